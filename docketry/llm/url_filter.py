"""URL filters by link-graph propagation: personalised PageRank from trusted hosts, and reversed distrust from blocked ones.

Rules judge urls directly. A host's seeds are the shares of its pages that rules allow or block; trust flows along host edges
(links in the pages' html), distrust against them, each seed decayed by DAMPING a step until no score moves by TOLERANCE.
What arrives grows with a host's links, so it is divided by what would arrive if every host were all seed: trust and distrust
are shares from 0 to 1 of the hosts that a host hears of, the nearer ones weighing more. A host of which no page is judged
says nothing about itself and doesn't count among them. A page that no rule judges is blocked when its host's distrust reaches
BLOCK_AT and exceeds its trust. Only built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import LOWER, UPPER, ascii_lower, discard, settle, table

#: (host, path prefix, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DAMPING, TOLERANCE = 0.85, 1e-6
#: Steps between two looks at what has moved; what moves less than TOLERANCE in them has less than that still to come.
STRIDE = 5
#: Steps that the SQL makes: 0.85^120 is under 1e-8.
ROUNDS = 120
BLOCK_AT = 0.5
LINK = r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null urls and those without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def match(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct; null if none does."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted; ``pages`` has host and html."""
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    dst = ascii_lower(F.regexp_extract("to", r"//([^/?#]*)", 1))
    return linked.select("src", dst.alias("dst")).filter("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from ``seeds(host, trust, distrust)`` over ``edges(src, dst, n)``: each a personalised PageRank over one
    from every host, which is carried beside it. Hosts that are only linked to or from have no seed."""
    edges = settle(edges, "edges")
    out, into = edges.groupBy("src").agg(F.sum("n").alias("all")), edges.groupBy("dst").agg(F.sum("n").alias("all"))
    arcs = edges.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("w"))
    arcs = settle(arcs.union(edges.join(into, "dst").select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n") / F.col("all"))), "arcs")
    every = seeds.union(edges.select(F.explode(F.array("src", "dst")), F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust"))
    own = F.when(F.col("trust") + F.col("distrust") > 0, 1.0).otherwise(0.0)
    base = settle(every.select("host", own.alias("own"), F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")), "seeds")
    score = base.select("host", "kind", F.col("seed").alias("s"), F.lit(1.0).alias("u"))
    moved = 0.0 if arcs.isEmpty() else math.inf
    while moved >= TOLERANCE:
        now = score
        for _ in range(STRIDE):
            flow = now.withColumnRenamed("host", "src").join(arcs, ["kind", "src"]).select(F.col("dst").alias("host"), "kind", *((F.col(x) * F.col("w") * DAMPING).alias(x) for x in ("s", "u")))
            now = flow.union(base.select("host", "kind", "seed", F.lit(1.0))).groupBy("host", "kind").agg(F.sum("s").alias("s"), F.sum("u").alias("u"))
        now = settle(now, "scores")
        change = F.try_divide(F.greatest(F.abs(F.col("s") - F.col("s0")), F.abs(F.col("u") - F.col("u0"))), F.col("u") - 1)  # of what arrives
        moved = now.join(score.withColumnsRenamed({"s": "s0", "u": "u0"}), ["host", "kind"]).agg(F.coalesce(F.max(change), F.lit(0.0)).alias("x")).first()["x"]
        discard(score)
        score = now
    share = F.try_divide("s", F.greatest(F.col("u") - 1 + F.col("own"), F.lit(0.0)))
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, share)), F.lit(0.0)).alias(kind)
    return score.join(base, ["host", "kind"]).groupBy("host").agg(pick("trust"), pick("distrust"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of ``pages(page_id, url, html)``.

    Null urls have an empty host and path, match no rule and are allowed; null html has no links. Repeated rows come back
    as often as they stand there.
    """
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("m", match(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("m.verdict") == v, 1.0).otherwise(0.0))
    seeds = own.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(own))
    verdict = F.when((F.col("distrust") >= BLOCK_AT) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return own.drop("html").join(scores, "host", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", verdict).alias("verdict"), zero("trust"), zero("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def oracle_sql(rules=RULES) -> str:
    """``query`` as SQL for DuckDB: each step one common table, ROUNDS of them; scores agree within TOLERANCE."""
    fits = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in fits) + " END"
    link = LINK.replace("'", "''")
    rounds = ", ".join(
        f"s{k + 1} AS (SELECT host, kind, sum(s) AS s, sum(u) AS u FROM (SELECT a.dst AS host, a.kind, s{k}.s * a.w * {DAMPING} AS s, s{k}.u * a.w * {DAMPING} AS u FROM s{k} JOIN arcs a ON a.src = s{k}.host AND a.kind = s{k}.kind UNION ALL SELECT host, kind, s, u FROM s0) GROUP BY host, kind)"
        for k in range(ROUNDS)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS own FROM h),
seeds AS (
  SELECT host, CAST(avg(CASE WHEN own = 'allow' THEN 1 ELSE 0 END) AS DOUBLE) AS trust, CAST(avg(CASE WHEN own = 'block' THEN 1 ELSE 0 END) AS DOUBLE) AS distrust
  FROM m WHERE host <> '' GROUP BY host
),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS target FROM m WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(target, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst FROM l) WHERE dst <> '' AND src <> dst GROUP BY src, dst),
arcs AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e
),
every_ AS MATERIALIZED (SELECT host, max(trust) AS trust, max(distrust) AS distrust FROM (SELECT * FROM seeds UNION ALL SELECT src, 0, 0 FROM e UNION ALL SELECT dst, 0, 0 FROM e) GROUP BY host),
s0 AS MATERIALIZED (SELECT host, 'trust' AS kind, trust AS s, CAST(1 AS DOUBLE) AS u FROM every_ UNION ALL SELECT host, 'distrust', distrust, 1 FROM every_),
{rounds},
r AS (SELECT host, kind, s / nullif(greatest(u - CASE WHEN trust + distrust > 0 THEN 0 ELSE 1 END, 0), 0) AS share FROM s{ROUNDS} JOIN every_ USING (host)),
scores AS (SELECT host, coalesce(max(share) FILTER (kind = 'trust'), 0) AS trust, coalesce(max(share) FILTER (kind = 'distrust'), 0) AS distrust FROM r GROUP BY host),
j AS (SELECT page_id, m.host, path, rule, own, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM m LEFT JOIN scores USING (host))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN distrust >= {BLOCK_AT} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM j
"""
