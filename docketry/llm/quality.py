"""Quality rules, line first: punctuation, navigation and boilerplate rules judge each line, failures are removed, and a
document that loses too much of its text is rejected. Only built-in functions; one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import hold, table, words

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line of this many words without any sentence mark is no prose.
UNPUNCTUATED_WORDS = 40
#: A line fails as navigation when so many of its words (percent) are separators or carry shouting marks.
MAX_SEPARATOR_PERCENT = 20
#: A document that loses more than this percentage of its characters in failing lines is rejected.
MAX_LOST_PERCENT = 50

SEPARATOR = r"(?:^|[\x20\t])[|>»•·/\\-]+(?=[\x20\t]|$)"
NOISY = r"[#*$%&<>]{2,}|!!|[#*$%&]{1}\S*[#*$%&]{2,}"
BOILERPLATE = (
    r"(?i)^\W*(?:all rights reserved|copyright (?:©|\(c\))|©|accept (?:all )?cookies|we use cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)"
    r"|subscribe to|sign (?:in|up)|log ?in|share (?:this|on)|follow us|read more|click here|skip to (?:main )?content|back to top|advertisement|powered by)\b"
)
BOILERPLATE_WORDS = 25
WORDED = r"[^\x20\x09-\x0D]"


def line_fails(line: Column) -> Column:
    """Whether a line goes. Lines without a word never fail."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    unpunctuated = (n >= UNPUNCTUATED_WORDS) & ~line.rlike(r"[.!?…。！？]")
    navigation = (n >= 4) & (F.regexp_count(line, F.lit(SEPARATOR)) * 100 > n * MAX_SEPARATOR_PERCENT)
    noise = (n >= 4) & (F.regexp_count(line, F.lit(NOISY)) * 100 > n * MAX_SEPARATOR_PERCENT)
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return navigation | noise | unpunctuated | boilerplate


def window_hashes(w: Column, n: Column) -> Column:
    """A hash for each WINDOW-word window of a text.

    ``quality`` counts the words in windows that a text holds twice or more. Windows are compared by 64-bit hashes within one text. Most texts repeat none and are done after a hash set; the others
    are sorted by hash, and the windows that have an equal neighbour are laid over the text.
    """
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    return F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def quality(df: DataFrame) -> DataFrame:
    """``df`` with a struct ``quality``: base counts, base_failed, kept, lines and characters lost, and the cleaned ``text``.

    Null text: no words, base_failed, not kept, cleaned text null. A text whose lines all pass keeps its very text. Other
    columns pass through, whatever their names; one named like the struct is replaced by it. Counts are 64-bit. Repeated rows
    come back as often as they stand there; an empty table gives none.
    """
    names = [c for c in df.columns if c != "quality"]
    step = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("t"))
    text = F.coalesce(F.col("t"), F.lit(""))
    judged = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), x.rlike(WORDED).alias("worded")))
    judged = F.transform(judged, lambda x: F.struct(x["line"].alias("line"), x["worded"].alias("worded"), F.when(x["worded"], line_fails(x["line"])).otherwise(F.lit(False)).alias("fails")))
    step = hold(step, w=words(F.col("t")), l=judged)
    step = step.withColumn("n", F.size("w"))
    step = hold(step, h=window_hashes(F.col("w"), F.col("n")), worded=F.transform(F.filter("l", lambda x: x["worded"]), lambda x: x["line"]), fails=F.filter("l", lambda x: x["fails"]))
    step = hold(step, d=F.size("h") != F.size(F.array_distinct("h")))
    step = hold(step, s=F.when(F.col("d"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i: F.get(F.col("s"), i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce(same(i) == F.when(i > 0, same(i - 1)), F.lit(False)) | F.coalesce(same(i) == same(i + 1), F.lit(False)))
    step = hold(step, p=F.when(F.col("d"), F.array_sort(F.transform(twice, lambda i: F.get(F.col("s"), i)["i"]))))
    reach = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("long")
    n, repeats = long(F.col("n")), long(F.coalesce(F.when(F.col("d"), reach), F.lit(0)))
    lost = F.aggregate("fails", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["line"]))
    step = hold(step, r=repeats, lost=lost)
    clean = F.when(F.size("fails") == 0, F.col("t")).otherwise(F.array_join(F.transform(F.filter("l", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"))
    failed = (n < MIN_WORDS) | (F.col("r") * 100 > n * MAX_REPEAT_PERCENT)
    out = F.struct(
        n.alias("n_words"),
        long(F.length(F.translate(text, BLANKS, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("worded") - F.size(F.array_distinct("worded"))).alias("n_dup_lines"),
        F.col("r").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("lost") * 100 <= long(F.length(text)) * MAX_LOST_PERCENT)).alias("kept"),
        long(F.size("fails")).alias("lines_lost"),
        F.col("lost").alias("chars_lost"),
        clean.alias("text"),
    )
    return hold(step, quality=out).select(*(F.col("row")[c].alias(c) for c in names), "quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_lost", "chars_lost")))


#: ``query`` as SQL for DuckDB. Its regular expressions have no lookahead: separators are counted among words split at blanks.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
j AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    len(list_filter(regexp_split_to_array(regexp_replace(line, '[\r\x{{85}}\x{{2028}}\x{{2029}}]$', ''), '[\x20\t]'), lambda x: regexp_full_match(x, '[|>»•·/\\-]+'))) AS separators,
    len(regexp_extract_all(line, '{NOISY.replace(chr(92) + "S", "[^ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "x0B" + chr(92) + "f" + chr(92) + "r]")}')) AS noisy
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
f AS (
  SELECT rid, line,
    (n >= 4 AND separators * 100 > n * {MAX_SEPARATOR_PERCENT}) OR (n >= 4 AND noisy * 100 > n * {MAX_SEPARATOR_PERCENT})
    OR (n >= {UNPUNCTUATED_WORDS} AND NOT regexp_matches(line, '[.!?…。！？]')) OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}')) AS fails
  FROM j
),
s AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS lines_lost, coalesce(sum(length(line)) FILTER (fails), 0) AS chars_lost FROM f GROUP BY rid
),
v AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
c AS (SELECT rid, count(*) AS n FROM v GROUP BY rid),
k AS (
  SELECT rid, i, lead(x, {WINDOW - 1}) OVER o AS last, concat_ws(' ', x, {", ".join(f"lead(x, {i}) OVER o" for i in range(1, WINDOW))}) AS words
  FROM v WINDOW o AS (PARTITION BY rid ORDER BY i)
),
p AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words) AS n FROM k WHERE last IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM p, range({WINDOW}) AS q(o) WHERE n > 1 GROUP BY rid),
e AS (
  SELECT doc_id, t, coalesce(c.n, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lines_lost, 0) AS lines_lost, coalesce(chars_lost, 0) AS chars_lost,
    coalesce(c.n, 0) < {MIN_WORDS} OR coalesce(r.n, 0) * 100 > coalesce(c.n, 0) * {MAX_REPEAT_PERCENT} AS base_failed
  FROM d LEFT JOIN s USING (rid) LEFT JOIN c USING (rid) LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chars_lost * 100 <= length(t) * {MAX_LOST_PERCENT} AS kept, lines_lost, CAST(chars_lost AS BIGINT) AS chars_lost
FROM e
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those with a null or empty text among them; the others lose their failing lines.

    Each row is judged alone, so repeated rows share a fate, and null ids and columns of any other name pass through (one
    named ``quality`` goes)."""
    out = quality(docs).filter("quality.kept")
    new = {"text": F.col("quality.text"), "n_chars": F.length("quality.text").cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns if c != "quality"))
