"""The operators against plain Python that tries every pair, window, line or rule."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import chat_format, decontaminate, html_extract, license_scan, line_dedup, quality, registry, suffix_tree_lm, url_filter

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, table="documents", key="doc_id"):
    return {r[0]: r.text for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key, "text").collect()}


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_decontamination_tries_every_window(spark):
    grams = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(ALNUM.findall((t or "").translate(LOW)))
    rng = random.Random(2)
    items = documents(spark, "benchmark", "item_id")
    items |= {1000 + i: " ".join(rng.choice("abc") for _ in range(30)) for i in range(5)}
    texts = documents(spark)
    for i, item in enumerate(list(items.values()) * 3):
        w = item.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        texts[10_000 + i] = " ".join([*(f"x{rng.randrange(999)}" for _ in range(rng.randrange(40))), *w[i % 3 :], *(f"x{rng.randrange(999)}" for _ in range(30 * (i % 2)))])
    want, best = set(), {}
    for d, t in texts.items():
        own = grams(t)
        for k, item in items.items():
            it = grams(item)
            if not it or not set(own) & set(it):
                continue
            full = collections.Counter(it)
            top = max(weighted(collections.Counter(own[s : s + len(it)]), full) for s in range(max(1, len(own) - len(it) + 1)))
            if top >= 0.75:
                want.add((d, k))
                best[d, k] = top
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert set(got) == want
    assert got == pytest.approx(best)


def test_line_dedup_tries_every_pair(spark):
    rng = random.Random(4)
    texts = {k: t for k, t in documents(spark).items() if len(t) < 20_000}
    for k in range(60):
        line = list("the quick brown fox of line number one jumps over lazy dogs near the river bank again")
        for _ in range(rng.randrange(6)):
            line[rng.randrange(len(line))] = rng.choice("QZX ")
        texts[50_000 + k] = "".join(line) + f"\n{k}\n ok "
    where, lines = collections.defaultdict(list), {}
    for d, t in texts.items():
        for n, line in enumerate(t.split("\n")):
            s = line.strip(" \t\n\r\x0b\x0c").translate(LOW)
            if s:
                where[s].append((d, n))
                lines[s] = {s[i : i + 8] for i in range(len(s) - 7)} or {s}
    parent = {s: s for s in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for s, grams in lines.items():
        shared = collections.Counter(o for g in grams for o in index[g])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(grams) + len(lines[o]) - n):
                parent[root(s)] = root(o)
        for g in grams:
            index[g].append(s)
    groups = collections.defaultdict(list)
    for s, places in where.items():
        groups[root(s)] += places
    gone = {p for places in groups.values() for p in places if p != min(places)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in texts.items()}


def test_url_scores_match_power_iteration(spark):
    rng = random.Random(6)
    hosts = [f"h{i}.org" for i in range(12)] + ["good.net", "bad.com"]
    pages = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'en/', 'x'])}{i}", "".join(f'<a href="http://{rng.choice(hosts)}/">' for _ in range(rng.randrange(4)))) for i in range(90)]
    host = {i: u.split("/")[2] for i, u, _ in pages}
    rule = lambda u: "allow" if re.match(r"http://good\.net/de/", u) else "block" if re.match(r"http://bad\.com/en/", u) else None
    seed = {v: {h: sum(rule(u) == v for i, u, _ in pages if host[i] == h) / max(1, sum(x == h for x in host.values())) for h in hosts} for v in ("allow", "block")}
    assert any(seed["allow"].values()) and any(seed["block"].values())
    links = collections.Counter((host[i], to) for i, _, html in pages for to in re.findall(r"http://([^/]+)/", html) if to != host[i])
    score = {}
    for v in seed:
        arcs = {(a, b) if v == "allow" else (b, a): n for (a, b), n in links.items()}
        out = collections.Counter()
        for (a, _), n in arcs.items():
            out[a] += n
        step = lambda s, own: {h: own[h] + 0.85 * sum(s[a] * n / out[a] for (a, b), n in arcs.items() if b == h) for h in hosts}
        s, u, ones = dict(seed[v]), dict.fromkeys(hosts, 1.0), dict.fromkeys(hosts, 1.0)
        for _ in range(300):
            s, u = step(s, seed[v]), step(u, ones)
        score[v] = {h: s[h] / w if (w := u[h] - (not any(seed[x][h] for x in seed))) > 1e-9 else 0.0 for h in hosts}
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [("good.net", "/de/", "allow"), ("bad.com", "/en/", "block")]).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx((score["allow"][r.host], score["block"][r.host]), abs=2e-6)
        url = next(u for i, u, _ in pages if i == r.page_id)
        assert r.verdict == (rule(url) or ("block" if r.distrust >= 0.5 and r.distrust > r.trust else "allow"))


def test_url_query_matches_its_sql(spark):
    """On the given pages, whose links are all internal, and on pages with links between hosts."""
    rng = random.Random(3)
    hosts = ["a.com", "b.net", "www.c.org", "d.io", "e.example.net"]
    pages = [(900_000 + i, f"https://{rng.choice(hosts).upper()}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randrange(99)}?q#f", f"<a href='//{rng.choice(hosts)}/x'> <A HREF = \"https://{rng.choice(hosts)}\">") for i in range(60)]
    pages += [(1, None, None), (1, None, None), (2, "no scheme", ""), (None, "://", "<a href=http://a.com>")]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    con.execute(f"insert into pages select page_id, url, html from '{SF}/pages.parquet'")
    cur = con.execute(registry.ORACLES["op1_url_filter"])
    names = [c[0] for c in cur.description]
    sort = lambda rows: sorted(rows, key=lambda r: (r[0] is None, *map(str, r[:5])))
    want = sort(cur.fetchall())
    df = url_filter.judge(spark.createDataFrame(con.execute("select * from pages").fetchall(), "page_id long, url string, html string"))
    got = sort(map(tuple, df.select(*names).collect()))
    assert sorted(df.columns) == sorted(names) and [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=2e-6)
    assert all(r[5] > 0 and r[6] > 0 for r in want if r[1] == "d.io")  # no rule fits it: what it has came along links


def test_license_rules_one_by_one(spark):
    rng = random.Random(8)
    names = ["mit", "Apache-2.0", "the GPL v3", "gpl version 2", "CC-BY-NC-SA 4.0", "bsd 3-clause", "mozilla public license 2.0", "lesser general public", "zlib", "EUPL-1.2"]
    around = ["licensed under the {}", "Released under the terms of the {} license.", "SPDX-License-Identifier: {}", "{} licence", "cc by nc {}", "under the mit license, {}", "Apache License, Version 2 {}"]
    texts = documents(spark) | {70_000 + i: " -- ".join(rng.choice(around).format(rng.choice(names)) for _ in range(3)) for i in range(60)}
    rules = license_scan.rules()
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, t in texts.items():
        w = ALNUM.findall(t.translate(LOW))
        norm = " " + " ".join(w) + " "
        base = {(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
        found = set()
        for r in rules:
            for m in re.finditer(r["pattern"], norm):
                found.add((norm[: m.start()].count(" ") - 1, m.group().count(" ") + 1, r["label"], r["priority"], r["confidence"]))
        left = {a for a in found if not any(b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] and (b[3] > a[3] or (b[3] == a[3] and b[1] > a[1])) for b in found)}
        assert {(b.at, b.label) for b in got[d].base} == base and len(got[d].base) == len(base) and got[d].n_words == len(w)
        assert got[d].labels == sorted({b[1] for b in base} | {a[2] for a in left})
        assert got[d].score == max([a[4] for a in left] + [0.85 if base else 0.0])


def test_quality_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet' union all by name select -i as doc_id, t as text from (values (1, null), (2, ''), (3, ' \n\t '), (4, repeat('a b ', 300) || '\n| x | y | z'), (5, repeat('Some words here. ', 9) || '\nread more\n\n© all\n' || repeat('home > ', 90))) v(i, t)")
    want = con.execute(registry.ORACLES["op6_quality_rules"]).fetchall()
    names = [c[0] for c in con.description]
    frame = spark.createDataFrame(con.execute("select doc_id, text from documents").fetchall(), "doc_id long, text string")
    frame.write.mode("overwrite").parquet((folder := "/tmp/docketry-test-quality") + "/documents.parquet")
    got = quality.query(spark, folder)
    assert sorted(got.columns) == sorted(names) and sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    assert 0 < sum(r[names.index("kept")] for r in want) < len(want) and any(r[names.index("lines_lost")] for r in want)


@pytest.mark.parametrize("room", [suffix_tree_lm.ROOM, 0, 600])
def test_suffix_tree_matches_plain_counts(spark, room):
    least = 4
    rng = random.Random(2)
    chain = [f"chain{i}" for i in range(9)]
    texts = dict(list(documents(spark).items())[:120])
    texts |= {10**6 + i: " ".join((["x", "y"] if rng.random() < 0.5 else ["z", "y"]) + chain[: rng.randrange(2, 9)] + [f"once{i}"]) for i in range(200)}
    texts |= {2 * 10**6 + i: " ".join([a, "p", "q", "r" + a] * 3) for i, a in enumerate("abcd" * 30)}
    docs = {k: [*WORD.findall(t.translate(LOW)), None] for k, t in texts.items()}
    rows = suffix_tree_lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), least, room).collect()
    train = [docs[r.doc_id] for r in rows if not r.held_out]
    c = collections.Counter(x for w in train for x in w)
    size = sum(c.values()) + len(c) + 1
    base = lambda x: (c[x] + 1) / size
    states, depth = {(): None}, 0

    def given(context, word):
        for s in (context[i:] for i in range(len(context))):
            if s in states and all(s[i:] in states for i in range(len(s))):
                n, own = states[s]
                return (own.get(word, 0) + (n - sum(own.values()) + 1) * given(s[1:], word)) / (n + 1)
        return base(word)

    while depth < suffix_tree_lm.DEEPEST and any(len(s) == depth for s in states):
        depth += 1
        grams = collections.Counter(tuple(w[i - depth : i + 1]) for w in train for i in range(depth, len(w)))
        kids, totals = collections.defaultdict(dict), collections.Counter()
        for g, n in grams.items():
            totals[g[:-1]] += n
            if n >= least and g[1:-1] in states:
                kids[g[:-1]][g[-1]] = n
        for s, own in kids.items():
            n, rest = totals[s], totals[s] - sum(own.values())
            gain = sum(k * math.log(k / n / given(s[1:], x)) for x, k in own.items())
            if rest > 0:
                gain += rest * math.log(rest / n / max(1e-12, 1 - sum(given(s[1:], x) for x in own)))
            if gain >= suffix_tree_lm.DIVERGENCE:
                states[s] = (n, own)
    assert {len(s) for s in states} >= {0, 1, 2, 3}
    for r in rows:
        w = docs[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(given(tuple(w[max(0, i - 8) : i]), x)) for i, x in enumerate(w)))
        assert r.base_score == pytest.approx(sum(math.log10(base(x)) for x in w)) and (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))


def test_suffix_tree_remembers_a_phrase_however_much_else_there_is(spark):
    """A phrase seen 500 times scores alike per token among other text of 1x and 10x."""
    rng, means = random.Random(4), []
    for much in (1, 10):
        rows = [(i, "seven grey herons cross the frozen weir") for i in range(500)]
        rows += [(1000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(100))) for i in range(400 * much)]
        got = suffix_tree_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 500").collect()
        gains = {round(r.score - r.base_score, 6) for r in got}
        assert len(gains) == 1 and (first := got[0].score - got[0].base_score) > 0
        # all words but the first follow their context nearly always: what they cost doesn't grow with the rest
        means.append(got[0].score - math.log10(501 / (got[0].train_tokens + 3008)))
        assert first > 10
    assert abs(means[0] - means[1]) < 0.2


def test_chat_digests_match_the_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [(role, "\\### Assistant: </turn> ok") for role in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {k: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len("".join(b for a, b in t if a == "assistant")), sha("".join(b for a, b in t if a == "assistant"))) for k, t in turns.items()}
    got = chat_format.query(spark, SF).collect()
    assert len(got) == len(want) and {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_suffix_array_finds_every_repeated_run():
    rng = np.random.default_rng(9)
    for n, letters, run in [(0, 2, 3), (2, 2, 3), (60, 2, 4), (300, 3, 5), (400, 2, 8), (200, 40, 1)]:
        tokens, page = rng.integers(0, letters, n), np.sort(rng.integers(0, 1 + n // 20, n))
        on = collections.defaultdict(set)
        runs = [(tuple(tokens[i : i + run]), i) for i in range(n - run + 1) if page[i] == page[i + run - 1]]
        for r, i in runs:
            on[r].add(page[i])
        want = np.zeros(n, bool)
        for r, i in runs:
            if len(on[r]) >= 3:
                want[i : i + run] = True
        assert html_extract.repeated(tokens, page, run, 3).tolist() == want.tolist()


def test_packed_keys_of_runs_come_back():
    rng = np.random.default_rng(3)
    for size, buckets, n in ((10, 1, 1), (5_000_000, 8, 40_000), (60_000_000_000, 3000, 200_000), (10**14, 10**6, 5_000)):
        keys = html_extract.Keys(size, buckets)
        own = np.unique(keys.of(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)))
        assert len(own) >= n - 2
        some, cuts, low, high = keys.pack(own)
        assert sorted(set(some.tolist())) == some.tolist() and cuts[-1] == len(own) and some.max() < keys.buckets
        begin = keys._begin(some).astype(np.uint64) << np.uint64(8 * keys.low)
        got = np.concatenate([keys.unpack(x, y) + b for x, y, b in zip(low, high, begin, strict=True)])
        assert got.tolist() == own.tolist()
        assert all(np.array_equal(x, y) for x, y in zip(keys.cells(own), (some, cuts), strict=True))


def test_html_extraction_over_many_chunks_equals_one(spark):
    """Chunks of a few pages find what one of all pages finds."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = {tuple(r) for r in html_extract.extract(pages).collect()}
    assert {tuple(r) for r in html_extract.extract(pages, chunk=20_000).collect()} == whole


def test_html_extraction_drops_what_many_pages_of_a_host_share(spark):
    rng = random.Random(12)
    menu = "Home News Sport Weather Travel Culture Money Contact"
    own = {i: [" ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 5))] for i in range(40)}
    pages = [(i, f"http://site{i % 2}.org/{i}", "".join(f"<div>{b}</div>" for b in [menu, *blocks, "All pages end with this very same footer line"])) for i, blocks in own.items()]
    pages.append((99, "http://alone.org/", f"<div>{menu}</div><div>one page of its host</div>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(b) for i, b in own.items()} | {99: f"{menu}\n\none page of its host"}


def test_html_extraction_counts_over_the_whole_host(spark):
    """A notice on few pages of a large host goes."""
    rng = random.Random(13)
    own = {i: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**9)}" for _ in range(12)) for i in range(2000)}
    notice = "This very notice stands on few pages of its host"
    pages = [(i, "http://big.org/", f"<div>{b}</div>" + f"<div>{notice}</div>" * (i % 500 == 0)) for i, b in own.items()]
    assert {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == own


def test_html_extraction_counts_over_the_whole_host_and_inside_articles(spark):
    """A notice on few pages of a large host goes, but for articles named by markup, of which it may be a part; exact copies of one article stay."""
    rng = random.Random(13)
    words = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**9)}" for _ in range(n))
    notice, copy = "This very notice stands on few pages of its host", words(40)
    own = {i: words(12) for i in range(2000)}
    page = lambda i, more: (i, f"http://big{i % 2}.org/{i}", (f"<article><p>{own[i]}</p>{more}</article>" if i % 4 < 2 else f"<div>{own[i]}</div>{more}"))
    pages = [page(i, f"<p>{notice}</p>" if i % 2 == 0 and i % 250 < 2 else "") for i in own]
    pages += [(5000 + i, "http://big0.org/copy", f"<article><p>{copy}</p></article>") for i in range(5)]
    pages += [(6000 + i, f"http://two{i // 2}.org/", f"<article><p>{words(9)}</p><p>{notice}</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert sum(notice in p[2] for p in pages[:2000]) == 8
    assert {i: t for i, t in got.items() if i < 5000} == {i: t + f"\n\n{notice}" * (i % 500 == 0) for i, t in own.items()}
    assert all(got[5000 + i] == copy for i in range(5)) and all(got[6000 + i].endswith(f"\n\n{notice}") for i in range(4))


def test_html_extraction_keeps_articles(spark):
    """Editions of one article stay whole, as do lines that many articles share; what most of a host's articles begin or end with goes."""
    rng = random.Random(14)
    words = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**9)}" for _ in range(n))
    title, text = words(8), [words(30) for _ in range(4)]
    page = lambda i, host, blocks: (i, f"http://{host}/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>")
    pages, want = [], {}
    for i in range(3):
        want[i] = [title, *text, f"Updated edition number {i} of this"]
        pages.append(page(i, "editions.org", want[i]))
    notice, line = words(9), words(9)
    for i in range(100, 160):
        want[i] = [words(60), *[line] * (i % 3 == 0), words(60)]
        pages.append(page(i, "many.org", [*[notice] * (i % 4 == 0), *want[i], *[notice] * (i % 4 in (1, 2))]))
    for i in range(200, 240):  # the notice is not at an end, or is most of the article
        want[i] = [words(60), notice, words(60)] if i % 2 else [notice, words(12)]
        pages.append(page(i, "other.org", want[i]))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for chunk in (html_extract.CHUNK, 2_000):
        assert {r.page_id: r.text for r in html_extract.extract(df, chunk).collect()} == {i: "\n\n".join(b) for i, b in want.items()}


def test_license_rules_need_no_word_but_their_own(spark):
    """Texts that never say license, against each rule alone; the anchors stand in whatever their templates match."""
    rng = random.Random(14)
    names = ["MIT", "the BSD 3-clause", "Apache 2.0", "zlib", "the GNU Free Documentation", "Python Software Foundation", "FreeBSD", "x11", "ruby", "GPL v3", "cc0", "the Unlicense", "Apache 1.1", "the OpenSSL"]
    around = ["Released under the {}.", "distributed under the terms of {}", "made available under {}", "Published under {}", "under the terms of {}, as is", "under {}", "{} only", "subject to {}"]
    texts = {k: f" -- {rng.randrange(9)} ".join(rng.choice(around).format(rng.choice(names)) for _ in range(rng.randrange(1, 4))) for k in range(300)}
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, t in texts.items():
        norm, found = " " + " ".join(ALNUM.findall(t.translate(LOW))) + " ", set()
        for r in license_scan.rules():
            for m in re.finditer(r["pattern"], norm):
                assert r["anchor"] in norm and r["keyword"] in norm
                found.add((norm[: m.start()].count(" ") - 1, m.group().count(" ") + 1, r["label"], r["priority"], r["confidence"]))
        left = {a for a in found if not any(b[0] <= a[0] and a[0] + a[1] <= b[0] + b[1] and (b[3] > a[3] or (b[3] == a[3] and b[1] > a[1])) for b in found)}
        assert {tuple(x) for x in got[d].detections} == left and got[d].score == max([a[4] for a in left], default=0.0)
    scored = license_scan.scan(spark.createDataFrame([(1, "Released under the MIT"), (2, "distributed under the terms of the BSD 3-clause")], "doc_id long, text string")).collect()
    assert [r.license.labels for r in sorted(scored)] == [["mit"], ["bsd-3"]]


def test_line_bands_miss_few_pairs_of_short_lines():
    """Pairs at 0.75 and a little above, of few shingles, across the change of scheme, and with repeated shingles."""
    rng, n = np.random.default_rng(15), 1500
    for common, a, b in [(3, 1, 0), (6, 1, 1), (5, 1, 0), (9, 1, 2), (12, 2, 2), (15, 5, 0), (39, 0, 12), (40, 0, 13), (41, 0, 13), (60, 10, 10)]:
        first, second = [], []
        for _ in range(n):
            x = rng.integers(0, 2**63, common + a + b).astype(np.uint64)
            first.append(np.repeat(x[: common + a], 1 + common % 2))
            second.append(np.concatenate((x[:common], x[common + a :])))
        spans = first + second
        span, band = line_dedup._bands(np.concatenate(spans), np.repeat(np.arange(2 * n), [len(x) for x in spans]), 2 * n)
        keys = collections.defaultdict(set)
        for s, k in zip(span.tolist(), band.tolist(), strict=True):
            keys[s].add(k)
        missed = sum(not keys[i] & keys[n + i] for i in range(n)) / n
        print(common, a, b, missed)
        assert missed <= 0.01


def test_url_scores_converge_on_a_cycle(spark):
    """Two hosts that link each other, one of them all seed: 1 / (1 - 0.85^2) and 0.85 of that arrive, of 1 / 0.15 and, without itself, 0.85 / 0.15."""
    link = '<a href="http://{}/">'
    df = spark.createDataFrame([(1, "http://a.org/x", link.format("b.org")), (2, "http://b.org/", link.format("a.org"))], "page_id long, url string, html string")
    got = {r.page_id: r.trust for r in url_filter.judge(df, [("a.org", "/x", "allow")]).collect()}
    assert got == pytest.approx({1: 0.15 / (1 - 0.85**2), 2: 0.15 / (1 - 0.85**2)}, abs=2e-6)


def test_url_scores_do_not_grow_with_links(spark):
    """A hub of thirty hosts with a twentieth of their pages blocked each is allowed, a hub of blocked hosts blocked."""
    pages, link = [], lambda to: "".join(f'<a href="http://{h}/">' for h in to)
    for name, blocked in (("part", 1), ("whole", 20)):
        hosts = [f"{name}{i}.com" for i in range(30)]
        pages += [(len(pages) + n, f"http://{h}/{'en/' if n < blocked else 'x/'}{n}", "") for h in hosts for n in range(20)]
        pages.append((90_000 + blocked, f"http://{name}-hub.org/", link(hosts)))
    pages.append((90_100, "http://mixed-hub.org/", link([f"whole{i}.com" for i in range(5)] + [f"part{i}.com" for i in range(25)])))
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [("com", "/en/", "block")]).collect()}
    assert [got[i].verdict for i in (90_001, 90_020, 90_100)] == ["allow", "block", "allow"]
    assert got[90_001].distrust == pytest.approx(0.05, abs=1e-3) and got[90_020].distrust == pytest.approx(1, abs=1e-3)


def test_decontamination_finds_swapped_halves_and_short_items(spark):
    rng = random.Random(21)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, third = w(60), w(60)
    docs = [(1, " ".join(w(40) + item[30:] + item[:30] + w(40))), (2, " ".join(third[40:] + third[20:40] + third[:20])), (3, " ".join(w(30) + ["Tiny,", "item"] + w(30))), (4, " ".join(w(90))), (5, "tiny item"), (6, " ".join(item[:40]))]
    items = [(7, " ".join(item)), (8, " ".join(third)), (9, "tiny item"), (10, ""), (11, " ".join(w(3)))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.start_word for r in got} == {(1, 7): 40, (2, 8): 0, (3, 9): 30, (5, 9): 0}


def test_html_markup_path_keeps_what_implied_ends_let_out(spark):
    pages = {
        1: ('<article><h1>T</h1><p class="ad">Buy<p>Real text<p>More</article>', "T\n\nReal text\n\nMore"),
        2: ('<main><ul><li class="share">S<li>Real item</ul><p>Para</p></main>', "Real item\n\nPara"),
        3: ('<main><ul><li class="share">S<ul><li>inner</ul>tail</ul><p>Para</main>', "Para"),
        4: ('<article><div class="article-header"><h1>Title</h1></div><p>Body</p></article>', "Title\n\nBody"),
        5: ('<article><table><tr><td class="ad">x<td>kept<tr><td>row</table><p>End</article>', "kept\n\nrow\n\nEnd"),
        6: ('<article><p class="notice">n<div>block</div></article><p>out</p>', "block"),
        7: ('<article><dl><dt class="promo">a<dd>b</dl><p>c</article>', "b\n\nc"),
        8: ("", ""), 9: (None, ""), 10: ("<article><p>" + "long words " * 200_000 + "</article>", ("long words " * 200_000).strip()),
    }
    df = spark.createDataFrame([(k, f"http://h{k}.org/", h, 1) for k, (h, _) in pages.items()], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {k: t for k, (_, t) in pages.items()}


def test_license_signatures_find_the_licenses_own_words(spark):
    """Each signature's plainest text is found, also among the words of others."""
    said = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "bsd-3": "Neither the name of the Foo Project nor the names of its contributors may be used to endorse or promote products",
        "apache-2": "you may not use this file except in compliance with the License.", "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "unlicense": "This is free and unencumbered software released into the public domain.",
        "cc-by-nc-sa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc0": "http://creativecommons.org/publicdomain/zero/1.0/", "ofl": "with Reserved Font Name Foo", "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    }
    rows = list(said.values())
    got = license_scan.scan(spark.createDataFrame([(i, f"x y, {t} z", "l", 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, license string, row int, __w int")).collect()
    assert all(label in next(r for r in got if r.doc_id == i).license.labels for i, label in enumerate(said)) and got[0].row == 1 and got[0]["__w"] == 2
    assert len(license_scan.rules()) >= 490


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, quality string, license int, row int, w int, lines_dropped int")
    for f in (quality.quality, license_scan.scan, line_dedup.dedup_lines, suffix_tree_lm.score):
        assert f(docs).collect() == []
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).collect() == [] and url_filter.judge(pages).collect() == []
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    long = spark.createDataFrame([(1, ("w" * 199 + " ") * 225_000, "q", 1, 2, 3, 4)], docs.schema)
    assert [(r.quality.n_words, r.row, r.w, r.lines_dropped) for r in quality.quality(long).collect()] == [(225_000, 2, 3, 4)]


def test_runs_of_words_meet_packed(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{w}" for w in rng.zipf(1.5, 300) % 400)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    def pairs(tokens, bounds):
        keep = np.ones(len(tokens) - 1, bool)
        keep[bounds[1:-1] - 1] = False  # not across two texts
        yield (suffix_tree_lm._combine(tokens, 2)[keep],)

    got = {r.k: r.n for r in suffix_tree_lm._counts(docs, pairs, [], 2**64, 5, 3).collect()}
    want = collections.Counter()
    for _, data, offsets in suffix_tree_lm.kernel.blocks(pa.array([t for _, t in docs.collect()])):
        want.update(next(pairs(*suffix_tree_lm._tokens(data, offsets)))[0].view(np.int64).tolist())
    assert got == {k: n for k, n in want.items() if n >= 3}
    keys = rng.integers(0, 2**44, 100_000).astype(np.uint64)
    sent = suffix_tree_lm._sent(keys, [], 2**44, 8)
    assert sent.nbytes < 5 * len(keys)  # 24 bytes and more each as rows of Spark
    h = rng.integers(0, 2**62, 40).astype(np.uint64)
    context, suffix = suffix_tree_lm._parts(suffix_tree_lm._combine(h, 4), h[:-3], h[3:], 3)
    assert (context == suffix_tree_lm._combine(h, 3)[:-1]).all() and (suffix == suffix_tree_lm._combine(h, 3)[1:]).all()


def test_large_trees_go_in_slices_without_a_row_a_token(spark, monkeypatch):
    kept, slices, settled, moves = [], [], suffix_tree_lm.settle, suffix_tree_lm._moves
    monkeypatch.setattr(suffix_tree_lm, "settle", lambda df, name, **how: (kept.append(name), settled(df, name, **how))[1])
    monkeypatch.setattr(suffix_tree_lm, "_moves", lambda held: (slices.append(1), moves(held))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lambda room: {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in suffix_tree_lm.score(docs, 4, room).collect()}
    want = rows(suffix_tree_lm.ROOM)
    assert not slices
    got = rows(1500)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(slices) > 1 and "tokens" not in kept
    runs = spark.range(1, 5000).selectExpr("xxhash64(id) k")
    keys = np.array([r.k for r in runs.collect()]).view(np.uint64)
    made = suffix_tree_lm.Filter(runs, len(keys), 2**10)
    assert made.parts > 1 and made.holds(keys).all() and made.holds(keys * np.uint64(3)).mean() < 0.05
