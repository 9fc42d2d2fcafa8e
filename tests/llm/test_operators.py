"""The operators against brute force on sf0.001 and on small tables with nulls, empty, long and repeated texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docketry.llm import bpe, chat_format, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, quality, suffix_tree_lm, url_filter

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "a b c d e f g h"), (6, "A b\nA b\na B"), (7, "x " * 3000), (8, "x " * 3000), (8, "x " * 3000), (9, "ü 😀 \x00 <|endoftext|> don't")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in ODD], "doc_id long, text string, row string, quality double")


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_jaccard_join_matches_brute_force(spark):
    got = {r.doc_id: r for r in jaccard_join.query(spark, SF).collect()}
    sets = {}
    for k, t in documents(spark).items():
        w = WORD.findall(t.translate(LOW))
        sets[k] = set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {k: (len(s), root(k)) for k, s in sets.items()} == {k: (r.n_shingles, r.component_id) for k, r in got.items()}


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for size in [1, 2, 4, 7, 12, 30, 75, 200]:
        for _ in range(40):
            s = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            r = s.copy()
            while len(r) > 1 and 100 * len(np.intersect1d(s, r[1:])) >= 75 * len(np.union1d(s, r[1:])):
                r = r[1:]
            extra = frozenset(jaccard_join.extras(s) + jaccard_join.extras(r))
            (a, pa), (b, pb) = jaccard_join.signatures(s, extra), jaccard_join.signatures(r, extra)
            assert set(a[pa].tolist()) & set(b.tolist()) or set(b[pb].tolist()) & set(a.tolist())


def test_jaccard_join_on_odd_rows(spark):
    got = jaccard_join.jaccard_components(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[4] == {(1, 4)} and by[5] == {(1, 4)} and by[8] == {(1, 7)} and by[None] == {(4, None)}


def test_line_dedup_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "Keep me.\nrepeated line here\n"), (2, "repeated  x\nRepeated line here"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "'z' as row", "1 as drop")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == "Keep me.\nrepeated line here\n" and got[2].text == "repeated  x" and got[2].lines_dropped == 1
    assert got[3].text is None and got[4].text == "" and got[1].row == "z"
    assert line_dedup.dedup_lines(df.filter("doc_id > 9")).collect() == []
    assert line_dedup.dedup_lines(odd(spark)).count() == len(ODD)


def test_line_dedup_joins_near_lines(spark):
    line = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, line.replace(f"word{i} ", "") + f"\n{hashlib.md5(bytes([i])).hexdigest()}") for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.lines_dropped for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: 0} | {i: 1 for i in range(1, 12)}


def test_bpe_matches_the_library(spark):
    import tokenizers

    own, lib = bpe.automaton(bpe.vocabulary()), tokenizers.Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(3)
    texts = [*documents(spark).values(), *(t or "" for _, t in ODD), *("".join(rng.choice("ab eht'sin10\né  ") for _ in range(80)) for _ in range(300))]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.array(ids, "<u4").tobytes() == own.encode(t)
        assert lib.decode(ids, skip_special_tokens=False) == own.decode(own.encode(t)) == t
    assert bpe.encode_decode(odd(spark)).count() == len(ODD)


def test_quality_base_counts(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    for k, t in documents(spark).items():
        w, r = WORD.findall(t), got[k]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)
    rows = quality.quality(odd(spark)).collect()
    assert len(rows) == len(ODD) and not any(r.quality.kept for r in rows)


def test_decontamination_finds_planted_and_only_those(spark):
    rng = random.Random(5)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, other = w(40), w(40)
    near = item[:20] + ["CHANGED"] + item[20:]
    docs = [(1, " ".join(w(50) + item + w(50))), (2, " ".join(w(9) + near + w(9))), (3, " ".join(w(200))), (4, " ".join(item[:15])), (5, None), (6, ""), (None, " ".join(item).upper() + "!")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7), (None, 7)}


def test_lm_counts_and_gain(spark):
    rows = suffix_tree_lm.query(spark, SF).collect()
    docs = {k: WORD.findall(t.translate(LOW)) + [None] for k, t in documents(spark).items()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    c = collections.Counter(x for k, w in docs.items() if not out[k] for x in w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum(1 for x in w if c[x]), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_tree_lm.score(odd(spark)).count() == len(ODD)


def test_license_scan(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License. cc-by-nc CC BY NC"), (2, "SPDX-License-Identifier: GPL-3.0-only"), (3, None), (4, "x Apache License, Version 2"), (5, "CC BY-NC-SA 4.0")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(df).collect()}
    assert [b.at for b in sorted(got[1].base, key=lambda b: b.at)] == [1, 5, 8] and got[1].base_labels == ["cc-by-nc", "mit"]
    assert got[2].labels == ["gpl-3"] and got[3].labels == [] and got[3].score == 0 and got[4].base_labels == ["apache-2"] and got[5].labels == ["cc-by-nc", "cc-by-nc-sa"]
    assert license_scan.scan(odd(spark)).count() == len(ODD)


def test_license_names_versions_and_other_licenses(spark):
    want = {
        "This is under the GNU GPL v3": "gpl-3", "Apache-2.0": "apache-2", "Steht unter der MIT-Lizenz.": "mit", "Er fährt mit Lizenz": "", "Publié sous licence MIT": "mit",
        "Licensed under the GNU General Public License version 3": "gpl-3", "Released under GNU Lesser General Public License v2.1": "lgpl-2.1", "dual licensed MIT or Apache-2.0": "apache-2,mit",
        "she has a driving license MIT gave her": "", "License: MIT": "mit", "We run Apache 2.4 behind a proxy": "", "GPL-2.0-or-later": "gpl-2",
    }
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.text: ",".join(r.license.labels) for r in license_scan.scan(rows).collect()}
    assert got == want


def test_chat_round_trip(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "\\### <turn x>\n</turn>\n" * 9, "word " * rng.randrange(700), "\\b\\l<"])) for k in range(30) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", chat_format.read_back(out.windows).alias("turns"), chat_format.lost_text(out.windows).alias("loss")).collect()}
    for k in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == k]
        assert [(t.role, t.text) for t in got[k].turns] == turns and got[k].loss == "".join(t for r, t in turns if r == "assistant")


def test_url_filter_propagates(spark):
    link = '<a href="https://{}/x">'
    rows = [(1, "https://good.org/a", link.format("friend.io")), (2, "http://Bad.example.net/de/8?q", ""), (3, "https://farm.io/", link.format("bad.example.net")), (4, "https://friend.io/", None), (5, None, None), (6, "nothing", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(df, [("good.org", "/", "allow"), ("example.net", "/de/8", "block")]).collect()}
    assert got[2].host == "bad.example.net" and got[2].path == "/de/8" and got[2].rule == "example.net/de/8"
    assert [got[i].verdict for i in range(1, 7)] == ["allow", "block", "block", "allow", "allow", "allow"] and got[4].trust > 0 and got[5].host == ""


def test_html_extraction(spark):
    page = "<body><nav>Home News</nav><article><h1>T &amp; t</h1><p>One<br>two<p>three<aside>no</aside></article><div class='comments'>c</div><footer>f"
    assert html_extract.blocks(page) == (["T & t", "One two", "three"], True)
    menu = "<div>Home News Sport Weather Travel Culture</div><p>Story number {} of {}</p>"
    df = spark.createDataFrame([(i, "http://a.b/", menu.format(i, "z" * i)) for i in range(5)] + [(9, None, None), (9, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert got == [(i, " ".join(f"Story number {i} of {'z' * i}".split())) for i in range(5)] + [(9, ""), (9, "")]


def test_digests(spark):
    out = {r.doc_id: r for r in bpe.query(spark, SF).collect()}
    for k, t in documents(spark).items():
        assert out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
