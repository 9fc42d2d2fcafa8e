"""The splitter against the recursive rule written out part by part, with real tokenizers; the index against full builds."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docketry.operators import chunks as H
from docketry.operators import retrieval as R

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def part_by_part(text, size, overlap, separators, count):
    """The rule with a count for each part and a loop for each step."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    between, out, run = count(mark) if mark else 0, [], []
    total = lambda: sum(count(x) for x in run) + between * max(0, len(run) - 1)

    def close():
        if joined := mark.join(run).strip():
            out.append(joined)

    for part in [x for x in (text.split(mark) if mark else list(text)) if x]:
        n = count(part)
        if n > size and finer:
            if run:
                close()
                run = []
            out += part_by_part(part, size, overlap, finer, count)
            continue
        if run and total() + n + between > size:
            close()
            while run and (total() > overlap or total() + n + between > size):
                run.pop(0)
        run.append(part)
    if run:
        close()
    return out


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß漢 \U0001f600"[: rng.choice([5, 11])]) for _ in range(rng.randrange(1, 14)))
    for _ in range(n):
        yield "\n\n".join("\n".join(" ".join(word() for _ in range(rng.randrange(0, 25))) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
    yield from ("", " ", "\n\n\n", "x" * 500, "a\n\n" * 40, " " * 50 + "b")


@pytest.mark.parametrize("size,overlap", [(5, 0), (12, 4), (40, 11), (7, 20)])
def test_rule_in_characters_and_tokens(size, overlap):
    tokens = H.tokenizer(BYTES)
    one = lambda s: int(tokens([s])[0])
    for text in texts(size, 40):
        assert H.split(text, size, overlap, H.lengths, recount=False) == part_by_part(text, size, overlap, H.SEPARATORS, len)
        assert H.split(text, size, overlap, H.one_by_one(lambda s: len(s.split()))) == part_by_part(text, size, overlap, H.SEPARATORS, lambda s: len(s.split()))
        want = part_by_part(text, size, overlap, H.SEPARATORS, one)
        got = H.split(text, size, overlap, tokens)
        assert got == want or any(one(c) > size for c in want)  # only chunks that count more, whole, are cut again
        letters = max((one(x) for x in text), default=0)
        assert all(one(c) <= max(size, letters) for c in got)
        assert "".join(text.split()) in "".join("".join(c.split()) for c in got) or overlap


@pytest.mark.parametrize("path", [BYTES, public_tokenizers.path("piece_bpe_32k.model")])
def test_sizes_of_an_index(spark, path):
    """512/50, 1024/100 and 2048/100 over whole documents: every chunk within its size, every word in a chunk."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    counts = H.tokenizer(path)
    for size, overlap in ((512, 50), (1024, 100), (2048, 100)):
        rows = H.recursive_chunks(docs, "doc_id", "text", size, overlap, lambda: H.tokenizer(path)).collect()
        assert counts([r["chunk"] for r in rows]).max() <= size
        own = {}
        for r in rows:
            own.setdefault(r["doc_id"], set()).update(r["chunk"].split())
        assert all(set((t or "").split()) == own.get(d, set()) for d, t in whole.items())


def test_long_texts_take_linear_time():
    tokens = H.tokenizer(BYTES)
    for text in ("y" * 200_000, "word " * 200_000, "w\n" * 100_000):
        began = time.time()
        got = H.split(text, 512, 50, tokens)
        assert time.time() - began < 5 and max(tokens(got)) <= 512


def cut(df):
    return R.chunk_tokens(df, "id", "text", 3, 1)


def rows(index):
    return sorted(map(tuple, index.chunks.select("id", "pos", "chunk").collect())), sorted(map(tuple, index.parents.select("id", "text").collect()), key=str)


def test_index_follows_its_documents(spark, tmp_path):
    kind = "id long, text string"
    first = [(1, "a b c d e"), (2, "x y"), (3, None), (4, "gone soon"), (5, "")]
    second = [(1, "a b c d e"), (2, "x y z w"), (3, "now a text"), (6, "new one"), (None, "no id"), (6, "new one")]
    folder = str(tmp_path / "index")
    seen = []
    H.follow(spark.createDataFrame(first, kind), folder, cut)
    index = H.follow(spark.createDataFrame(second, kind), folder, lambda df: (seen.append(sorted(r["id"] for r in df.collect())), cut(df))[1])
    fresh = H.follow(spark.createDataFrame(second, kind), str(tmp_path / "fresh"), cut)
    assert rows(index) == rows(fresh) and seen == [[2, 3, 6]]
    assert {r["state"]: r["n"] for r in index.delta.collect()} == {"same": 1, "changed": 2, "gone": 2, "new": 1}
    kept = H.follow(spark.createDataFrame([(7, "p q")], kind), folder, cut, whole=False)
    assert rows(kept)[1] == sorted([*rows(index)[1], (7, "p q")], key=str)
    back = H.follow(spark.createDataFrame(first, kind), folder, cut)
    assert rows(back) == rows(H.follow(spark.createDataFrame(first, kind), str(tmp_path / "again"), cut)) == rows(H.open_chunks(spark, folder))
    with pytest.raises(FileNotFoundError):
        H.open_chunks(spark, str(tmp_path / "none"))


def test_parents_join_without_a_shuffle(spark, tmp_path):
    index = H.follow(spark.range(500).select("id", F.concat_ws(" ", "id", "id", F.lit("z")).alias("text")), str(tmp_path / "index"), cut)
    joined = index.chunks.alias("c").join(index.parents.alias("p").hint("merge"), F.col("c.id") == F.col("p.id"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 500


def test_sizes_together_count_each_text_once(spark):
    rng = random.Random(9)
    texts = [(k, "\n\n".join(" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))) for _ in range(6))) for k in range(30)] + [(90, None), (91, "")]
    docs, sizes = spark.createDataFrame(texts, "doc_id long, text string"), ((40, 5), (80, 10), (200, 10))
    got = sorted(map(tuple, H.chunks_of_sizes(docs, "doc_id", "text", sizes, lambda: H.tokenizer(BYTES)).collect()))
    want = [(r.doc_id, size, r.pos, r.chunk) for size, overlap in sizes for r in H.recursive_chunks(docs, "doc_id", "text", size, overlap, lambda: H.tokenizer(BYTES)).collect()]
    assert got == sorted(want)
    asked = []
    counts = H.once(lambda texts: (asked.extend(texts), H.lengths(texts))[1])
    assert [counts(["a", "bb", "a"]).tolist(), counts(["bb", "c"]).tolist()] == [[1, 2, 1], [2, 1]] and asked == ["a", "bb", "c"]


def test_following_keeps_no_second_copy_of_texts(spark, tmp_path, monkeypatch):
    kept = {}
    settled = H.settle
    monkeypatch.setattr(H, "settle", lambda df, name: (kept.setdefault(name, df.columns), settled(df, name))[1])
    docs = spark.createDataFrame([(1, "b c"), (1, "a b"), (2, None), (2, "z"), (3, None), (None, "q")], "id long, text string")
    index = H.follow(docs, str(tmp_path / "index"), cut)
    assert rows(index) == ([(1, 0, "a b"), (2, 0, "z")], [(1, "a b"), (2, "z"), (3, None)])
    assert kept and not any("text" in columns for columns in kept.values())


def test_counts_by_pieces_are_the_library_s():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BYTES)
    made.encode_special_tokens = True
    plain = lambda texts: np.array([len(made.encode(x, add_special_tokens=False).ids) for x in texts], np.int64)
    rng, asked = random.Random(6), []
    letters = "ab zÉßøɏªº²¼19 \n\n\t\r\x0b\x1c\x1f\x85\xa0'.,!<|>×÷_'s're'll" + "漢\u2003\u0301\U0001f600Ж"
    odd = ["".join(rng.choice(letters[: rng.choice([20, 50, len(letters)])]) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    odd += [*texts(3, 20), "<|endoftext|> x", "it's  we'll\n\n'tis", "".join(map(chr, range(0x250)))] + [f"a{chr(x)}b {chr(x)} 1{chr(x)}" for x in range(0x250)]
    assert H.tokenizer(BYTES)(odd).tolist() == plain(odd).tolist()
    counts = H.tokenizer(BYTES)
    for size, overlap in ((6, 2), (30, 9)):
        for x in odd[:600] + odd[3000:3020]:
            assert H.split(x, size, overlap, counts) == H.split(x, size, overlap, plain)
    counts = H.by_pieces(lambda texts: (asked.extend(texts), plain(texts))[1])
    H.split("one two\n" * 300, 20, 4, counts)
    assert sum(map(len, asked)) < 100  # 300 lines, and all chunks whole, before
