"""The pipeline on sf0.001, stage by stage."""

import re

import pytest

import corpus_pipeline
from docketry.llm.shared import settle, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_narrow(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n


def test_near_duplicates_leave_one_and_clean_texts_stay(spark):
    """The third stage against brute force: no two texts that stay are linked, and each that goes is linked to some other."""
    docs = table(spark, SF, "documents")
    kept = settle(dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF), "kept")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[r.doc_id] = set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
    stay = {r.doc_id for r in kept.collect()}

    def linked(a, b):
        n = len(sets[a] & sets[b])
        return n > 0 and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)

    assert not [(a, b) for a in stay for b in stay if a < b and linked(a, b)]
    assert all(any(a != b and linked(a, b) for b in sets) for a in set(sets) - stay)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two", None, "s", 7), (3, "word " * 4000, "en", None, 20000)]])
def test_stages_take_empty_tables_and_odd_rows(spark, rows):
    """None of the odd rows is a document that the quality rules keep; every stage takes them as they are, too."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        assert n == 0 if name == "quality_rules" or not rows else 0 < n <= len(rows)
