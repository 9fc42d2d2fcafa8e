"""Readers and writers on small files of the shapes that they are for."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docketry.sources import readers, writers


def test_texts_are_whole_and_named(spark, tmp_path):
    (tmp_path / "001.txt").write_text("THE FACTS\none\ntwo\n")
    (tmp_path / "002.txt").write_text("three")
    rows = readers.read_texts(spark, str(tmp_path), "questions").collect()
    assert sorted((r.filename, r.folder, r.questions) for r in rows) == [("001.txt", tmp_path.name, "THE FACTS\none\ntwo\n"), ("002.txt", tmp_path.name, "three")]


def test_a_missing_folder_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_texts(spark, str(tmp_path / "none"), "questions").collect()


def test_facts_and_law_part_by_folder(spark, tmp_path):
    for folder, name in (("fact_section", "2001-02-03_a.txt"), ("law", "2001-02-03_a.txt"), ("other", "2001-02-04_b.txt")):
        (tmp_path / "x" / folder).mkdir(parents=True)
        (tmp_path / "x" / folder / name).write_text(folder)
    facts, law = readers.read_facts_and_law(spark, str(tmp_path))
    assert [tuple(r) for r in facts.collect()] == [("2001-02-03_a.txt", "fact_section")]
    assert sorted(r.the_law for r in law.collect()) == ["law", "other"]


def test_metadata_is_united_by_name(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"itemid": "1", "importance": 2, "extra": 5}\n{"appno": "7/01", "itemid": "2"}\n')
    (tmp_path / "b.json").write_text('{"respondent": "XYZ", "itemid": "3"}\n')
    (tmp_path / "c.txt").write_text('{"itemid": "4"}\n')
    df = readers.read_metadata(spark, str(tmp_path))
    assert "extra" not in df.columns
    assert sorted((r.itemid, r.appno, r.respondent, r.importance) for r in df.collect()) == [("1", None, None, 2), ("2", "7/01", None, None), ("3", None, "XYZ", None)]


def test_responses(spark, tmp_path):
    body = {"choices": [{"index": 0, "message": {"role": "assistant", "content": '{"Court": 1}'}}]}
    lines = [{"custom_id": "a", "response": {"status_code": 200, "body": body}}, {"custom_id": "b", "response": {"body": {"choices": []}}}, {"custom_id": "c"}]
    (tmp_path / "first.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.read_responses(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.custom_id, r.content) for r in rows) == [("first.jsonl", "a", '{"Court": 1}'), ("first.jsonl", "b", None), ("first.jsonl", "c", None)]


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("itemid,importance\n001,3\n002,\n")
    (tmp_path / "n.txt").write_text("a 1\nb 2\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "h.csv"), "itemid string, importance int").collect()] == [("001", 3), ("002", None)]
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "n.txt"), "k string, n int", " ", False).collect()] == [("a", 1), ("b", 2)]


def test_requests_are_written_in_files_of_bounded_length(spark, tmp_path):
    df = spark.range(25).select((F.col("id") % 2).alias("part"), writers.request(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string"))).alias("request")).coalesce(1)
    writers.write_requests(df, str(tmp_path / "out"), ["part"], 5)
    files = sorted((tmp_path / "out").rglob("*.json"))
    lines = [f.read_text().splitlines() for f in files]
    assert max(map(len, lines)) <= 5 and sum(map(len, lines)) == 25
    first = next(r for r in map(json.loads, sum(lines, [])) if r["custom_id"] == "0")
    assert first["method"] == "POST" and first["body"]["messages"] == [{"role": "user", "content": "text 0"}] and first["body"]["response_format"] == {"type": "json_object"}
    assert (first["body"]["temperature"], first["body"]["top_p"], first["body"]["seed"]) == (0.0, 1.0, 42)
