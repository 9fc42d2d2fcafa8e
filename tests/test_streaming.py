"""Files that arrive between two runs of a query are read once each."""

import json

from docketry.streaming import arrivals as A


def run(query):
    assert query.awaitTermination(120)


def test_texts_arrive_once(spark, tmp_path):
    source, out, marks = (tmp_path / x for x in ("in", "out", "marks"))
    source.mkdir()
    (source / "a.txt").write_text("first\ntext")
    (source / "b.txt").write_text("")
    store = lambda: run(A.store(A.arriving_texts(spark, str(source), "facts", 1), str(out), str(marks)))
    store()
    (source / "c.txt").write_text("third")
    store()
    store()
    rows = sorted((r.filename, r.facts) for r in spark.read.parquet(str(out)).collect())
    assert [r for r in rows if r[0] != "b.txt"] == [("a.txt", "first\ntext"), ("c.txt", "third")]
    assert [r for r in rows if r[0] == "b.txt"] in ([], [("b.txt", "")])


def response(name, created, content):
    body = {"created": created, "choices": [{"index": 0, "message": {"role": "assistant", "content": content}}]}
    return json.dumps({"id": name, "custom_id": name, "response": {"status_code": 200, "body": body}, "error": None})


def test_repeated_responses_are_dropped(spark, tmp_path):
    source, out, marks = (tmp_path / x for x in ("in", "out", "marks"))
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join([response("x", 1000, "a"), response("y", 1001, "b")]))
    (source / "2.jsonl").write_text(response("x", 1002, "a"))
    run(A.store(A.arriving_responses(spark, str(source), "1 hour"), str(out), str(marks)))
    assert sorted((r.custom_id, r.content) for r in spark.read.parquet(str(out)).collect()) == [("x", "a"), ("y", "b")]


def test_repeats_stay_without_a_bound(spark, tmp_path):
    source, out, marks = (tmp_path / x for x in ("in", "out", "marks"))
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join([response("x", 1000, "a"), response("x", 1001, "b")]))
    run(A.store(A.arriving_responses(spark, str(source)), str(out), str(marks)))
    assert sorted(r.content for r in spark.read.parquet(str(out)).collect()) == ["a", "b"]
