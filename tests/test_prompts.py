"""Prompts of each family, written out by hand."""

import pytest

from docketry.operators import prompts as P
from docketry.sources import readers
from pyspark.sql import functions as F

UNSURE = "If you cannot tell, say that you do not have enough information.\n"
LEVELS = (
    "key_case: among the most important, chosen for the official reports; 1: high importance, develops or changes the case law; "
    "2: medium importance, goes beyond applying the case law; 3: low importance, applies the case law.\n"
)
BY_HAND = [
    ("importance_by_name", {"variant": "third"}, "Importance is part of the metadata in the court's database.\nGive the importance of the case: key_case, 1, 2 or 3.\n\nAnswer in JSON with the schema s.\nThe case is X v. Y, with the application numbers 1/02."),
    ("importance_by_name", {"variant": "fifth"}, "Look the case up in the court's database.\nGive the importance of the case: key_case, 1, 2 or 3.\n\nAnswer in JSON with the schema s.\nThe case is X v. Y, with the application numbers 1/02."),
    ("importance_by_name", {}, "Importance is given to every case after its outcome.\nGive the importance of the case: key_case, 1, 2 or 3.\n" + UNSURE + "Answer in JSON with the schema s.\nThe case is X v. Y, with the application numbers 1/02."),
    ("importance", {"text": 4, "steps": True}, "You are shown a summary of the case of a communicated case.\n" + LEVELS + "\nPredict the importance of the case: key_case, 1, 2 or 3.\n" + UNSURE + "Answer in JSON with the schema s.\nThe case: facts\nGive your reasons step by step."),
    ("difficulty", {"text": 2, "unsure": False}, "You are shown the questions put to the parties of a communicated case.\nEasy: applies existing case law or goes little beyond it; Hard: develops, clarifies or changes the case law.\n\nPredict whether the case is Easy or Hard.\n\nAnswer in JSON with the schema s.\nThe case: facts\n"),
    ("court", {"text": 1}, "You are shown the subject matter of the case of a communicated case.\nJudgment: decides the merits; Decision: mostly on whether the case is admissible.\n\nPredict whether a Judgment or a Decision follows.\n" + UNSURE + "Answer in JSON with the schema s.\nThe case: facts\n"),
    ("chamber", {"grand_chamber": False, "text": 1}, "You are shown the subject matter of the case of a communicated case.\nCommittee: settled case law; Chamber: all other cases.\n\nPredict the formation that decides the case.\n" + UNSURE + "Answer in JSON with the schema s.\nThe case: facts\n"),
    ("summary_one", {}, "Summarise this communicated case, its subject matter and the questions put to the parties, in your own words.\nAnswer in JSON with the schema s.\nThe case: facts"),
    ("summary_communicated", {}, "Summarise the key facts of this communicated case, once in 200 and once in 500 words.\nAnswer in JSON with the schema s.\nThe case: facts"),
    ("summary_outcome", {}, "Summarise the key facts and the law of this decided case, once in 200 and once in 500 words.\nAnswer in JSON with the schema s.\nThe case: facts"),
]


@pytest.mark.parametrize("family,options,said", BY_HAND)
def test_prompt(spark, family, options, said):
    fields = {"name": F.lit("X v. Y"), "appnos": F.lit("1/02"), "text": F.lit("facts")}
    assert spark.range(1).select(P.prompt(family, "s", fields, **options)).first()[0] == said


def test_keywords_name_every_code(spark):
    said = spark.range(1).select(P.prompt("keywords", "s", {"text": F.lit("facts")})).first()[0]
    assert all(f"{k}: {v}" in said for k, v in P.KEYWORDS.items()) and "all of these cases have 350" in said


def test_examples_in_place(spark):
    df = spark.createDataFrame([("Hard", "b", 2), ("Easy", "a", 1)], "y string, t string, o int")
    shown = df.agg(P.examples_by_label(F.col("y"), F.col("t"), F.col("o")).alias("x"))
    said = shown.select(P.prompt("difficulty", "s", {"text": F.lit(None).cast("string")}, F.col("x"))).first()[0]
    assert "\nEasy: a; Hard: b\nPredict" in said and said.endswith("The case: \n")


def test_read_lookup(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"a": "first", "b": null}')
    names = readers.read_lookup(spark, str(tmp_path / "names.json"))
    assert names.first()[0] == {"a": "first", "b": None}
    codes = spark.createDataFrame([("a",), ("z",)], "code string").join(F.broadcast(names)).select("code", F.try_element_at("names", "code"))
    assert sorted(map(tuple, codes.collect())) == [("a", "first"), ("z", None)]
