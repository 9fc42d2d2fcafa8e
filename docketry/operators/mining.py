"""Training pairs for a re-ranker: positives from citations, negatives from the far end of ranked lists, texts attached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_code(codes: Column) -> Column:
    return F.split_part(codes, F.lit(";"), F.lit(1))


def outcomes_by_code(outcomes: DataFrame, order: str) -> DataFrame:
    """(appno, file, summary): of ``outcomes(appno, file, summary)`` the last row, by ``order``, of each first code."""
    last = outcomes.withColumn("appno", first_code(F.col("appno"))).groupBy("appno").agg(F.max_by(F.struct("file", "summary"), order).alias("x"))
    return last.select("appno", "x.*")


def positives(cases: DataFrame, outcomes: DataFrame, order: str) -> DataFrame:
    """(case, appno, positive): a row for each citation of ``cases(case, cited)``; ``positive`` is null where no outcome has that code."""
    cited = cases.select("case", F.posexplode("cited").alias("at", "appno"))
    return cited.join(outcomes_by_code(outcomes, order).select("appno", F.col("summary").alias("positive")), "appno", "left").select("case", "at", "appno", "positive")


def candidates(ranked: Column, skip: int = 15) -> Column:
    """The first code of each entry of a ranked list, without empty entries, less the first ``skip``."""
    codes = F.transform(F.filter(ranked, lambda x: x != ""), first_code)
    return F.slice(codes, skip + 1, F.greatest(F.size(codes) - skip, F.lit(0)))


def with_negatives(pairs: DataFrame, ranked: DataFrame, start: int = 49) -> DataFrame:
    """``pairs(case, at, ...)`` with ``negative``: the n-th positive of a case takes the candidate at place ``start`` - n + 1, from 0;
    null where the list is shorter or runs out. ``ranked(case, candidates)``."""
    n = F.row_number().over(Window.partitionBy("case").orderBy("at"))
    place = F.lit(start) - F.col("n") + 1
    both = pairs.withColumn("n", n).join(ranked, "case")
    return both.withColumn("negative", F.when(place >= 0, F.get("candidates", place))).drop("n", "candidates")


def with_texts(pairs: DataFrame, outcomes: DataFrame, summaries: DataFrame, order: str) -> DataFrame:
    """(case, text, positive, negative): the negatives' summaries, and each case's own in place of its text; inner joins."""
    texts = outcomes_by_code(outcomes, order).select(F.col("appno").alias("negative"), F.col("summary").alias("negative_text"))
    return pairs.join(texts, "negative").join(summaries.select("case", F.col("summary").alias("text")), "case").select("case", "text", "positive", F.col("negative_text").alias("negative"))


def labelled(pairs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text_a, text_b, label): each pair as a positive and a negative example."""
    side = lambda c, y: F.struct(F.col(c).alias("text_b"), F.lit(y).alias("label"))
    return pairs.select(*keep, F.col("text").alias("text_a"), F.explode(F.array(side("positive", 1), side("negative", 0))).alias("x")).select(*keep, "text_a", "x.*")
