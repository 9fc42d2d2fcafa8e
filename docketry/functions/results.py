"""Model responses: JSON inside JSON, predictions on one scale, a cast that holds for a whole column or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers of the first experiment on the scale of the data (fixed values).
SCALE = {"key_case": 1, "1": 2, "2": 3, "3": 4, "I do not have enough information": 0}


def content(response: Column) -> Column:
    """The text of the first choice of a response line, itself JSON."""
    return F.get_json_object(response, "$.response.body.choices[0].message.content")


def answer(response: Column, key: str, strict: bool = False) -> Column:
    """The value under ``key`` in the JSON that the response's content holds; null if that is missing or no JSON, an error if ``strict``.

    The key is taken literally, whatever characters it has.
    """
    inner = F.from_json(content(response), "map<string,string>")
    value = F.try_element_at(inner, F.lit(key))
    missing = F.raise_error(F.concat(F.lit(f"no {key} in: "), F.coalesce(content(response), F.lit("null")))).cast("string")
    return F.when(value.isNull(), missing).otherwise(value) if strict else value


def on_scale(prediction: Column, experiment: int) -> Column:
    """Predictions of the first experiment mapped to the data's scale, unknown ones null; those of others as they are."""
    if experiment != 1:
        return prediction.cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in SCALE.items() for x in (k, str(v)))), prediction.cast("string"))


def cast_whole(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` as text and ``{column}_long``: its integers if all of the column's values are such, else null throughout."""
    long = F.col(column).try_cast("long")
    whole = df.agg(F.coalesce(F.every(long.isNotNull()), F.lit(True)).alias("__whole"))
    return df.crossJoin(F.broadcast(whole)).withColumn(f"{column}_long", F.when(F.col("__whole"), long)).drop("__whole")
