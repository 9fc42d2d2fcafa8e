"""Writers of request files; repairs and splits of JSON-lines files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request(custom_id: Column, content: Column, model: str = "gpt-4o", seed: int = 42, max_tokens: int = 550, temperature: float = 0.0, top_p: float = 1.0) -> Column:
    """One line of a batch request file, as a struct."""
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    body = F.struct(
        F.lit(model).alias("model"), message.alias("messages"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(seed).alias("seed"),
    )
    return F.struct(custom_id.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def write_requests(df: DataFrame, path: str, by: list[str], rows_a_file: int = 3000) -> None:
    """Rows with a ``request`` struct as JSON lines, a folder for each configuration, at most so many lines a file."""
    df.select(*by, "request.*").write.partitionBy(*by).option("maxRecordsPerFile", rows_a_file).json(path)


def repair(line: Column) -> Column:
    """A response line cut short inside its JSON content gets the content's end back; others stay."""
    return F.when(~line.rlike(r'\\"\\n\}"[^"]*"ref'), F.regexp_replace(line, '", "refusal"', r'.\\"\\n}", "refusal"')).otherwise(line)


def split_number(n: Column, size: int) -> Column:
    """The file, from 1, of the n-th row, from 1."""
    return (F.floor((n - 1) / size) + 1).cast("int")
