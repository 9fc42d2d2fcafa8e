"""Files as they arrive: new case texts and new batch responses, each read once.

The file source remembers in the query's checkpoint which files it has read, so a restarted query goes on where it ended.
Without a trigger of the caller's own, a query takes all that is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.readers import RESPONSE

#: Files that one micro-batch takes at most; the others follow in later ones.
FILES_A_BATCH = 1000


def arriving_texts(spark: SparkSession, folder: str, column: str, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """(filename, column) of each new file, whole text."""
    df = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias(column))


def arriving_responses(spark: SparkSession, folder: str, late: str | None = None, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """(file, custom_id, created, content) of each new response.

    ``late``: how long a repeated custom_id is looked for, by the response's own time of creation, and so how long the state
    keeps an id; responses without that time are not told apart. Without ``late`` repeats stay.
    """
    df = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_a_batch).json(folder)
    body = F.col("response.body")
    rows = df.select(F.col("_metadata.file_name").alias("file"), "custom_id", F.timestamp_seconds(body["created"]).alias("created"), F.get(body["choices"], F.lit(0))["message"]["content"].alias("content"))
    return rows if late is None else rows.withWatermark("created", late).dropDuplicatesWithinWatermark(["custom_id"])


def store(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet; each row is written once, also over restarts with the same ``checkpoint``."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
