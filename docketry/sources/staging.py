"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.docketry.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own in a single process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="docketry-shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set(_OWN, folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows, and what depends on how they were dealt, stay as they are."""
    path = f"{shared_dir(df.sparkSession)}/docketry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
