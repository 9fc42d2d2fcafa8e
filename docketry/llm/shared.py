"""Helpers that every operator here uses: tables in the cluster's shared folder, partition counts, row keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own if this is a single process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.docketry.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="docketry-shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.docketry.shared.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str, **how: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation. ``how``: the writer's options."""
    path = f"{shared_dir(df.sparkSession)}/docketry/{name}-{uuid.uuid4().hex}"
    df.write.options(**how).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settle_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The same, dealt into ``buckets`` by ``key`` as it is written: what groups by ``key`` need not shuffle it.

    Spark keeps buckets only for tables with a name; this one's files lie in the shared folder, and its name is its own. Spark
    sets a limit on buckets, beyond which each holds more.
    """
    buckets = min(buckets, int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    title = f"docketry_{name}_{uuid.uuid4().hex}"
    place = f"{shared_dir(df.sparkSession)}/docketry/{title}"
    how = {"path": place, "compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
    df.write.options(**how).format("parquet").bucketBy(buckets, key).saveAsTable(title)
    out = df.sparkSession.table(title)
    out._settled_at = place
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing still to be computed reads."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def words(text):
    """The words of a text, split at ASCII white space; an empty array for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Keys that may be broadcast: at 16 bytes a key, a few MB. Beyond that the join shuffles.
FEW_KEYS = 200_000


def narrow(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """``df`` joined to distinct ``keys``: broadcast when a count shows at most FEW_KEYS of them, else shuffled."""
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def hold(df: DataFrame, **columns) -> DataFrame:
    """``df`` with ``columns`` computed once a row.

    The optimizer may copy a projected expression into a filter or into a lambda, where an array would be built anew for
    each element. It doesn't look through a generator; one that makes exactly one row costs next to nothing.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
