"""Replay of batch outputs: what a batch service's listing and downloads give, from files that were kept.

A folder holds ``batches.jsonl``, a line for each batch with its description (``name: file``) and the name of its output file,
and the output files. The data source ``batch_outputs`` reads the listing on the driver, leaves out batches whose description an
equality or prefix filter excludes before any of their files is opened, and makes a partition of each batch that is left. A file
that is missing, and each line that is no response, becomes a row with an ``error``; nothing is skipped in silence.

    spark.dataSource.register(BatchOutputs)
    spark.read.format("batch_outputs").load(folder).filter(F.col("description").startswith("experiment: "))

Filters reach the source where ``spark.sql.python.filterPushdown.enabled`` is true; Spark applies them again in any case.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

SCHEMA = "description string, file string, line int, custom_id string, content string, error string"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class _Batch(InputPartition):
    def __init__(self, description: str | None, file: str | None, error: str | None = None):
        self.description, self.file, self.error = description, file, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.equal, self.prefixes = options["path"].rstrip("/"), [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("description",):
                self.prefixes.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("description",):
                self.equal.append(f.value)
            yield f

    def partitions(self) -> list[_Batch]:
        place, root = _open(self.folder)
        with place.open_input_stream(f"{root}/batches.jsonl") as stream:
            lines = stream.read().decode("utf-8", "replace").splitlines()
        found = []
        for n, line in enumerate(lines, 1):
            try:
                entry = json.loads(line)
                found.append(_Batch(str(entry["metadata"]["description"]), str(entry["output_file"])))
            except (ValueError, KeyError, TypeError) as e:
                if line.strip():
                    found.append(_Batch(None, None, f"batches.jsonl, line {n}: {type(e).__name__}"))
        keep = lambda d: all(d is not None and d == x for x in self.equal) and all(d is not None and d.startswith(x) for x in self.prefixes)
        return [b for b in found if keep(b.description)] or [_Batch(None, None)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        where = (partition.description, partition.file)
        if partition.file is None:
            if partition.error:
                yield (*where, None, None, None, partition.error)
            return
        place, root = _open(self.folder)
        try:
            with place.open_input_stream(f"{root}/{partition.file}") as stream:
                lines = stream.read().decode("utf-8", "replace").split("\n")
        except OSError as e:
            yield (*where, None, None, None, f"file: {type(e).__name__}")
            return
        if not any(x.strip() for x in lines):
            yield (*where, None, None, None, "file: empty")
        for n, line in enumerate(lines, 1):
            if line.strip():
                try:
                    entry = json.loads(line)
                    yield (*where, n, str(entry["custom_id"]), entry["response"]["body"]["choices"][0]["message"]["content"], None)
                except (ValueError, KeyError, TypeError, IndexError) as e:
                    yield (*where, n, None, None, f"line: {type(e).__name__}")


class BatchOutputs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_outputs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def replay(spark: SparkSession, folder: str, experiment: str) -> DataFrame:
    """The outputs of one experiment's batches: those whose description is its name before the first colon."""
    spark.dataSource.register(BatchOutputs)
    return spark.read.format("batch_outputs").load(folder).filter(F.col("description").startswith(f"{experiment}:"))


def rejoin(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """``requests(custom_id, ...)`` with ``content`` of their outputs; null where there is none, the last line where there are several."""
    last = outputs.filter("error is null").groupBy("custom_id").agg(F.max_by("content", F.struct("file", "line")).alias("content"))
    return requests.join(last, "custom_id", "left")
