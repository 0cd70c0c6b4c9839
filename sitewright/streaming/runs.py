"""Keyed tables fed by micro-batches: every batch is a run of newest rows, and runs are merged in powers of ``fan``.

Batch b writes ``level=0/upto=b``. Where b + 1 is a multiple of ``fan ** n``, the ``fan`` runs of the level below that end at b are merged into
``level=n/upto=b``. So which runs make up the table after B batches follows from B alone: as many of each level as the digits of B to the base
``fan`` say, at most (fan - 1) * log(B). A batch that is repeated overwrites the same folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.streaming.sinks import run_available

FAN = 4


def covering(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, last batch) of the runs that hold the first ``batches`` batches, oldest first."""
    out, done, level = [], 0, 0
    while fan ** (level + 1) <= batches:
        level += 1
    while level >= 0:
        while done + fan**level <= batches:
            done += fan**level
            out.append((level, done - 1))
        level -= 1
    return out


def folder(path: str, level: int, upto: int) -> str:
    return f"{path}/level={level}/upto={upto}"


def newest(rows: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """One row per key, that of the highest version; equal versions go by the other columns."""
    rest = [c for c in rows.columns if c not in key and c != version]
    return rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_n")).select(*key, "_n.*")


def write_runs(path: str, key: Sequence[str], version: str, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """Sink of a feed: the batch's newest rows as a run, sorted by key, and the merges that fall due with it."""

    def put(rows: DataFrame, level: int, upto: int) -> None:
        # ranges of the key per file: its statistics let a lookup by key skip the other files of every run
        rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(folder(path, level, upto))

    def write(batch: DataFrame, batch_id: int) -> None:
        put(newest(batch, key, version), 0, batch_id)
        level = 1
        while (batch_id + 1) % fan**level == 0:
            step = fan ** (level - 1)
            parts = [folder(path, level - 1, batch_id - step * k) for k in range(fan)]
            put(newest(batch.sparkSession.read.schema(batch.schema).parquet(*parts), key, version), level, batch_id)
            level += 1

    return write


def written(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name``=number below a path that are complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return [int(n.partition("=")[2]) for n in found if n.startswith(f"{name}=")]


def batches_written(spark: SparkSession, path: str) -> int:
    """How many batches the table holds, from the names of its level-0 runs that are complete."""
    return 1 + max(written(spark, f"{path}/level=0", "upto"), default=-1)


def read_runs(spark: SparkSession, path: str, key: Sequence[str], version: str, schema: T.StructType, fan: int = FAN, batches: int | None = None) -> DataFrame:
    """The newest row per key after the first ``batches`` batches (default: all). A merge that is still to come is not waited for."""
    n = batches_written(spark, path) if batches is None else batches
    if not n:
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(*[folder(path, *run) for run in covering(n, fan)]), key, version).select(*schema.names)


def latest_table(changes: DataFrame, *, key: Sequence[str], version: str, path: str, checkpoint: str, fan: int = FAN) -> DataFrame:
    """Take in what is there of a feed of changes and return the newest version per key, in whatever order versions come.

    The table itself is the only state. Changes with a null in the key are one key of their own; a repeated change is no second row.
    """
    run_available(changes, checkpoint, write_runs(path, key, version, fan), mode="append")
    return read_runs(changes.sparkSession, path, key, version, changes.schema, fan)
