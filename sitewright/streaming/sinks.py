"""Sources and sinks of feeds: changes as they come, one folder per micro-batch, newest row per key.

A repeated batch overwrites its own folder. Checkpoints and tables live in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_changes(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_trigger: int = 4) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; naive input counts as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(df: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Process what is there, then stop; the same code runs with a time trigger in service."""
    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(on_batch).start()
    )
    q.awaitTermination()
    return q


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def read_latest(spark: SparkSession, path: str, key: Sequence[str], schema: T.StructType, order: str | None = None) -> DataFrame:
    """Last written row per key: the newest batch wins, inside a batch the highest ``order``.

    A batch that can hold several rows of a key needs the order of its events in a column.
    """
    rows = spark.read.schema(copied(schema).add("batch", T.LongType())).parquet(path)
    rest = [c for c in rows.columns if c not in key and c != "batch"]
    rest.sort(key=lambda c: c != order)
    g = rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("_b"))
    return g.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def copied(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields))


def keyed_state(updates: DataFrame, key: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Run an update-mode aggregation to a batch-folder table and return its latest rows."""
    schema = copied(updates.schema)
    run_available(updates, checkpoint, write_batch(path))
    return read_latest(updates.sparkSession, path, key, schema)
