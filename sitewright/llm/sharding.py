"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions come into one shard.

Every dimension is quantised at its own quantiles, the cell's place on the curve orders the rows, and the order is cut into
runs. Shards then have narrow ranges in all dimensions at once, so that a reader skips files by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewright.llm.common import written

BITS = 5
LAWS = ("rows", "bytes")


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells, one array per dimension (the transposed form of Skilling, 2004)."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in cells]
    n = len(x)
    if n * bits > 62:
        raise ValueError("too many bits for a 64-bit index")
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b) & 1
    return out


def as_number(df: DataFrame, column: str) -> Column:
    """Order-preserving number of a column that holds no texts; nulls come first."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        c = F.unix_timestamp(c)
    number = c.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(float("-inf"))).otherwise(number)


def text_cells(meta: DataFrame, column: str, rows: int, cells: int) -> DataFrame:
    """Rows (value, cell): every distinct text and the cell its first row falls into when all rows are sorted by whole values.

    Counts per value are sorted by ranges of values, so that any number of distinct texts spreads over tasks.
    """
    spark = meta.sparkSession
    counts = meta.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part)), pa.array(before + np.cumsum(n) - n)], ["value", "n", "part", "before"])
            before += int(n.sum())

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 50_000)))
    ranged = counts.repartitionByRange(parts, F.asc_nulls_first("value")).sortWithinPartitions(F.asc_nulls_first("value"))
    # written, as a second run of a range partitioning may draw other bounds
    placed = written(ranged.mapInArrow(number, "value string, n bigint, part bigint, before bigint"), "shard-values")
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per range
    starts = placed.groupBy("part").agg(F.sum("n").alias("all")).select("part", (F.sum("all").over(w) - F.col("all")).alias("first"))
    at = F.col("first") + F.col("before")
    # a cell for the middle of a value's rows: a frequent value does not take the cell of the one before it
    cell = F.floor((2 * at + F.col("n")).cast("decimal(38,0)") * cells / (2 * max(rows, 1)))
    return placed.join(starts, "part").select("value", F.least(cell, F.lit(cells - 1)).cast("double").alias("cell"))


def assign(
    docs: DataFrame, dimensions: tuple[str, ...], shards: int, key: str = "doc_id", text: str = "text", law: str = "rows", bits: int = BITS,
) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes of the text plus 1), text_crc32, curve (place on the curve), shard, slot.

    Rows are ordered by (curve, key, crc). ``rows``: counts of shards differ by one at most; ``bytes``: a row goes to the shard
    in whose equal part of all bytes its first byte lies, so that sizes differ from the mean by less than the largest row.
    Slots number a shard's rows from 0 without gaps. Null texts count as empty, null metadata sort first, repeated rows are
    placed each, fewer rows than shards leave shards empty, an empty table gives no rows. Copies of a text lie side by side
    where their metadata agree. Texts are read once; only numbers are sorted, and no key can fill a task, for the sort is by
    ranges down to single rows.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    names = [f"__d{i}" for i in range(len(dimensions))]
    texts = {d for d in dimensions if docs.schema[d].dataType.simpleString() == "string"}
    meta = written(docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        *((F.col(d) if d in texts else as_number(docs, d)).alias(n) for d, n in zip(dimensions, names, strict=True)),
    ), "shard-meta")
    rows = meta.count()
    for d, n in zip(dimensions, names, strict=True):
        if d in texts:
            found = text_cells(meta, n, rows, 1 << bits).withColumnRenamed("cell", f"{n}c")
            meta = meta.join(found, F.col(n).eqNullSafe(F.col("value")), "left").drop("value", n).withColumnRenamed(f"{n}c", n)
    if texts:
        meta = written(meta.select("key", "size", "crc", *names), "shard-cells")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = meta.agg(*(F.percentile_approx(n, steps, 10_000).alias(n) for n in names), F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    # a text's cell is its number already
    cuts = [np.arange(1, 1 << bits, dtype=float) if d in texts else np.array(found[n] or [], dtype=float) for d, n in zip(dimensions, names, strict=True)]
    total, size = found["rows"], found["bytes"]
    kind = docs.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [np.searchsorted(c, b.column(3 + i).to_numpy(zero_copy_only=False), side="right") for i, c in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hilbert_index(cells, bits))], ["key", "size", "crc", "curve"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 50_000)))
    order = ["curve", "key", "crc", "size", "tie"]
    # the tie makes equal rows distinct, so that any number of them spreads over ranges
    ranged = meta.mapInArrow(place, f"key {kind}, size bigint, crc bigint, curve bigint").withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, weight = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            s = b.column(1).to_numpy()
            before = weight + np.cumsum(s) - s
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(s), part)), pa.array(n + np.arange(len(s))), pa.array(before)], ["key", "size", "crc", "curve", "part", "row", "weight"])
            n, weight = n + len(s), weight + int(s.sum())

    # written, as a second run of a range partitioning may draw other bounds
    rows = written(ranged.mapInArrow(number, f"key {kind}, size bigint, crc bigint, curve bigint, part bigint, row bigint, weight bigint"), "shard-rows")
    each = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per range
    starts = each.select("part", (F.sum("n").over(w) - F.col("n")).alias("n0"), (F.sum("w").over(w) - F.col("w")).alias("w0"))
    placed = rows.join(starts, "part").withColumns({"at": F.col("n0") + F.col("row"), "before": F.col("w0") + F.col("weight")})
    if law == "rows":
        few, more = total // shards, total % shards
        edge = more * (few + 1)
        shard = F.when(F.col("at") < edge, F.floor(F.col("at") / (few + 1))).otherwise(more + F.floor((F.col("at") - edge) / max(few, 1)))
        first = F.when(F.col("shard") < more, F.col("shard") * (few + 1)).otherwise(edge + (F.col("shard") - more) * few)
        placed = placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("at") - first).cast("bigint"))
    else:
        placed = placed.withColumn("shard", F.floor(F.col("before").cast("decimal(38,0)") * shards / max(size, 1)).cast("int"))
        firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
        placed = placed.join(firsts, "shard").withColumn("slot", F.col("at") - F.col("first"))
    return placed.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "curve", "shard", "slot")


def ranges(docs: DataFrame, placed: DataFrame, dimensions: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Per shard the least and greatest value of each dimension: what a reader prunes by. Keys must be unique."""
    both = docs.select(key, *dimensions).join(placed.select(key, "shard"), key)
    return both.groupBy("shard").agg(F.count("*").alias("rows"), *(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))))
