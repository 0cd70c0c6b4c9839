"""Shared helpers: folders, written tables, byte-level words, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SENT: list[tempfile.TemporaryDirectory] = []

PIECE = 1 << 20  # bytes of text handled at once
ROWS_PER_FILE = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset a fresh folder is made, for single-process sessions only; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if _LOCAL.get("app") != app:
        _LOCAL.update(app=app, path="file://" + tempfile.mkdtemp(prefix="sitewright-llm-"))
    return _LOCAL["path"]


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, rows: int | None = None, files: int | None = None) -> DataFrame:
    """Write to a fresh shared folder and read back: cuts lineage, and a lost executor costs no recomputation.

    ``rows``: where the number of rows is about known and little work is left to do, no more tasks and files than it needs.
    ``files``: rows are dealt to so many files in a step of its own, for results far smaller than what they come from.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    if files is not None:
        df = df.repartition(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that can't import it (once per session)."""
    app = spark.sparkContext.applicationId
    if _LOCAL.get("shipped") == app:
        return
    package = __name__.partition(".")[0]

    def there(batches):
        import importlib.util

        import pyarrow

        for b in batches:
            yield pyarrow.RecordBatch.from_pydict({"there": [importlib.util.find_spec(package) is not None] * b.num_rows})

    if not spark.range(1, numPartitions=1).mapInArrow(there, "there boolean").first()[0]:
        home = Path(__file__).resolve().parents[1]
        _SENT.append(tempfile.TemporaryDirectory())  # the driver serves the file as long as it lives
        name = f"{_SENT[-1].name}/{package}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"{package}/{f.relative_to(home)}")
        spark.sparkContext.addPyFile(name)
    _LOCAL["shipped"] = app


def table(spark: SparkSession, sf_dir: str, name: str, native: bool = False) -> DataFrame:
    """One of the given tables; ``native`` for uses without any Python on the executors."""
    if not native:
        ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(df: DataFrame, keep: tuple[str, ...] | None, name: str) -> tuple[str, ...]:
    """Columns to return beside a new column ``name``, which replaces one that has the name already."""
    return tuple(c for c in (df.columns if keep is None else keep) if c.lower() != name.lower())


# ---- words of UTF-8 bytes ------------------------------------------------------------------------------------------


def byte_classes(separators: Iterator[int]) -> np.ndarray:
    """Lookup of 256 bytes: 0 for separators, else the byte, A-Z lower-cased."""
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("A") : ord("Z") + 1] += 32
    lut[list(separators)] = 0
    return lut


#: words are runs of anything but the six ASCII blanks (byte 0 is mapped to 1 so that it stays a word byte)
BLANK_WORDS = byte_classes([0x20, *range(0x09, 0x0E)])
BLANK_WORDS[0] = 1
#: words are runs of ASCII letters and digits and of everything beyond ASCII
ALNUM_WORDS = byte_classes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _piece_words(raw: np.ndarray, lut: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    low = lut[raw]
    edge = np.diff((low != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, inv = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(low.astype(np.uint64) * p[: len(raw)], out=sums[1:])
    salt, back = np.uint64(0xD6E8FEB86659FD93), inv[start]
    h = mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64) * salt)
    heads = (mix((sums[np.minimum(start + n, end)] - sums[start]) * back + np.uint64(((n << 32 | 1) * 0xD6E8FEB86659FD93) & _M64)) for n in prefixes)
    return start, end, h, *heads


def word_hashes(raw: np.ndarray, lut: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Starts, ends and 64-bit hashes of the words of a byte array, and of their first bytes for each number in ``prefixes``.

    Works piece by piece, so that long texts need little memory.
    """
    if len(raw) <= PIECE:
        return _piece_words(raw, lut, prefixes)
    out, at = [], 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        while stop < len(raw):  # move the cut to a separator
            gap = np.flatnonzero(lut[raw[stop : stop + 4096]] == 0)
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + 4096, len(raw))
        s, e, *h = _piece_words(raw[at:stop], lut, prefixes)
        out.append((s + at, e + at, *h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()  # what the batch before has left
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def runs(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``budget``, at least one index each."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > budget:
            yield at, i
            at, total = i, 0
        total += int(n)
    if len(sizes) > at:
        yield at, len(sizes)


# ---- connected components ------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """Rows (id, component): for every id in ``edges`` (a, b) the smallest id it is connected with.

    Alternates large-star and small-star steps; every step is one aggregation and one join on the nodes, so a node with very
    many neighbours is combined before the shuffle and its join partition can be split. Each round is written; ``files`` says how
    many files the edges are worth.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag, files=files
    )
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(
            large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(),
            tag, rows=seen[0] if seen else None,
        )
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
