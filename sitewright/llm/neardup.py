"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

1. One pass hashes every text's word shingles to 64 bits; its sketch is the ``k`` smallest values. Texts with equal sets form a
   class, its smallest id stands for it.
2. Inverted lists of the retained values. Two sets that are similar enough share at least a computable number of retained
   values, so they share one among each sketch's rarest few: only those enter the lists, rarest first. A value of one document
   alone makes no list, so documents with enough words of their own drop out here.
3. Documents that share a list, directly or over others, form a family. Families are cut into blocks of bounded size; a task
   holds two blocks of one family, counts overlaps of sketches, drops pairs by the union-sketch estimate, verifies the rest on
   full sets, and returns a spanning forest of the links, not all pairs.
4. Connected components of the links.

The overlap and the estimate use bounds with a miss probability below 1e-8 for a pair at the threshold (none for sets of at
most ``k`` shingles, whose sketch is the set).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import BLANK_WORDS, connected_components, mix, runs, text_buffers, word_hashes, written

K = 128
MISS = 1e-8
BATCH_BYTES = 2 << 20
DOCS_PER_FILE = 100_000  # of the small tables between steps
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 19, 512  # of one block of a family: full sets of about 4 MB, overlap counts of about 1 MB
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a word sequence's shingles; with fewer words the whole sequence is one."""
    n = len(h)
    if not n:
        return h
    width = min(size, n)
    s = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        s = (s * _C) + h[j : n - width + 1 + j]
    return np.unique(mix(s))


def hashed_texts(raw: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Shingle set of each text of an Arrow buffer."""
    for a, b in runs(np.diff(off), BATCH_BYTES):
        part = raw[off[a] : off[b]]
        if b - a > 1:
            part = np.frombuffer(b"\n".join(raw[off[i] : off[i + 1]].tobytes() for i in range(a, b)), np.uint8)
        start, _, h = word_hashes(part, BLANK_WORDS)
        first = np.searchsorted(start, (off[a : b + 1] - off[a]) + np.arange(b - a + 1))
        for i in range(b - a):
            yield shingles(h[first[i] : first[i + 1]], size)


@lru_cache(maxsize=100_000)
def least_sketch_overlap(k: int, share: int) -> int:
    """Values that of ``k`` draws at least hit a set with ``share``/1000 of the population, but for MISS (binomial tail)."""
    p = share / 1000
    tail, c = 0.0, 0
    while c <= k:
        tail += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail > MISS:
            return c
        c += 1
    return k


def list_length(n: int, k: int, percent: int) -> int:
    """How many of its rarest retained values a set of ``n`` shingles must show.

    A similar set shares at least ceil(t * n) of its shingles. Where the sketch is the whole set, by the pigeonhole one of any
    n - ceil(t * n) + 1 is shared. Else the k smallest values are a uniform draw of the set: at least c of them are shared.
    The partner retains a shared value if its own k smallest reach as far; the partner of a set with more than k shingles may
    be up to 1/t times larger and keep fewer, so c is taken for the union: the k smallest of the union are in both sketches
    when shared, with probability t each.
    """
    if n <= 0:
        return 0
    if n <= k * percent // 100:  # every similar partner has at most k shingles too
        return n - -(-percent * n // 100) + 1
    m = min(n, k)
    return m - least_sketch_overlap(m, percent * 10) + 1


def sketches(docs: DataFrame, key: str, text: str, size: int, k: int) -> DataFrame:
    """Rows (id, n, digest, sketch): set size, digest of the whole set, its k smallest hashes as bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch = [], [], []
            for s in hashed_texts(*text_buffers(batch.column(1)), size):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["id", "n", "digest", "sketch"])

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"id {kind}, n bigint, digest binary, sketch binary")


def retained(representatives: DataFrame) -> DataFrame:
    """Rows (value, id, n) of the sketches."""
    kind = representatives.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            line = np.repeat(np.arange(len(data)), [len(x) for x in data])
            values = np.concatenate([*data, np.zeros(0, np.int64)])
            for a in range(0, len(values), 200_000):
                at = pa.array(line[a : a + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(values[a : a + 200_000]), batch.column(0).take(at), batch.column(1).take(at)], ["value", "id", "n"])

    return representatives.select("id", "n", "sketch").mapInArrow(run, f"value bigint, id {kind}, n bigint")


def rare_lists(values: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (value, id, n): the retained values that a document has among its rarest and shares with another document."""
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    kind = values.schema["id"].dataType.simpleString()
    per = values.join(shared, "value").groupBy("id", "n").agg(F.collect_list(F.struct("df", "value")).alias("held"))  # k entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, out = [], []
            for i, (n, held) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                room = list_length(n, k, percent) - (min(n, k) - len(held))  # values of no other document come first
                if room > 0:
                    chosen = sorted((x["df"], x["value"]) for x in held)[:room]
                    line += [i] * len(chosen)
                    out += [v for _, v in chosen]
            at = pa.array(line, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], ["value", "id", "n"])

    return per.mapInArrow(run, f"value bigint, id {kind}, n bigint")


class Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def estimate_floor(k: int, percent: int) -> int:
    """Of the union's k smallest values, how many lie in both sets at least, for sets at the threshold."""
    return least_sketch_overlap(k, percent * 10)


def verify_block(sets: list[np.ndarray], side: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """Links that span the similar pairs of a block (pairs of the two sides, or all where there is one side)."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    kept = [s[:k] for s in sets]
    values, line = np.concatenate(kept), np.repeat(np.arange(m), [len(s) for s in kept])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    line, column = line[shared], np.unique(column[shared], return_inverse=True)[1]
    overlap = np.zeros((m, m), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    line, column = line[order], column[order]
    for a in range(0, width, 2048):  # inverted lists of the block, some at a time, to overlap counts
        lo, hi = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((m, min(2048, width - a)), np.float32)
        part[line[lo:hi], column[lo:hi] - a] = 1
        overlap += part @ part.T
    small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
    # union sketch: of its min(k, union) smallest values at least c are shared; the overlap of the sketches bounds the shared ones
    full = large <= k
    need = np.where(full, np.ceil(percent * (small + large) / (100 + percent) - 1e-9), estimate_floor(k, percent))
    maybe = (small * 100 >= percent * large) & (overlap >= need) & (side[:, None] != side[None, :] if side.any() else True)
    a, b = np.nonzero(np.triu(maybe, 1))
    forest, links = Forest(m), []
    for i in np.argsort(-overlap[a, b], kind="stable"):
        x, y = int(a[i]), int(b[i])
        if forest.root(x) == forest.root(y):
            continue
        s, t = sets[x], sets[y]
        if len(s) > k or len(t) > k:  # the estimate proper
            union = np.union1d(s[:k], t[:k])[:k]
            both = np.isin(union, s, assume_unique=True) & np.isin(union, t, assume_unique=True)
            if len(union) == k and int(both.sum()) < estimate_floor(k, percent):
                continue
        common = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * common >= percent * (len(s) + len(t) - common) and forest.join(x, y):
            links.append((x, y))
    return links


def _links(work: DataFrame, size: int, k: int, percent: int) -> DataFrame:
    """Links of every (family, first block, second block); rows come sorted, a task streams one group after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, side, links = None, [], [], [], []

        def close() -> None:
            if len(sets) > 1:
                links.extend((ids[x], ids[y]) for x, y in verify_block(sets, np.array(side), k, percent))

        for batch in batches:
            f, i, j, own, key = (batch.column(c).to_pylist() for c in range(5))
            for line, s in enumerate(hashed_texts(*text_buffers(batch.column(5)), size)):
                if (f[line], i[line], j[line]) != group:
                    close()
                    group, ids, sets, side = (f[line], i[line], j[line]), [], [], []
                ids.append(key[line])
                sets.append(s)
                side.append(int(own[line] != i[line]))
            if len(links) > 10_000:
                yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in links], schema=out)
                links = []
        close()
        yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in links], schema=out)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = work.schema["id"].dataType
    out = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind))])
    return work.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    Links join texts whose sets of distinct ``size``-word shingles have 100 * intersection >= percent * union; component_id is
    the smallest key reachable, kept marks the document that has it. Null texts and texts without words have the empty set, are
    linked with nothing and are kept. Rows with the same key are one node: their classes join, each row is returned. Rows with
    a null key take no part and are kept with a null component. An empty table gives no rows; other columns are not read. Texts are hashed whole.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    found = written(sketches(docs, key, text, size, k), "sketches")
    files = 1 + found.count() // DOCS_PER_FILE
    sets = found.where("n > 0 and id is not null")
    copied = written(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "copied", files=files)
    member = written(sets.join(copied, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"), "n"), "classes", files=files)
    reps = written(member.where("id = rep").select("id").distinct(), "representatives", files=files)
    lists = written(rare_lists(retained(sets.join(reps, "id", "left_semi").dropDuplicates(["id", "digest"])), k, percent), "lists", files=files)
    leaders = lists.groupBy("value").agg(F.min("id").alias("leader"))
    families = connected_components(lists.join(leaders, "value").select(F.col("id").alias("a"), F.col("leader").alias("b")), "families", files=files)
    placed = lists.select("id", "n").distinct().join(families, "id")
    blocks = placed.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"))
    own = placed.join(blocks, "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = own.select("id", "component", "own", other.alias("x")).select(
        "component", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "id"
    )
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    groups = ("component", "i", "j")
    work = pairs.join(texts, "id").select(*groups, "own", "id", "text").repartition(*groups).sortWithinPartitions(*groups)
    links = _links(work, size, k, percent)
    # copies of a set need no links: they have their representative's component; a key with several sets joins their classes
    own_rep = member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    several = own_rep.where("rep <> last").select("id")
    edges = links.union(member.join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(edges, "links", files=files).withColumnRenamed("id", "rep")
    out = found.select("id", "n").join(own_rep.drop("last"), "id", "left").join(components, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
