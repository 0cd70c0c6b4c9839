"""Exact top-k inner-product search with two cover trees.

Vectors and queries are cut into blocks; a task holds one block of each and indexes both with cover trees. The search descends
pairs of nodes, most promising first, and drops a pair when no query below its query node can find anything below its data
node that beats that query's worst k-th score so far. Scores are integers, so results are exact. Vectors with components so
large that a score might leave 64 bits (``wide``) are scored with integers of any length against every other one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitewright.llm.common import written

BLOCK_BYTES = 16 << 20  # of one block's vectors, eight bytes a component
MAX_ROWS, MAX_QUERIES = 16_384, 2_048
LEAF, CENTERS = 48, 64
NOTHING = np.iinfo(np.int64).min + 1  # its negative is a number too
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # scores beyond are returned as these


class Node:
    __slots__ = ("center", "children", "least", "norm", "parent", "points", "radius", "top", "first", "last", "matrix", "radii", "norms", "tops")

    def __init__(self, center: np.ndarray, points: np.ndarray, radius: float, top: float) -> None:
        self.center, self.points, self.radius, self.top = center, points, radius, top
        self.norm = float(np.linalg.norm(center))
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.least = -math.inf  # the worst k-th score of the queries below


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of the rows of ``x``: the children of a node at scale s are a net of its points at scale s / 2, its own centre
    first (nesting), every point within s / 2 of its child's centre (covering), centres further apart than that (separation)."""
    squares = np.einsum("ij,ij->i", x, x)
    norms = np.sqrt(squares)
    root_distance = np.linalg.norm(x - x[0], axis=1)
    root = Node(x[0], np.arange(len(x)), float(root_distance.max()), float(norms.max()))
    todo = [(root, root_distance)]
    while todo:
        node, distance = todo.pop()
        if len(node.points) <= leaf or node.radius == 0:
            continue
        half = 2.0 ** (math.ceil(math.log2(node.radius)) - 1)
        inside = distance <= half
        groups = [(node.center, node.points[inside], distance[inside])] if inside.any() else []
        rest = node.points[~inside]
        while len(rest):  # the first points left are tried as centres, distances to all of them at once
            tried = rest[:CENTERS]
            d2 = squares[rest][:, None] + squares[tried][None, :] - 2 * (x[rest] @ x[tried].T)
            left = np.ones(len(rest), bool)
            for j in range(len(tried)):
                if left[j]:
                    inside = left & (d2[:, j] <= half * half)
                    inside[j] = True
                    groups.append((x[tried[j]], rest[inside], np.sqrt(np.maximum(d2[inside, j], 0.0))))
                    left &= ~inside
            rest = rest[left]
        if len(groups) == 1:
            continue
        # neighbours with few points share a leaf: a node for each would cost more than its points' scores
        small = [g for g in groups if len(g[1]) <= leaf // 4]
        for c, points, d in [g for g in groups if len(g[1]) > leaf // 4]:
            child = Node(c, points, float(d.max()) * (1 + 1e-9) + 1e-9, float(norms[points].max()))
            node.children.append(child)
            todo.append((child, d))
        while small:
            take, total = [], 0
            while small and (not take or total + len(small[-1][1]) <= leaf):
                take.append(small.pop())
                total += len(take[-1][1])
            points = np.concatenate([g[1] for g in take])
            c = x[points].mean(axis=0)
            node.children.append(Node(c, points, float(np.linalg.norm(x[points] - c, axis=1).max()), float(norms[points].max())))
        for child in node.children:
            child.parent = node
        node.matrix = np.stack([c.center for c in node.children])
        node.radii, node.norms, node.tops = (np.array([getattr(c, k) for c in node.children]) for k in ("radius", "norm", "top"))
    return root


def _bounds(q: Node, centers: np.ndarray, radii: np.ndarray, norms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """No inner product of a query below ``q`` and a point below each node is larger."""
    product = centers @ q.center
    by_radius = product + q.radius * norms + radii * q.norm + q.radius * radii
    apart = np.sqrt(np.maximum(norms**2 + q.norm**2 - 2 * product, 0.0)) - q.radius - radii
    by_distance = (q.top**2 + tops**2 - np.maximum(apart, 0.0) ** 2) / 2
    out = np.minimum(by_radius, by_distance)
    return out + 1e-9 * (np.abs(out) + q.top * tops) + 1e-6


def dual_search(queries: np.ndarray, data: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
    """Per query the ``k`` best data rows by (score, smaller index): scores, indices (-1 where there are fewer), pairs scored."""
    n = len(data)
    best = np.full((len(queries), k), NOTHING)
    found = np.full((len(queries), k), n)
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    if peak >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    exact = peak >= 2**53
    qx, dx = queries.astype(np.float64), data.astype(np.float64)
    qroot, droot = cover_tree(qx, 32), cover_tree(dx, leaf)
    scored = 0

    def base(q: Node, points: np.ndarray) -> None:
        nonlocal scored
        scored += len(q.points) * len(points)
        s = queries[q.points] @ data[points].T if exact else (qx[q.points] @ dx[points].T).astype(np.int64)
        use = (s >= best[q.points, -1][:, None]).any(axis=0)
        if not use.any():
            return
        s = np.concatenate([best[q.points], s[:, use]], axis=1)
        i = np.concatenate([found[q.points], np.broadcast_to(points[use], (len(q.points), int(use.sum())))], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k] if s.shape[1] > k else np.lexsort((i, -s), axis=1)
        best[q.points], found[q.points] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        worst = best[q.points, -1].min()
        q.least = -math.inf if worst == NOTHING else float(worst)
        up = q.parent
        while up is not None:
            least = min(c.least for c in up.children)
            if least == up.least:
                break
            up.least, up = least, up.parent

    todo = [(math.inf, qroot, droot)]
    while todo:
        bound, q, d = todo.pop()
        if bound < q.least:
            continue
        if d.children and (not q.children or d.radius >= q.radius):
            b = _bounds(q, d.matrix, d.radii, d.norms, d.tops)
            live = np.flatnonzero(b >= q.least)
            if not q.children:  # leaves of this node at once
                flat = [j for j in live if not d.children[j].children]
                if flat and len(flat) < len(live) or len(flat) > 1:
                    flat.sort(key=lambda j: -b[j])
                    for a in range(0, len(flat), 16):
                        part = [d.children[j].points for j in flat[a : a + 16] if b[j] >= q.least]
                        if part:
                            base(q, np.concatenate(part))
                    live = np.array([j for j in live if d.children[j].children], dtype=np.int64)
            todo.extend((b[j], q, d.children[j]) for j in live[np.argsort(b[live], kind="stable")])
        elif q.children:
            todo.extend((bound, c, d) for c in q.children)
        else:
            base(q, d.points)
    found[found == n] = -1
    return best, found, scored


def saturated(score: int) -> tuple[int, bytes]:
    """A score within 64 bits, and what orders those beyond (bytes that compare as the scores do; empty within)."""
    if LEAST < score < MOST:
        return score, b""
    size = abs(score)
    raw = size.to_bytes((size.bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return (MOST, raw) if score > 0 else (LEAST, bytes(255 - x for x in raw))


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """Rows (id, dim, wide, v): floor(scale * component); vectors with anything missing or not finite go.

    v holds little-endian 64-bit integers, or decimal numbers with commas where ``wide``: there a component is so large that
    the inner product of two such vectors could leave 62 bits.
    """
    c = F.col(vector)
    good = c.isNotNull() & F.col(key).isNotNull() & F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kind = vectors.schema[key].dataType.simpleString()

    def whole_of(x: float) -> int:
        product = scale * x
        return math.floor(product) if math.isfinite(product) else math.floor(Fraction(scale) * Fraction(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            with np.errstate(over="ignore"):
                whole = np.floor(scale * flat)
            dims = np.diff(off)
            over = np.abs(whole) >= np.repeat(2.0**31 / np.sqrt(np.maximum(dims, 1)), dims)
            wide = np.diff(np.concatenate([[0], np.cumsum(over)])[off]) > 0
            plain = np.where(over, 0.0, whole).astype("<i8")
            made = [
                ",".join(str(whole_of(float(v))) for v in flat[x:y]).encode() if w else plain[x:y].tobytes() for x, y, w in zip(off, off[1:], wide, strict=False)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims), pa.array(wide), pa.array(made, pa.binary())], ["id", "dim", "wide", "v"])

    return vectors.where(good).select(F.col(key), c.cast("array<double>").alias("__v")).mapInArrow(run, f"id {kind}, dim bigint, wide boolean, v binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows (query_id, rank from 1, id, score): each query's ``k`` best rows by inner product of floor(scale * x), ties to the smaller id.

    ``is_query`` says, by the column ``id``, which rows are queries. Candidates are all rows with another id and as many
    components; with fewer than ``k``, all of them. Vectors that are null or hold a null or a non-finite component take no
    part, nor do null ids. Of rows repeated whole one query is made, as candidates each counts. Copies of a vector are indexed
    once per block, with the k + 1 smallest ids, as more can't be among the k best. Ranks follow the exact scores; a score
    beyond 64 bits is returned as the nearest 64-bit number.
    """
    rows = written(quantised(vectors, key, vector, scale), "vectors")
    # copies first: only the k + 1 smallest ids of a vector can matter; two steps, so that a very common vector spreads over tasks
    part = F.pmod(F.xxhash64("id"), F.lit(1 + rows.count() // 100_000))
    kept = rows.groupBy("dim", "wide", "v", part.alias("p")).agg(F.array_sort(F.collect_list("id")).alias("ids")).select("dim", "wide", "v", F.slice("ids", 1, k + 1).alias("ids"))
    kept = written(kept.groupBy("dim", "wide", "v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "distinct-vectors")
    queries = rows.where(is_query).distinct()
    n, widest = kept.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = max(1, min(MAX_ROWS, BLOCK_BYTES // (8 * max(widest, 1))))
    blocks, groups = max(1, -(-n // size)), max(1, -(-queries.count() // min(MAX_QUERIES, size)))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("query_id", to_arrow_type(kind)), ("query", pa.binary()), ("id", to_arrow_type(kind)), ("score", pa.int64()), ("beyond", pa.binary())])
    b, g = F.pmod(F.xxhash64("v"), F.lit(blocks)), F.pmod(F.xxhash64("id", "v"), F.lit(groups))
    left = kept.select("dim", b.alias("b"), F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("g"), "wide", "v", "ids")
    right = queries.select("dim", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"), g.alias("g"), "id", "wide", "v")

    def numbers(raw: bytes, wide: bool) -> np.ndarray:
        return np.array([int(x) for x in raw.split(b",")] if wide else np.frombuffer(raw, "<i8").tolist(), dtype=object)

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return out.empty_table()
        dim = data.column("dim")[0].as_py()
        ids, values, wide = (data.column(c).to_pylist() for c in ("ids", "v", "wide"))
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])  # index order is the order of smallest ids
        names, raw, wide_q = (asked.column(c).to_pylist() for c in ("id", "v", "wide"))
        best: list[list[tuple[int, int]]] = [[] for _ in names]  # (score, row of data)
        rows, asks = [i for i in order if not wide[i]], [i for i in range(len(names)) if not wide_q[i]]
        if rows and asks:
            x = np.frombuffer(b"".join(values[i] for i in rows), "<i8").reshape(len(rows), dim)
            q = np.frombuffer(b"".join(raw[i] for i in asks), "<i8").reshape(len(asks), dim)
            score, found, _ = dual_search(q, x, k + 1) if dim else (np.zeros((len(asks), 1), np.int64), np.zeros((len(asks), 1), np.int64), 0)
            for i, s, f in zip(asks, score, found, strict=True):
                best[i] = [(int(a), rows[j]) for a, j in zip(s, f, strict=True) if j >= 0]
        big = [i for i in order if wide[i]]
        big_x = np.stack([numbers(values[i], True) for i in big]) if big else None
        all_x = None
        for i in range(len(names)) if big else [i for i in range(len(names)) if wide_q[i]]:
            q = numbers(raw[i], wide_q[i])
            if wide_q[i] and all_x is None:
                all_x = np.stack([numbers(values[j], wide[j]) for j in order])
            those, x = (order, all_x) if wide_q[i] else (big, big_x)
            # of equal scores the first in order has the smallest ids
            best[i] += heapq.nlargest(k + 1, zip((x @ q).tolist(), those, strict=True), key=lambda e: e[0])
        made = []
        for name, value, entries in zip(names, raw, best, strict=True):
            nearest = sorted((-a, i) for a, j in entries for i in ids[j] if i != name)[:k]
            for a, i in nearest:
                shown, beyond = saturated(-a)
                made.append({"query_id": name, "query": value, "id": i, "score": shown, "beyond": beyond})
        return pa.Table.from_pylist(made, schema=out)

    t = kind.simpleString()
    keys = ("dim", "g", "b")
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"query_id {t}, query binary, id {t}, score bigint, beyond binary")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
