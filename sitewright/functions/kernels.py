"""Small Arrow kernels for what Columns cannot express: hull, oriented box, polygon overlap.

Each works on one ring at a time inside a vectorised UDF; Spark partitions and shuffles the rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sitewright.functions.slabs import overlap_area as slab_overlap_area  # the function alone: a module would travel with its used UDFs

# executors need not have this package installed: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DOUBLE = T.DoubleType()
_PATH_T = T.ArrayType(T.StructType([T.StructField("x", _DOUBLE), T.StructField("y", _DOUBLE)]))
_OBB_T = T.StructType([T.StructField(n, _DOUBLE) for n in ("cx", "cy", "length", "width", "ax", "ay")])


def _points(ring) -> list[tuple[float, float]]:
    return [(float(p["x"]), float(p["y"])) for p in ring]


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise and open (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) <= 2:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) >= 2 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def oriented_box(points: list[tuple[float, float]]):
    """Smallest-area rectangle: a side lies on a hull edge. The long side carries the axis vector."""
    h = hull(points)
    if len(h) < 3:
        return None
    best = None
    for (x0, y0), (x1, y1) in zip(h, h[1:] + h[:1]):
        size = math.hypot(x1 - x0, y1 - y0)
        ux, uy = (x1 - x0) / size, (y1 - y0) / size
        along = [x * ux + y * uy for x, y in h]
        across = [y * ux - x * uy for x, y in h]
        a0, a1, c0, c1 = min(along), max(along), min(across), max(across)
        box_area = (a1 - a0) * (c1 - c0)
        if best is None or box_area < best[0] - 1e-9:
            best = (box_area, ux, uy, a0, a1, c0, c1)
    _, ux, uy, a0, a1, c0, c1 = best
    ma, mc = (a0 + a1) / 2.0, (c0 + c1) / 2.0
    cx, cy = ma * ux - mc * uy, ma * uy + mc * ux
    length, width = a1 - a0, c1 - c0
    if width > length:
        length, width, ux, uy = width, length, -uy, ux
    return cx, cy, length, width, ux, uy


def clip_convex(subject, clip):
    """Part of any simple polygon inside a convex counter-clockwise one (half-plane cuts)."""
    out = list(subject)
    for (x0, y0), (x1, y1) in zip(clip, clip[1:] + clip[:1]):
        if not out:
            break
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)
        cut, prev = [], out[-1]
        sp = side(prev)
        for cur in out:
            sc = side(cur)
            if (sp < 0) != (sc < 0):
                t = sp / (sp - sc)
                cut.append((prev[0] + t * (cur[0] - prev[0]), prev[1] + t * (cur[1] - prev[1])))
            if sc >= 0:
                cut.append(cur)
            prev, sp = cur, sc
        out = cut
    return out


def shoelace(points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2.0


def overlap_area(p, q) -> float:
    """Exact area of the intersection of two simple polygons.

    Both are written as signed fans of triangles; overlaps of triangle pairs add up with the
    product of their signs, which also holds for concave outlines.
    """
    def fan(poly):
        ox, oy = poly[0]
        for a, b in zip(poly[1:], poly[2:]):
            w = (a[0] - ox) * (b[1] - oy) - (a[1] - oy) * (b[0] - ox)
            if w:
                yield (1.0, [(ox, oy), a, b]) if w > 0 else (-1.0, [(ox, oy), b, a])

    tq = list(fan(q))
    return abs(sum(sp * sq * abs(shoelace(c)) for sp, tp in fan(p) for sq, t in tq if (c := clip_convex(tp, t))))


def _open(ring):
    pts = _points(ring)
    return pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts


def _first_crossing(pts):
    """Edges i < j that properly cross, and the point, of the lowest i and then j; None for a simple ring."""
    first = min(((min(i, j), max(i, j), p) for i, _, j, _, p in crossings(pts)), default=None) if len(pts) > 3 else None
    return first


def crossings(points) -> list[tuple[int, float, int, float, tuple[float, float]]]:
    """All proper crossings of a closed outline's edges: (edge i, how far along, edge j, how far along, point).

    Edges are sorted by their left ends; each meets only those that begin before it ends, of which the ones beside it in height drop out at once.
    """
    a = np.array(points, dtype=np.float64)
    d = np.roll(a, -1, axis=0) - a
    low, high = np.minimum(a, a + d), np.maximum(a, a + d)
    order = np.argsort(low[:, 0], kind="stable")
    last = np.searchsorted(low[order, 0], high[order, 0], side="right")
    out, n, at = [], len(a), 0
    while at < n:
        stop = at + 1  # as many edges at a time as have about a million partners
        total = last[at] - at
        while stop < n and total + last[stop] - stop < 1 << 20:
            total += last[stop] - stop
            stop += 1
        counts = last[at:stop] - np.arange(at, stop) - 1
        first = np.repeat(np.arange(at, stop), counts)
        second = first + 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        i, j = order[first], order[second]
        near = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[near], j[near]
        den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = a[j] - a[i]
        with np.errstate(all="ignore"):
            t, u = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / den, (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / den
        beside = (np.abs(i - j) == 1) | (np.abs(i - j) == n - 1)
        for k in np.flatnonzero((den != 0) & (0 < t) & (t < 1) & (0 < u) & (u < 1) & ~beside):
            p = a[i[k]] + t[k] * d[i[k]]
            out.append((int(i[k]), float(t[k]), int(j[k]), float(u[k]), (float(p[0]), float(p[1]))))
        at = stop
    return out


def _encloses(ring, p) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def loops(points) -> list[tuple[list[tuple[float, float]], int]]:
    """Simple loops of an outline that may cross itself, open, each with the winding number of what lies just inside it.

    At every crossing the two passes change over, so that each goes on along the other's way: the outline falls into loops that do not cross.
    A loop inside another one of its own direction is wound twice, one of the other direction is a hole.
    """
    pts = list(points)
    on: dict[int, list[tuple[float, int]]] = {}
    met = crossings(pts) if len(pts) > 3 else []
    for k, (i, t, j, u, _) in enumerate(met):
        on.setdefault(i, []).append((t, k))
        on.setdefault(j, []).append((u, k))
    walk: list[tuple[tuple[float, float], int]] = []  # place, crossing or -1
    for e, p in enumerate(pts):
        walk.append((p, -1))
        walk += [(met[k][4], k) for _, k in sorted(on.get(e, ()))]
    passes: dict[int, list[int]] = {}
    for at, (_, k) in enumerate(walk):
        if k >= 0:
            passes.setdefault(k, []).append(at)
    follow = [(at + 1) % len(walk) for at in range(len(walk))]
    for x, y in passes.values():
        follow[x], follow[y] = follow[y], follow[x]
    rings, left = [], set(range(len(walk)))
    for begin in range(len(walk)):
        ring, at = [], begin
        while at in left:
            left.discard(at)
            ring.append(walk[at][0])
            at = follow[at]
        if len(ring) > 2:
            rings.append(ring)
    turn = [(area > 0) - (area < 0) for area in map(shoelace, rings)]
    out = []
    for n, ring in enumerate(rings):
        if not turn[n]:
            continue
        (ax, ay), (bx, by) = max(zip(ring, ring[1:] + ring[:1]), key=lambda s: math.hypot(s[1][0] - s[0][0], s[1][1] - s[0][1]))
        inward = ((ax + bx) / 2 - (by - ay) * 1e-7 * turn[n], (ay + by) / 2 + (bx - ax) * 1e-7 * turn[n])
        out.append((ring, turn[n] + sum(turn[m] for m, other in enumerate(rings) if m != n and _encloses(other, inward))))
    return out


def largest_loop(points):
    """A self-crossing ring falls apart at its crossings; the loop of largest area, open, or None."""
    best = max((ring for ring, _ in loops(points)), key=lambda r: abs(shoelace(r)), default=None) if len(points) > 2 else None
    return best


_LOOP_T = T.ArrayType(T.StructType([T.StructField("ring", _PATH_T), T.StructField("winding", T.IntegerType()), T.StructField("area_m2", _DOUBLE)]))


@pandas_udf(_LOOP_T)
def loops_udf(ring: pd.Series) -> pd.Series:
    """All simple loops of a ring, closed, largest first, with the winding number inside; an empty list for none."""
    def one(r):
        if r is None or len(r) < 3:
            return []
        found = sorted(loops(_open(r)), key=lambda x: -abs(shoelace(x[0])))
        return [{"ring": [{"x": a, "y": b} for a, b in p + p[:1]], "winding": w, "area_m2": abs(shoelace(p))} for p, w in found]

    return pd.Series([one(r) for r in ring])


@pandas_udf(_PATH_T)
def untangled_udf(ring: pd.Series) -> pd.Series:
    """The largest simple loop of a ring, closed; null for none."""
    def one(r):
        pts = largest_loop(_open(r)) if r is not None and len(r) else None
        return [{"x": a, "y": b} for a, b in pts + pts[:1]] if pts else None

    return pd.Series([one(r) for r in ring])


@pandas_udf(_DOUBLE)
def overlap_area_udf(p: pd.Series, q: pd.Series) -> pd.Series:
    def one(a, b):
        if a is None or b is None or not len(a) or not len(b):
            return None
        a, b = _open(a), _open(b)
        # the same area either way: pairs of triangles for a few corners, slabs beyond, which grow with the corners and not with their product
        return overlap_area(a, b) if len(a) * len(b) <= 64 else slab_overlap_area(a, b)

    return pd.Series([one(a, b) for a, b in zip(p, q)], dtype="float64")


@pandas_udf(_OBB_T)
def oriented_box_udf(ring: pd.Series) -> pd.DataFrame:
    rows = [(oriented_box(_open(r)) if r is not None else None) or (None,) * 6 for r in ring]
    return pd.DataFrame(rows, columns=["cx", "cy", "length", "width", "ax", "ay"]).astype("float64")


@pandas_udf(_PATH_T)
def clip_to_circle_udf(ring: pd.Series, cx: pd.Series, cy: pd.Series, r: pd.Series) -> pd.Series:
    """Ring clipped to a 64-corner circle as one ring, its parts joined along the circle; null when nothing is left."""
    def one(ring_, x, y, rad):
        if ring_ is None or len(ring_) == 0:
            return None
        circle = [
            (x + rad * math.cos(2 * math.pi * k / 64), y + rad * math.sin(2 * math.pi * k / 64)) for k in range(64)
        ]
        pts = clip_convex(_open(ring_), circle)
        if len(pts) < 3 or abs(shoelace(pts)) == 0.0:
            return None
        return [{"x": a, "y": b} for a, b in pts + pts[:1]]

    return pd.Series([one(*row) for row in zip(ring, cx, cy, r)])


def hull_rows(key: str):
    """mapInPandas function: hull vertices per key inside each Arrow batch (a map-side combine)."""
    def run(batches):
        for pdf in batches:
            points: dict = {}
            for k, x, y in zip(pdf[key], pdf["x"], pdf["y"]):
                points.setdefault(k, []).append((float(x), float(y)))
            rows = [(k, x, y) for k, pts in points.items() for x, y in hull(pts)]
            yield pd.DataFrame(rows, columns=[key, "x", "y"])

    return run


@pandas_udf(_PATH_T)
def hull_udf(points: pd.Series) -> pd.Series:
    """Closed convex ring of each point list; null for none."""
    def one(ps):
        if ps is None or len(ps) == 0:
            return None
        pts = hull(_points(ps))
        return [{"x": x, "y": y} for x, y in pts + pts[:1]]

    return pd.Series([one(p) for p in points])
