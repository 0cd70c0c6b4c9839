"""Exact areas of combined outlines by slab decomposition, and clipping to a convex outline with all parts.

The plane is cut into vertical slabs at every corner and crossing. Inside a slab no two curves cross, so sorted by height they
bound trapezoids (with an arc for a side where an outline is rounded), and each is wholly inside or outside every shape.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# executors need not have this package installed: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_POINT_T = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_CELLS = 1 << 21  # slab and curve pairs that are looked at together

Ring = list[tuple[float, float]]


def open_ring(ring) -> Ring:
    pts = [(float(p["x"]), float(p["y"])) for p in ring]
    return pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts


class Curves:
    """Boundaries of several shapes as curves over x: straight (x0, y0, x1, y1) or halves of circles (cx, cy, r, side)."""

    def __init__(self) -> None:
        self.lines: list[tuple] = []  # x0, y0, x1, y1, shape
        self.arcs: list[tuple] = []  # cx, cy, r, side, shape
        self.shapes = 0

    def ring(self, pts: Ring) -> None:
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            if ax != bx:
                self.lines.append((ax, ay, bx, by, self.shapes) if ax < bx else (bx, by, ax, ay, self.shapes))
        self.shapes += 1

    def disc(self, x: float, y: float, r: float) -> None:
        self.arcs += [(x, y, r, 1.0, self.shapes), (x, y, r, -1.0, self.shapes)]
        self.shapes += 1

    def border(self, pts: Ring, width: float) -> None:
        """All places nearer than ``width`` to an outline: a box about each edge and a disc about each corner."""
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            n = math.hypot(bx - ax, by - ay)
            if n:
                dx, dy = -(by - ay) / n * width, (bx - ax) / n * width
                self.ring([(ax + dx, ay + dy), (bx + dx, by + dy), (bx - dx, by - dy), (ax - dx, ay - dy)])
            self.disc(ax, ay, width)


def _crossings(lines: np.ndarray, circles: np.ndarray) -> list[np.ndarray]:
    """All x at which two straight curves, a straight one and a circle, or two circles may meet."""
    x0, y0, x1, y1 = lines[:, :4].T
    m = (y1 - y0) / (x1 - x0)
    b = y0 - m * x0
    i, j = np.triu_indices(len(lines), 1)
    x = (b[j] - b[i]) / (m[i] - m[j])
    out = [x[(np.maximum(x0[i], x0[j]) <= x) & (x <= np.minimum(x1[i], x1[j]))]]
    if len(circles):
        cx, cy, r = circles.T
        k, shift = m[:, None], b[:, None] - cy
        a, h = 1 + k**2, k * shift - cx
        root = np.sqrt(h**2 - a * (cx**2 + shift**2 - r**2))
        out += [((-h + s * root) / a).ravel() for s in (1, -1)]
        i, j = np.triu_indices(len(circles), 1)
        dx, dy = cx[j] - cx[i], cy[j] - cy[i]
        d2 = dx**2 + dy**2
        t = (d2 + r[i] ** 2 - r[j] ** 2) / (2 * d2)
        h = np.sqrt(r[i] ** 2 / d2 - t**2)
        out += [cx[i] + t * dx + s * h * dy for s in (1, -1)]
    return out


def combined_area(curves: Curves, wanted: int) -> float:
    """Area inside all of the first ``wanted`` shapes and outside all others (inside: odd number of crossings)."""
    lines, arcs = np.array(curves.lines).reshape(-1, 5), np.array(curves.arcs).reshape(-1, 5)
    if not len(lines):
        return 0.0
    low, high = -np.inf, np.inf
    for s in range(wanted):  # nothing counts beyond the smallest range of a wanted shape
        own = lines[lines[:, 4] == s]
        if not len(own):
            return 0.0
        low, high = max(low, own[:, 0].min()), min(high, own[:, 2].max())
    if low >= high:
        return 0.0
    lines = lines[(lines[:, 0] < high) & (lines[:, 2] > low)]
    arcs = arcs[(arcs[:, 0] - arcs[:, 2] < high) & (arcs[:, 0] + arcs[:, 2] > low)] if len(arcs) else arcs
    circles = np.unique(arcs[:, :3], axis=0) if len(arcs) else np.zeros((0, 3))
    with np.errstate(all="ignore"):
        x = np.concatenate([lines[:, 0], lines[:, 2], arcs[:, 0] - arcs[:, 2], arcs[:, 0] + arcs[:, 2], *_crossings(lines, circles)])
    x = np.unique(np.clip(x[np.isfinite(x)], low, high))
    left, right = x[:-1], x[1:]
    shape = np.concatenate([lines[:, 4], arcs[:, 4]]).astype(int)
    names, shape = np.unique(shape, return_inverse=True)
    if not np.isin(np.arange(wanted), names).all():
        return 0.0
    member = np.zeros((len(shape), len(names)), np.int8)
    member[np.arange(len(shape)), shape] = 1
    need = names < wanted
    total, step = 0.0, max(1, _CELLS // (len(shape) * len(names)))
    for at in range(0, len(left), step):
        total += _slabs(left[at : at + step, None], right[at : at + step, None], lines, arcs, member, need)
    return total


def _slabs(left, right, lines, arcs, member, need) -> float:
    middle = (left + right) / 2
    x0, y0, x1, y1 = lines[:, :4].T
    y = y0 + (y1 - y0) / (x1 - x0) * (middle - x0)
    on = (x0 <= middle) & (middle <= x1)
    under = y * (right - left)
    if len(arcs):
        cx, cy, r, side = arcs[:, :4].T
        inside = (cx - r <= middle) & (middle <= cx + r)
        half = lambda x: np.sqrt(np.maximum(r**2 - (x - cx) ** 2, 0.0))
        swept = lambda x: ((x - cx) * half(x) + r**2 * np.arcsin(np.clip((x - cx) / r, -1, 1))) / 2
        y, on = np.concatenate([y, cy + side * half(middle)], 1), np.concatenate([on, inside], 1)
        under = np.concatenate([under, cy * (right - left) + side * (swept(right) - swept(left))], 1)
    order = np.argsort(np.where(on, y, np.inf), axis=1, kind="stable")
    on, under = np.take_along_axis(on, order, 1), np.take_along_axis(under, order, 1)
    odd = np.cumsum(member[order] * on[:, :, None].astype(np.int8), axis=1, dtype=np.int32) % 2 == 1
    free = (odd == need).all(axis=2)[:, :-1] & on[:, 1:]
    return float(((under[:, 1:] - under[:, :-1])[free]).sum())


def overlap_area(p: Ring, q: Ring) -> float:
    c = Curves()
    c.ring(p)
    c.ring(q)
    return combined_area(c, 2)


def free_area(site: Ring, setback: float, zones: list[Ring]) -> float:
    """Area of the places inside a site that lie at least ``setback`` from its outline and in no zone."""
    c = Curves()
    c.ring(site)
    if setback > 0:
        c.border(site, setback)
    box = [min(x for x, _ in site), max(x for x, _ in site), min(y for _, y in site), max(y for _, y in site)]
    for z in zones:
        if len(z) > 2 and min(x for x, _ in z) < box[1] and max(x for x, _ in z) > box[0] and min(y for _, y in z) < box[3] and max(y for _, y in z) > box[2]:
            c.ring(z)
    return combined_area(c, 1)


@pandas_udf(T.DoubleType())
def free_area_udf(ring: pd.Series, setback: pd.Series, zones: pd.Series) -> pd.Series:
    """:func:`free_area` per row; zones may be null; a null ring or setback gives null."""
    def one(r, s, zs):
        if r is None or s is None or s != s or len(r) < 3:
            return None
        return free_area(open_ring(r), float(s), [open_ring(z) for z in zs] if zs is not None else [])

    return pd.Series([one(*row) for row in zip(ring, setback, zones)], dtype="float64")


# --- clipping to a convex outline -------------------------------------------------------------


def clip_parts(subject: Ring, clip: Ring) -> list[Ring]:
    """All parts of a simple polygon inside a convex counter-clockwise one.

    The outline is followed in and out of the clip: each stretch inside goes from an entry to an exit, and from an exit the clip's border leads
    counter-clockwise to the next entry. A ring that stays inside, holds the clip or misses it has neither.
    """
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(subject, subject[1:] + subject[:1])) < 0:
        subject = subject[::-1]
    corners = np.array(clip)
    along = np.roll(corners, -1, axis=0) - corners
    stretches, last = [], None
    for a, b in zip(subject, subject[1:] + subject[:1]):
        d = (b[0] - a[0], b[1] - a[1])
        at = along[:, 0] * (a[1] - corners[:, 1]) - along[:, 1] * (a[0] - corners[:, 0])  # over 0: inside of that edge
        rise = along[:, 0] * d[1] - along[:, 1] * d[0]
        with np.errstate(all="ignore"):
            t = -at / rise
        if (at[rise == 0] < 0).any():
            last = None
            continue
        go_in, go_out = np.where(rise > 0, t, -np.inf), np.where(rise < 0, t, np.inf)
        i, o = int(go_in.argmax()), int(go_out.argmin())
        t0, t1 = max(0.0, float(go_in[i])), min(1.0, float(go_out[o]))
        if t0 >= t1:
            last = None
            continue
        p, q = ((a[0] + d[0] * t, a[1] + d[1] * t) for t in (t0, t1))
        if t0 > 0 or last is None:
            last = {"in": _place(corners, along, i, p) if t0 > 0 else None, "pts": [p], "out": None}
            stretches.append(last)
        last["pts"].append(q)
        if t1 < 1:
            last["out"] = _place(corners, along, o, q)
            last = None
    if not stretches:
        c = corners.mean(axis=0)
        return [list(clip)] if _holds(subject, (float(c[0]), float(c[1]))) else []
    if len(stretches) > 1 and stretches[0]["in"] is None and last is stretches[-1]:  # the walk began inside
        stretches[0]["pts"] = stretches[-1]["pts"] + stretches[0]["pts"][1:]
        stretches[0]["in"] = stretches.pop()["in"]
    if len(stretches) == 1 and stretches[0]["in"] is None and stretches[0]["out"] is None:
        return [stretches[0]["pts"][:-1]]
    for s in stretches:  # a corner right on the border
        for k, p in (("in", s["pts"][0]), ("out", s["pts"][-1])):
            if s[k] is None:
                s[k] = _place(corners, along, int(np.abs(along[:, 0] * (p[1] - corners[:, 1]) - along[:, 1] * (p[0] - corners[:, 0])).argmin()), p)
    n, parts, left = len(clip), [], set(range(len(stretches)))
    while left:
        first = now = min(left)
        ring: Ring = []
        while now in left:
            left.discard(now)
            s = stretches[now]
            ring += s["pts"]
            ahead = lambda k: (stretches[k]["in"] - s["out"] + 1e-9) % n  # noqa: E731, B023 - a link to a hole comes back in where it went out
            nxt = min((k for k in (*left, first)), key=lambda k: (ahead(k), k))
            step = ahead(nxt)
            c = math.floor(s["out"]) + 1
            while c < s["out"] + step:
                ring.append(clip[c % n])
                c += 1
            now = nxt
        parts.append([p for p, q in zip(ring, ring[1:] + ring[:1]) if p != q])
    return [p for p in parts if len(p) > 2]


def _place(corners: np.ndarray, along: np.ndarray, edge: int, p: tuple[float, float]) -> float:
    """Where on the clip's border a point of one of its edges lies: the edge and how far along."""
    d = along[edge]
    t = ((p[0] - corners[edge, 0]) * d[0] + (p[1] - corners[edge, 1]) * d[1]) / float(d @ d)
    return edge + min(max(t, 0.0), 1.0 - 1e-12)


def _holds(ring: Ring, p: tuple[float, float]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def circle(x: float, y: float, r: float, corners: int = 64) -> Ring:
    return [(x + r * math.cos(2 * math.pi * k / corners), y + r * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


@pandas_udf(T.ArrayType(T.ArrayType(_POINT_T)))
def circle_parts_udf(ring: pd.Series, cx: pd.Series, cy: pd.Series, r: pd.Series) -> pd.Series:
    """Closed rings of all parts inside a 64-corner circle; an empty list where nothing is left."""
    def one(ring_, x, y, rad):
        if ring_ is None or len(ring_) < 3:
            return []
        return [[{"x": a, "y": b} for a, b in p + p[:1]] for p in clip_parts(open_ring(ring_), circle(x, y, rad))]

    return pd.Series([one(*row) for row in zip(ring, cx, cy, r)])
