"""Planar geometry as Column expressions.

A path is ``array<struct<x double, y double>>``; a ring is a closed path. Everything here stays
in the JVM (higher-order functions), so predicates can sit directly behind an equi-join on cells.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import rules

POINT_T = "struct<x:double,y:double>"
PATH_T = f"array<{POINT_T}>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def rect_ring(minx, miny, maxx, maxy) -> Column:
    """Counter-clockwise closed ring of an axis-aligned rectangle."""
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))


def is_rect(ring: Column) -> Column:
    """Whether a closed ring is an axis-aligned rectangle of four corners; false for null."""
    r = [F.get(ring, F.lit(i)) for i in range(5)]
    wide = (r[0].y == r[1].y) & (r[1].x == r[2].x) & (r[2].y == r[3].y) & (r[3].x == r[0].x)
    tall = (r[0].x == r[1].x) & (r[1].y == r[2].y) & (r[2].x == r[3].x) & (r[3].y == r[0].y)
    return F.coalesce((F.size(ring) == 5) & (r[0] == r[4]) & (wide | tall), F.lit(False))


def rect_overlap_area(p: Column, q: Column) -> Column:
    """Common area of two rings that are axis-aligned rectangles."""
    def common(axis: str) -> Column:
        a, b, c, d = (F.get(ring, F.lit(i)).getField(axis) for ring in (p, q) for i in (0, 2))
        return F.greatest(F.least(F.greatest(a, b), F.greatest(c, d)) - F.greatest(F.least(a, b), F.least(c, d)), F.lit(0.0))

    return common("x") * common("y")


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression, so that a large one is not repeated at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(path: Column) -> Column:
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(
        F.slice(path, F.lit(1), n),
        F.slice(path, F.lit(2), n),
        lambda a, b: F.struct(a.x.alias("x0"), a.y.alias("y0"), b.x.alias("x1"), b.y.alias("y1")),
    )


class Ends(NamedTuple):
    """A segment as four Columns, in the form of an element of ``segments``."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column


def length_between(x0, y0, x1, y1) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def path_length(path: Column) -> Column:
    return F.aggregate(segments(path), F.lit(0.0), lambda acc, s: acc + length_between(s.x0, s.y0, s.x1, s.y1))


def signed_area(ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + (s.x0 * s.y1 - s.x1 * s.y0)) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def bbox(path: Column) -> dict[str, Column]:
    xs, ys = F.transform(path, lambda p: p.x), F.transform(path, lambda p: p.y)
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def fenced(df, **columns: Column):
    """Add columns behind a one-row generator: later filters on them stay above, so the optimizer does not
    copy a long expression (or a Python call) to every reference."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_bbox(df, path_col: str, prefix: str = ""):
    return df.withColumns({prefix + k: v for k, v in bbox(F.col(path_col)).items()})


def centroid(ring: Column) -> Column:
    """Area centroid of a ring; the vertex mean of the open ring when the area is zero."""
    acc0 = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    ox, oy = F.get(ring, F.lit(0)).x, F.get(ring, F.lit(0)).y

    def step(acc, s):
        x0, y0, x1, y1 = s.x0 - ox, s.y0 - oy, s.x1 - ox, s.y1 - oy
        w = x0 * y1 - x1 * y0
        return F.struct(
            (acc.a + w).alias("a"), (acc.x + (x0 + x1) * w).alias("x"), (acc.y + (y0 + y1) * w).alias("y")
        )

    m = F.aggregate(segments(ring), acc0, step)
    open_n = F.greatest(F.size(ring) - 1, F.lit(1)).cast("double")
    mean = lambda f: F.aggregate(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), F.lit(0.0), f) / open_n
    return F.when(m.a != 0, point(ox + m.x / (m.a * 3.0), oy + m.y / (m.a * 3.0))).otherwise(
        point(mean(lambda acc, p: acc + p.x), mean(lambda acc, p: acc + p.y))
    )


def crosses_upward_ray(x: Column, y: Column, s: Column) -> Column:
    """Even-odd edge test without division, so it is safe under ANSI arithmetic."""
    spans = (s.y0 > y) != (s.y1 > y)
    left = ((x - s.x0) * (s.y1 - s.y0) < (s.x1 - s.x0) * (y - s.y0)) == (s.y1 > s.y0)
    return spans & left


def on_boundary(x: Column, y: Column, path: Column) -> Column:
    def hit(s):
        cross = (s.x1 - s.x0) * (y - s.y0) - (s.y1 - s.y0) * (x - s.x0)
        return (
            (cross == 0)
            & (x >= F.least(s.x0, s.x1)) & (x <= F.greatest(s.x0, s.x1))
            & (y >= F.least(s.y0, s.y1)) & (y <= F.greatest(s.y0, s.y1))
        )

    return F.exists(segments(path), hit)


def inside_even_odd(x: Column, y: Column, ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(False), lambda acc, s: acc != crosses_upward_ray(x, y, s))


def contains(x: Column, y: Column, ring: Column) -> Column:
    """Interior only: a point on the boundary is not contained."""
    return inside_even_odd(x, y, ring) & ~on_boundary(x, y, ring)


def covers(x: Column, y: Column, ring: Column) -> Column:
    """Interior or boundary."""
    return inside_even_odd(x, y, ring) | on_boundary(x, y, ring)


def clamp01(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def segment_param(x, y, x0, y0, x1, y1) -> Column:
    """Position of the nearest point on the segment, 0..1."""
    dx, dy = x1 - x0, y1 - y0
    len2 = dx * dx + dy * dy
    return F.when(len2 > 0, clamp01(((x - x0) * dx + (y - y0) * dy) / len2)).otherwise(F.lit(0.0))


def point_segment_dist2(x, y, x0, y0, x1, y1) -> Column:
    t = segment_param(x, y, x0, y0, x1, y1)
    px, py = x0 + t * (x1 - x0) - x, y0 + t * (y1 - y0) - y
    return px * px + py * py


def dist_to_path(x: Column, y: Column, path: Column) -> Column:
    """A path of one segment, which many are, is told without a pass over an array."""
    d2 = F.transform(segments(path), lambda s: point_segment_dist2(x, y, s.x0, s.y0, s.x1, s.y1))
    first, second = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    one = F.sqrt(point_segment_dist2(x, y, first.x, first.y, second.x, second.y))
    return F.when(F.size(path) == 2, one).when(F.size(path) == 1, length_between(x, y, first.x, first.y)).otherwise(F.sqrt(F.array_min(d2)))


def dist_to_area(x: Column, y: Column, ring: Column) -> Column:
    """0 inside; a point on the outline has distance 0 to it anyway."""
    return F.when(inside_even_odd(x, y, ring), F.lit(0.0)).otherwise(dist_to_path(x, y, ring))


def dist_to_area_in_box(x: Column, y: Column, ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """``dist_to_area`` of a ring whose box is known: of a rectangle it is the distance to the box."""
    out = lambda v, a, b: F.greatest(a - v, v - b, F.lit(0.0))
    dx, dy = out(x, minx, maxx), out(y, miny, maxy)
    return F.when(is_rect(ring), F.sqrt(dx * dx + dy * dy)).otherwise(dist_to_area(x, y, ring))


def project_along(x: Column, y: Column, path: Column) -> Column:
    """Distance from the path start to the foot of the nearest point; the earliest segment wins ties."""
    acc0 = F.struct(F.lit(float("inf")).alias("best"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("run"))

    def step(acc, s):
        seg_len = length_between(s.x0, s.y0, s.x1, s.y1)
        t = segment_param(x, y, s.x0, s.y0, s.x1, s.y1)
        d2 = point_segment_dist2(x, y, s.x0, s.y0, s.x1, s.y1)
        return F.struct(
            F.least(acc.best, d2).alias("best"),
            F.when(d2 < acc.best, acc.run + t * seg_len).otherwise(acc.pos).alias("pos"),
            (acc.run + seg_len).alias("run"),
        )

    first, second = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    ends = Ends(first.x, first.y, second.x, second.y)
    one = F.when(point_segment_dist2(x, y, *ends) < float("inf"), segment_param(x, y, *ends) * length_between(*ends)).otherwise(F.lit(0.0))
    return F.when(F.size(path) == 2, one).otherwise(F.aggregate(segments(path), acc0, step, lambda acc: acc.pos))


def interpolate(path: Column, d: Column) -> Column:
    """Point at distance ``d`` from the start, clamped to the last vertex."""
    first = F.get(path, F.lit(0))
    acc0 = F.struct(F.lit(0.0).alias("run"), first.x.alias("x"), first.y.alias("y"), F.lit(False).alias("done"))

    def step(acc, s):
        seg_len = length_between(s.x0, s.y0, s.x1, s.y1)
        here = d <= acc.run + seg_len
        t = F.when(seg_len > 0, clamp01((d - acc.run) / seg_len)).otherwise(F.lit(0.0))
        return F.struct(
            (acc.run + seg_len).alias("run"),
            F.when(acc.done, acc.x).when(here, s.x0 + t * (s.x1 - s.x0)).otherwise(s.x1).alias("x"),
            F.when(acc.done, acc.y).when(here, s.y0 + t * (s.y1 - s.y0)).otherwise(s.y1).alias("y"),
            (acc.done | here).alias("done"),
        )

    return F.aggregate(segments(path), acc0, step, lambda acc: point(acc.x, acc.y))


def segment_crossing(a: Column, b: Column) -> Column:
    """Single intersection point of two segments, null when parallel or apart."""
    adx, ady, bdx, bdy = a.x1 - a.x0, a.y1 - a.y0, b.x1 - b.x0, b.y1 - b.y0
    det = adx * bdy - ady * bdx
    s = ((b.x0 - a.x0) * bdy - (b.y0 - a.y0) * bdx) / det
    u = ((b.x0 - a.x0) * ady - (b.y0 - a.y0) * adx) / det
    return F.when(
        det != 0,
        F.when((s >= 0) & (s <= 1) & (u >= 0) & (u <= 1), point(a.x0 + s * adx, a.y0 + s * ady)),
    )


def segment_crossing_steps(a: Column, b: Column) -> list[dict[str, Column]]:
    """``segment_crossing`` in steps for ``fenced``, each small enough to be compiled: _det, then _s and _u (null when parallel),
    and where both are from 0 to 1 the point x, y."""
    adx, ady, bdx, bdy = a.x1 - a.x0, a.y1 - a.y0, b.x1 - b.x0, b.y1 - b.y0
    det = adx * bdy - ady * bdx
    s = ((b.x0 - a.x0) * bdy - (b.y0 - a.y0) * bdx) / F.col("_det")
    u = ((b.x0 - a.x0) * ady - (b.y0 - a.y0) * adx) / F.col("_det")
    return [{"_det": F.when(det != 0, det)}, {"_s": s, "_u": u}, {"x": a.x0 + F.col("_s") * adx, "y": a.y0 + F.col("_s") * ady}]


def _side(px, py, s) -> Column:
    return F.signum((s.x1 - s.x0) * (py - s.y0) - (s.y1 - s.y0) * (px - s.x0))


def segments_touch(a: Column, b: Column) -> Column:
    """Closed test: crossing, touching and collinear overlap all count."""
    boxes = (
        (F.greatest(F.least(a.x0, a.x1), F.least(b.x0, b.x1)) <= F.least(F.greatest(a.x0, a.x1), F.greatest(b.x0, b.x1)))
        & (F.greatest(F.least(a.y0, a.y1), F.least(b.y0, b.y1)) <= F.least(F.greatest(a.y0, a.y1), F.greatest(b.y0, b.y1)))
    )
    return (
        boxes
        & (_side(b.x0, b.y0, a) * _side(b.x1, b.y1, a) <= 0)
        & (_side(a.x0, a.y0, b) * _side(a.x1, a.y1, b) <= 0)
    )


def paths_touch(p: Column, q: Column) -> Column:
    return F.exists(segments(p), lambda a: F.exists(segments(q), lambda b: segments_touch(a, b)))


def _vertex(path: Column, i: int) -> Column:
    return F.get(path, F.lit(i))


def areas_intersect(p: Column, q: Column) -> Column:
    """Two rings share at least one point (touching counts)."""
    return (
        paths_touch(p, q)
        | covers(_vertex(p, 0).x, _vertex(p, 0).y, q)
        | covers(_vertex(q, 0).x, _vertex(q, 0).y, p)
    )


def areas_meet_in_boxes(p: Column, q: Column) -> Column:
    """``areas_intersect`` of two rings whose boxes meet: that is all there is to say of two rectangles."""
    return (is_rect(p) & is_rect(q)) | areas_intersect(p, q)


def path_meets_area(path: Column, ring: Column) -> Column:
    return paths_touch(path, ring) | covers(_vertex(path, 0).x, _vertex(path, 0).y, ring)


def ring_within(p: Column, q: Column) -> Column:
    """Every vertex of ``p`` is in ``q`` (closed) and no edge properly crosses an edge of ``q``."""
    proper = lambda a, b: (
        (_side(b.x0, b.y0, a) * _side(b.x1, b.y1, a) < 0) & (_side(a.x0, a.y0, b) * _side(a.x1, a.y1, b) < 0)
    )
    crossing = F.exists(segments(p), lambda a: F.exists(segments(q), lambda b: proper(a, b)))
    return F.forall(p, lambda v: covers(v.x, v.y, q)) & ~crossing


def path_path_dist(p: Column, q: Column) -> Column:
    d2 = lambda v, s: point_segment_dist2(v.x, v.y, s.x0, s.y0, s.x1, s.y1)
    pq = F.array_min(F.flatten(F.transform(p, lambda v: F.transform(segments(q), lambda s: d2(v, s)))))
    qp = F.array_min(F.flatten(F.transform(q, lambda v: F.transform(segments(p), lambda s: d2(v, s)))))
    return F.when(paths_touch(p, q), F.lit(0.0)).otherwise(F.sqrt(F.least(pq, qp)))


def path_area_dist(path: Column, ring: Column) -> Column:
    return F.when(path_meets_area(path, ring), F.lit(0.0)).otherwise(path_path_dist(path, ring))


def segment_box_dist2(s, minx: Column, miny: Column, maxx: Column, maxy: Column) -> list[dict[str, Column]]:
    """Steps, one after the other for ``fenced``, that end in ``_d2``: the squared ``path_area_dist`` of a segment and a rectangle.

    They meet where their boxes do and the corners are not all to one side of the segment; else a corner or an end is nearest.
    """
    at = {f"_k{i}{j}": (x, y) for i, x in enumerate((minx, maxx)) for j, y in enumerate((miny, maxy))}
    side = lambda x, y: (s.x1 - s.x0) * (y - s.y0) - (s.y1 - s.y0) * (x - s.x0)
    out = lambda v, a, b: F.greatest(a - v, v - b, F.lit(0.0))
    end = lambda x, y: out(x, minx, maxx) * out(x, minx, maxx) + out(y, miny, maxy) * out(y, miny, maxy)
    sides = [side(*xy) for xy in at.values()]
    boxes = (F.least(s.x0, s.x1) <= maxx) & (F.greatest(s.x0, s.x1) >= minx) & (F.least(s.y0, s.y1) <= maxy) & (F.greatest(s.y0, s.y1) >= miny)
    # one at a time: generated methods over 8000 bytes of code are not compiled
    steps = [{k: point_segment_dist2(x, y, s.x0, s.y0, s.x1, s.y1)} for k, (x, y) in at.items()]
    steps.append({"_ends": F.least(end(s.x0, s.y0), end(s.x1, s.y1))})
    steps.append({"_met": boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)})
    return [*steps, {"_d2": F.when(F.col("_met"), F.lit(0.0)).otherwise(F.least(*at, "_ends"))}]


def nearest_pair(p: Column, q: Column) -> Column:
    """Nearest points of two paths that do not cross: struct(d2, ax, ay, bx, by), a on p and b on q."""

    def foot(v, s, swap):
        t = segment_param(v.x, v.y, s.x0, s.y0, s.x1, s.y1)
        fx, fy = s.x0 + t * (s.x1 - s.x0), s.y0 + t * (s.y1 - s.y0)
        d2 = (fx - v.x) * (fx - v.x) + (fy - v.y) * (fy - v.y)
        ends = (fx, fy, v.x, v.y) if swap else (v.x, v.y, fx, fy)
        return F.struct(d2.alias("d2"), *[c.alias(n) for c, n in zip(ends, ("ax", "ay", "bx", "by"))])

    from_p = F.flatten(F.transform(p, lambda v: F.transform(segments(q), lambda s: foot(v, s, False))))
    from_q = F.flatten(F.transform(q, lambda v: F.transform(segments(p), lambda s: foot(v, s, True))))
    return F.array_min(F.concat(from_p, from_q))


def with_holes(outer: Column, holes: Column) -> Column:
    """One ring for an outline and its holes: holes run the other way round and hang on the first corner.

    The links to a hole are walked twice in opposite directions, so even-odd tests, signed areas and
    overlaps of the ring are those of the area without its holes. Links count as outline in distance
    and boundary tests: a point exactly on one is covered, not contained.
    """
    turn = lambda r, sign: F.when(signed_area(r) * sign < 0, F.reverse(r)).otherwise(r)
    first = F.slice(outer, 1, 1)
    return F.concat(turn(outer, 1), F.flatten(F.transform(holes, lambda h: F.concat(turn(h, -1), first))))


def translate(path: Column, dx: Column, dy: Column) -> Column:
    return F.transform(path, lambda p: point(p.x + dx, p.y + dy))


def rotate_translate(path: Column, deg: Column, dx: Column, dy: Column) -> Column:
    """Rotate about the origin, then move (building placement)."""
    c, s = F.cos(F.radians(deg)), F.sin(F.radians(deg))
    return F.transform(path, lambda p: point(p.x * c - p.y * s + dx, p.x * s + p.y * c + dy))


def repair_ring(ring: Column, min_area: float = rules.MIN_FOOTPRINT_AREA_M2, tol: float = 1e-9) -> Column:
    """Drop repeated vertices, close, orient counter-clockwise; null when fewer than 3 corners or too small."""

    def keep_new(acc, p):
        last = F.element_at(acc, F.lit(-1))
        fresh = (F.size(acc) == 0) | (F.abs(last.x - p.x) > tol) | (F.abs(last.y - p.y) > tol)
        return F.when(fresh, F.concat(acc, F.array(point(p.x, p.y)))).otherwise(acc)

    head = F.array(point(F.get(ring, F.lit(0)).x, F.get(ring, F.lit(0)).y))
    deduped = F.aggregate(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), head, keep_new)

    def checked(r):
        a = signed_area(r)
        return F.when((F.size(r) >= 4) & (F.abs(a) >= min_area), F.when(a < 0, F.reverse(r)).otherwise(r))

    return let(deduped, checked)


def self_crossing(ring: Column) -> Column:
    """True when two non-neighbouring edges of the ring properly cross."""
    segs = segments(ring)
    proper = lambda a, b: (
        (_side(b.x0, b.y0, a) * _side(b.x1, b.y1, a) < 0) & (_side(a.x0, a.y0, b) * _side(a.x1, a.y1, b) < 0)
    )
    return F.exists(segs, lambda a: F.exists(segs, lambda b: proper(a, b)))


def chaikin(path: Column, closed: bool, rounds: int = 2) -> Column:
    """Corner cutting; a closed ring stays closed, an open line keeps both ends."""

    def cut(segs):
        pair = lambda s: F.array(
            point(0.75 * s.x0 + 0.25 * s.x1, 0.75 * s.y0 + 0.25 * s.y1),
            point(0.25 * s.x0 + 0.75 * s.x1, 0.25 * s.y0 + 0.75 * s.y1),
        )
        return F.flatten(F.transform(segs, pair))

    def one_round(p):
        if closed:
            return let(cut(segments(p)), lambda c: F.concat(c, F.slice(c, F.lit(1), F.lit(1))))
        return F.concat(F.slice(p, F.lit(1), F.lit(1)), cut(segments(p)), F.slice(p, F.lit(-1), F.lit(1)))

    out = path
    for _ in range(rounds):
        out = let(out, one_round)
    enough = F.size(path) >= (4 if closed else 3)
    return F.when(enough, out).otherwise(path)


def clip_segment_to_circle(x0, y0, x1, y1, cx, cy, r) -> Column:
    """Part of a segment inside a circle: struct(x0, y0, x1, y1) or null."""
    dx, dy, fx, fy = x1 - x0, y1 - y0, x0 - cx, y0 - cy
    a = dx * dx + dy * dy
    b = 2.0 * (fx * dx + fy * dy)
    c = fx * fx + fy * fy - r * r
    disc = b * b - 4.0 * a * c
    root = F.sqrt(disc)
    t0 = F.greatest(F.lit(0.0), (-b - root) / (2.0 * a))
    t1 = F.least(F.lit(1.0), (-b + root) / (2.0 * a))
    part = F.struct(
        (x0 + t0 * dx).alias("x0"), (y0 + t0 * dy).alias("y0"),
        (x0 + t1 * dx).alias("x1"), (y0 + t1 * dy).alias("y1"),
    )
    return F.when((a > 0) & (disc >= 0), F.when(t0 < t1, part))
