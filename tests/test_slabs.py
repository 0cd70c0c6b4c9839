"""Slab areas and clipping with parts, against closed forms, turned copies and point counts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sitewright.functions import geom, kernels, slabs


def turned(pts, a, dx=0.0, dy=0.0):
    return [(x * math.cos(a) - y * math.sin(a) + dx, x * math.sin(a) + y * math.cos(a) + dy) for x, y in pts]


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


ANGLES = [0.0, 0.3, math.pi / 4, 1.1, math.pi / 2]
ELL = [(0, 0), (20, 0), (20, 12), (12, 12), (12, 20), (0, 20)]
STAR = [((10 if k % 2 else 4) * math.cos(k * math.pi / 5), (10 if k % 2 else 4) * math.sin(k * math.pi / 5)) for k in range(10)]


def test_setback_of_rectangles_and_concave_outlines_is_exact():
    for a in ANGLES:
        assert abs(slabs.free_area(turned(rect(0, 0, 30, 20), a, 1000, 2000), 3.0, []) - 24 * 14) < 1e-6
        # the inner corner of an L is rounded by a quarter circle
        s, b = 2.0, 8.0
        want = (20 - 2 * s) ** 2 - (b**2 - s**2 * (1 - math.pi / 4))
        assert abs(slabs.free_area(turned(ELL, a, -500, 70), s, []) - want) < 1e-6
    assert slabs.free_area(rect(0, 0, 4, 4), 2.5, []) == 0.0
    assert abs(slabs.free_area(ELL, 0.0, []) - 336) < 1e-9


def counted(site, setback, zones, step=0.02):
    pts = np.array(site)
    xs, ys = (np.arange(pts[:, k].min() + step / 2, pts[:, k].max(), step) for k in (0, 1))
    x, y = (v.ravel() for v in np.meshgrid(xs, ys))

    def inside(ring):
        odd = np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
        return odd

    keep = inside(site)
    for (ax, ay), (bx, by) in zip(site, site[1:] + site[:1]):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        keep &= np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) >= setback
    for z in zones:
        keep &= ~inside(z)
    return keep.sum() * step * step


ZONES = [rect(2, 2, 9, 9), turned(rect(0, 0, 9, 5), 0.5, 6, 4), turned(STAR, 0.2, 14, 6)]


def test_three_overlapping_zones_against_point_counts():
    for site, setback in ((ELL, 1.5), (turned(STAR, 0.1, 8, 8), 0.7), (rect(0, 0, 18, 15), 2.0)):
        exact = slabs.free_area(site, setback, ZONES)
        assert abs(exact - counted(site, setback, ZONES)) < 0.15
        for a in ANGLES[1:]:  # and the same to 1e-6 however all is turned
            assert abs(slabs.free_area(turned(site, a), setback, [turned(z, a) for z in ZONES]) - exact) < 1e-6


def test_overlap_equals_triangle_pairs():
    rng = random.Random(3)
    for _ in range(150):
        def blob(n):
            cx, cy = rng.uniform(-5, 5), rng.uniform(-5, 5)
            return [(cx + (r := rng.uniform(2, 9)) * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]

        p, q = blob(rng.randint(3, 12)), blob(rng.randint(3, 12))
        assert abs(slabs.overlap_area(p, q) - kernels.overlap_area(p, q)) < 1e-6
    assert abs(slabs.overlap_area(rect(0, 0, 4, 4), rect(0, 0, 4, 4)) - 16) < 1e-9 and slabs.overlap_area(rect(0, 0, 1, 1), rect(1, 0, 2, 1)) == 0.0


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def test_clip_gives_every_part():
    c = slabs.circle(0, 0, 10)
    u = [(-6, -2), (6, -2), (6, 20), (3, 20), (3, 12), (-3, 12), (-3, 20), (-6, 20)]
    legs = [(x, y - 14) for x, y in [(-6, 20), (-6, 0), (-3, 0), (-3, 30), (3, 30), (3, 0), (6, 0), (6, 40), (-6, 40)]]  # joined outside the circle only
    assert len(slabs.clip_parts(u, c)) == 1 and len(slabs.clip_parts(legs, c)) == 2
    assert len(slabs.clip_parts(legs[::-1], c)) == 2
    rng = random.Random(8)
    for trial in range(200):
        n = rng.randint(3, 14)
        cx, cy = rng.uniform(-9, 9), rng.uniform(-9, 9)
        p = [(cx + (r := rng.uniform(1, 16)) * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
        parts = slabs.clip_parts(p, c)
        assert abs(sum(map(area, parts)) - slabs.overlap_area(p, c)) < 1e-6, trial
        assert all(area(x) > -1e-9 for x in parts)
    assert slabs.clip_parts(rect(-50, -50, 50, 50), c) == [c] and slabs.clip_parts(rect(30, 30, 40, 40), c) == []
    assert slabs.clip_parts(rect(-1, -1, 1, 1), c) == [rect(-1, -1, 1, 1)]
    begins_inside = [(0, 0), (30, -3), (30, 3)]
    assert len(slabs.clip_parts(begins_inside, c)) == 1 and abs(area(slabs.clip_parts(begins_inside, c)[0]) - slabs.overlap_area(begins_inside, c)) < 1e-9


def test_udfs(spark):
    ring = lambda pts: F.array(*[geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts + pts[:1]])
    df = spark.range(1).select(ring(ELL).alias("r"), F.array(ring(ZONES[0]), ring(ZONES[1])).alias("z"))
    r = df.select(
        slabs.free_area_udf("r", F.lit(1.0), "z").alias("a"), slabs.free_area_udf("r", F.lit(1.0), F.lit(None).cast(df.schema["z"].dataType)).alias("b"),
        slabs.free_area_udf("r", F.lit(None).cast("double"), "z").alias("c"), F.size(slabs.circle_parts_udf("r", F.lit(0.0), F.lit(0.0), F.lit(5.0))).alias("n"),
        F.size(slabs.circle_parts_udf("r", F.lit(99.0), F.lit(0.0), F.lit(5.0))).alias("none"),
    ).first()
    assert abs(r["a"] - slabs.free_area(ELL, 1.0, ZONES[:2])) < 1e-9 and abs(r["b"] - slabs.free_area(ELL, 1.0, [])) < 1e-9
    assert r["c"] is None and (r["n"], r["none"]) == (1, 0)


def test_loops_of_crossing_outlines():
    loops = lambda p: sorted((round(abs(area(r)), 6), w) for r, w in kernels.loops(p))
    assert loops(rect(0, 0, 2, 3)) == [(6.0, 1)] and loops(rect(0, 0, 2, 3)[::-1]) == [(6.0, -1)]
    assert loops([(0, 0), (2, 2), (2, 0), (0, 2)]) == [(1.0, -1), (1.0, 1)]  # bow tie
    double = [(0, 0), (10, 0), (10, 10), (1, 10), (1, 1), (8, 1), (8, 8), (0, 8)]  # round once, then again inside
    found = kernels.loops(double)
    assert sorted(w for _, w in found) == [1, 2] and len(kernels.crossings(double)) == 1
    assert max(found, key=lambda x: abs(area(x[0])))[1] == 1  # the outer one stays, and the inner one is told as wound twice
    touching = [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]  # meets itself in a corner without crossing
    assert kernels.crossings(touching) == [] and len(kernels.loops(touching)) == 1
    assert kernels.loops([(0, 0), (1, 1)]) == [] and kernels.largest_loop([(0, 0), (1, 0)]) is None


def test_loops_keep_the_signed_area_and_do_not_cross():
    rng = random.Random(12)
    for _ in range(150):
        p = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(4, 14))]
        found = kernels.loops(p)
        assert abs(sum(area(r) for r, _ in found) - area(p)) < 1e-6
        pairs = 0
        for i in range(len(p)):
            for j in range(i + 2, len(p) - (i == 0)):
                (a, b), (c, d) = (p[i], p[(i + 1) % len(p)]), (p[j], p[(j + 1) % len(p)])
                side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
                pairs += side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
        assert len(kernels.crossings(p)) == pairs
        # the winding number of a place is the number of loops around it, by direction
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        turns = sum(math.atan2((ax - x) * (by - y) - (ay - y) * (bx - x), (ax - x) * (bx - x) + (ay - y) * (by - y)) for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]))
        assert round(turns / (2 * math.pi)) == sum((1 if area(r) > 0 else -1) for r, _ in found if slabs._holds(r, (x, y)))


def test_many_corners_are_quick():
    import time

    n = 20_000
    ring = [((100 + k % 2) * math.cos(2 * math.pi * k / n), (100 + k % 2) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    began = time.time()
    assert kernels.crossings(ring) == [] and time.time() - began < 30


def test_loops_udf(spark):
    bow = F.array(*[geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]])
    r = spark.range(1).select(kernels.loops_udf(bow).alias("l"), kernels.loops_udf(F.lit(None).cast("array<struct<x: double, y: double>>")).alias("none")).first()
    assert [(x["winding"], x["area_m2"]) for x in r["l"]] in ([(1, 1.0), (-1, 1.0)], [(-1, 1.0), (1, 1.0)]) and r["none"] == []


def test_common_area_of_rectangles_and_others(spark):
    from sitewright.operators.siting import with_common_area

    shapes = [rect(0, 0, 4, 3), rect(2, 1, 9, 9)[::-1], [(1, 1), (1, 5), (5, 5), (5, 1)], ELL, turned(rect(0, 0, 4, 4), 0.4), rect(4, 0, 6, 3), [(0, 0), (4, 0), (4, 4), (2, 4)]]
    rows = [(i, j, [*a, a[0]], [*b, b[0]]) for i, a in enumerate(shapes) for j, b in enumerate(shapes)] + [(-1, 0, None, [*shapes[0], shapes[0][0]])]
    ring = "array<struct<x: double, y: double>>"
    rows = [(i, j, *[None if r is None else [(float(x), float(y)) for x, y in r] for r in (a, b)]) for i, j, a, b in rows]
    df = spark.createDataFrame(rows, f"i int, j int, p {ring}, q {ring}")
    for r in with_common_area(df, "p", "q", "m2").collect():
        if r["i"] < 0:
            assert r["m2"] is None
        else:
            assert abs(r["m2"] - slabs.overlap_area(shapes[r["i"]], shapes[r["j"]])) < 1e-6
    got = {r["i"]: r["k"] for r in df.where("j = 0").select("i", geom.is_rect(F.col("p")).alias("k")).collect()}
    assert got == {-1: False, 0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_clip_of_outlines_with_linked_holes():
    rng = random.Random(21)
    c = slabs.circle(0, 0, 10)
    for trial in range(120):
        a = rng.uniform(0, 2 * math.pi)
        x, y = rng.uniform(-8, 8), rng.uniform(-8, 8)
        # a square with a square hole, the link between them walked both ways
        linked = turned([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9), (-4, -3), (-4, 3), (3, 3), (3, -3), (-4, -3)], a, x, y)
        parts = slabs.clip_parts(linked, c)
        assert abs(sum(map(area, parts)) - slabs.overlap_area(linked, c)) < 1e-5, trial
