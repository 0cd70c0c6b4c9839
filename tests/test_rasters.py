"""Exact distances to the other side of a mask, against all pairs of cells."""

import math
import random

from sitewright.functions.rasters import lower_envelope
from sitewright.operators.relief import other_side


def test_lower_envelope_against_all_parabolas():
    rng = random.Random(1)
    for _ in range(500):
        cols = sorted(rng.sample(range(-40, 60), rng.randint(1, 40)))
        heights = [rng.choice([None, 0, rng.randint(0, 30) ** 2]) for _ in cols]
        want = [min(((c - k) ** 2 + h for k, h in zip(cols, heights) if h is not None), default=None) for c in cols]
        assert lower_envelope(cols, heights) == want


def test_other_side_of_windows(spark):
    rng, cells = random.Random(2), []
    for pad, (rows, cols, share) in enumerate([(9, 14, 0.5), (12, 5, 0.05), (6, 6, 0.0), (7, 9, 1.0), (1, 12, 0.3)]):
        cells += [(pad, r + 5, c - 3, rng.random() < share) for r in range(rows) for c in range(cols)]
    df = spark.createDataFrame(cells, "k int, r long, c long, _in boolean").repartition(4)
    got = {(x["k"], x["r"], x["c"]): x["_d2"] for x in other_side(df, "k").collect()}
    for k, r, c, i in cells:
        assert got[k, r, c] == min(((r - a) ** 2 + (c - b) ** 2 for p, a, b, j in cells if p == k and j != i), default=None)
    assert len(got) == len(cells)


def test_distance_plan_has_no_offset_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, True)], "k int, r long, c long, _in boolean")
    plan = other_side(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Cartesian" not in plan


def test_three_overlapping_sources_against_cell_by_cell_fold(spark):
    import math

    from sitewright.operators.relief import merge_sources

    rng, px, width = random.Random(5), 10.0, 60.0
    masks = [lambda r, c: c < 30, lambda r, c: 10 < c < 36 and r > 8, lambda r, c: (r - 20) ** 2 + (c - 20) ** 2 < 120 or r == 39]
    grids = [{(r, c): float(rng.randint(0, 99)) if m(r, c) and rng.random() < 0.97 else None for r in range(-3, 40) for c in range(40)} for m in masks]
    want = dict(grids[0])
    for g in grids[1:]:
        for (r, c), new in g.items():
            other = [(r - a) ** 2 + (c - b) ** 2 for a in range(r - 4, r + 5) for b in range(c - 4, c + 5) if (a, b) in g and (g[a, b] is None) == (new is not None)]
            d = math.sqrt(min(other)) * px if other else width
            a = min(1.0, max(0.0, ((d if new is not None else -d) + width / 2) / width))
            old = want[r, c]
            want[r, c] = a * new + (1 - a) * old if new is not None and old is not None else old if old is not None else new
    dfs = [spark.createDataFrame([(1, r, c, z) for (r, c), z in g.items()], "source_id int, r int, c int, z double").repartition(3) for g in grids]
    got = {(x["r"], x["c"]): x["z"] for x in merge_sources(dfs, px, width, block=16).collect()}
    assert got.keys() == want.keys()
    for k, z in want.items():
        assert (got[k] is None) == (z is None) and (z is None or abs(got[k] - z) < 1e-9)
    plan = lambda n: merge_sources([dfs[0]] * n, px, width)._jdf.queryExecution().executedPlan().toString()
    assert plan(5).count("Exchange hashpartitioning(source_id") == plan(2).count("Exchange hashpartitioning(source_id") == 1


def _holed(rng, sources=2, rows=23, cols=17):
    """Heights of two sources with holes, whole rows and whole corners missing."""
    return {
        (s, r, c): float(rng.randint(0, 99)) for s in range(sources) for r in range(rows) for c in range(cols)
        if rng.random() < 0.85 and r != 7 * (s + 1) and not (r < 6 and c > 10)
    }


def test_bilinear_heights_against_cells(spark):
    from pyspark.sql import functions as F

    from sitewright.operators.relief import sample

    rng = random.Random(11)
    z = _holed(rng)
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()] + [(0, 1, 1, None), (1, 2, 2, -500.0), (1, 2, 2, None)], "source_id int, r int, c int, z double").repartition(5)
    z.pop((0, 1, 1), None)
    z.setdefault((1, 2, 2), -500.0)  # repeated cells: the highest counts
    cells = cells.where("not (source_id = 0 and r = 1 and c = 1)")
    grid = spark.createDataFrame([(0, 100.0, 50.0, 2.0, 17, 23), (1, 0.0, 0.0, 1.0, 17, 23)], "source_id int, x0 double, y0 double, px double, width long, height long")
    pts, want = [], {}
    for i in range(900):
        s = rng.choice([0, 1, 2])
        x0, y0, px = {0: (100.0, 50.0, 2.0), 1: (0.0, 0.0, 1.0), 2: (0.0, 0.0, 1.0)}[s]
        rf, cf = rng.choice([rng.uniform(-1, 23), float(rng.randint(0, 22))]), rng.choice([rng.uniform(-1, 17), float(rng.randint(0, 16)), 16.0])
        pts.append((i, s, x0 + (cf + 0.5) * px, y0 - (rf + 0.5) * px, "kept"))
        r, c = math.floor(rf), math.floor(cf)
        near = [z.get((s, min(r + a, 22), min(c + b, 16))) for a in (0, 1) for b in (0, 1)]
        if s == 2 or not (0 <= rf <= 22 and 0 <= cf <= 16) or None in near:
            want[i] = None
        else:
            fr, fc = rf - r, cf - c
            want[i] = (near[0] * (1 - fc) + near[1] * fc) * (1 - fr) + (near[2] * (1 - fc) + near[3] * fc) * fr
    pts += [(900, 0, None, 3.0, "kept"), (900, 0, None, 3.0, "kept")]
    points = spark.createDataFrame(pts, "id int, source_id int, x double, y double, note string").repartition(4)
    got = sample(points, cells, grid, ["id"]).collect()
    assert len(got) == len(pts) - 1 and {x["note"] for x in got} == {"kept"}  # repeated points are one
    for x in got:
        w = want.get(x["id"])
        assert (x["z"] is None and w is None) or (x["z"] is not None and w is not None and abs(x["z"] - w) < 1e-6), (x, w)
    assert sample(points.limit(0), cells, grid, ["id"]).count() == 0 and sample(points, cells.limit(0), grid, ["id"]).where(F.col("z").isNotNull()).count() == 0


def test_faces_and_surface_numbers(spark):
    from sitewright.operators.exports import numbered_surface
    from sitewright.operators.relief import faces

    z = {(s, r - 9, c - 5): v for (s, r, c), v in _holed(random.Random(12)).items()}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()] + [(0, 40, 40, None)], "source_id int, r int, c int, z double").repartition(5)
    want = set()
    for s, r, c in z:
        k = [(s, r + a, c + b) for a in (0, 1) for b in (0, 1)]
        if all(x in z for x in k):
            want |= {(s, r, c, h, *(y for i in t for y in (k[i][1], k[i][2], z[k[i]]))) for h, t in ((0, (0, 2, 1)), (1, (1, 2, 3)))}
    got = faces(cells).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    points, numbers = numbered_surface(cells)
    at = {(x["source_id"], x["id"]): (x["r"], x["c"]) for x in points.collect()}
    assert len(at) == len(z)
    named = {(x["source_id"], *(v for n in ("a", "b", "d") for v in at[x["source_id"], x[n]])) for x in numbers.collect()}
    assert named == {(w[0], w[4], w[5], w[7], w[8], w[10], w[11]) for w in want}
    plan = faces(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 1 and "Join" not in plan
