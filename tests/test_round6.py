"""Access roads where roads lie dense, bridges over many axes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom
from sitewright.operators import lines, siting, spatial

PATH = "array<struct<x: double, y: double>>"


def test_least_road_of_a_site_among_many(spark):
    rnd = random.Random(4)
    u = lambda: float(rnd.randint(-300, 300))
    rect = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    hook = lambda x, y: [(x, y), (x + 90, y), (x + 90, y + 90), (x + 80, y + 90), (x + 80, y + 10), (x, y + 10), (x, y)]
    sites = [(i % 2, i, rect(u(), u(), 40.0 + i, 90.0 - i) if i % 3 else hook(u(), u())) for i in range(60)]
    sites += [(1, 3, rect(200.0, 200.0, 50.0, 50.0)), (1, None, rect(0.0, 0.0, 9.0, 9.0)), (None, 70, rect(0.0, 0.0, 9.0, 9.0)), (0, 71, None), (2, 72, rect(0.0, 0.0, 9.0, 9.0)), (0, 73, rect(900.0, 900.0, 3.0, 3.0))]
    roads = [(k % 2, k // 2, [(u(), u()) for _ in range(2 + k % 3)], rules.NETWORK_BACKBONE if k % 5 else "other") for k in range(240)]
    roads += [(0, 500, [(-30_000.0, 40.0), (30_000.0, 41.0)], "other"), (1, -1, [(5.0, 5.0), (5.0, 5.0)], "other"), (1, 600, [], "other"), (0, -7, [(80.0, 80.0)], "other"), (1, -2, [(-30_000.0, 4.0), (30_000.0, 41.0)], "other")]
    roads += [(0, 0, [(0.0, 0.0), (40.0, 3.0)], "a"), (0, 0, [(0.0, 0.0), (40.0, 3.0)], "a")]
    s = spark.createDataFrame(sites, f"town int, site_id int, ring {PATH}").repartition(3)
    r = spark.createDataFrame(roads, f"town int, road_id int, path {PATH}, network string").repartition(3)
    o = spark.createDataFrame([(rect(0.0, 0.0, 5.0, 5.0),)], f"oring {PATH}")
    got = siting.access_roads(s, r, o, "site_id", "road_id", by=["town"]).collect()
    # every road beside every site
    segment = lambda e: F.array(geom.point(e.x0, e.y0), geom.point(e.x1, e.y1))
    every = s.join(r, "town").select("town", "site_id", "ring", "road_id", "path", "network", F.explode(geom.segments(F.col("path"))).alias("e"))
    every = every.select("site_id", "road_id", "path", "network", geom.path_area_dist(segment(F.col("e")), F.col("ring")).alias("d")).where("site_id IS NOT NULL AND d IS NOT NULL").collect()
    best = {}
    for e in every:
        best[e.site_id] = min(best.get(e.site_id, (9e9,)), (e.d, e.road_id, e.path, e.network))
    assert len(got) == len(sites) + 2  # the rows of the repeated id meet each other
    for row in got:
        d, road, _, network = best.get(row.site_id, (None,) * 4)
        assert (row.road_id, row.network, row.distance_m) == (road, network, d), row
    assert sum(b[0] == 0 for b in best.values()) > 50 and best[73][0] > 0


def test_few_of_the_roads_over_a_site_are_tested(spark, monkeypatch):
    rnd = random.Random(5)
    u = lambda: rnd.uniform(0.0, 200.0)
    roads = [(1, k, [(u(), u()), (u(), u())]) for k in range(2000)]
    square = [(50.0, 50.0), (150.0, 50.0), (150.0, 150.0), (50.0, 150.0), (50.0, 50.0)]
    tested, fenced = [], geom.fenced

    def counted(df, **columns):
        if "_told" in columns:
            tested.append(df.count())
        return fenced(df, **columns)

    monkeypatch.setattr(geom, "fenced", counted)
    s, r = spark.createDataFrame([(1, 9, square)], f"town int, sid int, ring {PATH}"), spark.createDataFrame(roads, f"town int, rid int, path {PATH}")
    got = spatial.first_met(s, r, area_id=["sid"], by=["town"], ring="ring", path="path", order=F.col("rid"), cell=100.0).collect()
    assert len(got) == 1 and got[0]["_first"].ord < 20 and len(tested) == 1 and tested[0] < 100


def test_bridge_clearance_is_the_least_over_all_crossings(spark):
    rnd = random.Random(6)
    u = lambda: rnd.uniform(-20.0, 120.0)
    heights = {(r, c): rnd.uniform(0.0, 9.0) for r in range(10) for c in range(12) if (r, c) != (4, 5)}
    bridges = [(i, [(u(), u()) for _ in range(2 + (i % 4 == 0))]) for i in range(12)] + [(12, [(5.0, 5.0), (5.0, 5.0)]), (13, [(30.0, 30.0), (75.0, 30.0)])]
    axes = [(k, "road" if k % 3 else "rail", [(u(), u()), (u(), u())]) for k in range(150)]
    b = spark.createDataFrame(bridges, f"bid int, path {PATH}").withColumn("source_id", F.lit(0).cast("bigint"))
    o = spark.createDataFrame(axes, f"oid int, kind string, path {PATH}").withColumn("source_id", F.lit(0).cast("bigint"))
    cells = spark.createDataFrame([(0, r, c, z) for (r, c), z in heights.items()], "source_id long, r int, c int, z double")
    grid = spark.createDataFrame([(0, 0.0, 100.0, 10.0, 12, 10)], "source_id long, x0 double, y0 double, px double, width long, height long")
    got = {r.bid: r for r in lines.bridge_clearance(b, o, cells, grid, "bid", "oid").collect()}

    def ground(x, y):
        c, r = x / 10 - 0.5, (100 - y) / 10 - 0.5
        if c < 0 or r < 0 or c > 11 or r > 9:
            return None
        i, j = int(c), int(r)
        z = [heights.get((p, q)) for p in (j, min(j + 1, 9)) for q in (i, min(i + 1, 11))]
        if None in z:
            return None
        return (z[0] * (1 - c + i) + z[1] * (c - i)) * (1 - r + j) + (z[2] * (1 - c + i) + z[3] * (c - i)) * (r - j)

    found = 0
    for bid, path in bridges:
        parts = [(math.dist(p, q), p, q) for p, q in zip(path, path[1:])]
        total, run, least = sum(d for d, _, _ in parts), 0.0, {}
        z0, z1 = (ground(*v) or 0.0 for v in (path[0], path[-1]))
        for d, (px, py), (qx, qy) in parts:
            for _, kind, ((ax, ay), (bx, by)) in axes:
                det = (qx - px) * (by - ay) - (qy - py) * (bx - ax)
                if det:
                    s, w = ((ax - px) * (by - ay) - (ay - py) * (bx - ax)) / det, ((ax - px) * (qy - py) - (ay - py) * (qx - px)) / det
                    z = ground(px + s * (qx - px), py + s * (qy - py))
                    if 0 <= s <= 1 and 0 <= w <= 1 and z is not None:
                        least[kind] = min(least.get(kind, 9e9), z0 + (z1 - z0) * (run + s * d) / total - z)
            run += d
        lift = max(5 - least.get("road", 9e9), 6 - least.get("rail", 9e9), 0)
        found += len(least)
        assert got[bid].lift_m == pytest.approx(lift, abs=1e-6), bid
        assert (got[bid].clearance_m is None) if not least else got[bid].clearance_m == pytest.approx(min(least.values()) + lift, abs=1e-6)
    assert len(got) == len(bridges) and found > 15
