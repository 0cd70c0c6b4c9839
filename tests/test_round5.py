"""Near pairs and scattered points where very much lies on one spot: equal results, few candidates."""

import math
import random

from pyspark.sql import functions as F

from sitewright.functions import geom
from sitewright.operators import audit, lines, spatial

PATH = "array<struct<x:double,y:double>>"


def dist(px, py, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / n)) if n else 0.0
    return math.hypot(x0 + t * dx - px, y0 + t * dy - py)


def path_dist(x, y, path):
    ends = list(zip(path, path[1:])) or [(path[0], path[0])]
    return min(dist(x, y, *a, *b) for a, b in ends)


def test_cut_segments_give_the_nearest_path_from_few_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    u = lambda: rnd.uniform(-150.0, 150.0)
    paths = [(i, [(u(), u()), (u(), u())] if i % 5 else [(u(), u()), (u(), u()), (u(), u())]) for i in range(150)]
    points = [(i, u() * (40 if i < 2 else 1), u()) for i in range(200)]
    p = spark.createDataFrame(paths, f"pid int, path {PATH}").withColumn("site", F.lit(0))
    q = spark.createDataFrame(points, "qid int, x double, y double").select("qid", F.lit(0).alias("site"), F.array(geom.point(F.col("x"), F.col("y"))).alias("qp"))
    met, pairs = [], spatial.box_pairs

    def counted(*a, **k):
        out = pairs(*a, **k)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "box_pairs", counted)
    how = dict(query_id=["qid"], by=["site"], query_path="qp", path="path", path_order=F.col("pid"), carry=[], distance=lambda a, b: geom.dist_to_path(a[0].x, a[0].y, b))
    got = {r.qid: (r.nearest.hit.ord, r.nearest.dist) for r in spatial.nearest_path(q, p, pieces=32, **how).collect()}
    assert len(got) == len(points)
    for qid, x, y in points:
        best = min((path_dist(x, y, path), i) for i, path in paths)
        assert got[qid][0] == best[1] and abs(got[qid][1] - best[0]) < 1e-9
    spatial.nearest_path(q, p, **how).collect()
    assert met[0] * 2 < met[1]


def test_poles_meet_lines_in_the_cells_along_them(spark):
    rnd = random.Random(7)
    u = lambda: rnd.uniform(-400.0, 400.0)
    paths = [(i, [(u(), u()) for _ in range(1 + i % 4)]) for i in range(40)]
    paths += [(40, [(0.0, -300.0), (0.0, 300.0)]), (41, [(-300.0, 8.0), (300.0, 8.0)]), (42, [(-9e6, -9e6), (9e6, 9e6)]), (43, [(5.0, 5.0), (5.0, 5.0)]), (43, paths[3][1]), (44, None)]
    points = [(i, u(), u()) for i in range(400)] + [(i, float(3 * (i % 3 - 1)), float(8 * (i % 20) - 80)) for i in range(400, 460)] + [(7, 1.0, 11.0), (None, 0.0, 0.0)]
    l = spark.createDataFrame(paths, f"line_id int, path {PATH}")
    p = spark.createDataFrame(points, "pole_id int, x double, y double")
    got = sorted((r.line_id, str(r.pole_id), r.x) for r in lines.poles_on_lines(l, p, "line_id", "pole_id").collect())
    assert got == sorted((i, str(k), x) for i, path in paths if path for k, x, y in points if path_dist(x, y, path) <= 3.0)
    candidates = spatial.points_near_paths(p, l.where("line_id < 40 AND size(path) = 2"), cell=8.0, point_id=["pole_id"], reach=3.0).count()
    boxes = spatial.points_in_boxes(p, geom.with_bbox(l.where("line_id < 40 AND size(path) = 2"), "path"), cell=200.0, point_id=["pole_id"], reach=3.0).count()
    assert candidates * 4 < boxes


def test_members_of_a_ribbon_are_those_of_its_segments(spark):
    rnd = random.Random(9)
    u = lambda: rnd.uniform(-100.0, 100.0)
    axes = [(i, [(u(), u()) for _ in range(1 + i % 4)], 2.0 + i) for i in range(20)] + [(20, [(1.0, 1.0), (1.0, 1.0)], 9.0), (21, [(0.0, 0.0), (9.0, 9.0)], None)]
    points = [(i, u(), u()) for i in range(300)]
    r = spark.createDataFrame(axes, f"rid int, path {PATH}, half_width double")
    p = spark.createDataFrame(points, "fid int, x double, y double")
    got = sorted((m.rid, m.fid) for m in lines.ribbon_members(p, r, "fid").collect())
    # every point beside every axis
    every = p.crossJoin(r).where(F.exists(geom.segments(F.col("path")), lambda s: lines.in_ribbon(F.col("x"), F.col("y"), F.array(geom.point(s.x0, s.y0), geom.point(s.x1, s.y1), geom.point(s.x1, s.y1)), F.col("half_width"))))
    assert got == sorted((m.rid, m.fid) for m in every.collect()) and len(got) > 100


def test_scattered_points_are_not_shuffled(spark):
    square, corner = [(0.0, 0.0), (90.0, 0.0), (90.0, 90.0), (0.0, 90.0), (0.0, 0.0)], [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)]
    rows = [(1, square, 1000), (2, corner, 700), (3, square, 3), (4, square, 0), (5, corner, 512), (5, corner, 512), (6, square, 300), (6, square, 40), (None, square, 20)]
    a = spark.createDataFrame(rows, f"id int, ring {PATH}, want int")
    small, large = (audit.scatter(a, "id", "want", seed=2, block=b) for b in (16, 100_000))
    points = lambda df: sorted((str(r.id), r.i, r.x, r.y) for r in df.collect())
    got = points(small)
    one_area = lambda rs: [r for r in rs if r[0] != "6"]  # of areas with one id and unlike counts either row may give a point
    assert one_area(got) == one_area(points(large)) and len(got) == len(points(large))
    n = {k: sum(r[0] == k for r in got) for k in ("1", "2", "3", "5", "None")}
    assert n == {"1": 1000, "2": 700, "3": 3, "5": 512, "None": 20}
    numbered, plain = [], audit.sequenced

    def counted(df, *args, **k):
        numbered.append(df.count())
        return plain(df, *args, **k)

    audit.sequenced = counted
    try:
        audit.scatter(a.where("id = 1"), "id", "want", seed=2).collect()
    finally:
        audit.sequenced = plain
    assert numbered[0] <= 256
