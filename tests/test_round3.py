"""Many areas on one spot, terrain samples, nearest labels: brute force on small inputs, and which side a join may send to every task."""

import random

from pyspark.sql import functions as F

from sitewright.functions import geom
from sitewright.operators import lines, relief, siting, spatial, zones

RING = "ring array<struct<x:double,y:double>>"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def area_rows(rnd, n):
    """Rectangles of many sizes, triangles, one without width, one without outline; ids repeat."""
    out = []
    for i in range(n):
        x, y, w, h = rnd.uniform(-400, 300), rnd.uniform(-400, 300), rnd.choice([0, 5, 90, 400]), rnd.choice([3, 60, 350])
        out.append((rnd.randrange(n), rect(x, y, x + w, y + h) if i % 3 else [(x, y), (x + w, y + h), (x, y + h), (x, y)]))
    return [*out, (None, rect(0.0, 0.0, 40.0, 40.0)), (0, None)]


def test_least_cover_equals_all_pairs(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(-420, 420), rnd.uniform(-420, 420)) for i in range(300)] + [(1000 + i, 31.25 * i, 31.25 * i) for i in range(-8, 9)]
    p = spark.createDataFrame(pts, "pid int, x double, y double")
    a = geom.with_bbox(spark.createDataFrame(area_rows(rnd, 120), f"id int, {RING}").withColumn("label", F.concat(F.lit("z"), F.size("ring").cast("string"))), "ring")
    pairs = p.crossJoin(a.select("id", "label", "ring"))
    inside = pairs.where(geom.contains(F.col("x"), F.col("y"), F.col("ring")))
    best = inside.groupBy("pid").agg(F.min(F.struct("id", "label")).alias("b")).select("pid", "b.*")
    want = {r.pid: (r.id, r.label) for r in p.join(best, "pid", "left").collect()}
    got = zones.containing_zone(p, a, point_id="pid", area_id="id", carry=["label"], cell=250.0).collect()
    assert {r.pid: (r.id, r.label) for r in got} == want and len(got) == len(pts)
    covered = {r.pid for r in pairs.where(geom.covers(F.col("x"), F.col("y"), F.col("ring"))).select("pid").collect()}
    assert sorted(r.pid for r in relief.outside_areas(p, a, ["pid"]).collect()) == sorted(i for i, _, _ in pts if i not in covered)


def test_areas_stacked_on_a_spot_are_not_all_met(spark):
    """2,000 areas over 200 points: 400,000 pairs before; now the least area that covers a cell stands for those behind it."""
    a = spark.createDataFrame([(i, rect(-float(i % 7), 0.0, 200.0, 200.0 + i % 5)) for i in range(2000)], f"id int, {RING}")
    p = spark.createDataFrame([(i, 50.0 + i % 20 * 5, 60.0 + i // 20 * 5) for i in range(200)], "pid int, x double, y double")
    tests = []

    def inside(x, y, ring):
        tests.append(1)
        return F.when(F.assert_true(x < -1e9).isNull(), F.lit(True))

    # every point lies in a covered cell, so the exact test is never run; running it would stop the job
    got = spatial.first_cover(p, geom.with_bbox(a, "ring"), inside, cell=250.0, point_id=["pid"], order=F.struct("id")).collect()
    assert tests and {r._best.id for r in got} == {0} and len(got) == 200


def test_clearing_and_touching_equal_all_pairs(spark):
    rnd = random.Random(8)
    f = spark.createDataFrame([(i, rect(x := rnd.uniform(-500, 500), y := rnd.uniform(-500, 500), x + 30, y + 20)) for i in range(150)], f"fid int, f{RING}")
    s = spark.createDataFrame([(r,) for _, r in area_rows(rnd, 25)], RING)
    meets = f.crossJoin(s).where(geom.areas_intersect(F.col("fring"), F.col("ring")))
    hit = {r.fid for r in meets.select("fid").collect()}
    assert 0 < len(hit) < 150
    got = siting.clear_site(f, s, "fid").select("fid", "part").collect()
    assert {r.fid for r in got if r.part == "removed"} == hit and len(got) == 150
    lanes = s.withColumn("network", F.lit("каркасная"))
    touched = lines.network_by_touch(f.withColumnRenamed("fring", "ring"), lanes, "fid").collect()
    assert {r.fid for r in touched if r.network == "каркасная"} == hit and len(touched) == 150


def test_labels_are_the_nearest_at_every_distance(spark):
    rnd = random.Random(9)
    segs = [(i, [(x := rnd.uniform(0, 300), y := rnd.uniform(0, 300)), (x + 4, y - 4)]) for i in range(80)]
    texts = [(i, float(rnd.randrange(0, 300)), float(rnd.randrange(0, 300)), f"t{i}") for i in range(120)] + [(500, 1.0, 1.0, "a"), (501, 1.0, 1.0, "b")]
    segs.append((900, [(0.0, 1.0), (2.0, 1.0)]))

    def nearest(path):
        mx, my = sum(x for x, _ in path) / len(path), sum(y for _, y in path) / len(path)
        near = [((x - mx) * (x - mx) + (y - my) * (y - my), -seq, t) for seq, x, y, t in texts]
        d2, _, t = min(near)
        return t if d2 <= 40.0 * 40.0 else None

    s = spark.createDataFrame(segs, "sid int, path array<struct<x:double,y:double>>")
    t = spark.createDataFrame(texts, "seq int, x double, y double, txt string")
    got = {r.sid: r.label for r in siting.label_segments(s, t, "sid", snap_m=40.0).collect()}
    assert got == {i: nearest(p) for i, p in segs} and got[900] == "b"


def test_samples_send_the_header_not_the_points(spark):
    cells = spark.range(100).select(F.lit(0).cast("bigint").alias("source_id"), (F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"), F.lit(1.0).alias("z"))
    pts = spark.range(50).select(F.lit(0).cast("bigint").alias("source_id"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert "BuildLeft" not in plan(relief.sample(pts, cells, relief.grid_of(cells, 0.0, 100.0, 10.0), ["id"]))


def test_near_pairs_send_no_side_to_the_driver(spark, tmp_path):
    """Files of regular rows are small on disk and large in memory; the planner goes by the former."""
    ids = spark.range(300).select(F.col("id").alias("b"), (F.col("id") * 10.0).alias("x"))
    ids.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    b = t.select("b", geom.rect_ring(F.col("x"), F.lit(0.0), F.col("x") + 4, F.lit(4.0)).alias("ring"))
    path = F.array(geom.point(F.col("x"), F.lit(5.0)), geom.point(F.col("x") + 4, F.lit(5.0)))
    near = siting.network_clearances(b, t.select(F.col("b").alias("l"), path.alias("path")), "b", min_m=2.0)
    assert "BroadcastHashJoin" not in plan(near) and near.count() == 300


def test_distance_to_a_rectangle_is_that_to_its_outline(spark):
    rnd = random.Random(10)
    p = spark.createDataFrame([(i, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(200)], "pid int, x double, y double")
    a = geom.with_bbox(spark.createDataFrame([(0, rect(-10.0, -5.0, 20.0, 7.0)), (1, [(0.0, 0.0), (9.0, 3.0), (2.0, 8.0), (0.0, 0.0)])], f"id int, {RING}"), "ring")
    d = p.crossJoin(a).select(
        geom.dist_to_area(F.col("x"), F.col("y"), F.col("ring")).alias("a"),
        geom.dist_to_area_in_box(F.col("x"), F.col("y"), F.col("ring"), *[F.col(c) for c in spatial.BOX]).alias("b"),
    ).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in d)
