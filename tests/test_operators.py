"""Invariants: brute force on small inputs, skewed keys, partition independence, plans without nested loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewright.functions import geom
from sitewright.operators import chunks, jobs, lines, relief, spatial, tiles, zones
from sitewright.sources import raster, tables
from sitewright.streaming import feeds


def test_points_in_boxes_meets_every_pair_once(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for i in range(300)] + [(1000 + i, 1.0, 1.0) for i in range(200)]  # a hot spot
    boxes = []
    for i in range(40):
        x, y, w, h = rnd.uniform(-500, 400), rnd.uniform(-500, 400), rnd.choice([5, 60, 900]), rnd.choice([5, 60, 900])
        boxes.append((i, x, y, x + w, y + h))
    want = sorted((p, b) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 - 3 <= x <= x1 + 3 and y0 - 3 <= y <= y1 + 3)
    pd_, bd = spark.createDataFrame(pts, "pid int, x double, y double"), spark.createDataFrame(boxes, "bid int, minx double, miny double, maxx double, maxy double")
    for fan in (1, 16):
        got = spatial.points_in_boxes(pd_, bd, cell=50.0, point_id=["pid"], reach=3.0, fan=fan).select("pid", "bid").collect()
        assert sorted(map(tuple, got)) == want


def test_box_pairs_meets_every_pair_once(spark):
    rnd = random.Random(2)

    def make(n):
        out = []
        for i in range(n):
            x, y, w, h = rnd.uniform(-300, 300), rnd.uniform(-300, 300), rnd.choice([1, 40, 700]), rnd.choice([1, 40, 700])
            out.append((i, x, y, x + w, y + h))
        return out

    a, b = make(80), make(70)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] - 2 <= q[3] and q[1] <= p[3] + 2 and p[2] - 2 <= q[4] and q[2] <= p[4] + 2)
    l = spark.createDataFrame(a, "a int, ax0 double, ay0 double, ax1 double, ay1 double")
    r = spark.createDataFrame(b, "b int, bx0 double, by0 double, bx1 double, by1 double")
    got = spatial.box_pairs(l, r, cell=50.0, left_id=["a"], lbox=("ax0", "ay0", "ax1", "ay1"), rbox=("bx0", "by0", "bx1", "by1"), reach=2.0)
    assert sorted(map(tuple, got.select("a", "b").collect())) == want


def test_nearest_path_is_exact(spark):
    rnd = random.Random(3)
    qs = [(i, rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000)) for i in range(60)]
    ps = [(i, x := rnd.uniform(2000, 2300), y := rnd.uniform(2000, 2300), x + rnd.uniform(-200, 200), y + rnd.uniform(-200, 200)) for i in range(50)] + [(99, -2900.0, -2900.0, 1500.0, -2800.0)]
    path = lambda: F.array(geom.point(F.col("x0"), F.col("y0")), geom.point(F.col("x1"), F.col("y1")))
    q = spark.createDataFrame(qs, "qid int, x double, y double").select("qid", F.lit(0).alias("site"), F.array(geom.point(F.col("x"), F.col("y"))).alias("qp"))
    p = spark.createDataFrame(ps, "pid int, x0 double, y0 double, x1 double, y1 double").select("pid", F.lit(0).alias("site"), path().alias("path"))
    n = spatial.nearest_path(q, p, query_id=["qid"], by=["site"], query_path="qp", path="path", path_order=F.col("pid"), carry=[],
                             distance=lambda a, b: geom.dist_to_path(a[0].x, a[0].y, b))
    got = {r.qid: (r.nearest.hit.ord, r.nearest.dist) for r in n.select("qid", "nearest").collect()}

    def dist(px, py, s):
        _, x0, y0, x1, y1 = s
        dx, dy = x1 - x0, y1 - y0
        t = max(0, min(1, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
        return ((x0 + t * dx - px) ** 2 + (y0 + t * dy - py) ** 2) ** 0.5

    for qid, x, y in qs:
        best = min((dist(x, y, s), s[0]) for s in ps)
        assert got[qid][0] == best[1] and got[qid][1] == pytest.approx(best[0])


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_sequenced_does_not_depend_on_chunks(spark, width):
    rows = [("hot", i) for i in range(60)] + [("b", 5), ("c", 1), ("c", 900)]
    df = spark.createDataFrame(rows, "k string, s long")
    out = chunks.sequenced(df, ["k"], ["s"], F.floor(F.col("s") / float(width)), number="n", following={"nx": "s"}, preceding={"pv": "s"})
    got = sorted(map(tuple, out.select("k", "s", "n", "nx", "pv").collect()), key=lambda r: (r[0], r[1]))
    by = {}
    for k, s in sorted(rows):
        by.setdefault(k, []).append(s)
    want = [(k, s, i + 1, v[i + 1] if i + 1 < len(v) else None, v[i - 1] if i else None) for k, v in sorted(by.items()) for i, s in enumerate(v)]
    assert got == want


def plane(spark, n=12, hole=None):
    cells = [(0, r, c, None if (r, c) == hole else 100 + 0.5 * c + 0.25 * r) for r in range(n) for c in range(n)]
    return spark.createDataFrame(cells, "source_id long, r int, c int, z double")


def test_plane_comes_back_from_sample_and_smoothing(spark):
    cells = plane(spark)
    grid = relief.grid_of(cells, 0.0, 120.0, 10.0)
    pts = spark.createDataFrame([(1, 0, 33.0, 61.0), (2, 0, 5.0, 115.0), (3, 0, 4.9, 60.0), (4, 0, 115.0, 5.0)], "id int, source_id long, x double, y double")
    z = {r.id: r.z for r in relief.sample(pts, cells, grid, ["id"]).collect()}
    f = lambda x, y: 100 + 0.5 * (x / 10 - 0.5) + 0.25 * ((120 - y) / 10 - 0.5)
    assert z[1] == pytest.approx(f(33, 61)) and z[2] == pytest.approx(100.0) and z[3] is None and z[4] == pytest.approx(100 + 0.75 * 11)
    inner = relief.smooth(cells, 5, chunk=4).where("r between 2 and 9 and c between 2 and 9")
    assert inner.where("abs(z - z_smooth) > 1e-9").count() == 0


def test_missing_neighbour_gives_no_height(spark):
    cells = plane(spark, hole=(5, 5))
    grid = relief.grid_of(cells, 0.0, 120.0, 10.0)
    pts = spark.createDataFrame([(1, 0, 52.0, 62.0)], "id int, source_id long, x double, y double")
    assert relief.sample(pts, cells, grid, ["id"]).first().z is None


def test_smoothed_profile_keeps_a_slope(spark):
    df = spark.createDataFrame([(1, i, 20, 3.0 + 0.5 * i) for i in range(21)] + [(2, i, 3, None) for i in range(4)], "line int, i long, n long, z double")
    out = lines.smoothed_profile(df, "line", step=1.0, window_m=10.0, chunk=6)
    got = {(r.line, r.i): r.z_smooth for r in out.collect()}
    assert all(got[1, i] == pytest.approx(3.0 + 0.5 * i) for i in range(21)) and got[2, 0] == 0.0


def test_blend_without_base_or_border(spark):
    cells = plane(spark).withColumns({"ok": F.lit(True), "base": F.lit(0.0)})
    assert relief.blend(cells, "base", "z", "ok", 10.0, 40.0, out="o").where("alpha <> 1").count() == 0


def test_neighbour_tiles_share_their_seam(spark):
    t = spark.createDataFrame([(0, 0), (1, 0)], "tx long, ty long")
    p = tiles.boundary_points(t, 50.0).where("x = 250").groupBy("tx").agg(F.sort_array(F.collect_set("y")).alias("y")).collect()
    assert p[0].y == p[1].y and len(p[0].y) == 6
    with pytest.raises(ValueError):
        tiles.boundary_points(t, 60.0)


def test_peak_in_long_steps(spark):
    base = 1_700_000_000
    s = spark.createDataFrame([(1, base + i * 600, i % 50) for i in range(200)], "job_id int, u long, rss_kb long").withColumn("ts", F.timestamp_seconds("u"))
    st = spark.createDataFrame([(1, 10, base + 100, base + 100_000), (1, 11, base, base), (1, 12, base + 200_000, base + 300_000)], "job_id int, step_id int, a long, e long")
    st = st.select("job_id", "step_id", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("e").alias("ended_at"))
    got = {r.step_id: r.peak_rss_kb for r in jobs.peak_in_steps(s, st).collect()}
    assert got == {10: 49, 11: 0, 12: None}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 3, "z"), ("a", 2, "w")], "k string, seq int, v string")
    assert sorted(map(tuple, tables.upsert_last(old, new, ["k"], "seq").collect())) == [("a", 3, "z"), ("b", 1, "y")]


def test_text_grid_reader(spark, tmp_path):
    (tmp_path / "g.txt").write_text("7 0 1.5 -9999 x\n7 1 2 3 4\n")
    got = {(r.r, r.c): r.z for r in raster.read_text_grid(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.5, (0, 1): None, (0, 2): None, (1, 0): 2.0, (1, 1): 3.0, (1, 2): 4.0}


def test_strict_mode_stops_on_a_reject(spark):
    bad = tables.checked_directory(spark.createDataFrame([("факс",)], "application_channel string"))
    with pytest.raises(Exception, match="unknown application channel"):
        tables.require_valid(bad).collect()


def test_joins_have_no_nested_loop(spark):
    from driver import catalog

    for name in ("j01_regulation_at_point", "j04_zones_near_point", "j07_outlines_without_parts", "j10_nearest_rail", "j13_network_clearance", "j22_peak_per_step", "f01_radius_selection"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_alert_stream_over_several_files_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    base = 1_700_000_000
    rows = [(k, base + i * 60 + k, rnd.random() < 0.8) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, u long, bad boolean").select("k", F.timestamp_seconds("u").alias("ts"), "bad")
    src = str(tmp_path / "in")
    for part in range(4):
        lo, hi = base + part * 3000, base + (part + 1) * 3000
        df.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = feeds.read_changes(spark, src, df.schema, files_per_trigger=1)
    got = feeds.alerts(stream, key="k", ts="ts", bad="bad", hold_s=120, path=str(tmp_path / "t"), checkpoint=str(tmp_path / "c"))
    want = jobs.held_alerts(df, key="k", ts="ts", bad="bad", hold_s=120)
    cols = ["k", "t0", "t1", "n_samples"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("keys", [("k",), ("k", "g")])
def test_sequenced_ranks_ties_nulls_and_null_keys(spark, keys):
    rows = [("a", 1, 1.0, i) for i in range(5)] + [("a", 1, 2.0, 7), ("a", 1, 900.0, 8), ("a", 1, None, 9), (None, 2, 5.0, 1), (None, 2, 5.0, 2), ("b", None, 3.0, 4)]
    df = spark.createDataFrame(rows, "k string, g int, d double, i int")
    out = chunks.sequenced(df, keys, ["d", "i"], F.floor("d"), number="n", rank=("rk", ["d"]))
    w = Window.partitionBy(*keys).orderBy("d", "i")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.rank().over(Window.partitionBy(*keys).orderBy("d")).cast("bigint").alias("rk"))
    assert sorted(map(repr, out.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_scans_and_shuffles_its_input_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("s"), F.col("id").alias("v"), F.lit("x").alias("unused")).write.parquet(path)
    df = spark.read.parquet(path).select("k", "s", "v")
    out = chunks.sequenced(df, ["k"], ["s"], F.floor(F.col("s") / 100.0), number="n", following={"nx": "v"}, preceding={"pv": "v"})
    for cut in (out, out.select("s", "n"), out.where(F.col("nx").isNull()).select("s"), out.where("v > 5").select("k", "pv")):
        plan = final_plan(cut)
        plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert plan.count("FileScan parquet") == 1, plan
        assert "ReusedExchange" in plan and "unused" not in plan


def test_a_box_covers_at_most_four_cells_whatever_its_size(spark):
    boxes = spark.createDataFrame([(i, 13.0 * i, -7.0 * i, 13.0 * i + side, -7.0 * i + side / 3) for i, side in enumerate([0.0, 1.0, 249.0, 250.0, 251.0, 1e4, 1e5, 1e7])],
                                  "bid int, minx double, miny double, maxx double, maxy double")
    b = boxes.withColumn("_lv", spatial._level(spatial.BOX, 250.0, None, F.lit(0.0)))
    cells = spatial._explode_cells(b, spatial.BOX, spatial._size(F.col("_lv"), 250.0), F.lit(0.0))
    assert cells.groupBy("bid").count().agg(F.max("count")).first()[0] <= 4
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-1e5, 1e5), rnd.uniform(-1e5, 1e5)) for i in range(300)] + [(300, 0.0, 0.0), (301, 13.0, -7.0)]
    got = spatial.points_in_boxes(spark.createDataFrame(pts, "pid int, x double, y double"), boxes, cell=250.0, point_id=["pid"])
    want = {(p, b.bid) for p, x, y in pts for b in boxes.collect() if b.minx <= x <= b.maxx and b.miny <= y <= b.maxy}
    rows = [(r.pid, r.bid) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    none = spatial.points_in_boxes(spark.createDataFrame(pts, "pid int, x double, y double"), boxes.limit(0), cell=250.0, point_id=["pid"])
    assert none.count() == 0


def test_latest_zones_are_those_in_force(spark):
    rows = [(i, None if i % 5 == 0 else f"n{i % 3}", i * 7 % 31, f"t{i}", [(1.0 * i, 2.0)]) for i in range(30)]
    z = spark.createDataFrame(rows, "id int, registry_number string, load_seq long, zone_type string, ring array<struct<x: double, y: double>>")
    want = zones.current(zones.versions(z, chunk_size=4)).select(z.columns)
    got = zones.latest(z).select(z.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 9
