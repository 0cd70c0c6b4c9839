"""Cases that lost or mis-ranked rows before: each is small and checked by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, kernels
from sitewright.operators import audit, selection, siting, tiles

SQUARE = lambda x, y, s: geom.rect_ring(F.lit(float(x)), F.lit(float(y)), F.lit(float(x + s)), F.lit(float(y + s)))


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


U = ring((0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0))
RING_T = "array<struct<x: double, y: double>>"


def test_parcels_have_no_page(spark):
    parcels = spark.range(300).select("id", F.lit("n").alias("number"), F.lit(56.0).alias("lon"), F.lit(58.0).alias("lat"))
    points = spark.createDataFrame([(1, 56.0, 58.0)], "site_id long, center_lon double, center_lat double")
    assert selection.parcels_near(parcels, points).count() == 300


def test_scatter_fills_thin_and_angular_areas(spark):
    thin = ring((0, 0), (1000, 1000), (1000, 1001), (0, 1), (0, 0))
    df = spark.createDataFrame([(1, U, 500), (2, thin, 40), (3, ring((0, 0), (5, 5), (0, 0)), 10), (4, U, 0)], f"id long, ring {RING_T}, want long")
    got = {r["id"]: r["n"] for r in audit.scatter(df, "id", "want").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 500, 2: 40}


def test_sight_through_a_concave_obstacle(spark):
    df = spark.createDataFrame([(U, 5.0, 20.0, 25.0, 20.0), (U, 5.0, 20.0, 5.0, 25.0), (U, 12.0, 20.0, 18.0, 20.0), (U, -5.0, 5.0, 35.0, 5.0), (U, 5.0, 5.0, 5.0, 5.0)], f"ring {RING_T}, x0 double, y0 double, x1 double, y1 double")
    got = [r[0] for r in df.select(siting.sight_blocked(F.col("ring"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).collect()]
    assert got == [True, False, False, True, False]


def test_access_roads_keep_every_site_and_ignore_touching(spark):
    roads = spark.createDataFrame([(1, 7, ring((50, -10), (50, 200)), rules.NETWORK_BACKBONE)], f"town long, road_id long, path {RING_T}, network string")
    # one obstacle across the first site's line, one that the other's line only touches
    obstacles = spark.createDataFrame([(ring((20, -5), (30, -5), (30, 20), (20, 20), (20, -5)),), (ring((20, 90), (30, 90), (30, 100), (20, 100), (20, 90)),)], f"oring {RING_T}")
    sites = spark.createDataFrame([(1, 1, ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), (1, 3, ring((0, 100), (10, 100), (10, 100.5), (0, 100.5), (0, 100))), (2, 2, ring((0, 0), (1, 0), (1, 1), (0, 0)))], f"town long, site_id long, ring {RING_T}")
    got = {r["site_id"]: r for r in siting.access_roads(sites, roads, obstacles, "site_id", "road_id", by=["town"]).collect()}
    assert set(got) == {1, 2, 3}
    assert got[2]["road_id"] is None and got[2]["distance_m"] is None and not got[2]["needs_confirmation"] and not got[2]["crosses_obstacle"]
    assert got[1]["road_id"] == 7 and got[1]["crosses_obstacle"] and got[1]["needs_confirmation"] and got[1]["distance_m"] == pytest.approx(40)
    assert not got[3]["crosses_obstacle"]


def test_kernels_pass_nulls(spark):
    df = spark.createDataFrame([(None,), (ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)),), ([],)], f"r {RING_T}")
    one = SQUARE(1, 1, 2)
    got = df.select(kernels.overlap_area_udf("r", one), kernels.clip_to_circle_udf("r", F.lit(0.0), F.lit(0.0), F.lit(1.0)), kernels.hull_udf("r"), kernels.oriented_box_udf("r")).collect()
    assert [r[0] for r in got] == [None, 1.0, None] and [r[1] is None for r in got] == [True, False, True] and [r[2] is None for r in got] == [True, False, True]


def test_groups_of_sites(spark):
    f = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "site long, layer string")
    got = {(r["site"], r["layer"]): r["n"] for r in audit.layer_summary(f, ["site"]).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (1, None): 3, (2, "b"): 1, (2, None): 1}
    counts = f.groupBy("site", "layer").agg(F.count("*").alias("n"))
    zero = audit.zero_filled(counts, ["a", "b", "c"], groups=f.select("site").distinct())
    assert {(r["site"], r["layer"]): r["n"] for r in zero.collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "c"): 0, (2, "a"): 0, (2, "b"): 1, (2, "c"): 0}
    content = spark.createDataFrame([(1, 0, 0, "LOD2", 10.0, 10.0, 0.0, 5.0), (2, 0, 0, "LOD0", 10.0, 10.0, 1.0, 2.0)], "site long, tx long, ty long, lod string, cx double, cy double, z_min double, z_max double")
    assert tiles.index_rows(content, ["site"]).groupBy("site").count().collect() and tiles.index_rows(content, ["site"]).where("lod = 'root'").count() == 2


def test_shared_folder_is_required_off_one_machine(monkeypatch):
    from sitewright import session

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_answer_in_the_same_batch_beats_the_request(spark, tmp_path):
    from sitewright.streaming import feeds

    day = datetime.date
    rows = [(1, day(2024, 1, 1), rules.TU_RECEIVED, 2), (1, day(2024, 1, 1), rules.TU_SENT, 1), (2, day(2024, 1, 1), rules.TU_SENT, 1), (3, day(2024, 6, 1), rules.TU_SENT, 1)]
    spark.createDataFrame(rows, "id long, sent_at date, status string, event_no int").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = feeds.read_changes(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    got = feeds.reminders(s, path=f"{tmp_path}/t", checkpoint=f"{tmp_path}/c", days=30, order="event_no")
    assert [r["id"] for r in got.collect()] == [2]


def test_alerts_over_many_files_with_late_rows(spark, tmp_path):
    """Six files, rows up to 40 minutes late, one of them turning a reported run into two."""
    import random

    from sitewright.operators import jobs
    from sitewright.streaming import feeds

    rnd, start = random.Random(4), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(k, start + datetime.timedelta(minutes=m), rnd.random() < 0.93) for k in range(5) for m in range(0, 600, 5) if rnd.random() < 0.9]
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rnd.choice([0, 0, 0, 40])))
    step = len(late) // 6 + 1
    for i in range(6):
        spark.createDataFrame(late[i * step : (i + 1) * step], "k long, ts timestamp, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    got = feeds.alerts(feeds.read_changes(spark, f"{tmp_path}/in", schema, files_per_trigger=1), key="k", ts="ts", bad="bad", hold_s=3600, path=f"{tmp_path}/t", checkpoint=f"{tmp_path}/c")
    want = jobs.held_alerts(spark.read.parquet(f"{tmp_path}/in"), key="k", ts="ts", bad="bad", hold_s=3600)
    assert sorted(map(tuple, got.select("k", "t0", "t1", "n_samples").collect())) == sorted(map(tuple, want.select("k", "t0", "t1", "n_samples").collect()))
    assert want.count() > 3


def test_holes_hold_in_every_predicate(spark):
    from sitewright.sources import tables

    def square(x, y, s):
        return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]

    import json

    zone = {"zone_type": "t", "status": "s", "registry_number": "1"}
    features = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 40), square(10, 10, 10), square(25, 25, 10)[::-1]]}, "properties": zone | {"regime": "a"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 2)], [square(9, 9, 3), square(10, 10, 1)]]}, "properties": zone | {"regime": "b"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": zone | {"regime": "c"}},
        {"type": "Feature", "geometry": None, "properties": zone | {"regime": "d"}},
    ]
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/z.json", "w") as f:
            json.dump({"type": "FeatureCollection", "features": features}, f)
        z = tables.zones_from_geojson(spark, f"{folder}/z.json").cache()
        z.count()
    got = {(r["regime"], r["part_no"]): (r["part"], r["n_holes"], r["a"]) for r in z.select("*", geom.area(F.col("ring")).alias("a")).collect()}
    assert got[("a", 1)] == ("valid", 2, 1400.0) and got[("b", 1)] == ("valid", 0, 4.0) and got[("b", 2)] == ("valid", 1, 8.0)
    assert got[("c", 1)][0] == got[("d", 1)][0] == "rejected" and z.where("ring is null").count() == 2
    a = z.where("regime = 'a'")
    inside = lambda x, y: geom.contains(F.lit(float(x)), F.lit(float(y)), F.col("ring"))
    row = a.select(inside(5, 3), inside(15, 14), inside(30, 29), inside(22, 21), inside(50, 5), kernels.overlap_area_udf("ring", SQUARE(5, 5, 20)), geom.dist_to_area(F.lit(15.0), F.lit(14.0), F.col("ring"))).first()
    assert list(row)[:5] == [True, False, False, True, False] and row[5] == pytest.approx(300.0) and 0 < row[6] <= 4


def test_self_crossing_rings_keep_their_largest_loop(spark):
    assert kernels.largest_loop([(0, 0), (10, 10), (10, 0), (0, 10)]) is not None
    eight = [(0, 0), (4, 4), (8, 0), (8, 8), (4, 4.5), (0, 8)]
    assert sorted(kernels.largest_loop(eight)) == sorted(eight)
    big = kernels.largest_loop([(0, 0), (10, 0), (10, 10), (4, -2), (2, -2)])
    assert abs(kernels.shoelace(big)) > 20 and kernels._first_crossing(big) is None
    df = spark.createDataFrame([(ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0)),), (None,), ([],)], f"r {RING_T}")
    got = df.select(geom.area(kernels.untangled_udf("r"))).collect()
    assert got[0][0] == pytest.approx(25.0)
