"""Requests, near zones, clearances and crossings in numbers: equal results, less work per row."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from driver import q_streams
from sitewright import rules
from sitewright.functions import geom
from sitewright.operators import exports, lines, siting, spatial, zones
from sitewright.streaming import feeds, stateful
from tests.test_stateful import as_stream, places

REQUESTS = "id long, status string, sent_at date, event_no int, at timestamp"
DAY = 86_400_000


class _Handle:
    """State and timers of one request."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *a):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def by_handlers(slices, days, delay_ms=1000):
    """What ``_Reminders`` says, request by request: batches by the clock of the rows before them, and one more at the end."""
    held, told, before, now = {}, {}, 0, 0
    ms = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    midnight = lambda d: ms(datetime.datetime(d.year, d.month, d.day)) if d else None
    for rows in [*slices, []]:
        mine = {}
        for key, status, sent, no, at in rows:
            if at is None or ms(at) > before:
                mine.setdefault(key, []).append({"no": no, "sent_ms": midnight(sent), "status": status})
        for key, events in mine.items():
            if key not in held:
                h = _Handle()
                held[key] = (stateful._Reminders(days), h)
                held[key][0].init(h)
            assert not [*held[key][0].handleInputRows((key,), iter(events), None)]
        for key, (p, h) in held.items():
            for at in [t for t in h.timers if t < now]:
                h.timers.remove(at)
                for r in p.handleExpiredTimer((key,), None, None):
                    told[r["id"]] = r["sent_ms"]
        before, now = now, max([now, *[ms(r[4]) - delay_ms for r in rows if r[4] is not None]])
    return told


def request_slices(seed, n=6):
    rnd, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    slices = []
    for k in range(n):
        rows = {}
        for _ in range(30):
            sent = rnd.choice([None, *[(start + datetime.timedelta(days=rnd.randrange(4 * k, 4 * k + 8))).date()] * 9])
            # clocks that fall on a deadline to the millisecond, and rows at and behind the clock
            at = start + datetime.timedelta(days=4 * k - rnd.choice([0, 0, 0, 4, 9]) + 3, milliseconds=rnd.choice([0, 999, 1000, 1001, 1002]))
            key = (rnd.choice([None, *range(12)]), rnd.randrange(6))
            rows[key] = (key[0], rnd.choice([rules.TU_SENT, rules.TU_SENT, rules.TU_RECEIVED, None]), sent, key[1], rnd.choice([None, *[at] * 9]))
        slices.append([*rows.values()])
    return slices


def test_reminders_equal_the_handler_of_one_request(spark):
    slices = request_slices(2, 5)
    got = stateful.reminders(as_stream(spark, slices, REQUESTS), days=5, at="at", **places(spark)).collect()
    want = by_handlers(slices, 5)
    ms = lambda d: (d - datetime.date(1970, 1, 1)).days * DAY
    assert {r["id"]: ms(r["sent_at"]) for r in got} == want and len(got) == len(want) > 1


def test_slices_are_files_that_all_tasks_write(spark, monkeypatch):
    monkeypatch.setattr(q_streams, "SLICE_FILE_ROWS", 100)
    for rows, files in ((4000, 10), (300, 1)):
        s = q_streams.in_slices(spark.range(rows), F.col("id"))
        seen = []
        feeds.run_available(s, places(spark)["checkpoint"], lambda df, b: seen.append((df.select(F.input_file_name()).distinct().count(), df.agg(F.min("id"), F.max("id"), F.count("id")).first())), mode="append")  # noqa: B023
        # four batches in order of their time, each whole, of as many files
        assert [n for n, _ in seen] == [files] * 4 and sum(r[2] for _, r in seen) == rows
        assert all(a[1][1] < b[1][0] for a, b in zip(seen, seen[1:]))


def test_reminders_start_no_python_per_request(spark, monkeypatch):
    def forbidden(*a):
        raise AssertionError("a handler for each request")

    monkeypatch.setattr(stateful._Reminders, "__init__", forbidden)
    day = datetime.date(2024, 1, 1)
    got = stateful.reminders(as_stream(spark, [[(1, rules.TU_SENT, day, 0)], [(2, rules.TU_SENT, day + datetime.timedelta(days=9), 0)]], "id long, status string, sent_at date, event_no int"), days=5, **places(spark))
    assert [r["id"] for r in got.collect()] == [1]


PATH = "array<struct<x:double,y:double>>"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def boxes_and_lines(rnd, n=60, side=400.0):
    b, p = [], []
    for _ in range(n):
        x, y, w, h = rnd.randint(0, int(side)), rnd.randint(0, int(side)), rnd.choice([0, 8, 40, 40, 150]), rnd.choice([4, 28, 90])
        b.append(rect(float(x), float(y), float(x + w), float(y + h)))
        dx, dy = rnd.choice([(0, 0), (0, 90), (70, 0), (-3000, 900), *[(rnd.randint(-120, 120), rnd.randint(-120, 120)) for _ in range(6)]])
        x, y = rnd.randint(0, int(side)), rnd.randint(0, int(side))
        p.append([(float(x), float(y)), (float(x + dx), float(y + dy))])
    return b, p


def test_clearances_equal_all_pairs(spark, monkeypatch):
    rnd = random.Random(7)
    b, p = boxes_and_lines(rnd)
    b += [[(10.0, 10.0), (60.0, 20.0), (30.0, 70.0), (10.0, 10.0)], None, rect(5.0, 5.0, 9.0, 50.0)[:4]]
    p += [[(0.0, 0.0), (200.0, 10.0), (210.0, 300.0)], [(50.0, 50.0)], [], None, [(None, 1.0), (2.0, 2.0)], p[0]]
    bs = spark.createDataFrame([(i, r) for i, r in enumerate(b)] + [(0, b[0])], f"bid long, ring {PATH}").localCheckpoint()
    ps = spark.createDataFrame([(i, r) for i, r in enumerate(p)], f"lid long, path {PATH}").localCheckpoint()
    got = sorted((r.bid, r.lid, round(r.distance_m, 9)) for r in siting.network_clearances(bs, ps, "bid", min_m=5.0).collect())
    d = geom.path_area_dist(F.col("path"), F.col("ring"))
    want = sorted((r.bid, r.lid, round(r.d, 9)) for r in geom.fenced(bs.crossJoin(ps), d=d).where("d < 5 AND lid != 64").collect())  # no place for a path with an unknown vertex
    assert got == want and len(want) > 150
    # rectangles and single segments are told without the general test
    plain = [x for x in want if x[0] < 60 and x[1] < 60]
    monkeypatch.setattr(geom, "path_area_dist", lambda path, ring: F.raise_error(F.size(ring).cast("string")).cast("double"))
    got_plain = sorted((r.bid, r.lid, round(r.distance_m, 9)) for r in siting.network_clearances(bs.where("bid < 60"), ps.where("lid < 60"), "bid", min_m=5.0).collect())
    assert got_plain == plain


def test_segments_meet_few_boxes_that_are_far(spark):
    rnd = random.Random(8)
    b = spark.createDataFrame([(i, x, y, x + rnd.uniform(5, 30), y + rnd.uniform(5, 30)) for i in range(2000) for x, y in [(rnd.uniform(0, 1000), rnd.uniform(0, 1000))]], "bid long, minx double, miny double, maxx double, maxy double")
    s = spark.createDataFrame([(i, x, y, x + rnd.uniform(-200, 200), y + rnd.uniform(-200, 200)) for i in range(300) for x, y in [(rnd.uniform(0, 1000), rnd.uniform(0, 1000))]], "sid long, x0 double, y0 double, x1 double, y1 double")
    near = spatial.segments_near_boxes(s, b, cell=32.0, seg_id=["sid"], reach=2.0)
    path, ring = F.array(geom.point(F.col("x0"), F.col("y0")), geom.point(F.col("x1"), F.col("y1"))), geom.rect_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    n, ids = near.count(), near.select("sid", "bid").distinct().count()
    true = near.where(geom.path_area_dist(path, ring) < 2).count()
    assert n == ids and true > 2000 and n < 1.2 * true


def test_check_summary_adds_up_before_the_subtotals(spark):
    rows = [(i % 3, ["a", "b", None][i % 5 % 3], float(i)) for i in range(40)] + [(None, "a", 1.0), (7, "c", None)]
    found = spark.createDataFrame(rows, "building_id long, zone_type string, measure double")
    got = exports.check_summary([("one", found), ("two", found.where("building_id = 1"))])
    p = got._jdf.queryExecution().optimizedPlan().toString()
    assert p.index("Expand") < p.rindex("Aggregate [check_type")  # printed top down: the first sums lie below
    r = {(x.check_type, x.zone_type, x.level): (x.n, x.n_buildings, x.total) for x in got.collect()}
    assert r[None, None, 3] == (42 + 13, 4, sum(range(40)) + 1.0 + sum(range(1, 40, 3))) and r["one", "c", 0] == (1, 1, None) and r["one", None, 1][0] == 42


def test_envelope_of_a_rectangle_is_told_by_its_box(spark):
    rnd = random.Random(9)
    shapes = [rect(x, y, x + w, y + 4.0) for x in (0.0, 1.0) for y in (0.0, 2.0) for w in (0.0, 4.0, 6.0)] + [[(0.0, 0.0), (5.0, 0.0), (2.0, 5.0), (0.0, 0.0)], None]
    df = spark.createDataFrame([(i, rnd.choice(shapes), rnd.choice(shapes)) for i in range(200)], f"bid long, ring {PATH}, envelope {PATH}").localCheckpoint()
    got = {r.bid for r in siting.envelope_violations(df, "bid").collect()}
    assert got == {r.bid for r in df.where(~geom.ring_within(F.col("ring"), F.col("envelope"))).collect()} and len(got) > 20


def near_inputs(spark, rnd, n=120):
    pts = [(rnd.choice([None, 0, 1, *range(2, 200)]), float(rnd.randint(0, 900)), float(rnd.randint(0, 900))) for _ in range(n)] + [(500, None, 1.0), (501, 450.0, 450.0)]
    rings = [rect(x, y, x + rnd.choice([0.0, 30.0, 2000.0]), y + rnd.choice([20.0, 60.0])) for x, y in [(float(rnd.randint(-200, 1000)), float(rnd.randint(-200, 1000))) for _ in range(60)]]
    rings += [[(0.0, 0.0), (90.0, 10.0), (40.0, 200.0), (0.0, 0.0)], None]
    z = spark.createDataFrame([(i, r, f"t{i % 3}") for i, r in enumerate(rings)], f"zone_id long, ring {PATH}, kind string")
    return spark.createDataFrame(pts, "pid long, x double, y double").localCheckpoint(), geom.with_bbox(z, "ring").localCheckpoint()


def test_near_zones_and_their_ranks_equal_all_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    p, z = near_inputs(spark, rnd)
    monkeypatch.setattr(spatial, "GROUP", 3)  # cells fall into several groups
    d = geom.dist_to_area_in_box(F.col("x"), F.col("y"), F.col("ring"), *[F.col(c) for c in spatial.BOX])
    near = geom.fenced(p.where("x IS NOT NULL").crossJoin(z), distance_m=d).where("distance_m <= 150").localCheckpoint()
    got = zones.near_points(p, z, point_id="pid", max_distance_m=150.0)
    assert got.columns == [*p.columns, *z.columns, "distance_m"]
    show = lambda df: sorted(map(str, df.select("pid", "zone_id", "kind", F.round("distance_m", 9)).collect()))
    assert show(got) == show(near) and near.count() > 300
    ranked = zones.ranked_near_points(p, z, point_id="pid", zone_id="zone_id", carry=["kind"], max_distance_m=150.0)
    want = zones.rank_by_distance(near.select("pid", "zone_id", "kind", "distance_m"), point_id="pid", zone_id="zone_id")
    full = lambda df: sorted(map(str, df.select("pid", "zone_id", "kind", "pos", "rank").collect()))
    # ids that occur at several places, null among them, are ranked over all of these; equal pairs may change places
    assert show(ranked) == show(near)
    assert sorted(map(str, ranked.groupBy("pid").agg(F.sort_array(F.collect_list("pos")), F.sort_array(F.collect_list("rank"))).collect())) == sorted(
        map(str, want.groupBy("pid").agg(F.sort_array(F.collect_list("pos")), F.sort_array(F.collect_list("rank"))).collect())
    )
    single = p.groupBy("pid").count().where("count = 1").select("pid")
    assert full(ranked.join(single, "pid")) == full(want.join(single, "pid"))


def test_ranked_pairs_of_single_points_are_not_shuffled(spark):
    p, z = near_inputs(spark, random.Random(12))
    p = p.where("pid IS NOT NULL").dropDuplicates(["pid"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = zones.ranked_near_points(p, z, point_id="pid", zone_id="zone_id", max_distance_m=150.0)
        text = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = text[text.index("Window"):]  # the first branch of the union: from its windows down to the join of points and zones
    assert "Exchange" not in first[: first.index("SortMergeJoin")]


def test_crossings_equal_all_pairs_and_are_compiled(spark):
    rnd = random.Random(14)
    at = lambda: (float(rnd.randint(0, 30)), float(rnd.randint(0, 30)))
    side = lambda name, n: spark.createDataFrame([(i, [at() for _ in range(rnd.choice([1, 2, 2, 3]))]) for i in range(n)] + [(n, None), (n + 1, [(None, 1.0), (5.0, 5.0)])], f"{name} long, path {PATH}").localCheckpoint()
    b, a = side("bid", 40), side("aid", 40)
    got = lines.axis_crossings(b, a, "bid", "aid")
    pairs = b.select("bid", F.explode(geom.segments("path")).alias("s")).crossJoin(a.select("aid", F.explode(geom.segments("path")).alias("t")))
    want = geom.fenced(pairs, p=geom.segment_crossing(F.col("s"), F.col("t"))).where("p IS NOT NULL").select("bid", "aid", "p.x", "p.y")
    show = lambda df: sorted(map(str, df.select("bid", "aid", "x", "y").collect()))
    assert show(got) == show(want) and len(show(got)) > 200
    # methods over 8000 bytes of code are left to the interpreter
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = got.select("bid", "aid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) > 4 and max(sizes) < 8000
