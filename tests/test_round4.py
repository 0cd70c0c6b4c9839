"""Sight lines, overlaps, envelopes, curbs and reminders where very much lies on one spot: equal results, less work."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitewright import rules
from sitewright.functions import geom
from sitewright.functions.slabs import open_ring, overlap_area
from sitewright.operators import lines, siting, zones
from sitewright.streaming import stateful

PATH = "array<struct<x:double,y:double>>"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def shapes(rnd, n, span, size):
    """Rectangles, one in three a triangle; some share sides, one has no outline."""
    out = []
    for i in range(n):
        x, y, w, h = rnd.randrange(span), rnd.randrange(span), rnd.randrange(4, size), rnd.randrange(4, size)
        out.append(rect(x, y, x + w, y + h) if i % 3 else [(x, y), (x + w, y), (x, y + h), (x, y)])
    floats = [[(float(a), float(b)) for a, b in r] for r in out]
    return [*floats, None]


def test_curbs_deal_lanes_before_their_edges(spark):
    lanes = spark.createDataFrame([(k, t, r) for k in ([1], [2, 3], [4], None) for t, r in (("Driving", rect(0.0, 0.0, 4.0, 9.0)), ("Sidewalk", rect(4.0, 0.0, 6.0, 9.0)))], f"way_ids array<long>, lane_type string, ring {PATH}")
    ways = spark.createDataFrame([(1, "asphalt"), (2, "asphalt"), (3, "Gravel"), (4, None)], "way_id long, surface string")
    c = lines.curbs(lanes, ways)
    assert sorted(str(r.ways_key) for r in c.collect()) == ["1", "4", "None"]
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan


def test_site_under_a_rectangle_needs_no_kernel(spark, monkeypatch):
    def only_null(ring: pd.Series, setback: pd.Series, around: pd.Series) -> pd.Series:
        assert ring.isna().all()
        return pd.Series([None] * len(ring), dtype="float64")

    monkeypatch.setattr(zones.slabs, "free_area_udf", pandas_udf(only_null, "double"))
    s = spark.createDataFrame([(1, rect(0.0, 0.0, 20.0, 10.0), "a")], f"site long, ring {PATH}, zone_code string")
    regs = spark.createDataFrame([("a", 1.0, 9.0)], "zone_code string, setback_m double, max_height_m double")
    o = spark.createDataFrame([(1, rect(0.0, 0.0, 20.0, 10.0), "x", 7.0), (2, rect(5.0, 5.0, 9.0, 9.0), "y", 6.0)], f"zone_id long, ring {PATH}, label string, limit_m double")
    row = zones.envelope(s, regs, geom.with_bbox(o, "ring"), site_id="site").first()
    assert (row.footprint_area_m2, row.max_height_m, row.height_limit_source) == (0.0, 6.0, "y")


class _Calls:
    """A handle with one value that counts its round trips."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def __getattr__(self, name):
        def call(*a):
            self.calls.append(name)
            if name == "getValueState":
                return self
            if name in ("get", "exists"):
                return self.value if name == "get" else self.value is not None
            if name == "listTimers":
                return iter(sorted(self.timers))
            if name == "update":
                self.value = a[0]
            else:
                {"registerTimer": self.timers.add, "deleteTimer": self.timers.remove}[name](*a)
        return call


def test_reminder_asks_its_state_once_and_lists_no_timers():
    day, h = 86_400_000, _Calls()
    p = stateful._Reminders(30)
    p.init(h)
    step = lambda no, status, sent: list(p.handleInputRows((1,), iter([{"no": no, "sent_ms": sent, "status": status}]), None))
    step(0, rules.TU_SENT, 5 * day)
    assert h.timers == {35 * day + 1}
    step(2, rules.TU_SENT, 7 * day)
    assert h.timers == {37 * day + 1}
    step(1, rules.TU_RECEIVED, 5 * day)
    assert h.timers == {37 * day + 1} and h.value[0] == 2
    step(3, rules.TU_RECEIVED, 7 * day)
    assert h.timers == set() and h.calls.count("get") == 4 and not {"exists", "listTimers"} & set(h.calls)


def test_overlaps_of_rectangles_need_no_kernel(spark, monkeypatch):
    rnd = random.Random(3)
    b, z = shapes(rnd, 20, 60, 30), shapes(rnd, 15, 60, 50)
    rows = lambda rings, name: spark.createDataFrame(list(enumerate(rings)), f"{name} long, {'z' if name == 'zid' else ''}ring {PATH}")
    got = {(r.bid, r.zid): r.overlap_m2 for r in siting.zone_overlaps(rows(b, "bid"), rows(z, "zid"), "bid").collect()}
    meets = rows(b, "bid").crossJoin(rows(z, "zid")).where(geom.areas_intersect(F.col("ring"), F.col("zring"))).collect()
    assert got.keys() == {(r.bid, r.zid) for r in meets}
    for r in meets:
        assert got[r.bid, r.zid] == pytest.approx(overlap_area(open_ring(r.ring), open_ring(r.zring)), abs=1e-9)

    def forbidden(p: pd.Series, q: pd.Series) -> pd.Series:
        raise AssertionError("rectangles went to the kernel")

    monkeypatch.setattr(siting.kernels, "overlap_area_udf", pandas_udf(forbidden, "double"))
    plain = lambda rings: [r for r in rings if r and len(r) == 5]
    assert siting.zone_overlaps(rows(plain(b), "bid"), rows(plain(z), "zid"), "bid").count() > 5


def test_sight_lines_out_of_obstacles_are_not_drawn(spark, monkeypatch):
    o = spark.createDataFrame([(rect(-5.0 - i, -5.0, 5.0, 5.0 + i),) for i in range(30)], f"oring {PATH}")
    t = spark.createDataFrame([(1, 0.0, 0.0)], "target_id long, tx double, ty double")
    w = spark.createDataFrame([(i, [(-100.0, float(i)), (100.0, float(i))]) for i in range(-3, 4)], f"walk_id long, path {PATH}")
    drawn, pairs = [], siting.box_pairs
    monkeypatch.setattr(siting, "box_pairs", lambda l, *a, **k: (drawn.append(l.count()), pairs(l, *a, **k))[1])
    assert siting.view_points(t, w, o, "target_id", "walk_id").count() == 7  # the sample at x = 0 of each walk
    assert drawn == [7]
