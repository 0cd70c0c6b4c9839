"""Feeds with keyed state over several micro-batches, against the batch forms on the same rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.operators import jobs, zones
from sitewright.sources.tables import fresh_path
from sitewright.streaming import feeds, stateful


def as_stream(spark, slices, schema):
    """One file per slice, read one by one in this order."""
    folder = fresh_path(spark, "slices")
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return feeds.read_changes(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)


def places(spark):
    base = fresh_path(spark, "feed")
    return {"path": base + "/table", "checkpoint": base + "/checkpoint"}


ZONES = "registry_number string, load_seq long, zone_type string"


@pytest.mark.parametrize("shuffled", [False, True])
def test_zone_versions_equal_batch_versions(spark, shuffled):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c", "d"]), i, rng.choice(["x", "y"])) for i in range(200)]
    sent = rows[:]
    if shuffled:
        rng.shuffle(sent)
    slices = [sent[i : i + 50] for i in range(0, 200, 50)] + [sent[10:20]]  # the last slice comes again
    got = stateful.zone_versions(as_stream(spark, slices, ZONES), carry=["zone_type"], **places(spark))
    want = zones.versions(spark.createDataFrame(rows, ZONES))
    pick = lambda df, key: sorted(map(tuple, df.select(key, "load_seq", "version", "superseded_by", "zone_type").collect()))
    assert pick(got, "zone_key") == pick(want.withColumn("k", F.coalesce("registry_number", F.concat(F.lit("#"), F.col("load_seq").cast("string")))), "k")
    # the history of W08 comes from the same rows
    h = zones.history(got.where("zone_key not like '#%'").withColumnRenamed("zone_key", "registry_number"))
    assert h.where("changed").count() == zones.history(want).where("changed").count() > 0


def test_zone_state_is_bounded_and_late_loads_stay(spark):
    slices = [[("a", i, "x") for i in range(100 * k + 50, 100 * k + 100)] for k in range(3)] + [[("a", 3, "late"), ("a", 299, "x"), ("a", 260, "late"), ("a", 1000, "new")]]
    got = {r["load_seq"]: (r["version"], r["superseded_by"], r["zone_type"]) for r in stateful.zone_versions(as_stream(spark, slices, ZONES), carry=["zone_type"], remember=45, **places(spark)).collect()}
    assert len(got) == 152 and got[1000] == (151, None, "new") and got[299] == (150, 1000, "x")
    assert got[3] == (None, 255, "late")  # behind all that is remembered
    assert got[50] == (1, 51, "x") and got[199] == (100, 250, "x")


SAMPLES = "job_id long, ts timestamp, bad boolean"


def test_alerts_equal_batch_over_shuffled_slices_with_late_rows(spark):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(j, start + datetime.timedelta(minutes=10 * k + j), rng.random() < 0.8) for j in range(12) for k in range(200) if k < 100 or j < 10]
    rows += [(3, start + datetime.timedelta(minutes=13), False)] * 2  # the same instant again
    hours = lambda r: (r[1] - start).total_seconds() / 3600
    jittered = sorted(rows, key=lambda r: hours(r) + rng.random() * 2)  # up to two hours late
    n = len(rows)
    slices = [jittered[i * n // 6 : (i + 1) * n // 6] for i in range(6)]
    stream = as_stream(spark, slices, SAMPLES)
    at = places(spark)
    got = stateful.alerts(stream, key="job_id", ts="ts", bad="bad", hold_s=3000, lateness_s=3 * 3600, **at)
    want = jobs.held_alerts(spark.createDataFrame(rows, SAMPLES), key="job_id", ts="ts", bad="bad", hold_s=3000)
    pick = lambda df: sorted(map(tuple, df.select("job_id", "t0", "t1", "n_samples").collect()))
    assert pick(got) == pick(want) != []
    # most runs are final long before the end, and two keys that fell silent were settled by their timers
    table = spark.read.parquet(at["path"])
    assert table.where("final").count() > 0.8 * len(pick(want))
    assert table.where("final and job_id >= 10").count() == len([r for r in pick(want) if r[0] >= 10])
    # one view row a key and call: state is written once for each key that a batch or a timer touches
    per = table.where("not final").groupBy("batch", "job_id").count().agg(F.max("count")).first()[0]
    assert per <= 2


def test_too_late_samples_are_dropped(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    slices = [[(1, t(0), True), (1, t(2), True)], [(2, t(50), False)], [(2, t(51), False)], [(1, t(1), False)]]
    got = stateful.alerts(as_stream(spark, slices, SAMPLES), key="job_id", ts="ts", bad="bad", hold_s=3600, lateness_s=3600, **places(spark)).collect()
    assert [(r["job_id"], r["n_samples"]) for r in got] == [(1, 2)]


REQUESTS = "id long, status string, sent_at date, event_no int"


def test_reminders_fire_by_their_own_timers(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    s, other = rules.TU_SENT, rules.TU_RECEIVED
    slices = [
        [(1, s, day(0), 0), (2, s, day(0), 0), (3, s, day(1), 0), (2, other, day(0), 1)],
        [(4, s, day(20), 0), (3, s, day(1), 0)],
        [(5, s, day(30), 0), (5, other, day(30), 1)],
        [(6, s, day(31), 0)],
    ]
    at = places(spark)
    got = stateful.reminders(as_stream(spark, slices, REQUESTS), days=30, **at).collect()
    # 1 was due on day 30 and is late from day 31 on; 3 is due on day 31; nobody sent a row of 1 since
    assert sorted((r["id"], r["sent_at"]) for r in got) == [(1, day(0))]
    more = stateful.reminders(as_stream(spark, [*slices, [(7, s, day(90), 0)]], REQUESTS), days=30, **places(spark)).collect()
    assert sorted(r["id"] for r in more) == [1, 3, 4, 6]


def test_empty_streams(spark):
    assert stateful.zone_versions(as_stream(spark, [[]], ZONES), **places(spark)).count() == 0
    assert stateful.alerts(as_stream(spark, [[]], SAMPLES), key="job_id", ts="ts", bad="bad", hold_s=1, **places(spark)).count() == 0
    assert stateful.reminders(as_stream(spark, [[]], REQUESTS), days=30, **places(spark)).count() == 0


def test_runs_cover_all_batches_with_few_folders():
    from sitewright.streaming.runs import covering

    for n in range(300):
        held, at = covering(n), -1
        for level, upto in held:
            assert at + 4**level == upto
            at = upto
        assert at == n - 1 and len(held) <= 3 * 5


def test_run_merges_equal_batch_after_fifty_batches(spark):
    from sitewright.streaming import runs

    rng, path = random.Random(6), fresh_path(spark, "runs")
    schema = spark.createDataFrame([], "id long, version long, v string").schema
    put = runs.write_runs(path, ["id"], "version")
    rows = []
    for b in range(50):
        batch = [(rng.choice([None, *range(30)]), rng.randint(0, 400), f"{b}") for _ in range(20)]
        rows += batch
        put(spark.createDataFrame(batch, schema).coalesce(1), b)
        if b == 20:
            put(spark.createDataFrame(batch, schema).coalesce(1), b)  # a batch that is repeated
    got = runs.read_runs(spark, path, ["id"], "version", schema)
    want = {}
    for r in rows:
        want[r[0]] = max(want.get(r[0], r[1:]), r[1:])
    assert {r["id"]: (r["version"], r["v"]) for r in got.collect()} == want
    opened = {f.rsplit("/", 2)[-3:-1][0] + "/" + f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert runs.batches_written(spark, path) == 50 and len(opened) == len(runs.covering(50)) == 5
    assert runs.read_runs(spark, path + "/none", ["id"], "version", schema).count() == 0


EVENTS = "event_id long, job_id long, ts timestamp, event_type string, value double"


def sliced_events(late_minutes: int, too_late: bool):
    """Five slices in time order with rows up to ``late_minutes`` late, and where asked for one far behind the watermark at the end."""
    rng, start = random.Random(11), datetime.datetime(2024, 3, 1)
    rows = [(i, i % 7, start + datetime.timedelta(minutes=4 * i + rng.random()), rng.choice(["a", "b"]), float(rng.randint(0, 99))) for i in range(300)]
    sent = sorted(rows, key=lambda r: r[2] + datetime.timedelta(minutes=rng.random() * late_minutes))
    slices = [sent[i * 60 : (i + 1) * 60] for i in range(5)]
    if too_late:
        slices.append([(999, 1, start, "a", 1e6)])
    return rows, slices


@pytest.mark.parametrize("too_late", [False, True])
def test_step_windows_over_micro_batches_with_late_rows(spark, too_late):
    rows, slices = sliced_events(9, too_late)
    at = places(spark)
    got = feeds.keyed_state(feeds.step_windows(as_stream(spark, slices, EVENTS)), ["window_us", "event_type"], at["path"], at["checkpoint"])
    df = spark.createDataFrame(rows, EVENTS)
    want = df.groupBy(F.unix_micros(F.date_trunc("hour", "ts")).alias("window_us"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    pick = lambda x: sorted(map(tuple, x.select("window_us", "event_type", "n", "max_value", "min_value").collect()))
    assert pick(got) == pick(want)  # late rows are in, the one behind the watermark is not
    assert spark.read.parquet(at["path"]).select("batch").distinct().count() >= 5


def test_peak_windows_over_micro_batches_with_late_rows(spark):
    rows, slices = sliced_events(9, True)
    samples = [[(f"{r[2].replace(tzinfo=datetime.timezone.utc).timestamp():.3f},{int(r[4])}",) for r in s] + [("broken",), ("1,x",), ("1,2,3",)] for s in slices]
    at = places(spark)
    w = feeds.peak_windows(feeds.parse_samples(as_stream(spark, samples, "value string")), "1 hour", "30 minutes")
    got = {r["window_us"]: r["peak_rss_kb"] for r in feeds.keyed_state(w, ["window_us"], at["path"], at["checkpoint"]).collect()}
    want = {}
    for r in rows:
        t = int(r[2].replace(tzinfo=datetime.timezone.utc).timestamp() // 1800) * 1800
        for s in (t, t - 1800):
            want[s * 1_000_000] = max(want.get(s * 1_000_000, 0), int(r[4]))
    assert got == want


def test_completion_notices_once_over_micro_batches(spark):
    rows, slices = sliced_events(9, False)
    kind = {"a": "done", "b": "failed"}
    again = [[(r[1], kind[r[3]], r[2]) for r in s] for s in slices] + [[(slices[0][0][1], kind[slices[0][0][3]], slices[4][-1][2])]]
    got = feeds.completion_notices(as_stream(spark, again, "job_id long, status string, ts timestamp"), **places(spark)).collect()
    assert len(got) == len({(r["job_id"], r["status"]) for r in got})
    assert {(r["job_id"], r["status"]) for r in got} == {(r[1], kind[r[3]]) for r in rows}
