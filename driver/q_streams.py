"""Streams run to the end of the available input; the SQL side is the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.registry import query
from driver.views import V
from sitewright import rules
from sitewright.operators import jobs
from sitewright.sources.tables import fresh_path
from sitewright.streaming import feeds, runs


def stream_of(v: V, table: str):
    schema = v.spark.read.parquet(f"{v.dir}/{table}.parquet").schema
    return feeds.read_changes(v.spark, v.dir, schema, glob=f"{table}.parquet")


SLICE_FILE_ROWS = 250_000


def in_slices(df, time, n: int = 4):
    """The rows as a stream of ``n`` slices, one for each stretch of ``time`` (a number), read one by one in this order.

    A slice is as many files as its neighbours, about ``SLICE_FILE_ROWS`` rows each in the smallest, so that all tasks write and read it."""
    folder = fresh_path(df.sparkSession, "slices")
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    lo, width = lo or 0, ((hi or 0) - (lo or 0)) / n or 1
    part = F.least(F.floor((time - lo) / width), F.lit(n - 1))
    rows = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(rows.get(i, 0) for i in range(n)) // SLICE_FILE_ROWS)
    for i in range(n):  # one write after the other, as files are read by their times
        one = df.where(part == i)
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(folder)
    return feeds.read_changes(df.sparkSession, folder, df.schema, files_per_trigger=files)


def places(spark):
    base = fresh_path(spark, "feed")
    return base + "/table", base + "/checkpoint"


@query("r01_latest_object_versions", "SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def r01(spark, d):
    v = V(spark, d)
    table, ck = places(spark)
    changes = v.table("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("kind"), "value")
    # nine micro-batches, in no order of versions: two merged runs and one of its own
    return runs.latest_table(in_slices(changes, F.col("version") * 7 % 9, 9), key=["id"], version="version", path=table, checkpoint=ck)


@query("r02_versioned_zone_feed", """SELECT coalesce(registry_number, '#' || load_seq) AS zone_key, count(*) AS version, max(load_seq) AS load_seq, arg_max(zone_type, load_seq) AS zone_type FROM v_zones GROUP BY 1""")
def r02(spark, d):
    """The versions that are current, of the same feed as below."""
    return zone_feed(spark, d).where("superseded_by is null").select("zone_key", "version", "load_seq", "zone_type")


@query("r02_zone_version_history", """SELECT coalesce(registry_number, '#' || load_seq) AS zone_key, load_seq, CASE WHEN registry_number IS NULL THEN 1 ELSE row_number() OVER w END AS version,
CASE WHEN registry_number IS NOT NULL THEN lead(load_seq) OVER w END AS superseded_by, zone_type FROM v_zones WINDOW w AS (PARTITION BY registry_number ORDER BY load_seq)""")
def r02_history(spark, d):
    """Current and superseded versions, as W02 has them, from four micro-batches."""
    return zone_feed(spark, d).select("zone_key", "load_seq", "version", "superseded_by", "zone_type")


def zone_feed(spark, d):
    z = V(spark, d).zones().select("registry_number", "load_seq", "zone_type")
    table, ck = places(spark)
    return feeds.zone_versions(in_slices(z, F.col("load_seq")), path=table, checkpoint=ck, carry=["zone_type"])


@query("r03_step_windows", """SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type, count(*) AS n, max(value) AS max_value, min(value) AS min_value FROM events GROUP BY 1, 2""")
def r03(spark, d):
    table, ck = places(spark)
    return feeds.keyed_state(feeds.step_windows(stream_of(V(spark, d), "events")), ["window_us", "event_type"], table, ck)


@query("r04_peak_windows", """WITH s AS (SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, CAST(floor(value * 1024) AS BIGINT) AS rss FROM events WHERE event_id % 11 > 0), w AS (SELECT (t // 1800) * 1800 - k * 1800 AS st, rss FROM s, range(0, 2) x(k))
SELECT st * 1000000 AS window_us, max(rss) AS peak_rss_kb FROM w GROUP BY st""")
def r04(spark, d):
    """Samples as text lines, every eleventh one broken."""
    table, ck = places(spark)
    e = stream_of(V(spark, d), "events")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string")
    rss = F.floor(F.col("value") * 1024).cast("bigint").cast("string")
    line = F.when(F.col("event_id") % 22 == 0, F.concat_ws(",", sec, rss, F.lit("x"))).when(F.col("event_id") % 11 == 0, F.lit("broken")).otherwise(F.concat_ws(",", sec, rss))
    w = feeds.peak_windows(feeds.parse_samples(e.select(line.alias("value"))), "1 hour", "30 minutes")
    return feeds.keyed_state(w, ["window_us"], table, ck)


RUNS = """b AS (SELECT user_id AS job_id, epoch_us(ts) AS t, bool_or(event_type IN ('error', 'click', 'view')) AS bad FROM events GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t) AS run FROM b), u AS (SELECT job_id, run, min(t) AS t0, max(t) AS t1, count(*) AS n_samples FROM g WHERE bad GROUP BY job_id, run)"""


def down(df):
    return df.select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").isin("error", "click", "view").alias("bad"))


@query("r05_alerts_with_hold", f"WITH {RUNS} SELECT job_id, t0, t1, n_samples FROM u WHERE t1 - t0 >= 7200::BIGINT * 1000000")
def r05(spark, d):
    """Two hours stand for the two minutes of the rule: samples are hours apart here. Four micro-batches, with rows up to two hours late."""
    table, ck = places(spark)
    e = V(spark, d).table("events").select("event_id", "user_id", "ts", "event_type")
    late = in_slices(e, F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 3 * 3600)
    return feeds.alerts(down(late), key="job_id", ts="ts", bad="bad", hold_s=7200, lateness_s=3 * 3600, path=table, checkpoint=ck)


@query("r05_alerts_batch_twin", f"WITH {RUNS} SELECT job_id, t0, t1, n_samples FROM u WHERE t1 - t0 >= 7200::BIGINT * 1000000")
def r05_batch(spark, d):
    return jobs.held_alerts(down(V(spark, d).table("events")), key="job_id", ts="ts", bad="bad", hold_s=7200)


@query("r06_overdue_reminders", """SELECT id, strftime(sent_at, '%Y-%m-%d') AS sent_at FROM v_requests WHERE status = 'отправлен' AND sent_at + INTERVAL 30 DAY < (SELECT max(sent_at) FROM v_requests)""")
def r06(spark, d):
    """Every request is sent first; an answer follows in the same micro-batch. Time goes on over four of them."""
    table, ck = places(spark)
    now = V(spark, d).requests().withColumn("event_no", F.lit(1))
    first = now.withColumns({"status": F.lit(rules.TU_SENT), "event_no": F.lit(0)})
    events = in_slices(now.union(first), F.unix_date("sent_at"))
    r = feeds.reminders(events, path=table, checkpoint=ck, days=rules.TU_DEADLINE_DAYS)
    return r.select("id", F.date_format("sent_at", "yyyy-MM-dd").alias("sent_at"))


@query("r07_completion_notices", "SELECT DISTINCT user_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'done' END AS status FROM events WHERE event_type IN ('error', 'purchase')")
def r07(spark, d):
    table, ck = places(spark)
    e = stream_of(V(spark, d), "events").where(F.col("event_type").isin("error", "purchase"))
    e = e.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "ts")
    return feeds.completion_notices(e, path=table, checkpoint=ck)
