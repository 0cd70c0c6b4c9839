"""Feeds: keyed upserts, windows over job events and samples, notices; those with state of their own are in ``stateful``.

Sinks are idempotent: a micro-batch writes its own folder, so a repeated batch overwrites itself.
Readers take the latest state per key. Checkpoints and tables live in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.streaming.sinks import copied, event_time, keyed_state, read_changes, read_latest, run_available, write_batch
from sitewright.streaming.stateful import alerts, reminders, zone_versions

__all__ = [
    "alerts", "completion_notices", "event_time", "keyed_state", "latest_versions", "parse_samples", "peak_windows", "read_changes", "read_latest", "reminders", "run_available",
    "step_windows", "write_batch", "zone_versions",
]


# --- versioned objects ------------------------------------------------------------------------


def latest_versions(changes: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Newest version per key; an older change never replaces a newer one, in whatever order they come."""
    rest = [c for c in changes.columns if c not in key and c != version]
    g = changes.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_b"))
    return g.select(*key, "_b.*")


# --- job events and samples -------------------------------------------------------------------


def step_windows(events: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Throughput per tumbling window and event type; rows later than the watermark are dropped."""
    w = event_time(events, ts).withWatermark(ts, delay)
    g = w.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    return g.select(F.unix_micros("window.start").alias("window_us"), "event_type", "n", "max_value", "min_value")


def parse_samples(lines: DataFrame, col: str = "value") -> DataFrame:
    """``timestamp_unix,rss_kb`` lines; anything that is not two numbers is skipped."""
    p = F.split(col, ",")
    rows = lines.where(F.size(p) == 2).select(
        F.timestamp_seconds(F.get(p, F.lit(0)).try_cast("double")).alias("ts"), F.get(p, F.lit(1)).try_cast("bigint").alias("rss_kb"),
    )
    return rows.where(F.col("ts").isNotNull() & F.col("rss_kb").isNotNull())


def peak_windows(samples: DataFrame, width: str = "1 minute", slide: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    g = samples.withWatermark("ts", delay).groupBy(F.window("ts", width, slide)).agg(F.max("rss_kb").alias("peak_rss_kb"))
    return g.select(F.unix_micros("window.start").alias("window_us"), "peak_rss_kb")


def completion_notices(events: DataFrame, *, path: str, checkpoint: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """One notice per job and terminal status: repeats inside the watermark are dropped in flight, later
    ones fall on the same key of the sink."""
    spark = events.sparkSession
    d = event_time(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["job_id", "status"]).select("job_id", "status")
    schema = copied(d.schema)
    run_available(d, checkpoint, write_batch(path), mode="append")
    return read_latest(spark, path, ["job_id", "status"], schema)
