"""Job steps, resource samples, request deadlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import crs
from sitewright.operators.chunks import sequenced
from sitewright.operators.spatial import salted_join


def expand_jobs(jobs: DataFrame, step_names: Sequence[str] = rules.STEP_NAMES) -> DataFrame:
    """One pending row per step for valid jobs; a bad radius or region gives one reject row."""
    lo, hi = rules.RADIUS_LIMITS_M
    reason = F.when(~F.col("radius_m").between(lo, hi) | F.col("radius_m").isNull(), "radius out of range").when(
        crs.pick_zone(F.col("lon")).isNull(), "outside supported region"
    )
    j = jobs.withColumn("reject_reason", reason)
    steps = F.when(F.col("reject_reason").isNull(), F.array(*map(F.lit, step_names)))
    out = j.select("job_id", "reject_reason", F.posexplode_outer(steps).alias("step_order", "step_name"))
    return out.withColumn("status", F.when(F.col("step_order").isNotNull(), "pending"))


def job_status(steps: DataFrame, order: str = "step_order") -> DataFrame:
    """failed beats done beats running beats pending; first error by step order."""
    s = F.col("status")
    err = F.when(s == "failed", F.col("error_message"))
    return steps.groupBy("job_id").agg(
        F.when(F.bool_or(s == "failed"), "failed").when(F.bool_and(s == "done"), "done")
        .when(F.bool_or(s != "pending"), "running").otherwise("pending").alias("job_status"),
        F.min_by(err, F.when(s == "failed", F.col(order))).alias("first_error"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def next_step(steps: DataFrame, order: str = "step_order") -> DataFrame:
    """First step not done, unless the job is failed or done; the failed step a retry would reset."""
    open_order = F.when(F.col("status") != "done", F.col(order))
    failed_order = F.when(F.col("status") == "failed", F.col(order))
    g = steps.groupBy("job_id").agg(
        F.min(open_order).alias("_open"), F.min(failed_order).alias("retry_order"),
    )
    return g.select(
        "job_id", F.when(F.col("retry_order").isNull(), F.col("_open")).alias("next_order"), "retry_order"
    )


def retried(steps: DataFrame, order: str = "step_order") -> DataFrame:
    """Steps with only the first failed one set back to pending."""
    first = next_step(steps, order).select("job_id", "retry_order")
    s = salted_join(steps, first, ["job_id"], ["job_id", order], how="left")
    reset = F.col(order) == F.col("retry_order")
    return s.withColumns({
        "status": F.when(reset, "pending").otherwise(F.col("status")),
        "error_message": F.when(reset, None).otherwise(F.col("error_message")),
    }).drop("retry_order")


def listing(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Jobs newest first with their steps in order: one join instead of a query per job, one row per step."""
    rows = salted_join(steps, jobs, ["job_id"], ["job_id", "step_order"])
    return rows.orderBy(F.col("created_at").desc(), "job_id", "step_order")


def peak_in_steps(samples: DataFrame, steps: DataFrame, *, key: Sequence[str] = ("job_id",), ts: str = "ts", bucket_s: int = 3600) -> DataFrame:
    """Largest sample inside each step's closed [start, end]; steps without samples keep null.

    Samples shrink to one maximum per (key, second) first. Time buckets turn the interval test into
    an equi-join; an interval longer than two buckets is answered from the per-bucket maxima for its
    inner buckets, so a long step does not pair with every sample it spans.
    """
    key = list(key)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    b = bucket_s * 1_000_000
    s = samples.select(*key, us(ts).alias("_t"), "rss_kb").groupBy(*key, "_t").agg(F.max("rss_kb").alias("rss_kb"))
    s = s.withColumn("_b", F.floor(F.col("_t") / b).cast("bigint"))
    per_bucket = s.groupBy(*key, "_b").agg(F.max("rss_kb").alias("rss_kb"))
    i = steps.where(F.col("started_at").isNotNull()).select(*key, "step_id", us("started_at").alias("_a"), us("ended_at").alias("_e"))
    i = i.withColumns({"_ba": F.floor(F.col("_a") / b).cast("bigint"), "_be": F.floor(F.col("_e") / b).cast("bigint")})
    ends = i.withColumn("_b", F.explode(F.array_distinct(F.array("_ba", "_be"))))
    edge = salted_join(s, ends, [*key, "_b"], [*key, "_t"]).where(F.col("_t").between(F.col("_a"), F.col("_e")))
    edge = edge.groupBy("step_id").agg(F.max("rss_kb").alias("peak"))
    middle = i.where(F.col("_be") - F.col("_ba") >= 2).withColumn("_b", F.explode(F.sequence(F.col("_ba") + 1, F.col("_be") - 1)))
    inner = middle.join(per_bucket, [*key, "_b"]).groupBy("step_id").agg(F.max("rss_kb").alias("peak"))
    peaks = edge.unionByName(inner).groupBy("step_id").agg(F.max("peak").alias("peak_rss_kb"))
    return steps.join(peaks, "step_id", "left")


def with_deadline(requests: DataFrame, days: int = rules.TU_DEADLINE_DAYS) -> DataFrame:
    return requests.withColumn("deadline", F.date_add("sent_at", days))


def overdue(requests: DataFrame, as_of) -> DataFrame:
    """Sent requests past their deadline; the deadline day itself is not overdue."""
    late = (F.col("status") == rules.TU_SENT) & (F.col("deadline") < as_of)
    return requests.withColumn("status", F.when(late, rules.TU_OVERDUE).otherwise(F.col("status")))


def with_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Latest response per request turns it into received."""
    last = responses.groupBy("id").agg(F.max(F.struct("received_at", "incoming_number")).alias("_r"))
    out = requests.join(last, "id", "left")
    return out.withColumns({
        "status": F.when(F.col("_r").isNotNull(), rules.TU_RECEIVED).otherwise(F.col("status")),
        "received_at": F.col("_r.received_at"), "incoming_number": F.col("_r.incoming_number"),
    }).drop("_r")


def bad_runs(samples: DataFrame, key: str, chunk_s: int = 86_400) -> DataFrame:
    """Runs of consecutive bad samples (gaps and islands): key, t0, t1, n_samples. samples: key, t (us), bad, n.

    Islands are built per (key, time chunk). A run inside its chunk is complete; only the first and
    last run of a chunk can go on across the border, so merging sees at most two rows per chunk.
    """
    s = samples.groupBy(key, "t").agg(F.bool_or("bad").alias("bad"), F.sum("n").alias("n"))
    s = s.withColumn("ck", F.floor(F.col("t") / (chunk_s * 1_000_000)).cast("bigint"))
    w = Window.partitionBy(key, "ck").orderBy("t")
    marked = s.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    runs = marked.groupBy(key, "ck", "run").agg(
        F.min(F.when(F.col("bad"), F.col("t"))).alias("t0"), F.max(F.when(F.col("bad"), F.col("t"))).alias("t1"),
        F.bool_or(~F.col("bad")).alias("starts_good"), F.sum(F.when(F.col("bad"), F.col("n"))).alias("n_samples"),
    )
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy(key, "ck")))
    open_run = (F.col("run") == 0) | (F.col("run") == F.col("last"))
    inner = runs.where(~open_run).select(key, "t0", "t1", "n_samples")
    over = Window.partitionBy(key).orderBy("ck", "run")
    border = runs.where(open_run).withColumn("island", F.sum(F.when(F.col("starts_good"), 1).otherwise(0)).over(over))
    merged = border.groupBy(key, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n_samples").alias("n_samples"))
    return inner.unionByName(merged.drop("island")).where(F.col("t0").isNotNull())


def held_alerts(states: DataFrame, *, key: str, ts: str, bad: str, hold_s: int) -> DataFrame:
    """Bad runs lasting at least ``hold_s`` seconds."""
    s = states.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(bad).alias("bad"), F.lit(1).cast("bigint").alias("n"))
    return bad_runs(s, key).where((F.col("t1") - F.col("t0")) >= hold_s * 1_000_000)


def ordered_steps(events: DataFrame, key: str, ts: str, event_id: str, chunk_s: int = 86_400) -> DataFrame:
    """step_order and the next event's time as finish, without a window over a whole key."""
    chunk = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / float(chunk_s))
    return sequenced(events, [key], [ts, event_id], chunk, number="step_order", following={"finished_at": ts})
