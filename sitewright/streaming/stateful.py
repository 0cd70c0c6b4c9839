"""Feeds with keyed state and timers: zone versions with their history, alerts with hold time, overdue reminders.

State lives in the state store (RocksDB, checkpointed to the shared folder), one small value per key; requests, of which very many come
and go one event at a time, are a table of merged runs (``runs``). Results go to batch folders, so a repeated batch overwrites itself;
readers take the newest row per result key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitewright import rules
from sitewright.streaming import runs
from sitewright.streaming.sinks import batch_folder, event_time, read_latest, run_available, write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of any kind needs this store; it also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


# --- zone versions ----------------------------------------------------------------------------


class _Versions(StatefulProcessor):
    """Newest ``remember`` versions of one registry number in load order, in a list state."""

    def __init__(self, seq: str, carry: Sequence[str], carry_schema: T.StructType, remember: int) -> None:
        self.seq, self.carry, self.schema, self.remember = seq, list(carry), carry_schema, remember

    def _row(self, key, seq, version, superseded_by, loaded, rest) -> Row:
        return Row(zone_key=key, version=version, superseded_by=superseded_by, loaded=loaded, **{self.seq: seq}, **dict(zip(self.carry, rest, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = [tuple(r) for r in self.known.get()] if self.known.exists() else []  # (load_seq, version, carried ...), by load_seq
        held = {r[0]: r for r in old}
        base = old[0][1] if old else 1
        seqs, fresh, behind = [r[0] for r in old], {}, []
        for r in rows:
            s = r[self.seq]
            if s in held or s in fresh:
                continue  # a load that comes again
            if base > 1 and s < seqs[0]:
                behind.append((s, *[r[c] for c in self.carry]))
                continue
            fresh[s] = (s, None, *[r[c] for c in self.carry])
            bisect.insort(seqs, s)
        now = [(s, base + i, *(fresh.get(s) or held[s])[2:]) for i, s in enumerate(seqs)]
        following = {s: n for s, n in zip(seqs, seqs[1:])}
        before = {r[0]: (r[1], n[0] if n else None) for r, n in zip(old, [*old[1:], None])}
        for s, version, *rest in now:
            if before.get(s) != (version, following.get(s)):
                yield self._row(key[0], s, version, following.get(s), s in fresh, rest)
        for s, *rest in behind:  # older than all that is remembered: superseded on arrival, its number is not known
            yield self._row(key[0], s, None, seqs[0], True, rest)
        if fresh:
            kept = now[-self.remember :]
            self.known.put(kept)

    def close(self) -> None:
        pass


def zone_versions(
    zones: DataFrame, *, path: str, checkpoint: str, number: str = "registry_number", seq: str = "load_seq", carry: Sequence[str] = (), remember: int = 64,
) -> DataFrame:
    """Current and superseded versions per registry number, kept up as zones arrive: (zone_key, seq, version, superseded_by, carry ...).

    The newest load of a number closes the one before; versions count from 1 in load order. Loads may come out of order: the rows
    behind one that comes late are numbered anew, as far back as the newest ``remember`` versions, which is all that a number's state
    holds. A load older than that is returned closed, with a null version. A load that comes again changes nothing. (State that expires by
    itself would need processing time, with which a run over what is there never ends.) Zones without a number never version and touch no state.
    """
    spark = zones.sparkSession
    use_rocksdb(spark)
    kind = zones.schema
    out = T.StructType([
        T.StructField("zone_key", T.StringType()), T.StructField(seq, kind[seq].dataType), T.StructField("version", T.LongType()), T.StructField("superseded_by", kind[seq].dataType),
        T.StructField("loaded", T.BooleanType()), *[T.StructField(c, kind[c].dataType) for c in carry],
    ])
    held = T.StructType([T.StructField(seq, kind[seq].dataType), T.StructField("version", T.LongType()), *[T.StructField(c, kind[c].dataType) for c in carry]])
    numbered = zones.where(F.col(number).isNotNull()).withColumn("zone_key", F.col(number).cast("string"))
    numbered = numbered.groupBy("zone_key").transformWithState(_Versions(seq, carry, held, remember), out, "Update", "None")
    alone = zones.where(F.col(number).isNull()).select(
        F.concat(F.lit("#"), F.col(seq).cast("string")).alias("zone_key"), seq, F.lit(1).cast("bigint").alias("version"), F.lit(None).cast(kind[seq].dataType).alias("superseded_by"),
        F.lit(True).alias("loaded"), *carry,
    )
    run_available(numbered.unionByName(alone), checkpoint, write_batch(path), mode="update")
    rows = spark.read.schema(T.StructType([*out.fields, T.StructField("batch", T.LongType())])).parquet(path)
    # what a row carries comes from the batch that brought it; its number and end from the newest one
    newest = F.struct("batch", "version", "superseded_by")
    told = rows.groupBy("zone_key", seq).agg(F.max(newest).alias("n"), *[F.max(F.when(F.col("loaded"), F.struct("batch", c))).alias(f"c_{c}") for c in carry])
    return told.select("zone_key", seq, "n.version", "n.superseded_by", *[F.col(f"c_{c}.{c}").alias(c) for c in carry])


# --- alerts with hold time --------------------------------------------------------------------

_RUN = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("t0", "t1", "n")],
    T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("bads", T.ArrayType(T.BooleanType())), T.StructField("ns", T.ArrayType(T.LongType())),
])


def settle(run: tuple | None, samples: Iterable[tuple[int, bool, int]]) -> tuple[list[tuple], tuple | None]:
    """Runs that end within time-ordered (t, bad, n) samples, and the one that goes on; ``run``: (t0, t1, n) so far."""
    ended = []
    for t, bad, n in samples:
        if bad:
            run = (run[0], t, run[2] + n) if run else (t, t, n)
        elif run:
            ended.append(run)
            run = None
    return ended, run


class _Alerts(StatefulProcessor):
    """One value per key: the run that goes on, and the samples the watermark has not passed yet, in time order. A timer stands at the first of these."""

    def __init__(self, key: str, hold_us: int) -> None:
        self.key, self.hold = key, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _RUN)

    def _row(self, key, final: bool, runs: list[tuple]) -> Row:
        return Row(final=final, runs=[Row(t0=a, t1=b, n_samples=n) for a, b, n in runs], **{self.key: key})

    def _step(self, key, fresh: list[tuple], watermark_us: int) -> Iterator[Row]:
        s = self.state.get() if self.state.exists() else None
        run = tuple(s[:3]) if s and s[0] is not None else None
        waiting: dict[int, tuple[bool, int]] = {}
        for t, bad, n in [*(zip(*s[3:]) if s else ()), *fresh]:
            was = waiting.get(t, (False, 0))
            waiting[t] = (was[0] or bad, was[1] + n)
        rows = [(t, *waiting[t]) for t in sorted(waiting)]
        done = bisect.bisect_right([r[0] for r in rows], watermark_us)
        ended, run = settle(run, rows[:done])
        left = rows[done:]
        for r in ended:
            if r[1] - r[0] >= self.hold:
                yield self._row(key, True, [r])
        open_, last = settle(run, left)
        view = [r for r in [*open_, *([last] if last else [])] if r[1] - r[0] >= self.hold]
        yield self._row(key, False, view)
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        if left or run:
            self.state.update((*(run or (None,) * 3), [r[0] for r in left], [r[1] for r in left], [r[2] for r in left]))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._step(key[0], [(r["t"], r["bad"], 1) for r in rows], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._step(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def alerts(states: DataFrame, *, key: str, ts: str, bad: str, hold_s: int, path: str, checkpoint: str, lateness_s: int = 3600) -> DataFrame:
    """Runs of bad samples of at least ``hold_s``: (key, t0, t1, n_samples), the same as over all samples at once.

    A sample may come up to ``lateness_s`` behind the newest one of any key; older ones are dropped by the watermark. Samples wait in their key's
    state until the watermark passes them, then join its run and are forgotten, so a key's state is a run and the samples of ``lateness_s``.
    A timer settles what waits even where no sample of that key comes any more. A batch writes one value for each key it touches. A run that has ended
    is final; what is still open is the view of the key's newest batch.
    """
    spark = states.sparkSession
    use_rocksdb(spark)
    kind = states.schema[key].dataType
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("t0", "t1", "n_samples")])
    out = T.StructType([T.StructField(key, kind), T.StructField("final", T.BooleanType()), T.StructField("runs", T.ArrayType(run))])
    s = event_time(states, ts).where(F.col(ts).isNotNull()).withWatermark(ts, f"{lateness_s} seconds")
    s = s.select(key, ts, F.unix_micros(ts).alias("t"), F.coalesce(F.col(bad), F.lit(False)).alias("bad"))
    told = s.groupBy(key).transformWithState(_Alerts(key, hold_s * 1_000_000), out, "Update", "EventTime")
    run_available(told, checkpoint, write_batch(path), mode="update")
    rows = spark.read.schema(T.StructType([*out.fields, T.StructField("batch", T.LongType())])).parquet(path)
    final = rows.where("final").select(key, F.explode("runs").alias("r"))
    view = rows.where("not final").groupBy(key).agg(F.max(F.struct("batch", "runs")).alias("v")).select(key, F.explode("v.runs").alias("r"))
    return final.unionByName(view).select(key, "r.t0", "r.t1", "r.n_samples")


# --- overdue reminders ------------------------------------------------------------------------


class _Reminders(StatefulProcessor):
    """The rule for one request, event by event: it waits for its answer, with a timer behind its deadline. An answer or the reminder clears both.

    ``reminders`` follows it for all requests at once."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", _longs("no", "sent_ms", "open"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self.state.get()
        last = max(((r["no"], r["sent_ms"], int(r["status"] == rules.TU_SENT)) for r in rows), key=lambda r: r[0])
        if s and s[0] > last[0]:
            return iter(())
        # every call on the handle is a round trip; the timer of an open request is known from its state
        if s and s[2] and s[1] is not None:
            self.handle.deleteTimer(self._due(s[1]))
        self.state.update(last)
        if last[2] and last[1] is not None:
            self.handle.registerTimer(self._due(last[1]))
        return iter(())

    def _due(self, sent_ms: int) -> int:
        return sent_ms + self.days * 86_400_000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        no, sent_ms, open_ = self.state.get()
        self.state.update((no, sent_ms, 0))
        if open_:
            yield Row(id=key[0], sent_ms=sent_ms)

    def close(self) -> None:
        pass


def reminders(events: DataFrame, *, path: str, checkpoint: str, days: int, at: str = "sent_at", order: str = "event_no", delay: str = "1 second") -> DataFrame:
    """One reminder (id, sent_at) per request that is still sent when time passes its deadline.

    ``events``: id, status, sent_at, ``order`` (rises along a request's events) and ``at``, their event time, by which the clock goes: the newest ``at`` of all
    rows less ``delay``. A reminder needs no new row of its request: it comes when the clock passes the deadline. The deadline day
    itself is not overdue. An event that comes after a newer one of its request changes nothing.

    Very many requests wait at a time, so none has a handler of its own: newest events per request are a table of merged runs. A batch
    settles the deadlines between the last clock and its own, over the requests that have one there and those it brings. Clocks are those of
    a watermark: a batch goes by what came before it, the end of the input by all that came, and rows at or behind the clock before are late.
    """
    spark = events.sparkSession
    kind = events.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("sent_ms", T.LongType())])
    e = event_time(events.withColumn("_at", F.col(at)), "_at")
    e = e.select("id", "_at", "status", F.unix_millis(F.col("sent_at").cast("date").cast("timestamp")).alias("sent_ms"), F.col(order).cast("bigint").alias("no"))
    delay_ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL '{delay}'"))).first()[0]
    r = _Requests(spark, path, kind, days, delay_ms)
    run_available(e, checkpoint, r.take, mode="append")
    r.end()
    return read_latest(spark, r.told, ["id"], out).select("id", F.timestamp_millis("sent_ms").cast("date").alias("sent_at"))


class _Requests:
    """Tables of ``reminders`` below one folder: newest events in runs, clocks and reminders by step.

    Batch b is step 2 b, the end of the input after it step 2 b + 1. A step reads only what steps before it wrote, so it may be repeated.
    A clock is (before, now) in milliseconds: deadlines up to ``before`` are settled, ``now`` is for the next step.
    """

    def __init__(self, spark: SparkSession, path: str, kind: T.DataType, days: int, delay_ms: int) -> None:
        self.spark, self.held, self.clocks, self.told = spark, path + "/requests", path + "/clocks", path + "/reminders"
        self.days, self.delay_ms = days, delay_ms
        version = T.StructType([T.StructField("no", T.LongType()), T.StructField("batch", T.LongType())])
        self.schema = T.StructType([T.StructField("id", kind), T.StructField("version", version), T.StructField("sent_ms", T.LongType()), T.StructField("due_ms", T.LongType())])

    def clock(self, step: int) -> tuple[int, int]:
        done = [n for n in runs.written(self.spark, self.clocks, "step") if n < step]
        return tuple(self.spark.read.parquet(f"{self.clocks}/step={max(done)}").select("before", "now").first()) if done else (0, 0)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        before, now = self.clock(2 * batch_id)
        newest = batch.agg(F.max(F.unix_micros("_at"))).first()[0]
        rows = batch.where(F.col("_at").isNull() | (F.unix_micros("_at") > before * 1000))
        due = F.when(F.col("status") == rules.TU_SENT, F.col("sent_ms") + self.days * 86_400_000 + 1)  # null: nothing to wait for
        rows = rows.select("id", F.struct("no", F.lit(batch_id).cast("bigint").alias("batch")).alias("version"), "sent_ms", due.alias("due_ms"))
        runs.write_runs(self.held, ["id"], "version")(rows, batch_id)
        self.settle(2 * batch_id, before, now, now if newest is None else max(now, newest // 1000 - self.delay_ms))

    def end(self) -> None:
        """Reminders that need no further row."""
        n = runs.batches_written(self.spark, self.held)
        before, now = self.clock(2 * n)
        if n and before < now:
            self.settle(2 * n - 1, before, now, now)

    def settle(self, step: int, before: int, now: int, following: int) -> None:
        """The reminders of deadlines from ``before`` on that are behind ``now``, and any that the step's own rows bring."""
        batch, own = divmod(step, 2)
        rows = self.spark.read.schema(self.schema).parquet(*[runs.folder(self.held, *run) for run in runs.covering(batch + 1)])
        fresh = F.lit(own == 0) & (F.col("version.batch") == batch)
        due = (F.col("due_ms") < now) & ((F.col("due_ms") >= before) | fresh)
        asked = rows.where(due).select(F.col("id").alias("_id")).distinct()
        known = runs.newest(rows.join(asked, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), ["id"], "version")
        known.where(due).select("id", "sent_ms").write.mode("overwrite").parquet(batch_folder(self.told, step))
        self.spark.range(1, numPartitions=1).select(F.lit(now).alias("before"), F.lit(following).alias("now")).write.mode("overwrite").parquet(f"{self.clocks}/step={step}")
