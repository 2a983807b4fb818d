"""Event-time monitors: throttling, sessions, counters, stage metrics, leases, matching, audit.

Every monitor takes a streaming (or batch) frame. ``run_available`` drains a stream into a parquet
folder, one sub-folder per micro-batch, so that a re-run batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provena.operators.listing import keep_latest
from provena.operators.matching import digest_index, indexed_file_match
from provena.session import cut_lineage, shuffle_partitions
from provena.sources import folders
from provena.sources.sinks import committed_parts

THROTTLE_LIMIT, THROTTLE_WINDOW = 5, "300 seconds"
IDLE_SECONDS, ABSOLUTE_SECONDS = 1800, 86400
AUDIT_COLUMNS = ("event_id", "actor_user_id", "action", "target_id", "outcome", "correlation_id", "created_at")
# Stages of the detection telemetry.
STAGES = ("decode", "exact_lookup", "dino_recall", "geometry", "observation", "authentication", "total")


def run_available(frame: DataFrame, folder: str, mode: str = "update", transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Drain what is available now into ``folder``/rows; progress lives in ``folder``/progress."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True
    ).foreachBatch(write).start().awaitTermination()


def latest_rows(spark, folder: str, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return keep_latest(rows, keys, "batch_id").drop("batch_id")


def login_throttle(attempts: DataFrame, limit: int = THROTTLE_LIMIT) -> DataFrame:
    """attempts: ts, username, client_ip. Windows whose account or address count passes the limit."""
    subjects = F.array(
        F.struct(F.lit("account").alias("kind"), F.lower("username").alias("subject")),
        F.struct(F.lit("ip").alias("kind"), F.col("client_ip").alias("subject")),
    )
    counted = (
        attempts.select("ts", F.inline(subjects)).groupBy(F.window("ts", THROTTLE_WINDOW).alias("w"), "kind", "subject")
        .agg(F.count(F.lit(1)).alias("attempts"))
    )
    return counted.where(F.col("attempts") > limit).select(
        F.col("w.start").alias("window_start"), "kind", "subject", "attempts"
    )


def counter_deltas(increments: DataFrame) -> DataFrame:
    """increments: ts, owner_user_id, counter_key, delta. Sums under the plain key (no day) and under the dated key."""
    day = F.to_date("ts")
    keys = F.array(
        F.struct("counter_key", F.lit(None).cast("date").alias("day")),
        F.struct(F.concat("counter_key", F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("counter_key"), day.alias("day")),
    )
    rows = increments.where(F.col("delta") > 0).select("owner_user_id", F.inline(keys), "delta")
    return rows.groupBy("owner_user_id", "counter_key", "day").agg(F.sum("delta").alias("counter_value"))


def running_counters(increments: DataFrame) -> DataFrame:
    """increments: ts, owner_user_id, counter_key, delta. Totals, also under the dated key."""
    return counter_deltas(increments).drop("day")


COUNTER_ROW = "owner_user_id bigint, counter_key string, day date, counter_value bigint"
_COUNTER_KEYS = ("owner_user_id", "counter_key", "day")


def _counter_rows(spark: SparkSession, folder: str, parts: list[tuple[str, int]]) -> DataFrame:
    """Rows of the named parts of a counter table, several a key."""
    paths = [f"{folder}/{kind}/{kind}={number}" for kind, number in parts]
    return spark.read.schema(COUNTER_ROW).parquet(*paths) if paths else spark.createDataFrame([], COUNTER_ROW)


def counter_sink(increments: DataFrame, folder: str, compact_every: int = 8, keep_days: int = 2) -> None:
    """Drain a stream of increments into a table of counters; the stream itself keeps no state.

    A micro-batch adds its own sums as one part, named by its number, so that a re-run batch replaces itself. Every
    ``compact_every`` batches the parts since the last base are merged into a new base; dated keys more than
    ``keep_days`` before the latest day leave it for a closed part that is never merged again, so the base holds the
    plain keys and a few days. Late increments of a closed day make another closed row. ``counter_totals`` adds all up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sums = counter_deltas(batch)
        sums.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in COUNTER_ROW.split(", ")]).write.mode("overwrite").parquet(f"{folder}/delta/delta={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        before = [n for n in folders.numbers(spark, f"{folder}/base", "base") if n < batch_id]
        deltas = [n for n in folders.numbers(spark, f"{folder}/delta", "delta") if (max(before) if before else -1) < n <= batch_id]
        parts = [("base", max(before))] if before else []
        merged = _counter_rows(spark, folder, parts + [("delta", n) for n in deltas]).groupBy(*_COUNTER_KEYS).agg(F.sum("counter_value").alias("counter_value"))
        merged = cut_lineage(merged)
        latest = merged.agg(F.max("day")).first()[0]
        over = F.coalesce(F.col("day") < F.date_sub(F.lit(latest), keep_days), F.lit(False))
        merged.where(over).write.mode("overwrite").parquet(f"{folder}/closed/closed={batch_id}")
        # The base counts once it is whole; it is written last.
        merged.where(~over).write.mode("overwrite").parquet(f"{folder}/base/base={batch_id}")
        # Parts that the base before this one had taken in are of no use to any reader.
        if before:
            folders.remove(spark, *[f"{folder}/delta/delta={n}" for n in folders.numbers(spark, f"{folder}/delta", "delta") if n <= max(before)])
            folders.remove(spark, *[f"{folder}/base/base={n}" for n in before if n != max(before)])

    increments.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def counter_totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row a key of what ``counter_sink`` has taken in."""
    bases = folders.numbers(spark, f"{folder}/base", "base")
    last = max(bases) if bases else -1
    parts = [("base", last)] if bases else []
    parts += [("closed", n) for n in folders.numbers(spark, f"{folder}/closed", "closed") if n <= last]
    parts += [("delta", n) for n in folders.numbers(spark, f"{folder}/delta", "delta") if n > last]
    return _counter_rows(spark, folder, parts).groupBy("owner_user_id", "counter_key").agg(F.sum("counter_value").alias("counter_value"))


def stage_metrics(events: DataFrame, length: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """events: ts, stage, duration_ms, candidate_count, fallback_count over sliding windows."""
    return (
        events.groupBy(F.window("ts", length, slide).alias("w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("events"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
            F.sum("candidate_count").alias("candidates"), F.sum("fallback_count").alias("fallbacks"),
        )
        .select(F.col("w.start").alias("window_start"), "stage", "events", "mean_ms", "max_ms", "candidates", "fallbacks")
    )


def late_events(batch: DataFrame, watermark: Column, event_time: str = "ts") -> DataFrame:
    """Rows of a micro-batch older than the watermark, kept aside so that totals can be reconciled."""
    return batch.where(F.col(event_time) < watermark)


def _leave_mark(batch: DataFrame, folder: str, batch_id: int, event_time: str = "ts") -> None:
    """Keep the latest event time of a micro-batch below its number."""
    own = batch.agg(F.max(event_time).alias("latest")).select(F.lit(batch_id).cast("bigint").alias("batch_id"), "latest")
    own.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")


def _watermark(spark: SparkSession, folder: str, batch_id: int, kind: T.DataType, delay: str, form: Callable[[Column], Column] = lambda w: w):
    """The latest event time that the batches before ``batch_id`` have left, less the delay, in a ``form``; none before the first."""
    if not batch_id:
        return None
    seen = spark.read.schema(f"batch_id bigint, latest {kind.simpleString()}").option("recursiveFileLookup", True).parquet(f"{folder}/marks")
    return seen.where(F.col("batch_id") < batch_id).agg(form(F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("w")).first().w


def late_sink(events: DataFrame, folder: str, delay: str = "10 minutes", event_time: str = "ts") -> None:
    """Drain a stream and keep the rows that come later than the watermark allows in ``folder``/late.

    The watermark of a micro-batch is the latest event time of the batches before it, less the delay. Each batch
    leaves its rows and its latest time below its own number, so that a re-run batch replaces itself.
    """
    kind = events.schema[event_time].dataType

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        limit = F.lit(_watermark(batch.sparkSession, folder, batch_id, kind, delay)).cast(kind)
        late_events(batch, limit, event_time).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        _leave_mark(batch, folder, batch_id, event_time)
        batch.unpersist()

    events.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


# --- state kept in a table -----------------------------------------------------------------------

# Events without a time come first.
_NO_TIME = -(2**63)


def fold_sink(
    events: DataFrame, folder: str, key: str, other: str, kinds: tuple[str, ...], unknown: int, held: str,
    step: Callable[[tuple | None, int, int, object], tuple[tuple | None, list[tuple[int | None, str]]]],
    leave: Callable[[tuple | None, int | None, int | None], tuple[tuple | None, list[tuple[int | None, str]]]],
    delay: str,
) -> None:
    """Drain a stream of (ts, key, kind, other) through one small state a key; the stream itself keeps none.

    A micro-batch is shuffled by key together with the state table that the batch before left, sorted by key, time, kind
    and ``other``, and folded in one pass a task: no call, frame or buffer is spent on a single key, and a key of any
    number of events is one row held. ``step`` takes (state, place of the kind, microseconds, other) and returns the
    state and the rows (microseconds, event) of one event; ``leave`` takes the state that a key has at the end of the batch
    and the watermarks (microseconds) before and after it, and returns what is kept, with rows of timers.
    Rows go to ``folder``/rows and states to ``folder``/state, each below the number of the batch, so that a re-run batch
    replaces itself. Events behind the watermark are left out, as stateful operators do; ``late_sink`` can keep them.
    """
    states = T.StructType.fromDDL(held)
    other_type = events.schema[other].dataType
    shape = T.StructType([T.StructField("key", T.StringType()), T.StructField("other", other_type), T.StructField("at", T.LongType()), T.StructField("event", T.StringType()), T.StructField("held", states)])
    arrow = to_arrow_schema(shape)
    codes = F.create_map(*[F.lit(x) for i, kind in enumerate(kinds) for x in (kind, i)])

    def folded(before: int | None, after: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nobody = object()
            current, state = nobody, None
            out: list[tuple] = []

            def close() -> None:
                kept, rows = leave(state, before, after)
                out.extend((current, None, at, event, None) for at, event in rows)
                if kept is not None:
                    out.append((current, None, None, None, dict(zip(states.names, kept, strict=True))))

            def flush() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
                made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                out.clear()
                return made

            for batch in batches:
                for name, kind, at, third, old in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if name != current:
                        if current is not nobody:
                            close()
                        current, state = name, None
                    if old is not None:
                        state = tuple(old.values())
                        continue
                    state, rows = step(state, kind, _NO_TIME if at is None else at, third)
                    for when, event in rows:
                        out.append((name, third, when, event, None))
                if out:
                    yield flush()
            if current is not nobody:
                close()
            if out:
                yield flush()

        return run

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _leave_mark(batch, folder, batch_id)
        before, after = (_watermark(spark, folder, n, T.TimestampType(), delay, F.unix_micros) for n in (batch_id, batch_id + 1))
        late = F.lit(False) if before is None else F.coalesce(F.unix_micros("ts") < before, F.lit(False))
        code = F.coalesce(F.try_element_at(codes, "kind"), F.lit(unknown))
        rows = batch.where(~late).select(F.col(key).alias("key"), code.alias("kind"), F.unix_micros("ts").alias("at"), F.col(other).alias("other"), F.lit(None).cast(states).alias("held"))
        earlier = [n for n in folders.numbers(spark, f"{folder}/state", "batch") if n < batch_id]
        if earlier:
            kept = spark.read.schema(T.StructType([T.StructField("key", T.StringType()), T.StructField("held", states)])).parquet(f"{folder}/state/batch={max(earlier)}")
            rows = rows.unionByName(kept.select("key", F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast(other_type).alias("other"), "held"))
        # The state of a key comes before its events.
        placed = rows.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", F.col("held").isNull(), "at", "kind", "other")
        made = cut_lineage(placed.mapInArrow(folded(before, after), shape))
        out = made.where(F.col("held").isNull()).select(F.col("key").alias(key), F.col("other").alias(other), F.timestamp_micros("at").alias("at"), "event")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        made.where(F.col("held").isNotNull()).select("key", "held").write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        # A re-run of this batch reads the state before it; nobody reads older ones.
        folders.remove(spark, *[f"{folder}/state/batch={n}" for n in earlier if n != max(earlier)])

    events.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


# --- sessions ------------------------------------------------------------------------------------

SESSION_STATE = "issued double, last double, user bigint, revoked boolean, known boolean"
SESSION_ROW = "token string, user_id bigint, at timestamp, event string"


def session_step(state: tuple | None, kind: str, at: float, user: int, idle: float, absolute: float) -> tuple[tuple | None, str]:
    """One event on one token: (issued, last use, user, revoked) and what happened."""
    if kind == "issue":
        return (at, at, user, False), "issued"
    if state is None or state[3]:
        return state, "rejected"
    issued, last, owner, _ = state
    if at >= min(last + idle, issued + absolute):
        return (issued, last, owner, True), "expired"
    if kind == "revoke":
        return (issued, last, owner, True), "revoked"
    return (issued, at, owner, False), "accepted"


# Rows of a key that leave a step at a time.
_STEP_ROWS = 10000
SESSION_KINDS = ("issue", "use", "revoke")


def _arrivals(batches: Iterator[pd.DataFrame], read: Callable[[pd.DataFrame], list[np.ndarray]]) -> list[np.ndarray]:
    """Chunks of a key reduced to a few numbers a row, in the order of the last columns: time first, then the others."""
    parts = [read(batch) for batch in batches]
    columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def sessions(events: DataFrame, idle: float = IDLE_SECONDS, absolute: float = ABSOLUTE_SECONDS) -> DataFrame:
    """events: ts, token, user_id, kind (issue / use / revoke). One outcome row per event.

    State per token is four values. An event-time timer drops a token once its absolute expiry has
    passed the watermark; later uses then find no session and are rejected, as they must be. The events of one token in
    one micro-batch are held as three numbers each and leave in chunks.
    """
    codes = {kind: i for i, kind in enumerate(SESSION_KINDS)}

    def read(batch: pd.DataFrame) -> list[np.ndarray]:
        return [_micros(batch["ts"]), batch["kind"].map(codes).fillna(1).to_numpy(np.int8), batch["user_id"].to_numpy(np.int64)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get)[:4] if state.exists else None
        times, kinds, users = _arrivals(batches, read)
        for start in range(0, len(times), _STEP_ROWS):
            part = slice(start, start + _STEP_ROWS)
            out = []
            for at, kind, user in zip(times[part].tolist(), kinds[part].tolist(), users[part].tolist(), strict=True):
                held, event = session_step(held, SESSION_KINDS[kind], at / 1e6, user, idle, absolute)
                out.append(event)
            yield pd.DataFrame({"token": key[0], "user_id": users[part], "at": times[part].astype("datetime64[us]"), "event": out})
        if held is not None:
            state.update((*held, True))
            expiry = int((held[0] + absolute) * 1000)
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("token").applyInPandasWithState(step, SESSION_ROW, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_sink(events: DataFrame, folder: str, idle: float = IDLE_SECONDS, absolute: float = ABSOLUTE_SECONDS, delay: str = "10 minutes") -> None:
    """Drain a stream of events into ``folder``/rows: the outcomes of ``sessions``, by the same rules, for any number of tokens."""

    def step(state: tuple | None, kind: int, at: int, user: int | None) -> tuple[tuple | None, list[tuple[int | None, str]]]:
        state, event = session_step(state, SESSION_KINDS[kind], at / 1e6, user, idle, absolute)
        return state, [(None if at == _NO_TIME else at, event)]

    def leave(state: tuple | None, before: int | None, after: int | None) -> tuple[tuple | None, list[tuple[int | None, str]]]:
        over = state is not None and before is not None and round((state[0] + absolute) * 1e6) < before
        return None if over else state, []

    held = SESSION_STATE.removesuffix(", known boolean")
    fold_sink(events, folder, "token", "user_id", SESSION_KINDS, SESSION_KINDS.index("use"), held, step, leave, delay)


# --- jobs ----------------------------------------------------------------------------------------

JOB_STATE = "status string, owner string, lease double, deadline double, reported boolean"
JOB_ROW = "job_id string, at timestamp, event string"


def job_step(state: tuple, kind: str, worker: str | None, now: float, lease_seconds: float, deadline_seconds: float) -> tuple:
    """One event on one job: (status, lease owner, lease end, deadline, lease end reported).

    Queued jobs, and running ones whose lease is over, can be claimed before their deadline. Only the owner of a
    running job renews it (before the deadline) or finishes it; anyone cancels what is not finished.
    """
    status, owner, lease, deadline, reported = state
    if kind == "create" and not status:
        return "queued", "", 0.0, now + deadline_seconds, False
    running = status == "running"
    free = status == "queued" or (running and lease < now)
    if (kind == "claim" and worker and free and now < deadline) or (kind == "renew" and running and owner == worker and now < deadline):
        return "running", worker, now + lease_seconds, deadline, False
    if kind in ("complete", "fail") and running and owner == worker:
        return {"complete": "completed", "fail": "failed"}[kind], "", 0.0, deadline, False
    if kind == "cancel" and status in ("queued", "running"):
        return "cancelled", "", 0.0, deadline, False
    return state


JOB_KINDS = ("create", "claim", "renew", "complete", "fail", "cancel")


def lease_monitor(events: DataFrame, lease_seconds: float = 30, deadline_seconds: float = 1000) -> DataFrame:
    """events: ts, job_id, worker_id, kind (create / claim / renew / complete / fail / cancel).

    Emits lease_expired and past_deadline rows from event-time timers; a terminal state wins and
    releases the job's state. Events that the rules of ``job_step`` refuse change nothing. Events of one moment are
    taken in the order of the kinds above, then of the workers. A micro-batch's events of one job are held as
    three numbers each, beside the distinct names of their workers.
    """
    codes = {kind: i for i, kind in enumerate(JOB_KINDS)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else ("", "", 0.0, 0.0, False)
        out: list[tuple] = []

        def due(now: float) -> None:
            nonlocal held
            held, rows = _due(held, now)
            out.extend((key[0], pd.Timestamp(at, unit="us"), event) for at, event in rows)

        if state.hasTimedOut:
            due(state.getCurrentWatermarkMs() / 1000)
        else:
            names: dict[str | None, int] = {}

            def read(batch: pd.DataFrame) -> list[np.ndarray]:
                workers = [w if isinstance(w, str) else None for w in batch["worker_id"]]
                numbers = [names.setdefault(w, len(names)) for w in workers]
                return [_micros(batch["ts"]), batch["kind"].map(codes).fillna(len(codes)).to_numpy(np.int8), np.array(numbers, np.int64)]

            times, kinds, workers = _arrivals(batches, read)
            order, called = _by_name(times, kinds, workers, list(names))
            for i in order:
                now = int(times[i]) / 1e6
                due(now)
                kind = JOB_KINDS[kinds[i]] if kinds[i] < len(JOB_KINDS) else ""
                held = job_step(held, kind, called[workers[i]], now, lease_seconds, deadline_seconds)
                if len(out) >= _STEP_ROWS:
                    yield pd.DataFrame(out, columns=["job_id", "at", "event"])
                    out.clear()
        status, _, lease, deadline, reported = held
        if status in ("queued", "running"):
            state.update(held)
            # A lease is over once time has passed its end.
            soonest = min(lease + 0.001, deadline) if status == "running" and not reported else deadline
            state.setTimeoutTimestamp(max(int(soonest * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["job_id", "at", "event"])

    return events.groupBy("job_id").applyInPandasWithState(step, JOB_ROW, JOB_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _due(state: tuple, now: float) -> tuple[tuple, list[tuple[int | None, str]]]:
    """What has come due on a job by ``now``: its state after that, and (microseconds, event) rows."""
    status, owner, lease, deadline, reported = state
    rows: list[tuple[int | None, str]] = []
    if status == "running" and not reported and lease < now and lease <= deadline:
        rows.append((round(lease * 1e6), "lease_expired"))
        reported = True
    if status in ("queued", "running") and deadline <= now:
        rows.append((round(deadline * 1e6), "past_deadline"))
        status, reported = "overdue", True
    return (status, owner, lease, deadline, reported), rows


def lease_sink(events: DataFrame, folder: str, lease_seconds: float = 30, deadline_seconds: float = 1000, delay: str = "10 minutes") -> None:
    """Drain a stream of events into ``folder``/rows: the rows of ``lease_monitor``, by the same rules, for any number of jobs.

    Timers are looked at where a micro-batch ends, against the watermark that it leaves.
    """
    fresh = ("", "", 0.0, 0.0, False)

    def step(state: tuple | None, kind: int, at: int, worker: str | None) -> tuple[tuple | None, list[tuple[int | None, str]]]:
        now = at / 1e6
        state, rows = _due(state or fresh, now)
        return job_step(state, JOB_KINDS[kind] if kind < len(JOB_KINDS) else "", worker, now, lease_seconds, deadline_seconds), rows

    def leave(state: tuple | None, before: int | None, after: int | None) -> tuple[tuple | None, list[tuple[int | None, str]]]:
        rows: list[tuple[int | None, str]] = []
        if state is not None and state[0] in ("queued", "running") and after is not None:
            status, _, lease, deadline, reported = state
            # A lease is over once time has passed its end.
            soonest = min(lease + 0.001, deadline) if status == "running" and not reported else deadline
            if int(soonest * 1000) < after // 1000:
                state, rows = _due(state, after / 1e6)
        return (state if state is not None and state[0] in ("queued", "running") else None), rows

    named = events.withColumn("worker_id", F.col("worker_id").cast("string"))
    fold_sink(named, folder, "job_id", "worker_id", JOB_KINDS, len(JOB_KINDS), JOB_STATE, step, leave, delay)


def _by_name(times: np.ndarray, kinds: np.ndarray, workers: np.ndarray, names: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
    """Order by time, kind and the name of the worker (none first)."""
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))] = np.arange(len(names))
    return np.lexsort((place[workers], kinds, times)), names


# --- matching and audit --------------------------------------------------------------------------


def exact_match_stream(suspects: DataFrame, records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """suspects: ts, query_id, user_id, cross_owner, md5, sha256. Repeated content within the
    watermark is answered once; the registry is reduced to one row per digest, once for all micro-batches."""
    by_owner, by_all = (cut_lineage(index) for index in digest_index(records))
    once = suspects.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "cross_owner", "md5", "sha256"])
    return indexed_file_match(once.drop("ts"), by_owner, by_all)


def match_sink(suspects: DataFrame, registry: str, folder: str, delay: str = "1 hour") -> None:
    """Answer a stream of suspects from the registry folder that ``append_generation_batch`` writes to.

    Rows are those of ``exact_match_stream``, in ``folder``/rows. Each committed part of the registry is reduced to its
    digests once and kept in ``folder``/index. Before a micro-batch the parts are listed: where none was added, the index
    of the batch before serves; else the new parts alone are reduced, and the index is summed up anew.
    """
    once = suspects.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "cross_owner", "md5", "sha256"]).drop("ts")
    held: dict[str, object] = {}
    shape = "owner_user_id int, md5 binary, sha256 binary, n_records bigint, first_id string"

    def index(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        parts = committed_parts(spark, registry, "v4_records")
        if held.get("parts") != sorted(parts):
            done = set(folders.names(spark, f"{folder}/index", "part"))
            for name in parts:
                if name not in done:
                    digest_index(parts[name])[0].write.mode("overwrite").parquet(f"{folder}/index/part={name}")
            files = [f"{folder}/index/part={name}" for name in parts]
            rows = spark.read.parquet(*files) if files else spark.createDataFrame([], shape)
            counts = (F.sum("n_records").alias("n_records"), F.min("first_id").alias("first_id"))
            by_owner = cut_lineage(rows.groupBy("owner_user_id", "md5", "sha256").agg(*counts))
            held.update(parts=sorted(parts), index=(by_owner, cut_lineage(by_owner.groupBy("md5", "sha256").agg(*counts))))
        return held["index"]

    def write(batch: DataFrame, batch_id: int) -> None:
        # Suspects of one owner and those of all take different joins; what is new among them is found once for both.
        fresh, spark = cut_lineage(batch), batch.sparkSession
        # A batch without suspects, such as one that moves the watermark alone, asks no index.
        none = spark.createDataFrame([], shape)
        held_index = (none, none.drop("owner_user_id")) if fresh.isEmpty() else index(spark)
        indexed_file_match(fresh, *held_index).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    once.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def audit_append(events: DataFrame) -> DataFrame:
    """Allow-listed audit columns; free-form details never reach the sink."""
    return events.select(*[c for c in AUDIT_COLUMNS if c in events.columns])


def audit_sink(events: DataFrame, folder: str) -> None:
    audit_append(events).writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/progress"
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
