"""Structured Streaming jobs. Screening needs no state; counters and liveness are aggregations."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from screenwright.operators.analytics import count_if
from screenwright.operators.lookups import bucket
from screenwright.plans.screening import Dimensions, Options, audit
from screenwright.sources.tables import append_screened, exists, write_audit
from screenwright.streaming.batches import BatchLog

HEARTBEAT_SECONDS = 30
# Groups of keys in which repeats are looked for.
REPEAT_BUCKETS = 4096


def checkpoint_dir(spark: SparkSession, name: str, given: str | None = None) -> str:
    """Checkpoint location of a query: the given one, or a folder below the shared one of the session."""
    if given:
        return given
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir to a shared folder")
    return f"{shared.rstrip('/')}/{name}"


def screen_stream(
    requests: DataFrame, dims: Dimensions, path: str, name: str = "screening", checkpoint: str | None = None,
    options: Options | None = None, **trigger,
) -> StreamingQuery:
    """Screen requests as they arrive and append audit rows to the same table as batch jobs.

    Beside the checkpoint lies the sink's own log of batches (``BatchLog``). A batch that it holds as written is not written
    again; one that was begun, or the first of a log, may be in the table and is compared with its ids; others are
    appended as they are. So a restart, whenever it was stopped, neither loses nor repeats rows. A second run of the same
    query on the same checkpoint takes the sink over, and the first one fails at its next batch.

    Where policies are not broadcast, requests are screened batch by batch, so that hot keys are measured and large
    organisations are met in chunks. So they are where the table may hold rows of the next batch: these are left out
    before they are screened.
    """
    spark = requests.sparkSession
    where = checkpoint_dir(spark, name, checkpoint)
    log = BatchLog(spark, f"{where}/sink")
    log.take_over()
    small = (options or Options()).policy_plan != "join" and dims.policies_small
    at_once = small and not (log.unsure() and exists(spark, path))  # the whole stream is screened in one plan

    def append(rows: DataFrame, batch: int) -> None:
        log.still_mine()
        state = log.state(batch)
        if state == "written":
            return
        log.begin(batch)
        check = state != "new" and exists(spark, path)
        again = check or not small  # whether the batch is read more than once
        rows = rows.persist() if again else rows
        if at_once:
            write_audit(rows, path, check=check)
        elif check:
            append_screened(rows, dims, path, options)
        else:
            write_audit(audit(rows, dims, options), path, check=False)
        if again:
            rows.unpersist()
        log.written(batch)

    return (
        (audit(requests, dims, options) if at_once else requests).writeStream.outputMode("append").foreachBatch(append)
        .option("checkpointLocation", where)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )


def pass_apart(key, batches: Iterator[pd.DataFrame], state, window: int, late: int) -> Iterator[pd.DataFrame]:
    """Rows whose times are at least ``window`` from those of their key that passed before (microseconds).

    The rows are those of a bucket of keys. ``state`` holds per key the times that passed, and when it is forgotten.
    """
    known = {k: (due, passed) for k, due, passed in zip(*state.get, strict=True)} if state.exists else {}
    arrivals: dict[str, int] = {}
    for batch in () if state.hasTimedOut else batches:
        if batch.empty:
            continue
        chosen = []
        columns = (batch[c].tolist() for c in ("_key", "_at", "request_id", "_arrived_ms"))
        # By key and time; what has no time or no id comes first.
        for k, at, _, arrived, row in sorted(zip(*columns, range(len(batch)), strict=True), key=lambda r: (
                r[0], r[1] == r[1], r[1] if r[1] == r[1] else 0, r[2] is not None, r[2] or "")):
            arrivals[k] = max(arrived, arrivals.get(k, 0))
            if at != at:  # without a time nothing tells a repeat
                chosen.append(row)
                continue
            passed = known.setdefault(k, (0, []))[1]
            i = bisect.bisect_left(passed, at)
            if (i == 0 or at - passed[i - 1] >= window) and (i == len(passed) or passed[i] - at >= window):
                passed.insert(i, int(at))
                chosen.append(row)
        if chosen:
            yield batch.iloc[chosen].drop(columns=["_bucket", "_key", "_at", "_arrived", "_arrived_ms"])
    now, rest = state.getCurrentWatermarkMs(), late + window
    kept = []
    for k, (due, passed) in known.items():
        if k in arrivals:
            kept.append((k, arrivals[k] + rest // 1000, [at for at in passed if at >= passed[-1] - rest]))
        elif due >= now:
            kept.append((k, due, passed))
    if kept:
        state.update(tuple(map(list, zip(*kept, strict=True))))
        state.setTimeoutTimestamp(max(min(due for _, due, _ in kept), now + 1))
    elif state.exists:
        state.remove()


def suppress_repeats(requests: DataFrame, window: str = "5 minutes", late: str = "1 hour", buckets: int = REPEAT_BUCKETS) -> DataFrame:
    """Let a request through once per user, sub-user and prompt within the window.

    This drops requests, so it is not part of screening by default. A request passes if none of its key has passed at a
    time less than ``window`` from its own, whatever order they arrive in; what arrives together is taken by time. The
    watermark is one of arrival, so a late request that is no repeat passes too. Per key, the times that passed are remembered until
    they lie ``late`` and a window before the newest, or nothing has come for as long; a repeat later than that passes.
    Rows without a time pass. The state holds digests and times, no prompt, and rows go by in Arrow batches, so a key
    of many rows is never held whole.

    A call of Python takes milliseconds, so keys are dealt into ``buckets`` by digest and a call judges the keys of one.
    The state of a bucket is written anew when one of its keys comes; more buckets make it smaller. A checkpoint holds to
    its number of buckets.
    """
    parts = [F.coalesce(F.sha2(F.col(c), 256), F.lit("-")) for c in ("user_id", "sub_user", "prompt")]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    keyed = requests.withColumns({
        "_bucket": bucket(F.xxhash64(digest), F.lit(buckets)), "_key": digest, "_at": F.unix_micros(F.col("ts").cast("timestamp")),
        "_arrived": F.current_timestamp(), "_arrived_ms": F.unix_millis(F.current_timestamp())}).withWatermark("_arrived", "1 minute")
    apart = partial(pass_apart, window=pd.Timedelta(window) // pd.Timedelta("1us"), late=pd.Timedelta(late) // pd.Timedelta("1us"))
    return keyed.groupBy("_bucket").applyInPandasWithState(
        lambda key, batches, state: apart(key, batches, state), requests.schema,
        "keys array<string>, due array<bigint>, passed array<array<bigint>>", "append", "EventTimeTimeout")


def running_counters(actions: DataFrame, user_id: str = "user_id", action: str = "action") -> DataFrame:
    """Prompts per user by outcome, in update mode. Whatever is not a known action counts as allowed."""
    outcome = F.upper(F.coalesce(F.col(action), F.lit("")))
    return actions.groupBy(user_id).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(outcome == "BLOCK").alias("blocked"),
        count_if(outcome == "REDACT").alias("redacted"),
        count_if(outcome == "ALERT").alias("alerted"),
        count_if(~outcome.isin("BLOCK", "REDACT", "ALERT")).alias("allowed"),
    )


def last_seen(heartbeats: DataFrame, ts: str = "ts") -> DataFrame:
    """Time of the last heartbeat per organisation, sub-user and browser."""
    return heartbeats.groupBy("org_label", "subUser", "browserName").agg(F.max(ts).alias("last_seen"))


def with_liveness(seen: DataFrame, now, missed: int = 3) -> DataFrame:
    """Mark clients that have missed more than ``missed`` heartbeats at time ``now``."""
    at = now if not isinstance(now, str) else F.lit(now).cast(seen.schema["last_seen"].dataType)
    return seen.withColumn("stale", at - F.col("last_seen") > F.make_dt_interval(secs=F.lit(missed * HEARTBEAT_SECONDS)))


def note_beats(key, batches: Iterator[pd.DataFrame], state, silent: int) -> Iterator[pd.DataFrame]:
    """Changes of one client: it turns live with a heartbeat after silence, and stale ``silent`` after its last one
    (microseconds)."""
    last, stale = state.get if state.exists else (None, True)
    changes: list[tuple[int, str]] = []
    if state.hasTimedOut:
        changes.append((last + silent, "stale"))
        stale = True
    else:
        times = np.sort(np.concatenate([b["_at"].to_numpy(np.int64) for b in batches]))
        times = times[times > last] if last is not None else times
        if len(times):
            if last is not None and not stale and times[0] - last > silent:
                changes.append((last + silent, "stale"))
                stale = True
            if stale:
                changes.append((int(times[0]), "live"))
            for i in np.flatnonzero(np.diff(times) > silent):
                changes += [(int(times[i]) + silent, "stale"), (int(times[i + 1]), "live")]
            last, stale = int(times[-1]), False
    due = -(-(last + silent) // 1000) if last is not None else 0  # timers count whole milliseconds
    if last is not None and not stale and due < state.getCurrentWatermarkMs():
        changes.append((last + silent, "stale"))
        stale = True
    if last is not None:
        state.update((last, stale))
    if not stale:
        state.setTimeoutTimestamp(due)
    if changes:
        yield pd.DataFrame({"org_label": key[0], "subUser": key[1], "browserName": key[2],
                            "changed_at": pd.to_datetime([at for at, _ in changes], unit="us", utc=True), "change": [c for _, c in changes]})


def liveness_changes(heartbeats: DataFrame, missed: int = 3, late: str = "1 minute") -> DataFrame:
    """A stream of changes: ``live`` when a client is first heard or heard again, ``stale`` once it has missed more than
    ``missed`` heartbeats.

    Silence sends no row, so a timer per client on the watermark reports it: the stale row comes by itself when the heartbeats
    of others have moved the time far enough, and once. The changes do not depend on how heartbeats fall into batches. A
    heartbeat later than ``late``, or older than the last one of its client, changes nothing; one without a time neither.
    The state is a time and a flag a client.
    """
    timed = heartbeats.select("org_label", "subUser", "browserName", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    timed = timed.withWatermark("ts", late).withColumn("_at", F.unix_micros("ts"))
    silent = missed * HEARTBEAT_SECONDS * 1_000_000
    return timed.groupBy("org_label", "subUser", "browserName").applyInPandasWithState(
        lambda key, batches, state: note_beats(key, batches, state, silent),
        "org_label string, subUser string, browserName string, changed_at timestamp, change string", "last bigint, stale boolean",
        "append", "EventTimeTimeout")


def windowed_actions(audit_rows: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per action and time window of the event."""
    source = audit_rows.withWatermark("created_at", late) if audit_rows.isStreaming else audit_rows
    grouped = source.groupBy(F.window("created_at", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("prompts"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "prompts")
