"""Streams over files, run until the input is used up."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenwright import schemas
from screenwright.plans.screening import Dimensions, audit
from screenwright.sources import tables as T
from screenwright.sources.tables import read_audit, read_prompts, read_prompts_stream, write_audit
from screenwright.streaming import jobs as R

TEXTS = ["my ssn 123-45-6789", "hello", "drop table users", "act as a pirate", "the alpha plan", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("requests")
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("request_id"), F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"),
        F.lit("user1").alias("sub_user"), F.lit("ChatGPT").alias("tool"), F.lit("Edge").alias("browser_name"),
        F.get(F.array(*[F.lit(t) for t in TEXTS]), (F.col("id") % 6).cast("int")).alias("prompt"),
        F.lit(False).alias("testing"), F.timestamp_seconds(1704067200 + F.col("id") * 20).alias("ts"))
    rows.repartition(3).write.json(str(path / "in"))
    return path


@pytest.fixture(scope="module")
def dims(spark):
    return Dimensions(
        spark.createDataFrame([("u1", "U", "USER", 7, None)], schemas.USERS),
        spark.createDataFrame([(7, "Seven")], schemas.ORGANIZATIONS),
        spark.createDataFrame([(1, "7", "*", "alpha", False, False, False, True, "")], schemas.POLICIES))


def test_stream_equals_batch_and_restart_adds_nothing(spark, folder, dims):
    source = str(folder / "in")
    for _ in range(2):
        R.screen_stream(read_prompts_stream(spark, source, files_per_batch=1), dims, str(folder / "out"),
                        checkpoint=str(folder / "cp"), availableNow=True).awaitTermination()
    columns = ["id", "user_id", "risk_score", "action", "redacted_prompt", "tokens_used", "cost_saved"]
    streamed = sorted(map(str, read_audit(spark, str(folder / "out")).select(columns).collect()))
    batch = sorted(map(str, audit(read_prompts(spark, source, "json"), dims).select(columns).collect()))
    assert streamed == batch and len(batch) == 60
    # Without its checkpoint the stream starts anew, and a batch job appends the same rows: nothing is doubled.
    R.screen_stream(read_prompts_stream(spark, source), dims, str(folder / "out"), checkpoint=str(folder / "cp-new"),
                    availableNow=True).awaitTermination()
    write_audit(audit(read_prompts(spark, source, "json"), dims), str(folder / "out"))
    assert read_audit(spark, str(folder / "out")).count() == 60


def test_requests_that_the_table_holds_are_not_screened_again(spark, folder, dims, tmp_path, monkeypatch):
    """Neither by a batch that comes again after its driver was lost, nor by a batch job: before, all were screened and then left out."""
    screened, plain = [], T.audit_of
    monkeypatch.setattr(T, "audit_of", lambda requests, *rest: screened.append(requests.count()) or plain(requests, *rest))
    source, path, log = str(folder / "in"), str(tmp_path / "out"), tmp_path / "cp"

    def run():
        R.screen_stream(read_prompts_stream(spark, source), dims, path, checkpoint=str(log), availableNow=True).awaitTermination()
        return sorted(map(str, read_audit(spark, path).collect()))

    first = run()
    assert len(first) == 60 and not screened
    for folder, name in (("commits", "0"), ("sink", "written-0")):
        (log / folder / name).unlink()
        (log / folder / f".{name}.crc").unlink(missing_ok=True)
    assert run() == first and screened == [0]
    T.append_screened(read_prompts(spark, source, "json"), dims, path)
    assert screened == [0, 0] and sorted(map(str, read_audit(spark, path).collect())) == first
    # Without a request id a request is known by its prepared fields; only what is new is screened.
    nameless = read_prompts(spark, source, "json").withColumns({"request_id": F.lit(None).cast("string"), "sub_user": F.lit(" ")})
    T.append_screened(nameless.where("ts < timestamp_seconds(1704067200 + 600)"), dims, path)
    T.append_screened(nameless, dims, path)
    assert screened == [0, 0, 30, 30] and read_audit(spark, path).count() == 120


def test_stream_with_a_large_policy_table(spark, folder, dims, monkeypatch):
    """Above the broadcast bound the stream starts as well and gives the same rows."""
    source = str(folder / "in")
    batch = sorted(map(str, audit(read_prompts(spark, source, "json"), dims).select("id", "action", "risk_score").collect()))
    monkeypatch.setattr("screenwright.operators.org_policy.POLICY_ROWS", 0)
    R.screen_stream(read_prompts_stream(spark, source, files_per_batch=1), dims, str(folder / "out-large"),
                    checkpoint=str(folder / "cp-large"), availableNow=True).awaitTermination()
    got = read_audit(spark, str(folder / "out-large")).select("id", "action", "risk_score").collect()
    assert sorted(map(str, got)) == batch


def run_to_memory(df, name, mode, checkpoint):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_repeats_within_the_window_are_dropped(spark, folder):
    requests = read_prompts_stream(spark, str(folder / "in"))
    kept = run_to_memory(R.suppress_repeats(requests, "1 hour"), "kept", "append", str(folder / "cp-kept"))
    assert kept.count() == kept.select("user_id", "sub_user", "prompt").distinct().count() == 6


def test_late_requests_that_are_no_repeats_pass(spark, tmp_path):
    def arrive(*rows):
        frame = spark.createDataFrame([(i, "u", "s", None, None, p, None, None) for i, p, _ in rows], schemas.PROMPTS)
        times = F.create_map(*[F.lit(x) for i, _, m in rows for x in (i, m)])
        frame.withColumn("ts", F.timestamp_seconds(1704067200 + 60 * times[F.col("request_id")])).coalesce(1).write.mode(
            "append").json(str(tmp_path / "in"))
        kept = R.suppress_repeats(read_prompts_stream(spark, str(tmp_path / "in")))
        kept.writeStream.format("json").option("path", str(tmp_path / "kept")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.request_id for r in read_prompts(spark, str(tmp_path / "kept"), "json").collect())

    assert arrive(("a", "x", 100), ("b", "x", 104), ("c", "x", 105), ("n", "x", None)) == ["a", "c", "n"]
    # Far behind: a new prompt, a repeat of it, one of the known prompt outside and one inside its window.
    assert arrive(("d", "y", 1), ("e", "y", 2), ("f", "x", 95), ("g", "x", 97)) == ["a", "c", "d", "f", "n"]


def test_a_call_judges_many_keys_and_forgets_each_in_its_time():
    """One call of Python a key took milliseconds each, most of the time of a stream of texts that do not repeat."""
    minute, held = 60_000_000, SimpleNamespace(value=None, due=None)

    class State:
        hasTimedOut = False
        now = 0
        exists = property(lambda self: held.value is not None)
        get = property(lambda self: held.value)

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, value):
            held.value = value

        def setTimeoutTimestamp(self, due):
            assert due > self.now
            held.due = due

        def remove(self):
            held.value = held.due = None

    def call(*rows, timed_out=False, now=0):
        state = State()
        state.hasTimedOut, state.now = timed_out, now
        frame = pd.DataFrame([(0, k, at, i, now, now) for i, k, at in rows],
                             columns=["_bucket", "_key", "_at", "request_id", "_arrived", "_arrived_ms"])
        out = R.pass_apart((0,), iter([frame]), state, 5 * minute, 60 * minute)
        return sorted(i for b in out for i in b["request_id"])

    assert call(("a", "x", 0), ("b", "y", minute), ("c", "x", 4 * minute), ("d", "x", 5 * minute), ("e", "z", None)) == ["a", "b", "d", "e"]
    assert sorted(held.value[0]) == ["x", "y"] and held.due == 65 * 60_000
    assert call(("f", "y", 2 * minute), ("g", "v", 0), now=30 * 60_000) == ["g"]
    # Of x nothing came for an hour and a window, of y and v later.
    assert call(timed_out=True, now=66 * 60_000) == [] and sorted(held.value[0]) == ["v", "y"]
    assert call(("h", "x", minute), ("i", "y", minute), now=67 * 60_000) == ["h"]
    assert call(timed_out=True, now=600 * 60_000) == [] and held.value is None


def test_last_seen_as_a_stream(spark, tmp_path):
    beats = spark.range(6).selectExpr("CAST(id % 2 AS STRING) AS org_label", "'s' AS subUser", "'b' AS browserName",
                                      "timestamp_seconds(1704067200 + id * 60) AS ts")
    beats.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = run_to_memory(R.last_seen(stream), "seen", "complete", str(tmp_path / "cp"))
    got = R.with_liveness(seen, "2024-01-01 00:06:00").orderBy("org_label").collect()
    assert [(r.org_label, r.stale) for r in got] == [("0", True), ("1", False)]


def test_running_counters_equal_batch(spark, folder, dims):
    screened = audit(read_prompts(spark, str(folder / "in"), "json"), dims)
    screened.write.parquet(str(folder / "audit"))
    stream = spark.readStream.schema(schemas.AUDIT).option("maxFilesPerTrigger", 1).parquet(str(folder / "audit"))
    counted = run_to_memory(R.running_counters(stream), "counted", "complete", str(folder / "cp-count"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, R.running_counters(screened).collect()))


def test_windowed_actions_stream_equals_batch_up_to_the_watermark(spark, folder, dims):
    screened = audit(read_prompts(spark, str(folder / "in"), "json"), dims)
    screened.write.parquet(str(folder / "audit2"))
    stream = spark.readStream.schema(schemas.AUDIT).parquet(str(folder / "audit2"))
    got = run_to_memory(R.windowed_actions(stream, late="0 seconds"), "windowed", "append", str(folder / "cp-w"))
    streamed, batch = set(map(tuple, got.collect())), set(map(tuple, R.windowed_actions(screened).collect()))
    assert streamed and streamed <= batch
    last = max(w[1] for w in batch)
    assert {w for w in batch if w[1] < last} <= streamed


def test_unknown_actions_count_as_allowed(spark):
    df = spark.createDataFrame([("u", "block"), ("u", None), ("u", "odd")], "user_id string, action string")
    assert tuple(R.running_counters(df).first()) == ("u", 3, 1, 0, 0, 2)


def test_liveness(spark):
    seen = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS last_seen UNION ALL SELECT timestamp'2024-01-01 00:09:00'")
    got = R.with_liveness(seen, "2024-01-01 00:10:00").orderBy("last_seen").collect()
    assert [r.stale for r in got] == [True, False]


def test_checkpoint_location():
    def session(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value))

    with pytest.raises(ValueError):
        R.checkpoint_dir(session(None), "q")
    assert R.checkpoint_dir(session(None), "q", "/given") == "/given"
    assert R.checkpoint_dir(session("/shared/"), "q") == "/shared/q"
