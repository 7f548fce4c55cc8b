"""Streams fed in several batches, in any order, end where their batch twins end."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliograph.operators import ranks, timeline
from foliograph.session import scratch_path
from foliograph.streaming import monitors, store


@pytest.fixture
def feed(spark, tmp_path):
    """A stream that reads its rows in several batches, and the same rows as a table; ``parts`` maps a row's number to its batch."""

    def make(df, parts, turn=None):
        folder = str(tmp_path / "in")
        for n in range(parts):
            df.filter((turn if turn is not None else F.col("seq") % parts) == n).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def log(spark):
    rows = [(n % 3, n, f"out_time_us={(n * 37) % 50 * 1000000}" if n % 2 else f"line {n}") for n in range(120)]
    return spark.createDataFrame(rows, "job_id int, seq long, line string")


@pytest.mark.parametrize("delay", ["1 hour", "1 second"])
def test_progress(spark, feed, delay):
    known = spark.createDataFrame([(0, 40.0), (1, 60.0), (2, None)], "job_id int, duration double")
    folder = monitors.drain(monitors.progress_stream(feed(log(spark), 5), known, delay), "update", "t", monitors.merge_progress)
    batch = timeline.progress_state(timeline.log_progress(log(spark), known))
    assert rows_of(monitors.latest_progress(spark, folder)) == {(r.job_id, r.percent, r.reports) for r in batch.collect()}


def token_lines(spark, n=60, done=True):
    """Three requests, one of which is never done; every fifth line is broken."""
    rows = []
    for q in range(3):
        for s in range(n):
            reply = f'{{"response":"{q}.{s} ","done":{"true" if done and q < 2 and s == n - 1 else "false"}}}'
            rows.append((q, s, "broken" if s % 5 == 1 else reply))
    return spark.createDataFrame(rows, "request_id int, seq long, line string")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_tokens_in_any_order(spark, feed, order):
    lines = token_lines(spark)
    turns = list(range(4))
    random.Random(order).shuffle(turns)
    batch_of = F.element_at(F.lit(turns), (F.floor(F.col("seq") / 15) + 1).cast("int"))
    folder = monitors.drain(monitors.token_stream(feed(lines, 4, batch_of)), "update", "t")
    assert rows_of(monitors.latest_tokens(spark, folder)) == rows_of(timeline.fold_tokens(lines))


def test_tokens_close_with_done(spark, feed):
    """A closed request leaves no state; an open one is all in the state, and nothing is late."""
    folder = monitors.drain(monitors.token_stream(feed(token_lines(spark), 3, F.floor(F.col("seq") / 20))), "update", "t")
    told = store.EpochStore(spark, folder).read()
    assert sorted((r.request_id, r.done) for r in told.collect()) == [(0, True), (1, True)]
    pending = monitors.open_tokens(spark, folder)
    assert {r.request_id for r in pending.collect()} == {2} and pending.count() == 48
    assert monitors.late_tokens(spark, folder).isEmpty()


def test_tokens_after_the_end_and_requests_that_never_end(spark, tmp_path):
    """What comes after ``done`` goes to the side table once its time is up, as does what never ends."""
    source, folder = str(tmp_path / "in"), scratch_path(spark, "t")
    lines = token_lines(spark, 10)

    def more(df, pause=0.0):
        df.coalesce(1).write.mode("append").parquet(source)
        stream = monitors.token_stream(spark.readStream.schema(lines.schema).parquet(source), wait=0.5)
        monitors.start(stream, folder, "update").awaitTermination()
        time.sleep(pause)

    more(lines.filter("seq >= 5"))
    more(lines.filter("seq < 5"), 2.5)
    tick = spark.createDataFrame([(9, 0, '{"response":"tick","done":true}')], lines.schema)
    more(tick, 2.5)
    more(tick.withColumn("seq", F.lit(1).cast("long")))
    assert monitors.open_tokens(spark, folder).filter("request_id < 9").isEmpty()
    late = {(r.request_id, p.seq) for r in monitors.late_tokens(spark, folder).collect() for p in r.pairs}
    assert {q for q, _ in late} == {0, 1, 2} and (0, 0) in late and (0, 9) not in late
    got = rows_of(monitors.latest_tokens(spark, folder).filter("request_id < 9"))
    assert got == rows_of(timeline.fold_tokens(lines))


def test_tail(spark, feed):
    lines = log(spark)
    folder = monitors.tail_stream(feed(lines, 5), 7, ["job_id"], ["seq"])
    want = ranks.last_rows(lines, ["job_id"], ["seq"], 7).drop("tail_pos")
    assert rows_of(monitors.latest_tail(spark, folder, lines.schema)) == rows_of(want)
    assert monitors.state_rows(spark, folder, "tail").count() == 21


def test_tail_of_odd_rows(spark, feed):
    """NULL keys and lines, times as order, one key with nearly all rows."""
    rows = [(None if n % 50 == 0 else 1, n, None if n % 7 == 0 else f"l\"{n}\n") for n in range(3000)]
    lines = spark.createDataFrame(rows, "job_id int, seq long, line string").withColumn("at", F.timestamp_seconds("seq"))
    folder = monitors.tail_stream(feed(lines, 2), 4, ["job_id"], ["at"])
    want = ranks.last_rows(lines, ["job_id"], ["at"], 4).drop("tail_pos")
    assert rows_of(monitors.latest_tail(spark, folder, lines.schema)) == rows_of(want)


def test_tail_forgets_silent_keys(spark, tmp_path):
    source = str(tmp_path / "in")
    lines = log(spark)
    lines.filter("job_id = 0").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    folder = monitors.tail_stream(stream, 3, ["job_id"], ["seq"], ttl=3600.0)
    assert monitors.latest_tail(spark, folder, lines.schema).count() == 3


@pytest.mark.parametrize("delay", ["1 day", "1 second"])
def test_manifest(spark, feed, delay):
    rows = [(f"/p{n % 11}", n) for n in range(100)]
    df = spark.createDataFrame(rows, "path string, seq long")
    folder = monitors.drain(monitors.manifest_stream(feed(df, 4), delay), "append", "t", monitors.merge_files)
    got = [r.path for r in monitors.latest_files(spark, folder).collect()]
    assert sorted(got) == sorted({p for p, _ in rows})


def test_manifest_folded_by_the_store(spark, feed):
    """No state; each epoch is told without copies, and copies of other epochs go as the parts are read. NULL is a path."""
    rows = [(None if n % 11 == 5 else f"/p{n % 11}", None if n % 3 else 2**60 + n, n) for n in range(220)]
    df = spark.createDataFrame(rows, "path string, size long, seq long")
    folder = scratch_path(spark, "t")
    query = monitors.start(monitors.manifest_stream(feed(df, 4, F.floor(F.col("seq") / 55))), folder, "append", monitors.merge_files, fold=True)
    query.awaitTermination()
    assert len(query.recentProgress) == 4 and all(not p["stateOperators"] for p in query.recentProgress)
    parts = [p for _, p in store.EpochStore(spark, folder).current()["parts"]]
    assert [spark.read.parquet(f"{folder}/{p}").count() for p in parts] == [11] * 4
    got = rows_of(monitors.latest_files(spark, folder, df.schema))
    assert len(got) == 11 and {p for p, _, _ in got} == {p for p, _, _ in rows} and got <= set(rows)


def test_manifest_told_once(spark, feed):
    """With ``delay`` the stream itself tells each path once, by one state, and leaves the other columns as they are."""
    rows = [(None if n % 11 == 5 else f"/p{n % 11}", None if n % 3 else 2**60 + n, n) for n in range(220)]
    df = spark.createDataFrame(rows, "path string, size long, seq long")
    folder = scratch_path(spark, "t")
    query = monitors.start(monitors.manifest_stream(feed(df, 4, F.floor(F.col("seq") / 55)), "1 day"), folder, "append")
    query.awaitTermination()
    assert {len(p["stateOperators"]) for p in query.recentProgress} == {1}
    told = [tuple(r) for r in store.EpochStore(spark, folder).read().collect()]
    assert len(told) == 11 and {p for p, _, _ in told} == {p for p, _, _ in rows} and set(told) <= set(rows)


def test_no_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    lines = spark.readStream.schema("job_id int, seq long, line string").parquet(str(tmp_path / "none"))
    assert monitors.latest_tail(spark, monitors.tail_stream(lines, 3, ["job_id"], ["seq"]), "job_id int, line string").isEmpty()
    folder = monitors.drain(monitors.manifest_stream(lines.select(F.col("line").alias("path"))), "append", "t")
    assert monitors.latest_files(spark, folder).isEmpty()
    folder = monitors.drain(monitors.token_stream(lines.withColumnRenamed("job_id", "request_id")), "update", "t")
    assert monitors.latest_tokens(spark, folder).isEmpty() and monitors.late_tokens(spark, folder).isEmpty()


# --- the store --------------------------------------------------------------------------


def test_a_repeated_epoch_changes_nothing(spark):
    kept = store.EpochStore(spark, scratch_path(spark, "t"))
    for _ in range(2):
        kept.write(spark.createDataFrame([("a",)], "path string"), 0)
    assert kept.read().count() == 1


def test_only_a_folded_part_is_read_as_it_is(spark):
    """One part that was merged when it was written is not merged again; one that was not, or several, are."""
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    plain, folded = scratch_path(spark, "t"), scratch_path(spark, "t")
    store.EpochStore(spark, plain).write(rows, 0)
    store.EpochStore(spark, folded, monitors.merge_files, fold=True).write(rows, 0)
    shuffled = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    for folder in (plain, folded):
        assert sorted(r.path for r in monitors.latest_files(spark, folder).collect()) == ["a", "b"]
    assert shuffled(monitors.latest_files(spark, plain)) and not shuffled(monitors.latest_files(spark, folded))
    store.EpochStore(spark, folded).write(rows, 1)  # by a writer that does not fold
    assert sorted(r.path for r in monitors.latest_files(spark, folded).collect()) == ["a", "b"]
    store.EpochStore(spark, plain, monitors.merge_files, fold=True).write(rows, 1)
    assert store.EpochStore(spark, plain).current()["folded"] is False


def test_an_epoch_that_broke_off_is_replaced(spark):
    folder = scratch_path(spark, "t")
    rows = spark.createDataFrame([("a",), ("b",)], "path string")
    rows.write.parquet(f"{folder}/parts/epoch-0")  # written, but no manifest names it
    kept = store.EpochStore(spark, folder)
    assert kept.read(rows.schema).isEmpty()
    kept.write(rows.limit(1), 0)
    assert kept.read().count() == 1


def test_many_epochs_leave_few_parts(spark, tmp_path):
    folder = str(tmp_path / "store")
    kept = store.EpochStore(spark, folder, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    for epoch in range(70):
        kept.write(spark.createDataFrame([(epoch % 3, 1)], "k int, n long"), epoch)
        assert len(kept.current()["parts"]) <= 2 * (store.FAN - 1) + 1
    assert rows_of(kept.read()) == {(0, 24), (1, 23), (2, 23)}
    assert len(list((tmp_path / "store" / "manifests").glob("*.json"))) == store.KEPT
    assert len(list((tmp_path / "store" / "parts").iterdir())) <= 2 * store.FAN + store.KEPT
