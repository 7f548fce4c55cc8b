"""Trims, logs, progress and tokens on fixtures."""

from datetime import datetime

from foliograph.operators import timeline


def test_plan_trim(spark):
    cases = [
        (("", "", 60.0), (None, None, 60.0, None)), (("10", "", 60.0), (10.0, None, 50.0, None)), (("70", "", 60.0), (70.0, None, 0.0, None)),
        (("", "1:30", None), (None, 90.0, 90.0, None)), (("0:10", "0:75", 60.0), (10.0, 75.0, 65.0, None)), (("10", " ", None), (10.0, None, None, None)),
        (("30", "0:30", 60.0), (30.0, 30.0, None, "End time must be after start time")), (("soon", "", 60.0), (None, None, None, "Invalid time: soon")),
        (("", "1d", 60.0), (None, None, None, "Invalid time: 1d")), ((None, None, None), (None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, start string, end string, duration double")
    got = timeline.plan_trim(df).orderBy("i").collect()
    assert [(r.start_s, r.end_s, r.effective, r.error) for r in got] == [w for _, w in cases]


def test_display_bounds(spark):
    df = spark.createDataFrame([(0.0, 60.0, 60.0), (5.0, 50.0, 60.0), (-1.0, 70.0, 60.0), (0.0, 0.0, 0.0), (0.0, 1.0, None)], "s double, e double, d double")
    got = timeline.display_bounds(df, df.s, df.e, df.d).collect()
    assert [(r.skipped, r.start, r.end) for r in got] == [
        (False, "", ""), (False, "0:05", "0:50"), (False, "", ""), (True, None, None), (True, None, None)]


def test_trim_and_rebase(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, at(5)), (1, at(7)), (1, at(15)), (2, at(1)), (3, at(2))], "k int, ts timestamp")
    assert {(r.k, r.offset) for r in timeline.rebase(events, "k").collect()} == {(1, 0.0), (1, 2.0), (1, 10.0), (2, 0.0), (3, 0.0)}
    specs = spark.createDataFrame([(1, "2", "0:10"), (2, "", ""), (3, "9", "3")], "k int, start string, end string")
    assert {(r.k, r.offset) for r in timeline.trim_series(events, specs, "k").collect()} == {(1, 0.0), (1, 8.0), (2, 0.0)}


def lines(spark, per_job):
    rows = [(job, n, text) for job, texts in per_job.items() for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "job_id int, seq long, line string")


def test_durations_and_progress(spark):
    log = lines(spark, {
        1: ["x", "Duration: 1:2, ", "Duration: 00:00:10.00, start", "Duration: 00:00:99.00,", "out_time_us=5000000", "out_time_us=20000000", "out_time_us=1000000"],
        2: ["Duration: 0:x:1, ", "Duration: 00:00:10.00,", "out_time_us=1"], 3: ["out_time_us=1"],
    })
    known = timeline.job_durations(log)
    assert {r.job_id: r.duration for r in known.collect()} == {1: 10.0, 2: None}
    state = timeline.progress_state(timeline.log_progress(log, known))
    assert [tuple(r) for r in state.collect()] == [(1, 100.0, 10.0, 3)]


def test_running_progress(spark):
    log = lines(spark, {1: ["hello", "Load Model", "bar 50%", "layout detection", "bar 10%", "saved to x", "odd x%y"]})
    got = [r.percent for r in timeline.running_progress(log).orderBy("seq").collect()]
    assert got == [2.0, 5.0, 54.0, 54.0, 54.0, 90.0, 90.0]


def test_tails(spark):
    noise = ["frame=1", "  ", "out_time_us=4", "fps=2"]
    log = lines(spark, {1: [t for n in range(20) for t in (f"error {n}", noise[n % 4])], 2: ["only"]})
    got = {r.job_id: (r.tail, r.kept) for r in timeline.tail_lines(timeline.error_lines(log), 15).collect()}
    assert got == {1: ("\n".join(f"error {n}" for n in range(5, 20)), 15), 2: ("only", 1)}


def test_tokens(spark):
    rows = [(1, 0, '{"response":"He"}'), (1, 1, '{"response":"llo'), (1, 2, '{"response":" w","done":false}'), (1, 3, '{"response":5}'),
            (1, 5000, '{"response":"!","done":true}'), (2, 0, '{"done":"true"}'), (2, 1, "[]")]
    df = spark.createDataFrame(rows, "request_id int, seq long, line string")
    assert {tuple(r) for r in timeline.fold_tokens(df).collect()} == {(1, "He w!", True, 3), (2, "", False, 0)}


def test_failure_message(spark):
    df = spark.createDataFrame([("  a\nb \n", 1), (" ", 7), (None, None)], "d string, s int")
    got = [r[0] for r in df.select(timeline.failure_message(df.d, df.s)).collect()]
    assert got == ["ffmpeg failed: a\nb", "ffmpeg exited with status 7", "ffmpeg exited with status -1"]


def test_shown_lines(spark):
    log = lines(spark, {1: [" a ", "\t", "", "b"]})
    assert [r.line for r in timeline.shown_lines(log).orderBy("seq").collect()] == ["a", "b"]
