"""Queries on time strings, job logs and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import catalog
from foliograph.functions import timecodes
from foliograph.operators import ranks, timeline
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table

CLOCK_SQL = """clocks AS (SELECT event_id, event_id % 90 AS m, round(value, 2) AS s, event_id % 9 AS k FROM events)"""


def _clocks(spark, sf_dir):
    n = F.col("event_id")
    secs = F.format_string("%.2f", F.col("value"))
    text = (
        F.when(n % 9 == 0, secs).when(n % 9 == 1, F.concat(n % 90, F.lit(":"), secs))
        .when(n % 9 == 2, F.concat(F.lit("1:"), n % 90, F.lit(":"), secs)).when(n % 9 == 3, F.concat(F.lit("a:"), secs))
        .when(n % 9 == 4, F.concat(F.lit("1:2:3:"), secs)).when(n % 9 == 5, F.concat(secs, F.lit("d")))
        .when(n % 9 == 6, F.concat(F.lit(" "), secs, F.lit("\t"))).when(n % 9 == 7, F.concat(F.lit("1: "), secs))
        .otherwise("")
    )
    return table(spark, sf_dir, "events").select(n, "value", text.alias("text"))


@query(
    "b7_time_to_secs",
    f"""WITH {CLOCK_SQL} SELECT event_id, round(CASE WHEN k IN (0, 6) THEN s WHEN k = 1 THEN m * 60 + s
      WHEN k = 2 THEN 3600 + m * 60 + s END, 6) AS secs FROM clocks""",
)
def time_to_secs(spark, sf_dir):
    return _clocks(spark, sf_dir).select("event_id", F.round(timecodes.time_to_secs(F.col("text")), 6).alias("secs"))


@query(
    "b8_secs_to_time",
    """WITH s AS (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
      ELSE printf('%d:%02d', s // 60, s % 60) END AS shown FROM s""",
)
def secs_to_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timecodes.secs_to_time(F.col("value") * 37).alias("shown"))


@query(
    "b9_banner_duration",
    f"""WITH {d.LOG_SQL} SELECT job_id, arg_min(CAST(seq % 10 * 60 + seq % 60 + 0.5 AS DOUBLE), seq) AS duration
    FROM log_lines WHERE line LIKE '%Duration:%' GROUP BY job_id""",
)
def banner_duration(spark, sf_dir):
    return timeline.job_durations(d.log_lines(spark, sf_dir))


PROGRESS_SQL = f"""{d.LOG_SQL},
progress AS (
  SELECT job_id, seq, round(least(round(value * 1000000) / 1000000.0 / duration * 100.0, 100.0), 6) AS percent
  FROM log_lines JOIN durations USING (job_id) WHERE kind = 'click' AND duration > 0
)"""


@query("b10_progress_percent", f"WITH {PROGRESS_SQL} SELECT job_id, seq, percent FROM progress")
def progress_percent(spark, sf_dir):
    reported = timeline.log_progress(d.log_lines(spark, sf_dir), d.durations(spark, sf_dir))
    return reported.select("job_id", "seq", F.round("percent", 6).alias("percent"))


@query(
    "b11_bar_percent",
    f"""WITH {d.LOG_SQL} SELECT seq, CASE WHEN kind = 'signup' THEN CAST(seq % 101 AS DOUBLE) END AS bar,
      CASE WHEN kind = 'signup' THEN round(20.0 + (seq % 101) / 100.0 * 68.0, 6) END AS mapped FROM log_lines""",
)
def bar_percent(spark, sf_dir):
    line = F.col("line")
    return d.log_lines(spark, sf_dir).select(
        "seq", timecodes.bar_percent(line).alias("bar"), F.round(timecodes.bar_progress(line), 6).alias("mapped")
    )


@query("b25_is_progress_kv", f"WITH {d.LOG_SQL} SELECT seq, kind IN ('click', 'view') AS kv FROM log_lines")
def is_progress_kv(spark, sf_dir):
    return d.log_lines(spark, sf_dir).select("seq", timecodes.is_progress_kv(F.col("line")).alias("kv"))


STAGES_SQL = f"stages AS ({catalog.values_sql(catalog.STAGES, 'word, pct')})"


@query(
    "c8_stage_percent",
    f"""WITH {d.LOG_SQL}, {STAGES_SQL}
    SELECT seq, CAST(max(pct) AS DOUBLE) AS percent FROM log_lines LEFT JOIN stages ON contains(lower(line), word) GROUP BY seq""",
)
def stage_percent(spark, sf_dir):
    return d.log_lines(spark, sf_dir).select("seq", timecodes.stage_percent(F.col("line")).alias("percent"))


@query(
    "b24_plan_trim",
    f"""WITH {d.SPECS_SQL}
    SELECT user_id, CASE WHEN start = 'soon' THEN NULL ELSE start_s END AS start_s, end_s, error,
      CASE WHEN error IS NOT NULL THEN NULL WHEN start_s IS NOT NULL AND end_s IS NOT NULL THEN end_s - start_s
           WHEN end_s IS NOT NULL THEN end_s
           WHEN start_s IS NOT NULL THEN CASE WHEN duration IS NOT NULL THEN greatest(duration - start_s, 0) END
           ELSE duration END AS effective,
      duration IS NULL OR duration <= 0 AS skipped,
      CASE WHEN duration > 0 THEN CASE WHEN coalesce(end_s, duration) >= duration THEN ''
        WHEN end_s >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(end_s) AS BIGINT) // 3600, CAST(floor(end_s) AS BIGINT) % 3600 // 60, CAST(floor(end_s) AS BIGINT) % 60)
        ELSE printf('%d:%02d', CAST(floor(end_s) AS BIGINT) // 60, CAST(floor(end_s) AS BIGINT) % 60) END END AS shown_end
    FROM planned""",
)
def plan_trim(spark, sf_dir):
    planned = timeline.plan_trim(d.trim_specs(spark, sf_dir))
    shown = timeline.display_bounds(
        planned, F.coalesce("start_s", F.lit(0.0)), F.coalesce("end_s", "duration"), F.col("duration")
    )
    return shown.select("user_id", "start_s", "end_s", "error", "effective", "skipped", F.col("end").alias("shown_end"))


OFFSETS_SQL = """offsets AS (
  SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1000000.0 AS secs FROM events)"""


@query("e5_rebase", f"WITH {OFFSETS_SQL} SELECT event_id, user_id, round(secs, 6) AS secs FROM offsets")
def rebase(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeline.rebase(events, "user_id").select("event_id", "user_id", F.round("offset", 6).alias("secs"))


@query(
    "c10_trim_series",
    f"""WITH {OFFSETS_SQL}, {d.SPECS_SQL}
    SELECT event_id, o.user_id, value, round(secs - coalesce(start_s, 0), 6) AS secs
    FROM offsets o JOIN planned p ON o.user_id = p.user_id
    WHERE error IS NULL AND secs >= coalesce(start_s, 0) AND (end_s IS NULL OR secs <= end_s)""",
)
def trim_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    specs = d.trim_specs(spark, sf_dir).select("user_id", "start", "end")
    trimmed = timeline.trim_series(events, specs, "user_id")
    return trimmed.select("event_id", "user_id", "value", F.round("offset", 6).alias("secs"))


TOKENS_SQL = """
  SELECT conv_id AS request_id, string_agg(CASE WHEN turn % 5 <> 4 THEN text END, '' ORDER BY turn) AS text,
         bool_or(turn >= 3 AND turn % 5 <> 4) AS done, count(*) FILTER (turn % 5 <> 4) AS tokens
  FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id"""


@query("d5_fold_tokens", f"SELECT request_id, md5(text) AS text_md5, done, tokens FROM ({TOKENS_SQL})")
def fold_tokens(spark, sf_dir):
    folded = timeline.fold_tokens(d.token_lines(spark, sf_dir))
    return folded.select("request_id", F.md5("text").alias("text_md5"), "done", "tokens")


@query(
    "d6_progress_state",
    f"WITH {PROGRESS_SQL} SELECT job_id, max(percent) AS percent, arg_max(percent, seq) AS last_percent, count(*) AS reports FROM progress GROUP BY job_id",
)
def progress_state(spark, sf_dir):
    reported = timeline.log_progress(d.log_lines(spark, sf_dir), d.durations(spark, sf_dir))
    return timeline.progress_state(reported.withColumn("percent", F.round("percent", 6)))


@query(
    "e2_running_progress",
    f"""WITH {d.LOG_SQL}, said AS (SELECT job_id, seq, greatest(2.0, CASE kind WHEN 'signup' THEN 20.0 + (seq % 101) / 100.0 * 68.0
      WHEN 'purchase' THEN stage ELSE 2.0 END) AS pct FROM log_lines)
    SELECT job_id, seq, round(CAST(max(pct) OVER (PARTITION BY job_id ORDER BY seq) AS DOUBLE), 6) AS percent FROM said""",
)
def running_progress(spark, sf_dir):
    lines = d.log_lines(spark, sf_dir)
    return timeline.running_progress(lines).select("job_id", "seq", F.round("percent", 6).alias("percent"))


@query(
    "e4_error_tail",
    f"""WITH {d.LOG_SQL}, kept AS (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM log_lines
      WHERE kind NOT IN ('click', 'view') AND line <> '   ')
    SELECT job_id, concat('ffmpeg failed: ', trim(string_agg(line, chr(10) ORDER BY seq))) AS message, count(*) AS kept
    FROM kept WHERE rn <= 15 GROUP BY job_id""",
)
def error_tail(spark, sf_dir):
    errors = timeline.error_lines(d.log_lines(spark, sf_dir))
    tails = timeline.tail_lines(errors, catalog.ERROR_TAIL_LINES)
    return tails.select("job_id", timeline.failure_message(F.col("tail"), F.lit(1)).alias("message"), "kept")


@query(
    "e4_log_tail",
    f"""WITH {d.LOG_SQL}, kept AS (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM log_lines WHERE trim(line) <> '')
    SELECT job_id, seq, trim(line) AS line FROM kept WHERE rn <= 300""",
)
def log_tail(spark, sf_dir):
    shown = timeline.shown_lines(d.log_lines(spark, sf_dir))
    return ranks.last_rows(shown, ["job_id"], ["seq"], catalog.LOG_TAIL_LINES).select("job_id", "seq", "line")
