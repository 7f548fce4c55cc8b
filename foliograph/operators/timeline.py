"""Time series, job logs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph import catalog
from foliograph.catalog import error as error_text
from foliograph.functions.documents import strict_json
from foliograph.functions.text import trim_space
from foliograph.functions.timecodes import (
    banner_duration,
    clock,
    is_banner,
    is_progress_kv,
    progress_percent,
    secs_to_time,
    step_percent,
)
from foliograph.operators.ranks import last_rows, running_max, seq_block
from foliograph.session import per_key

TOKEN_BLOCK = 4096


def plan_trim(specs: DataFrame) -> DataFrame:
    """Bounds in seconds, effective duration and error of (start, end, duration) rows.

    A blank bound is open. A bound that is no time is an error, as is an end that is not
    after the start.
    """
    bounds = {}
    for side in ("start", "end"):
        text = trim_space(F.coalesce(side, F.lit("")))
        bounds[f"{side}_s"] = clock(text)
        bounds[f"_given_{side}"] = text != ""
    planned = specs.withColumns(bounds)
    s, e, whole = F.col("start_s"), F.col("end_s"), F.col("duration")
    error = (
        F.when(F.col("_given_start") & s.isNull(), error_text("bad_time", F.col("start")))
        .when(F.col("_given_end") & e.isNull(), error_text("bad_time", F.col("end")))
        .when(e <= s, error_text("end_before_start"))
    )
    span = F.when(s.isNotNull() & e.isNotNull(), e - s).when(e.isNotNull(), e)
    span = span.when(s.isNotNull(), F.when(whole.isNotNull(), F.greatest(whole - s, F.lit(0.0)))).otherwise(whole)
    with_error = planned.withColumn("error", error)
    return with_error.withColumn("effective", F.when(F.col("error").isNull(), span)).drop("_given_start", "_given_end")


def display_bounds(df: DataFrame, start: Column, end: Column, duration: Column) -> DataFrame:
    """Bounds as time strings, '' where they are open; ``skipped`` when the duration is unknown."""
    known = F.coalesce(duration > 0, F.lit(False))
    return df.withColumns(
        {
            "skipped": ~known,
            "start": F.when(known, F.when(start <= 0, "").otherwise(secs_to_time(start))),
            "end": F.when(known, F.when(end >= duration, "").otherwise(secs_to_time(end))),
        }
    )


def _first_seen(events: DataFrame, key: str, ts: str) -> DataFrame:
    return per_key(events, [key], F.min(ts).alias("_first"))


def _seconds_since(ts: Column, first: Column) -> Column:
    micros = [F.unix_micros(t.cast("timestamp")) for t in (ts, first)]
    return (micros[0] - micros[1]) / 1000000.0


def rebase(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Add ``offset``: seconds since the key's first event. The minimum is aggregated and
    joined back, so a hot key is split by the skew join instead of sorted in one window."""
    joined = events.join(_first_seen(events, key, ts), key)
    return joined.withColumn("offset", _seconds_since(F.col(ts), F.col("_first"))).drop("_first")


def trim_series(events: DataFrame, specs: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Events within their key's [start, end] and ``offset`` counted from the start bound.

    ``specs`` holds one row per key with start and end as time strings.
    Keys without a valid spec yield nothing.
    """
    planned = plan_trim(specs.withColumn("duration", F.lit(None).cast("double")))
    start = F.when(F.col("error").isNull(), F.coalesce("start_s", F.lit(0.0)))
    ranges = planned.select(key, start.alias("_from"), F.col("end_s").alias("_to"))
    # first event and bounds of a key come out of one aggregation over both inputs
    bounds = per_key(
        events.select(key, ts).unionByName(ranges, allowMissingColumns=True),
        [key],
        F.min(ts).alias("_first"),
        F.max("_from").alias("_from"),
        F.max("_to").alias("_to"),
    ).filter(F.col("_from").isNotNull())
    offset = _seconds_since(F.col(ts), F.col("_first"))
    inside = (offset >= F.col("_from")) & (F.col("_to").isNull() | (offset <= F.col("_to")))
    trimmed = events.join(bounds, key).filter(inside)
    return trimmed.withColumn("offset", offset - F.col("_from")).drop("_first", "_from", "_to")


def job_durations(lines: DataFrame) -> DataFrame:
    """Duration per job from its first complete banner."""
    first = F.min_by(F.struct(banner_duration(F.col("line")).alias("d")), "seq")
    return per_key(lines.filter(is_banner(F.col("line"))), ["job_id"], first["d"].alias("duration"))


def log_progress(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Percent of each progress line of jobs with a known duration: job_id, seq, percent."""
    reported = lines.filter(F.startswith("line", F.lit("out_time_us=")))
    joined = reported.join(durations.filter(F.col("duration") > 0), "job_id")
    return joined.withColumn("percent", progress_percent(F.col("line"), F.col("duration"))).filter(
        F.col("percent").isNotNull()
    )


def progress_state(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Where each job stands: highest and last percent, number of reports."""
    return events.groupBy(key).agg(
        F.max("percent").alias("percent"),
        F.max_by("percent", "seq").alias("last_percent"),
        F.count(F.lit(1)).alias("reports"),
    )


def running_progress(
    lines: DataFrame, key: str = "job_id", order: list[str] | None = None, block: list[Column] | None = None
) -> DataFrame:
    """Progress after each line; it starts at the initial percent and only moves up."""
    order = order or ["seq"]
    block = block or [seq_block(F.col(order[0]))]
    value = F.greatest(F.lit(catalog.STAGE_START), step_percent(F.col("line")))
    return running_max(lines, [key], order, block, value, "percent")


def error_lines(lines: DataFrame) -> DataFrame:
    """Lines that may explain a failure: neither blank nor key=value progress."""
    return lines.filter(~is_progress_kv(F.col("line")) & (trim_space(F.col("line")) != ""))


def shown_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines without the blank ones, as a log view keeps them."""
    return lines.withColumn("line", trim_space(F.col("line"))).filter(F.col("line") != "")


def failure_message(detail: Column, status: Column) -> Column:
    """What a failed job reports: its last lines or, without any, its exit status."""
    said = trim_space(F.coalesce(detail, F.lit("")))
    return F.when(said == "", error_text("job_status", F.coalesce(status, F.lit(-1)))).otherwise(
        error_text("job_failed", said)
    )


def tail_lines(lines: DataFrame, n: int, key: str = "job_id", order: list[str] | None = None) -> DataFrame:
    """The last n lines of each job as one text."""
    order = order or ["seq"]
    kept = last_rows(lines, [key], order, n)
    newest_last = F.array_sort(F.collect_list(F.struct((-F.col("tail_pos")).alias("at"), "line")))
    return kept.groupBy(key).agg(F.array_join(newest_last["line"], "\n").alias("tail"), F.count("line").alias("kept"))


def token_rows(lines: DataFrame) -> DataFrame:
    """``token`` and ``is_done`` of NDJSON lines; lines that are no JSON are left out."""
    parsed = lines.withColumn("_v", strict_json(F.col("line"))).filter(F.col("_v").isNotNull())
    reply = F.try_variant_get("_v", "$.response", "variant")
    done = F.try_variant_get("_v", "$.done", "variant")
    return parsed.select(
        *lines.columns,
        F.when(F.schema_of_variant(reply) == "STRING", F.try_variant_get("_v", "$.response", "string")).alias("token"),
        F.coalesce(
            F.when(F.schema_of_variant(done) == "BOOLEAN", F.try_variant_get("_v", "$.done", "boolean")), F.lit(False)
        ).alias("is_done"),
    )


def joined_tokens(order: str, text: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return F.array_join(ordered[text], "")


def fold_blocks(tokens: DataFrame, key: str = "request_id") -> DataFrame:
    """Text of each block of a request; a block holds at most TOKEN_BLOCK sequence numbers."""
    return tokens.groupBy(key, seq_block(F.col("seq"), TOKEN_BLOCK).alias("block")).agg(
        joined_tokens("seq", "token").alias("part"),
        F.min("seq").alias("first_seq"),
        F.max("is_done").alias("done"),
        F.count("token").alias("tokens"),
    )


def join_blocks(blocks: DataFrame, key: str = "request_id") -> DataFrame:
    return blocks.groupBy(key).agg(
        joined_tokens("first_seq", "part").alias("text"), F.max("done").alias("done"), F.sum("tokens").alias("tokens")
    )


def fold_tokens(lines: DataFrame, key: str = "request_id") -> DataFrame:
    """Reply of each request from its NDJSON lines: blocks first, then their texts."""
    return join_blocks(fold_blocks(token_rows(lines), key), key)
