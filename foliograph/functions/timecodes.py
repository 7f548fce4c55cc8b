"""Time strings, progress lines and log banners."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliograph.catalog import STAGES
from foliograph.functions.text import trim_space

_NUMBER = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)"


def plain_number(text: Column) -> Column:
    """A decimal number or NULL; unlike a bare cast no suffix, hex form or blank passes."""
    return F.when(text.rlike(f"(?i)^{_NUMBER}$(?!\n)"), text.try_cast("double"))


def clock(text: Column, least: int = 1) -> Column:
    """Seconds of ``least`` to three numbers set apart by colons, NULL for anything else."""
    form = f"(?i)^{_NUMBER}(?::{_NUMBER}){{{least - 1},2}}$(?!\n)"
    parts = F.split(F.when(text.rlike(form), text), ":")
    weights = F.slice(F.array(F.lit(3600.0), F.lit(60.0), F.lit(1.0)), 4 - F.size(parts), F.size(parts))
    scaled = F.zip_with(parts, weights, lambda part, weight: part.try_cast("double") * weight)
    return F.aggregate(scaled, F.lit(0.0), lambda total, part: total + part)


def time_to_secs(text: Column) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` in seconds, NULL for anything else."""
    return clock(trim_space(text))


def secs_to_time(secs: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` of the floored value."""
    whole = F.floor(secs)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def _banner(line: Column) -> Column:
    return trim_space(F.regexp_extract(line, r"Duration:([^,]*)", 1))


def is_banner(line: Column) -> Column:
    """The line names a duration of three parts, readable or not."""
    return F.contains(line, F.lit("Duration:")) & (F.size(F.split(_banner(line), ":")) == 3)


def banner_duration(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("Duration:")), clock(_banner(line), least=3))


def out_time_us(line: Column) -> Column:
    value = F.regexp_extract(line, r"(?s)^out_time_us=(.*)$", 1)
    return F.when(F.startswith(line, F.lit("out_time_us=")), plain_number(trim_space(value)))


def ratio_percent(done: Column, total: Column) -> Column:
    # least() skips NULLs, so an unknown part must be ruled out first
    return F.when((total > 0) & done.isNotNull(), F.least(done / total * 100.0, F.lit(100.0)))


def progress_percent(line: Column, duration: Column) -> Column:
    """Percent of ``duration`` an ``out_time_us=`` line stands for, capped at 100."""
    return ratio_percent(out_time_us(line) / 1000000.0, duration)


def bar_percent(line: Column) -> Column:
    """The number in up to four characters before the first percent sign."""
    at = F.instr(line, "%")
    shown = F.substring(line, F.greatest(at - 4, F.lit(1)), F.least(at - 1, F.lit(4)))
    return F.when(at > 0, plain_number(F.regexp_replace(shown, r"^[^0-9]+", "")))


def bar_progress(line: Column) -> Column:
    return 20.0 + bar_percent(line) / 100.0 * 68.0


def stage_percent(line: Column, stages: list[tuple[str, float]] = STAGES) -> Column:
    """Highest percent of any keyword in the line, NULL when none is there."""
    lower = F.lower(line)
    hits = [F.when(F.contains(lower, F.lit(word)), F.lit(pct)) for word, pct in stages]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def step_percent(line: Column, stages: list[tuple[str, float]] = STAGES) -> Column:
    """What one log line says about progress: its bar if it shows one, else its stage."""
    bar = bar_progress(line)
    return F.coalesce(bar, stage_percent(line, stages))


def is_progress_kv(line: Column) -> Column:
    return line.rlike("^[a-z0-9_]+=")
