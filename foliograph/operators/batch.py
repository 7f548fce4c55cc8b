"""Batches of files: admission, settings, checksums, outcomes, elections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliograph import catalog
from foliograph.functions.paths import normalize_ext, path_ext
from foliograph.functions.text import trim_space
from foliograph.session import settle, small_side


def admit(df: DataFrame, mode: str) -> DataFrame:
    """Add ``accepted`` and ``reason`` for the merge, trim or convert mode.

    The convert mode expects the catalog's sources, which admit every format that
    converts into something.
    """
    path = F.col("path")
    if mode == "merge":
        accepted, reason = F.lower(path).endswith(".pdf"), catalog.error("not_pdf")
    elif mode == "trim":
        # here the text after the last dot of the whole path counts as extension
        tail = F.lower(F.substring_index(path, ".", -1))
        accepted, reason = tail.isin(catalog.MEDIA), catalog.error("not_media")
    elif mode == "convert":
        sources = sorted({src for _, src, _, _, cond in catalog.edge_rows() if cond == catalog.ALWAYS})
        accepted = normalize_ext(path_ext(path)).isin(sources)
        reason = catalog.error("unsupported_type", path_ext(path))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("accepted", accepted).withColumn("reason", F.when(~accepted, reason))


def is_audio_only(path: Column) -> Column:
    return path_ext(path).isin(catalog.AUDIO)


def validate_settings(df: DataFrame) -> DataFrame:
    """Clamp the numbers, default the mode, check the URL scheme. Missing values get defaults."""

    def clamped(name: str, low: int, high: int) -> Column:
        value = F.coalesce(F.col(name), F.lit(catalog.SETTING_DEFAULTS[name]))
        return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast("int")

    url = trim_space(F.col("rewriter_url"))
    mode = F.col("output_mode")
    return df.withColumns(
        {
            "jpeg_quality": clamped("jpeg_quality", 1, 100),
            "avif_quality": clamped("avif_quality", 1, 100),
            "max_concurrent": clamped("max_concurrent", 1, 8),
            "rewriter_url": url,
            "output_mode": F.when(mode == "download", mode).otherwise(catalog.SETTING_DEFAULTS["output_mode"]),
            "error": F.when(
                (url != "") & ~url.rlike("^https?://"),
                catalog.error("bad_url", url),
            ),
        }
    )


def checksum_status(content: Column, expected: Column) -> Column:
    return (
        F.when(expected == "", "unverified").when(F.sha2(content, 256) == expected, "ok").otherwise("mismatch")
    )


def verify_checksum(files: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Join file contents with their expected digests; the content itself is not shuffled,
    only its digest is."""
    digests = files.select(key, F.sha2("content", 256).alias("actual"))
    joined = digests.join(expected.select(key, "expected"), key, "left")
    want = F.coalesce("expected", F.lit(""))
    status = F.when(want == "", "unverified").when(F.col("actual") == want, "ok").otherwise("mismatch")
    return joined.withColumn("status", status)


def classify_error(
    message: Column, active: Column, rules: list[tuple[str, str]] = catalog.ERROR_RULES
) -> Column:
    """Dependency of the first rule whose fragment the message holds and which is active."""
    lower = F.lower(message)
    hits = [
        F.when(F.contains(lower, F.lit(fragment)) & F.array_contains(active, dep), F.lit(dep))
        for fragment, dep in rules
    ]
    return F.coalesce(*hits)


def map_types(representations: DataFrame, rules: DataFrame) -> DataFrame:
    """Extension, class and priority of each representation by its content type."""
    return representations.join(small_side(rules), "mime")


def elect(df: DataFrame, keys: list[str], priority: list[str], columns: list[str]) -> DataFrame:
    """The row with the smallest priority per key; partial results merge before the shuffle."""
    winner = F.min_by(F.struct(*columns), F.struct(*priority)).alias("_won")
    return df.groupBy(*keys).agg(winner).select(*keys, *[F.col(f"_won.{c}").alias(c) for c in columns])


def native_type_id(ext: Column) -> Column:
    """Type id an image extension is offered under, NULL for all others."""
    ids = F.create_map(*[F.lit(x) for pair in catalog.NATIVE_TYPE_IDS.items() for x in pair])
    return F.try_element_at(ids, ext)


def elect_representation(kinds: DataFrame, order: list[str] = catalog.REPRESENTATION_ORDER) -> DataFrame:
    """Which of an item's present representations is used; NULL when none is present."""
    place = F.array_position(F.lit(order), F.col("kind"))
    best = F.min(F.when(F.col("present") & (place > 0), place))
    return kinds.groupBy("item_id").agg(F.try_element_at(F.lit(order), best.cast("int")).alias("kind"))


def dedupe_paths(df: DataFrame, order: list[str], key: str = "path") -> DataFrame:
    """Keep the first row per path in the given order."""
    rest = [c for c in df.columns if c != key]
    return elect(df, [key], order, rest).select(*df.columns)


def batch_summary(results: DataFrame) -> DataFrame:
    """Outcome per batch: exit status 1 as soon as one item failed."""
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("output_path").alias("ok"),
        F.count("error").alias("failed"),
        F.max(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("exit_status"),
    )


def item_results(planned: DataFrame, output: Column) -> DataFrame:
    """One row per item with exactly one of output_path and error."""
    return planned.withColumn("output_path", F.when(F.col("error").isNull(), output))


def in_input_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in input order whatever order they were finished in (a range-partitioned sort)."""
    return df.orderBy(*order)


def with_fallback(
    df: DataFrame,
    key: str,
    value: str,
    primary: Callable[[DataFrame], DataFrame],
    fallback: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Run ``fallback`` only on the rows for which ``primary`` gave no or an empty value.

    Both take and return rows with ``key`` (unique) and ``value``. What ``primary`` gives is
    written once, as it decides both which rows are done and which are left.
    """
    first = settle(primary(df).select(key, value))
    done = first.filter(F.col(value).isNotNull() & (F.col(value) != "")).withColumn("used", F.lit("primary"))
    rest = df.join(done.select(key), key, "left_anti")
    second = fallback(rest).select(key, value).withColumn("used", F.lit("fallback"))
    return done.unionByName(second)


def unpivot_manifest(df: DataFrame, id_cols: list[str], platforms: list[str]) -> DataFrame:
    """Wide tool table (one struct or text column per platform) to one row per tool and platform."""
    long = df.unpivot(id_cols, platforms, "platform", "entry")
    return long.filter(F.col("entry").isNotNull())
