"""TOML, YAML and CSV texts as VARIANT values."""

from __future__ import annotations

import csv
import io
import json
import tomllib
from datetime import date, datetime, time

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliograph.catalog import error as error_text
from foliograph.functions.documents import json_error, strict_json

try:
    import yaml
except ImportError:  # rows in YAML then carry an error, all others are unaffected
    yaml = None


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, datetime | date | time):
        return value.isoformat()
    return value


def _csv_records(text: str) -> list[dict[str, str]]:
    csv.field_size_limit(max(len(text), csv.field_size_limit()))
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    header = rows[0] if rows else []
    for row in rows[1:]:
        if len(row) != len(header):
            raise ValueError(f"found record with {len(row)} fields, but the header has {len(header)} fields")
    return [dict(zip(header, row)) for row in rows[1:]]


def _to_json(fmt: str | None, text: str | None) -> tuple[str | None, str | None]:
    if fmt is None or text is None:
        return None, None
    try:
        if fmt == "toml":
            value = tomllib.loads(text)
        elif fmt == "csv":
            value = _csv_records(text)
        elif yaml is None:
            return None, "no YAML reader on this worker"
        else:
            value = yaml.safe_load(text)
        return json.dumps(_plain(value), ensure_ascii=False, allow_nan=False), None
    except (ValueError, csv.Error, RecursionError, TypeError) as problem:
        return None, f"Invalid {fmt.upper()}: {problem}"
    except Exception as problem:  # the YAML reader has its own error tree
        if yaml is not None and isinstance(problem, yaml.YAMLError):
            return None, f"Invalid {fmt.upper()}: {problem}"
        raise


_RESULT = StructType([StructField("json", StringType()), StructField("problem", StringType())])


@F.pandas_udf(_RESULT)
def _decode(fmt: pd.Series, text: pd.Series) -> pd.DataFrame:
    pairs = [_to_json(f, t) for f, t in zip(fmt, text)]
    return pd.DataFrame(pairs, columns=["json", "problem"])


def decode_config(df: DataFrame, fmt_col: str, text_col: str) -> DataFrame:
    """Add ``value`` (VARIANT) and ``decode_error`` for TOML and YAML texts."""
    return decode_documents(df, fmt_col, text_col)


def decode_documents(df: DataFrame, fmt_col: str, text_col: str) -> DataFrame:
    """Add ``value`` (VARIANT) and ``decode_error``. JSON stays in the JVM; for TOML, YAML
    and CSV an Arrow function turns the text into JSON and Spark parses that.
    """
    fmt = F.lower(F.col(fmt_col))
    fmt = F.when(fmt == "yml", F.lit("yaml")).otherwise(fmt)
    foreign = fmt.isin("toml", "yaml", "csv")
    sent = _decode(F.when(foreign, fmt), F.when(foreign, F.col(text_col)))
    decoded = df.withColumn("_sent", sent)
    value = F.when(fmt == "json", strict_json(F.col(text_col))).otherwise(F.try_parse_json("_sent.json"))
    error = (
        F.when(
            ~F.coalesce(foreign | (fmt == "json"), F.lit(False)),
            error_text("unsupported_data", F.lower(F.col(fmt_col))),
        )
        .when(F.col("_sent.problem").isNotNull(), F.col("_sent.problem"))
        .when(fmt == "json", json_error(F.col(text_col), F.col("value")))
        .when(F.col("value").isNull(), F.concat(F.lit("Invalid "), F.upper(fmt)))
    )
    return decoded.withColumn("value", value).withColumn("decode_error", error).drop("_sent")
