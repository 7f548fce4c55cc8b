"""Document values as records: arrays to rows and back, flattening, batch conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph.catalog import error as error_text
from foliograph.functions.documents import (
    cell_text,
    csv_line,
    shape_error,
    shape_of,
    variant_kind,
)
from foliograph.session import settle_counting
from foliograph.sources.configs import decode_documents
from foliograph.sources.files import read_json_documents

LEVELS = 8  # opened per pass


def object_fields(value: Column) -> Column:
    return F.map_keys(value.try_cast("map<string,variant>"))


def record_header(value: Column) -> Column:
    """Sorted keys of the first record."""
    return F.array_sort(object_fields(F.try_variant_get(value, "$[0]", "variant")))


def records_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a document that is an array of objects, under the keys of its first one.

    Adds ``pos`` (place in the array), ``header`` and ``cells``, and ``dropped_keys``: how
    many keys of the record the header lacks. Elements that are no objects give no row.
    """
    elements = F.posexplode(F.col(value).try_cast("array<variant>")).alias("pos", "_element")
    opened = df.withColumn("header", record_header(F.col(value))).select("*", elements)
    rows = opened.filter(variant_kind(F.col("_element")) == "object").withColumn(
        "_fields", F.col("_element").try_cast("map<string,variant>")
    )
    fields = F.col("_fields")
    return (
        rows.withColumn("cells", F.transform("header", lambda k: cell_text(F.try_element_at(fields, k))))
        .withColumn("dropped_keys", F.size(F.array_except(F.map_keys(fields), "header")))
        .drop("_element", "_fields", value)
    )


def csv_document(value: Column) -> Column:
    """CSV text of an array of objects; an empty array gives an empty text."""
    header = record_header(value)
    records = F.filter(
        F.transform(value.try_cast("array<variant>"), lambda e: e.try_cast("map<string,variant>")),
        lambda r: r.isNotNull(),
    )
    lines = F.transform(
        records, lambda r: csv_line(F.transform(header, lambda k: cell_text(F.try_element_at(r, k))))
    )
    text = F.concat(F.array_join(F.concat(F.array(csv_line(header)), lines), "\n"), F.lit("\n"))
    return F.when(header.isNull(), F.lit("")).otherwise(text)


def json_from_records(df: DataFrame, columns: list[str], name: str = "json") -> DataFrame:
    """One JSON object of strings per record; keys sorted, an absent cell is ''."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(columns)]
    return df.withColumn(name, F.to_json(F.struct(*cells)))


def json_from_cells(header: Column, cells: Column) -> Column:
    """The same for a header and a cell array; of repeated headers the last wins."""
    pairs = F.map_from_arrays(header, cells)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def shape_gate(df: DataFrame, value: str = "value", target: str = "target") -> DataFrame:
    """Add ``shape`` and, when the target cannot hold it, ``error``."""
    shaped = df.withColumn("shape", shape_of(F.col(value)))
    return shaped.withColumn("error", shape_error(F.col("shape"), F.col(target)))


def _open_level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each non-empty container by its parts; everything else stays."""
    row_type = "array<struct<step:string,node:variant>>"
    node = F.col("_node")
    fields = F.transform(
        F.map_entries(node.try_cast("map<string,variant>")),
        lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), e["value"].alias("node")),
    )
    items = F.transform(
        node.try_cast("array<variant>"),
        lambda e, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), e.alias("node")),
    )
    itself = F.array(F.struct(F.lit("").alias("step"), node.alias("node")))
    # an empty container has nothing to open and stays a leaf
    inside = F.filter(
        F.array(F.coalesce(fields.cast(row_type), items.cast(row_type))), lambda part: F.size(part) > 0
    )
    opened = rows.select(*keys, "key_path", F.inline(F.coalesce(F.get(inside, F.lit(0)), itself.cast(row_type))))
    return opened.select(*keys, F.concat("key_path", "step").alias("key_path"), F.col("node").alias("_node"))


def _leaves(rows: DataFrame, keys: list[str]) -> DataFrame:
    node = F.col("_node")
    kind = variant_kind(node)
    text = F.when(kind == "string", F.try_variant_get(node, "$", "string"))
    return rows.select(*keys, "key_path", kind.alias("type"), F.coalesce(text, F.to_json(node)).alias("leaf"))


def flatten_documents(
    df: DataFrame, keys: list[str], value: str = "value", levels: int = LEVELS, depth: int | None = None
) -> DataFrame:
    """(keys, key_path, type, leaf): one row per leaf of each document, however deep.

    A pass opens ``levels`` levels within one map stage and is written; as long as it leaves a
    non-empty container, only what is below such containers goes through another pass. An empty
    container is a leaf of its own. With ``depth`` containers below that level are kept as JSON
    text, and one pass without writing does.
    """
    rows = df.select(*keys, F.lit("$").alias("key_path"), F.col(value).alias("_node"))
    if depth is not None:
        for _ in range(depth):
            rows = _open_level(rows, keys)
        return _leaves(rows, keys)
    done = None
    while True:
        for _ in range(levels):
            rows = _open_level(rows, keys)
        node = F.col("_node")
        filled = (F.size(node.try_cast("map<string,variant>")) > 0) | (F.size(node.try_cast("array<variant>")) > 0)
        rows, remaining = settle_counting(rows.withColumn("_open", F.coalesce(filled, F.lit(False))), F.col("_open"))
        closed = _leaves(rows.filter(~F.col("_open")), keys)
        done = closed if done is None else done.unionByName(closed)
        if not remaining:
            return done
        rows = rows.filter("_open").drop("_open")


def convert_batch(items: DataFrame) -> DataFrame:
    """Convert data documents (ext, text, target); a bad one yields an error, not a failure.

    Adds ``output`` and ``error``, exactly one of them set. JSON comes back compact.
    """
    parsed = decode_documents(items, "ext", "text")
    shape = shape_of(F.col("value"))
    misfit = shape_error(shape, F.col("target"))
    written = F.when(F.col("target") == "json", F.to_json("value")).when(
        F.col("target") == "csv", csv_document(F.col("value"))
    )
    error = F.coalesce(
        F.col("decode_error"),
        misfit,
        F.when(
            ~F.coalesce("target", F.lit("")).isin("json", "csv"),
            error_text("unsupported_target", F.col("target")),
        ),
    )
    done = parsed.withColumn("error", error)
    return done.withColumn("output", F.when(F.col("error").isNull(), written)).drop("value", "decode_error")


def parse_strict(df: DataFrame, text: str = "text") -> DataFrame:
    """``value`` and ``error`` of a strict JSON parse."""
    return read_json_documents(df, text)
