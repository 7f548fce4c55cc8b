"""JSON checks, document shapes and format sniffing."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from foliograph.catalog import ERRORS
from foliograph.functions.text import trim_space

NO_TOP_LEVEL_ARRAY = ERRORS["toml_array"]
NEEDS_RECORDS = ERRORS["csv_shape"]

# --- fixed value: the JVM's JSON parser reads no string beyond this ---
PARSER_BYTES = 20_000_000


def _sealed(text: Column) -> Column:
    """The text as first element of a list that its own digest ends.

    The parser ignores whatever follows the first value it has read. If the digest is read
    back as second element, the whole text before it was exactly one value.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


_HEX = "[0-9A-Fa-f]"
_PAIR = rf"u[dD][89abAB]{_HEX}{{2}}\\u[dD][c-fC-F]{_HEX}{{2}}"  # what follows the first backslash of a character beyond 16 bits


def _half_character(text: Column) -> Column:
    """Some escape is half a surrogate pair, which the JVM's parser takes and strict ones refuse."""
    whole = F.regexp_replace(text, rf"\\(?:[^u]|{_PAIR})", "x")
    return F.when(F.contains(text, F.lit("\\u")), whole.rlike(r"\\u[dD][89a-fA-F]")).otherwise(F.lit(False))


def _intact(sealed: Column, text: Column) -> Column:
    return F.coalesce(F.try_variant_get(sealed, "$[1]", "string") == F.md5(text), F.lit(False)) & ~_half_character(text)


def _beyond(text: Column) -> Column:
    """The parser may have given up for size: its longest string is no longer than this."""
    return F.octet_length(text) > PARSER_BYTES


# Steps that leave of a text only what its grammar is made of: escapes become a letter, which is wrong outside of strings, strings and
# other scalars one sign each, and blanks go. No step has a loop that backtracks.
_STRING, _SCALAR = "\x01", "\x02"
_STEPS = [
    (rf'\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F]){_HEX}{{4}}|{_PAIR})', "x"),
    (r'"[^"\\\x00-\x1f]*+"', _STRING),
    (r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null", _SCALAR),
    (r"[ \t\n\r]++", ""),
]
_INNERMOST = r"\[(?:[\x01\x02](?:,[\x01\x02])*+)?+\]|\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?+\}"
DEPTH = 1000  # as deep as the JVM's parser goes


def is_json_by_reduction(text: Column) -> Column:
    """Strict validity of a text of any size: the innermost lists and objects become scalars until nothing but one is left."""
    bare = text
    for pattern, sign in _STEPS:
        bare = F.regexp_replace(bare, pattern, sign)

    def once(state: Column, _: Column) -> Column:
        less = F.regexp_replace(state["t"], _INNERMOST, _SCALAR)
        changed = F.struct(less.alias("t"), F.length(state["t"]).alias("n"))
        return F.when(F.length(state["t"]) < state["n"], changed).otherwise(state)

    first = F.struct(bare.alias("t"), (F.length(bare) + 1).alias("n"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), first, once)
    return ~text.rlike(r"[\x01\x02]") & last["t"].isin(_STRING, _SCALAR)


def is_json(text: Column) -> Column:
    """Strict validity of the whole text. Texts that the parser cannot read for their size are reduced instead."""
    intact = _intact(_sealed(text), text)
    large = F.coalesce(_beyond(text), F.lit(False))
    return F.when(intact, True).when(large, is_json_by_reduction(text)).otherwise(F.lit(False))


def json_error(text: Column, value: Column) -> Column:
    """Why ``strict_json`` of the text gave no value, NULL when it did. A valid document may be too large for a value."""
    too_large = _beyond(text) & is_json_by_reduction(text)
    return F.when(
        value.isNull(), F.when(too_large, F.lit("JSON document too large")).otherwise(F.lit("Invalid JSON"))
    )


def strict_json(text: Column) -> Column:
    """The parsed value, NULL unless the whole text is one JSON value."""
    kept = F.filter(F.array(_sealed(text)), lambda sealed: _intact(sealed, text))
    return F.try_variant_get(F.get(kept, F.lit(0)), "$[0]", "variant")


def variant_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null. Containers are told by a shallow
    cast; the schema of a whole document is never worked out."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value.try_cast("map<string,variant>").isNotNull(), "object")
        .when(value.try_cast("array<variant>").isNotNull(), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def shape_of(value: Column) -> Column:
    """object, array_of_objects, empty_array, array or scalar.

    Only the first element decides: later ones that are no objects are skipped on writing.
    """
    kind = variant_kind(value)
    first = variant_kind(F.try_variant_get(value, "$[0]", "variant"))
    return (
        F.when(kind == "object", "object")
        .when((kind == "array") & first.isNull(), "empty_array")
        .when((kind == "array") & (first == "object"), "array_of_objects")
        .when(kind == "array", "array")
        .otherwise(F.when(kind.isNotNull(), "scalar"))
    )


def shape_error(shape: Column, target: Column) -> Column:
    """Why a document of this shape cannot be written as ``target``, NULL when it can."""
    is_array = shape.isin("array", "array_of_objects", "empty_array")
    return F.when((target == "toml") & is_array, NO_TOP_LEVEL_ARRAY).when(
        (target == "csv") & ~shape.isin("array_of_objects", "empty_array"), NEEDS_RECORDS
    )


def cell_text(value: Column) -> Column:
    """A CSV cell: strings raw, everything else compact JSON, '' when missing."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(text, F.to_json(value), F.lit(""))


def csv_line(cells: Column) -> Column:
    """One CSV record; a cell is quoted only when it has to be."""
    quoted = F.transform(
        cells,
        lambda c: F.when(
            c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(c),
    )
    line = F.array_join(quoted, ",")
    return F.when((F.size(cells) == 1) & (line == ""), F.lit('""')).otherwise(line)


def toml_shaped(text: Column) -> Column:
    """Some line is a ``[header]`` or holds `` = `` between two other characters."""

    def shaped(line: Column) -> Column:
        bare = trim_space(line)
        header = bare.startswith("[") & bare.endswith("]") & (F.octet_length(bare) > 2)
        return header | F.contains(bare, F.lit(" = "))

    possible = F.contains(text, F.lit(" = ")) | F.contains(text, F.lit("["))
    return F.when(possible, F.exists(F.split(text, "\n"), shaped)).otherwise(F.lit(False))


@F.pandas_udf(StringType())
def _format_of(texts: pd.Series) -> pd.Series:
    """``toml`` where a text is a TOML document."""

    def named(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            tomllib.loads(text.replace("\r\n", "\n"))
        except (tomllib.TOMLDecodeError, RecursionError, ValueError):
            return None
        return "toml"

    return texts.map(named).astype(object)


def sniff_format(text: Column) -> Column:
    """json, xml, toml or txt, in this order of preference.

    Everything but the TOML parse runs in the JVM; only texts that passed the line test
    and none of the earlier formats travel to Python, all others as NULL.
    """
    bare = trim_space(text)
    braced = bare.startswith("{") | bare.startswith("[")
    parsed = F.when(braced, F.coalesce(is_json(text), F.lit(False))).otherwise(F.lit(False))
    xml = bare.startswith("<") & bare.endswith(">") & F.contains(bare, F.lit("</"))
    candidate = F.when((bare != "") & ~parsed & ~xml & toml_shaped(text), text)
    return (
        F.when(bare == "", "txt")
        .when(parsed, "json")
        .when(xml, "xml")
        .otherwise(F.coalesce(_format_of(candidate), F.when(text.isNotNull(), "txt")))
    )
