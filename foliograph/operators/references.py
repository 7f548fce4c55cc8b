"""Texts that may name a known file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph.functions.documents import sniff_format
from foliograph.functions.paths import percent_decode
from foliograph.functions.text import trim_space
from foliograph.session import per_key

_SCHEME = "file://"


def named_path(text: Column) -> Column:
    """The path a whole text stands for: a ``file://`` reference or one absolute path on a
    single line. NULL for any other text."""
    bare = trim_space(text)
    single = ~bare.rlike(r"[\n\r\x00]")
    return F.when(bare.startswith(_SCHEME), percent_decode(F.substr(bare, F.lit(len(_SCHEME) + 1)))).when(
        single & bare.startswith("/"), bare
    )


def resolve_refs(texts: DataFrame, manifest: DataFrame, text: str = "text") -> DataFrame:
    """Add ``path`` where the text names a file of the manifest, else the sniffed ``format``.

    Only texts that could name a file are joined; the bodies of all others are neither
    shuffled nor gathered under one NULL key.
    """
    marked = texts.withColumn("_named", named_path(F.col(text)))
    known = per_key(manifest.select(F.col("path").alias("_named")), ["_named"], F.first("_named").alias("path"))
    joined = marked.filter(F.col("_named").isNotNull()).join(known, "_named", "left")
    others = marked.filter(F.col("_named").isNull()).withColumn("path", F.lit(None).cast("string"))
    both = joined.unionByName(others).drop("_named")
    return both.withColumn("format", sniff_format(F.when(F.col("path").isNull(), F.col(text))))
