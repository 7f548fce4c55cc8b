"""What the operators of this subpackage share: tables, row keys, words, and text kernels for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliograph.session import settle

# A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\t\n\x0b\x0c\r "

BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of id and text: rows that share it are treated alike, so repeated rows need no numbering."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def bucket(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``n``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """``settle`` and the number of rows, which the file footers tell."""
    frozen = settle(df)
    return frozen, frozen.count()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a written table of narrow rows if its count is below the bound; otherwise let it shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# --- texts as bytes, for functions that see Arrow batches -------------------------------

CHUNK = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MIX = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """0th to (n-1)th power of an odd constant, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers)), _STEP, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``data[start:end]``; runs ascend and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    places = np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)
    inside = places - np.repeat(starts, lengths)
    values = _MIX[data[places]] * powers(int(lengths.max()) if len(lengths) else 0)[inside]
    sums = np.add.reduceat(np.append(values, np.uint64(0)), before)
    sums[lengths == 0] = 0  # reduceat gives an empty run the value at its place
    return scramble(sums + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def chunks(texts: list[bytes | None], size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) for runs of texts of about ``size`` bytes, each text closed by a line break.

    Text i takes ``bytes[offsets[i]:offsets[i + 1] - 1]``. A longer text makes a chunk of its own.
    """
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last] or b"") <= size):
            total += len(texts[last] or b"")
            last += 1
        part = [t or b"" for t in texts[first:last]]
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        yield first, np.frombuffer(b"\n".join(part) + b"\n", np.uint8), offsets
        first = last


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    space = _IS_SPACE[data].view(np.int8)
    edges = np.diff(space, prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, also where that is empty."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one, equal to any other one) for each key."""
    later, any_other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:]] = same
        any_other[order[1:]] = same
        any_other[order[:-1][same]] = True
    return later, any_other


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, fold: Column) -> DataFrame:
    """``docs`` joined with ``_label`` for at most ``sample`` ids, those of the smallest digest inside ``fold``.

    NULL ids and labels, and ids whose labels differ, are left out. Ids are chosen before any text is read;
    the bound on their number is what makes the broadcast safe.
    """
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_top")
    )
    usable = agreed.where((F.col("_label") == F.col("_top")) & fold)
    present = usable.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("_h", F.xxhash64("doc_id"))
    chosen = present.orderBy("_h", "doc_id").limit(sample).select("doc_id", "_label")
    return docs.join(F.broadcast(chosen), "doc_id")
