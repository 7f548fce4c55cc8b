"""SimHash near-duplicates: fingerprints, keys from the binary Golay code, verified links, components.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Three differing bits fall on them in one of two ways:
either some segment is equal and one of the others differs in one bit at most, or each differs in exactly one, so that
of the halves of the first one is equal, and of the last likewise. The Golay code of length 23 is perfect: each
segment has one codeword within three bits, and a segment that differs in one bit has that same codeword within four.
A key is what is equal, exactly, with the codeword of the segment that may differ: 30 bits of the fingerprint or more.
Each fingerprint is filed under its nearest codewords (ten keys) and looks under every codeword within four bits
(one to six a segment): no pair is missed, and each candidate is verified by its differing bits.

Texts of a similarity of 0.8 can differ in a dozen bits, where a fingerprint alone singles out too little. ``keep_one``
therefore files a text under the codewords of each segment together with least shingles, and verifies on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from foliograph.llm.common import run_hashes, scramble, small, spans, written
from foliograph.llm.graphs import components
from foliograph.session import per_key, settle

# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 3
SHINGLE = 3


def _fingerprint(text: bytes | None, block: int = 1 << 15) -> int:
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    width = min(SHINGLE, len(parts))
    starts, ends = starts[: len(parts) - width + 1], ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), block):
        few = zip(starts[at : at + block].tolist(), ends[at : at + block].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in few], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed 64-bit number, of ``docs`` with a column text."""
    schema = docs.select(*keep).schema.add("fp", "long", False)
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(x.as_py()) for x in batch.column("_text")]
            columns = [batch.column(n) for n in names] + [pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "fp"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- Golay keys -------------------------------------------------------------------------


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GOLAY << (bit - 11)
    return v


def error_table() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the 23 bits, for each syndrome the error patterns of up to four bits, nearest first, -1 after them)."""
    single = np.array([_remainder(1 << i) for i in range(23)])
    table = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            table[syndrome, filled[syndrome]] = sum(1 << b for b in bits)
            filled[syndrome] += 1
    return single, table


def _codewords(fps: np.ndarray, single: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """For each segment an array (fingerprint, 6) of codewords, -1 where there are fewer."""
    found = []
    for first, width in SEGMENTS:
        value = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(fps), np.int64)
        for bit in range(width):
            syndrome ^= np.where(value >> bit & 1, single[bit], 0)
        errors = table[syndrome]
        found.append(np.where(errors < 0, -1, value[:, None] ^ errors))
    return found


def _keys(fps: np.ndarray, codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Per kind of key an array (fingerprint, codewords of one segment) of keys, -1 where there is none."""
    segments = [(fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    halves = [[(0, 12), (12, 11)], [(0, 9), (9, 9)]]
    equal = [(segments[i], codes[j]) for i, j in permutations(range(3), 2)]
    for (low, n), (at, m) in product(*halves):
        part = (segments[0] >> low & (1 << n) - 1) << 9 | segments[2] >> at & (1 << m) - 1
        equal.append((part, codes[1]))
    for kind, (same, code) in enumerate(equal):
        yield np.where(code < 0, -1, kind << 58 | same[:, None] << 23 | code)


def golay_keys(fps: DataFrame, every: bool) -> DataFrame:
    """(key, fp, comp) for ``fps`` (fp, comp): the ten keys a fingerprint is filed under, or all that it looks under."""
    single, table = error_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fp").to_numpy().view(np.uint64)
                comps = part.column("comp").to_numpy()
                codes = _codewords(fps, single, table)
                for keys in _keys(fps, codes if every else [c[:, :1] for c in codes]):
                    rows, places = np.nonzero(keys >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[rows, places]), pa.array(fps[rows].view(np.int64)), pa.array(comps[rows])],
                        names=["key", "fp", "comp"],
                    )

    return fps.mapInArrow(run, "key long, fp long, comp long")


def _near_edges(fps: DataFrame) -> DataFrame:
    """Links between fingerprints that differ inside one run of three bits: never more than a star of eight each."""
    runs = [(i, 0b111 << i) for i in range(0, 64, MAX_BITS)]
    signed = [(i, (~m & (2**64 - 1)) - 2**64 if ~m & 2**63 else ~m & (2**64 - 1)) for i, m in runs]
    masked = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, m in signed]
    grouped = (
        fps.select("fp", F.explode(F.array(*masked)).alias("k"))
        .groupBy("k")
        .agg(F.collect_list("fp").alias("fps"), F.min("fp").alias("v"))
        .where(F.size("fps") > 1)
    )
    return grouped.select(F.explode("fps").alias("u"), "v").where("u != v")


def _labelled(fps: DataFrame, comps: DataFrame) -> DataFrame:
    named = comps.withColumnRenamed("node", "fp")
    return fps.join(named, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, comp) for distinct ``fps`` (fp): comp is one fingerprint of all that are linked at three bits or fewer.

    Links inside a run of three bits are joined first, as stars. The Golay join then returns only pairs
    whose components still differ, so a crowd of near copies does not come out as all its pairs.
    """
    first = settle(_labelled(fps, components(_near_edges(fps))))
    filed = golay_keys(first, False).toDF("key", "fp", "comp")
    looking = golay_keys(first, True).toDF("key", "fp2", "comp2")
    close = (F.col("comp") != F.col("comp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS)
    pairs = looking.join(filed.hint("shuffle_hash"), (looking["key"] == filed["key"]) & close)
    links = pairs.select(F.least("comp", "comp2").alias("v"), F.greatest("comp", "comp2").alias("u")).distinct()
    merged = components(links).toDF("comp", "top")
    return first.join(merged, "comp", "left").select("fp", F.coalesce("top", "comp").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of three differing bits or fewer. Texts without words,
    NULL ones included, have fingerprint zero and are linked like any other. Rows that repeat an id each get
    their own row. NULL ids get a component too, but name one only if it has no other id (then NULL). An empty
    table gives an empty table. Copies meet as one fingerprint before any join, so a group of any size is one row there.
    """
    rows = settle(with_fingerprint(docs, ["doc_id"]))
    distinct = settle(per_key(rows, ["fp"], F.min("doc_id").alias("least")))
    comps = settle(fingerprint_components(distinct.select("fp")))
    least = distinct.join(comps, "fp").groupBy("comp").agg(F.min("least").alias("component_id"))
    named = per_key(comps.join(least, "comp"), ["fp"], F.min("component_id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# --- near copies beyond three bits -------------------------------------------------------

WIDTH, SIMILARITY = 5, 0.8
BANDS = 6
_RNG = np.random.Generator(np.random.PCG64(9))
_ORDERS = _RNG.integers(0, 2**63, 2 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
LONG_WORD = 1 << 16


def _word_hashes(text: bytes | None, block: int = 1 << 15) -> np.ndarray:
    data = np.frombuffer((text or b"").lower() + b" ", np.uint8)
    starts, ends = spans(data)
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), block):
        a, b = starts[at : at + block], ends[at : at + block]
        if (b - a).max() > LONG_WORD:
            hashes[at : at + block] = [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(a.tolist(), b.tolist())]
        else:
            hashes[at : at + block] = run_hashes(data[a[0] : b[-1]], a - a[0], b - a[0])
    return hashes


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of ``WIDTH`` lower-case words, hashed; the whole sequence where there are fewer words."""
    hashes = _word_hashes(text)
    width = min(WIDTH, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    mixed = np.full(n, width, np.uint64)
    for j in range(width):
        mixed += hashes[j : j + n] * _PLACES[j]
    return np.unique(scramble(mixed))


def _bands(shingles: np.ndarray) -> np.ndarray:
    """A number per band, made of the least shingle in each of two orders."""
    least = np.array([(shingles * a).min() for a in _ORDERS])
    return scramble(least[:BANDS] * _ORDERS[:BANDS] + least[BANDS:])


def _majority(hashes: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The bits that are set in over half the ``hashes``, as one number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def with_sketch(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, fp, and of the set of five-word shingles the digest ``sid``, size ``n``, SimHash ``fp5`` and ``bands``."""
    schema = docs.select(*keep).schema.add("fp", "long", False).add("sid", "long").add("n", "long").add("fp5", "long").add("bands", ArrayType(LongType()))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sids, sizes, others, bands = [], [], [], [], []
            for x in batch.column("_text"):
                text = x.as_py()
                shingles = shingle_set(text)
                fps.append(_fingerprint(text))
                sizes.append(len(shingles))
                others.append(int(_majority(shingles).view(np.int64)))
                sids.append(int(shingles.sum(dtype=np.uint64).view(np.int64)))
                bands.append(_bands(shingles).view(np.int64).tolist() if len(shingles) else [])
            columns = [batch.column(k) for k in keep]
            columns += [pa.array(numbers, pa.int64()) for numbers in (fps, sids, sizes, others)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], names=names)

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)


def _shared_bands(units: DataFrame) -> DataFrame:
    """(band, sid, fp, fp5, n, comp) of the bands that units of more than one component have."""
    every = units.select(F.explode("bands").alias("band"), "sid", "fp", "fp5", "n", "comp")
    spread = per_key(every, ["band"], F.min("comp").alias("low"), F.max("comp").alias("high"))
    return every.join(spread.where("low != high").select("band"), "band", "left_semi")


def _fuzzy_keys(shared: DataFrame) -> DataFrame:
    """(key, sid, fp, n, comp): each band with every codeword within four bits of each segment of both fingerprints."""
    single, table = error_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bands = part.column("band").to_numpy().view(np.uint64)
                both = [part.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp5")]
                for segment, code in enumerate(code for fps in both for code in _codewords(fps, single, table)):
                    rows, places = np.nonzero(code >= 0)
                    keys = scramble(bands[rows] + scramble((code[rows, places] << 3 | segment).astype(np.uint64)))
                    columns = [pa.array(part.column(c).to_numpy()[rows]) for c in ("sid", "fp", "n", "comp")]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *columns], names=["key", "sid", "fp", "n", "comp"])

    return shared.select("band", "sid", "fp", "fp5", "n", "comp").mapInArrow(run, "key long, sid long, fp long, n long, comp long")


def _sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, fp, hs): the shingles of each of ``wanted`` (sid, fp, _key), from one of its texts."""
    wanted, n = written(wanted)
    texts = keyed.join(small(wanted, n), "_key").select("sid", "fp", F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                hs = pa.array([shingle_set(one.column("_text")[0].as_py()).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([one.column("sid"), one.column("fp"), hs], names=["sid", "fp", "hs"])

    found = texts.mapInArrow(run, "sid long, fp long, hs array<long>")
    return per_key(found, ["sid", "fp"], F.first("hs").alias("hs"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): components of the ``pairs`` whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more."""
    both = pairs.join(sets, ["sid", "fp"]).join(sets.toDF("sid2", "fp2", "hs2"), ["sid2", "fp2"])
    common = F.size(F.array_intersect("hs", "hs2"))
    similar = common >= SIMILARITY * (F.size("hs") + F.size("hs2") - common)
    return both.where(similar).select(F.least("comp", "comp2").alias("v"), F.greatest("comp", "comp2").alias("u")).distinct()


def _prefix_pairs(open_units: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``open_units`` (sid, fp, n, comp) of different components that can reach ``SIMILARITY``; no such pair is missed.

    Shingles are ordered by how many of these texts have them, rare ones first. Similar sets meet in the first ninth of the smaller one and
    the first fifth of the larger one, and where they first meet both have enough left to reach the overlap they need. Texts
    that share much, but not enough, differ in rare shingles, which come before those they share.
    """
    opened = open_units.join(sets, ["sid", "fp"]).select("sid", "fp", "n", "comp", F.explode("hs").alias("h"))
    shared = per_key(opened, ["h"], F.count(F.lit(1)).alias("texts"))
    inside = Window.partitionBy("sid", "fp").orderBy("texts", "h")
    placed = opened.join(shared, "h").withColumn("at", F.row_number().over(inside) - 1)
    first = settle(placed.where((F.col("at") <= (1 - SIMILARITY) * F.col("n") + 1) & (F.col("texts") > 1)).drop("texts"))
    short = first.where(F.col("at") <= (1 - 2 * SIMILARITY / (1 + SIMILARITY)) * F.col("n") + 1)
    larger = first.toDF(*["h" if c == "h" else f"{c}2" for c in first.columns])
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    ordered = F.struct("n", "sid", "fp") < F.struct(F.col("n2").alias("n"), F.col("sid2").alias("sid"), F.col("fp2").alias("fp"))
    reach = (F.col("comp") != F.col("comp2")) & ordered & (most >= SIMILARITY * (F.col("n") + F.col("n2") - most))
    met = short.hint("shuffle_hash").join(larger, (short["h"] == larger["h"]) & reach)
    return met.select("sid", "fp", "comp", "sid2", "fp2", "comp2").distinct()


def text_components(rows: DataFrame, keyed: DataFrame, comps: DataFrame) -> DataFrame:
    """``comps`` (fp, comp) merged where texts have five-word shingles of a similarity of 0.8 or more.

    Texts are candidates if they share a band (the least shingle in two orders) and, under it, a codeword within four
    bits of a segment of either fingerprint (three-word and five-word shingles), so that a band of a frequent passage is split. Stars around one text of
    a key come first; texts of keys whose components still differ then meet by their rarest shingles (``_prefix_pairs``), because
    texts that share a key without being similar would come out as all their pairs. All are verified on their whole shingle sets.
    """
    some = per_key(rows.where("n > 0"), ["sid", "fp"], F.min(F.struct("_key", "n", "fp5", "bands")).alias("one"))
    units = settle(some.join(comps, "fp").select("sid", "fp", "one.*", "comp"))
    keys = settle(_fuzzy_keys(_shared_bands(units)))
    fits = (F.col("comp") != F.col("comp2")) & (F.least("n", "n2") >= SIMILARITY * F.greatest("n", "n2"))
    wanted = ["sid", "fp", "comp", "sid2", "fp2", "comp2"]
    other = ["sid2", "fp2", "n2", "comp2"]
    hubs = per_key(keys, ["key"], F.min(F.struct("sid", "fp", "n", "comp")).alias("hub"))
    hubs = hubs.select("key", *[F.col(f"hub.{c[:-1]}").alias(c) for c in other])
    stars = settle(keys.join(hubs, "key").where(fits).select(*wanted).distinct())
    ends = stars.select("sid", "fp").unionByName(stars.select(F.col("sid2").alias("sid"), F.col("fp2").alias("fp"))).distinct()
    sets = settle(_sets(keyed, units.join(ends, ["sid", "fp"]).select("sid", "fp", "_key")))
    first = settle(components(_verified(stars, sets)).toDF("comp", "top"))
    now = settle(keys.join(first, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top"))
    spread = per_key(now, ["key"], F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    open_units = settle(now.join(spread, "key", "left_semi").select("sid", "fp", "n", "comp").distinct())
    sets = settle(_sets(keyed, units.join(open_units, ["sid", "fp"]).select("sid", "fp", "_key")))
    second = components(_verified(settle(_prefix_pairs(open_units, sets)), sets)).toDF("top", "last")
    named = comps.join(first, "comp", "left").withColumn("top", F.coalesce("top", "comp")).join(second, "top", "left")
    return named.select("fp", F.coalesce("last", "top").alias("comp"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) without the near duplicates: of each component the row of the smallest doc_id stays.

    Texts are linked if their fingerprints differ in three bits or fewer, or if their sets of five-word shingles have a
    Jaccard similarity of 0.8 or more (``text_components``). Texts without words, NULL ones included, are one component. Rows that
    repeat id and text count as one; a NULL id stays only where its component has no other. Columns may have any
    names. An empty table gives an empty table.
    """
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_key"))
    rows = settle(with_sketch(keyed, ["doc_id", "_key"]))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("_key"))).alias("best")
    distinct = settle(per_key(rows, ["fp"], best))
    comps = settle(fingerprint_components(distinct.select("fp")))
    wide = text_components(rows, keyed, comps)
    kept = distinct.join(wide, "fp").groupBy("comp").agg(F.min("best").alias("best")).select("best._key")
    # a struct is never NULL, so rows with a NULL id are joined like any other
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
