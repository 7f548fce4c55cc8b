"""Language-model scoring by prediction by partial matching over bytes, next to a smoothed word count.

A text is the sequence of its lower-case words, each followed by a blank, and an end sign. The trie of byte contexts is kept
as one table of n-grams per order: its counts give, for every context, the probability of each symbol seen
after it and that of an escape to the context one byte shorter, where the symbols already ruled out are excluded.
Half a count of each seen symbol goes to the escape (method D).
Since a symbol seen after a context was also seen after every shorter one, what is excluded below a context depends
on that context alone, so all of it is worked out once per node.

The trie is a Spark table of any size. Frequent n-grams travel to the tasks with their probability; all others are walked
down the orders once each, by joins in which a key has 256 rows at most, and joined with the rows that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from foliograph.llm.common import bucket, chunks, run_hashes, spans, sums
from foliograph.session import settle

ORDER = 5  # bytes of context; an n-gram of one byte more has to fit into 63 bits
HEAD_GRAMS = 1 << 20  # n-grams of the full order whose probabilities travel to the tasks; all others are joined
HEAD_WORDS = 1 << 19  # words whose counts travel to the tasks; all others are joined
CHUNK = 1 << 18  # bytes of text worked on at a time
HELD = 1 << 20  # distinct n-grams and words a task holds before it hands them on
BLANK, END = 32, 10
END_WORD = -1  # stands for the end sign among the hashes of words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def streams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): per text zeros and an end sign as its history, then its words with blanks, then the end sign."""
    lengths = ends - starts + 1
    texts = len(first) - 1
    words_before = np.concatenate(([0], np.cumsum(lengths)))
    bounds = words_before[first] + np.arange(texts + 1) * (ORDER + 1)
    out = np.zeros(bounds[-1], np.uint8)
    owner = np.repeat(np.arange(texts), np.diff(first))
    into = words_before[:-1] + owner * (ORDER + 1) + ORDER
    place = np.arange(words_before[-1]) - np.repeat(words_before[:-1], lengths)
    source = np.minimum(np.repeat(starts, lengths) + place, len(data) - 1)
    symbols = np.where(place == np.repeat(lengths - 1, lengths), BLANK, data[source])
    out[np.repeat(into, lengths) + place] = symbols
    out[bounds[:-1] + ORDER - 1] = END
    out[bounds[1:] - 1] = END
    return out, bounds


def grams(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends with each coded symbol, bounds of the texts among them); histories are not coded."""
    packed = np.zeros(max(0, len(stream) - ORDER), np.int64)
    for i in range(ORDER + 1):
        packed = packed << 8 | stream[i : i + len(packed)]
    coded = np.ones(len(packed), bool)  # element i codes byte i + ORDER
    for i in range(ORDER):
        spots = bounds[1:-1] + i - ORDER
        coded[spots] = False
    at = np.concatenate(([0], np.cumsum(np.diff(bounds) - ORDER)))
    return packed[coded], at


def _prepared(texts: list[bytes | None]):
    """Per chunk: (hashes of words, first word of each text, n-grams, first n-gram of each text)."""
    for _, data, offsets in chunks(texts, CHUNK):
        low = _LOWER[data]
        starts, ends = spans(low)
        first = np.searchsorted(starts, offsets)
        hashes = run_hashes(low, starts, ends).view(np.int64)
        hashes = np.where(hashes == END_WORD, 0, hashes)
        yield hashes, first, *grams(*streams(low, starts, ends, first))


def _counted(parts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(weights)).astype(np.int64)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): how often each n-gram of the full order (kind 0) and each word (kind 1) occurs in ``docs`` (text).

    Tasks count chunk by chunk, merge, and hand on what they hold when it has grown to a bound and at the end;
    the sums per key are Spark's.
    """

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 1 << 16):
            part = slice(at, at + (1 << 16))
            columns = [np.full(len(key[part]), kind, np.int32), key[part], n[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
        for batch in batches:
            for hashes, first, codes, _ in _prepared(batch.column("_text").to_pylist()):
                for kind, keys in ((0, codes), (1, np.append(hashes, np.full(len(first) - 1, END_WORD)))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(key) for key, _ in held[kind]) > 2 * HELD:
                        held[kind] = [_counted(*zip(*held[kind]))]
                        if len(held[kind][0][0]) > HELD:
                            yield from rows(kind, *held[kind].pop())
        for kind, parts in held.items():
            if parts:
                yield from rows(kind, *_counted(*zip(*parts)))

    seen = docs.select(F.col("text").cast("binary").alias("_text")).mapInArrow(run, "kind int, key long, n long")
    return seen.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _levels(table: DataFrame, *keys: str) -> dict[tuple, int]:
    """Rows per ``keys`` and power of two of their count: a histogram of 64 bins a key."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    return {tuple(r[:-1]): r[-1] for r in table.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("rows")).collect()}


def _threshold(bins: dict[int, int], most: int, least: int = 0) -> int:
    """The lowest level from ``least`` on such that the rows of it and all above are at most ``most``."""
    total, level = 0, 64
    while level > least and total + bins.get(level - 1, 0) <= most:
        level -= 1
        total += bins.get(level, 0)
    return level


class _Table:
    """Values of sorted keys, found by hashing into open addresses."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(1.4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.index = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]  # the last of several writers stays
            won = free & (self.slots[at] == keys[left])
            self.index[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key (none negative), -1 if it is not there."""
        at = self._home(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.index[at], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slots) - 1)
            held = self.slots[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.index[at[hit]]
            on = ~hit & (held >= 0)
            open_, at = open_[on], at[on]
        return out


def build(orders: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Nodes per order from (n-gram, count) per order, sorted; what ``log_probability`` needs, as logarithms to base 10."""
    model, lower = [], None
    for order, (keys, n) in enumerate(orders):
        contexts, start = np.unique(keys >> 8, return_index=True)
        edges = np.append(start, len(keys))
        total = sums(n, edges).astype(np.float64)
        kinds = np.diff(edges).astype(np.float64)
        node = np.repeat(np.arange(len(contexts)), np.diff(edges))
        level = {"size": len(keys), "keys": keys, "contexts": contexts, "count": np.log10(n - 0.5).astype(np.float32)}
        level["seen"] = (level["count"] - np.log10(total)[node]).astype(np.float32)
        level["escape"] = (np.log10(kinds / 2) - np.log10(total)).astype(np.float32)
        if lower is None:
            below_total, below_kinds = np.zeros(1), np.full(1, 256.0)
            rest_total, rest_kinds = np.zeros(len(contexts)), 256.0 - kinds
        else:
            suffix = keys & ((1 << 8 * order) - 1)
            under = np.searchsorted(lower["keys"], suffix)
            excluded = sums(lower["n"][under], edges)
            parent = np.searchsorted(lower["contexts"], contexts & ((1 << 8 * (order - 1)) - 1) if order > 1 else np.zeros(len(contexts), np.int64))
            rest_total, rest_kinds = lower["total"][parent] - excluded, lower["kinds"][parent] - kinds
        with np.errstate(divide="ignore"):
            level["below"] = np.log10(rest_total if order else rest_kinds)  # -inf: the shorter context has nothing else
            level["below_escape"] = np.where(rest_kinds > 0, np.log10(np.maximum(rest_kinds, 1) / 2) - np.where(rest_kinds > 0, level["below"], 0), 0)
        lower = {"keys": keys, "n": n, "contexts": contexts, "total": total, "kinds": kinds}
        model.append(level)
    return model


class Scorer:
    """The walk over a model held in memory, which ``walked`` does by joins. Takes the sorted keys out of the model."""

    def __init__(self, model: list[dict]):
        self.model = model
        self.grams = [_Table(level.pop("keys")) for level in model]
        self.contexts = [_Table(level.pop("contexts")) for level in model]

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each n-gram after the others."""
        out = np.zeros(len(codes))
        if not self.model[0]["size"]:
            return out - np.log10(256.0)
        left = np.arange(len(codes))
        child = np.full(len(codes), -1)  # the longer context escaped from, if the trie has it
        for order in range(ORDER, -1, -1):
            level, keys = self.model[order], codes[left] & ((1 << 8 * (order + 1)) - 1)
            if not level["size"]:
                continue
            found = self.grams[order].find(keys)
            hit = found >= 0
            rows, at, above = left[hit], found[hit], child[hit]
            alone = level["seen"][at]
            longer = self.model[order + 1] if order < ORDER and self.model[order + 1]["size"] else level
            out[rows] += np.where(above < 0, alone, level["count"][at] - longer["below"][np.maximum(above, 0)])
            left, child, keys = left[~hit], child[~hit], keys[~hit]
            node = self.contexts[order].find(keys >> 8)
            known = node >= 0
            cost = np.where(child < 0, level["escape"][np.maximum(node, 0)], longer["below_escape"][np.maximum(child, 0)])
            out[left] += np.where(known, cost, 0.0)
            child = node
        lowest = self.model[0]
        out[left] -= np.where(child < 0, np.log10(256.0), lowest["below"][np.maximum(child, 0)])
        return out


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int]]:
    """(n-grams (k, g, n) of each order, contexts (k, x, total, kinds, excluded), word counts (key, n), (N, V)) of ``docs``
    (text), all written.

    Every text is counted, and every n-gram stays. Of a context: how often it was seen, the symbols seen after it, and how
    often those were seen after the context one byte shorter (NULL for the empty one).
    """
    both = settle(counts(docs))
    vocabulary = settle(both.where("kind = 1").select("key", "n"))
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _last(F.col("key"), k + 1).alias("g")) for k in range(ORDER + 1)]))
    nodes = settle(both.where("kind = 0").select(orders.alias("o"), "n").groupBy("o").agg(F.sum("n").alias("n")).select("o.k", "o.g", "n"))
    shorter = F.get(F.array(*[_last(F.col("g"), k) for k in range(ORDER + 1)]), F.col("k"))
    under = nodes.select((F.col("k") + 1).alias("k"), F.col("g").alias("s"), F.col("n").alias("below"))
    each = nodes.withColumn("s", shorter).join(under, ["k", "s"], "left")
    of_context = each.groupBy("k", F.shiftright("g", 8).alias("x"))
    contexts = of_context.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("excluded"))
    return nodes, settle(contexts), vocabulary, (int(tokens), int(distinct))


def _last(key: Column, n: int) -> Column:
    """The last ``n`` bytes of an n-gram."""
    return key.bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def walked(asked: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of the last byte of each of the distinct n-grams ``asked`` (key).

    Order by order from the lowest, for the distinct endings of that order: ``value`` is that of a walk that begins there,
    ``rest`` that of one that has escaped from its context, whose symbols are excluded. Both follow from the ending one
    byte shorter, so nothing is walked twice, and no key of a join has more than 256 rows.
    """
    lower = None
    for k in range(ORDER + 1):
        own = asked.select(_last(F.col("key"), k + 1).alias("g")).distinct()
        seen = nodes.where(F.col("k") == k).select("g", "n")
        around = contexts.where(F.col("k") == k).drop("k")
        at = own.join(seen, "g", "left").withColumn("x", F.shiftright("g", 8)).join(around, "x", "left")
        if lower is None:
            rest, start = -F.log10(256.0 - F.col("kinds")), F.lit(-float(np.log10(256.0)))
        else:
            at = at.withColumn("s", _last(F.col("g"), k)).join(lower, "s", "left")
            left, kinds = F.col("s_total") - F.col("excluded"), F.col("s_kinds") - F.col("kinds")
            again = F.when(kinds > 0, F.log10(kinds / 2) - F.log10(left)).otherwise(0.0)  # none: the shorter context has nothing else
            rest = F.when(F.col("s_n").isNotNull(), F.log10(F.col("s_n") - 0.5) - F.log10(left)).otherwise(again + F.col("s_rest"))
            start = F.col("s_value")
        at = at.withColumn("rest", rest)
        escape = F.log10(F.col("kinds") / 2) - F.log10("total") + F.col("rest")
        value = F.when(F.col("n").isNotNull(), F.log10(F.col("n") - 0.5) - F.log10("total")).when(F.col("total").isNotNull(), escape).otherwise(start)
        lower = at.withColumn("value", value).select(
            F.col("g").alias("s"), *[F.col(c).alias(f"s_{c}") for c in ("n", "total", "kinds", "rest", "value")]
        )
    return lower.select(F.col("s").alias("key"), F.col("s_value").alias("value"))


def score_texts(docs: DataFrame, fold: int = 5, held: int = 1, most: int = HEAD_GRAMS, head: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text).

    Learned from every text outside the fold, scored is every whole text. NULL counts as the empty text, which is one
    end sign. A NULL id falls into the fold of the empty id. Repeated rows count and are scored one by one. An empty table stays
    empty; with nothing to learn from every byte is one of 256. Other columns are ignored.

    ``most`` n-grams and ``head`` words, the most frequent ones, travel to the tasks as tables of bounded size; a text's
    other n-grams and words are joined with the whole trie and vocabulary and summed per row. The bounds do not change a score.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    nodes, contexts, vocabulary, (tokens, distinct) = train(docs.where(bucket(fold) != held))
    least = 2 ** _threshold({level: n for (level,), n in _levels(vocabulary).items()}, head)
    top = vocabulary.where(F.col("n") >= least).toArrow()
    by_key = np.argsort(top.column("key").to_numpy())
    head_keys, head_counts = top.column("key").to_numpy()[by_key], top.column("n").to_numpy()[by_key]
    full_order = nodes.where(F.col("k") == ORDER)
    often = 2 ** _threshold({level: n for (level,), n in _levels(full_order).items()}, most)
    totals = contexts.where(F.col("k") == ORDER).select("x", "total")
    frequent = full_order.where(F.col("n") >= often).withColumn("x", F.shiftright("g", 8)).join(totals, "x")
    grams_top = frequent.select("g", (F.log10(F.col("n") - 0.5) - F.log10("total")).alias("value")).toArrow()
    log_n = np.log10(tokens + 0.5 * (distinct + 1))
    shared = spark.sparkContext.broadcast({
        "grams": grams_top.column("g").to_numpy(), "values": grams_top.column("value").to_numpy(), "keys": head_keys, "counts": head_counts,
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_here = shared.value  # one object per worker: what is made of it serves later tasks too
        known_grams = held_here.get("table") or _Table(held_here["grams"])
        held_here["table"] = known_grams
        values = np.append(held_here["values"], 0.0)  # at -1: joined
        keys, gains = held_here["keys"], np.log10(held_here["counts"] + 0.5)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            at = 0
            for hashes, first, codes, code_first in _prepared(batch.column("_text").to_pylist()):
                n_texts = len(first) - 1
                base, known = np.zeros(n_texts), np.zeros(n_texts, np.int64)
                place = np.searchsorted(keys, hashes)
                hit = np.zeros(len(hashes), bool)
                if len(keys):
                    place = np.minimum(place, len(keys) - 1)
                    hit = keys[place] == hashes
                    base = sums(np.where(hit, gains[place], 0.0), first)
                    known = sums(hit, first)
                owner = np.repeat(np.arange(n_texts), np.diff(first))
                rare_owner, rare = owner[~hit], hashes[~hit]
                # the end sign: as frequent as there are training texts; joined if it is not among the frequent words
                spot = np.searchsorted(keys, END_WORD)
                if spot < len(keys) and keys[spot] == END_WORD:
                    base, known = base + gains[spot], known + 1
                else:
                    rare_owner = np.append(rare_owner, np.arange(n_texts))
                    rare = np.append(rare, np.full(n_texts, END_WORD))
                    by_owner = np.argsort(rare_owner, kind="stable")
                    rare_owner, rare = rare_owner[by_owner], rare[by_owner]
                bounds = np.searchsorted(rare_owner, np.arange(n_texts + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(rare))
                spot = known_grams.find(codes)
                score = sums(values[spot], code_first)
                missed = np.concatenate(([0], np.cumsum(spot < 0)))[code_first].astype(np.int32)
                rare_grams = pa.ListArray.from_arrays(pa.array(missed), pa.array(codes[spot < 0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n_texts)), batch.column("doc_id").slice(at, n_texts), pa.array(np.diff(first) + 1),
                     pa.array(known), pa.array(base), pa.array(score), lists, rare_grams],
                    names=["row", "doc_id", "n_tokens", "known", "base", "score", "rare", "rare_grams"],
                )
                at, row = at + n_texts, row + n_texts

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, known long, base double, score double, rare array<long>, rare_grams array<long>"
    rows = settle(docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema))
    each = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    told = each.join(vocabulary.where(F.col("n") < least), "key", "left")
    gain = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    tail = told.groupBy("row").agg(F.sum(gain).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("found"))
    others = settle(rows.select("row", F.explode("rare_grams").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times")))
    worth = settle(walked(settle(others.select("key").distinct()), nodes, contexts))
    gram_tail = others.join(worth, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more_score"))
    full = rows.drop("rare", "rare_grams").join(tail, "row", "left").join(gram_tail, "row", "left")
    return full.select(
        "doc_id",
        (bucket(fold) == held).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(log_n))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
