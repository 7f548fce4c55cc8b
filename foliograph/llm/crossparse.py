"""Language identification by cross-parsing: suffix automata of labelled text, longest matches, fewest phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from foliograph.llm.common import bucket, chunks

TRAIN_BYTES = 30_000  # text a language is learned from, at most
TABLE_BYTES = 120_000  # the same over the languages of one table of automata; more languages take more tables
TRAIN_DOCS = 60  # documents of a language that are read for it, at most
LONG_DOC = 6_000  # characters; longer documents are read for training only if others do not suffice
PIECE = 512  # bytes parsed from the root on; a longer text is parsed in pieces

_KEPT = np.full(256, 32, np.uint8)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of lower-cased texts, all else as single blanks; each text begins with its first letter's run."""
    kept = _KEPT[data]
    blank = kept == 32
    wanted = ~blank
    wanted[1:] |= blank[1:] & ~blank[:-1]
    wanted[offsets[:-1]] = ~blank[offsets[:-1]]
    places = np.concatenate(([0], np.cumsum(wanted)))
    return kept[wanted], places[offsets]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, symbol) of the automaton of all substrings of ``text``; -1 where there is none; 0 is the root."""
    links, lengths, steps = [-1], [0], [[-1] * width]
    last = 0
    for symbol in text.tolist():
        state = len(steps)
        links.append(0)
        lengths.append(lengths[last] + 1)
        steps.append([-1] * width)
        at = last
        while at >= 0 and steps[at][symbol] < 0:
            steps[at][symbol] = state
            at = links[at]
        if at >= 0:
            target = steps[at][symbol]
            if lengths[target] == lengths[at] + 1:
                links[state] = target
            else:
                copy = len(steps)
                links.append(links[target])
                lengths.append(lengths[at] + 1)
                steps.append(steps[target].copy())
                while at >= 0 and steps[at][symbol] == target:
                    steps[at][symbol] = copy
                    at = links[at]
                links[target] = links[state] = copy
        last = state
    return np.array(steps, np.int32)


def build(texts: dict[str, np.ndarray]) -> dict:
    """One table of transitions for all languages. An entry is the place of the next state, or, where the match ends,
    the complement of the place from which the next phrase goes on."""
    langs = sorted(texts)
    used = np.zeros(256, bool)
    for text in texts.values():
        used[text] = True
    code = np.where(used, np.cumsum(used) - 1, used.sum()).astype(np.int32)
    width = int(used.sum()) + 1
    tables, roots, base = [], [], 0
    for lang in langs:
        steps = suffix_automaton(code[texts[lang]], width)
        again = np.maximum(steps[0], 0)  # after a match: one symbol from the root, or the root if the symbol is new
        table = np.where(steps >= 0, (steps + base) * width, ~((again[None, :] + base) * width))
        tables.append(table.astype(np.int32))
        roots.append(base * width)
        base += len(steps)
    flat = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    size = np.array([max(2, len(texts[lang])) for lang in langs], np.float64)
    return {"langs": langs, "code": code, "table": flat, "roots": np.array(roots, np.int32), "bits": np.log2(size)}


def phrases(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of phrases (language, text) of cross-parsing each text: all pieces of all texts walk side by side."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[owner] + inside * PIECE
    left = np.minimum(PIECE, offsets[owner + 1] - start)
    order = np.argsort(-left, kind="stable")
    start, left, owner = start[order], left[order], owner[order]
    code, table = model["code"][data], model["table"]
    state = np.repeat(model["roots"][:, None], len(start), 1)
    ended = np.zeros(state.shape, np.int32)
    active = np.searchsorted(-left, -np.arange(1, PIECE + 1), "right")  # pieces of more than j bytes
    for j in range(int(left.max()) if len(left) else 0):
        n = active[j]
        after = table[state[:, :n] + code[start[:n] + j]]
        sign = after >> 31
        ended[:, :n] -= sign
        state[:, :n] = after ^ sign
    counts = np.zeros((len(model["langs"]), len(lengths)))
    for i in range(len(counts)):
        counts[i] = np.bincount(owner, ended[i] + 1, len(lengths))
    return counts


def identify(models: list[dict], texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each lower-cased text. Phrases are normalised to bits a byte: phrases times the bits of
    a place in the training text, over the length. The lowest wins, the first by name if equal."""
    names, scores, langs = [], [], [lang for model in models for lang in model["langs"]]
    for _, data, offsets in chunks(texts):
        letters, bounds = plain(data, offsets)
        cost = np.concatenate([phrases(m, letters, bounds) * m["bits"][:, None] for m in models]) / np.maximum(1, np.diff(bounds))
        best = cost.min(0)
        names += [langs[i] for i in cost.argmin(0)]
        scores.append(1 / ((np.maximum(best, 1e-9) / np.maximum(cost, 1e-9)) ** 8).sum(0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, each: int = TRAIN_BYTES, together: int = TABLE_BYTES, n_docs: int = TRAIN_DOCS) -> list[dict]:
    """Automata of ``docs`` (doc_id, text, lang) outside the held-out fold: per language the documents of the smallest
    digest, long ones last, up to a number of documents and of bytes, however many languages there are. They are named by the labels; in the order of
    their names they fill tables of ``together`` bytes of text."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (bucket(3) != 1))
    sized = taught.select("lang", F.xxhash64("doc_id", "text").alias("_key"), (F.length("text") > LONG_DOC).alias("_long"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_long", "_key"))
    chosen = sized.withColumn("_n", place).where(F.col("_n") <= n_docs)
    keyed = docs.where(bucket(3) != 1).withColumn("_key", F.xxhash64("doc_id", "text"))
    texts = keyed.join(F.broadcast(chosen), ["lang", "_key"]).select("lang", "_long", "_key", F.lower("text").cast("binary").alias("t"))
    rows = texts.groupBy("lang", "_long", "_key").agg(F.first("t").alias("t")).toArrow().to_pylist()
    found: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["_long"], r["_key"])):
        found.setdefault(row["lang"], []).append(row["t"])
    groups: list[dict[str, np.ndarray]] = []
    for lang, parts in found.items():
        letters, _ = plain(np.frombuffer(b"\n".join(parts), np.uint8), np.array([0, sum(map(len, parts)) + len(parts) - 1]))
        letters = letters[:each]
        if not groups or sum(map(len, groups[-1].values())) + len(letters) > together:
            groups.append({})
        groups[-1][lang] = letters
    return [build(learned) for learned in groups]


def predict_language(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text, lang).

    Every whole text is parsed. A text that is NULL or has no letter is ``und`` with score 0, and so is every text if no
    language was learned. Rows without lang teach nothing; repeated rows are judged one by one. An empty table stays
    empty. Other columns are ignored.
    """
    models = train(docs.select("doc_id", "text", "lang"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = StructType([*docs.select("doc_id").schema.fields, StructField("has", LongType()), StructField("lang", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = identify(shared.value, batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("has"), pa.array(names), pa.array(scores)], names=["doc_id", "has", "lang", "score"])

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = docs.select("doc_id", has.cast("bigint").alias("has"), F.lower("text").cast("binary").alias("_text"))
    judged = asked.mapInArrow(run, schema) if models else asked.select("doc_id", F.lit(0).alias("has"), F.lit("").alias("lang"), F.lit(0.0).alias("score"))
    known = F.col("has") == 1
    return judged.select(
        "doc_id",
        (bucket(3) == 1).alias("held_out"),
        F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(known, F.least(F.col("score"), F.lit(1.0))).otherwise(F.lit(0.0)).alias("score"),
    )
