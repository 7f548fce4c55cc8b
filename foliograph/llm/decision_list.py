"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliograph.llm.common import chunks, labelled_sample, repeats, run_hashes, scramble, spans, sums

WINDOW = 8  # words
SAMPLE = 10_000  # labelled documents the list is learned from, at most
MIN_PRECISION = 0.9  # on the pruning set, for a rule to be kept
MAX_RULES = 12
MAX_CONDITIONS = 4

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_exclaims", "n_adjacent", "n_single", "n_distinct",
]

# What the rules may look at: a count in proportion to another one.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "digit_rate": ("n_digits", "word_chars"),
    "exclaim_rate": ("n_exclaims", "word_chars"),
    "adjacent_rate": ("n_adjacent", "n_words"),
    "single_rate": ("n_single", "n_words"),
    "distinct_rate": ("n_distinct", "n_words"),
}

_KINDS = {"n_symbols": b"#*$%&|<>", "n_exclaims": b"!", "n_digits": bytes(range(48, 58)), "n_upper": bytes(range(65, 91))}
_MASKS = {}
for _name, _bytes in _KINDS.items():
    _MASKS[_name] = np.zeros(256, bool)
    _MASKS[_name][list(_bytes)] = True


def text_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of each text; zeros for None."""
    found: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
    golden = np.uint64(0x9E3779B97F4A7C15)
    for _, data, offsets in chunks(texts):
        starts, ends = spans(data)
        first = np.searchsorted(starts, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        lengths = ends - starts
        hashes = run_hashes(data, starts, ends)
        salt = owner.astype(np.uint64) * golden
        lead = (data & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(lead)))
        out = {"n_words": np.diff(first), "word_chars": sums(chars[ends] - chars[starts], first)}
        for name, mask in _MASKS.items():
            out[name] = sums(mask[data], offsets)
        out["n_single"] = sums(chars[ends] - chars[starts] == 1, first)
        out["n_distinct"] = out["n_words"] - sums(repeats(scramble(hashes + salt))[0], first)
        adjacent = np.zeros(len(starts), bool)
        adjacent[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out["n_adjacent"] = sums(adjacent, first)
        # lines that have a word
        stops = np.flatnonzero(data == 10)
        begins = np.concatenate(([0], stops[:-1] + 1))
        worded = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
        begins, stops = begins[worded], stops[worded]
        line_owner = np.searchsorted(offsets, begins, "right") - 1
        line_first = np.searchsorted(begins, offsets)
        line_keys = scramble(run_hashes(data, begins, stops) + line_owner.astype(np.uint64) * golden)
        out["n_lines"], out["n_dup_lines"] = np.diff(line_first), sums(repeats(line_keys)[0], line_first)
        # words inside windows that come again
        n_windows = max(0, len(starts) - WINDOW + 1)
        covered = np.zeros(len(starts) + 1, np.int64)
        if n_windows:
            inside = owner[:n_windows] == owner[WINDOW - 1 :]
            keys = salt[:n_windows].copy()
            for i in range(WINDOW):
                keys = scramble(keys + hashes[i : i + n_windows])
            places = np.flatnonzero(inside)
            again = places[repeats(keys[places])[1]]
            np.add.at(covered, again, 1)
            np.subtract.at(covered, again + WINDOW, 1)
        out["n_repeat_words"] = sums(np.cumsum(covered[:-1]) > 0, first)
        for name in COUNTS:
            found[name].append(np.asarray(out[name], np.int64))
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of ``docs`` with a column text, then the rates as doubles."""
    kept = docs.select(*keep)
    schema = StructType([*kept.schema.fields, *[StructField(n, LongType()) for n in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column("_text").to_pylist())
            columns = [batch.column(n) for n in keep] + [pa.array(counts[n]) for n in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS])

    counted = docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)
    rates = {name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, (a, b) in RATES.items()}
    return counted.withColumns(rates)


# --- learning ---------------------------------------------------------------------------

Condition = tuple[int, bool, float]  # column, above (else at or below), threshold


def _holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for column, above, threshold in rule:
        mask &= (x[:, column] > threshold) == above
    return mask


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition of the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for column in range(x.shape[1]):
            values, bads = x[inside, column], bad[inside]
            for threshold in np.unique(np.quantile(values, np.linspace(0, 1, 65)[:-1])):
                upper = values > threshold
                for above in (True, False):
                    cover = upper == above
                    p, n = int((cover & bads).sum()), int((cover & ~bads).sum())
                    gain = p * (np.log2(p / (p + n)) - base) if p else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (column, above, float(threshold)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, rule[-1:])
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[list[Condition], float]:
    """The beginning of the rule that is worth most on rows it was not grown on, and its precision there."""
    best, worth = [], -2.0
    for length in range(1, len(rule) + 1):
        cover = _holds(x, rule[:length])
        p, n = int((cover & bad).sum()), int((cover & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            best, worth = rule[:length], (p - n) / (p + n)
    return best, (worth + 1) / 2


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> list[list[Condition]]:
    """Rules that reject, in order: each is grown on two thirds of the rows left, pruned on the rest,
    and the rows it covers are taken out. A rule below the wanted precision ends the list."""
    rules: list[list[Condition]] = []
    rng, left = np.random.default_rng(seed), np.arange(len(x))
    while len(rules) < MAX_RULES and bad[left].any():
        mixed = rng.permutation(left)
        cut = -(-2 * len(mixed) // 3)
        grown, held = mixed[:cut], mixed[cut:]
        rule, precision = _prune(_grow(x[grown], bad[grown]), x[held], bad[held])
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        left = left[~_holds(x[left], rule)]
    return rules


def as_column(rules: list[list[Condition]], names: list[str]) -> Column:
    """The decision list as an expression: the first rule that holds rejects, the default accepts."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for column, above, threshold in rule:
            value = F.col(names[column])
            test = test & ((value > F.lit(threshold)) if above else (value <= F.lit(threshold)))
        verdict = verdict.when(test, F.lit(False))
    return verdict.otherwise(F.lit(True))


def as_text(rules: list[list[Condition]], names: list[str]) -> list[str]:
    """The rules for people."""
    return [" and ".join(f"{names[c]} {'>' if above else '<='} {t:.6g}" for c, above, t in rule) + " -> reject" for rule in rules]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from ``labels`` (doc_id, quality; 0 is bad) of at most ``sample`` documents."""
    taught = labelled_sample(docs.select("doc_id", "text"), labels, "quality", sample, F.lit(True))
    rows = with_counts(taught, ["doc_id", "_label"]).select("doc_id", "_label", *RATES).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), *[(n, "ascending") for n in RATES]])
    x = np.stack([rows.column(n).to_numpy() for n in RATES], 1) if rows.num_rows else np.zeros((0, len(RATES)))
    return learn_rules(x, rows.column("_label").to_numpy() == 0)


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, rates, base_failed and kept.

    Every whole text is counted. A NULL or empty text has no words, so it fails the base. Repeated rows and NULL ids are
    judged one by one; without labels the list is empty and only the base rejects. An empty table stays empty.
    """
    rules = train(docs, labels, sample)
    counted = with_counts(docs, ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & as_column(rules, list(RATES)))
