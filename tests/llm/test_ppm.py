import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliograph.llm import ppm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def stream_of(text):
    return b"\0" * (ppm.ORDER - 1) + b"\n" + b"".join(w + b" " for w in WORD.findall((text or b"").lower())) + b"\n"


class PlainModel:
    """The same estimate written as a walk over dictionaries."""

    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for text in texts:
            s = stream_of(text)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    def probability(self, history, symbol):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            counts = self.seen.get(history[len(history) - k :])
            if counts is None:
                continue
            rest = {s: n for s, n in counts.items() if s not in excluded}
            total = sum(rest.values())
            if not rest:
                continue
            if symbol in rest:
                return p * (rest[symbol] - 0.5) / total
            p *= len(rest) / 2 / total
            excluded |= set(counts)
        return p / (256 - len(excluded))


def local(texts):
    parts = [codes for _, _, codes, _ in ppm._prepared(texts)]
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    orders = []
    for k in range(ppm.ORDER + 1):
        short, back = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        orders.append((short, np.bincount(back, n).astype(np.int64)))
    return ppm.Scorer(ppm.build(orders))


TRAIN = [b"the cat sat on the mat", b"the dog ate the cat", "übung macht den Meister".encode(), b"", b"a a a a b"]


def test_log_probability_against_a_walk():
    scorer, plain = local(TRAIN), PlainModel(TRAIN)
    for text in [*TRAIN, b"the zebra sat", b"\xff\xfe odd", b"THE CAT", None, b"qqq"]:
        (_, _, codes, _), = ppm._prepared([text])
        s = stream_of(text)
        want = [math.log10(plain.probability(s[:i], s[i])) for i in range(ppm.ORDER, len(s))]
        assert scorer.log_probability(codes) == pytest.approx(want, abs=1e-5)


def test_probabilities_after_a_history_sum_to_one():
    scorer = local(TRAIN)
    for history in (b"\0\0\0\0\n", b"e cat", b"zzzzz", b"o the", b"a a a"):
        codes = np.array([int.from_bytes(history[-ppm.ORDER :] + bytes([s]), "big") for s in range(256)])
        assert (10 ** scorer.log_probability(codes)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_against_plain_python(docs):
    import zlib

    rows = [(i, f"word{i % 9} other{i % 4} the THE the x{i}\n end" * (i % 3)) for i in range(60)] + [(70, None), (71, "unseen words only"), (71, "unseen words only"), (None, "the")]
    found = ppm.score_texts(docs(*rows), head=4).collect()
    assert len(found) == len(rows)
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i, _ in rows}
    taught = [(t or "").encode() for i, t in rows if not held[i]]
    counts = Counter(w for t in taught for w in [*WORD.findall(t.lower()), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    plain = PlainModel(taught)
    texts = dict(rows)
    for r in found:
        text = (texts[r["doc_id"]] or "").encode()
        tokens = [*WORD.findall(text.lower()), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens), rel=1e-9)
        s = stream_of(text)
        assert r["score"] == pytest.approx(sum(math.log10(plain.probability(s[:i], s[i])) for i in range(ppm.ORDER, len(s))), abs=1e-3)


def test_a_small_budget_still_gives_probabilities(docs):
    rows = [(i, f"alpha beta{i} gamma") for i in range(40)]
    found = ppm.score_texts(docs(*rows), most=60, head=2).collect()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert ppm.score_texts(docs()).count() == 0


def test_no_budget_changes_a_score(docs):
    """Every n-gram that does not travel to the tasks is joined: with a small head, or none, scores are those of the whole trie."""
    rows = [(i, f"alpha beta{i} gamma" * (1 + i % 3)) for i in range(40)] + [(50, "new zebra words"), (51, None)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    plain = PlainModel([(t or "").encode() for i, t in rows if not held[i]])
    streams = {i: stream_of((t or "").encode()) for i, t in rows}
    want = {i: sum(math.log10(plain.probability(s[:j], s[j])) for j in range(ppm.ORDER, len(s))) for i, s in streams.items()}
    for most in (0, 60):
        found = {r["doc_id"]: r["score"] for r in ppm.score_texts(docs(*rows), most=most, head=2).collect()}
        assert found == pytest.approx(want, abs=1e-6)
