"""The trie against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliograph.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"


def order(turns):
    def key(t):
        role, text = t[1] or "", t[2] or ""
        return (t[0] is not None, t[0] or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    return [(t[1] or "", t[2] or "") for t in sorted(turns, key=key)]


def rebuilt(rows):
    own = defaultdict(list)
    for c, *turn in rows:
        if c is not None:
            own[c].append(turn)
    own = {c: order(t) for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, int(c / 100) * 100
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """{(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}"""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[x] for x in children[path])
    return {
        (m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    }


def result(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def conversations(rng, n, longest=7, texts=3):
    rows = []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bb", "ö" * texts])))
    return rows


def shared(spark, rows):
    return prefix_trie.trie(*prefix_trie.share_heads(prefix_trie.ordered_turns(spark.createDataFrame(rows, KIND))))


@pytest.mark.parametrize("base", [4, 4096])
def test_rebuilt_conversations(spark, monkeypatch, base):
    monkeypatch.setattr(prefix_trie.list_rank, "__defaults__", (base,))
    rows = conversations(random.Random(base), 150)
    assert result(shared(spark, rows)) == plain(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (-105, 2, "user", "x"), (-105, None, None, None), (-100, 1, "user", "x"), (0, 1, "a", "b"), (0, 1, "a", "b"), (0, 1, "b", "a"), (7, 1, "ab", "c"), (8, 1, "a", "bc"),
        (None, 1, "a", "b"), (2**62, 5, "u", "very " * 5000), (9, -3, "", ""), (9, 3, None, "\n"),
    ]
    df = spark.createDataFrame(rows, KIND).withColumns({"pos": F.lit("clash"), "depth": F.lit(1), "node": F.lit(None)})
    own = {c: order([t[1:] for t in rows if t[0] == c]) for c in {r[0] for r in rows} - {None}}
    assert result(prefix_trie.conversation_trie(df)) == plain(own)
    got = result(prefix_trie.trie(*prefix_trie.share_heads(prefix_trie.ordered_turns(df))))
    assert got == plain(rebuilt(rows))


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], KIND)).isEmpty()
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], KIND)).isEmpty()


def test_blocks_pieces_and_rounds(spark, monkeypatch):
    """A long conversation, a node of many children and one that many conversations end at, in blocks of a few."""
    for name, value in (("BLOCK", 8), ("PIECE", 16)):
        monkeypatch.setattr(prefix_trie, name, value)
    monkeypatch.setattr(prefix_trie.list_rank, "__defaults__", (16,))
    rows = [(5, t, "user", str(t % 4)) for t in range(70)] + [(6, t, "user", str(t % 4)) for t in range(60)]
    rows += [(c, 0, "user", f"own {c}") for c in range(10, 60)] + [(c, 0, "user", "same") for c in range(100, 180)]
    want = plain({c: order([t[1:] for t in rows if t[0] == c]) for c in {r[0] for r in rows}})
    assert result(prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND).repartition(5))) == want


def test_list_rank(spark):
    rng = random.Random(9)
    names = rng.sample(range(10**9), 400)
    rows = [(a, b, rng.randrange(5), rng.randrange(7)) for a, b in zip(names, [*names[1:], None])]
    ranks = prefix_trie.list_rank(spark.createDataFrame(rows, "arc long, next long, x long, y long").repartition(4), ["x", "y"], base=8)
    want, x, y = {}, 0, 0
    for a, _, p, q in rows:
        want[a] = (x, y)
        x, y = x + p, y + q
    assert {r.arc: (r.x, r.y) for r in ranks.collect()} == want
