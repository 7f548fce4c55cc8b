import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliograph.llm import simhash
from foliograph.llm.graphs import components


def plain_fingerprint(text):
    parts = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not parts:
        return 0
    width = min(3, len(parts))
    hashes = [xxhash.xxh64(" ".join(parts[i : i + width]).encode(), seed=42).intdigest() for i in range(len(parts) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    top = {i: i for i in fps}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def similar(a, b, width=5):
    """Five-word Jaccard similarity of two texts, the whole sequence where there are fewer words."""
    sets = []
    for text in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1 if w else 0))})
    return len(sets[0] & sets[1]) / max(len(sets[0] | sets[1]), 1)


def plain_groups(rows):
    """{id: smallest id} over links of three bits or a similarity of 0.8."""
    top = {i: c for i, (_, c) in plain_components(rows).items()}
    rows = sorted(rows)
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if top[a] != top[b] and similar(s, t) >= 0.8:
                low, high = sorted((top[a], top[b]))
                top = {k: low if v == high else v for k, v in top.items()}
    return top


def test_every_pattern_of_four_bits_has_its_codeword():
    single, table = simhash.error_table()
    counts = (table >= 0).sum(1)
    assert sorted(np.unique(counts)) == [1, 6]
    assert (counts == 6).sum() == 1771
    for syndrome in range(2048):
        for error in table[syndrome][table[syndrome] >= 0]:
            found = 0
            for bit in range(23):
                found ^= int(single[bit]) if int(error) >> bit & 1 else 0
            assert found == syndrome


def test_no_pair_within_three_bits_is_missed(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = set(centres)
    for c in centres:
        for bits in (1, 2, 3, 3, 4):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {r["fp"]: r["comp"] for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    top = {f: f for f in signed}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                top[find(a)] = find(b)
    groups, wanted = {}, {}
    for f in signed:
        groups.setdefault(got[f], set()).add(f)
        wanted.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_documents_against_brute_force(docs):
    rng = random.Random(2)
    base = " ".join(rng.choice("alpha beta gamma delta Eps zeta ETA theta über".split()) + str(rng.randrange(90)) for _ in range(300))
    rows = [(1, base), (2, base.upper().lower()), (3, base.replace("alpha", "beta", 1)), (4, ""), (5, None), (6, "one two"), (7, "ONE\ttwo"), (8, " \n"), (9, "x " * 5000), (10, "  y z")]
    rows += [(20 + i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(60)]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(*rows)).collect()}
    assert got == plain_components(rows)


def test_repeated_and_missing_ids(docs):
    found = simhash.near_duplicates(docs((7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, None))).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.near_duplicates(docs()).count() == 0


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_one(docs((3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "something else is here"), (None, "a b c d")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9]


def test_near_copies_beyond_three_bits(docs):
    rng = random.Random(11)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((40, 150, 600)))]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 8):  # single words, or a run of them, replaced
            copy = list(base)
            if k % 2:
                for _ in range(max(1, len(base) * k // 400)):
                    copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            else:
                at, n = rng.randrange(len(base) - 4), len(base) * k // 60
                copy[at : at + n] = [f"other{rng.randrange(9999)}" for _ in range(n)]
            rows.append((10 * g + k, " ".join(copy)))
    want = {i for i, c in plain_groups(rows).items() if i == c}
    far = {i for i, (_, c) in plain_components(rows).items() if i == c}
    got = [r["doc_id"] for r in simhash.keep_one(docs(*rows)).collect()]
    # nothing goes that should stay; of what should go, keys may miss a few at the threshold itself
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(rows) - len(got) >= 0.98 * (len(rows) - len(want)) and len(want) < 0.7 * len(far)


def test_a_shared_passage_is_no_near_copy(docs):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " " + passage) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace("p30", "p31")) for i in range(0, 300, 3)]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(*rows)).collect()) == list(range(300))


def test_kept_rows_keep_all_columns(docs):
    few = docs((1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "x"), (5, "y"), (None, "y"))
    for name in ("_key", "_id", "_k", "fp", "n", "sid", "bands", "_row", "comp"):
        few = few.withColumn(name, F.col("doc_id").cast("string"))
    kept = simhash.keep_one(few)
    assert kept.columns == few.columns
    assert sorted((r["doc_id"], r["text"], r["_key"], r["n"]) for r in kept.collect()) == [
        (1, "a b c d e f g", "1", "1"), (3, None, "3", "3"), (5, "x", "5", "5"), (5, "y", "5", "5")
    ]
    assert simhash.keep_one(docs()).count() == 0


def test_shingles_of_odd_texts():
    assert len(simhash.shingle_set(None)) == len(simhash.shingle_set(b" \n\t")) == 0
    assert len(simhash.shingle_set(b"one")) == 1 and simhash.shingle_set(b"A b").tolist() == simhash.shingle_set(b"a\n b ").tolist()
    words = [b"w%d" % (i % 70001) for i in range(200000)]
    assert len(simhash.shingle_set(b" ".join(words))) == 70001
    long = b"a b " + b"x" * 100000 + b" c d e"
    assert len(simhash.shingle_set(long)) == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_that_share_much_but_not_enough_make_no_pairs(spark):
    """All pairs of a crowd at a similarity of 0.6 would be 1,225; those that are similar are found among few candidates."""
    common = list(range(1000, 1075))
    crowd = {i: common + [5000 + 100 * i + k for k in range(25)] for i in range(50)}
    crowd[90] = crowd[7][:-2] + [1, 2]
    rows = [(i, i, len(hs), i) for i, hs in crowd.items()]
    units = spark.createDataFrame(rows, "sid long, fp long, n long, comp long")
    sets = spark.createDataFrame([(i, i, hs) for i, hs in crowd.items()], "sid long, fp long, hs array<long>")
    pairs = simhash._prefix_pairs(units, sets)
    assert {(r.sid, r.sid2) for r in pairs.collect()} == {(7, 90)}
    assert [(r.u, r.v) for r in simhash._verified(pairs, sets).collect()] == [(90, 7)]
