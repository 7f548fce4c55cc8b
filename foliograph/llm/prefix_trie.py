"""Prefix trie of conversations, measured by the Euler tour of its nodes.

A node is a distinct sequence of first turns. Its key is the exclusive or of one digest per place and turn, so that keys
of all depths come from running totals. Each node has an arc that enters it and one that leaves it; the tour is the list
of arcs in the order of a walk around the tree. The list is ranked by contraction: in each round half of the arcs, by a
coin of their id, take in the arc that follows them if its coin differs, a quarter of the list at a time, and give it its place
back on the way out. What lies below a node is then the difference of the totals at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliograph.llm.common import written
from foliograph.operators.ranks import ordinals
from foliograph.session import settle

BLOCK = 4096  # turns of a conversation, or children of a node, that one window sorts
BASE = 4096  # arcs of a contracted list that one task walks along
PIECE = 1 << 16  # bytes of joined ids in a row


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): each turn's place from 1 on, a digest of role and text, and the code points of its text.

    NULL turns come first; equal ones follow by role and digest. NULL roles and texts are empty, rows without a conv_id
    belong to no conversation, and repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("bigint").alias("size")
    )
    placed = ordinals(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "digest"], name="pos")
    return placed.select("conv_id", "pos", "digest", "size")


def share_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their hundred: (turns, ids with a conversation's number of turns).

    The first h turns of conversation c are replaced by those of c - c % ``group``, where h is crc32(c) % ``most``; a base
    of fewer turns gives all it has, and one that is absent none.
    """
    place = F.when((F.col("pos") < most) & (F.col("conv_id") % group == 0), F.struct("pos", "digest", "size"))
    whole = settle(turns.groupBy("conv_id").agg(F.max("pos").alias("own"), F.array_sort(F.collect_list(place)).alias("head")))
    bases = whole.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), "head")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    named = whole.select("conv_id", "own", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    head = F.slice(F.coalesce("head", F.array().cast(bases.schema["head"].dataType)), F.lit(1), F.col("h"))
    ids = named.join(bases, "base", "left").select("conv_id", "own", "h", head.alias("head"))
    ids = settle(ids.withColumn("n", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    shared = ids.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    shift = ids.select("conv_id", "h", (F.col("h") - F.size("head")).alias("gap"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("gap")).alias("pos"), "digest", "size")
    return shared.unionByName(own), ids.select("conv_id", "n")


def _prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, size): the key of each first part of a conversation, that of the part before, and its last turn's size.

    Long conversations are cut into blocks, whose totals are carried on.
    """
    marks = [F.xxhash64(F.lit(1), "pos", "digest").alias("z1"), F.xxhash64(F.lit(2), "digest", "pos").alias("z2")]
    cut = turns.select("conv_id", F.col("pos").alias("depth"), "size", *marks, F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = [F.bit_xor(z).over(inside).alias(k) for z, k in (("z1", "k1"), ("z2", "k2"))]
    single = cut.where("block = 0").select("conv_id", "depth", "size", "z1", "z2", *running)
    long = cut.join(cut.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    totals = long.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"))
    carried = totals.select("conv_id", "block", F.bit_xor("t1").over(before).alias("c1"), F.bit_xor("t2").over(before).alias("c2")).where("block > 0")
    rest = cut.where("block > 0").select("conv_id", "block", "depth", "size", "z1", "z2", *running).join(carried, ["conv_id", "block"])
    rest = rest.withColumns({k: F.col(k).bitwiseXOR(F.col(c)) for k, c in (("k1", "c1"), ("k2", "c2"))}).drop("block", "c1", "c2")
    parts = single.unionByName(rest)
    previous = [F.col(k).bitwiseXOR(F.col(z)).alias(p) for k, z, p in (("k1", "z1", "p1"), ("k2", "z2", "p2"))]
    none = F.lit(0).cast("bigint")
    roots = ids.select("conv_id", none.alias("depth"), *[none.alias(c) for c in ("k1", "k2", "p1", "p2", "size")])
    return parts.select("conv_id", "depth", "k1", "k2", *previous, "size").unionByName(roots)


def _siblings(links: DataFrame) -> DataFrame:
    """(node, parent, after): the child that follows each one below its parent, NULL for the last. Children are taken in blocks of their numbers."""
    placed = links.withColumn("block", F.floor(F.col("node") / BLOCK))
    inside = Window.partitionBy("parent", "block").orderBy("node")
    near = placed.select("node", "parent", F.lead("node").over(inside).alias("after")).where("after is not null")
    blocks = placed.groupBy("parent", "block").agg(F.min("node").alias("first"), F.max("node").alias("node"))
    following = F.lead("first").over(Window.partitionBy("parent").orderBy("block"))
    return near.unionByName(blocks.select("node", "parent", following.alias("after")))


def _coin(arc: str, turn: int) -> Column:
    return F.xxhash64(F.col(arc), F.lit(turn)).bitwiseAND(F.lit(1))


def list_rank(arcs: DataFrame, weights: list[str], base: int = BASE) -> DataFrame:
    """(arc, weights): for each arc of a list (arc, next, weights) the sums of the weights of all arcs before it.

    ``next`` is NULL for the last arc. A round is one join of half of the list with a quarter of it and one written table; the list shrinks by
    a quarter each time, so that all rounds together handle four times its length.
    """
    now, n = written(arcs.select("arc", "next", *weights))
    levels = []
    while n > base:
        turn = len(levels)
        taking = (_coin("arc", turn) == 0) & F.coalesce(_coin("next", turn) == 1, F.lit(False))
        kept = now.where((_coin("arc", turn) == 0) & (F.col("next").isNull() | (_coin("next", turn) == 0)))
        nobody = [F.lit(None).cast("bigint").alias(c) for c in ("gone", *[f"{w}_at" for w in weights])]
        before = now.where(taking).select(F.col("arc").alias("p"), F.col("next").alias("arc"), *[F.col(w).alias(f"{w}_p") for w in weights])
        met = now.where(_coin("arc", turn) == 1).join(before, "arc", "left")
        taken = F.col("p").isNotNull()
        merged = met.select(
            F.coalesce("p", "arc").alias("arc"),
            "next",
            *[(F.coalesce(f"{w}_p", F.lit(0)) + F.col(w)).alias(w) for w in weights],
            F.when(taken, F.col("arc")).alias("gone"),
            *[F.col(f"{w}_p").alias(f"{w}_at") for w in weights],
        )
        now, n = written(kept.select("arc", "next", *weights, *nobody).unionByName(merged))
        levels.append(now)
    ranks = _walk(now, weights)
    for k, level in enumerate(reversed(levels)):
        inside = level.where("gone is not null").select("arc", "gone", *[f"{w}_at" for w in weights])
        own = F.struct("arc", *weights)
        other = F.struct(F.col("gone").alias("arc"), *[(F.col(w) + F.col(f"{w}_at")).alias(w) for w in weights])
        both = ranks.join(inside, "arc", "left").select(F.inline(F.when(F.col("gone").isNull(), F.array(own)).otherwise(F.array(own, other))))
        ranks = settle(both) if k % 4 == 3 else both
    return ranks


def _walk(arcs: DataFrame, weights: list[str]) -> DataFrame:
    """The sums before each arc of a list of at most ``BASE`` arcs, by one task."""
    names = ["arc", *weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r["arc"]: r for batch in batches for r in batch.to_pylist()}
        at = next(iter(rows.keys() - {r["next"] for r in rows.values()}), None)
        sums, out = [0] * len(weights), []
        while at is not None:
            row = rows[at]
            out.append(dict(zip(names, (at, *sums))))
            sums = [s + row[w] for s, w in zip(sums, weights)]
            at = row["next"]
        yield pa.RecordBatch.from_pylist(out, pa.schema([(n, pa.int64()) for n in names]))

    return arcs.select("arc", "next", *weights).coalesce(1).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def joined_digests(ids: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` (numbers) and sha256: the digest of the values of each key as decimals, ascending, joined by commas.

    Rows are sorted over all tasks by key and value and joined to pieces of bounded size; a digest is a chain of its pieces, which one task
    reads in order without keeping them.
    """
    piece_kind = ", ".join(f"{k} long" for k in keys) + ", first long, piece string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, first, parts, size = None, None, [], 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*keys, "first", "piece"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, value)]
            for *own, number in zip(*columns):
                if own != key or size >= PIECE:
                    if parts:
                        rows.append((*key, first, ",".join(parts)))
                    key, first, parts, size = own, number, [], 0
                parts.append(str(number))
                size += len(parts[-1]) + 1
            if len(rows) >= 1000:
                yield flush(rows)
                rows = []
        if parts:
            rows.append((*key, first, ",".join(parts)))
        if rows:
            yield flush(rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, piece in zip(*[batch.column(c).to_pylist() for c in (*keys, "piece")]):
                if own != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*keys, "sha256"])

    ordered = ids.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    pieces = settle(ordered.mapInArrow(join, piece_kind))
    chained = pieces.repartition(*keys).sortWithinPartitions(*keys, "first")
    return chained.mapInArrow(digest, ", ".join(f"{k} long" for k in keys) + ", sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, pos, digest, size) of the conversations ``ids`` (conv_id).

    conv_id (smallest member), depth, parent_conv_id (NULL for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Conversations without
    turns are members of the root. No conversations, no root: an empty table gives an empty table. A conversation
    of any length, a node of any number of children and a prefix that all conversations share are spread over tasks.
    """
    prefixes = settle(_prefixes(turns, ids))
    keys = ["depth", "k1", "k2"]
    sums = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("p1", "p2", "size")]]
    nodes = settle(prefixes.groupBy(*keys).agg(*sums).withColumn("node", F.monotonically_increasing_id()))

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    links = settle(nodes.where("depth > 0").select("node", "depth", "p1", "p2").join(above, ["depth", "p1", "p2"]).select("node", "parent", "parent_conv_id"))
    below = settle(links.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.min("node").alias("first")).withColumnRenamed("parent", "node"))

    zero = F.lit(0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.col("size")
    inner = F.col("first").isNotNull()
    enter = nodes.join(below, "node", "left").select(
        (2 * F.col("node")).alias("arc"),
        F.when(inner, 2 * F.col("first")).otherwise(2 * F.col("node") + 1).alias("next"),
        F.when(inner, 0).otherwise(1).cast("bigint").alias("leaves"),
        saved.alias("saved"),
    )
    leave = _siblings(links.select("node", "parent")).select(
        (2 * F.col("node") + 1).alias("arc"), F.coalesce(2 * F.col("after"), 2 * F.col("parent") + 1).alias("next"), zero.alias("leaves"), zero.alias("saved")
    )
    end = nodes.where("depth = 0").select((2 * F.col("node") + 1).alias("arc"), F.lit(None).cast("bigint").alias("next"), zero.alias("leaves"), zero.alias("saved"))
    ranks = list_rank(enter.unionByName(leave).unionByName(end), ["leaves", "saved"])
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    inside = ranks.groupBy(F.floor(F.col("arc") / 2).alias("node")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))

    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*keys), "depth").alias("k")).select("k.*", "conv_id")
    ends = joined_digests(last, keys, "conv_id")
    named = nodes.select("node", "depth", "k1", "k2", "conv_id", "n_convs").join(ends, keys, "left")
    return (
        named.join(links.select("node", "parent_conv_id"), "node", "left")
        .join(below.select("node", "n_children"), "node", "left")
        .join(inside, "node")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of ``conversations`` (conv_id, turn, role, text) as they are; other columns are ignored."""
    turns = settle(ordered_turns(conversations))
    return trie(turns, turns.select("conv_id").distinct())


# crc32 is worked out from its polynomial; a node is the list of its turns' digests, its subtree the longer lists that begin so.
SQL = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
turns AS (
  SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, length(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), tab),
rebuilt AS (
  SELECT ids.conv_id, pos, digest, size FROM ids JOIN turns ON turns.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 10 + pos, digest, size FROM ids JOIN turns USING (conv_id) WHERE pos > h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(digest, ' ') OVER w) AS k, size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
steps AS (
  SELECT *, lag(k) OVER w AS above, lead(k) OVER w IS NULL AS is_end FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT depth, k, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM steps GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, above AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, k)),
inside AS (
  SELECT p.depth, p.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * u.size)::BIGINT AS saved_tokens
  FROM full_nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM full_nodes v JOIN inside USING (depth, k) LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.k = v.above
"""
