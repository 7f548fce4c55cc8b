"""Merging documents: object renumbering, reference rewriting, page order.

Objects are rows (merge keys, doc_seq, obj_id, parent_id, page_no, refs, ...); ``page_no``
is set on pages only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph.catalog import CATALOG_NODE, ERRORS, INHERITED_KEYS, PAGES_NODE
from foliograph.operators.hierarchy import resolve_parents, take_from_parents
from foliograph.operators.ranks import ordinals, seq_block, sum_before
from foliograph.session import per_key, settle

TOO_FEW = ERRORS["too_few"]
VALUE_PLACES = 1 << 32  # places of one column of references


def global_rank(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """1-based rank over (doc_seq, ``order``) within the merge keys.

    Documents are counted, the counts accumulated over the small table of documents, and
    the rank inside each document added. Neither step needs a whole group in one task.
    """
    counts = df.groupBy(*keys, "doc_seq").agg(F.count(F.lit(1)).alias("_n"))
    base = sum_before(counts, keys, ["doc_seq"], [seq_block(F.col("doc_seq"))], "_n", "_base").drop("_n")
    placed = ordinals(df, [*keys, "doc_seq"], [order], [seq_block(F.col(order))], "_rank")
    ranked = placed.join(base, [*keys, "doc_seq"])
    return ranked.withColumn(name, F.col("_base") + F.col("_rank")).drop("_base", "_rank")


def renumber_objects(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``new_id``: unique over all documents of a merge, in (doc_seq, obj_id) order."""
    return global_rank(objects, keys, "obj_id", "new_id")


def _token_places(name: str, first: int) -> Column:
    inside = F.transform(name, lambda t, i: F.struct((i + first).alias("at"), t["ref"].alias("old")))
    return F.filter(inside, lambda e: e["old"].isNotNull())


def _renewed_tokens(name: str, first: int) -> Column:
    def renewed(t: Column, i: Column) -> Column:
        ref = F.coalesce(F.try_element_at("_tokens", (i + first).cast("bigint")), t["ref"])
        return F.struct(t["text"].alias("text"), ref.alias("ref"))

    return F.transform(name, renewed)


def rewrite_refs(objects: DataFrame, id_map: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Replace ``refs`` and ``parent_id`` by new ids; a reference to nothing keeps its old id.

    ``id_map`` holds (keys, doc_seq, obj_id, new_id). ``values`` are columns whose values hold references too, as lists of tokens
    (text, ref). One join serves all: each reference travels with its place, the parent's being -1, that of a token
    behind its column's number. Regrouping is by object, whose references were one value.
    """
    same, values = [*keys, "doc_seq"], values or []
    entry = "array<struct<at:bigint,old:bigint>>"
    places = [
        F.when(F.col("parent_id").isNotNull(), F.array(F.struct(F.lit(-1).cast("bigint").alias("at"), F.col("parent_id").alias("old")))),
        F.transform("refs", lambda r, i: F.struct(i.cast("bigint").alias("at"), r.alias("old"))),
    ]
    places += [_token_places(name, k * VALUE_PLACES) for k, name in enumerate(values, 1)]
    links = F.concat(*[F.coalesce(p.cast(entry), F.array().cast(entry)) for p in places])
    opened = objects.select(*same, "new_id", F.inline(links))
    target = id_map.select(*same, F.col("obj_id").alias("old"), F.col("new_id").alias("mapped"))
    mapped = opened.join(target, [*same, "old"], "left").select(
        *same, "new_id", "at", F.coalesce("mapped", "old").alias("ref")
    )
    found = [
        F.max(F.when(F.col("at") == -1, F.col("ref"))).alias("new_parent_id"),
        F.array_sort(F.collect_list(F.when(F.col("at").between(0, VALUE_PLACES - 1), F.struct("at", "ref"))))["ref"].alias("new_refs"),
    ]
    if values:
        found.append(F.map_from_entries(F.collect_list(F.when(F.col("at") >= VALUE_PLACES, F.struct("at", "ref")))).alias("_tokens"))
    joined = objects.join(mapped.groupBy(*same, "new_id").agg(*found), [*same, "new_id"], "left")
    empty = F.array().cast("array<bigint>")
    renewed = {"new_refs": F.coalesce("new_refs", empty)}
    renewed |= {name: _renewed_tokens(name, k * VALUE_PLACES) for k, name in enumerate(values, 1)}
    return joined.withColumns(renewed).drop("_tokens")


def union_documents(pools: list[DataFrame], keys: list[str]) -> DataFrame:
    """One pool out of several, with ids that no longer collide."""
    pool = pools[0]
    for other in pools[1:]:
        pool = pool.unionByName(other)
    return renumber_objects(pool, keys)


def merge_summary(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, pages and new root ids per merge, or the error that there is too little to merge."""
    totals = objects.groupBy(*keys, "doc_seq").agg(
        F.count(F.lit(1)).alias("n"), F.count("page_no").alias("pages")
    )
    counted = per_key(
        totals, keys, F.count(F.lit(1)).alias("documents"), F.sum("n").alias("objects"), F.sum("pages").alias("pages")
    )
    enough = F.col("documents") >= 2
    return counted.select(
        *keys,
        "documents",
        F.when(enough, F.col("pages")).alias("pages"),
        F.when(enough, F.col("objects") + 1).alias("pages_root"),
        F.when(enough, F.col("objects") + 2).alias("catalog_id"),
        F.when(~enough, F.lit(TOO_FEW)).alias("error"),
    )


def merge_documents(
    objects: DataFrame, keys: list[str], attributes: list[str] = INHERITED_KEYS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, pages, summary) of each merge.

    objects: ``new_id``, rewritten references, inherited attributes on pages, and every
    page's parent pointing at the new page root. Attributes are texts or lists of tokens (text, ref), whose
    references are renumbered like any other, inherited ones too. pages: the page list in input order, as
    rows with a ``position``. summary: counts, the ids of the new root nodes, or an error
    for merges of fewer than two documents, which yield no objects and pages.
    """
    numbered, summary = _numbered(objects, keys)
    pages = global_rank(numbered.filter(F.col("page_no").isNotNull()), keys, "page_no", "position").select(
        *keys, "position", "doc_seq", F.col("new_id").alias("page_id")
    )
    return _merged(numbered, summary, keys, attributes), pages, summary


def _numbered(objects: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The written objects of valid merges with ``new_id``, and the summary; all else reads these two tables."""
    summary = settle(merge_summary(objects, keys))
    valid = summary.filter(F.col("error").isNull()).select(*keys)
    return settle(renumber_objects(objects.join(valid, keys, "left_semi"), keys)), summary


def _merged(numbered: DataFrame, summary: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    valid = summary.filter(F.col("error").isNull()).select(*keys, "pages_root")
    is_page = F.col("page_no").isNotNull()
    attributes = [a for a in attributes if a in numbered.columns]
    tokens = [a for a in attributes if numbered.schema[a].dataType.typeName() == "array"]
    filled = numbered
    if attributes:
        scope = [*keys, "doc_seq"]
        parents = resolve_parents(numbered.withColumnRenamed("obj_id", "node_id"), attributes, scope)
        own = {f"_own_{a}": F.col(a) for a in attributes}
        filled = take_from_parents(numbered.withColumns(own), parents, attributes, scope)
        # an inherited value goes onto pages only, all other nodes keep what they had
        filled = filled.withColumns(
            {a: F.when(is_page, F.col(a)).otherwise(F.col(f"_own_{a}")) for a in attributes}
        ).drop(*own)
    return (
        rewrite_refs(filled, numbered, keys, tokens)
        .join(valid, keys)
        .withColumn("new_parent_id", F.when(is_page, F.col("pages_root")).otherwise(F.col("new_parent_id")))
        .drop("pages_root")
    )


def added_nodes(numbered: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """The two nodes a merge makes: the page root, whose references are the pages in order, and the catalog, which refers to the root.

    A root's page list is one value of its document, as it is in the file.
    """
    listed = F.array_sort(F.collect_list(F.struct("doc_seq", "page_no", "new_id")))["new_id"]
    kids = numbered.filter(F.col("page_no").isNotNull()).groupBy(*keys).agg(listed.alias("kids"))
    made = summary.filter(F.col("error").isNull()).join(kids, keys, "left")
    none = F.array().cast("array<bigint>")
    root = F.struct(
        F.lit(PAGES_NODE).alias("kind"), F.col("pages_root").alias("new_id"), F.coalesce("kids", none).alias("new_refs"), F.col("pages").alias("count")
    )
    top = F.struct(
        F.lit(CATALOG_NODE).alias("kind"), F.col("catalog_id").alias("new_id"), F.array("pages_root").alias("new_refs"), F.lit(None).cast("bigint").alias("count")
    )
    return made.select(*keys, F.inline(F.array(root, top)))


def merged_pool(objects: DataFrame, keys: list[str], attributes: list[str] = INHERITED_KEYS) -> DataFrame:
    """All nodes of each merged document: the renumbered objects (``kind`` NULL) and the page root and catalog made for it."""
    numbered, summary = _numbered(objects, keys)
    merged = _merged(numbered, summary, keys, attributes)
    return merged.unionByName(added_nodes(numbered, summary, keys), allowMissingColumns=True)
