"""Queries on merging documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import assembly
from foliograph.plans import derived as d
from foliograph.plans.registry import query
from foliograph.session import settle

KEY = ["merge_id"]


@query("e3_renumber_objects", f"WITH {d.OBJECTS_SQL} SELECT merge_id, doc_seq, obj_id, new_id FROM objects")
def renumber_objects(spark, sf_dir):
    return assembly.renumber_objects(d.objects(spark, sf_dir).select("merge_id", "doc_seq", "obj_id"), KEY)


@query(
    "g2_union_documents",
    f"""WITH {d.OBJECTS_SQL} SELECT merge_id, count(*) AS objects, count(DISTINCT new_id) AS ids, max(new_id) AS max_id,
      sum(new_id * obj_id) AS checksum FROM objects GROUP BY merge_id""",
)
def union_documents(spark, sf_dir):
    """Even and odd documents as two pools put together: no id occurs twice."""
    pool = d.objects(spark, sf_dir).select("merge_id", "doc_seq", "obj_id")
    halves = [pool.filter(F.col("doc_seq") % 2 == r) for r in (0, 1)]
    united = assembly.union_documents(halves, KEY)
    return united.groupBy("merge_id").agg(
        F.count(F.lit(1)).alias("objects"), F.countDistinct("new_id").alias("ids"), F.max("new_id").alias("max_id"),
        F.sum(F.col("new_id") * F.col("obj_id")).alias("checksum"),
    )


LINKED_SQL = f"""{d.OBJECTS_SQL},
linked AS (
  SELECT o.*, p.new_id AS parent_new, r.new_id AS ref_new FROM objects o
  LEFT JOIN objects p ON o.merge_id = p.merge_id AND o.doc_seq = p.doc_seq AND o.parent_id = p.obj_id
  LEFT JOIN objects r ON o.merge_id = r.merge_id AND o.doc_seq = r.doc_seq AND o.ref = r.obj_id
)"""


@query(
    "c9_rewrite_refs",
    f"""WITH {LINKED_SQL} SELECT merge_id, new_id, parent_new AS new_parent_id,
      CASE WHEN ref IS NULL THEN '' ELSE concat(ref_new, ',2') END AS refs FROM linked""",
)
def rewrite_refs(spark, sf_dir):
    pool = d.objects(spark, sf_dir).select("merge_id", "doc_seq", "obj_id", "parent_id", "refs")
    numbered = settle(assembly.renumber_objects(pool, KEY))
    linked = assembly.rewrite_refs(numbered, numbered, KEY)
    return linked.select("merge_id", "new_id", "new_parent_id", F.array_join(F.col("new_refs").cast("array<string>"), ",").alias("refs"))


MERGE_SQL = f"""{LINKED_SQL},
sizes AS (SELECT merge_id, count(DISTINCT doc_seq) AS documents, count(*) AS n, count(page_no) AS pages FROM objects GROUP BY merge_id)"""

ANCESTORS_SQL = """
chain AS (
  SELECT merge_id, doc_seq, obj_id, parent_id AS up, "MediaBox" AS box, "Resources" AS res, CASE WHEN "Resources" IS NOT NULL THEN ref END AS res_ref FROM objects
  UNION ALL
  SELECT c.merge_id, c.doc_seq, c.obj_id, o.parent_id, coalesce(c.box, o."MediaBox"), coalesce(c.res, o."Resources"),
         CASE WHEN c.res IS NOT NULL THEN c.res_ref WHEN o."Resources" IS NOT NULL THEN o.ref END
  FROM chain c JOIN objects o ON c.merge_id = o.merge_id AND c.doc_seq = o.doc_seq AND c.up = o.obj_id
),
resolved AS (SELECT merge_id, doc_seq, obj_id, box, res, res_ref FROM chain WHERE up IS NULL)"""


@query(
    "d4_merge_objects",
    f"""WITH RECURSIVE {MERGE_SQL}, {ANCESTORS_SQL},
    pool AS (
      SELECT l.merge_id, l.new_id, NULL AS kind, CASE WHEN l.page_no IS NOT NULL THEN n + 1 ELSE parent_new END AS new_parent_id,
        CASE WHEN l.page_no IS NOT NULL THEN box ELSE l."MediaBox" END AS "MediaBox",
        CASE WHEN l.page_no IS NOT NULL THEN res || ' ' || coalesce(t.new_id::VARCHAR, '') WHEN l."Resources" IS NOT NULL THEN concat(l."Resources", ' ', ref_new) END AS "Resources",
        NULL AS count, CASE WHEN l.ref IS NULL THEN '' ELSE concat(ref_new, ',2') END AS refs
      FROM linked l JOIN sizes s ON l.merge_id = s.merge_id
      JOIN resolved r ON l.merge_id = r.merge_id AND l.doc_seq = r.doc_seq AND l.obj_id = r.obj_id
      LEFT JOIN objects t ON t.merge_id = l.merge_id AND t.doc_seq = l.doc_seq AND t.obj_id = r.res_ref WHERE documents >= 2
      UNION ALL
      SELECT l.merge_id, n + 1, 'Pages', NULL, NULL, NULL, pages, coalesce(string_agg(new_id::VARCHAR, ',' ORDER BY doc_seq, page_no), '')
      FROM linked l JOIN sizes s ON l.merge_id = s.merge_id WHERE documents >= 2 AND page_no IS NOT NULL GROUP BY ALL
      UNION ALL SELECT merge_id, n + 1, 'Pages', NULL, NULL, NULL, pages, '' FROM sizes WHERE documents >= 2 AND pages = 0
      UNION ALL SELECT merge_id, n + 2, 'Catalog', NULL, NULL, NULL, NULL, (n + 1)::VARCHAR FROM sizes WHERE documents >= 2)
    SELECT merge_id, new_id, kind, new_parent_id, "MediaBox", nullif("Resources", '') AS "Resources", count, md5(refs) AS refs_md5 FROM pool""",
)
def merge_objects(spark, sf_dir):
    """Resources are tokens: a text and a reference to the object that the node itself refers to."""
    pool = d.objects(spark, sf_dir)
    token = F.struct(F.col("Resources").alias("text"), F.lit(None).cast("bigint").alias("ref"))
    link = F.struct(F.lit(None).cast("string").alias("text"), F.get("refs", F.lit(0)).alias("ref"))
    pool = pool.withColumn("Resources", F.when(F.col("Resources").isNotNull(), F.array(token, link)))
    merged = assembly.merged_pool(pool, KEY)
    told = F.transform("Resources", lambda t: F.coalesce(t["text"], t["ref"].cast("string"), F.lit("")))
    return merged.select(
        "merge_id", "new_id", "kind", "new_parent_id", "MediaBox", F.array_join(told, " ").alias("Resources"), "count",
        F.md5(F.array_join(F.col("new_refs").cast("array<string>"), ",")).alias("refs_md5"),
    )


@query(
    "d4_merge_pages",
    f"""WITH {MERGE_SQL} SELECT l.merge_id, row_number() OVER (PARTITION BY l.merge_id ORDER BY doc_seq, page_no) AS position, new_id AS page_id
    FROM linked l JOIN sizes s ON l.merge_id = s.merge_id WHERE documents >= 2 AND page_no IS NOT NULL""",
)
def merge_pages(spark, sf_dir):
    pool = d.objects(spark, sf_dir).drop("MediaBox", "Resources")
    _, pages, _ = assembly.merge_documents(pool, KEY)
    return pages.select("merge_id", "position", "page_id")


@query(
    "d4_merge_summary",
    f"""WITH {MERGE_SQL} SELECT merge_id, documents, CASE WHEN documents >= 2 THEN pages END AS pages,
      CASE WHEN documents >= 2 THEN n + 1 END AS pages_root, CASE WHEN documents >= 2 THEN n + 2 END AS catalog_id,
      CASE WHEN documents < 2 THEN 'Need at least 2 PDFs to merge' END AS error FROM sizes""",
)
def merge_summary(spark, sf_dir):
    return assembly.merge_summary(d.objects(spark, sf_dir), KEY)
