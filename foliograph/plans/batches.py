"""Queries on batches, elections and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph import catalog
from foliograph.functions import paths
from foliograph.operators import batch, ranks, routing
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table
from foliograph.session import scratch_path
from foliograph.sources import files


@query(
    "a1_file_manifest",
    "SELECT page_id, strlen(html) + 1 AS length, 'txt' AS ext FROM pages",
)
def file_manifest(spark, sf_dir):
    """Pages written as a file each and listed."""
    folder = scratch_path(spark, "pages")
    named = files.write_texts(table(spark, sf_dir, "pages"), "page_id", "html", folder)
    found = files.file_manifest(spark, folder, "*.txt").select(files.file_number(F.col("path")).alias("file_no"), "length", "ext")
    return named.join(found, "file_no").select("page_id", "length", "ext")


@query(
    "a9_unpivot_manifest",
    """SELECT s_suppkey, s_name, platform, url, mode FROM (
      SELECT s_suppkey, s_name, 'linux-x86_64' AS platform, concat('http://h/', s_suppkey, '-lx') AS url, 'binary' AS mode
      FROM supplier
      UNION ALL SELECT s_suppkey, s_name, 'linux-aarch64', concat('http://h/', s_suppkey, '-la'), 'dir'
      FROM supplier WHERE s_suppkey % 3 <> 0
      UNION ALL SELECT s_suppkey, s_name, 'windows-x86_64', concat('http://h/', s_suppkey, '-wx'), 'dir'
      FROM supplier WHERE s_suppkey % 4 <> 0)""",
)
def unpivot_manifest(spark, sf_dir):
    n = F.col("s_suppkey")

    def entry(mark, mode):
        return F.struct(F.concat(F.lit("http://h/"), n, F.lit(mark)).alias("url"), F.lit(mode).alias("mode"))

    wide = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        "s_name",
        F.when(n >= 0, entry("-lx", "binary")).alias("linux-x86_64"),
        F.when(n % 3 != 0, entry("-la", "dir")).alias("linux-aarch64"),
        F.when(n % 4 != 0, entry("-wx", "dir")).alias("windows-x86_64"),
    )
    long = batch.unpivot_manifest(wide, ["s_suppkey", "s_name"], ["linux-x86_64", "linux-aarch64", "windows-x86_64"])
    return long.select("s_suppkey", "s_name", "platform", "entry.url", "entry.mode")


@query(
    "b14_validate_settings",
    """SELECT p_partkey, least(greatest(p_size * 4 - 20, 1), 100) AS jpeg_quality,
      coalesce(CASE WHEN p_partkey % 6 <> 0 THEN least(greatest(p_size * 3, 1), 100) END, 65) AS avif_quality,
      CAST(least(greatest(p_partkey % 13 - 2, 1), 8) AS INTEGER) AS max_concurrent, url AS rewriter_url,
      CASE WHEN p_partkey % 3 = 0 THEN 'download' ELSE 'clipboard' END AS output_mode,
      CASE WHEN p_partkey % 4 = 0 THEN concat('Invalid local LLM URL ''', url, ''': must start with http:// or https://') END AS error
    FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN concat('localhost:', p_partkey) WHEN 1 THEN concat('http://h:', p_partkey)
                    WHEN 2 THEN 'https://h' ELSE '' END AS url FROM part)""",
)
def validate_settings(spark, sf_dir):
    n = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        n,
        (F.col("p_size") * 4 - 20).alias("jpeg_quality"),
        F.when(n % 6 != 0, F.col("p_size") * 3).alias("avif_quality"),
        (n % 13 - 2).cast("int").alias("max_concurrent"),
        F.when(n % 4 == 0, F.concat(F.lit("localhost:"), n)).when(n % 4 == 1, F.concat(F.lit("  http://h:"), n, F.lit("\n")))
        .when(n % 4 == 2, "https://h").otherwise(" ").alias("rewriter_url"),
        F.when(n % 3 == 0, "download").when(n % 3 == 1, "clipboard").otherwise("printer").alias("output_mode"),
    )
    return batch.validate_settings(raw)


@query(
    "b15_verify_checksum",
    """SELECT concat('d', doc_id) AS path,
      CASE doc_id % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unverified' ELSE 'ok' END AS status,
      sha256(text) AS actual FROM documents""",
)
def verify_checksum(spark, sf_dir):
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(n, F.concat(F.lit("d"), n).alias("path"), F.col("text").cast("binary").alias("content"))
    want = docs.filter(n % 4 != 2).select(
        "path", F.when(n % 4 == 0, "").when(n % 4 == 1, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)).alias("expected")
    )
    return batch.verify_checksum(docs, want).select("path", "status", "actual")


@query(
    "b19_classify_error",
    f"""WITH {d.LOG_SQL}
    SELECT seq, CASE WHEN line LIKE 'Error%' AND job_id % 2 = 0 THEN 'pandoc'
                     WHEN line LIKE 'ffmpeg%' AND job_id % 3 = 0 THEN 'ffmpeg' END AS dependency
    FROM log_lines""",
)
def classify_error(spark, sf_dir):
    n = F.col("job_id")
    active = F.array_compact(F.array(F.when(n % 2 == 0, "pandoc"), F.when(n % 3 == 0, "ffmpeg")))
    lines = d.log_lines(spark, sf_dir)
    return lines.select("seq", batch.classify_error(F.col("line"), active).alias("dependency"))


RULES_SQL = f"rules AS ({catalog.values_sql(catalog.type_rule_rows(), 'mime, kind, mapped_ext, priority')})"
MIMES = [r[0] for r in catalog.type_rule_rows()] + ["text/unknown", "application/x-none"]
REPS_SQL = f"""
reps AS (SELECT event_id, user_id AS item_id, {d.list_sql(MIMES)}[1 + event_id % {len(MIMES)}] AS mime FROM events)"""


def _representations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("item_id"), d.dealt(MIMES, F.col("event_id")).alias("mime")
    )


@query(
    "c6_map_types",
    f"""WITH {RULES_SQL}, {REPS_SQL} SELECT event_id, mime, kind, mapped_ext, priority,
      CASE WHEN mapped_ext IN ('png', 'webp', 'heic', 'avif', 'gif', 'jpg', 'tif', 'bmp') THEN
        CASE mapped_ext WHEN 'jpg' THEN 'public.jpeg' WHEN 'gif' THEN 'com.compuserve.gif' WHEN 'tif' THEN 'public.tiff'
          WHEN 'bmp' THEN 'com.microsoft.bmp' WHEN 'webp' THEN 'org.webmproject.webp' ELSE concat('public.', mapped_ext) END END AS type_id
    FROM reps JOIN rules USING (mime)""",
)
def map_types(spark, sf_dir):
    mapped = batch.map_types(_representations(spark, sf_dir), catalog.type_rules(spark))
    type_id = batch.native_type_id(F.col("mapped_ext"))
    return mapped.select("event_id", "mime", "kind", "mapped_ext", "priority", type_id.alias("type_id"))


@query(
    "f3_elect",
    f"""WITH {RULES_SQL}, {REPS_SQL}, {d.MANIFEST_SQL},
    kinds AS (SELECT item_id, event_id, kind, mapped_ext, priority,
                CASE kind WHEN 'raw_image' THEN 2 WHEN 'document' THEN 3 ELSE 6 END AS rank FROM reps JOIN rules USING (mime))
    SELECT item_id, kind, mapped_ext, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, priority, event_id) AS rn FROM kinds) WHERE rn = 1""",
)
def elect(spark, sf_dir):
    """Among representations told by their content type."""
    mapped = batch.map_types(_representations(spark, sf_dir), catalog.type_rules(spark)).withColumn(
        "rank", F.array_position(F.lit(catalog.REPRESENTATION_ORDER), F.col("kind"))
    )
    return batch.elect(mapped, ["item_id"], ["rank", "priority", "event_id"], ["kind", "mapped_ext", "event_id"])


@query(
    "f3_elect_representation",
    f"""WITH kinds AS (SELECT user_id AS item_id, event_id % 6 AS place, event_id % 4 = 0 AS present FROM events)
    SELECT item_id, {d.list_sql(catalog.REPRESENTATION_ORDER)}[1 + min(place) FILTER (present)] AS kind,
      {d.list_sql(catalog.PLAIN_REPRESENTATION_ORDER)}[
        min(CASE place WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 END) FILTER (present)] AS plain_kind
    FROM kinds GROUP BY item_id""",
)
def elect_representation(spark, sf_dir):
    """Among all six kinds, with and without rich types; a batch of clipboard items of any size is one group by item."""
    n = F.col("event_id")
    kinds = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), d.dealt(catalog.REPRESENTATION_ORDER, n).alias("kind"), (n % 4 == 0).alias("present")
    )
    rich = batch.elect_representation(kinds)
    plain = batch.elect_representation(kinds, catalog.PLAIN_REPRESENTATION_ORDER).withColumnRenamed("kind", "plain_kind")
    return rich.join(plain, "item_id")


@query(
    "c11_with_fallback",
    """WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN text LIKE '%"%' THEN regexp_extract(text, '"([^"]*)"', 1)
                 ELSE '' END AS quoted FROM documents)
    SELECT doc_id, CASE WHEN coalesce(quoted, '') <> '' THEN quoted ELSE lower(string_split(text, ' ')[1]) END AS value,
      CASE WHEN coalesce(quoted, '') <> '' THEN 'primary' ELSE 'fallback' END AS used FROM p""",
)
def with_fallback(spark, sf_dir):
    """First quoted passage of a document, else its first word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def quoted(df):
        found = F.regexp_extract("text", '"([^"]*)"', 1)
        return df.select("doc_id", F.when(F.col("doc_id") % 5 != 0, found).alias("value"))

    def first_word(df):
        return df.select("doc_id", F.lower(F.substring_index("text", " ", 1)).alias("value"))

    return batch.with_fallback(docs, "doc_id", "value", quoted, first_word)


RESULTS_SQL = f"""{d.MANIFEST_SQL}, {d.ASKED_SQL}, {d.CATALOG_ROUTES_SQL},
    results AS (
      SELECT batch_id, ord, path,
        CASE WHEN route IS NOT NULL THEN concat('/out/', name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END, '.',
          CASE WHEN m.target = 'latex' THEN 'tex' ELSE m.target END) END AS output_path,
        CASE WHEN route IS NULL THEN concat('No conversion path from .', ext, ' to ', m.target) END AS error
      FROM asked m LEFT JOIN routes r ON m.fmt = r.src_fmt AND m.target_fmt = r.dst_fmt)"""


def _results(spark, sf_dir):
    planned = routing.plan_routes(d.asked(spark, sf_dir), routing.catalog_routes(spark))
    done = batch.item_results(planned, paths.output_path(F.col("path"), F.col("target"), "/out"))
    return done.select("batch_id", "ord", "path", "output_path", "error")


@query(
    "d2_batch_summary",
    f"""WITH RECURSIVE {RESULTS_SQL}
    SELECT batch_id, count(*) AS items, count(output_path) AS ok, count(error) AS failed,
           CASE WHEN count(error) > 0 THEN 1 ELSE 0 END AS exit_status FROM results GROUP BY batch_id""",
)
def batch_summary(spark, sf_dir):
    return batch.batch_summary(_results(spark, sf_dir))


@query("f2_in_input_order", f"WITH RECURSIVE {RESULTS_SQL} SELECT * FROM results ORDER BY batch_id, ord, path")
def in_input_order(spark, sf_dir):
    return batch.in_input_order(_results(spark, sf_dir), ["batch_id", "ord", "path"])


@query(
    "d7_dedupe_paths",
    """SELECT path, l_partkey, l_suppkey FROM (
      SELECT concat('/in/', l_orderkey, '/', l_linenumber) AS path, l_partkey, l_suppkey,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def dedupe_paths(spark, sf_dir):
    added = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/in/"), "l_orderkey", F.lit("/"), "l_linenumber").alias("path"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    kept = batch.dedupe_paths(added, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return kept.select("path", "l_partkey", "l_suppkey")


@query(
    "e1_renumber",
    f"""WITH {d.MANIFEST_SQL}
    SELECT path, row_number() OVER (PARTITION BY batch_id ORDER BY ord, path) AS ordinal FROM manifest
    WHERE ext IN ({', '.join(repr(m) for m in catalog.MEDIA)})""",
)
def renumber(spark, sf_dir):
    """Places of the files a trim batch admits, closed up after the others are removed."""
    admitted = batch.admit(d.manifest(spark, sf_dir), "trim").filter("accepted")
    # line numbers repeat within a batch, so they cannot cut it into blocks
    placed = ranks.ordinals(admitted.select("batch_id", "ord", "path"), ["batch_id"], ["ord", "path"])
    return placed.select("path", "ordinal")
