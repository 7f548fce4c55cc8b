"""Queries on conversion planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliograph import catalog
from foliograph.functions import paths
from foliograph.operators import batch, hierarchy, routing
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table
from foliograph.session import per_key


def _edges(spark: SparkSession, caps: list[str] | None = None) -> DataFrame:
    return routing.usable_edges(catalog.edges(spark), caps or [catalog.ALWAYS])


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per extension: a manifest reduced before anything is multiplied."""
    return d.manifest(spark, sf_dir).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


@query("b1_path_ext", f"WITH {d.MANIFEST_SQL} SELECT path, ext FROM manifest")
def path_ext(spark, sf_dir):
    return d.manifest(spark, sf_dir).select("path", paths.path_ext(F.col("path")).alias("ext"))


@query("b2_normalize_ext", f"WITH {d.MANIFEST_SQL} SELECT path, fmt FROM manifest")
def normalize_ext(spark, sf_dir):
    return d.manifest(spark, sf_dir).select("path", paths.normalize_ext(F.col("ext")).alias("fmt"))


@query(
    "b3_output_path",
    f"""WITH {d.MANIFEST_SQL}
    SELECT path,
      concat(folder, name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END, '.',
             CASE WHEN target = 'latex' THEN 'tex' ELSE target END) AS beside,
      concat('/out/', name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END, '.',
             CASE WHEN target = 'latex' THEN 'tex' ELSE target END) AS in_folder,
      count(*) OVER (PARTITION BY name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END,
             CASE WHEN target = 'latex' THEN 'tex' ELSE target END) AS collisions
    FROM manifest""",
)
def output_path(spark, sf_dir):
    """Also counts how many inputs would be written to the same output."""
    named = d.manifest(spark, sf_dir).select(
        "path",
        paths.output_path(F.col("path"), F.col("target")).alias("beside"),
        paths.output_path(F.col("path"), F.col("target"), "/out").alias("in_folder"),
    )
    clashes = per_key(named, ["in_folder"], F.count(F.lit(1)).alias("collisions"))
    return named.join(clashes, "in_folder")


@query(
    "b4_suffixed_path",
    f"""WITH {d.MANIFEST_SQL}
    SELECT path,
      concat(folder, name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END, '-trim',
             CASE WHEN ending = '.tar.gz' THEN '.gz' ELSE ending END) AS trimmed,
      concat('/out/', name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END, '-merged.pdf') AS merged
    FROM manifest""",
)
def suffixed_path(spark, sf_dir):
    return d.manifest(spark, sf_dir).select(
        "path",
        paths.suffixed_path(F.col("path"), "-trim").alias("trimmed"),
        paths.suffixed_path(F.col("path"), "-merged", F.lit("pdf"), "/out").alias("merged"),
    )


@query(
    "b17_admit",
    f"""WITH {d.MANIFEST_SQL}
    SELECT path, fmt = 'pdf' AS merge_ok,
      CASE WHEN fmt = 'pdf' THEN NULL ELSE 'Only PDF files can be merged' END AS merge_reason,
      ext IN ({', '.join(repr(m) for m in catalog.MEDIA)}) AS trim_ok,
      CASE WHEN ext IN ({', '.join(repr(m) for m in catalog.MEDIA)}) THEN NULL
           ELSE 'Only audio/video files can be trimmed' END AS trim_reason,
      fmt NOT IN ('xyz', '', 'gz', 'heic') AS convert_ok,
      CASE WHEN fmt NOT IN ('xyz', '', 'gz', 'heic') THEN NULL
           ELSE concat('Unsupported file type: .', ext) END AS convert_reason,
      ext IN ({', '.join(repr(m) for m in catalog.AUDIO)}) AS audio_only
    FROM manifest""",
)
def admit(spark, sf_dir):
    df = d.manifest(spark, sf_dir).select("path")
    for mode in ("merge", "trim", "convert"):
        df = batch.admit(df, mode).withColumnsRenamed({"accepted": f"{mode}_ok", "reason": f"{mode}_reason"})
    return df.withColumn("audio_only", batch.is_audio_only(F.col("path")))


@query(
    "c1_direct_targets",
    f"""WITH {d.MANIFEST_SQL}, {d.EDGES_SQL}
    SELECT path, dst_fmt AS target FROM manifest JOIN edges ON fmt = src_fmt AND cond = 'always'""",
)
def direct_targets(spark, sf_dir):
    return routing.direct_targets(d.manifest(spark, sf_dir).select("path", "ext"), _edges(spark)).select("path", "target")


@query(
    "c2_unsupported",
    f"""WITH {d.MANIFEST_SQL}, {d.EDGES_SQL}
    SELECT path, concat('Unsupported file type: .', ext) AS error FROM manifest
    WHERE fmt NOT IN (SELECT src_fmt FROM edges WHERE cond = 'always')""",
)
def unsupported(spark, sf_dir):
    return routing.unsupported(d.manifest(spark, sf_dir).select("path", "ext"), _edges(spark)).select("path", "error")


@query(
    "c3_plan_routes",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.ASKED_SQL}, {d.CATALOG_ROUTES_SQL}
    SELECT path, m.target, array_to_string(route, '>') AS route, CAST(hops AS BIGINT) AS hops, r.cost,
      CASE WHEN route IS NULL THEN concat('No conversion path from .', ext, ' to ', m.target) END AS error
    FROM asked m LEFT JOIN routes r ON m.fmt = r.src_fmt AND m.target_fmt = r.dst_fmt""",
)
def plan_routes(spark, sf_dir):
    planned = routing.plan_routes(d.asked(spark, sf_dir).select("path", "ext", "target"), routing.catalog_routes(spark))
    return planned.select(
        "path", "target", F.array_join("route", ">").alias("route"), F.col("hops").cast("bigint").alias("hops"), "cost", "error"
    )


@query(
    "c4_route_hops",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL}, {d.HANDLERS_SQL},
    steps AS (
      SELECT route[n] AS src_fmt, route[n + 1] AS dst_fmt FROM (
        SELECT route, unnest(generate_series(1, len(route) - 1)) AS n
        FROM manifest m JOIN routes r ON m.fmt = r.src_fmt AND m.target_fmt = r.dst_fmt))
    SELECT s.src_fmt, s.dst_fmt, hop_kind, count(*) AS uses,
      CASE WHEN hop_kind IS NULL THEN 'none' END AS error
    FROM steps s LEFT JOIN handlers h ON s.src_fmt = h.src_fmt AND s.dst_fmt = h.dst_fmt GROUP BY ALL""",
)
def route_hops(spark, sf_dir):
    """Handlers the planned conversions need, with how often each hop is used."""
    formats = d.manifest(spark, sf_dir).groupBy("ext", "target").agg(F.count(F.lit(1)).alias("files"))
    planned = routing.plan_routes(formats, routing.catalog_routes(spark)).filter("error IS NULL")
    hop = F.explode(
        F.arrays_zip(
            F.slice("route", F.lit(1), F.size("route") - 1).alias("src_fmt"),
            F.slice("route", F.lit(2), F.size("route") - 1).alias("dst_fmt"),
        )
    )
    pairs = planned.select("files", hop.alias("hop")).groupBy("hop.src_fmt", "hop.dst_fmt").agg(F.sum("files").alias("uses"))
    return routing.route_hops(pairs, catalog.handlers(spark)).select("src_fmt", "dst_fmt", "hop_kind", "uses", "error")


@query(
    "c5_usable_edges",
    f"""WITH {d.MANIFEST_SQL}, {d.EDGES_SQL}
    SELECT path, dst_fmt AS target FROM manifest JOIN edges ON fmt = src_fmt AND cond = 'macos'""",
)
def usable_edges(spark, sf_dir):
    """What the extra capability adds for each file."""
    extra = _edges(spark, [catalog.MACOS])
    return routing.direct_targets(d.manifest(spark, sf_dir).select("path", "ext"), extra).select("path", "target")


@query(
    "c12_format_params",
    f"""WITH {d.MANIFEST_SQL}
    SELECT path,
      CASE WHEN fmt IN ('md', 'txt') THEN 'markdown' WHEN fmt = 'tex' THEN 'latex' ELSE fmt END AS reader,
      CASE target_fmt WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'plain' WHEN 'tex' THEN 'latex' ELSE target_fmt END AS writer,
      CASE WHEN target_fmt = 'ogg' THEN '-codec:a libvorbis -q:a 4' END AS vorbis_args,
      CASE target_fmt WHEN 'mp3' THEN '-codec:a libmp3lame -q:a 2' WHEN 'aac' THEN '-codec:a aac -b:a 192k'
        WHEN 'flac' THEN '-codec:a flac' WHEN 'opus' THEN '-codec:a libopus -b:a 128k'
        WHEN 'wav' THEN '-codec:a pcm_s16le' WHEN 'm4a' THEN '-vn -codec:a aac -b:a 192k'
        WHEN 'gif' THEN '-vf fps=15,scale=480:-1:flags=lanczos,split[s0][s1];[s0]palettegen[p];[s1][p]paletteuse'
        WHEN 'webm' THEN '-codec:v libvpx-vp9 -codec:a libopus' WHEN 'ogg' THEN '-codec:a vorbis -strict -2 -ac 2 -q:a 4' END AS encoder_args
    FROM manifest""",
)
def format_params(spark, sf_dir):
    named = d.manifest(spark, sf_dir).withColumns(
        {"fmt": paths.normalize_ext(F.col("ext")), "target_fmt": paths.normalize_ext(F.col("target"))}
    )
    target, args = F.col("target_fmt"), catalog.encoder_params(spark)
    named = routing.format_names(named, catalog.format_params(spark), F.col("fmt"), target)
    named = routing.format_params(named, routing.by_capability(args, [catalog.ALWAYS]), target, ["encoder_args"])
    rich = routing.by_capability(args, ["libvorbis"]).withColumnRenamed("encoder_args", "vorbis_args")
    return routing.format_params(named, rich, target, ["vorbis_args"]).select(
        "path", "reader", "writer", "encoder_args", "vorbis_args"
    )


@query(
    "d1_common_targets",
    f"""WITH {d.MANIFEST_SQL}, {d.EDGES_SQL}, usable AS (SELECT * FROM edges WHERE cond = 'always'),
    supported AS (SELECT * FROM manifest WHERE fmt IN (SELECT src_fmt FROM usable)),
    sizes AS (SELECT batch_id, count(*) AS files FROM supported GROUP BY batch_id HAVING count(*) >= 2)
    SELECT s.batch_id, dst_fmt AS target, files
    FROM supported s JOIN usable ON fmt = src_fmt JOIN sizes z ON s.batch_id = z.batch_id
    GROUP BY s.batch_id, dst_fmt, files HAVING count(DISTINCT path) = files""",
)
def common_targets(spark, sf_dir):
    return routing.common_targets(d.manifest(spark, sf_dir).select("batch_id", "ext"), _edges(spark))


@query(
    "f1_order_targets",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL}
    SELECT m.fmt, m.files, string_agg(concat(dst_fmt, ':', hops), ',' ORDER BY hops, dst_fmt) AS chained
    FROM (SELECT fmt, count(*) AS files FROM manifest GROUP BY fmt) m JOIN routes r ON m.fmt = r.src_fmt
    WHERE hops >= 2 AND NOT EXISTS (SELECT 1 FROM usable e WHERE e.src_fmt = r.src_fmt AND e.dst_fmt = r.dst_fmt)
    GROUP BY m.fmt, m.files""",
)
def order_targets(spark, sf_dir):
    chained = routing.chained_targets(routing.catalog_routes(spark), _edges(spark))
    ordered = routing.order_targets(chained, ["src_fmt"]).withColumnRenamed("src_fmt", "fmt")
    formats = d.manifest(spark, sf_dir).groupBy(paths.normalize_ext(F.col("ext")).alias("fmt")).agg(
        F.count(F.lit(1)).alias("files")
    )
    listed = F.array_join(F.transform("chained", lambda c: F.concat(c["format"], F.lit(":"), c["hops"].cast("string"))), ",")
    return formats.join(ordered, "fmt").select("fmt", "files", listed.alias("chained"))


@query(
    "g1_chained_targets",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL}
    SELECT m.ext, m.files, dst_fmt, CAST(hops AS BIGINT) AS hops, array_to_string(route, '>') AS route
    FROM (SELECT ext, fmt, count(*) AS files FROM manifest GROUP BY ext, fmt) m JOIN routes r ON m.fmt = r.src_fmt
    WHERE len(route) > 2 AND NOT EXISTS
      (SELECT 1 FROM usable e WHERE e.src_fmt = r.src_fmt AND e.dst_fmt = r.dst_fmt)""",
)
def chained_targets(spark, sf_dir):
    chained = routing.chained_targets(routing.catalog_routes(spark), _edges(spark))
    formats = _formats(spark, sf_dir).withColumn("src_fmt", paths.normalize_ext(F.col("ext")))
    return formats.join(chained, "src_fmt").select(
        "ext", "files", "dst_fmt", F.col("hops").cast("bigint").alias("hops"), F.array_join("route", ">").alias("route")
    )


TRADE_SQL = """
trade AS (
  SELECT * FROM (
    SELECT concat('N', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS src_fmt,
           concat('N', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS dst_fmt, count(*) % 17 + 1 AS cost
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey)
  WHERE src_fmt <> dst_fmt
)"""


@query(
    "h1_min_cost_paths",
    f"""WITH RECURSIVE {TRADE_SQL}, {d.routes_sql('trade', 18)}
    SELECT src_fmt, dst_fmt, cost, CAST(hops AS BIGINT) AS hops, array_to_string(route, '>') AS route FROM routes""",
)
def min_cost_paths(spark, sf_dir):
    """Cheapest trade routes between nations."""
    routes = routing.min_cost_paths(d.trade_edges(spark, sf_dir))
    return routes.select(
        "src_fmt", "dst_fmt", "cost", F.col("hops").cast("bigint").alias("hops"), F.array_join("route", ">").alias("route")
    )


@query(
    "h2_expand_plan",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL}, {d.HANDLERS_SQL},
    steps AS (
      SELECT path, concat(name, CASE WHEN ending = '.tar.gz' THEN '.tar' ELSE '' END) AS stem, n - 1 AS step,
             len(route) - 1 AS total, route[n] AS src_fmt, route[n + 1] AS dst_fmt
      FROM (SELECT *, unnest(generate_series(1, len(route) - 1)) AS n
            FROM manifest m JOIN routes r ON m.fmt = r.src_fmt AND m.target_fmt = r.dst_fmt))
    SELECT path, step, s.src_fmt, s.dst_fmt, hop_kind,
      CASE WHEN step = 0 THEN path ELSE concat('/tmp/chain/', stem, '.', s.src_fmt) END AS in_path,
      concat(CASE WHEN step = total - 1 THEN '/out/' ELSE '/tmp/chain/' END, stem, '.', s.dst_fmt) AS out_path,
      step = total - 1 AS is_last, round(step / total * 100.0, 6) AS percent
    FROM steps s JOIN handlers h ON s.src_fmt = h.src_fmt AND s.dst_fmt = h.dst_fmt""",
)
def expand_plan(spark, sf_dir):
    items = d.manifest(spark, sf_dir).select("path", "ext", "target")
    plan = routing.expand_plan(items, routing.catalog_steps(spark), "/tmp/chain", "/out")
    return plan.select(
        "path", F.col("step").cast("bigint").alias("step"), "src_fmt", "dst_fmt", "hop_kind", "in_path", "out_path",
        "is_last", F.round("percent", 6).alias("percent"),
    )


@query(
    "e2_hop_progress",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL}
    SELECT path, n AS seq, round(n / hops * 100.0, 6) AS percent
    FROM (SELECT path, hops, unnest(generate_series(0, hops)) AS n
          FROM manifest m JOIN routes r ON m.fmt = r.src_fmt AND m.target_fmt = r.dst_fmt)""",
)
def hop_progress(spark, sf_dir):
    items = d.manifest(spark, sf_dir).select("path", "ext", "target")
    plan = routing.expand_plan(items, routing.catalog_steps(spark), "/tmp/chain", "/out")
    events = routing.hop_progress(plan)
    return events.select("path", F.col("seq").cast("bigint").alias("seq"), F.round("percent", 6).alias("percent"))


@query(
    "h3_inherit_attributes",
    """WITH r AS (SELECT r_regionkey, r_name AS "MediaBox" FROM region),
    n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS "Resources" FROM nation),
    c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS "Rotate",
                 CASE WHEN c_custkey % 5 = 0 THEN c_name END AS box FROM customer),
    o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS "CropBox" FROM orders),
    nr AS (SELECT * FROM n LEFT JOIN r ON n_regionkey = r_regionkey),
    cn AS (SELECT c_custkey, c_nationkey, "Rotate", coalesce(box, "MediaBox") AS "MediaBox", "Resources"
           FROM c LEFT JOIN nr ON c_nationkey = n_nationkey)
    SELECT concat('r', r_regionkey) AS node_id, "MediaBox", NULL AS "Resources", NULL AS "Rotate", NULL AS "CropBox" FROM r
    UNION ALL SELECT concat('n', n_nationkey), "MediaBox", "Resources", NULL, NULL FROM nr
    UNION ALL SELECT concat('c', c_custkey), "MediaBox", "Resources", "Rotate", NULL FROM cn
    UNION ALL SELECT concat('o', o_orderkey), "MediaBox", "Resources", "Rotate", "CropBox"
              FROM o LEFT JOIN cn ON o_custkey = c_custkey""",
)
def inherit_attributes(spark, sf_dir):
    return hierarchy.inherit_attributes(d.places(spark, sf_dir)).select("node_id", *catalog.INHERITED_KEYS)


@query(
    "h4_detect",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.CATALOG_ROUTES_SQL},
    direct AS (SELECT src_fmt, string_agg(dst_fmt, ',' ORDER BY ord) AS direct FROM usable GROUP BY src_fmt),
    chained AS (
      SELECT src_fmt, string_agg(concat(dst_fmt, ':', array_to_string(route, '>')), ',' ORDER BY hops, dst_fmt) AS chained
      FROM routes r WHERE hops >= 2 AND NOT EXISTS
        (SELECT 1 FROM usable e WHERE e.src_fmt = r.src_fmt AND e.dst_fmt = r.dst_fmt) GROUP BY src_fmt)
    SELECT path, direct, CASE WHEN direct IS NOT NULL THEN coalesce(chained, '') END AS chained,
      CASE WHEN direct IS NULL THEN concat('Unsupported file type: .', ext) END AS error
    FROM manifest m LEFT JOIN direct ON m.fmt = direct.src_fmt LEFT JOIN chained ON m.fmt = chained.src_fmt""",
)
def detect(spark, sf_dir):
    found = routing.detect_with(d.manifest(spark, sf_dir).select("path", "ext"), routing.catalog_report(spark))
    listed = F.transform("chained", lambda c: F.concat(c["format"], F.lit(":"), F.array_join(c["route"], ">")))
    return found.select(
        "path", F.array_join("direct", ",").alias("direct"), F.array_join(listed, ",").alias("chained"), "error"
    )


@query(
    "h5_blocked_pairs",
    f"""WITH RECURSIVE {d.MANIFEST_SQL}, {d.EDGES_SQL}, usable AS (SELECT * FROM edges WHERE cond = 'always'),
    {d.routes_sql("usable", 22)},
    wanted AS (SELECT fmt, target_fmt FROM manifest UNION ALL SELECT fmt, 'toml' FROM manifest)
    SELECT fmt, target_fmt, count(*) AS items, fmt = 'csv' AND target_fmt = 'toml' AS blocked,
      CASE WHEN fmt = 'csv' AND target_fmt = 'toml' THEN any_value(array_to_string(route, '>')) END AS excluded_route
    FROM wanted LEFT JOIN routes ON fmt = src_fmt AND target_fmt = dst_fmt GROUP BY fmt, target_fmt""",
)
def blocked_pairs(spark, sf_dir):
    """Requests per pair of formats, and the route the exclusion list takes from them. Each file is asked for in its target and in TOML."""
    asked = F.explode(F.array("target", F.lit("toml"))).alias("target")
    items = d.manifest(spark, sf_dir).select("ext", asked).groupBy("ext", "target").agg(F.count(F.lit(1)).alias("n"))
    asked = (
        items.select(paths.normalize_ext(F.col("ext")).alias("src_fmt"), paths.normalize_ext(F.col("target")).alias("dst_fmt"), "n")
        .groupBy("src_fmt", "dst_fmt")
        .agg(F.sum("n").alias("items"))
    )
    offered = routing.catalog_routes(spark).select("src_fmt", "dst_fmt", F.lit(True).alias("kept"))
    every = routing.catalog_all_routes(spark).select("src_fmt", "dst_fmt", F.array_join("route", ">").alias("route"))
    pair = ["src_fmt", "dst_fmt"]
    flagged = asked.join(every, pair, "left").join(offered, pair, "left")
    blocked = F.col("route").isNotNull() & F.col("kept").isNull()
    return flagged.select(
        F.col("src_fmt").alias("fmt"), F.col("dst_fmt").alias("target_fmt"), "items", blocked.alias("blocked"),
        F.when(blocked, F.col("route")).alias("excluded_route"),
    )
