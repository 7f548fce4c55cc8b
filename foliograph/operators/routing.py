"""Conversion planning over file manifests: targets, routes, steps.

The graph side (edges, routes, handlers) is a dimension; the manifest side is the data.
Work on the manifest is a projection plus lookups keyed by format, so whatever can be
computed per format is computed on the dimension and joined once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliograph import catalog
from foliograph.functions.paths import normalize_ext, output_path
from foliograph.session import settle, settle_counting, small_side


DELTAS = 6  # rounds whose pairs are read one beside the other


def usable_edges(edges: DataFrame, caps: list[str]) -> DataFrame:
    """Edges whose capability is present."""
    return edges.filter(F.col("cond").isin(caps))


def _format_of(ext: Column) -> Column:
    """Never NULL: else every join on it would first filter on the whole expression behind
    the extension, below whatever shuffle and next to the scan."""
    return F.coalesce(normalize_ext(ext), F.lit(""))


def _by_format(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("fmt", _format_of(F.col("ext")))


def direct_targets(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per file and format it converts to in one hop."""
    targets = edges.select(F.col("src_fmt").alias("fmt"), F.col("dst_fmt").alias("target"))
    return _by_format(manifest).join(small_side(targets), "fmt")


def unsupported(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """Files no edge starts from, with the reason."""
    sources = edges.select(F.col("src_fmt").alias("fmt")).distinct()
    lost = _by_format(manifest).join(small_side(sources), "fmt", "left_anti")
    return lost.withColumn("error", catalog.error("unsupported_type", F.col("ext")))


def min_cost_paths(
    edges: DataFrame,
    max_hops: int = catalog.MAX_HOPS,
    blocked: DataFrame | None = None,
    sources: list[str] | None = None,
) -> DataFrame:
    """Cheapest route between every two formats: src_fmt, dst_fmt, cost, hops, route.

    With ``sources`` only routes that start there are worked out, so the table grows with
    the number of sources and not with that of all pairs.
    Costs are relaxed to a fixpoint first and only then routes of more than ``max_hops``
    are dropped. Among equally cheap routes the one whose last but one node is nearer
    to the source wins, then the one with the larger name.
    Each round joins only the pairs that got cheaper in the round before and writes only those it makes cheaper;
    what is known is their union, put together every few rounds.
    """
    step, wrong = settle_counting(
        edges.filter(F.col("src_fmt") != F.col("dst_fmt"))
        .groupBy("src_fmt", "dst_fmt")
        .agg(F.min("cost").cast("bigint").alias("cost")),
        F.col("cost") < 1,
    )
    if wrong:
        raise ValueError("edge costs must be positive")
    hop = step.select(F.col("src_fmt").alias("via"), F.col("dst_fmt").alias("next"), F.col("cost").alias("price"))
    hop = small_side(hop)

    first = step if sources is None else step.filter(F.col("src_fmt").isin(sources))
    pair = ["src_fmt", "dst_fmt"]
    found, fresh = [first], first
    while True:
        best = reduce(DataFrame.unionByName, found).groupBy(*pair).agg(F.min("cost").alias("cost"))
        if len(found) > DELTAS:
            best = settle(best)
            found = [best]
        longer = (
            fresh.join(hop, F.col("dst_fmt") == F.col("via"))
            .filter(F.col("src_fmt") != F.col("next"))
            .groupBy("src_fmt", F.col("next").alias("dst_fmt"))
            .agg(F.min(F.col("cost") + F.col("price")).alias("cost"))
        )
        known = best.withColumnRenamed("cost", "old")
        cheaper = longer.join(known, pair, "left").filter(F.col("old").isNull() | (F.col("cost") < F.col("old")))
        fresh, improved = settle_counting(cheaper.select(*pair, "cost"), F.lit(True))
        if not improved:
            break
        found.append(fresh)
    best = settle(best)

    reached = best.select("src_fmt", F.col("dst_fmt").alias("via"), F.col("cost").alias("to_via"))
    start = first.select("src_fmt", F.col("src_fmt").alias("via"), F.lit(0).cast("bigint").alias("to_via")).distinct()
    last_step = settle(
        reached.unionByName(start)
        .join(hop, "via")
        .select("src_fmt", "via", "to_via", F.col("next").alias("dst_fmt"), (F.col("to_via") + F.col("price")).alias("cost"))
        .join(best, ["src_fmt", "dst_fmt", "cost"])
        .groupBy("src_fmt", "dst_fmt", "cost")
        .agg(F.max(F.struct((-F.col("to_via")).alias("near"), "via"))["via"].alias("prev"))
    )

    back = last_step.select(F.col("src_fmt").alias("b_src"), F.col("dst_fmt").alias("b_dst"), F.col("prev").alias("b_prev"))
    back = small_side(back)
    walk = last_step.select("src_fmt", "dst_fmt", "cost", F.col("prev").alias("at"), F.array("prev", "dst_fmt").alias("route"))
    for _ in range(max_hops - 1):
        seen = (F.col("src_fmt") == F.col("b_src")) & (F.col("at") == F.col("b_dst"))
        walk = walk.join(back, seen, "left").select(
            "src_fmt",
            "dst_fmt",
            "cost",
            F.coalesce("b_prev", "at").alias("at"),
            F.when(F.col("b_prev").isNull(), F.col("route"))
            .otherwise(F.concat(F.array("b_prev"), "route"))
            .alias("route"),
        )
    routes = walk.filter(F.col("at") == F.col("src_fmt")).select(
        "src_fmt", "dst_fmt", "cost", (F.size("route") - 1).alias("hops"), "route"
    )
    if blocked is not None:
        routes = drop_blocked(routes, blocked)
    return routes


def drop_blocked(routes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leave out pairs that must never be offered."""
    return routes.join(small_side(pairs.select("src_fmt", "dst_fmt")), ["src_fmt", "dst_fmt"], "left_anti")


_built: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, name: str, caps: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """Dimensions of the built-in graph, worked out once per application and kept as a local
    table. Their size is fixed: at most one row per pair of formats of the catalog."""
    key = (spark.sparkContext.applicationId, name, tuple(caps))
    if key not in _built:
        _built[key] = spark.createDataFrame(build().toArrow())
    return _built[key]


def catalog_all_routes(spark: SparkSession, caps: tuple[str, ...] = (catalog.ALWAYS,)) -> DataFrame:
    """The routes before the exclusion list."""
    edges = usable_edges(catalog.edges(spark), list(caps))
    return _once(spark, "all routes", caps, lambda: min_cost_paths(edges))


def catalog_routes(spark: SparkSession, caps: tuple[str, ...] = (catalog.ALWAYS,)) -> DataFrame:
    edges = usable_edges(catalog.edges(spark), list(caps))
    return _once(spark, "routes", caps, lambda: min_cost_paths(edges, blocked=catalog.blocked(spark)))


def catalog_steps(spark: SparkSession, caps: tuple[str, ...] = (catalog.ALWAYS,)) -> DataFrame:
    return _once(spark, "steps", caps, lambda: route_steps(catalog_routes(spark, caps), catalog.handlers(spark)))


def catalog_report(spark: SparkSession, caps: tuple[str, ...] = (catalog.ALWAYS,)) -> DataFrame:
    edges = usable_edges(catalog.edges(spark), list(caps))
    return _once(spark, "report", caps, lambda: format_report(edges, catalog_routes(spark, caps)))


def plan_routes(items: DataFrame, routes: DataFrame) -> DataFrame:
    """Route, hops and cost per item (ext, target), or the error that there is none."""
    table = routes.select(
        F.col("src_fmt").alias("fmt"), F.col("dst_fmt").alias("target_fmt"), "route", "hops", "cost"
    )
    keyed = _by_format(items).withColumn("target_fmt", _format_of(F.col("target")))
    planned = keyed.join(small_side(table), ["fmt", "target_fmt"], "left")
    return planned.withColumn(
        "error",
        F.when(
            F.col("route").isNull(),
            catalog.error("no_path", F.col("ext"), F.col("target")),
        ),
    )


def route_hops(pairs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Handler of each (src_fmt, dst_fmt) hop, or the error that none takes it."""
    found = pairs.join(small_side(handlers), ["src_fmt", "dst_fmt"], "left")
    return found.withColumn(
        "error",
        F.when(
            F.col("hop_kind").isNull(),
            catalog.error("no_handler", F.col("src_fmt"), F.col("dst_fmt")),
        ),
    )


def uncovered(edges: DataFrame, handlers: DataFrame) -> DataFrame:
    """Edges without a handler; empty for a consistent catalog."""
    return edges.join(small_side(handlers), ["src_fmt", "dst_fmt"], "left_anti")


def chained_targets(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of two or more hops to formats that are no direct target."""
    pairs = edges.select("src_fmt", "dst_fmt").distinct()
    far = routes.filter(F.col("hops") >= 2)
    return far.join(small_side(pairs), ["src_fmt", "dst_fmt"], "left_anti")


def order_targets(chained: DataFrame, keys: list[str]) -> DataFrame:
    """Chained targets of each key as one array: fewest hops first, then by name.

    Meant for the route side, where a group is at most the number of formats.
    """
    entry = F.struct("hops", F.col("dst_fmt").alias("format"), "route")
    return chained.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("chained"))


def format_report(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Per source format: direct targets in listing order and the ordered chained ones."""
    place = F.col("ord") if "ord" in edges.columns else F.lit(0).alias("ord")
    direct = edges.groupBy("src_fmt").agg(
        F.array_sort(F.collect_set(F.struct(place, "dst_fmt")))["dst_fmt"].alias("direct")
    )
    chained = order_targets(chained_targets(routes, edges), ["src_fmt"])
    nothing = F.array().cast("array<struct<hops:int,format:string,route:array<string>>>")
    return direct.join(chained, "src_fmt", "left").select(
        F.col("src_fmt").alias("fmt"), "direct", F.coalesce("chained", nothing).alias("chained")
    )


def detect(manifest: DataFrame, edges: DataFrame, routes: DataFrame) -> DataFrame:
    """Direct and chained targets per file, or why it is not supported."""
    return detect_with(manifest, settle(format_report(edges, routes)))


def detect_with(manifest: DataFrame, report: DataFrame) -> DataFrame:
    """The same for a report worked out before."""
    found = _by_format(manifest).join(small_side(report), "fmt", "left")
    return found.withColumn(
        "error",
        F.when(F.col("direct").isNull(), catalog.error("unsupported_type", F.col("ext"))),
    )


def common_targets(manifest: DataFrame, edges: DataFrame, min_files: int = 2) -> DataFrame:
    """Formats every supported file of a batch converts to directly.

    A batch boils down to its file count and its set of formats (bounded by the graph)
    before anything is multiplied; the count per target then needs no second shuffle,
    because the rows already are partitioned by batch.
    """
    targets = edges.select(F.col("src_fmt").alias("fmt"), F.col("dst_fmt").alias("target")).distinct()
    targets = small_side(targets)
    sources = small_side(edges.select(F.col("src_fmt").alias("fmt")).distinct())
    batches = (
        _by_format(manifest)
        .join(sources, "fmt", "left_semi")
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("files"), F.collect_set("fmt").alias("fmts"))
        .filter(F.col("files") >= min_files)
    )
    return (
        batches.select("batch_id", "files", F.size("fmts").alias("kinds"), F.explode("fmts").alias("fmt"))
        .join(targets, "fmt")
        .groupBy("batch_id", "target")
        .agg(F.count(F.lit(1)).alias("hits"), F.first("kinds").alias("kinds"), F.first("files").alias("files"))
        .filter(F.col("hits") == F.col("kinds"))
        .select("batch_id", "target", "files")
    )


def format_params(plan: DataFrame, params: DataFrame, fmt: Column, columns: list[str]) -> DataFrame:
    """Look up named parameters of a format; a format without an entry keeps NULLs.

    ``params`` may hold alternatives by capability: narrow it with ``by_capability`` first.
    """
    side = F.broadcast(params.select(F.col("fmt").alias("_fmt"), *columns))  # one row per format of the catalog
    return plan.join(side, fmt == F.col("_fmt"), "left").drop("_fmt")


def by_capability(params: DataFrame, caps: list[str]) -> DataFrame:
    """Of each format's alternatives the one of the first capability in ``caps`` that has one."""
    usable = params.withColumn("_place", F.array_position(F.lit(caps), F.col("cond"))).filter("_place > 0")
    rest = [c for c in params.columns if c not in ("fmt", "cond")]
    best = F.min_by(F.struct(*rest), F.col("_place")).alias("_best")
    return usable.groupBy("fmt").agg(best).select("fmt", *[F.col(f"_best.{c}").alias(c) for c in rest])


def format_names(plan: DataFrame, params: DataFrame, source: Column, target: Column) -> DataFrame:
    """``reader`` and ``writer`` names of a conversion; a format without an entry is its own name."""
    named = format_params(plan, params, source, ["reader"])
    named = format_params(named, params, target, ["writer"])
    return named.withColumn("reader", F.coalesce("reader", source)).withColumn("writer", F.coalesce("writer", target))


def route_steps(routes: DataFrame, handlers: DataFrame) -> DataFrame:
    """Routes with ``steps``: array of (pos, src_fmt, dst_fmt, hop_kind) in travel order."""
    hops = routes.select(
        F.col("src_fmt").alias("r_src"), F.col("dst_fmt").alias("r_dst"), F.posexplode(
            F.arrays_zip(
                F.slice("route", F.lit(1), F.size("route") - 1).alias("src_fmt"),
                F.slice("route", F.lit(2), F.size("route") - 1).alias("dst_fmt"),
            )
        ).alias("pos", "hop")
    ).select("r_src", "r_dst", "pos", "hop.src_fmt", "hop.dst_fmt")
    steps = (
        route_hops(hops, handlers)
        .groupBy(F.col("r_src").alias("src_fmt"), F.col("r_dst").alias("dst_fmt"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "src_fmt", "dst_fmt", "hop_kind"))).alias("steps"))
    )
    return routes.join(steps, ["src_fmt", "dst_fmt"])


def expand_plan(items: DataFrame, steps: DataFrame, temp_dir: str, out_dir: Column | str | None = None) -> DataFrame:
    """One row per item and hop. Only the last hop writes to the user's folder.

    ``steps`` are routes with their handlers (``route_steps``), so the items meet one lookup
    and one explode.
    """
    table = steps.select(
        F.col("src_fmt").alias("fmt"), F.col("dst_fmt").alias("target_fmt"), "steps"
    )
    keyed = _by_format(items).withColumn("target_fmt", _format_of(F.col("target")))
    planned = keyed.join(small_side(table), ["fmt", "target_fmt"])
    total = F.size("steps")
    opened = planned.select(
        *[c for c in planned.columns if c != "steps"], total.alias("total"), F.explode("steps").alias("hop")
    )
    is_last = F.col("hop.pos") == F.col("total") - 1
    passed = output_path(F.col("path"), F.col("hop.src_fmt"), temp_dir)
    return opened.select(
        *[c for c in opened.columns if c not in ("hop", "total")],
        F.col("hop.pos").alias("step"),
        F.col("hop.src_fmt").alias("src_fmt"),
        F.col("hop.dst_fmt").alias("dst_fmt"),
        F.col("hop.hop_kind").alias("hop_kind"),
        F.when(F.col("hop.pos") == 0, F.col("path")).otherwise(passed).alias("in_path"),
        F.when(is_last, output_path(F.col("path"), F.col("hop.dst_fmt"), out_dir))
        .otherwise(output_path(F.col("path"), F.col("hop.dst_fmt"), temp_dir))
        .alias("out_path"),
        is_last.alias("is_last"),
        (F.col("hop.pos") / F.col("total") * 100.0).alias("percent"),
    )


def hop_progress(plan: DataFrame, key: str = "path") -> DataFrame:
    """Progress events of an expanded plan: one as each hop starts and 100 after the last."""
    reports = F.when(F.col("is_last"), F.array("percent", F.lit(100.0))).otherwise(F.array("percent"))
    opened = plan.select(key, "step", F.posexplode(reports).alias("after", "percent"))
    return opened.select(key, (F.col("step") + F.col("after")).alias("seq"), "percent")
