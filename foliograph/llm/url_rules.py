"""URL filters: curated rules first, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from foliograph.llm.common import small, written
from foliograph.session import settle

# Fixed values: (host, path, verdict). A rule fits its host and all subdomains.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
LEAST = 15  # labelled URLs a mined rule holds for, whatever the size of the tables
CONFIDENCE = 0.9
MARK = "\x00"  # begins a label among the tokens; never begins a token of a URL


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; NULL if none does.

    One ordered expression, longest rule first, the first in code-point order among equals.
    """
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for host, path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = rule.when(fits, F.lit(host + path)), verdict.when(fits, F.lit(says))
    return rule, verdict


def tokens() -> Column:
    """The tokens of columns host and path: labels of the host by place, their parts, folders and the ending of the path."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    folders = F.filter(F.split("path", "/"), lambda x: x != "")
    none = F.array().cast("array<string>")
    top = F.when(F.size(labels) > 0, F.array(F.element_at(labels, -1))).otherwise(none)
    ending = F.filter(F.array(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)), lambda x: x != "")
    inner = F.when(F.size(folders) > 1, F.slice(folders, F.lit(1), F.size(folders) - 1)).otherwise(none)
    kinds = {"part:": parts, "top:": top, "folder:": F.when(F.col("path").endswith("/"), folders).otherwise(inner), "ending:": ending}
    named = F.concat(*[F.transform(values, lambda x, kind=kind: F.concat(F.lit(kind), x)) for kind, values in kinds.items()])
    return F.array_distinct(named)


def mine(labelled: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, n) of the rules mined from ``labelled`` (tokens, verdict).

    FP-growth counts the combinations of tokens and verdicts. A combination with a verdict is a rule if its share of the
    combination without it reaches ``confidence``. A rule is dropped if one of fewer tokens, all among its own,
    says the same with no less confidence. Rules have any number of tokens. Before mining, tokens that alone are rules without exception leave
    the rows: whatever they are combined with would be dropped.
    """
    rows, n = written(labelled.where("verdict is not null").select("tokens", "verdict"))
    if not n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, n long")
    told = rows.select("verdict", F.explode("tokens").alias("x")).groupBy("x").agg(
        F.min("verdict").alias("verdict"), F.max("verdict").alias("other"), F.count(F.lit(1)).alias("n")
    )
    sure = settle(told.where((F.col("verdict") == F.col("other")) & (F.col("n") >= least)).select("x", "verdict", "n"))
    listed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "verdict", F.explode_outer("tokens").alias("x"))
    left = listed.join(sure.select("x"), "x", "left_anti").groupBy("row", "verdict").agg(F.collect_list("x").alias("tokens"))
    items = settle(left.select(F.array_union("tokens", F.array(F.concat(F.lit(MARK), F.col("verdict")))).alias("items")))
    # a share a little lower than the count, so that rounding loses no rule; the count is applied below
    share = min(1.0, max(least - 0.5, 0.5) / max(1, items.count()))
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items).freqItemsets
    split = sets.select(
        F.array_sort(F.filter("items", lambda x: ~x.startswith(MARK))).alias("tokens"),
        F.filter("items", lambda x: x.startswith(MARK)).alias("mark"),
        F.col("freq").alias("n"),
    ).where((F.size("tokens") >= 1) & (F.col("n") >= least))
    counted = settle(split)
    alone = counted.where(F.size("mark") == 0).select("tokens", F.col("n").alias("all"))
    marked = counted.where(F.size("mark") == 1).select("tokens", F.substring(F.element_at("mark", 1), 2, 1 << 20).alias("verdict"), "n")
    combined = marked.join(alone, "tokens").withColumn("confidence", F.col("n") / F.col("all")).where(F.col("confidence") >= confidence)
    single = sure.select(F.array("x").alias("tokens"), "verdict", F.lit(1.0).alias("confidence"), "n")
    rules = settle(combined.select("tokens", "verdict", "confidence", "n").unionByName(single))
    wider = rules.select(F.col("tokens").alias("t"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.explode("tokens").alias("x"))
    narrow = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("x"))
    covered = (F.size("t") < F.size("tokens")) & (F.size(F.array_except("t", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    redundant = narrow.join(wider, (narrow["x"] == wider["x"]) & (F.col("verdict") == F.col("v")) & covered).select("tokens", "verdict").distinct()
    return rules.join(redundant, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "n")


def best_match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict): for each distinct token set of ``urls`` the surest mined rule that fits; of equally sure ones the longest, then the
    last by its tokens and verdict.

    Rules stand in an inverted index under the rarest of their tokens; a token set looks only under its own tokens.
    """
    sets = settle(urls.select("tokens").distinct())
    each = sets.select("tokens", F.explode("tokens").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    filed = rules.select(F.col("tokens").alias("wanted"), "verdict", "confidence", F.explode("tokens").alias("x"))
    rarest = filed.join(often, "x").groupBy("wanted", "verdict", "confidence").agg(F.min_by("x", F.struct("often", "x")).alias("x"))
    index, n = written(rarest)
    fits = each.join(small(index, n), "x").where(F.size(F.array_except("wanted", "tokens")) == 0)
    rank = F.struct("confidence", F.size("wanted").alias("s"), "wanted", "verdict")
    # written, so that the join below shuffles both sides and a token set with very many URLs is split
    return settle(fits.groupBy("tokens").agg(F.max(rank).alias("best")).select("tokens", F.col("best.verdict").alias("mined")))


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: list[tuple[str, str, str]] = RULES,
    default: str = "allow",
    **options,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    What a curated rule decides teaches the mined rules, and so does ``labelled`` (url, verdict) elsewhere. A URL that no
    curated rule fits takes the verdict of the surest mined rule, or ``default`` if none fits. NULL and URLs without
    ``://`` have empty host and path and the default. Repeated rows are judged alike; NULL ids stay NULL. Other columns
    are ignored. An empty table gives an empty table.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = curated(rules)
    known = settle(parsed.withColumn("rule", rule).withColumn("said", verdict).withColumn("tokens", tokens()))
    taught = known.select("tokens", F.col("said").alias("verdict"))
    if labelled is not None:
        named = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
        taught = taught.unionByName(named.where(verdict.isNull()).select(tokens().alias("tokens"), "verdict"))
    mined = best_match(known.where("said is null"), mine(taught, **options))
    open_ = known.where("said is null").join(mined, "tokens", "left")
    kept = ["page_id", "host", "path", "rule"]
    decided = known.where("said is not null").select(*kept, F.col("said").alias("verdict"))
    return decided.unionByName(open_.select(*kept, F.coalesce("mined", F.lit(default)).alias("verdict")))
