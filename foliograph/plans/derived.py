"""Inputs derived from the analytics tables: manifests, log lines, documents, object pools.

Each has a Spark form and, below, the text of the same rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliograph import catalog
from foliograph.functions.paths import path_ext
from foliograph.plans.registry import table

# --- fixed values: file name endings dealt out over the manifest ---
ENDINGS = [
    ".png", ".jpg", ".webp", ".bmp", ".tiff", ".gif", ".avif", ".heic",
    ".mp4", ".mov", ".mkv", ".webm", ".avi",
    ".mp3", ".aac", ".flac", ".ogg", ".wav", ".opus", ".m4a",
    ".json", ".yaml", ".toml", ".csv",
    ".md", ".txt", ".tex", ".typst", ".epub", ".mobi", ".pdf",
    ".jpeg", ".yml", ".tif", ".markdown", ".latex", ".heif",
    ".PNG", ".JPEG", ".Pdf",
    ".xyz", "", ".tar.gz",
]
# --- fixed values: requested targets dealt out over the items ---
TARGETS = [
    "png", "jpg", "webp", "bmp", "tiff", "gif", "avif", "heic",
    "mp4", "mov", "mkv", "webm", "avi",
    "mp3", "aac", "flac", "ogg", "wav", "opus", "m4a",
    "json", "yaml", "toml", "csv",
    "md", "txt", "tex", "typst", "epub", "mobi", "pdf", "html",
    "jpeg", "yml", "markdown", "latex", "zip",
]
# --- fixed values: spellings of a line break tag dealt out over pages ---
BREAKS = ["<br>", "<br/>", "<br />", "<BR/>", "<BR />", "<BR>", "<Br>"]


def dealt(values: list[str], number: Column) -> Column:
    """Element number mod length of a fixed list."""
    return F.element_at(F.lit(values), (number % len(values) + 1).cast("int"))


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, ord, path, ext: one file per distinct line item key."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*keys).distinct()
    path = F.concat(
        F.lit("/in/b"), "l_orderkey", F.lit("/s"), "l_suppkey", F.lit("/f"), "l_linenumber", F.lit("_"),
        "l_partkey", dealt(ENDINGS, F.col("l_partkey")),
    )
    return rows.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").cast("bigint").alias("ord"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(dealt(TARGETS, F.col("l_suppkey")), F.lit("")).alias("target"),
    ).withColumn("ext", path_ext(F.col("path")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with missing and empty extensions and targets in it."""
    turn = (F.col("batch_id") + F.col("ord")) % 13
    return manifest(spark, sf_dir).withColumns(
        {
            "target": F.when(turn == 1, "").when(turn != 0, F.col("target")),
            "ext": F.when(turn == 3, "").when(turn != 2, F.col("ext")),
        }
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, line: every event as a log line of its user's job."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return log_lines_of(events)


def log_lines_of(events: DataFrame, *keep: str) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    micros = F.round(F.col("value") * 1000000).cast("bigint")
    word = dealt([w for w, _ in catalog.STAGES], n)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    line = (
        F.when(kind == "click", F.concat(F.lit("out_time_us="), text(micros)))
        .when(kind == "view", F.concat(F.lit("frame="), text(n)))
        .when(kind == "signup", F.concat(F.lit("Processing: "), text(n % 101), F.lit("%|####|")))
        .when(kind == "purchase", F.concat(F.lit("Now "), F.when(n % 3 == 0, F.upper(word)).otherwise(word), F.lit(" ...")))
        .when(n % 4 == 0, F.concat(F.lit("Error "), text(n), F.lit(": Pandoc not found on PATH")))
        .when(n % 4 == 1, F.lit("   "))
        .when(
            n % 4 == 2,
            F.concat(F.lit("  Duration: 00:"), two(n % 10), F.lit(":"), two(n % 60), F.lit(".50, start: 0.0")),
        )
        .otherwise(F.concat(F.lit("ffmpeg not found ("), text(n), F.lit(")")))
    )
    return events.select(F.col("user_id").alias("job_id"), n.alias("seq"), line.alias("line"), *keep)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, duration: unknown for every seventh job."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    return users.withColumn("duration", F.when(F.col("job_id") % 7 != 0, (F.col("job_id") % 200 + 60).cast("double")))


def trim_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, start, end, duration: bounds as time strings, some open, some wrong."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    n = F.col("user_id")
    start = (
        F.when(n % 6 == 0, "").when(n % 6 == 1, F.concat(text(n % 50), F.lit(":00:00")))
        .when(n % 6 == 2, text(n * 1000)).when(n % 6 == 3, "soon")
        .otherwise(F.concat(text(n % 90), F.lit(":30")))
    )
    end = (
        F.when(n % 5 == 0, " ").when(n % 5 == 1, "100:00:00.5").when(n % 5 == 2, F.concat(text(n * 7), F.lit(":90")))
        .otherwise("200000")
    )
    return users.select(
        "user_id", start.alias("start"), end.alias("end"), F.when(n % 4 != 0, (n * 5000).cast("double")).alias("duration")
    )


def fenced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: paragraphs set apart by blank lines, code fences in every third document."""
    n = F.col("doc_id")
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    fenced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n```\n"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.when(n % 3 == 0, fenced).otherwise(paragraphs).alias("text")
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object pool: each turn of a conversation is a document whose words are objects.

    Ids start over in every document and have gaps. Word 0 is the root, odd words are pages
    or inner nodes below it, references point at the word before and at a missing object.
    """
    words = F.posexplode(F.split(F.col("text"), " ")).alias("at", "word")
    opened = table(spark, sf_dir, "conversations").select("conv_id", "turn", words)
    at = F.col("at").cast("bigint")
    length = F.length("word")
    return opened.select(
        F.col("conv_id").alias("merge_id"),
        F.col("turn").alias("doc_seq"),
        (at * 3 + 1).alias("obj_id"),
        F.when(at > 0, F.floor(at / 2) * 3 + 1).alias("parent_id"),
        F.when(at % 2 == 1, at).alias("page_no"),
        F.when(at > 0, F.array((at - 1) * 3 + 1, F.lit(2).cast("bigint"))).alias("refs"),
        F.when(length % 4 == 0, F.concat(F.lit("box"), "at")).alias("MediaBox"),
        F.when(length % 7 == 0, F.concat(F.lit("res"), "at")).alias("Resources"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, parent_id and four attributes: region, nation, customer, order as a tree."""
    none = F.lit(None).cast("string")

    def level(df: DataFrame, mark: str, key: str, up: Column, **attrs: Column) -> DataFrame:
        columns = [attrs.get(k, none).alias(k) for k in catalog.INHERITED_KEYS]
        return df.select(F.concat(F.lit(mark), key).alias("node_id"), up.alias("parent_id"), *columns)

    def above(mark: str, key: str) -> Column:
        return F.concat(F.lit(mark), key)

    nation, customer, orders = F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey")
    return (
        level(table(spark, sf_dir, "region"), "r", "r_regionkey", none, MediaBox=F.col("r_name"))
        .unionByName(
            level(table(spark, sf_dir, "nation"), "n", "n_nationkey", above("r", "n_regionkey"),
                  Resources=F.when(nation % 2 == 0, F.col("n_name")))
        )
        .unionByName(
            level(table(spark, sf_dir, "customer"), "c", "c_custkey", above("n", "c_nationkey"),
                  Rotate=F.when(customer % 3 == 0, F.col("c_mktsegment")),
                  MediaBox=F.when(customer % 5 == 0, F.col("c_name")))
        )
        .unionByName(
            level(table(spark, sf_dir, "orders"), "o", "o_orderkey", above("c", "o_custkey"),
                  CropBox=F.when(orders % 4 == 0, F.col("o_orderpriority")))
        )
    )


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation with a cost from the number of line items between them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    name = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))
    return pairs.select(
        name("c_nationkey").alias("src_fmt"), name("s_nationkey").alias("dst_fmt"), (F.col("n") % 17 + 1).alias("cost")
    ).filter(F.col("src_fmt") != F.col("dst_fmt"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seq, line: every turn of a conversation as an NDJSON reply line, some broken."""
    turns = table(spark, sf_dir, "conversations")
    return token_lines_of(turns)


def token_lines_of(turns: DataFrame) -> DataFrame:
    reply = F.to_json(F.struct(F.col("text").alias("response"), (F.col("turn") >= 3).alias("done")))
    line = F.when(F.col("turn") % 5 == 4, F.concat(reply, F.lit(" x"))).otherwise(reply)
    return turns.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), line.alias("line"))


# ---- the same rules in SQL ----


def list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


MANIFEST_SQL = f"""
raw_manifest AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
),
manifest AS (
  SELECT l_orderkey AS batch_id, CAST(l_linenumber AS BIGINT) AS ord,
         concat('/in/b', l_orderkey, '/s', l_suppkey, '/f', l_linenumber, '_', l_partkey, ending) AS path,
         concat('f', l_linenumber, '_', l_partkey) AS name,
         concat('/in/b', l_orderkey, '/s', l_suppkey, '/') AS folder,
         ending, target,
         CASE WHEN ending = '.tar.gz' THEN 'gz' ELSE lower(replace(ending, '.', '')) END AS ext,
         CASE lower(ending) WHEN '.jpeg' THEN 'jpg' WHEN '.yml' THEN 'yaml' WHEN '.tif' THEN 'tiff'
              WHEN '.markdown' THEN 'md' WHEN '.latex' THEN 'tex' WHEN '.heif' THEN 'heic'
              WHEN '.tar.gz' THEN 'gz' ELSE lower(replace(ending, '.', '')) END AS fmt,
         CASE target WHEN 'jpeg' THEN 'jpg' WHEN 'yml' THEN 'yaml' WHEN 'markdown' THEN 'md'
              WHEN 'latex' THEN 'tex' ELSE target END AS target_fmt
  FROM (SELECT *, {list_sql(ENDINGS)}[1 + l_partkey % {len(ENDINGS)}] AS ending,
               {list_sql(TARGETS)}[1 + l_suppkey % {len(TARGETS)}] AS target FROM raw_manifest)
)"""

# requests as they come: some without extension or target, some with empty ones
ASKED_SQL = """
asked AS (SELECT * REPLACE (
    CASE (batch_id + ord) % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE target END AS target,
    CASE (batch_id + ord) % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE target_fmt END AS target_fmt,
    CASE (batch_id + ord) % 13 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE ext END AS ext,
    CASE (batch_id + ord) % 13 WHEN 2 THEN NULL WHEN 3 THEN '' ELSE fmt END AS fmt) FROM manifest)"""

LOG_SQL = f"""
log_lines AS (
  SELECT user_id AS job_id, event_id AS seq, event_type AS kind, value, CASE
    WHEN event_type = 'click' THEN concat('out_time_us=', CAST(round(value * 1000000) AS BIGINT))
    WHEN event_type = 'view' THEN concat('frame=', event_id)
    WHEN event_type = 'signup' THEN concat('Processing: ', event_id % 101, '%|####|')
    WHEN event_type = 'purchase' THEN concat('Now ',
      CASE WHEN event_id % 3 = 0 THEN upper(word) ELSE word END, ' ...')
    WHEN event_id % 4 = 0 THEN concat('Error ', event_id, ': Pandoc not found on PATH')
    WHEN event_id % 4 = 1 THEN '   '
    WHEN event_id % 4 = 2 THEN concat('  Duration: 00:', lpad(CAST(event_id % 10 AS VARCHAR), 2, '0'), ':',
      lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'), '.50, start: 0.0')
    ELSE concat('ffmpeg not found (', event_id, ')') END AS line,
    stage
  FROM (SELECT *, {list_sql([w for w, _ in catalog.STAGES])}[1 + event_id % {len(catalog.STAGES)}] AS word,
               {[p for _, p in catalog.STAGES]}[1 + event_id % {len(catalog.STAGES)}] AS stage FROM events)
),
durations AS (
  SELECT DISTINCT user_id AS job_id,
         CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 200 + 60 AS DOUBLE) END AS duration
  FROM events
)"""

SPECS_SQL = """
specs AS (
  SELECT DISTINCT user_id,
    CASE WHEN user_id % 6 = 0 THEN '' WHEN user_id % 6 = 1 THEN concat(user_id % 50, ':00:00')
         WHEN user_id % 6 = 2 THEN CAST(user_id * 1000 AS VARCHAR) WHEN user_id % 6 = 3 THEN 'soon'
         ELSE concat(user_id % 90, ':30') END AS start,
    CASE WHEN user_id % 5 = 0 THEN ' ' WHEN user_id % 5 = 1 THEN '100:00:00.5'
         WHEN user_id % 5 = 2 THEN concat(user_id * 7, ':90') ELSE '200000' END AS "end",
    CAST(CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN user_id % 50 * 3600 WHEN 2 THEN user_id * 1000
         WHEN 3 THEN NULL ELSE user_id % 90 * 60 + 30 END AS DOUBLE) AS start_s,
    CAST(CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 360000.5 WHEN 2 THEN user_id * 420 + 90
         ELSE 200000 END AS DOUBLE) AS end_s,
    CASE WHEN user_id % 4 <> 0 THEN CAST(user_id * 5000 AS DOUBLE) END AS duration
  FROM events
),
planned AS (
  SELECT *, CASE WHEN start = 'soon' THEN 'Invalid time: soon'
                 WHEN end_s <= start_s THEN 'End time must be after start time' END AS error
  FROM specs
)"""

DOCS_SQL = """
docs AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10), '```', chr(10)))
                      ELSE replace(text, chr(10), concat(chr(10), chr(10))) END AS text
  FROM documents
)"""

OBJECTS_SQL = """
opened AS (
  SELECT conv_id AS merge_id, turn AS doc_seq, words[n + 1] AS word, n AS place
  FROM (SELECT conv_id, turn, string_split(text, ' ') AS words,
               unnest(generate_series(0, len(string_split(text, ' ')) - 1)) AS n FROM conversations)
),
objects AS (
  SELECT merge_id, doc_seq, place * 3 + 1 AS obj_id,
         CASE WHEN place > 0 THEN (place // 2) * 3 + 1 END AS parent_id,
         CASE WHEN place % 2 = 1 THEN place END AS page_no,
         CASE WHEN place > 0 THEN (place - 1) * 3 + 1 END AS ref,
         CASE WHEN length(word) % 4 = 0 THEN concat('box', place) END AS "MediaBox",
         CASE WHEN length(word) % 7 = 0 THEN concat('res', place) END AS "Resources",
         row_number() OVER (PARTITION BY merge_id ORDER BY doc_seq, place) AS new_id
  FROM opened
)"""

EDGES_SQL = f"edges AS ({catalog.values_sql(catalog.edge_rows(), 'ord, src_fmt, dst_fmt, cost, cond')})"
HANDLERS_SQL = f"handlers AS ({catalog.values_sql(catalog.handler_rows(), 'src_fmt, dst_fmt, hop_kind')})"


def routes_sql(edges: str, bound: int, blocked: str = "FALSE") -> str:
    """CTEs that give ``routes`` by listing every cost up to ``bound`` each node is reached at."""
    return f"""
walk AS (
  SELECT DISTINCT src_fmt, src_fmt AS node, CAST(0 AS BIGINT) AS cost FROM {edges}
  UNION
  SELECT w.src_fmt, e.dst_fmt, w.cost + e.cost FROM walk w JOIN {edges} e ON w.node = e.src_fmt
  WHERE w.cost + e.cost <= {bound}
),
dist AS (SELECT src_fmt, node, min(cost) AS cost FROM walk GROUP BY ALL),
pred AS (
  SELECT src_fmt, node, prev, cost FROM (
    SELECT v.src_fmt, v.node, v.cost, u.node AS prev,
           row_number() OVER (PARTITION BY v.src_fmt, v.node ORDER BY u.cost, u.node DESC) AS rn
    FROM dist v JOIN dist u ON u.src_fmt = v.src_fmt
    JOIN {edges} e ON e.src_fmt = u.node AND e.dst_fmt = v.node AND u.cost + e.cost = v.cost
    WHERE v.node <> v.src_fmt)
  WHERE rn = 1
),
built AS (
  SELECT src_fmt, node, cost, [node] AS route, 0 AS hops FROM dist WHERE node = src_fmt
  UNION ALL
  SELECT p.src_fmt, p.node, p.cost, list_append(b.route, p.node), b.hops + 1
  FROM built b JOIN pred p ON p.src_fmt = b.src_fmt AND p.prev = b.node
),
routes AS (
  SELECT src_fmt, node AS dst_fmt, CAST(cost AS BIGINT) AS cost, hops, route FROM built
  WHERE hops BETWEEN 1 AND {catalog.MAX_HOPS} AND NOT ({blocked})
)"""


CATALOG_ROUTES_SQL = (
    EDGES_SQL
    + ", usable AS (SELECT * FROM edges WHERE cond = 'always'),"
    + routes_sql("usable", 22, "src_fmt = 'csv' AND node = 'toml'")
)
