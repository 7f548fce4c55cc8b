"""Queries on JSON, CSV and configuration documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foliograph.functions.documents import csv_line, is_json
from foliograph.operators import batch, records
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table
from foliograph.session import scratch_path, settle
from foliograph.sources import configs, files
from foliograph.streaming import monitors

GROUP_FILES = 200_000  # files that are listed and read together


@query(
    "a2_text_documents",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN md5(concat(text, chr(10))) END AS text_md5, doc_id % 10 = 0 AS failed
    FROM documents""",
)
def text_documents(spark, sf_dir):
    """Documents written as one text file each, every tenth with bytes that are no UTF-8, and read back whole."""
    folder = scratch_path(spark, "texts")
    broken = F.when(F.col("doc_id") % 10 == 0, F.lit(b"\xff\xfe").cast("string")).otherwise(F.lit(""))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), broken).alias("text"))
    # the list of a group's files is what the driver holds at a time
    named = files.write_texts(texts, "doc_id", "text", folder, groups=1 + texts.count() // GROUP_FILES)
    told = []
    for group in files.folders(spark, folder):
        read = files.text_documents(spark, group, "*.txt")
        number = files.file_number(F.col("path")).alias("file_no")
        told.append(settle(read.select(number, F.md5("content").alias("text_md5"), F.col("error").isNotNull().alias("failed"))))
    return named.join(reduce(DataFrame.unionByName, told), "file_no").select("doc_id", "text_md5", "failed")


@query(
    "a3_csv_records",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(text) AS text_md5, NULL AS error FROM documents
    UNION ALL SELECT NULL, NULL, NULL, NULL, concat('CSV rows whose fields do not match the header: ', count(*)) FROM labels HAVING count(*) > 0""",
)
def csv_records(spark, sf_dir):
    """Documents through the CSV sink and back, with quotes, commas and line breaks inside texts, beside a file of ragged rows."""
    columns = ["doc_id", "lang", "text", "source"]
    folder = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").select(*columns), f"{folder}/good")
    rows = table(spark, sf_dir, "labels").select(F.concat_ws(",", "doc_id", F.coalesce("quality", F.lit(0))).alias("value"), F.lit(1).alias("at"))
    top = rows.limit(1).select(F.lit(",".join(columns)).alias("value"), F.lit(0).alias("at"))
    # one file, its header first
    top.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{folder}/ragged")
    back = files.split_csv_records(spark, f"{folder}/*", columns)
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), "error")


VALIDITY_SQL = """
texts AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat(props, ' x') WHEN 1 THEN replace(props, '}', '')
  WHEN 2 THEN concat('[', props, ', 2]') WHEN 3 THEN concat(props, ']') WHEN 4 THEN '' ELSE props END AS text FROM events)"""


def _texts(spark, sf_dir):
    n, props = F.col("event_id"), F.col("props")
    text = (
        F.when(n % 7 == 0, F.concat(props, F.lit(" x"))).when(n % 7 == 1, F.replace(props, F.lit("}"), F.lit("")))
        .when(n % 7 == 2, F.concat(F.lit("["), props, F.lit(", 2]"))).when(n % 7 == 3, F.concat(props, F.lit("]")))
        .when(n % 7 == 4, F.lit("")).otherwise(props)
    )
    return table(spark, sf_dir, "events", "event_id", "props").select(n, text.alias("text"))


@query("i0_is_json", f"WITH {VALIDITY_SQL} SELECT event_id, json_valid(text) AS valid FROM texts")
def json_validity(spark, sf_dir):
    return _texts(spark, sf_dir).select("event_id", is_json(F.col("text")).alias("valid"))


@query(
    "a4_json_documents",
    f"""WITH {VALIDITY_SQL} SELECT event_id, CASE WHEN event_id % 7 >= 5 THEN CAST(text->>'$.k' AS INTEGER) END AS k,
      CASE WHEN json_valid(text) THEN NULL ELSE 'Invalid JSON' END AS error FROM texts""",
)
def json_documents(spark, sf_dir):
    read = files.read_json_documents(_texts(spark, sf_dir), "text")
    return read.select("event_id", F.try_variant_get("value", "$.k", "int").alias("k"), "error")


@query(
    "a5_decode_config",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS size,
      p_partkey % 11 = 0 AS failed FROM part""",
)
def decode_config(spark, sf_dir):
    n = F.col("p_partkey")
    toml = F.concat(F.lit('[part]\nname = "'), "p_name", F.lit('"\nsize = '), "p_size", F.lit("\n"))
    yaml = F.concat(F.lit("part:\n  name: "), "p_name", F.lit("\n  size: "), "p_size", F.lit("\n"))
    broken = F.when(n % 11 == 0, F.lit("= [\n")).otherwise(F.lit(""))
    texts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(
        n,
        F.when(n % 2 == 0, "toml").otherwise("yml").alias("ext"),
        F.concat(F.when(n % 2 == 0, toml).otherwise(yaml), broken).alias("text"),
    )
    read = configs.decode_config(texts, "ext", "text")
    return read.select(
        n,
        F.try_variant_get("value", "$.part.name", "string").alias("name"),
        F.try_variant_get("value", "$.part.size", "int").alias("size"),
        F.col("decode_error").isNotNull().alias("failed"),
    )


@query("a6_json_sink", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def json_sink(spark, sf_dir):
    """Customers through the JSON sink and back as lines and values."""
    folder = scratch_path(spark, "json")
    files.write_json(table(spark, sf_dir, "customer"), folder)
    read = files.read_json_documents(files.read_lines(spark, folder), "line")
    pick = lambda name, kind: F.variant_get("value", f"$.{name}", kind).alias(name)
    return read.select(pick("c_custkey", "bigint"), pick("c_name", "string"), pick("c_acctbal", "double"), pick("c_nationkey", "int"))


@query(
    "a7_csv_line",
    r"""SELECT page_id, md5(concat(page_id, ',',
      CASE WHEN regexp_matches(url, '[",\r\n]') THEN concat('"', replace(url, '"', '""'), '"') ELSE url END, ',',
      CASE WHEN regexp_matches(html, '[",\r\n]') THEN concat('"', replace(html, '"', '""'), '"') ELSE html END)) AS line_md5
    FROM pages""",
)
def csv_lines(spark, sf_dir):
    cells = F.array(F.col("page_id").cast("string"), "url", "html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(csv_line(cells)).alias("line_md5"))


@query(
    "a6_json_documents",
    """SELECT c_nationkey, concat('[', string_agg(concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '"}'), ',' ORDER BY c_custkey), ']')
      AS document FROM customer GROUP BY c_nationkey""",
)
def json_document_sink(spark, sf_dir):
    """Customers of a nation as one JSON document."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return files.json_documents(rows, ["c_nationkey"])


@query("a8_read_lines", f"WITH {d.LOG_SQL} SELECT job_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM log_lines GROUP BY job_id")
def read_lines(spark, sf_dir):
    """Log lines written as text files and read back as a stream of arriving files."""
    folder = scratch_path(spark, "lines")
    d.log_lines(spark, sf_dir).select(F.concat_ws("\t", "job_id", "line")).write.text(folder)
    arrived = monitors.drained(files.read_lines(spark, folder, stream=True), "arrived")
    line = F.split("line", "\t", 2)
    read = arrived.select(line[0].cast("bigint").alias("job_id"), line[1].alias("line"))
    return read.groupBy("job_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line")).alias("chars"))


def _arrays(spark, sf_dir):
    """Per event an array of records with gaps, an extra key, a null, a nested value and a scalar."""
    n = F.col("event_id")
    text = F.concat(
        F.lit('[{"b":"'), "event_type", F.lit('","a":'), "user_id", F.lit('},{"a":null,"c":'), n, F.lit("},"), n,
        F.lit(',{"b":'), "props", F.lit("}]"),
    )
    return records.parse_strict(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select(n, text.alias("text"))).select(n, "value")


@query(
    "i1_records_from_json",
    """SELECT event_id, pos, 'a|b' AS header, cells, dropped FROM (
      SELECT event_id, 0 AS pos, concat(user_id, '|', event_type) AS cells, 0 AS dropped FROM events
      UNION ALL SELECT event_id, 1, 'null|', 1 FROM events
      UNION ALL SELECT event_id, 3, concat('|', replace(props, ' ', '')), 0 FROM events)""",
)
def records_from_json(spark, sf_dir):
    rows = records.records_from_json(_arrays(spark, sf_dir))
    return rows.select(
        "event_id", "pos", F.array_join("header", "|").alias("header"), F.array_join("cells", "|").alias("cells"),
        F.col("dropped_keys").alias("dropped"),
    )


@query(
    "i1_csv_document",
    """SELECT event_id, concat('a,b', chr(10), user_id, ',', event_type, chr(10), 'null,', chr(10),
      ',"', replace(replace(props, ' ', ''), '"', '""'), '"', chr(10)) AS csv FROM events""",
)
def csv_document(spark, sf_dir):
    return _arrays(spark, sf_dir).select("event_id", records.csv_document(F.col("value")).alias("csv"))


@query(
    "i2_json_from_records",
    """SELECT c_custkey, concat('{"c_custkey":"', c_custkey, '","c_mktsegment":"', c_mktsegment, '","c_name":"', c_name, '"}') AS json
    FROM customer""",
)
def json_from_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment")
    return records.json_from_records(rows, rows.columns).select("c_custkey", "json")


@query(
    "i3_shape_gate",
    """WITH s AS (SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array_of_objects' WHEN 2 THEN 'empty_array' WHEN 3 THEN 'array' ELSE 'scalar' END AS shape,
        CASE event_id % 3 WHEN 0 THEN 'toml' WHEN 1 THEN 'csv' ELSE 'json' END AS target FROM events)
    SELECT event_id, shape, CASE
      WHEN target = 'toml' AND shape LIKE '%array%' THEN 'TOML has no top-level array — only object/map data can convert to TOML'
      WHEN target = 'csv' AND shape IN ('object', 'array', 'scalar') THEN 'CSV output requires an array of objects' END AS error FROM s""",
)
def shape_gate(spark, sf_dir):
    n = F.col("event_id")
    text = (
        F.when(n % 5 == 0, F.col("props")).when(n % 5 == 1, F.concat(F.lit("["), "props", F.lit(", 1]")))
        .when(n % 5 == 2, "[]").when(n % 5 == 3, F.concat(F.lit("["), n, F.lit(", {}]"))).otherwise(n.cast("string"))
    )
    target = F.when(n % 3 == 0, "toml").when(n % 3 == 1, "csv").otherwise("json")
    docs = table(spark, sf_dir, "events", "event_id", "props").select(n, text.alias("text"), target.alias("target"))
    return records.shape_gate(records.parse_strict(docs).drop("error")).select("event_id", "shape", "error")


@query(
    "i4_flatten_documents",
    """WITH docs AS (SELECT event_id, concat('{"id":', event_id, ',"user":{"id":', user_id, ',"seen":[', event_id % 2 = 0, ',null,"', event_type,
        '"]},"props":', props, ',"none":{}}') AS doc FROM events)
    SELECT event_id, replace(fullkey, '"', '') AS key_path,
      CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean'
                WHEN 'NULL' THEN 'null' ELSE lower(type) END AS type,
      CASE WHEN type = 'VARCHAR' THEN atom->>'$' WHEN type = 'NULL' THEN 'null' ELSE CAST(value AS VARCHAR) END AS leaf
    FROM docs, json_tree(doc) WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) = '{}'""",
)
def flatten_documents(spark, sf_dir):
    n = F.col("event_id")
    doc = F.concat(
        F.lit('{"id":'), n, F.lit(',"user":{"id":'), "user_id", F.lit(',"seen":['), (n % 2 == 0).cast("string"),
        F.lit(',null,"'), "event_type", F.lit('"]},"props":'), "props", F.lit(',"none":{}}'),
    )
    docs = records.parse_strict(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select(n, doc.alias("text")))
    return records.flatten_documents(docs, ["event_id"], levels=4)


@query(
    "i5_convert_batch",
    """SELECT event_id, CASE WHEN event_id % 24 IN (9, 10) THEN NULL
        WHEN k IN (0, 5) THEN replace(props, ' ', '')
        WHEN k = 1 THEN concat('id,kind', chr(10), event_id, ',', event_type, chr(10))
        WHEN k = 2 THEN concat('[{"id":"', event_id, '","kind":"', event_type, '"}]') END AS output,
      CASE WHEN event_id % 24 = 9 THEN 'Unsupported data format: .' WHEN event_id % 24 = 10 THEN 'Unsupported target format: '
        WHEN k = 3 THEN 'Invalid JSON' WHEN k = 4 THEN 'CSV output requires an array of objects'
        WHEN k = 6 THEN 'Unsupported data format: .xml'
        WHEN k = 7 THEN 'TOML has no top-level array — only object/map data can convert to TOML' END AS error
    FROM (SELECT *, event_id % 8 AS k FROM events)""",
)
def convert_batch(spark, sf_dir):
    return records.convert_batch(_items(spark, sf_dir)).select("event_id", "output", "error")


def _items(spark, sf_dir):
    """One data document per event; every eighth kind has its own format, target and fault."""
    n, k = F.col("event_id"), F.col("event_id") % 8
    record = F.concat(F.lit('{"id":'), n, F.lit(',"kind":"'), "event_type", F.lit('"}'))
    text = (
        F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), record, F.lit("]")))
        .when(k == 2, F.concat(F.lit("kind,id\n"), "event_type", F.lit(","), n, F.lit("\n")))
        .when(k == 3, F.concat(record, F.lit(" {"))).when(k == 4, F.col("props"))
        .when(k == 5, F.concat(F.lit("k = "), F.regexp_extract("props", r"(\d+)", 1), F.lit("\n")))
        .when(k == 6, F.lit("<a/>")).otherwise(F.concat(F.lit("- "), n, F.lit("\n- b\n")))
    )
    ext = F.element_at(F.lit(["json", "json", "csv", "json", "json", "toml", "xml", "yaml"]), (k + 1).cast("int"))
    target = F.element_at(F.lit(["json", "csv", "json", "json", "csv", "json", "json", "toml"]), (k + 1).cast("int"))
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select(
        n, F.col("user_id").alias("batch_id"), text.alias("text"), F.when(n % 24 != 9, ext).alias("ext"),
        F.when(n % 24 != 10, target).alias("target"),
    )


@query(
    "i5_convert_batch_summary",
    """SELECT user_id AS batch_id, count(*) AS items, count(*) FILTER (event_id % 8 IN (0, 1, 2, 5) AND event_id % 24 NOT IN (9, 10)) AS ok,
      count(*) FILTER (event_id % 8 NOT IN (0, 1, 2, 5) OR event_id % 24 IN (9, 10)) AS failed,
      max(CASE WHEN event_id % 8 NOT IN (0, 1, 2, 5) OR event_id % 24 IN (9, 10) THEN 1 ELSE 0 END) AS exit_status FROM events GROUP BY user_id""",
)
def convert_batch_summary(spark, sf_dir):
    done = records.convert_batch(_items(spark, sf_dir))
    return batch.batch_summary(done.withColumnRenamed("output", "output_path"))
