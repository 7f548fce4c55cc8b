"""Queries on text corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from foliograph.functions import documents, paths, text as text_fn
from foliograph.operators import chunks, references
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table

# the characters trimmed on both sides of a text, for the checking engine
SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in text_fn.WHITE_SPACE) + ")"


URL_SQL = """urls AS (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN replace(url, '.', '%2E') WHEN 1 THEN replace(url, 'e', '%65')
  WHEN 2 THEN replace(url, '/', '%zz') WHEN 3 THEN concat(url, '+%E4%B8%AD%2') ELSE url END, CASE WHEN page_id % 2 = 0 THEN '%' ELSE '' END) AS escaped
  FROM pages)"""


@query("b5_percent_decode", f"WITH {URL_SQL} SELECT page_id, url_decode(escaped) AS decoded FROM urls")
def percent_decode(spark, sf_dir):
    n, url = F.col("page_id"), F.col("url")
    swap = lambda a, b: F.replace(url, F.lit(a), F.lit(b))
    escaped = F.concat(
        F.when(n % 5 == 0, swap(".", "%2E")).when(n % 5 == 1, swap("e", "%65")).when(n % 5 == 2, swap("/", "%zz"))
        .when(n % 5 == 3, F.concat(url, F.lit("+%E4%B8%AD%2"))).otherwise(url),
        F.when(n % 2 == 0, "%").otherwise(""),
    )
    return table(spark, sf_dir, "pages").select(n, paths.percent_decode(escaped).alias("decoded"))


@query(
    "b6_file_ref",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('/in/a b/', page_id) WHEN 1 THEN concat('/in/', page_id, '.pdf')
      WHEN 2 THEN NULL ELSE concat('/é/', page_id) END AS path FROM pages""",
)
def file_ref(spark, sf_dir):
    """References in plain texts and inside binary wrappers."""
    n = F.col("page_id")
    payload = (
        F.when(n % 4 == 0, F.concat(F.lit(" \tfile:///in/a%20b/"), n, F.lit(" \n\x00")).cast("binary"))
        .when(n % 4 == 1, F.concat(F.unhex(F.lit("62706CFF00")), F.concat(F.lit("file:///in/"), n, F.lit(".pdf")).cast("binary"), F.unhex(F.lit("00FF41"))))
        .when(n % 4 == 2, F.col("html").cast("binary"))
        .otherwise(F.concat(F.concat(F.lit("file:///%C3%A9/"), n).cast("binary"), F.unhex(F.lit("FE2F"))))
    )
    return table(spark, sf_dir, "pages").select(n, paths.file_ref(paths.lossy_text(payload)).alias("path"))


@query(
    "b12_sanitize_br",
    f"""SELECT page_id, md5(regexp_replace(replace(html, '<br>', {d.list_sql(d.BREAKS)}[1 + page_id % {len(d.BREAKS)}]),
      '<br ?/>|<BR ?/>|<br>|<BR>', ' ', 'g')) AS text_md5 FROM pages""",
)
def sanitize_br(spark, sf_dir):
    html = F.replace(F.col("html"), F.lit("<br>"), d.dealt(d.BREAKS, F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text_fn.sanitize_br(html)).alias("text_md5"))


@query(
    "b13_balance_tags",
    """WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' <sup>the '), ' of ', CASE WHEN doc_id % 2 = 0 THEN ' <sub>of</sup> ' ELSE ' of</sub> ' END) AS text FROM documents),
    n AS (SELECT *, len(regexp_extract_all(text, '<sup>')) - len(regexp_extract_all(text, '</sup>')) AS sup,
                    len(regexp_extract_all(text, '<sub>')) - len(regexp_extract_all(text, '</sub>')) AS sub FROM t)
    SELECT doc_id, md5(concat(text, repeat('</sup>', greatest(sup, 0)), repeat('</sub>', greatest(sub, 0)))) AS text_md5 FROM n""",
)
def balance_tags(spark, sf_dir):
    n = F.col("doc_id")
    marked = F.replace(F.col("text"), F.lit(" the "), F.lit(" <sup>the "))
    marked = F.replace(marked, F.lit(" of "), F.when(n % 2 == 0, F.lit(" <sub>of</sup> ")).otherwise(F.lit(" of</sub> ")))
    marked_docs = table(spark, sf_dir, "documents", "doc_id", "text").select(n, marked.alias("text"))
    return marked_docs.select(n, F.md5(text_fn.balance_tags(F.col("text"))).alias("text_md5"))


SNIFF_SQL = f"""
mixed AS (
  SELECT concat('d', doc_id) AS id, doc_id % 6 AS k, CASE doc_id % 6
    WHEN 0 THEN CAST(json_object('id', doc_id, 'text', text) AS VARCHAR)
    WHEN 1 THEN concat('<?xml version="1.0"?><d>', text, '</d>', chr(10)) WHEN 2 THEN concat('[doc]', chr(10), 'id = ', doc_id, chr(10))
    WHEN 3 THEN concat('{{', text, '}}') WHEN 4 THEN concat('key = value without quotes', chr(10), text) ELSE text END AS text FROM documents
  UNION ALL SELECT concat('p', page_id), 6, html FROM pages
)"""


@query(
    "b16_sniff_format",
    f"""WITH {SNIFF_SQL}, bare AS (SELECT *, trim(text, {SPACES}) AS t FROM mixed)
    SELECT id, CASE WHEN t = '' THEN 'txt' WHEN (t LIKE '{{%' OR t LIKE '[%') AND json_valid(text) THEN 'json'
      WHEN t LIKE '<%' AND t LIKE '%>' AND t LIKE '%</%' THEN 'xml' WHEN k = 2 THEN 'toml' ELSE 'txt' END AS format FROM bare""",
)
def sniff_format(spark, sf_dir):
    """Texts dealt one of six forms, and pages. A text that is NULL counts as empty, and so does an id in its name."""
    named = lambda mark, key: F.concat(F.lit(mark), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("id")
    n, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    mixed = (
        F.when(n % 6 == 0, F.to_json(F.struct(n.alias("id"), body.alias("text"))))
        .when(n % 6 == 1, F.concat(F.lit('<?xml version="1.0"?><d>'), body, F.lit("</d>\n")))
        .when(n % 6 == 2, F.concat(F.lit("[doc]\nid = "), n, F.lit("\n")))
        .when(n % 6 == 3, F.concat(F.lit("{"), body, F.lit("}")))
        .when(n % 6 == 4, F.concat(F.lit("key = value without quotes\n"), body))
        .otherwise(body)
    )
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(named("d", "doc_id"), mixed.alias("text"))
    pages = table(spark, sf_dir, "pages").select(named("p", "page_id"), F.coalesce("html", F.lit("")).alias("text"))
    return docs.unionByName(pages).select("id", documents.sniff_format(F.col("text")).alias("format"))


CANDIDATES_SQL = """
cands AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 8
    WHEN 0 THEN concat('```markdown', chr(10), text, chr(10), '```', chr(10)) WHEN 1 THEN concat(' Fixed: ', text)
    WHEN 2 THEN concat(text, text, text) WHEN 3 THEN substr(text, 1, length(text) // 10) WHEN 4 THEN '``````'
    WHEN 5 THEN NULL WHEN 6 THEN substr(text, 1, length(text) // 2) ELSE concat('``````', text, '``````') END AS cand FROM conversations)"""


@query(
    "b20_accept_rewrite",
    f"""WITH {CANDIDATES_SQL},
    c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(cand, {SPACES}),
      '^(?:```markdown)*(?:```)*', ''), '(?:```)+$', ''), {SPACES}), '^Fixed:', ''), {SPACES}) AS cleaned FROM cands),
    g AS (SELECT *, coalesce(length(cleaned) > 0 AND length(cleaned) <= 2 * length(text)
      AND length(cleaned) >= length(text) * 3 // 10, FALSE) AS accepted FROM c)
    SELECT conv_id, turn, accepted, md5(CASE WHEN accepted THEN cleaned ELSE text END) AS text_md5,
      greatest(2 * length(text), 256) AS budget FROM g""",
)
def accept_rewrite(spark, sf_dir):
    k, body = (F.col("conv_id") + F.col("turn")) % 8, F.col("text")
    part = lambda by: F.substring(body, F.lit(1), F.floor(F.char_length(body) / by).cast("int"))
    cand = (
        F.when(k == 0, F.concat(F.lit("```markdown\n"), body, F.lit("\n```\n"))).when(k == 1, F.concat(F.lit(" Fixed: "), body))
        .when(k == 2, F.concat(body, body, body)).when(k == 3, part(10)).when(k == 4, F.lit("``````"))
        .when(k == 6, part(2)).when(k == 7, F.concat(F.lit("``````"), body, F.lit("``````")))
    )
    answered = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", cand.alias("cand"))
    gate = answered.withColumn("gate", text_fn.accept_rewrite(F.col("text"), F.col("cand")))
    return gate.select(
        "conv_id", "turn", "gate.accepted", F.md5("gate.text").alias("text_md5"),
        text_fn.rewrite_budget(F.col("text")).cast("bigint").alias("budget"),
    )


@query(
    "b21_fix_headings",
    r"""SELECT conv_id, turn, md5(concat(repeat('#', CASE turn % 4 WHEN 3 THEN 1 ELSE turn % 4 + 1 END), ' ', conv_id % 9,
      CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.2.3' ELSE '.x' END, ' Title', chr(10), text,
      chr(10), '## 1.2.3 Kept')) AS text_md5 FROM conversations""",
)
def fix_headings(spark, sf_dir):
    turn = F.col("turn") % 4
    number = F.when(turn == 0, "").when(turn == 1, ".1").when(turn == 2, ".2.3").otherwise(".x")
    marked = F.concat(
        F.lit("# "), F.col("conv_id") % 9, number, F.lit(" Title\n"), "text", F.lit("\n## 1.2.3 Kept")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text_fn.fix_headings(marked)).alias("text_md5"))


@query(
    "b22_dehyphenate",
    r"""SELECT doc_id, md5(regexp_replace(replace(text, 'th', concat('t-', chr(10), 'h')), '(\p{L})-\n(\p{Ll})', '\1\2', 'g')) AS text_md5
    FROM documents""",
)
def dehyphenate(spark, sf_dir):
    broken = F.replace(F.col("text"), F.lit("th"), F.lit("t-\nh"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(text_fn.dehyphenate(broken)).alias("text_md5"))


@query(
    "c7_resolve_refs",
    """WITH known AS (SELECT DISTINCT concat('/in/', l_orderkey, '/', l_linenumber, '.dat') AS path FROM lineitem),
    texts AS (SELECT o_orderkey, concat('/in/', o_orderkey, '/', 1 + o_orderkey % 7, '.dat') AS path, o_orderkey % 3 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k < 2 THEN known.path END AS path,
      CASE WHEN k < 2 AND known.path IS NOT NULL THEN NULL ELSE 'txt' END AS format
    FROM texts LEFT JOIN known ON texts.path = known.path""",
)
def resolve_refs(spark, sf_dir):
    """Pasted order notes that may point at a known file; the others are sniffed."""
    n = F.col("o_orderkey")
    path = F.concat(F.lit("/in/"), n, F.lit("/"), 1 + n % 7, F.lit(".dat"))
    text = (
        F.when(n % 3 == 0, F.concat(F.lit(" file://"), F.replace(path, F.lit("."), F.lit("%2E")), F.lit("\n")))
        .when(n % 3 == 1, path).otherwise(F.concat(path, F.lit("\nsecond line")))
    )
    texts = table(spark, sf_dir, "orders").select(n, text.alias("text"))
    known = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/in/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit(".dat")).alias("path")
    )
    return references.resolve_refs(texts, known).select("o_orderkey", "path", "format")


# paragraphs with their chunk number, by walking each text one paragraph at a time
CHUNKS_SQL = f"""
{{source}},
paras AS (
  SELECT doc_id, n AS i, parts[n] AS p, length(parts[n]) AS len, len(parts) AS total,
         len(regexp_extract_all(parts[n], '(?m)^[ \t\r]*```')) % 2 = 1 AS toggles
  FROM (SELECT doc_id, string_split(text, concat(chr(10), chr(10))) AS parts,
               unnest(generate_series(1, len(string_split(text, concat(chr(10), chr(10)))))) AS n
        FROM docs WHERE length(text) > 3000)
),
walk AS (
  SELECT doc_id, i, len AS size, toggles AS fenced, 0 AS pos FROM paras WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i,
    CASE WHEN w.fenced = p.toggles AND w.size > 0 AND w.size + p.len + 2 > 3000 THEN p.len
         WHEN w.size = 0 THEN p.len ELSE w.size + p.len + 2 END,
    w.fenced <> p.toggles,
    CASE WHEN w.fenced = p.toggles AND w.size > 0 AND w.size + p.len + 2 > 3000 THEN w.pos + 1 ELSE w.pos END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1
),
cut AS (
  SELECT w.doc_id, w.pos, trim(string_agg(p.p, concat(chr(10), chr(10)) ORDER BY w.i), {SPACES}) AS chunk
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i GROUP BY w.doc_id, w.pos
),
chunks AS (
  SELECT doc_id, 0 AS pos, text AS chunk FROM docs WHERE length(text) <= 3000
  UNION ALL
  SELECT doc_id, pos, chunk FROM cut c
  WHERE chunk <> '' OR pos < (SELECT max(pos) FROM cut x WHERE x.doc_id = c.doc_id)
)"""


def _chunks_sql(source: str) -> str:
    return CHUNKS_SQL.replace("{source}", source)


@query("j1_chunk_text", f"WITH RECURSIVE {_chunks_sql(d.DOCS_SQL)} SELECT doc_id, pos, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM chunks")
def chunk_text(spark, sf_dir):
    cut = chunks.chunk_text(d.fenced_documents(spark, sf_dir))
    return cut.select("doc_id", "pos", F.char_length("chunk").cast("bigint").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query(
    "d3_reassemble",
    f"""WITH RECURSIVE {_chunks_sql(d.DOCS_SQL)}
    SELECT doc_id, md5(string_agg(chunk, concat(chr(10), chr(10)) ORDER BY pos)) AS text_md5 FROM chunks GROUP BY doc_id""",
)
def reassemble(spark, sf_dir):
    joined = chunks.reassemble(chunks.chunk_text(d.fenced_documents(spark, sf_dir)), ["doc_id"])
    return joined.select("doc_id", F.md5("text").alias("text_md5"))


def replace_of(prompts: pd.Series, budgets: pd.Series) -> pd.Series:
    """A stand-in for a model: it finds the text in its prompt, replaces something and wraps the answer the way answers come.
    Every third text it repeats until its budget is spent."""

    def answer(asked: str, budget: int) -> str:
        text = asked.removeprefix(chunks.PROMPT_HEAD).removesuffix(chunks.PROMPT_TAIL).replace(" of ", " in ")
        return "Fixed: " + ((text * 3)[:budget] if len(text) % 3 == 0 else text)

    return pd.Series([answer(a, b) for a, b in zip(prompts, budgets)], dtype=object)


REWRITE_SQL = d.DOCS_SQL.replace("docs AS", "plain AS").replace("\n)", "\n)") + """,
docs AS (SELECT doc_id, regexp_replace(concat(text, repeat('</sup>', greatest(
    len(regexp_extract_all(text, '<sup>')) - len(regexp_extract_all(text, '</sup>')), 0)), repeat('</sub>', greatest(
    len(regexp_extract_all(text, '<sub>')) - len(regexp_extract_all(text, '</sub>')), 0))),
  '<br ?/>|<BR ?/>|<br>|<BR>', ' ', 'g') AS text FROM plain)"""
REPLACED = "replace(chunk, ' of ', ' in ')"
ANSWER = f"trim(CASE WHEN length(chunk) % 3 = 0 THEN left(repeat({REPLACED}, 3), greatest(2 * length(chunk), 256)) ELSE {REPLACED} END, {SPACES})"


@query(
    "j2_rewrite_corpus",
    f"""WITH RECURSIVE {_chunks_sql(REWRITE_SQL)},
    answered AS (SELECT doc_id, pos, CASE WHEN length({ANSWER}) > 0 AND length({ANSWER}) <= 2 * length(chunk)
      AND length({ANSWER}) >= length(chunk) * 3 // 10 THEN {ANSWER} ELSE chunk END AS chunk FROM chunks)
    SELECT doc_id, md5(string_agg(chunk, concat(chr(10), chr(10)) ORDER BY pos)) AS text_md5 FROM answered GROUP BY doc_id""",
)
def rewrite_corpus(spark, sf_dir):
    done = chunks.rewrite_corpus(d.fenced_documents(spark, sf_dir), replace_of, ["doc_id"])
    return done.select("doc_id", F.md5("text").alias("text_md5"))


def shout_or_fail(texts: pd.Series) -> pd.Series:
    """Fails on some texts, answers too little on others."""
    if texts.str.contains("the", regex=False).any():
        raise ValueError("no answer")
    return texts.where(texts.str.len() % 2 == 0, "?")


@query(
    "l1_rewrite_chunks",
    f"""WITH a AS (SELECT conv_id, turn, text, CASE WHEN text LIKE '%the%' THEN NULL WHEN length(text) % 2 = 0 THEN trim(text, {SPACES}) ELSE '?' END AS answer
      FROM conversations),
    g AS (SELECT *, coalesce(length(answer) > 0 AND length(answer) <= 2 * length(text) AND length(answer) >= length(text) * 3 // 10, FALSE) AS accepted FROM a)
    SELECT conv_id, turn, accepted, md5(CASE WHEN accepted THEN answer ELSE text END) AS text_md5 FROM g""",
)
def rewrite_chunks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumnRenamed("text", "chunk")
    done = chunks.rewrite_chunks(turns, shout_or_fail)
    return done.select("conv_id", "turn", "accepted", F.md5("rewritten").alias("text_md5"))
