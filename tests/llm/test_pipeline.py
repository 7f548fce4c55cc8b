"""The pipeline against the same decisions in plain Python, and the query registry."""

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliograph.llm import attention
from foliograph.llm.common import table
from foliograph.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(__file__))
from compare import compare, connect  # noqa: E402
from test_decontaminate import shingles  # noqa: E402
from test_line_dedup import brute_force as dedup_lines  # noqa: E402
from test_mixing import targets_by_rounds, words_of  # noqa: E402
from test_simhash import plain_groups  # noqa: E402

ROOT = "/root/testdata/sf0.001"
WITH_SECRETS = "/root/testdata/sf0.01"  # the smaller tables hold none


def test_run_against_plain_stages(spark):
    docs = table(spark, ROOT, "documents", *corpus_pipeline.COLUMNS)
    scored = attention.score_quality(docs, table(spark, ROOT, "labels", "doc_id", "quality"))
    accepted = [(r["doc_id"], r["text"], r["source"]) for r in scored.where("predicted = 1").collect()]
    source = {d: s for d, _, s in accepted}
    texts = dict(dedup_lines(accepted, 10))
    groups = plain_groups(list(texts.items()))
    single = {d: t for d, t in texts.items() if groups[d] == d}
    items = [shingles(r["text"]) for r in table(spark, ROOT, "benchmark", "text").collect()]
    clean = {d: t for d, t in single.items() if not any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
    sizes = defaultdict(int)
    for d, t in clean.items():
        sizes[source[d]] += words_of(t)
    targets = targets_by_rounds(dict(sizes))
    want = Counter()
    for d, t in clean.items():
        rate = targets[source[d]] / sizes[source[d]] if sizes[source[d]] else 0
        coin = int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (coin < rate - math.floor(rate))
        if copies:
            want[d, t] = copies
    got = corpus_pipeline.run(spark, ROOT)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert len(clean) < len(single) < len(texts)


def test_every_stage_takes_empty_and_odd_documents(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e", None, None, 9), (2, "a b c d e", None, None, 9), (3, "x\n\ny", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_lines", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), ROOT).count() == 0
        assert stage(spark, docs, ROOT).columns[:5] == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    root = WITH_SECRETS if name == "op4_secret_forest" else ROOT
    _, _, message = compare(spark, connect(root), name, QUERIES[name], ORACLES.get(name), root)
    assert not message


def test_secrets_have_scores(spark):
    found = QUERIES["op4_secret_forest"](spark, WITH_SECRETS).collect()
    tokens = {(r["doc_id"], t) for r in table(spark, WITH_SECRETS, "documents", "doc_id", "text").collect() for t in re.findall(r'(?i)token = "([0-9a-f]{40})"', r["text"] or "")}
    assert tokens and {(r["doc_id"], r["secret"]) for r in found} == tokens and all(0.5 <= r["score"] <= 1 for r in found)


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
