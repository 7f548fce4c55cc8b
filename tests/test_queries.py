"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest
from compare import TABLES_ROOT, compare, connect

import __spark_entry__ as entry

SF_DIR = f"{TABLES_ROOT}/sf0.001"
ORACLES = entry.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, tables, name):
    _, _, message = compare(spark, tables, name, entry.QUERIES[name], ORACLES.get(name), SF_DIR)
    assert not message


def test_all_have_sql():
    assert set(entry.QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sniff_of_null_texts(spark, tmp_path):
    """A text that is NULL is empty inside each form it is dealt, as in the SQL."""
    texts = [None, "", " ", "This is.", '{"a": 1}', "<a></a>"]
    tables = {
        "documents": ("doc_id long, text string", [(i * 6 + k, t) for i, t in enumerate(texts) for k in range(6)]),
        "pages": ("page_id long, html string", list(enumerate(texts))),
    }
    for name, (schema, rows) in tables.items():
        frame = spark.createDataFrame(rows, schema).toPandas()
        frame.to_parquet(tmp_path / f"{name}.parquet", index=False)
    name = "b16_sniff_format"
    _, rows, message = compare(spark, connect(str(tmp_path)), name, entry.QUERIES[name], ORACLES[name], str(tmp_path))
    assert rows == 42 and not message


def test_sniff_without_ids(spark, tmp_path):
    """A text whose id is NULL is taken as it is and named by its kind only, as in the SQL."""
    texts = [None, "", "This is.", '{"a": 1}', r'["\ud800"]', "<a></a>"]
    for name, columns in (("documents", ["doc_id", "text"]), ("pages", ["page_id", "html"])):
        rows = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, f"{columns[0]} long, {columns[1]} string").toPandas()
        frame.astype({columns[0]: "Int64"}).to_parquet(tmp_path / f"{name}.parquet", index=False)
    name = "b16_sniff_format"
    _, rows, message = compare(spark, connect(str(tmp_path)), name, entry.QUERIES[name], ORACLES[name], str(tmp_path))
    assert rows == 24 and not message
