"""Document values: decoding, records, flattening, batch conversion, files."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions.documents import NEEDS_RECORDS, NO_TOP_LEVEL_ARRAY
from foliograph.operators import records
from foliograph.session import scratch_path
from foliograph.sources import configs, files


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return records.parse_strict(df)


def test_records_and_csv(spark):
    texts = [
        '[{"b":"x","a":1},{"a":null,"c":2},7,{"b":{"z":[1, 2]},"a":true}]', "[]", '[{"k":"a,b"},{"k":"say \\"x\\""}]', '{"a":1}', "[{}]",
    ]
    df = parsed(spark, texts)
    rows = {(r.id, r.pos): (r.header, r.cells, r.dropped_keys) for r in records.records_from_json(df).collect()}
    assert rows[0, 0] == (["a", "b"], ["1", "x"], 0)
    assert rows[0, 1] == (["a", "b"], ["null", ""], 1)
    assert (0, 2) not in rows
    assert rows[0, 3] == (["a", "b"], ["true", '{"z":[1,2]}'], 0)
    csv = [r.c for r in df.select("id", records.csv_document(F.col("value")).alias("c")).orderBy("id").collect()]
    assert csv[0] == 'a,b\n1,x\nnull,\ntrue,"{""z"":[1,2]}"\n'
    assert csv[1] == ""
    assert csv[2] == 'k\n"a,b"\n"say ""x"""\n'


def test_shape_gate(spark):
    cases = [
        ('[{"a":1},{"a":2}]', "toml", NO_TOP_LEVEL_ARRAY), ('{"a":1}', "csv", NEEDS_RECORDS), ("[]", "csv", None), ("[1,{}]", "csv", NEEDS_RECORDS),
        ('[{"a":1},5]', "csv", None), ('{"a":1}', "toml", None), ("5", "csv", NEEDS_RECORDS), ("[1]", "json", None), ("[]", "toml", NO_TOP_LEVEL_ARRAY),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "id int, text string, target string")
    got = records.shape_gate(records.parse_strict(df).drop("error")).orderBy("id").collect()
    assert [r.error for r in got] == [e for _, _, e in cases]


def test_json_from_records(spark):
    df = spark.createDataFrame([("1", "x, y"), ("2", None)], "b string, a string")
    assert [r.json for r in records.json_from_records(df, ["b", "a"]).collect()] == ['{"a":"x, y","b":"1"}', '{"a":"","b":"2"}']
    cells = spark.createDataFrame([(["k", "a", "k"], ["1", "2", "3"])], "h array<string>, c array<string>")
    assert cells.select(records.json_from_cells(F.col("h"), F.col("c"))).first()[0] == '{"a":"2","k":"3"}'


def test_flatten(spark):
    df = parsed(spark, ['{"a":{"b":[1,{"c":null}]},"d":"s","e":{},"f":[]}', "5", "null"])
    got = {(r.id, r.key_path): (r.type, r.leaf) for r in records.flatten_documents(df, ["id"]).collect()}
    assert got == {
        (0, "$.a.b[0]"): ("number", "1"), (0, "$.a.b[1].c"): ("null", "null"), (0, "$.d"): ("string", "s"),
        (0, "$.e"): ("object", "{}"), (0, "$.f"): ("array", "[]"), (1, "$"): ("number", "5"), (2, "$"): ("null", "null"),
    }
    cut = {r.key_path: r.leaf for r in records.flatten_documents(df.filter("id = 0"), ["id"], depth=1).collect()}
    assert cut["$.a"] == '{"b":[1,{"c":null}]}'


def test_decode(spark):
    rows = [
        (0, "TOML", 't = 1\n[s]\nd = 2020-01-02\nl = ["a", 1.5]\n'), (1, "toml", "t = "), (2, "yml", "a: 1\nb: [x, y]\n"), (3, "yaml", "a: [1"),
        (4, "csv", 'h,k\n"a\nb","x,y"\n1,2\n'), (5, "csv", "h,k\n1\n"), (6, "json", '{"a":1}'), (7, "json", '{"a":1} x'), (8, "xml", "<a/>"), (9, "yaml", "n: .nan"),
    ]
    df = spark.createDataFrame(rows, "id int, ext string, text string")
    got = {r.id: (r.j, r.decode_error) for r in configs.decode_config(df, "ext", "text").withColumn("j", F.to_json("value")).collect()}
    assert got[0] == ('{"s":{"d":"2020-01-02","l":["a",1.5]},"t":1}', None)
    assert got[1][0] is None and got[1][1].startswith("Invalid TOML")
    assert got[2] == ('{"a":1,"b":["x","y"]}', None)
    assert got[3][0] is None and got[3][1].startswith("Invalid YAML")
    assert got[4] == ('[{"h":"a\\nb","k":"x,y"},{"h":"1","k":"2"}]', None)
    assert got[5][0] is None and "fields" in got[5][1]
    assert got[6] == ('{"a":1}', None)
    assert got[7] == (None, "Invalid JSON")
    assert got[8] == (None, "Unsupported data format: .xml")
    assert got[9][0] is None and got[9][1] is not None


def test_convert_batch(spark):
    rows = [(0, "json", '[{"a":1,"b":"x"}]', "csv"), (1, "csv", "a\n1\n", "json"), (2, "csv", "a\n1\n", "toml"), (3, "json", "{", "csv"),
            (4, "toml", "a = 1", "csv"), (5, "json", "1", "yaml"), (6, "toml", "a = 1", "json")]
    df = spark.createDataFrame(rows, "id int, ext string, text string, target string")
    got = {r.id: (r.output, r.error) for r in records.convert_batch(df).collect()}
    assert all((o is None) != (e is None) for o, e in got.values())
    assert got[0] == ("a,b\n1,x\n", None) and got[1] == ('[{"a":"1"}]', None) and got[2] == (None, NO_TOP_LEVEL_ARRAY)
    assert got[3] == (None, "Invalid JSON") and got[4] == (None, NEEDS_RECORDS) and got[6] == ('{"a":1}', None)
    assert got[5][1] == "Unsupported target format: yaml"


def test_csv_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('h,k\n"a\nb","x,""y"\n007,\n', newline="")
    assert files.csv_header(spark, str(good)) == ["h", "k"]
    rows = files.read_csv_records(spark, str(good), ["h", "k"]).collect()
    assert [(r.h, r.k, r.error) for r in rows] == [("a\nb", 'x,"y', None), ("007", "", None)]
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("h,k\n1\n")
    assert [(r.h, r.error) for r in files.read_csv_records(spark, str(ragged), ["h", "k"]).collect()] == [
        (None, "CSV rows whose fields do not match the header: 1")
    ]
    folder = scratch_path(spark, "csv")
    odd = spark.createDataFrame([(" pad ", 'q"q'), ("l\nm", "a,b"), ("", "x")], "h string, k string")
    files.write_csv(odd, folder)
    assert {(r.h, r.k) for r in files.read_csv_records(spark, folder, ["h", "k"]).collect()} == {tuple(r) for r in odd.collect()}


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.MD").write_text("b")
    (tmp_path / "a.md").write_text("ä\nx")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    found = files.file_manifest(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.ext, r.length) for r in found.collect()} == {("b.MD", "md", 1), ("a.md", "md", 4), ("bad.md", "md", 2)}
    assert files.first_match(found, "md").first().path.endswith("/a.md")
    texts = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in files.text_documents(spark, str(tmp_path)).collect()}
    assert texts["a.md"] == ("ä\nx", None)
    assert texts["bad.md"][0] is None and "UTF-8" in texts["bad.md"][1]


def test_json_documents(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, "c")], "file string, pos int, v string")
    got = {r.file: r.document for r in files.json_documents(df, ["file"]).collect()}
    assert got == {"f": '[{"pos":1,"v":"a"},{"pos":2,"v":"b"}]', "g": '[{"pos":1,"v":"c"}]'}


def test_deep_documents_open_to_the_leaves(spark):
    deep = '{"a":' * 30 + '[1,{"b":[]}]' + "}" * 30
    df = records.parse_strict(spark.createDataFrame([(0, deep), (1, '{"x":1}'), (2, "{}")], "id int, text string")).select("id", "value")
    got = {(r.id, r.key_path, r.type, r.leaf) for r in records.flatten_documents(df, ["id"], levels=7).collect()}
    path = "$" + ".a" * 30
    assert got == {(0, path + "[0]", "number", "1"), (0, path + "[1].b", "array", "[]"), (1, "$.x", "number", "1"), (2, "$", "object", "{}")}


def test_large_cells_and_missing_requests(spark):
    big = "x" * 200_000
    rows = [(0, "csv", f"a,b\n{big},1\n", "json"), (1, "csv", 'a\n"x"y\n', "json"), (2, None, "{}", "json"), (3, "json", "{}", None), (4, None, None, None), (5, "json", None, "json")]
    done = records.convert_batch(spark.createDataFrame(rows, "id int, ext string, text string, target string"))
    got = {r.id: r for r in done.collect()}
    assert all((r.output is None) != (r.error is None) for r in got.values())
    assert got[0].output == f'[{{"a":"{big}","b":"1"}}]'
    assert got[1].output == '[{"a":"xy"}]'
    assert got[2].error == "Unsupported data format: ."
    assert got[3].error == "Unsupported target format: "


def test_ragged_files_give_an_error_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,z\n')
    (tmp_path / "b.csv").write_text("k,v\n1,2,3\n4,5\n")
    rows = files.read_csv_records(spark, str(tmp_path), ["k", "v"]).collect()
    assert sorted((r.k, r.v) for r in rows if r.error is None) == [("1", "x\ny"), ("2", "z")]
    assert [r.file.rsplit("/", 1)[1] for r in rows if r.error] == ["b.csv"]


def test_csv_files_in_many_splits(spark, tmp_path):
    """Files cut anywhere, inside quotes too, give the rows of a reader that takes each file whole."""
    rng = random.Random(12)
    cells = ["", "a", "b,c", 'say "x"', "two\nlines", '"', "\n\n", "end\r\nhere", "ü" * 40, '",\n"', " x "]
    rows = [(str(i), rng.choice(cells), rng.choice(cells) * rng.randrange(1, 4)) for i in range(600)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') else c
    for k in range(2):
        part = rows[k::2]
        (tmp_path / f"part{k}.csv").write_bytes(("h,k,l\r\n" + "\r\n".join(",".join(map(quoted, r)) for r in part) + "\r\n").encode())
    (tmp_path / "ragged.csv").write_text('h,k,l\n1,2,3\n1,2\n"a\nb",2,3,4\n')
    (tmp_path / "other.csv").write_text("h,x,l\n1,2,3\n")
    (tmp_path / "open.csv").write_text('h,k,l\n1,"2,3\n4,5,6\n')
    (tmp_path / "empty.csv").write_text("h,k,l\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = files.split_csv_records(spark, str(tmp_path / "*.csv"), ["h", "k", "l"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = sorted((h, k.replace("\r\n", "\n"), l.replace("\r\n", "\n")) for h, k, l in rows)
    assert sorted((r.h, r.k, r.l) for r in got if r.error is None) == plain
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in got if r.error}
    assert errors == {"ragged.csv": files.CSV_RAGGED + "2", "other.csv": files.CSV_HEADER, "open.csv": files.CSV_OPEN}
    whole = files.read_csv_records(spark, str(tmp_path / "part*.csv"), ["h", "k", "l"]).collect()
    assert sorted((r.h, r.k, r.l) for r in whole) == plain


def test_texts_as_files_without_a_folder_each(spark, tmp_path):
    """Rows that repeat a key get a file each, and all files lie in one folder."""
    rows = [(i, f"line\n{i}") for i in range(40)] + [(7, "again"), (8, None)]
    folder = str(tmp_path / "texts")
    named = files.write_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", folder)
    read = files.text_documents(spark, folder, "*.txt").withColumn("file_no", files.file_number(F.col("path")))
    got = sorted((r.id, r.content) for r in named.join(read, "file_no").collect())
    assert got == sorted((i, (text or "") + "\n") for i, text in rows)
    assert not [d for d in (tmp_path / "texts").iterdir() if d.is_dir()]


def test_lines_of_one_split_are_added_up_in_many_blocks(spark, tmp_path, monkeypatch):
    """No task adds up a whole split: a file of one split is cut into blocks of ``LINES``."""
    seen, add_up = [], files.sum_before

    def watched(df, keys, order, block, value, name):
        seen.append(df.select(*keys, *[b.alias(f"b{i}") for i, b in enumerate(block)]).distinct().count())
        return add_up(df, keys, order, block, value, name)

    monkeypatch.setattr(files, "LINES", 100)
    monkeypatch.setattr(files, "sum_before", watched)
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f'{i},"x\ny"\n' for i in range(500)))
    back = files.split_csv_records(spark, str(tmp_path / "*.csv"), ["n", "t"])
    assert sorted((int(r.n), r.t, r.error) for r in back.collect()) == [(i, "x\ny", None) for i in range(500)]
    assert min(seen) > 5


def test_many_texts_as_files_in_groups(spark, tmp_path):
    """Groups hold all files, which lie there without files of check sums, and few tasks read them."""
    rows = [(i, None if i % 7 == 0 else f"é\n{i % 5}") for i in range(2100)]
    folder = str(tmp_path / "texts")
    named = files.write_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", folder, groups=3)
    assert {str(p.suffix) for p in (tmp_path / "texts").rglob("*") if p.is_file()} == {".txt"}
    groups = files.folders(spark, folder)
    assert len(groups) == 3
    for one in [folder, *groups]:
        assert files.text_documents(spark, one).rdd.getNumPartitions() <= files.READERS * spark.sparkContext.defaultParallelism
    read = [files.text_documents(spark, one).select(files.file_number(F.col("path")).alias("file_no"), "content") for one in groups]
    got = named.join(read[0].union(read[1]).union(read[2]), "file_no").collect()
    assert sorted((r.id, r.content) for r in got) == [(i, (text or "") + "\n") for i, text in rows]
    with pytest.raises(FileExistsError):
        files.write_texts(named, "file_no", "id", folder)


def test_texts_in_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_new_mounted_folder", lambda *_: None)
    rows = [(i, f"line\n{i}") for i in range(20)]
    folder = str(tmp_path / "texts")
    named = files.write_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text", folder, groups=2)
    assert files.folders(spark, folder) == [folder]
    read = files.text_documents(spark, folder, "*.txt").withColumn("file_no", files.file_number(F.col("path")))
    assert sorted((r.id, r.content) for r in named.join(read, "file_no").collect()) == [(i, text + "\n") for i, text in rows]
