"""Batch operators on small fixtures."""

import hashlib

from pyspark.sql import functions as F

from foliograph import catalog
from foliograph.operators import batch, ranks


def test_admission(spark):
    paths = ["/a/b.pdf", "/a/c.PDF", "/a/d.png", "/a/e.mp3", "/a/f.MKV", "mp3", "/x.y/mp4"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    merge = {r.path: r for r in batch.admit(df, "merge").collect()}
    assert [p for p in paths if merge[p].accepted] == ["/a/b.pdf", "/a/c.PDF"]
    assert merge["/a/d.png"].reason == "Only PDF files can be merged" and merge["/a/b.pdf"].reason is None
    trim = {r.path: r for r in batch.admit(df, "trim").collect()}
    # without a dot the whole path is taken for the extension
    assert [p for p in paths if trim[p].accepted] == ["/a/e.mp3", "/a/f.MKV", "mp3"]
    assert trim["/a/d.png"].reason == "Only audio/video files can be trimmed"
    audio = df.filter(batch.is_audio_only(F.col("path"))).collect()
    assert [r.path for r in audio] == ["/a/e.mp3"]
    convert = {r.path: r.reason for r in batch.admit(df, "convert").collect()}
    assert convert["mp3"] == "Unsupported file type: ." and convert["/a/b.pdf"] is None


def test_settings(spark):
    rows = [
        (200, 0, 99, " http://localhost:11434 ", "download"), (0, 50, 0, "localhost:11434", "printer"),
        (None, None, None, "", None), (75, 65, 4, "https://h", "clipboard"),
    ]
    df = spark.createDataFrame(rows, "jpeg_quality int, avif_quality int, max_concurrent int, rewriter_url string, output_mode string")
    got = [tuple(r) for r in batch.validate_settings(df).collect()]
    assert got[0] == (100, 1, 8, "http://localhost:11434", "download", None)
    assert got[1] == (1, 50, 1, "localhost:11434", "clipboard",
                      "Invalid local LLM URL 'localhost:11434': must start with http:// or https://")
    assert got[2] == (75, 65, 4, "", "clipboard", None)
    assert got[3] == (75, 65, 4, "https://h", "clipboard", None)


def test_checksums(spark):
    empty = hashlib.sha256(b"").hexdigest()
    files = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(b"x")), ("c", bytearray(b"y")), ("d", bytearray(b"z"))], "path string, content binary")
    want = spark.createDataFrame([("a", empty), ("b", "0" * 64), ("c", "")], "path string, expected string")
    got = {r.path: r.status for r in batch.verify_checksum(files, want).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "unverified", "d": "unverified"}


def test_error_classes(spark):
    rows = [("Pandoc NOT found", ["pandoc"]), ("pandoc not found", ["ffmpeg"]), ("ffmpeg not found, pandoc not found", ["ffmpeg", "pandoc"]), ("fine", ["pandoc"])]
    df = spark.createDataFrame(rows, "m string, a array<string>")
    assert [r[0] for r in df.select(batch.classify_error(F.col("m"), F.col("a"))).collect()] == ["pandoc", None, "pandoc", None]


def test_election(spark):
    cases = {
        1: (["file", "raw_image", "text"], "file"), 2: (["raw_image", "text"], "raw_image"), 3: (["document", "text"], "document"),
        4: (["text", "image"], "text"), 5: (["image", "markup"], "image"), 6: (["markup"], "markup"), 7: ([], None),
    }
    rows = [(i, k, k in present) for i, (present, _) in cases.items() for k in catalog.REPRESENTATION_ORDER]
    got = batch.elect_representation(spark.createDataFrame(rows, "item_id int, kind string, present boolean"))
    assert {r.item_id: r.kind for r in got.collect()} == {i: want for i, (_, want) in cases.items()}
    plain = batch.elect_representation(spark.createDataFrame(rows, "item_id int, kind string, present boolean"), catalog.PLAIN_REPRESENTATION_ORDER)
    assert {r.item_id: r.kind for r in plain.collect()} == {1: "file", 2: "raw_image", 3: None, 4: "image", 5: "image", 6: None, 7: None}


def test_type_rules(spark):
    reps = spark.createDataFrame([(1, "image/png"), (1, "com.adobe.pdf"), (2, "public.html"), (3, "x/y")], "item_id int, mime string")
    got = {(r.item_id, r.mapped_ext, r.kind) for r in batch.map_types(reps, catalog.type_rules(spark)).collect()}
    assert got == {(1, "png", "raw_image"), (1, "pdf", "document"), (2, "html", "markup")}


def test_engine_election(spark):
    found = spark.createDataFrame([(1, "typst", 5), (1, "xelatex", 1), (2, "typst", 5)], "host int, engine string, place int")
    got = batch.elect(found, ["host"], ["place"], ["engine"]).collect()
    assert {tuple(r) for r in got} == {(1, "xelatex"), (2, "typst")}
    assert catalog.ENGINE_ORDER[1] == "xelatex"


def test_dedupe_and_renumber(spark):
    rows = [("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)]
    df = spark.createDataFrame(rows, "path string, ord long")
    kept = batch.dedupe_paths(df, ["ord"])
    assert {tuple(r) for r in kept.collect()} == {("b", 1), ("a", 2), ("c", 4)}
    left = kept.filter("path <> 'a'").withColumn("batch", F.lit(1))
    placed = ranks.ordinals(left, ["batch"], ["ord"], [ranks.seq_block(F.col("ord"))])
    assert {(r.path, r.ordinal) for r in placed.collect()} == {("b", 1), ("c", 2)}


def test_results_and_summary(spark):
    rows = [(1, 0, "/a", None), (1, 1, "/b", "boom"), (2, 0, "/c", None)]
    planned = spark.createDataFrame(rows, "batch_id int, ord int, path string, error string")
    results = batch.item_results(planned, F.concat("path", F.lit(".out")))
    assert all((r.output_path is None) != (r.error is None) for r in results.collect())
    summary = {r.batch_id: (r.items, r.ok, r.failed, r.exit_status) for r in batch.batch_summary(results).collect()}
    assert summary == {1: (2, 1, 1, 1), 2: (1, 1, 0, 0)}
    assert [r.path for r in batch.in_input_order(results, ["batch_id", "ord"]).collect()] == ["/a", "/b", "/c"]


def test_fallback_runs_only_where_needed(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, v string")
    seen = spark.sparkContext.accumulator(0)

    def fallback(rest):
        seen.add(rest.count())
        return rest.select("id", F.lit("fb").alias("v"))

    got = batch.with_fallback(df, "id", "v", lambda d: d, fallback).collect()
    assert {tuple(r) for r in got} == {(1, "x", "primary"), (2, "fb", "fallback"), (3, "fb", "fallback")}
    assert seen.value == 2


def test_unpivot(spark):
    wide = spark.createDataFrame([("t", ("u1", "bin"), None), ("s", None, ("u2", "dir"))],
                                 "tool string, lx struct<url:string,mode:string>, win struct<url:string,mode:string>")
    got = batch.unpivot_manifest(wide, ["tool"], ["lx", "win"]).select("tool", "platform", "entry.url").collect()
    assert {tuple(r) for r in got} == {("t", "lx", "u1"), ("s", "win", "u2")}
