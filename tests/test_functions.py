"""Column functions on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions import documents, paths, text, timecodes
from foliograph.operators import references


def test_path_ext(apply):
    cases = {"/a/b.PNG": "png", "x.tar.gz": "gz", "/a/.bashrc": "", "noext": "", "/a.b/c": "", "..a": "a", "a.": "", "/d/f.txt/": "txt"}
    assert apply(paths.path_ext, list(cases)) == list(cases.values())


def test_normalize_ext(apply):
    cases = {"jpeg": "jpg", "yml": "yaml", "tif": "tiff", "markdown": "md", "latex": "tex", "heif": "heic", "png": "png", "": ""}
    assert apply(paths.normalize_ext, list(cases)) == list(cases.values())


def test_output_path(apply):
    inputs = ["/in/a.b.png", "a.png", "/a.png", "/x//a.png", "/in/.hidden"]
    beside = apply(lambda c: paths.output_path(c, F.lit("latex")), inputs)
    assert beside == ["/in/a.b.tex", "a.tex", "/a.tex", "/x/a.tex", "/in/.hidden.tex"]
    assert apply(lambda c: paths.output_path(c, F.lit("pdf"), "/out"), inputs[:2]) == ["/out/a.b.pdf", "/out/a.pdf"]


def test_suffixed_path(apply):
    trim = lambda c: paths.suffixed_path(c, "-trim")
    assert apply(trim, ["/home/user/interview.mp3", "/home/user/x", "/h/A.MP3"]) == [
        "/home/user/interview-trim.mp3", "/home/user/x-trim", "/h/A-trim.MP3"]
    assert apply(lambda c: paths.suffixed_path(c, "-trim", out_dir="/o/"), ["/h/i.mp3"]) == ["/o/i-trim.mp3"]
    assert apply(lambda c: paths.suffixed_path(c, "-merged", F.lit("pdf")), ["/h/i.x.pdf"]) == ["/h/i.x-merged.pdf"]


def test_percent_decode(apply):
    cases = {"a%20b": "a b", "plain": "plain", "%zz": "%zz", "%E4%B8%AD": "中", "abc%": "abc%", "abc%2": "abc%2", "%2f": "/",
             "a+b": "a+b", "%FFx": "�x", "%25zz": "%zz"}
    assert apply(paths.percent_decode, list(cases)) == list(cases.values())


def test_file_ref(apply):
    cases = [
        (b"file:///a/b.txt", "/a/b.txt"), (b" file:///a%20b\x00", "/a b"), (b"file:///a \n", "/a"), (b"http://x", None),
        (b"bplist\x00\xfffile:///q.png\x00tail", "/q.png"), (b"\xfexfile:///q\xff", "/q"),
    ]
    got = apply(lambda c: paths.file_ref(paths.lossy_text(c)), [bytearray(c) for c, _ in cases], "binary")
    assert got == [want for _, want in cases]


def test_break_tags(apply):
    raw = "a<br>b<br/>c<br />d<BR>e<BR/>f<BR />g<Br>h<br  >i"
    assert apply(text.sanitize_br, [raw, "<br<br/>/>"]) == ["a b c d e f g<Br>h<br  >i", " "]


def test_balance_tags(apply):
    cases = {"<sup>a<sup>b</sup>": "<sup>a<sup>b</sup></sup>", "a</sup>": "a</sup>", "<sub>x<sup>y": "<sub>x<sup>y</sup></sub>", "": ""}
    assert apply(text.balance_tags, list(cases)) == list(cases.values())


def test_headings(apply):
    raw = "# 1 One\n# 1.1 Two\n# 1.1.1 Three\n## 1.1 Kept\nx # 1.1 y\n# 1.1.1.1 Four"
    assert apply(text.fix_headings, [raw]) == ["# 1 One\n## 1.1 Two\n### 1.1.1 Three\n## 1.1 Kept\nx # 1.1 y\n#### 1.1.1.1 Four"]


def test_dehyphenate(apply):
    assert apply(text.dehyphenate, ["auto-\nmatic", "Jean-\nPaul", "a -\nb"]) == ["automatic", "Jean-\nPaul", "a -\nb"]


@pytest.mark.parametrize(
    "original, candidate, want, accepted",
    [
        ("abcdefghij", "", "abcdefghij", False),
        ("abcdefghij", None, "abcdefghij", False),
        ("abcdefghij", "x" * 20, "x" * 20, True),
        ("abcdefghij", "x" * 21, "abcdefghij", False),
        ("abcdefghij", "xxx", "xxx", True),
        ("abcdefghij", "xx", "abcdefghij", False),
        ("hello world", "```markdown\nhello there\n```", "hello there", True),
        ("hello world", "``````hello there``````\n", "hello there", True),
        ("hello world", "Fixed: hello there", "hello there", True),
        ("hello world", "Fixed: Fixed: hi there", "Fixed: hi there", True),
        ("hello world", " hello ", "hello", True),
        ("a", "b", "b", True),
    ],
)
def test_accept_rewrite(spark, original, candidate, want, accepted):
    row = spark.createDataFrame([(original, candidate)], "o string, c string")
    got = row.select(text.accept_rewrite(F.col("o"), F.col("c")).alias("g")).first().g
    assert (got.text, got.accepted) == (want, accepted)


def test_rewrite_budget(apply):
    assert apply(text.rewrite_budget, ["a", "b" * 200]) == [256, 400]


def test_time_to_secs(apply):
    cases = {"90": 90.0, "1:30": 90.0, "1:02:03.5": 3723.5, "0:75": 75.0, "a:b": None, "1:2:3:4": None, "1d": None, "0x1p3": None,
             " 2 ": 2.0, "1: 2": None, "": None, "1:": None, ".5": 0.5, "5.": 5.0, "1e2": 100.0, "-3": -3.0, " 7\n": 7.0, "1\n2": None}
    assert apply(timecodes.time_to_secs, list(cases)) == list(cases.values())


def test_secs_to_time(apply):
    cases = {0.0: "0:00", 59.9: "0:59", 75.0: "1:15", 3599.0: "59:59", 3600.0: "1:00:00", 36005.7: "10:00:05"}
    assert apply(timecodes.secs_to_time, list(cases), "double") == list(cases.values())


def test_banner(apply):
    cases = {"  Duration: 00:01:02.50, start: 0": 62.5, "Duration: N/A, bitrate": None, "Duration: 1:2": None, "x": None, "Duration: 1:x:2,": None}
    assert apply(timecodes.banner_duration, list(cases)) == list(cases.values())
    assert apply(timecodes.is_banner, list(cases)) == [True, False, False, False, True]


def test_progress(apply):
    lines = ["out_time_us=5000000", "out_time_us= 99000000 ", "out_time_us=N/A", "frame=1"]
    assert apply(lambda c: timecodes.progress_percent(c, F.lit(10.0)), lines) == [50.0, 100.0, None, None]
    assert apply(lambda c: timecodes.progress_percent(c, F.lit(0.0)), lines[:1]) == [None]
    assert apply(timecodes.is_progress_kv, ["frame=1", "out_time_us=2", "Error=3", "=x", "a b=c", "plain"]) == [
        True, True, False, False, False, False]


def test_bar(apply):
    cases = {"45%": 45.0, "Layout: 100%|##": 100.0, "p 7.5%": 7.5, "12345%": 2345.0, "%": None, "none": None, "a 5 %": None, "é9%": 9.0}
    assert apply(timecodes.bar_percent, list(cases)) == list(cases.values())
    assert apply(timecodes.bar_progress, ["50%"]) == [54.0]


def test_stage(apply):
    assert apply(timecodes.stage_percent, ["Loading: LOAD MODEL", "texify and Surya", "nothing"]) == [5.0, 14.0, None]


def test_json_validity(apply):
    good = ['{"a":1}', " [1, 2] ", "null", '"x"', "1.50", '{"a":1,"a":2}', "[]"]
    bad = ['{"a":1} x', "[1]] x", "1,2", "1],[2", '1,"x"],["y"', "", " ", "[1,2,]", "[NaN]", "{a:1}", '1}, {"x":1', "tru"]
    assert apply(documents.is_json, good) == [True] * len(good)
    assert apply(documents.is_json, bad) == [False] * len(bad)
    last = apply(lambda c: F.to_json(documents.strict_json(c)), ['{"a":1,"a":2}', "1,2", "null"])
    assert last == ['{"a":2}', None, "null"]


def test_shapes(apply):
    cases = {"{}": "object", '[{"a":1},2]': "array_of_objects", "[]": "empty_array", "[1,{}]": "array", "5": "scalar", '"[]"': "scalar", "null": "scalar"}
    assert apply(lambda c: documents.shape_of(documents.strict_json(c)), list(cases)) == list(cases.values())


def test_csv_line(apply):
    cells = [["a", "b"], ["a,b", 'say "x"'], ["l\nm", ""], [""], ["", ""], [" pad "]]
    assert apply(documents.csv_line, cells, "array<string>") == ["a,b", '"a,b","say ""x"""', '"l\nm",', '""', ",", " pad "]


def test_sniff(apply):
    cases = {
        '{"key": "value"}': "json", "[1, 2, 3]": "json", '[section]\nkey = "value"\n': "toml", "<?xml version='1'?><a>b</a>": "xml",
        "<a><b>c</b></a>\n": "xml", "key: value\nother: x": "txt", "a,b\n1,2": "txt", "Note: this is prose": "txt", "": "txt", "  \n": "txt",
        "<not really xml>": "txt", "{not valid json}": "txt", '{"a":1} x': "txt", "[1]] x": "txt", "a = b c": "txt", "# only a comment": "txt",
        "x = 1": "toml", "[]": "json", "[a]": "toml", '  {"a": 1}  ': "json", " <a></a> ": "xml", "n = 1\r\nm = 2\r\n": "toml",
    }
    assert apply(documents.sniff_format, list(cases)) == list(cases.values())
    assert apply(documents.sniff_format, [None]) == [None]


def test_sniff_of_prose_that_is_toml(apply):
    """Keys may have blanks around their dots and comments may follow values, so a word or two with a secret can be a TOML document."""
    toml = ['token = "ab"', 'This. token = "ab"', 'A. B. token = "ab"', 'token = "ab"### La', '# c\ntoken = "ab"']
    txt = ['Erö. token = "ab"', 'token = "ab" This.', 'This is. token = "ab"', 'This. token = "ab"\nmore']
    assert apply(documents.sniff_format, toml + txt) == ["toml"] * len(toml) + ["txt"] * len(txt)


def test_json_with_half_a_character(apply):
    """Escapes of surrogates come in pairs, by the parser and by the reduction of texts beyond its size."""
    high, low = r"\ud83d", r"\ude00"
    good = [f'"{high}{low}"', r'"\\ud800"', rf'"\u00e9{high}{low}\n"', rf'["\\{high}{low}", "\\\\ud800"]', '"😀"']
    bad = [f'"{high}"', f'"{low}"', f'"{high}{high}{low}"', f'"{high}{low}{low}"', f'"{high}x{low}"', rf'["\\{high}"]', f'{{"{low}": 1}}', rf'"{high.upper().replace("U", "u")}\{low}"']
    want = [True] * len(good) + [False] * len(bad)
    assert apply(documents.is_json, good + bad) == want
    assert apply(documents.is_json_by_reduction, good + bad) == want
    assert apply(lambda c: documents.strict_json(c).isNotNull(), good + bad) == want
    assert apply(documents.sniff_format, [f"[{t}]" for t in good + bad[:-1]]) == ["json"] * len(good) + ["txt"] * (len(bad) - 1)


def test_resolve_refs(spark):
    known = spark.createDataFrame([("/in/a b.txt",), ("/in/c.pdf",)], "path string")
    cases = {
        " file:///in/a%20b.txt\n": ("/in/a b.txt", None), "/in/c.pdf\n": ("/in/c.pdf", None), "/in/none.pdf": (None, "txt"),
        "/in/c.pdf\nmore": (None, "txt"), "in/c.pdf": (None, "txt"), '{"a": 1}': (None, "json"), "file:///gone": (None, "txt"),
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.i: (r.path, r.format) for r in references.resolve_refs(texts, known).collect()}
    assert got == dict(enumerate(cases.values()))


def test_texts_over_the_parsers_limits(spark):
    big = '["' + "x" * 21_000_000 + '"]'
    records = "[" + '{"a": [1, -2.5e3, "b\\n\\u00e9"], "c": {"d": null}},' * 500_000 + "true]"
    df = spark.createDataFrame([(0, big), (1, big + "]"), (2, "[1]"), (3, records), (4, records.replace("true]", "tru e]")), (5, big.replace("xx]", 'x\\q]'))], "id int, text string")
    column = F.col("text")
    value = documents.strict_json(column)
    got = df.select("id", documents.sniff_format(column).alias("f"), documents.is_json(column).alias("j"), documents.json_error(column, value).alias("e"))
    rows = {r.id: (r.f, r.j, r.e) for r in got.collect()}
    assert rows.pop(3) in [("json", True, None), ("json", True, "JSON document too large")]
    bad = ("txt", False, "Invalid JSON")
    assert rows == {0: ("json", True, "JSON document too large"), 1: bad, 2: ("json", True, None), 4: bad, 5: ("json", True, "JSON document too large")}


@pytest.mark.parametrize("seed", range(3))
def test_reduction_agrees_with_the_parser(spark, seed):
    rng = random.Random(seed)
    scalars = ["1", "-0", "0.5", "-1e5", "2E-3", "01", "1.", ".5", "+1", "- 1", "1 2", "true", "tru", "nul l", "null", '""', '"a"', '"\\n"', '"\\x"', '"\\u12aF"', '"\\u12"', '"a\nb"', "'a'", "a", "\\n", '"\x01"', "\x02", '"ü"', '"\\"', '"\\\\"', "NaN"]

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(scalars[:1] * 20 + scalars)
        parts = [make(depth - 1) for _ in range(rng.randrange(4))]
        if kind < 0.6:
            return rng.choice(["[", "[", "[ ", "{"]) + rng.choice([",", ", ", ","]).join(parts) + rng.choice(["]"] * 8 + [",]", "", "]]"])
        return "{" + ",".join(f'"k{i}"{rng.choice([":"] * 9 + [",", ""])}{p}' for i, p in enumerate(parts)) + rng.choice(["}"] * 8 + ["]", ",}"])

    texts = [make(4) for _ in range(600)] + scalars + ["", " ", "[" * 900 + "]" * 900, "[" * 900 + "]" * 899, ' {"a" : [ ] , "b":\t{}}\n', "[1,]", "[,1]", "{,}", '{"a"}', "{1:2}", "[]]", "[] []"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", documents.is_json(F.col("t")).alias("a"), documents.is_json_by_reduction(F.col("t")).alias("b")).collect()
    assert [r.t for r in got if r.a != r.b] == [] and 20 < sum(r.a for r in got) < len(got) - 20


def test_paths_with_line_breaks(apply):
    names = ["/in/a\nb.png", "a.png\n", "/x\ny/c", "/x/.b\n"]
    assert apply(paths.path_ext, names) == ["png", "png\n", "", ""]
    out = apply(lambda c: paths.output_path(c, F.lit("pdf")), names)
    assert out == ["/in/a\nb.pdf", "a.pdf", "/x\ny/c.pdf", "/x/.b\n.pdf"]
