"""Chunking and rewriting, against a plain loop."""

import random

from pyspark.sql import functions as F

from foliograph.operators import chunks


def plain_chunks(text, limit):
    """The rule as a loop over characters of paragraphs, for comparison."""
    if len(text) <= limit:
        return [text]
    out, current, fenced = [], "", False
    for paragraph in text.split("\n\n"):
        if sum(line.lstrip().startswith("```") for line in paragraph.split("\n")) % 2:
            fenced = not fenced
        if not fenced and current and len(current) + len(paragraph) + 2 > limit:
            out.append(current.strip())
            current = paragraph
        else:
            current = current + "\n\n" + paragraph if current else paragraph
    return out + [current.strip()] if current.strip() else out


def cut(spark, texts, limit, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = chunks.chunk_text(df, limit, **options).orderBy("id", "pos").collect()
    return [[r.chunk for r in got if r.id == i] for i in range(len(texts))]


def test_fixtures(spark):
    fence = "intro text\n\n```py\ncode one\n\ncode two\n```\n\nafter the fence"
    cases = [" short ", "aaaa\n\nbbbb", "aaaa\n\nbbbbb", "x" * 30, "a\n\n" + "y" * 30 + "\n\nb", " \n\n \n\n          ", fence, "\n\n\n\naaaa\n\nbbbb\n\n"]
    assert cut(spark, cases, 10) == [plain_chunks(c, 10) for c in cases]
    assert cut(spark, ["aaaa\n\nbbbb"], 10) == [["aaaa\n\nbbbb"]]
    assert cut(spark, ["aaaa\n\nbbbbb"], 10) == [["aaaa", "bbbbb"]]


def test_break_before_the_closing_fence(spark):
    text = "```\n" + "a" * 10 + "\n\n" + "b" * 10 + "\n```\n\ntail"
    assert cut(spark, [text], 12) == [["```\n" + "a" * 10, "b" * 10 + "\n```", "tail"]]
    assert cut(spark, [text], 12, strict_fences=True) == [["```\n" + "a" * 10 + "\n\n" + "b" * 10 + "\n```", "tail"]]


def test_random_texts(spark):
    rng = random.Random(3)
    parts = ["", " ", "ab", "é" * 5, "```", "  ```x\ny", "word " * 4, "\n", "z" * 25, "```\nq\n```", " "]
    texts = ["\n\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    for limit in (8, 20, 60):
        assert cut(spark, texts, limit) == [plain_chunks(t, limit) for t in texts]


def test_reassemble(spark):
    rows = [(1, 2, "c"), (1, 0, "a"), (1, 10, "k"), (1, 1, "b"), (2, 0, "x")]
    df = spark.createDataFrame(rows, "id int, pos int, chunk string")
    assert {r.id: r.text for r in chunks.reassemble(df, ["id"]).collect()} == {1: "a\n\nb\n\nc\n\nk", 2: "x"}


def test_rewrite(spark):
    df = spark.createDataFrame([(1, "para one\n\npara two"), (2, "bad\n\nfine<br>x<sup>"), (3, "a" * 9)], "id int, text string")

    def fn(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError
        return texts.str.replace("para", "PARA")

    got = {r.id: r.text for r in chunks.rewrite_corpus(df, fn, ["id"], max_chars=10, with_prompt=False).collect()}
    assert got == {1: "PARA one\n\nPARA two", 2: "bad\n\nfine x<sup></sup>", 3: "a" * 9}
    spread = chunks.rewrite_corpus(df, fn, ["id"], max_chars=10, with_prompt=False, partitions=3)
    assert {r.id: r.text for r in spread.collect()} == got


def test_prompt(spark):
    seen = chunks.chunk_text(spark.createDataFrame([(1, "body")], "id int, text string")).select(chunks.prompt(F.col("chunk"))).first()[0]
    assert "\n\nbody\n\n" in seen and seen.endswith("Fixed:")


def test_fences_behind_any_blank(spark):
    text = " ```\n" + "\n\n".join("word " * 100 for _ in range(3)) + "\n\n　```\n" + "\n\n".join("tail " * 60 for _ in range(3))
    plain = text.replace(" ", " ").replace("　", " ")
    df = spark.createDataFrame([(0, text), (1, plain)], "id int, text string")
    sizes = {}
    for r in chunks.chunk_text(df, 600).collect():
        sizes.setdefault(r.id, []).append(len(r.chunk))
    assert sizes[0] == sizes[1]


def test_fences_of_the_chunk_itself_stay(spark):
    """Only a fence that wraps an answer goes, not the one a chunk begins or ends with."""
    texts = ["text\n\n```", "```\ncode\n```", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, chunk string")
    told = lambda fn: [r.rewritten for r in chunks.rewrite_chunks(df, fn).orderBy("id").collect()]
    assert told(lambda t: t) == texts
    assert told(lambda t: "Fixed: " + t) == texts
    assert told(lambda t: "```markdown\n" + t + "\n```") == texts


def test_an_answer_is_not_cut_to_an_accepted_length(spark):
    """What a repeated text begins with again is no closing fence: the answer is too long and the chunk stays."""
    text = "```\n" + "a" * 122
    df = spark.createDataFrame([(0, text)], "id int, chunk string")
    row = chunks.rewrite_chunks(df, lambda t: "Fixed: " + (t * 3).str[:256]).first()
    assert (row.rewritten, row.accepted) == (text, False)
