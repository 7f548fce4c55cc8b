"""Long texts in chunks: splitting, rewriting, putting together."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from foliograph.catalog import CHUNK_CHARS
from foliograph.functions.text import WHITE_SPACE, accept_rewrite, balance_tags, rewrite_budget, sanitize_br, trim_space

# a line that opens or closes a fence, after any blanks
FENCE_LINE = "(?md)^[" + WHITE_SPACE.replace("\n", "") + "]*```"

PROMPT_HEAD = (
    "Correct the Markdown that follows. Repair heading levels, fence code blocks with their language, "
    "rejoin words hyphenated at a line break and set bare formulas in dollar signs. "
    "Leave every other line as it is.\n\n"
)
PROMPT_TAIL = "\n\nFixed:"
ANSWER_BOUND = 16  # characters a token of the budget stands for, at most


def chunk_text(
    df: DataFrame,
    max_chars: int = CHUNK_CHARS,
    sep: str = "\n\n",
    text: str = "text",
    strict_fences: bool = False,
) -> DataFrame:
    """Cut a text at paragraph ends into chunks of about ``max_chars``: adds pos and chunk.

    A chunk takes paragraphs until the next one would not fit. Inside a code fence no cut is
    made, except right before the paragraph that closes it; ``strict_fences`` rules that out
    too. A text that fits stays one chunk as it is, others are trimmed; a paragraph larger
    than ``max_chars`` is kept whole.

    The fold carries only numbers (where chunks start, the running size, the fence state),
    texts are sliced once at the end, and nothing leaves the map stage.
    """
    parts = F.transform(
        "_paras",
        lambda p, i: F.struct(
            i.alias("at"),
            F.char_length(p).alias("n"),
            (F.regexp_count(p, F.lit(FENCE_LINE)) % 2 == 1).alias("toggles"),
        ),
    )
    start = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).alias("size"), F.lit(False).alias("fenced")
    )

    def take(acc: Column, p: Column) -> Column:
        fenced = acc["fenced"] != p["toggles"]
        closed = ~fenced & ~acc["fenced"] if strict_fences else ~fenced
        cut = closed & (acc["size"] > 0) & (acc["size"] + p["n"] + len(sep) > max_chars)
        return F.struct(
            F.when(cut, F.concat(acc["starts"], F.array(p["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(cut | (acc["size"] == 0), p["n"]).otherwise(acc["size"] + p["n"] + len(sep)).alias("size"),
            fenced.alias("fenced"),
        )

    short = F.char_length(text) <= max_chars
    cut_up = df.withColumn("_paras", F.when(~short, F.split(text, re.escape(sep)))).withColumn(
        "_starts", F.when(~short, F.aggregate(parts, start, take, lambda acc: acc["starts"]))
    )
    paras, starts = F.col("_paras"), F.col("_starts")
    sliced = F.transform(
        starts,
        lambda s, j: trim_space(
            F.array_join(F.slice(paras, s + 1, F.coalesce(F.get(starts, j + 1), F.size(paras)) - s), sep)
        ),
    )
    # only the last chunk may turn out blank, and then it is left out
    kept = F.filter(sliced, lambda c, j: (c != "") | (j < F.size(starts) - 1))
    chunks = F.when(short, F.array(text)).otherwise(kept)
    rest = [c for c in df.columns if c != text]
    return cut_up.select(*rest, F.posexplode(chunks).alias("pos", "chunk"))


def reassemble(chunks: DataFrame, keys: list[str], sep: str = "\n\n", chunk: str = "chunk") -> DataFrame:
    """Join the chunks of each text in order. A group is one text, a single value anyway."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(chunk).alias("chunk"))))
    return chunks.groupBy(*keys).agg(F.array_join(ordered["chunk"], sep).alias("text"))


def prompt(chunk: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), chunk, F.lit(PROMPT_TAIL))


def rewriter(fn: Callable[..., pd.Series]):
    """``fn`` as an Arrow function of the asked texts and their budgets. Where it raises, rows are tried one by one and those
    that raise again answer NULL, which the acceptance gate turns into the original.

    Whatever ``fn`` answers, no more than ``ANSWER_BOUND`` budgets of characters leave the task: longer answers are NULL.
    """

    def bounded(answers: pd.Series, budgets: pd.Series) -> pd.Series:
        fits = [isinstance(a, str) and len(a) <= ANSWER_BOUND * b for a, b in zip(answers, budgets)]
        return pd.Series([a if ok else None for a, ok in zip(answers, fits)], dtype=object)

    try:
        takes_budget = len(inspect.signature(fn).parameters) > 1
    except (TypeError, ValueError):  # no Python function
        takes_budget = False
    ask = fn if takes_budget else lambda texts, budgets: fn(texts)

    @F.pandas_udf(StringType())
    def answers(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        budgets = budgets.fillna(0).astype("int64")
        try:
            return bounded(ask(texts, budgets), budgets)
        except Exception:
            single = [_single(ask, text, budget) for text, budget in zip(texts, budgets)]
            return bounded(pd.Series(single, dtype=object), budgets)

    return answers


def _single(ask: Callable[..., pd.Series], text: str | None, budget: int) -> str | None:
    try:
        return ask(pd.Series([text]), pd.Series([budget])).iloc[0]
    except Exception:
        return None


def rewrite_chunks(
    chunks: DataFrame, fn: Callable[..., pd.Series], asked: str = "chunk", partitions: int | None = None
) -> DataFrame:
    """Add ``rewritten`` and ``accepted``. ``fn`` sees the column ``asked`` and, if it takes a second argument, the budget of each
    chunk: how many tokens it may answer with. Fences that do not wrap the whole answer are kept.

    With ``partitions`` the chunks are spread over that many tasks first, which pays when
    ``fn`` is slow and few texts hold most chunks.
    """
    spread = chunks.repartition(partitions, "chunk") if partitions else chunks
    answered = spread.withColumn("_answer", rewriter(fn)(F.col(asked), rewrite_budget(F.col("chunk"))))
    gate = answered.withColumn("_gate", accept_rewrite(F.col("chunk"), F.col("_answer"), own_fences=True))
    return gate.withColumn("rewritten", F.col("_gate.text")).withColumn(
        "accepted", F.col("_gate.accepted")
    ).drop("_answer", "_gate")


def rewrite_corpus(
    df: DataFrame,
    fn: Callable[..., pd.Series],
    keys: list[str],
    max_chars: int = CHUNK_CHARS,
    with_prompt: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Clean, chunk, rewrite and put together the column ``text``: one shuffle in all. ``fn`` is asked as in ``rewrite_chunks``."""
    cleaned = df.select(*keys, balance_tags(sanitize_br(F.col("text"))).alias("text"))
    chunks = chunk_text(cleaned, max_chars)
    if with_prompt:
        chunks = chunks.withColumn("prompt", prompt(F.col("chunk")))
    asked = "prompt" if with_prompt else "chunk"
    rewritten = rewrite_chunks(chunks, fn, asked, partitions)
    return reassemble(rewritten, keys, chunk="rewritten")
