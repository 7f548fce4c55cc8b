"""Text clean-up and the acceptance gate of the chunk rewriter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values: line break tags that turn into a space, in this order ---
BREAK_TAGS = ["<br/>", "<br />", "<BR/>", "<BR />", "<br>", "<BR>"]
BALANCED_TAGS = ["sup", "sub"]
# --- fixed values: the characters with the Unicode property White_Space ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    """Strip every Unicode white space, not only the blank."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def sanitize_br(text: Column) -> Column:
    return reduce(lambda c, tag: F.replace(c, F.lit(tag), F.lit(" ")), BREAK_TAGS, text)


def _occurrences(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def balance_tags(text: Column, tags: list[str] = BALANCED_TAGS) -> Column:
    """Append the closers a text lacks, one tag after the other."""
    missing = [
        F.repeat(F.lit(f"</{t}>"), F.greatest(_occurrences(text, f"<{t}>") - _occurrences(text, f"</{t}>"), F.lit(0)))
        for t in tags
    ]
    return F.concat(text, *missing)


def fix_headings(text: Column) -> Column:
    """``# 1.2 T`` becomes ``## 1.2 T``, ``# 1.2.3 T`` becomes ``### 1.2.3 T`` and so on to six."""
    for depth in range(2, 7):
        number = r"\d+" + r"\.\d+" * (depth - 1)
        text = F.regexp_replace(text, rf"(?m)^# ({number}) ", "#" * depth + " $1 ")
    return text


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def clean_candidate(candidate: Column, original: Column | None = None) -> Column:
    """Drop the code fence and the ``Fixed:`` label an answer may be wrapped in.

    With ``original``, fences that it begins with itself are no wrapper, and a fence at the end is one only if one was dropped in front.
    """
    bare = trim_space(candidate)
    lead, tail = r"^(?:```markdown)*(?:```)*", r"(?:```)+$"
    opened, closed = F.regexp_replace(bare, lead, ""), lambda c: F.regexp_replace(c, tail, "")
    if original is None:
        bare = closed(opened)
    else:
        own, wrapper = trim_space(original), F.regexp_extract(bare, lead, 0)
        wrapped = (wrapper != "") & (wrapper != F.regexp_extract(own, lead, 0))
        bare = F.when(wrapped, closed(opened)).otherwise(bare)
    return trim_space(F.regexp_replace(trim_space(bare), r"^Fixed:", ""))


def rewrite_budget(original: Column) -> Column:
    return F.greatest(F.char_length(original) * 2, F.lit(256))


def accept_rewrite(original: Column, candidate: Column, own_fences: bool = False) -> Column:
    """struct(text, accepted): the cleaned candidate if its length is plausible, else the original.

    With ``own_fences`` fences that wrap nothing stay.
    """
    cleaned = clean_candidate(candidate, original if own_fences else None)
    size, limit = F.char_length(cleaned), F.char_length(original)
    fits = (size > 0) & (size <= limit * 2) & (size >= F.floor(limit * 3 / 10))
    fits = F.coalesce(fits, F.lit(False))
    return F.struct(F.when(fits, cleaned).otherwise(original).alias("text"), fits.alias("accepted"))
