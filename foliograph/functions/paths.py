"""Paths, extensions, output names and file references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliograph.catalog import EXT_ALIASES
from foliograph.functions.text import trim_space


def file_name(path: Column) -> Column:
    """Last component; trailing slashes do not count."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def path_ext(path: Column) -> Column:
    """Lower-cased extension, '' when there is none (dotfiles have none)."""
    return F.lower(raw_ext(path))


def raw_ext(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?s)\A.+\.([^.]*)\z", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)\A(.+)\.[^.]*\z", "$1")


def parent_prefix(path: Column) -> Column:
    """Parent folder with its closing slash, '' for a bare name."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)\A(.*/)?[^/]+/*\z", 1), r"/+\z", "/")


def dir_prefix(folder: Column) -> Column:
    return F.when((folder == "") | folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))


def normalize_ext(ext: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in EXT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, ext), ext)


def _folder(path: Column, out_dir: Column | str | None) -> Column:
    if out_dir is None:
        return parent_prefix(path)
    chosen = F.lit(out_dir) if isinstance(out_dir, str) else out_dir
    return F.coalesce(dir_prefix(chosen), parent_prefix(path))


def output_path(path: Column, target: Column, out_dir: Column | str | None = None) -> Column:
    """Folder (or the parent) + stem + '.' + extension of the target."""
    ext = F.when(target == "latex", F.lit("tex")).otherwise(target)
    return F.concat(_folder(path, out_dir), path_stem(path), F.lit("."), ext)


def suffixed_path(
    path: Column, suffix: str, ext: Column | None = None, out_dir: Column | str | None = None
) -> Column:
    """``stem + suffix + .ext``; without ``ext`` the path's own one, and no dot when empty."""
    chosen = raw_ext(path) if ext is None else ext
    tail = F.when(chosen == "", F.lit("")).otherwise(F.concat(F.lit("."), chosen))
    return F.concat(_folder(path, out_dir), path_stem(path), F.lit(suffix), tail)


def percent_decode(text: Column) -> Column:
    """Decode %XX; broken escapes and '+' stay, bad UTF-8 turns into U+FFFD."""
    guarded = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def file_ref(payload: Column) -> Column:
    """Path of the first ``file://`` reference in a text, NULL when there is none.

    The reference ends at a NUL or a replacement character, which is where a binary
    wrapper resumes. Cast binary payloads with ``lossy_text`` first.
    """
    found = F.regexp_extract(payload, "(?s)file://([^\\x00\\uFFFD]*)", 1)
    return F.when(F.contains(payload, F.lit("file://")), percent_decode(trim_space(found)))


def lossy_text(payload: Column) -> Column:
    return F.make_valid_utf8(payload.cast("string"))
