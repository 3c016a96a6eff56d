"""Expressions over error messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import tables
from .urlparts import WHITESPACE, as_column, each, keep, sql_text, trim_space

MAX_LINE = 150
MAX_LINES = 8


_FILES = sql_text(r"(?<![\w-])(?<![\w-]/)(?:[a-zA-Z0-9_-]++/)*+([\w-]+\.(?:go|js|html|css|json))")
_LONG_URL = sql_text(r"(?=https?://)(\S{30})\S{11,}(\S{20})")
_FIRST_LINES = rf"\A(?:[{WHITESPACE}]*+[^\n]++(?:\n|\z)){{0,%d}}+"  # blank lines are passed over


def shorten_sql(max_line: int) -> str:
    """SQL over ``s``, one line: file names for paths, short URLs, a bounded length.

    A pattern is tried only on a line that has a piece which every match of it has.
    """
    has_file = " OR ".join(f"contains(s, '{ending}')" for ending in (".go", ".js", ".html", ".css"))  # .js is in .json
    return (
        f"transform(transform(array(CASE WHEN {has_file} THEN regexp_replace(s, {_FILES}, '$1') ELSE s END), "
        f"s -> CASE WHEN contains(s, '://') THEN regexp_replace(s, {_LONG_URL}, '$1...$2') ELSE s END), "
        f"t -> CASE WHEN length(t) <= {max_line} THEN t ELSE concat(substr(t, 1, {max_line - 3}), '...') END)[0]"
    )


def truncate(text: Column, size: int | Column) -> Column:
    """At most ``size`` characters, the last three being dots where text was cut."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substr(text, F.lit(1), size - 3), F.lit("...")))


def error_digest(message: Column | str, max_line: int = MAX_LINE, max_lines: int = MAX_LINES) -> Column:
    """A message cut to its essence: file names for paths, short URLs, short lines, few lines.

    What follows the last line that counts is cut off first, so a long message costs what its first lines do.
    """
    first = F.regexp_extract(as_column(message), _FIRST_LINES % max(max_lines, 0), 0)
    lines = keep(each(F.split(first, "\n", -1), f"s -> btrim(s, {sql_text(WHITESPACE)})"), "s -> s <> ''")
    return trim_space(F.array_join(each(F.slice(lines, 1, max_lines), f"s -> {shorten_sql(max_line)}"), "\n"))


def is_cancellation(message: Column | str) -> Column:
    text = F.lower(as_column(message))
    hit = F.lit(False)
    for phrase in tables.CANCEL_PHRASES:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit
