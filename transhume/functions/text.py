"""Text expressions: lines, paths, previews, pattern tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from transhume.values import TRUNCATE_LIMIT, TRUNCATE_MARKER

# Line ends: \R covers \r\n as one, \n \v \f \r, U+0085, U+2028, U+2029; the separators
# U+001C..U+001E end a line too.
LINE_END = r"\R|[\x1c-\x1e]"
LINE_END_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def java_regex(pattern: str) -> str:
    r"""Flags that give Java the intended reading: ``^`` only after \n, Unicode \b \w \s."""
    return "(?mdU)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def contains_any(text: Column, literals: Iterable[str]) -> Column:
    test = F.lit(False)
    for literal in literals:
        test = test | F.contains(text, F.lit(literal))
    return test


def matches(text: Column, pattern: str, hints: Iterable[str] = ()) -> Column:
    """Regex test, run only on the texts a literal search lets through."""
    test = text.rlike(java_regex(pattern))
    hints = tuple(hints)
    return contains_any(text, hints) & test if hints else test


def replacement_text(text: str) -> str:
    """Escape the two characters that are special in a regex replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def ends_line(text: Column) -> Column:
    """Whether the last character ends a line; looks at the last bytes only."""
    test = F.lit(False)
    for char in LINE_END_CHARS:
        test = test | text.endswith(char)
    return test


def line_count(text: Column) -> Column:
    """Number of lines; a line end at the very end opens no further line."""
    closed = (text == "") | ends_line(text)
    return F.regexp_count(text, F.lit(LINE_END)) + F.when(closed, 0).otherwise(1)


def lines(text: Column) -> Column:
    """The lines without their ends, as an array; empty for an empty text."""
    size = F.length(text)
    body = (
        F.when(text.endswith("\r\n"), F.left(text, size - 2))
        .when(ends_line(text), F.left(text, size - 1))
        .otherwise(text)
    )
    # Most texts have no other line end than \n, and splitting by that alone takes no regular expression.
    others = contains_any(body, LINE_END_CHARS[1:])
    split = F.when(others, F.split(body, LINE_END, -1)).otherwise(F.split(body, "\n", -1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(split)


def newline_count(text: Column) -> Column:
    without = F.replace(text, F.lit("\n"), F.lit(""))
    return F.coalesce(F.length(text) - F.length(without), F.lit(0))


def base_name(path: Column) -> Column:
    return F.coalesce(F.substring_index(path, "/", -1), F.lit(""))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]+$", "")


def owner_from_path(path: Column) -> Column:
    """The user folder, else the first folder; ``unknown`` without a path."""
    parts = F.split(F.btrim(path, F.lit("/")), "/", -1)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.when((parts[0] == "Users") & (F.size(parts) >= 2), parts[1]).otherwise(parts[0])
    )


def truncate_middle(
    text: Column, limit: int = TRUNCATE_LIMIT, marker: str = TRUNCATE_MARKER
) -> Column:
    head, tail = int(limit * 0.6), int(limit * 0.4)
    cut = F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def preview(text: Column, size: int = 1000, ellipsis: str = "...") -> Column:
    head = F.left(text, F.lit(size))
    return F.when(F.length(text) > size, F.concat(head, F.lit(ellipsis))).otherwise(text)
