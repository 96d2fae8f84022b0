"""Text expressions. All of them are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space set, and the characters the result
# clean-up strips from both ends of a field.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CLEAN_CUTSET = "'\"()[]{} \n\r\t"


def trim_set(col: Column, chars: str) -> Column:
    """Strip every character of ``chars`` from both ends."""
    return F.btrim(col, F.lit(chars))


def trim_space(col: Column) -> Column:
    return trim_set(col, WHITE_SPACE)


def clean_field(col: Column) -> Column:
    """Strip quotes, brackets and blanks at the ends and unescape ``\\/``."""
    return F.replace(trim_set(col, CLEAN_CUTSET), F.lit("\\/"), F.lit("/"))


def count_newlines(col: Column) -> Column:
    return (F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit("")))).cast("long")


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often, and in whichever lambda, it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_totals(values: Column, block: int = 32, levels: int = 3) -> Column:
    """For each entry of an array of longs the sum of those before it.

    Folded by blocks, and over the blocks' sums: a plain fold copies all it has for every entry.
    """

    def fold(xs: Column, start: Column) -> Column:
        sums = F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, F.lit(1), F.size(xs))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def cut(xs: Column) -> Column:
        last = F.greatest(F.lit(0), (F.size(xs) - 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), last, F.lit(block)), lambda at: F.slice(xs, at + 1, F.lit(block)))

    def sums(xs: Column, level: int) -> Column:
        if level == 1:
            return fold(xs, F.lit(0).cast("long"))
        return with_value(
            cut(xs), lambda blocks: F.flatten(F.zip_with(blocks, sums(F.transform(blocks, total), level - 1), fold))
        )

    return with_value(values, lambda xs: sums(xs, levels))


def before_first(text: Column, needle: Column) -> Column:
    """The part of ``text`` in front of the first ``needle``; all of it when absent."""
    return F.call_function("substring_index", text, needle, F.lit(1))


def byte_position(prefix: Column) -> Column:
    """0-based byte offset right after ``prefix``."""
    return F.octet_length(prefix).cast("long")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes ``[start, end)`` of ``text``; a character cut at an edge becomes U+FFFD."""
    raw = F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))
    return F.make_valid_utf8(raw.cast("string"))


def contains_any(col: Column, words: list[str]) -> Column:
    """Case-sensitive test for any of ``words``; false for an empty list."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(col, F.lit(word))
    return hit


def sql_string(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keywords(words: list[str] | None) -> list[str]:
    """Trim and lower-case filter keywords and drop blank ones."""
    return [w.strip().lower() for w in words or [] if w.strip()]


def elide(col: Column, limit: int = 50, mark: str = "...") -> Column:
    """Cut values over ``limit`` bytes to ``limit`` bytes including ``mark``."""
    head = byte_slice(col, F.lit(0), F.lit(limit - len(mark)))
    return F.when(F.octet_length(col) > limit, F.concat(head, F.lit(mark))).otherwise(col)


def strip_extension(col: Column) -> Column:
    return F.regexp_replace(col, r"\.[^./]*$", "")


def extension(col: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col, r"(\.[^./]+)$", 1))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with two decimals; null for a whole of zero."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 2)


def megabytes(n: float) -> int:
    return int(n * 1024 * 1024)
