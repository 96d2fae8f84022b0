"""Regex expressions on Spark's built-in (Java) regex functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsentry.functions.text import sql_string

# Every pattern is multi-line and case-insensitive, and only "\n" ends a line.
# Rules of the backtracking engine get Unicode classes, rules of the linear one
# ASCII classes.
JAVA_FLAGS = "(?dmiU)"
GO_FLAGS = "(?dmiu)"

# Accepted engine names.
BACKTRACKING_ENGINES = ("nfa", "dfa", "java")
LINEAR_ENGINE = "go"

# Syntax a linear-time engine rejects: lookaround, atomic and conditional groups,
# backreferences, \u escapes, possessive repeats.
NON_LINEAR_SYNTAX = r"\(\?(?:=|!|<=|<!|>|\()|\\[1-9]|\\k|\\u|[*+?}]\+"

# POSIX class names and their Java property names.
POSIX_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}

NEVER = "(?!)"


def to_java(column: str) -> Column:
    """The pattern in ``column`` with group and class spellings Java does not know rewritten."""
    out = f"replace(`{column}`, '(?P<', '(?<')"
    for pattern, spelled in ((r"\(\?P=(\w+)\)", r"\\k<$1>"), (r"\\k'(\w+)'", r"\\k<$1>")):
        out = f"regexp_replace({out}, {sql_string(pattern)}, {sql_string(spelled)})"
    for posix, java in POSIX_CLASSES.items():
        out = f"replace({out}, '[:{posix}:]', {sql_string(f'\\p{{{java}}}')})"
    return F.expr(out)


def compiled_or_null(pattern: Column) -> Column:
    """The pattern itself when it compiles, else null; evaluated on the executors."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)


def resolve_engine(engine: Column, pattern: Column) -> Column:
    """``java`` or ``go`` for a known engine name; null for an unknown one.

    An empty name picks the linear flags unless the pattern needs backtracking.
    """
    automatic = F.when(F.rlike(pattern, F.lit(NON_LINEAR_SYNTAX)), "java").otherwise("go")
    return (
        F.when(engine.isin(*BACKTRACKING_ENGINES), "java")
        .when(engine == LINEAR_ENGINE, "go")
        .when(engine == "", automatic)
    )


def with_flags(engine: Column, pattern: Column) -> Column:
    return F.concat(F.when(engine == "go", GO_FLAGS).otherwise(JAVA_FLAGS), pattern)


def match_any(text: Column, pattern: Column) -> Column:
    return F.rlike(text, pattern)


def match_first(text: Column, pattern: str) -> Column:
    """First match, or null when there is none."""
    hit = match_any(text, F.lit(pattern))
    return F.when(hit, F.regexp_extract(text, pattern, 0))


def match_all(text: Column, pattern: Column, n: int = 0) -> Column:
    """Non-overlapping matches in order; the first ``n`` of them when ``n`` is positive."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.slice(found, 1, n) if n > 0 else found


def match_groups(text: Column, pattern: Column, groups: int) -> Column:
    """One struct per match: ``g0`` is the match, ``g1`` ... ``gN`` the last capture of each group.

    Null for a text without a match: every group costs a pass of its own, so
    those texts get one pass only.
    """
    fields = ",".join(f"g{i}:string" for i in range(groups + 1))
    parts = [F.regexp_extract_all(text, pattern, F.lit(i)) for i in range(groups + 1)]
    zipped = F.arrays_zip(*parts).cast(f"array<struct<{fields}>>")
    return F.when(match_any(text, pattern), zipped)


# What a pattern is cut into to find its groups: quoted text, escapes, classes, brackets, repeats.
_TOKENS = re.compile(
    r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|(?P<open>\((?!\?)|\(\?P?<[A-Za-z]\w*>)"
    r"|(?P<plain>\()|(?P<close>\))(?P<repeat>(?:[*+]|\{\d+(?:,\d*)?\})[+?]?)?|.",
    re.DOTALL,
)
_NAME = re.compile(r"\((?:\?P?<[A-Za-z]\w*>)")


def repeated_part(pattern: str, group: int) -> tuple[str, str, int]:
    """How to find all captures of a group within a repeat.

    Returns the pattern with a group around the innermost repeat that holds
    ``group`` (or is it), one round of that repeat, and how many groups come
    before it. Backreferences are refused, as groups are renumbered.
    """
    if re.search(r"\\(?:[1-9]|k)|\(\?P=", pattern):
        raise ValueError("a pattern with backreferences has no capture history")
    stack, number, path = [], 0, None
    loops = []
    for token in _TOKENS.finditer(pattern):
        if token["open"] or token["plain"]:
            stack.append((token.start(), number))
            number += bool(token["open"])
            if token["open"] and number == group:
                path = {start for start, _ in stack}
        elif token["close"] and stack:
            start, before = stack.pop()
            if path is not None and start in path and token["repeat"]:
                loops.append((start, token.end("close"), token.end(), before))
    if not loops:
        raise ValueError(f"group {group} of {pattern!r} is not repeated")
    start, body, end, before = loops[0]
    bare = _NAME.sub("(", pattern[start:body])
    around = f"{_NAME.sub('(', pattern[:start])}({bare}{pattern[body:end]}){_NAME.sub('(', pattern[end:])}"
    return around, bare, before


def capture_history(match: Column, pattern: str, group: int = 1, flags: str = JAVA_FLAGS) -> Column:
    """All captures of a repeated group in ``match``, in order, for a match of ``pattern``.

    Java keeps the last capture only. The span of the repeat is cut out of the
    match first; its rounds are then matched one by one, each from where the last
    ended and so that the rest can still be filled with rounds.
    """
    around, round_, before = repeated_part(pattern, group)
    span = F.regexp_extract(match, f"{flags}\\A(?:{around})\\z", before + 1)
    each = f"{flags}\\G(?:{round_})(?=(?:{round_})*\\z)"
    return F.regexp_extract_all(span, F.lit(each), F.lit(group - before))
