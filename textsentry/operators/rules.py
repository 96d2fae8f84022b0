"""Rule selection, listing and compilation on the flat rules table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.functions import regex
from textsentry.functions.nesting import open_rounds
from textsentry.functions.text import elide, keywords
from textsentry.session import broadcast_if_small
from textsentry.sources.equivalents import FILTERS, GATES, SAFE_FORMS

DEFAULT_CONTEXT = 50

# Most rules a scan accepts: the pack is held in memory.
MAX_RULES = 20_000

# Rounds of repeated groups a match may have open at once. Java's regex recurses once per
# round, and a stack overflow ends the whole executor.
SAFE_ROUNDS = 64
LOOP_HINT = "repeats groups too often for Java's stack; make the repeat possessive, as in (...)*+"


class RuleError(ValueError):
    """A rule that cannot be used."""


def usable(rules: DataFrame) -> DataFrame:
    """Keep loaded rules with a name and a pattern."""
    return rules.where("loaded AND name <> '' AND f_regex <> ''")


def _keyword_filter(rules: DataFrame, column: str, words: list[str] | None) -> DataFrame:
    wanted = keywords(words)
    if not wanted:
        return rules
    hit = F.lit(False)
    for word in wanted:
        hit = hit | F.contains(F.lower(F.col(column)), F.lit(word))
    return rules.where(hit)


def by_group(rules: DataFrame, words: list[str] | None) -> DataFrame:
    """Keep rules whose group holds any keyword, whatever its case; blank keywords do not count."""
    return _keyword_filter(rules, "group", words)


def by_name(rules: DataFrame, words: list[str] | None) -> DataFrame:
    return _keyword_filter(rules, "name", words)


def sensitive_only(rules: DataFrame) -> DataFrame:
    return rules.where("sensitive")


def fill_context(rules: DataFrame) -> DataFrame:
    """Sensitive rules with no width on either side get the default width on both."""
    bare = F.col("sensitive") & (F.col("context_left") <= 0) & (F.col("context_right") <= 0)

    def filled(name: str) -> Column:
        return F.when(bare, DEFAULT_CONTEXT).otherwise(F.col(name)).alias(name)

    return rules.withColumns(
        {name: filled(name) for name in ("context_left", "context_right")}
    )


def last_group_wins(rules: DataFrame) -> DataFrame:
    """Of groups sharing a name keep the last one.

    The per-name maximum is a partial aggregate, so one name holding most rules
    is no hot spot.
    """
    last = rules.groupBy("group").agg(F.max("group_ord").alias("group_ord"))
    return rules.join(broadcast_if_small(last), ["group", "group_ord"], "left_semi").select(
        rules.columns
    )


def select_rules(
    rules: DataFrame,
    groups: list[str] | None = None,
    names: list[str] | None = None,
    only_sensitive: bool = False,
) -> DataFrame:
    """The rules a scan will use: filters first, then context defaults, then duplicate groups."""
    kept = by_name(by_group(usable(rules), groups), names)
    if only_sensitive:
        kept = sensitive_only(kept)
    return last_group_wins(fill_context(kept))


def listing(rules: DataFrame) -> DataFrame:
    """``group: name: pattern`` lines with long patterns cut."""
    line = F.concat_ws(": ", "group", "name", elide(F.col("f_regex")))
    return rules.select("group", "name", line.alias("line"))


def count_rules(rules: DataFrame) -> DataFrame:
    """Number of rules and of groups, from per-group partial counts."""
    return (
        rules.groupBy("group")
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rules"), F.count("*").alias("groups"))
    )


def _lookup(table: dict, kind: str, key: str) -> Column:
    """The entry of a literal map, or null; folded to a constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")[F.col(key)]


def loops(pattern: Column) -> Column:
    """Whether a pattern repeats groups, nested ones included, so often that Java might run out of stack."""
    return open_rounds(pattern) > SAFE_ROUNDS


def compile_rules(
    rules: DataFrame,
    gates: dict[str, list[str]] | None = None,
    forms: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``engine_resolved``, ``pattern``, ``keyword_gate``, ``unsafe`` and ``compile_ok``.

    ``gates`` adds words to look for before a pattern is tried: every match of
    the pattern must hold one of them in some letter case. They must be ASCII,
    for which the test knows all letters that fold to them. ``forms`` adds other
    spellings of patterns of the backtracking engine, for syntax Java does not
    have or loops it should not run; they must find the same matches.
    """
    if not all(word.isascii() for ws in (gates or {}).values() for word in ws):
        raise RuleError("gate words must be ASCII")
    words = {**GATES, **{p: [w.lower() for w in ws] for p, ws in (gates or {}).items()}}
    safe = _lookup({**SAFE_FORMS, **(forms or {})}, "string", "f_regex")
    gate = _lookup(words, "array<string>", "f_regex")
    engine = regex.resolve_engine(F.col("engine"), F.col("f_regex"))
    body = F.when(engine == "java", safe)
    return (
        rules.withColumn("engine_resolved", engine)
        .withColumn("keyword_gate", gate)
        .withColumn(
            "pattern",
            regex.with_flags(
                F.col("engine_resolved"), F.coalesce(body, regex.to_java("f_regex"))
            ),
        )
        .withColumn("unsafe", body.isNull() & loops(F.col("f_regex")))
        .withColumn("compile_ok", regex.compiled_or_null(F.col("pattern")).isNotNull())
    )


def verdict() -> Column:
    """What a scan makes of a compiled rule: ``ok`` or why it refuses it."""
    return (
        F.when(F.col("engine_resolved").isNull(), "unsupported engine")
        .when(~F.col("compile_ok"), "does not compile")
        .when(F.col("unsafe"), "unsafe loop")
        .otherwise("ok")
    )


def rule_pack(compiled: DataFrame) -> list:
    """The compiled rules as driver-side rows, checked.

    A pack is configuration, so it is small by nature; the bound is enforced.
    Rules that cannot be used, or could end an executor, are refused by name.
    """
    rows = (
        compiled.withColumn("verdict", verdict())
        .orderBy("group_ord", "rule_ord")
        .limit(MAX_RULES + 1)
        .collect()
    )
    if len(rows) > MAX_RULES:
        raise RuleError(f"a scan takes at most {MAX_RULES} rules")
    why = {
        "unsupported engine": lambda r: f"unsupported regex engine {r['engine']!r}",
        "does not compile": lambda r: "the pattern does not compile",
        "unsafe loop": lambda r: f"the pattern {LOOP_HINT}",
    }
    bad = [f"{why[r['verdict']](r)} [{r['group']}:{r['name']}]" for r in rows if r["verdict"] != "ok"]
    if bad:
        raise RuleError("; ".join(bad))
    return [{**r.asDict(), "filter": FILTERS.get(r["f_regex"])} for r in rows]
