"""Rule validation and the rule self-test.

Both look at the pattern as written: letter case counts and the engine field is
ignored, although the scan itself ignores case and honours the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.functions import regex
from textsentry.functions.text import percent
from textsentry.operators.rules import MAX_RULES, RuleError, compile_rules, loops


# The longest sample a pattern with a group loop is tried on.
SAMPLE_CHARS = 1000


def _probe(rules: DataFrame) -> DataFrame:
    """Loaded rules with ``raw`` (the compiled pattern or null) and ``hits`` (sample matches).

    A pattern that might exhaust Java's stack is not run on a long sample; that
    rule does not hit.
    """
    linear = regex.resolve_engine(F.lit(""), F.col("f_regex")) == "go"
    flags = F.when(linear, "(?d)").otherwise("(?dU)")
    raw = regex.compiled_or_null(F.concat(flags, regex.to_java("f_regex")))
    harmless = (F.length("sample_code") <= SAMPLE_CHARS) | ~loops(F.col("f_regex"))
    hits = F.when(
        F.col("raw").isNotNull() & (F.col("sample_code") != "") & harmless,
        F.rlike(F.col("sample_code"), F.coalesce("raw", F.lit(regex.NEVER))),
    )
    return rules.where("loaded").withColumn("raw", raw).withColumn("hits", hits)


def validate(rules: DataFrame) -> DataFrame:
    """One row per loaded rule with its status; a missing sample is only a warning."""
    status = (
        F.when(F.col("name") == "", "missing_name")
        .when(F.col("f_regex") == "", "missing_regex")
        .when(F.col("raw").isNull(), "compile_error")
        .when(F.col("sample_code") == "", "no_sample")
        .when(F.col("hits"), "ok")
        .otherwise("sample_mismatch")
    )
    return (
        compile_rules(_probe(rules))
        .withColumn("status", status)
        .select(
            "group_ord",
            "rule_ord",
            "group",
            "name",
            "status",
            F.col("status").isin("ok", "no_sample").alias("valid"),
            F.col("compile_ok").alias("scan_compile_ok"),
        )
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("checked"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("status") == "no_sample").alias("warnings"),
    )


def require_valid(rules: DataFrame) -> DataFrame:
    """Raise when any loaded rule is invalid, naming them; a pack holds at most ``MAX_RULES``."""
    bad = validate(rules).where(~F.col("valid")).orderBy("group_ord", "rule_ord").limit(MAX_RULES).collect()
    if bad:
        named = ", ".join(f"[{r['group']}:{r['name']}] {r['status']}" for r in bad)
        raise RuleError(f"found {len(bad)} invalid rules: {named}")
    return rules


def self_test(rules: DataFrame) -> DataFrame:
    """One row per loaded rule: ``valid``, ``no_sample`` or ``compile_error`` with a reason."""
    reason = (
        F.when(F.col("raw").isNull(), "pattern does not compile")
        .when(F.col("sample_code") == "", "no sample")
        .when(~F.col("hits"), "sample does not match")
        .otherwise("")
    )
    status = (
        F.when(F.col("reason") == "", "valid")
        .when(F.col("reason") == "no sample", "no_sample")
        .otherwise("compile_error")
    )
    return (
        _probe(rules)
        .withColumn("reason", reason)
        .select("group", "name", status.alias("status"), "reason")
    )


def self_test_summary(tested: DataFrame) -> DataFrame:
    """Counts, percentages and the verdict of a self-test."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    total = F.col("total_rules")
    verdict = (
        F.when(F.col("valid") == total, "passed")
        .when(F.col("valid") > F.col("compile_error") + F.col("no_sample"), "mostly passed")
        .otherwise("failed")
    )
    counts = tested.agg(
        F.count("*").alias("total_rules"),
        n("valid").alias("valid"),
        n("no_sample").alias("no_sample"),
        n("compile_error").alias("compile_error"),
    )
    return counts.select(
        "*",
        *[
            percent(F.col(c), total).alias(f"{c}_pct")
            for c in ("valid", "no_sample", "compile_error")
        ],
        verdict.alias("verdict"),
    )
