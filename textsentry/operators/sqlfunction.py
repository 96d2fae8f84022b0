"""A pack of rules as a SQL function, for use in any statement of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textsentry.functions.text import WHITE_SPACE, sql_string
from textsentry.operators.rules import RuleError
from textsentry.operators.scan import MAX_UNROLLED, MIN_MATCH_BYTES, ODD_CASE_LETTERS, _extract_sql
from textsentry.schemas import FINDING_FIELDS

_ROW = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in FINDING_FIELDS.fields)


def _finding_sql(rule: dict) -> str:
    """The finding of a match ``m``, located where its text first occurs in ``t``."""
    before = "substring_index(t, m, 1)"
    start = f"octet_length({before})"
    left, right = max(rule["context_left"], 0), max(rule["context_right"], 0)
    begin = f"greatest(0, {start} - {left})"
    end = f"least(octet_length(t), {start} + octet_length(m) + {right})"
    around = f"make_valid_utf8(CAST(substring(CAST(t AS BINARY), {begin} + 1, {end} - {begin}) AS STRING))"
    fields = {
        "group": sql_string(rule["group"]),
        "rule_name": sql_string(rule["name"]),
        "match": "m",
        "context": around if left or right else "m",
        "position": f"CAST({start} AS BIGINT)",
        "line_number": f"CAST(1 + {start} - octet_length(replace({before}, '\\n', '')) AS BIGINT)",
        "sensitive": str(bool(rule["sensitive"])).lower(),
    }
    return "named_struct(" + ", ".join(f"'{f.name}', {fields[f.name]}" for f in FINDING_FIELDS.fields) + ")"


def function_sql(pack: list[dict], name: str) -> str:
    """The statement that makes ``name``; texts are read once per rule whose gate they pass."""
    odd = " OR ".join(f"contains(t, {sql_string(x)})" for x in ODD_CASE_LETTERS)
    long_enough = f"octet_length(btrim(m, {sql_string(WHITE_SPACE)})) > {MIN_MATCH_BYTES}"
    per_rule = []
    for rule in pack:
        found = _extract_sql(rule, "t").replace("__lower", "lower(t)").replace("__odd", f"({odd})")
        per_rule.append(f"transform(filter(coalesce({found}, array()), m -> {long_enough}), m -> {_finding_sql(rule)})")
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRUCT<{_ROW}>> "
        f"RETURN flatten(array({', '.join(per_rule)}))"
    )


def register_scan(spark: SparkSession, pack: list[dict], name: str = "scan_text") -> None:
    """Make ``name(text)`` return the findings of a prepared pack in a text, as an array; null for a null text.

    In SQL: ``SELECT id, inline(found) FROM (SELECT id, scan_text(text) AS found FROM docs)``;
    Spark does not let a generator take a SQL function directly.
    """
    if not pack or len(pack) > MAX_UNROLLED:
        raise RuleError(f"a SQL function takes 1 to {MAX_UNROLLED} rules")
    spark.sql(function_sql(pack, name))
