"""Post-processing of findings: clean-up, blocklist, output keys and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.functions.text import clean_field, contains_any
from textsentry.schemas import FINDING_COLUMNS

_CLEANED = ("match", "context", "group", "rule_name")


def clean(findings: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """Strip quotes, brackets and blanks from the text fields, string ids included."""
    types = dict(findings.dtypes)
    ids = [c for c in id_cols or [] if types[c] == "string"]
    return findings.withColumns({c: clean_field(F.col(c)) for c in (*ids, *_CLEANED)})


def block(findings: DataFrame, words: list[str]) -> DataFrame:
    """Drop findings whose match holds any of the words; case counts."""
    return findings.where(~contains_any(F.col("match"), words)) if words else findings


def block_counts(findings: DataFrame, words: list[str]) -> DataFrame:
    """Number of findings before and after the blocklist."""
    return findings.agg(
        F.count("*").alias("before"),
        F.count_if(~contains_any(F.col("match"), words)).alias("after"),
    )


def select_keys(findings: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Keep the chosen columns in the chosen order; ``file`` stands for the id columns."""
    allowed = {"file", *id_cols, *FINDING_COLUMNS}
    unknown = [k for k in keys if k not in allowed]
    if unknown:
        raise ValueError(f"unknown output keys {unknown}; choose from {sorted(allowed)}")
    if not keys:
        return findings
    chosen = [c for k in keys for c in (id_cols if k == "file" else [k])]
    return findings.select(*dict.fromkeys(chosen))


def group_findings(findings: DataFrame, field: str, id_cols: list[str]) -> DataFrame:
    """Findings per bucket of ``field`` and match text, with their number.

    Fields are ``group``, ``rule_name`` and ``file``; any other puts all rows in
    one bucket named by the empty string. A bucket stays spread over rows, so
    one that holds most findings is never gathered in a task.
    """
    if field in ("group", "rule_name"):
        bucket = F.col(field)
    elif field == "file":
        bucket = F.concat_ws("/", *id_cols)
    else:
        bucket = F.lit("")
    return findings.groupBy(bucket.alias("bucket"), "match").agg(F.count("*").alias("n"))
