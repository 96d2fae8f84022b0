"""Statistics over raw findings: partial aggregates, then one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_RULES = 5


def overview(findings: DataFrame, id_cols: list[str]) -> DataFrame:
    """Findings, sensitive findings, distinct texts and distinct groups in one row.

    The only shuffle that grows with the data carries one row per text, with the
    few group names the text hit. From there counts fold into one row per group.
    """
    per_text = findings.groupBy(*id_cols).agg(
        F.count("*").alias("n"),
        F.count_if("sensitive").alias("s"),
        F.collect_set("group").alias("hit"),
    )
    # Only the first group of a text brings its counts along.
    first = F.col("i") == 0
    per_group = (
        per_text.select("n", "s", F.posexplode("hit").alias("i", "group"))
        .groupBy("group")
        .agg(
            F.sum(F.when(first, F.col("n"))).alias("n"),
            F.sum(F.when(first, F.col("s"))).alias("s"),
            F.count_if(first).alias("files"),
        )
    )
    return per_group.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in (("n", "total"), ("s", "sensitive"), ("files", "files"))
        ],
        F.count("*").alias("groups"),
    )


def by_group(findings: DataFrame) -> DataFrame:
    return findings.groupBy("group").agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    """Findings per rule name, whatever the group."""
    return findings.groupBy("rule_name").agg(F.count("*").alias("n"))


def sorted_rules(findings: DataFrame) -> DataFrame:
    """Rules by falling count; ties go by name."""
    return by_rule(findings).orderBy(F.desc("n"), "rule_name")


def top_rules(findings: DataFrame, n: int = TOP_RULES) -> DataFrame:
    return sorted_rules(findings).limit(n)


def files_with_findings(findings: DataFrame, id_cols: list[str]) -> DataFrame:
    return findings.select(*id_cols).distinct()
