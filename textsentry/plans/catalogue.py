"""A rule catalogue derived from the ``part`` table, one detector per part.

It gives the rule operators an input that grows with the data and holds every
case they tell apart: rules that are off, nameless, without pattern or sample,
with a broken pattern, of every engine, and group names that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsentry.schemas import RULE_FIELDS, RULE_SCHEMA

# The same expressions, spelled for both engines: a part's brand is its group,
# its size the position of the group, its price decides whether the rule is on.
RULE_EXPRESSIONS = {
    "rule_ord": "CAST(p_partkey AS INT)",
    "group_ord": "p_size",
    "group": "p_brand",
    "name": "CASE WHEN p_size = 7 THEN '' ELSE p_name END",
    "f_regex": (
        "CASE WHEN p_size = 11 THEN '' "
        "WHEN p_size = 13 THEN concat('(', p_name) "
        "WHEN p_size = 17 THEN concat('(?P<word>', replace(p_name, ' ', '|'), ')') "
        "WHEN p_size = 19 THEN concat('^', upper(p_name)) "
        "WHEN p_size < 30 THEN replace(p_name, ' ', '.{0,20}') "
        "ELSE concat('(', replace(p_name, ' ', '[a-z -]*)(?:'), ')+[^0-9]{0,40}', p_type) END"
    ),
    "loaded": "p_retailprice < 990",
    "engine": (
        "CASE WHEN p_size < 10 THEN 'nfa' WHEN p_size < 15 THEN 'dfa' WHEN p_size < 20 THEN 'java' "
        "WHEN p_size < 30 THEN 'go' WHEN p_size < 48 THEN '' ELSE 'other' END"
    ),
    "sensitive": "p_type IN ('ECONOMY', 'PROMO')",
    "context_left": "p_size - 25",
    "context_right": "CASE WHEN p_size > 40 THEN 10 ELSE 0 END",
    "sample_code": "CASE WHEN p_size = 23 THEN '' ELSE concat(p_name, ' / ', p_type) END",
    "s_regex": "''",
    "format": "''",
    "color": "''",
    "scope": "''",
}

CATALOGUE_SQL = (
    "SELECT "
    + ", ".join(f'{expr} AS "{name}"' for name, expr in RULE_EXPRESSIONS.items())
    + " FROM part"
)

# Rules per entry when the catalogue is nested like a rule file.
_ENTRY = 100


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        [F.expr(expr).alias(name) for name, expr in RULE_EXPRESSIONS.items()]
    ).to(RULE_SCHEMA)


def nested_catalogue(rules: DataFrame) -> DataFrame:
    """Rule-file layout: one row per part of a group, each with a bounded number of rules."""
    rule = F.struct(*RULE_FIELDS.fieldNames())
    return (
        rules.groupBy("group", F.expr(f"rule_ord DIV {_ENTRY}").alias("entry"))
        .agg(F.collect_list(rule).alias("rule"))
        .select(F.array(F.struct("group", "rule")).alias("rules"))
    )
