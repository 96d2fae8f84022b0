"""Rule catalogues: YAML, JSON or parquet in, a flat rules table out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsentry.schemas import CATALOGUE_SCHEMA, RULE_FIELDS, RULE_SCHEMA

try:
    import yaml
except ImportError:  # optional
    yaml = None

# A rule file is written by hand; anything larger is not one.
MAX_RULE_FILE_BYTES = 16 * 1024 * 1024

_ZERO = {T.StringType(): "", T.BooleanType(): False, T.IntegerType(): 0}


def _value(rule: dict, field: T.StructField):
    value = rule.get(field.name)
    zero = _ZERO[field.dataType]
    return zero if value is None else type(zero)(value)


def catalogue_frame(spark: SparkSession, document: dict) -> DataFrame:
    """One nested row from a parsed rule file; missing keys take zero values."""
    groups = [
        {
            "group": str(entry.get("group") or ""),
            "rule": [
                {f.name: _value(rule, f) for f in RULE_FIELDS} for rule in entry.get("rule") or []
            ],
        }
        for entry in (document or {}).get("rules") or []
    ]
    # A JSON literal keeps the catalogue on the JVM: no Python worker starts for it.
    parsed = F.from_json(F.lit(json.dumps({"rules": groups})), CATALOGUE_SCHEMA)
    return spark.range(1, numPartitions=1).select(parsed["rules"].alias("rules"))


def flatten_catalogue(nested: DataFrame) -> DataFrame:
    """One row per rule, with the positions of its group and of the rule inside it."""
    groups = nested.select(F.posexplode("rules").alias("group_ord", "entry"))
    rules = groups.select(
        "group_ord",
        F.col("entry.group").alias("group"),
        F.posexplode("entry.rule").alias("rule_ord", "r"),
    )
    columns = {
        f.name: F.coalesce(F.col("r")[f.name], F.lit(_ZERO[f.dataType])) for f in RULE_FIELDS
    }
    return rules.select(
        "rule_ord",
        "group_ord",
        F.coalesce("group", F.lit("")).alias("group"),
        *[c.alias(name) for name, c in columns.items()],
    )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a rule catalogue; the extension tells YAML, JSON and parquet apart."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("yaml", "yml"):
        rules = flatten_catalogue(catalogue_frame(spark, _read_yaml(spark, path)))
    elif suffix == "json":
        rules = flatten_catalogue(
            spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path)
        )
    else:
        stored = spark.read.parquet(path)
        rules = flatten_catalogue(stored) if "rules" in stored.columns else stored.to(RULE_SCHEMA)
    return require_rules(rules)


def _read_yaml(spark: SparkSession, path: str) -> dict:
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read YAML rule files; use JSON instead")
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("length").collect()
    if len(sizes) != 1 or sizes[0]["length"] > MAX_RULE_FILE_BYTES:
        raise ValueError(f"{path} is not a single rule file of at most {MAX_RULE_FILE_BYTES} bytes")
    return yaml.safe_load(files.select("content").first()["content"].decode("utf-8")) or {}


def require_rules(rules: DataFrame) -> DataFrame:
    """Raise when a catalogue holds no rule."""
    if rules.isEmpty():
        raise ValueError("the rule catalogue is empty")
    return rules
