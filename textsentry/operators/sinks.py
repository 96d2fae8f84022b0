"""Write findings as JSON lines or CSV, whole or one folder per rule group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

JSON, CSV = "json", "csv"

# Everything quoted and blanks kept, so that any field survives a round trip.
_CSV_WRITE = {
    "header": True,
    "quoteAll": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_CSV_READ = {**_CSV_WRITE, "multiLine": True, "emptyValue": "", "nullValue": "\x00"}
_CSV_READ.pop("quoteAll")


def output_path(base: str, fmt: str = JSON) -> str:
    """Folder for one output: ``base`` without its extension, then the format."""
    head, _, name = base.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return f"{head}/{stem}/format={fmt}" if head else f"{stem}/format={fmt}"


def write(
    findings: DataFrame, base: str, fmt: str = JSON, split_by_group: bool = False
) -> str:
    """Write and return the folder. No findings give an empty, readable dataset.

    Findings are few and inherit the partitions of the texts, so they are
    rebalanced into files of a sensible size first; a large group is split.
    """
    path = output_path(base, fmt)
    if fmt not in (JSON, CSV):
        raise ValueError(f"unknown output format {fmt!r}")
    out = findings
    if fmt == CSV:
        out = out.select([F.col(c).cast("string").alias(c) for c in out.columns])
    if split_by_group:
        # The partition column leaves the files, so the rows keep a copy of it.
        out = out.withColumn("rule_group", F.col("group"))
    out = out.hint("rebalance", F.col("rule_group")) if split_by_group else out.hint("rebalance")
    writer = out.write.mode("overwrite")
    if split_by_group:
        writer = writer.partitionBy("rule_group")
    if fmt == CSV:
        writer.options(**_CSV_WRITE).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
    return path


def read_back(spark: SparkSession, path: str, schema: StructType, fmt: str = JSON) -> DataFrame:
    """Read one output folder with the columns that were written."""
    if fmt == CSV:
        return spark.read.schema(schema).options(**_CSV_READ).csv(path).select(schema.fieldNames())
    return spark.read.schema(schema).json(path).select(schema.fieldNames())
