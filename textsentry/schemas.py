"""Column layouts shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# One detector as it appears inside a rule file.
RULE_FIELDS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("f_regex", T.StringType()),
        T.StructField("loaded", T.BooleanType()),
        T.StructField("engine", T.StringType()),
        T.StructField("sensitive", T.BooleanType()),
        T.StructField("context_left", T.IntegerType()),
        T.StructField("context_right", T.IntegerType()),
        T.StructField("sample_code", T.StringType()),
        T.StructField("s_regex", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("scope", T.StringType()),
    ]
)

# A rule file: groups of detectors.
CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField(
            "rules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("group", T.StringType()),
                        T.StructField("rule", T.ArrayType(RULE_FIELDS)),
                    ]
                )
            ),
        )
    ]
)

# The flat form every operator works on.
RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("group_ord", T.IntegerType()),
        T.StructField("group", T.StringType()),
        *RULE_FIELDS.fields,
    ]
)

# Finding columns that follow the id columns of the scanned table.
FINDING_FIELDS = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("match", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("sensitive", T.BooleanType()),
    ]
)

FINDING_COLUMNS = FINDING_FIELDS.fieldNames()

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
