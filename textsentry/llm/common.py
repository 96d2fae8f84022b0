"""Helpers the operators share: distributed running totals, row keys and hex digests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsentry.session import broadcast_if_small, materialise

# Rows a bucket of a running total holds on average; a stratum with few rows fills its buckets less.
BUCKET_ROWS = 4096
STRATUM_ROWS = 1024


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded_key(seed: str, *parts: Column) -> Column:
    """32 hex digits that order rows at random, the same in every run."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *text))


def bucket_count(rows: int, each: int = BUCKET_ROWS) -> int:
    return max(16, -(-rows // each))


def hex_bucket(key: Column, buckets: int | Column) -> Column:
    """The bucket of a hex key; buckets are in key order and about equally full."""
    number = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.floor(F.conv(F.substring(key, 1, 12), 16, 10).cast("long") * number / F.lit(float(16**12)))


def salt_repeats(rows: DataFrame, id_col: str, each: int = STRATUM_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``_salt``, and the ids that more than ``each`` rows have (``_hot``, ``_parts``).

    Rows of one id share a key and so a bucket; the salt tells them apart. It is
    written down with the rows, so that a task run again sees the same one; a
    table without such an id is not written. Of ``each`` rows one id at most is listed.
    """
    counts = rows.groupBy(F.col(id_col).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > each)
    hot = materialise(counts.select("_hot", F.ceil(F.col("_n") / each).alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.withColumn("_salt", F.lit(0).cast("long")), hot
    return materialise(rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "salted"), hot


def split_bucket(
    df: DataFrame, bucket: str, value: str, hot: DataFrame, part: Callable[[Column], Column], out: str
) -> DataFrame:
    """Split ``bucket`` around and within the values that too many rows share.

    ``hot`` lists them: ``_bucket``, ``_value``, ``_parts``. ``bucket`` becomes three
    numbers that rise with ``value`` and ``out``: itself, the place among its hot
    values, and ``out``, which is ``part(parts)`` for a hot value and 0 for others.
    """
    hot = hot.groupBy("_bucket", "_value").agg(F.max("_parts").alias("_parts"))
    lists = hot.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("_value", "_parts"))).alias("_hots"))
    own = F.filter("_hots", lambda h: h["_value"] == F.col(value))
    below = F.size(F.filter("_hots", lambda h: h["_value"] < F.col(value)))
    marked = df.join(broadcast_if_small(lists), df[bucket] == F.col("_bucket"), "left")
    marked = marked.withColumn(
        "_own", F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda a, h: h["_parts"]), F.lit(0))
    )
    number = F.when(F.col("_own") > 0, part(F.col("_own"))).otherwise(F.lit(0)).cast("long")
    place = F.when(F.col("_hots").isNull(), 0).otherwise(2 * below) + (F.col("_own") > 0).cast("int")
    return (
        marked.withColumn(out, number)
        .withColumn(bucket, F.struct(F.col(bucket).alias("b"), place.alias("p"), F.col(out).alias("s")))
        .drop("_hots", "_own", "_bucket")
    )


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running_total(
    df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str
) -> DataFrame:
    """Add ``out``, the inclusive running total of ``value`` in ``order`` within ``groups``.

    A group may hold any share of the rows: totals per bucket are summed first
    (few rows), and only the rows of one bucket are ever sorted together.
    ``bucket`` must rise with ``order``. Nulls in ``groups`` form a group.
    """
    keys = [*groups, bucket]
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_before")
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, on)
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_before", *[f"_o_{k}" for k in keys])
    )
