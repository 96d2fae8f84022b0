"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key inside each stratum (source), each gets its
fractional rank ``(rank - 1/2) / stratum size``, and the table sorted by that
fraction is cut into runs whose lengths differ by one at most. Every run then
holds each stratum in its share of the whole, to within a row or so.

Both ranks come from running totals over key buckets, so neither a stratum
with a third of all rows nor the table as a whole is sorted in one task. An id
that many rows share (null, say) has one key, and rows of small strata share few
fractions: the buckets of such keys and fractions are split again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm.common import (
    BUCKET_ROWS,
    STRATUM_ROWS,
    bucket_count,
    hex_bucket,
    running_total,
    salt_repeats,
    seeded_key,
    split_bucket,
)

SHARDS = 16
SEED = "shard"


def interleave(rows: DataFrame, stratum: str, id_col: str, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to narrow ``rows``.

    Null strata form one stratum, null ids sort as empty strings. Rows that
    agree in all columns are interchangeable; other ties are settled by the
    remaining columns, those of an id with more than ``STRATUM_ROWS`` rows at
    random. No rows give no rows. The added columns replace columns of the same name.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    rows, hot = salt_repeats(rows.select(*names), id_col)
    total = rows.count()
    buckets = bucket_count(total)
    ties = [c for c in names if c not in (stratum, id_col)]

    def keys(df: DataFrame, name: str) -> DataFrame:
        keyed = df.withColumn("_key", seeded_key(seed, F.col(name)))
        return keyed.withColumn("_kb", hex_bucket(F.col("_key"), bucket_count(total, STRATUM_ROWS)))

    keyed = keys(rows.withColumn("_one", F.lit(1).cast("long")), id_col).withColumn("_part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        listed = keys(hot, "_hot").select(F.col("_kb").alias("_bucket"), F.col("_key").alias("_value"), "_parts")
        keyed = split_bucket(keyed, "_kb", "_key", listed, lambda n: F.pmod(F.col("_salt"), n), "_part")
    sizes = rows.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_size"))
    ranked = running_total(keyed, [stratum], "_kb", ["_key", "_part", id_col, *ties], "_one", "_rank")
    placed = (
        ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
        .withColumn("_at", (F.col("_rank") - 0.5) / F.col("_size"))
        .withColumn("_ab", F.floor(F.col("_at") * buckets))
        .withColumn("_nth", F.lit(0).cast("long"))
    )
    # A fraction occurs once in a stratum at most, so few strata cannot fill a bucket with one.
    if sizes.count() > BUCKET_ROWS:
        shared = placed.groupBy(F.col("_ab").alias("_bucket"), F.col("_at").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        shared = shared.where(F.col("_n") > BUCKET_ROWS).withColumn("_parts", F.ceil(F.col("_n") / BUCKET_ROWS)).drop("_n")
        # Repeated ids share a key, too.
        spread = F.col("_key") if hot.isEmpty() else seeded_key(seed, F.col("_key"), F.col(stratum), F.col("_salt"))
        placed = split_bucket(placed, "_ab", "_at", shared, lambda n: hex_bucket(spread, n), "_nth")
    cut = running_total(placed, [], "_ab", ["_at", "_nth", "_key", stratum, id_col, *ties], "_one", "_pos")
    shard = F.expr(f"(_pos - 1) * {shards}L div {max(total, 1)}L")
    return (
        cut.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_pos") - 1 - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L"))
        .select(*names, "shard", "slot")
    )


def shard_documents(docs: DataFrame, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """The placement of every row of ``docs`` (doc_id, text, source).

    Null texts have size 1 and the checksum of nothing; further columns are
    ignored. Copies are ordinary rows: each gets a slot of its own.
    """
    rows = docs.select(
        "doc_id",
        F.col("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(rows, "source", "doc_id", seed, shards)
