"""Cut large texts into pieces that are scanned on their own.

Cuts are made on byte offsets moved forward to the next character, so one
chunk costs one slice of the bytes however far into the text it lies. All of it
happens inside the row: no shuffle, and line numbers come from a running sum
over the row's own chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsentry.functions.text import count_newlines, megabytes

# Texts above the threshold are cut into chunks of this size.
DEFAULT_THRESHOLD_MB = 5
CHUNK_BYTES = 1024 * 1024
# Bytes of the text around a chunk that its piece holds on either side.
OVERLAP_BYTES = 64 * 1024


def _char_start(raw: Column, at: Column) -> Column:
    """First character boundary at or behind byte ``at``: skip up to three continuation bytes."""
    ahead = F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(3)))
    skipped = F.length(F.regexp_extract(ahead, "^(?:[89AB][0-9A-F])*", 0)) / 2
    return (at + skipped).cast("long")


def chunk_texts(
    texts: DataFrame,
    id_cols: list[str],
    text_col: str = "text",
    *,
    threshold_mb: float = DEFAULT_THRESHOLD_MB,
    chunk_bytes: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
    spread_chunks: bool = False,
) -> DataFrame:
    """``id_cols, chunk_idx, start_offset, start_line, own_from, own_to, text`` for every text.

    Texts at or below the threshold (all of them when it is zero) stay whole. A
    piece holds ``overlap`` bytes more than its chunk on either side, from
    ``start_offset`` on; the chunk's own bytes are ``own_from`` to ``own_to``. A
    match that starts there is the chunk's, so every match shorter than the
    overlap is found once, whole, wherever the text is cut. ``spread_chunks`` shuffles the chunks
    over the cluster, for tables in which a few texts hold most of the bytes.
    """
    # All chunks of a text pass through one array, so offsets are taken first
    # and the pieces are cut from the bytes one by one.
    size = F.octet_length(text_col)
    large = (size > megabytes(threshold_mb)) if threshold_mb > 0 else F.lit(False)
    last = F.when(large, F.floor((size - 1) / chunk_bytes)).otherwise(0).cast("int")
    raw = F.col("__raw")
    total = F.octet_length(raw)

    def bound(i: Column) -> Column:
        return F.least(_char_start(raw, i.cast("long") * chunk_bytes), total.cast("long"))

    def piece(start: Column, end: Column) -> Column:
        return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")

    cut = (
        texts.select(*id_cols, F.col(text_col).cast("binary").alias("__raw"), last.alias("__last"))
        .withColumn(
            "__starts",
            F.when(F.col("__last") == 0, F.array(F.lit(0).cast("long"))).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("__last")), bound)
            ),
        )
        .withColumn(
            "__ends",
            F.concat(
                F.slice("__starts", F.lit(2), F.size("__starts")), F.array(total.cast("long"))
            ),
        )
        .withColumn("__from", F.transform("__starts", lambda a: _char_start(raw, F.greatest(F.lit(0).cast("long"), a - overlap))))
        .withColumn(
            "__lines",
            F.when(F.col("__last") == 0, F.array(F.lit(1).cast("long"))).otherwise(
                F.aggregate(
                    F.arrays_zip(F.col("__from").alias("a"), F.slice("__from", F.lit(2), F.size("__from")).alias("z")),
                    F.array(F.lit(1).cast("long")),
                    lambda acc, c: F.concat(
                        acc, F.array(F.element_at(acc, -1) + count_newlines(piece(c["a"], c["z"])))
                    ),
                )
            ),
        )
    )
    chunks = cut.select(
        *id_cols,
        "__raw",
        F.posexplode_outer(F.arrays_zip("__starts", "__ends", "__lines", "__from")).alias("chunk_idx", "__c"),
    ).where(F.col("__c.__starts").isNotNull() & F.col("__c.__ends").isNotNull())
    first, start, end = F.col("__c.__from"), F.col("__c.__starts"), F.col("__c.__ends")
    out = chunks.select(
        *id_cols,
        "chunk_idx",
        first.alias("start_offset"),
        F.col("__c.__lines").alias("start_line"),
        (start - first).alias("own_from"),
        (end - first).alias("own_to"),
        piece(first, F.least(total.cast("long"), _char_start(raw, end + overlap))).alias("text"),
    )
    return out.repartition(*id_cols, "chunk_idx") if spread_chunks else out
