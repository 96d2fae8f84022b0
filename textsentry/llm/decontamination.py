"""Benchmark decontamination by a prefix-filtered containment join.

The sets are the windows of benchmark items (13 consecutive words, or the whole
of a shorter item), their elements five-word shingles. Whole containment is
asked for, so the prefix a window must share with a document is one shingle,
and the rarest in the corpus makes the shortest posting list. Document shingles
are joined with these prefixes only; a pair gives the one place the window
could start at (positional bound), which must leave room for all its words
(length bound), and the words there are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHINGLE = 5
# Above this many item windows nothing is broadcast and the joins shuffle.
BROADCAST_ROWS = 200_000
# A document is contaminated if one word in this many is hit.
HIT_SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def plain(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null is empty.

    ``lower`` is cheaper and does the same to ASCII. Other texts must not go through it: what
    it makes of a letter can depend on those around it, beyond the ends of a word.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; null has none."""
    return F.array_remove(F.split(plain(text), _BETWEEN), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items`` (item_id, text) with the items that hold them."""
    words = items.select("item_id", words_of(F.col("text")).alias("_w")).where("size(_w) > 0")
    return (
        words.withColumn("_len", F.least(F.size("_w"), F.lit(window)))
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("_len"))))
        .withColumn("_words", F.slice("_w", F.col("_at") + 1, F.col("_len")))
        .groupBy(F.concat_ws(" ", "_words").alias("_window"), F.col("_len"))
        .agg(F.collect_set("item_id").alias("_items"), F.first("_words").alias("_words"))
    )


def _join(left: DataFrame, right: DataFrame, small: bool, how: str) -> DataFrame:
    return left.join(F.broadcast(right) if small else right, "_shingle", how)


def window_hits(
    docs: DataFrame, keys: list[str], items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """One row per distinct ``keys`` of ``docs`` (keys, text): words, hit words and items.

    Columns: keys, ``n_words``, ``n_hit``, ``items`` (array of item ids with an
    occurring window). Null and empty texts have no words. Items without words
    have no window; equal items are all named. Items with a null id count as
    hits but are not named. Documents that agree in ``keys`` must have equal texts.
    """
    windows = item_windows(items, window).withColumn("_q", F.least("_len", F.lit(shingle)))
    sizes = windows.groupBy("_q").count().collect()  # at most ``shingle`` rows
    small = sum(r["count"] for r in sizes) <= BROADCAST_ROWS
    words = docs.select(*keys, words_of(F.col("text")).alias("_dw"))
    positions = words.select("*", F.posexplode_outer("_dw").alias("_pos", "_first")).drop("_first")

    found = None
    for q in sorted((r["_q"] for r in sizes), reverse=True):
        shingles = (
            windows.where(F.col("_q") == q)
            .withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_len") - q)))
            .withColumn("_shingle", _shingle(F.col("_words"), F.col("_off"), q))
        )
        there = positions.withColumn("_shingle", _shingle(F.col("_dw"), F.col("_pos"), q))
        counts = (
            _join(there.where("_pos IS NOT NULL"), shingles.select("_shingle").distinct(), small, "inner")
            .groupBy("_shingle")
            .agg(F.count(F.lit(1)).alias("_count"))
        )
        rarity = F.struct(F.coalesce("_count", F.lit(0)), "_off", "_shingle")
        prefixes = (
            shingles.join(counts, "_shingle", "left")
            .groupBy("_window", "_len", "_items")
            .agg(F.min(rarity).alias("_rarest"))
            .select("_window", "_len", "_items", "_rarest._off", "_rarest._shingle")
        )
        start = F.col("_pos") - F.col("_off")
        there_words = F.concat_ws(" ", F.slice("_dw", F.greatest(F.col("_start"), F.lit(0)) + 1, F.col("_len")))
        same = there_words == F.col("_window")
        fits = (F.col("_start") >= 0) & (F.col("_start") + F.col("_len") <= F.size("_dw"))
        pairs = (
            _join(there, prefixes, small, "left")
            .withColumn("_start", start)
            .withColumn("_hit", F.coalesce(fits, F.lit(False)) & same)
            # The first position stands for the document itself.
            .where("_hit OR _pos = 0 OR _pos IS NULL")
            .select(
                *keys,
                F.size("_dw").alias("_n"),
                F.when(F.col("_hit"), F.struct("_start", "_len")).alias("_span"),
                F.when(F.col("_hit"), F.col("_items")).alias("_found"),
            )
        )
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = words.select(
            *keys,
            F.size("_dw").alias("_n"),
            F.lit(None).cast("struct<_start:int,_len:int>").alias("_span"),
            F.lit(None).cast(f"array<{dict(items.dtypes)['item_id']}>").alias("_found"),
        )
    hit = F.expr("array_distinct(flatten(transform(_spans, s -> sequence(s._start, s._start + s._len - 1))))")
    return (
        found.groupBy(*keys)
        .agg(
            F.max("_n").cast("long").alias("n_words"),
            F.collect_set("_span").alias("_spans"),
            F.collect_set("_found").alias("_found"),
        )
        .withColumn("n_hit", F.size(hit).cast("long"))
        .withColumn("items", F.array_distinct(F.flatten("_found")))
        .drop("_spans", "_found")
    )


def is_contaminated(n_hit: Column, n_words: Column, share: int = HIT_SHARE) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def hits_by_document(docs: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`window_hits` by ``doc_id`` and text; rows that repeat both count once."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    return window_hits(rows, ["doc_id", "_text_hash"], items).drop("_text_hash")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is contaminated; columns and repeats stay as they are."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"))
    bad = (
        window_hits(rows, ["doc_id", "_text_hash"], items)
        .where(is_contaminated(F.col("n_hit"), F.col("n_words")))
        .select(F.col("doc_id").alias("_bad_id"), F.col("_text_hash").alias("_bad_hash"))
    )
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")
