"""Filter interaction audit over failing-id relations.

Each filter has one table of the rows that fail it. What a filter removes at a
step is the left-semi join of the rows still there with its table, and what
survives is their left-anti join with it. All orders share their prefixes, and
a prefix's survivors do not depend on the order within it, so the joins are made
once per filter for all prefixes together: a round's left-semi side gets the
filter's bit, its left-anti side goes on as it is. A row is there after a prefix
if it has none of the prefix's bits. Rows are then counted by part and bits,
before anything is shuffled, and every step of every order is read off the at
most ``2 ** filters`` counts of a part.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsentry.session import materialise

# Orders grow with the factorial of the filters.
MAX_FILTERS = 6
MIN_WORDS = 200
SYMBOLS = "[#$%&*|]"

_SPACE = "[\\x20\\x09-\\x0D]+"
_STEP = "array<struct<filter_order:string,step:int,_prefix:int,_bit:int>>"
_COUNTS = ("_n", "_good", "_toxic")


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``_row``, ``_id``, ``_part``, ``_digest`` and a boolean per text filter (``A`` to ``D``), written down.

    The texts are read once and go no further. ``_row`` tells rows apart, those
    that share an id or have none too. Null texts are empty, null parts ``''``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"),
        text.alias("_text"),
        F.array_remove(F.split(text, _SPACE, -1), "").alias("_words"),
    )
    words, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    out = rows.select(
        "_row",
        "_id",
        "_part",
        F.unhex(F.sha2("_text", 256)).alias("_digest"),
        (words < MIN_WORDS).alias("A"),
        (distinct.cast("long") * 100 < words.cast("long") * 50).alias("B"),
        (capitals.cast("long") * 100 > F.length("_text").cast("long") * 2).alias("C"),
        F.rlike("_text", F.lit(SYMBOLS)).alias("D"),
    )
    return materialise(out, "measured")


def later_copies(rows: DataFrame) -> DataFrame:
    """``_row`` of the rows whose text (``_digest``) some row with a smaller ``_id`` has; null ids neither fail nor count."""
    least = rows.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    least = least.where("_least < _most").select("_digest", "_least")
    return rows.select("_row", "_id", "_digest").join(least, "_digest").where("_id > _least").select("_row")


def failing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The id table of each of the five filters, by name."""
    tables = {name: rows.where(name).select("_row") for name in "ABCD"}
    return {name: materialise(ids, f"fails-{name}") for name, ids in {**tables, "E": later_copies(rows)}.items()}


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``_row``, ``_part``, ``_good``, ``_toxic``: whether any label of the row's id says so."""
    said = (
        labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy(F.col("doc_id").alias("_label"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
        )
    )
    told = rows.select("_row", "_id", "_part").join(said, F.col("_id") == F.col("_label"), "left")
    return told.select("_row", "_part", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("_good", "_toxic")])


def outcomes(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``_fails``: bit i is set if the i-th filter's table has the ``_row``.

    Tables are sets of rows: ids that repeat in one, or are unknown, change nothing.
    """
    rows = rows.withColumn("_fails", F.lit(0))
    for i, ids in enumerate(failing.values()):
        removed = rows.join(ids, "_row", "left_semi").withColumn("_fails", F.col("_fails") + F.lit(1 << i))
        survived = rows.join(ids, "_row", "left_anti")
        rows = materialise(removed.unionByName(survived), "outcomes")
    return rows


def _steps(names: list[str]) -> Column:
    """Every step of every order, with the bits of the filters before it and its own."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "_prefix": sum(bit[x] for x in order[:k]), "_bit": bit[order[k]]}
        for order in permutations(names)
        for k in range(len(order))
    ]
    return F.from_json(F.lit(json.dumps(steps)), _STEP)


def _total(field: str, test: str) -> Column:
    return F.expr(f"aggregate(filter(_counts, c -> {test}), 0L, (s, c) -> s + c.{field})")


def interactions(outcome: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, with that step's counts.

    ``outcome`` has ``_part``, ``_fails``, ``_good``, ``_toxic`` per row (of
    :func:`outcomes`). No rows give no parts; steps that remove nothing are there
    with zeros.
    """
    if len(set(names)) != len(names) or len(names) > MAX_FILTERS:
        raise ValueError(f"an audit takes at most {MAX_FILTERS} filters of different names")
    counted = outcome.groupBy("_part", "_fails").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(c) for c in ("_good", "_toxic")]
    )
    # At most 2 ** MAX_FILTERS entries a part.
    parts = counted.groupBy("_part").agg(F.collect_list(F.struct("_fails", *_COUNTS)).alias("_counts"))
    removed = "(c._fails & _prefix) = 0 AND (c._fails & _bit) != 0"
    return (
        parts.select("_part", "_counts", F.inline(_steps(names)))
        .select(
            F.col("_part").alias("part"),
            "filter_order",
            "step",
            _total("_n", "(c._fails & (_prefix | _bit)) = 0").alias("kept"),
            _total("_n", removed).alias("removed"),
            _total("_n", "(c._fails & _prefix) != 0 AND (c._fails & _bit) != 0").alias("redundant"),
            _total("_n", "c._fails = _bit").alias("unique_fails"),
            _total("_good", removed).alias("good_lost"),
            _total("_toxic", removed).alias("toxic_lost"),
            "_bit",
        )
        .withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_bit")))
        .drop("_bit")
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs`` (doc_id, text, source), labels joined by ``doc_id``.

    A: under 200 words; B: under half of the words distinct; C: over 2 % capitals;
    D: holds a symbol; E: the text of a smaller id. Null and empty texts have no words.
    Rows that repeat are counted one by one; further columns are ignored.
    """
    rows = measured(docs, "doc_id", "text", "source")
    failing = failing_tables(rows)
    return interactions(outcomes(labelled(rows, labels), failing), list(failing))
