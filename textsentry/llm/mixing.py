"""Mixing sources to target weights by hierarchical budgeting.

Weights run down a tree (domain, language, source). At each node the budget is
shared among the children by weight; a child that cannot fill its share, with
all its epochs, gets what it has, and what is left goes to its siblings first.
Capacities are those of whole subtrees, so a shortage leaves a node only if
every child of it is exhausted. Each leaf then takes a prefix, by tokens, of
its rows in the seeded order of the epoch it ends in, after whole epochs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsentry.llm.common import STRATUM_ROWS, bucket_count, hex_bucket, salt_repeats, seeded_key, split_bucket
from textsentry.session import materialise

TREE = ("domain", "lang", "source")
SEED = "mix"
SHARE = 0.5
EPOCHS = 2
# Relative weights by path in the tree; paths that are not named weigh 1.
WEIGHTS = {
    ("web",): 2,
    ("books",): 3,
    ("reference",): 3,
    ("web", "en"): 2,
    ("books", "en"): 2,
    ("reference", "en"): 2,
}
_SEP = "\x1f"


def domain_of(source: Column) -> Column:
    """The domain a source belongs to: the hot source is the web crawl, the others are collections."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999"))
    return (
        F.when(source.isNull() | number.isNull(), "other")
        .when(number == 0, "web")
        .when(number < 10, "books")
        .otherwise("reference")
    )


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(path: list[str], weights: dict[tuple, int]) -> Column:
    named = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not named:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for k, v in named.items() for x in (_SEP.join(k), v)])
    joined = F.concat_ws(_SEP, *[F.coalesce(F.col(p), F.lit("\x00")) for p in path])
    return F.coalesce(known[joined], F.lit(1))


def _share_out(children: DataFrame, parents: list[str], weights: dict, path: list[str]) -> DataFrame:
    """Split ``budget`` (of the parent) over the children by weight, within ``capacity``.

    In the order of capacity per weight, a child is full if its part of what
    the fuller ones leave is at least what it has; the others share the rest.
    """
    whole = Window.partitionBy(*parents)
    upto = whole.orderBy("_fill", path[-1]).rowsBetween(Window.unboundedPreceding, -1)
    w, c, b = F.col("_w"), F.col("capacity"), F.col("budget")
    weighed = children.withColumn("_w", _weight(path, weights).cast("long"))
    ranked = (
        weighed.withColumn("_fill", F.when(w > 0, c / w).otherwise(F.lit(float("inf"))))
        .withColumn("_used", F.coalesce(F.sum("capacity").over(upto), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        .withColumn(
            "_full", (w > 0) & (c.cast("double") * F.col("_open") <= (b - F.col("_used")).cast("double") * w)
        )
    )
    rest = b - F.coalesce(F.sum(F.when(F.col("_full"), c)).over(whole), F.lit(0))
    open_w = F.coalesce(F.sum(F.when(~F.col("_full"), w)).over(whole), F.lit(0))
    part = F.when(F.col("_full"), c).otherwise(
        F.least(c, F.floor(F.when(open_w > 0, rest.cast("double") * w / open_w).otherwise(0.0)))
    )
    return ranked.withColumn("budget", part.cast("long")).drop("_w", "_fill", "_used", "_open", "_full")


def budgets(
    leaves: DataFrame, tree: list[str], weights: dict[tuple, int], share: float, epochs: int
) -> DataFrame:
    """``leaves`` (tree columns, supply) with ``capacity`` and ``budget`` in tokens.

    The root's budget is ``share`` of all tokens. Weights are whole numbers, 0
    keeps a subtree out. Budgets are rounded down at each level.
    """
    leaves = leaves.withColumn("capacity", F.col("supply") * epochs)
    level = leaves.agg(
        F.coalesce(F.floor(F.sum("supply") * F.lit(float(share))), F.lit(0)).cast("long").alias("budget")
    )
    for depth in range(1, len(tree) + 1):
        path, parents = tree[:depth], tree[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("supply").alias("supply"), F.sum("capacity").alias("capacity"))
        if parents:
            up = level.select(*[F.col(p).alias(f"_p_{p}") for p in parents], "budget")
            on = reduce(lambda a, x: a & x, [F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in parents])
            nodes = nodes.join(up, on).drop(*[f"_p_{p}" for p in parents])
        else:
            nodes = nodes.crossJoin(F.broadcast(level))  # one row
        level = _share_out(nodes, parents, weights, path)
    return level


def mix(
    rows: DataFrame,
    id_col: str,
    tokens: str,
    tree: tuple[str, ...] = TREE,
    weights: dict[tuple, int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The rows each leaf contributes, one per epoch it is read in, with ``epoch`` and ``cum_tokens``.

    ``rows`` are narrow: id, tree columns, tokens. A row is taken in an epoch
    while the tokens up to and with it stay within the leaf's budget. Null tree
    values form a branch of their own (weight 1), null tokens count 0, rows
    without tokens cost nothing and come with the prefix they fall in, but a leaf
    without any takes none. Repeated
    rows are taken or left one by one. No rows give no rows. Leaves may hold
    any share of the rows: they are ranked in buckets, and so may one id, null
    included, whose rows come at random.
    """
    tree = list(tree)
    rows = rows.select(F.col(id_col).alias("_id"), *tree, F.coalesce(F.col(tokens), F.lit(0)).alias("_tokens"))
    rows, hot = salt_repeats(rows, "_id")
    buckets = bucket_count(rows.count(), STRATUM_ROWS)

    def keys(df: DataFrame, name: str) -> DataFrame:
        read = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        keyed = read.withColumn("_key", seeded_key(seed, F.col("epoch"), F.col(name)))
        return keyed.withColumn("_kb", hex_bucket(F.col("_key"), buckets))

    keyed = keys(rows, "_id").withColumn("_part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        listed = keys(hot, "_hot").select(F.col("_kb").alias("_bucket"), F.col("_key").alias("_value"), "_parts")
        keyed = split_bucket(keyed, "_kb", "_key", listed, lambda n: F.pmod(F.col("_salt"), n), "_part")
    at = [*tree, "epoch", "_kb"]
    before = Window.partitionBy(*tree, "epoch").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*at).agg(F.sum("_tokens").alias("_sum"))
    leaves = sums.where("epoch = 1").groupBy(*tree).agg(F.sum("_sum").alias("supply"))
    plan = budgets(leaves, tree, weights, share, epochs).select(
        *[F.col(t).alias(f"_l_{t}") for t in tree], "supply", "budget"
    )
    leaf = reduce(lambda a, x: a & x, [F.col(t).eqNullSafe(F.col(f"_l_{t}")) for t in tree])
    # What a bucket may still take: whole epochs first, then the prefix of the next.
    open_buckets = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(plan, leaf)
        .withColumn("_left", F.col("budget") - F.col("supply") * (F.col("epoch") - 1))
        .where("_left > 0 AND _before <= _left")
        .select(*[F.col(a).alias(f"_b_{a}") for a in at], "_before", "_left", F.col("budget").alias("leaf_budget"))
    )
    on = reduce(lambda a, x: a & x, [F.col(a).eqNullSafe(F.col(f"_b_{a}")) for a in at])
    inside = Window.partitionBy(*at).orderBy("_key", "_part", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(open_buckets, on)
        .withColumn("cum_tokens", F.col("_before") + F.sum("_tokens").over(inside))
        .where("cum_tokens <= _left")
        .select(F.col("_id").alias(id_col), *tree, F.col("_tokens").alias(tokens), "epoch", "cum_tokens", "leaf_budget")
    )


def mix_documents(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """:func:`mix` over ``documents`` with the built-in tree and weights."""
    rows = docs.select(
        "doc_id",
        domain_of(F.col("source")).alias("domain"),
        "lang",
        "source",
        token_count(F.col("text")).alias("n_tokens"),
    )
    return mix(rows, "doc_id", "n_tokens", share=share, epochs=epochs, seed=seed)


def take_mix(docs: DataFrame, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that :func:`mix_documents` takes in one epoch, columns as they are.

    Rows are taken one by one. Where ids repeat or are missing, they are told apart and
    ordered by id, text and leaf; of rows that agree in all these any may be taken.
    """
    doubtful = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1 OR doc_id IS NULL")
    if doubtful.isEmpty():
        taken = mix_documents(docs, share, 1, seed).select(F.col("doc_id").alias("_taken"))
        return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_taken"]), "left_semi")
    row = F.concat_ws(
        "|",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        F.to_json(F.struct("lang", "source")),
    )
    taken = mix_documents(docs.withColumn("doc_id", row), share, 1, seed)
    taken = taken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_taken"))
    rows = docs.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("_rows"))
    marks = materialise(
        taken.join(rows, taken["doc_id"] == rows["_row"]).select("_row", F.when(F.col("_taken") < F.col("_rows"), F.col("_taken")).alias("_only")),
        "taken",
    )
    marked = docs.withColumn("_mix_row", row)
    on = F.col("_mix_row") == F.col("_row")
    whole = marked.join(marks.where("_only IS NULL"), on, "left_semi")
    # The budget of a leaf ends within the copies of one row at most.
    nth = F.row_number().over(Window.partitionBy("_mix_row").orderBy(F.lit(1)))
    part = marked.join(marks.where("_only IS NOT NULL"), on).withColumn("_nth", nth).where("_nth <= _only")
    return whole.select(*docs.columns).unionByName(part.select(*docs.columns))
