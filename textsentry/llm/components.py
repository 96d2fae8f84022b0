"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.session import materialise

# Rounds over at most this many edges (some MB) take one task. Shuffled, each would be some thousand
# near-empty tasks and several broadcasts where there are many partitions, all kept track of by the driver.
FEW_EDGES = 1 << 16


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u``, ``v``: each row's ``pairs`` of columns."""
    return edges.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """``edges`` with ``m``, the least ``v`` of each ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # One partition needs no exchange; the planner forgets behind a join that there is but one.
    return edges.join(least.hint("merge"), "u").coalesce(1) if few else edges.join(least, "u")


def _large(edges: DataFrame, few: bool = False) -> DataFrame:
    near = _with_least(_pairs(edges, ("u", "v"), ("v", "u")), few).where("v > u")
    return _pairs(near.withColumn("m", F.least("u", "m")), ("v", "m")).where("u != v").distinct()


def _small(edges: DataFrame, few: bool = False) -> DataFrame:
    return _pairs(_with_least(edges, few), ("v", "m"), ("u", "m")).where("u != v").distinct()


def _round(edges: DataFrame, rows: int) -> DataFrame:
    """A large and a small star. Few edges are merged where they lie, without a shuffle or a broadcast."""
    if rows <= FEW_EDGES:
        return _small(_large(edges.coalesce(1), few=True), few=True)
    return _small(_large(edges))


def components(links: DataFrame) -> DataFrame:
    """``u`` and ``root`` for every vertex of ``links`` (``u``, ``v``) but the roots themselves.

    The root is the least vertex of the component. Every round is written to
    the shared folder, so a lost executor costs one round at most; vertices of
    any degree are handled by partial minima and joins with one row per vertex.
    Rounds over more than ``FEW_EDGES`` edges are shuffled.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(_round(edges, state[0]), "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select("u", F.col("v").alias("root"))
