"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length one and cut into halves, each quantised by its own
codebook; a pair of centroids is a cell. For a query the pairs are walked in the
order of their summed distance, with a heap over two sorted lists, until the
cells hold enough entries; these are ranked by the exact cosine.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors, by hash); every
vector is indexed. Cells are dealt to groups of about ``GROUP`` vectors, a cell
beyond that is split, and queries meet each group in blocks of ``BLOCK``. A
query visits cells until they hold ``share`` of all entries (and ``ENTRIES`` at
least): what recall needs depends on how clustered the vectors are. Of equal
vectors only the first ``k + 1`` ids can be in an answer, so only they are kept:
that many at least come before any further copy for every query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 5
QUERY_STEP = 50
SAMPLE = 20_000
# Entries a query visits at least, and as a share of all.
ENTRIES = 4000
SHARE = 0.45
GROUP = 4096
BLOCK = 2048
MAX_CENTROIDS = 64
ROUNDS = 12


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``_id`` and ``_v`` (array of doubles): vectors that take part.

    Left out are null ids and vectors, vectors with null, NaN or infinite
    components or no length, and those whose dimension is not the commonest
    (the larger of equally common ones). Rows that agree in id and vector count
    once; an id with several vectors is a candidate with each.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where("_id IS NOT NULL")
    sound = rows.where(
        F.col("_v").isNotNull()
        & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("_v", lambda x: x != 0)
    )
    sizes = sound.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return sound.where(F.size("_v") == (sizes[0]["n"] if sizes else 0))


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def fit(sample: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centroids of ``sample`` by Lloyd's rounds; empty ones restart at the farthest points."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=len(sample) < k)].copy()
    for _ in range(rounds):
        d = _squared(sample, c)
        best = d.argmin(1)
        n = np.bincount(best, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, best, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = sample[np.argsort(-d[np.arange(len(d)), best])[: len(empty)]][: len(empty)] if len(d) >= len(empty) else c[empty]
    return c


def _matrix(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, entries: int) -> list[int]:
    """Non-empty cells in the order of ``a[i] + b[j]``, until they hold ``entries``."""
    i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, k = a[i_order].tolist(), b[j_order].tolist(), len(b)
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < entries:
        _, i, j = heapq.heappop(heap)
        cell = int(i_order[i]) * k + int(j_order[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of ``q`` with each row of ``x``, in an order of sums that does not depend on the other rows."""
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def nearest(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    step: int = QUERY_STEP,
    k: int = NEAREST,
    entries: int = ENTRIES,
    share: float = SHARE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest found.

    Queries are the usable vectors whose id is divisible by ``step``. No usable
    vector gives no rows, and fewer candidates than ``k`` give fewer ranks.
    """
    good = usable(vectors, id_col, vector_col)
    alike = Window.partitionBy(F.xxhash64("_v"), F.hash("_v"), "_v").orderBy("_id")
    distinct = good.dropDuplicates(["_id", "_v"])
    kept = distinct.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= k + 1).drop("_copy")
    total = good.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)

    taken = good.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).toArrow()
    size = len(taken.column("_v")[0])
    sample = _unit(_matrix(taken.column("_v"), size))
    half = max(1, size // 2)
    n = int(min(MAX_CENTROIDS, max(2, 2 ** int(np.ceil(np.log2(max(total, 1) ** 0.5 / 2))))))
    books = [fit(sample[:, :half], n), fit(sample[:, half:] if size > 1 else sample, n)]

    def parts(v: np.ndarray) -> list[np.ndarray]:
        u = _unit(v)
        return [u[:, :half], u[:, half:] if size > 1 else u]

    def cell_of(v: np.ndarray) -> np.ndarray:
        i, j = (_squared(p, c).argmin(1) for p, c in zip(parts(v), books, strict=True))
        return (i * n + j).astype(np.int32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cell_of(_matrix(batch.column(1), size))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["_id", "_v", "_cell"])

    index = kept.mapInArrow(assign, "_id long, _v array<double>, _cell int")
    counts = np.zeros(n * n, np.int64)  # at most MAX_CENTROIDS ** 2 numbers
    for row in index.groupBy("_cell").count().collect():
        counts[row["_cell"]] = row["count"]
    split = np.maximum(1, -(-counts // GROUP))
    groups = max(1, int(-(-counts.sum() // GROUP)))
    blocks = max(1, -(-distinct.where(F.col("_id") % step == 0).count() // BLOCK))
    wanted = max(entries, int(np.ceil(share * counts.sum())))

    def group_of(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        return ((cell.astype(np.int64) + part * (n * n)) * 7919 % 1_000_003 % groups).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            spread = batch.column(0).to_numpy() * 0x9E3779B1 >> 7
            group = group_of(cell, spread % split[cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], ["_id", "_v", "_cell", "_group"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_squared(p, c) for p, c in zip(parts(_matrix(batch.column(1), size)), books, strict=True))
            for r in range(batch.num_rows):
                cells = np.array(walk(a[r], b[r], counts, wanted), np.int32)
                which = np.repeat(np.arange(len(cells)), split[cells])
                part = np.arange(len(which)) - np.repeat(np.cumsum(split[cells]) - split[cells], split[cells])
                group = group_of(cells[which], part)
                order = np.argsort(group, kind="stable")
                heads, first = np.unique(group[order], return_index=True)
                lists = [np.unique(x) for x in np.split(cells[which][order], first[1:])]
                same = pa.array(np.full(len(heads), r))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), pa.array(lists, pa.list_(pa.int32())), pa.array(heads)],
                    ["_q", "_v", "_cells", "_group"],
                )

    stock = index.mapInArrow(deal, "_id long, _v array<double>, _cell int, _group int").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = (
        distinct.where(F.col("_id") % step == 0)
        .mapInArrow(visit, "_q long, _v array<double>, _cells array<int>, _group int")
        .withColumn("_block", F.pmod(F.hash("_q"), F.lit(blocks)))
    )

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids, cell = np.stack(right["_v"].to_list()), right["_id"].to_numpy(), right["_cell"].to_numpy()
            q, names = np.stack(left["_v"].to_list()), left["_q"].to_numpy()
            unit, ours = _unit(x), _unit(q)
            for r, cells in enumerate(left["_cells"]):
                seen = np.zeros(n * n, bool)
                seen[cells] = True
                at = np.flatnonzero(seen[cell] & (ids != names[r]))
                near = unit[at] @ ours[r]
                if len(at) > k:
                    at = at[near >= np.partition(near, -k)[-k] - 1e-9]
                score = cosines(q[r], x[at])
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": names[r], "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = asked.groupBy("_group", "_block").cogroup(stock.groupBy("_group", "_block"))
    found = met.applyInPandas(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
