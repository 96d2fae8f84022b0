"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers ``floor(scale * c)``. The fit list holds each
distinct one once. Its centred rows are reduced block by block to triangles
(QR), the triangles in a tree of groups to one, and that one, a matrix of the
size of a row, is solved on the driver (:mod:`singular`): Householder
bidiagonal form, dqds for the singular values, twisted factorisations for the
directions. The covariance is never formed, so small components keep their
digits. Counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.llm.singular import leading_directions
from textsentry.session import materialise

SCALE = 256
COMPONENTS = 4
# Triangles joined by one task of the tree.
FAN_IN = 16
# Rows of a block that is reduced at once, at least.
BLOCK_ROWS = 4096

_EPS = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """Of the fit list: rows, sums by dimension, eigenvalues (falling), directions (columns), error."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    identity_error: float | None

    @property
    def explained(self) -> list[float | None]:
        trace = float(self.values.sum())
        return [float(e) / trace if trace else None for e in self.values[: self.directions.shape[1]]]


def coded(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``_id`` and ``_x`` (array of longs) of the vectors without null or non-finite entries.

    Entries beyond a long's range become its ends. Of vectors of several
    dimensions those of the commonest (the larger of equally common ones) stay.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("_v"))
    sound = rows.where(
        F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = sound.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    same = sound.where(F.size("_v") == (sizes[0]["n"] if sizes else 0))
    return same.select("_id", F.transform("_v", lambda x: F.floor(x * F.lit(float(scale)))).alias("_x"))


def _whole(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: of longs while they can't overflow, else of Python's whole numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _square_sums(dev: np.ndarray) -> list[int | None]:
    """The squares of each row's deviations summed up, exact; null beyond a long."""
    most = max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0)))) if dev.size else 0
    if dev.dtype == object or most * most * dev.shape[1] >= 1 << 63:
        dev = dev.astype(object)
    total = (dev * dev).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in total]


def _totals(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension; a task returns the sums of its rows' high and low halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _whole(batch.column(0), size)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        arrays = [pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n)), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(arrays, ["d", "n", "high", "low"])

    parts = fit.mapInArrow(run, "d int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), *wide).collect()  # one row a dimension
    sums = {r["d"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(d, 0) for d in range(size)]


def _reduced(stack: np.ndarray, size: int) -> np.ndarray:
    """The triangle of ``stack``, a square one whatever its number of rows."""
    short = size - len(stack)
    return np.linalg.qr(np.vstack([stack, np.zeros((short, size))]) if short > 0 else stack, mode="r")


def triangle(fit: DataFrame, n: int, sums: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """R of the centred fit list: each task folds its blocks into one triangle, groups of triangles into one again."""
    size = len(sums)
    schema = "_node long, _r array<double>"

    def emit(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["_node", "_r"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, rows = np.zeros((0, size)), [], 0
        for batch in batches:
            held.append(_deviations(_whole(batch.column(0), size), n, sums).astype(np.float64) / n)
            rows += batch.num_rows
            if rows >= max(BLOCK_ROWS, size):
                r, held, rows = _reduced(np.vstack([r, *held]), size), [], 0
        if held or len(r):
            yield emit(TaskContext.get().partitionId(), _reduced(np.vstack([r, *held]), size))

    def joined(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_node").to_numpy(), kind="stable")
        parts = table.column("_r").combine_chunks().flatten().to_numpy().reshape(-1, size, size)
        node = int(table.column("_node").to_numpy().min()) // fan_in
        return pa.Table.from_batches([emit(node, _reduced(np.vstack(parts[order]), size))])

    level = materialise(fit.mapInArrow(blocks, schema), "triangles")
    most = level.agg(F.max("_node")).first()[0]
    while most:
        level = level.groupBy(F.floor(F.col("_node") / fan_in)).applyInArrow(joined, schema)
        most //= fan_in
    return level.toArrow().column("_r").combine_chunks().flatten().to_numpy().reshape(size, size)


def _projected(x: np.ndarray, n: int, sums: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dev = _deviations(x, n, sums)
    return dev, (dev.astype(np.float64) / n) @ axes


def _identity_error(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> float | None:
    size, k = axes.shape
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, w = _projected(_whole(batch.column(0), size), n, sums, axes)
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "t"])

    rows = fit.mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()  # k * (k + 1) rows
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["i"]] = r["t"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, fan_in: int = FAN_IN) -> Whitening:
    """The whitening of ``rows`` (``_x`` of one dimension), fitted on each distinct one once.

    Values and directions are those of the covariance with divisor ``n``. Where
    eigenvalues are equal any orthonormal directions of their space are returned.
    """
    fit = materialise(rows.select("_x").distinct(), "fit")
    first = fit.first()
    size = len(first["_x"]) if first else 0
    if not size:
        return Whitening(fit.count(), [], np.zeros(0), np.zeros((0, 0)), None)
    n, sums = _totals(fit, size)
    singular, directions = leading_directions(triangle(fit, n, sums, fan_in), components)
    values = singular * singular / n
    axes = _axes(values, directions)
    return Whitening(n, sums, values, directions, _identity_error(fit, n, sums, axes[:, np.isfinite(axes).all(axis=0)]))


def _axes(values: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Directions over the root of their values; NaN where the value is nothing but rounding."""
    root = np.sqrt(values[: directions.shape[1]])
    floor = 8 * len(values) * _EPS * (root[0] if len(root) else 0.0)
    return directions / np.where(root > floor, root, np.nan)


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null or non-finite entries give no rows; rows
    that repeat and null ids stay. A component without variance has a null
    ``whitened`` and takes no part in ``identity_error``; ``explained`` is null if
    nothing varies. ``deviation`` is null beyond a long. Fewer dimensions than
    ``components`` give fewer rows. Other columns are ignored.
    """
    rows = coded(vectors, id_col, vector_col, scale)
    model = fit_whitening(rows, components)
    n, sums, explained, error = model.n, model.sums, model.explained, model.identity_error
    axes = _axes(model.values, model.directions)
    size, k = axes.shape
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dev, w = _projected(_whole(batch.column(1), size), n, sums, axes)
            rows = len(dev)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(_square_sums(dev), pa.int64()).take(each),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
