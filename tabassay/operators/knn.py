"""Exact nearest neighbours between tables, and sums over all pairs of rows.

Neighbours are looked for in cells of space: what a row finds in its own cell rules out the cells that are farther. ``most`` bounds
the work by a hash-ordered sample where that is wanted. With many columns few cells are ruled out, and blocks meet blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabassay.operators.caster import quoted
from tabassay.operators.frames import row_sample
from tabassay.plans.storage import checkpointed

BLOCK = 4096
#: Targets a cell and cells at most; rows sampled for each to choose the cuts; distances that a task holds at a time.
CELL, MOST_CELLS, SAMPLED, STEP = 1024, 4096, 32, 1 << 17


def scale_of(frame: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 for constant columns), from one aggregate."""
    row = frame.agg(*[f(quoted(c).cast("double")).alias(f"{p}{k}") for k, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(len(columns))])
    deviation = np.array([row[f"s{k}"] or 0.0 for k in range(len(columns))])
    return mean, np.where(deviation > 0, deviation, 1.0)


def packed(frame: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray], prefix: str) -> DataFrame:
    """Blocks of standardised rows: ids and a matrix as bytes. Nulls count as 0 before scaling."""
    mean, deviation = scale

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([((x - mean) / deviation).tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_rows"])

    picked = frame.select("id", *[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(columns)])
    return picked.mapInArrow(blocks, f"{prefix}_ids binary, {prefix}_rows binary")


@dataclass
class Cells:
    """A tree of cuts through a sample of points; every point of space belongs to one cell. Cuts decide where the work is done, never a result."""

    axis: list[int]
    cut: list[float]
    below: list[int]
    above: list[int]
    cell: list[int]

    @classmethod
    def of(cls, points: np.ndarray, count: int) -> Cells:
        """About ``count`` cells with equally many of ``points``."""
        tree, number = cls([], [], [], [], []), 0

        def grow(some: np.ndarray, share: int) -> int:
            nonlocal number
            at = len(tree.axis)
            for part in (tree.axis, tree.cut, tree.below, tree.above, tree.cell):
                part.append(-1)
            width = np.ptp(some, axis=0) if len(some) else np.zeros(1)
            if share < 2 or not width.max() > 0:
                tree.cell[at], number = number, number + 1
                return at
            k = int(width.argmax())
            values = some[:, k]
            cut = np.median(values)
            if not (values < cut).any():
                cut = values[values > cut].min()
            tree.axis[at], tree.cut[at] = k, float(cut)
            left = values < cut
            tree.below[at], tree.above[at] = grow(some[left], share // 2), grow(some[~left], share - share // 2)
            return at

        grow(points, count)
        return tree

    def place(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        ahead = [(0, np.arange(len(points)))]
        while ahead:
            at, rows = ahead.pop()
            if not len(rows):
                continue
            if self.axis[at] < 0:
                out[rows] = self.cell[at]
            else:
                left = points[rows, self.axis[at]] < self.cut[at]
                ahead += [(self.below[at], rows[left]), (self.above[at], rows[~left])]
        return out


def cells_of(frame: DataFrame, d: int, a_cell: int, most: int) -> Cells:
    """Cells of about ``a_cell`` rows of a frame with columns x0, x1, ..., at most ``most`` of them, from a sample of the rows."""
    n = frame.count()
    count = max(1, min(most, n // a_cell))
    share = min(1.0, SAMPLED * count / max(n, 1))
    rows = frame.select(*[f"x{k}" for k in range(d)])
    points = (rows.sample(share, seed=42) if share < 1 else rows).toPandas().to_numpy(np.float64).reshape(-1, d)
    return Cells.of(points, count)


def placed(frame: DataFrame, d: int, cells: Cells) -> DataFrame:
    """Blocks ``cell, ids, rows`` of at most BLOCK rows of one cell each, ids and rows as bytes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(cells.place(x)), *batch.columns], names=["cell", "id", *[f"x{k}" for k in range(d)]])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            ids, x = batch.column(1).to_numpy(), np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            ends = [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            spans = [(at, min(at + BLOCK, end)) for start, end in zip([0, *ends[:-1]], ends, strict=True) for at in range(start, end, BLOCK)]
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([int(cell[a]) for a, _ in spans], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())], names=["cell", "ids", "rows"])

    names = ", ".join(f"x{k} double" for k in range(d))
    marked = frame.select("id", *[f"x{k}" for k in range(d)]).mapInArrow(mark, f"cell int, id bigint, {names}")
    # The id in the order keeps a cell of very many rows from being one partition.
    return marked.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(blocks, "cell int, ids binary, rows binary")


def standard(frame: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, x0, x1, ...``: standardised columns. Nulls count as 0 before scaling."""
    mean, deviation = scale
    return frame.select("id", *[((F.coalesce(quoted(c).cast("double"), F.lit(0.0)) - float(mean[k])) / float(deviation[k])).alias(f"x{k}") for k, c in enumerate(columns)])


def closest(q_ids: np.ndarray, q: np.ndarray, t_ids: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of each row's nearest target of another id, ties to the smaller id; infinite and -1 without one.

    Products give rough squares; every target whose square is within their rounding of the least one is measured exactly.
    """
    out_d, out_n = np.full(len(q), np.inf), np.full(len(q), -1, np.int64)
    if not len(t):
        return out_d, out_n
    middle = t.mean(axis=0)
    near = t - middle
    sizes, last = (near * near).sum(axis=1), near.T.copy()
    largest = float(sizes.max())
    step = max(1, STEP // len(t))
    for at in range(0, len(q), step):
        some, own = q[at : at + step], q_ids[at : at + step]
        away = some - middle
        rough = (-2 * away) @ last
        rough += sizes
        same = np.isin(own, t_ids, kind="sort")
        if same.any():
            rough[own[:, None] == t_ids] = np.inf
        square = (away * away).sum(axis=1)
        limit = rough.min(axis=1) + 64 * np.finfo(float).eps * (q.shape[1] + 2) * (largest + square)
        row, found = np.nonzero(rough <= np.where(np.isfinite(limit), limit, -np.inf)[:, None])
        if len(row):
            exact = np.sqrt(((t[found] - some[row]) ** 2).sum(axis=1))
            order = np.lexsort((t_ids[found], exact, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            out_d[at + row[first]], out_n[at + row[first]] = exact[first], t_ids[found[first]]
    return out_d, out_n


def nearest(queries: DataFrame, targets: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, distance, neighbour``: for each query (``id`` bigint) its nearest target of another id; ties go to the smaller id.

    Targets stand in cells. A query first meets its own cell; the distance found there rules out all cells whose box is farther, and it
    meets the rest. Of equal targets the two of least id are kept, which answers for all of them, own ids left out.
    """
    d = len(columns)
    xs = [f"x{k}" for k in range(d)]
    few = Window.partitionBy(*xs).orderBy("id")
    # Values that are not finite have no finite distance (Spark orders NaN above infinity).
    finite = standard(targets, columns, scale).filter(functools.reduce(Column.__and__, [F.abs(x) < math.inf for x in map(F.col, xs)]))
    t = checkpointed(finite.withColumn("n", F.row_number().over(few)).filter("n <= 2").drop("n"))
    cells = cells_of(t, d, CELL, MOST_CELLS)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(r).reshape(-1, d) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.min(axis=0).tolist() for r in x], pa.list_(pa.float64())), pa.array([r.max(axis=0).tolist() for r in x], pa.list_(pa.float64()))], names=["cell", "low", "high"])

    tb = checkpointed(placed(t, d, cells))
    found = tb.select("rows", "cell").mapInArrow(boxed, "cell int, low array<double>, high array<double>").groupBy("cell")
    ends = sorted(found.agg(*[F.min(F.get("low", F.lit(k))).alias(f"l{k}") for k in range(d)], *[F.max(F.get("high", F.lit(k))).alias(f"h{k}") for k in range(d)]).collect())
    names, low, high = np.array([r["cell"] for r in ends], np.int32), *(np.array([[r[f"{e}{k}"] for k in range(d)] for r in ends]).reshape(-1, d) for e in "lh")
    form = "cell int, ids binary, rows binary, distances binary, neighbours binary"
    empty = (np.zeros(0, np.int64), np.zeros((0, d)))

    def meet(batches: Iterator[pa.RecordBatch], route: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, rows, t_ids, t_rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q_ids, q = np.frombuffer(ids, np.int64), np.frombuffer(rows).reshape(-1, d)
                t_id, t = empty if t_ids is None else (np.frombuffer(t_ids, np.int64), np.frombuffer(t_rows).reshape(-1, d))
                distance, neighbour = closest(q_ids, q, t_id, t)
                out = [(-1, ids, b"", distance.tobytes(), neighbour.tobytes())]
                if route:
                    for k in range(len(names)):
                        if names[k] != cell:
                            gap = np.maximum(np.maximum(low[k] - q, q - high[k]), 0.0)
                            goes = np.sqrt((gap * gap).sum(axis=1)) <= distance * (1 + 1e-9)
                            if goes.any():
                                out.append((int(names[k]), q_ids[goes].tobytes(), q[goes].tobytes(), b"", b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["cell", "ids", "rows", "distances", "neighbours"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, distances, neighbours in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                distance = np.frombuffer(distances)
                seen = np.isfinite(distance)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[seen]), pa.array(distance[seen]), pa.array(np.frombuffer(neighbours, np.int64)[seen])], names=["id", "distance", "neighbour"])

    there = tb.select(F.col("cell").alias("t_cell"), F.col("ids").alias("t_ids"), F.col("rows").alias("t_rows"))

    def met(blocks: DataFrame, route: bool, how: str) -> DataFrame:
        pairs = blocks.select("cell", "ids", "rows").join(there, F.col("cell") == F.col("t_cell"), how).select("cell", "ids", "rows", "t_ids", "t_rows")
        return pairs.mapInArrow(lambda batches: meet(batches, route), form)

    first = checkpointed(met(placed(standard(queries, columns, scale), d, cells), True, "left"))
    found = first.filter("cell = -1").unionByName(met(first.filter("cell >= 0"), False, "inner")).select("ids", "distances", "neighbours").mapInArrow(each, "id bigint, distance double, neighbour bigint")
    return found.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("n")).select("id", F.col("n.distance").alias("distance"), F.col("n.neighbour").alias("neighbour"))


def row_sums(a: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray], value: Callable[[np.ndarray], np.ndarray]) -> float:
    """The sum of ``value`` over rows."""
    d = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = math.fsum(float(value(np.frombuffer(x).reshape(-1, d)).sum()) for batch in batches for x in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["total"])

    return packed(a, columns, scale, "q").mapInArrow(sums, "total double").agg(F.sum("total")).first()[0] or 0.0


def numbered(frame: DataFrame, columns: Sequence[str], offset: int = 0, most: int | None = None, seed: int = 42) -> DataFrame:
    """Numeric columns with an ``id``; written down, since ids must not change between uses."""
    rows = frame.select(*[quoted(c) for c in columns])
    if most is not None:
        rows = row_sample(rows, most, seed)
    return checkpointed(rows.withColumn("id", F.monotonically_increasing_id() + F.lit(offset)))
