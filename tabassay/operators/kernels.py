"""Sums of a kernel over all pairs of rows of two sides, without meeting all pairs.

Both sides stand in the same cells of space, under a tree of boxes. Where a kernel is smooth enough between two boxes, their rows are replaced
by weights on Chebyshev nodes of the boxes, which gives the sum over their pairs to about ten digits; rows of boxes that are too near are
met one by one. With many columns, or few rows in a box, nodes would cost more than rows, and all pairs are met.
Kernels that are polynomials need only sums of products of the columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabassay.operators import knn
from tabassay.plans.storage import checkpointed

MOST_CELLS, STEP, FAR_A_TASK = 2048, 1 << 17, 256


@dataclass(frozen=True)
class Radial:
    """exp(-factor * square): smooth where a box is small beside its width."""

    factor: float
    nodes: int = 12
    reach: float = 0.35

    def of(self, squares: np.ndarray) -> np.ndarray:
        squares *= -self.factor
        return np.exp(squares, out=squares)

    def far(self, a: float, b: float, gap: float) -> bool:
        return max(a, b) * math.sqrt(abs(self.factor)) <= self.reach


@dataclass(frozen=True)
class Power:
    """The distance to the power ``alpha``: smooth where the gap is large beside the boxes."""

    alpha: float
    nodes: int = 8
    reach: float = 2.0

    def of(self, squares: np.ndarray) -> np.ndarray:
        np.maximum(squares, 0.0, out=squares)
        return np.sqrt(squares, out=squares) if self.alpha == 1 else np.power(squares, self.alpha / 2, out=squares)

    def far(self, a: float, b: float, gap: float) -> bool:
        return gap >= self.reach * max(a, b)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one product of matrices, around the middle of x."""
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    left = np.column_stack([-2 * x, (x * x).sum(axis=1), np.ones(len(x))])
    return left @ np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)]).T


def met(kernel: Radial | Power, x: np.ndarray, sx: np.ndarray, y: np.ndarray, sy: np.ndarray, same: bool) -> np.ndarray:
    """Sums of the kernel by side of x and side of y; ``same``: x is y, and a row is not at any distance of itself."""
    out, step = np.zeros((2, 2)), max(1, STEP // max(len(y), 1))
    for at in range(0, len(x), step):
        apart = squares(x[at : at + step], y)
        if same:
            rows = np.arange(len(apart))
            apart[rows, at + rows] = 0.0
        out += sx[at : at + step].T @ (kernel.of(apart) @ sy)
    return out


def nodes_of(low: np.ndarray, high: np.ndarray, count: int) -> list[np.ndarray]:
    """Chebyshev nodes of each side of a box; one for a side without width."""
    unit = np.cos((2 * np.arange(count) + 1) * np.pi / (2 * count))
    return [(a + b) / 2 + (b - a) / 2 * unit if b > a else np.array([a]) for a, b in zip(low, high, strict=True)]


def shares(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of Chebyshev nodes at x: a row a value, a column a node."""
    n = len(nodes)
    if n == 1:
        return np.ones((len(x), 1))
    weight = (-1.0) ** np.arange(n) * np.sin((2 * np.arange(n) + 1) * np.pi / (2 * n))
    gap = x[:, None] - nodes
    hit = gap == 0
    part = weight / np.where(hit, 1.0, gap)
    out = part / part.sum(axis=1, keepdims=True)
    rows = hit.any(axis=1)
    out[rows] = hit[rows]
    return out


def spread(nodes: list[np.ndarray], x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Weights of both sides' rows on the nodes of a box: 2 x all nodes."""
    out = np.zeros((2, math.prod(map(len, nodes))))
    step = max(1, (1 << 20) // out.shape[1])
    for at in range(0, len(x), step):
        some, row = x[at : at + step], np.ones((min(step, len(x) - at), 1))
        for k, line in enumerate(nodes):
            row = (row[:, :, None] * shares(line, some[:, k])[:, None, :]).reshape(len(some), -1)
        out += side[at : at + step].T @ row
    return out


def lifted(weights: np.ndarray, inner: list[np.ndarray], outer: list[np.ndarray]) -> np.ndarray:
    """Weights on a box's nodes moved to those of a box around it."""
    t = weights.reshape(2, *map(len, inner))
    for k, (a, b) in enumerate(zip(inner, outer, strict=True)):
        t = np.moveaxis(np.tensordot(t, shares(b, a), axes=(k + 1, 0)), -1, k + 1)
    return t.reshape(2, -1)


def by_nodes(kernel: Radial | Power, a: list[np.ndarray], wa: np.ndarray, b: list[np.ndarray], wb: np.ndarray) -> np.ndarray:
    """Sums by side from weights on nodes; a radial kernel is a product over columns."""
    if isinstance(kernel, Radial):
        t = wb.reshape(2, *map(len, b))
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            t = np.moveaxis(np.tensordot(t, np.exp(-kernel.factor * (x[:, None] - y) ** 2), axes=(k + 1, 1)), -1, k + 1)
        return wa @ t.reshape(2, -1).T
    x, y = (np.stack([g.reshape(-1) for g in np.meshgrid(*n, indexing="ij")], axis=1) for n in (a, b))
    return wa @ (kernel.of(squares(x, y)) @ wb.T)


def sides(ids: np.ndarray) -> np.ndarray:
    odd = (ids & 1).astype(np.float64)
    return np.column_stack([1 - odd, odd])


def pair_sums(real: DataFrame, synth: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray], kernel: Radial | Power) -> np.ndarray:
    """Of two numbered frames: the kernel's sums over all ordered pairs of rows by side, [0, 0] within real, [1, 1] within synth and [0, 1] between; rows meet themselves."""
    d = len(columns)
    both = knn.standard(real, columns, scale).withColumn("id", F.col("id") * 2).unionByName(knn.standard(synth, columns, scale).withColumn("id", F.col("id") * 2 + 1))
    both = checkpointed(both)
    tree = knn.cells_of(both, d, knn.CELL, MOST_CELLS)
    blocks = checkpointed(knn.placed(both, d, tree))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(r).reshape(-1, d) for r in batch.column(1).to_pylist()]
            form = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in x], pa.int64()), pa.array([r.min(axis=0).tolist() for r in x], form), pa.array([r.max(axis=0).tolist() for r in x], form)], names=["cell", "n", "low", "high"])

    boxes = blocks.select("cell", "rows").mapInArrow(measured, "cell int, n bigint, low array<double>, high array<double>").groupBy("cell")
    boxes = {r["cell"]: r for r in boxes.agg(F.sum("n").alias("n"), *[F.min(F.get("low", F.lit(k))).alias(f"l{k}") for k in range(d)], *[F.max(F.get("high", F.lit(k))).alias(f"h{k}") for k in range(d)]).collect()}
    # Children come after their parents in the tree.
    size = len(tree.axis)
    n, low, high = np.zeros(size, np.int64), np.full((size, d), np.inf), np.full((size, d), -np.inf)
    for at in reversed(range(size)):
        if tree.axis[at] < 0:
            if r := boxes.get(tree.cell[at]):
                n[at], low[at], high[at] = r["n"], [r[f"l{k}"] for k in range(d)], [r[f"h{k}"] for k in range(d)]
        else:
            a, b = tree.below[at], tree.above[at]
            n[at], low[at], high[at] = n[a] + n[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
    half = np.where(n[:, None] > 0, (high - low) / 2, 0.0)
    count = [math.prod(kernel.nodes if w > 0 else 1 for w in h) for h in half]
    near, far = [], []
    lows, highs, wide, rows = low.tolist(), high.tolist(), half.max(axis=1).tolist(), n.tolist()
    ahead = [(0, 0)]
    while ahead:
        a, b = ahead.pop()
        if not rows[a] or not rows[b]:
            continue
        gap = math.sqrt(sum(max(x - v, u - y, 0.0) ** 2 for u, v, x, y in zip(lows[a], highs[a], lows[b], highs[b], strict=True)))
        points = wide[a] == wide[b] == 0
        if points or count[a] * count[b] < rows[a] * rows[b] and kernel.far(wide[a], wide[b], gap):
            far.append((a, b))
        elif tree.axis[a] < 0 and tree.axis[b] < 0:
            near.append((tree.cell[a], tree.cell[b]))
        elif a == b:
            x, y = tree.below[a], tree.above[a]
            ahead += [(x, x), (x, y), (y, y)]
        elif tree.axis[b] < 0 or tree.axis[a] >= 0 and wide[a] >= wide[b]:
            ahead += [(tree.below[a], b), (tree.above[a], b)]
        else:
            ahead += [(a, tree.below[b]), (a, tree.above[b])]

    spark, form = real.sparkSession, "a double, b double, c double, d double"
    result = lambda t: pa.RecordBatch.from_arrays([pa.array([v]) for v in t.reshape(-1).tolist()], names=list("abcd"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2))
        for batch in batches:
            for a, x_ids, x_rows, b, y_ids, y_rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                i, j = np.frombuffer(x_ids, np.int64), np.frombuffer(y_ids, np.int64)
                some = met(kernel, np.frombuffer(x_rows).reshape(-1, d), sides(i), np.frombuffer(y_rows).reshape(-1, d), sides(j), a == b and i[0] == j[0])
                total += some if a == b else some + some.T
        yield result(total)

    total = np.zeros((2, 2))

    def add(sums: DataFrame) -> None:
        row = sums.agg(*[F.sum(c) for c in "abcd"]).first()
        total.__iadd__(np.array([v or 0.0 for v in row]).reshape(2, 2))

    if near:
        pairs = spark.createDataFrame(pa.table({"a": pa.array([a for a, _ in near], pa.int32()), "b": pa.array([b for _, b in near], pa.int32())}))
        side = lambda p, c: blocks.select(F.col("cell").alias(c), F.col("ids").alias(f"{p}_ids"), F.col("rows").alias(f"{p}_rows"))
        add(pairs.repartition(max(1, len(near) // 64)).join(side("x", "a"), "a").join(side("y", "b"), "b").select("a", "x_ids", "x_rows", "b", "y_ids", "y_rows").mapInArrow(meet, form))
    if far:
        used = {at for pair in far for at in pair}
        leaves = {tree.cell[at]: at for at in range(size) if tree.axis[at] < 0}
        places = [nodes_of(low[at], high[at], kernel.nodes) if n[at] else [] for at in range(size)]
        weights = leaf_weights(blocks, d, {c: places[at] for c, at in leaves.items() if n[at]})
        weight: list[np.ndarray | None] = [None] * size
        for at in reversed(range(size)):
            if n[at]:
                inner = [k for k in (tree.below[at], tree.above[at]) if k >= 0 and n[k]]
                weight[at] = weights.pop(tree.cell[at]) if tree.axis[at] < 0 else sum(lifted(weight[k], places[k], places[at]) for k in inner)
        shared = spark.sparkContext.broadcast((np.array(far, np.int32), {at: (places[at], weight[at]) for at in used}))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed, known = shared.value
            total = np.zeros((2, 2))
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    for a, b in listed[at * FAR_A_TASK : (at + 1) * FAR_A_TASK].tolist():
                        some = by_nodes(kernel, *known[a], *known[b])
                        total += some if a == b else some + some.T
            yield result(total)

        tasks = -(-len(far) // FAR_A_TASK)
        add(spark.range(0, tasks, 1, tasks).mapInArrow(reach, form))
        shared.unpersist()
    return total


def leaf_weights(blocks: DataFrame, d: int, places: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Weights of each cell's rows on the nodes of its box."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = spread(places[cell], np.frombuffer(rows).reshape(-1, d), sides(np.frombuffer(ids, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=["cell", "weights"])

    out: dict[int, np.ndarray] = {}
    for r in blocks.select("cell", "ids", "rows").mapInArrow(project, "cell int, weights binary").toLocalIterator():
        made = np.frombuffer(r["weights"]).reshape(2, -1)
        out[r["cell"]] = out[r["cell"]] + made if r["cell"] in out else made
    return out


def moment_sums(frame: DataFrame, columns: Sequence[str], scale: tuple[np.ndarray, np.ndarray], degree: int, one: bool) -> np.ndarray:
    """The sum over rows of the products of every ``degree`` columns, with a column of ones if ``one``: kernels (x y)^degree are products of two such sums."""
    width = (len(columns) + one) ** degree

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for rows in batch.column(1).to_pylist():
                every = np.frombuffer(rows).reshape(-1, len(columns))
                for at in range(0, len(every), 512):
                    x = every[at : at + 512]
                    x = np.column_stack([x, np.ones(len(x))]) if one else x
                    made = x
                    for _ in range(degree - 2):
                        made = (made[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                    total += made.sum(axis=0) if degree == 1 else (made.T @ x).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    out = np.zeros(width)
    for r in knn.packed(frame, columns, scale, "q").mapInArrow(sums, "sums binary").toLocalIterator():
        out += np.frombuffer(r["sums"])
    return out
