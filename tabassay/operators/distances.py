"""Exact sums over all pairs of rows of products of the distances in two columns, without meeting all pairs.

Equal rows are one row with a weight, and every column is cut into parts: values equal to a cut are a part of their own
(odd numbers, no distance inside), those between two cuts another (even numbers). For rows of different parts in both columns the
signs of both differences are known, so totals per pair of parts are enough. What is left are pairs inside a part, which a task
adds up by halving: n log(n)**2 steps instead of n**2. Cuts decide only where the work is split, never a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabassay.operators.caster import quoted
from tabassay.operators.frames import cuts_below
from tabassay.plans.storage import checkpointed

LEAST_PARTS, MOST_PARTS, ROWS_A_SQUARE = 16, 500, 100
BRUTE = 32


def products_apart(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum of ``w_i w_j |x_i - x_j| |y_i - y_j|`` over all ordered pairs.

    Rows stand in the order of x and halves of every stretch meet, shorter stretches first: the x of the right half are not smaller,
    and in the order of y the left rows seen so far are those below.
    """
    if len(x) < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    x, y, w = x[order] - x.mean(), y[order] - y.mean(), w[order].astype(np.float64)
    m = len(x)
    filled = -(-m // BRUTE) * BRUTE
    a, b, c = (np.concatenate([v, np.zeros(filled - m)]).reshape(-1, BRUTE) for v in (x, y, w))
    sums = [sum(float((np.abs(a[:, k, None] - a) * np.abs(b[:, k, None] - b) * c[:, k, None] * c).sum()) for k in range(BRUTE))]
    by_y = np.argsort(y, kind="stable")
    values = np.stack([w, w * x, w * y, w * x * y])
    size = BRUTE
    while size < m:
        stretch = by_y // (2 * size)
        place = by_y[np.argsort(stretch, kind="stable")]
        left = place // size % 2 == 0
        upto = np.cumsum(np.where(left, values[:, place], 0.0), axis=1)
        starts = np.arange(0, m, 2 * size)
        before = np.concatenate([np.zeros((4, 1)), upto], axis=1)[:, starts]
        total = np.concatenate([np.zeros((4, 1)), upto], axis=1)[:, np.minimum(starts + 2 * size, m)] - before
        right = np.flatnonzero(~left)
        j = place[right]
        k = j // (2 * size)
        n, sx, sy, sxy = 2 * (upto[:, right] - before[:, k]) - total[:, k]
        sums.append(2 * float((w[j] * (x[j] * (y[j] * n - sy) - (y[j] * sx - sxy))).sum()))
        size *= 2
    return math.fsum(sums)


def products_by_parts(cells: np.ndarray) -> float:
    """The same sum over pairs of different parts in both columns, from rows ``part of x, part of y, w, wx, wy, wxy``."""
    p, q = (np.unique(cells[:, k], return_inverse=True)[1] for k in (0, 1))
    grid = np.zeros((4, p.max() + 1, q.max() + 1))
    grid[:, p, q] = cells[:, 2:].T
    before = np.zeros_like(grid)
    before[:, 1:] = np.cumsum(grid, axis=1)[:, :-1]
    below = np.zeros_like(grid)
    below[:, :, 1:] = np.cumsum(before, axis=2)[:, :, :-1]
    above = before.sum(axis=2, keepdims=True) - below - before
    n, sx, sy, sxy = below - above
    w, wx, wy, wxy = grid
    return 2 * float((wxy * n - wx * sy - wy * sx + w * sxy).sum())


def distance_sums(frame: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """How many rows, and for columns a and b the means over all pairs of rows of a's distance and of both
    distances' product, and the mean over rows of the product of the rows' mean distances; columns in units of their deviations.
    """
    d = len(columns)
    counted = frame.groupBy(*[quoted(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).agg(F.count("*").cast("double").alias("w"))
    base = checkpointed(counted.withColumn("id", F.monotonically_increasing_id()))
    mean = lambda k: F.sum(F.col(f"x{k}") * F.col("w")) / F.sum("w")
    seen = base.agg(F.sum("w").alias("n"), F.count("*").alias("rows"), *[a for k in range(d) for a in (F.min(f"x{k}").alias(f"l{k}"), F.max(f"x{k}").alias(f"h{k}"), mean(k).alias(f"m{k}"), F.stddev_pop(f"x{k}").alias(f"s{k}"))]).first()
    if not seen["rows"]:
        return 0, np.zeros(d), np.zeros((d, d)), np.zeros((d, d))
    n = int(seen["n"])
    # A constant column is moved to exact zeros.
    still = [seen[f"l{k}"] == seen[f"h{k}"] for k in range(d)]
    z = lambda k: ((F.col(f"x{k}") - (seen[f"l{k}"] if still[k] else seen[f"m{k}"])) / (1.0 if still[k] else seen[f"s{k}"])).alias(f"z{k}")
    scaled = base.select("id", "w", *[z(k) for k in range(d)])
    parts = min(MOST_PARTS, max(LEAST_PARTS, math.isqrt(seen["rows"] // ROWS_A_SQUARE)))
    shares = [k / parts for k in range(1, parts)]
    found = scaled.agg(*[F.percentile_approx(f"z{k}", shares, 20 * parts).alias(f"c{k}") for k in range(d)]).first()
    cuts = [sorted(set(found[f"c{k}"])) for k in range(d)]
    part = lambda k: (cuts_below(F.array(*map(F.lit, cuts[k])), F.col(f"z{k}")) + cuts_below(F.array(*map(F.lit, cuts[k])), F.col(f"z{k}"), True)).cast("int").alias(f"p{k}")
    dealt = checkpointed(scaled.select("*", *[part(k) for k in range(d)]))

    both = list(combinations(range(d), 2))
    w, of = F.col("w"), lambda k: F.col(f"z{k}")
    sums = lambda i, j: [F.sum(w).alias("w"), F.sum(w * of(i)).alias("wx"), F.sum(w * of(j)).alias("wy"), F.sum(w * of(i) * of(j)).alias("wxy")]
    cells = {(i, j): dealt.groupBy(f"p{i}", f"p{j}").agg(*sums(i, j)).toPandas().to_numpy(np.float64) for i, j in both}
    alone = [dealt.groupBy(f"p{k}").agg(F.sum(w).alias("w"), F.sum(w * of(k)).alias("wx"), F.sum(w * of(k) ** 2).alias("wxx")).toPandas().sort_values(f"p{k}").to_numpy(np.float64) for k in range(d)]
    lower = []  # by column and part: weights and sums of the parts below, and of those above
    for t in alone:
        upto = np.cumsum(t[:, 1:3], axis=0)
        lower.append({int(p): (*(u - v), *(upto[-1] - u)) for p, u, v in zip(t[:, 0], upto, t[:, 1:3], strict=True)})

    def outside(k: int, p: int, v: np.ndarray) -> np.ndarray:
        n_below, s_below, n_above, s_above = lower[k][p]
        return v * n_below - s_below + s_above - v * n_above

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        k, p = int(group["k"].iloc[0]), int(group["p"].iloc[0])
        group = group.sort_values(f"z{k}", kind="stable")
        v, w = group[f"z{k}"].to_numpy(), group["w"].to_numpy()
        cw, cx = np.cumsum(w), np.cumsum(w * v)
        near = v * (2 * cw - cw[-1]) - 2 * cx + cx[-1]
        totals = np.zeros((d, d))
        for other in range(d):
            if other != k:
                a, b = min(k, other), max(k, other)
                totals[a, b] += products_apart(v, group[f"z{other}"].to_numpy(), w)
                if k < other:  # pairs of one part in both columns are counted twice
                    for q, cell in group.groupby(f"p{other}"):
                        if q % 2 == 0:
                            totals[a, b] -= products_apart(cell[f"z{k}"].to_numpy(), cell[f"z{other}"].to_numpy(), cell["w"].to_numpy())
        rows = pd.DataFrame({"id": group["id"], "k": k, "w": w, "value": near + outside(k, p, v), "sums": None})
        return pd.concat([rows, pd.DataFrame({"id": [-1], "k": [k], "w": [0.0], "value": [0.0], "sums": [totals.reshape(-1).tolist()]})])

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (k, p), group in batch.groupby(["k", "p"]):
                yield pd.DataFrame({"id": group["id"], "k": int(k), "w": group["w"], "value": outside(int(k), int(p), group[f"z{k}"].to_numpy()), "sums": None})

    by_part: Column = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in range(d)]))
    spread = dealt.select("*", by_part.alias("by")).select("*", "by.k", "by.p").drop("by")
    form = "id bigint, k int, w double, value double, sums array<double>"
    near = spread.filter("p % 2 = 0").groupBy("k", "p").applyInPandas(inside, form).unionByName(spread.filter("p % 2 = 1").mapInPandas(level, form))
    near = checkpointed(near)
    local = near.filter("id = -1").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"t{k}") for k in range(d * d)]).first()
    rows = near.filter("id >= 0").groupBy("id").agg(F.max("w").alias("w"), *[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"s{k}") for k in range(d)])
    row = rows.agg(*[F.sum(F.col("w") * F.col(f"s{k}")).alias(f"t{k}") for k in range(d)], *[F.sum(F.col("w") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(d) for j in range(d)]).first()
    products = np.zeros((d, d))
    for i, j in both:
        products[i, j] = products[j, i] = (local[f"t{i * d + j}"] or 0.0) + products_by_parts(cells[i, j])
    for k, t in enumerate(alone):
        products[k, k] = 2 * (n * t[:, 3].sum() - t[:, 2].sum() ** 2)
    return n, np.array([row[f"t{k}"] for k in range(d)]) / n**2, products / n**2, np.array([[row[f"m{i}_{j}"] for j in range(d)] for i in range(d)]) / n**3
