"""Fidelity of relations between two columns: ``metric, c1, c2, real_value, synth_value, delta``.

All pairs of a kind share one scan; tables of counts are combined before they are shuffled. A pair needs ten
rows on either side. Pairs for which a side has no value (constant columns, one group) give null.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabassay.operators.caster import complete, quoted
from tabassay.operators.distances import distance_sums
from tabassay.operators.frames import cumulative, flag, row_sample, stacked
from tabassay.plans.storage import checkpointed

LEAST_ROWS = 10
MI_BINS = 10
DCOR_ROWS = 2000
NUM_NUM, NUM_CAT, CAT_CAT = ("pearson", "spearman", "dcor", "mi"), ("eta_squared", "point_biserial", "kruskal_epsilon"), ("cramers_v", "theils_u", "chi2_stat")


def numeric_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(columns), 2))


def mixed_pairs(numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, str]]:
    return list(product(sorted(numeric), sorted(categorical)))


def named(sides: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Numbers of columns, which are cheaper to group by, back to their names."""
    at = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    return sides.withColumns({"c1": at(left, "c1"), "c2": at(right, "c2")})


def result(sides: DataFrame, metric: str, left: Sequence[str] | None = None, right: Sequence[str] | None = None) -> DataFrame:
    """``is_real, c1, c2, value`` -> a row per pair with both values."""
    if left is not None:
        sides = named(sides, left, right)
    wide = sides.groupBy("c1", "c2").agg(F.max(F.when(F.col("is_real"), F.col("value"))).alias("real_value"), F.max(F.when(~F.col("is_real"), F.col("value"))).alias("synth_value"))
    return wide.select(F.lit(f"fidelity.{metric}").alias("metric"), "c1", "c2", "real_value", "synth_value", F.abs(F.col("real_value") - F.col("synth_value")).alias("delta"))


def both_given(a: str, b: str) -> Column:
    return quoted(a).isNotNull() & quoted(b).isNotNull()


def spread(pairs: Sequence[tuple[str, str]], wide: DataFrame) -> DataFrame:
    return wide.select("is_real", F.explode(F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"v{k}").alias("value")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("is_real", "p.c1", "p.c2", "p.value")


def correlations(both: DataFrame, pairs: Sequence[tuple[str, str]], metric: str) -> DataFrame:
    """Absolute Pearson correlations of all pairs in one aggregate."""
    value = lambda a, b: F.abs(F.corr(F.when(both_given(a, b), quoted(a)), F.when(both_given(a, b), quoted(b))))
    guarded = lambda a, b: F.when(F.count(F.when(both_given(a, b), 1)) >= LEAST_ROWS, F.nanvl(value(a, b), F.lit(None).cast("double")))
    return result(spread(pairs, both.groupBy("is_real").agg(*[guarded(a, b).alias(f"v{k}") for k, (a, b) in enumerate(pairs)])), metric)


def pearson(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = numeric_pairs(columns)
    return correlations(stacked(real, synth, columns), pairs, "pearson")


def spearman(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson on average ranks; ranks follow from cumulative counts and are joined back by value."""
    rows = stacked(real, synth, columns).withColumn("id", F.monotonically_increasing_id())
    long = rows.select("id", "is_real", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns])).alias("p")).select("id", "is_real", "p.column", "p.value").filter(F.col("value").isNotNull())
    cum = cumulative(long.groupBy("column", "value").agg(F.sum(flag()).alias("nr"), F.sum(1 - flag()).alias("ns")))
    rank = F.when(F.col("is_real"), F.col("cr") - (F.col("nr") - 1) / 2).otherwise(F.col("cs") - (F.col("ns") - 1) / 2)
    ranked = long.join(cum, ["column", "value"]).select("id", "is_real", "column", rank.alias("rank"))
    wide = ranked.groupBy("id", "is_real").agg(*[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c) for c in columns])
    return correlations(wide, numeric_pairs(columns), "spearman")


def mutual_information(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """In nats over ten equal-width bins of each side's own range, closed on the right."""
    pairs, both = numeric_pairs(columns), stacked(real, synth, columns)
    span = both.groupBy("is_real").agg(*[f(quoted(c)).alias(f"{p}{k}") for k, c in enumerate(columns) for p, f in (("low", F.min), ("high", F.max))])
    x = both.join(F.broadcast(span), "is_real")
    width = lambda k: (F.col(f"high{k}") - F.col(f"low{k}")) / MI_BINS
    cell = {c: F.when(width(k) > 0, F.greatest(F.least(F.ceil((quoted(c) - F.col(f"low{k}")) / width(k)), F.lit(MI_BINS)), F.lit(1)).cast("int")) for k, c in enumerate(columns)}
    place = {c: k for k, c in enumerate(columns)}
    cells = x.select("is_real", F.explode(F.array(*[F.struct(F.lit(place[a]).alias("c1"), F.lit(place[b]).alias("c2"), cell[a].alias("x"), cell[b].alias("y")) for a, b in pairs])).alias("p")).select("is_real", "p.*").na.drop()
    counts = cells.groupBy("is_real", "c1", "c2", "x", "y").agg(F.count("*").alias("n"))
    key = ["is_real", "c1", "c2"]
    total, px, py = (F.sum("n").over(Window.partitionBy(*key, *more)) for more in ([], ["x"], ["y"]))
    with_sums = counts.select(*key, "n", total.alias("t"), px.alias("nx"), py.alias("ny"))
    value = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    return result(with_sums.groupBy(*key).agg(F.when(F.max("t") >= LEAST_ROWS, F.greatest(value, F.lit(0.0))).alias("value")), "mi", columns, columns)


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """V-statistic; null for a constant column."""

    def centred(v: np.ndarray) -> np.ndarray:
        d = np.abs(v[:, None] - v[None])
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    spread_xy = (a * a).mean() * (b * b).mean()
    return float(np.sqrt(max((a * b).mean(), 0.0) / np.sqrt(spread_xy))) if spread_xy > 0 else None


def sampled(frame: DataFrame, columns: Sequence[str], most: int, seed: int = 42) -> np.ndarray:
    """At most ``most`` rows in the order of a hash of row and copy: the same rows on every run."""
    picks = [quoted(c).cast("double").alias(c) for c in columns]
    rows = row_sample(complete(frame.select(*picks)), most, seed)
    return rows.toPandas().to_numpy(np.float64).reshape(-1, len(columns))


def dcor(real: DataFrame, synth: DataFrame, columns: Sequence[str], most: int | None = DCOR_ROWS, seed: int = 42) -> DataFrame:
    """Distance correlations on samples of ``most`` rows a side, or with None on all rows in blocks."""
    spark = real.sparkSession
    columns = sorted(columns)
    if most is None:
        sides = [all_distance_correlations(t, columns) for t in (real, synth)]
    else:
        r, s = sampled(real, columns, most, seed), sampled(synth, columns, most, seed)
        sides = [{(a, b): distance_correlation(m[:, columns.index(a)], m[:, columns.index(b)]) if len(m) >= LEAST_ROWS else None for a, b in numeric_pairs(columns)} for m in (r, s)]
    out = []
    for pair in numeric_pairs(columns):
        values = [side[pair] for side in sides]
        out.append(("fidelity.dcor", *pair, *values, abs(values[0] - values[1]) if None not in values else None))
    return spark.createDataFrame(out, "metric string, c1 string, c2 string, real_value double, synth_value double, delta double")


def all_distance_correlations(frame: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """The V-statistics of every pair of columns from exact sums over all pairs of rows; null for a constant column or few rows."""
    picks = complete(frame.select(*[quoted(c).cast("double").alias(c) for c in columns]))
    n, mean, both, rows = distance_sums(picks, columns)
    covariance = both - 2 * rows + np.outer(mean, mean)
    out = {}
    for a, b in numeric_pairs(columns):
        i, j = columns.index(a), columns.index(b)
        spread = covariance[i, i] * covariance[j, j]
        out[a, b] = float(np.sqrt(max(covariance[i, j], 0.0) / np.sqrt(spread))) if n >= LEAST_ROWS and spread > 0 else None
    return out


def grouped(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``is_real, c1, c2, value, group``: every numeric value beside every category of its row; columns by their numbers."""
    both = stacked(real, synth, [*numeric, *categorical])
    pairs, left, right = mixed_pairs(numeric, categorical), list(numeric), list(categorical)
    return both.select("is_real", F.explode(F.array(*[F.struct(F.lit(left.index(a)).alias("c1"), F.lit(right.index(b)).alias("c2"), quoted(a).cast("double").alias("value"), quoted(b).cast("string").alias("group")) for a, b in pairs])).alias("p")).select("is_real", "p.*").na.drop()


KEY = ("is_real", "c1", "c2")


def eta_squared(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Share of variance between groups of more than one row; moments per group, combined before the shuffle."""
    g = grouped(real, synth, numeric, categorical).groupBy(*KEY, "group").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter("n > 1")
    mean = g.groupBy(*KEY).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("n").alias("total"), F.count("*").alias("groups"))
    x = g.join(F.broadcast(mean), list(KEY))
    between = F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2)
    within = F.sum(F.col("n") * F.col("v"))
    value = F.when((F.max("groups") >= 2) & (F.max("total") >= LEAST_ROWS) & (between + within > 0), between / (between + within))
    return result(x.groupBy(*KEY).agg(value.alias("value")), "eta_squared", numeric, categorical)


def point_biserial(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Absolute correlation with a category of exactly two values; others give null."""
    g = grouped(real, synth, numeric, categorical)
    cells = g.groupBy(*KEY, "group").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    two = cells.groupBy(*KEY).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("t"),
        F.min_by(F.struct("n", "m"), "group").alias("a"),
        F.max_by(F.struct("n", "m"), "group").alias("b"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    na, nb = F.col("a.n"), F.col("b.n")
    between = na * nb / F.col("t") * (F.col("a.m") - F.col("b.m")) ** 2
    value = F.when((F.col("k") == 2) & (F.col("t") >= LEAST_ROWS) & (between + F.col("within") > 0), F.sqrt(between / (between + F.col("within"))))
    return result(two.select(*KEY, value.alias("value")), "point_biserial", numeric, categorical)


def kruskal_epsilon(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H over groups of more than one row, divided by all rows less one.

    Counts by group and by value are used several times and are written to the checkpoint folder.
    """
    cells = checkpointed(grouped(real, synth, numeric, categorical).groupBy("c1", "c2", "group", "value").agg(F.sum(flag()).alias("nr"), F.sum(1 - flag()).alias("ns")))
    sizes = cells.groupBy("c1", "c2", "group").agg(F.sum("nr").alias("gr"), F.sum("ns").alias("gs"))
    alls = sizes.groupBy("c1", "c2").agg(F.sum("gr").alias("ar"), F.sum("gs").alias("as_"))
    kept = cells.join(sizes, ["c1", "c2", "group"]).select("c1", "c2", "group", "value", F.when(F.col("gr") > 1, F.col("nr")).otherwise(0).alias("nr"), F.when(F.col("gs") > 1, F.col("ns")).otherwise(0).alias("ns"))
    by_value = checkpointed(kept.groupBy("c1", "c2", "value").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns")))
    cum = checkpointed(cumulative(by_value, ("c1", "c2")))
    ranks = cum.select("c1", "c2", "value", *[(F.col(f"c{s}") - (F.col(f"n{s}") - 1) / 2).alias(f"rank_{s}") for s in "rs"])
    ties = cum.groupBy("c1", "c2").agg(*[F.sum(F.pow(F.col(f"n{s}").cast("double"), 3.0) - F.col(f"n{s}")).alias(f"tie_{s}") for s in "rs"], F.max("tr").alias("tr"), F.max("ts").alias("ts"))
    sums = kept.join(ranks, ["c1", "c2", "value"]).groupBy("c1", "c2", "group").agg(*[x for s in "rs" for x in (F.sum(F.col(f"n{s}") * F.col(f"rank_{s}")).alias(f"w{s}"), F.sum(f"n{s}").alias(f"k{s}"))])
    h = sums.groupBy("c1", "c2").agg(*[x for s in "rs" for x in (F.sum(F.when(F.col(f"k{s}") > 0, F.col(f"w{s}") ** 2 / F.col(f"k{s}"))).alias(f"h{s}"), F.sum((F.col(f"k{s}") > 0).cast("int")).alias(f"g{s}"))])
    x = h.join(F.broadcast(ties), ["c1", "c2"]).join(F.broadcast(alls), ["c1", "c2"])

    def epsilon(s: str, everyone: str) -> Column:
        n = F.col(f"t{s}").cast("double")
        raw = 12 / (n * (n + 1)) * F.col(f"h{s}") - 3 * (n + 1)
        fix = 1 - F.col(f"tie_{s}") / (n * n * n - n)
        return F.when((F.col(f"g{s}") >= 2) & (F.col(everyone) >= LEAST_ROWS) & (fix > 0), raw / fix / (F.col(everyone) - 1))

    sides = x.select("c1", "c2", F.explode(F.array(F.struct(F.lit(True).alias("is_real"), epsilon("r", "ar").alias("value")), F.struct(F.lit(False).alias("is_real"), epsilon("s", "as_").alias("value")))).alias("p")).select("p.is_real", "c1", "c2", "p.value")
    return result(sides, "kruskal_epsilon", numeric, categorical)


def contingency(real: DataFrame, synth: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """``is_real, c1, c2, x, y, n`` and the sums of each row, column and table."""
    both, pairs = stacked(real, synth, categorical), list(combinations(sorted(categorical), 2))
    cells = both.select("is_real", F.explode(F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), quoted(a).cast("string").alias("x"), quoted(b).cast("string").alias("y")) for a, b in pairs])).alias("p")).select("is_real", "p.*").na.drop()
    counts = cells.groupBy(*KEY, "x", "y").agg(F.count("*").alias("n"))
    rows = counts.groupBy(*KEY, "x").agg(F.sum("n").alias("nx"))
    columns = counts.groupBy(*KEY, "y").agg(F.sum("n").alias("ny"))
    table = rows.groupBy(*KEY).agg(F.sum("nx").alias("t"), F.count("*").alias("kx"), F.sum(1 / F.col("nx")).alias("ix"), F.sum(F.col("nx") * F.log(F.col("nx").cast("double"))).alias("lx"))
    table = table.join(columns.groupBy(*KEY).agg(F.count("*").alias("ky"), F.sum(1 / F.col("ny")).alias("iy"), F.sum(F.col("ny") * F.log(F.col("ny").cast("double"))).alias("ly")), list(KEY))
    return counts.join(rows, [*KEY, "x"]).join(columns, [*KEY, "y"]).join(table, list(KEY))


def categorical_metrics(real: DataFrame, synth: DataFrame, categorical: Sequence[str], names: Sequence[str] = CAT_CAT) -> DataFrame:
    """Cramér's V, Theil's U (of the second column given the first) and chi-squared over n, from one table of counts.

    Cells of no row add nothing to sum(n^2 / (nx ny)), so only cells that exist are counted. Two-by-two tables take
    the continuity correction; there all cells lie equally far from what is expected.
    """
    c = contingency(real, synth, categorical)
    t, n = F.max("t"), F.col("n")
    apart = F.max(F.abs(n - F.col("nx") * F.col("ny") / F.col("t")))
    corrected = (apart - F.least(apart, F.lit(0.5))) ** 2 * t * F.max("ix") * F.max("iy")
    plain = t * (F.sum(n * n / (F.col("nx") * F.col("ny"))) - 1)
    two = (F.max("kx") == 2) & (F.max("ky") == 2)
    least = F.least(F.max("kx"), F.max("ky")) - 1
    s = c.groupBy(*KEY).agg(
        F.when(two, corrected).otherwise(F.greatest(plain, F.lit(0.0))).alias("chi2"),
        least.alias("least"),
        t.alias("t"),
        (F.log(t.cast("double")) - F.max("ly") / t).alias("hy"),
        ((F.max("lx") - F.sum(n * F.log(n.cast("double")))) / t).alias("hyx"),
    )
    values = {
        "cramers_v": F.when(F.col("least") > 0, F.sqrt(F.col("chi2") / (F.col("t") * F.col("least")))).otherwise(0.0),
        "theils_u": F.when(F.col("hy") > 1e-12, (F.col("hy") - F.col("hyx")) / F.col("hy")).otherwise(0.0),
        "chi2_stat": F.when(F.col("least") > 0, F.col("chi2") / F.col("t")).otherwise(0.0),
    }
    out = None
    for name in names:
        one = result(s.select(*KEY, F.when(F.col("t") >= LEAST_ROWS, values[name]).alias("value")), name)
        out = one if out is None else out.unionByName(one)
    return out


def pair_metric(name: str, real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], seed: int = 42) -> DataFrame | None:
    """One pair metric by its short name; none if there is no pair of its kind."""
    if name in NUM_NUM:
        if len(numeric) < 2:
            return None
        made = {"pearson": pearson, "spearman": spearman, "mi": mutual_information}
        return dcor(real, synth, numeric, seed=seed) if name == "dcor" else made[name](real, synth, numeric)
    if name in NUM_CAT:
        made = {"eta_squared": eta_squared, "point_biserial": point_biserial, "kruskal_epsilon": kruskal_epsilon}
        return made[name](real, synth, numeric, categorical) if numeric and categorical else None
    return categorical_metrics(real, synth, categorical, [name]) if len(categorical) >= 2 else None
