"""Privacy: distances to real records, classes of quasi-identifiers, mechanism. Scores of 1 are most private."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabassay.operators import knn
from tabassay.operators.caster import quoted
from tabassay.operators.frames import at_rank, cumulative, cuts_below, ranges_of, row_sample
from tabassay.plans.storage import checkpointed

K_TARGET, L_TARGET, T_THRESHOLD, QUASI = 5, 3, 0.2, 5
COPY = 0.1
REAL_OFFSET = 1 << 62


def unit(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def balanced(real: DataFrame, synth: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The larger side cut to the smaller's size by a hash of its rows and their copies; equal sides stay as they are."""
    n, m = real.count(), synth.count()
    return (row_sample(real, m, seed) if n > m else real), (row_sample(synth, n, seed) if m > n else synth)


def closest_records(real: DataFrame, synth: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """``id, distance, neighbour`` of each synthetic row's nearest real row, in units of the real side's deviations."""
    scale = knn.scale_of(real, columns)
    return knn.nearest(knn.numbered(synth, columns, 0, most), knn.numbered(real, columns, REAL_OFFSET, most), columns, scale)


def distance_quantiles(distances: DataFrame, qs: dict[str, float]) -> DataFrame:
    counts = distances.groupBy(F.lit(0).alias("column"), F.col("distance").alias("value")).agg(F.count("*").alias("nr"), F.lit(0).cast("bigint").alias("ns"))
    return cumulative(counts).groupBy("column").agg(*[at_rank(q, "cr", "tr").alias(n) for n, q in qs.items()])


def dcr(real: DataFrame, synth: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """One row: p5, median, share of near copies and the score."""
    d = closest_records(real, synth, columns, most)
    q = distance_quantiles(d, {"p5": 0.05, "median": 0.5})
    a = d.agg(F.avg((F.col("distance") < COPY).cast("double")).alias("copies"))
    score = 0.4 * F.least(F.col("p5"), F.lit(1.0)) + 0.3 * (1 - F.col("copies")) + 0.3 * F.least(F.col("median") / 1.5, F.lit(1.0))
    return q.crossJoin(F.broadcast(a)).select("p5", "median", "copies", unit(score).alias("score"))


def nnaa(real: DataFrame, synth: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """One row: shares of rows whose nearest neighbour in both tables, themselves left out, is of the other side; at equal distance the real one counts."""
    scale = knn.scale_of(real, columns)
    r, s = knn.numbered(real, columns, REAL_OFFSET, most), knn.numbered(synth, columns, 0, most)
    near = lambda q, t, name: knn.nearest(q, t, columns, scale).select("id", F.col("distance").alias(name))
    ss, sr, rr, rs = near(s, s, "own"), near(s, r, "other"), near(r, r, "own"), near(r, s, "other")
    own = F.coalesce("own", F.lit(math.inf))
    adversarial = sr.join(ss, "id", "left").agg(F.avg((F.col("other") <= own).cast("double")).alias("accuracy"))
    reverse = rs.join(rr, "id", "left").agg(F.avg((F.col("other") < own).cast("double")).alias("reverse_accuracy"))
    score = F.when(F.col("accuracy") >= 0.5, 1 - 2 * (F.col("accuracy") - 0.5)).otherwise(1.0)
    return adversarial.crossJoin(F.broadcast(reverse)).select("accuracy", "reverse_accuracy", unit(score).alias("score"))


def record_linkage(real: DataFrame, synth: DataFrame, columns: Sequence[str], threshold: float | None = None, most: int | None = None) -> DataFrame:
    """One row: linkage rate (within the threshold, by default the median distance), mean distance, distinct links and the score."""
    d = closest_records(real, synth, columns, most)
    limit = distance_quantiles(d, {"cut": 0.5}).select("cut") if threshold is None else d.sparkSession.range(1).select(F.lit(float(threshold)).alias("cut"))
    a = d.crossJoin(F.broadcast(limit)).agg(F.avg((F.col("distance") <= F.col("cut")).cast("double")).alias("linkage_rate"), F.avg("distance").alias("mean_distance"), F.count_distinct("neighbour").alias("distinct_links"))
    return a.withColumn("score", unit((F.least(F.col("mean_distance") / 2, F.lit(1.0)) + 1 - F.col("linkage_rate")) / 2))


def class_sizes(table: DataFrame, quasi: Sequence[str]) -> DataFrame:
    return table.groupBy(*[quoted(q).cast("string").alias(q) for q in quasi]).agg(F.count("*").alias("k"))


def k_anonymity(synth: DataFrame, quasi: Sequence[str], target: int = K_TARGET) -> DataFrame:
    """One row: smallest and median class, share of classes below the target, and the score (by the median class)."""
    sizes = class_sizes(synth, quasi).groupBy("k").agg(F.count("*").alias("n"))
    counts = sizes.select(F.lit(0).alias("column"), F.col("k").cast("double").alias("value"), F.col("n").alias("nr"), F.lit(0).cast("bigint").alias("ns"))
    median = cumulative(counts).groupBy("column").agg(at_rank(0.5, "cr", "tr").alias("k_median"))
    a = sizes.agg(F.min("k").alias("k_min"), F.sum("n").alias("n_groups"), (F.sum(F.when(F.col("k") < target, F.col("n")).otherwise(0)) / F.sum("n")).alias("below"))
    depth = 1 - F.exp(-F.col("k_median") / target) if target > 0 else F.lit(1.0)
    return a.crossJoin(F.broadcast(median)).select("k_min", "k_median", "n_groups", "below", unit((1 - F.col("below")) * depth).alias("score"))


def l_diversity(synth: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], target: int = L_TARGET) -> DataFrame:
    """``column, l_min, below, score`` per sensitive column.

    Distinct (class, column, value) triples are counted in two steps, so no class is gathered in one place.
    """
    q = [quoted(c).alias(f"q{k}") for k, c in enumerate(quasi)]
    names = [f"q{k}" for k in range(len(quasi))]
    triples = synth.select(*q, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in sensitive])).alias("p")).select(*names, "p.column", "p.value")
    diversity = triples.distinct().groupBy(*names, "column").agg(F.count("value").alias("l"))
    a = diversity.groupBy("column").agg(F.min("l").alias("l_min"), F.avg((F.col("l") < target).cast("double")).alias("below"))
    depth = 1 - F.exp(-F.col("l_min") / target) if target > 0 else F.lit(1.0)
    return a.select("column", "l_min", "below", unit((1 - F.col("below")) * depth).alias("score"))


def t_distances(table: DataFrame, quasi: Sequence[str], numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``column, g, t``: how far each class's distribution of each column is from the whole table's.

    Strings: total variation. Numbers: area between the distribution functions over the range, which for a class
    is a sum over its own values of closed forms of the whole table's cumulative counts, so classes are not crossed with all values.
    """
    g = F.sha2(F.concat_ws("\u0001", *[F.coalesce(quoted(q).cast("string"), F.lit("\u0002")) for q in quasi]), 256)
    parts = []
    if categorical:
        long = table.select(g.alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in categorical])).alias("p")).select("g", "p.column", "p.value")
        cells = long.groupBy("column", "g", "value").agg(F.count("*").alias("n"))
        whole = cells.groupBy("column", "value").agg(F.sum("n").alias("w"))
        total = whole.groupBy("column").agg(F.sum("w").alias("total"))
        sizes = cells.groupBy("column", "g").agg(F.sum("n").alias("size"))
        x = cells.join(whole, ["column", "value"]).join(sizes, ["column", "g"]).join(F.broadcast(total), "column")
        p, q = F.col("n") / F.col("size"), F.col("w") / F.col("total")
        parts.append(x.groupBy("column", "g").agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("t")))
    if numeric:
        parts.append(number_distances(table.withColumn("g", g), numeric))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def number_distances(table: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Wasserstein distance of each class to the whole, over the whole's range, at most 1.

    Between two neighbouring values of a class its distribution function is level, say at h. The whole's function F rises, so
    the area of |F - h| there follows from the integral of F at both ends and at the place where F passes h.
    Counts, areas and steps are used more than once and are written to the checkpoint folder.
    """
    long = table.select("g", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in numeric])).alias("p")).select("g", "p.column", "p.value").filter(F.col("value").isNotNull())
    cells = checkpointed(long.groupBy("column", "g", "value").agg(F.count("*").alias("n")))
    whole = cells.groupBy("column", "value").agg(F.sum("n").alias("nr"), F.lit(0).cast("bigint").alias("ns"))
    area = checkpointed(with_areas(cumulative(whole).select("column", "value", "cr", "tr", "next")))
    ends = area.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    inner = Window.partitionBy("column", "g").orderBy("value")
    levels = cells.withColumns({"c": F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "size": F.sum("n").over(Window.partitionBy("column", "g")), "to": F.lead("value").over(inner), "at": F.row_number().over(inner)})
    x = levels.join(F.broadcast(ends), "column").withColumns({"h": F.col("c") / F.col("size"), "to": F.coalesce("to", "high")})
    first = x.filter("at = 1").select("column", "g", F.lit(0.0).alias("h"), F.col("low").alias("a"), F.col("value").alias("b"))
    steps = x.select("column", "g", "h", F.col("value").alias("a"), F.col("to").alias("b")).unionByName(first).filter("b > a")
    at = lambda name: area.select("column", F.col("value").alias(name), F.col("area").alias(f"area_{name}"), F.col("f").alias(f"f_{name}"))
    placed = checkpointed(steps.join(at("a"), ["column", "a"]).join(at("b"), ["column", "b"]))
    settled, crossing = F.col("h") <= F.col("f_a"), F.col("h") > F.col("f_a")
    straight = F.col("area_b") - F.col("area_a") - F.col("h") * (F.col("b") - F.col("a"))
    down = placed.filter(settled).select("column", "g", straight.alias("w"))
    top = placed.filter(crossing)
    place = first_reaching(area, top.select("column", "h").distinct())
    met = top.join(place, ["column", "h"])
    mid = F.least(F.col("m"), F.col("b"))
    area_mid = F.when(F.col("m") <= F.col("b"), F.col("area_m")).otherwise(F.col("area_b"))
    both = F.col("h") * (mid - F.col("a")) - (area_mid - F.col("area_a")) + (F.col("area_b") - area_mid) - F.col("h") * (F.col("b") - mid)
    up = met.select("column", "g", both.alias("w"))
    sums = down.unionByName(up).groupBy("column", "g").agg(F.sum("w").alias("w"))
    everyone = cells.select("column", "g").distinct().join(sums, ["column", "g"], "left").join(F.broadcast(ends), "column")
    width = F.col("high") - F.col("low")
    return everyone.select("column", "g", F.when(width > 0, F.least(F.coalesce("w", F.lit(0.0)) / width, F.lit(1.0))).otherwise(0.0).alias("t"))


def first_reaching(area: DataFrame, wanted: DataFrame) -> DataFrame:
    """``column, h, m, area_m``: the first value at which the whole's distribution function reaches h.

    Both are sorted together inside ranges of the share; where a range holds no later value, the first of a higher range serves.
    """
    n = ranges_of(area)
    marks = area.select("column", F.col("f").alias("key"), F.struct(F.col("value").alias("m"), F.col("area").alias("area_m")).alias("mark"), F.lit(0).alias("kind"))
    both = marks.unionByName(wanted.select("column", F.col("h").alias("key"), F.lit(1).alias("kind")), allowMissingColumns=True)
    both = both.withColumn("range", F.least(F.floor(F.col("key") * n), F.lit(n - 1)).cast("int"))
    downward = Window.partitionBy("column", "range").orderBy(F.desc("key"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("mark", ignorenulls=True).over(downward)).filter("kind = 1")
    firsts = both.groupBy("column", "range").agg(F.min(F.when(F.col("kind") == 0, F.struct("key", "mark"))).alias("first"))
    higher = Window.partitionBy("column").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("column", "range", F.last("first", ignorenulls=True).over(higher)["mark"].alias("after"))
    found = near.join(F.broadcast(after), ["column", "range"]).withColumn("p", F.coalesce("near", "after"))
    return found.select("column", F.col("key").alias("h"), F.col("p.m").alias("m"), F.col("p.area_m").alias("area_m"))


def with_areas(cum: DataFrame) -> DataFrame:
    """The whole's distribution function ``f`` and its integral ``area`` up to each value, in ranges like ``cumulative``."""
    n = ranges_of(cum)
    cuts = cum.groupBy("column").agg(F.percentile_approx("value", [k / n for k in range(1, n)], 16 * n).alias("cuts"))
    x = cum.join(F.broadcast(cuts), "column").select("column", "value", cuts_below(F.col("cuts"), F.col("value")).alias("part"), (F.col("cr") / F.col("tr")).alias("f"), F.coalesce(F.col("cr") / F.col("tr") * (F.col("next") - F.col("value")), F.lit(0.0)).alias("step"))
    parts = x.groupBy("column", "part").agg(F.sum("step").alias("sum"))
    offsets = parts.select("column", "part", F.coalesce(F.sum("sum").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("inner", F.coalesce(F.sum("step").over(inside), F.lit(0.0))).join(F.broadcast(offsets), ["column", "part"])
    return y.select("column", "value", "part", "f", (F.col("inner") + F.col("before")).alias("area"))


def t_closeness(synth: DataFrame, quasi: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], threshold: float = T_THRESHOLD) -> DataFrame:
    """``column, t_max, above, score`` per sensitive column."""
    t = t_distances(synth, quasi, numeric, categorical)
    a = t.groupBy("column").agg(F.max("t").alias("t_max"), F.avg((F.col("t") > threshold).cast("double")).alias("above"))
    return a.withColumn("score", unit((1 - F.col("t_max")) * (1 - F.col("above"))))


def differential_privacy(epsilon: float = 1.0, delta: float = 0.0) -> float:
    """exp(-epsilon / 2), the ends fixed, less a small penalty for delta."""
    base = 1.0 if epsilon <= 0 else 0.0 if epsilon >= 100 else math.exp(-epsilon / 2)
    return min(max(base - min(0.2, 100 * delta), 0.0), 1.0)
