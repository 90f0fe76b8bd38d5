"""Column-by-column fidelity: tails, scales and coverage.

Results are ``column, raw``. Metrics of one family come from one frame: everything about the empirical
distribution from cumulative counts, everything about bins from one count per bin. A column needs two
values on either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabassay.operators.frames import at_rank, cumulative, flag, long_numbers, long_texts, value_counts
from tabassay.plans.storage import checkpointed

BINS = 50
FEW_DISTINCT = 20
TINY = 1e-10
GRID, REACH = 1000, 9.0

# Upper and lower quantiles whose exceedance is compared.
UPPER, LOWER = (0.90, 0.95, 0.99), (0.01, 0.05, 0.10)

MOMENTS = ("delta_mean", "cohens_d")
QUANTILES = ("delta_median", "delta_iqr")
DISTRIBUTION = ("ks", "wasserstein", "anderson_darling", "gini_delta")
COVERAGE = ("tvd", "js", "kl", "psi", "entropy_delta")
GROUPS = (QUANTILES, DISTRIBUTION, ("delta_mad",), ("delta_exceedance",), ("hellinger",), ("kde_ise",))


def enough(c: Column, nr: Column, ns: Column) -> Column:
    return F.when((nr >= 2) & (ns >= 2), c)


def moments(long: DataFrame) -> DataFrame:
    """column, delta_mean, cohens_d: one aggregate with partial sums."""
    of = lambda f, side: f(F.when(flag() == side, F.col("value")))
    a = long.groupBy("column").agg(of(F.avg, 1).alias("mr"), of(F.avg, 0).alias("ms"), of(F.var_samp, 1).alias("vr"), of(F.var_samp, 0).alias("vs"), of(F.count, 1).alias("nr"), of(F.count, 0).alias("ns"))
    gap, spread = F.abs(F.col("mr") - F.col("ms")), F.sqrt("vr")
    pooled = F.sqrt(((F.col("nr") - 1) * F.col("vr") + (F.col("ns") - 1) * F.col("vs")) / (F.col("nr") + F.col("ns") - 2))
    nr, ns = F.col("nr"), F.col("ns")
    return a.select("column", enough(F.when(spread > TINY, gap / spread).otherwise(gap), nr, ns).alias("delta_mean"), enough(F.when(pooled > TINY, gap / pooled).otherwise(0.0), nr, ns).alias("cohens_d"))


def over(gap: Column, scale: Column) -> Column:
    return F.when(scale > TINY, gap / scale).otherwise(gap)


def quartiles(cum: DataFrame) -> DataFrame:
    """column, rq1..sq3 and totals: exact quartiles of both sides from cumulative counts."""
    picks = [at_rank(q, f"c{s}", f"t{s}").alias(f"{s}q{k}") for s in "rs" for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return cum.groupBy("column").agg(*picks, F.max("tr").alias("nr"), F.max("ts").alias("ns"))


def quantile_gaps(cum: DataFrame) -> DataFrame:
    """column, delta_median, delta_iqr."""
    q = quartiles(cum)
    iqr_r, iqr_s = F.col("rq3") - F.col("rq1"), F.col("sq3") - F.col("sq1")
    nr, ns = F.col("nr"), F.col("ns")
    return q.select("column", enough(over(F.abs(F.col("rq2") - F.col("sq2")), iqr_r), nr, ns).alias("delta_median"), enough(over(F.abs(iqr_r - iqr_s), iqr_r), nr, ns).alias("delta_iqr"))


def mad_gap(counts: DataFrame, cum: DataFrame) -> DataFrame:
    """column, delta_mad: medians, then exact medians of the distances of counted values to them (a few rows are joined back)."""
    medians = cum.groupBy("column").agg(at_rank(0.5, "cr", "tr").alias("mr"), at_rank(0.5, "cs", "ts").alias("ms"))
    none = F.lit(0).cast("bigint")
    side = lambda m, nr, ns: F.struct(F.abs(F.col("value") - F.col(m)).alias("value"), nr.alias("nr"), ns.alias("ns"))
    both = counts.join(F.broadcast(medians), "column").select("column", F.explode(F.array(side("mr", F.col("nr"), none), side("ms", none, F.col("ns")))).alias("p")).select("column", "p.*")
    apart = both.filter((F.col("nr") > 0) | (F.col("ns") > 0)).groupBy("column", "value").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns"))
    m = cumulative(apart).groupBy("column").agg(at_rank(0.5, "cr", "tr").alias("r"), at_rank(0.5, "cs", "ts").alias("s"), F.max("tr").alias("nr"), F.max("ts").alias("ns"))
    return m.select("column", enough(over(F.abs(F.col("r") - F.col("s")), F.col("r")), F.col("nr"), F.col("ns")).alias("delta_mad"))


def distribution(cum: DataFrame) -> DataFrame:
    """column, ks, wasserstein, anderson_darling, gini_delta from one pass over cumulative counts.

    The Anderson-Darling statistic is the two-sample midrank form. Gini uses values shifted to start at 1 on their own
    side; sums over runs of equal values follow from their counts.
    """
    fr, fs = F.col("cr") / F.col("tr"), F.col("cs") / F.col("ts")
    n, l, c = F.col("tr") + F.col("ts"), F.col("nr") + F.col("ns"), F.col("cr") + F.col("cs")
    b = c - l / 2
    below = b * (n - b) - n * l / 4

    def inner(cum_side: str, own: str, total: str) -> Column:
        m = F.col(cum_side) - F.col(own) / 2
        return F.sum(F.when(below > 0, l / n * (n * m - b * F.col(total)) ** 2 / below)) / F.max(total)

    def gini(own: str, upto: str, total: str, least: Column) -> list[Column]:
        k, i = F.col(own), F.col(upto)
        ranks = k * i - k * (k - 1) / 2
        return [F.sum(ranks * F.col("value")), F.sum(ranks), F.sum(k * F.col("value")), F.max(total), least]

    low = lambda own: F.min(F.when(F.col(own) > 0, F.col("value")))
    sums = [x.alias(f"g{s}{k}") for s, own, upto, total in (("r", "nr", "cr", "tr"), ("s", "ns", "cs", "ts")) for k, x in enumerate(gini(own, upto, total, low(own)))]
    a = cum.groupBy("column").agg(
        F.max(F.abs(fr - fs)).alias("ks"),
        F.sum(F.abs(fr - fs) * F.coalesce(F.col("next") - F.col("value"), F.lit(0.0))).alias("wasserstein"),
        ((F.max(n) - 1) / F.max(n) * (inner("cr", "nr", "tr") + inner("cs", "ns", "ts"))).alias("anderson_darling"),
        *sums,
    )

    def coefficient(s: str) -> Column:
        rank_sum, ranks, total, size, least = (F.col(f"g{s}{k}") for k in range(5))
        shifted, ranked = total - size * least + size, rank_sum + ranks * (1 - least)
        return F.when(shifted > 0, (2 * ranked - (size + 1) * shifted) / (size * shifted)).otherwise(0.0)

    nr, ns = F.col("gr3"), F.col("gs3")
    return a.select("column", *[enough(F.col(c), nr, ns).alias(c) for c in ("ks", "wasserstein", "anderson_darling")], enough(F.abs(coefficient("r") - coefficient("s")), nr, ns).alias("gini_delta"))


def exceedance(long: DataFrame, cum: DataFrame) -> DataFrame:
    """column, delta_exceedance: shares beyond the real side's outer quantiles."""
    marks = cum.groupBy("column").agg(*[at_rank(q, "cr", "tr").alias(f"q{k}") for k, q in enumerate((*UPPER, *LOWER))])
    beyond = [F.col("value") > F.col(f"q{k}") if k < len(UPPER) else F.col("value") < F.col(f"q{k}") for k in range(len(UPPER) + len(LOWER))]
    joined = cum.join(F.broadcast(marks), "column")
    shares = [F.abs(F.sum(F.when(x, F.col("nr")).otherwise(0)) / F.max("tr") - F.sum(F.when(x, F.col("ns")).otherwise(0)) / F.max("ts")) for x in beyond]
    a = joined.groupBy("column").agg((sum(shares[1:], shares[0]) / len(shares)).alias("raw"), F.max("tr").alias("nr"), F.max("ts").alias("ns"))
    return a.select("column", enough(F.col("raw"), F.col("nr"), F.col("ns")).alias("delta_exceedance"))


def bin_of(value: Column, low: Column, high: Column, bins: int = BINS) -> Column:
    """Equal-width bins closed on the left, the last on both sides; a lone value spreads to one unit around it."""
    flat = high <= low
    start, width = F.when(flat, low - 0.5).otherwise(low), F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.least(F.floor((value - start) / width * bins), F.lit(bins - 1)).cast("int")


def binned(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """column, bin, nr, ns and the pooled range, from counts of values; empty bins have no row."""
    span = counts.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.when(F.col("nr") > 0, 1).otherwise(0)).alias("distinct_real"), F.sum("nr").alias("tr"), F.sum("ns").alias("ts"))
    placed = counts.join(F.broadcast(span), "column").withColumn("bin", bin_of(F.col("value"), F.col("low"), F.col("high"), bins))
    return placed.groupBy("column", "bin").agg(F.sum("nr").alias("nr"), F.sum("ns").alias("ns"), *[F.max(c).alias(c) for c in ("low", "high", "distinct_real", "tr", "ts")])


def hellinger(bins: DataFrame) -> DataFrame:
    """column, hellinger over pooled bins of densities, each bin with a tiny floor, empty bins too."""
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / BINS)
    p, q = F.col("nr") / (F.col("tr") * width) * width + TINY, F.col("ns") / (F.col("ts") * width) * width + TINY
    empty = F.lit(BINS) - F.count("*")
    sp, sq = F.sum(p) + empty * TINY, F.sum(q) + empty * TINY
    affinity = (F.sum(F.sqrt(p * q)) + empty * TINY) / F.sqrt(sp * sq)
    a = bins.groupBy("column").agg(F.sqrt(F.greatest(1 - affinity, F.lit(0.0))).alias("raw"), F.max("tr").alias("nr"), F.max("ts").alias("ns"))
    return a.select("column", enough(F.coalesce("raw", F.lit(0.0)), F.col("nr"), F.col("ns")).alias("hellinger"))


def coverage(aligned: DataFrame) -> DataFrame:
    """column, tvd, js, kl, psi, entropy_delta of aligned shares; ``aligned``: column, nr, ns, tr, ts, empty.

    ``empty`` cells exist on neither side and carry the floor alone; they cancel in all but the sums that
    shares are divided by and the entropies.
    """
    floor = lambda c, t: F.least(F.greatest(F.col(c) / (F.col(t) + F.when(F.col("empty").isNull(), F.lit(0.0)).otherwise(F.lit(TINY))), F.lit(TINY)), F.lit(1.0))
    shares = aligned.select("column", floor("nr", "tr").alias("p0"), floor("ns", "ts").alias("q0"), F.coalesce("empty", F.lit(0)).alias("empty"), "tr", "ts")
    sums = shares.groupBy("column").agg((F.sum("p0") + F.max("empty") * TINY).alias("sp"), (F.sum("q0") + F.max("empty") * TINY).alias("sq"))
    x = shares.join(F.broadcast(sums), "column").withColumns({"p": F.col("p0") / F.col("sp"), "q": F.col("q0") / F.col("sq")})
    p, q, m = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    e, fp, fq = F.max("empty"), TINY / F.max("sp"), TINY / F.max("sq")
    kl = F.sum(p * F.log(p / q)) + e * fp * F.log(fp / fq)
    fm = (fp + fq) / 2
    js = 0.5 * (F.sum(p * F.log(p / m) + q * F.log(q / m)) + e * (fp * F.log(fp / fm) + fq * F.log(fq / fm)))
    psi = F.sum((p - q) * F.log(p / q)) + e * (fp - fq) * F.log(fp / fq)
    hr, hs = -(F.sum(p * F.log(p)) + e * fp * F.log(fp)), -(F.sum(q * F.log(q)) + e * fq * F.log(fq))
    a = x.groupBy("column").agg(
        (0.5 * (F.sum(F.abs(p - q)) + e * F.abs(fp - fq))).alias("tvd"),
        F.sqrt(F.greatest(js, F.lit(0.0))).alias("js"),
        F.least(kl, F.lit(10.0)).alias("kl"),
        F.least(psi, F.lit(10.0)).alias("psi"),
        F.when(hr > TINY, F.abs(hr - hs) / hr).otherwise(F.abs(hr - hs)).alias("entropy_delta"),
        F.max("tr").alias("nr"),
        F.max("ts").alias("ns"),
    )
    return a.select("column", *[enough(F.col(c), F.col("nr"), F.col("ns")).alias(c) for c in COVERAGE])


def aligned_numbers(counts: DataFrame) -> DataFrame:
    """Cells of numeric columns: values themselves where the real side has few, else pooled bins."""
    bins = binned(counts)
    many = bins.filter(F.col("distinct_real") >= FEW_DISTINCT)
    used = many.groupBy("column").agg(F.count("*").alias("used"))
    many = many.join(F.broadcast(used), "column").select("column", "nr", "ns", "tr", "ts", (F.lit(BINS) - F.col("used")).alias("empty"))
    totals = bins.groupBy("column").agg(F.max("distinct_real").alias("distinct_real"), F.max("tr").alias("tr"), F.max("ts").alias("ts"))
    few = counts.join(F.broadcast(totals.filter(F.col("distinct_real") < FEW_DISTINCT)), "column").select("column", "nr", "ns", "tr", "ts", F.lit(None).cast("bigint").alias("empty"))
    return many.unionByName(few)


def aligned_texts(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts"))
    return counts.join(F.broadcast(totals), "column").select("column", "nr", "ns", "tr", "ts", F.lit(None).cast("bigint").alias("empty"))


def density_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of both sides' kernels on the grid, a row per column and point for each task.

    Values are taken in ascending order, so a stretch of them reaches a few points only; points beyond nine widths get less
    than 1e-17 of a value's density and are left out.
    """
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        columns = batch.column(0).to_numpy(zero_copy_only=False)
        value, nr, ns, start, step, hr, hs = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:])
        for name in dict.fromkeys(columns):
            own = np.flatnonzero(columns == name)
            own = own[np.argsort(value[own], kind="stable")]
            at, gap, widths = start[own[0]], step[own[0]], (hr[own[0]], hs[own[0]])
            total, reach = sums.setdefault(name, np.zeros((2, GRID))), REACH * max(widths)
            for part in np.array_split(own, -(-len(own) // 512)):
                v = value[part]
                first, last = max(math.ceil((v[0] - reach - at) / gap), 0), min(math.floor((v[-1] + reach - at) / gap), GRID - 1)
                if first > last:
                    continue
                apart = at + np.arange(first, last + 1) * gap - v[:, None]
                for side, n in enumerate((nr, ns)):
                    total[side, first : last + 1] += n[part] @ np.exp(-0.5 * (apart / widths[side]) ** 2)
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * GRID), pa.array(range(GRID), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["column", "k", "fr", "fs"])


def kde_ise(counts: DataFrame) -> DataFrame:
    """column, kde_ise: squared distance of Gaussian kernel densities (Scott's width) on a grid of 1000 points.

    Values are first merged into counts; every task adds its values up on the grid and gives one row per column and point.
    """
    w = lambda c: F.col(c).cast("double")
    var = lambda k, t: (F.sum(w(k) * F.col("value") ** 2) - F.sum(w(k) * F.col("value")) ** 2 / F.sum(w(k))) / (F.sum(w(k)) - 1)
    mean = lambda k: F.sum(w(k) * F.col("value")) / F.sum(w(k))
    centred = counts.join(F.broadcast(counts.groupBy("column").agg(mean("nr").alias("shift"))), "column").withColumn("value", F.col("value") - F.col("shift"))
    span = centred.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("nr").alias("tr"), F.sum("ns").alias("ts"), var("nr", "tr").alias("vr"), var("ns", "ts").alias("vs"), mean("nr").alias("mr"), mean("ns").alias("ms"))
    width = lambda v, n: F.sqrt(v) * F.pow(n, F.lit(-0.2))
    margin = 0.1 * (F.col("high") - F.col("low"))
    span = span.withColumns({"hr": width(F.greatest("vr", F.lit(0.0)), F.col("tr")), "hs": width(F.greatest("vs", F.lit(0.0)), F.col("ts")), "from": F.col("low") - margin, "step": (F.col("high") - F.col("low") + 2 * margin) / (GRID - 1)})
    flat = (F.col("hr") < TINY) | (F.col("hs") < TINY)
    near = centred.join(F.broadcast(span.filter(~flat)), "column").select("column", "value", "nr", "ns", "from", "step", "hr", "hs")
    points = near.mapInArrow(density_batches, "column string, k int, fr double, fs double").groupBy("column", "k").agg(F.sum("fr").alias("fr"), F.sum("fs").alias("fs"))
    scaled = points.join(F.broadcast(span), "column").withColumns({"fr": F.col("fr") / (F.col("tr") * F.col("hr")), "fs": F.col("fs") / (F.col("ts") * F.col("hs"))})
    curved = scaled.groupBy("column").agg((F.sum((F.col("fr") - F.col("fs")) ** 2) * F.max("step") / (2 * F.lit(3.141592653589793))).alias("ise"))
    out = span.join(F.broadcast(curved), "column", "left")
    raw = F.when(flat, F.abs(F.col("mr") - F.col("ms"))).otherwise(F.col("ise"))
    return out.select("column", enough(raw, F.col("tr"), F.col("ts")).alias("kde_ise"))


def numeric_metrics(real: DataFrame, synth: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``metric, column, raw`` for the numeric metrics asked for.

    Where several groups are wanted, or one that uses them twice, the cumulative counts they all use are written once to the checkpoint
    folder, so the tables are scanned for them once and not for every group.
    """
    long = long_numbers(real, synth, columns)
    counts = value_counts(long)
    cum = cumulative(counts)
    if len({g for g in GROUPS if set(g) & set(names)}) > 1 or {"delta_mad", "delta_exceedance"} & set(names):
        cum = checkpointed(cum)
        counts = cum.select("column", "value", "nr", "ns")
    made = {}
    if set(names) & set(MOMENTS):
        made[MOMENTS] = moments(long)
    if set(names) & set(QUANTILES):
        made[QUANTILES] = quantile_gaps(cum)
    if "delta_mad" in names:
        made["delta_mad",] = mad_gap(counts, cum)
    if set(names) & set(DISTRIBUTION):
        made[DISTRIBUTION] = distribution(cum)
    if "delta_exceedance" in names:
        made["delta_exceedance",] = exceedance(long, cum)
    if "hellinger" in names:
        made["hellinger",] = hellinger(binned(counts))
    if "kde_ise" in names:
        made["kde_ise",] = kde_ise(counts)
    return tall(made, names)


def universal_metrics(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``metric, column, raw`` for metrics of shares, over both kinds of columns."""
    parts = []
    if numeric:
        parts.append(aligned_numbers(value_counts(long_numbers(real, synth, numeric))))
    if categorical:
        parts.append(aligned_texts(value_counts(long_texts(real, synth, categorical))))
    aligned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return tall({COVERAGE: coverage(aligned)}, names)


def tall(made: dict[tuple[str, ...], DataFrame], names: Sequence[str]) -> DataFrame:
    out = None
    for group, wide in made.items():
        own = [n for n in group if n in names]
        one = wide.select("column", F.explode(F.array(*[F.struct(F.lit(f"fidelity.{n}").alias("metric"), F.col(n).alias("raw")) for n in own])).alias("m")).select("m.metric", "column", "m.raw")
        out = one if out is None else out.unionByName(one)
    return out


ALL_NUMERIC = (*DISTRIBUTION[:3], "hellinger", "kde_ise", "delta_exceedance", *MOMENTS, *QUANTILES, "delta_mad", "gini_delta")
