"""Frames that metrics share: the long table of both sides and cumulative counts by value.

A sorted window over a whole column would be one task however large the column is. Values are
therefore dealt to ranges between approximate quantiles; windows run inside a range, and the few totals
per range give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabassay.operators.caster import quoted

RANGES = 16
COPIES = 10_000
BUCKETS = 1 << 16
MANY = 500


def ranges_of(frame: DataFrame) -> int:
    """How many ranges a column is dealt to: more where the session shuffles to more partitions, without an upper end."""
    return max(RANGES, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def cuts_below(cuts: Column, value: Column, inclusive: bool = False) -> Column:
    """How many of the ascending ``cuts`` are less than ``value`` (or equal): counted, or with many cuts, where that is quicker, by a binary search."""

    lower = lambda c: c <= value if inclusive else c < value

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        less = lower(F.get(cuts, mid))
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(less, mid + 1).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(mid).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1.0)).cast("int"))
    searched = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high")), step, lambda s: s["low"])
    return F.when(F.size(cuts) <= MANY, F.size(F.filter(cuts, lower))).otherwise(searched)


def stacked(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides in one frame with ``is_real``, so every metric scans and shuffles once."""
    pick = lambda t, flag: t.select(*[quoted(c) for c in columns], F.lit(flag).alias("is_real"))
    return pick(real, True).unionByName(pick(synth, False))


def long_numbers(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, is_real`` of numeric columns, nulls left out."""
    both = stacked(real, synth, columns)
    return both.select("is_real", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns])).alias("p")).select("p.column", "p.value", "is_real").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def long_texts(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    both = stacked(real, synth, columns)
    return both.select("is_real", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.column", "p.value", "is_real").filter(F.col("value").isNotNull())


def lowest(marked: DataFrame, order: Sequence[str | Column], most: int) -> DataFrame:
    """The ``most`` rows of least ``__u`` in [0, 1), ties by ``order``, without bringing them to one task.

    Rows are counted in BUCKETS of ``__u``. Buckets below the one that ``most`` falls into are taken whole; of that one
    only so many rows are ordered as it holds.
    """
    bucket = F.floor(F.col("__u") * BUCKETS).cast("int")
    below, boundary = 0, None
    for r in marked.groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect():
        if below + r["count"] > most:
            boundary = r["bucket"]
            break
        below += r["count"]
    if boundary is None:
        return marked
    edge = marked.filter(bucket == boundary).orderBy("__u", *order).limit(most - below)
    return marked.filter(bucket < boundary).unionByName(edge)


def hash_sample(frame: DataFrame, columns: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, the first by a hash of ``columns`` and in that order: the same rows on every run."""
    names = [quoted(c) for c in columns]
    u = F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return lowest(frame.withColumn("__u", u), names, most).orderBy("__u", *names).drop("__u")


def row_sample(frame: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, the first by a hash of the row and its number among equal rows and in that order: the same rows on every run.

    Equal rows are drawn one by one, so a frequent row has its share of the sample.
    """
    names = [quoted(c) for c in frame.columns]
    counts = frame.groupBy(*names).agg(F.count("*").alias("__n"))
    # Two steps, so that no array has an entry for every copy.
    high = counts.select(*names, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / COPIES))).alias("__high"))
    low = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(COPIES).cast("bigint"), F.col("__n") - F.col("__high") * COPIES) - 1)
    each = high.select(*names, "__high", F.explode(low).alias("__low"))
    copy = F.col("__high") * COPIES + F.col("__low")
    u = F.pmod(F.xxhash64(*names, copy, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    marked = each.select(*names, copy.alias("__copy"), u.alias("__u"))
    return lowest(marked, [*names, F.col("__copy")], most).orderBy("__u", *names, "__copy").select(*names)


def flag(name: str = "is_real") -> Column:
    return F.col(name).cast("bigint")


def value_counts(long: DataFrame) -> DataFrame:
    """``column, value, nr, ns``: how often each value stands on either side."""
    return long.groupBy("column", "value").agg(F.sum(flag()).alias("nr"), F.sum(1 - flag()).alias("ns"))


def cumulative(counts: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """``value_counts`` with the counts up to each value (cr, cs), totals (tr, ts) and the next value.

    Cut points come from approximate quantiles of the distinct values; they decide only where the work
    is split, never a result.
    """
    keys = list(keys)
    n = ranges_of(counts)
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("value", [k / n for k in range(1, n)], 16 * n).alias("cuts"))
    dealt = counts.join(F.broadcast(cuts), keys).withColumn("part", cuts_below(F.col("cuts"), F.col("value"))).drop("cuts")
    parts = dealt.groupBy(*keys, "part").agg(F.sum("nr").alias("pr"), F.sum("ns").alias("ps"), F.min("value").alias("first"))
    order, every = Window.partitionBy(*keys).orderBy("part"), Window.partitionBy(*keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        "part",
        F.coalesce(F.sum("pr").over(before), F.lit(0)).alias("br"),
        F.coalesce(F.sum("ps").over(before), F.lit(0)).alias("bs"),
        F.sum("pr").over(every).alias("tr"),
        F.sum("ps").over(every).alias("ts"),
        F.lead("first").over(order).alias("after"),
    )
    inside = Window.partitionBy(*keys, "part").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({"cr": F.sum("nr").over(upto), "cs": F.sum("ns").over(upto), "next": F.lead("value").over(inside)}).join(F.broadcast(offsets), [*keys, "part"])
    return out.select(*keys, "value", "nr", "ns", (F.col("cr") + F.col("br")).alias("cr"), (F.col("cs") + F.col("bs")).alias("cs"), "tr", "ts", F.coalesce("next", "after").alias("next"))


def at_rank(q: float, cum: str, total: str) -> Column:
    """Aggregate: the q-quantile with linear interpolation, from cumulative counts."""
    place = F.lit(q) * (F.col(total) - 1)
    low = F.min(F.when(F.col(cum) > F.floor(place), F.col("value")))
    high = F.min(F.when(F.col(cum) > F.ceil(place), F.col("value")))
    share = F.max(place - F.floor(place))
    return low + (high - low) * share
