"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabassay.llm.common import WORD, checkpointed, small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5, the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size`` -> also ``target``: weighted shares of ``share`` times all sizes, none above ``most`` times its source's size.

    Resharing an excess until none is left ends at a water level: ``least(most * size, level * weight)``.
    In order of most * size / weight, the level is that of the first source at which the rest of the
    total, spread over the weights from there on, stays below its limit; later ones are lower. Runs on one row per source.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    upto, from_here = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("rest", share * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("rest") / F.sum("weight").over(from_here))
    level = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``key, source, size, source_size, target, copies, taken`` per row of ``docs``.

    A document is taken floor(rate) times, rate = target / source_size, plus once more with the
    probability of the fraction, decided by a hash of its key. Rows with the same key share that
    decision. Null and empty texts have size 0 and take nothing; the null source counts as one, the last.
    An empty table gives no rows. The sizes are counted once and written to the checkpoint folder; sums
    per source are combined before their shuffle, and Spark's measured sizes decide whether the few
    rows of targets are broadcast or joined with a hot source split.
    """
    sized = checkpointed(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, most).select(F.col("source").alias("of"), "source_size", "target")
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate).cast("int") + (unit(F.col("key"), seed) < rate - F.floor(rate)).cast("int")
    return joined.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def take_mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it, all its columns kept.

    Only sums per source are joined back, so texts stay where they are.
    """
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    totals = docs.select(F.col(source).cast("string").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = small_side(goal.select(F.col("source").alias("__of"), rate.alias("__rate")))
    joined = docs.join(goal, docs[source].cast("string").eqNullSafe(goal["__of"]), "left")
    copies = F.floor("__rate").cast("int") + (unit(docs[key], seed) < F.col("__rate") - F.floor("__rate")).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), limits AS (SELECT *, 2 * CAST(source_size AS DOUBLE) AS most FROM totals),
levels AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM limits
), goal AS (
  SELECT source, source_size, least(most, max(CASE WHEN level <= most / weight THEN level END) OVER () * weight) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
