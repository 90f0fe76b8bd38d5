"""The registered queries over the shared test tables, and DuckDB SQL that gives the same rows.

Real and synthetic halves of a table are the even and odd keys; the synthetic half drifts by fixed rules.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import tabassay.generators.models  # noqa: F401  registers
from tabassay.functions.aggregate import AGGREGATORS, aggregate_column, hypervolume, run_statistics, weighted_score
from tabassay.functions.normalize import BOUNDED, CLOSEST, DELTA, INFORMATION, LOSS, RULES, SIMILARITY, UNBOUNDED, as_column, column_scores, percentile_scores
from tabassay.functions.ranktests import friedman, mean_ranks, wilcoxon
from tabassay.generators.simple import uniform_noise
from tabassay.operators import learning, marginal, pairs, privacy, whole
from tabassay.operators.caster import CastTable, Caster, prepare
from tabassay.plans.benchmark import score_table
from tabassay.plans.calibrate import bounds_of, place
from tabassay.plans.evaluate import marginal_report, redacted_counts, univariate
from tabassay.plans.registry import GENERATORS
from tabassay.plans.storage import shared_folder
from tabassay.plans.taxonomy import PLACES
from tabassay.schema import TableSchema
from tabassay.sources import loaders
from tabassay.streaming.drift import monitor

RULE_NAMES = (BOUNDED, UNBOUNDED, SIMILARITY, DELTA, INFORMATION, CLOSEST, LOSS)
Query = Callable[[SparkSession, str], DataFrame]

LINEITEM = {"l_quantity": "continuous", "l_extendedprice": "continuous", "l_discount": "continuous", "l_tax": "continuous", "l_shipdate": "datetime", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_mode": "categorical"}
NUMERIC = ["l_discount", "l_extendedprice", "l_quantity", "l_shipdate__ts", "l_tax"]
CATEGORICAL = ["l_linestatus", "l_mode", "l_returnflag"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_halves(spark: SparkSession, sf_dir: str) -> tuple[CastTable, CastTable]:
    rows = table(spark, sf_dir, "lineitem").withColumn("l_mode", F.concat(F.lit("m"), F.col("l_linenumber") % 4))
    real = rows.filter("l_orderkey % 2 = 0")
    drift = F.when(F.col("l_linenumber") % 3 == 0, "R").otherwise(F.col("l_returnflag"))
    synth = rows.filter("l_orderkey % 2 = 1").withColumns({"l_extendedprice": F.col("l_extendedprice") * 1.1 + 100, "l_returnflag": drift})
    return prepare(real, synth, TableSchema.of(LINEITEM))


def _half(parity: int, price: str, returned: str) -> str:
    return f"SELECT l_quantity, {price} AS l_extendedprice, l_discount, l_tax, epoch_us(l_shipdate) / 1e6 AS l_shipdate__ts, lower({returned}) AS l_returnflag, lower(l_linestatus) AS l_linestatus, 'm' || (l_linenumber % 4) AS l_mode FROM lineitem WHERE l_orderkey % 2 = {parity}"


HALVES = f"""real AS ({_half(0, "l_extendedprice", "l_returnflag")}),
synth AS ({_half(1, "l_extendedprice * 1.1 + 100", "CASE WHEN l_linenumber % 3 = 0 THEN 'R' ELSE l_returnflag END")}),
both_sides AS (SELECT *, TRUE AS is_real FROM real UNION ALL SELECT *, FALSE AS is_real FROM synth)"""


def _long(columns: list[str], name: str, kind: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS {kind}) AS value, is_real FROM both_sides" for c in columns)
    return f"{name} AS ({each})"


NUMBERS = f"""WITH {HALVES}, {_long(NUMERIC, "numbers", "DOUBLE")},
counts AS (SELECT col, value, count(*) FILTER (is_real) AS nr, count(*) FILTER (NOT is_real) AS ns FROM numbers GROUP BY col, value),
cum AS (SELECT *, sum(nr) OVER w AS cr, sum(ns) OVER w AS cs, sum(nr) OVER (PARTITION BY col) AS tr, sum(ns) OVER (PARTITION BY col) AS ts, lead(value) OVER w AS nxt FROM counts WINDOW w AS (PARTITION BY col ORDER BY value)),
quant AS (SELECT col, quantile_cont(value, 0.25) FILTER (is_real) AS r1, median(value) FILTER (is_real) AS r2, quantile_cont(value, 0.75) FILTER (is_real) AS r3,
  quantile_cont(value, 0.25) FILTER (NOT is_real) AS s1, median(value) FILTER (NOT is_real) AS s2, quantile_cont(value, 0.75) FILTER (NOT is_real) AS s3, avg(value) FILTER (is_real) AS mr, avg(value) FILTER (NOT is_real) AS ms,
  var_samp(value) FILTER (is_real) AS vr, var_samp(value) FILTER (NOT is_real) AS vs, count(*) FILTER (is_real) AS tr, count(*) FILTER (NOT is_real) AS ts, min(value) AS low, max(value) AS high, count(DISTINCT value) FILTER (is_real) AS distinct_real,
  min(value) FILTER (is_real) AS min_r, max(value) FILTER (is_real) AS max_r, min(value) FILTER (NOT is_real) AS min_s, max(value) FILTER (NOT is_real) AS max_s FROM numbers GROUP BY col)"""


def _rows(metric: str, raw: str, source: str, more: str = "") -> str:
    return f"{NUMBERS}{more} SELECT 'fidelity.{metric}' AS metric, col AS \"column\", round({raw}, 6) AS raw FROM {source}"


def _over(gap: str, scale: str) -> str:
    return f"CASE WHEN {scale} > 1e-10 THEN {gap} / {scale} ELSE {gap} END"


_GINI = "(2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x))"
_BIN = "CAST(least(floor((value - low) / (high - low) * 50), 49) AS INTEGER)"
_BINS = f""", cells AS (SELECT q.col, b.bin, count(n.value) FILTER (n.is_real) AS nr, count(n.value) FILTER (NOT n.is_real) AS ns, any_value(q.tr) AS tr, any_value(q.ts) AS ts
  FROM quant q CROSS JOIN (SELECT unnest(range(50)) AS bin) b LEFT JOIN (SELECT n.col, n.is_real, n.value, {_BIN} AS bin FROM numbers n JOIN quant USING (col)) n ON n.col = q.col AND n.bin = b.bin GROUP BY q.col, b.bin)"""
_EXCEED = " + ".join([f"abs(avg(CASE WHEN value > q{k} THEN 1.0 ELSE 0 END) FILTER (is_real) - avg(CASE WHEN value > q{k} THEN 1.0 ELSE 0 END) FILTER (NOT is_real))" for k in range(3)] + [f"abs(avg(CASE WHEN value < q{k} THEN 1.0 ELSE 0 END) FILTER (is_real) - avg(CASE WHEN value < q{k} THEN 1.0 ELSE 0 END) FILTER (NOT is_real))" for k in range(3, 6)])
_AD = """, ad AS (SELECT *, tr + ts AS n, nr + ns AS l, cr + cs - (nr + ns) / 2.0 AS b FROM cum),
ad2 AS (SELECT col, max(n) AS n, max(tr) AS tr, max(ts) AS ts, sum(l / n * (n * (cr - nr / 2.0) - b * tr) ** 2 / (b * (n - b) - n * l / 4.0)) AS a, sum(l / n * (n * (cs - ns / 2.0) - b * ts) ** 2 / (b * (n - b) - n * l / 4.0)) AS c FROM ad WHERE b * (n - b) - n * l / 4.0 > 0 GROUP BY col)"""
_KDE = """, h AS (SELECT *, sqrt(vr) * tr ** -0.2 AS hr, sqrt(vs) * ts ** -0.2 AS hs, low - 0.1 * (high - low) AS start, (high - low) * 1.2 / 999 AS step FROM quant),
grid AS (SELECT h.col, k, sum(nr * exp(-0.5 * ((start + k * step - value) / hr) ** 2)) / any_value(h.tr * hr) AS fr, sum(ns * exp(-0.5 * ((start + k * step - value) / hs) ** 2)) / any_value(h.ts * hs) AS fs, any_value(step) AS step
  FROM counts JOIN h USING (col) CROSS JOIN (SELECT unnest(range(1000)) AS k) g GROUP BY h.col, k)"""

NUMERIC_SQL = {
    "ks": _rows("ks", "max(abs(cr / tr - cs / ts))", "cum GROUP BY col"),
    "wasserstein": _rows("wasserstein", "sum(abs(cr / tr - cs / ts) * coalesce(nxt - value, 0))", "cum GROUP BY col"),
    "anderson_darling": _rows("anderson_darling", "(n - 1.0) / n * (a / tr + c / ts)", "ad2", _AD),
    "hellinger": _rows("hellinger", "sqrt(greatest(0, 1 - sum(sqrt((nr / tr + 1e-10) * (ns / ts + 1e-10))) / sqrt(sum(nr / tr + 1e-10) * sum(ns / ts + 1e-10))))", "cells GROUP BY col", _BINS),
    "kde_ise": _rows("kde_ise", "sum((fr - fs) ** 2) * any_value(step) / (2 * pi())", "grid GROUP BY col", _KDE),
    "delta_exceedance": _rows("delta_exceedance", f"({_EXCEED}) / 6", "numbers JOIN marks USING (col) GROUP BY col", ", marks AS (SELECT col, " + ", ".join(f"quantile_cont(value, {q}) FILTER (is_real) AS q{k}" for k, q in enumerate((*marginal.UPPER, *marginal.LOWER))) + " FROM numbers GROUP BY col)"),
    "delta_mean": _rows("delta_mean", _over("abs(mr - ms)", "sqrt(vr)"), "quant"),
    "cohens_d": _rows("cohens_d", "abs(mr - ms) / sqrt(((tr - 1) * vr + (ts - 1) * vs) / (tr + ts - 2))", "quant"),
    "delta_median": _rows("delta_median", _over("abs(r2 - s2)", "(r3 - r1)"), "quant"),
    "delta_iqr": _rows("delta_iqr", _over("abs((r3 - r1) - (s3 - s1))", "(r3 - r1)"), "quant"),
    "delta_mad": _rows("delta_mad", _over("abs(a - b)", "a"), "mads", ", mads AS (SELECT col, median(abs(value - r2)) FILTER (is_real) AS a, median(abs(value - s2)) FILTER (NOT is_real) AS b FROM numbers JOIN quant USING (col) GROUP BY col)"),
    "gini_delta": _rows("gini_delta", "abs(max(g) FILTER (is_real) - max(g) FILTER (NOT is_real))", "gini GROUP BY col", f", ranked AS (SELECT col, is_real, value - min(value) OVER (PARTITION BY col, is_real) + 1 AS x, row_number() OVER (PARTITION BY col, is_real ORDER BY value) AS i FROM numbers), gini AS (SELECT col, is_real, {_GINI} AS g FROM ranked GROUP BY col, is_real)"),
}

_ALIGNED = f"""{_BINS}, {_long(CATEGORICAL, "texts", "VARCHAR")},
raw_cells AS (
  SELECT col, nr / (tr + 1e-10) AS p, ns / (ts + 1e-10) AS q FROM cells JOIN (SELECT col FROM quant WHERE distinct_real >= 20) USING (col)
  UNION ALL SELECT col, nr / tr AS p, ns / ts AS q FROM cum JOIN (SELECT col FROM quant WHERE distinct_real < 20) USING (col)
  UNION ALL SELECT col, nr / sum(nr) OVER (PARTITION BY col) AS p, ns / sum(ns) OVER (PARTITION BY col) AS q FROM (SELECT col, value, count(*) FILTER (is_real) AS nr, count(*) FILTER (NOT is_real) AS ns FROM texts GROUP BY col, value)),
floored AS (SELECT col, least(greatest(p, 1e-10), 1) AS p, least(greatest(q, 1e-10), 1) AS q FROM raw_cells),
shares AS (SELECT col, p / sum(p) OVER (PARTITION BY col) AS p, q / sum(q) OVER (PARTITION BY col) AS q FROM floored)"""

COVERAGE_SQL = {
    "tvd": _rows("tvd", "0.5 * sum(abs(p - q))", "shares GROUP BY col", _ALIGNED),
    "js": _rows("js", "sqrt(greatest(0, 0.5 * sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))))", "shares GROUP BY col", _ALIGNED),
    "kl": _rows("kl", "least(10, sum(p * ln(p / q)))", "shares GROUP BY col", _ALIGNED),
    "psi": _rows("psi", "least(10, sum((p - q) * ln(p / q)))", "shares GROUP BY col", _ALIGNED),
    "entropy_delta": _rows("entropy_delta", "abs(sum(p * ln(p)) - sum(q * ln(q))) / -sum(p * ln(p))", "shares GROUP BY col", _ALIGNED),
}


def numeric_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        real, synth = lineitem_halves(spark, sf_dir)
        return marginal.numeric_metrics(real.frame, synth.frame, real.numeric, [name]).withColumn("raw", F.round("raw", 6))

    return run


def coverage_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        real, synth = lineitem_halves(spark, sf_dir)
        return marginal.universal_metrics(real.frame, synth.frame, real.numeric, real.categorical, [name]).withColumn("raw", F.round("raw", 6))

    return run


def pair_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name == "dcor":
            real, synth = customer_halves(spark, sf_dir)
            numeric = CUSTOMER_NUMERIC
            rows = pairs.dcor(real, synth, numeric, most=None)
        else:
            r, s = lineitem_halves(spark, sf_dir)
            rows = pairs.pair_metric(name, r.frame, s.frame, r.numeric, r.categorical)
        return rows.select("metric", "c1", "c2", *[F.round(c, 6).alias(c) for c in ("real_value", "synth_value", "delta")])

    return run


CUSTOMER_NUMERIC = ["c_acctbal", "c_load", "c_nationkey"]


def customer_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Halves of all customers, a table small enough for metrics of every pair of rows."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"), (F.col("c_custkey") * 37 % 101).cast("double").alias("c_load"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return rows.filter("c_custkey % 2 = 0"), rows.filter("c_custkey % 2 = 1").withColumn("c_acctbal", F.col("c_acctbal") * 0.9 + 250)


CUSTOMERS = """WITH base AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_custkey * 37 % 101 AS DOUBLE) AS c_load, lower(c_mktsegment) AS c_mktsegment FROM customer),
real AS (SELECT * FROM base WHERE c_custkey % 2 = 0), synth AS (SELECT c_custkey, c_acctbal * 0.9 + 250 AS c_acctbal, c_nationkey, c_load, c_mktsegment FROM base WHERE c_custkey % 2 = 1),
scale AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_load) AS m1, stddev_pop(c_load) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM real),
r AS (SELECT c_custkey AS id, (c_acctbal - m0) / s0 AS a, (c_load - m1) / s1 AS b, (c_nationkey - m2) / s2 AS c FROM real CROSS JOIN scale),
s AS (SELECT c_custkey AS id, (c_acctbal - m0) / s0 AS a, (c_load - m1) / s1 AS b, (c_nationkey - m2) / s2 AS c FROM synth CROSS JOIN scale)"""
_APART = "sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2)"
_NEAR = f""", near AS (SELECT x.id, min({_APART}) AS d FROM s x CROSS JOIN r y GROUP BY x.id)"""

_PAIRED = f"""WITH {HALVES}, pairs AS ({" UNION ALL ".join(f"SELECT is_real, '{a}' AS c1, '{b}' AS c2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM both_sides" for a, b in pairs.numeric_pairs(NUMERIC))})"""
_MIXED = f"""WITH {HALVES}, pairs AS ({" UNION ALL ".join(f"SELECT is_real, '{a}' AS c1, '{b}' AS c2, CAST({a} AS DOUBLE) AS x, {b} AS g FROM both_sides" for a, b in pairs.mixed_pairs(NUMERIC, CATEGORICAL))})"""
_CATS = f"""WITH {HALVES}, pairs AS ({" UNION ALL ".join(f"SELECT is_real, '{a}' AS c1, '{b}' AS c2, {a} AS x, {b} AS y FROM both_sides" for k, a in enumerate(CATEGORICAL) for b in CATEGORICAL[k + 1 :])}),
cells AS (SELECT is_real, c1, c2, x, y, count(*) AS n FROM pairs GROUP BY ALL),
margins AS (SELECT *, sum(n) OVER (PARTITION BY is_real, c1, c2, x) AS nx, sum(n) OVER (PARTITION BY is_real, c1, c2, y) AS ny, sum(n) OVER (PARTITION BY is_real, c1, c2) AS t FROM cells),
grid AS (SELECT a.is_real, a.c1, a.c2, nx, ny, any_value(t) AS t, coalesce(max(m.n) FILTER (m.y = b.y), 0) AS n FROM (SELECT DISTINCT is_real, c1, c2, x, nx, t FROM margins) a JOIN (SELECT DISTINCT is_real, c1, c2, y, ny FROM margins) b USING (is_real, c1, c2) LEFT JOIN cells m ON m.is_real = a.is_real AND m.c1 = a.c1 AND m.c2 = a.c2 AND m.x = a.x GROUP BY a.is_real, a.c1, a.c2, a.x, b.y, nx, ny),
shape AS (SELECT is_real, c1, c2, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM cells GROUP BY ALL),
chi AS (SELECT is_real, c1, c2, any_value(t) AS t, least(any_value(kx), any_value(ky)) - 1 AS least_k, sum(CASE WHEN kx = 2 AND ky = 2 THEN (abs(n - nx * ny / t) - least(0.5, abs(n - nx * ny / t))) ** 2 ELSE (n - nx * ny / t) ** 2 END / (nx * ny / t)) AS chi2 FROM grid JOIN shape USING (is_real, c1, c2) GROUP BY is_real, c1, c2)"""


def _pair_rows(metric: str, head: str, sides: str) -> str:
    return f"""{head}, sides AS ({sides}) SELECT 'fidelity.{metric}' AS metric, c1, c2, round(max(v) FILTER (is_real), 6) AS real_value, round(max(v) FILTER (NOT is_real), 6) AS synth_value, round(abs(max(v) FILTER (is_real) - max(v) FILTER (NOT is_real)), 6) AS delta FROM sides GROUP BY c1, c2"""


_RANKED = _MIXED + """, kept AS (SELECT *, count(*) OVER (PARTITION BY is_real, c1, c2, g) AS size, count(*) OVER (PARTITION BY is_real, c1, c2) AS alls FROM pairs),
ranked AS (SELECT is_real, c1, c2, g, alls, rank() OVER w + (count(*) OVER (PARTITION BY is_real, c1, c2, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY is_real, c1, c2, x) AS tied, count(*) OVER (PARTITION BY is_real, c1, c2) AS n FROM kept WHERE size > 1 WINDOW w AS (PARTITION BY is_real, c1, c2 ORDER BY x)),
per_group AS (SELECT is_real, c1, c2, g, sum(rk) ** 2 / count(*) AS h, any_value(n) AS n, any_value(alls) AS alls FROM ranked GROUP BY is_real, c1, c2, g),
ties AS (SELECT is_real, c1, c2, sum(CAST(tied AS DOUBLE) ** 2 - 1) AS tie FROM ranked GROUP BY is_real, c1, c2)"""
_DCOR = CUSTOMERS + """, long AS (SELECT is_real, c1, c2, x, y, row_number() OVER (PARTITION BY is_real, c1, c2) AS i FROM (
  SELECT TRUE AS is_real, 'c_acctbal' AS c1, 'c_load' AS c2, c_acctbal AS x, c_load AS y FROM real UNION ALL SELECT TRUE, 'c_acctbal', 'c_nationkey', c_acctbal, c_nationkey FROM real UNION ALL SELECT TRUE, 'c_load', 'c_nationkey', c_load, c_nationkey FROM real
  UNION ALL SELECT FALSE, 'c_acctbal', 'c_load', c_acctbal, c_load FROM synth UNION ALL SELECT FALSE, 'c_acctbal', 'c_nationkey', c_acctbal, c_nationkey FROM synth UNION ALL SELECT FALSE, 'c_load', 'c_nationkey', c_load, c_nationkey FROM synth)),
d AS (SELECT p.is_real, p.c1, p.c2, p.i, q.i AS j, abs(p.x - q.x) AS a, abs(p.y - q.y) AS b FROM long p JOIN long q USING (is_real, c1, c2)),
m AS (SELECT is_real, c1, c2, i, avg(a) AS ma, avg(b) AS mb FROM d GROUP BY is_real, c1, c2, i), g AS (SELECT is_real, c1, c2, avg(ma) AS ga, avg(mb) AS gb FROM m GROUP BY is_real, c1, c2),
e AS (SELECT d.is_real, d.c1, d.c2, a - u.ma - w.ma + ga AS a, b - u.mb - w.mb + gb AS b FROM d JOIN m u ON u.is_real = d.is_real AND u.c1 = d.c1 AND u.c2 = d.c2 AND u.i = d.i JOIN m w ON w.is_real = d.is_real AND w.c1 = d.c1 AND w.c2 = d.c2 AND w.i = d.j JOIN g ON g.is_real = d.is_real AND g.c1 = d.c1 AND g.c2 = d.c2)"""

PAIR_SQL = {
    "pearson": _pair_rows("pearson", _PAIRED, "SELECT is_real, c1, c2, abs(corr(x, y)) AS v FROM pairs GROUP BY ALL"),
    "spearman": _pair_rows("spearman", _PAIRED, "SELECT is_real, c1, c2, abs(corr(rx, ry)) AS v FROM (SELECT is_real, c1, c2, rank() OVER (PARTITION BY is_real, c1, c2 ORDER BY x) + (count(*) OVER (PARTITION BY is_real, c1, c2, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY is_real, c1, c2 ORDER BY y) + (count(*) OVER (PARTITION BY is_real, c1, c2, y) - 1) / 2.0 AS ry FROM pairs) GROUP BY ALL"),
    "mi": _pair_rows("mi", _PAIRED + """, span AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM pairs WINDOW w AS (PARTITION BY is_real, c1, c2)),
cell AS (SELECT is_real, c1, c2, greatest(least(ceil((x - lx) / ((hx - lx) / 10)), 10), 1) AS bx, greatest(least(ceil((y - ly) / ((hy - ly) / 10)), 10), 1) AS by_, count(*) AS n FROM span GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY is_real, c1, c2) AS t, sum(n) OVER (PARTITION BY is_real, c1, c2, bx) AS nx, sum(n) OVER (PARTITION BY is_real, c1, c2, by_) AS ny FROM cell)""", "SELECT is_real, c1, c2, greatest(0, sum(n / t * ln(n * t / (nx * ny)))) AS v FROM sums GROUP BY is_real, c1, c2"),
    "dcor": _pair_rows("dcor", _DCOR, "SELECT is_real, c1, c2, sqrt(greatest(0, avg(a * b)) / sqrt(avg(a * a) * avg(b * b))) AS v FROM e GROUP BY is_real, c1, c2"),
    "eta_squared": _pair_rows("eta_squared", _MIXED, "SELECT is_real, c1, c2, sum((m - gm) ** 2) / sum((x - gm) ** 2) AS v FROM (SELECT *, avg(x) OVER (PARTITION BY is_real, c1, c2, g) AS m, avg(x) OVER (PARTITION BY is_real, c1, c2) AS gm FROM pairs) GROUP BY is_real, c1, c2"),
    "point_biserial": _pair_rows("point_biserial", _MIXED, "SELECT is_real, c1, c2, CASE WHEN count(DISTINCT g) = 2 THEN abs(corr(x, CASE WHEN g = lowest THEN 1.0 ELSE 0.0 END)) END AS v FROM (SELECT *, min(g) OVER (PARTITION BY is_real, c1, c2) AS lowest FROM pairs) GROUP BY is_real, c1, c2"),
    "kruskal_epsilon": _pair_rows("kruskal_epsilon", _RANKED, "SELECT is_real, c1, c2, (12 / (any_value(n) * (any_value(n) + 1.0)) * sum(h) - 3 * (any_value(n) + 1)) / (1 - any_value(tie) / (CAST(any_value(n) AS DOUBLE) ** 3 - any_value(n))) / (any_value(alls) - 1) AS v FROM per_group JOIN ties USING (is_real, c1, c2) GROUP BY is_real, c1, c2"),
    "cramers_v": _pair_rows("cramers_v", _CATS, "SELECT is_real, c1, c2, CASE WHEN least_k > 0 THEN sqrt(chi2 / (t * least_k)) ELSE 0 END AS v FROM chi"),
    "theils_u": _pair_rows("theils_u", _CATS, "SELECT m.is_real, m.c1, m.c2, (any_value(hy) + sum(n / t * ln(n / nx))) / any_value(hy) AS v FROM margins m JOIN (SELECT is_real, c1, c2, -sum(ny / t * ln(ny / t)) AS hy FROM (SELECT DISTINCT is_real, c1, c2, y, ny, t FROM margins) GROUP BY is_real, c1, c2) h ON h.is_real = m.is_real AND h.c1 = m.c1 AND h.c2 = m.c2 GROUP BY m.is_real, m.c1, m.c2"),
    "chi2_stat": _pair_rows("chi2_stat", _CATS, "SELECT is_real, c1, c2, CASE WHEN least_k > 0 THEN chi2 / t ELSE 0 END AS v FROM chi"),
}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = lineitem_halves(spark, sf_dir)
    out = whole.correlation_matrix(real.frame, synth.frame, real.numeric)
    names = ("frobenius", "spectral", "rv", "score")
    return spark.createDataFrame([tuple(round(out[k], 6) for k in names)], ", ".join(f"{n} double" for n in names))


WIDTH = 0.5


def mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kernels over all rows, the radial one with a given width; the median width is tested against numpy."""
    real, synth = customer_halves(spark, sf_dir)
    rows = [(k, whole.mmd(real, synth, CUSTOMER_NUMERIC, kernel=k, gamma=WIDTH, most=None)["raw"]) for k in whole.KERNELS]
    return rounded(spark.createDataFrame(rows, "kernel string, raw double"))


def energy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = customer_halves(spark, sf_dir)
    out = whole.energy_distance(real, synth, CUSTOMER_NUMERIC, most=None)
    return rounded(spark.createDataFrame([(out["raw"], out["score"])], "raw double, score double"))


def outliers_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = lineitem_halves(spark, sf_dir)
    return rounded(whole.outliers_coverage(real.frame, synth.frame, real.numeric))


def dcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.dcr(*customer_halves(spark, sf_dir), CUSTOMER_NUMERIC))


def nnaa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.nnaa(*customer_halves(spark, sf_dir), CUSTOMER_NUMERIC))


def record_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.record_linkage(*customer_halves(spark, sf_dir), CUSTOMER_NUMERIC)).drop("distinct_links")


def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.k_anonymity(lineitem_halves(spark, sf_dir)[1].frame, [*CATEGORICAL, "l_discount"]))


def l_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.l_diversity(lineitem_halves(spark, sf_dir)[1].frame, CATEGORICAL, ["l_quantity", "l_discount", "l_shipdate__ts", "l_tax"]))


def t_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(privacy.t_closeness(lineitem_halves(spark, sf_dir)[1].frame, CATEGORICAL, NUMERIC, CATEGORICAL))


_PEARSON_SIDE = ", ".join(f"corr({a}, {b}) AS p{k}" for k, (a, b) in enumerate(pairs.numeric_pairs(NUMERIC)))
_N_PAIRS = len(pairs.numeric_pairs(NUMERIC))


def _correlation_sql() -> str:
    """The largest absolute eigenvalue of the symmetric difference by 400 power steps."""
    k, place = len(NUMERIC), {p: n for n, p in enumerate(pairs.numeric_pairs(NUMERIC))}
    gap = lambda i, j: "0" if i == j else f"d{place[NUMERIC[min(i, j)], NUMERIC[max(i, j)]]}"
    moved = [f"({' + '.join(f'{gap(i, j)} * v{j}' for j in range(k))})" for i in range(k)]
    size = f"sqrt({' + '.join(f'w{i} ** 2' for i in range(k))})"
    total = lambda f: " + ".join(f.format(k=n) for n in range(_N_PAIRS))
    return f"""WITH RECURSIVE {HALVES}, a AS (SELECT {_PEARSON_SIDE} FROM real), b AS (SELECT {_PEARSON_SIDE} FROM synth),
d AS (SELECT {", ".join(f"a.p{n} - b.p{n} AS d{n}" for n in range(_N_PAIRS))}, {total("a.p{k} * b.p{k}")} AS dot, {total("a.p{k} ** 2")} AS sa, {total("b.p{k} ** 2")} AS sb FROM a, b),
steps AS (SELECT 0 AS i, {", ".join(f"CAST({1 / (n + 1)} AS DOUBLE) AS v{n}" for n in range(k))}, CAST(0 AS DOUBLE) AS size
  UNION ALL SELECT i + 1, {", ".join(f"w{n} / size" for n in range(k))}, size FROM (SELECT *, {size} AS size FROM (SELECT i, {", ".join(f"CAST({m} AS DOUBLE) AS w{n}" for n, m in enumerate(moved))} FROM steps, d WHERE i < 400))),
parts AS (SELECT 1 - sqrt(2 * ({total("d{k} ** 2")})) / {2 * k} AS frobenius, greatest(0, 1 - (SELECT size FROM steps WHERE i = 400) / 2) AS spectral, least(1, greatest(0, dot / sqrt(sa * sb))) AS rv FROM d)
SELECT round(frobenius, 6) AS frobenius, round(spectral, 6) AS spectral, round(rv, 6) AS rv, round(0.4 * frobenius + 0.3 * spectral + 0.3 * rv, 6) AS score FROM parts"""


def _mmd_sql() -> str:
    dot = "(x.a * y.a + x.b * y.b + x.c * y.c)"
    made = {"rbf": f"exp(-{WIDTH} * ((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2))", "linear": dot, "polynomial": f"({dot} + 1) ** 3"}
    own = lambda t, f: f"(SELECT avg({f}) FROM {t} x JOIN {t} y ON x.id <> y.id)"
    each = " UNION ALL ".join(f"SELECT '{k}' AS kernel, {own('r', f)} + {own('s', f)} - 2 * (SELECT avg({f}) FROM r x CROSS JOIN s y) AS v" for k, f in made.items())
    return f"{CUSTOMERS}, k AS ({each}) SELECT kernel, round(sqrt(greatest(0, v)), 6) AS raw FROM k"


OTHER_SQL = {
    "correlation_matrix": _correlation_sql(),
    "mmd": _mmd_sql(),
    "energy_distance": CUSTOMERS + f", e AS (SELECT greatest(0, 2 * (SELECT avg({_APART}) FROM r x CROSS JOIN s y) - (SELECT avg({_APART}) FROM r x JOIN r y ON x.id <> y.id) - (SELECT avg({_APART}) FROM s x JOIN s y ON x.id <> y.id)) AS raw) SELECT round(raw, 6) AS raw, round(1 - least(raw / 4, 1), 6) AS score FROM e",
    "outliers_coverage": NUMBERS + f"""{_BINS}, fences AS (SELECT col, r1 - 1.5 * (r3 - r1) AS lr, r3 + 1.5 * (r3 - r1) AS ur, s1 - 1.5 * (s3 - s1) AS ls, s3 + 1.5 * (s3 - s1) AS us FROM quant),
outs AS (SELECT col, value, is_real FROM numbers JOIN fences USING (col) WHERE CASE WHEN is_real THEN value < lr OR value > ur ELSE value < ls OR value > us END),
span AS (SELECT q.col, count(value) FILTER (is_real) AS nr, count(value) FILTER (NOT is_real) AS ns, min(value) FILTER (is_real) AS a, max(value) FILTER (is_real) AS b FROM quant q LEFT JOIN outs USING (col) GROUP BY q.col),
hits AS (SELECT span.col, any_value(nr) AS nr, any_value(ns) AS ns, count(value) FILTER (NOT is_real AND value BETWEEN a AND b) AS inside FROM span LEFT JOIN outs USING (col) GROUP BY span.col),
dens AS (SELECT col, sum(least(nr / tr, ns / ts)) AS d FROM cells GROUP BY col),
parts AS (SELECT least(1, greatest(0, least(max_r, max_s) - greatest(min_r, min_s)) / (max_r - min_r)) AS range_coverage, CASE WHEN nr = 0 AND ns = 0 THEN 1 WHEN nr = 0 OR ns = 0 THEN 0.5 ELSE inside / ns END AS outlier_overlap, d AS density_coverage FROM quant JOIN hits USING (col) JOIN dens USING (col))
SELECT round(avg(range_coverage), 6) AS range_coverage, round(avg(outlier_overlap), 6) AS outlier_overlap, round(avg(density_coverage), 6) AS density_coverage, round(0.3 * avg(range_coverage) + 0.4 * avg(outlier_overlap) + 0.3 * avg(density_coverage), 6) AS score FROM parts""",
    "dcr": CUSTOMERS + _NEAR + ", q AS (SELECT quantile_cont(d, 0.05) AS p5, median(d) AS md, avg(CASE WHEN d < 0.1 THEN 1.0 ELSE 0 END) AS copies FROM near) SELECT round(p5, 6) AS p5, round(md, 6) AS median, round(copies, 6) AS copies, round(0.4 * least(1, p5) + 0.3 * (1 - copies) + 0.3 * least(1, md / 1.5), 6) AS score FROM q",
    "nnaa": CUSTOMERS + f""", sr AS (SELECT x.id, min({_APART}) AS d FROM s x CROSS JOIN r y GROUP BY x.id), ss AS (SELECT x.id, min({_APART}) AS d FROM s x JOIN s y ON x.id <> y.id GROUP BY x.id),
rs AS (SELECT x.id, min({_APART}) AS d FROM r x CROSS JOIN s y GROUP BY x.id), rr AS (SELECT x.id, min({_APART}) AS d FROM r x JOIN r y ON x.id <> y.id GROUP BY x.id),
a AS (SELECT avg(CASE WHEN sr.d <= ss.d THEN 1.0 ELSE 0 END) AS accuracy FROM sr JOIN ss USING (id)), b AS (SELECT avg(CASE WHEN rs.d < rr.d THEN 1.0 ELSE 0 END) AS reverse_accuracy FROM rs JOIN rr USING (id))
SELECT round(accuracy, 6) AS accuracy, round(reverse_accuracy, 6) AS reverse_accuracy, round(CASE WHEN accuracy >= 0.5 THEN 1 - 2 * (accuracy - 0.5) ELSE 1 END, 6) AS score FROM a, b""",
    "record_linkage": CUSTOMERS + _NEAR + ", q AS (SELECT median(d) AS md FROM near), u AS (SELECT avg(CASE WHEN d <= md THEN 1.0 ELSE 0 END) AS rate, avg(d) AS mean FROM near, q) SELECT round(rate, 6) AS linkage_rate, round(mean, 6) AS mean_distance, round((least(1, mean / 2) + 1 - rate) / 2, 6) AS score FROM u",
    "k_anonymity": f"WITH {HALVES}, k AS (SELECT count(*) AS k FROM synth GROUP BY l_linestatus, l_mode, l_returnflag, l_discount), q AS (SELECT min(k) AS k_min, median(k) AS k_median, count(*) AS n_groups, avg(CASE WHEN k < 5 THEN 1.0 ELSE 0 END) AS below FROM k) SELECT k_min, round(k_median, 6) AS k_median, n_groups, round(below, 6) AS below, round((1 - below) * (1 - exp(-k_median / 5)), 6) AS score FROM q",
    "l_diversity": f"WITH {HALVES}, l AS ({' UNION ALL '.join(f'''SELECT '{c}' AS col, count(DISTINCT {c}) AS l FROM synth GROUP BY l_linestatus, l_mode, l_returnflag''' for c in ('l_quantity', 'l_discount', 'l_shipdate__ts', 'l_tax'))}), q AS (SELECT col, min(l) AS l_min, avg(CASE WHEN l < 3 THEN 1.0 ELSE 0 END) AS below FROM l GROUP BY col) SELECT col AS \"column\", l_min, round(below, 6) AS below, round((1 - below) * (1 - exp(-l_min / 3)), 6) AS score FROM q",
    "t_closeness": f"""WITH {HALVES}, g AS (SELECT *, l_linestatus || '/' || l_mode || '/' || l_returnflag AS g FROM synth),
n AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, g, CAST({c} AS DOUBLE) AS value FROM g" for c in NUMERIC)}), v AS (SELECT col, value, count(*) AS w FROM n GROUP BY col, value),
f AS (SELECT col, value, sum(w) OVER (PARTITION BY col ORDER BY value) / sum(w) OVER (PARTITION BY col) AS f, lead(value) OVER (PARTITION BY col ORDER BY value) - value AS step, max(value) OVER (PARTITION BY col) - min(value) OVER (PARTITION BY col) AS width FROM v),
own AS (SELECT col, g, value, count(*) AS w FROM n GROUP BY col, g, value), gs AS (SELECT col, g, sum(w) AS size FROM own GROUP BY col, g),
h AS (SELECT gs.col, gs.g, f.value, f.f, f.step, f.width, sum(coalesce(own.w, 0)) OVER (PARTITION BY gs.col, gs.g ORDER BY f.value) / gs.size AS h FROM gs JOIN f ON f.col = gs.col LEFT JOIN own ON own.col = gs.col AND own.g = gs.g AND own.value = f.value),
tn AS (SELECT col, g, least(1, sum(abs(f - h) * coalesce(step, 0)) / any_value(width)) AS t FROM h GROUP BY col, g),
c AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, g, {c} AS value FROM g" for c in CATEGORICAL)}), cw AS (SELECT col, value, count(*) / sum(count(*)) OVER (PARTITION BY col) AS q FROM c GROUP BY col, value), cg AS (SELECT col, g, value, count(*) / sum(count(*)) OVER (PARTITION BY col, g) AS p FROM c GROUP BY col, g, value),
tc AS (SELECT x.col, x.g, sum(abs(cw.q - coalesce(cg.p, 0))) / 2 AS t FROM (SELECT DISTINCT col, g FROM c) x JOIN cw ON cw.col = x.col LEFT JOIN cg ON cg.col = x.col AND cg.g = x.g AND cg.value = cw.value GROUP BY x.col, x.g),
t AS (SELECT * FROM tn UNION ALL SELECT * FROM tc), q AS (SELECT col, max(t) AS t_max, avg(CASE WHEN t > 0.2 THEN 1.0 ELSE 0 END) AS above FROM t GROUP BY col) SELECT col AS "column", round(t_max, 6) AS t_max, round(above, 6) AS above, round((1 - t_max) * (1 - above), 6) AS score FROM q""",
}

def marginal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship report: every column metric as one plan."""
    return rounded(marginal_report(*lineitem_halves(spark, sf_dir)))


def normalized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw distances of one metric of each rule, normalised."""
    real, synth = lineitem_halves(spark, sf_dir)
    rows = marginal.numeric_metrics(real.frame, synth.frame, real.numeric, ["ks", "wasserstein", "delta_mean"])
    return rounded(column_scores(rows).drop("raw"))


def aggregated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aggregator over the Kolmogorov-Smirnov similarities of the columns."""
    real, synth = lineitem_halves(spark, sf_dir)
    rows = column_scores(marginal.universal_metrics(real.frame, synth.frame, real.numeric, real.categorical, ["tvd"]))
    return rounded(rows.agg(*[aggregate_column(n, F.col("score")).alias(n) for n in AGGREGATORS]))


def univariate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synth = lineitem_halves(spark, sf_dir)
    return rounded(univariate(real.frame, synth.frame, real.numeric).drop("skew", "kurtosis"))


def cast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cast by their declared types, counted by what came out."""
    schema = TableSchema.of({"o_totalprice": "continuous", "o_orderdate": "datetime", "o_orderpriority": {"type": "ordinal", "levels": ORDER_LEVELS}, "o_orderstatus": "boolean", "o_custkey": {"type": "discrete", "ranges": [[0, 50], [51, 500], [501, 10_000_000]]}})
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "O", " YES ").when(F.col("o_orderstatus") == "F", "no"))
    cast = prepare(orders, orders, schema)[0].frame
    return rounded(cast.groupBy("o_orderpriority", "o_orderpriority__ord", "o_orderstatus", "o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.max("o_orderdate__ts").alias("latest")))


def frequent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types kept among the forty most frequent, all others merged."""
    parts = table(spark, sf_dir, "part").select("p_type")
    cast = Caster(TableSchema.of({"p_type": "text"}), top_texts=40).fit(parts).transform(parts)
    return cast.frame.groupBy("p_type").agg(F.count("*").alias("n"))


def redacted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_counts(table(spark, sf_dir, "part"), "p_brand", least=5, top=10)


def generator_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ranks of suppliers' nations over regions of balance, as of generators over seeds."""
    scores = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("generator"), (F.col("c_custkey") % 5).cast("int").alias("seed")).agg(F.round(F.avg("c_acctbal"), 2).alias("score"))
    return rounded(mean_ranks(scores))


def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("generator"), (F.col("c_custkey") % 3).cast("int").alias("seed"), F.lit("composite").alias("name"), F.col("c_acctbal").alias("value"))
    return rounded(score_table(rows))


def small_halves(spark: SparkSession, sf_dir: str) -> tuple[CastTable, CastTable]:
    """Customers with a target that is learnable but for a fifth of them, for queries that train models."""
    r, s = customer_halves(spark, sf_dir)
    by_chance = F.when(F.pmod(F.xxhash64("c_custkey"), F.lit(5)) == 0, F.pmod(F.xxhash64("c_custkey", F.lit(1)), F.lit(2)) == 0)
    schema = TableSchema.of({"c_acctbal": "continuous", "c_nationkey": "continuous", "c_load": "continuous", "c_mktsegment": "categorical", "c_large": "categorical"})
    large = lambda t: t.withColumn("c_large", F.when(F.coalesce(by_chance, F.col("c_acctbal") > 4500), "y").otherwise("n")).drop("c_custkey")
    return prepare(large(r), large(s), schema)


def privacy_mia(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.membership_attack(*small_halves(spark, sf_dir))
    return spark.createDataFrame([(out["score"], out["accuracy"])], "score double, accuracy double")


def privacy_inference_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.inference_attack(*small_halves(spark, sf_dir))
    return spark.createDataFrame([(c["column"], c["score"]) for c in out["columns"]], "column string, score double")


def utility_ml_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four strategies, from which every utility metric follows."""
    out = learning.efficiency(*small_halves(spark, sf_dir), "c_large")
    return spark.createDataFrame([("ttr", out["ttr"]), *out["strategies"].items(), ("ml_efficiency", out["score"])], "strategy string, value double")


def calibration_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, _ = small_halves(spark, sf_dir)
    return uniform_noise(real, 7).frame


def generator_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        real, _ = small_halves(spark, sf_dir)
        return GENERATORS[name](seed=3, **({"target": "c_large"} if name == "smotenc" else {})).fit_generate(real).frame

    return run


SEGMENT_VALUE = "c_acctbal / 10000"


def normalization_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over the distinct account balances, as raw values from below 0 to above 1, some of them null."""
    values = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") > 0, F.expr(SEGMENT_VALUE)).alias("value")).distinct()
    each = values.select("value", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), as_column(r, F.col("value"), 0.25).alias("score")) for r in RULE_NAMES])).alias("r"))
    return rounded(each.select("r.rule", F.round("value", 6).alias("value"), "r.score"))


def percentile_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("metric"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("value"))
    return rounded(percentile_scores(rows, {"BUILDING": True, "MACHINERY": True}).drop("value"))


def segment_scores(spark: SparkSession, sf_dir: str, blocks: int) -> dict[str, list[float]]:
    """Mean balances by segment over blocks, as of generators over seeds."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("generator"), (F.col("c_custkey") % blocks).alias("seed")).agg(F.round(F.avg("c_acctbal"), 4).alias("score")).collect()
    out: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: (r["generator"], r["seed"])):
        out.setdefault(r["generator"], []).append(r["score"])
    return out


def rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friedman over five segments, and Wilcoxon of every two of them."""
    scores = segment_scores(spark, sf_dir, 12)
    f = friedman(scores)
    rows = [("friedman", f.statistic, f.p_value), *[(f"wilcoxon {a} {b}", wilcoxon(scores[a], scores[b]).statistic, None) for k, a in enumerate(scores) for b in list(scores)[k + 1 :]]]
    return rounded(spark.createDataFrame(rows, "test string, statistic double, p_value double"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over runs, and bounds made of them, for every segment."""
    rows = [(g, *[s[k] for k in RUN_NAMES], hypervolume([x / 10000 for x in v]), weighted_score([x / 10000 for x in v], range(1, len(v) + 1))) for g, v in segment_scores(spark, sf_dir, 7).items() for s in [run_statistics(v)]]
    return rounded(spark.createDataFrame(rows, f"generator string, {', '.join(f'{k} double' for k in RUN_NAMES)}, hypervolume double, weighted double"))


RUN_NAMES = ("median", "mean", "std", "min", "max", "q1", "q3")


def calibrated_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's runs as upper runs against those of all others as lower ones, and its median placed between the bounds."""
    scores = {g: [x / 10000 for x in v] for g, v in segment_scores(spark, sf_dir, 7).items()}
    rows = []
    for g, upper in scores.items():
        lower = [x for other, v in scores.items() if other != g for x in v]
        b = bounds_of(upper, lower, "fidelity")
        rows.append((g, b.low, b.high, b.inverted, place(float(run_statistics(upper)["median"]), b.low, b.high, b.inverted)))
    return rounded(spark.createDataFrame(rows, "generator string, low double, high double, inverted boolean, placed double"))


def differential_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of mechanisms: an epsilon for every nation, a delta for every region."""
    rows = [(r["n_nationkey"], privacy.differential_privacy(r["n_nationkey"] * 5.0 - 10, r["n_regionkey"] / 1000)) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]
    return rounded(spark.createDataFrame(rows, "n_nationkey int, score double"))


def cleaned_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV with spellings of null, blanks around texts, a column and rows of nulls, and read back."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("c_name"),
        F.when(F.col("c_nationkey") < 5, F.lit(" N/A ")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("nan")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.lit("null").alias("c_nothing"),
    )
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    loaders.save_csv(rows.unionByName(rows.limit(3).select(*[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes])), path)
    return rounded(loaders.load(spark, path))


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as a stream of one batch, scored against the half with even keys."""
    wanted = ["c_acctbal", "c_nationkey"]
    every = table(spark, sf_dir, "customer")
    stream = spark.readStream.schema(every.schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir).select(*[F.col(c).cast("double") for c in wanted])
    found: list[tuple] = []
    baseline = customer_halves(spark, sf_dir)[0]
    monitor(stream, baseline, lambda scores, number: found.extend((r["metric"], r["column"], r["raw"], number) for r in scores.collect()), wanted, metrics=("ks", "wasserstein"), checkpoint=f"{shared_folder(spark)}/{uuid.uuid4().hex}").awaitTermination()
    return rounded(spark.createDataFrame(found, 'metric string, column string, raw double, batch int'))


def generator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of generators with a fixed number of rows: how many they gave, and whether every value lies in what the real table holds."""
    real, _ = small_halves(spark, sf_dir)
    levels = {c: real.frame.select(c).distinct() for c in real.categorical}
    ends = real.frame.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(real.numeric) for n, f in (("low", F.min), ("high", F.max))]).first()
    out = []
    for name in ("uniform_noise", "smotenc", "gaussian_copula", "bayesian_network"):
        made = GENERATORS[name](seed=3, **({"target": "c_large"} if name == "smotenc" else {})).fit_generate(real).frame
        inside = [F.coalesce(F.min(F.col(c).between(ends[f"low{k}"] - 1e-9, ends[f"high{k}"] + 1e-9)), F.lit(False)) for k, c in enumerate(real.numeric)]
        row = made.agg(F.count("*").alias("n"), *[x.alias(f"i{k}") for k, x in enumerate(inside)]).first()
        known = all(made.join(seen, c, "left_anti").isEmpty() for c, seen in levels.items())
        out.append((name, row["n"], all(row[f"i{k}"] for k in range(len(real.numeric))), known))
    return spark.createDataFrame(out, "generator string, n bigint, inside boolean, known boolean")


ORDER_LEVELS = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]
_TVD = COVERAGE_SQL["tvd"].replace("round(0.5 * sum(abs(p - q)), 6) AS raw", "1 - 0.5 * sum(abs(p - q)) AS v")
_NOISE = ["uniform_noise", "bootstrap", "delete_zero", "delete_mean", "smotenc", "gaussian_copula", "bayesian_network", "cart", "real_data"]

QUERIES: dict[str, Query] = {
    **{f.__name__: f for f in (marginal_scores, normalized_columns, aggregated_columns, univariate_statistics, cast_table, frequent_texts, redacted_values, generator_ranks, benchmark_scores, privacy_mia, privacy_inference_attack, utility_ml_efficiency, calibration_noise, normalization_rules, percentile_normalized, rank_tests, run_summaries, calibrated_bounds, cleaned_csv, stream_drift, generator_ranges)},
    **{f"generator_{n}": generator_query(n) for n in _NOISE},
    **{f"fidelity_{n}": numeric_query(n) for n in NUMERIC_SQL},
    **{f"fidelity_{n}": coverage_query(n) for n in COVERAGE_SQL},
    **{f"fidelity_{n}": pair_query(n) for n in PAIR_SQL},
    **{f"fidelity_{f.__name__}": f for f in (correlation_matrix, mmd, energy_distance, outliers_coverage)},
    **{f"privacy_{f.__name__}": f for f in (dcr, nnaa, record_linkage, k_anonymity, l_diversity, t_closeness, differential_privacy)},
}
MORE_SQL = {
    "normalized_columns": NUMBERS + """, raw AS (SELECT 'fidelity.ks' AS metric, col, max(abs(cr / tr - cs / ts)) AS v FROM cum GROUP BY col UNION ALL SELECT 'fidelity.wasserstein', col, sum(abs(cr / tr - cs / ts) * coalesce(nxt - value, 0)) FROM cum GROUP BY col
UNION ALL SELECT 'fidelity.delta_mean', col, CASE WHEN sqrt(vr) > 1e-10 THEN abs(mr - ms) / sqrt(vr) ELSE abs(mr - ms) END FROM quant), span AS (SELECT metric, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM raw GROUP BY metric)
SELECT metric, col AS "column", round(CASE metric WHEN 'fidelity.ks' THEN 1 - v WHEN 'fidelity.delta_mean' THEN 1 / (1 + v) ELSE 1 - least(1, greatest(0, (v - a) / (b - a))) END, 6) AS score FROM raw JOIN span USING (metric)""",
    "aggregated_columns": f"""WITH t AS ({_TVD}), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM t),
a AS (SELECT avg(v) AS m, min(v) AS least_v FROM t), s AS (SELECT -ln(avg(exp(-5 * v))) / 5 AS e FROM t)
SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS percentile_25, round(quantile_cont(v, 0.75), 6) AS percentile_75,
round(avg(v) FILTER (i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 6) AS trimmed_mean_10, round(avg(v) FILTER (i > floor(n * 0.2) AND i <= n - floor(n * 0.2)), 6) AS trimmed_mean_20, round(exp(avg(ln(v))), 6) AS geometric_mean, round(count(*) / sum(1 / v), 6) AS harmonic_mean, round(least(1, avg(v)), 6) AS fsd,
(SELECT round(least(1, least(greatest(e, least_v), m)), 6) FROM a, s) AS ssd FROM r""",
    "univariate_statistics": NUMBERS + " SELECT is_real, col AS \"column\", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM numbers GROUP BY is_real, col",
    "cast_table": """WITH c AS (SELECT lower(trim(o_orderpriority)) AS o_orderpriority, (list_position(['1-urgent', '2-high', '3-medium', '4-not specified', '5-low'], lower(trim(o_orderpriority))) - 1) / 4.0 AS o_orderpriority__ord, CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'no' END AS o_orderstatus,
CASE WHEN o_custkey BETWEEN 0 AND 50 THEN 0.0 WHEN o_custkey BETWEEN 51 AND 500 THEN 0.5 WHEN o_custkey BETWEEN 501 AND 10000000 THEN 1.0 END AS o_custkey, o_totalprice, epoch_us(o_orderdate) / 1e6 AS ts FROM orders)
SELECT o_orderpriority, round(o_orderpriority__ord, 6) AS o_orderpriority__ord, o_orderstatus, CAST(o_custkey AS DOUBLE) AS o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS price, round(max(ts), 6) AS latest FROM c WHERE o_orderstatus IS NOT NULL AND o_orderpriority__ord IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
    "frequent_texts": "WITH k AS (SELECT lower(trim(p_type)) AS t, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS i, count(*) OVER () AS k FROM k) SELECT CASE WHEN k <= 40 OR i <= 40 THEN t ELSE 'OTHER' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "redacted_values": "WITH k AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY n >= 5 ORDER BY n DESC, v) AS i FROM k) SELECT CASE WHEN n < 5 THEN '__redacted__' WHEN i > 10 THEN '__other__' ELSE v END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1",
    "generator_ranks": "WITH s AS (SELECT c_mktsegment AS g, c_custkey % 5 AS seed, round(avg(c_acctbal), 2) AS score FROM customer GROUP BY 1, 2), r AS (SELECT g, rank() OVER (PARTITION BY seed ORDER BY score DESC) + (count(*) OVER (PARTITION BY seed, score) - 1) / 2.0 AS rk FROM s) SELECT g AS generator, round(avg(rk), 6) AS mean_rank FROM r GROUP BY g",
    "benchmark_scores": "SELECT c_mktsegment AS generator, 'composite' AS name, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) AS std, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) AS iqr FROM customer GROUP BY 1",
}
_SEGMENTS = lambda blocks: f"WITH s AS (SELECT c_mktsegment AS g, c_custkey % {blocks} AS seed, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 1, 2)"
_UNIT = lambda x: f"least(1, greatest(0, {x}))"


def _report_sql() -> str:
    """Every column metric's own SQL without its rounding, scored by rule, and rolled up."""
    bare = lambda sql: re.sub(r"round\((.*), 6\) AS raw", r"\1 AS raw", sql, flags=re.DOTALL)
    raw = " UNION ALL ".join(f"SELECT * FROM ({bare(s)})" for s in (NUMERIC_SQL | COVERAGE_SQL).values())
    of = {r: ", ".join(f"'{m}'" for m, own in RULES.items() if own == r and m.startswith("fidelity.")) for r in RULE_NAMES}
    robust = f"CASE WHEN b - a < 1e-10 THEN CASE WHEN b < 1e-6 THEN 1.0 ELSE 0.5 END ELSE 1 - {_UNIT('(raw - a) / (b - a)')} END"
    score = f"CASE WHEN raw IS NULL THEN NULL WHEN metric IN ({of[UNBOUNDED]}) THEN {robust} WHEN metric IN ({of[BOUNDED]}) THEN {_UNIT('1 - raw')} WHEN metric IN ({of[DELTA]}) THEN 1 / (1 + abs(raw)) WHEN metric IN ({of[SIMILARITY]}) THEN {_UNIT('raw')} END"
    place_of = " ".join(f"WHEN '{m}' THEN '{p[2]}'" for m, p in PLACES.items() if m.startswith("fidelity."))
    return f"""WITH raws AS MATERIALIZED ({raw}), span AS (SELECT metric, quantile_cont(raw, 0.05) AS a, quantile_cont(raw, 0.95) AS b FROM raws GROUP BY metric),
scored AS (SELECT metric, avg({score}) AS score FROM raws JOIN span USING (metric) GROUP BY metric),
leaves AS (SELECT 'fidelity' AS family, 'marginal' AS category, CASE metric {place_of} END AS subcategory, metric, score FROM scored)
SELECT family, category, subcategory, metric, round(median(score), 6) AS score FROM leaves GROUP BY ROLLUP (family, category, subcategory, metric) HAVING family IS NOT NULL"""


MORE_SQL |= {
    "marginal_scores": _report_sql(),
    "normalization_rules": f"WITH v AS (SELECT DISTINCT CASE WHEN c_nationkey > 0 THEN {SEGMENT_VALUE} END AS value FROM customer), e AS ("
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule, value, {x} AS score FROM v"
        for r, x in (
            (BOUNDED, _UNIT("1 - value")),
            (UNBOUNDED, "CASE WHEN value >= 0 THEN exp(-value / 0.25) WHEN value < 0 THEN 1 END"),
            (SIMILARITY, _UNIT("value")),
            (DELTA, "1 / (1 + abs(value))"),
            (INFORMATION, "CASE WHEN value > 0 THEN value / (value + 0.25) ELSE 0 END"),
            (CLOSEST, "1 - exp(-greatest(value, 0) / 0.25)"),
            (LOSS, "1 / (1 + greatest(value, 0))"),
        )
    )
    + ") SELECT rule, round(value, 6) AS value, CASE WHEN value IS NULL THEN 0.0 ELSE round(score, 6) END AS score FROM e",
    "percentile_normalized": f"""WITH p AS (SELECT c_mktsegment AS metric, quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer GROUP BY 1)
SELECT metric, c_custkey AS item, round(CASE WHEN metric IN ('BUILDING', 'MACHINERY') THEN 1 - {_UNIT("(c_acctbal - a) / (b - a)")} ELSE {_UNIT("(c_acctbal - a) / (b - a)")} END, 6) AS score FROM customer JOIN p ON p.metric = c_mktsegment""",
    "rank_tests": _SEGMENTS(12)
    + """, r AS (SELECT g, seed, rank() OVER (PARTITION BY seed ORDER BY v DESC) + (count(*) OVER (PARTITION BY seed, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY seed, v) AS tied FROM s),
f AS (SELECT (12.0 / (12 * 5 * 6) * sum(t ** 2) - 3 * 12 * 6) / (1 - (SELECT sum(CAST(tied AS DOUBLE) ** 2 - 1) FROM r) / (12.0 * (125 - 5))) AS q FROM (SELECT sum(rk) AS t FROM r GROUP BY g)),
d AS (SELECT x.g AS a, y.g AS b, x.v - y.v AS d FROM s x JOIN s y ON x.seed = y.seed AND x.g < y.g WHERE x.v <> y.v),
w AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rk FROM d)
SELECT 'friedman' AS test, round(q, 6) AS statistic, round(exp(-q / 2) * (1 + q / 2), 6) AS p_value FROM f
UNION ALL SELECT 'wilcoxon ' || a || ' ' || b, round(least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)), 6), NULL FROM w GROUP BY a, b""",
    "run_summaries": _SEGMENTS(7)
    + """, o AS (SELECT *, v / 10000 AS x, row_number() OVER (PARTITION BY g ORDER BY seed) AS i FROM s), m AS (SELECT *, min(x) OVER (PARTITION BY g) AS least_x FROM o),
q AS (SELECT g, median(v) AS median, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, exp(avg(ln(least(1, greatest(1e-10, x))))) AS hypervolume,
  any_value(least_x) AS least_x, any_value(least_x) - ln(sum(i * exp(-5 * (x - least_x))) / sum(i)) / 5 AS e, sum(i * x) / sum(i) AS wm FROM m GROUP BY g)
SELECT g AS generator, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(q1, 6) AS q1, round(q3, 6) AS q3, round(hypervolume, 6) AS hypervolume, round(least(1, greatest(0, least(greatest(e, least_x), wm))), 6) AS weighted FROM q""",
    "calibrated_bounds": _SEGMENTS(7)
    + """, p AS (SELECT x.g, y.g = x.g AS own, y.v / 10000 AS v FROM (SELECT DISTINCT g FROM s) x CROSS JOIN s y),
b AS (SELECT g, median(v) FILTER (own) < median(v) FILTER (NOT own) AS inverted, min(v) FILTER (own) AS lo, max(v) FILTER (own) AS hi, min(v) FILTER (NOT own) AS olo, max(v) FILTER (NOT own) AS ohi, median(v) FILTER (own) AS m FROM p GROUP BY g),
c AS (SELECT g, inverted, m, CASE WHEN inverted THEN hi ELSE ohi END AS low, CASE WHEN inverted THEN olo ELSE lo END AS high FROM b),
d AS (SELECT *, CASE WHEN abs(high - low) > 1e-10 THEN least(1, greatest(0, (m - low) / (high - low))) WHEN m >= high THEN 1.0 ELSE 0.0 END AS x FROM c)
SELECT g AS generator, round(low, 6) AS low, round(high, 6) AS high, inverted, round(CASE WHEN inverted THEN 1 - x ELSE x END, 6) AS placed FROM d""",
    "cleaned_csv": "SELECT c_custkey, trim(c_name) AS c_name, CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal, 6) END AS c_acctbal FROM customer",
    "stream_drift": """WITH v AS (SELECT 'c_acctbal' AS col, CAST(c_acctbal AS DOUBLE) AS value, c_custkey % 2 = 0 AS even FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE), c_custkey % 2 = 0 FROM customer),
k AS (SELECT col, value, count(*) FILTER (even) AS nr, count(*) AS ns FROM v GROUP BY col, value),
c AS (SELECT col, abs(sum(nr) OVER w / sum(nr) OVER (PARTITION BY col) - sum(ns) OVER w / sum(ns) OVER (PARTITION BY col)) AS d, lead(value) OVER w - value AS step FROM k WINDOW w AS (PARTITION BY col ORDER BY value))
SELECT 'fidelity.ks' AS metric, col AS "column", round(max(d), 6) AS raw, 0 AS batch FROM c GROUP BY col UNION ALL SELECT 'fidelity.wasserstein', col, round(sum(d * coalesce(step, 0)), 6), 0 FROM c GROUP BY col""",
    "generator_ranges": "SELECT g AS generator, count(*) AS n, TRUE AS inside, TRUE AS known FROM customer CROSS JOIN (SELECT unnest(['uniform_noise', 'smotenc', 'gaussian_copula', 'bayesian_network']) AS g) WHERE c_custkey % 2 = 0 GROUP BY g",
    "privacy_differential_privacy": "WITH e AS (SELECT n_nationkey, n_nationkey * 5.0 - 10 AS e, n_regionkey / 1000.0 AS d FROM nation) SELECT n_nationkey, round(least(1, greatest(0, CASE WHEN e <= 0 THEN 1.0 WHEN e >= 100 THEN 0.0 ELSE exp(-e / 2) END - least(0.2, 100 * d))), 6) AS score FROM e",
}
ORACLES: dict[str, str] = {
    **MORE_SQL,
    **{f"fidelity_{n}": s for n, s in (NUMERIC_SQL | COVERAGE_SQL | PAIR_SQL).items()},
    **{(f"fidelity_{n}" if f"fidelity_{n}" in QUERIES else f"privacy_{n}"): s for n, s in OTHER_SQL.items()},
}
