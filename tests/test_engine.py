import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.errors import ConfigError, PreparationError, SchemaError
from tabassay.operators import caster, frames, knn, marginal, pairs, privacy, whole
from tabassay.operators.caster import CastTable, prepare, validate
from tabassay.operators.frames import at_rank, cumulative, cuts_below, long_numbers, lowest, value_counts
from tabassay.plans.evaluate import EvalPlan, evaluate, marginal_report, redacted_counts, univariate
from tabassay.schema import ColumnType, TableSchema

SCHEMA = {"age": "continuous", "income": "continuous", "score": "continuous", "gender": "categorical", "city": "categorical"}


def table(spark, seed, n=60, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(i), float(s), str(g), str(c)) for a, i, s, g, c in zip(rng.integers(18, 80, n) + shift, rng.uniform(2e4, 1.2e5, n), rng.random(n), rng.choice(["M", "F"], n), rng.choice(["Madrid", "Barcelona", "Valencia", "Sevilla"], n))]
    return spark.createDataFrame(rows, "age double, income double, score double, gender string, city string")


def test_casts(spark):
    rows = [("1,5", "3", " YES ", "Low", "2024-01-02 00:00:00", "X1", "a"), ("2.5", "15", "sí", "high", "2024-01-03", "X2", "b"), ("x", "7", "no", "low", "2024-01-03", "X3", "c"), ("1", "99", "no", "low", "2024-01-03", "X4", "d"), ("1", "7", "maybe", "low", "2024-01-03", "X5", "e"), (None, "7", "no", "low", "2024-01-03", "X6", "f")]
    df = spark.createDataFrame(rows, "c string, d string, b string, o string, t string, code string, id string")
    schema = TableSchema.of({"c": "continuous", "d": {"type": "discrete", "ranges": [[0, 5], [6, 10], [11, 20]]}, "b": "boolean", "o": {"type": "ordinal", "levels": ["low", "mid", "high"]}, "t": "datetime", "code": "code_numeric", "id": "id"})
    cast, _ = prepare(df, df, schema)
    assert cast.categorical == ["b", "code", "o"] and cast.numeric == ["c", "d", "o__ord", "t__ts"]
    got = [r.asDict() for r in cast.frame.orderBy("code").collect()]
    assert got == [{"b": "yes", "code": "X1", "o": "low", "c": 1.5, "d": 0.0, "o__ord": 0.0, "t__ts": 1704153600.0}, {"b": "yes", "code": "X2", "o": "high", "c": 2.5, "d": 1.0, "o__ord": 1.0, "t__ts": 1704240000.0}]
    assert caster.unseen_levels(df, schema) == {"o": ["mid"]}


def test_rare_texts_become_other(spark):
    df = spark.createDataFrame([(t,) for t in ["a"] * 5 + ["b"] * 3 + ["c", "d"]], "t string")
    cast = caster.Caster(TableSchema.of({"t": "text"}), top_texts=2).fit(df).transform(df)
    assert {r["t"]: r["count"] for r in cast.frame.groupBy("t").count().collect()} == {"a": 5, "b": 3, "OTHER": 2}


def test_odd_column_names(spark):
    df = table(spark, 1).withColumnsRenamed({"age": "age [y].x", "city": "ci`ty"})
    r, s = prepare(df, df, TableSchema.of({"age [y].x": "continuous", "ci`ty": "categorical"}))
    rows = marginal.numeric_metrics(r.frame, s.frame, r.numeric, ["ks"]).collect()
    assert rows[0]["raw"] == 0


def test_schema_errors(spark):
    with pytest.raises(SchemaError):
        ColumnType("ordinal")
    with pytest.raises(SchemaError):
        ColumnType("odd")
    with pytest.raises(ConfigError):
        TableSchema.of({})
    with pytest.raises(SchemaError):
        prepare(table(spark, 1), table(spark, 1).drop("age"), TableSchema.of(SCHEMA))
    r, s = prepare(table(spark, 1, 5), table(spark, 2), TableSchema.of(SCHEMA))
    with pytest.raises(PreparationError):
        validate(r, s)
    r, s = prepare(table(spark, 1), table(spark, 2), TableSchema.of(SCHEMA))
    with pytest.raises(SchemaError):
        validate(r, s, None, ["utility.tstr"])
    assert validate(r, s, "age") == {"real": 60, "synthetic": 60}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(50, 10, 997), 1), np.round(rng.normal(52, 11, 400), 2)
    to = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    cum = cumulative(value_counts(long_numbers(to(a), to(b), ["x"])))
    qs = (0.01, 0.25, 0.5, 0.9, 0.999)
    row = cum.groupBy("column").agg(*[at_rank(q, "cr", "tr").alias(f"r{k}") for k, q in enumerate(qs)], *[at_rank(q, "cs", "ts").alias(f"s{k}") for k, q in enumerate(qs)]).first()
    assert [row[f"r{k}"] for k in range(5)] == pytest.approx(np.quantile(a, qs).tolist())
    assert [row[f"s{k}"] for k in range(5)] == pytest.approx(np.quantile(b, qs).tolist())


def test_equal_tables_are_best(spark):
    df = table(spark, 4)
    r, s = prepare(df, df, TableSchema.of(SCHEMA))
    for row in marginal.numeric_metrics(r.frame, s.frame, r.numeric, [n for n in marginal.ALL_NUMERIC if n != "anderson_darling"]).collect() + marginal.universal_metrics(r.frame, s.frame, r.numeric, r.categorical, marginal.COVERAGE).collect():
        assert row["raw"] == pytest.approx(0, abs=1e-7), row
    for name in (*pairs.NUM_NUM, *pairs.NUM_CAT, *pairs.CAT_CAT):
        for row in pairs.pair_metric(name, r.frame, s.frame, r.numeric, r.categorical).collect():
            assert row["delta"] is None or row["delta"] == pytest.approx(0, abs=1e-9), row
    assert whole.correlation_matrix(r.frame, s.frame, r.numeric)["score"] == pytest.approx(1)
    assert whole.outliers_coverage(r.frame, s.frame, r.numeric).first()["score"] == pytest.approx(1)


def test_constant_columns_and_tiny_sides(spark):
    one = spark.createDataFrame([(1.0,)] * 12, "x double")
    rows = marginal.numeric_metrics(one, one, ["x"], marginal.ALL_NUMERIC).collect()
    assert all(r["raw"] is None or r["raw"] == pytest.approx(0) for r in rows)
    short = spark.createDataFrame([(1.0,)], "x double")
    assert [r["raw"] for r in marginal.numeric_metrics(one, short, ["x"], ["ks", "delta_mean"]).collect()] == [None, None]


def test_numpy_bins(spark):
    v = [0.0, 0.1, 0.5, 1.0, 0.98, 0.02, 0.3]
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", marginal.bin_of(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("b"))
    for r in df.collect():
        assert np.histogram([r["v"]], bins=50, range=(0, 1))[0][r["b"]] == 1


def test_two_by_two_correction(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 4 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "p string, q string")
    got = pairs.categorical_metrics(df, df, ["p", "q"], ["chi2_stat"]).first()
    o, n = np.array([[12, 5], [4, 9]]), 30
    e = o.sum(1)[:, None] * o.sum(0)[None] / n
    assert got["real_value"] == pytest.approx((((abs(o - e) - 0.5) ** 2) / e).sum() / n)


def test_nearest_ties_and_self(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 3.0, 4.0)], "id bigint, a double, b double")
    got = {r["id"]: (r["distance"], r["neighbour"]) for r in knn.nearest(rows, rows, ["a", "b"], (np.zeros(2), np.ones(2))).collect()}
    assert got == {0: (0.0, 1), 1: (0.0, 0), 2: (5.0, 0)}


def test_kernels_against_loops():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.normal(1, 2, size=(17, 3))
    d = lambda a, b: np.array([[np.linalg.norm(p - q) for q in b] for p in a])
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert whole.energy_value(x, y) == pytest.approx(2 * d(x, y).mean() - off(d(x, x)) - off(d(y, y)))
    k = lambda a, b: np.exp(-0.3 * d(a, b) ** 2)
    assert whole.mmd_value(x, y, gamma=0.3) == pytest.approx(math.sqrt(max(0, off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean())))
    assert whole.mmd_value(x, x, "polynomial") == 0


def test_privacy_classes(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("b", 2.0), ("b", 3.0)], "q string, v double")
    k = privacy.k_anonymity(df, ["q"]).first()
    assert (k["k_min"], k["k_median"], k["below"]) == (2, 4.0, 0.5)
    assert k["score"] == pytest.approx(0.5 * (1 - math.exp(-4 / 5)))
    assert privacy.l_diversity(df, ["q"], ["v"]).first()["l_min"] == 1
    t = {r["column"]: r["t_max"] for r in privacy.t_closeness(df, ["q"], ["v"], ["q"]).collect()}
    # Class b holds 2 and 3 once each: F is 0.75 on [1, 2) and 0.875 on [2, 3), its own 0 and 0.5.
    assert t["q"] == pytest.approx(0.75) and t["v"] == pytest.approx((0.75 + 0.375) / 2)
    assert privacy.differential_privacy(1.0) == pytest.approx(math.exp(-0.5)) and privacy.differential_privacy(0) == 1


def test_evaluate_everything_but_learning(spark):
    plan = EvalPlan(["fidelity", "privacy.dataset_based.reidentification", "privacy.dataset_based.empirical_similarity", "privacy.mechanism_based"])
    out = evaluate(table(spark, 5), table(spark, 6, shift=3), SCHEMA, plan)
    assert [r.id for r in out.results] == plan.metrics
    assert all(r.valid and 0 <= r.value <= 1 for r in out.results), [(r.id, r.value, r.details) for r in out.results if not r.valid]
    assert set(out.scores["families"]) == {"fidelity", "privacy"} and 0 <= out.scores["composite"] <= 1
    assert out.frame(spark).count() == len(plan.metrics)
    json.dumps(out.scores)


def test_failures_stay_apart(spark):
    out = evaluate(table(spark, 5).drop("gender", "city"), table(spark, 6).drop("gender", "city"), {k: v for k, v in SCHEMA.items() if v == "continuous"}, EvalPlan(["ks", "k_anonymity", "theils_u"]))
    assert [r.valid for r in out.results] == [True, False, False]


def test_report_and_statistics(spark):
    r, s = prepare(table(spark, 5), table(spark, 6), TableSchema.of(SCHEMA))
    rows = marginal_report(r, s).collect()
    assert len(rows) == 17 + 3 + 2 and all(x["score"] is not None for x in rows)
    u = univariate(r.frame, s.frame, ["age"]).filter("is_real").first()
    assert u["std"] == pytest.approx(np.std([x["age"] for x in r.frame.collect()], ddof=1))
    assert {x["value"]: x["n"] for x in redacted_counts(spark.createDataFrame([(v,) for v in ["a"] * 6 + ["b"] * 5 + ["c"]], "v string"), "v", top=1).collect()} == {"a": 6, "__other__": 5, "__redacted__": 1}


def test_inference_and_filling(spark):
    df = spark.createDataFrame([(float(k), "x", str(k), k % 2) for k in range(40)] + [(None, None, "z", 1)], "a double, b string, c string, d int")
    assert caster.infer_kinds(df) == {"a": "continuous", "b": "categorical", "c": "text", "d": "categorical_numeric"}
    assert caster.fill_missing(df, "mode").filter("b is null").count() == 0
    assert caster.compare_schemas(df, df.drop("b"))["missing"] == ["b"]
    assert isinstance(prepare(df, df, TableSchema.of({"a": "continuous"}))[0], CastTable)


def test_samples_draw_rows_not_values(spark):
    """A third of the rows are equal; few distinct rows fill a sample as well as many."""
    from tabassay.operators.frames import row_sample

    hot = spark.range(30_000).selectExpr("IF(id % 3 = 0, -1, id) AS x")
    got = [r["x"] for r in row_sample(hot, 300).collect()]
    assert len(got) == 300 and 60 <= got.count(-1) <= 140
    assert got == [r["x"] for r in row_sample(hot.repartition(3), 300).collect()]
    few = spark.range(25_000).selectExpr("CAST(id % 5 AS DOUBLE) AS x", "CAST(id % 5 AS DOUBLE) AS y")
    assert len(pairs.sampled(few, ["x", "y"], 1000)) == 1000
    assert row_sample(hot, 40_000).groupBy("x").count().filter("x = -1").first()["count"] == 10_000


def test_all_rows_in_blocks_equal_numpy(spark, monkeypatch):
    """Without a sample: kernels, energy and distance correlations over every pair, in several blocks, sides of unequal size."""
    monkeypatch.setattr(knn, "BLOCK", 16)
    a, b = table(spark, 1, 70), table(spark, 2, 45, 3.0)
    columns = ["age", "income", "score"]
    x, y = (np.array([[r[c] for c in columns] for r in t.collect()]) for t in (a, b))
    u, v = whole.standardised(x, y)
    for kernel in whole.KERNELS:
        assert whole.mmd(a, b, columns, kernel, 0.3, most=None)["raw"] == pytest.approx(whole.mmd_value(u, v, kernel, 0.3), abs=1e-9)
    assert whole.mmd(a, b, columns, most=None)["raw"] == pytest.approx(whole.mmd(a, b, columns)["raw"], abs=0.2)
    assert whole.energy_distance(a, b, columns, most=None)["raw"] == pytest.approx(whole.energy_value(u, v), abs=1e-9)
    for r in pairs.dcor(a, b, columns, most=None).collect():
        i, j = columns.index(r["c1"]), columns.index(r["c2"])
        assert r["real_value"] == pytest.approx(pairs.distance_correlation(x[:, i], x[:, j])) and r["synth_value"] == pytest.approx(pairs.distance_correlation(y[:, i], y[:, j]))
    flat = a.withColumn("age", F.lit(1.0))
    assert {r["real_value"] for r in pairs.dcor(flat, b, ["age", "score"], most=None).collect()} == {None}
    assert whole.energy_distance(a.limit(1), b, columns, most=None)["raw"] == 0.0


def test_least_rows_without_one_task(spark):
    """The rows of least mark are those that ordering them all would give, whatever bucket the limit falls into."""
    marked = spark.range(20_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)).alias("__u"))
    for most in (0, 1, 700, 19_999, 20_000, 30_000):
        want = [r["id"] for r in marked.orderBy("__u", "id").limit(most).collect()]
        assert sorted(r["id"] for r in lowest(marked, ["id"], most).collect()) == sorted(want)
    hot = marked.withColumn("__u", F.lit(0.5))
    assert lowest(hot, ["id"], 10).count() == 10
    assert lowest(marked.limit(0), ["id"], 10).count() == 0


@pytest.mark.parametrize("many", [0, 500])
def test_cuts_by_counting_and_by_binary_search(spark, many, monkeypatch):
    monkeypatch.setattr(frames, "MANY", many)
    cuts = [-2.0, 0.0, 0.0, 1.5, 9.0]
    rows = spark.createDataFrame([(v, cuts) for v in (-3.0, -2.0, 0.0, 0.1, 9.0, 10.0)], "v double, cuts array<double>")
    assert [r[0] for r in rows.select(cuts_below(F.col("cuts"), F.col("v"))).collect()] == [sum(c < v for c in cuts) for v in (-3.0, -2.0, 0.0, 0.1, 9.0, 10.0)]
    assert [r[0] for r in rows.select(cuts_below(F.col("cuts"), F.col("v"), True)).collect()] == [sum(c <= v for c in cuts) for v in (-3.0, -2.0, 0.0, 0.1, 9.0, 10.0)]
    assert rows.limit(1).select(cuts_below(F.array().cast("array<double>"), F.col("v"))).first()[0] == 0


def test_sides_are_cut_to_the_smaller(spark):
    r, s = privacy.balanced(table(spark, 1, 60), table(spark, 2, 40))
    assert (r.count(), s.count()) == (40, 40) and r.subtract(table(spark, 1, 60)).count() == 0
