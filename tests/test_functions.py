import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabassay.errors import RegistryError
from tabassay.functions import aggregate as A
from tabassay.functions import normalize as N
from tabassay.functions import ranktests as R
from tabassay.plans.taxonomy import ALL, by_place, expand

scores = st.lists(st.floats(0, 1), min_size=1, max_size=30)


@given(st.sampled_from(sorted(set(N.RULES.values()))), st.floats(-1e6, 1e6))
def test_normalised_values_stay_in_range(rule, value):
    assert 0 <= N.apply_rule(rule, value) <= 1


@given(st.floats(0, 100), st.floats(0, 100))
def test_distances_fall(a, b):
    low, high = sorted((a, b))
    for rule in (N.BOUNDED, N.UNBOUNDED, N.DELTA, N.LOSS):
        assert N.apply_rule(rule, low) >= N.apply_rule(rule, high)


def test_lookup_and_nan():
    assert N.normalize("ks", 0.25) == 0.75
    assert N.normalize("unknown", 0.4) == 0.4
    assert N.normalize("fidelity.psi", 0.25) == pytest.approx(math.exp(-1))
    assert math.isnan(N.normalize_all({"fidelity.ks": math.nan})["fidelity.ks"])
    assert N.clamp(math.inf) == 0


@given(scores)
@settings(max_examples=60)
def test_aggregators_stay_within_their_values(values):
    for name in A.AGGREGATORS:
        assert min(values) - 1e-9 <= A.aggregate(name, values) <= max(values) + 1e-9 or name in ("geometric_mean", "harmonic_mean")
    assert A.aggregate("ssd", values) <= A.aggregate("mean", values) + 1e-9


def test_aggregators_skip_what_is_not_finite():
    assert A.aggregate("mean", [0.5, math.nan, math.inf]) == 0.5
    assert math.isnan(A.aggregate("ssd", [math.nan]))
    assert A.aggregate("geometric_mean", [0, 0.5]) == 0
    with pytest.raises(RegistryError):
        A.aggregate("other", [1])


def test_column_aggregators_equal_plain_ones(spark):
    values = [0.1, 0.4, 0.4, 0.55, 0.8, 0.9, 0.95, 1.0, 0.3, 0.2, 0.65]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    row = df.agg(*[A.aggregate_column(n, F.col("v")).alias(n) for n in A.AGGREGATORS]).first()
    for n in A.AGGREGATORS:
        assert row[n] == pytest.approx(A.aggregate(n, values), abs=1e-9), n


def test_column_rules_equal_plain_ones(spark):
    values = [-1.0, 0.0, 0.2, 1.0, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for rule in sorted(set(N.RULES.values())):
        got = [r[0] for r in df.select(N.as_column(rule, F.col("v"), 2.0)).collect()]
        assert got == pytest.approx([N.apply_rule(rule, v, 2.0) for v in values]), rule


def test_robust_scores(spark):
    rows = [("fidelity.kl", "a", 0.0), ("fidelity.kl", "b", 10.0), ("fidelity.psi", "a", 3.0), ("fidelity.wasserstein", "a", 0.0), ("fidelity.ks", "a", 0.25)]
    got = {(r["metric"], r["column"]): r["score"] for r in N.column_scores(spark.createDataFrame(rows, "metric string, column string, raw double")).collect()}
    assert got == {("fidelity.kl", "a"): 1.0, ("fidelity.kl", "b"): 0.0, ("fidelity.psi", "a"): 0.5, ("fidelity.wasserstein", "a"): 1.0, ("fidelity.ks", "a"): 0.75}


def test_matrix_weights_and_runs():
    means, q = A.matrix_score([[0.9, 0.7], [0.2, 0.4]])
    assert means.tolist() == pytest.approx([0.8, 0.3]) and 0.3 <= q <= 0.55
    assert A.weighted_score([0.2, 0.8], [1, 1]) == pytest.approx(A.certainty_equivalent(np.array([0.2, 0.8])))
    with pytest.raises(ValueError):
        A.weighted_score([0.2], [0])
    s = A.run_statistics([0.5, 0.5, 0.7])
    assert s["mode"] == 0.5 and s["median"] == 0.5 and s["std"] == pytest.approx(np.std([0.5, 0.5, 0.7], ddof=1))


def test_taxonomy():
    assert len(ALL) == 47
    assert expand(["fidelity.marginal.scales", "ks", "fidelity.ks"]) == ["fidelity.delta_mean", "fidelity.delta_median", "fidelity.delta_iqr", "fidelity.delta_mad", "fidelity.cohens_d", "fidelity.ks"]
    assert by_place(["privacy.dcr"]) == {"privacy": {"dataset_based": {"empirical_similarity": ["privacy.dcr"]}}}
    with pytest.raises(RegistryError):
        expand(["nothing"])


def test_tails_and_ranges():
    assert R.chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert R.chi_squared_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert R.range_quantile(0.95, 2) / math.sqrt(2) == pytest.approx(1.960, abs=1e-3)
    assert R.range_quantile(0.95, 10) / math.sqrt(2) == pytest.approx(3.164, abs=2e-3)


def test_friedman_and_wilcoxon():
    best = {"a": [0.9, 0.8, 0.95, 0.9, 0.85, 0.9], "b": [0.5, 0.6, 0.55, 0.5, 0.6, 0.5], "c": [0.1, 0.2, 0.1, 0.3, 0.2, 0.1]}
    t = R.friedman(best)
    assert t.statistic == pytest.approx(12.0) and t.significant and t.ranks == {"a": 1.0, "b": 2.0, "c": 3.0}
    assert [p["significant"] for p in t.pairs if {p["a"], p["b"]} == {"a", "c"}] == [True]
    assert math.isnan(R.friedman({"a": [1.0], "b": [0.5]}).statistic)
    w = R.wilcoxon([1, 2, 3, 4, 5], [0, 0.5, 0.2, 0.1, 0.3])
    assert w.statistic == 0 and w.p_value == pytest.approx(2 / 32)
    assert R.wilcoxon([1, 1], [1, 1]).p_value == 1


def test_mean_ranks(spark):
    rows = [("a", 0, 0.9), ("b", 0, 0.9), ("c", 0, 0.1), ("a", 1, 0.2), ("b", 1, 0.5), ("c", 1, 0.1)]
    got = {r["generator"]: r["mean_rank"] for r in R.mean_ranks(spark.createDataFrame(rows, "generator string, seed int, score double")).collect()}
    assert got == {"a": 1.75, "b": 1.25, "c": 3.0}
