import json
import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from test_engine import SCHEMA, table

import tabassay.generators.models  # noqa: F401  registers
from tabassay.errors import AssayError, ConfigError, PreparationError, RegistryError
from tabassay.generators.simple import halves, uniform_noise
from tabassay.operators import learning
from tabassay.operators.caster import prepare
from tabassay.plans import api, benchmark, calibrate, cli
from tabassay.plans.evaluate import EvalPlan, MetricResult, roll_up
from tabassay.plans.registry import GENERATORS, METRICS, Registry
from tabassay.schema import TableSchema
from tabassay.sources import config as config_files
from tabassay.sources import loaders, reports
from tabassay.streaming.drift import monitor


@pytest.fixture(scope="module")
def real(spark):
    return prepare(table(spark, 5, 120), table(spark, 5, 120), TableSchema.of(SCHEMA))[0]


@pytest.mark.parametrize("name", ["real_data", "uniform_noise", "bootstrap", "delete_zero", "delete_mean", "delete_median", "delete_mode", "gaussian_copula", "bayesian_network", "bn", "smotenc", "cart"])
def test_generators_keep_columns_and_ranges(real, name):
    options = {"cart": {"sweeps": 1}, "smotenc": {"target": "gender"}}.get(name, {})
    out = GENERATORS[name](seed=1, **options).fit_generate(real, 60)
    assert sorted(out.frame.columns) == sorted(real.columns)
    got, own = out.frame.toPandas(), real.frame.toPandas()
    assert 20 <= len(got) <= 110 and not got.isna().any().any()
    assert set(got["city"]) <= set(own["city"])
    low = 0 if name.startswith("delete_zero") else own["income"].min()
    assert got["income"].between(low - 1e-6, own["income"].max() + 1e-6).all()


def test_copula_keeps_dependence(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    df = spark.createDataFrame([(float(a), float(a + 0.3 * b), "p" if a > 0 else "q") for a, b in zip(x, rng.normal(size=600))], "a double, b double, c string")
    real, _ = prepare(df, df, TableSchema.of({"a": "continuous", "b": "continuous", "c": "categorical"}))
    for name, least in (("gaussian_copula", 0.85), ("bayesian_network", 0.6)):
        out = GENERATORS[name](seed=2).fit_generate(real, 800).frame.toPandas()
        assert out["a"].corr(out["b"]) > least
        assert abs((out["c"] == "p").mean() - 0.5) < 0.12


def test_external_generators_take_tables(real):
    with pytest.raises(PreparationError):
        GENERATORS["ctgan"]().fit(real).generate(5)
    assert GENERATORS["tvae"](rows=real).fit(real).generate(5).frame.count() == 5
    with pytest.raises(RegistryError):
        GENERATORS["nothing"]


def test_halves_and_noise(real):
    a, b = halves(real, 3)
    assert a.frame.count() + b.frame.count() == 120 and 35 < a.frame.count() < 85
    n = uniform_noise(real, 3).frame.toPandas()
    assert len(n) == 120 and (n["age"] == n["age"].round()).all() and not (n["income"] == n["income"].round()).all()


def test_bounds():
    b = calibrate.bounds_of([0.9, 0.95], [0.2, 0.3], "fidelity")
    assert (b.low, b.high, b.inverted) == (0.3, 0.9, False)
    b = calibrate.bounds_of([0.2, 0.3], [0.8, 0.9], "privacy")
    assert (b.low, b.high, b.inverted) == (0.3, 0.8, False)
    assert calibrate.bounds_of([0.2, 0.3], [0.8, 0.9], "fidelity").inverted
    assert calibrate.place(0.6, 0.3, 0.9) == pytest.approx(0.5) and calibrate.place(0.6, 0.3, 0.9, True) == pytest.approx(0.5)
    assert calibrate.place(2, 0.3, 0.9) == 1 and calibrate.place(0.5, 0.5, 0.5) == 1 and calibrate.place(0.4, 0.5, 0.5) == 0
    assert math.isnan(calibrate.place(math.nan, 0, 1))
    assert calibrate.tuned([[1.0, 1.0]], [[0.0, 0.0]])[1] == 0


def test_calibration_and_cache(real, tmp_path):
    plan, cache = EvalPlan(["ks", "tvd", "delta_mean", "k_anonymity"]), calibrate.BoundsCache(tmp_path)
    made = cache.get_or_calibrate(real, plan, iterations=2)
    assert set(made.families) == {"fidelity", "privacy"} and made.families["fidelity"].high > made.families["fidelity"].low
    assert cache.get_or_calibrate(real, plan, iterations=2).families == made.families and len(list(tmp_path.iterdir())) == 1
    out = made.calibrated({"fidelity": made.families["fidelity"].high, "privacy": 0.0})
    assert out["fidelity"] == (0 if made.families["fidelity"].inverted else 1) and 0 <= out["composite"] <= 1
    bad = tmp_path / "bad.json"
    bad.write_text("{}")
    with pytest.raises(ConfigError):
        calibrate.Bounds.load(bad)
    assert cache.clear() == 1


def test_fingerprint_ignores_order_not_content(spark):
    a = table(spark, 5)
    assert calibrate.fingerprint(a) == calibrate.fingerprint(a.orderBy("income").repartition(3))
    assert calibrate.fingerprint(a) != calibrate.fingerprint(table(spark, 6))


def test_roll_up_of_known_values():
    values = {"fidelity.ks": 0.8, "fidelity.wasserstein": 0.6, "fidelity.mmd": math.nan, "privacy.dcr": 0.7}
    s = roll_up([MetricResult(k, v, k.split(".")[0]) for k, v in values.items()])
    assert s["hierarchy"]["fidelity"]["categories"]["marginal"]["score"] == pytest.approx(0.7)
    assert s["counts"] == {"total": 4, "valid": 3, "failed": ["fidelity.mmd"]}
    assert 0.6 <= s["families"]["fidelity"] <= 0.7 and s["families"]["privacy"] == 0.7


def test_learning_metrics(spark):
    rng = np.random.default_rng(1)
    make = lambda n, s: spark.createDataFrame([(float(a), float(b), "y" if a + 0.1 * b > s else "n") for a, b in rng.normal(s, 1, (n, 2))], "a double, b double, t string")
    schema = TableSchema.of({"a": "continuous", "b": "continuous", "t": "categorical"})
    r, s = prepare(make(200, 0), make(200, 0), schema)
    out = learning.efficiency(r, s, "t")
    assert out["task"] == "classification" and set(out["strategies"]) == set(learning.STRATEGIES) and out["score"] > 0.7
    assert learning.efficiency(r, s, "a", ["tstr"])["task"] == "regression"
    far = prepare(make(200, 0), make(200, 9), schema)
    assert learning.membership_attack(*far)["score"] > 0.9 > learning.membership_attack(r, s)["score"]
    attack = learning.attribute_attack(r, s, "t", trees=10)["score"]
    assert 0 <= attack < 0.5


def test_csv_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n1, x ,,\n2,NA,,null\n,,,\n3.5,y,,5\n")
    t = loaders.load(spark, str(path))
    assert t.dtypes == [("a", "double"), ("b", "string"), ("d", "bigint")]
    assert [tuple(r) for r in t.collect()] == [(1.0, "x", None), (2.0, None, None), (3.5, "y", 5)]
    loaders.save_csv(t, str(tmp_path / "out.csv"))
    assert loaders.load(spark, str(tmp_path / "out.csv")).count() == 3
    info = loaders.file_info(spark, str(path))
    assert info["bytes"] == path.stat().st_size and set(info["types"]) == {"a", "b", "d"}
    with pytest.raises(ConfigError):
        loaders.load(spark, "None")


def test_configurations(tmp_path):
    good = {"data": {"real": "a", "synthetic": "b"}, "metrics": ["ks"], "report": {"formats": ["json"], "output_dir": "x"}}
    path = tmp_path / "c.yaml"
    config_files.save_config(good, path)
    assert config_files.load_config(path) == good
    assert config_files.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    for bad in ({}, {"data": {"real": "a"}, "metrics": ["ks"]}, {"data": good["data"]}, good | {"report": {"formats": []}}, good | {"aggregation": {"risk_aversion": 0}}, good | {"report": 3}):
        with pytest.raises(ConfigError):
            config_files.check(bad)
    path.write_text("a: [")
    with pytest.raises(ConfigError):
        config_files.load_config(path)


def test_paths_stay_inside(tmp_path):
    assert reports.inside(tmp_path, "a", "b.json").parent.name == "a"
    with pytest.raises(ConfigError):
        reports.inside(tmp_path, "..", "x")


def test_command_line(spark, tmp_path, capsys):
    for name, seed in (("real", 5), ("synth", 6)):
        table(spark, seed, 80).write.parquet(str(tmp_path / name))
    config = {
        "data": {"real": str(tmp_path / "real"), "synthetic": str(tmp_path / "synth"), "schema": SCHEMA},
        "metrics": ["fidelity.marginal.scales", "privacy.k_anonymity"],
        "evaluation": {"n_runs": 2},
        "report": {"formats": ["json", "md"], "output_dir": str(tmp_path / "out")},
        "benchmark": {"generators": ["bootstrap", {"name": "uniform_noise"}], "n_runs": 2},
        "calibration": {"iterations": 1},
    }
    path = tmp_path / "c.yaml"
    config_files.save_config(config, path)
    assert cli.main(["evaluate", "-c", str(path)], spark) == 0
    assert set(json.loads(capsys.readouterr().out)["families"]) == {"fidelity", "privacy"}
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert summary["artifacts"]["runs"]["n"] == 2 and "| fidelity |" in (tmp_path / "out" / "summary.md").read_text()
    assert cli.main(["calibrate", "-c", str(path), "-o", str(tmp_path / "b.json")], spark) == 0
    with_bounds = api.Evaluator(config | {"calibration": {"bounds_file": str(tmp_path / "b.json")}}).evaluate(table(spark, 5, 80), table(spark, 6, 80))
    assert "composite" in with_bounds.scores["calibrated"]
    capsys.readouterr()
    assert cli.main(["benchmark", "-c", str(path)], spark) == 0
    rows = [tuple(r) for r in json.loads(capsys.readouterr().out)]
    scores, ranks, test = benchmark.compare(spark, rows)
    assert scores.count() == 6 and ranks.count() == 2 and test.name == "Wilcoxon"
    assert "bootstrap" in benchmark.as_markdown(rows, test) and benchmark.as_csv(rows).startswith("generator,seed")
    assert cli.main(["version"]) == 0


def test_registries(spark, real):
    names = Registry("thing")
    names.register("a")(1)
    with pytest.raises(RegistryError):
        names.register("a")(2)
    METRICS.register("fidelity.rows")(lambda r, s, plan: {"score": 1.0})
    try:
        from tabassay.plans.evaluate import evaluate_cast

        plan = EvalPlan(["ks"])
        plan.metrics.append("fidelity.rows")
        assert [r.value for r in evaluate_cast(real, real, plan)] == [1.0, 1.0]
    finally:
        del METRICS["fidelity.rows"]
    assert issubclass(RegistryError, AssayError)


def test_stream_monitor(spark, tmp_path):
    for k in range(2):
        table(spark, 6 + k, 40).write.parquet(str(tmp_path / "in" / f"b{k}"))
    schema = table(spark, 6).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    monitor(stream, table(spark, 5), lambda df, n: seen.extend(df.collect()), ["age"], ["city"], checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["metric"], r["column"]) for r in seen} == {("fidelity.ks", "age"), ("fidelity.psi", "age"), ("fidelity.psi", "city")}


def test_store_folds_and_division(spark):
    from pyspark.sql import functions as F

    from tabassay.plans.cache import StatsStore, folds, key_of, safe_divide

    store = StatsStore(2)
    assert [store.get(k, lambda k=k: k.upper()) for k in ("a", "b", "a", "c", "b")] == ["A", "B", "A", "C", "B"]
    assert store.statistics() == {"size": 2, "hits": 1, "misses": 4, "hit_rate": 0.2} and key_of("univariate", "real", "age") == "univariate:real:age"
    t = table(spark, 5)
    parts = list(folds(t, 4))
    assert sum(test.count() for _, test in parts) == t.count() and all(a.count() + b.count() == t.count() for a, b in parts)
    assert [r[0] for r in spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double").select(safe_divide(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, 0.0]


def test_hierarchy_frame_equals_the_tree(spark):
    from tabassay.plans.evaluate import RunSummary, hierarchy_frame, worst_columns

    values = {"fidelity.ks": 0.8, "fidelity.wasserstein": 0.6, "fidelity.psi": 0.5, "fidelity.mmd": math.nan, "fidelity.pearson": 0.9, "privacy.dcr": 0.7}
    results = [MetricResult(k, v, k.split(".")[0]) for k, v in values.items()]
    tree = roll_up(results)["hierarchy"]
    got = {(r["family"], r["category"], r["subcategory"]): r["score"] for r in hierarchy_frame(RunSummary(EvalPlan(["ks"]), results, {}).frame(spark)).collect()}
    for f, t in tree.items():
        assert got[f, None, None] == pytest.approx(t["score"])
        for c, x in t["categories"].items():
            assert got[f, c, None] == pytest.approx(x["score"])
            for s, y in x["subcategories"].items():
                assert got[f, c, s] == pytest.approx(y["score"])
    scored = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.1), ("m", "c", None), ("n", "a", 0.2)], "metric string, column string, score double")
    assert {(r["metric"], r["column"]) for r in worst_columns(scored, 1).collect()} == {("m", "b"), ("n", "a")}


def test_a_missing_package_is_not_taken_for_a_missing_subpackage(tmp_path):
    """Without the training-data parts the entry imports; with them, an import that fails inside is an error."""
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "tabassay").mkdir()
    for p in (root / "tabassay").iterdir():
        if p.name != "llm":
            (tmp_path / "tabassay" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    alone = run()
    assert alone.returncode == 0 and int(alone.stdout) > 50
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    assert run().returncode != 0


@pytest.mark.parametrize(
    "given,low,high,privacy,composite",
    [
        (None, "median", "ssd", "ssd", "ssd"),
        ("mean", "median", "mean", "mean", "mean"),
        ({"layers_1_2": "max", "layers_3_4": "min"}, "max", "min", "min", "min"),
        ({"fidelity": {"level_1": "min", "level_2": "max", "level_3": "ssd"}, "privacy": {}, "composite": "mean"}, "max", "mean", "mean", "mean"),
        ({"fidelity": "mean", "privacy": "max", "composite": "min"}, "median", "ssd", "max", "min"),
        ({"composite": "max"}, "median", "ssd", "ssd", "max"),
    ],
)
def test_shapes_of_aggregators(given, low, high, privacy, composite):
    config = {"data": {"real": "-", "synthetic": "-"}, "metrics": ["fidelity.ks"], "aggregation": {} if given is None else {"layers": given}}
    layers = api.plan_of(config).layers
    assert (layers.low, layers.high, layers.families.get("privacy", layers.high), layers.composite or layers.high) == (low, high, privacy, composite)
    results = [MetricResult("privacy.dcr", 0.2, "privacy"), MetricResult("privacy.nnaa", 0.6, "privacy"), MetricResult("fidelity.ks", 0.9, "fidelity")]
    from tabassay.functions.aggregate import aggregate

    scores = roll_up(results, layers)
    assert scores["families"]["privacy"] == pytest.approx(aggregate(privacy, [0.2, 0.6]))
    assert scores["composite"] == pytest.approx(aggregate(composite, scores["families"].values()))


def test_settings_are_drawn_by_the_seed():
    a = learning.settings(40, 3)
    assert a == learning.settings(40, 3) and a[0] == learning.Setting() and a[:5] == learning.settings(5, 3) and a != learning.settings(40, 4)
    assert all(3 <= s.depth <= 10 and 1e-5 <= s.rate <= 1 and 0.5 <= s.share <= 1 for s in a)
