"""Sums and neighbours over all pairs of rows that do not meet all pairs: against numpy, with frequent values, ties and constants."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.operators import distances, kernels, knn, learning, pairs, privacy, whole
from tabassay.operators.caster import CastTable


def odd_table(spark, seed, n, shift=0.0):
    """Two columns of few values, one of them mostly a single value, one of many, and repeated rows."""
    rng = np.random.default_rng(seed)
    few = np.where(rng.random(n) < 0.5, 3.0, rng.integers(0, 9, n))
    rows = np.column_stack([rng.normal(shift, 1, n).round(2), few, rng.integers(0, 40, n) * 2.5])
    rows[: n // 5] = rows[n // 5 : 2 * (n // 5)]
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double"), rows


def test_products_of_distances():
    rng = np.random.default_rng(3)
    for m in (0, 1, 2, 31, 32, 33, 65, 300):
        x, y, w = rng.integers(0, 20, m) / 3, rng.normal(size=m).round(1), rng.integers(1, 4, m)
        want = (np.abs(x[:, None] - x) * np.abs(y[:, None] - y) * w[:, None] * w).sum()
        assert distances.products_apart(x, y, w) == pytest.approx(want)


def test_distance_correlation_by_parts(spark):
    """Sixteen parts a column, so that pairs inside parts, across parts and at cut values all count."""
    (r, x), (s, y) = odd_table(spark, 1, 900), odd_table(spark, 2, 400, 0.5)
    for got in pairs.dcor(r, s, ["a", "b", "c"], most=None).collect():
        i, j = "abc".index(got["c1"]), "abc".index(got["c2"])
        assert got["real_value"] == pytest.approx(pairs.distance_correlation(x[:, i], x[:, j]), abs=1e-9)
        assert got["synth_value"] == pytest.approx(pairs.distance_correlation(y[:, i], y[:, j]), abs=1e-9)
    far = pairs.dcor(r.withColumn("a", F.lit(1e9)), s.withColumn("b", F.col("b") * 1e-9 + 1e6), ["a", "b", "c"], most=None).collect()
    assert [g["real_value"] is None for g in far] == [True, True, False]
    assert pairs.dcor(r.limit(0), s, ["a", "b"], most=None).first()["real_value"] is None


def apart(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))


def test_boxes_that_are_far_apart():
    """Weights on nodes give the sums over pairs, also for a box without width in a column and for boxes of boxes."""
    rng = np.random.default_rng(7)
    x, y = rng.random((700, 3)) * [1.0, 0.0, 0.5], rng.random((600, 3)) * 0.9 + [2.1, 0.3, 0.0]
    sx, sy = kernels.sides(np.arange(700)), kernels.sides(np.arange(600))
    for kernel, y_ in ((kernels.Power(1.0), y), (kernels.Power(0.5), y), (kernels.Radial(0.4), y - [2.0, 0.0, 0.0])):
        a, b = (kernels.nodes_of(t.min(axis=0), t.max(axis=0), kernel.nodes) for t in (x, y_))
        half = [kernels.nodes_of(t.min(axis=0), t.max(axis=0), kernel.nodes) for t in (x[:300], x[300:])]
        weights = kernels.lifted(kernels.spread(half[0], x[:300], sx[:300]), half[0], a) + kernels.lifted(kernels.spread(half[1], x[300:], sx[300:]), half[1], a)
        want = kernels.met(kernel, x, sx, y_, sy, False)
        np.testing.assert_allclose(want, sx.T @ kernel.of(whole.squared_distances(x, y_)) @ sy)
        np.testing.assert_allclose(kernels.by_nodes(kernel, a, weights, b, kernels.spread(b, y_, sy)), want, rtol=1e-8)


def test_radial_kernel_by_boxes(spark, monkeypatch):
    """All kernels over many cells, far rows and copies among them, against numpy."""
    monkeypatch.setattr(knn, "CELL", 64)
    monkeypatch.setattr(kernels, "Radial", lambda gamma, made=kernels.Radial: made(gamma, 6, 0.1))
    (r, x), (s, y) = odd_table(spark, 1, 900), odd_table(spark, 2, 700, 0.5)
    u, v = whole.standardised(x, y)
    for kernel in whole.KERNELS:
        assert whole.mmd(r, s, ["a", "b", "c"], kernel, 0.05, most=None)["raw"] == pytest.approx(whole.mmd_value(u, v, kernel, 0.05), abs=1e-7)


def test_energy_distance_by_boxes(spark, monkeypatch):
    """Boxes far apart and near, rows far from all others, a frequent row; a sharper bound on boxes keeps nodes in use on few rows."""
    monkeypatch.setattr(knn, "CELL", 64)
    monkeypatch.setattr(kernels, "Power", lambda alpha, made=kernels.Power: made(alpha, 5, 3.0))
    (r, x), (s, y) = odd_table(spark, 1, 900), odd_table(spark, 2, 700, 0.5)
    hot, far = [(1.0, 3.0, 5.0)] * 200, [(400.0, 3.0, -9.0)] * 3
    r, s = (t.unionByName(spark.createDataFrame(hot + far, "a double, b double, c double")) for t in (r, s))
    u, v = whole.standardised(*(np.vstack([t, hot + far]) for t in (x, y)))
    for alpha in (1.0, 0.5):
        assert whole.energy_distance(r, s, ["a", "b", "c"], alpha, most=None)["raw"] == pytest.approx(whole.energy_value(u, v, alpha), abs=1e-6)


def test_neighbours_in_cells(spark, monkeypatch):
    """Many cells and blocks: distances and the smallest of all tied ids, copies of a row among them, own ids left out."""
    monkeypatch.setattr(knn, "CELL", 16)
    (r, _), (s, _) = odd_table(spark, 1, 500), odd_table(spark, 2, 300, 0.5)
    columns = ["a", "b", "c"]
    hot = r.limit(1).crossJoin(spark.range(40)).drop("id")
    far = spark.createDataFrame([(900.0, 0.0, 0.0), (float("nan"), 1.0, 1.0)], "a double, b double, c double")
    t, q = knn.numbered(r.unionByName(hot).unionByName(far), columns), knn.numbered(s.unionByName(hot.limit(3)).unionByName(far), columns, 1 << 40)
    scale = (np.zeros(3), np.ones(3))
    for queries in (q, t):
        x, y = (f.orderBy("id").toPandas() for f in (queries, t))
        gaps = apart(x[columns].to_numpy(), y[columns].to_numpy())
        gaps[(x["id"].to_numpy()[:, None] == y["id"].to_numpy()) | np.isnan(gaps)] = np.inf
        want = {int(i): (float(g.min()), int(y["id"].iloc[int(g.argmin())])) for i, g in zip(x["id"], gaps, strict=True) if np.isfinite(g).any()}
        got = {n["id"]: (n["distance"], n["neighbour"]) for n in knn.nearest(queries, t, columns, scale).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == pytest.approx(want[i][0]) and got[i][1] == want[i][1] for i in want)
    assert knn.nearest(q, t.limit(0), columns, scale).count() == 0
    assert "Cross" not in knn.nearest(q, t, columns, scale)._jdf.queryExecution().toString()


def test_record_linkage_in_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 16)
    (r, x), (s, y) = odd_table(spark, 3, 400), odd_table(spark, 4, 250, 0.5)
    gaps = apart((y - x.mean(axis=0)) / x.std(axis=0), (x - x.mean(axis=0)) / x.std(axis=0)).min(axis=1)
    got = privacy.record_linkage(r, s, ["a", "b", "c"], 0.2).first()
    assert got["linkage_rate"] == pytest.approx((gaps <= 0.2).mean()) and got["mean_distance"] == pytest.approx(gaps.mean())


def test_closest_records_in_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 16)
    (r, x), (s, y) = odd_table(spark, 3, 400), odd_table(spark, 4, 250, 0.5)
    gaps = apart((y - x.mean(axis=0)) / x.std(axis=0), (x - x.mean(axis=0)) / x.std(axis=0)).min(axis=1)
    got = privacy.dcr(r, s, ["a", "b", "c"]).first()
    assert got["median"] == pytest.approx(np.median(gaps)) and got["p5"] == pytest.approx(np.quantile(gaps, 0.05)) and got["copies"] == pytest.approx((gaps < 0.1).mean())


def test_adversarial_accuracy_in_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 16)
    (r, x), (s, y) = odd_table(spark, 5, 300), odd_table(spark, 6, 200, 0.5)
    u, v = ((t - x.mean(axis=0)) / x.std(axis=0) for t in (x, y))
    own = lambda t: (apart(t, t) + np.diag(np.full(len(t), np.inf))).min(axis=1)
    got = privacy.nnaa(r, s, ["a", "b", "c"]).first()
    # Distances that are equal but for rounding may fall to either side.
    assert got["accuracy"] == pytest.approx((apart(v, u).min(axis=1) <= own(v)).mean(), abs=0.02)
    assert got["reverse_accuracy"] == pytest.approx((apart(u, v).min(axis=1) < own(u)).mean(), abs=0.02)


def test_columns_are_attacked_side_by_side(spark, monkeypatch):
    """Two attacks wait for each other; rows keep the order of columns."""
    together = threading.Barrier(2, timeout=30)
    monkeypatch.setattr(learning, "attribute_attack", lambda real, synth, c, trees, seed: (together.wait(), {"column": c, "score": 0.5})[1])
    table = CastTable(spark.range(1).selectExpr("1.0D AS a", "2.0D AS b"), [], ["a", "b"])
    out = learning.inference_attack(table, table)
    assert [r["column"] for r in out["columns"]] == table.columns and out["score"] == 0.5
