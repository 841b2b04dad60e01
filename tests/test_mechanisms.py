"""Matrices, events by place, losses and metrics of one's own, survivors, and fits that are kept up to date."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taperline.functions.linear import inverse, one_norm
from taperline.operators import changepoint, curves, diagnostics, fit, uncertainty
from taperline.streaming.incremental import IncrementalFit
from test_operators import exact


def test_inverse(spark):
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 6):
        made = [rng.normal(size=(k, k)) * 10.0 ** rng.integers(-3, 4, size=(k, 1)) for _ in range(20)]
        rows = [(m.ravel().tolist(),) for m in made] + [([0.0] * (k * k),), ([float("nan")] * (k * k),), ([1.0] * (k * k + 1),), (None,)]
        got = spark.createDataFrame(rows, "m array<double>").select("m", inverse(F.col("m"), k, 1e12).alias("i"), one_norm(F.col("m"), k).alias("n")).collect()
        for m, r in zip(made, got):
            if np.linalg.cond(m, 1) < 1e11:
                assert np.allclose(np.array(r["i"]).reshape(k, k) @ m, np.eye(k), atol=1e-6) and r["n"] == pytest.approx(np.linalg.norm(m, 1))
        assert all(r["i"] is None for r in got[20:])
    near = [[1.0, 1.0, 1.0, 1.0 + 1e-12]]
    assert spark.createDataFrame([(x,) for x in near], "m array<double>").select(inverse(F.col("m"), 2).alias("i")).first()["i"] is None
    swap = spark.createDataFrame([([0.0, 2.0, 4.0, 0.0],)], "m array<double>").select(inverse(F.col("m"), 2).alias("i")).first()["i"]
    assert swap == [0.0, 0.25, 0.5, 0.0]


def test_bands_need_no_python(spark):
    c = exact(spark, "exponential", [100.0, 0.08]).withColumn("y", F.col("y") + F.col("t") % 3)
    f = fit.fit_profile(c, "exponential")
    plan = uncertainty.delta_band(c, f, "exponential")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    e = {r["param"]: r for r in uncertainty.param_standard_errors(c, f, "exponential", "sse").collect()}
    h = np.array([r["value"] for r in uncertainty.numeric_hessian(c, f, "exponential", "sse").orderBy("i", "j").collect()]).reshape(2, 2)
    scale = 2 * fit.sse(c, f, ["exponential"]).first()["sse"] / 28
    assert [e[p]["se"] for p in "ab"] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h)) * scale).tolist(), rel=1e-6)


def fits_to_come(spark):
    """Days of three series and their fits, not stored: whoever reads these twice shares exchanges between the two; with the covariances of a and b by hand."""
    c = exact(spark, "exponential", [100.0, 0.08], sid="r").unionByName(exact(spark, "exponential", [60.0, 0.2], sid="s")).unionByName(exact(spark, "exponential", [300.0, 0.03], sid="u")).withColumn("y", F.col("y") + F.col("t") % 3)
    f = fit.fit_profile(c, "exponential")
    by_hand = {}
    for r in f.collect():
        t, y = (np.array(x) for x in zip(*((d["t"], d["y"]) for d in c.where(F.col("series_id") == r["series_id"]).orderBy("t").collect())))
        (a, b), e = r["params"], np.exp(-r["params"][1] * t)
        g, off = np.array([1 - e, a * t * e]), y - a * (1 - e)
        second = np.array([[np.zeros_like(t), t * e], [t * e, -a * t * t * e]])
        by_hand[r["series_id"]] = (t, a * (1 - e), g, np.linalg.inv(2 * (g @ g.T - second @ off)) * 2 * (off @ off) / (len(t) - 2))
    return c, f, by_hand


def test_bands_of_fits_to_come(spark):
    c, f, by_hand = fits_to_come(spark)
    got = uncertainty.delta_band(c, f, "exponential").orderBy("series_id", "t").collect()
    assert len(got) == c.count() and by_hand.keys() == {"r", "s", "u"}
    for s, (t, m, g, cov) in by_hand.items():
        rows, half = [r for r in got if r["series_id"] == s], 1.959963984540054 * np.sqrt(np.einsum("it,ij,jt->t", g, cov, g))
        assert [r["t"] for r in rows] == t.tolist() and [r["m"] for r in rows] == pytest.approx(m.tolist())
        assert [(r["upper"] - r["lower"]) / 2 for r in rows] == pytest.approx(half.tolist(), rel=1e-3)


def test_correlations_of_fits_to_come(spark):
    c, f, by_hand = fits_to_come(spark)
    got = {(r["series_id"], r["a"], r["b"]): r["correlation"] for r in uncertainty.correlations(uncertainty.param_standard_errors(c, f, "exponential", "sse"), "exponential").collect()}
    assert len(got) == 12
    for s, (_, _, _, cov) in by_hand.items():
        ab = cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1])
        assert [got[s, x, z] for x in "ab" for z in "ab"] == pytest.approx([1, ab, ab, 1], rel=1e-3)


def test_standard_errors_of_fits_to_come(spark):
    c, f, by_hand = fits_to_come(spark)
    errors = uncertainty.param_standard_errors(c, f, "exponential", "sse")
    assert "NestedLoop" not in errors._jdf.queryExecution().executedPlan().toString()  # days meet candidates once, before
    got = {(r["series_id"], r["param"]): r for r in errors.collect()}
    assert len(got) == 6
    for s, (_, _, _, cov) in by_hand.items():
        assert [got[s, p]["se"] for p in "ab"] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-3)
        assert all(got[s, p]["covariance"] == pytest.approx(cov.ravel().tolist(), rel=5e-3) for p in "ab")
        assert all(got[s, p]["high"] - got[s, p]["value"] == pytest.approx(1.959963984540054 * got[s, p]["se"]) for p in "ab")
    assert uncertainty.param_standard_errors(c, f, "gompertz").collect() == []  # no fits of that model


def test_places_of_events(spark):
    rows = [("s", 1.0, 3.0), ("s", 2.0, 0.0), ("s", 3.0, 2.0), ("r", 1.0, 1.0)]
    expected = spark.createDataFrame(rows, "series_id string, t double, dy double").withColumn("model_id", F.lit("m"))
    got = {(r["series_id"], r["i"]): (r["t"], r["n"]) for r in diagnostics.event_times(expected).collect()}
    assert got == {("s", 1): (1 / 6, 5), ("s", 2): (0.5, 5), ("s", 3): (5 / 6, 5), ("s", 4): (2.25, 5), ("s", 5): (2.75, 5), ("r", 1): (0.5, 1)}


def test_a_day_of_ten_million_events(spark):
    """u = t / 2 for two days of unequal counts: D and W2 have closed forms, and nothing orders events."""
    n1, n2 = 10_000_000, 5_000_000
    c = spark.createDataFrame([("s", 1.0, float(n1), 0.0, 0.0), ("s", 2.0, float(n1 + n2), 0.0, 0.0)], "series_id string, t double, y double, y_fixed double, effort double")
    fits = spark.createDataFrame([("s", "ohba_weibull", [1e9, 1e-9, 1.0])], "series_id string, model_id string, params array<double>")
    times = diagnostics.transformed_times(c, fits, ["ohba_weibull"])
    plan = times._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # read from the top: days are ordered below, events are not
    got = diagnostics.ks_test(times).first()
    assert got["n"] == n1 + n2 and got["d"] == pytest.approx(n1 / (n1 + n2) - 0.5, abs=1e-6)


def test_losses_of_ones_own(spark):
    c = exact(spark, "exponential", [100.0, 0.08]).withColumn("y", F.col("y") + F.col("t") % 3).unionByName(exact(spark, "gompertz", [90.0, 3.0, 0.15], sid="g"))
    for known, own in (("sse", fit.SQUARES), ("mle", fit.POISSON)):
        for m in ("exponential", "gompertz"):
            a, b = ({r["series_id"]: r for r in fit.fit_profile(c, m, loss=x, rounds=r).collect()} for x, r in ((known, 0), (own, 0)))
            assert a.keys() == b.keys()
            for k in a:
                assert a[k]["params"] == pytest.approx(b[k]["params"]) and a[k]["loss"] == pytest.approx(b[k]["loss"], abs=1e-6)
    zoomed = fit.fit_zoom(c, "exponential", loss=fit.SQUARES, rounds=2)
    assert {r["series_id"]: r["loss"] for r in zoomed.collect()} == pytest.approx({r["series_id"]: r["loss"] for r in fit.fit_zoom(c, "exponential", rounds=2).collect()}, abs=1e-6)
    for model, loss in (("exp_change_point", fit.SQUARES), ("exponential", "none")):
        with pytest.raises(ValueError):
            fit.fit_profile(c, model, loss=loss)


def test_metrics_of_ones_own(spark):
    c = exact(spark, "exponential", [100.0, 0.08])
    f = spark.createDataFrame([("s", "exponential", [100.0, 0.08])], "series_id string, model_id string, params array<double>")
    known, own = (uncertainty.sensitivity(c, f, "exponential", *x).orderBy("param").collect() for x in (("total",), ("mine", 0.01, "a")))
    assert [(r["base"], r["elasticity"], r["grade"]) for r in known] == [(r["base"], r["elasticity"], r["grade"]) for r in own]
    day = {r["param"]: r for r in uncertainty.sensitivity(c, f, "exponential", "day95", value="-ln(0.05D)/b").collect()}
    assert day["b"]["base"] == pytest.approx(-math.log(0.05) / 0.08) and day["b"]["elasticity"] == pytest.approx(-1, abs=1e-3) and day["a"]["elasticity"] == 0


def test_points_spread_evenly(spark):
    u = np.array([r["u"] for r in fit.low_discrepancy(spark, 3, 512).collect()])
    assert u.shape == (512, 3) and u.min() >= 0 and u.max() < 1
    for k in range(3):
        assert np.histogram(u[:, k], 16, (0, 1))[0].min() >= 24
    more = np.array([r["u"] for r in fit.low_discrepancy(spark, 3, 100, 513).collect()])
    assert not (np.round(u[:, None], 9) == np.round(more[None], 9)).all(axis=2).any()


def test_survivors_beat_one_zoom(spark):
    random.seed(2)
    truths = [(str(i), [100.0, random.uniform(0.05, 0.3), random.uniform(0.05, 0.4), random.uniform(0.05, 0.4), random.uniform(8, 22)]) for i in range(12)]
    spec = curves.MODELS["imperfect_change_point"]
    points = spark.createDataFrame(truths, "series_id string, params array<double>").crossJoin(spark.range(1, 31).select(F.col("id").cast("double").alias("t")))
    c = points.select("series_id", "t", F.expr(curves.by_index(spec, spec.mean)).cast("double").alias("y"), F.lit(0.0).alias("y_fixed"), F.lit(0.0).alias("effort")).cache()
    found = {r["series_id"]: r for r in fit.fit_halving(c, "imperfect_change_point").collect()}
    zoomed = {r["series_id"]: r["loss"] for r in fit.fit_zoom(c, "imperfect_change_point").collect()}
    top = {r["series_id"]: r["s"] for r in c.groupBy("series_id").agg(F.sum(F.col("y") * F.col("y")).alias("s")).collect()}
    assert found.keys() == zoomed.keys() and sum(found[k]["loss"] for k in found) < 0.7 * sum(zoomed.values())
    assert sorted(found[k]["loss"] / top[k] for k in found)[-2] < 2e-3
    again = {r["series_id"]: r["sse"] for r in fit.sse(c, spark.createDataFrame([(k, r["model_id"], r["params"]) for k, r in found.items()], "series_id string, model_id string, params array<double>"), ["imperfect_change_point"]).collect()}
    assert again == pytest.approx({k: r["loss"] for k, r in found.items()}, abs=1e-4)


def test_incremental_fits_are_the_batch_fits(spark, tmp_path):
    days = [(s, d, float(k)) for s, ks in {"a": [9, 7, 8, 5, 4, 4, 2, 3, 1, 2, 1], "b": [0, 3, 9, 12, 8, 5, 2, 1, 0, 0, 1]}.items() for d, k in enumerate(ks, 1)]
    rows = [(s, f"2024-01-{d:02d}", k) for s, d, k in days]
    frame = lambda r: spark.createDataFrame(r, "series_id string, day string, found double").withColumn("day", F.to_date("day"))
    total, cum = {}, []
    for s, d, k in days:
        total[s] = total.get(s, 0.0) + k
        cum.append((s, float(d), total[s], 0.0, 0.0))
    batch = {(r["series_id"], m): r for m in ("exponential", "gompertz") for r in fit.fit_profile(spark.createDataFrame(cum, "series_id string, t double, y double, y_fixed double, effort double"), m, loss="mle").collect()}
    late = [("a", "2024-01-02", 2.0), ("b", "2024-01-05", 3.0)]
    early = [(s, d, k - sum(x for a, b, x in late if (a, b) == (s, d))) for s, d, k in rows]
    for model in ("exponential", "gompertz"):
        for name, order in (("one", [rows]), ("late", [early[::2], early[1::2], late]), ("mixed", [late, early[5:], early[:5]])):
            kept = IncrementalFit(spark, str(tmp_path / f"{model}-{name}"), model, "2024-01-01")
            for i, part in enumerate(order):
                kept.update(frame(part), i)
                if i == 1:
                    kept = IncrementalFit(spark, str(tmp_path / f"{model}-{name}"), model, "2024-01-01")  # a restart, which tries its last batch again
                    kept.update(frame(part), i)
            got = {r["series_id"]: r for r in kept.fits().collect()}
            assert got.keys() == {"a", "b"}
            for s in got:
                assert got[s]["params"] == pytest.approx(batch[s, model]["params"]) and got[s]["loss"] == pytest.approx(batch[s, model]["loss"], abs=1e-6)
    with pytest.raises(ValueError):
        IncrementalFit(spark, str(tmp_path / "x"), "logistic", "2024-01-01")


def test_no_change_points_in_short_series(spark):
    c = spark.createDataFrame([("s", 1.0, 1.0, 0.0, 0.0), ("s", 2.0, 2.0, 0.0, 0.0)], "series_id string, t double, y double, y_fixed double, effort double")
    assert changepoint.fit_change_points(c).collect() == [] and changepoint.profile_tau(c).collect() == [] and changepoint.poisson_lr(c, ["series_id"]).collect() == []
