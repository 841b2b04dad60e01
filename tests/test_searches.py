"""Searches: many models in a pass, likelihood fits, and change points by running sums and dynamic programming."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from taperline.operators import changepoint, curves, fit
from test_operators import exact

CHANGE = [60.0, 0.15, 70.0, 0.1, 15.0]


def counted(spark, daily):
    """cum of one series a list of daily finds."""
    rows = []
    for sid, days in daily.items():
        total = 0.0
        for t, k in enumerate(days, 1):
            total += k
            rows.append((sid, float(t), total, 0.0, 0.0))
    return spark.createDataFrame(rows, "series_id string, t double, y double, y_fixed double, effort double")


DAILY = {"a": [9, 7, 8, 5, 4, 4, 2, 3, 1, 2, 1, 6, 9, 8, 7, 5, 6, 3, 2, 2, 1, 1], "b": [1, 0, 0, 3, 9, 12, 8, 5, 2, 1, 0, 0, 0, 1], "c": [0, 0, 2, 0, 0, 0, 1, 0]}


def test_a_pass_of_many_models_is_the_passes_of_each(spark):
    c = exact(spark, "exponential", [100.0, 0.08]).unionByName(exact(spark, "constant_removal", [80.0, 0.1, 0.6], 24, "r")).cache()
    models = ["exponential", "delayed_s", "gompertz", "logistic", "weibull_imperfect", "exp_change_point", "constant_removal", "reduction_factor", "effort_exponential_weibull", "effort_delayed_s_rayleigh"]
    for loss in ("sse", "mle"):
        together = {(r["series_id"], r["model_id"]): r for r in fit.fit_all(c, models, loss).collect()}
        assert len(together) == 2 * len(models)
        for m in ("delayed_s", "weibull_imperfect", "exp_change_point", "reduction_factor", "effort_delayed_s_rayleigh"):
            for r in fit.fit_profile(c, m, loss=loss).collect():
                t = together[r["series_id"], m]
                assert t["params"] == pytest.approx(r["params"]) and t["loss"] == pytest.approx(r["loss"], abs=1e-6)


def test_default_models_read_their_days_once(spark, tmp_path):
    exact(spark, "exponential", [100.0, 0.08]).write.parquet(str(tmp_path / "c"))
    plan = fit.fit_all(spark.read.parquet(str(tmp_path / "c")), curves.catalog_ids())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("model,truth", [("exp_change_point", CHANGE), ("delayed_s_change_point", [60.0, 0.3, 70.0, 0.2, 15.0]), ("constant_removal", [100.0, 0.08, 0.7]), ("reduction_factor", [100.0, 0.08, 5.0, 0.3])])
def test_likelihood_finds_the_truth(spark, model, truth):
    """The counts are the model's own means, so no candidate can beat the truth's likelihood by more than rounding, and the found one is near."""
    c = exact(spark, model, truth)
    found = fit.fit_zoom(c, model, loss="mle", rounds=3)
    point = spark.createDataFrame([("s", model, truth)], "series_id string, model_id string, params array<double>")
    best, got = (fit.poisson_loglik(c, f, [model]).first()["loglik"] for f in (point, found))
    assert got <= best + 1e-6 and got > best - 0.02 * abs(best) - 0.5
    near = {r["model_id"]: r["loss"] for r in fit.fit_all(c, [model], "mle").collect()}
    assert found.first()["loss"] <= near[model] + 1e-9


def test_likelihood_of_finds_and_effort(spark):
    truth = [100.0, 0.01, 400.0, 20.0]
    c = exact(spark, "effort_exponential_rayleigh", truth)
    found = fit.fit_zoom(c, "effort_exponential_rayleigh", loss="mle", rounds=3).first()
    assert found["params"] == pytest.approx(truth, rel=0.35) and found["params"][2:] == pytest.approx(truth[2:], rel=0.03)


def test_the_shared_day_is_split_to_the_optimum(spark):
    """Against a fine grid over both scales, for places inside a day."""
    c = counted(spark, {"a": DAILY["a"]})
    units = spark.createDataFrame([(0, [0.3, 0.2, 0.43])], "cand long, u array<double>")
    r = fit.fit_profile(c, "exp_change_point", units, "mle").first()
    a1, b1, a2, b2, tau = r["params"]
    assert tau != int(tau)

    def loss(x, y):
        m = lambda t: x * (1 - math.exp(-b1 * min(t, tau))) + y * (1 - math.exp(-b2 * max(t - tau, 0)))
        return -sum(k * math.log(max(m(t) - m(t - 1), 1e-12)) - (m(t) - m(t - 1)) - math.lgamma(k + 1) for t, k in enumerate(DAILY["a"], 1))

    assert loss(a1, a2) == pytest.approx(r["loss"], rel=1e-4)  # ln k! is by Stirling's formula there
    assert all(loss(a1, a2) <= loss(a1 * (1 + i / 500), a2 * (1 + j / 500)) + 1e-6 for i in range(-5, 6) for j in range(-5, 6))


def test_what_likelihood_refuses(spark):
    c = exact(spark, "exponential", [100.0, 0.08])
    curves.register_model(curves.ModelSpec("two_at_once", "own", {"a1": ("1", "3*Y"), "b1": ("0.01", "1"), "a2": ("1", "3*Y"), "b2": ("0.01", "1")}, "(a1*(1-exp(-b1*t))+a2*(1-exp(-b2*t)))", "(a1+a2)", pair=True, first="(1-exp(-b1*t))", second="(1-exp(-b2*t))"))
    try:
        with pytest.raises(ValueError):
            fit.fit_profile(c, "two_at_once", loss="mle")
        assert fit.fit_profile(c, "two_at_once").first()["loss"] < 50
        with pytest.raises(ValueError):
            fit.fit_profile(c, "change_points_2")
    finally:
        del curves.MODELS["two_at_once"]


@pytest.mark.parametrize("model", ["exp_change_point", "delayed_s_change_point"])
def test_profile_by_sums_is_the_profile_by_search(spark, model):
    c = counted(spark, DAILY).cache()
    spec, bare = curves.MODELS[model], None
    ours = {(r["series_id"], r["tau"]): r for r in changepoint.profile_tau(c, model).collect()}
    plan = changepoint.profile_tau(c, model)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "explode(sequence" not in plan
    from dataclasses import replace

    curves.register_model(replace(spec, model_id="bare", decay=()))
    try:
        bare = {(r["series_id"], r["tau"]): r for r in changepoint.profile_tau(c, "bare").collect()}
        fits = spark.createDataFrame([(s, m, CHANGE) for s in DAILY for m in (model, "bare")], "series_id string, model_id string, params array<double>")
        scans = [{(r["series_id"], r["tau"]): r["sse"] for r in changepoint.scan_tau(c, fits, m).collect()} for m in (model, "bare")]
    finally:
        del curves.MODELS["bare"]
    assert ours.keys() == bare.keys() and {s for s, _ in ours} == set("abc")
    for k, r in ours.items():
        assert r["loss"] == pytest.approx(bare[k]["loss"], rel=1e-7, abs=1e-6) and r["best"] == bare[k]["best"]
    assert scans[0].keys() == scans[1].keys() and all(v == pytest.approx(scans[1][k], rel=1e-9) for k, v in scans[0].items())


def test_sums_of_long_series_stay_in_range(spark):
    """exp(b t) overflows beyond 709: blocks keep the exponents small."""
    n, days = 2000, [(t * 7) % 5 for t in range(2000)]
    c = counted(spark, {"s": days})
    rows = c.select("series_id", "t", F.lit(float(n)).alias("n"), "y", F.explode(F.array(F.lit(1.0), F.lit(0.37), F.lit(0.002))).alias("b"))
    got = {(r["b"], int(r["t"])): r for r in changepoint.segment_sums(rows, ("1.0D", "b"), ["series_id", "b"]).where("t in (1, 299, 301, 700, 1500, 1999, 2000)").collect()}
    y = list(itertools.accumulate(days))
    kernel = lambda b, d: 1 - (1 + b * d) * math.exp(-b * d)
    for (b, tau), r in got.items():
        want = sum(y[t - 1] * kernel(b, t - tau) for t in range(tau + 1, n + 1))
        assert r["s_ky"] == pytest.approx(want, rel=1e-9, abs=1e-6) and r["s_kk"] == pytest.approx(sum(kernel(b, d) ** 2 for d in range(n - tau + 1)), rel=1e-9, abs=1e-9)
        assert r["ky"] == pytest.approx(sum(y[t - 1] * kernel(b, t) for t in range(1, tau + 1)), rel=1e-9) and r["y_after"] == pytest.approx(sum(y[tau:]), rel=1e-12)


def stretches(days, points=100, shortest=2, top=2.0):
    y, out = max(1.0, float(sum(days))), {}
    for i in range(len(days)):
        for j in range(i + shortest, len(days) + 1):
            best = None
            for r in range(1, points + 1):
                b = 0.001 + 0.999 * r / points
                a = min(max(sum(days[i:j]) / (1 - math.exp(-b * (j - i))), 1.0), top * y)
                lam = [a * (math.exp(-b * (t - 1)) - math.exp(-b * t)) for t in range(1, j - i + 1)]
                v = sum(k * math.log(x) - x for k, x in zip(days[i:j], lam))
                best = max(best or (v, 0, 0), (v, -b, a))
            out[i, j] = best
    return out


def test_change_points_are_the_best_of_all_places(spark):
    got = {(r["series_id"], r["points"]): r for r in changepoint.fit_change_points(counted(spark, DAILY)).collect()}
    for sid, days in DAILY.items():
        cost, n = stretches(days), len(days)
        for points in (1, 2, 3):
            ways = [(sum(cost[e][0] for e in zip((0, *p), (*p, n))), p) for p in itertools.combinations(range(2, n - 1), points) if all(b - a >= 2 for a, b in zip((0, *p), (*p, n)))]
            r = got.pop((sid, points), None)
            assert (r is not None) == bool(ways)
            if ways:
                assert r["loss"] == pytest.approx(sum(0 if k < 2 else math.lgamma(k + 1) for k in days) - max(ways)[0], abs=1e-6) and r["k"] == 3 * points + 2
                taus = [x for x in r["params"] if x == int(x) and x > 1][-points:] if points == 1 else r["params"][2::3]
                assert sum(cost[e][0] for e in zip((0, *map(int, taus)), (*map(int, taus), n))) == pytest.approx(max(ways)[0], abs=1e-6)
    assert not got


def test_a_fit_of_several_points_is_scored_as_its_curve(spark):
    c = counted(spark, DAILY)
    f = changepoint.fit_change_points(c)
    models = ["exp_change_point", "change_points_2", "change_points_3"]
    by_curve = {(r["series_id"], r["model_id"]): -r["loglik"] for r in fit.poisson_loglik(c, f, models).collect()}
    for r in f.collect():
        assert by_curve[r["series_id"], r["model_id"]] == pytest.approx(r["loss"], abs=1e-5)
    assert {r["series_id"]: r["n"] for r in f.groupBy("series_id").agg(F.count_if("best").alias("n")).collect()} == {"a": 1, "b": 1, "c": 1}
    one = {r["series_id"]: r for r in changepoint.fit_change_points(c, 1, shortest=3, top=3.0).collect()}
    for r in changepoint.poisson_lr(c, ["series_id"]).collect():
        assert one[r["series_id"]]["params"][-1] == r["tau"]
    assert changepoint.fit_change_points(c.limit(0)).collect() == []


def test_likelihood_ratio(spark):
    flat = counted(spark, {"n": [12, 11, 10, 9, 8, 8, 7, 6, 6, 5, 5, 4, 4, 4, 3, 3]})
    clear = counted(spark, {"y": [20, 14, 9, 5, 3, 2, 1, 0, 25, 17, 11, 7, 4, 3, 2, 1]})
    got = {r["series_id"]: r for r in changepoint.change_point_lrt(flat.unionByName(clear), replicates=60).collect()}
    assert got["y"]["grade"] in ("significant", "weak") or got["y"]["p_value"] == pytest.approx(1 / 61)
    assert got["n"]["grade"] == "none" and got["n"]["chi2_p"] > 0.3 and got["y"]["chi2_p"] < 1e-6 and got["y"]["df"] == 3
    other = changepoint.change_point_lrt(clear, "delayed_s", "delayed_s_change_point", replicates=5).first()
    squares = changepoint.change_point_lrt(clear, replicates=5, loss="sse").first()
    assert other["lr"] > 0 and squares["lr"] > 0 and other["n_reps"] == squares["n_reps"] == 5
