import math

import pytest
from pyspark.sql import functions as F

from taperline.operators import changepoint, curves, diagnostics, fit, predict, score, series, uncertainty
from taperline.sources import observations as o

TRUTH = {
    "exponential": [100.0, 0.08],
    "delayed_s": [100.0, 0.17],
    "gompertz": [100.0, 3.0, 0.15],
    "ohba_weibull": [100.0, 0.05, 1.2],
    "exp_change_point": [60.0, 0.15, 70.0, 0.1, 15.0],
    "constant_removal": [100.0, 0.08, 0.7],
}


def exact(spark, model, params, n=30, sid="s"):
    spec = curves.MODELS[model]
    base = spark.range(1, n + 1).select(F.lit(sid).alias("series_id"), F.col("id").cast("double").alias("t"), F.array(*map(F.lit, params)).alias("params"))
    return base.select("series_id", "t", *(F.expr(curves.by_index(spec, e)).cast("double").alias(c) for e, c in ((spec.mean, "y"), (spec.corrected or "0.0", "y_fixed"), (spec.effort or "10*t", "effort"))))


@pytest.mark.parametrize("model", TRUTH)
def test_known_truth(spark, model):
    c = exact(spark, model, TRUTH[model]).cache()
    first, zoomed = fit.fit_profile(c, model).first(), fit.fit_zoom(c, model, rounds=3).first()
    assert zoomed["loss"] <= first["loss"] + 1e-9
    assert zoomed["loss"] < 0.002 * c.agg(F.sum(F.col("y") * F.col("y"))).first()[0]


def test_many_series_fit_as_each_alone(spark):
    both = exact(spark, "exponential", [100.0, 0.08], sid="a").unionByName(exact(spark, "exponential", [50.0, 0.2], sid="b"))
    together = {r["series_id"]: r["params"] for r in fit.fit_profile(both, "exponential").collect()}
    for k in "ab":
        assert fit.fit_profile(both.where(F.col("series_id") == k), "exponential").first()["params"] == together[k]


def test_edges_of_fits(spark):
    zero = spark.createDataFrame([("z", float(t), 0.0, 0.0, 0.0) for t in (1, 2)], "series_id string, t double, y double, y_fixed double, effort double")
    got = {r["model_id"]: r for r in fit.fit_all(zero, ["exponential", "constant_removal", "effort_exponential_weibull"]).collect()}
    assert got["exponential"]["success"] and got["constant_removal"]["warning"] == "no_fixes"
    assert not got["effort_exponential_weibull"]["success"] and got["effort_exponential_weibull"]["warning"] == "no_effort"
    scored = score.score_fits(zero, fit.fit_profile(zero, "exponential"), ["exponential"]).first()
    assert scored["criterion"] == "Invalid" and scored["r2"] == 0 and scored["aicc"] is None
    assert fit.fit_profile(zero.limit(0), "exponential").count() == 0


def test_same_curves_and_monotone(spark):
    t = spark.range(1, 40).select(F.lit("s").alias("series_id"), F.col("id").cast("double").alias("t"))
    def values(model, params):
        f = spark.createDataFrame([("s", model, params)], "series_id string, model_id string, params array<double>")
        return [r["m"] for r in curves.evaluate(f, t, [model]).orderBy("t").collect()]
    assert values("ohba_weibull", [90.0, 0.1, 1.0]) == pytest.approx(values("exponential", [90.0, 0.1]))
    assert values("pham_imperfect", [90.0, 0.1, 0.0]) == pytest.approx(values("exponential", [90.0, 0.1]))
    for model in ("exponential", "delayed_s", "shifted_gompertz", "exp_change_point", "integrated"):
        point = {"a": 80.0, "a1": 40.0, "a2": 50.0, "b": 0.1, "b1": 0.1, "b2": 0.05, "c": 0.2, "tau": 12.0, "eta": 0.8, "alpha": 0.1}
        v = values(model, [point[p] for p in curves.MODELS[model].params])
        assert v[0] > 0 and all(x <= y + 1e-9 for x, y in zip(v, v[1:]))


def test_learning_removal_is_its_integral():
    a, b, e0, e1, lam, t = 100.0, 0.1, 0.4, 0.9, 0.2, 12.0
    step = t / 20000
    area = sum((e1 - (e1 - e0) * math.exp(-lam * (i + 0.5) * step)) * a * b * math.exp(-b * (i + 0.5) * step) * step for i in range(20000))
    closed = a * (e1 * (1 - math.exp(-b * t)) - (e1 - e0) * b / (b + lam) * (1 - math.exp(-(b + lam) * t)))
    assert closed == pytest.approx(area, rel=1e-6)


def test_hypercube_takes_each_cell_once(spark):
    rows = fit.latin_hypercube(spark, 3, 50, seed=7).collect()
    for k in range(3):
        assert sorted(int(r["u"][k] * 50) for r in rows) == list(range(50))


def test_multistart_is_best_of_starts(spark):
    c = exact(spark, "gompertz", TRUTH["gompertz"])
    runs = fit.search_runs(c, "gompertz", {str(s): fit.latin_hypercube(spark, 2, 50, 101 + s) for s in range(3)})
    assert fit.fit_multistart(c, "gompertz", 3, 50).first()["loss"] == pytest.approx(min(r["loss"] for r in runs.collect()))


def test_weights_and_bands(spark):
    c = exact(spark, "exponential", [60.0, 0.1])
    fits = fit.fit_all(c, ["exponential", "delayed_s", "gompertz"])
    w = score.aic_weights(score.score_fits(c, fits, ["exponential", "delayed_s", "gompertz"]))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    conf = uncertainty.confidence_band(c, fits, "exponential", 60)
    pred = uncertainty.prediction_band(c, fits, "exponential", 60)
    assert conf.where("lower > upper").isEmpty()
    width = lambda d: d.agg(F.avg(F.col("upper") - F.col("lower"))).first()[0]
    assert width(pred) > width(conf)


def test_milestones(spark):
    c = exact(spark, "exponential", [100.0, 0.08])
    fits = fit.fit_zoom(c, "exponential")
    closed = {r["ratio"]: r for r in predict.milestones(c, fits, ["exponential"]).collect()}
    halved = {r["ratio"]: r for r in predict.milestones(c, fits, ["exponential"], closed=False).collect()}
    assert closed[0.9]["already_reached"] and closed[0.9]["day"] <= 30
    assert closed[0.99]["day"] == pytest.approx(halved[0.99]["day"], abs=1e-6)
    assert closed[0.99]["day"] == pytest.approx(-math.log(0.01) / 0.08, rel=0.02)


def test_change_point_is_found(spark):
    c = exact(spark, "exp_change_point", TRUTH["exp_change_point"])
    p = changepoint.profile_tau(c)
    assert p.where("best").first()["tau"] == 15
    assert changepoint.fit_change_point(c).first()["params"][4] == 15
    assert changepoint.profile_tau(c.where("t <= 6")).count() == 0


def test_diagnostics_edges(spark):
    c = exact(spark, "exponential", [100.0, 0.08])
    fits = spark.createDataFrame([("s", "exponential", [120.0, 0.08])], "series_id string, model_id string, params array<double>")
    res = diagnostics.residuals(diagnostics.expected_daily(c, fits, ["exponential"]))
    runs = diagnostics.runs_test(res).first()
    assert runs["pattern"] == "one_sign" and runs["p_value"] == 0
    assert diagnostics.diagnostic_score(res).first()["score"] <= 70
    assert diagnostics.goodness_of_fit(c, fits, ["exponential"], 2).count() == 1
    assert diagnostics.chi_square_gof(res.where("t < 8"), 2).count() == 0


def test_sources(spark, tmp_path):
    rows = [("a", "2024-01-01", "20", "x", "8", None), ("a", "2024-01-02", "25", "22", "12", "5")]
    raw = spark.createDataFrame(rows, "series_id string, day string, planned string, actual string, found string, fixed string")
    for fmt in ("csv", "json", "parquet"):
        o.write_table(raw, str(tmp_path / fmt), fmt)
        got = o.read_obs(spark, str(tmp_path / fmt), fmt).orderBy("day").collect()
        assert [(r["planned"], r["actual"], r["found"], r["fixed"]) for r in got] == [(20, 0, 8, 0), (25, 22, 12, 5)]
    good, short = o.require_min_days(o.read_obs(spark, str(tmp_path / "csv"), "csv"), 3)
    assert good.count() == 0 and short.first()["n_days"] == 2


def test_readme_days(spark):
    days = [(20, 15, 8, 2), (25, 22, 12, 5), (25, 28, 15, 8), (30, 25, 10, 10)]
    obs = spark.createDataFrame([("s", f"2024-01-0{i + 1}", *map(float, d)) for i, d in enumerate(days)], "series_id string, day string, planned double, actual double, found double, fixed double")
    t = series.running_totals(obs).orderBy("t").collect()
    assert [r["cum_found"] for r in t] == [8, 20, 35, 45] and [r["remaining"] for r in t] == [6, 13, 20, 20]


def test_register_model(spark):
    curves.register_model(curves.ModelSpec("half_life", "own", {"a": ("Y", "5*Y"), "h": ("1", "2*n")}, "(a*(1-power(0.5,t/h)))", "a"))
    try:
        c = exact(spark, "half_life", [100.0, 9.0])
        assert fit.fit_profile(c, "half_life").first()["params"][1] == pytest.approx(9, abs=0.3)
    finally:
        del curves.MODELS["half_life"]


def test_random_stream_of_days(spark, tmp_path):
    from taperline.streaming.daily import run_daily

    rows = [(f"2024-01-0{d} 10:00:00", s, "error") for d in range(1, 8) for s in ("a", "b") for _ in range(d)]
    events = spark.createDataFrame(rows, "ts string, user string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = run_daily(stream, F.col("user"), {"found": F.col("kind") == "error"}, lambda df, i: got.extend(df.collect()), str(tmp_path / "state"))
    q.awaitTermination(120)
    final = {(r["series_id"], r["day"].day): r["found"] for r in got}
    assert final[("a", 1)] == 1 and final[("b", 4)] == 4 and ("a", 7) not in final


def test_null_series_is_one_of_its_own(spark):
    rows = [(None, "2024-01-01", "error"), (None, "2024-01-03", "error"), (None, "2024-01-03", "purchase"), ("a", "2024-01-02", "error"), ("a", "2024-01-04", "error")]
    events = spark.createDataFrame(rows, "user string, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    kinds = {k: F.col("kind") == v for k, v in (("planned", "view"), ("actual", "click"), ("found", "error"), ("fixed", "purchase"))}
    daily = o.daily_counts(events, F.col("user"), kinds)
    assert {(r["series_id"], r["day"].day): r["found"] for r in daily.collect()} == {(None, 1): 1, (None, 2): 0, (None, 3): 1, ("a", 2): 1, ("a", 3): 0, ("a", 4): 1}
    table = daily.groupBy("series_id").agg(F.lit(10).alias("total_cases"), F.min("day").alias("start_date"))
    assert series.progress_pct(series.running_totals(daily), table).where("planned_pct is null").count() == 0
    assert o.fill_dates(series.time_index(daily).withColumn("i", F.col("t") - 1).withColumn("day", F.lit(None).cast("date")), table).where("day is null").count() == 0
    c = series.cumulative(daily)
    fits = fit.fit_all(c, ["exponential"])
    assert {r["series_id"] for r in fits.where("success").collect()} == {series.NO_SERIES, "a"} and curves.evaluate(fits, c).count() == c.count()


def test_fit_plan_has_no_sort_aggregate(spark):
    c = exact(spark, "exponential", [100.0, 0.08])
    for model in ("exponential", "exp_change_point", "constant_removal", "effort_exponential_weibull"):
        plan = fit.fit_profile(c, model)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "BroadcastNestedLoopJoin" in plan
