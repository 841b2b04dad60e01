"""What grows with the number of series stays bounded in a task."""

import contextlib
import io
import re

from taperline.operators import fit
from taperline.plans import formulas, registry
from test_searches import exact


def rows_of(df):
    return sorted(map(tuple, df.select("series_id", "model_id", "params", "loss").collect()))


def test_passes_of_many_models_are_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes (F1)."""
    c = exact(spark, "exponential", [100.0, 0.08])
    units = {m: fit.grid(spark, len(formulas.BOXES[m]), 2) for m in registry.MLE}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for models, loss in ((list(registry.MLE), "mle"), (registry.CATALOG, "mle"), (registry.CATALOG, "sse")):
            shown = io.StringIO()
            with contextlib.redirect_stdout(shown):
                fit.fit_all(c, models, loss, units=units).explain("codegen")
            sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())))
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_more_days_make_more_tasks(spark, monkeypatch):
    """A task holds the sums of its series by candidates (F2 to F5), and goes through one pass of a union only."""
    c = exact(spark, "exponential", [100.0, 0.08]).unionByName(exact(spark, "constant_removal", [80.0, 0.1, 0.6], 24, "r")).cache()
    models = ["exponential", "gompertz", "constant_removal", "exp_change_point"]
    few = rows_of(fit.fit_all(c, models))
    monkeypatch.setattr(fit, "PER_TASK", 1000)
    found = fit.fit_all(c, models)
    evaluations = c.count() * (400 + 400 + 400 + 600)
    assert found.rdd.getNumPartitions() >= evaluations / 1000
    for a, b in zip(few, rows_of(found)):
        assert a[:2] == b[:2] and all(abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a[2], b[2]))


def test_best_rates_are_those_of_a_scan(spark):
    """Halved places name the rate that trying all of them names (F7), also where a scale is held at a side of its box and without finds."""
    from pyspark.sql import functions as F

    from taperline.operators import changepoint

    cases = [(float(n), n * m, float(d), lo, hi) for d in (1, 3, 14, 27) for n in (0, 0.4, 1, 7, 60, 300) for m in (1.0, 1 + 0.1 * d, 1 + 0.3 * d, 0.5 * (d + 1), 0.9 * d) if 1 <= m <= d for lo, hi in ((1.0, 30.0), (1.0, 900.0), (40.0, 200.0))]
    rows = spark.createDataFrame(cases, "n double, at double, days double, lo double, hi double")
    got = changepoint._best_rate(rows, "best", "n", "at", "days", "lo", "hi", 100, spark.createDataFrame([(27,)], "n int"))
    every = changepoint.exponential_loglik("n", "at", "(0.001D+0.999D*i/100.0D)", "days", "lo", "hi")
    worst = got.select(F.max(F.abs(F.col("best") - F.expr(f"array_max(transform(sequence(1,100), i -> {every}))")) / (1 + F.abs("best")))).first()[0]
    assert got.count() == len(cases) and worst < 1e-12


def test_draws_by_table_are_the_quantiles(spark):
    """F6 to F8."""
    from pyspark.sql import functions as F

    from taperline.functions import special

    rows = spark.range(3000).select((F.col("id") % 12).alias("k"), special.uniform(F.lit("x"), F.col("id")).alias("u")).withColumn("lam", F.element_at(F.array(*map(F.lit, (-1.0, 0.0, 0.01, 0.1, 1.0, 3.5, 12.0, 40.0, 99.9, 100.0, 100.1, 250.0))), (F.col("k") + 1).cast("int")))
    rows = rows.unionByName(spark.createDataFrame([(0, u, lam) for u in (0.0, 1 - 2.0**-32) for lam in (0.01, 5.0, 100.0)], "k long, u double, lam double"))
    rows = rows.withColumn("cdf", special.poisson_table(F.col("lam"))).withColumn("q", special.poisson_quantile(F.col("u"), F.col("lam")))
    drawn = special.poisson_draws(rows).select("d", "q").collect()
    assert len(drawn) == 3006 and all(r["d"] == r["q"] for r in drawn)


def test_replicates_refitted_in_lanes_are_those_of_a_search(spark):
    """A row of several candidates finds what one row for each finds."""
    from pyspark.sql import functions as F

    from taperline.operators import uncertainty

    c = exact(spark, "exponential", [60.0, 0.1])
    for model in ("exponential", "gompertz"):
        spec = fit.MODELS[model]
        fits = fit.fit_all(c, [model])
        pseudo = uncertainty.pseudo_series_poisson(c, fits, model, 6).cache()
        theta = fits.select("series_id", F.col("params").alias("th"))
        side = lambda w, s: F.transform("th", lambda x, i: F.when(i == 0, x * s).otherwise(x * w))  # noqa: B023, E731
        stats = pseudo.join(theta, "series_id").groupBy("series_id", "rep", "th").agg(F.count("*").cast("double").alias("n"), F.lit(1.0).alias("E"), F.max_by("y", "t").alias("y_n"))
        units = fit.latin_hypercube(spark, 2, 40) if model == "gompertz" else fit.grid(spark, 1, 40)
        want = {r["rep"]: r for r in fit.fit_profile(pseudo, spec, units, by=("rep",), boxes=stats.withColumns({"lo": side(0.5, 0.0), "hi": side(1.5, 10.0)})).collect()}
        got = uncertainty.refit_replicates(pseudo, fits, model).collect()
        assert len(got) == 6
        for r in got:
            assert not r["refitted"] or all(abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in zip((r["loss"], *r["params"]), (want[r["rep"]]["loss"], *want[r["rep"]]["params"])))


def test_profiles_are_dealt_by_days_and_compiled(spark, monkeypatch):
    """days that lie by series already, as after a split, and are few bytes went through one task; a filter of the losses became the condition of the cross join."""
    from taperline.operators import changepoint, score

    c = exact(spark, "exp_change_point", [60.0, 0.15, 70.0, 0.1, 15.0]).unionByName(exact(spark, "exponential", [100.0, 0.08], 24, "r")).cache()
    train = score.split_last_n(c, 5).where("is_train").select(*c.columns)
    monkeypatch.setattr(fit, "PER_TASK", 1000)
    for model in ("exp_change_point", "delayed_s_change_point"):
        found = changepoint.profile_tau(train, model)
        assert found.rdd.getNumPartitions() >= train.count() * 256 / 1000
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            shown = io.StringIO()
            with contextlib.redirect_stdout(shown):
                changepoint.profile_tau(train, model).explain("codegen")
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert "BroadcastNestedLoopJoin" in shown.getvalue() and not re.search(r"BroadcastNestedLoopJoin \w+, \w+, ", shown.getvalue())
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue()))) < 8000


def test_a_day_without_a_count_adds_nothing_to_a_profile(spark):
    """the sums of all places pass over it."""
    from taperline.operators import changepoint

    days = lambda gap: spark.createDataFrame([("s", float(t), gap if t == 4 else float(t * t % 7 + 3 * t), 0.0, 0.0) for t in range(1, 13)], "series_id string, t double, y double, y_fixed double, effort double")
    got, want = (sorted(changepoint.profile_tau(days(gap)).select("tau", "loss", "params").collect()) for gap in (None, 0.0))
    assert len(got) == 7 and got == want
