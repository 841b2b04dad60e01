"""Scores, selection, hold-out validation, model averaging and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .curves import MODELS, curve
from .fit import gaussian_loglik, joint_loglik, sse, sse_joint_effort, sse_joint_removal


def by_series():
    return Window.partitionBy("series_id")


def r2(sse_: Column, sst: Column) -> Column:
    """1 - SSE / SST; 0 where SST is 0 (F1)."""
    return F.when(sst > 0, 1 - sse_ / sst).otherwise(0.0)


def aic(n: Column, k: Column, sse_: Column, loglik: Column | None = None) -> Column:
    """n ln(SSE / n) + 2 k, or 2 k - 2 ln L where a likelihood is given; null where it can't be had."""
    by_sse = F.when(sse_ > 0, n * F.log(sse_ / n) + 2 * k)
    return by_sse if loglik is None else F.coalesce(2 * k - 2 * loglik, by_sse)


def aicc(aic_: Column, n: Column, k: Column) -> Column:
    """AIC + 2 k (k + 1) / (n - k - 1); null for n <= k + 1."""
    return F.when(n > k + 1, aic_ + 2 * k * (k + 1) / (n - k - 1))


def criterion(n: Column, k: Column) -> Column:
    """Invalid for n <= k + 1, AICc for n / k under 40, else AIC."""
    return F.when(n <= k + 1, "Invalid").when(n / k < 40, "AICc").otherwise("AIC")


def score_fits(cum: DataFrame, fits: DataFrame, models: list[str], loss: str = "sse") -> DataFrame:
    """fits with n, k, sse, r2, mse, aic, aicc, criterion and score (F1 to F5). Removal and effort models, whose fit is to two series, score by the
    Gaussian likelihood of both, and with loss "mle" all score by the Poisson likelihood (effort: Gaussian); family names what may be compared."""
    s = sse(cum, fits, models)
    k = F.coalesce(*(F.when(F.col("model_id") == m, F.lit(MODELS[m].k)) for m in models))
    out = fits.join(s, ["series_id", "model_id"]).withColumns({"k": k, "family": F.lit("sse")})
    removal, effort = [m for m in models if MODELS[m].corrected], [m for m in models if MODELS[m].effort]
    keys, joint = ["series_id", "model_id"], None
    if loss == "mle":
        joint = joint_loglik(cum, fits, models)
    else:
        both = lambda n, e: (gaussian_loglik(F.col("n"), F.col("sse_found")) + gaussian_loglik(F.col(n), F.col(e))).alias("loglik")
        parts = []
        if removal:
            parts.append(sse_joint_removal(cum, fits.where(F.col("model_id").isin(removal)), removal).select(*keys, both("n", "sse_fixed")))
        if effort:
            parts.append(sse_joint_effort(cum, fits.where(F.col("model_id").isin(effort)), effort).select(*keys, both("n_effort", "sse_effort")))
        joint = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    if joint is None:
        out = out.withColumn("loglik", F.lit(None).cast("double"))
    else:
        out = out.join(joint, keys, "left").withColumn("family", F.lit("poisson") if loss == "mle" else F.when(F.col("model_id").isin(removal + effort), "joint").otherwise("sse"))
    out = out.withColumns({"r2": r2(F.col("sse"), F.col("sst")), "mse": F.col("sse") / F.col("n"), "aic": aic(F.col("n"), F.col("k"), F.col("sse"), F.col("loglik"))})
    out = out.withColumns({"aicc": aicc(F.col("aic"), F.col("n"), F.col("k")), "criterion": criterion(F.col("n"), F.col("k"))})
    return out.withColumn("score", F.when(F.col("criterion") == "AICc", F.col("aicc")).when(F.col("criterion") == "AIC", F.col("aic"))).drop("sst")


def rank_models(scored: DataFrame, within_family: bool = False) -> DataFrame:
    """The valid fits with rank 1, 2, ... by score, then model_id."""
    by = ["series_id"] + (["family"] if within_family else [])
    w = Window.partitionBy(*by).orderBy("score", "model_id")
    return scored.where("criterion != 'Invalid' and score is not null").withColumn("rank", F.row_number().over(w))


def best_model(scored: DataFrame, category: str | None = None) -> DataFrame:
    ids = [m.model_id for m in MODELS.values() if category is None or m.category == category]
    return rank_models(scored.where(F.col("model_id").isin(ids)) if category else scored).where("rank = 1")


def split_last_n(cum: DataFrame, holdout: int) -> DataFrame:
    """cum with is_train, split_valid (3 or more training days, 1 or more test days) and split_warning."""
    n = F.count("*").over(by_series())
    train = F.greatest(n - holdout, F.lit(0))
    valid = (train >= 3) & (n - train >= 1)
    warning = F.when(~valid, "invalid").when(train < 5, "very_few_training_days").when(train < 10, "few_training_days")
    return cum.withColumns({"is_train": F.col("t") <= train, "split_valid": valid, "split_warning": warning})


def split_by_ratio(cum: DataFrame, ratio: float) -> DataFrame:
    """cum with is_train for the first floor(n * ratio) days (F8)."""
    return cum.withColumn("is_train", F.col("t") <= F.floor(F.count("*").over(by_series()) * ratio))


def holdout_metrics(split: DataFrame, fits: DataFrame, models: list[str], floor: float = 1e-6) -> DataFrame:
    """(series_id, model_id, n_test, mse, mae, mape, n_skipped, mostly_skipped) on the test days; mape leaves out |y| < floor, null if all."""
    test = split.where("not is_train")
    rows = fits.select("series_id", "model_id", "params").join(test.select("series_id", "t", "y"), "series_id").withColumn("e", F.col("y") - curve("mean", models))
    tiny = F.abs("y") < floor
    out = rows.groupBy("series_id", "model_id").agg(
        F.count("*").alias("n_test"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.avg(F.when(~tiny, 100 * F.abs(F.col("e") / F.col("y")))).alias("mape"), F.count_if(tiny).alias("n_skipped")
    )
    return out.withColumn("mostly_skipped", F.col("n_skipped") > 0.5 * F.col("n_test"))


def best_by_mape(metrics: DataFrame) -> DataFrame:
    """(series_id, model_id, mape, n_poor): the least hold-out error, and how many models are over 50 %."""
    return metrics.groupBy("series_id").agg(F.min(F.when(F.col("mape").isNotNull(), F.struct("mape", "model_id"))).alias("b"), F.count_if(F.col("mape") > 50).alias("n_poor")).select(
        "series_id", "b.model_id", "b.mape", "n_poor"
    )


def aic_weights(scored: DataFrame) -> DataFrame:
    """(series_id, model_id, delta, weight) over the valid fits: exp(-delta / 2), by AICc if all have it as criterion, else by AIC."""
    valid = scored.where("criterion != 'Invalid' and aic is not null")
    both = valid.withColumn("value", F.when(F.bool_and(F.col("criterion") == "AICc").over(by_series()), F.col("aicc")).otherwise(F.col("aic")))
    delta = both.withColumn("delta", F.col("value") - F.min("value").over(by_series()))
    return delta.select("series_id", "model_id", "delta", (F.exp(-F.col("delta") / 2) / F.sum(F.exp(-F.col("delta") / 2)).over(by_series())).alias("weight"))


def average_predictions(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """(series_id, t, m, sd, n_effective, best_weight): weighted mean and spread between models."""
    j = pred.join(weights.select("series_id", "model_id", "weight"), ["series_id", "model_id"])
    sums = j.groupBy("series_id", "t").agg(
        F.sum(F.col("weight") * F.col("m")).alias("m"), F.sum(F.col("weight") * F.col("m") * F.col("m")).alias("mm"), F.count_if(F.col("weight") > 0.01).alias("n_effective"), F.max("weight").alias("best_weight")
    )
    return sums.select("series_id", "t", "m", F.sqrt(F.greatest(F.lit(0.0), F.col("mm") - F.col("m") * F.col("m"))).alias("sd"), "n_effective", "best_weight")


def average_milestones(milestones: DataFrame, weights: DataFrame) -> DataFrame:
    """(series_id, ratio, day, sd, low, high, n_models): weighted over the models that reach a milestone, weights scaled to 1."""
    j = milestones.where("day is not null").join(weights.select("series_id", "model_id", "weight"), ["series_id", "model_id"])
    w = F.col("weight")
    out = j.groupBy("series_id", "ratio").agg((F.sum(w * F.col("day")) / F.sum(w)).alias("day"), (F.sum(w * F.col("day") * F.col("day")) / F.sum(w)).alias("dd"), F.count("*").alias("n_models"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("dd") - F.col("day") * F.col("day")))
    return out.select("series_id", "ratio", "day", sd.alias("sd"), (F.col("day") - sd).alias("low"), (F.col("day") + sd).alias("high"), "n_models")


def warnings(scored: DataFrame, metrics: DataFrame | None = None, bugs: DataFrame | None = None) -> DataFrame:
    """(series_id, model_id, warnings array): few days (under 7; under 3 k), few bugs (under 20; ``bugs`` has series_id, y_last), hold-out errors
    over 100 or 50 %, well over the mean, or over the best model's, and r2 under 0.9 (F14, D8)."""
    rows = scored.select("series_id", "model_id", "n", "k", "r2")
    rows = rows.join(bugs.select("series_id", "y_last"), "series_id", "left") if bugs is not None else rows.withColumn("y_last", F.lit(None).cast("double"))
    rows = rows.join(metrics.select("series_id", "model_id", "mape"), ["series_id", "model_id"], "left") if metrics is not None else rows.withColumn("mape", F.lit(None).cast("double"))
    mean, least = F.avg("mape").over(by_series()), F.min("mape").over(by_series())
    code = lambda cond, name: F.when(cond, F.lit(name))
    every = F.array(
        code(F.col("n") < 7, "few_days"),
        code(F.col("n") < 3 * F.col("k"), "few_days_for_parameters"),
        code(F.col("y_last") < 20, "few_bugs"),
        F.when(F.col("mape") > 100, "error_over_100").when(F.col("mape") > 50, "error_over_50"),
        code((F.col("mape") > 1.5 * mean) & (F.col("mape") > 2 * least), "error_over_average"),
        code(F.col("mape") > 1.3 * least, "error_over_best"),
        code(F.col("r2") < 0.9, "low_r2"),
    )
    return rows.select("series_id", "model_id", F.array_distinct(F.array_compact(every)).alias("warnings"))


def comparison_table(scored: DataFrame, milestones: DataFrame, metrics: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model_id, r2, mse, aic, total, p, holdout_mse, holdout_mape, loss, day95, day99) (F16)."""
    days = milestones.groupBy("series_id", "model_id").agg(*(F.max(F.when(F.abs(F.col("ratio") - r) < 1e-9, F.col("day"))).alias(c) for r, c in ((0.95, "day95"), (0.99, "day99"))))
    p = F.coalesce(*(F.when(F.col("model_id") == m, F.element_at("params", MODELS[m].params.index("p") + 1)) for m in models if "p" in MODELS[m].params), F.lit(None).cast("double"))
    held = metrics.select("series_id", "model_id", F.col("mse").alias("holdout_mse"), F.col("mape").alias("holdout_mape"))
    out = scored.withColumns({"total": curve("total", models), "p": p}).join(held, ["series_id", "model_id"], "left").join(days, ["series_id", "model_id"], "left")
    return out.select("series_id", "model_id", "r2", "mse", "aic", "total", "p", "holdout_mse", "holdout_mape", "loss", "day95", "day99")


def status_report(status: DataFrame, best: DataFrame, milestones: DataFrame, notes: DataFrame, models: list[str], sensitivity: DataFrame | None = None, profile: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """One row per series: status, best model with parameters and scores, grade, milestones, warnings, sensitivities, the five best change points and, from hold-out ``metrics``, the
    errors of every model, the least first, the best model by them and how many are over 50 % (F15)."""
    from .series import convergence_grade

    one = best.withColumn("total", curve("total", models)).select("series_id", "model_id", "params", "r2", "mse", "aic", "total")
    steps = milestones.groupBy("series_id", "model_id").agg(F.array_sort(F.collect_list(F.struct("ratio", "day", "already_reached"))).alias("milestones"))
    out = status.join(one, "series_id", "left").join(steps, ["series_id", "model_id"], "left").join(notes, ["series_id", "model_id"], "left")
    out = out.withColumn("grade", convergence_grade(F.col("cum_found"), F.col("total")))
    high_p = F.coalesce(*(F.when(F.col("model_id") == m, F.element_at("params", MODELS[m].params.index("p") + 1) > 0.1) for m in models if "p" in MODELS[m].params), F.lit(False))
    out = out.withColumn("imperfect_debugging", high_p)
    if sensitivity is not None:
        s = sensitivity.groupBy("series_id", "model_id").agg(F.array_sort(F.collect_list(F.struct((-F.abs("elasticity")).alias("order"), "param", "elasticity"))).alias("sensitivity"))
        out = out.join(s, ["series_id", "model_id"], "left")
    if metrics is not None:
        errors = metrics.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("mape", F.lit(float("inf"))).alias("order"), "model_id", "mape", "mse", "mae", "n_test"))).alias("holdout"))
        best_held = best_by_mape(metrics).select("series_id", F.col("model_id").alias("holdout_best"), F.col("mape").alias("holdout_best_mape"), F.col("n_poor").alias("holdout_n_poor"))
        out = out.join(errors, "series_id", "left").join(best_held, "series_id", "left")
    if profile is not None:
        w = Window.partitionBy("series_id").orderBy("aicc", "tau")
        top = profile.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("aicc", "tau"))).alias("change_points"))
        out = out.join(top, "series_id", "left")
    return out
