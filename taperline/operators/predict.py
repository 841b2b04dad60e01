"""Forecasts, milestones and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import MODELS, bind, by_index, curve

RATIOS = (0.90, 0.95, 0.99, 0.999)


def forecast(cum: DataFrame, fits: DataFrame, models: list[str], factor: float = 2.0) -> DataFrame:
    """(series_id, model_id, t, actual, m, total, remaining) for t = 1 to factor * n; actual is null beyond the data."""
    n = cum.groupBy("series_id").agg(F.count("*").alias("n"))
    times = n.select("series_id", F.explode(F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") * factor).cast("int")), lambda x: x.cast("double"))).alias("t"))
    rows = fits.select("series_id", "model_id", "params").join(times, "series_id").withColumns({"m": curve("mean", models), "total": curve("total", models)})
    actual = cum.select("series_id", "t", F.col("y").alias("actual"))
    return rows.join(actual, ["series_id", "t"], "left").select("series_id", "model_id", "t", "actual", "m", "total", (F.col("total") - F.col("m")).alias("remaining"))


def milestones(cum: DataFrame, fits: DataFrame, models: list[str], ratios: tuple[float, ...] = RATIOS, series: DataFrame | None = None, closed: bool = True) -> DataFrame:
    """(series_id, model_id, ratio, target, already_reached, day, remaining_days, date): when the curve meets ratio * total.

    Reached: the observed total is there, and day is the first such day. Else day solves m(day) = target, in closed form where there
    is one; null where the curve never gets there. date needs ``series`` with start_date.
    """
    base = cum.groupBy("series_id").agg(F.count("*").cast("double").alias("n"), F.max_by("y", "t").alias("y_n"))
    rows = fits.select("series_id", "model_id", "params").join(base, "series_id").withColumn("total", curve("total", models))
    rows = rows.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios)))).withColumn("target", F.col("ratio") * F.col("total"))
    day = None
    for m in models:
        spec = MODELS[m]
        if spec.inverse and closed:
            v = F.expr(by_index(spec, spec.inverse, target="target")).cast("double")
        else:
            v = F.expr(f"element_at(transform(array({_sql_grow(m)}), g -> {_sql_narrow(m)}), 1)")
        day = F.when(F.col("model_id") == m, v) if day is None else day.when(F.col("model_id") == m, v)
    first = cum.select("series_id", F.col("t").alias("t_seen"), F.col("y").alias("y_seen"))
    reached = rows.join(first, "series_id").where("y_seen >= target").groupBy("series_id", "model_id", "ratio").agg(F.min("t_seen").alias("seen"))
    out = rows.withColumn("solved", day).join(reached, ["series_id", "model_id", "ratio"], "left").withColumn("already_reached", F.col("y_n") >= F.col("target"))
    out = out.withColumn("day", F.when(F.col("already_reached"), F.col("seen")).when(~F.isnan("solved") & (F.abs("solved") < float("inf")), F.col("solved")))
    out = out.withColumn("remaining_days", F.when(F.col("already_reached"), 0.0).otherwise(F.col("day") - F.col("n")))
    cols = ["series_id", "model_id", "ratio", "target", "already_reached", "day", "remaining_days"]
    if series is None:
        return out.select(*cols)
    return out.join(series.select("series_id", "start_date"), "series_id", "left").select(*cols, F.expr("date_add(start_date, cast(floor(day) as int) - 1)").alias("date"))


def _sql_at(model: str, t: str) -> str:
    spec = MODELS[model]
    return bind(spec.mean, {p: f"s.p[{i}]" for i, p in enumerate(spec.params)} | {"t": t})


def _sql_grow(model: str) -> str:
    return f"""aggregate(sequence(1, 20), named_struct('p', params, 'hi', cast(least(greatest(10.0D * n, 1.0D), 10000.0D) as double), 'target', target),
      (s, i) -> case when {_sql_at(model, 's.hi')} < s.target and s.hi < 10000 then named_struct('p', s.p, 'hi', cast(least(2 * s.hi, 10000.0D) as double), 'target', s.target) else s end)"""


def _sql_narrow(model: str, steps: int = 60) -> str:
    spec = MODELS[model]
    reach = bind(spec.mean, {p: f"g.p[{i}]" for i, p in enumerate(spec.params)} | {"t": "g.hi"})
    mid = "((s.lo + s.hi) / 2)"
    return f"""case when {reach} >= g.target then aggregate(sequence(1, {steps}), named_struct('p', g.p, 'lo', 0.0D, 'hi', g.hi, 'target', g.target),
      (s, i) -> case when {_sql_at(model, mid)} < s.target then named_struct('p', s.p, 'lo', {mid}, 'hi', s.hi, 'target', s.target)
                     else named_struct('p', s.p, 'lo', s.lo, 'hi', {mid}, 'target', s.target) end, s -> {mid}) end"""


def chart_tables(totals: DataFrame, pred: DataFrame | None = None) -> DataFrame:
    """(series_id, chart, line, t, value): burn-down, bugs, remaining and combined charts, and growth where ``pred`` (m, lower, upper) is given."""
    lines = [("burn_down", c) for c in ("cum_planned", "cum_actual")] + [("bugs", c) for c in ("cum_found", "cum_fixed")] + [("remaining", "remaining")] + [("combined", c) for c in ("cum_actual", "cum_found", "cum_fixed", "remaining")]
    parts = F.explode(F.array(*(F.struct(F.lit(a).alias("chart"), F.lit(c).alias("line"), F.col(c).cast("double").alias("value")) for a, c in lines)))
    out = totals.select("series_id", "t", parts.alias("x")).select("series_id", "x.chart", "x.line", "t", "x.value")
    if pred is not None:
        have = [c for c in ("m", "lower", "upper") if c in pred.columns]
        more = F.explode(F.array(*(F.struct(F.lit("growth").alias("chart"), F.concat(F.col("model_id"), F.lit(f".{c}")).alias("line"), F.col(c).alias("value")) for c in have)))
        out = out.unionByName(pred.select("series_id", "t", more.alias("x")).select("series_id", "x.chart", "x.line", "t", "x.value"))
    return out
