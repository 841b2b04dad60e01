"""Observation tables made from the given tables, and the same in SQL.

Series are teams of users of ``events`` (15 by default, by user_id), so their number grows with the table; planned, actual, found and fixed
count views, clicks, errors and purchases, all of them. These counts are flat. To exercise growth curves, found and fixed can be scaled by day: the count
times the shape's share on that day, rounded (fixed: 0.8 of it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import cumulative
from ..sources.observations import daily_counts

#: Scale of day t's counts.
SHAPES = {
    "flat": "1.0",
    "growth": "exp(-0.08*(t-1))",
    "sshape": "((t/6.0)*exp(1-t/6.0))",
    "change": "(case when t<=15 then exp(-0.15*(t-1)) else exp(-0.15*(t-16)) end)",
}


def obs(spark: SparkSession, sf_dir: str, shape: str = "growth", team: int = 15, axis: str = "calendar") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type")
    kinds = {k: F.col("event_type") == v for k, v in (("planned", "view"), ("actual", "click"), ("found", "error"), ("fixed", "purchase"))}
    daily = daily_counts(events, F.floor(F.col("user_id") / team), kinds, axis=axis)
    if shape == "flat":
        return daily
    share = F.expr(SHAPES[shape])
    scaled = daily.withColumn("t", (F.datediff("day", F.lit("2024-01-01").cast("date")) + 1).cast("double"))
    return scaled.withColumns({"found": F.round(F.col("found") * share), "fixed": F.round(0.8 * F.col("fixed") * share)}).drop("t")


def cum(spark: SparkSession, sf_dir: str, shape: str = "growth", team: int = 15) -> DataFrame:
    return cumulative(obs(spark, sf_dir, shape, team))


def series_table(observations: DataFrame) -> DataFrame:
    """A series table for the observations: twice the planned cases as total, the first day as start."""
    return observations.groupBy("series_id").agg((2 * F.sum("planned")).cast("int").alias("total_cases"), F.min("day").alias("start_date"))


def base_sql(shape: str = "growth", team: int = 15) -> str:
    """CTEs ev, daily, obs, idx, totals, cum, series."""
    found, fixed = ("found", "fixed") if shape == "flat" else (f"round(found * {SHAPES[shape]})", f"round(0.8 * fixed * {SHAPES[shape]})")
    return f"""
ev as (select cast(user_id // {team} as varchar) as series_id, cast(ts as date) as day, event_type from events),
counted as (
  select series_id, day, cast(date_diff('day', date '2024-01-01', day) + 1 as double) as t,
    cast(count(*) filter (where event_type = 'view') as double) as planned,
    cast(count(*) filter (where event_type = 'click') as double) as actual,
    cast(count(*) filter (where event_type = 'error') as double) as found,
    cast(count(*) filter (where event_type = 'purchase') as double) as fixed
  from ev group by 1, 2),
daily as (select series_id, day, planned, actual, {found} as found, {fixed} as fixed from counted),
spine as (select series_id, cast(unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day)) as date) as day from daily group by 1),
obs as (
  select s.series_id, s.day, coalesce(planned, 0) as planned, coalesce(actual, 0) as actual, coalesce(found, 0) as found, coalesce(fixed, 0) as fixed
  from spine s left join daily d on s.series_id = d.series_id and s.day = d.day),
idx as (select *, cast(row_number() over (partition by series_id order by day) as double) as t from obs),
totals as (
  select series_id, day, t, sum(planned) over w as cum_planned, sum(actual) over w as cum_actual, sum(found) over w as cum_found, sum(fixed) over w as cum_fixed,
    sum(found) over w - sum(fixed) over w as remaining
  from idx window w as (partition by series_id order by t rows unbounded preceding)),
cum as (select series_id, t, cum_found as y, cum_fixed as y_fixed, cum_actual as effort from totals),
series as (select series_id, cast(2 * sum(planned) as integer) as total_cases, min(day) as start_date from obs group by 1),
stats as (
  select series_id, cast(count(*) as double) as n, greatest(max(y), 1.0) as "Y", greatest(max(effort), 1.0) as "E", arg_max(y, t) as y_n, sum(y * y) as syy, var_pop(y) as var_y, var_pop(effort) as var_e
  from cum group by 1)"""
