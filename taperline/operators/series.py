"""Series: time index, running totals, status and starting values.

cum: (series_id, t, y, y_fixed, effort), t = 1, 2, ... in order of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_time(*keys: str):
    """Window of a series in order of t."""
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("t")


def so_far(*keys: str):
    return by_time(*keys).rowsBetween(Window.unboundedPreceding, 0)


def time_index(obs: DataFrame) -> DataFrame:
    """obs with t, the place of the day in its series from 1 (B1)."""
    return obs.withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("day")).cast("double"))


def running_totals(obs: DataFrame) -> DataFrame:
    """(series_id, day, t, cum_planned, cum_actual, cum_found, cum_fixed, remaining)."""
    sums = [F.sum(c).over(so_far()).alias(f"cum_{c}") for c in ("planned", "actual", "found", "fixed")]
    return time_index(obs).select("series_id", "day", "t", *sums).withColumn("remaining", F.col("cum_found") - F.col("cum_fixed"))


#: What a null series_id is called in cum, so that it stays a series of its own in every join from there on.
NO_SERIES = "(none)"


def cumulative(obs: DataFrame) -> DataFrame:
    """cum of obs (B2); a null series_id becomes NO_SERIES."""
    return running_totals(obs).select(F.coalesce("series_id", F.lit(NO_SERIES)).alias("series_id"), "t", F.col("cum_found").alias("y"), F.col("cum_fixed").alias("y_fixed"), F.col("cum_actual").alias("effort"))


def progress_pct(totals: DataFrame, series: DataFrame) -> DataFrame:
    """totals with planned_pct and actual_pct of the planned number of cases; null where that isn't over 0."""
    pct = lambda c: F.when(F.col("total_cases") > 0, 100 * F.col(c) / F.col("total_cases"))
    cases = series.select(F.col("series_id").alias("_series"), "total_cases")
    return totals.join(cases, totals["series_id"].eqNullSafe(cases["_series"]), "left").drop("_series").withColumns({"planned_pct": pct("cum_planned"), "actual_pct": pct("cum_actual")})


def current_status(totals: DataFrame) -> DataFrame:
    """Each series' last row."""
    rest = [c for c in totals.columns if c != "series_id"]
    return totals.groupBy("series_id").agg(F.max_by(F.struct(*rest), "t").alias("last")).select("series_id", "last.*")


def to_daily(cum: DataFrame, column: str = "y") -> DataFrame:
    """cum with dy, the increments of a running total; the first is the total itself."""
    return cum.withColumn("dy", F.col(column) - F.coalesce(F.lag(column).over(by_time()), F.lit(0.0)))


def convergence_grade(found, total):
    """ready from 99 %, beta from 95 %, converging from 90 % of the expected total found, else open; null without a total."""
    share = found / total
    return F.when(total <= 0, None).when(share >= 0.99, "ready").when(share >= 0.95, "beta").when(share >= 0.90, "converging").when(share.isNotNull(), "open")


def shape(cum: DataFrame, increment: float = 1.0, recumulate: bool = False) -> DataFrame:
    """One row per series: n, y_max, y_min, y_last, average_slope, last_increment, is_converged, day50 and e_max.

    ``recumulate`` takes running totals of the totals for day50, as older tools do.
    """
    d = to_daily(cum)
    w = d.withColumn("run", F.sum("y").over(so_far()) if recumulate else F.col("y"))
    whole = Window.partitionBy("series_id")
    w = w.withColumn("half", F.max("run").over(whole) / 2)
    return w.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.max("y").alias("y_max"),
        F.min("y").alias("y_min"),
        F.max_by("y", "t").alias("y_last"),
        F.when(F.count("*") > 1, (F.max("y") - F.min("y")) / (F.count("*") - 1)).otherwise(F.lit(0.0)).alias("average_slope"),
        F.max_by("dy", "t").alias("last_increment"),
        (F.max_by("dy", "t") <= increment).alias("is_converged"),
        F.min(F.when(F.col("run") >= F.col("half"), F.col("t"))).alias("day50"),
        F.max("effort").alias("e_max"),
    )


def day_for_ratio(cum: DataFrame, ratio: float, recumulate: bool = False) -> DataFrame:
    """(series_id, day): the first t with the ratio of the last total."""
    run = cum.withColumn("run", F.sum("y").over(so_far()) if recumulate else F.col("y"))
    aim = run.withColumn("aim", ratio * F.max("run").over(Window.partitionBy("series_id")))
    return aim.groupBy("series_id").agg(F.min(F.when(F.col("run") >= F.col("aim"), F.col("t"))).alias("day"))


def moment_starts(shapes: DataFrame, position: float = 0.5) -> DataFrame:
    """shapes with a0, b0_exp, b0_s, tau0: where a search can be centred (B11); ``position`` in the ranges, 0 to 1."""
    scale = F.when(F.col("is_converged"), 1.1 + 0.3 * position).otherwise(1.5 + 0.4 * position)
    slope = F.col("average_slope")
    bucket = lambda *v: F.when(slope <= 0.1, v[0]).when(slope <= 0.5, v[1]).when(slope <= 1, v[2]).otherwise(v[3])
    return shapes.withColumns({"a0": F.col("y_max") * scale, "b0_exp": bucket(0.05, 0.1, 0.2, 0.3), "b0_s": bucket(0.08, 0.15, 0.25, 0.35), "tau0": F.col("day50")})
