"""Daily observations of many series: reading, shaping, checking and writing them.

obs: (series_id, day, planned, actual, found, fixed); series: (series_id, total_cases, start_date). Empty tables give empty tables;
a null series_id is a series of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = ("planned", "actual", "found", "fixed")


def read_obs(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A long daily table; counts that are blank or no number are 0 (A1)."""
    return clean_counts(spark.read.options(**({"header": "true"} if fmt == "csv" else {}) | options).format(fmt).load(path))


def clean_counts(raw: DataFrame) -> DataFrame:
    counts = (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in COUNTS)
    return raw.select(F.col("series_id").cast("string").alias("series_id"), F.col("day").cast("date").alias("day"), *counts)


def unpivot_tracker(wide: DataFrame) -> DataFrame:
    """A sheet with one row per metric (date and the counts) and one column d1, d2, ... per day becomes long; days from the first
    without a date on are left out (A2)."""
    days = sorted((c for c in wide.columns if c[:1] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    long = wide.select("series_id", "metric", *(F.col(d).cast("string").alias(d) for d in days)).unpivot(["series_id", "metric"], days, "slot", "value")
    rows = long.groupBy("series_id", F.substring("slot", 2, 9).cast("int").alias("i")).pivot("metric", ["date", *COUNTS]).agg(F.first("value", True))
    w = Window.partitionBy("series_id").orderBy("i")
    open_ = rows.withColumn("gap", F.max(F.col("date").isNull()).over(w)).where("not gap")
    return clean_counts(open_.withColumnRenamed("date", "day"))


def fill_dates(obs: DataFrame, series: DataFrame) -> DataFrame:
    """A missing day becomes the series' start plus the row's place ``i`` (from 0); null without a start (A3)."""
    start = series.select(F.col("series_id").alias("_series"), "start_date")
    joined = obs.join(start, obs["series_id"].eqNullSafe(start["_series"]), "left").drop("_series")
    return joined.withColumn("day", F.coalesce("day", F.date_add("start_date", F.col("i").cast("int")))).drop("start_date")


def require_min_days(obs: DataFrame, days: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the rows of series with ``days`` days or more, the rejected series with their number of days) (A4)."""
    size = obs.groupBy("series_id").agg(F.count("*").alias("n_days"))
    short = size.where(F.col("n_days") < days)
    return obs.join(short, obs["series_id"].eqNullSafe(short["series_id"]), "left_anti"), short


def daily_counts(events: DataFrame, series: Column, kinds: dict[str, Column], ts: str = "ts", axis: str = "calendar") -> DataFrame:
    """obs from raw events: per series and day, how many events each condition of ``kinds`` holds for (A5).

    axis "calendar" keeps days without events between a series' first and last as zeros; "active" keeps days with events only.
    """
    daily = events.groupBy(series.cast("string").alias("series_id"), F.to_date(ts).alias("day")).agg(*(F.count_if(c).cast("double").alias(k) for k, c in kinds.items()))
    if axis == "active":
        return daily
    # each day fills the days up to the next one: no join with a calendar
    following = F.lead("day").over(Window.partitionBy("series_id").orderBy("day"))
    filled = daily.where("day is not null").withColumn("until", F.coalesce(F.date_sub(following, 1), F.col("day")))
    each = filled.select("series_id", *kinds, F.posexplode(F.sequence("day", "until")).alias("at", "day"))
    return each.select("series_id", "day", *(F.when(F.col("at") == 0, F.col(k)).otherwise(0.0).alias(k) for k in kinds))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A result table, in files that hold ranges of series rather than a folder for each."""
    out = df.repartitionByRange(F.col("series_id")) if "series_id" in df.columns else df
    out.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
