"""Daily counts as a stream, for fits of each finished batch of days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_stream(events: DataFrame, series: Column, kinds: dict[str, Column], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """(series_id, day, counts...) by one-day windows; a day is final when the watermark, ``late`` behind the newest event, has passed it."""
    by_day = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), series.cast("string").alias("series_id"))
    return by_day.agg(*(F.count_if(c).cast("double").alias(k) for k, c in kinds.items())).select("series_id", F.to_date("window.start").alias("day"), *kinds)


def run_daily(events: DataFrame, series: Column, kinds: dict[str, Column], on_batch: Callable[[DataFrame, int], None], checkpoint: str, **kw) -> StreamingQuery:
    """Starts the stream over what is there now; ``on_batch`` gets each batch of final days and its number."""
    return daily_stream(events, series, kinds, **kw).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(availableNow=True).start()
