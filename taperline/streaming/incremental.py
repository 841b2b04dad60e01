"""Fits kept up to date with new days: sums over days add up, so a batch adds its own and nothing else is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import log_factorial
from ..operators.curves import MODELS, ModelSpec, bind
from ..operators.fit import _place, default_units


class IncrementalFit:
    """Likelihood fits of a model of one scale to daily counts that arrive in batches, in any order and late ones too.

    The Poisson log-likelihood of a candidate needs the sum of finds times the log of the curve's growth on their day, which is additive over finds. Each batch
    writes its own counts by day and its own sums by series and candidate under its number, over what an earlier attempt at that number left, so that a batch that is
    tried again counts once; the state is the sum of all batches, and outlives restarts. Days are numbered from ``origin`` on; candidates can't depend on the data,
    so the searched sides of the model's box are constants. ``folder`` is shared by the driver and all executors.
    """

    def __init__(self, spark: SparkSession, folder: str, model: ModelSpec | str, origin: str, units: DataFrame | None = None) -> None:
        self.spec = MODELS[model] if isinstance(model, str) else model
        s = self.spec
        if s.pair or s.corrected or s.effort is not None or s.segments or any(x.replace(".", "", 1).isdigit() is False for p in s.searched for x in s.box[p]):
            raise ValueError(f"{s.model_id}: incremental fits are of models of one scale whose other parameters have constant sides")
        self.spark, self.folder, self.origin = spark, folder.rstrip("/"), origin
        units = units if units is not None else default_units(spark, s)
        self.units = units.select("cand", *(F.expr(_place(f"u[{k}]", *(f"cast({x} as double)" for x in s.box[p]), p in s.logs)).alias(f"p_{p}") for k, p in enumerate(s.searched)))

    def _grown(self, t: str, before: str) -> str:
        at = lambda t: bind(self.spec.mean, {self.spec.scales[0]: "1.0D", "t": t} | {p: f"p_{p}" for p in self.spec.searched})
        return f"greatest({at(t)}-{at(before)},1e-12D)"

    def update(self, counts: DataFrame, number: int) -> None:
        """Adds the finds of ``counts`` (series_id, day, found; several rows for a day add up, as do later batches); a sink for foreachBatch. Days before the origin are an error."""
        days = counts.groupBy("series_id", "day").agg(F.sum("found").cast("double").alias("found")).where("day is not null")
        days = days.withColumn("t", (F.datediff("day", F.lit(self.origin).cast("date")) + 1).cast("double"))
        days = days.withColumn("t", F.when(F.col("t") < 1, F.raise_error(F.lit("a day before the origin"))).otherwise(F.col("t")))
        days.write.mode("overwrite").parquet(f"{self.folder}/days/batch={number}")
        own = self.spark.read.parquet(f"{self.folder}/days/batch={number}")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        each = own.repartition(tasks, "series_id").crossJoin(F.broadcast(self.units)).withColumn("l", F.expr(f"found*ln({self._grown('t', '(t-1)')})"))
        each.groupBy("series_id", "cand").agg(F.sum("l").alias("s_ln")).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={number}")

    def fits(self) -> DataFrame:
        """(series_id, model_id, params, loss), from the sums of all batches: what fit_profile by "mle" gives for all days from the origin to each series' last one."""
        s = self.spec
        days = self.spark.read.parquet(f"{self.folder}/days").groupBy("series_id", "t").agg(F.sum("found").alias("found"))
        known = days.groupBy(F.col("series_id").alias("_series")).agg(F.max("t").alias("n"), F.sum("found").alias("y_n"), F.sum(log_factorial(F.col("found"))).alias("fact"))
        known = known.withColumn("top", F.greatest("y_n", F.lit(1.0)))
        sums = self.spark.read.parquet(f"{self.folder}/sums").groupBy("series_id", "cand").agg(F.sum("s_ln").alias("s_ln"))
        rows = sums.join(known, sums["series_id"].eqNullSafe(known["_series"])).join(F.broadcast(self.units), "cand")
        lo, hi = (f"cast({bind(x, {'Y': 'top', 'n': 'n'})} as double)" for x in s.box[s.scales[0]])
        rows = rows.withColumn("g", F.expr(self._grown("n", "0.0D"))).withColumn("a", F.expr(f"least(greatest(y_n/g,{lo}),{hi})"))
        rows = rows.withColumn("loss", F.expr("-(y_n*ln(a)+s_ln-a*g-fact)"))
        order = F.col("loss") + F.abs("loss") * F.col("cand") * F.lit(2.0**-50) + F.col("cand") * F.lit(1e-290)
        best = rows.groupBy("series_id").agg(*(F.min_by(c, order).alias(c) for c in ("loss", "a", *(f"p_{p}" for p in s.searched))))
        return best.select("series_id", F.lit(s.model_id).alias("model_id"), F.array(*(F.col("a") if p in s.scales else F.col(f"p_{p}") for p in s.params)).alias("params"), "loss")
