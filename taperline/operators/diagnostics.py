"""Residuals, their tests, and goodness of fit, one row per series and model."""

from __future__ import annotations

from math import log as ln
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import chi2_sf, normal_cdf, normal_quantile, poisson_cdf, uniform
from .curves import curve

KEY = ["series_id", "model_id"]


def in_order():
    return Window.partitionBy(*KEY).orderBy("t")


def whole():
    return Window.partitionBy(*KEY)


def expected_daily(cum: DataFrame, fits: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model_id, t, y, m, dy, lam): daily counts and m(t) - m(t before); the first day is m(t) itself."""
    rows = fits.select("series_id", "model_id", "params").join(cum.select("series_id", "t", "y"), "series_id").withColumn("m", curve("mean", models))
    first = lambda c: F.col(c) - F.coalesce(F.lag(c).over(in_order()), F.lit(0.0))
    return rows.select(*KEY, "t", "y", "m").withColumns({"dy": first("y"), "lam": first("m")})


def residuals(expected: DataFrame) -> DataFrame:
    """expected with raw, pearson, deviance, anscombe and cumulative residuals; those that divide by lam are 0 for lam <= 0."""
    y, lam = F.col("dy"), F.col("lam")
    pos = lambda v: F.when(lam > 0, v).otherwise(0.0)
    dev = F.when(y > 0, 2 * (y * F.log(y / lam) - (y - lam))).otherwise(2 * lam)
    root = lambda v, p: F.pow(F.greatest(v, F.lit(0.0)), F.lit(p))
    return expected.withColumns({
        "raw": y - lam,
        "pearson": pos((y - lam) / F.sqrt(lam)),
        "deviance": pos(F.signum(y - lam) * F.sqrt(F.greatest(dev, F.lit(0.0)))),
        "anscombe": pos(1.5 * (root(y, 2 / 3) - root(lam, 2 / 3)) / root(lam, 1 / 6)),
        "cumulative": F.col("y") - F.col("m"),
    })


def quantile_residuals(expected: DataFrame, seed: int = 1) -> DataFrame:
    """expected with low, high (Poisson distribution at dy - 1 and dy) and quantile: a normal score of a place drawn between them."""
    u = uniform(F.lit(seed), F.col("series_id"), F.col("model_id"), F.col("t").cast("int"))
    lam = F.greatest("lam", F.lit(1e-9))
    out = expected.withColumns({"low": poisson_cdf(F.col("dy") - 1, lam), "high": poisson_cdf(F.col("dy"), lam)})
    p = F.least(F.greatest(F.col("low") + u * (F.col("high") - F.col("low")), F.lit(1e-10)), F.lit(1 - 1e-10))
    return out.withColumn("quantile", normal_quantile(p))


def moments(res: DataFrame, column: str = "pearson") -> DataFrame:
    """(series_id, model_id, n, mean, sd, skew, kurt): sample sd, adjusted skewness (n >= 3) and excess kurtosis (n >= 4), 0 without spread."""
    c = res.select(*KEY, F.col(column).alias("r")).withColumn("d", F.col("r") - F.avg("r").over(whole()))
    g = c.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), *(F.avg(F.pow("d", F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)))
    n, m2 = F.col("n").cast("double"), F.col("m2")
    sd = F.when(n > 1, F.sqrt(m2 * n / (n - 1))).otherwise(0.0)
    g1, g2 = F.col("m3") / F.pow(m2, F.lit(1.5)), F.col("m4") / (m2 * m2) - 3
    skew = F.when((n >= 3) & (m2 > 1e-24), g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when((n >= 4) & (m2 > 1e-24), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).otherwise(0.0)
    return g.select(*KEY, "n", "mean", sd.alias("sd"), skew.alias("skew"), kurt.alias("kurt"))


def outliers(res: DataFrame, column: str = "pearson", limit: float = 2.0) -> DataFrame:
    """The rows with |z| over the limit, with z."""
    sd = F.stddev_samp(column).over(whole())
    return res.withColumn("z", F.when(sd > 0, (F.col(column) - F.avg(column).over(whole())) / sd)).where(F.abs("z") > limit)


def two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def runs_test(res: DataFrame, column: str = "raw") -> DataFrame:
    """(series_id, model_id, n_pos, n_neg, runs, expected_runs, z, p_value, pattern) of the signs (positive or not); p 0 if all are alike; pattern
    one_sign, clustered or alternating at p < 0.05 (J6, J7)."""
    s = res.select(*KEY, "t", (F.col(column) > 0).alias("up"))
    s = s.withColumn("turn", F.coalesce((F.col("up") != F.lag("up").over(in_order())).cast("int"), F.lit(1)))
    g = s.groupBy(*KEY).agg(F.count_if(F.col("up")).alias("n_pos"), F.count_if(~F.col("up")).alias("n_neg"), F.sum("turn").alias("runs"))
    a, b = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = a + b
    e = 1 + 2 * a * b / n
    v = F.when(n > 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1)))
    z = F.when((a > 0) & (b > 0) & (v > 0), (F.col("runs") - e) / F.sqrt(v))
    out = g.withColumns({"expected_runs": e, "z": z})
    p = F.when((a == 0) | (b == 0), 0.0).when(F.col("z").isNull(), 1.0).otherwise(two_sided(F.col("z")))
    out = out.withColumn("p_value", p)
    return out.withColumn("pattern", F.when((a == 0) | (b == 0), "one_sign").when((F.col("p_value") < 0.05) & (F.col("z") < 0), "clustered").when(F.col("p_value") < 0.05, "alternating").otherwise("none"))


def overdispersion(expected: DataFrame, k: Column | int) -> DataFrame:
    """(series_id, model_id, chi2, df, phi, p_value, over, grade) of Poisson daily counts, days with lam > 0."""
    v = F.col("lam") > 0
    g = expected.groupBy(*KEY).agg(F.sum(F.when(v, F.pow(F.col("dy") - F.col("lam"), 2) / F.col("lam"))).alias("chi2"), F.count_if(v).alias("valid"))
    g = g.withColumn("df", F.col("valid") - k)
    out = g.withColumns({"phi": F.when(F.col("df") > 0, F.col("chi2") / F.col("df")), "p_value": F.when(F.col("df") > 0, chi2_sf(F.col("chi2"), F.col("df")))})
    phi = F.col("phi")
    return out.select(*KEY, "chi2", "df", "phi", "p_value").withColumns({
        "over": (phi > 1.5) & (F.col("p_value") < 0.05),
        "grade": F.when(phi < 0.8, "under").when(phi <= 1.2, "none").when(phi <= 1.5, "slight").when(phi <= 3, "moderate").when(phi > 3, "strong"),
    })


def poisson_warnings(expected: DataFrame) -> DataFrame:
    """(series_id, model_id, warnings): under 10 days, means under 5 on over 30 % of days, more zeros than the law gives."""
    g = expected.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("lam") < 5).alias("small"), F.count_if(F.col("dy") == 0).alias("zeros"), F.sum(F.exp(-F.greatest("lam", F.lit(0.0)))).alias("e0"))
    codes = F.array(
        F.when(F.col("n") < 10, F.lit("few_days")), F.when(F.col("small") > 0.3 * F.col("n"), F.lit("small_means")), F.when((F.col("zeros") > 1.5 * F.col("e0")) & (F.col("zeros") > 3), F.lit("many_zeros"))
    )
    return g.select(*KEY, F.array_compact(codes).alias("warnings"))


def durbin_watson(res: DataFrame, column: str = "raw") -> DataFrame:
    """(series_id, model_id, dw, band); 2 for under 2 days or no spread."""
    d = res.select(*KEY, "t", F.col(column).alias("r")).withColumn("d", F.col("r") - F.lag("r").over(in_order()))
    g = d.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    g = g.select(*KEY, F.when((F.col("n") < 2) | (F.col("rr") == 0), 2.0).otherwise(F.col("dd") / F.col("rr")).alias("dw"))
    dw = F.col("dw")
    return g.withColumn("band", F.when(dw < 1, "strong_positive").when(dw < 1.5, "positive").when(dw <= 2.5, "none").when(dw <= 3, "negative").otherwise("strong_negative"))


def acf(res: DataFrame, column: str = "raw", most: int = 10) -> DataFrame:
    """(series_id, model_id, lag, r, n, significant) for lags to min(most, n / 4, n - 2), 1 at least where n allows; limits 1.96 / sqrt(n)."""
    c = res.select(*KEY, "t", F.col(column).alias("v"))
    c = c.withColumns({"d": F.col("v") - F.avg("v").over(whole()), "n": F.count("*").over(whole())})
    c = c.withColumns({f"l{k}": F.lag("d", k).over(in_order()) for k in range(1, most + 1)})
    g = c.groupBy(*KEY, "n").agg(F.sum(F.col("d") * F.col("d")).alias("c0"), *(F.sum(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, most + 1)))
    x = g.select(*KEY, "n", "c0", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("c")) for k in range(1, most + 1)))).alias("x"))
    top = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("n") / 4), F.col("n") - 2))
    r = F.when(F.col("c0") > 0, F.col("x.c") / F.col("c0")).otherwise(0.0)
    out = x.where((F.col("x.lag") <= top) & (F.col("n") > 2)).select(*KEY, F.col("x.lag").alias("lag"), r.alias("r"), "n")
    return out.withColumn("significant", F.abs("r") > 1.96 / F.sqrt("n"))


def ljung_box(acfs: DataFrame) -> DataFrame:
    """(series_id, model_id, q, df, p_value)."""
    g = acfs.groupBy(*KEY).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"), F.count("*").alias("df"))
    return g.withColumn("p_value", chi2_sf(F.col("q"), F.col("df")))


def jarque_bera(mom: DataFrame) -> DataFrame:
    """(series_id, model_id, jb, p_value) for n >= 8."""
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return mom.where("n >= 8").select(*KEY, jb.alias("jb")).withColumn("p_value", F.greatest(F.lit(1e-4), F.exp(-F.col("jb") / 2)))


def anderson_darling(res: DataFrame, column: str = "pearson") -> DataFrame:
    """(series_id, model_id, a2, p_value) of standardised values, for n >= 8 with spread."""
    sd = F.stddev_samp(column).over(whole())
    by_value = Window.partitionBy(*KEY).orderBy(column, "t")
    z = res.select(*KEY, "t", column).withColumns({"z": F.when(sd > 0, (F.col(column) - F.avg(column).over(whole())) / sd), "i": F.row_number().over(by_value), "n": F.count("*").over(whole())})
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    z = z.where("n >= 8 and z is not null").withColumn("p", clip(normal_cdf(F.col("z"))))
    # the pair of i and n + 1 - i: each value's own two weights
    term = (2 * F.col("i") - 1) * F.log("p") + (2 * (F.col("n") - F.col("i")) + 1) * F.log(1 - F.col("p"))
    g = z.groupBy(*KEY, "n").agg(F.sum(term).alias("s"))
    a2 = (-F.col("n") - F.col("s") / F.col("n")) * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    g = g.select(*KEY, a2.alias("a2"))
    a = F.col("a2")
    p = (
        F.when(a >= 10, 0.0001)
        .when(a >= 0.6, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
        .when(a >= 0.34, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .when(a >= 0.2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
    )
    return g.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def normality(res: DataFrame, column: str = "pearson") -> DataFrame:
    """(series_id, model_id, normal): neither test rejects at 0.05; null where neither applies."""
    jb, ad = jarque_bera(moments(res, column)).select(*KEY, F.col("p_value").alias("p_jb")), anderson_darling(res, column).select(*KEY, F.col("p_value").alias("p_ad"))
    return jb.join(ad, KEY, "full").select(*KEY, (F.least("p_jb", "p_ad") >= 0.05).alias("normal"))


def chi_square_gof(expected: DataFrame, k: int) -> DataFrame:
    """(series_id, model_id, chi2, bins, df, p_value) for n >= 10 days: bins of as many days, merged from the left until 5 are expected in each,
    what is left over going to the last (J15)."""
    n = F.count("*").over(whole())
    bins = F.greatest(F.lit(2), F.least(F.greatest(F.lit(5), F.ceil(1 + 3.322 * F.log(n.cast("double")) / ln(10))), F.floor(n / 5)))
    e = expected.withColumns({"n": n, "bins": bins}).where("n >= 10")
    e = e.withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col("t") - 1) * F.col("bins") / F.col("n"))))
    g = e.groupBy(*KEY, "bin").agg(F.sum("dy").alias("o"), F.sum("lam").alias("e"))
    lists = g.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("bin", "o", "e"))).alias("b"))
    start = F.struct(F.lit(0.0).alias("o"), F.lit(0.0).alias("e"), F.array().cast("array<struct<o:double,e:double>>").alias("out"))
    merge = F.aggregate(
        "b",
        start,
        lambda s, x: F.when(
            s["e"] + x["e"] >= 5, F.struct(F.lit(0.0).alias("o"), F.lit(0.0).alias("e"), F.concat(s["out"], F.array(F.struct((s["o"] + x["o"]).alias("o"), (s["e"] + x["e"]).alias("e")))).alias("out"))
        ).otherwise(F.struct((s["o"] + x["o"]).alias("o"), (s["e"] + x["e"]).alias("e"), s["out"].alias("out"))),
    )
    m = lists.withColumn("m", merge)
    size = F.size("m.out")
    final = F.transform("m.out", lambda x, i: F.when(i == size - 1, F.struct((x["o"] + F.col("m.o")).alias("o"), (x["e"] + F.col("m.e")).alias("e"))).otherwise(x))
    out = m.withColumn("f", final).where(F.size("f") > 0)
    chi2 = F.aggregate("f", F.lit(0.0), lambda s, x: s + F.pow(x["o"] - x["e"], F.lit(2.0)) / x["e"])
    out = out.select(*KEY, chi2.alias("chi2"), F.size("f").alias("bins")).withColumn("df", F.greatest(F.lit(1), F.col("bins") - 1 - k))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("df")))


#: Events that a day's row becomes at a time.
EVENTS = 1000


def event_times(expected: DataFrame) -> DataFrame:
    """(series_id, model_id, t, i, n): a day's bugs spread evenly within it, at t - 1 + (j + 0.5) / dy, with the place of each among its series' n.

    A place is the number of bugs of the days before and that within the day, so only days are ordered, and a day of many bugs becomes rows in blocks: no task
    holds a day's or a series' events.
    """
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    d = expected.withColumn("c", F.round("dy").cast("long")).where("c > 0").withColumns({"before": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(whole())})
    blocks = d.select(*KEY, F.col("t").alias("day"), "c", "before", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / EVENTS))).alias("b"))
    each = blocks.select("*", F.explode(F.sequence(F.col("b") * EVENTS, F.least("c", (F.col("b") + 1) * EVENTS) - 1)).alias("j"))
    return each.select(*KEY, (F.col("day") - 1 + (F.col("j") + 0.5) / F.col("c")).alias("t"), (F.col("before") + F.col("j") + 1).alias("i"), "n")


def transformed_times(cum: DataFrame, fits: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model_id, i, n, u): event times as shares m(t) / m(T) of the fitted total, with their places."""
    ev = event_times(expected_daily(cum, fits, models))
    end = cum.groupBy("series_id").agg(F.max("t").alias("last"))
    rows = ev.join(fits.select(*KEY, "params"), KEY).join(end, "series_id")
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), curve("mean", models) / curve("mean", models, t="last")))
    return rows.select(*KEY, "i", "n", u.alias("u"))


def ks_test(times: DataFrame) -> DataFrame:
    """(series_id, model_id, n, d, p_value); under 5 events (0, 1)."""
    i, n, u = F.col("i"), F.col("n"), F.col("u")
    g = times.groupBy(*KEY, "n").agg(F.max(F.greatest(F.abs(i / n - u), F.abs((i - 1) / n - u))).alias("d"))
    x = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    p = F.when(x < 0.27, 1.0).when(x < 1, 1 - (2 * pi) ** 0.5 / x * sum((F.exp(-((2 * k - 1) ** 2) * pi**2 / (8 * x * x)) for k in (1, 2, 3)), F.lit(0.0))).when(
        x < 3.1, 2 * sum(((-1) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in (1, 2, 3, 4)), F.lit(0.0))
    ).otherwise(0.0)
    few = F.col("n") < 5
    return g.select(*KEY, "n", F.when(few, 0.0).otherwise(F.col("d")).alias("d"), F.when(few, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).alias("p_value"))


def cvm_test(times: DataFrame) -> DataFrame:
    """(series_id, model_id, n, w2, p_value): W2 (1 + 0.5 / n), p by pieces."""
    g = times.groupBy(*KEY, "n").agg(F.sum(F.pow(F.col("u") - (2 * F.col("i") - 1) / (2 * F.col("n")), F.lit(2.0))).alias("s"))
    g = g.select(*KEY, "n", ((1 / (12 * F.col("n")) + F.col("s")) * (1 + 0.5 / F.col("n"))).alias("w2"))
    w = F.col("w2")
    p = (
        F.when(w < 0.0275, 1 - F.exp(-13.953 + 775.5 * w - 12542.6 * w * w))
        .when(w < 0.051, 1 - F.exp(-5.903 + 179.5 * w - 1515.3 * w * w))
        .when(w < 0.092, F.exp(0.886 - 31.62 * w + 10.89 * w * w))
        .otherwise(F.exp(1.111 - 34.24 * w + 12.83 * w * w))
    )
    return g.withColumn("p_value", F.when(w >= 1.1, 0.0001).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def gof_verdict(p_chi2: Column, p_ks: Column, p_cvm: Column) -> tuple[Column, Column]:
    """(adequate: two of three p-values are 0.05 or more; label by their second largest: good, acceptable, doubtful or poor)."""
    passed = sum((F.coalesce((p >= 0.05).cast("int"), F.lit(0)) for p in (p_chi2, p_ks, p_cvm)), F.lit(0))
    middle = F.get(F.sort_array(F.array(*(F.coalesce(p, F.lit(0.0)) for p in (p_chi2, p_ks, p_cvm)))), F.lit(1))
    return passed >= 2, F.when(middle >= 0.10, "good").when(middle >= 0.05, "acceptable").when(middle >= 0.01, "doubtful").otherwise("poor")


def goodness_of_fit(cum: DataFrame, fits: DataFrame, models: list[str], k: int) -> DataFrame:
    """One row per fit with the three tests and the verdict."""
    times = transformed_times(cum, fits, models)
    named = lambda d, n: d.select(*KEY, F.col("p_value").alias(n))
    out = named(ks_test(times), "p_ks").join(named(cvm_test(times), "p_cvm"), KEY, "full").join(named(chi_square_gof(expected_daily(cum, fits, models), k), "p_chi2"), KEY, "full")
    ok, label = gof_verdict(F.col("p_chi2"), F.col("p_ks"), F.col("p_cvm"))
    return out.withColumns({"adequate": ok, "label": label})


def diagnostic_score(res: DataFrame, column: str = "pearson") -> DataFrame:
    """(series_id, model_id, score, grade, codes): 100 less what patterns, outliers, skew, tails, autocorrelation and non-normality cost, all
    of the same residuals (J20)."""
    n_out = outliers(res, column).groupBy(*KEY).agg(F.count("*").alias("n_out"))
    parts = moments(res, column).join(runs_test(res, column).select(*KEY, "pattern"), KEY).join(durbin_watson(res, column).select(*KEY, "dw"), KEY).join(n_out, KEY, "left")
    parts = parts.join(ljung_box(acf(res, column)).select(*KEY, F.col("p_value").alias("p_lb")), KEY, "left").join(normality(res, column), KEY, "left")
    share = F.coalesce("n_out", F.lit(0)) / F.col("n")
    dw, lb = F.col("dw"), F.col("p_lb")
    auto = (dw < 1.5) | (dw > 2.5) | F.coalesce(lb < 0.05, F.lit(False))
    costs = {
        "pattern": F.when(F.col("pattern") != "none", 30).otherwise(0),
        "outliers": F.when(share > 0.10, 15).when(share > 0.05, 8).otherwise(0),
        "skew": F.when(F.abs("skew") > 1, 10).when(F.abs("skew") > 0.5, 5).otherwise(0),
        "tails": F.when(F.abs("kurt") > 3, 10).when(F.abs("kurt") > 1, 5).otherwise(0),
        "autocorrelation": F.when(~auto, 0).otherwise(F.when((dw < 1) | (dw > 3), 25).when((dw < 1.5) | (dw > 2.5), 15).otherwise(0) + F.when(lb < 0.01, 10).when(lb < 0.05, 5).otherwise(0)),
        "not_normal": F.when(~F.col("normal"), 10).otherwise(0),
    }
    out = parts.withColumn("score", F.greatest(F.lit(0), 100 - sum(costs.values(), F.lit(0))))
    s = F.col("score")
    grade = F.when(s >= 85, "excellent").when(s >= 70, "good").when(s >= 55, "fair").when(s >= 40, "poor").otherwise("bad")
    return out.select(*KEY, "score", grade.alias("grade"), F.array_compact(F.array(*(F.when(c > 0, F.lit(k)) for k, c in costs.items()))).alias("codes"))
