from bisect import bisect_right
from itertools import accumulate
from math import erf, exp, lgamma, log, sqrt

import pytest
from pyspark.sql import functions as F

from taperline.functions import special as s


def values(spark, rows, **exprs):
    df = spark.createDataFrame(rows, [f"x{i}" for i in range(len(rows[0]))])
    return [r.asDict() for r in df.select(*df.columns, *(e.alias(k) for k, e in exprs.items())).collect()]


def test_normal(spark):
    x = F.col("x0")
    for r in values(spark, [(v,) for v in (-8.0, -3.2, -1.0, 0.0, 0.3, 1.386, 2.9, 3.1, 6.0)], cdf=s.normal_cdf(x)):
        assert r["cdf"] == pytest.approx(0.5 * (1 + erf(r["x0"] / sqrt(2))), abs=1e-13)
    for r in values(spark, [(v,) for v in (1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], q=s.normal_quantile(x)):
        assert 0.5 * (1 + erf(r["q"] / sqrt(2))) == pytest.approx(r["x0"], rel=1e-6)


def test_chi_square_and_poisson(spark):
    rows = values(spark, [(3.841458820694124, 1), (5.991464547107979, 2), (16.918977604620448, 9), (18.307038053275146, 10), (0.0, 3)], p=s.chi2_sf(F.col("x0"), F.col("x1")))
    assert [r["p"] for r in rows] == pytest.approx([0.05] * 4 + [1.0], abs=1e-10)
    for r in values(spark, [(k, lam) for k in (-1, 0, 3, 40) for lam in (0.5, 12.0)], c=s.poisson_cdf(F.col("x0"), F.col("x1"))):
        assert r["c"] == pytest.approx(sum(exp(-r["x1"] + i * __import__("math").log(r["x1"]) - lgamma(i + 1)) for i in range(r["x0"] + 1)), abs=1e-12)


def test_log_factorial_and_quantile(spark):
    for r in values(spark, [(float(v),) for v in (0, 1, 2, 7, 20)], f=s.log_factorial(F.col("x0"))):
        assert r["f"] == pytest.approx(lgamma(r["x0"] + 1), abs=1e-12)
    (r,) = values(spark, [(0.0, 5.0)], q=s.poisson_quantile(F.lit(0.5), F.col("x1")))
    assert r["q"] == 5
    u = spark.range(4000).select(s.poisson_quantile(s.uniform(F.lit("s"), F.col("id")), F.lit(7.0)).alias("d")).agg(F.avg("d"), F.var_pop("d")).first()
    assert u[0] == pytest.approx(7, abs=0.2) and u[1] == pytest.approx(7, abs=0.6)


def test_clamp_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double").select(s.clamp(F.col("x"), 0.0, 1.0).alias("c")).collect()
    assert [r["c"] for r in rows] == [None, 1.0, 0.0]


def by_sums(lam: float) -> tuple[int, list[float]]:
    """The Poisson distribution function from a first k on, below which nothing counts."""
    first = max(0, int(lam - 12 * sqrt(lam)))
    return first, list(accumulate(exp(-lam + i * log(lam) - lgamma(i + 1)) for i in range(first, int(lam + 12 * sqrt(lam)) + 20)))


@pytest.mark.parametrize("lam", [31.0, 99.5, 100.5, 130.0, 701.0, 5000.0])
def test_poisson_of_large_means(spark, lam):
    first, sums = by_sums(lam)
    ks = sorted({max(0, int(lam + z / 4 * sqrt(lam))) for z in range(-36, 37)} | {0, 3, int(5 * lam), int(100 * lam)})
    for r in values(spark, [(float(k), lam) for k in ks], c=s.poisson_cdf(F.col("x0"), F.col("x1"))):
        k = int(r["x0"]) - first
        assert r["c"] == pytest.approx(0.0 if k < 0 else sums[min(k, len(sums) - 1)], abs=1e-10), (lam, r["x0"])
    us = [(i + 0.37) / 500 for i in range(500)] + [2.0**-32, 1e-7, 1 - 1e-7, 1 - 2.0**-32]
    for r in values(spark, [(u, lam) for u in us], q=s.poisson_quantile(F.col("x0"), F.col("x1"))):
        assert r["q"] == first + bisect_right(sums, r["x0"]), (lam, r["x0"])


def test_poisson_draws_keep_the_skew(spark):
    """Means far beyond any sum of terms: mean, variance and third moment are the law's."""
    draws = spark.range(20000).select(s.poisson_quantile(s.uniform(F.lit("t"), F.col("id")), F.lit(400.0)).alias("d"), s.poisson_quantile((F.col("id") + 0.5) / 20000, F.lit(1e9)).alias("e"))
    r = draws.agg(F.avg("d"), F.var_pop("d"), F.avg("e"), F.var_pop("e")).first()
    assert r[0] == pytest.approx(400, abs=1) and r[1] == pytest.approx(400, rel=0.05)
    assert r[2] == pytest.approx(1e9, abs=200) and r[3] == pytest.approx(1e9, rel=0.01)
    skew = spark.range(20000).select(s.poisson_quantile((F.col("id") + 0.5) / 20000, F.lit(144.0)).alias("d")).agg(F.skewness("d")).first()[0]
    assert skew == pytest.approx(1 / 12, abs=0.005)
