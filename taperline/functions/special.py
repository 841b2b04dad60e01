"""Special functions as SQL expressions, for Spark's expr() and, where only ANSI functions are used, any other engine."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clamp(x: Column, lo, hi) -> Column:
    """x moved into [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi))


def log_factorial(n: Column) -> Column:
    """ln n!: 0 up to 1, an exact sum to 20, Stirling's formula beyond."""
    whole = F.round(n).cast("int")
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(n <= 1, 0.0).when(whole <= 20, exact).otherwise(n * F.log(n) - n + 0.5 * F.log(2 * pi * n))


def erfc(x: Column) -> Column:
    """1 - erf(x): Taylor's series within 3, a continued fraction of 60 levels beyond."""
    return let(x.cast("double"), _erfc)


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(a.alias("term"), a.alias("sum")),
        lambda s, n: F.struct((-s["term"] * a * a / n).alias("term"), (s["sum"] - s["term"] * a * a / n / (2 * n + 1)).alias("sum")),
    )["sum"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda s, k: (k / 2.0) / (a + s))
    upper = F.when(a < 3, 1 - 2 / pi**0.5 * series).otherwise(F.exp(-a * a) / pi**0.5 / (F.greatest(a, F.lit(1.0)) + tail))
    return F.when(x < 0, 2 - upper).otherwise(upper)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / 2**0.5)


#: The coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(coefficients: tuple, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of normal_cdf on (0, 1), by a rational approximation and one Newton step."""
    return let(p.cast("double"), _normal_quantile)


def _normal_quantile(p: Column) -> Column:
    low = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.log(F.greatest(low, F.lit(1e-300))))
    tail = let(q, lambda v: _horner(_C, v) / _horner(_D, v))
    mid = let(p - 0.5, lambda d: d * _horner(_A, d * d) / _horner(_B, d * d))
    first = F.when(low < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(mid)
    return let(first, lambda x: x - F.when(F.abs(x) < 6, (normal_cdf(x) - p) * (2 * pi) ** 0.5 * F.exp(x * x / 2)).otherwise(0.0))


def chi2_sf(x: Column, df: Column) -> Column:
    """P(chi-square with a whole number df of degrees of freedom > x); df under 1: null."""
    return let(F.greatest(x, F.lit(0.0)).cast("double") / 2, lambda h: _chi2_sf(h, df))


def _chi2_sf(h: Column, df: Column) -> Column:
    n = F.floor(df / 2).cast("int")
    even = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.exp(-h).alias("term"), F.exp(-h).alias("sum")),
        lambda s, k: F.when(k < n, F.struct((s["term"] * h / k).alias("term"), (s["sum"] + s["term"] * h / k).alias("sum"))).otherwise(s),
    )["sum"]
    first = 2 * F.sqrt(h / pi) * F.exp(-h)
    odd = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, k: F.when(k <= n, F.struct((s["term"] * h / (k + 0.5)).alias("term"), (s["sum"] + s["term"]).alias("sum"))).otherwise(s),
    )["sum"]
    return F.when(df >= 1, F.least(F.lit(1.0), F.when(df % 2 == 0, even).otherwise(erfc(F.sqrt(h)) + odd)))


#: Up to this mean Poisson probabilities are added up; above it their sums are taken by the uniform expansion, whose error there is under 1e-11.
POISSON_SUMMED = 100.0


def uniform_coefficients(orders: int = 4, terms: int = 14) -> list[list[float]]:
    """Taylor coefficients of the terms of the incomplete gamma function's uniform asymptotic expansion (DLMF 8.12), by their recurrences."""
    stirling = (1.0, 1 / 12, 1 / 288, -139 / 51840)  # fixed values: of the scaled gamma function
    m = terms + 2 * orders + 2
    alpha = [0.0, 1.0]
    for i in range(2, m + 2):
        alpha.append((alpha[i - 1] - sum(j * alpha[j] * alpha[i - j + 1] for j in range(2, i))) / (i + 1))
    rows = [[-1 / 3] + [(i + 2) * alpha[i + 2] for i in range(1, m)]]
    for k in range(1, orders):
        rows.append([(-1) ** k * stirling[k] * rows[0][i] + (i + 2) * rows[-1][i + 2] for i in range(len(rows[-1]) - 2)])
    return [r[:terms] for r in rows]


_UNIFORM = uniform_coefficients()


def poisson_cdf(k: Column, lam: Column) -> Column:
    """P(Poisson(lam) <= k): a finite sum, above POISSON_SUMMED the uniform expansion; 0 for k < 0."""
    return let(F.struct(k.alias("k"), lam.alias("lam")), lambda x: _poisson_cdf(x["k"], x["lam"]))


def _poisson_cdf(k: Column, lam: Column) -> Column:
    n = F.floor(k)
    total = F.aggregate(
        F.sequence(F.lit(0), F.least(F.greatest(n, F.lit(0)), F.lit(int(4 * POISSON_SUMMED))).cast("int")),  # beyond that nothing is left to add
        F.struct(F.exp(-F.least(lam, F.lit(POISSON_SUMMED))).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * lam / (i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
    )["sum"]
    return F.when(n < 0, 0.0).when(lam > POISSON_SUMMED, _poisson_expansion(n, lam)).otherwise(F.least(F.lit(1.0), total))


def _poisson_expansion(k: Column, lam: Column) -> Column:
    a = (k + 1).cast("double")
    return let(F.struct(a.alias("a"), F.greatest((lam - a) / a, F.lit(1e-15 - 1)).alias("mu")), _gamma_expansion)


def _gamma_expansion(x: Column) -> Column:
    """The upper incomplete gamma function, regularised, of a at a * (1 + mu); where eta is beyond 2 it is 0 or 1 to all digits, as a mean over 100 makes it."""
    half = x["mu"] - F.log1p(x["mu"])
    at = F.struct(x["a"].alias("a"), half.alias("half"), (F.signum(x["mu"]) * F.sqrt(2 * F.greatest(half, F.lit(0.0)))).alias("eta"))

    def value(v: Column) -> Column:
        a, eta = v["a"], v["eta"]
        series = _horner(tuple(reversed(_UNIFORM[-1])), eta)
        for row in reversed(_UNIFORM[:-1]):
            series = series / a + _horner(tuple(reversed(row)), eta)
        near = 0.5 * erfc(eta * F.sqrt(a / 2)) + F.exp(-a * v["half"]) / F.sqrt(2 * pi * a) * series
        return F.when(eta > 2, 0.0).when(eta < -2, 1.0).otherwise(clamp(near, 0.0, 1.0))

    return let(at, value)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that any engine with md5 makes from the same parts: the first 32 bits of the hash of their texts."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_quantile(u: Column, lam: Column) -> Column:
    """The least k with P(Poisson(lam) <= k) > u, u being of 32 bits; 0 for lam <= 0. Above POISSON_SUMMED the law's expansion about the normal one
    names two neighbours, and the distribution function decides: the cost doesn't grow with the mean."""
    return let(F.struct(u.alias("u"), lam.alias("lam")), lambda x: _poisson_quantile(x["u"], x["lam"]))


def _poisson_quantile(u: Column, lam: Column) -> Column:
    low = F.greatest(F.lit(0.0), F.least(lam, F.lit(POISSON_SUMMED)))
    most = F.ceil(low + 8 * F.sqrt(low) + 10).cast("int")  # u has 32 bits
    exact = F.aggregate(
        F.sequence(F.lit(0), most),
        F.struct(F.exp(-low).alias("term"), F.exp(-low).alias("cdf"), F.lit(0).alias("k")),
        lambda s, i: F.when(s["cdf"] > u, s).otherwise(
            F.struct((s["term"] * low / (s["k"] + 1)).alias("term"), (s["cdf"] + s["term"] * low / (s["k"] + 1)).alias("cdf"), (s["k"] + 1).alias("k"))
        ),
    )["k"]
    z = normal_quantile(F.greatest(F.least(u, F.lit(1 - 1e-10)), F.lit(1e-10)))
    root = let(z, lambda v: F.floor(lam + F.sqrt(lam) * v + (v * v - 1) / 6 + (v - v * v * v) / (72 * F.sqrt(lam))))
    large = let(root, lambda k: k + F.when(_poisson_expansion(k, lam) > u, 0.0).otherwise(1.0))
    return F.when(lam <= 0, 0.0).when(lam <= POISSON_SUMMED, exact.cast("double")).otherwise(large)


def poisson_table(lam: Column) -> Column:
    """P(Poisson(lam) <= k) for k = 0, 1, ... to beyond what 32 bits tell from 1, for means up to POISSON_SUMMED: many draws of one mean look k up (see poisson_draws)."""
    low = F.greatest(F.lit(0.0), F.least(lam, F.lit(POISSON_SUMMED)))

    def table(low: Column) -> Column:
        sums = F.aggregate(
            F.sequence(F.lit(1), F.ceil(low + 8 * F.sqrt(low) + 10).cast("int")), F.struct(F.exp(-low).alias("term"), F.array(F.exp(-low)).alias("cdf")),
            lambda s, k: F.struct((s["term"] * low / k).alias("term"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["term"] * low / k)).alias("cdf")),
        )
        return sums["cdf"]

    return let(low, table)


def poisson_draws(rows: DataFrame, u: str = "u", lam: str = "lam", table: str = "cdf") -> DataFrame:
    """rows with d, what poisson_quantile gives for u and lam, by halving the table of lam instead of adding up its law for every row."""
    rows = rows.withColumn("d", F.lit(0))
    for step in (128, 64, 32, 16, 8, 4, 2, 1):  # tables have under 256 places
        rows = rows.withColumn("d", F.when(F.get(table, F.col("d") + (step - 1)) <= F.col(u), F.col("d") + step).otherwise(F.col("d")))
    return rows.withColumn("d", F.when(F.col(lam) <= 0, 0.0).when(F.col(lam) <= POISSON_SUMMED, F.col("d").cast("double")).otherwise(poisson_quantile(F.col(u), F.col(lam))))


def parameter_label(name: Column, value: Column) -> Column:
    """name = value, shares (p, eta, alpha and their like) in percent."""
    share = name.isin("p", "eta", "eta0", "eta1", "alpha")
    return F.concat(name, F.lit(" = "), F.when(share, F.concat(F.format_number(100 * value, 2), F.lit("%"))).otherwise(F.format_number(value, 4)))
