"""Bootstrap replicates, bands, standard errors and sensitivity. Replicates are rows: a run is one more key, not one more loop."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.linear import inverse
from ..functions.special import normal_quantile, poisson_draws, poisson_table, uniform
from ..sources.shared import stored
from .curves import MODELS, ModelSpec, bind, by_index, curve
from .fit import _free, _kind, _place, _tasks, fit_profile, grid, latin_hypercube


def _daily_means(cum: DataFrame, fits: DataFrame, model: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t")
    rows = fits.where(F.col("model_id") == model).select("series_id", "model_id", "params").join(cum.select("series_id", "t", "y"), "series_id").withColumn("m", curve("mean", [model]))
    return rows.withColumn("lam", F.col("m") - F.coalesce(F.lag("m").over(w), F.lit(0.0)))


def pseudo_series_poisson(cum: DataFrame, fits: DataFrame, model: str, replicates: int, seed: int = 1, min_lambda: float = 0.0) -> DataFrame:
    """(series_id, rep, t, y, y_fixed, effort): daily Poisson draws around the fitted curve, added up (H1). Draws depend on seed, series,
    replicate and day alone, by hashes that any engine can make. A day's law is tabulated once for all replicates, and series are dealt to tasks by the number of draws."""
    days = _daily_means(cum, fits, model).select("series_id", "t", F.greatest("lam", F.lit(min_lambda)).alias("lam")).withColumn("cdf", poisson_table(F.col("lam")))
    days = stored(days, "daily-means")
    days = days.repartition(_tasks(days, days.count(), replicates * LANES), "series_id")
    reps = days.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform(F.lit(seed), F.col("series_id"), F.col("rep"), F.col("t").cast("int"))
    w = Window.partitionBy("series_id", "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    return poisson_draws(reps.withColumn("u", u)).select("series_id", "rep", "t", F.sum("d").over(w).alias("y"), zero.alias("y_fixed"), zero.alias("effort"))


def pseudo_series_residual(cum: DataFrame, fits: DataFrame, model: str, replicates: int, seed: int = 1) -> DataFrame:
    """(series_id, rep, t, y, y_fixed, effort): m(t) plus a residual drawn with replacement from the series', 0 at least (H2)."""
    base = _daily_means(cum, fits, model).select("series_id", "t", "m", (F.col("y") - F.col("m")).alias("r"))
    pool = base.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"]).alias("pool"))
    reps = base.join(pool, "series_id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform(F.lit(seed), F.col("series_id"), F.col("rep"), F.col("t").cast("int"))
    y = F.greatest(F.lit(0.0), F.col("m") + F.get("pool", F.floor(u * F.size("pool")).cast("int")))
    return reps.select("series_id", "rep", "t", y.alias("y"), F.lit(0.0).alias("y_fixed"), F.lit(0.0).alias("effort"))


def refit_replicates(pseudo: DataFrame, fits: DataFrame, model: str, n: int = 40, width: float = 0.5, worst: float = 10.0) -> DataFrame:
    """(series_id, rep, model_id, params, loss, refitted): each replicate fitted by SSE among candidates around the original parameters (H3).

    A fit of over ``worst`` times the replicate's own error under the original parameters is dropped for those. Models of one scale try LANES candidates in a row.
    """
    spec = MODELS[model]
    dims = len(spec.searched)
    if _kind(spec) == "plain":
        return _refit_in_lanes(pseudo, fits, spec, latin_hypercube(pseudo.sparkSession, dims, n) if dims > 1 else grid(pseudo.sparkSession, dims, n), width, worst)
    theta = fits.where(F.col("model_id") == model).select("series_id", F.col("params").alias("theta"))
    stats = pseudo.join(theta, "series_id").groupBy("series_id", "rep").agg(
        F.count("*").cast("double").alias("n"), F.greatest(F.max("y"), F.lit(1.0)).alias("Y"), F.lit(1.0).alias("E"), F.max_by("y", "t").alias("y_n"),
        F.sum(F.col("y") * F.col("y")).alias("syy"), F.lit(1.0).alias("var_y"), F.lit(1.0).alias("var_e"), F.first("theta").alias("theta"),
        F.sum(F.pow(F.col("y") - F.expr(by_index(spec, spec.mean, "theta")), 2)).alias("loss0"),
    )
    scale = [spec.params.index(s) for s in spec.scales]
    side = lambda s: F.transform("theta", lambda x, i: F.when(i.isin(scale), x * (0.0 if s < 0 else 10.0)).otherwise(x * (1 + s * width)))
    boxes = stats.withColumns({"lo": side(-1), "hi": side(1)})
    units = latin_hypercube(pseudo.sparkSession, dims, n) if dims > 1 else grid(pseudo.sparkSession, dims, n)
    found = fit_profile(pseudo, spec, units, by=("rep",), boxes=boxes)
    out = stats.select("series_id", "rep", "theta", "loss0").join(found, ["series_id", "rep"], "left")
    ok = F.col("loss").isNotNull() & (F.col("loss") <= worst * F.greatest("loss0", F.lit(1e-12)))
    return out.select("series_id", "rep", F.lit(model).alias("model_id"), F.when(ok, F.col("params")).otherwise(F.col("theta")).alias("params"), F.when(ok, F.col("loss")).otherwise(F.col("loss0")).alias("loss"), ok.alias("refitted"))


#: Candidates of a row when replicates are fitted again.
LANES = 4


def _refit_in_lanes(pseudo: DataFrame, fits: DataFrame, spec: ModelSpec, units: DataFrame, width: float, worst: float) -> DataFrame:
    """refit_replicates for models of one scale: a day meets LANES candidates at once, as columns, so that what a row costs is shared by them. Losses and ties are those of fit_profile;
    rows stay where they are dealt out by series."""
    free, at = _free(spec), spec.params.index
    lanes, scale = range(LANES), spec.scales[0]
    chunks = units.groupBy(F.floor(F.col("cand") / LANES).alias("chunk")).agg(*(F.max(F.when(F.col("cand") % LANES == k, F.col("u")[j])).alias(f"u_{k}_{j}") for k in lanes for j in range(len(free))))
    theta = fits.where(F.col("model_id") == spec.model_id).select("series_id", *(F.col("params")[i].alias(f"th_{i}") for i in range(spec.k)))
    rows = pseudo.select("series_id", "rep", "t", "y").join(theta, "series_id").withColumn("miss", F.expr(f"y-({bind(spec.mean, {p: f'th_{i}' for i, p in enumerate(spec.params)})})"))
    place = lambda k, j: _place(f"u_{k}_{j}", f"(th_{at(free[j])}*{1 - width}D)", f"(th_{at(free[j])}*{1 + width}D)", free[j] in spec.logs)
    placed = {f"p_{k}_{j}": F.expr(place(k, j)) for k in lanes for j in range(len(free))}
    kernels = {f"g_{k}": F.expr(bind(spec.mean, {scale: "cast(1 as double)"} | {p: f"p_{k}_{j}" for j, p in enumerate(free)})) for k in lanes}
    rows = rows.crossJoin(F.broadcast(chunks)).withColumns(placed).withColumns(kernels)
    carried = [f"th_{i}" for i in range(spec.k)] + [f"u_{k}_{j}" for k in lanes for j in range(len(free))]
    sums = {"s_yy": "y*y", "loss0": "miss*miss"} | {f"s_yg_{k}": f"y*g_{k}" for k in lanes} | {f"s_gg_{k}": f"g_{k}*g_{k}" for k in lanes}
    got = rows.groupBy("series_id", "rep", "chunk").agg(*(F.max(c).alias(c) for c in carried), *(F.sum(F.expr(x)).alias(c) for c, x in sums.items()))
    a = {f"a_{k}": F.expr(f"least(greatest(coalesce(s_yg_{k}/nullif(s_gg_{k},0),th_{at(scale)}*0.0D),th_{at(scale)}*0.0D),th_{at(scale)}*10.0D)") for k in lanes}
    got = got.withColumns(a | placed).withColumns({f"l_{k}": F.expr(f"nanvl(s_yy-2*a_{k}*s_yg_{k}+a_{k}*a_{k}*s_gg_{k},cast(null as double))") for k in lanes})
    # equal losses go to the least candidate, as in fit_profile
    cand = lambda k: F.col("chunk") * LANES + k
    order = lambda k: F.col(f"l_{k}") + F.abs(f"l_{k}") * cand(k) * F.lit(2.0**-50) + cand(k) * F.lit(1e-290)
    best = F.array_min(F.array(*(F.when(F.col(f"l_{k}").isNotNull(), F.struct(order(k).alias("o"), F.col(f"l_{k}").alias("l"), F.col(f"a_{k}").alias("a"), *(F.col(f"p_{k}_{j}").alias(f"p_{j}") for j in range(len(free))))) for k in lanes)))
    one = got.withColumn("b", best).select("series_id", "rep", "loss0", *(f"th_{i}" for i in range(spec.k)), "b.*")
    least = one.groupBy("series_id", "rep").agg(*(F.max(c).alias(c) for c in ("loss0", *(f"th_{i}" for i in range(spec.k)))), *(F.min_by(c, "o").alias(c) for c in ("l", "a", *(f"p_{j}" for j in range(len(free))))))
    ok = F.col("l").isNotNull() & (F.col("l") <= worst * F.greatest("loss0", F.lit(1e-12)))
    new, old = F.array(*(F.col("a" if p == scale else f"p_{free.index(p)}") for p in spec.params)), F.array(*(F.col(f"th_{i}") for i in range(spec.k)))
    return least.select("series_id", "rep", F.lit(spec.model_id).alias("model_id"), F.when(ok, new).otherwise(old).alias("params"), F.when(ok, F.col("l")).otherwise(F.col("loss0")).alias("loss"), ok.alias("refitted"))


def replicate_curves(refits: DataFrame, times: DataFrame, model: str) -> DataFrame:
    """(series_id, rep, t, m, refitted)."""
    rows = refits.select("series_id", "rep", "model_id", "params", "refitted").join(times.select("series_id", "t"), "series_id")
    return rows.select("series_id", "rep", "t", curve("mean", [model]).alias("m"), "refitted")


def band(samples: DataFrame, level: float = 0.95, value: str = "m") -> DataFrame:
    """(series_id, t, lower, upper, n_reps): order statistics at round((B - 1) alpha / 2) and round((B - 1)(1 - alpha / 2)), halves to even (H4); with success_rate, the share of replicates
    whose own fit was taken, where samples have refitted."""
    alpha = round(1 - level, 12)
    rate = [F.avg(F.col("refitted").cast("double")).alias("success_rate")] if "refitted" in samples.columns else []
    lists = samples.groupBy("series_id", "t").agg(F.sort_array(F.collect_list(value)).alias("v"), *rate)  # bounded by the number of replicates
    at = lambda q: F.get("v", F.bround((F.size("v") - 1) * F.lit(q)).cast("int"))
    return lists.select("series_id", "t", at(alpha / 2).alias("lower"), at(1 - alpha / 2).alias("upper"), F.size("v").alias("n_reps"), *(["success_rate"] if rate else []))


def confidence_band(cum: DataFrame, fits: DataFrame, model: str, replicates: int = 200, level: float = 0.95, seed: int = 1, residual: bool = False, times: DataFrame | None = None) -> DataFrame:
    """H1 (or H2), H3 and H4 together."""
    make = pseudo_series_residual if residual else pseudo_series_poisson
    refits = refit_replicates(make(cum, fits, model, replicates, seed), fits, model)
    return band(replicate_curves(refits, times if times is not None else cum, model), level)


def noisy(samples: DataFrame, seed: int = 1) -> DataFrame:
    """samples with y: m plus normal noise of variance max(1, m), 0 at least (Box-Muller on portable uniforms)."""
    u1, u2 = (uniform(F.lit(seed), F.lit(k), F.col("series_id"), F.col("rep"), F.col("t").cast("int")) for k in ("u1", "u2"))
    z = F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * pi * u2)
    return samples.withColumn("y", F.greatest(F.lit(0.0), F.col("m") + F.sqrt(F.greatest(F.lit(1.0), F.col("m"))) * z))


def prediction_band(cum: DataFrame, fits: DataFrame, model: str, replicates: int = 500, level: float = 0.95, seed: int = 1, times: DataFrame | None = None) -> DataFrame:
    """As confidence_band, with daily means of 0.1 at least and noise on each value (H5); times may lie in the future."""
    refits = refit_replicates(pseudo_series_poisson(cum, fits, model, replicates, seed, 0.1), fits, model)
    return band(noisy(replicate_curves(refits, times if times is not None else cum, model), seed), level, "y")


_POISSON = "(greatest(({now})-({before}),1e-10)-dy*ln(greatest(({now})-({before}),1e-10)))"
_SQUARE = "power(y-({now}),2)"


def numeric_hessian(cum: DataFrame, fits: DataFrame, model: str, kind: str = "poisson", h: float = 1e-4) -> DataFrame:
    """(series_id, i, j, value): second central differences of the daily Poisson -log likelihood (without ln y!) or of the SSE (H6)."""
    spec = MODELS[model]
    w = Window.partitionBy("series_id").orderBy("t")
    obs = cum.select("series_id", "t", "y").withColumns({"dy": F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0.0)), "t0": F.coalesce(F.lag("t").over(w), F.lit(0.0))})
    signs = [(i, j, si, sj) for i in range(spec.k) for j in range(i, spec.k) for si in (-1, 1) for sj in (-1, 1)]
    moves = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("i", "j", "si", "sj"), s))) for s in signs)))
    base = fits.where(F.col("model_id") == model).select("series_id", "params", moves.alias("v"))
    step = F.transform("params", lambda x: F.greatest(F.lit(h), F.abs(x) * h))
    base = base.withColumn("step", step).withColumn(
        "moved", F.transform("params", lambda x, k: x + F.when(k == F.col("v.i"), F.col("v.si") * F.get("step", k)).otherwise(0.0) + F.when(k == F.col("v.j"), F.col("v.sj") * F.get("step", k)).otherwise(0.0))
    )
    now, before = by_index(spec, spec.mean, "moved"), by_index(spec, spec.mean, "moved", t="t0")
    term = F.expr((_POISSON if kind == "poisson" else _SQUARE).format(now=now, before=before))
    sums = base.join(obs, "series_id").groupBy("series_id", "v.i", "v.j", "v.si", "v.sj").agg(F.sum(term).alias("f"), F.first(F.get("step", F.col("v.i"))).alias("hi"), F.first(F.get("step", F.col("v.j"))).alias("hj"))
    half = sums.groupBy("series_id", "i", "j").agg((F.sum(F.col("si") * F.col("sj") * F.col("f")) / (4 * F.first("hi") * F.first("hj"))).alias("value"))
    # on the diagonal the moves add up to two steps, so the same quotient holds; off it one row makes both cells, since a union of the table with itself would plan the fits twice
    # and, where its branches share an exchange, report a partitioning that it does not run with
    cell = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "value")
    cells = F.when(F.col("i") == F.col("j"), F.array(cell("i", "j"))).otherwise(F.array(cell("i", "j"), cell("j", "i")))
    return half.select("series_id", F.explode(cells).alias("x")).select("series_id", "x.*")


def _covariances(cum: DataFrame, fits: DataFrame, model: str, kind: str) -> DataFrame:
    """(series_id, params, covariance) of one model's fits, which are stored: the Hessian, its scale and the estimates read them, and each would search again in one task."""
    from .fit import sse

    k = MODELS[model].k
    fits = stored(fits.where(F.col("model_id") == model).select("series_id", "model_id", "params"), "fits")
    rows = numeric_hessian(cum, fits, model, kind).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda x: x["value"]).alias("h"))
    scale = sse(cum, fits, [model]).select("series_id", (2 * F.col("sse") / F.greatest(F.col("n") - k, F.lit(1))).alias("scale"))
    joined = fits.select("series_id", "params").join(rows, "series_id").join(scale, "series_id").withColumn("inv", inverse(F.col("h"), k))
    factor = F.col("scale") if kind == "sse" else F.lit(1.0)
    return joined.select("series_id", "params", F.transform("inv", lambda x: x * factor).alias("covariance"))


def param_standard_errors(cum: DataFrame, fits: DataFrame, model: str, kind: str = "poisson", level: float = 0.95) -> DataFrame:
    """(series_id, param, value, se, low, high, covariance array): from the inverse Hessian; SSE Hessians are scaled by 2 SSE / (n - k); null for
    a condition number over 1e10 (in the 1-norm) or a variance that isn't positive (H7). The k by k inverse is an expression on one row per series."""
    spec = MODELS[model]
    out = _covariances(cum, fits, model, kind).select("series_id", F.posexplode("params").alias("i", "value"), "covariance")
    var = F.get("covariance", F.col("i") * (spec.k + 1))
    z = normal_quantile(F.lit(0.5 + level / 2))
    se = F.when(var > 0, F.sqrt(var))
    names = F.array(*map(F.lit, spec.params))
    return out.select("series_id", F.get(names, F.col("i")).alias("param"), "value", se.alias("se"), (F.col("value") - z * se).alias("low"), (F.col("value") + z * se).alias("high"), "covariance")


def correlations(errors: DataFrame, model: str) -> DataFrame:
    """(series_id, a, b, correlation) of a model's parameters."""
    k, names = MODELS[model].k, MODELS[model].params
    one = errors.where(F.col("param") == names[0]).select("series_id", "covariance")
    cells = F.explode(F.array(*(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), (F.col("covariance")[i * k + j] / F.sqrt(F.col("covariance")[i * k + i] * F.col("covariance")[j * k + j])).alias("correlation")) for i in range(k) for j in range(k))))
    return one.select("series_id", cells.alias("x")).select("series_id", "x.*")


def delta_band(cum: DataFrame, fits: DataFrame, model: str, times: DataFrame | None = None, kind: str = "sse", level: float = 0.95, h: float = 1e-5) -> DataFrame:
    """(series_id, t, m, lower, upper): m plus and minus z sqrt(g' C g), C the covariance of the parameters (H8)."""
    spec = MODELS[model]
    rows = _covariances(cum, fits, model, kind).join((times if times is not None else cum).select("series_id", "t"), "series_id")
    rows = rows.withColumn("m", F.expr(by_index(spec, spec.mean)))
    grads = []
    for i, p in enumerate(spec.params):
        step = f"greatest({h},abs(params[{i}])*{h})"
        up, down = (by_index(spec, spec.mean, **{p: f"(params[{i}]{s}{step})"}) for s in "+-")
        grads.append(F.expr(f"(({up})-({down}))/(2*{step})"))
    rows = rows.withColumn("g", F.array(*grads))
    var = sum((F.col("g")[i] * F.col("g")[j] * F.col("covariance")[i * spec.k + j] for i in range(spec.k) for j in range(spec.k)), F.lit(0.0))
    half = normal_quantile(F.lit(0.5 + level / 2)) * F.sqrt(F.greatest(var, F.lit(0.0)))
    return rows.select("series_id", "t", "m", (F.col("m") - half).alias("lower"), (F.col("m") + half).alias("upper"))


def sensitivity(cum: DataFrame, fits: DataFrame, model: str, metric: str = "total", change: float = 0.01, value: str | None = None) -> DataFrame:
    """(series_id, model_id, param, metric, base, sensitivity, elasticity, grade, direction, warning) (H9).

    metric: total, m_n or m_1.5n; or any name with ``value``, SQL in the model's parameters and n, the number of days. Each parameter is moved by ``change`` both ways; a parameter of about 0 has elasticity 0, a base of about 0 no row.
    """
    spec = MODELS[model]
    n = cum.groupBy("series_id").agg(F.count("*").cast("double").alias("n"))
    rows = fits.where(F.col("model_id") == model).select("series_id", "model_id", "params").join(n, "series_id")
    sql, t = (value, "n") if value is not None else (spec.total, "n") if metric == "total" else (spec.mean, "n" if metric == "m_n" else "(1.5*n)")
    of = lambda moved: F.expr(by_index(spec, sql, moved, t=t)).cast("double")
    rows = rows.withColumn("base", of("params")).where(F.abs("base") > 1e-12).select("*", F.posexplode("params").alias("i", "theta"))
    for name, sign in (("up", 1), ("down", -1)):
        rows = rows.withColumn(f"p_{name}", F.transform("params", lambda x, k: F.when(k == F.col("i"), x * (1 + sign * change)).otherwise(x))).withColumn(name, of(f"p_{name}"))
    zero = F.abs("theta") < 1e-12
    slope = F.when(zero, 0.0).otherwise((F.col("up") - F.col("down")) / (2 * change * F.col("theta")))
    e = F.when(zero, 0.0).otherwise(slope * F.col("theta") / F.col("base"))
    size = F.abs("elasticity")
    out = rows.select("series_id", "model_id", F.get(F.array(*map(F.lit, spec.params)), F.col("i")).alias("param"), F.lit(metric).alias("metric"), "base", slope.alias("sensitivity"), e.alias("elasticity"))
    return out.withColumns(
        {
            "grade": F.when(size < 1, "low").when(size < 5, "medium").when(size < 10, "high").otherwise("very_high"),
            "direction": F.when(F.col("elasticity") > 0.1, "up").when(F.col("elasticity") < -0.1, "down").otherwise("flat"),
            "warning": F.when(size >= 10, "very_sensitive").when(size >= 5, "sensitive"),
        }
    )
