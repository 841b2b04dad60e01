"""Change points: slope breaks, scans and profiles over their place, and a likelihood-ratio test by simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import chi2_sf, log_factorial
from ..sources.shared import stored
from .curves import MODELS, ModelSpec, bind, by_index, with_fixed_tau
from .fit import _search, _tasks, fit_profile, grid, latin_hypercube, param_bounds, series_stats
from .score import aicc
from .series import by_time
from .uncertainty import pseudo_series_poisson


def slope_breaks(cum: DataFrame, window: int = 5, threshold: float = 0.3) -> DataFrame:
    """(series_id, t, before, after, change, picked): days whose mean slopes before and after differ by more than ``threshold`` of the
    first (0.1 at least); picked from the first on, each more than ``window`` days after the last (I1)."""
    d = cum.select("series_id", "t", "y").withColumns({
        "before": (F.col("y") - F.lag("y", window).over(by_time())) / window,
        "after": (F.lead("y", window).over(by_time()) - F.col("y")) / window,
        "n": F.count("*").over(Window.partitionBy("series_id")),
    })
    c = d.withColumn("change", F.abs(F.col("after") - F.col("before")) / F.greatest(F.lit(0.1), F.abs("before"))).where((F.col("n") >= 2 * window + 1) & (F.col("change") > threshold))
    lists = c.groupBy("series_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    taken = F.aggregate("ts", F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > window), F.concat(a, F.array(x))).otherwise(a))
    return c.join(lists.select("series_id", taken.alias("taken")), "series_id").select("series_id", "t", "before", "after", "change", F.array_contains("taken", F.col("t")).alias("picked"))


#: Exponents that stand together in one running sum, so that none overflows; what lies two blocks further off is under exp(-300) of it.
_BLOCK = 300


def segment_sums(days: DataFrame, decay: tuple[str, ...], keys: list[str]) -> DataFrame:
    """days (keys, t, n, y, b) with what a pair's sums at every place tau = t are made of, by running sums over the days.

    Before tau: k, the kernel at tau, and kk, ky, the sums of its square and its product with y up to tau. After tau: y_after, the sum of y, s_k and s_kk, the kernel's
    sums over the days since tau, and s_ky, its product with y. exp(-b (t - tau)) is exp(b tau) times exp(-b t), so each is one running sum, whatever the number of places; exponents
    are summed in blocks so that they stay in range.
    """
    at = lambda d: F.expr("1-exp(-b*" + d + ")*(" + "+".join(f"({c})*power({d},{j})" if j else f"({c})" for j, c in enumerate(decay)) + ")")
    forward = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy(*keys).orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    rest_of_block = Window.partitionBy(*keys, "block").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    next_block = Window.partitionBy(*keys).orderBy("block").rangeBetween(1, 1)
    d = days.withColumns({"k": at("t"), "back": at("(n-t)"), "block": F.floor(F.col("b") * F.col("t") / _BLOCK)})
    d = d.withColumns({f"e{j}": F.expr(f"y*power(t,{j})*exp({_BLOCK}*block-b*t)") for j in range(len(decay))})
    zero = F.lit(0.0)
    d = d.withColumns({
        "kk": F.sum(F.expr("k*k")).over(forward), "ky": F.sum(F.expr("k*y")).over(forward), "y_after": F.coalesce(F.sum("y").over(later), zero), "s_k": F.sum("back").over(backward), "s_kk": F.sum(F.expr("back*back")).over(backward),
        **{f"r{j}": F.coalesce(F.sum(f"e{j}").over(rest_of_block), zero) for j in range(len(decay))}, **{f"x{j}": F.coalesce(F.sum(f"e{j}").over(next_block), zero) for j in range(len(decay))},
    })
    # the sum of y (t - tau)^j exp(-b (t - tau)) over t after tau
    moment = lambda j: f"(exp(b*t-{_BLOCK}*block)*r{j}+exp(b*t-{_BLOCK}*(block+1))*x{j})"
    parts = [f"({decay[0]})*{moment(0)}", *([f"({decay[1]})*({moment(1)}-t*{moment(0)})"] if len(decay) > 1 else [])]
    return d.withColumn("s_ky", F.expr(f"y_after-({'+'.join(parts)})")).select(*days.columns, "k", "kk", "ky", "y_after", "s_k", "s_kk", "s_ky")


#: The sums of a pair at tau = t from those of its first kernel (f) and of its second (g).
_PAIR = {"s_11": "f.kk+(n-t)*f.k*f.k", "s_12": "f.k*g.s_k", "s_22": "g.s_kk", "s_y1": "f.ky+f.k*f.y_after", "s_y2": "g.s_ky"}


def _dealt(cum: DataFrame, keys: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """Days dealt out by series to as many tasks as the session has shuffle partitions (unless they are ``dealt`` already), with n, Y as top and the sum of y * y beside them."""
    keys = keys or ["series_id"]
    w = Window.partitionBy(*keys)
    rows = cum.select(*keys, "t", "y")
    rows = rows if dealt else rows.repartition(int(cum.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return rows.withColumns({"n": F.count("*").over(w).cast("double"), "top": F.greatest(F.max("y").over(w), F.lit(1.0)), "s_yy": F.sum(F.expr("y*y")).over(w)})


def scan_tau(cum: DataFrame, fits: DataFrame, model: str) -> DataFrame:
    """(series_id, tau, sse, best): the error of a change-point model with all else given, for tau = 3 to n - 4.

    For kernels that name their decay the errors of all places come from running sums, so that each day is used once.
    """
    spec = MODELS[model]
    best = F.row_number().over(Window.partitionBy("series_id").orderBy("sse", "tau")) == 1
    given = fits.where(F.col("model_id") == model).select("series_id", "params")
    if spec.decay:
        days = _dealt(cum).join(given, "series_id")
        each = days.select("series_id", "t", "n", "y", "s_yy", "params", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("params")[spec.params.index(p)].alias("b")) for i, p in enumerate(("b1", "b2"))))).alias("x"))
        sums = segment_sums(each.select("series_id", "x.i", "t", "n", "y", "s_yy", "params", "x.b"), spec.decay, ["series_id", "i"])
        part = lambda i: F.max(F.when(F.col("i") == i, F.struct("k", "kk", "ky", "y_after", "s_k", "s_kk", "s_ky")))
        both = sums.groupBy("series_id", "t", "n", "s_yy", "params").agg(part(0).alias("f"), part(1).alias("g")).withColumns({k: F.expr(v) for k, v in _PAIR.items()})
        x, y = (f"params[{spec.params.index(p)}]" for p in ("a1", "a2"))
        out = both.where("n >= 7 and t between 3 and n - 4").select("series_id", F.col("t").alias("tau"), F.expr(f"s_yy-2*{x}*s_y1-2*{y}*s_y2+{x}*{x}*s_11+2*{x}*{y}*s_12+{y}*{y}*s_22").alias("sse"))
        return out.withColumn("best", best)
    n = cum.groupBy("series_id").agg(F.count("*").alias("n")).where("n >= 7")
    taus = n.select("series_id", F.explode(F.expr("transform(sequence(3, cast(n as int) - 4), x -> cast(x as double))")).alias("tau"))
    rows = given.join(taus, "series_id").join(cum.select("series_id", "t", "y"), "series_id")
    m = F.expr(by_index(spec, spec.mean, tau="tau"))
    return rows.groupBy("series_id", "tau").agg(F.sum(F.pow(F.col("y") - m, 2)).alias("sse")).withColumn("best", best)


def _kernel_sums(decay: tuple[str, ...]) -> str:
    """SQL, for a row of one rate b of one series (ys, its days' y in order, n and i): array<struct<p, q, r>> by place tau = 0, 1, .. n; for i = 0 the first kernel at tau, the sum of its squares over all
    days and that of its products with y, else the second kernel's sum, that of its squares and that of its products with y over the days after tau.

    Each is one pass over the days: exp(-b (t - tau)) is exp(-b) times what it is one place on, so products with y are added up from the last day backwards and nothing leaves its range.
    """
    last = lambda c: f"a[size(a)-1].{c}"
    pass_ = lambda ys, zero, **step: f"aggregate({ys}, array({zero}), (a, y) -> concat(a, array(named_struct({', '.join(f"'{c}', {last(c)}+{x}" if c[0] != 'm' else f"'{c}', {x}" for c, x in step.items())}))))"
    kernel = "ks[size(a)]"
    first = pass_("ys", "named_struct('kk', 0.0D, 'ky', 0.0D, 'past', 0.0D)", kk=f"{kernel}*{kernel}", ky=f"{kernel}*y", past="y")
    first = f"transform({first}, (x, t) -> named_struct('p', ks[t], 'q', x.kk+(n-t)*ks[t]*ks[t], 'r', x.ky+ks[t]*(s_y-x.past)))"
    moments = {"m0": f"q*({last('m0')}+y)", "m1": f"q*({last('m1')}+{last('m0')}+y)"} if len(decay) > 1 else {"m0": f"q*({last('m0')}+y)"}
    zero = f"named_struct('s_k', ks[0], 's_kk', ks[0]*ks[0], 'past', 0.0D, {', '.join(f"'{m}', 0.0D" for m in moments)})"
    second = pass_("reverse(ys)", zero, s_k=kernel, s_kk=f"{kernel}*{kernel}", past="y", **moments)
    product = "+".join(f"({c})*x.m{j}" for j, c in enumerate(decay))
    return f"case when i=0 then {first} else reverse(transform({second}, x -> named_struct('p', x.s_k, 'q', x.s_kk, 'r', x.past-({product})))) end"


def _pair_losses(d: DataFrame) -> DataFrame:
    """d with loss, a1 and a2: the least squares of a pair with scales in [lo_0, hi_0] and [lo_1, hi_1], as _solve finds it, from the sums s_11, s_12, s_22, s_y1, s_y2 and s_yy. Plain numbers in
    small steps, so that the JVM compiles what every place and candidate goes through."""
    clip = lambda x, k: f"least(greatest(coalesce({x},lo_{k}),lo_{k}),hi_{k})"
    loss = lambda x, y: F.expr(f"s_yy-2*{x}*s_y1-2*{y}*s_y2+{x}*{x}*s_11+2*{x}*{y}*s_12+{y}*{y}*s_22")
    d = d.withColumn("det", F.expr("nullif(s_11*s_22-s_12*s_12,0)"))
    d = d.withColumns({"x_0": F.expr("(s_y1*s_22-s_y2*s_12)/det"), "y_0": F.expr("(s_y2*s_11-s_y1*s_12)/det")})
    points = {1: ("lo_0", "y_1"), 2: ("hi_0", "y_2"), 3: ("x_3", "lo_1"), 4: ("x_4", "hi_1"), 0: ("x_0", "y_0")}
    d = d.withColumns({f"y_{i}": F.expr(clip(f"(s_y2-{v}*s_12)/nullif(s_22,0)", 1)) for i, v in ((1, "lo_0"), (2, "hi_0"))} | {f"x_{i}": F.expr(clip(f"(s_y1-{v}*s_12)/nullif(s_11,0)", 0)) for i, v in ((3, "lo_1"), (4, "hi_1"))})
    inside = F.expr("det>0 and x_0 between lo_0 and hi_0 and y_0 between lo_1 and hi_1")
    d = d.withColumns({f"l_{i}": F.when(inside, loss(x, y)) if i == 0 else loss(x, y) for i, (x, y) in points.items()})
    d = d.withColumn("loss", F.least(*(f"l_{i}" for i in points)))
    # of equal losses the least first scale, then the least second
    d = d.withColumn("a1", F.least(*(F.when(F.col(f"l_{i}") == F.col("loss"), F.col(x)) for i, (x, _) in points.items())))
    return d.withColumn("a2", F.least(*(F.when((F.col(f"l_{i}") == F.col("loss")) & (F.col(x) == F.col("a1")), F.col(y)) for i, (x, y) in points.items())))


def _profile_by_sums(cum: DataFrame, spec: ModelSpec, units: DataFrame, margin: int, step: int) -> DataFrame:
    """series_id, tau, n, params, loss for a pair whose kernels name their decay: one pass over a series' days for every rate, and every place combines two of them for each candidate.

    Days are stored and counted: every day meets all candidates, so their number, not their bytes, decides that of the tasks, and all steps stay where the series are.
    """
    keys = ["series_id"]
    obs = stored(cum.select(*keys, "t", "y"), "days")
    pairs = units.select("cand", F.col("u")[0].alias("u1"), F.col("u")[1].alias("u2"))
    number = F.row_number().over(Window.partitionBy("i").orderBy("u")) - 1  # candidates are few, and their number does not depend on the data
    rates = pairs.select(F.lit(0).alias("i"), F.col("u1").alias("u")).union(pairs.select(F.lit(1).alias("i"), F.col("u2").alias("u"))).distinct().withColumn("place", number)
    first, second = (rates.where(F.col("i") == i).select(F.col("u").alias(f"u{i + 1}"), F.col("place").alias(f"at{i + 1}")) for i in (0, 1))
    numbered = pairs.join(first, "u1").join(second, "u2").select("cand", "at1", "at2")
    whole = obs.repartition(_tasks(obs, obs.count(), units.count()), *keys).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.greatest(F.max("y"), F.lit(1.0)).alias("top"), F.sum("y").alias("s_y"), F.sum(F.expr("y*y")).alias("s_yy"), F.sort_array(F.collect_list(F.struct("t", F.coalesce("y", F.lit(0.0)).alias("y")))).alias("days")
    )
    whole = whole.where(F.col("n") >= 2 * margin + 1).select(*keys, "n", "top", "s_y", "s_yy", F.col("days.y").alias("ys"))
    (lo1, hi1), (lo2, hi2) = ([F.expr(bind(x, {"Y": "top", "n": "n", "E": "1.0D"})).cast("double") for x in spec.box[p]] for p in ("b1", "b2"))
    rate = F.when(F.col("i") == 0, lo1 + (hi1 - lo1) * F.col("u")).otherwise(lo2 + (hi2 - lo2) * F.col("u"))
    kernel = "1-exp(-b*d)*(" + "+".join(f"({c})*power(d,{j})" if j else f"({c})" for j, c in enumerate(spec.decay)) + ")"
    each = whole.crossJoin(F.broadcast(rates)).withColumn("b", rate).withColumns({"q": F.exp(-F.col("b")), "ks": F.expr(f"transform(sequence(0, cast(n as int)), d -> {kernel})")})
    each = each.withColumn("v", F.expr(_kernel_sums(spec.decay)))
    of = lambda i: F.sort_array(F.collect_list(F.when(F.col("i") == i, F.struct("place", "b", "v"))))
    sides = {f"{s}_{k}": F.expr(bind(x, {"Y": "top", "n": "n", "E": "1.0D"})).cast("double") for k, p in enumerate(("a1", "a2")) for s, x in zip(("lo", "hi"), spec.box[p])}
    series = each.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("n", "top", "s_yy")), of(0).alias("firsts"), of(1).alias("seconds"))
    series = series.withColumns(sides).withColumn("taus", F.expr(f"sequence({margin}, cast(n as int) - {margin}, {step})"))
    rows = series.select(*keys, "n", "s_yy", *sides, "firsts", "seconds", F.explode("taus").alias("t")).crossJoin(F.broadcast(numbered))
    rows = rows.withColumns({"one": F.get("firsts", F.col("at1")), "two": F.get("seconds", F.col("at2"))}).withColumns({"f": F.get("one.v", F.col("t")), "g": F.get("two.v", F.col("t"))})
    rows = rows.select(*keys, "t", "n", "s_yy", "cand", *sides, F.col("one.b").alias("b1"), F.col("two.b").alias("b2"), F.col("f.q").alias("s_11"), F.expr("f.p*g.p").alias("s_12"), F.col("g.q").alias("s_22"), F.col("f.r").alias("s_y1"), F.col("g.r").alias("s_y2"))
    # losses that are no numbers have no order, which min_by leaves out; a filter of them would be pushed below the cross join, all steps of the loss written out in it
    order = F.nanvl(F.col("loss") + F.abs("loss") * F.col("cand") * F.lit(2.0**-50) + F.col("cand") * F.lit(1e-290), F.lit(None).cast("double"))
    least = _pair_losses(rows).withColumn("_order", order).groupBy(*keys, "t").agg(F.max("n").alias("n"), *(F.min_by(c, "_order").alias(c) for c in ("loss", "a1", "b1", "a2", "b2"))).where("loss is not null")
    return least.select(*keys, F.col("t").cast("double").alias("tau"), "n", F.array("a1", "b1", "a2", "b2").alias("params"), "loss")


def profile_tau(cum: DataFrame, model: str = "exp_change_point", margin: int = 3, step: int = 1, units: DataFrame | None = None) -> DataFrame:
    """(series_id, model_id, tau, params, loss, n, k, aicc, best): the model refitted with each tau from margin to n - margin.

    params are those of the model with tau fixed, in its order; tau counts in k. Series under 2 * margin + 1 days have no rows. Models of two scales whose kernels name
    their decay cost days by candidates: all places come from one pass for every rate (see _kernel_sums). Others are searched for every place.
    """
    spec = with_fixed_tau(MODELS[model])
    dims = len(spec.searched)
    units = units if units is not None else (grid(cum.sparkSession, dims, 16) if dims <= 2 else latin_hypercube(cum.sparkSession, dims, 400))
    k = F.lit(spec.k + 1)
    if spec.decay:
        found = _profile_by_sums(cum, spec, units, margin, step)
        out = found.select("series_id", F.lit(model).alias("model_id"), "tau", "params", "loss", F.col("n").cast("long").alias("n"), k.alias("k"))
    else:
        n = cum.groupBy("series_id").agg(F.count("*").alias("n_days")).where(F.col("n_days") >= 2 * margin + 1)
        taus = n.select("series_id", F.explode(F.expr(f"transform(sequence({margin}, cast(n_days as int) - {margin}, {step}), x -> cast(x as double))")).alias("tau"))
        boxes = param_bounds(series_stats(cum), spec).join(taus, "series_id").select("series_id", "tau", "lo", "hi", "n", "E", "y_n", "syy", "var_y", "var_e")
        obs = stored(cum.select("series_id", "t", "y", "y_fixed", "effort").join(taus, "series_id"), "days")
        found = _search(obs, spec, boxes, units, False, ["series_id", "tau"], days=obs.count())
        out = found.select("series_id", F.lit(model).alias("model_id"), "tau", F.col("best.params").alias("params"), F.col("best.loss").alias("loss"), F.col("n").cast("long").alias("n"), k.alias("k"))
    score = F.when(F.col("loss") > 0, F.col("n") * F.log(F.col("loss") / F.col("n")) + 2 * F.col("k"))
    out = out.withColumn("aicc", aicc(score, F.col("n"), F.col("k")))
    return out.withColumn("best", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("aicc").asc_nulls_last(), "tau")) == 1)


def tau_reliability(profile: DataFrame) -> DataFrame:
    """(series_id, gap, grade): the (upper) median less the least AICc; high over 10, medium over 4, low over 2; under 3 taus n/a (I4)."""
    lists = profile.groupBy("series_id").agg(F.sort_array(F.collect_list("aicc")).alias("v"))
    gap = F.get("v", F.floor(F.size("v") / 2).cast("int")) - F.get("v", F.lit(0))
    return lists.select("series_id", F.when(F.size("v") >= 3, gap).alias("gap")).withColumn(
        "grade", F.when(F.col("gap").isNull(), "n/a").when(F.col("gap") > 10, "high").when(F.col("gap") > 4, "medium").when(F.col("gap") > 2, "low").otherwise("very_low")
    )


def fit_change_point(cum: DataFrame, model: str = "exp_change_point", profile: DataFrame | None = None) -> DataFrame:
    """(series_id, model_id, params, loss): the best tau's fit with tau among the parameters; series too short for a profile get the joint fit (I5). ``profile`` is that of profile_tau,
    if it is there already."""
    spec, fixed = MODELS[model], with_fixed_tau(MODELS[model])
    best = (profile_tau(cum, model) if profile is None else profile).where("best")
    params = F.array(*(F.col("tau") if p == "tau" else F.col("params")[fixed.params.index(p)] for p in spec.params))
    done = best.select("series_id", "model_id", params.alias("params"), "loss")
    short = cum.withColumn("_n", F.count("*").over(Window.partitionBy("series_id"))).where("_n < 7").drop("_n")
    return done.unionByName(fit_profile(short, model).select(*done.columns))


def change_point_report(cum: DataFrame, model: str = "exp_change_point", holdout: int = 5, ratios: tuple[float, ...] = (0.90, 0.95, 0.99, 0.999)) -> DataFrame:
    """One row per series: the fit with its best tau, how far that can be relied on (gap and reliability), hold-out errors of the fit without the last ``holdout`` days, milestones
    and sensitivities of the total, the largest first (I5). Series that are too short for a profile have neither gap nor, on fewer days, hold-out errors."""
    from .predict import milestones
    from .score import holdout_metrics, split_last_n
    from .uncertainty import sensitivity

    cum = stored(cum, "days")  # nine steps read them
    profile = stored(profile_tau(cum, model), "profile")
    fits = stored(fit_change_point(cum, model, profile), "change-point-fits")
    sure = tau_reliability(profile).withColumnRenamed("grade", "reliability")
    split = split_last_n(cum, holdout)
    held = holdout_metrics(split, stored(fit_change_point(split.where("is_train").select(*cum.columns), model), "held-fits"), [model])
    steps = milestones(cum, fits, [model], ratios).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ratio", "target", "already_reached", "day", "remaining_days"))).alias("milestones"))
    moves = sensitivity(cum, fits, model).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct((-F.abs("elasticity")).alias("order"), "param", "elasticity", "grade"))).alias("sensitivity"))
    tau = F.col("params")[MODELS[model].params.index("tau")]
    out = fits.select("series_id", "model_id", "params", tau.alias("tau"), "loss")
    errors = held.select("series_id", "n_test", *(F.col(c).alias(f"holdout_{c}") for c in ("mse", "mae", "mape")))
    for part in (sure, errors, steps, moves):
        out = out.join(part, "series_id", "left")
    return out


def exponential_loglik(n: str, at: str, b: str, days: str, lo: str, hi: str) -> str:
    """SQL: the greatest Poisson log-likelihood, but for the factorials, of n finds over a segment of ``days`` days under a (1 - exp(-b d)) with a in [lo, hi]; ``at`` is
    the sum of the finds' days counted from the segment's beginning, which is all that is needed of them beside their number."""
    g = f"(1-exp(-{b}*{days}))"
    a = f"least(greatest(({n})/{g},{lo}),{hi})"
    return f"(({n})*ln({a})+({n})*ln(exp({b})-1)-{b}*({at})-({a})*{g})"


def _best_rate(d: DataFrame, out: str, n: str, at: str, days: str, lo: str, hi: str, points: int, longest: DataFrame) -> DataFrame:
    """d with ``out``: the greatest exponential_loglik among rates 0.001 + 0.999 i / points, i = 1 .. points.

    With a scale that nothing holds the likelihood is n c(b) - b at and what rates don't change, c being concave, so it grows from rate to rate as long as the mean day at / n is under a
    threshold that falls with the rate: a table of thresholds by the number of days is halved (it grows with the longest series only). Where the scale of that rate is held at its upper side, the likelihood, which is
    concave in a rate up to 1 there too, is itself compared at halved places. Scales are n / (1 - exp(-b d)), so only 0 < n < lo can be held below: those rows try all rates.
    """
    rate = lambda i: f"(0.001D+0.999D*({i})/{float(points)}D)"
    d = d.withColumns({"_n": F.expr(n), "_at": F.expr(at), "_days": F.expr(days), "_lo": F.expr(lo), "_hi": F.expr(hi)})
    c = lambda i: f"(ln(exp({rate(i)})-1)-ln(1-exp(-{rate(i)}*_days)))"
    falls = longest.select(F.explode(F.expr("transform(sequence(1, n), x -> cast(x as double))")).alias("_days")).withColumn("_falls", F.expr(f"transform(sequence(2,{points}), i -> ({c('i')}-{c('i-1')})/({rate('i')}-{rate('i-1')}))"))
    d = d.join(F.broadcast(falls), "_days", "left").withColumns({"_i": F.lit(0), "_mean": F.expr("case when _n>0 then _at/_n else 0.0D end")})
    step = 1 << (points.bit_length() - 1)
    steps = []
    while step:
        d = d.withColumn("_i", F.when(F.get("_falls", F.col("_i") + (step - 1)) > F.col("_mean"), F.col("_i") + step).otherwise(F.col("_i")))
        steps.append(str(step))
        step >>= 1
    here = lambda i: exponential_loglik("_n", "_at", rate(i), "_days", "_lo", "_hi")
    held = f"aggregate(array({','.join(steps)}), 1, (i, s) -> case when i+s<={points} and {here('i+s')}>{here('i+s-1')} then i+s else i end)"
    d = d.withColumns({"_i": F.when(F.col("_n") > 0, F.col("_i") + 1).otherwise(F.lit(1))}).withColumn("_i", F.expr(f"case when _n>_hi*(1-exp(-{rate('_i')}*_days)) then {held} else _i end"))
    d = d.withColumn(out, F.expr(f"case when _n>0 and _n<_lo then array_max(transform(sequence(1,{points}), i -> {here('i')})) else {here('_i')} end"))
    return d.drop(*(x for x in d.columns if x.startswith("_")))


def poisson_lr(rows: DataFrame, keys: list[str], points: int = 100, margin: int = 3, dealt: bool = False, longest: DataFrame | None = None) -> DataFrame:
    """(keys, lr, l0, l1, tau): twice the gain in Poisson log-likelihood of an exponential curve with a change point over one without, and the best place.

    At a whole-numbered place the likelihood falls into two segments, each with a scale in closed form and a rate among ``points``; a segment needs the number of its finds and the
    sum of their days, which are running sums, and its best rate is found by halving, so a replicate costs days by the logarithm of the rates. Series under 2 * margin + 1 days have
    no rows. ``dealt``: rows are dealt out by series already, and stay where they are; ``longest`` (n): the most days of a series, if it is known.
    """
    w, so_far_ = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = _dealt(rows, keys, dealt).withColumn("dy", F.col("y") - F.coalesce(F.lag("y").over(Window.partitionBy(*keys).orderBy("t")), F.lit(0.0)))
    d = d.withColumn("at", F.sum(F.expr("dy*t")).over(so_far_)).withColumns({"y_n": F.max_by("y", "t").over(w), "at_n": F.max_by("at", "t").over(w)})
    places = d.where((F.col("n") >= 2 * margin + 1) & ((F.col("t") == F.col("n")) | ((F.col("t") >= margin) & (F.col("t") <= F.col("n") - margin))))
    if longest is None:
        longest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("n")).where("n is not null")
    # the last day stands for no change point
    places = _best_rate(places, "l_first", "y", "at", "t", "case when t=n then top else 1.0D end", "case when t=n then 5*top else 3*top end", points, longest)
    places = _best_rate(places, "l_rest", "y_n-y", "at_n-at-t*(y_n-y)", "greatest(n-t,1.0D)", "1.0D", "3*top", points, longest)
    best = places.withColumns({"l0": F.expr("case when t=n then l_first end"), "l1": F.expr("case when t<n then l_first+l_rest end")})
    out = best.groupBy(*keys).agg(F.max("l0").alias("l0"), F.max("l1").alias("l1"), F.max_by("t", F.when(F.col("l1").isNotNull(), F.struct("l1", -F.col("t")))).alias("tau"))
    return out.select(*keys, F.greatest(F.lit(0.0), 2 * (F.col("l1") - F.col("l0"))).alias("lr"), "l0", "l1", "tau").where("lr is not null")


def fit_change_points(cum: DataFrame, most: int = 3, points: int = 100, shortest: int = 2, top: float = 2.0) -> DataFrame:
    """(series_id, model_id, points, params, loss, n, k, aicc, best): exponential segments with scales and rates of their own between 1 to ``most`` change points (C12), by likelihood.

    The Poisson likelihood of daily finds is the sum of the segments', so dynamic programming over the place of the last change point finds the best of all ordered places: every
    stretch of days (``shortest`` at least) is fitted once, with its scale in [1, top * Y] in closed form and its rate among ``points``, from running sums. A series costs its days
    squared by rates, and holds its stretches in one row. loss is the negative log-likelihood, k counts scales, rates and places, and best marks the number of change points of the least AICc
    (ties: the fewest). Series of under shortest * (most + 1) days have the numbers of change points for which they are long enough.
    """
    keys, s = ["series_id"], shortest
    so_far_ = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = _dealt(cum, keys).withColumn("dy", F.col("y") - F.coalesce(F.lag("y").over(Window.partitionBy(*keys).orderBy("t")), F.lit(0.0)))
    d = d.withColumns({"at": F.sum(F.expr("dy*t")).over(so_far_), "fact": log_factorial(F.col("dy"))})
    whole = d.groupBy(*keys).agg(F.max("n").alias("n"), F.max("top").alias("top"), F.sum("fact").alias("fact"), F.array_sort(F.collect_list(F.struct("t", "y", "at"))).alias("days"))
    zero = "named_struct('t', 0.0D, 'y', 0.0D, 'at', 0.0D)"
    ends = whole.where(F.col("n") >= s).select(*keys, "n", "top", "fact", F.expr(f"concat(array({zero}), days)").alias("days"))
    ends = ends.select("*", F.explode(F.expr(f"sequence({s}, cast(n as int))")).alias("j"))
    pairs = ends.select(*keys, "n", "top", "fact", "j", F.expr("days[j]").alias("e"), F.posexplode(F.expr(f"slice(days, 1, j - {s} + 1)")).alias("i", "o"))
    plain = pairs.select(*keys, "n", "top", "fact", "i", "j", F.expr("e.t-o.t").alias("days"), F.expr("e.y-o.y").alias("found"), F.expr("e.at-o.at-o.t*(e.y-o.y)").alias("at"))
    rates = cum.sparkSession.range(1, points + 1).select((F.lit(0.001) + F.lit(0.999) * F.col("id") / float(points)).alias("b"))
    tried = plain.crossJoin(F.broadcast(rates)).withColumn("l", F.expr(exponential_loglik("found", "at", "b", "days", "1.0D", f"({top}D*top)")))
    carried = [F.max(c).alias(c) for c in ("n", "top", "fact", "days", "found")]
    one = tried.groupBy(*keys, "j", "i").agg(*carried, F.max("l").alias("l"), F.max_by("b", F.expr("l-abs(l)*b*power(2.0D,-50)")).alias("b"))
    one = one.withColumn("a", F.expr(f"least(greatest(found/(1-exp(-b*days)),1.0D),{top}D*top)"))
    table = one.groupBy(*keys).agg(*(F.max(c).cast(t).alias(c) for c, t in (("n", "int"), ("fact", "double"))), F.array_sort(F.collect_list(F.struct("j", "i", "l", "a", "b"))).alias("c"))
    at = lambda i, j: f"c[cast(({j}-{s})*({j}-{s}+1)/2+{i} as int)]"  # noqa: E731  # stretches in order of j, then i
    first = f"transform(sequence(0, n), j -> case when j >= {s} then named_struct('v', {at('0', 'j')}.l, 'path', cast(array() as array<int>)) end)"
    # of equal sums the earlier place
    step = f"array_max(transform(sequence((k - 1) * {s}, j - {s}), i -> named_struct('v', q.d[i].v + {at('i', 'j')}.l, 'less', -i)))"
    level = f"transform(sequence(0, n), j -> case when j >= k * {s} then transform(array({step}), m -> named_struct('v', m.v, 'path', concat(q.d[-m.less].path, array(-m.less))))[0] end)"
    paths = f"aggregate(sequence(2, {most + 1}), named_struct('d', {first}, 'out', cast(array() as array<struct<v: double, path: array<int>>>)), (q, k) -> transform(array({level}), x -> named_struct('d', x, 'out', concat(q.out, array(x[n]))))[0], q -> q.out)"
    # level by level: the best way to end on each day with k segments
    found = table.select(*keys, "n", "fact", "c", F.posexplode(F.expr(paths)).alias("m", "x")).where("x is not null").withColumn("points", F.col("m") + 1)
    parts = "transform(concat(x.path, array(n)), (j, r) -> transform(array(case when r = 0 then 0 else x.path[r - 1] end), i -> array(" + f"{at('i', 'j')}.a, {at('i', 'j')}.b" + ", cast(j as double)))[0])"
    flat = found.withColumn("p", F.expr(f"flatten({parts})"))
    params = F.expr("case when points = 1 then array(p[0], p[1], p[3], p[4], p[2]) else slice(p, 1, size(p) - 1) end")
    k = 3 * F.col("points") + 2
    out = flat.select(*keys, F.when(F.col("points") == 1, "exp_change_point").otherwise(F.concat(F.lit("change_points_"), F.col("points"))).alias("model_id"), "points", params.alias("params"), (F.col("fact") - F.col("x.v")).alias("loss"), F.col("n").cast("long").alias("n"), k.alias("k"))
    out = out.withColumn("aicc", aicc(2 * F.col("loss") + 2 * F.col("k"), F.col("n"), F.col("k")))
    return out.withColumn("best", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("aicc").asc_nulls_last(), "points")) == 1)


def change_point_lrt(cum: DataFrame, null_model: str = "exponential", alt_model: str = "exp_change_point", replicates: int = 500, seed: int = 1, loss: str = "mle") -> DataFrame:
    """(series_id, lr, df, chi2_p, n_reps, p_value, grade): the likelihood ratio of a model with a change point over one without.

    loss "mle": twice the gain in Poisson log-likelihood; "sse": n ln(SSE0 / SSE1). chi2_p is the chi-square law's, for reference: the place of the change is not
    identified without one. p_value is by replicates of the null model with daily means of 0.01 at least: (those as large + 1) / (replicates + 1). Exponential curves under
    "mle" are fitted at whole-numbered places by running sums (poisson_lr); other models and "sse" by candidates.
    """
    mle = loss == "mle"
    summed = mle and null_model == "exponential" and alt_model == "exp_change_point"

    def ratio(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        keys = ["series_id", *by]
        if summed:
            return poisson_lr(rows, keys, dealt=bool(by), longest=cum.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("n")).where("n is not null")).select(*keys, "lr")
        n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        few = lambda m, one, more: grid(rows.sparkSession, 1, one) if len(MODELS[m].searched) == 1 else latin_hypercube(rows.sparkSession, len(MODELS[m].searched), more)
        a = fit_profile(rows, null_model, few(null_model, 100, 150), loss, by=by).select(*keys, F.col("loss").alias("l0"))
        b = fit_profile(rows, alt_model, few(alt_model, 100, 150), loss, by=by).select(*keys, F.col("loss").alias("l1"))
        gain = 2 * (F.col("l0") - F.col("l1")) if mle else F.col("n") * F.log(F.greatest("l0", F.lit(1e-12)) / F.greatest("l1", F.lit(1e-12)))
        return n.join(a, keys).join(b, keys).select(*keys, F.greatest(F.lit(0.0), gain).alias("lr"))

    seen = ratio(cum, ())
    null = fit_profile(cum, null_model, loss=loss)
    draws = ratio(pseudo_series_poisson(cum, null, null_model, replicates, seed, 0.01), ("rep",)).withColumnRenamed("lr", "lr_rep")
    out = seen.join(draws, "series_id", "left").groupBy("series_id", "lr").agg(F.count("lr_rep").alias("n_reps"), F.count_if(F.col("lr_rep") >= F.col("lr")).alias("larger"))
    p = (F.col("larger") + 1) / (F.col("n_reps") + 1)
    df = MODELS[alt_model].k - MODELS[null_model].k
    return out.select("series_id", "lr", F.lit(df).alias("df"), chi2_sf(F.col("lr"), F.lit(df)).alias("chi2_p"), "n_reps", p.alias("p_value"), lrt_grade(p).alias("grade"))


def lrt_grade(p):
    return F.when(p < 0.01, "strong").when(p < 0.05, "significant").when(p < 0.10, "weak").otherwise("none")


__all__ = ["slope_breaks", "segment_sums", "scan_tau", "profile_tau", "tau_reliability", "fit_change_point", "fit_change_points", "change_point_report", "poisson_lr", "change_point_lrt", "lrt_grade"]
