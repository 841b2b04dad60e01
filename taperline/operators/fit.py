"""Fits as searches over candidate tables.

Linear parameters are solved from sums for every candidate of the others, so a search is one pass: observations by broadcast candidates,
summed by series and candidate (partial sums before the shuffle), and the least loss kept. Zooming narrows each series' box around its best.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .curves import EFFORTS, MODELS, ModelSpec, bind, evaluate
from ..functions.special import log_factorial, uniform
from ..sources.shared import stored
from .series import to_daily


def series_stats(cum: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per series (or ``keys``): n, Y, E, y_n, f_n and the sums of squares of y and y_fixed, with Y and E of 1 at least, as boxes need."""
    return cum.groupBy(*(keys or ["series_id"])).agg(
        F.count("*").cast("double").alias("n"),
        F.greatest(F.max("y"), F.lit(1.0)).alias("Y"),
        F.greatest(F.max("effort"), F.lit(1.0)).alias("E"),
        F.max("effort").alias("e_max"),
        F.max_by("y", "t").alias("y_n"),
        F.max_by("y_fixed", "t").alias("f_n"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("y_fixed") * F.col("y_fixed")).alias("sff"),
        F.var_pop("y").alias("var_y"),
        F.var_pop("effort").alias("var_e"),
    )


def param_bounds(stats: DataFrame, spec: ModelSpec) -> DataFrame:
    """stats with lo and hi arrays, in the order of the model's parameters."""
    side = lambda k: F.array(*(F.expr(bind(b[k], {"Y": "Y", "E": "E", "n": "n"})).cast("double") for b in spec.box.values()))
    return stats.withColumns({"lo": side(0), "hi": F.transform(F.arrays_zip(side(0).alias("lo"), side(1).alias("hi")), lambda x: F.greatest(x["lo"], x["hi"]))})


def grid(spark: SparkSession, dims: int, per_dim: int | None = None) -> DataFrame:
    """(cand, u): all points i / g of a grid in the unit cube, i = 1 .. g; g = 20 up to 2 dimensions, 10 for 3, 8 beyond."""
    g = per_dim or (20 if dims <= 2 else 10 if dims == 3 else 8)
    n = spark.range(g**dims).withColumnRenamed("id", "cand")
    return n.select("cand", F.array(*((F.floor(F.col("cand") / g**k) % g + 1) / float(g) for k in range(dims))).alias("u"))


def latin_hypercube(spark: SparkSession, dims: int, n: int, seed: int = 1) -> DataFrame:
    """(cand, u): n points with each of n cells taken once in every dimension, placed at random in its cell."""
    from pyspark.sql.window import Window

    out = spark.range(n).withColumnRenamed("id", "cand")
    for k in range(dims):
        order = Window.partitionBy(F.lit(k)).orderBy(uniform(F.lit(seed), F.lit(k), F.col("cand")), "cand")
        out = out.withColumn(f"_u{k}", (F.row_number().over(order) - 1 + uniform(F.lit(seed), F.lit(f"j{k}"), F.col("cand"))) / float(n))
    return out.select("cand", F.array(*(f"_u{k}" for k in range(dims))).alias("u"))


def low_discrepancy(spark: SparkSession, dims: int, n: int, first: int = 1) -> DataFrame:
    """(cand, u): n points that fill the cube evenly however many are taken: multiples of the powers of 1 / phi, modulo 1, where phi ** (dims + 1) = phi + 1."""
    phi = 2.0
    for _ in range(60):
        phi = (1 + phi) ** (1 / (dims + 1))
    return spark.range(n).select(F.col("id").alias("cand"), F.array(*((F.lit(0.5) + (F.col("id") + first) * F.lit(phi ** -(k + 1) % 1)) % 1 for k in range(dims))).alias("u"))


def _place(u: str, lo: str, hi: str, log: bool) -> str:
    return f"({lo}*power({hi}/{lo},{u}))" if log else f"({lo}+({hi}-{lo})*{u})"


@dataclass(frozen=True)
class Loss:
    """A loss of one's own, for models of one scale: ``sums`` names the sums over days that decide, as SQL in t, y, dy, y_fixed, effort and the curve g (for a scale of 1) on the day and g_before on the
    day before; ``scale`` is the best scale, SQL in these sums, n, y_n (it is moved into its box); ``loss``, least at the best, is SQL in the sums, n, y_n and the scale a."""

    name: str
    sums: dict[str, str]
    scale: str
    loss: str


#: The losses that fits know by name, once more as sums.
SQUARES = Loss("squares", {"s_yg": "y*g", "s_gg": "g*g", "s_yy": "y*y"}, "s_yg/nullif(s_gg,0)", "s_yy-2*a*s_yg+a*a*s_gg")
POISSON = Loss(
    "poisson", {"s_ln": "dy*ln(greatest(g-g_before,1e-12D))", "g_n": "greatest(g-g_before,1e-12D)", "s_fact": "fact"}, "y_n/nullif(g_n,0)", "-(y_n*ln(a)+s_ln-a*g_n-s_fact)"
)

#: Rounds of the fixed point that splits the finds of the one day on which both kernels of a pair grow.
SHARES = 20


def _kind(spec: ModelSpec) -> str:
    return "pair" if spec.pair else "effort" if spec.effort is not None else "removal" if spec.corrected else "plain"


def _free(spec: ModelSpec) -> list[str]:
    """The parameters that candidates place; the others are solved from sums."""
    return [p for p in spec.searched if not (spec.effort is not None and p == "N")]


def _sums(kind: str, mle: bool | Loss, g: Callable[..., Column]) -> tuple[dict[str, Column], dict[str, str]]:
    """What a row of days by candidates adds (columns by g(curve, t), for scales of 1) and the sums of it that decide."""
    if isinstance(mle, Loss):
        return {"g": g("mean"), "g_before": g("mean", "t_prev")}, mle.sums
    step = lambda what: g(what) - g(what, "t_prev")
    if kind == "pair" and mle:
        # days on which the first kernel grows alone, the second alone, or both: one day at most, that of the change point
        rows = {"d1": F.greatest(step("first"), F.lit(0.0)), "d2": F.greatest(step("second"), F.lit(0.0))}
        alone, other, both = "d2<=0", "d1<=0 and d2>0", "d1>0 and d2>0"
        when = lambda c, x: f"case when {c} then {x} else 0.0D end"
        sums = {"g_1": "d1", "g_2": "d2", "n_1": when(alone, "dy"), "n_2": when(other, "dy"), "n_b": when(both, "dy"), "m_1": when(both, "d1"), "m_2": when(both, "d2")}
        return rows, sums | {"s_ln": f"case when {alone} then dy*ln(greatest(d1,1e-12D)) when {other} then dy*ln(greatest(d2,1e-12D)) else 0.0D end", "s_fact": "fact"}
    if kind == "pair":
        return {"g1": g("first"), "g2": g("second")}, {"s_11": "g1*g1", "s_12": "g1*g2", "s_22": "g2*g2", "s_y1": "y*g1", "s_y2": "y*g2", "s_yy": "y*y"}
    if mle:
        rows, sums = {"dg": F.greatest(step("mean"), F.lit(1e-12))}, {"s_ln": "dy*ln(dg)", "g_n": "dg", "s_fact": "fact"}
        if kind == "removal":
            rows["dc"] = F.greatest(step("corrected"), F.lit(1e-12))
            sums = {"s_ln": "dy*ln(dg)+df*ln(dc)", "g_n": "dg+dc", "s_fact": "fact+fact_fixed"}
    else:
        rows, sums = {"g": g("mean")}, {"s_yg": "y*g", "s_gg": "g*g", "s_yy": "y*y"}
        if kind == "removal":
            rows["gc"] = g("corrected")
            sums = {"s_yg": "y*g+y_fixed*gc", "s_gg": "g*g+gc*gc", "s_yy": "y*y+y_fixed*y_fixed"}
    if kind == "effort":
        rows["w"] = g("effort")
        used = lambda x: f"case when effort>0 then {x} else 0.0D end"
        sums |= {"s_ew": used("effort*w"), "s_ww": used("w*w"), "s_ee": used("effort*effort"), "n_e": used("1.0D")}
    return rows, sums


def _solve(kind: str, mle: bool | Loss, lo: list[str], hi: list[str]) -> Column:
    """struct of loss and the values x0, x1 of the scales: the constrained optimum that one candidate's sums allow. lo, hi: SQL of the scales' sides."""
    clip = lambda x, k: f"least(greatest({x},{lo[k]}),{hi[k]})"
    if isinstance(mle, Loss):
        a = clip(f"coalesce({mle.scale},{lo[0]})", 0)
        return F.expr(f"struct({bind(mle.loss, {'a': f'({a})'})} as loss, {a} as x0)")
    if kind != "pair":
        if mle:
            found = "y_n+f_n" if kind == "removal" else "y_n"
            a = clip(f"({found})/nullif(g_n,0)", 0)
            return F.expr(f"struct(-(({found})*ln({a})+s_ln-({a})*g_n-s_fact) as loss, {a} as x0)")
        a = clip(f"coalesce(s_yg/nullif(s_gg,0),{lo[0]})", 0)
        return F.expr(f"struct(s_yy-2*({a})*s_yg+({a})*({a})*s_gg as loss, {a} as x0)")
    if mle:
        # minorise and maximise: the shared day's finds are split as the scales say, and the scales follow; both are solved at once where no day is shared
        part = lambda own, x, k: f"{clip(f'coalesce((n_{k + 1}+n_b*{own})/nullif(g_{k + 1},0),{lo[k]})', k)} as x{k}"
        shared = "(s.x0*m_1+s.x1*m_2)"
        start = f"struct({part('0.5D', '', 0)}, {part('0.5D', '', 1)})"
        again = f"struct({part(f's.x0*m_1/{shared}', '', 0)}, {part(f's.x1*m_2/{shared}', '', 1)})"
        loss = f"-(n_1*ln(s.x0)+n_2*ln(s.x1)+case when n_b>0 then n_b*ln({shared}) else 0.0D end+s_ln-s.x0*g_1-s.x1*g_2-s_fact)"
        return F.expr(f"case when n_b>0 then aggregate(sequence(1,{SHARES}), {start}, (s, i) -> {again}, s -> struct({loss} as loss, s.x0 as x0, s.x1 as x1)) else transform(array({start}), s -> struct({loss} as loss, s.x0 as x0, s.x1 as x1))[0] end")
    loss = lambda x, y: f"s_yy-2*({x})*s_y1-2*({y})*s_y2+({x})*({x})*s_11+2*({x})*({y})*s_12+({y})*({y})*s_22"
    det = "nullif(s_11*s_22-s_12*s_12,0)"
    x, y = f"((s_y1*s_22-s_y2*s_12)/{det})", f"((s_y2*s_11-s_y1*s_12)/{det})"
    point = lambda x, y: f"struct({loss(x, y)} as loss, {x} as x0, {y} as x1)"
    inside = f"case when {det}>0 and {x} between {lo[0]} and {hi[0]} and {y} between {lo[1]} and {hi[1]} then {point(x, y)} end"
    edges = []
    for v in (lo[0], hi[0]):
        edges.append(point(v, clip(f"coalesce((s_y2-({v})*s_12)/nullif(s_22,0),{lo[1]})", 1)))
    for v in (lo[1], hi[1]):
        edges.append(point(clip(f"coalesce((s_y1-({v})*s_12)/nullif(s_11,0),{lo[0]})", 0), v))
    return F.array_min(F.expr(f"array({inside},{','.join(edges)})"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; b's keys are dropped."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    return a.join(b, on, how).drop(*(f"_{k}" for k in keys))


#: What a search needs of a box beside its sides.
_STATS = ("n", "E", "y_n", "f_n", "syy", "var_y", "var_e")
#: Most models whose kernels one pass dispatches, and most characters of their SQL: the JVM compiles methods of up to 8,000 bytes only, and runs longer ones many times slower.
TOGETHER, DISPATCHED = 8, 500
#: Days by candidates that a task goes through. Its sums lie in memory, one row for every series and candidate, so more series make more tasks, not larger ones.
PER_TASK = 2_000_000


def _passes(specs: list[ModelSpec], mle: bool | Loss) -> list[list[ModelSpec]]:
    """specs of one kind in the groups that share a pass; kernels of several parts go alone, since what their parts have in common is worked out once only where nothing is dispatched."""
    out: list[list[ModelSpec]] = []
    for s in specs:
        if not out or _kind(s) != "plain" or len(out[-1]) == TOGETHER or sum(_length(x, mle) for x in (*out[-1], s)) > DISPATCHED:
            out.append([])
        out[-1].append(s)
    return out


def _length(spec: ModelSpec, mle: bool | Loss) -> int:
    """Characters of SQL that a pass needs for a model's kernel, on the day and, for daily growth, on the day before."""
    return len(spec.mean) * (2 if mle else 1)


def _pass(rows: DataFrame, specs: list[ModelSpec], units: list[DataFrame], mle: bool | Loss, keys: list[str], side: Callable[[ModelSpec, str, str], str], carry: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One pass of days by candidates for models of one kind: keys, m (a model's place in ``specs``), n and best = struct<loss, cand, params>.

    ``rows`` are the days with what ``side`` (model, "lo" or "hi", parameter) refers to and ``carry`` names; ``keep`` of it is returned, and then keys without
    a candidate of finite loss as well. Candidates are broadcast: their number does not depend on the data. All that is grouped or carried is a plain double,
    so the sums are hash aggregates in generated code, without a sort, and where ``rows`` are dealt out by key nothing is shuffled.
    """
    kind, places = _kind(specs[0]), max(len(_free(s)) for s in specs)
    of = lambda f: f(specs[0]) if all(s is specs[0] for s in specs) else "case m " + " ".join(f"when {i} then {f(s)}" for i, s in enumerate(specs)) + " end"
    flat = reduce(DataFrame.unionByName, (
        u.select(F.lit(i).alias("m"), "cand", *((F.col("u")[k] if k < len(_free(s)) else F.lit(None).cast("double")).alias(f"u_{k}") for k in range(places))) for i, (s, u) in enumerate(zip(specs, units))
    ))

    def place(spec: ModelSpec, k: int) -> str:
        if k >= len(_free(spec)):
            return "cast(null as double)"
        p = _free(spec)[k]
        lo, hi = side(spec, "lo", p), side(spec, "hi", p)
        if kind == "effort" and p == "b":
            lo, hi = f"({lo}*E)", f"({hi}*E*5)"  # the rate times the height of the effort curve
        return _place(f"u_{k}", lo, hi, p in spec.logs)

    rows = rows.crossJoin(F.broadcast(flat)).withColumns({f"p_{k}": F.expr(of(lambda s, k=k: place(s, k))) for k in range(places)})

    def kernel(spec: ModelSpec, what: str, t: str) -> str:
        one = {x: "cast(1 as double)" for x in (*spec.scales, *(["N"] if kind == "effort" else []))} | {p: f"p_{k}" for k, p in enumerate(_free(spec))}
        return bind(getattr(spec, what), one | {"t": t})

    added, sums = _sums(kind, mle, lambda what, t="t": F.expr(of(lambda s: kernel(s, what, t))))
    placed = [f"p_{k}" for k in range(places)]
    got = rows.withColumns(added).groupBy(*keys, "m", "cand").agg(*(F.max(c).alias(c) for c in dict.fromkeys([*carry, *placed, *keep])), *(F.sum(F.expr(v)).alias(k) for k, v in sums.items()))
    extra = F.lit(0.0)
    if kind == "effort":
        b = lambda s: f"p_{_free(s).index('b')}"
        got = got.withColumn("height", F.expr(of(lambda s: f"least(greatest(s_ew/nullif(s_ww,0),{side(s, 'lo', 'N')}),{side(s, 'hi', 'N')})")))
        got = got.withColumn("rate", F.expr(of(lambda s: f"{b(s)}/height")))
        off = "(s_ee-2*height*s_ew+height*height*s_ww)"
        inside = F.expr(of(lambda s: f"case when rate between {side(s, 'lo', 'b')} and {side(s, 'hi', 'b')} then 0.0D end"))
        extra = inside + F.expr(f"case when n_e>0 then n_e/2*(1.8378770664093453D+ln(greatest({off},1e-9D)/n_e)+1) else 0.0D end" if mle else f"coalesce(nullif(var_y,0),1)/coalesce(nullif(var_e,0),1)*{off}")
    scales = range(2 if kind == "pair" else 1)
    sides = {f"{s}_x{i}": F.expr(of(lambda spec, s=s, i=i: side(spec, s, spec.scales[i]))) for i in scales for s in ("lo", "hi")}
    solved = got.withColumns(sides).withColumn("s", _solve(kind, mle, [f"lo_x{i}" for i in scales], [f"hi_x{i}" for i in scales]))

    def values(spec: ModelSpec) -> str:
        return "array(" + ",".join(f"x{spec.scales.index(p)}" if p in spec.scales else ("height" if kind == "effort" and p == "N" else "rate" if kind == "effort" and p == "b" else f"p_{_free(spec).index(p)}") for p in spec.params) + ")"

    chosen = [*placed, *(["height", "rate"] if kind == "effort" else [])]
    solved = solved.select(*keys, "m", "cand", "n", *chosen, *(c for c in keep if c not in ("n", *chosen)), (F.col("s.loss") + extra).alias("loss"), *(F.col(f"s.x{i}").alias(f"x{i}") for i in scales))
    solved = solved.withColumn("loss", F.nanvl("loss", F.lit(None).cast("double"))) if keep else solved.where("loss is not null and not isnan(loss)")
    # equal losses go to the least candidate: one part in 2 ** 50 a candidate sets them apart
    order = F.col("loss") + F.abs("loss") * F.col("cand") * F.lit(2.0**-50) + F.col("cand") * F.lit(1e-290)
    least = solved.withColumn("_order", order).groupBy(*keys, "m").agg(*(F.max(c).alias(c) for c in dict.fromkeys(("n", *keep))), *(F.min_by(c, "_order").alias(c) for c in ("loss", "cand", *chosen, *(f"x{i}" for i in scales))))
    return least.select(*keys, "m", "n", *(c for c in keep if c != "n"), F.struct("loss", "cand", F.expr(of(values)).alias("params")).alias("best"))


def _tasks(df: DataFrame, days: int = 0, candidates: int = 1) -> int:
    """As many tasks as the session has shuffle partitions, however few bytes a table of days is: each day meets all candidates; more where that is over PER_TASK a task."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-days * candidates // PER_TASK))


def _search(obs: DataFrame, spec: ModelSpec, boxes: DataFrame, units: DataFrame, mle: bool | Loss, keys: list[str], keep: tuple[str, ...] = (), days: int = 0) -> DataFrame:
    """One pass of one model over boxes that a table gives: keys, n and best = struct<loss, cand, params>; with ``keep`` (numbers of the boxes, lo_0, hi_0, ...
    among them) these too. Days, ``days`` of them, are shuffled once, by key."""
    plain = boxes.select(*keys, *(c for c in _STATS if c in boxes.columns), *(F.col(s)[i].alias(f"{s}_{i}") for s in ("lo", "hi") for i in range(spec.k)), *(c for c in keep if c in boxes.columns and c not in _STATS))
    rows = _same(obs, plain, keys).repartition(_tasks(obs, days, units.count()), *keys)
    kind, at = _kind(spec), spec.params.index
    used = [*spec.scales, *(["N", "b"] if kind == "effort" else [])]
    carry = ["n", *(["y_n", "f_n"] if mle else []), *(f"{s}_{at(p)}" for p in used for s in ("lo", "hi")), *(["var_y", "var_e"] if kind == "effort" else [])]
    carry = [c for c in carry if c in rows.columns]
    return _pass(rows, [spec], [units], mle, keys, lambda s, edge, p: f"{edge}_{at(p)}", carry, keep).drop("m")


def _prepared(cum: DataFrame, mle: bool | Loss, keys: list[str]) -> DataFrame:
    if not mle:
        return cum
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("t")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))
    d = cum.withColumns({"dy": step("y"), "df": step("y_fixed"), "t_prev": F.coalesce(F.lag("t").over(w), F.lit(0.0))})
    return d.withColumns({"fact": log_factorial(F.col("dy")), "fact_fixed": log_factorial(F.col("df"))})


def _with_stats(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Days with the statistics of their series beside them (see series_stats), by windows over days dealt out by key: one shuffle, no join."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    d = obs.repartition(_tasks(obs), *keys)
    return d.withColumns({
        "n": F.count("*").over(w).cast("double"), "top": F.greatest(F.max("y").over(w), F.lit(1.0)), "E": F.greatest(F.max("effort").over(w), F.lit(1.0)), "e_max": F.max("effort").over(w),
        "f_max": F.max("y_fixed").over(w), "y_n": F.max_by("y", "t").over(w), "f_n": F.max_by("y_fixed", "t").over(w), "var_y": F.var_pop("y").over(w), "var_e": F.var_pop("effort").over(w),
    })


def default_units(spark: SparkSession, spec: ModelSpec) -> DataFrame:
    """The candidates of a model by the number of its searched parameters: 400 points of a grid for one or two, a hypercube of 600 beyond."""
    dims = len(_free(spec))
    return grid(spark, dims, 400 if dims == 1 else None) if dims <= 2 else latin_hypercube(spark, dims, 600)


def _kind_of_loss(loss: str | Loss) -> bool | Loss:
    if isinstance(loss, str) and loss not in ("sse", "mle"):
        raise ValueError(f"{loss}: loss is sse, mle or a Loss")
    return loss if isinstance(loss, Loss) else loss == "mle"


def _checked(spec: ModelSpec, mle: bool | Loss) -> None:
    if isinstance(mle, Loss) and _kind(spec) != "plain":
        raise ValueError(f"{spec.model_id}: losses of one's own are for models of one scale, without fixes or effort")
    if spec.segments:
        raise ValueError(f"{spec.model_id}: fit_change_points fits it, by dynamic programming over all places")
    if mle and spec.pair and not spec.apart:
        raise ValueError(f"{spec.model_id}: likelihood fits of two scales are of kernels that grow on different days (apart), all but one")


def fit_models(cum: DataFrame, specs: list[ModelSpec], loss: str | Loss = "sse", units: dict[str, DataFrame] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, by..., model_id, params, loss, e_max, f_max): the best candidate of every model for every series, null where none has a finite loss.

    Days are worked out once, with statistics from windows over them, and stored: their number decides that of the tasks. Models of one kind (one scale, two, with fixes, with effort)
    share a pass over them, up to TOGETHER, in which each candidate names its model and the kernels are dispatched by it. Losses and ties are those of fit_profile.
    """
    mle, keys, spark = _kind_of_loss(loss), ["series_id", *by], cum.sparkSession
    for s in specs:
        _checked(s, mle)
    obs = stored(_prepared(_with_stats(cum.select(*keys, "t", "y", "y_fixed", "effort"), keys), mle, keys), "days")
    days = obs.count()
    stats = {"Y": "top", "E": "E", "n": "n"}  # names of columns don't differ by case alone

    def side(spec: ModelSpec, edge: str, p: str) -> str:
        lo, hi = (f"cast({bind(x, stats)} as double)" for x in spec.box[p])
        return lo if edge == "lo" else f"greatest({lo},{hi})"

    found, taken = [], set()
    for kind in dict.fromkeys(map(_kind, specs)):
        alike = [s for s in specs if _kind(s) == kind]
        for some in _passes(alike, mle):
            tables = [default_units(spark, s) if t is None else t for s in some for t in [(units or {}).get(s.model_id)]]
            # no two passes have as many tasks: a union of tables that are dealt out alike has one task go through all of them, holding the sums of all
            tasks = _tasks(obs, days, reduce(DataFrame.unionByName, tables).count())
            while tasks in taken:
                tasks += 1
            taken.add(tasks)
            got = _pass(obs.repartition(tasks, *keys), some, tables, mle, keys, side, ["n", "top", "E", *(["y_n", "f_n"] if mle else []), *(["var_y", "var_e"] if kind == "effort" else [])], ("e_max", "f_max"))
            name = F.element_at(F.array(*(F.lit(s.model_id) for s in some)), F.col("m") + 1)
            found.append(got.select(*keys, name.alias("model_id"), F.when(F.col("best.loss").isNotNull(), F.col("best.params")).alias("params"), F.col("best.loss").alias("loss"), "e_max", "f_max"))
    return reduce(DataFrame.unionByName, found)


def fit_profile(cum: DataFrame, spec: ModelSpec | str, units: DataFrame | None = None, loss: str | Loss = "sse", rounds: int = 0, by: tuple[str, ...] = (), boxes: DataFrame | None = None) -> DataFrame:
    """(series_id, by..., model_id, params, loss): the best candidate of each series (E9), after ``rounds`` zooms.

    loss "sse" (removal models: both series; effort models: the effort too, E2, E3) or "mle": the negative log-likelihood of the daily finds as Poisson counts, with that of the
    daily fixes for removal models and the Gaussian of the effort for effort models (E4, E5). Scales are solved for every candidate: in closed form, or for two scales by a fixed point on
    sums, since their kernels share one day at most; or a Loss of one's own. ``by`` adds keys such as a replicate or a start. Series without a candidate of finite loss have no row. Ties go to the least
    candidate. Broadcast are the candidates only, whose number does not depend on the data. Zooms only shrink boxes, so the loss never grows with them.
    """
    spec = MODELS[spec] if isinstance(spec, str) else spec
    mle, keys = _kind_of_loss(loss), ["series_id", *by]
    _checked(spec, mle)
    if boxes is None and not rounds:
        found = fit_models(cum, [spec], loss, None if units is None else {spec.model_id: units}, by)
        return found.where("loss is not null").select(*keys, "model_id", "params", "loss")
    spark = cum.sparkSession
    dims = len(_free(spec))
    if units is None:
        units = default_units(spark, spec)
    obs = stored(_prepared(cum, mle, keys), "days")
    days = obs.count()
    if boxes is None:
        boxes = param_bounds(series_stats(cum, keys), spec)
    boxes = boxes.select(*keys, "lo", "hi", *(c for c in _STATS if c in boxes.columns))
    if not rounds:
        found = _search(obs, spec, boxes, units, mle, keys, days=days)
        return found.select(*keys, F.lit(spec.model_id).alias("model_id"), F.col("best.params").alias("params"), F.col("best.loss").alias("loss"))
    # the sides and the best so far go along as plain numbers, so each round reads the last one once
    stats = tuple(c for c in _STATS if c in boxes.columns)
    best = ("b_loss", *(f"b_{i}" for i in range(spec.k)))
    keep = (*stats, *(f"{s}_{i}" for s in ("lo", "hi") for i in range(spec.k)))
    found = _search(obs, spec, boxes, units, mle, keys, keep, days)
    found = found.withColumns({"b_loss": F.col("best.loss"), **{f"b_{i}": F.col("best.params")[i] for i in range(spec.k)}}).drop("best")
    free = [spec.params.index(p) for p in _free(spec)]
    for k in range(rounds):
        small = latin_hypercube(spark, dims, 60, seed=k + 2) if dims > 1 else grid(spark, 1, 20)
        share = 0.35 * 0.4**k if dims > 1 else 1.0 / 400 * 0.1**k * 1.5
        lo = [F.greatest(f"lo_{i}", F.col(f"b_{i}") - share * (F.col(f"hi_{i}") - F.col(f"lo_{i}"))) if i in free else F.col(f"lo_{i}") for i in range(spec.k)]
        hi = [F.least(f"hi_{i}", F.col(f"b_{i}") + share * (F.col(f"hi_{i}") - F.col(f"lo_{i}"))) if i in free else F.col(f"hi_{i}") for i in range(spec.k)]
        narrow = found.select(*keys, *stats, F.array(*lo).alias("lo"), F.array(*hi).alias("hi"), *best)
        again = _search(obs, spec, narrow, small, mle, keys, (*keep, *best), days)
        better = F.coalesce(F.col("best.loss") < F.col("b_loss"), F.col("b_loss").isNull())
        found = again.select(
            *keys, *keep, F.when(better, F.col("best.loss")).otherwise(F.col("b_loss")).alias("b_loss"), *(F.when(better, F.col("best.params")[i]).otherwise(F.col(f"b_{i}")).alias(f"b_{i}") for i in range(spec.k))
        )
    done = found.where("b_loss is not null")
    return done.select(*keys, F.lit(spec.model_id).alias("model_id"), F.array(*(f"b_{i}" for i in range(spec.k))).alias("params"), F.col("b_loss").alias("loss"))


def fit_zoom(cum: DataFrame, spec: ModelSpec | str, rounds: int = 4, **kw) -> DataFrame:
    return fit_profile(cum, spec, rounds=rounds, **kw)


def fit_halving(cum: DataFrame, spec: ModelSpec | str, n: int = 2048, survivors: int = 8, points: int = 128, rounds: int = 8, loss: str | Loss = "sse") -> DataFrame:
    """(series_id, model_id, params, loss): searches of three and more parameters with several survivors a series.

    n evenly spread candidates are dealt to ``survivors`` starts, whose best go on; each round gives every survivor ``points`` candidates in a box around its best, and
    every other round the better half of a series' survivors stays, at last one. A box is shrunk by nearly half if the round found nothing better in it, else by a fifth and moved to its new best, so the loss
    never grows. Starts are further keys of the same pass: days are shuffled once a round and no series waits for another. Series without a finite loss have no row.
    """
    spec = MODELS[spec] if isinstance(spec, str) else spec
    mle, spark = _kind_of_loss(loss), cum.sparkSession
    _checked(spec, mle)
    free, k = [spec.params.index(p) for p in _free(spec)], spec.k
    dims = len(free)
    obs = stored(_prepared(_with_stats(cum.select("series_id", "t", "y", "y_fixed", "effort"), ["series_id"]), mle, ["series_id"]), "days")
    rows_of_days = obs.count()
    stats = ["n", "top", "E", "y_n", "f_n", "var_y", "var_e"]
    sides = {f"{edge}_{i}": F.expr(f"cast({bind(spec.box[p][edge == 'hi'], {'Y': 'top', 'E': 'E', 'n': 'n'})} as double)") for i, p in enumerate(spec.params) for edge in ("lo", "hi")}
    obs = obs.withColumns(sides).withColumns({f"hi_{i}": F.greatest(f"lo_{i}", f"hi_{i}") for i in range(k)})
    side = lambda s, edge, p: f"{edge}_{spec.params.index(p)}"
    whole = [*stats, *(f"{s}_{i}" for s in ("lo", "hi") for i in range(k))]
    spread = low_discrepancy(spark, dims, n)
    starts = [spread.where(F.col("cand") % survivors == g) for g in range(survivors)]
    found = _pass(obs.repartition(_tasks(obs, rows_of_days, n), "series_id"), [spec] * survivors, starts, mle, ["series_id"], side, whole, tuple(whole)).withColumnRenamed("m", "start").where("best.loss is not null")
    found = found.select("series_id", "start", *whole, F.col("best.loss").alias("b_loss"), *(F.col("best.params")[i].alias(f"b_{i}") for i in range(k)), F.lit(0.5 * n ** (-1 / dims) * 3).alias("share"))
    days = obs.drop(*whole)
    for r in range(rounds):
        if r % 2 and survivors > 1:
            survivors = max(1, survivors // 2)
            from pyspark.sql.window import Window

            found = found.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy("b_loss", "start"))).where(F.col("_r") <= survivors).drop("_r")
        box = found.select("series_id", "start", *stats, *(F.col(c).alias(f"w{c}") for c in whole if c not in stats), "b_loss", *(f"b_{i}" for i in range(k)), "share")
        # the searched sides lie around the best, on the scale on which the parameter is searched
        near = {}
        for i in range(k):
            lo, hi, b = F.col(f"wlo_{i}"), F.col(f"whi_{i}"), F.col(f"b_{i}")
            if i not in free or (spec.effort is not None and spec.params[i] == "b"):
                near |= {f"lo_{i}": lo, f"hi_{i}": hi}
            elif spec.params[i] in spec.logs:
                step = F.pow(hi / lo, F.col("share"))
                near |= {f"lo_{i}": F.greatest(lo, b / step), f"hi_{i}": F.least(hi, b * step)}
            else:
                near |= {f"lo_{i}": F.greatest(lo, b - F.col("share") * (hi - lo)), f"hi_{i}": F.least(hi, b + F.col("share") * (hi - lo))}
        rows = days.join(box.withColumns(near), "series_id").repartition(_tasks(cum, rows_of_days, survivors * points), "series_id")
        keep = (*stats, *(f"{s}_{i}" for s in ("wlo", "whi") for i in range(k)), "b_loss", *(f"b_{i}" for i in range(k)), "share")
        again = _pass(rows, [spec], [low_discrepancy(spark, dims, points, 1 + r * points)], mle, ["series_id", "start"], side, [*stats, *(f"{s}_{i}" for s in ("lo", "hi") for i in range(k))], keep)
        better = F.coalesce(F.col("best.loss") < F.col("b_loss"), F.lit(False))
        found = again.select(
            "series_id", "start", *stats, *(F.col(f"w{s}_{i}").alias(f"{s}_{i}") for s in ("lo", "hi") for i in range(k)), F.when(better, F.col("best.loss")).otherwise(F.col("b_loss")).alias("b_loss"),
            *(F.when(better, F.col("best.params")[i]).otherwise(F.col(f"b_{i}")).alias(f"b_{i}") for i in range(k)), (F.col("share") * F.when(better, 0.8).otherwise(0.55)).alias("share"),
        )
    last = found.groupBy("series_id").agg(*(F.min_by(c, "b_loss").alias(c) for c in ("b_loss", *(f"b_{i}" for i in range(k)))))
    return last.select("series_id", F.lit(spec.model_id).alias("model_id"), F.array(*(f"b_{i}" for i in range(k))).alias("params"), F.col("b_loss").alias("loss"))


def fit_multistart(cum: DataFrame, spec: ModelSpec | str, starts: int = 3, n: int = 200, loss: str = "sse", rounds: int = 0) -> DataFrame:
    """(series_id, model_id, params, loss, start_id) of the best of several independent candidate tables."""
    spec = MODELS[spec] if isinstance(spec, str) else spec
    dims = len(spec.searched) - (spec.effort is not None)
    runs = search_runs(cum, spec, {str(s): latin_hypercube(cum.sparkSession, dims, n, seed=101 + s) for s in range(starts)}, loss, rounds)
    return runs.groupBy("series_id").agg(F.min(F.struct("loss", "strategy", "model_id", "params")).alias("b")).select("series_id", "b.model_id", "b.params", "b.loss", F.col("b.strategy").alias("start_id"))


def search_runs(cum: DataFrame, spec: ModelSpec | str, tables: dict[str, DataFrame], loss: str = "sse", rounds: int = 0) -> DataFrame:
    """The fits of each named candidate table, with strategy and evaluations."""
    return reduce(DataFrame.unionByName, (fit_profile(cum, spec, t, loss, rounds).withColumns({"strategy": F.lit(k), "evaluations": F.lit(t.count())}) for k, t in tables.items()))


def compare_search(runs: DataFrame) -> DataFrame:
    """Per strategy: n_success, best_loss, avg_loss, avg_evaluations and in how many series it wins (ties: the first name)."""
    winner = runs.groupBy("series_id", "model_id").agg(F.min(F.struct("loss", "strategy")).alias("w")).groupBy(F.col("w.strategy").alias("strategy")).agg(F.count("*").alias("wins"))
    per = runs.groupBy("strategy").agg(F.count("loss").alias("n_success"), F.min("loss").alias("best_loss"), F.avg("loss").alias("avg_loss"), F.avg("evaluations").alias("avg_evaluations"))
    return per.join(winner, "strategy", "left").na.fill({"wins": 0})


def fit_all(cum: DataFrame, models: list[str], loss: str = "sse", rounds: int = 0, units: dict[str, DataFrame] | None = None) -> DataFrame:
    """(series_id, model_id, params, loss, success, warning): every model for every series; a series that a model can't fit keeps a row
    with success false (E14, E15)."""
    if rounds:
        found = reduce(DataFrame.unionByName, (fit_profile(cum, m, (units or {}).get(m), loss, rounds) for m in models))
        have = cum.groupBy("series_id").agg(F.max("effort").alias("e_max"), F.max("y_fixed").alias("f_max"))
        kinds = cum.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
        out = have.crossJoin(F.broadcast(kinds)).join(found, ["series_id", "model_id"], "left")
    else:
        out = fit_models(cum, [MODELS[m] for m in models], loss, units)
    of = lambda kind: F.col("model_id").isin([m for m in models if MODELS[m].category == kind])
    warning = F.when(of("effort") & ~(F.coalesce("e_max", F.lit(0.0)) > 0), "no_effort").when(of("removal") & ~(F.coalesce("f_max", F.lit(0.0)) > 0), "no_fixes")
    ok = F.col("params").isNotNull() & ~F.coalesce(F.col("warning") == "no_effort", F.lit(False))
    return out.withColumn("warning", warning).select("series_id", "model_id", F.when(ok, F.col("params")).alias("params"), F.when(ok, F.col("loss")).alias("loss"), ok.alias("success"), "warning")


def sse(cum: DataFrame, fits: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(series_id, model_id, n, sse, sst, y_sum): a direct pass over the residuals."""
    from .curves import curve

    rows = fits.select("series_id", "model_id", "params").join(cum.select("series_id", "t", "y"), "series_id").withColumn("m", curve("mean", models))
    return rows.groupBy("series_id", "model_id").agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("sse"), (F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*")).alias("sst")
    )


def sse_joint_removal(cum: DataFrame, fits: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(series_id, model_id, n, sse_found, sse_fixed, sse): both cumulative series."""
    pred = evaluate(fits, cum, models, corrected=True)
    rows = pred.join(cum.select("series_id", "t", "y", "y_fixed"), ["series_id", "t"])
    out = rows.groupBy("series_id", "model_id").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("sse_found"), F.sum(F.pow(F.col("y_fixed") - F.col("corrected"), 2)).alias("sse_fixed"))
    return out.withColumn("sse", F.col("sse_found") + F.col("sse_fixed"))


def sse_joint_effort(cum: DataFrame, fits: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model_id, n, n_effort, sse_found, sse_effort, sse): with the effort's squared errors, where over 0, weighted by the ratio of the
    population variances (a variance of 0 counts as 1) (E3)."""
    from .curves import curve

    rows = fits.select("series_id", "model_id", "params").join(cum, "series_id").withColumns({"m": curve("mean", models), "w": curve("effort", models)})
    out = rows.groupBy("series_id", "model_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("effort") > 0).alias("n_effort"),
        F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("sse_found"),
        F.coalesce(F.sum(F.when(F.col("effort") > 0, F.pow(F.col("effort") - F.col("w"), 2))), F.lit(0.0)).alias("sse_effort"),
        F.var_pop("y").alias("vy"),
        F.var_pop("effort").alias("ve"),
    )
    one = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("sse", F.col("sse_found") + one("vy") / one("ve") * F.col("sse_effort")).drop("vy", "ve")


def poisson_loglik(cum: DataFrame, fits: DataFrame, models: list[str] | None = None, what: str = "mean", counts: str = "y") -> DataFrame:
    """(series_id, model_id, loglik) of the daily counts, with means m(t) - m(t before) of 1e-9 at least, from m(0) on."""
    from pyspark.sql.window import Window

    from .curves import curve

    d = to_daily(cum, counts).select("series_id", "t", "dy")
    w = Window.partitionBy("series_id", "model_id").orderBy("t")
    rows = fits.select("series_id", "model_id", "params").join(d, "series_id").withColumn("t0", F.coalesce(F.lag("t").over(w), F.lit(0.0)))
    lam = F.greatest(curve(what, models) - curve(what, models, t="t0"), F.lit(1e-9))
    rows = rows.withColumn("lam", lam)
    return rows.groupBy("series_id", "model_id").agg(F.sum(F.col("dy") * F.log("lam") - F.col("lam") - log_factorial(F.col("dy"))).alias("loglik"))


def joint_loglik(cum: DataFrame, fits: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model_id, loglik): the Poisson likelihood of the daily finds, with that of the daily fixes for removal models, and the Gaussian of
    the effort for effort models (E5)."""
    keys = ["series_id", "model_id"]
    out = poisson_loglik(cum, fits, models).withColumnRenamed("loglik", "l_found")
    removal, effort = [m for m in models if MODELS[m].corrected], [m for m in models if MODELS[m].effort]
    out = out.withColumns({"l_fixed": F.lit(0.0), "l_effort": F.lit(0.0)})
    if removal:
        fixed = poisson_loglik(cum, fits.where(F.col("model_id").isin(removal)), removal, "corrected", "y_fixed").withColumnRenamed("loglik", "l_fixed")
        out = out.drop("l_fixed").join(fixed, keys, "left")
    if effort:
        e = sse_joint_effort(cum, fits.where(F.col("model_id").isin(effort)), effort)
        out = out.drop("l_effort").join(e.select(*keys, F.coalesce(gaussian_loglik(F.col("n_effort"), F.col("sse_effort")), F.lit(0.0)).alias("l_effort")), keys, "left")
    return out.select(*keys, (F.col("l_found") + F.coalesce("l_fixed", F.lit(0.0)) + F.coalesce("l_effort", F.lit(0.0))).alias("loglik"))


def gaussian_loglik(n: Column, sse_: Column) -> Column:
    """-n/2 (ln 2 pi + ln(SSE / n) + 1); null where SSE is not over 0."""
    return F.when(sse_ > 0, -n / 2 * (F.lit(1.8378770664093453) + F.log(sse_ / n) + 1))


def fit_quality(cum: DataFrame, fits: DataFrame, model: str, step: float = 1e-4) -> DataFrame:
    """(series_id, model_id, at_bound array<string>, gradient, grade): which parameters lie within 0.1 % of the box's width from
    its edge, the length of the loss's scaled gradient, and Good (flat, none at a bound), Acceptable (flat), Questionable (none at a bound) or Poor (E13)."""
    spec = MODELS[model]
    boxed = fits.where(F.col("model_id") == model).join(param_bounds(series_stats(cum), spec).select("series_id", "lo", "hi", "syy"), "series_id")
    near = lambda i: F.when(
        F.least(F.col("params")[i] - F.col("lo")[i], F.col("hi")[i] - F.col("params")[i]) < 0.001 * (F.col("hi")[i] - F.col("lo")[i]), F.lit(spec.params[i])
    )
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i in range(spec.k) for s in (-1, 1))))
    moved = boxed.select("series_id", "params", moves.alias("v")).select(
        "series_id", "v.i", "v.s", F.transform("params", lambda x, j: F.when(j == F.col("v.i"), x * (1 + step * F.col("v.s"))).otherwise(x)).alias("params")
    )
    from .curves import by_index

    loss = moved.join(cum.select("series_id", "t", "y"), "series_id").groupBy("series_id", "i").agg(F.sum(F.col("s") * F.pow(F.col("y") - F.expr(by_index(spec, spec.mean)), 2)).alias("d"))
    slope = loss.groupBy("series_id").agg(F.sqrt(F.sum(F.pow(F.col("d") / (2 * step), 2))).alias("gradient"))
    out = boxed.withColumn("at_bound", F.array_compact(F.array(*(near(i) for i in range(spec.k))))).join(slope, "series_id")
    flat, none = F.col("gradient") <= 0.05 * F.col("syy"), F.size("at_bound") == 0
    grade = F.when(flat & none, "Good").when(flat, "Acceptable").when(none, "Questionable").otherwise("Poor")
    return out.select("series_id", "model_id", "at_bound", "gradient", grade.alias("grade"))


def fit_effort(cum: DataFrame, effort: str, units: DataFrame | None = None, rounds: int = 0) -> DataFrame:
    """An effort curve fitted to the effort alone: (series_id, model_id, params, loss), N solved from sums."""
    curve_, _, shapes, top = EFFORTS[effort]
    spec = ModelSpec(f"effort_{effort}", "effort_curve", {"a": ("E", "5*E")} | shapes, bind(curve_, {"N": "a"}), "a" if top != "null" else "null")
    return fit_profile(cum.withColumn("y", F.col("effort")), spec, units, rounds=rounds)
