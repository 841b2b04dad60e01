"""The growth curves once more, written out by hand in SQL, so that the checks don't read the library's own expressions.

Fixed values: published curves. Parameters are named in their order; m(t), its limit, and for removal models corrected m, what is left, and the rate.
"""

from __future__ import annotations

import re

_PLAIN = """
exponential | a b | a - a * exp(-b * t) | a
delayed_s | a b | a - a * exp(-b * t) - a * b * t * exp(-b * t) | a
gompertz | a b c | a * exp(-b * exp(-c * t)) | a
shifted_gompertz | a b c | a * exp(-b * exp(-c * t)) - a * exp(-b) | a - a * exp(-b)
ohba_weibull | a b c | a - a * exp(-b * pow(t, c)) | a
logistic | a b c | a / (1 + exp(b * c - b * t)) | a
pham_imperfect | a b p | (a - a * exp(-b * t)) / (1 + p * exp(-b * t)) | a
weibull_imperfect | a b c p | (a - a * exp(-b * pow(t, c))) / (1 + p - p * exp(-b * pow(t, c))) | a / (1 + p)
exp_change_point | a1 b1 a2 b2 tau | case when t <= tau then a1 - a1 * exp(-b1 * t) else a1 - a1 * exp(-b1 * tau) + a2 - a2 * exp(-b2 * (t - tau)) end | a1 - a1 * exp(-b1 * tau) + a2
delayed_s_change_point | a1 b1 a2 b2 tau | case when t <= tau then a1 - a1 * (1 + b1 * t) * exp(-b1 * t) else a1 - a1 * (1 + b1 * tau) * exp(-b1 * tau) + a2 - a2 * (1 + b2 * (t - tau)) * exp(-b2 * (t - tau)) end | a1 - a1 * (1 + b1 * tau) * exp(-b1 * tau) + a2
imperfect_change_point | a b1 b2 alpha tau | case when t <= tau then IMP(t) else IMP(tau) + (a - (1 - alpha) * IMP(tau)) * (1 - exp(-b2 * (1 - alpha) * (t - tau))) / (1 - alpha + alpha * exp(-b2 * (1 - alpha) * (t - tau))) end | IMP(tau) + (a - (1 - alpha) * IMP(tau)) / (1 - alpha)
multi_change_point | a b1 r2 b2 r3 b3 tau gap | case when t <= tau then a * (1 - exp(-b1 * t)) when t <= tau + gap then a * (1 - exp(-b1 * tau)) + a * r2 * (1 - exp(-b2 * (t - tau))) else a * (1 - exp(-b1 * tau)) + a * r2 * (1 - exp(-b2 * gap)) + a * r3 * (1 - exp(-b3 * (t - tau - gap))) end | a * (1 - exp(-b1 * tau)) + a * r2 * (1 - exp(-b2 * gap)) + a * r3
change_points_2 | a1 b1 tau1 a2 b2 tau2 a3 b3 | case when t <= tau1 then a1 - a1 * exp(-b1 * t) when t <= tau2 then a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (t - tau1)) else a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (tau2 - tau1)) + a3 - a3 * exp(-b3 * (t - tau2)) end | a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (tau2 - tau1)) + a3
change_points_3 | a1 b1 tau1 a2 b2 tau2 a3 b3 tau3 a4 b4 | case when t <= tau1 then a1 - a1 * exp(-b1 * t) when t <= tau2 then a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (t - tau1)) when t <= tau3 then a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (tau2 - tau1)) + a3 - a3 * exp(-b3 * (t - tau2)) else a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (tau2 - tau1)) + a3 - a3 * exp(-b3 * (tau3 - tau2)) + a4 - a4 * exp(-b4 * (t - tau3)) end | a1 - a1 * exp(-b1 * tau1) + a2 - a2 * exp(-b2 * (tau2 - tau1)) + a3 - a3 * exp(-b3 * (tau3 - tau2)) + a4
effective_time_change_point | a b1 b2 p tau | a * (1 - exp(-(case when t <= tau then b1 * t else b1 * tau + b2 * (t - tau) end))) / (1 + p * exp(-(case when t <= tau then b1 * t else b1 * tau + b2 * (t - tau) end))) | a
coverage_weibull | a beta g | a - a * exp(-pow(beta * t, g)) | a
coverage_logistic | a beta tau | a / (1 + exp(beta * tau - beta * t)) | a
coverage_gompertz | a beta tau | a * exp(-exp(beta * tau - beta * t)) | a
constant_removal | a b eta | a - a * exp(-b * t) | a | eta * a * (1 - exp(-b * t)) | a - eta * a * (1 - exp(-b * t)) | eta
learning_removal | a b eta0 eta1 lambda | a - a * exp(-b * t) | a | LEARN | a - LEARN | eta1 - (eta1 - eta0) * exp(-lambda * t)
error_generation | a0 b alpha | GEN | a0 / (1 - alpha) | GEN | a0 * exp(-b * (1 - alpha) * t) | 1.0
removal_generation | a0 b alpha eta | GEN | a0 / (1 - alpha) | eta * GEN | a0 - (eta - alpha) * GEN | eta
reduction_factor | a b beta g | a - a * exp(-b * t) | a | (a - a * exp(-b * t)) / (1 + beta * exp(-g * t)) | a - (a - a * exp(-b * t)) / (1 + beta * exp(-g * t)) | 1 / (1 + beta * exp(-g * t))
integrated | a b1 b2 eta alpha tau | INT | INTAU + greatest(a + alpha * INTAU - (1 - alpha) * INTAU, 0) / (1 - alpha) | eta * INT | a - eta * INT | eta
"""
_PARTS = {
    "IMP(t)": "(a * (1 - exp(-b1 * (1 - alpha) * t)) / (1 - alpha + alpha * exp(-b1 * (1 - alpha) * t)))",
    "IMP(tau)": "(a * (1 - exp(-b1 * (1 - alpha) * tau)) / (1 - alpha + alpha * exp(-b1 * (1 - alpha) * tau)))",
    "LEARN": "(a * eta1 * (1 - exp(-b * t)) - a * (eta1 - eta0) * b / (b + lambda) * (1 - exp(-(b + lambda) * t)))",
    "GEN": "((a0 - a0 * exp(-b * (1 - alpha) * t)) / (1 - alpha))",
    "INTAU": "((a - a * exp(-b1 * (1 - alpha) * tau)) / (1 - alpha))",
    "INT": "(case when t <= tau then (a - a * exp(-b1 * (1 - alpha) * t)) / (1 - alpha) else INTAU + greatest(a + alpha * INTAU - (1 - alpha) * INTAU, 0) * (1 - exp(-b2 * (1 - alpha) * (t - tau))) / (1 - alpha) end)",
}
#: Effort: parameters, W(t), its rate, and its limit.
EFFORTS = {
    "exponential": ("N beta", "(N - N * exp(-beta * t))", "N * beta * exp(-beta * t)", "N"),
    "rayleigh": ("N beta", "(N - N * exp(-t * t / (beta * beta)))", "2 * N * t / (beta * beta) * exp(-t * t / (beta * beta))", "N"),
    "weibull": ("N beta m", "(N - N * exp(-pow(t / beta, m)))", "N * m / beta * pow(t / beta, m - 1) * exp(-pow(t / beta, m))", "N"),
    "logistic": ("N A rate", "(N / (1 + A * exp(-rate * t)))", "N * A * rate * exp(-rate * t) / pow(1 + A * exp(-rate * t), 2)", "N"),
    "log_power": ("N m", "(N * ln(1 + pow(t, m)))", "N * m * pow(t, m - 1) / (1 + pow(t, m))", None),
}
_KERNELS = {
    "exponential": ("a b", "a - a * exp(-b * W)", "a"),
    "delayed_s": ("a b", "a - a * (1 + b * W) * exp(-b * W)", "a"),
    "imperfect": ("a b alpha", "a * (1 - exp(-b * (1 - alpha) * W)) / (1 - alpha + alpha * exp(-b * (1 - alpha) * W))", "a / (1 - alpha)"),
}
#: Boxes of the models whose searches the checks repeat: lower and upper sides of the searched parameters, those on a log scale marked.
BOXES = {
    "exponential": {"b": ("0.001", "1.0")}, "delayed_s": {"b": ("0.001", "1.0")}, "gompertz": {"b": ("0.1", "10.0"), "c": ("0.001", "1.0")}, "shifted_gompertz": {"b": ("0.5", "10.0"), "c": ("0.001", "1.0")},
    "ohba_weibull": {"b": ("0.0001", "1.0", "log"), "c": ("0.3", "3.0")}, "logistic": {"b": ("0.01", "2.0"), "c": ("1.0", "2 * n")}, "pham_imperfect": {"b": ("0.001", "1.0"), "p": ("0.0", "0.99")},
    "weibull_imperfect": {"b": ("0.001", "1.0"), "c": ("0.5", "2.0"), "p": ("0.0", "0.99")},
    "exp_change_point": {"b1": ("0.001", "1.0"), "b2": ("0.001", "1.0"), "tau": ("2.0", "n - 2")}, "delayed_s_change_point": {"b1": ("0.001", "1.0"), "b2": ("0.001", "1.0"), "tau": ("2.0", "n - 2")},
    "constant_removal": {"b": ("0.001", "1.0"), "eta": ("0.3", "1.0")}, "learning_removal": {"b": ("0.001", "1.0"), "eta0": ("0.1", "0.9"), "eta1": ("0.7", "1.0"), "lambda": ("0.01", "1.0")},
    "error_generation": {"b": ("0.001", "1.0"), "alpha": ("0.0", "0.5")}, "removal_generation": {"b": ("0.001", "1.0"), "alpha": ("0.0", "0.5"), "eta": ("0.3", "1.0")},
    "reduction_factor": {"b": ("0.001", "1.0"), "beta": ("0.5", "50.0"), "g": ("0.01", "2.0")},
    "integrated": {"b1": ("0.001", "1.0"), "b2": ("0.001", "1.0"), "eta": ("0.3", "1.0"), "alpha": ("0.0", "0.5"), "tau": ("2.0", "n - 2")},
} | {
    f"effort_{k}_{e}": {"b": ("0.0001 * \"E\"", "5 * \"E\"", "log")} | ({"alpha": ("-0.5", "0.99")} if k == "imperfect" else {}) | s
    for k in ("exponential", "delayed_s", "imperfect")
    for e, s in {
        "exponential": {"beta": ("0.001", "2.0", "log")}, "rayleigh": {"beta": ("1.0", "2 * n", "log")}, "weibull": {"beta": ("1.0", "2 * n", "log"), "m": ("0.5", "5.0")},
        "logistic": {"A": ("1.0", "50.0"), "rate": ("0.01", "2.0")}, "log_power": {"m": ("0.5", "3.0")},
    }.items()
}
TOP = {"shifted_gompertz": "6", "error_generation": "3", "removal_generation": "3"}


def _named(sql: str, values: dict[str, str]) -> str:
    return re.sub(r"\b(" + "|".join(map(re.escape, values)) + r")\b", lambda m: values[m[0]], sql)


def _written(sql: str) -> str:
    for _ in range(2):
        for name, part in _PARTS.items():
            sql = re.sub(rf"\b{re.escape(name)}" + ("" if name.endswith(")") else r"\b"), lambda m, part=part: part, sql)
    return sql


def _table() -> dict[str, dict[str, str | None]]:
    out = {}
    for line in _PLAIN.strip().split("\n"):
        name, params, *parts = (x.strip() for x in line.split(" | "))
        out[name] = {"params": params, "effort": None} | dict(zip(("mean", "total", "corrected", "latent", "eta"), [*map(_written, parts), None, None, None]))
    for kernel, (params, mean, limit) in _KERNELS.items():
        for effort, (more, w, _, top) in EFFORTS.items():
            total = mean.replace("W", top) if top else limit
            out[f"effort_{kernel}_{effort}"] = {"params": f"{params} {more}", "mean": mean.replace("W", w), "total": total, "effort": w, "corrected": None, "latent": None, "eta": None}
    return out


FORMULAS = _table()


def names(model: str) -> list[str]:
    return FORMULAS[model]["params"].split()


def formula(model: str, what: str, params: str = "params", **more: str) -> str:
    """One of mean, total, corrected, latent, eta or effort with the parameters read from an array."""
    at = {p: f"{params}[{i + 1}]" for i, p in enumerate(names(model))} | more
    return f"({_named(FORMULAS[model][what], at)})"


def case(what: str, models: list[str], **more: str) -> str:
    return "case model_id " + " ".join(f"when '{m}' then {formula(m, what, **more)}" for m in models) + " end"


def effort_case(k: int) -> str:
    """W (k = 1) or its rate (k = 2)."""
    return "case effort " + " ".join(f"when '{e}' then {_named(v[k], {p: f'params[{i + 1}]' for i, p in enumerate(v[0].split())})}" for e, v in EFFORTS.items()) + " end"


def search(model: str, source: str = "cum", stats: str = "stats", cube: tuple[int, int] | None = None, tag: str = "") -> str:
    """CTE best_<model>: (series_id, model_id, params, loss) of its grid (up to two searched parameters) or hypercube (three; or of ``cube`` points and seed, under a name of its own)."""
    box = BOXES[model]
    if cube:
        return _search_cube(model, source, stats, *cube, tag)
    if len(box) < 3:
        g = 400 if len(box) == 1 else 20
        units = f"select i, {', '.join(f'((i // {g**k}) % {g} + 1) / {g}.0 as u{k}' for k in range(len(box)))} from (select unnest(range(0, {400})) as i)"
    else:
        h = lambda *parts: "cast(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8)) as ubigint)::double / 4294967296.0"
        order = lambda k: f"row_number() over (order by {h(chr(39) + '1' + chr(39), repr(str(k)), 'i::varchar')}, i)"
        units = "select i, " + ", ".join(f"({order(k)} - 1 + {h(chr(39) + '1' + chr(39), repr('j' + str(k)), 'i::varchar')}) / 600.0 as u{k}" for k in range(len(box))) + " from (select unnest(range(0, 600)) as i)"
    return _search_units(model, source, stats, units, model, TOP.get(model, "5"))


def _search_cube(model: str, source: str, stats: str, points: int, seed: int, tag: str) -> str:
    h = lambda *parts: "cast(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8)) as ubigint)::double / 4294967296.0"
    order = lambda k: f"row_number() over (order by {h(repr(str(seed)), repr(str(k)), 'i::varchar')}, i)"
    units = "select i, " + ", ".join(f"({order(k)} - 1 + {h(repr(str(seed)), repr('j' + str(k)), 'i::varchar')}) / {points}.0 as u{k}" for k in range(len(BOXES[model]))) + f" from (select unnest(range(0, {points})) as i)"
    return _search_units(model, source, stats, units, f"{model}{tag}", TOP.get(model, "5"))


def _search_units(model: str, source: str, stats: str, units: str, name: str, top: str) -> str:
    box, place = BOXES[model], []
    for k, (p, (lo, hi, *log)) in enumerate(box.items()):
        place.append(f"{lo} * pow({hi} / {lo}, u{k}) as p_{p}" if log else f"{lo} + ({hi} - {lo}) * u{k} as p_{p}")
    g = _named(FORMULAS[model]["mean"], {"a": "1.0"} | {p: f"p_{p}" for p in box})
    cols = ", ".join(f"p_{p}" for p in box)
    array = ", ".join("a" if p == "a" else f"p_{p}" for p in names(model))
    return f"""
units_{name} as ({units}),
at_{name} as (select c.series_id, i, c.t, c.y, {', '.join(place)} from {source} c join {stats} using (series_id) cross join units_{name}),
sums_{name} as (select series_id, i, {cols}, sum(y * g) as syg, sum(g * g) as sgg, sum(y * y) as syy from (select *, {g} as g from at_{name}) group by all),
best_{name} as (
  select series_id, '{model}' as model_id, arg_min([{array}], (loss, i)) as params, min(loss) as loss
  from (select *, syy - 2 * a * syg + a * a * sgg as loss from (select s.*, least(greatest(syg / sgg, "Y"), {top} * "Y") as a from sums_{name} s join {stats} using (series_id)))
  group by 1)"""


#: ln k! as the library defines it, of the column x.
LF = "case when x <= 1 then 0.0 when round(x) <= 20 then list_sum(list_transform(range(2, cast(round(x) as bigint) + 1), lambda i: ln(i))) else x * ln(x) - x + 0.5 * ln(2 * pi() * x) end"


def mle_search(model: str, per_dim: int, source: str = "cum", stats: str = "stats") -> str:
    """CTE mle_<model>: (series_id, model_id, params, loss) of the likelihood search over a grid: daily Poisson finds, with fixes or the effort where the model has them."""
    box, every = BOXES[model], names(model)
    pair, effort, fixes = "a1" in every, bool(FORMULAS[model]["effort"]), bool(FORMULAS[model]["corrected"])
    units = f"select i, {', '.join(f'((i // {per_dim**k}) % {per_dim} + 1) / {per_dim}.0 as u{k}' for k in range(len(box)))} from (select unnest(range(0, {per_dim ** len(box)})) as i)"
    place = [f"({lo}) * pow(({hi}) / ({lo}), u{k}) as p_{p}" if log else f"({lo}) + (({hi}) - ({lo})) * u{k} as p_{p}" for k, (p, (lo, hi, *log)) in enumerate(box.items())]
    cols = ", ".join(f"p_{p}" for p in box)

    def grown(what: str, **scales: str) -> str:
        at = lambda t: "(" + _named(FORMULAS[model][what], scales | {p: f"p_{p}" for p in box} | {"t": t}) + ")"
        return f"{at('t')} - {at('t0')}"

    days = f"d_{model} as (select series_id, t, effort, y - coalesce(lag(y) over w, 0) as dy, y_fixed - coalesce(lag(y_fixed) over w, 0) as df, coalesce(lag(t) over w, 0) as t0 from {source} window w as (partition by series_id order by t))"
    at = f"at_{model} as (select d.*, {_named(LF, {'x': 'dy'})} as fact, {_named(LF, {'x': 'df'})} as fact_fixed, i, {', '.join(place)} from d_{model} d join {stats} using (series_id) cross join units_{model})"
    if pair:
        rows = f"select *, greatest({grown('mean', a1='1.0', a2='0.0')}, 0) as d1, greatest({grown('mean', a1='0.0', a2='1.0')}, 0) as d2 from at_{model}"
        sums = f"""select series_id, i, {cols}, sum(d1) as g1, sum(d2) as g2, sum(fact) as fact, coalesce(sum(dy) filter (where d2 <= 0), 0) as n1, coalesce(sum(dy) filter (where d1 <= 0 and d2 > 0), 0) as n2,
  coalesce(sum(dy) filter (where d1 > 0 and d2 > 0), 0) as nb, coalesce(sum(d1) filter (where d1 > 0 and d2 > 0), 0) as b1, coalesce(sum(d2) filter (where d1 > 0 and d2 > 0), 0) as b2,
  sum(case when d2 <= 0 then dy * ln(greatest(d1, 1e-12)) when d1 <= 0 then dy * ln(greatest(d2, 1e-12)) else 0 end) as sl from ({rows}) group by all"""
        new = lambda own, k: f"least(greatest(coalesce((n{k} + nb * {own}) / nullif(g{k}, 0), 1.0), 1.0), 3 * \"Y\")"
        share = "(s.x0 * b1 + s.x1 * b2)"
        first = f"{{'x0': {new('0.5', 1)}, 'x1': {new('0.5', 2)}}}"
        again = f"{{'x0': {new(f's.x0 * b1 / {share}', 1)}, 'x1': {new(f's.x1 * b2 / {share}', 2)}}}"
        solved = f"(select s.*, case when nb > 0 then list_reduce(list_prepend({first}, list_transform(range(0, 20), lambda i: {{'x0': 0.0::double, 'x1': 0.0::double}})), lambda s, x: {again}) else {first} end as s from sums_{model} s join {stats} using (series_id))"
        loss = f"-(n1 * ln(s.x0) + n2 * ln(s.x1) + case when nb > 0 then nb * ln({share}) else 0 end + sl - s.x0 * g1 - s.x1 * g2 - fact)"
        array = ", ".join({"a1": "s.x0", "a2": "s.x1"}.get(p, f"p_{p}") for p in every)
        last = f"select *, {loss} as loss from {solved}"
    else:
        one = {p: "1.0" for p in every if p not in box}
        parts = [f"greatest({grown('mean', **one)}, 1e-12) as dg"] + ([f"greatest({grown('corrected', **one)}, 1e-12) as dc"] if fixes else [])
        if effort:
            parts.append("(" + _named(FORMULAS[model]["effort"], one | {p: f"p_{p}" for p in box}) + ") as w")
        sums = f"select series_id, i, {cols}, " + ("sum(dy * ln(dg) + df * ln(dc)) as sl, sum(dg + dc) as gn, sum(fact + fact_fixed) as fact, sum(dy + df) as total" if fixes else "sum(dy * ln(dg)) as sl, sum(dg) as gn, sum(fact) as fact, sum(dy) as total")
        sums += ", sum(effort * w) filter (where effort > 0) as ew, sum(w * w) filter (where effort > 0) as ww, sum(effort * effort) filter (where effort > 0) as ee, count(*) filter (where effort > 0) as ne" if effort else ""
        sums += f" from (select *, {', '.join(parts)} from at_{model}) group by all"
        a = f"least(greatest(total / gn, \"Y\"), {TOP.get(model, '5')} * \"Y\")"
        last = f"select *, -(total * ln(a) + sl - a * gn - fact) as loss from (select s.*, {a} as a from sums_{model} s join {stats} using (series_id))"
        if effort:
            sides = ("1.0", '2 * "E"') if model.endswith("log_power") else ('"E"', '5 * "E"')
            last = f"""select *, -(total * ln(a) + sl - a * gn - fact) + ne / 2.0 * (ln(2 * pi()) + ln(greatest(ee - 2 * h * ew + h * h * ww, 1e-9) / ne) + 1) as loss
    from (select *, p_b / h as rate from (select s.*, {a} as a, least(greatest(ew / ww, {sides[0]}), {sides[1]}) as h from sums_{model} s join {stats} using (series_id))) where rate between 0.0001 and 1"""
        array = ", ".join({"a": "a", "a0": "a", "N": "h", "b": "rate" if effort else "p_b"}.get(p, f"p_{p}") for p in every)
    return f"""
units_{model} as ({units}), {days}, {at},
sums_{model} as ({sums}),
mle_{model} as (select series_id, '{model}' as model_id, arg_min([{array}], (loss, i)) as params, min(loss) as loss from ({last}) group by 1)"""
