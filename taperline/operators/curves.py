"""Growth curves m(t) as SQL expressions in t and named parameters, with their boxes and limits.

The expressions use ANSI functions only. ``scale`` parameters enter linearly: m is proportional to ``a`` (or a sum over a1, a2),
so fits solve them from sums. Boxes are expressions in Y (greatest cumulative count), n (days), E (greatest effort).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelSpec:
    """``box``: parameter to (lower, upper); ``mean``, ``total``, ``corrected``: SQL; ``inverse``: t at which m(t) = target, if closed."""

    model_id: str
    category: str
    box: dict[str, tuple[str, str]]
    mean: str
    total: str
    corrected: str | None = None
    inverse: str | None = None
    effort: str | None = None  # W(t) of an effort curve of height N
    pair: bool = False  # two scale parameters a1, a2 with kernels first and second
    first: str = ""
    second: str = ""
    apart: bool = False  # the kernels of a pair grow on different days, but for one
    decay: tuple[str, ...] = ()  # a pair's kernel over d days of its segment is 1 - exp(-b d) * (c0 + c1 d): c0, c1 as SQL in b
    latent: str | None = None
    eta: str | None = None
    defaults: bool = False
    logs: tuple[str, ...] = field(default=())  # parameters searched on a log scale
    segments: int = 0  # of exponential segments with scales of their own, fitted by fit_change_points

    @property
    def params(self) -> tuple[str, ...]:
        return tuple(self.box)

    @property
    def k(self) -> int:
        return len(self.box)

    @property
    def scales(self) -> tuple[str, ...]:
        if self.segments:
            return tuple(f"a{i + 1}" for i in range(self.segments))
        return ("a1", "a2") if self.pair else (("a0",) if "a0" in self.box else ("a",))

    @property
    def searched(self) -> tuple[str, ...]:
        return tuple(p for p in self.box if p not in self.scales)


def bind(sql: str, values: dict[str, str]) -> str:
    """``sql`` with names replaced as whole words."""
    return re.sub(r"\b(" + "|".join(map(re.escape, values)) + r")\b", lambda m: values[m[0]], sql) if values else sql


def by_index(spec: ModelSpec, sql: str, params: str = "params", base: int = 0, **more: str) -> str:
    """``sql`` with the parameters read from an array; DuckDB's start at 1."""
    return bind(sql, {p: f"{params}[{i + base}]" for i, p in enumerate(spec.params)} | more)


_A, _A6, _A100 = ("Y", "5*Y"), ("Y", "6*Y"), ("Y", "100*Y")
_B = ("0.001", "1")
_TAU = ("2", "n-2")


def _weibull_imperfect(x: str) -> str:
    return f"(a*{x}/(1+p*{x}))"


_D = "(1-exp(-b*power(t,c)))"
_S = lambda b, t: f"(1-(1+{b}*{t})*exp(-{b}*{t}))"
_E = lambda b, t: f"(1-exp(-{b}*{t}))"
_BEFORE, _AFTER = "least(t,tau)", "greatest(t-tau,0)"
_IMP = "(a*(1-exp(-b1*(1-alpha)*least(t,tau)))/(1-alpha*(1-exp(-b1*(1-alpha)*least(t,tau)))))"
_IMP_REST = "(a+alpha*" + _IMP + "-" + _IMP + ")"
_U = f"(b1*{_BEFORE}+b2*{_AFTER})"
_GEN = "(a0*(1-exp(-b*(1-alpha)*t))/(1-alpha))"
_INT = "(a*(1-exp(-b1*(1-alpha)*least(t,tau)))/(1-alpha))"
_INT_REST = f"(a+alpha*{_INT}-{_INT}*(1-alpha))"

#: Effort curves of height N: W(t), its rate, and the box of their shape parameters.
EFFORTS: dict[str, tuple[str, str, dict[str, tuple[str, str]], str]] = {
    "exponential": ("(N*(1-exp(-beta*t)))", "(N*beta*exp(-beta*t))", {"beta": ("0.001", "2")}, "N"),
    "rayleigh": ("(N*(1-exp(-power(t/beta,2))))", "(N*2*t/power(beta,2)*exp(-power(t/beta,2)))", {"beta": ("1", "2*n")}, "N"),
    "weibull": ("(N*(1-exp(-power(t/beta,m))))", "(N*m/beta*power(t/beta,m-1)*exp(-power(t/beta,m)))", {"beta": ("1", "2*n"), "m": ("0.5", "5")}, "N"),
    "logistic": ("(N/(1+A*exp(-rate*t)))", "(N*A*rate*exp(-rate*t)/power(1+A*exp(-rate*t),2))", {"A": ("1", "50"), "rate": ("0.01", "2")}, "N"),
    "log_power": ("(N*ln(1+power(t,m)))", "(N*m*power(t,m-1)/(1+power(t,m)))", {"m": ("0.5", "3")}, "null"),
}


def effort_model(kernel: str, effort: str) -> ModelSpec:
    """A curve driven by effort W(t) in place of t."""
    curve, _, shapes, top = EFFORTS[effort]
    box = {"a": _A, "b": ("0.0001", "1")} | ({"alpha": ("-0.5", "0.99")} if kernel == "imperfect" else {}) | {"N": ("E", "5*E") if effort != "log_power" else ("1", "2*E")} | shapes
    of = {
        "exponential": lambda w: f"(a*(1-exp(-b*{w})))",
        "delayed_s": lambda w: f"(a*(1-(1+b*{w})*exp(-b*{w})))",
        "imperfect": lambda w: f"(a*(1-exp(-b*(1-alpha)*{w}))/(1-alpha*(1-exp(-b*(1-alpha)*{w}))))",
    }[kernel]
    total = of(top) if top != "null" else ("a/(1-alpha)" if kernel == "imperfect" else "a")
    return ModelSpec(f"effort_{kernel}_{effort}", "effort", box, of(curve), total, effort=curve, logs=("b", "beta"))


def _specs() -> list[ModelSpec]:
    basic = [
        ModelSpec("exponential", "basic", {"a": _A, "b": _B}, f"(a*{_E('b', 't')})", "a", inverse="(-ln(1-target/a)/b)", defaults=True),
        ModelSpec("delayed_s", "basic", {"a": _A, "b": _B}, f"(a*{_S('b', 't')})", "a", defaults=True),
        ModelSpec("gompertz", "basic", {"a": _A, "b": ("0.1", "10"), "c": _B}, "(a*exp(-b*exp(-c*t)))", "a", inverse="(-ln(-ln(target/a)/b)/c)", defaults=True),
        ModelSpec("shifted_gompertz", "basic", {"a": _A6, "b": ("0.5", "10"), "c": _B}, "(a*(exp(-b*exp(-c*t))-exp(-b)))", "(a*(1-exp(-b)))", inverse="(-ln(-ln(target/a+exp(-b))/b)/c)", defaults=True),
        ModelSpec("ohba_weibull", "basic", {"a": _A, "b": ("0.0001", "1"), "c": ("0.3", "3")}, f"(a*{_D})", "a", inverse="power(-ln(1-target/a)/b,1/c)", defaults=True, logs=("b",)),
        ModelSpec("logistic", "basic", {"a": _A, "b": ("0.01", "2"), "c": ("1", "2*n")}, "(a/(1+exp(-b*(t-c))))", "a", inverse="(c-ln(a/target-1)/b)", defaults=True),
    ]
    imperfect = [
        ModelSpec("pham_imperfect", "imperfect", {"a": _A, "b": _B, "p": ("0", "0.99")}, "(a*(1-exp(-b*t))/(1+p*exp(-b*t)))", "a", inverse="(-ln((a-target)/(a+p*target))/b)", defaults=True),
        ModelSpec(
            "weibull_imperfect", "imperfect", {"a": _A, "b": _B, "c": ("0.5", "2"), "p": ("0", "0.99")}, _weibull_imperfect(_D), "(a/(1+p))", inverse="power(-ln(1-target/(a-p*target))/b,1/c)", defaults=True
        ),
    ]
    pair = {"a1": ("1", "3*Y"), "b1": _B, "a2": ("1", "3*Y"), "b2": _B, "tau": _TAU}

    def two(name: str, f, *decay: str) -> ModelSpec:  # noqa: ANN001
        first, second = f("b1", _BEFORE), f("b2", _AFTER)
        return ModelSpec(name, "change_point", pair, f"(a1*{first}+a2*{second})", f"(a1*{f('b1', 'tau')}+a2)", pair=True, first=first, second=second, apart=True, decay=decay)

    def several(points: int) -> ModelSpec:
        """Exponential segments, each with its own scale and rate, between ``points`` change points."""
        box, parts, limit = {}, [], []
        for i in range(1, points + 2):
            box |= {f"a{i}": ("1", "2*Y"), f"b{i}": _B} | ({f"tau{i}": _TAU} if i <= points else {})
            begin, length = (f"tau{i - 1}" if i > 1 else "0"), f"(tau{i}-tau{i - 1})" if 1 < i <= points else "tau1"
            days = f"least(greatest(t-{begin},0),{length})" if i <= points else f"greatest(t-{begin},0)"
            parts.append(f"a{i}*{_E(f'b{i}', days)}")
            limit.append(f"a{i}*{_E(f'b{i}', length)}" if i <= points else f"a{i}")
        return ModelSpec(f"change_points_{points}", "change_point", box, "(" + "+".join(parts) + ")", "(" + "+".join(limit) + ")", segments=points + 1)

    change = [
        several(2),
        several(3),
        two("exp_change_point", _E, "1.0D"),
        two("delayed_s_change_point", _S, "1.0D", "b"),
        ModelSpec(
            "imperfect_change_point", "change_point", {"a": _A, "b1": _B, "b2": _B, "alpha": ("0", "0.5"), "tau": _TAU},
            f"(case when t<=tau then {_IMP} else {_IMP}+{_IMP_REST}*(1-exp(-b2*(1-alpha)*{_AFTER}))/(1-alpha*(1-exp(-b2*(1-alpha)*{_AFTER}))) end)",
            f"({_IMP.replace('least(t,tau)', 'tau')}+{_IMP_REST.replace('least(t,tau)', 'tau')}/(1-alpha))",
        ),
        ModelSpec(
            "multi_change_point", "change_point",
            {"a": ("1", "2*Y"), "b1": _B, "r2": ("0.05", "2"), "b2": _B, "r3": ("0.05", "2"), "b3": _B, "tau": _TAU, "gap": ("1", "n-3")},
            f"(a*({_E('b1', _BEFORE)}+r2*{_E('b2', 'least(greatest(t-tau,0),gap)')}+r3*{_E('b3', 'greatest(t-tau-gap,0)')}))",
            f"(a*({_E('b1', 'tau')}+r2*{_E('b2', 'gap')}+r3))",
        ),
        ModelSpec(
            "effective_time_change_point", "change_point", {"a": _A100, "b1": ("0.00000001", "10"), "b2": ("0.00000001", "10"), "p": ("0", "0.99"), "tau": _TAU},
            f"(a*(1-exp(-{_U}))/(1+p*exp(-{_U})))", "a", logs=("b1", "b2"),
        ),
    ]
    coverage = [
        ModelSpec("coverage_weibull", "coverage", {"a": _A100, "beta": ("0.00000001", "10"), "g": ("0.1", "5")}, "(a*(1-exp(-power(beta*t,g))))", "a", inverse="(power(-ln(1-target/a),1/g)/beta)", logs=("beta",)),
        ModelSpec("coverage_logistic", "coverage", {"a": _A100, "beta": ("0.01", "10"), "tau": ("1", "n")}, "(a/(1+exp(-beta*(t-tau))))", "a", inverse="(tau-ln(a/target-1)/beta)", logs=("beta",)),
        ModelSpec("coverage_gompertz", "coverage", {"a": _A100, "beta": ("0.001", "5"), "tau": ("1", "n")}, "(a*exp(-exp(-beta*(t-tau))))", "a", inverse="(tau-ln(-ln(target/a))/beta)", logs=("beta",)),
    ]
    ab = {"a": _A, "b": _B}
    md = "(a*(1-exp(-b*t)))"
    learning = "(a*(eta1*(1-exp(-b*t))-(eta1-eta0)*b/(b+lambda)*(1-exp(-(b+lambda)*t))))"
    invert = "(-ln(1-target/a)/b)"
    gen = {"a0": ("Y", "3*Y"), "b": _B, "alpha": ("0", "0.5")}
    removal = [
        ModelSpec("constant_removal", "removal", ab | {"eta": ("0.3", "1")}, md, "a", corrected=f"(eta*{md})", inverse=invert, latent=f"(a-eta*{md})", eta="eta"),
        ModelSpec(
            "learning_removal", "removal", ab | {"eta0": ("0.1", "0.9"), "eta1": ("0.7", "1"), "lambda": ("0.01", "1")}, md, "a", corrected=learning, inverse=invert, latent=f"(a-{learning})",
            eta="(eta1-(eta1-eta0)*exp(-lambda*t))",
        ),
        ModelSpec("error_generation", "removal", gen, _GEN, "(a0/(1-alpha))", corrected=_GEN, latent=f"(a0-(1-alpha)*{_GEN})", eta="1"),
        ModelSpec("removal_generation", "removal", gen | {"eta": ("0.3", "1")}, _GEN, "(a0/(1-alpha))", corrected=f"(eta*{_GEN})", latent=f"(a0+alpha*{_GEN}-eta*{_GEN})", eta="eta"),
        ModelSpec("reduction_factor", "removal", ab | {"beta": ("0.5", "50"), "g": ("0.01", "2")}, md, "a", corrected=f"({md}/(1+beta*exp(-g*t)))", inverse=invert, latent=f"(a-{md}/(1+beta*exp(-g*t)))", eta="(1/(1+beta*exp(-g*t)))"),
        ModelSpec(
            "integrated", "removal", {"a": _A, "b1": _B, "b2": _B, "eta": ("0.3", "1"), "alpha": ("0", "0.5"), "tau": _TAU},
            f"({_INT}+greatest({_INT_REST},0)*(1-exp(-b2*(1-alpha)*{_AFTER}))/(1-alpha))",
            f"({_INT.replace('least(t,tau)', 'tau')}+greatest({_INT_REST.replace('least(t,tau)', 'tau')},0)/(1-alpha))",
            corrected=f"(eta*({_INT}+greatest({_INT_REST},0)*(1-exp(-b2*(1-alpha)*{_AFTER}))/(1-alpha)))", eta="eta",
            latent=f"(a-eta*({_INT}+greatest({_INT_REST},0)*(1-exp(-b2*(1-alpha)*{_AFTER}))/(1-alpha)))",
        ),
    ]
    efforts = [effort_model(k, e) for k in ("exponential", "delayed_s", "imperfect") for e in EFFORTS]
    return basic + imperfect + change + coverage + removal + efforts


#: Every model by its name; register_model adds to it.
MODELS: dict[str, ModelSpec] = {s.model_id: s for s in _specs()}


def register_model(spec: ModelSpec) -> None:
    """Adds a model, or replaces one of the same name."""
    MODELS[spec.model_id] = spec


def with_fixed_tau(spec: ModelSpec) -> ModelSpec:
    """The model with its change point given by a column ``tau`` (C14)."""
    return ModelSpec(f"{spec.model_id}_fixed_tau", spec.category, {p: b for p, b in spec.box.items() if p != "tau"}, spec.mean, spec.total, pair=spec.pair, first=spec.first, second=spec.second, apart=spec.apart, decay=spec.decay, logs=spec.logs)


def catalog_ids(change_point: bool = False, effort: bool = False, removal: bool = False, coverage: bool = False) -> list[str]:
    wanted = {"change_point": change_point, "effort": effort, "removal": removal, "coverage": coverage}
    return [s.model_id for s in MODELS.values() if s.defaults or wanted.get(s.category)]


def model_catalog(spark: SparkSession, **families: bool) -> DataFrame:
    """(model_id, category, k, param_names) of the default models and the families asked for."""
    rows = [(s.model_id, s.category, s.k, list(s.params)) for s in map(MODELS.get, catalog_ids(**families))]
    return spark.createDataFrame(rows, "model_id string, category string, k int, param_names array<string>").dropDuplicates(["model_id"])


def curve(what: str, models: list[str] | None = None, params: str = "params", **more: str) -> Column:
    """``mean``, ``total``, ``corrected``, ``latent``, ``eta``, ``inverse`` or ``effort`` of each row's model, from its parameters; null where a
    model has none."""
    out = None
    for spec in (MODELS[m] for m in (models or MODELS)):
        sql = getattr(spec, what)
        value = F.expr(by_index(spec, sql, params, **more)).cast("double") if sql else F.lit(None).cast("double")
        out = F.when(F.col("model_id") == spec.model_id, value) if out is None else out.when(F.col("model_id") == spec.model_id, value)
    return out


def evaluate(fits: DataFrame, times: DataFrame, models: list[str] | None = None, corrected: bool = False) -> DataFrame:
    """(series_id, model_id, t, m) of every fit at its series' times; with ``corrected`` also corrected, latent and eta."""
    rows = fits.select("series_id", "model_id", "params").join(times.select("series_id", "t"), "series_id")
    cols = [curve("mean", models).alias("m")]
    if corrected:
        cols += [curve(x, models).alias(x) for x in ("corrected", "latent", "eta")]
    return rows.select("series_id", "model_id", "t", *cols)


def evaluate_efforts(points: DataFrame, times: DataFrame) -> DataFrame:
    """(series_id, effort, t, w, rate) of effort curves; ``points`` has effort (a name of EFFORTS) and params, N first."""
    rows = points.select("series_id", "effort", "params").join(times.select("series_id", "t"), "series_id")

    def pick(k: int) -> Column:
        out = None
        for name, parts in EFFORTS.items():
            value = F.expr(bind(parts[k], {p: f"params[{i}]" for i, p in enumerate(["N", *parts[2]])})).cast("double")
            out = F.when(F.col("effort") == name, value) if out is None else out.when(F.col("effort") == name, value)
        return out

    return rows.select("series_id", "effort", "t", pick(0).alias("w"), pick(1).alias("rate"))
