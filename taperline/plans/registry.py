"""The queries of the library, each over the given tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..operators import changepoint, curves, diagnostics, fit, predict, score, series, uncertainty
from ..sources import observations
from ..sources.shared import stored
from . import formulas
from .fixtures import base_sql, cum, obs, series_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODELS = ["exponential", "delayed_s"]
#: What the selection queries choose among.
CATALOG = curves.catalog_ids()
SIX = ["exponential", "delayed_s", "gompertz", "shifted_gompertz", "ohba_weibull", "logistic"]
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of sums can't show."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def q(names: str, digits: int = DIGITS) -> str:
    """A select list that rounds: each name, or expression as name."""
    out = []
    for x in names.split(";"):
        e, _, n = x.strip().rpartition(" as ")
        out.append(f"cast(round({e or n}, {digits}) as double) + cast(0 as double) as {n}")
    return ", ".join(out)


_case = formulas.case


def fits_sql(shape: str = "growth", models: list[str] = MODELS, source: str = "cum", stats: str = "stats", base: str = "") -> str:
    """CTEs to fits: the models' searches on a shape."""
    each = ",".join(formulas.search(m, source, stats) for m in models)
    return f"with {base or base_sql(shape)},{each},\nfits as ({' union all '.join(f'select * from best_{m}' for m in models)})"


def fits_of(spark: SparkSession, sf_dir: str, shape: str = "growth", models: list[str] = MODELS) -> tuple[DataFrame, DataFrame]:
    c = cum(spark, sf_dir, shape)
    return c, fit.fit_all(c, models).select("series_id", "model_id", "params", "loss")


MEAN, TOTAL = _case("mean", MODELS), _case("total", MODELS)
_K = "case model_id " + " ".join(f"when '{m}' then {len(formulas.names(m))}" for m in CATALOG) + " end"
PRED = f"{fits_sql(models=CATALOG)},\npred as (select f.series_id, f.model_id, params, c.t, c.y, c.y_fixed, {_case('mean', CATALOG)} as m from fits f join cum c using (series_id))"
SCORED = f"""{PRED},
sse as (select series_id, model_id, count(*) as n, sum(power(y - m, 2)) as sse, sum(y * y) - sum(y) * sum(y) / count(*) as sst from pred group by 1, 2),
scored0 as (select f.series_id, f.model_id, params, loss, n, {_K} as k, sse, case when sst > 0 then 1 - sse / sst else 0 end as r2, sse / n as mse, n * ln(sse / n) + 2 * ({_K}) as aic from fits f join sse using (series_id, model_id)),
scored as (select *, case when n > k + 1 then aic + 2.0 * k * (k + 1) / (n - k - 1) end as aicc, case when n <= k + 1 then 'Invalid' when n / k < 40 then 'AICc' else 'AIC' end as criterion from scored0)"""


# --- sources and series -------------------------------------------------------------------------------------------------


@query(f"with {base_sql('flat')} select series_id, day, planned, actual, found, fixed from obs")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir, "flat")


@query(f"with {base_sql('flat', 1)} select series_id, day, planned, actual, found, fixed from daily")
def daily_counts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir, "flat", 1, axis="active")


@query("""select l_returnflag || '-' || l_linestatus as series_id, cast(l_shipdate as date) as day, cast(sum(l_quantity) as double) as planned, cast(0 as double) as actual, cast(count(*) as double) as found, cast(0 as double) as fixed
  from lineitem group by 1, 2""")
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("day"))
    return observations.clean_counts(raw.agg(F.sum("l_quantity").cast("string").alias("planned"), F.lit("").alias("actual"), F.count("*").alias("found"), F.lit("n/a").alias("fixed")))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series.time_index(obs(spark, sf_dir, "flat", 7))
    days = int(o.agg(F.max("t")).first()[0] or 1)
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("v")) for m, c in (("date", "day"), *((k, k) for k in observations.COUNTS)))))
    long = o.select("series_id", "t", cells.alias("x")).select("series_id", "x.metric", F.concat(F.lit("d"), F.col("t").cast("int")).alias("slot"), "x.v")
    # one series has no date on its eleventh day
    gap = long.withColumn("v", F.when((F.col("series_id") == "3") & (F.col("slot") == "d11") & (F.col("metric") == "date"), None).otherwise(F.col("v")))
    return gap.groupBy("series_id", "metric").pivot("slot", [f"d{i}" for i in range(1, days + 1)]).agg(F.first("v"))


@query(f"with {base_sql('flat', 7)} select series_id, day, planned, actual, found, fixed from idx where (series_id <> '3' or t < 11)")
def unpivot_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.unpivot_tracker(_wide(spark, sf_dir))


@query(f"with {base_sql('flat')} select series_id, cast(case when t % 3 = 0 then start_date + cast(t - 1 as integer) else day end as date) as day, found from idx join series using (series_id)")
def fill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir, "flat")
    holes = series.time_index(o).withColumn("i", F.col("t").cast("int") - 1).withColumn("day", F.when(F.col("t") % 3 != 0, F.col("day")))
    return observations.fill_dates(holes, series_table(o)).select("series_id", "day", "found")


@query(f"with {base_sql('flat', 1)} select series_id, count(*) as n_days from daily group by 1 having count(*) < 26")
def require_min_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.require_min_days(obs(spark, sf_dir, "flat", 1, axis="active"), 26)[1]


@query(f"with {base_sql('flat')} select series_id, day, t, cum_planned, cum_actual, cum_found, cum_fixed, remaining from totals")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.running_totals(obs(spark, sf_dir, "flat"))


@query(f"with {base_sql('flat')} select series_id, t, {q('100 * cum_planned / total_cases as planned_pct; 100 * cum_actual / total_cases as actual_pct')} from totals join series using (series_id)")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir, "flat")
    return rounded(series.progress_pct(series.running_totals(o), series_table(o)).select("series_id", "t", "planned_pct", "actual_pct"))


@query(f"with {base_sql('flat')} select series_id, day, t, cum_planned, cum_actual, cum_found, cum_fixed, remaining from totals qualify row_number() over (partition by series_id order by t desc) = 1")
def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.current_status(series.running_totals(obs(spark, sf_dir, "flat")))


@query(f"with {base_sql()} select series_id, t, y, y - coalesce(lag(y) over (partition by series_id order by t), 0) as dy from cum")
def to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_daily(cum(spark, sf_dir)).select("series_id", "t", "y", "dy")


SHAPE = f"""with {base_sql()},
d as (select *, y - coalesce(lag(y) over (partition by series_id order by t), 0) as dy, max(y) over (partition by series_id) as top from cum),
shape as (
  select series_id, count(*) as n, max(y) as y_max, min(y) as y_min, arg_max(y, t) as y_last, (max(y) - min(y)) / (count(*) - 1) as average_slope,
    arg_max(dy, t) as last_increment, arg_max(dy, t) <= 1 as is_converged, min(t) filter (where y >= top / 2) as day50, max(effort) as e_max
  from d group by 1)"""


@query(f"{SHAPE} select series_id, n, y_max, y_min, y_last, {q('average_slope')}, last_increment, is_converged, day50, e_max from shape")
def series_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.shape(cum(spark, sf_dir)))


@query(f"""with {base_sql()}, d as (select *, sum(y) over (partition by series_id order by t) as run from cum), e as (select *, max(run) over (partition by series_id) as top from d)
  select series_id, min(t) as day from e where run >= 0.5 * top group by 1""")
def day_for_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.day_for_ratio(cum(spark, sf_dir), 0.5, recumulate=True)


@query(f"""{SHAPE} select series_id, {q('y_max * case when is_converged then 1.25 else 1.7 end as a0')},
  cast(case when average_slope <= 0.1 then 0.05 when average_slope <= 0.5 then 0.1 when average_slope <= 1 then 0.2 else 0.3 end as double) as b0_exp,
  cast(case when average_slope <= 0.1 then 0.08 when average_slope <= 0.5 then 0.15 when average_slope <= 1 then 0.25 else 0.35 end as double) as b0_s, day50 as tau0 from shape""")
def moment_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.moment_starts(series.shape(cum(spark, sf_dir))).select("series_id", "a0", F.col("b0_exp").cast("double").alias("b0_exp"), F.col("b0_s").cast("double").alias("b0_s"), "tau0"))


@query(f"""with {base_sql()} select series_id, {q('"Y" as lo_a; 5 * "Y" as hi_a; 0.01 as lo_b; 2.0 as hi_b; 1.0 as lo_c; 2 * n as hi_c')} from stats""")
def param_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fit.param_bounds(fit.series_stats(cum(spark, sf_dir)), curves.MODELS["logistic"])
    return rounded(b.select("series_id", *(F.col(s)[i].alias(f"{s}_{p}") for i, p in enumerate("abc") for s in ("lo", "hi"))))


@query(f"""with {base_sql('flat')} select series_id, chart, line, t, value from (
  select series_id, t, unnest(['burn_down', 'burn_down', 'bugs', 'bugs', 'remaining', 'combined', 'combined', 'combined', 'combined']) as chart,
    unnest(['cum_planned', 'cum_actual', 'cum_found', 'cum_fixed', 'remaining', 'cum_actual', 'cum_found', 'cum_fixed', 'remaining']) as line,
    unnest([cum_planned, cum_actual, cum_found, cum_fixed, remaining, cum_actual, cum_found, cum_fixed, remaining]) as value from totals)""")
def chart_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.chart_tables(series.running_totals(obs(spark, sf_dir, "flat")))


# --- curves and fits ----------------------------------------------------------------------------------------------------

#: Parameters inside every model's box for the data at hand, by name.
POINT = {
    "a": "(2.0*Y)", "a0": "(1.5*Y)", "a1": "(0.8*Y)", "a2": "(0.6*Y)", "b": "0.08", "b1": "0.08", "b2": "0.05", "b3": "0.04", "c": "1.1", "p": "0.3", "tau": "10.0", "tau1": "8.0", "tau2": "14.0", "tau3": "20.0", "a3": "(0.5*Y)", "a4": "(0.4*Y)", "b4": "0.06", "gap": "8.0", "alpha": "0.2", "r2": "0.5",
    "r3": "0.4", "beta": "0.9", "g": "0.8", "eta": "0.7", "eta0": "0.4", "eta1": "0.9", "lambda": "0.2", "N": "(1.5*E)", "m": "1.5", "A": "8.0", "rate": "0.15",
}


#: Curves that would be flat after a few days at the common values.
_OWN = {("gompertz", "b"): "2.5", ("gompertz", "c"): "0.12", ("shifted_gompertz", "b"): "2.5", ("shifted_gompertz", "c"): "0.12"} | {(m, "b"): "0.01" for m in formulas.FORMULAS if m.startswith("effort_")}


def point_sql(model: str) -> str:
    return "[" + ", ".join(f"cast({_OWN.get((model, p), POINT[p])} as double)" for p in formulas.names(model)) + "]"


EVERY = sorted(m for m in curves.MODELS)


def _points(c: DataFrame, models: list[str]) -> DataFrame:
    stats = fit.series_stats(c)
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model_id"), F.expr("array(" + point_sql(m)[1:-1] + ")").alias("params")) for m in models)))
    return stats.select("series_id", rows.alias("x")).select("series_id", "x.model_id", "x.params")


def _points_sql(models: list[str]) -> str:
    return "points as (" + " union all ".join(f"select series_id, '{m}' as model_id, {point_sql(m).replace('Y', '\"Y\"').replace('*E', '*\"E\"')} as params from stats" for m in models) + ")"


@query(f"with {base_sql()}, {_points_sql(EVERY)} select p.series_id, p.model_id, c.t, {q(_case('mean', EVERY) + ' as m')} from points p join cum c using (series_id)")
def evaluate_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(curves.evaluate(_points(c, EVERY), c))


def _effort_points(sql: bool) -> list[tuple[str, str]]:
    return [(e, ("[{}]" if sql else "array({})").format(", ".join(f"cast({POINT[p]} as double)" for p in ["N", *v[2]]))) for e, v in curves.EFFORTS.items()]


_EFFORT_POINTS = " union all ".join(f"select series_id, '{e}' as effort, {p.replace('*E', '*' + chr(34) + 'E' + chr(34))} as params from stats" for e, p in _effort_points(True))


@query(f"with {base_sql()}, ep as ({_EFFORT_POINTS}) select ep.series_id, ep.effort, t, {q(formulas.effort_case(1) + ' as w')}, {q(formulas.effort_case(2) + ' as rate')} from (select series_id, effort, params from ep) ep join (select series_id, t from cum) c using (series_id)")
def effort_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    rows = F.explode(F.array(*(F.struct(F.lit(e).alias("effort"), F.expr(p).alias("params")) for e, p in _effort_points(False))))
    points = fit.series_stats(c).select("series_id", rows.alias("x")).select("series_id", "x.effort", "x.params")
    return rounded(curves.evaluate_efforts(points, c))


@query(f"""{fits_sql()}, r as (select f.series_id, f.model_id, {TOTAL} as total, y_n from fits f join stats using (series_id))
select series_id, model_id, case when y_n / total >= 0.99 then 'ready' when y_n / total >= 0.95 then 'beta' when y_n / total >= 0.9 then 'converging' else 'open' end as grade from r""")
def convergence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    last = c.groupBy("series_id").agg(F.max_by("y", "t").alias("y_n"))
    return f.withColumn("total", curves.curve("total", MODELS)).join(last, "series_id").select("series_id", "model_id", series.convergence_grade(F.col("y_n"), F.col("total")).alias("grade"))


@query(f"""{fits_sql()}, p as (select series_id, model_id, unnest(['a', 'b']) as name, unnest(params) as value from fits)
select series_id, model_id, name, name || ' = ' || case when value >= 1000 then cast(cast(floor(value / 1000) as integer) as varchar) || ',' || printf('%08.4f', value - 1000 * floor(value / 1000)) else printf('%.4f', value) end as label from p""")
def parameter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fitted parameter with its name and a readable value."""
    _, f = fits_of(spark, sf_dir)
    names = f.join(F.broadcast(curves.model_catalog(spark).select("model_id", "param_names")), "model_id")
    each = names.select("series_id", "model_id", F.explode(F.arrays_zip(F.col("param_names").alias("name"), F.col("params").alias("value"))).alias("x"))
    return each.select("series_id", "model_id", "x.name", special.parameter_label(F.col("x.name"), F.col("x.value")).alias("label"))


def _squared(da: int, db: int) -> str:
    return f"sum(power(y - (a + {da} * ha) * (1 - exp(-(b + {db} * hb) * t)), 2))"


def _moved(da: int, db: int) -> str:
    now = f"((a + {da} * ha) * (1 - exp(-(b + {db} * hb) * t)))"
    was = f"((a + {da} * ha) * (1 - exp(-(b + {db} * hb) * t0)))"
    return f"sum(greatest({now} - {was}, 1e-10) - dy * ln(greatest({now} - {was}, 1e-10)))"


@query(f"""{fits_sql()}, d as (select f.series_id, params[1] as a, params[2] as b, greatest(1e-4, params[1] * 1e-4) as ha, greatest(1e-4, params[2] * 1e-4) as hb, t, y - coalesce(lag(y) over w, 0) as dy, coalesce(lag(t) over w, 0) as t0
  from fits f join cum c using (series_id) where model_id = 'exponential' window w as (partition by f.series_id order by t)),
h as (select series_id, ({_moved(2, 0)} - 2 * {_moved(0, 0)} + {_moved(-2, 0)}) / (4 * any_value(ha * ha)) as aa, ({_moved(1, 1)} - {_moved(1, -1)} - {_moved(-1, 1)} + {_moved(-1, -1)}) / (4 * any_value(ha * hb)) as ab,
  ({_moved(0, 2)} - 2 * {_moved(0, 0)} + {_moved(0, -2)}) / (4 * any_value(hb * hb)) as bb from d group by 1)
select series_id, cast(i as integer) as i, cast(j as integer) as j, {q('case when i = 0 and j = 0 then aa when i = 1 and j = 1 then bb else ab end as value', 2)} from h cross join (values (0), (1)) x(i) cross join (values (0), (1)) z(j)""")
def hessians(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(uncertainty.numeric_hessian(c, f, "exponential"), 2)


@query(f"""{fits_sql()}, d as (select f.series_id, params[1] as a, params[2] as b, greatest(1e-4, params[1] * 1e-4) as ha, greatest(1e-4, params[2] * 1e-4) as hb, t, y from fits f join cum c using (series_id) where model_id = 'exponential'),
h as (select series_id, ({_squared(2, 0)} - 2 * {_squared(0, 0)} + {_squared(-2, 0)}) / (4 * any_value(ha * ha)) as aa, ({_squared(1, 1)} - {_squared(1, -1)} - {_squared(-1, 1)} + {_squared(-1, -1)}) / (4 * any_value(ha * hb)) as ab,
  ({_squared(0, 2)} - 2 * {_squared(0, 0)} + {_squared(0, -2)}) / (4 * any_value(hb * hb)) as bb from d group by 1)
select series_id, x.p as a, z.p as b, {q('case when x.p = z.p then 1.0 else -ab / sqrt(aa * bb) end as correlation', 4)} from h cross join (values ('a'), ('b')) x(p) cross join (values ('a'), ('b')) z(p)""")
def param_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(uncertainty.correlations(uncertainty.param_standard_errors(c, f, "exponential", "sse"), "exponential"), 4)


REMOVAL = [m for m in EVERY if curves.MODELS[m].corrected]


@query(
    f"with {base_sql()}, {_points_sql(REMOVAL)} select p.series_id, p.model_id, c.t, {q(_case('corrected', REMOVAL) + ' as corrected')}, {q(_case('latent', REMOVAL) + ' as latent')}, {q(_case('eta', REMOVAL) + ' as eta')} from points p join cum c using (series_id)"
)
def evaluate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(curves.evaluate(_points(c, REMOVAL), c, REMOVAL, corrected=True).select("series_id", "model_id", "t", "corrected", "latent", "eta"))


@query(f"with {base_sql()}, {_points_sql(EVERY)} select series_id, model_id, {q(_case('total', EVERY) + ' as total')} from points")
def asymptotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_points(cum(spark, sf_dir), EVERY).select("series_id", "model_id", curves.curve("total").alias("total")))


#: The catalogue's categories.
_CATEGORIES = {
    "basic": "exponential delayed_s gompertz shifted_gompertz ohba_weibull logistic", "imperfect": "pham_imperfect weibull_imperfect",
    "change_point": "change_points_2 change_points_3 exp_change_point delayed_s_change_point imperfect_change_point multi_change_point effective_time_change_point",
    "removal": "constant_removal learning_removal error_generation removal_generation reduction_factor integrated",
}
_CATALOG = "select * from (values " + ", ".join(f"('{m}', '{c}', {len(formulas.names(m))}, '{','.join(formulas.names(m))}')" for c, ms in _CATEGORIES.items() for m in ms.split()) + ") v(model_id, category, k, params)"


@query(f"with {base_sql()}, c as ({_CATALOG}) select series_id, model_id, category, cast(k as integer) as k, params from stats cross join c")
def observations_by_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = curves.model_catalog(spark, change_point=True, removal=True).select("model_id", "category", "k", F.array_join("param_names", ",").alias("params"))
    return cum(spark, sf_dir).select("series_id").distinct().crossJoin(F.broadcast(cat))


@query(f"{fits_sql()} select series_id, model_id, {q('params[1] as a; params[2] as b; loss', 8)} from fits")
def fit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits_of(spark, sf_dir)[1].select("series_id", "model_id", F.col("params")[0].alias("a"), F.col("params")[1].alias("b"), "loss"), 8)


@query(f"{fits_sql('sshape')} select series_id, model_id, {q('params[1] as a; params[2] as b; loss', 8)} from fits")
def fit_profile_sshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits_of(spark, sf_dir, "sshape")[1].select("series_id", "model_id", F.col("params")[0].alias("a"), F.col("params")[1].alias("b"), "loss"), 8)


LF = "case when dy <= 1 then 0.0 when round(dy) <= 20 then list_sum(list_transform(range(2, cast(round(dy) as bigint) + 1), lambda i: ln(i))) else dy * ln(dy) - dy + 0.5 * ln(2 * pi() * dy) end"


@query(f"""with {base_sql()},
d as (select series_id, t, y, y - coalesce(lag(y) over w, 0) as dy, coalesce(lag(t) over w, 0) as t0 from cum window w as (partition by series_id order by t)),
g as (select d.*, {LF} as fact, i, 0.001 + (1 - 0.001) * (i / 400.0) as b from d cross join (select unnest(range(1, 401)) as i)),
s as (select series_id, i, b, sum(dy * ln(greatest(exp(-b * t0) - exp(-b * t), 1e-12))) as sl, sum(greatest(exp(-b * t0) - exp(-b * t), 1e-12)) as gn, sum(fact) as sf from g group by 1, 2, 3),
l as (select series_id, b, a, -(y_n * ln(a) + sl - a * gn - sf) as loss from (select s.*, y_n, least(greatest(y_n / gn, "Y"), 5 * "Y") as a from s join stats using (series_id)))
select series_id, {q('arg_min(a, loss) as a; arg_min(b, loss) as b; min(loss) as loss', 8)} from l group by 1""")
def fit_profile_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit.fit_profile(cum(spark, sf_dir), "exponential", loss="mle").select("series_id", F.col("params")[0].alias("a"), F.col("params")[1].alias("b"), "loss"), 8)


#: Models of two scales, of found and fixed counts, and of effort, with the points a dimension of their candidate grids.
MLE = {
    "exp_change_point": 8, "delayed_s_change_point": 8, "constant_removal": 16, "learning_removal": 4, "error_generation": 16, "removal_generation": 6, "reduction_factor": 6, "integrated": 3,
    "effort_exponential_exponential": 16, "effort_exponential_rayleigh": 16, "effort_exponential_weibull": 8, "effort_exponential_logistic": 8, "effort_exponential_log_power": 16,
    "effort_delayed_s_weibull": 8, "effort_imperfect_weibull": 4,
}


@query(f"with {base_sql('change')},{','.join(formulas.mle_search(m, MLE[m]) for m in MLE)},\nevery as ({' union all '.join(f'select * from mle_{m}' for m in MLE)}) select series_id, model_id, {q('loss', 5)} from every")
def fit_mle_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood fits of pairs, removal and effort models."""
    units = {m: fit.grid(spark, len(formulas.BOXES[m]), g) for m, g in MLE.items()}
    return rounded(fit.fit_all(cum(spark, sf_dir, "change"), list(MLE), "mle", units=units).where("success").select("series_id", "model_id", "loss"), 5)


_IDENTIFIED = ["exp_change_point", "delayed_s_change_point", "constant_removal", "effort_exponential_weibull"]


@query(f"with {base_sql('change')},{','.join(formulas.mle_search(m, MLE[m]) for m in _IDENTIFIED)},\nevery as ({' union all '.join(f'select * from mle_{m}' for m in _IDENTIFIED)}) select series_id, model_id, i - 1 as place, {q('params[i] as value', 7)} from every, unnest(range(1, len(params) + 1)) as u(i)")
def fit_mle_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = {m: fit.grid(spark, len(formulas.BOXES[m]), MLE[m]) for m in _IDENTIFIED}
    found = fit.fit_all(cum(spark, sf_dir, "change"), _IDENTIFIED, "mle", units=units)
    return rounded(found.select("series_id", "model_id", F.posexplode("params").alias("place", "value")).withColumn("place", F.col("place").cast("long")), 7)


@query(f"with {base_sql()}, u as (select unnest(range(0, 400)) as i) select series_id, i as cand, {q('0.01 + 1.99 * ((i % 20) + 1) / 20.0 as b; 1 + (2 * n - 1) * (i // 20 + 1) / 20.0 as c')} from stats cross join u")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fit.param_bounds(fit.series_stats(cum(spark, sf_dir)), curves.MODELS["logistic"])
    at = lambda u, i: F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) * F.col("u")[u]
    return rounded(boxes.crossJoin(F.broadcast(fit.grid(spark, 2))).select("series_id", "cand", at(0, 1).alias("b"), at(1, 2).alias("c")))


@query()
def fit_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fit_zoom(cum(spark, sf_dir, "sshape"), "logistic")


@query()
def fit_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four searched parameters, several survivors a series."""
    return fit.fit_halving(cum(spark, sf_dir, "change"), "imperfect_change_point")


_STARTS = ",".join(formulas.search("gompertz", cube=(200, 101 + s), tag=f"_{s}") for s in range(3))


@query(f"""with {base_sql('sshape')},{_STARTS}, every as ({' union all '.join(f"select *, '{s}' as start_id from best_gompertz_{s}" for s in range(3))})
select series_id, model_id, start_id, {q('params[1] as a; params[2] as b; params[3] as c; loss')} from every qualify row_number() over (partition by series_id order by loss, start_id) = 1""")
def fit_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fit.fit_multistart(cum(spark, sf_dir, "sshape"), "gompertz")
    return rounded(f.select("series_id", "model_id", "start_id", *(F.col("params")[i].alias(p) for i, p in enumerate("abc")), "loss"))


@query(f"""with {base_sql('sshape')},{formulas.search('gompertz')},{formulas.search('gompertz', cube=(400, 1), tag='_cube')},
runs as (select *, 'grid' as strategy from best_gompertz union all select *, 'hypercube' from best_gompertz_cube),
won as (select series_id, strategy from runs qualify row_number() over (partition by series_id order by loss, strategy) = 1)
select r.strategy, count(loss) as n_success, {q('min(loss) as best_loss; avg(loss) as avg_loss')}, 400.0::double as avg_evaluations, (select count(*) from won where won.strategy = r.strategy) as wins from runs r group by 1""")
def compare_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"grid": fit.grid(spark, 2), "hypercube": fit.latin_hypercube(spark, 2, 400)}
    return rounded(fit.compare_search(fit.search_runs(cum(spark, sf_dir, "sshape"), "gompertz", tables)))


@query()
def fit_all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of each family for every series."""
    return fit.fit_all(cum(spark, sf_dir), [*SIX, "pham_imperfect", "exp_change_point", "coverage_weibull", "constant_removal", "effort_exponential_weibull"])


@query(f"""with {base_sql()}, u as (select i, (i % 20 + 1) / 20.0 as u0, (i // 20 + 1) / 20.0 as u1 from (select unnest(range(0, 400)) as i)),
g as (select c.series_id, i, 1 + (2 * n - 1) * u0 as beta, 0.5 + 4.5 * u1 as m, effort, 1 - exp(-pow(t / (1 + (2 * n - 1) * u0), 0.5 + 4.5 * u1)) as w from cum c join stats using (series_id) cross join u),
s as (select series_id, i, beta, m, sum(effort * w) as ew, sum(w * w) as ww, sum(effort * effort) as ee from g group by all),
l as (select series_id, i, beta, m, h, ee - 2 * h * ew + h * h * ww as loss from (select s.*, least(greatest(ew / ww, "E"), 5 * "E") as h from s join stats using (series_id)))
select series_id, {q('arg_min(h, (loss, i)) as height; arg_min(beta, (loss, i)) as beta; arg_min(m, (loss, i)) as m; min(loss) as loss')} from l group by 1""")
def fit_effort_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fit.fit_effort(cum(spark, sf_dir), "weibull")
    return rounded(f.select("series_id", *(F.col("params")[i].alias(p) for i, p in enumerate(("height", "beta", "m"))), "loss"))


#: Squares relative to the count, as a loss of one's own.
RELATIVE = fit.Loss("relative", {"s_g": "g*g/greatest(y,1)", "s_m": "y*g/greatest(y,1)", "s_y": "y*y/greatest(y,1)"}, "s_m/nullif(s_g,0)", "s_y-2*a*s_m+a*a*s_g")


@query(f"""with {base_sql()}, g as (select c.series_id, i, 0.001 + 0.999 * i / 400.0 as b, y, 1 - exp(-(0.001 + 0.999 * i / 400.0) * t) as g from cum c cross join (select unnest(range(1, 401)) as i)),
s as (select series_id, i, b, sum(g * g / greatest(y, 1)) as sg, sum(y * g / greatest(y, 1)) as sm, sum(y * y / greatest(y, 1)) as sy from g group by 1, 2, 3),
l as (select series_id, b, i, a, sy - 2 * a * sm + a * a * sg as loss from (select s.*, least(greatest(sm / sg, "Y"), 5 * "Y") as a from s join stats using (series_id)))
select series_id, {q('arg_min(a, (loss, i)) as a; arg_min(b, (loss, i)) as b; min(loss) as loss', 8)} from l group by 1""")
def fit_own_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fit.fit_profile(cum(spark, sf_dir), "exponential", loss=RELATIVE)
    return rounded(f.select("series_id", F.col("params")[0].alias("a"), F.col("params")[1].alias("b"), "loss"), 8)


@query(f"with {base_sql()}, {_points_sql(SIX)}, p as (select model_id, {_case('mean', SIX)} as m, c.* from points p join cum c using (series_id)) select series_id, model_id, count(*) as n, {q('sum(power(y - m, 2)) as sse')} from p group by 1, 2")
def sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.sse(c, _points(c, SIX), SIX).select("series_id", "model_id", "n", "sse"))


@query(
    f"with {base_sql()}, {_points_sql(REMOVAL)}, p as (select model_id, {_case('mean', REMOVAL)} as m, {_case('corrected', REMOVAL)} as mc, c.* from points p join cum c using (series_id)) select series_id, model_id, {q('sum(power(y - m, 2)) as sse_found; sum(power(y_fixed - mc, 2)) as sse_fixed; sum(power(y - m, 2)) + sum(power(y_fixed - mc, 2)) as sse')} from p group by 1, 2"
)
def sse_joint_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.sse_joint_removal(c, _points(c, REMOVAL), REMOVAL).drop("n"))


EFFORT = [m for m in EVERY if curves.MODELS[m].effort]


@query(
    f"with {base_sql()}, {_points_sql(EFFORT)}, p as (select model_id, {_case('mean', EFFORT)} as m, {_case('effort', EFFORT)} as w, c.* from points p join cum c using (series_id)) select series_id, model_id, {q('sum(power(y - m, 2)) as sse_found; sum(power(effort - w, 2)) filter (where effort > 0) as sse_effort; sum(power(y - m, 2)) + var_pop(y) / var_pop(effort) * (sum(power(effort - w, 2)) filter (where effort > 0)) as sse')} from p group by 1, 2"
)
def sse_joint_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.sse_joint_effort(c, _points(c, EFFORT), EFFORT).drop("n", "n_effort"))


@query(f"""with {base_sql()}, {_points_sql(SIX)},
d as (select p.model_id, p.params, c.series_id, c.t, c.y - coalesce(lag(c.y) over w, 0) as dy, coalesce(lag(c.t) over w, 0) as t0 from points p join cum c using (series_id) window w as (partition by c.series_id, p.model_id order by c.t)),
l as (select *, greatest({_case('mean', SIX)} - {_case('mean', SIX, t='t0')}, 1e-9) as lam, {LF} as fact from d)
select series_id, model_id, {q('sum(dy * ln(lam) - lam - fact) as loglik')} from l group by 1, 2""")
def poisson_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.poisson_loglik(c, _points(c, SIX), SIX))


JOINT = ["exponential", "constant_removal", "reduction_factor", "effort_exponential_weibull"]


@query(f"""with {base_sql()}, {_points_sql(JOINT)},
d as (select p.model_id, p.params, c.*, c.y - coalesce(lag(c.y) over w, 0) as dy, c.y_fixed - coalesce(lag(c.y_fixed) over w, 0) as df, coalesce(lag(c.t) over w, 0) as t0 from points p join cum c using (series_id) window w as (partition by c.series_id, p.model_id order by c.t)),
l as (select *, greatest({_case('mean', JOINT)} - {_case('mean', JOINT, t='t0')}, 1e-9) as lam, {LF} as fact from d),
found as (select series_id, model_id, sum(dy * ln(lam) - lam - fact) as l_found from l group by 1, 2),
fx as (select *, greatest({_case('corrected', JOINT[1:3])} - {_case('corrected', JOINT[1:3], t='t0')}, 1e-9) as lam, {LF.replace('dy', 'df')} as fact from d where model_id in ('constant_removal', 'reduction_factor')),
fixed as (select series_id, model_id, sum(df * ln(lam) - lam - fact) as l_fixed from fx group by 1, 2),
eff as (select series_id, model_id, count(*) as n, sum(power(effort - {_case('effort', JOINT[3:])}, 2)) as sse from d where model_id = 'effort_exponential_weibull' and effort > 0 group by 1, 2)
select series_id, model_id, {q('l_found + coalesce(l_fixed, 0) + coalesce(-n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1), 0) as loglik')} from found left join fixed using (series_id, model_id) left join eff using (series_id, model_id)""")
def joint_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.joint_loglik(c, _points(c, JOINT), JOINT))


@query(
    f"with {base_sql()}, {_points_sql(SIX)}, p as (select model_id, {_case('mean', SIX)} as m, c.* from points p join cum c using (series_id)), s as (select series_id, model_id, count(*) as n, sum(power(y - m, 2)) as sse from p group by 1, 2) select series_id, model_id, {q('-n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) as loglik')} from s"
)
def gaussian_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(fit.sse(c, _points(c, SIX), SIX).select("series_id", "model_id", fit.gaussian_loglik(F.col("n"), F.col("sse")).alias("loglik")))


@query(f"""{fits_sql('flat')}, b as (select f.series_id, f.model_id, params[1] as a, params[2] as b, "Y" as top, syy from fits f join stats using (series_id) where model_id = 'exponential'),
moved as (select b.series_id, sum(power(y - 1.0001 * a * (1 - exp(-b * t)), 2) - power(y - 0.9999 * a * (1 - exp(-b * t)), 2)) / 0.0002 as da, sum(power(y - a * (1 - exp(-1.0001 * b * t)), 2) - power(y - a * (1 - exp(-0.9999 * b * t)), 2)) / 0.0002 as db from b join cum c using (series_id) group by 1),
g as (select b.*, sqrt(da * da + db * db) as gradient, concat_ws(',', case when least(a - top, 5 * top - a) < 0.004 * top then 'a' end, case when least(b - 0.001, 1 - b) < 0.000999 then 'b' end) as at_bound from b join moved using (series_id))
select series_id, model_id, at_bound, {q('gradient / syy as gradient')}, case when gradient <= 0.05 * syy then (case when at_bound = '' then 'Good' else 'Acceptable' end) when at_bound = '' then 'Questionable' else 'Poor' end as grade from g""")
def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir, "flat")
    made = fit.fit_quality(c, f, "exponential").join(fit.series_stats(c).select("series_id", "syy"), "series_id")
    return rounded(made.select("series_id", "model_id", F.concat_ws(",", "at_bound").alias("at_bound"), (F.col("gradient") / F.col("syy")).alias("gradient"), "grade"))


#: Every third series has no effort, and every third no fixes.
_HOLES = "select series_id, t, y, case when series_id::int % 3 = 1 then 0 else y_fixed end as y_fixed, case when series_id::int % 3 = 0 then 0 else effort end as effort from cum"


@query(f"with {base_sql()}, holes as ({_HOLES}), e as (select series_id, max(effort) as e, max(y_fixed) as f from holes group by 1) select series_id, model_id, case when model_id = 'effort_exponential_weibull' and not e > 0 then 'no_effort' when model_id = 'constant_removal' and not f > 0 then 'no_fixes' end as warning, not (model_id = 'effort_exponential_weibull' and not e > 0) as success from e cross join (values ('effort_exponential_weibull'), ('constant_removal')) v(model_id)")
def input_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("series_id").cast("int") % 3
    c = cum(spark, sf_dir).withColumns({"y_fixed": F.when(third == 1, 0.0).otherwise(F.col("y_fixed")), "effort": F.when(third == 0, 0.0).otherwise(F.col("effort"))})
    return fit.fit_all(c, ["effort_exponential_weibull", "constant_removal"]).select("series_id", "model_id", "warning", "success")


# --- scores and selection -----------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, f = fits_of(spark, sf_dir, models=CATALOG)
    f = stored(f, "fits")  # read by scores, milestones and curves
    return c, f, score.score_fits(c, f, CATALOG)


@query(f"{SCORED} select series_id, model_id, n, {q('r2; mse; aic; aicc')}, criterion from scored")
def score_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir)[2].select("series_id", "model_id", "n", "r2", "mse", "aic", "aicc", "criterion"))


@query(f"{SCORED} select series_id, model_id, {q('aicc as score')}, cast(row_number() over (partition by series_id order by aicc, model_id) as integer) as rank from scored")
def rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.rank_models(_scored(spark, sf_dir)[2]).select("series_id", "model_id", "score", "rank"))


@query(f"with {base_sql()}, n as (select *, count(*) over (partition by series_id) as n from cum) select series_id, t, t <= n - 5 as is_train, t <= floor(n * 0.8) as in_ratio from n")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    a = score.split_last_n(c, 5).select("series_id", "t", "is_train")
    return a.join(score.split_by_ratio(c, 0.8).select("series_id", "t", F.col("is_train").alias("in_ratio")), ["series_id", "t"])


_TRAIN = f"""{base_sql()}, train as (select c.* from cum c join stats using (series_id) where t <= n - 5),
tstats as (select series_id, cast(count(*) as double) as n, greatest(max(y), 1.0) as "Y" from train group by 1)"""
HELD = f"""{fits_sql(models=CATALOG, source='train', stats='tstats', base=_TRAIN)},
test as (select f.series_id, f.model_id, c.t, c.y, {_case('mean', CATALOG, t='c.t')} as m from fits f join cum c using (series_id) join (select series_id, n from stats) z using (series_id) where c.t > n - 5),
metrics as (select series_id, model_id, count(*) as n_test, avg(power(y - m, 2)) as mse, avg(abs(y - m)) as mae, avg(100 * abs((y - m) / y)) filter (where abs(y) >= 1e-6) as mape from test group by 1, 2)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score.split_last_n(cum(spark, sf_dir), 5)
    return score.holdout_metrics(s, fit.fit_all(s.where("is_train"), CATALOG), CATALOG)


@query(f"{HELD} select series_id, model_id, n_test, {q('mse; mae; mape')} from metrics")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_held(spark, sf_dir).select("series_id", "model_id", "n_test", "mse", "mae", "mape"))


@query(f"{HELD} select series_id, arg_min(model_id, mape) as model_id, {q('min(mape) as mape')}, count(*) filter (where mape > 50) as n_poor from metrics group by 1")
def best_by_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.best_by_mape(_held(spark, sf_dir)))


WEIGHTS = f"""{SCORED}, delta as (select *, aicc - min(aicc) over (partition by series_id) as delta from scored),
weights as (select series_id, model_id, delta, exp(-delta / 2) / sum(exp(-delta / 2)) over (partition by series_id) as weight from delta)"""


@query(f"{WEIGHTS} select series_id, model_id, {q('delta; weight')} from weights")
def aic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(score.aic_weights(_scored(spark, sf_dir)[2]))


@query(f"""{WEIGHTS}, s as (select series_id, t, sum(weight * m) as m, sum(weight * m * m) as mm, count(*) filter (where weight > 0.01) as n_effective from pred join weights using (series_id, model_id) group by 1, 2)
select series_id, t, {q('m; sqrt(greatest(0, mm - m * m)) as sd', 4)}, n_effective from s""")
def average_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f, s = _scored(spark, sf_dir)
    return rounded(score.average_predictions(curves.evaluate(f, c, CATALOG), score.aic_weights(s)).select("series_id", "t", "m", "sd", "n_effective"), 4)


@query(f"""{SCORED}, h as (select * from ({HELD} select series_id, model_id, mape from metrics)), w as (select s.*, y_last, mape, avg(mape) over (partition by series_id) as mean_mape, min(mape) over (partition by series_id) as least_mape
  from scored s join (select series_id, arg_max(y, t) as y_last from cum group by 1) using (series_id) left join h using (series_id, model_id))
select series_id, model_id, concat_ws(',', case when n < 7 then 'few_days' end, case when n < 3 * k then 'few_days_for_parameters' end, case when y_last < 20 then 'few_bugs' end, case when mape > 100 then 'error_over_100' when mape > 50 then 'error_over_50' end,
  case when mape > 1.5 * mean_mape and mape > 2 * least_mape then 'error_over_average' end, case when mape > 1.3 * least_mape then 'error_over_best' end, case when r2 < 0.9 then 'low_r2' end) as warnings from w""")
def fit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, s = _scored(spark, sf_dir)
    return score.warnings(s, _held(spark, sf_dir), series.shape(c)).select("series_id", "model_id", F.concat_ws(",", "warnings").alias("warnings"))


# --- prediction ---------------------------------------------------------------------------------------------------------


@query(f"""{fits_sql()}, h as (select series_id, unnest(range(1, cast(2 * n as bigint) + 1)) as d from stats), t as (select series_id, cast(d as double) as t from h),
p as (select f.series_id, f.model_id, t.t, {MEAN} as m, {TOTAL} as total from fits f join t using (series_id))
select p.series_id, p.model_id, p.t, c.y as actual, {q('m; total; total - m as remaining')} from p left join cum c on p.series_id = c.series_id and p.t = c.t""")
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(predict.forecast(c, f, MODELS))


_MS = f"""{fits_sql()}, r as (select f.series_id, f.model_id, params, {TOTAL} as total, ratio, ratio * {TOTAL} as target, n, y_n from fits f join stats using (series_id) cross join (select unnest([0.9, 0.95, 0.99, 0.999]) as ratio) where model_id = 'exponential'),
ms as (select r.*, y_n >= target as already_reached, case when y_n >= target then (select min(t) from cum c where c.series_id = r.series_id and c.y >= r.target) else -ln(1 - target / params[1]) / params[2] end as day from r)"""


@query(f"{_MS} select series_id, model_id, cast(ratio as double) as ratio, {q('target')}, already_reached, {q('day')}, {q('case when already_reached then 0 else day - n end as remaining_days')}, cast(start_date + cast(floor(day) - 1 as integer) as date) as date from ms join series using (series_id)")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    out = predict.milestones(c, f.where("model_id = 'exponential'"), ["exponential"], series=series_table(obs(spark, sf_dir)))
    return rounded(out)


@query(f"{_MS} select series_id, cast(ratio as double) as ratio, {q('day', 4)} from ms")
def milestones_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(predict.milestones(c, f.where("model_id = 'exponential'"), ["exponential"], closed=False).select("series_id", "ratio", "day"), 4)


_A, _B, _C = ("params[1]", "params[2]", "params[3]")
#: The curves' inverses by hand; the delayed S-curve, which has none, by bisection.
_INVERSE = {
    "exponential": f"-ln(1 - target / {_A}) / {_B}", "gompertz": f"-ln(-ln(target / {_A}) / {_B}) / {_C}", "shifted_gompertz": f"-ln(-ln(target / {_A} + exp(-{_B})) / {_B}) / {_C}",
    "ohba_weibull": f"pow(-ln(1 - target / {_A}) / {_B}, 1 / {_C})", "logistic": f"{_C} - ln({_A} / target - 1) / {_B}", "pham_imperfect": f"-ln(({_A} - target) / ({_A} + {_C} * target)) / {_B}",
    "weibull_imperfect": f"pow(-ln(1 - target / ({_A} - params[4] * target)) / {_B}, 1 / {_C})",
    "delayed_s": f"list_reduce(list_prepend({{'lo': 0.0::double, 'hi': 10000.0::double}}, list_transform(range(0, 80), lambda i: {{'lo': 0.0::double, 'hi': 0.0::double}})), lambda s, x: case when {_A} * (1 - (1 + {_B} * (s.lo + s.hi) / 2) * exp(-{_B} * (s.lo + s.hi) / 2)) < target then {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} else {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} end).lo",
}


def milestones_sql(ratios: str) -> str:
    """CTE ms of all models over scored."""
    solved = "case model_id " + " ".join(f"when '{m}' then {x}" for m, x in _INVERSE.items()) + " end"
    return f"""aims as (select s.series_id, s.model_id, params, {_case('total', CATALOG)} as total, ratio, ratio * {_case('total', CATALOG)} as target, z.y_n from scored s join stats z using (series_id) cross join (select unnest({ratios}) as ratio)),
ms as (select *, case when y_n >= target then (select min(t) from cum c where c.series_id = a.series_id and c.y >= a.target) else {solved} end as day from aims a)"""


WEIGHED = WEIGHTS + ", " + milestones_sql("[0.8, 0.9, 0.95, 0.99]")


@query(f"""{WEIGHED}, g as (select series_id, ratio, sum(weight * day) / sum(weight) as day, sum(weight * day * day) / sum(weight) as dd, count(*) as n_models from ms join weights using (series_id, model_id) where day is not null group by 1, 2)
select series_id, cast(ratio as double) as ratio, {q('day; sqrt(greatest(0, dd - day * day)) as sd; day - sqrt(greatest(0, dd - day * day)) as low; day + sqrt(greatest(0, dd - day * day)) as high', 3)}, n_models from g""")
def average_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f, s = _scored(spark, sf_dir)
    return rounded(score.average_milestones(predict.milestones(c, f, CATALOG, (0.8, 0.9, 0.95, 0.99)), score.aic_weights(s)), 3)


@query(f"""{SCORED}, {milestones_sql('[0.95, 0.99]')}, h as (select * from ({HELD} select series_id, model_id, mse as holdout_mse, mape as holdout_mape from metrics)),
days as (select series_id, model_id, max(day) filter (where ratio = 0.95) as day95, max(day) filter (where ratio = 0.99) as day99 from ms group by 1, 2)
select series_id, model_id, {q("r2; mse; aic; " + _case('total', CATALOG) + " as total; case model_id when 'pham_imperfect' then params[3] when 'weibull_imperfect' then params[4] end as p; holdout_mse; holdout_mape; loss; day95; day99", 4)}
from scored left join h using (series_id, model_id) left join days using (series_id, model_id)""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f, s = _scored(spark, sf_dir)
    return rounded(score.comparison_table(s, predict.milestones(c, f, CATALOG), _held(spark, sf_dir), CATALOG), 4)


@query()
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f, s = _scored(spark, sf_dir)
    status = series.current_status(series.running_totals(obs(spark, sf_dir)))
    sens = uncertainty.sensitivity(c, f, "exponential")
    return score.status_report(status, score.best_model(s), predict.milestones(c, f, CATALOG), score.warnings(s, bugs=series.shape(c)), CATALOG, sens, changepoint.profile_tau(c), _held(spark, sf_dir))


@query(f"""{_MS} select series_id, {q('day as day95')}, {q('total')}, case when total <= 0 then null when y_n / total >= 0.99 then 'ready' when y_n / total >= 0.95 then 'beta' when y_n / total >= 0.9 then 'converging' else 'open' end as grade from ms where ratio = 0.95""")
def flagship_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events to daily counts to a fitted curve, the day by which 95 % will have been found, and the grade, one row per series."""
    c = cum(spark, sf_dir)
    f = fit.fit_profile(c, "exponential")
    m = predict.milestones(c, f, ["exponential"], (0.95,)).select("series_id", F.col("day").alias("day95"), (F.col("target") / 0.95).alias("total"))
    last = c.groupBy("series_id").agg(F.max_by("y", "t").alias("y_n"))
    return rounded(m.join(last, "series_id").select("series_id", "day95", "total", series.convergence_grade(F.col("y_n"), F.col("total")).alias("grade")))


# --- change points ------------------------------------------------------------------------------------------------------


@query(f"""with {base_sql('change')}, d as (select *, (y - lag(y, 5) over w) / 5 as before, (lead(y, 5) over w - y) / 5 as after, count(*) over (partition by series_id) as n from cum window w as (partition by series_id order by t)),
b as (select * from d where n >= 11 and abs(after - before) / greatest(0.1, abs(before)) > 0.3),
picks as (select series_id, list_reduce(list_prepend([]::double[], list([t] order by t)), lambda a, x: case when len(a) = 0 or x[1] - a[len(a)] > 5 then list_concat(a, x) else a end) as taken from b group by 1)
select series_id, t, {q('before; after; abs(after - before) / greatest(0.1, abs(before)) as change')}, list_contains(taken, t) as picked from b join picks using (series_id)""")
def slope_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(changepoint.slope_breaks(cum(spark, sf_dir, "change")))


_CP = curves.MODELS["exp_change_point"]
_CP_MEAN = formulas.formula("exp_change_point", "mean", tau="tau")


@query(f"""with {base_sql('change')}, {_points_sql(['exp_change_point'])}, s as (select p.series_id, tau, sum(power(y - {_CP_MEAN}, 2)) as sse
  from points p join cum c using (series_id) join (select series_id, unnest(range(3, cast(n as bigint) - 3)) as tau from stats) x using (series_id) group by 1, 2)
select series_id, cast(tau as double) as tau, {q('sse')}, row_number() over (partition by series_id order by sse, tau) = 1 as best from s""")
def scan_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir, "change")
    return rounded(changepoint.scan_tau(c, _points(c, ["exp_change_point"]), "exp_change_point"))


_GRID = 16
_FIRST, _SECOND = "(1 - exp(-b1 * least(t, tau)))", "(1 - exp(-b2 * greatest(t - tau, 0)))"
def _profile(source: str = "cum", stats: str = "stats", p: str = "") -> str:
    """CTE profile, all names with a prefix: every place of a change point, fitted to a table of days."""
    return f"""
{p}grid as (select i, j, 0.001 + 0.999 * i / {_GRID}.0 as b1, 0.001 + 0.999 * j / {_GRID}.0 as b2 from (select unnest(range(1, {_GRID + 1})) as i), (select unnest(range(1, {_GRID + 1})) as j)),
{p}taus as (select series_id, unnest(range(3, cast(n as bigint) - 2)) as tau from {stats}),
{p}g as (select c.series_id, tau, i, j, y, {_FIRST} as g1, {_SECOND} as g2 from {source} c join {p}taus using (series_id) cross join {p}grid),
{p}s as (select series_id, tau, i, j, sum(g1*g1) as s11, sum(g1*g2) as s12, sum(g2*g2) as s22, sum(y*g1) as y1, sum(y*g2) as y2, sum(y*y) as yy from {p}g group by 1, 2, 3, 4),
{p}b as (select s.*, n, 1.0 as lo, 3 * "Y" as hi, s11 * s22 - s12 * s12 as det from {p}s s join {stats} using (series_id)),
{p}c5 as (select *, unnest([1, 2, 3, 4, 5]) as e from {p}b),
{p}x as (select *, case e when 1 then (y1 * s22 - y2 * s12) / nullif(det, 0) when 2 then lo when 3 then hi when 4 then least(greatest((y1 - lo * s12) / nullif(s11, 0), lo), hi) else least(greatest((y1 - hi * s12) / nullif(s11, 0), lo), hi) end as a1,
  case e when 1 then (y2 * s11 - y1 * s12) / nullif(det, 0) when 2 then least(greatest(coalesce((y2 - lo * s12) / nullif(s22, 0), lo), lo), hi) when 3 then least(greatest(coalesce((y2 - hi * s12) / nullif(s22, 0), lo), lo), hi) when 4 then lo else hi end as a2 from {p}c5),
{p}every as (select *, yy - 2*a1*y1 - 2*a2*y2 + a1*a1*s11 + 2*a1*a2*s12 + a2*a2*s22 as loss, 0.001 + 0.999 * i / 16.0 as b1, 0.001 + 0.999 * j / 16.0 as b2 from {p}x where e > 1 or (det > 0 and a1 between lo and hi and a2 between lo and hi)),
{p}l as (select series_id, tau, n, min(loss) as loss, arg_min([a1, b1, a2, b2, tau], loss) as params from {p}every group by 1, 2, 3),
{p}profile as (select series_id, tau, params, loss, n * ln(loss / n) + 10 + 60.0 / (n - 6) as aicc from {p}l)"""


_PROFILE = f"with {base_sql('change')},{_profile()}"


@query(f"{_PROFILE} select series_id, cast(tau as double) as tau, {q('loss; aicc', 5)}, row_number() over (partition by series_id order by aicc, tau) = 1 as best from profile")
def profile_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = changepoint.profile_tau(cum(spark, sf_dir, "change"))
    return rounded(p.select("series_id", "tau", "loss", "aicc", "best"), 5)


@query(f"""{_PROFILE}, v as (select series_id, list_sort(list(aicc)) as v from profile group by 1), gaps as (select series_id, v[len(v) // 2 + 1] - v[1] as gap from v)
select series_id, {q('gap', 5)}, case when gap > 10 then 'high' when gap > 4 then 'medium' when gap > 2 then 'low' else 'very_low' end as grade from gaps""")
def tau_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(changepoint.tau_reliability(changepoint.profile_tau(cum(spark, sf_dir, "change"))), 5)


@query(f"""{_PROFILE} select series_id, 'exp_change_point' as model_id, {q('; '.join(f'arg_min(params[{i + 1}], aicc) as {p}' for i, p in enumerate(['a1', 'b1', 'a2', 'b2', 'tau'])) + '; arg_min(loss, aicc) as loss', 4)} from profile group by 1""")
def fit_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = changepoint.fit_change_point(cum(spark, sf_dir, "change"))
    return rounded(f.select("series_id", "model_id", *(F.col("params")[i].alias(p) for i, p in enumerate(("a1", "b1", "a2", "b2", "tau"))), "loss"), 4)


@query(f"""{_PROFILE},
train as (select c.* from cum c join stats using (series_id) where t <= n - 5),
tstats as (select series_id, cast(count(*) as double) as n, greatest(max(y), 1.0) as "Y" from train group by 1),{_profile("train", "tstats", "t_")},
held as (select series_id, arg_min(params, aicc) as params from t_profile group by 1),
errors as (select c.series_id, avg(power(y - m, 2)) as mse, avg(100 * abs((y - m) / y)) as mape from (select c.series_id, c.y, {formulas.formula('exp_change_point', 'mean')} as m from cum c join held using (series_id) join (select series_id, n from stats) z using (series_id) where t > n - 5) c group by 1),
best as (select series_id, cast(arg_min(tau, aicc) as double) as tau, min(loss) as loss, list_sort(list(aicc)) as v from profile group by 1),
fitted as (select series_id, arg_min(loss, aicc) as loss from profile group by 1)
select series_id, b.tau, {q('f.loss as loss; v[len(v) // 2 + 1] - v[1] as gap; mse as holdout_mse; mape as holdout_mape', 4)} from best b join fitted f using (series_id) join errors using (series_id)""")
def change_point_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the best change point with its reliability and hold-out errors; milestones and sensitivities are in the operator's result."""
    r = changepoint.change_point_report(cum(spark, sf_dir, "change"))
    return rounded(r.select("series_id", "tau", "loss", "gap", "holdout_mse", "holdout_mape"), 4)


_STRETCHES = f"""with {base_sql('change')},
d as (select *, y - coalesce(lag(y) over (partition by series_id order by t), 0) as dy from cum),
f as (select series_id, sum({formulas._named(formulas.LF, {'x': 'dy'})}) as fact from d group by 1),
days as (select series_id, t, y, sum(dy * t) over (partition by series_id order by t) as at from d union all select series_id, 0, 0, 0 from stats),
rates as (select 0.001 + 0.999 * i / 100.0 as b from (select unnest(range(1, 101)) as i)),
pairs as (select o.series_id, o.t as i, e.t as j, e.y - o.y as k, e.at - o.at - o.t * (e.y - o.y) as s from days o join days e on o.series_id = e.series_id and e.t >= o.t + 2),
tried as (select p.*, b, greatest(least(k / (1 - exp(-b * (j - i))), 2 * "Y"), 1.0) as a from pairs p join stats using (series_id) cross join rates),
seg as materialized (select series_id, i, j, max(k * ln(a * (exp(b) - 1)) - b * s - a * (1 - exp(-b * (j - i)))) as l from tried group by 1, 2, 3),
ends as (select series_id, n from stats)"""


@query(f"""{_STRETCHES},
one as (select p.series_id, 1 as points, p.j as t1, null as t2, null as t3, p.l + q.l as l from seg p join seg q on p.series_id = q.series_id and p.j = q.i join ends e on q.series_id = e.series_id and q.j = e.n where p.i = 0),
two as (select p.series_id, 2, p.j, q.j, null, p.l + q.l + r.l as l from seg p join seg q on p.series_id = q.series_id and p.j = q.i join seg r on q.series_id = r.series_id and q.j = r.i join ends e on r.series_id = e.series_id and r.j = e.n where p.i = 0),
three as (select p.series_id, 3, p.j, q.j, r.j, p.l + q.l + r.l + s.l as l from seg p join seg q on p.series_id = q.series_id and p.j = q.i join seg r on q.series_id = r.series_id and q.j = r.i join seg s on r.series_id = s.series_id and r.j = s.i
  join ends e on s.series_id = e.series_id and s.j = e.n where p.i = 0),
every as (select * from one union all select * from two union all select * from three),
best as (select series_id, points, max(l) as l from every group by 1, 2),
scored as (select series_id, points, 3 * points + 2 as k, n, fact - l as loss from best join f using (series_id) join ends using (series_id))
select series_id, cast(points as integer) as points, {q('loss; 2 * loss + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) as aicc', 5)} from scored""")
def fit_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three change points with scales of their own; the check tries every ordered choice of places."""
    return rounded(changepoint.fit_change_points(cum(spark, sf_dir, "change")).select("series_id", "points", "loss", "aicc"), 5)


@query(f"""with {base_sql('change')},
d as (select *, y - coalesce(lag(y) over (partition by series_id order by t), 0) as dy from cum),
s as (select d.series_id, d.t, d.y, n, y_n, stats."Y" as top, sum(dy * t) over (partition by d.series_id order by t) as sat, sum(dy * t) over (partition by d.series_id) as at_n from d join stats using (series_id)),
r as (select s.*, 0.001 + 0.999 * i / 100.0 as b from s cross join (select unnest(range(1, 101)) as i)),
l as (select series_id, t, n,
    max(y_n * ln(least(greatest(y_n / (1 - exp(-b * n)), top), 5 * top)) + y_n * ln(exp(b) - 1) - b * at_n - least(greatest(y_n / (1 - exp(-b * n)), top), 5 * top) * (1 - exp(-b * n))) as l0,
    max(y * ln(least(greatest(y / (1 - exp(-b * t)), 1), 3 * top)) + y * ln(exp(b) - 1) - b * sat - least(greatest(y / (1 - exp(-b * t)), 1), 3 * top) * (1 - exp(-b * t))) as la,
    max((y_n - y) * ln(least(greatest((y_n - y) / (1 - exp(-b * (n - t))), 1), 3 * top)) + (y_n - y) * ln(exp(b) - 1) - b * (at_n - sat - t * (y_n - y)) - least(greatest((y_n - y) / (1 - exp(-b * (n - t))), 1), 3 * top) * (1 - exp(-b * (n - t)))) as lb
  from r where t between 3 and n - 3 group by 1, 2, 3),
lr as (select series_id, greatest(0, 2 * (max(la + lb) - max(l0))) as lr, arg_max(t, la + lb) as tau from l group by 1)
select series_id, {q('lr', 5)}, tau from lr""")
def poisson_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood ratio itself; its simulated law is in change_point_lrt."""
    out = changepoint.poisson_lr(cum(spark, sf_dir, "change"), ["series_id"])
    return rounded(out.select("series_id", "lr", "tau"), 5)


@query()
def change_point_lrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.change_point_lrt(cum(spark, sf_dir, "change"))


# --- uncertainty --------------------------------------------------------------------------------------------------------


@query(f"""{fits_sql()}, m0 as (select f.series_id, params, n, params[1] as base from fits f join stats using (series_id) where model_id = 'exponential'),
e as (select series_id, unnest(['a', 'b']) as param, base, unnest([1.0, 0.0]) as elasticity, unnest([1.0, 0.0]) as sensitivity from m0)
select series_id, param, {q('base; sensitivity; elasticity')}, case when abs(elasticity) < 1 then 'low' else 'medium' end as grade, case when elasticity > 0.1 then 'up' else 'flat' end as direction
from (select series_id, param, base, elasticity, sensitivity * (base * 1.01 - base * 0.99) / (0.02 * base) as sensitivity from e)""")
def sensitivity_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    s = uncertainty.sensitivity(c, f, "exponential")
    # 1.01 times the least value of the box is on the border of two grades
    return rounded(s.select("series_id", "param", "base", "sensitivity", F.round("elasticity", 9).alias("elasticity")).withColumns({"grade": F.when(F.abs("elasticity") < 1, "low").otherwise("medium"), "direction": F.when(F.col("elasticity") > 0.1, "up").otherwise("flat")}))


@query(f"""{fits_sql()}, v as (select series_id, params[2] as b from fits where model_id = 'exponential')
select series_id, {q('-ln(0.05) / b as base; (-ln(0.05) / (1.01 * b) + ln(0.05) / (0.99 * b)) / (0.02 * b) as sensitivity; (1 / 1.01 - 1 / 0.99) / 0.02 as elasticity', 5)}, case when abs((1 / 1.01 - 1 / 0.99) / 0.02) < 1 then 'low' else 'medium' end as grade, 'down' as direction from v""")
def sensitivity_own_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day by which 95 % are found, as a metric of one's own."""
    c, f = fits_of(spark, sf_dir)
    s = uncertainty.sensitivity(c, f, "exponential", "day95", value="-ln(0.05D)/b").where("param = 'b'")
    return rounded(s.select("series_id", "base", "sensitivity", "elasticity", "grade", "direction"), 5)


_SENS = "params[1] * (1 - exp(-{b} * n))"


@query(f"""{fits_sql()}, v as (select f.series_id, params[2] as b, {_SENS.format(b='params[2]')} as base, {_SENS.format(b='(params[2] * 1.01)')} as up, {_SENS.format(b='(params[2] * 0.99)')} as down from fits f join stats using (series_id) where model_id = 'exponential')
select series_id, {q('base; (up - down) / (0.02 * b) as sensitivity; (up - down) / 0.02 / base as elasticity')} from v""")
def sensitivity_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(uncertainty.sensitivity(c, f, "exponential", "m_n").where("param = 'b'").select("series_id", "base", "sensitivity", "elasticity"))


@query(f"""with {base_sql('sshape')}, {_points_sql(['exponential'])}, reps as (select unnest(range(1, 21)) as rep),
base as (select c.series_id, c.t, c.y, {_case('mean', ['exponential'])} as m from points p join cum c using (series_id)),
pool as (select series_id, list(y - m order by t) as pool from base group by 1),
u as (select b.*, rep, cast(('0x' || substr(md5(concat_ws('|', '1', b.series_id, rep::varchar, cast(cast(b.t as integer) as varchar))), 1, 8)) as ubigint)::double / 4294967296.0 as u from base b cross join reps)
select u.series_id, cast(rep as integer) as rep, t, {q('greatest(0.0, m + pool[cast(floor(u * len(pool)) as bigint) + 1]) as y')} from u join pool using (series_id)""")
def pseudo_series_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir, "sshape")
    return rounded(uncertainty.pseudo_series_residual(c, _points(c, ["exponential"]), "exponential", 20).select("series_id", "rep", "t", "y"))


@query(f"""with {base_sql()}, {_points_sql(['exponential'])}, reps as (select unnest(range(1, 21)) as rep),
m as (select c.series_id, c.t, {_case('mean', ['exponential'])} as m from points p join cum c using (series_id)),
l as (select series_id, t, greatest(m - coalesce(lag(m) over (partition by series_id order by t), 0), 0.1) as lam from m),
u as (select l.*, rep, cast(('0x' || substr(md5(concat_ws('|', '1', l.series_id, rep::varchar, cast(cast(l.t as integer) as varchar))), 1, 8)) as ubigint)::double / 4294967296.0 as u from l cross join reps),
k as (select unnest(range(0, 61)) as k),
p as (select series_id, t, k, sum(exp(-lam + k * ln(lam) - (case when k < 2 then 0 else list_sum(list_transform(range(2, k + 1), lambda i: ln(i))) end))) over (partition by series_id, t order by k) as cdf from l cross join k),
d as (select u.series_id, rep, u.t, min(k) as d from u join p on u.series_id = p.series_id and u.t = p.t and p.cdf > u.u group by 1, 2, 3)
select series_id, cast(rep as integer) as rep, t, cast(sum(d) over (partition by series_id, rep order by t) as double) as y from d""")
def pseudo_series_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return uncertainty.pseudo_series_poisson(c, _points(c, ["exponential"]), "exponential", 20, min_lambda=0.1).select("series_id", "rep", "t", "y")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals as samples: a table of any size to take bands of."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("series_id"), F.month("o_orderdate").cast("double").alias("t"), F.col("o_totalprice").cast("double").alias("m"))


@query(f"""with s as (select o_orderpriority as series_id, cast(month(o_orderdate) as double) as t, list_sort(list(cast(o_totalprice as double))) as v from orders group by 1, 2)
select series_id, t, v[cast(round_even((len(v) - 1) * 0.025, 0) as bigint) + 1] as lower, v[cast(round_even((len(v) - 1) * 0.975, 0) as bigint) + 1] as upper, cast(len(v) as integer) as n_reps from s""")
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uncertainty.band(_samples(spark, sf_dir))


@query()
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return uncertainty.confidence_band(c, f, "exponential")


@query()
def prediction_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return uncertainty.prediction_band(c, f, "exponential")


_H = "(select f.series_id, params[1] as a, params[2] as b, t, y from fits f join cum c using (series_id) where model_id = 'exponential')"


@query(f"""{fits_sql()}, s as (select series_id, count(*) as n, sum(power(y - a * (1 - exp(-b * t)), 2)) as sse,
  sum(2 * power(1 - exp(-b * t), 2)) as haa, sum(2 * (a * t * exp(-b * t) * (1 - exp(-b * t)) - (y - a * (1 - exp(-b * t))) * t * exp(-b * t))) as hab,
  sum(2 * (power(a * t * exp(-b * t), 2) + (y - a * (1 - exp(-b * t))) * a * t * t * exp(-b * t))) as hbb from {_H} group by 1)
select series_id, round(sqrt(2 * sse / (n - 2) * hbb / (haa * hbb - hab * hab)), 2) as se_a, round(sqrt(2 * sse / (n - 2) * haa / (haa * hbb - hab * hab)), 4) as se_b from s""")
def param_standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    e = uncertainty.param_standard_errors(c, f, "exponential", "sse")
    by = e.groupBy("series_id").agg(*(F.max(F.when(F.col("param") == p, F.col("se"))).alias(f"se_{p}") for p in "ab"))
    return by.select("series_id", F.round("se_a", 2).alias("se_a"), F.round("se_b", 4).alias("se_b"))


def _square(da: int, db: int) -> str:
    return f"sum(power(y - (a + {da} * ha) * (1 - exp(-(b + {db} * hb) * t)), 2))"


@query(f"""{fits_sql()}, d as (select f.series_id, params[1] as a, params[2] as b, greatest(1e-4, params[1] * 1e-4) as ha, greatest(1e-4, params[2] * 1e-4) as hb, t, y from fits f join cum c using (series_id) where model_id = 'exponential'),
s as (select series_id, any_value(a) as a, any_value(b) as b, 2 * {_square(0, 0)} / (count(*) - 2) as scale, ({_square(2, 0)} - 2 * {_square(0, 0)} + {_square(-2, 0)}) / (4 * any_value(ha * ha)) as haa,
  ({_square(1, 1)} - {_square(1, -1)} - {_square(-1, 1)} + {_square(-1, -1)}) / (4 * any_value(ha * hb)) as hab, ({_square(0, 2)} - 2 * {_square(0, 0)} + {_square(0, -2)}) / (4 * any_value(hb * hb)) as hbb from d group by 1),
v as (select series_id, c.t, a * (1 - exp(-b * c.t)) as m, scale / (haa * hbb - hab * hab) * (power(1 - exp(-b * c.t), 2) * hbb - 2 * (1 - exp(-b * c.t)) * a * c.t * exp(-b * c.t) * hab + power(a * c.t * exp(-b * c.t), 2) * haa) as var from s join cum c using (series_id))
select series_id, t, {q('m; m - 1.959963984540054 * sqrt(greatest(var, 0)) as lower; m + 1.959963984540054 * sqrt(greatest(var, 0)) as upper', 3)} from v""")
def delta_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = fits_of(spark, sf_dir)
    return rounded(uncertainty.delta_band(c, f, "exponential"), 3)


# --- diagnostics --------------------------------------------------------------------------------------------------------

_W = "(partition by series_id, model_id order by t)"
RES = f"""with {base_sql()}, {_points_sql(SIX)},
ed as (select p.series_id, p.model_id, c.t, c.y, {_case('mean', SIX)} as m from points p join cum c using (series_id)),
ex as (select *, y - coalesce(lag(y) over {_W}, 0) as dy, m - coalesce(lag(m) over {_W}, 0) as lam from ed),
res as (select *, dy - lam as raw, case when lam > 0 then (dy - lam) / sqrt(lam) else 0 end as pearson,
  case when lam > 0 then sign(dy - lam) * sqrt(greatest(case when dy > 0 then 2 * (dy * ln(dy / lam) - (dy - lam)) else 2 * lam end, 0)) else 0 end as deviance,
  case when lam > 0 then 1.5 * (power(greatest(dy, 0), 2.0 / 3) - power(lam, 2.0 / 3)) / power(lam, 1.0 / 6) else 0 end as anscombe, y - m as cumulative from ex)"""


def _res(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return diagnostics.residuals(diagnostics.expected_daily(c, _points(c, SIX), SIX))


@query(f"{RES} select series_id, model_id, t, {q('dy; lam; raw; pearson; deviance; anscombe; cumulative')} from res")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_res(spark, sf_dir).drop("y", "m"))


MOMENTS = f"""{RES}, mu as (select *, pearson - avg(pearson) over (partition by series_id, model_id) as d from res),
mm as (select series_id, model_id, cast(count(*) as double) as n, avg(pearson) as mean, avg(d*d) as m2, avg(d*d*d) as m3, avg(d*d*d*d) as m4 from mu group by 1, 2),
mom as (select series_id, model_id, n, mean, sqrt(m2 * n / (n - 1)) as sd, m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) as skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) as kurt from mm)"""


@query(f"{MOMENTS} select series_id, model_id, {q('mean; sd; skew; kurt')} from mom")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.moments(_res(spark, sf_dir)).drop("n"))


@query(f"{MOMENTS} select series_id, model_id, {q('n / 6 * (skew * skew + kurt * kurt / 4) as jb; greatest(0.0001, exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)) as p_value')} from mom where n >= 8")
def jarque_bera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.jarque_bera(diagnostics.moments(_res(spark, sf_dir))))


@query(f"{MOMENTS} select series_id, model_id, t, {q('(pearson - mean) / sd as z')} from res join mom using (series_id, model_id) where abs((pearson - mean) / sd) > 2")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.outliers(_res(spark, sf_dir)).select("series_id", "model_id", "t", "z"))


def normal_sql(z: str) -> str:
    """The normal distribution function by its series in z."""
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1)))))"


def chi2_tail_sql(x: str, df: str) -> str:
    """The upper tail for any number of degrees of freedom, by the series of the lower incomplete gamma function."""
    return f"case when ({x}) > 1200 then 0.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 500), lambda k: exp(-({x}) / 2 + (({df}) / 2.0 + k) * ln(greatest(({x}) / 2, 1e-300)) - lgamma(({df}) / 2.0 + k + 1))))) end"


def runs_sql(column: str) -> str:
    """CTE runs over res."""
    return f"""turns as (select series_id, model_id, {column} > 0 as up, coalesce(cast(({column} > 0) <> lag({column} > 0) over {_W} as integer), 1) as turn from res),
runs0 as (select series_id, model_id, count(*) filter (where up) as n_pos, count(*) filter (where not up) as n_neg, cast(sum(turn) as bigint) as runs from turns group by 1, 2),
runs1 as (select *, 1 + 2.0 * n_pos * n_neg / (n_pos + n_neg) as expected_runs, 2.0 * n_pos * n_neg * (2.0 * n_pos * n_neg - n_pos - n_neg) / (power(n_pos + n_neg, 2) * (n_pos + n_neg - 1)) as v from runs0),
runs2 as (select *, case when n_pos > 0 and n_neg > 0 and v > 0 then (runs - expected_runs) / sqrt(v) end as z from runs1),
runs3 as (select *, case when n_pos = 0 or n_neg = 0 then 0.0 when z is null then 1.0 else 2 * (1 - {normal_sql('abs(z)')}) end as p_value from runs2),
runs as (select *, case when n_pos = 0 or n_neg = 0 then 'one_sign' when p_value < 0.05 and z < 0 then 'clustered' when p_value < 0.05 then 'alternating' else 'none' end as pattern from runs3)"""


@query(f"{RES}, {runs_sql('raw')} select series_id, model_id, n_pos, n_neg, runs, {q('expected_runs; z; p_value')}, pattern from runs")
def runs_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.runs_test(_res(spark, sf_dir)))


@query(f"""{RES}, g as (select series_id, model_id, sum(power(dy - lam, 2) / lam) filter (where lam > 0) as chi2, count(*) filter (where lam > 0) - 2 as df from res group by 1, 2),
o as (select *, chi2 / df as phi, {chi2_tail_sql('chi2', 'df')} as p_value from g)
select series_id, model_id, {q('chi2; phi; p_value')}, df, phi > 1.5 and p_value < 0.05 as over,
  case when phi < 0.8 then 'under' when phi <= 1.2 then 'none' when phi <= 1.5 then 'slight' when phi <= 3 then 'moderate' else 'strong' end as grade from o""")
def overdispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.overdispersion(_res(spark, sf_dir), 2))


@query(f"""{RES}, g as (select series_id, model_id, count(*) as n, count(*) filter (where lam < 5) as small, count(*) filter (where dy = 0) as zeros, sum(exp(-greatest(lam, 0))) as e0 from res group by 1, 2)
select series_id, model_id, concat_ws(',', case when n < 10 then 'few_days' end, case when small > 0.3 * n then 'small_means' end, case when zeros > 1.5 * e0 and zeros > 3 then 'many_zeros' end) as warnings from g""")
def poisson_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.poisson_warnings(_res(spark, sf_dir)).select("series_id", "model_id", F.concat_ws(",", "warnings").alias("warnings"))


def durbin_sql(column: str) -> str:
    """CTE dws over res."""
    return f"""dwd as (select series_id, model_id, {column} as x, {column} - lag({column}) over {_W} as d from res),
dws as (select series_id, model_id, sum(d * d) / sum(x * x) as dw from dwd group by 1, 2)"""


@query(f"""{RES}, {durbin_sql('raw')} select series_id, model_id, {q('dw')},
  case when dw < 1 then 'strong_positive' when dw < 1.5 then 'positive' when dw <= 2.5 then 'none' when dw <= 3 then 'negative' else 'strong_negative' end as band from dws""")
def durbin_watson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.durbin_watson(_res(spark, sf_dir)))


def acf_sql(column: str) -> str:
    """CTEs acf and lb (Ljung-Box) over res."""
    return f"""ac as (select series_id, model_id, t, {column} - avg({column}) over (partition by series_id, model_id) as d, count(*) over (partition by series_id, model_id) as n from res),
acf as (select a.series_id, a.model_id, k as lag, a.n, sum(a.d * b.d) / any_value(v.v) as r from ac a cross join (select unnest(range(1, 11)) as k) join ac b on a.series_id = b.series_id and a.model_id = b.model_id and b.t = a.t - k
  join (select series_id, model_id, sum(d * d) as v from ac group by 1, 2) v on a.series_id = v.series_id and a.model_id = v.model_id
  where k <= least(10, a.n // 4, a.n - 2) group by 1, 2, 3, 4),
lb0 as (select series_id, model_id, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) as q, count(*) as df from acf group by 1, 2),
lb as (select *, {chi2_tail_sql('q', 'df')} as p_value from lb0)"""


ACF = f"{RES}, {acf_sql('raw')}"


@query(f"{ACF} select series_id, model_id, cast(lag as integer) as lag, {q('r')}, abs(r) > 1.96 / sqrt(n) as significant from acf")
def acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.acf(_res(spark, sf_dir)).drop("n"))


@query(f"{ACF} select series_id, model_id, {q('q; p_value')}, df from lb")
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.ljung_box(diagnostics.acf(_res(spark, sf_dir))))


ANDERSON = f"""adz as (select series_id, model_id, (pearson - avg(pearson) over w) / stddev_samp(pearson) over w as z, row_number() over (partition by series_id, model_id order by pearson, t) as i, count(*) over w as n from res window w as (partition by series_id, model_id)),
adp as (select *, least(greatest({normal_sql('z')}, 1e-10), 1 - 1e-10) as p from adz where n >= 8),
ada as (select series_id, model_id, (-n - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / n) * (1 + 0.75 / n + 2.25 / (n * n)) as a2 from adp group by series_id, model_id, n),
ad as (select *, least(1.0, greatest(0.0, case when a2 >= 10 then 0.0001 when a2 >= 0.6 then exp(1.2937 - 5.709 * a2 + 0.0186 * a2 * a2) when a2 >= 0.34 then exp(0.9177 - 4.279 * a2 - 1.38 * a2 * a2)
  when a2 >= 0.2 then 1 - exp(-8.318 + 42.796 * a2 - 59.938 * a2 * a2) else 1 - exp(-13.436 + 101.14 * a2 - 223.73 * a2 * a2) end)) as p_value from ada)"""


@query(f"{RES}, {ANDERSON} select series_id, model_id, {q('a2; p_value')} from ad")
def anderson_darling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.anderson_darling(_res(spark, sf_dir)))


_P = "least(greatest(low + u * (high - low), 1e-10), 1 - 1e-10)"
_POISSON = lambda k: f"case when {k} < 0 then 0.0 else least(1.0, list_sum(list_transform(range(0, cast({k} as bigint) + 1), lambda i: exp(-l + i * ln(l) - lgamma(i + 1))))) end"


@query(f"""{RES}, c as (select series_id, model_id, t, dy, greatest(lam, 1e-9) as l, cast(('0x' || substr(md5(concat_ws('|', '1', series_id, model_id, cast(cast(t as integer) as varchar))), 1, 8)) as ubigint)::double / 4294967296.0 as u from res),
p as (select *, {_POISSON('dy - 1')} as low, {_POISSON('dy')} as high from c), pp as (select *, {_P} as p from p),
z as (select *, list_reduce(list_prepend({{'lo': -7.0::double, 'hi': 7.0::double}}, list_transform(range(0, 50), lambda i: {{'lo': 0.0::double, 'hi': 0.0::double}})),
  lambda s, x: case when {normal_sql('((s.lo + s.hi) / 2)')} < p then {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} else {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} end) as z from pp)
select series_id, model_id, t, {q('low; high; (z.lo + z.hi) / 2 as quantile', 5)} from z""")
def quantile_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.quantile_residuals(_res(spark, sf_dir)).select("series_id", "model_id", "t", "low", "high", "quantile"), 5)


_ONE = "{{'o': {o}, 'e': {e}, 'kept': {k}}}"
_NO_BINS = "[]::struct(o double, e double)[]"
CHI2 = f"""binned as (select series_id, model_id, dy, lam, n, bins, least(bins - 1, floor((t - 1) * bins / n)) as bin
  from (select *, greatest(2, least(greatest(5, ceil(1 + 3.322 * log10(n))), floor(n / 5))) as bins from (select *, cast(count(*) over (partition by series_id, model_id) as double) as n from res)) where n >= 10),
bin_sums as (select series_id, model_id, bin, cast(sum(dy) as double) as o, cast(sum(lam) as double) as e from binned group by 1, 2, 3),
merged as (select series_id, model_id, list_reduce(list_prepend({_ONE.format(o='0.0::double', e='0.0::double', k=_NO_BINS)}, list({_ONE.format(o='o', e='e', k=_NO_BINS)} order by bin)),
  lambda s, x: case when s.e + x.e >= 5 then {_ONE.format(o='0.0::double', e='0.0::double', k="list_append(s.kept, {'o': s.o + x.o, 'e': s.e + x.e})")} else {_ONE.format(o='s.o + x.o', e='s.e + x.e', k='s.kept')} end) as m from bin_sums group by 1, 2),
cells as (select series_id, model_id, len(m.kept) as bins, list_sum(list_transform(m.kept, lambda x, i: case when i = len(m.kept) then power(x.o + m.o - x.e - m.e, 2) / (x.e + m.e) else power(x.o - x.e, 2) / x.e end)) as chi2 from merged where len(m.kept) > 0),
gof as (select *, greatest(1, bins - 3) as df, {chi2_tail_sql('chi2', 'greatest(1, bins - 3)')} as p_chi2 from cells)"""


@query(f"{RES}, {CHI2} select series_id, model_id, {q('chi2')}, cast(bins as integer) as bins, cast(df as integer) as df, {q('p_chi2 as p_value')} from gof")
def chi_square_gof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.chi_square_gof(_res(spark, sf_dir), 2))


@query(f"{RES}, e as (select series_id, model_id, t, dy, unnest(range(0, cast(dy as bigint))) as j from res) select series_id, model_id, {q('t - 1 + (j + 0.5) / dy as t')} from e")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.event_times(_res(spark, sf_dir)).select("series_id", "model_id", "t"))


TIMES = f"""{RES}, evt as (select series_id, model_id, params, t_end, t - 1 + (j + 0.5) / dy as t from (select r.series_id, r.model_id, r.t, r.dy, p.params, n as t_end, unnest(range(0, cast(r.dy as bigint))) as j from res r join points p using (series_id, model_id) join stats using (series_id) where r.model_id = 'exponential')),
tt as (select series_id, model_id, row_number() over {_W} as i, count(*) over (partition by series_id, model_id) as n, ({formulas.formula('exponential', 'mean')}) / ({formulas.formula('exponential', 'mean', t='t_end')}) as u from evt)"""


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return diagnostics.transformed_times(c, _points(c, ["exponential"]), ["exponential"])


@query(f"""{TIMES}, d as (select series_id, model_id, n, max(greatest(abs(1.0 * i / n - u), abs((i - 1.0) / n - u))) as d from tt group by 1, 2, 3), x as (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d as x from d)
select series_id, model_id, n, {q('d')}, {q("""case when x < 0.27 then 1.0 when x < 1 then least(1, greatest(0, 1 - sqrt(2 * pi()) / x * (exp(-power(pi(), 2) / (8 * x * x)) + exp(-9 * power(pi(), 2) / (8 * x * x)) + exp(-25 * power(pi(), 2) / (8 * x * x)))))
  when x < 3.1 then least(1, greatest(0, 2 * (exp(-2 * x * x) - exp(-8 * x * x) + exp(-18 * x * x) - exp(-32 * x * x)))) else 0.0 end as p_value""")} from x where n >= 5""")
def ks_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.ks_test(_times(spark, sf_dir)).where("n >= 5"))


@query(f"""{TIMES}, w as (select series_id, model_id, n, (1 / (12.0 * n) + sum(power(u - (2.0 * i - 1) / (2.0 * n), 2))) * (1 + 0.5 / n) as w2 from tt group by 1, 2, 3)
select series_id, model_id, n, {q('w2')}, {q("""case when w2 >= 1.1 then 0.0001 else least(1, greatest(0, case when w2 < 0.0275 then 1 - exp(-13.953 + 775.5 * w2 - 12542.6 * w2 * w2) when w2 < 0.051 then 1 - exp(-5.903 + 179.5 * w2 - 1515.3 * w2 * w2)
  when w2 < 0.092 then exp(0.886 - 31.62 * w2 + 10.89 * w2 * w2) else exp(1.111 - 34.24 * w2 + 12.83 * w2 * w2) end)) end as p_value""")} from w""")
def cvm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.cvm_test(_times(spark, sf_dir)))


_KS_P = """case when n < 5 then 1.0 when x < 0.27 then 1.0 when x < 1 then least(1, greatest(0, 1 - sqrt(2 * pi()) / x * (exp(-power(pi(), 2) / (8 * x * x)) + exp(-9 * power(pi(), 2) / (8 * x * x)) + exp(-25 * power(pi(), 2) / (8 * x * x)))))
  when x < 3.1 then least(1, greatest(0, 2 * (exp(-2 * x * x) - exp(-8 * x * x) + exp(-18 * x * x) - exp(-32 * x * x)))) else 0.0 end"""
_CVM_P = """case when w2 >= 1.1 then 0.0001 else least(1, greatest(0, case when w2 < 0.0275 then 1 - exp(-13.953 + 775.5 * w2 - 12542.6 * w2 * w2) when w2 < 0.051 then 1 - exp(-5.903 + 179.5 * w2 - 1515.3 * w2 * w2)
  when w2 < 0.092 then exp(0.886 - 31.62 * w2 + 10.89 * w2 * w2) else exp(1.111 - 34.24 * w2 + 12.83 * w2 * w2) end)) end"""


@query(f"""{RES}, {CHI2},
evs as (select r.series_id, r.model_id, p.params, n as t_end, r.t - 1 + (r.j + 0.5) / r.dy as t from (select series_id, model_id, t, dy, unnest(range(0, cast(dy as bigint))) as j from res) r join points p using (series_id, model_id) join stats using (series_id)),
placed as (select series_id, model_id, row_number() over {_W} as i, count(*) over (partition by series_id, model_id) as n, least(1.0, greatest(0.0, {_case('mean', SIX)} / {_case('mean', SIX, t='t_end')})) as u from evs),
far as (select series_id, model_id, n, max(greatest(abs(1.0 * i / n - u), abs((i - 1.0) / n - u))) as d, (1 / (12.0 * n) + sum(power(u - (2.0 * i - 1) / (2.0 * n), 2))) * (1 + 0.5 / n) as w2 from placed group by 1, 2, 3),
tests as (select series_id, model_id, {_KS_P} as p_ks, {_CVM_P} as p_cvm from (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d as x from far)),
every as (select *, cast(coalesce(p_ks, 0) >= 0.05 as integer) + cast(coalesce(p_cvm, 0) >= 0.05 as integer) + cast(coalesce(p_chi2, 0) >= 0.05 as integer) >= 2 as adequate, list_sort([coalesce(p_chi2, 0), coalesce(p_ks, 0), coalesce(p_cvm, 0)])[2] as middle from tests full join gof using (series_id, model_id))
select series_id, model_id, {q('p_ks; p_cvm; p_chi2')}, adequate, case when middle >= 0.1 then 'good' when middle >= 0.05 then 'acceptable' when middle >= 0.01 then 'doubtful' else 'poor' end as label from every""")
def goodness_of_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cum(spark, sf_dir)
    return rounded(diagnostics.goodness_of_fit(c, _points(c, SIX), SIX, 2))


_DIAGNOSED = MOMENTS.removeprefix(RES)


@query(f"""{RES}{_DIAGNOSED}, {runs_sql('pearson')}, {durbin_sql('pearson')}, {acf_sql('pearson')}, {ANDERSON},
outs as (select series_id, model_id, count(*) filter (where abs((pearson - mean) / sd) > 2) as n_out from res join mom using (series_id, model_id) group by 1, 2),
every as (select m.*, pattern, dw, lb.p_value as p_lb, n_out / n as share, least(greatest(0.0001, exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)), ad.p_value) >= 0.05 as normal
  from mom m join runs using (series_id, model_id) join dws using (series_id, model_id) join lb using (series_id, model_id) join outs using (series_id, model_id) join ad using (series_id, model_id)),
costs as (select *, case when pattern <> 'none' then 30 else 0 end as c1, case when share > 0.1 then 15 when share > 0.05 then 8 else 0 end as c2, case when abs(skew) > 1 then 10 when abs(skew) > 0.5 then 5 else 0 end as c3,
  case when abs(kurt) > 3 then 10 when abs(kurt) > 1 then 5 else 0 end as c4,
  case when dw < 1.5 or dw > 2.5 or p_lb < 0.05 then (case when dw < 1 or dw > 3 then 25 when dw < 1.5 or dw > 2.5 then 15 else 0 end) + (case when p_lb < 0.01 then 10 when p_lb < 0.05 then 5 else 0 end) else 0 end as c5, case when normal then 0 else 10 end as c6 from every),
marked as (select *, cast(greatest(0, 100 - c1 - c2 - c3 - c4 - c5 - c6) as integer) as score from costs)
select series_id, model_id, score, case when score >= 85 then 'excellent' when score >= 70 then 'good' when score >= 55 then 'fair' when score >= 40 then 'poor' else 'bad' end as grade,
  concat_ws(',', case when c1 > 0 then 'pattern' end, case when c2 > 0 then 'outliers' end, case when c3 > 0 then 'skew' end, case when c4 > 0 then 'tails' end, case when c5 > 0 then 'autocorrelation' end, case when c6 > 0 then 'not_normal' end) as codes from marked""")
def diagnostic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.diagnostic_score(_res(spark, sf_dir)).withColumn("codes", F.concat_ws(",", "codes"))


@query(f"with evn as (select event_id, value from events where value is not null) select event_id, {q('case when value <= 1 then 0.0 when round(value) <= 20 then coalesce(list_sum(list_transform(range(2, cast(round(value) as bigint) + 1), lambda i: ln(i))), 0) else value * ln(value) - value + 0.5 * ln(2 * pi() * value) end as lf')} from evn")
def log_factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return rounded(e.select("event_id", F.coalesce(special.log_factorial(F.col("value")), F.lit(0.0)).alias("lf")))
