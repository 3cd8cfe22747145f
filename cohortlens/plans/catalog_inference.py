"""Queries on leave-one-out values, p-values and BCa intervals, with SQL that leaves rows out one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.distributions import chi2_sf
from ..operators import confusion as M
from ..operators import panel as P
from ..operators import resample as R
from ..operators import tables as T
from .catalog import RATED, grid_counts, panel_sql, query, r
from .catalog_cohort import boot_ctes, near
from .views import table, view

CI = ("stat", "lower", "upper")
BY_COUNT = [m for m in R.METRICS if m not in R.BY_CELL]

# ---- tails in SQL: Simpson's rule for the normal density, and a published rational approximation of its quantile


def phi_sql(z: str, steps: int = 800) -> str:
    """The normal distribution function: one half and the area from 0 to z."""
    at = f"({z}) * i / {steps}"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    area = f"list_sum(list_transform(range({steps + 1}), lambda i: {weight} * exp(-pow({at}, 2) / 2)))"
    return f"(0.5 + ({z}) / {steps} / 3 * {area} / sqrt(2 * pi()))"


def chi2_sql(x: str) -> str:
    """The tail beyond x of one degree of freedom."""
    return f"greatest(0, 2 * (1 - {phi_sql(f'sqrt({x})')}))"


# Acklam's coefficients of the normal quantile (relative error 1.2e-9).
CENTRE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
CENTRE_BELOW = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
TAIL_BELOW = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + {c!r})"
    return out


def quantile_sql(p: str) -> str:
    """The normal quantile; 0 where it is infinite."""
    centre = f"({p} - 0.5) * {_polynomial(f'pow({p} - 0.5, 2)', CENTRE)} / {_polynomial(f'pow({p} - 0.5, 2)', CENTRE_BELOW)}"
    low, high = (f"sqrt(-2 * ln({q}))" for q in (p, f"(1 - {p})"))
    tail = lambda x: f"{_polynomial(x, TAIL)} / {_polynomial(x, TAIL_BELOW)}"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -({tail(high)}) ELSE {centre} END)"


# ---- p-values

MCNEMAR = "(pow(abs(fp - fn) - 1, 2) / nullif(fp + fn, 0))"


@query("m13_mcnemar_p", f"{RATED} SELECT grp, {r(MCNEMAR, 6)} AS stat, {r(chi2_sql(MCNEMAR), 8)} AS pval FROM q", "scored_grid")
def m13p(spark: SparkSession, d: str) -> DataFrame:
    out = M.mcnemar(grid_counts(spark, d))
    return out.select("grp", S.half_even("stat", 6).alias("stat"), S.half_even(chi2_sf("stat"), 8).alias("pval"))


@query(
    "m20_panel_mcnemar",
    f"{RATED} SELECT grp, {r('se')} AS sens, {r('sp')} AS spec, {r(chi2_sql(MCNEMAR), 8)} AS mcnemar, 'grid' AS model FROM q",
    "scored_grid",
)
def m20n(spark: SparkSession, d: str) -> DataFrame:
    out = P.panel(view(spark, d, "scored_grid"), ("grp",), mcnemar=True, model="grid", only=["sens", "spec", "mcnemar", "model"])
    return out.withColumn("mcnemar", S.half_even("mcnemar", 8))


FISHER = "-2 * sum(ln(value / 500 + 1e-7))"
#: With 2k degrees of freedom the tail is a sum of k terms; with one it is that of a squared normal value.
POISSON = "list_sum(list_transform(range(k), lambda i: exp(i * ln(fisher / 2) - fisher / 2 - lgamma(i + 1))))"


@query("a15_fisher_p", f"WITH f AS (SELECT user_id, greatest({FISHER}, 0) AS fisher FROM events GROUP BY user_id) SELECT user_id, {r(chi2_sql('fisher'), 8)} AS pval FROM f")
def a15p(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.col("value") / 500).groupBy("user_id").agg(T.fisher_statistic().alias("fisher"))
    return e.select("user_id", S.half_even(chi2_sf("fisher"), 8).alias("pval"))


@query(
    "a15_fisher_p_groups",
    "WITH e AS (SELECT event_type, event_id % 50 AS cell, value FROM events WHERE value > 0), "
    f"w AS (SELECT event_type, cell, min(value) AS value FROM e GROUP BY ALL), f AS (SELECT event_type, {FISHER} AS fisher, 50 AS k FROM w GROUP BY event_type HAVING count(*) = 50) "
    f"SELECT event_type, {r('fisher', 6)} AS fisher, {r(POISSON, 8)} AS pval FROM f",
)
def a15g(spark: SparkSession, d: str) -> DataFrame:
    """Fifty p-values of each type combined, on 100 degrees of freedom."""
    e = table(spark, d, "events").where("value > 0").groupBy("event_type", (F.col("event_id") % 50).alias("cell")).agg((F.min("value") / 500).alias("p"))
    f = e.groupBy("event_type").agg(T.fisher_statistic().alias("fisher"), F.count(F.lit(1)).alias("k")).where("k = 50")
    return f.select("event_type", S.half_even("fisher", 6).alias("fisher"), S.half_even(chi2_sf("fisher", 100), 8).alias("pval"))


# ---- leave-one-out


def left_out(source: str, tag: str = "") -> str:
    """lo{tag} (rep, y, p): all rows but one, for one row of each cell (label, score); of{tag} says which and of how many."""
    return (
        f"nr{tag} AS (SELECT y, p, row_number() OVER () AS i FROM {source}), "
        f"of{tag} AS (SELECT row_number() OVER () AS rep, y AS oy, p AS op, min(i) AS out, count(*) AS weight FROM nr{tag} GROUP BY y, p), "
        f"lo{tag} AS (SELECT rep, y, p FROM nr{tag} JOIN of{tag} ON i <> out)"
    )


def unrounded(sql: str) -> str:
    """A panel's SQL with areas and operating points as they are."""
    for m in ("auc", "ap"):
        sql = sql.replace(f"{r(m, 6)} AS {m}", f"{m}")
    sens_at, spec_at = "coalesce(tp2, 0)::DOUBLE / pt.np", "(1 - fp1::DOUBLE / pt.nn)"
    return sql.replace(f"{r(sens_at, 6)} AS sens_at", f"{sens_at} AS sens_at").replace(f"{r(spec_at, 6)} AS spec_at", f"{spec_at} AS spec_at")


def left_out_panel(source: str, tag: str = "", p_adj: float | None = None) -> str:
    """jk{tag} (oy, op, weight and the whole panel without such a row)."""
    return f"{left_out(source, tag)}, jp{tag} AS ({unrounded(panel_sql('lo' + tag, 'rep', p_adj))}), jk{tag} AS (SELECT * FROM jp{tag} JOIN of{tag} USING (rep))"


def jackknifed(spark: SparkSession, d: str, metric: str) -> DataFrame:
    out = R.jackknife_cells(R.cells(view(spark, d, "scored_grid")))
    return out.select("y", "p", S.half_even(metric, 8).alias(metric), "weight")


for _m in ("ap", "sens_at", "spec_at"):
    _sql = f"WITH {left_out_panel('scored_grid')} SELECT oy AS y, op AS p, {r(_m, 8)} AS {_m}, weight FROM jk"
    query(f"r03_jackknife_{_m}", _sql, "scored_grid")(lambda spark, d, m=_m: jackknifed(spark, d, m))


def _counts_sql(p_adj: float | None) -> str:
    each = " UNION ALL ".join(f"SELECT oy AS y, op >= 0.5 AS hit, '{m}' AS metric, {m}::DOUBLE AS value, weight FROM jk" for m in BY_COUNT)
    return f"WITH {left_out_panel('scored_grid', p_adj=p_adj)} SELECT y, hit, metric, value, sum(weight)::BIGINT AS weight FROM ({each}) GROUP BY ALL"


for _name, _p in (("r03_jackknife_counts", None), ("r03_jackknife_padj", 0.12)):
    query(_name, _counts_sql(_p), "scored_grid")(lambda spark, d, p=_p: R.jackknife(R.cells(view(spark, d, "scored_grid")), p_adj=p))


# ---- BCa


def bca_ends(jack: str) -> str:
    """Common table expressions from jn (metric, stat, t) and the named table (metric, value, weight) to bc (metric, stat, t, lo, up)."""
    term = lambda z: f"{phi_sql(f'(z0 + (z0 + {z}) / (1 - acc * (z0 + {z})))')} * 100"
    z = 1.959963984540054
    return (
        f"jm AS (SELECT metric, sum(value * weight) / sum(weight) AS mean FROM {jack} WHERE value IS NOT NULL GROUP BY metric), "
        f"js AS (SELECT metric, sum(pow(mean - value, 3) * weight) AS c3, 6 * pow(sum(pow(mean - value, 2) * weight), 1.5) AS low FROM {jack} JOIN jm USING (metric) WHERE value IS NOT NULL GROUP BY metric), "
        f"ja AS (SELECT metric, c3 / CASE WHEN low = 0 THEN 1e-6 ELSE low END AS acc FROM js), "
        f"jb AS (SELECT metric, stat, t, len(list_filter(t, lambda x: x < stat))::DOUBLE / len(t) AS below FROM jn), "
        f"jz AS (SELECT metric, stat, t, coalesce(acc, 0) AS acc, {quantile_sql('below')} AS z0 FROM jb LEFT JOIN ja USING (metric)), "
        f"bc AS (SELECT metric, stat, t, {term(-z)} AS lo, {term(z)} AS up FROM jz)"
    )


def long_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS value, weight FROM {source}" for m in R.METRICS)


def between(q: str) -> str:
    """The nearest percentile at a column q, and null where replicates are."""
    return f"list_sort(list_filter(t, lambda x: x IS NOT NULL))[CAST(round_even({q} / 100 * (len(list_filter(t, lambda x: x IS NOT NULL)) - 1), 0) AS INT) + 1]"


def bca_sql(reps: int = 20, seed: int = 10221983, p_adj: float | None = None) -> str:
    return (
        f"WITH {boot_ctes('scored_grid', '', reps, seed, p_adj)}, {left_out_panel('scored_grid', p_adj=p_adj)}, jl AS ({long_sql('jk')}), "
        f"jn AS (SELECT metric, any_value(pl.value) AS stat, list(rl.value) AS t FROM rl JOIN pl USING (metric) GROUP BY metric), {bca_ends('jl')} "
        f"SELECT metric, {r('stat', 6)} AS stat, {r(between('lo'), 6)} AS lower, {r(between('up'), 6)} AS upper FROM bc"
    )


def interval_rows(spark: SparkSession, d: str, n: int = 20, method: str = "bca", draws=R.bootstrap_weights, p_adj: float | None = None, boot_mean: bool = False) -> DataFrame:
    out = R.bootstrap(view(spark, d, "scored_grid"), n, method, draws=draws, p_adj=p_adj, boot_mean=boot_mean).cis
    return out.select("metric", *[S.half_even(c, 6).alias(c) for c in CI])


for _name, _p in (("r08_bca", None), ("r08_bca_padj", 0.12)):
    query(_name, bca_sql(p_adj=_p), "scored_grid")(lambda spark, d, p=_p: interval_rows(spark, d, p_adj=p))


@query("r08_bca_counts")
def r08c(spark: SparkSession, d: str) -> DataFrame:
    """A hundred replicates by counts, which SQL cannot draw."""
    return interval_rows(spark, d, 100, draws=R.multinomial_weights)


def boot_mean_sql(p_adj: float = 0.12, reps: int = 20, seed: int = 10221983) -> str:
    return (
        f"WITH {boot_ctes('scored_grid', '', reps, seed, p_adj)}, jn AS (SELECT metric, avg(value) AS stat, list(value) AS t FROM rl GROUP BY metric) "
        f"SELECT metric, {r('stat', 6)} AS stat, {r(near('t', 2.5), 6)} AS lower, {r(near('t', 97.5), 6)} AS upper FROM jn"
    )


@query("r04_boot_mean", boot_mean_sql(), "scored_grid")
def r04m(spark: SparkSession, d: str) -> DataFrame:
    return interval_rows(spark, d, method="pct", p_adj=0.12, boot_mean=True)


FINDINGS = {f: f"(SELECT y, p FROM scored_findings WHERE finding = '{f}')" for f in ("bulk", "open")}


def diff_bca_sql(reps: int = 20, seed: int = 10221983) -> str:
    """Rows are left out of both findings at once: pairs of cells with their rows."""
    a, b = FINDINGS.values()
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    both = (
        f"wd AS (SELECT {key}, max(y) FILTER (WHERE finding = 'bulk') AS ry, max(p) FILTER (WHERE finding = 'bulk') AS rp, "
        f"max(y) FILTER (WHERE finding = 'open') AS cy, max(p) FILTER (WHERE finding = 'open') AS cp FROM scored_findings GROUP BY {key}), "
        "pc AS (SELECT ry, rp, cy, cp, count(*) AS n FROM wd GROUP BY ALL)"
    )
    each = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, (b.{m} - a.{m})::DOUBLE AS value, pc.n AS weight FROM pc JOIN jk_a a ON a.oy = ry AND a.op = rp JOIN jk_b b ON b.oy = cy AND b.op = cp"
        for m in R.METRICS
        if m != "true_prev"
    )
    return (
        f"WITH {boot_ctes(a, '_a', reps, seed, None)}, {boot_ctes(b, '_b', reps, seed, None)}, {left_out_panel(a, '_a')}, {left_out_panel(b, '_b')}, {both}, jl AS ({each}), "
        "dv AS (SELECT metric, list(b.value - a.value) AS t FROM rl_a a JOIN rl_b b USING (rep, metric) GROUP BY metric), "
        "jn AS (SELECT metric, b.value - a.value AS stat, t, a.value AS av, b.value AS bv FROM dv JOIN pl_a a USING (metric) JOIN pl_b b USING (metric) WHERE metric <> 'true_prev'), "
        f"{bca_ends('jl')} SELECT metric, {r('av', 6)} AS ref, {r('bv', 6)} AS comp, {r('bc.stat', 6)} AS d, {r(between('lo').replace('(t,', '(bc.t,'), 6)} AS lower, {r(between('up').replace('(t,', '(bc.t,'), 6)} AS upper "
        "FROM bc JOIN (SELECT metric, av, bv FROM jn) USING (metric)"
    )


@query("r09_diff_ci", diff_bca_sql(), "scored_findings")
def r09(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "scored_findings").where(F.col("finding").isin(*FINDINGS))
    both = R.bootstraps(f, "finding", 20)
    wide = R.paired_rows(f, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "finding", *FINDINGS)
    out = R.difference(*[both[x] for x in FINDINGS], "bca", pairs=R.paired_cells(wide))
    return out.select("metric", *[S.half_even(c, 6).alias(c) for c in ("ref", "comp", "d", "lower", "upper")])
