"""Queries by operator id, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cohort as C
from ..operators import confusion as M
from ..operators import image as I
from ..operators import panel as P
from ..operators import resample as R
from ..operators import roc
from ..operators import tables as T
from ..shipping import ship
from .views import table, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return f

    return add


def r(x: str, digits: int = 4) -> str:
    """Half-even rounding in DuckDB."""
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def hashed(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


CELLS = "count(*) AS n, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn"
SE, SP = "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)", "coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)"
PV, NV = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)", "coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0)"
RATED = f"WITH c AS (SELECT grp, {CELLS} FROM scored_grid GROUP BY grp), q AS (SELECT *, {SE} AS se, {SP} AS sp, {PV} AS pv, {NV} AS nv FROM c)"
F1 = "coalesce((1 + 1.0) * se * pv / nullif(1.0 * pv + se, 0), 0)"
MCC = "CASE WHEN (se + sp - 1) * (pv + nv - 1) = 0 THEN 0 ELSE pow((se + sp - 1) * (pv + nv - 1) * (pv + nv - 1) * (se + sp - 1), 0.25) END"


def grid_counts(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "scored_grid")
    return M.counts(g, ("grp",), "y", M.threshold("p", 0.5))


@query("p19_threshold_confusion", f"{RATED} SELECT grp, n, tp, fp, tn, fn, {r('se')} AS sens, {r('sp')} AS spec, {r('pv')} AS ppv, {r('nv')} AS npv FROM q", "scored_grid")
def p19(spark: SparkSession, d: str) -> DataFrame:
    x = M.Rates()
    return grid_counts(spark, d).withColumns({k: S.half_even(v) for k, v in (("sens", x.sens), ("spec", x.spec), ("ppv", x.ppv), ("npv", x.npv))})


@query("m05_08_derived_rates", f"{RATED} SELECT grp, {r('(pv + nv - 1)')} AS markedness, {r('(se + sp - 1)')} AS youden, {r('(2 * 2.0 / 3.0 * se + 2 * 1.0 / 3.0 * sp - 1)')} AS youden_2_1, {r(F1)} AS f1, {r('coalesce(5.0 * se * pv / nullif(4.0 * pv + se, 0), 0)')} AS f2, {r(f'({MCC})')} AS abs_mcc FROM q", "scored_grid")
def m05(spark: SparkSession, d: str) -> DataFrame:
    x = M.Rates()
    named = (("markedness", x.markedness), ("youden", x.youden()), ("youden_2_1", x.youden(2.0, 1.0)), ("f1", x.f_score()), ("f2", x.f_score(2.0)), ("abs_mcc", x.abs_mcc()))
    return grid_counts(spark, d).select("grp", *[S.half_even(v).alias(k) for k, v in named])


@query("m09_brier", f"SELECT {r('avg(pow(p - y, 2))', 6)} AS brier FROM scored_cont", "scored_cont")
def m09(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored_cont").agg(S.half_even(M.brier(), 6).alias("brier"))


@query("m10_brier_multiclass", f"WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS v FROM embeddings), q AS (SELECT label, list_transform(v, lambda x: x / list_sum(v)) AS pr FROM e) SELECT {r('avg(list_sum(list_transform(range(10), lambda i: pow(pr[i + 1] - CASE WHEN i = label THEN 1.0 ELSE 0.0 END, 2))))', 6)} AS brier FROM q")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return softmax10(spark, d).agg(S.half_even(M.brier_multiclass("label", "probs"), 6).alias("brier"))


def softmax10(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").withColumn("e", e).select("vec_id", "label", F.transform("e", lambda x: x / total).alias("probs"))


@query("m11_counts_from_rates", f"{RATED}, z AS (SELECT *, {r('se')} AS s4, {r('sp')} AS p4, round_even(0.12 * n, 0) AS np FROM q) SELECT grp, round_even(s4 * np, 0)::BIGINT AS tp, round_even((1 - p4) * (n - np), 0)::BIGINT AS fp, round_even(p4 * (n - np), 0)::BIGINT AS tn, round_even((1 - s4) * np, 0)::BIGINT AS fn, {r('(s4 * 0.12 / nullif(s4 * 0.12 + (1 - p4) * (1 - 0.12), 0))')} AS ppv, {r('(p4 * (1 - 0.12) / nullif(p4 * (1 - 0.12) + (1 - s4) * 0.12, 0))')} AS npv FROM z", "scored_grid")
def m11(spark: SparkSession, d: str) -> DataFrame:
    x = M.Rates()
    c = grid_counts(spark, d).withColumns({"se": S.half_even(x.sens), "sp": S.half_even(x.spec)})
    se, sp = F.col("se"), F.col("sp")
    made = M.counts_from_rates(se, sp, F.lit(0.12), F.col("n"))
    return c.select("grp", *[v.alias(k) for k, v in made.items()], S.half_even(M.ppv_from_rates(se, sp, 0.12)).alias("ppv"), S.half_even(M.npv_from_rates(se, sp, 0.12)).alias("npv"))


@query("m13_mcnemar_stat", f"{RATED} SELECT grp, fp AS b, fn AS c, {r('(pow(abs(fp - fn) - 1, 2) / nullif(fp + fn, 0))')} AS stat, {r('(pow(fp - fn, 2) / nullif(fp + fn, 0))')} AS stat_plain FROM q", "scored_grid")
def m13(spark: SparkSession, d: str) -> DataFrame:
    plain = M.mcnemar(grid_counts(spark, d), False).select("grp", S.half_even("stat").alias("stat_plain"))
    return M.mcnemar(grid_counts(spark, d)).select("grp", "b", "c", S.half_even("stat").alias("stat")).join(plain, "grp")


@query("m14_synthetic_obs", f"{RATED}, e AS (SELECT grp, u.o, u.y, u.yhat, u.k, u.b FROM q, unnest([{{'o':0,'y':0,'yhat':0,'k':tn,'b':0}}, {{'o':1,'y':1,'yhat':0,'k':fn,'b':tn}}, {{'o':2,'y':0,'yhat':1,'k':fp,'b':tn+fn}}, {{'o':3,'y':1,'yhat':1,'k':tp,'b':tn+fn+fp}}]) AS t(u)) SELECT grp, y, yhat, b + unnest(range(k)) AS at FROM e", "scored_grid")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return M.observations(grid_counts(spark, d), ("grp",))


@query("m15_mcc_from_rates", f"{RATED} SELECT grp, {r('sqrt(abs((se + sp - 1) * (se * 0.12 / (se * 0.12 + (1 - sp) * (1 - 0.12)) + sp * (1 - 0.12) / (sp * (1 - 0.12) + (1 - se) * 0.12) - 1)))')} AS mcc FROM q", "scored_grid")
def m15(spark: SparkSession, d: str) -> DataFrame:
    x = M.Rates()
    return grid_counts(spark, d).select("grp", S.half_even(M.abs_mcc_from_rates(x.sens, x.spec, 0.12)).alias("mcc"))


def curve_sql(source: str, by: str = "") -> str:
    """Common table expressions pts, cum, roc of a scored view."""
    b, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return (
        f"WITH pts AS (SELECT {b}p AS thr, sum(y)::BIGINT AS dp, (count(*) - sum(y))::BIGINT AS dn FROM {source} GROUP BY {b}p), "
        f"cum AS (SELECT *, (sum(dp) OVER ({part}ORDER BY thr DESC))::BIGINT AS tps, (sum(dn) OVER ({part}ORDER BY thr DESC))::BIGINT AS fps, (sum(dp) OVER ({part or ''}))::BIGINT AS np, (sum(dn) OVER ({part or ''}))::BIGINT AS nn FROM pts), "
        f"nb AS (SELECT *, lag(tps) OVER w AS lt, lead(tps) OVER w AS nt, lag(fps) OVER w AS lf, lead(fps) OVER w AS nf FROM cum WINDOW w AS ({part}ORDER BY thr DESC)), "
        f"roc AS (SELECT * FROM nb WHERE lt IS NULL OR nt IS NULL OR nt - 2 * tps + lt <> 0 OR nf - 2 * fps + lf <> 0 UNION ALL SELECT DISTINCT {b}NULL, 0, 0, 0, 0, np, nn, NULL, NULL, NULL, NULL FROM cum)"
    )


AUC = "(sum(dn * (2 * (tps - dp) + dp)))::DOUBLE / (2 * max(np) * max(nn))"
AP = "sum(dp * (tps::DOUBLE / (tps + fps))) / max(np)"


@query("m16_auc", f"{curve_sql('scored_findings', 'finding')} SELECT finding, {r(AUC, 6)} AS auc FROM cum GROUP BY finding", "scored_findings")
def m16(spark: SparkSession, d: str) -> DataFrame:
    return roc.areas(roc.curve(view(spark, d, "scored_findings"), ("finding",)), ("finding",)).select("finding", S.half_even("auc", 6).alias("auc"))


@query("m16_auc_continuous", f"{curve_sql('scored_cont')} SELECT {r(AUC, 6)} AS auc FROM cum", "scored_cont")
def m16c(spark: SparkSession, d: str) -> DataFrame:
    return roc.areas(roc.curve(view(spark, d, "scored_cont"))).select(S.half_even("auc", 6).alias("auc"))


@query("m17_ap", f"{curve_sql('scored_findings', 'finding')} SELECT finding, {r(AP, 6)} AS ap FROM cum GROUP BY finding", "scored_findings")
def m17(spark: SparkSession, d: str) -> DataFrame:
    return roc.areas(roc.curve(view(spark, d, "scored_findings"), ("finding",)), ("finding",)).select("finding", S.half_even("ap", 6).alias("ap"))


@query("m18_roc_points", f"{curve_sql('scored_grid')} SELECT thr, tps, fps FROM roc WHERE thr IS NOT NULL", "scored_grid")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return roc.curve(view(spark, d, "scored_grid")).where("kept").select("thr", "tps", "fps")


@query("m18_roc_points_continuous", f"{curve_sql('scored_cont')} SELECT thr, tps, fps FROM roc WHERE thr IS NOT NULL", "scored_cont")
def m18c(spark: SparkSession, d: str) -> DataFrame:
    return roc.curve(view(spark, d, "scored_cont")).where("kept").select("thr", "tps", "fps")


def points_sql(source: str, by: str = "") -> str:
    b, g = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"{curve_sql(source, by)}, pt AS (SELECT {b}max(thr) FILTER (WHERE tps::DOUBLE / np >= 0.9) AS ts, arg_max(tps, thr) FILTER (WHERE tps::DOUBLE / np >= 0.9) AS tp1, arg_max(fps, thr) FILTER (WHERE tps::DOUBLE / np >= 0.9) AS fp1, "
        f"min(thr) FILTER (WHERE 1 - fps::DOUBLE / nn >= 0.7) AS tt, arg_min(tps, thr) FILTER (WHERE 1 - fps::DOUBLE / nn >= 0.7) AS tp2, arg_min(fps, thr) FILTER (WHERE 1 - fps::DOUBLE / nn >= 0.7) AS fp2, max(np) AS np, max(nn) AS nn FROM cum{g})"
    )


@query("m19_operating_points", f"{points_sql('scored_grid')} SELECT 'sens' AS kind, {r('100 * tp1::DOUBLE / np')} AS sens, {r('100 * (1 - fp1::DOUBLE / nn)')} AS spec, ts AS cutpoint FROM pt UNION ALL SELECT 'spec', {r('100 * coalesce(tp2, 0)::DOUBLE / np')}, {r('100 * (1 - coalesce(fp2, 0)::DOUBLE / nn)')}, tt FROM pt", "scored_grid")
def m19(spark: SparkSession, d: str) -> DataFrame:
    out = roc.operating_rows(roc.curve(view(spark, d, "scored_grid")))
    return out.select("kind", S.half_even("sens").alias("sens"), S.half_even("spec").alias("spec"), "cutpoint")


@query("m21_confusion_matrix", "SELECT y, CAST(p >= 0.5 AS INT) AS yhat, count(*) AS n FROM scored_cont GROUP BY ALL", "scored_cont")
def m21(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "scored_cont").groupBy("y", M.threshold("p", 0.5).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def cut_sql(source: str, by: str, p_adj: float | str) -> str:
    b, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    pick = lambda obj: f"row_number() OVER ({part}ORDER BY {obj}, thr DESC NULLS FIRST)"
    adj = f"abs(fps::DOUBLE / nn * (1 - {p_adj}) - (1 - tps::DOUBLE / np) * {p_adj})"
    adj = f"coalesce({adj}, abs(fps - (np - tps))::DOUBLE)"  # where there is no p_adj
    g = f" GROUP BY {by}" if by else ""
    return f"{curve_sql(source, by)}, o AS (SELECT *, {pick('fps * np - tps * nn')} AS rj, {pick('abs(fps - (np - tps))')} AS rc, {pick(adj)} AS ra FROM roc) SELECT {b}max(thr) FILTER (WHERE rj = 1) AS j, max(thr) FILTER (WHERE rc = 1) AS count_cut, max(thr) FILTER (WHERE ra = 1) AS count_adj FROM o{g}"


@query("c03_cutpoints", cut_sql("scored_grid", "", 0.12), "scored_grid")
def c03(spark: SparkSession, d: str) -> DataFrame:
    return roc.cutpoints(roc.curve(view(spark, d, "scored_grid")), (), 0.12).withColumnRenamed("count", "count_cut")


@query("c03_cutpoints_continuous", cut_sql("scored_cont", "", 0.07), "scored_cont")
def c03c(spark: SparkSession, d: str) -> DataFrame:
    return roc.cutpoints(roc.curve(view(spark, d, "scored_cont")), (), 0.07).withColumnRenamed("count", "count_cut")


@query("c04_cutpoints_by_finding", cut_sql("scored_findings", "finding", 0.2), "scored_findings")
def c04(spark: SparkSession, d: str) -> DataFrame:
    c = roc.curve(view(spark, d, "scored_findings"), ("finding",))
    return roc.cutpoints(c, ("finding",), 0.2).withColumnRenamed("count", "count_cut")


@query("c04_padj_by_finding", cut_sql("scored_findings", "finding", "CASE finding WHEN 'bulk' THEN 0.3 WHEN 'open' THEN 0.1 END"), "scored_findings")
def c04p(spark: SparkSession, d: str) -> DataFrame:
    c = roc.curve(view(spark, d, "scored_findings"), ("finding",))
    return roc.cutpoints(c, ("finding",), {"bulk": 0.3, "open": 0.1}).withColumnRenamed("count", "count_cut")


@query("c05_threshold_grid", "WITH g AS (SELECT i * (1.0 / 100)::DOUBLE AS cutoff FROM range(100) t(i)), a AS (SELECT cutoff, count(*) FILTER (WHERE y = 1 AND p >= cutoff) AS tp, count(*) FILTER (WHERE y = 0 AND p >= cutoff) AS fp, count(*) FILTER (WHERE y = 0 AND p < cutoff) AS tn, count(*) FILTER (WHERE y = 1 AND p < cutoff) AS fn FROM g, (SELECT y, p FROM scored_cont) GROUP BY cutoff) " f"SELECT {r('cutoff', 2)} AS cutoff, tp, fp, tn, fn, {r(SE)} AS sens, {r(SP)} AS spec FROM a", "scored_cont")
def c05(spark: SparkSession, d: str) -> DataFrame:
    x = M.Rates()
    return roc.threshold_grid(view(spark, d, "scored_cont")).withColumns({"cutoff": S.half_even("cutoff", 2), "sens": S.half_even(x.sens), "spec": S.half_even(x.spec)})


@query("a12_best_at", "SELECT max(tps::DOUBLE / np) AS tpr FROM (" + curve_sql("scored_grid").replace("WITH ", "WITH ", 1) + " SELECT * FROM cum) WHERE 1 - fps::DOUBLE / nn >= 0.7", "scored_grid")
def a12(spark: SparkSession, d: str) -> DataFrame:
    c = roc.curve(view(spark, d, "scored_grid")).select((F.col("tps") / F.col("np")).alias("tpr"), (1 - F.col("fps") / F.col("nn")).alias("spec"))
    return c.agg(T.best_x("tpr", "spec", 0.7).alias("tpr"))


def panel_sql(source: str, by: str, p_adj: float | None = None, cut: str = "0.5") -> str:
    b, on = (f"{by}, ", f" JOIN ar USING ({by}) JOIN pt USING ({by})") if by else ("", ", ar, pt")
    g = f" GROUP BY {by}" if by else ""
    cells = CELLS.replace("0.5", cut)
    own = "" if p_adj else "c"
    prev = f"{p_adj}" if p_adj else "(ctp + cfn)::DOUBLE / n"
    o = lambda c: f"{own}{c}"
    div = lambda a, z: f"coalesce({a}::DOUBLE / nullif({z}, 0), 0)"
    return (
        f"{points_sql(source, by)}, ar AS (SELECT {b}{AUC} AS auc, {AP} AS ap FROM cum{g}), "
        f"k AS (SELECT {b}{cells}, avg(pow(p - y, 2)) AS brier FROM {source}{g}), "
        f"k2 AS (SELECT {b}n, tp AS ctp, fp AS cfp, tn AS ctn, fn AS cfn, brier, {r(SE)} AS sens, {r(SP)} AS spec FROM k), "
        f"k3 AS (SELECT *, round_even({prev} * n, 0) AS pos FROM k2), "
        f"k4 AS (SELECT *, round_even(sens * pos, 0)::BIGINT AS tp, round_even((1 - spec) * (n - pos), 0)::BIGINT AS fp, round_even(spec * (n - pos), 0)::BIGINT AS tn, round_even((1 - sens) * pos, 0)::BIGINT AS fn FROM k3), "
        f"k5 AS (SELECT *, {div(o('tp'), o('tp') + '+' + o('fn'))} AS se, {div(o('tn'), o('tn') + '+' + o('fp'))} AS sp, {div(o('tp'), o('tp') + '+' + o('fp'))} AS pv, {div(o('tn'), o('tn') + '+' + o('fn'))} AS nv, ({o('tp')} + {o('fn')})::BIGINT AS true_prev, ({o('tp')} + {o('fp')})::BIGINT AS pred_prev FROM k4) "
        f"SELECT {b}tp, fp, tn, fn, sens, spec, {r('pv')} AS ppv, {r('nv')} AS npv, {r('(sens + spec - 1)')} AS j, {r(F1)} AS f1, {r(f'({MCC})')} AS mcc, {r('brier')} AS brier, {r('auc', 6)} AS auc, {r('ap', 6)} AS ap, {r('coalesce(tp2, 0)::DOUBLE / pt.np', 6)} AS sens_at, {r('(1 - fp1::DOUBLE / pt.nn)', 6)} AS spec_at, true_prev, pred_prev, pred_prev - true_prev AS prev_diff, {r('((pred_prev - true_prev)::DOUBLE / nullif(true_prev, 0))')} AS rel_prev_diff FROM k5{on}"
    )


def shown(p: DataFrame) -> DataFrame:
    """Areas and targets are not rounded by the panel; here they are, to compare."""
    return p.withColumns({c: S.half_even(c, 6) for c in ("auc", "ap", "sens_at", "spec_at") if c in p.columns})


@query("m20_panel", panel_sql("scored_grid", "grp"), "scored_grid")
def m20(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.panel(view(spark, d, "scored_grid"), ("grp",)))


@query("m20_panel_padj", panel_sql("scored_grid", "grp", 0.12), "scored_grid")
def m20a(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.panel(view(spark, d, "scored_grid"), ("grp",), p_adj=0.12))


@query("m20_panel_whole", panel_sql("scored_cont", ""), "scored_cont")
def m20w(spark: SparkSession, d: str) -> DataFrame:
    return shown(P.panel(view(spark, d, "scored_cont"), kind="auto"))


@query("m20_panel_hard", f"WITH h AS (SELECT grp, y, CAST(p >= 0.5 AS INT) AS p FROM scored_grid), c AS (SELECT grp, {CELLS} FROM h GROUP BY grp), q AS (SELECT *, {SE} AS se, {SP} AS sp, {PV} AS pv, {NV} AS nv FROM c) SELECT grp, {r('se')} AS sens, {r('sp')} AS spec, {r(F1)} AS f1, 0.0::DOUBLE AS auc, {r('((fp + fn)::DOUBLE / n)')} AS brier FROM q", "scored_grid")
def m20h(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "scored_grid").withColumn("p", M.threshold("p", 0.5))
    return P.panel(g, ("grp",), kind="hard", only=["sens", "spec", "f1", "auc", "brier"])


WHOLE = ["tp", "fp", "tn", "fn", "true_prev", "pred_prev", "prev_diff"]
SHARES = ["sens", "spec", "ppv", "npv", "j", "f1", "mcc", "rel_prev_diff"]


def multiclass_sql(average: str) -> str:
    """One panel for each class, and their average; probabilities are a softmax of ten components."""
    w = "1" if average == "macro" else "true_prev"
    mean = lambda c, w=w: f"sum(coalesce({c}, 0) * {w})::DOUBLE / sum({w})"
    pooled = "SELECT 0 AS k, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM c"
    shares = f"z AS (SELECT *, {SE} AS se, {SP} AS sp, {PV} AS pv, {NV} AS nv FROM {{src}}), m AS (SELECT k, tp, fp, tn, fn, se AS sens, sp AS spec, pv AS ppv, nv AS npv, se + sp - 1 AS j, {F1} AS f1, coalesce({MCC}, 0) AS mcc, tp + fn AS true_prev, tp + fp AS pred_prev, fp - fn AS prev_diff, (fp - fn)::DOUBLE / nullif(tp + fn, 0) AS rel_prev_diff FROM z)"
    rates = ", ".join([f"round_even({mean(c, '1')}, 0)::BIGINT AS {c}" for c in WHOLE] + [f"{r('(' + mean(c, '1') + ')')} + 0.0::DOUBLE AS {c}" for c in SHARES]) if average == "micro" else ", ".join([f"round_even({mean(c)}, 0)::BIGINT AS {c}" for c in WHOLE] + [f"{r('(' + mean(c) + ')')} + 0.0::DOUBLE AS {c}" for c in SHARES])
    return (
        "WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS v FROM embeddings), q AS (SELECT label, list_transform(v, lambda x: x / list_sum(v)) AS pr FROM e), "
        "h AS (SELECT label, list_position(pr, list_max(pr)) - 1 AS hat FROM q), c AS (SELECT k, count(*) FILTER (WHERE label = k AND hat = k) AS tp, count(*) FILTER (WHERE label <> k AND hat = k) AS fp, count(*) FILTER (WHERE label <> k AND hat <> k) AS tn, count(*) FILTER (WHERE label = k AND hat <> k) AS fn FROM h, range(10) t(k) GROUP BY k), "
        + "lg AS (SELECT k, CAST(label = k AS INT) AS y, pr[k + 1] AS p FROM q, range(10) t(k)), "
        + curve_sql("lg", "k")[5:]
        + f", ar AS (SELECT cum.k, {AUC} AS auc, {AP} AS ap, any_value(c.tp + c.fn) AS true_prev FROM cum JOIN c ON c.k = cum.k GROUP BY cum.k), "
        + (f"pool AS ({pooled}), " if average == "micro" else "")
        + shares.format(src="pool" if average == "micro" else "c")
        + f" SELECT {rates}, (SELECT {r('avg(list_sum(list_transform(range(10), lambda i: pow(pr[i + 1] - CASE WHEN i = label THEN 1.0 ELSE 0.0 END, 2))))')} FROM q) AS brier, (SELECT {r('(' + mean('auc') + ')')} FROM ar) AS auc, (SELECT {r('(' + mean('ap') + ')')} FROM ar) AS ap, 10 AS classes FROM m"
    )


for _average in ("weighted", "macro", "micro"):
    query(f"m20_multiclass_{_average}", multiclass_sql(_average))(lambda spark, d, average=_average: P.panel_multiclass(softmax10(spark, d), average=average))


@query("a16_multiclass_macro", f"WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS v FROM embeddings), h AS (SELECT label, list_position(v, list_max(v)) - 1 AS hat FROM e), c AS (SELECT k, count(*) FILTER (WHERE label = k AND hat = k) AS tp, count(*) FILTER (WHERE label <> k AND hat = k) AS fp, count(*) FILTER (WHERE label <> k AND hat <> k) AS tn, count(*) FILTER (WHERE label = k AND hat <> k) AS fn FROM h, range(10) t(k) GROUP BY k) SELECT {r(f'avg({SE})')} AS sens, {r(f'avg({SP})')} AS spec, {r(f'avg({PV})')} AS ppv, {r(f'avg({NV})')} AS npv FROM c")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return P.panel_multiclass(softmax10(spark, d), average="macro").select("sens", "spec", "ppv", "npv")


CUTS = "cutpoint_type, cutpoint"


@query("x09_binary_report", "WITH cc AS (" + cut_sql("scored_grid", "", 0.12) + "), lab AS (SELECT y, p, t.k AS cutpoint_type, CASE t.k WHEN 'j' THEN cc.j ELSE cc.count_cut END AS cutpoint FROM scored_grid, cc, (VALUES ('j'), ('count')) t(k)), " + panel_sql("lab", CUTS, None, "cutpoint")[5:], "scored_grid")
def x09(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "scored_grid")
    cuts = roc.cutpoints(roc.curve(g)).select(F.explode(F.array(F.struct(F.lit("j").alias("cutpoint_type"), F.col("j").alias("cutpoint")), F.struct(F.lit("count").alias("cutpoint_type"), F.col("count").alias("cutpoint")))).alias("c")).select("c.*")
    each = g.crossJoin(F.broadcast(cuts))  # two rows: a report has two kinds of cut
    return shown(P.panel(each, ("cutpoint_type", "cutpoint"), F.col("cutpoint")))


EXTERNAL = "WITH f AS (SELECT concat('set', l_suppkey % 4) AS dataset, y, p FROM scored_grid), "


@query("x10_external_report", EXTERNAL + panel_sql("f", "dataset", None, "0.4")[5:], "scored_grid")
def x10(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "scored_grid").withColumn("dataset", F.concat(F.lit("set"), F.col("l_suppkey") % 4))
    return shown(P.panel(f, ("dataset",), 0.4))


@query("x11_multilabel_report", "WITH cc AS (" + cut_sql("scored_findings", "finding", 0.2) + "), lab AS (SELECT f.finding || ':' || t.k AS tag, f.y, f.p, CASE t.k WHEN 'j' THEN cc.j ELSE cc.count_cut END AS cp FROM scored_findings f JOIN cc USING (finding), (VALUES ('j'), ('count')) t(k)) " f"SELECT tag, any_value(cp) AS cutpoint, {r('count(*) FILTER (WHERE y = 1 AND p >= cp)::DOUBLE / count(*) FILTER (WHERE y = 1)')} AS sens, {r('count(*) FILTER (WHERE y = 0 AND p < cp)::DOUBLE / count(*) FILTER (WHERE y = 0)')} AS spec, {r('avg(pow(p - y, 2))')} AS brier FROM lab GROUP BY tag", "scored_findings")
def x11(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "scored_findings")
    cuts = roc.cutpoints(roc.curve(f, ("finding",)), ("finding",), 0.2)
    cuts = cuts.select("finding", F.explode(F.array(F.struct(F.lit("j").alias("k"), F.col("j").alias("cutpoint")), F.struct(F.lit("count").alias("k"), F.col("count").alias("cutpoint")))).alias("c")).select("finding", "c.*")
    each = f.join(F.broadcast(cuts), "finding").withColumn("tag", F.concat_ws(":", "finding", "k"))  # two rows for each finding
    return P.panel(each, ("tag", "cutpoint"), F.col("cutpoint"), only=["sens", "spec", "brier"])


@query("c06_spec_at_sens", f"{points_sql('scored_findings', 'finding')} SELECT finding AS dataset, {r('100 * tp1::DOUBLE / np')} AS sens, {r('100 * (1 - fp1::DOUBLE / nn)')} AS spec, ts AS cutpoint FROM pt", "scored_findings")
def c06(spark: SparkSession, d: str) -> DataFrame:
    c = roc.curve(view(spark, d, "scored_findings"), ("finding",))
    return roc.operating_rows(c, ("finding",)).where("kind = 'sens'").select(F.col("finding").alias("dataset"), S.half_even("sens").alias("sens"), S.half_even("spec").alias("spec"), "cutpoint")


@query("c07_auc_table", "WITH f AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END || ':' || finding AS tag FROM scored_findings), " + curve_sql("f", "tag")[5:] + ", a AS (SELECT split_part(tag, ':', 1) AS dataset, split_part(tag, ':', 2) AS finding, " + r("100 * " + AUC, 2) + " AS auc FROM cum GROUP BY tag) SELECT dataset, max(auc) FILTER (WHERE finding = 'bulk') AS bulk, max(auc) FILTER (WHERE finding = 'returned') AS returned, max(auc) FILTER (WHERE finding = 'open') AS open FROM a GROUP BY dataset", "scored_findings")
def c07(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "scored_findings").withColumn("dataset", F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd"))
    a = roc.areas(roc.curve(f, ("dataset", "finding")), ("dataset", "finding"))
    return a.groupBy("dataset").pivot("finding", ["bulk", "returned", "open"]).agg(F.first(S.half_even(100 * F.col("auc"), 2)))
