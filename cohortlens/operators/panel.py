"""The full panel of classification metrics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf
from ..functions.scalar import half_even, ratio
from . import roc
from .confusion import Rates, brier_multiclass, counts_from_rates, threshold

COLUMNS = "tp fp tn fn sens spec ppv npv j f1 mcc brier auc ap sens_at spec_at true_prev pred_prev prev_diff rel_prev_diff".split()


def panel(df: DataFrame, by: tuple[str, ...] = (), cut: float | Column = 0.5, p_adj: float | None = None, kind: str = "prob", y: str = "y", p: str = "p", sens_min: float = 0.9, spec_min: float = 0.7, digits: int = 4, only: list[str] | None = None, weight: str | None = None, mcnemar: bool = False, model: str | None = None) -> DataFrame:
    """One row of COLUMNS for each group.

    weight: a column of whole numbers, how often a row counts. mcnemar adds the
    p-value of the corrected test on the counts that the other values come from,
    model a column with that name.

    kind "prob": p is a probability; "hard": p is 0 or 1, auc and ap are 0 and
    sens_at, spec_at are left out; "auto": decided by one aggregate over all rows.
    Sensitivity and specificity are rounded first; the counts are rebuilt from
    them (and from p_adj, if given, as prevalence); with p_adj the values that
    depend on prevalence come from the rebuilt counts. A ratio to a true
    prevalence of 0 is null.
    """
    by = tuple(by)
    if kind == "auto":
        kind = "prob" if df.where((F.col(p) > 0) & (F.col(p) < 1)).limit(1).count() else "hard"
    hat = threshold(p, cut) if kind == "prob" else F.col(p).cast("int")
    w = F.lit(1) if weight is None else F.col(weight)
    one = F.count_if if weight is None else lambda c: F.sum(F.when(c, w).otherwise(0))
    off = F.pow(F.col(p) - F.col(y), 2)
    yes, no, pos, neg = F.col(y) == 1, F.col(y) == 0, hat == 1, hat == 0
    base = df.groupBy(*by).agg(
        F.sum(w).alias("n"), one(yes & pos).alias("c_tp"), one(no & pos).alias("c_fp"), one(no & neg).alias("c_tn"), one(yes & neg).alias("c_fn"), (F.avg(off) if weight is None else F.sum(off * w) / F.sum(w)).alias("brier")
    )
    asked = lambda *names: only is None or any(n in only for n in names)
    zero = F.lit(0.0)
    if kind == "prob":
        # the curve is only drawn for what is asked of it
        c = roc.curve(df, by, y, p, weight) if asked("auc", "ap", "sens_at", "spec_at") else None
        if asked("auc", "ap"):
            base = _join(base, roc.areas(c, by), by)
        if asked("sens_at", "spec_at"):
            points = roc.operating_points(c, by, sens_min, spec_min)
            spec_at = (1 - ratio("at_sens.fps", "nn", None)).alias("spec_at")
            base = _join(base, points.select(*by, spec_at, F.coalesce(ratio("at_spec.tps", "np", None), zero).alias("sens_at")), by)
    else:
        base = base.withColumns({"auc": zero, "ap": zero})
    r = Rates("c_tp", "c_fp", "c_tn", "c_fn")
    base = base.withColumns({"sens": half_even(r.sens, digits), "spec": half_even(r.spec, digits)})
    prev = F.lit(float(p_adj)) if p_adj else (F.col("c_tp") + F.col("c_fn")) / F.col("n")
    base = base.withColumns(counts_from_rates(F.col("sens"), F.col("spec"), prev, F.col("n")))
    q = Rates() if p_adj else r
    true, pred = (F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")) if p_adj else (F.col("c_tp") + F.col("c_fn"), F.col("c_tp") + F.col("c_fp"))
    round_ = lambda x: half_even(x, digits)
    base = base.withColumns({
        "ppv": round_(q.ppv), "npv": round_(q.npv), "j": round_(F.col("sens") + F.col("spec") - 1), "f1": round_(q.f_score()), "mcc": round_(q.abs_mcc()), "brier": round_("brier"),
        "true_prev": true.cast("long"), "pred_prev": pred.cast("long"), "prev_diff": (pred - true).cast("long"), "rel_prev_diff": round_(ratio(pred - true, true, None)),
    })
    names = [x for x in COLUMNS if kind == "prob" or x not in ("sens_at", "spec_at")]
    if mcnemar:
        b, c_ = (F.col("fp"), F.col("fn")) if p_adj else (F.col("c_fp"), F.col("c_fn"))
        base = base.withColumn("mcnemar", chi2_sf(ratio(F.pow(F.abs(b - c_) - 1, 2), b + c_, None)))
        names.append("mcnemar")
    if model is not None:
        base = base.withColumn("model", F.lit(model))
        names.append("model")
    return base.select(*by, *(n for n in names if only is None or n in only))


def panel_multiclass(df: DataFrame, label: str = "label", probs: str = "probs", average: str = "weighted", digits: int = 4, model: str | None = None) -> DataFrame:
    """Averages of the one-against-rest panels over the classes 0..k-1 of an array of probabilities, one row.

    weighted: by the number of rows of the class; macro: plain; micro: from
    pooled counts. The prediction is the first class of the highest probability.
    Counts are averaged like the rates and rounded. brier is the mean squared
    distance of the probabilities to the one-hot label; auc and ap come from the
    probabilities of each class (for micro they are averaged by weight).
    A class whose correlation or relative difference is undefined counts with 0.
    """
    picked = F.array_position(probs, F.array_max(probs)) - 1
    long = df.select(F.col(label), picked.alias("_h"), F.posexplode(probs).alias("k", "p")).select("k", (F.col(label) == F.col("k")).cast("int").alias("y"), (F.col("_h") == F.col("k")).cast("int").alias("h"), "p")
    cells = long.groupBy("k", "y", "h").agg(F.count(F.lit(1)).alias("n"))
    names = [c for c in COLUMNS if c not in ("brier", "auc", "ap", "sens_at", "spec_at")]
    whole = ["tp", "fp", "tn", "fn", "true_prev", "pred_prev", "prev_diff"]
    hard = lambda by: panel(cells, by, kind="hard", p="h", weight="n", digits=16, only=[*names])
    weight = F.lit(1) if average == "macro" else F.col("true_prev")
    mean = lambda c, w: ratio(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w), F.sum(w))
    area = roc.areas(roc.curve(long, ("k",)), ("k",))
    each = hard(("k",)).join(area, "k")
    if average == "micro":
        out = hard(()).crossJoin(each.agg(mean("auc", weight).alias("auc"), mean("ap", weight).alias("ap")))  # one row on either side
    else:
        out = each.agg(*[mean(c, weight).alias(c) for c in (*names, "auc", "ap")])
    out = out.crossJoin(df.agg(brier_multiclass(label, probs).alias("brier"), F.max(F.size(probs)).alias("classes")))  # one row on either side
    shown = [F.rint(c).cast("long").alias(c) if c in whole else (half_even(c, digits) + 0.0).alias(c) for c in COLUMNS if c in out.columns]  # + 0.0: no negative zeros
    out = out.select(*shown, "classes")
    return out if model is None else out.withColumn("model", F.lit(model))


def _join(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Both have a row for each group; null keys match."""
    if not by:
        return a.crossJoin(b)  # one row on either side
    on = None
    for k in by:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    return a.alias("a").join(b.alias("b"), on, "left").select("a.*", *[f"b.{c}" for c in b.columns if c not in by])
