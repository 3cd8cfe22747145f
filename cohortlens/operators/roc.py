"""ROC curves, areas and cut-points by group.

Scores are first merged to one row for each distinct score. Running sums over
falling scores are taken in two steps: within ranges of the score, and over the
ranges, so a curve is not one task's work. The ranges need no pass over the data:
they are finer towards 0 and 1, where scores of sure models crowd, and widen
beyond, where logits lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import col, half_even, ratio

PER_OCTAVE = 512  # ranges in which the distance to 0, or to 1 from one half on, doubles


def score_range(p: str | Column, per_octave: int = PER_OCTAVE) -> Column:
    """The number of a score's range; it never falls as the score rises. There are
    some forty octaves below one half and as many above, whatever the scores."""
    octaves = lambda d: F.floor(F.log2(1 + F.least(d, F.lit(1e290)) * 2.0**40) * per_octave)
    p, half = col(p).cast("double"), octaves(F.lit(0.5))
    return F.when(p <= 0, -octaves(-p)).when(p <= 0.5, octaves(p)).when(p <= 1, 2 * half - octaves(1 - p)).otherwise(2 * half + octaves(p - 1))


def curve(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """(by, thr, dp, dn, tps, fps, np, nn, kept): a row for each distinct score.

    tps and fps count rows with p >= thr by label; kept marks the ends and the
    points at which the curve bends. The point (infinity, 0, 0) is not a row.
    Rows with a null score or label are left out; scores may be any numbers.
    """
    by = list(by)
    w = F.lit(1) if weight is None else F.col(weight)
    pts = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("thr")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("long").alias("dp"), F.sum(F.when(F.col(y) == 0, w).otherwise(0)).cast("long").alias("dn")
    )
    pts = pts.where("dp + dn > 0").withColumn("_r", score_range("thr"))
    high = F.struct("dp", "dn")
    ranges = pts.groupBy(*by, "_r").agg(F.sum("dp").alias("p_"), F.sum("dn").alias("n_"), F.max_by(high, "thr").alias("first_"))
    down = W.partitionBy(*by).orderBy(F.desc("_r"))
    up_to = down.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    ranges = ranges.select(
        *by, "_r", F.coalesce(F.sum("p_").over(up_to), F.lit(0)).alias("_p0"), F.coalesce(F.sum("n_").over(up_to), F.lit(0)).alias("_n0"), F.sum("p_").over(whole).alias("np"), F.sum("n_").over(whole).alias("nn"), F.lead("first_").over(down).alias("_below"),
    )
    # null-safe on the group keys: a null key is a group of its own
    on = F.col("a._r") == F.col("b._r")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = pts.alias("a").join(ranges.alias("b"), on).select("a.*", "b._p0", "b._n0", "b.np", "b.nn", "b._below")
    inside = W.partitionBy(*by, "_r").orderBy(F.desc("thr"))
    to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"tps": F.col("_p0") + F.sum("dp").over(to_here), "fps": F.col("_n0") + F.sum("dn").over(to_here), "_next": F.coalesce(F.lead(high).over(inside), F.col("_below"))})
    first = (F.col("tps") == F.col("dp")) & (F.col("fps") == F.col("dn"))
    # with (0, 0) before it the first point has a neighbour on both sides, yet it bends unless steps agree
    kept = F.col("_next").isNull() | (F.col("_next.dp") != F.col("dp")) | (F.col("_next.dn") != F.col("dn")) | first
    return both.select(*by, "thr", "dp", "dn", "tps", "fps", "np", "nn", kept.alias("kept"))


def areas(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """auc (mid-ranks, from whole-number sums) and ap (no interpolation), null where a class is empty."""
    wins2 = F.sum(F.col("dn") * (2 * (F.col("tps") - F.col("dp")) + F.col("dp")))
    return c.groupBy(*by).agg(
        ratio(wins2, 2 * F.max("np") * F.max("nn"), None).alias("auc"), ratio(F.sum(F.col("dp") * (F.col("tps") / (F.col("tps") + F.col("fps")))), F.max("np"), None).alias("ap")
    )


def operating_points(c: DataFrame, by: tuple[str, ...] = (), sens_min: float = 0.9, spec_min: float = 0.7) -> DataFrame:
    """One row: at_sens (tps, fps, thr) of the first point with that sensitivity, and
    at_spec of the last point with that specificity (null: the point at infinity)."""
    point = F.struct("tps", "fps", "thr")
    tpr, spec = ratio("tps", "np", None), 1 - ratio("fps", "nn", None)
    return c.groupBy(*by).agg(
        F.max_by(point, F.when(tpr >= sens_min, F.col("thr"))).alias("at_sens"), F.min_by(point, F.when(spec >= spec_min, F.col("thr"))).alias("at_spec"), F.max("np").alias("np"), F.max("nn").alias("nn")
    )


def operating_rows(c: DataFrame, by: tuple[str, ...] = (), sens_min: float = 0.9, spec_min: float = 0.7, pct: bool = True) -> DataFrame:
    """(by, kind, sens, spec, cutpoint), a row for each target."""
    scale = 100.0 if pct else 1.0
    pts = operating_points(c, by, sens_min, spec_min)
    row = lambda kind, s: F.struct(F.lit(kind).alias("kind"), (F.coalesce(ratio(f"{s}.tps", "np", None), F.lit(0.0)) * scale).alias("sens"), ((1 - F.coalesce(ratio(f"{s}.fps", "nn", None), F.lit(0.0))) * scale).alias("spec"), F.col(f"{s}.thr").alias("cutpoint"))
    return pts.select(*by, F.explode(F.array(row("sens", "at_sens"), row("spec", "at_spec"))).alias("r")).select(*by, "r.*")


def cutpoints(c: DataFrame, by: tuple[str, ...] = (), p_adj: float | dict | Column | None = None) -> DataFrame:
    """(by, j, count, count_adj): scores that maximise tpr - fpr, that balance wrong
    counts at the observed prevalence, and at p_adj.

    p_adj: one prevalence for all groups, a column over the keys, or a dict from
    the first key to its own; a group without one (null, 0 or not in the dict)
    takes its observed prevalence. Ties go to the higher score; the point at
    infinity (null) comes first of all. Only bends of the curve count, as the
    counts can tie inside a segment.
    """
    k = c.where("kept")
    j = F.col("tps") * F.col("nn") - F.col("fps") * F.col("np")
    count = F.abs(F.col("fps") - (F.col("np") - F.col("tps")))
    if isinstance(p_adj, dict):
        p_adj = F.element_at(F.create_map(*[F.lit(x) for kv in p_adj.items() for x in (kv[0], float(kv[1]))]), F.col(by[0])) if p_adj else None
    p = F.lit(p_adj).cast("double") if not isinstance(p_adj, Column) else p_adj.cast("double")
    p = F.when(p != 0, p)
    adj = F.abs(ratio("fps", "nn", None) * (1 - p) - (1 - ratio("tps", "np", None)) * p)
    adj, adj0 = F.coalesce(adj, count.cast("double")), F.coalesce(F.abs(F.lit(0.0) - p), F.col("np").cast("double"))
    best = lambda x: F.min(F.struct(x.alias("v"), (-F.col("thr")).alias("t")))
    agg = k.groupBy(*by).agg(best(-j).alias("j"), best(count).alias("c"), best(adj).alias("a"), F.max("np").alias("np"), F.max(adj0).alias("a0"))
    pick = lambda s, at_infinity: F.when(F.col(f"{s}.v") < F.col(at_infinity) if isinstance(at_infinity, str) else F.col(f"{s}.v") < at_infinity, -F.col(f"{s}.t"))
    return agg.select(*by, pick("j", F.lit(0)).alias("j"), pick("c", "np").alias("count"), pick("a", "a0").alias("count_adj"))


def band(curves: DataFrame, alpha: float = 0.05, digits: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(fpr, lower, med, upper): percentiles of tpr over curves, by rounded fpr."""
    at = half_even(ratio("fps", "nn", None), digits)
    pts = curves.select(*by, at.alias("fpr"), ratio("tps", "np", None).alias("tpr"))
    return pts.groupBy(*by, "fpr").agg(F.percentile("tpr", F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2))).alias("q")).select(*by, "fpr", F.col("q")[0].alias("lower"), F.col("q")[1].alias("med"), F.col("q")[2].alias("upper"))


def threshold_grid(df: DataFrame, by: tuple[str, ...] = (), steps: int = 100, y: str = "y", p: str = "p") -> DataFrame:
    """(by, cutoff, tp, fp, tn, fn) for cutoffs i/steps below 1, from one aggregation.

    Each row counts for the last cutoff that it reaches; sums over at most
    steps + 1 rows of a group give the rest.
    """
    by, width = list(by), 1.0 / steps
    i = F.floor(F.col(p) * steps)
    i = F.when((i + 1) * width <= F.col(p), i + 1).when(i * width > F.col(p), i - 1).otherwise(i)
    i = F.greatest(F.least(i, F.lit(steps - 1)), F.lit(-1)).cast("int")
    got = df.where(F.col(p).isNotNull()).groupBy(*by, i.alias("i")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    lists = got.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.collect_list(F.struct("i", "p", "n")).alias("s"))
    each = lists.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    over = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda a, r: a + F.when(r["i"] >= F.col("i"), r[c]).otherwise(0))
    out = each.select(*by, (F.col("i") * width).alias("cutoff"), over("p").alias("tp"), over("n").alias("fp"), "np", "nn")
    return out.select(*by, "cutoff", "tp", "fp", (F.col("nn") - F.col("fp")).alias("tn"), (F.col("np") - F.col("tp")).alias("fn"))
