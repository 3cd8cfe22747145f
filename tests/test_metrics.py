"""Hand-computed fixtures and properties of metrics and curves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.functions.distributions import chi2_sf, normal_quantile
from cohortlens.operators import cohort as C
from cohortlens.operators import confusion as M
from cohortlens.operators import panel as P
from cohortlens.operators import resample as R
from cohortlens.operators import roc
from cohortlens.operators.scoring import score_batches

A = list(zip([0, 0, 1, 1, 0, 1, 0, 1], [0.1, 0.4, 0.35, 0.8, 0.4, 0.9, 0.7, 0.6]))


def scored(spark, pairs):
    return spark.createDataFrame([(y, p) for y, p in pairs], "y int, p double")


def test_curve_and_areas(spark, rows):
    c = roc.curve(scored(spark, A))
    got = [(r["thr"], r["tps"], r["fps"], r["kept"]) for r in c.orderBy(F.desc("thr")).collect()]
    assert got == [(0.9, 1, 0, True), (0.8, 2, 0, True), (0.7, 2, 1, True), (0.6, 3, 1, True), (0.4, 3, 3, True), (0.35, 4, 3, True), (0.1, 4, 4, True)]
    a = roc.areas(c).first()
    assert a["auc"] == 0.75 and round(a["ap"], 7) == 0.8303571


def test_cutpoints(spark):
    r = roc.cutpoints(roc.curve(scored(spark, A)), (), 0.1).first()
    assert (r["j"], r["count"], r["count_adj"]) == (0.8, 0.6, 0.8)
    b = [(y, p) for p in (0.9, 0.7, 0.5, 0.3, 0.1) for y in (0, 1)]
    r = roc.cutpoints(roc.curve(scored(spark, b)), (), 0.5).first()
    assert (r["j"], r["count"], r["count_adj"]) == (None, 0.9, 0.9)  # inner points of a straight curve do not count


def test_panel(spark):
    r = P.panel(scored(spark, A)).first().asDict()
    assert [r[k] for k in ("tp", "fp", "tn", "fn")] == [3, 1, 3, 1]
    assert [r[k] for k in ("sens", "spec", "ppv", "npv", "f1", "j", "mcc", "brier", "auc", "sens_at", "spec_at", "prev_diff")] == [0.75] * 5 + [0.5, 0.5, 0.1816, 0.75, 0.75, 0.25, 0]
    hard = P.panel(scored(spark, [(1, 1.0), (0, 1.0), (1, 0.0)]), kind="auto")
    assert "sens_at" not in hard.columns and hard.first()["auc"] == 0.0


def test_counts_from_rates(spark):
    one = lambda *x: spark.range(1).select(*[v.alias(k) for k, v in M.counts_from_rates(*map(F.lit, x)).items()]).first()
    assert tuple(one(0.5, 0.5, 0.5, 10)) == (2, 2, 2, 2)
    assert tuple(one(0.75, 0.75, 0.1, 20)) == (2, 4, 14, 0)


def test_lost_sign_and_mcnemar(spark):
    c = spark.createDataFrame([(10, 40, 15, 35)], "tp long, fp long, tn long, fn long")
    assert round(c.select(M.Rates().abs_mcc()).first()[0], 4) == 0.5025
    c = spark.createDataFrame([(0, 10, 0, 4)], "tp long, fp long, tn long, fn long")
    r = M.mcnemar(c).withColumn("p", chi2_sf("stat")).first()
    assert round(r["stat"], 7) == 1.7857143 and round(r["p"], 7) == 0.1814492
    assert round(M.mcnemar(c, False).first()["stat"], 7) == 2.5714286


def test_edges(spark):
    assert P.panel(scored(spark, [(0, 0.2), (0, 0.7)])).first()["rel_prev_diff"] is None
    r = P.panel(scored(spark, [(0, 0.2), (1, 0.3)])).first()  # nothing predicted
    assert r["mcc"] is None and r["ppv"] == 0.0
    assert roc.curve(scored(spark, [])).count() == 0
    assert roc.areas(roc.curve(scored(spark, [(1, 0.5), (None, 0.5), (1, None)]))).first()["auc"] is None


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), (None, 1, 0.2), (None, 0, 0.8)], "g string, y int, p double")
    got = {r["g"]: r["auc"] for r in P.panel(df, ("g",)).collect()}
    assert got == {"a": 1.0, None: 0.0}


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_area_properties(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 1), round(rng.random(), rng.choice([1, 3]))) for _ in range(300)]
    auc = roc.areas(roc.curve(scored(spark, pairs))).first()["auc"]
    assert auc == pytest.approx(brute_auc(pairs))
    flipped = roc.areas(roc.curve(scored(spark, [(y, 1 - p) for y, p in pairs]))).first()["auc"]
    assert auc + flipped == pytest.approx(1)


def test_repartitioning_changes_nothing(spark, rows):
    df = scored(spark, [(int(i % 3 == 0), (i * 37 % 101) / 101) for i in range(500)])
    assert rows(roc.curve(df.repartition(7))) == rows(roc.curve(df.coalesce(1)))


def test_threshold_grid(spark):
    g = {round(r["cutoff"], 2): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in roc.threshold_grid(scored(spark, [*A, (1, 1.0), (0, 0.0)])).collect()}
    for i in (0, 10, 35, 36, 90, 99):
        c = i * 0.01
        rows = [*A, (1, 1.0), (0, 0.0)]
        assert g[round(c, 2)] == tuple(sum(1 for y, p in rows if y == a and (p >= c) == b) for a, b in ((1, True), (0, True), (0, False), (1, False)))


def test_observations_and_weights(spark):
    cells = spark.createDataFrame([(3, 1, 2, 0)], "tp long, fp long, tn long, fn long")
    got = sorted((r["at"], r["y"], r["yhat"]) for r in M.observations(cells).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1)]
    for draw in (R.bootstrap_weights, R.multinomial_weights):
        check_weights(draw(R.cells(scored(spark, A)), 5))


def check_weights(w):
    per = {(r["rep"], r["y"]): r["n"] for r in w.groupBy("rep", "y").agg(F.sum("n").alias("n")).collect()}
    assert per == {(r, y): 4 for r in range(5) for y in (0, 1)}


def test_jackknife_against_brute_force(spark):
    got = {}
    for r in R.jackknife(R.cells(scored(spark, A))).collect():
        got[r["y"], r["hit"], r["metric"]] = (r["value"], r["weight"])
    for i, (y, p) in enumerate(A):
        rest = A[:i] + A[i + 1 :]
        tp, pos = sum(1 for a, b in rest if a == 1 and b >= 0.5), sum(a for a, _ in rest)
        assert got[y, p >= 0.5, "sens"][0] == round(tp / pos, 4)
    auc = {(r["y"], r["p"]): r["auc"] for r in R.jackknife_auc(R.cells(scored(spark, A))).collect()}
    for i, key in enumerate(A):
        assert auc[key] == pytest.approx(brute_auc(A[:i] + A[i + 1 :]))


@pytest.mark.parametrize("method", ["pct", "emp", "diff", "bca"])
def test_intervals_hold_the_point(spark, method):
    rng = random.Random(4)
    df = scored(spark, [(y, min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2)))) for y in (0, 1) for _ in range(150)])
    out = R.bootstrap(df, 30, method)
    counts = {"tp", "fp", "tn", "fn", "true_prev", "pred_prev", "prev_diff"}  # of 150 rows a label; the rest are rates
    for r in out.cis.collect():
        assert r["lower"] <= r["upper"] and abs(r["stat"] - (r["lower"] + r["upper"]) / 2) < 0.15 * (150 if r["metric"] in counts else 1)


def test_difference_of_equals_is_zero(spark):
    a = R.bootstrap(scored(spark, A * 10), 10, "pct")
    assert all(r["d"] == r["lower"] == r["upper"] == 0 for r in R.difference(a, a).collect())


def test_power_simulation(spark):
    sim = R.power_simulation(spark, sizes=(200, 1001, 400), draws=200)
    got = {(r["n"], r["n_pos"]): r["specificity"] for r in R.margins(sim).collect()}
    assert len(got) == 6 and got[200, 24] > got[1000, 120] > 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.half_even(F.lit(x), 0)) for x in (12.5, 37.5, 2.5)] == [12, 38, 2]
    date = lambda s: F.lit(s).cast("date")
    assert one(S.completed_years(date("2000-02-29"), date("2015-02-28"))) == 15
    assert one(S.completed_years(date("2000-03-15"), date("2015-03-14"))) == 14
    bins = lambda x: one(S.cut(F.lit(x), [15, 25, 35, 45, 55, 65, 99], ["15-24", "25-34", "35-44", "45-54", "55-64", ">=65"]))
    assert [bins(x) for x in (15, 25, 26, 99, 100)] == ["nan", "15-24", "25-34", ">=65", "nan"]
    near = lambda n: one(S.nearest_percentile(F.array(*[F.lit(float(i)) for i in range(n)]), F.lit(50)))
    assert [near(n) for n in (2, 4, 6)] == [0, 2, 2]
    assert one(S.format_interval(F.lit(0.5), F.lit(0.25), F.lit(0.75))) == "0.5000 (0.2500, 0.7500)"
    assert one(normal_quantile(F.lit(0.0))) == 0 and math.isclose(one(normal_quantile(F.lit(0.975))), 1.959964, abs_tol=1e-6)
    assert math.isclose(one(chi2_sf(F.lit(18.8669418), 6)), 0.0044, abs_tol=2e-4)
    names = spark.createDataFrame([("pan_12_0042",), ("pan_12_00000042",), ("a",)], "f string").select(S.trim_zeroes("f")).collect()
    assert [r[0] for r in names] == ["pan_12_0042", "pan_12_000042", "a"]


@pytest.mark.parametrize("make", [lambda u: u / 1000, lambda u: 1 - u / 1e6, lambda u: np.log(u / (1 - u)), lambda u: u], ids=["tiny", "sure", "logits", "even"])
def test_score_ranges_spread_crowded_scores(spark, make):
    """No range holds more than a few times its share, whatever the scores; order is kept."""
    u = np.random.default_rng(1).uniform(1e-9, 1 - 1e-9, 20000)
    df = spark.createDataFrame([(float(x), int(v > 0.5)) for x, v in zip(make(u), u)], "p double, y int")
    ranged = df.select("p", roc.score_range("p").alias("r"))
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert max(sizes) < 20000 / 100
    lows = ranged.groupBy("r").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("r").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(lows, lows[1:]))
    assert abs(roc.areas(roc.curve(df)).first()["auc"] - 0.5) > 0.499


def test_scores_beyond_any_range(spark):
    df = spark.createDataFrame([(0, float("-inf")), (1, 0.3), (0, -5.0), (1, float("inf")), (1, None)], "y int, p double")
    assert [(r["tps"], r["fps"]) for r in roc.curve(df).orderBy(F.desc("thr")).collect()] == [(1, 0), (2, 0), (2, 1), (2, 2)]


def test_adjusted_draws_have_their_sizes(spark):
    df = spark.createDataFrame([(int(i % 4 == 0), i / 1000) for i in range(1000)], "y int, p double")
    c = R.cells(df)
    for draws in (R.bootstrap_weights, R.multinomial_weights):
        got = {}
        for r in draws(c, 30, 5, p_adj=0.1).groupBy("rep", "y").agg(F.sum("n").alias("n")).collect():
            got[r["rep"], r["y"]] = r["n"]
        ones = np.array([got[i, 1] for i in range(30)])
        assert all(999 <= got[i, 0] + got[i, 1] <= 1000 for i in range(30)) and 80 < ones.mean() < 120 and len(set(ones)) > 5
        small = draws(c, 4, 5, size=100).groupBy("rep", "y").agg(F.sum("n").alias("n")).collect()
        assert {(r["y"], r["n"]) for r in small} == {(0, 75), (1, 25)}
        free = draws(c, 20, 5, size=200, stratified=False).groupBy("rep").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("k")).collect()
        assert all(r["n"] == 200 for r in free) and len({r["k"] for r in free}) > 3


def test_jackknife_of_the_panel(spark):
    rows = [(int(i % 3 == 0), (i * 7 % 20) / 20) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = {}
    for r in R.jackknife_panel(R.cells(df)).collect():
        got.setdefault(r["metric"], []).extend([r["value"]] * r["weight"])
    for metric in ("sens", "mcc", "brier", "auc", "true_prev", "rel_prev_diff"):
        want = []
        for i in set(range(60)):
            left = spark.createDataFrame([x for j, x in enumerate(rows) if j != i], "y int, p double") if i < 6 else None
            if left is not None:
                want.append(P.panel(left).first()[metric])
        assert all(any(math.isclose(w, g, abs_tol=1e-9) for g in got[metric]) for w in want) and len(got[metric]) == 60


def test_weights_count_like_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0.9, 3), (0, 0.2, 2), (1, 0.4, 1), (0, 0.6, 2)], "y int, p double, n long")
    each = df.withColumn("i", F.explode(F.expr("sequence(1, n)"))).drop("n", "i")
    assert P.panel(df, weight="n").collect() == P.panel(each).collect()


def test_cutpoints_take_a_prevalence_for_each_group(spark):
    df = spark.createDataFrame([(g, int(i % 3 == 0), i / 30) for g in "ab" for i in range(30)], "g string, y int, p double")
    c = roc.curve(df, ("g",))
    got = {r["g"]: r["count_adj"] for r in roc.cutpoints(c, ("g",), {"a": 0.9}).collect()}
    one = {r["g"]: (r["count_adj"], r["count"]) for r in roc.cutpoints(c, ("g",), 0.9).collect()}
    assert got["a"] == one["a"][0] and got["b"] == one["b"][1]


def test_lookup_is_the_same_in_every_run(spark):
    table = spark.createDataFrame([("k", "b"), ("k", "a"), ("j", "c")], "name string, value string")
    df = spark.createDataFrame([("k",), ("j",), (None,)], "key string")
    assert sorted(r["value"] for r in C.lookup(df, table, "key", "name", "value").collect()) == ["NA", "a", "c"]


def test_scorer_sees_batches_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 5.0])], "id long, pixels array<double>")
    got = score_batches(df, lambda: lambda x: np.stack([x.sum(axis=1), x[:, 0]], axis=1), ["sum", "first"]).orderBy("id").collect()
    assert [(r["sum_prob"], r["first_prob"]) for r in got] == [(3.0, 1.0), (None, None), (8.0, 3.0)]


def test_tails_do_not_overflow(spark):
    r = spark.range(1).select(chi2_sf(F.lit(1e4), 400).alias("far"), chi2_sf(F.lit(390.0), 400).alias("near")).first()
    assert r["far"] < 1e-300 and math.isclose(r["near"], 0.63, abs_tol=0.02)
