"""Leave-one-out values and distribution functions against plain versions."""

import hashlib
import math
import random
from collections import Counter
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import distributions as D
from cohortlens.functions.numbered import numbered_keys
from cohortlens.operators import panel as P
from cohortlens.operators import resample as R

CELLS = ("brier", "auc", "ap", "sens_at", "spec_at")


def plain(rows, sens_min=0.9, spec_min=0.7):
    """The five metrics of (y, p) rows, by definition; None where undefined."""
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    brier = round(sum((p - y) ** 2 for y, p in rows) / len(rows), 4) if rows else None
    points = []
    for t in sorted({p for _, p in rows}, reverse=True):
        points.append((sum(p >= t for p in pos), sum(p >= t for p in neg)))
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    ap, before = 0.0, 0
    for tps, fps in points:
        ap, before = ap + (tps - before) * tps / (tps + fps), tps
    ap = ap / len(pos) if pos else None
    reach = [f for t, f in points if pos and t / len(pos) >= sens_min]
    spec_at = 1 - reach[0] / len(neg) if reach and neg else None
    held = [t for t, f in points if neg and 1 - f / len(neg) >= spec_min]
    sens_at = held[-1] / len(pos) if held and pos else 0.0
    return dict(zip(CELLS, (brier, auc, ap, sens_at, spec_at)))


def close(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < tol)


@pytest.mark.parametrize("seed", range(4))
def test_every_row_left_out(spark, seed):
    rng = random.Random(seed)
    tables = [[(rng.randint(0, 1), round(rng.random(), rng.choice([1, 2]))) for _ in range(rng.choice([2, 3, 7, 25, 60]))] for _ in range(6)]
    tables += [[(1, 0.5)], [(0, 0.5), (1, 0.5)], [(1, 0.2), (1, 0.4)], [(0, 0.1), (0, 0.9), (1, 0.95)], [(1, 0.9), (1, 0.8), (0, 0.1)]]
    for rows in tables:
        got = {(r["y"], r["p"]): r for r in R.jackknife_cells(R.cells(spark.createDataFrame(rows, "y int, p double"))).collect()}
        assert sum(r["weight"] for r in got.values()) == len(rows)
        for i, cell in enumerate(rows):
            want = plain(rows[:i] + rows[i + 1 :])
            for m in CELLS:
                tol = 2e-4 if m == "brier" else 1e-9
                assert close(got[cell][m], want[m], tol), (rows, i, m, got[cell][m], want[m])


def test_the_plain_version_is_the_panel(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(40)]
    p = P.panel(spark.createDataFrame(rows, "y int, p double")).first()
    assert all(close(p[m], v, 2e-4 if m == "brier" else 1e-12) for m, v in plain(rows).items())


def test_differences_leave_the_same_row_out(spark):
    """The acceleration of a difference against rows left out of both panels one by one."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1), rng.randint(0, 1), round(rng.random(), 1)) for _ in range(30)]
    df = spark.createDataFrame(rows, "y int, p double, y2 int, p2 double")
    sides = [R.Intervals(None, None, R.jackknife(c := R.cells(df, *s)), R.jackknife_cells(c)) for s in (("y", "p"), ("y2", "p2"))]
    got = {}
    for r in R._differences(*sides, R.paired_cells(df)).collect():
        got.setdefault(r["metric"], []).extend([r["value"]] * r["weight"])
    for m in ("auc", "ap", "sens_at", "spec_at"):
        want = []
        for i in range(30):
            left = rows[:i] + rows[i + 1 :]
            want.append(plain([x[2:] for x in left])[m] - plain([x[:2] for x in left])[m])
        assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(got[m]), sorted(want), strict=True)), m
    sens = lambda x: round(sum(p >= 0.5 for y, p in x if y) / max(1, sum(y for y, _ in x)), 4)
    want = [sens([x[2:] for j, x in enumerate(rows) if j != i]) - sens([x[:2] for j, x in enumerate(rows) if j != i]) for i in range(30)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(got["sens"]), sorted(want), strict=True))
    assert set(got) == set(R.METRICS)


def test_bca_differences_need_pairs(spark):
    df = spark.createDataFrame([(i % 2, i / 10) for i in range(10)], "y int, p double")
    a = R.bootstrap(df, 5)
    with pytest.raises(ValueError):
        R.difference(a, a, "bca")
    both = df.selectExpr("y", "p", "y as y2", "p as p2")
    assert all(r["d"] == 0 for r in R.difference(a, a, "bca", pairs=R.paired_cells(both)).collect())


def values(spark, f, xs):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    return [r["v"] for r in df.select("i", f("x").alias("v")).orderBy("i").collect()]


def test_erfc_and_the_normal_distribution(spark):
    xs = [-6, -2, -1, -0.3, 0, 1e-9, 0.1, 0.5, 1, 1.2247, 1.23, 1.5, 2, 3, 5, 8, 20, 26]
    assert all(math.isclose(a, math.erfc(x), rel_tol=1e-12) for a, x in zip(values(spark, D.erfc, xs), xs))
    assert all(math.isclose(a, NormalDist().cdf(x), rel_tol=1e-12, abs_tol=1e-15) for a, x in zip(values(spark, D.normal_cdf, xs), xs))
    ps = [1e-300, 1e-100, 1e-12, 1e-5, 0.01, 0.025, 0.2, 0.4999, 0.5, 0.6, 0.9, 0.975, 1 - 1e-9]
    assert all(math.isclose(a, NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-12) for a, p in zip(values(spark, D.normal_quantile, ps), ps))
    assert values(spark, D.normal_quantile, [0, 1, None, 2, -1]) == [0.0, 0.0, None, None, None]
    assert values(spark, D.erfc, [None]) == [None]


@pytest.mark.parametrize("df", [1, 2, 3, 6, 41, 400, 2000])
def test_chi_square_tails(spark, df):
    def tail(x):
        t, k = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
        while k < df:
            t += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
            k += 2
        return t

    xs = [0.01, 1, 3, 10, 18.8669418, 50, 200, 390, 420, 600, 1e4]
    assert all(math.isclose(a, tail(x), rel_tol=1e-11, abs_tol=1e-13) for a, x in zip(values(spark, lambda c: D.chi2_sf(c, df), xs), xs))
    assert values(spark, lambda c: D.chi2_sf(c, df), [0, -1, None, math.inf]) == [1.0, 1.0, None, 0.0]
    with pytest.raises(ValueError):
        D.gamma_tail(0, "x")


def test_tails_stay_in_the_jvm(spark):
    plan = spark.range(3).select(D.chi2_sf("id", 3), D.normal_quantile(F.col("id") / 4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_in_arrays_are_those_of_single_rows():
    single = lambda prefix, k: int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16)
    for prefix in ("7:0:", "10221983:19:1:", "3:0:p:", "x" * 50 + ":", "x" * 70 + ":"):
        for first, last in ((0, 0), (0, 12), (9_995, 20_003), (36_000_001, 36_000_007), (99_999_998, 100_000_002)):
            got = [int(k) for keys in numbered_keys(prefix, first, last) for k in keys]
            assert got == [single(prefix, k) for k in range(first, last)]


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("how", [{}, {"p_adj": 0.3}, {"size": 150_000}, {"size": 20_000, "stratified": False}])
def test_draws_are_counted_and_not_rows(spark, monkeypatch, most, how):
    monkeypatch.setattr(R, "MOST_BROADCAST", most)
    c = [(0, 0.1, 30_000), (0, 0.4, 2), (0, 0.9, 50_000), (1, 0.1, 7), (1, 0.6, 44_000), (1, 0.7, 1)]
    got = R.bootstrap_weights(spark.createDataFrame(c, "y int, p double, n long"), 2, 5, **how)
    if most > 3:  # a task hashes and counts a run of draws; none is a row of its own
        assert "md5" not in got._jdf.queryExecution().toString()
    key = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    of = {y: [p for z, p, n in c if z == y for _ in range(n)] for y in (0, 1)}
    total, want = len(of[0]) + len(of[1]), Counter()
    for rep in range(2):
        share = len(of[1]) / total if "p_adj" not in how else sum(key(f"5:{rep}:p:{k}") < int(0.3 * 2**32) for k in range(total)) / total
        if not how.get("stratified", True):
            every = [(y, p) for y in (0, 1) for p in of[y]]
            want.update((rep, *every[key(f"5:{rep}:{k}") % total]) for k in range(how["size"]))
            continue
        for y in (0, 1):
            m = int((share if y else 1 - share) * how.get("size", total)) if how else len(of[y])
            want.update((rep, y, of[y][key(f"5:{rep}:{y}:{k}") % len(of[y])]) for k in range(m))
    assert {tuple(r)[:3]: r["n"] for r in got.collect()} == dict(want)


def test_keys_come_in_long_arrays():
    assert [len(k) for k in numbered_keys("10221983:19:1:", 100_000, 300_000)] == [50_000] * 4
    single = lambda prefix, k: int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16)
    for prefix in ("", "a", "ab:", "10221983:3:p:", *("x" * n for n in range(42, 52))):
        for first, last in ((99_990, 100_010), (199_990, 200_010), (4_300_000_000, 4_300_000_003)):
            got = [int(k) for keys in numbered_keys(prefix, first, last) for k in keys]
            assert got == [single(prefix, k) for k in range(first, last)]


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("how", [{}, {"p_adj": 0.3}, {"size": 20_000, "stratified": False}])
def test_groups_share_the_keys_of_their_draws(spark, monkeypatch, most, how):
    monkeypatch.setattr(R, "MOST_BROADCAST", most)
    made, plain_runs = [], R._runs
    monkeypatch.setattr(R, "_runs", lambda df, rows: made.append(df.agg(F.sum(rows)).first()[0]) or plain_runs(df, rows))
    groups = {"b": [(0, 0.1, 3_000), (0, 0.4, 2), (1, 0.1, 7), (1, 0.6, 4_000)], "a": [(0, 0.3, 2_009), (1, 0.6, 5_000)], "c": [(0, 0.3, 5)]}
    df = spark.createDataFrame([(g, *c) for g, cells in groups.items() for c in cells] + [(None, 0, 0.5, 9)], "finding string, y int, p double, n long")
    got = {tuple(r) for r in R.bootstrap_weights(df, 2, 5, by="finding", **how).collect()}
    together, made[:] = sum(made), []
    each = {g: {tuple(r) for r in R.bootstrap_weights(spark.createDataFrame(c, "y int, p double, n long"), 2, 5, **how).collect()} for g, c in groups.items()}
    assert got == {(g, *r) for g, rows in each.items() for r in rows}
    assert together < sum(made)


def test_pairs_of_two_findings_need_no_join(spark):
    rows = [(1, "bulk", 0, 0.1), (1, "open", 1, 0.2), (1, "returned", 1, 0.9), (2, "bulk", 1, 0.3), (3, "open", 0, 0.4), (4, "bulk", 0, None), (4, "open", 1, 0.5)]
    rows += [(None, "bulk", 0, 0.1), (None, "open", 1, 0.2), (5, "bulk", 0, 0.6), (5, "bulk", 1, 0.1), (5, "open", 0, 0.7), (5, "open", 0, 0.8)]
    wide = R.paired_rows(spark.createDataFrame(rows, "id int, finding string, y int, p double"), ["id"], "finding", "bulk", "open")
    assert "Join" not in wide._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in R.paired_cells(wide).collect()} == {(0, 0.1, 1, 0.2, 2), (1, 0.6, 0, 0.8, 1)}


@pytest.mark.parametrize(("name", "times"), [("r09_diff_padj", 1), ("r09_diff_ci", 1), ("s10_kept_intervals", 2), ("s10_difference_of_kept_runs", 2)])
def test_both_findings_are_drawn_at_once(spark, monkeypatch, name, times):
    from cohortlens.plans import catalog, catalog_batches, catalog_cohort, catalog_inference  # noqa: F401

    calls, drawn = [], R.bootstrap_weights
    kept, keep = [], R._kept
    monkeypatch.setattr(R, "_kept", lambda df, what: kept.append(what) or keep(df, what))
    monkeypatch.setattr(R, "bootstrap_weights", lambda *a, **k: calls.append(1) or drawn(*a, **k))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == times
    assert ("pairs" in kept) == (name == "r09_diff_ci")  # rows are paired once and not for each use
