"""Sampling, splitting, bootstrap and jackknife on hash keys that any engine can recompute."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType

from ..functions.distributions import normal_cdf, normal_quantile
from ..functions.names import free_name
from ..functions.numbered import numbered_keys
from ..functions.scalar import half_even, hash_key, nearest_percentile, ratio
from ..shipping import shipped
from ..sources.scratch import new_path
from .panel import COLUMNS, panel
from .roc import areas, curve, score_range

METRICS = COLUMNS  # of the whole panel
BLOCK = 1024
PER_OCTAVE = 64  # ranges of the score over which draws are dealt
REPS_AT_ONCE = 10  # replicates that a task draws for a range
RUN = 100_000  # draws that a task hashes and counts at a time
TASK = 3_000_000  # draws below which a task is not worth its start
MOST_BROADCAST = 200_000  # cells up to which draws look them up in memory


def smallest_keys(df: DataFrame, n: int, seed: int, id_col: str = "id", by: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """The n rows of each group with the smallest hash keys, with their place in that order as `rank`.

    No group is one task's work: rows are counted in 65,536 ranges of the
    key, ranges that lie beyond the n-th row are dropped, and ranks are taken
    within a range and added to the rows before it. Null groups are groups.
    """
    by = list(by)
    key, part, count, before = (free_name(x, df.columns) for x in ("_key", "_range", "_n", "_before"))
    keyed = df.withColumn(key, hash_key(seed, id_col)).withColumn(part, F.shiftright(key, 16).cast("int"))
    up_to = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    ranges = keyed.groupBy(*by, part).agg(F.count(F.lit(1)).alias(count)).withColumn(before, F.coalesce(F.sum(count).over(up_to), F.lit(0))).where(F.col(before) < n)
    on = F.col(f"a.{part}") == F.col(f"b.{part}")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    near = keyed.alias("a").join(ranges.alias("b"), on).select("a.*", f"b.{before}")
    place = F.row_number().over(W.partitionBy(*by, part).orderBy(key, id_col))
    return near.withColumn(rank, F.col(before) + place).where(F.col(rank) <= n).drop(key, part, before)


def resample_prevalence(df: DataFrame, p_adj: float, seed: int = 2022, y: str = "y", id_col: str = "id") -> DataFrame:
    """All rows of label 0 and int(N * p_adj) of label 1, without replacement."""
    n, rank = df.agg(F.count(F.lit(1))).first()[0], free_name("rank", df.columns)
    return df.where(F.col(y) == 0).unionByName(smallest_keys(df.where(F.col(y) == 1), int(n * p_adj), seed, id_col, rank=rank).drop(rank))


def fixed_split(df: DataFrame, stratum: Column, size: int, seed: int = 2022, id_col: str = "id", check: bool = True) -> DataFrame:
    """df with split: of each non-null stratum `size` rows, half val and half test; all else train.

    A stratum that is too small is an error.
    """
    layer, own, place, rank = (free_name(x, df.columns) for x in ("_stratum", "_id", "_split", "_rank"))
    marked = df.withColumn(layer, stratum)
    known = marked.where(F.col(layer).isNotNull())
    if check:
        have = {r[0]: r[1] for r in known.groupBy(layer).agg(F.count(F.lit(1))).collect()}
        if small := [s for s, n in have.items() if n < size]:
            raise ValueError(f"strata with fewer than {size} rows: {small}")
    taken = smallest_keys(known, size, seed, id_col, (layer,), rank)
    taken = taken.select(F.col(id_col).alias(own), F.when(F.col(rank) <= size // 2, "val").otherwise("test").alias(place))
    return marked.join(taken, F.col(id_col) == F.col(own), "left").withColumn("split", F.coalesce(place, F.lit("train"))).drop(own, place, layer)


def hash_split(df: DataFrame, share: float = 0.7, seed: int = 2022, id_col: str = "id") -> DataFrame:
    """split train for about this share of rows, val for the rest; no shuffle."""
    return df.withColumn("split", F.when(hash_key(seed, id_col) < int(share * 2**32), "train").otherwise("val"))


def scenario_split(df: DataFrame, good_site: Column, preferred: Column, min_n: int, seed: int = 2022, id_col: str = "id") -> DataFrame:
    """split into train, val, test_high and test_low.

    Settings are high (good sites) and low. Of (tb, abnormal without tb) in a
    setting the rarer gets 2*min_n rows, the other 2*int(ratio*min_n) by their
    ratio there; normals 2*min_n. Pools are rows of both settings: tb and normal
    from preferred reads, the others from all. The high sample is drawn first,
    the low one from what is left; half of each goes to val.
    """
    kind = F.when(F.col("abnormal_tb") == 1, "tb").when(F.col("abnormal") == 1, "no_tb").when(F.col("abnormal") == 0, "normal")
    sort, site, own, to, rank = (free_name(x, df.columns) for x in ("_kind", "_high", "_id", "_split", "_rank"))
    marked = df.withColumn(sort, kind).withColumn(site, good_site)
    both = marked.where(F.col(sort).isNotNull() & F.col(site).isNotNull())
    seen = {(r[0], r[1]): r[2] for r in both.groupBy(site, sort).agg(F.count(F.lit(1))).collect()}

    def sizes(high: bool) -> dict[str, int]:
        tb, no = seen.get((high, "tb"), 0), seen.get((high, "no_tb"), 0)
        big = 2 * int(max(tb, no) / max(1, min(tb, no)) * min_n)
        return {"tb": 2 * min_n if tb <= no else big, "no_tb": big if tb <= no else 2 * min_n, "normal": 2 * min_n}

    pool = marked.where(F.col(sort).isNotNull() & (preferred | (F.col(sort) == "no_tb")))
    high, low = sizes(True), sizes(False)
    ranked = smallest_keys(pool, max(high[k] + low[k] for k in high), seed, id_col, (sort,), rank)
    of = lambda s: F.when(F.col(sort) == "tb", s["tb"]).when(F.col(sort) == "no_tb", s["no_tb"]).otherwise(s["normal"])
    r, h, w = F.col(rank), of(high), of(low)
    place = F.when(r <= h, F.when(r <= h / 2, "val").otherwise("test_high")).when(r <= h + w, F.when(r - h <= w / 2, "val").otherwise("test_low"))
    drawn = ranked.select(F.col(id_col).alias(own), place.alias(to)).where(F.col(to).isNotNull())
    return marked.join(drawn, F.col(id_col) == F.col(own), "left").withColumn("split", F.coalesce(to, F.lit("train"))).drop(own, to, sort, site)


def cells(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, p, n): rows by label and score; all that a replicate needs to know of the data."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def draw_sizes(c: DataFrame, reps: int, seed: int, p_adj: float | None, size: int | None, positives) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """Rows of each label, and (rep, label, draws).

    Without p_adj and size every label keeps its rows. Else a replicate has
    int((1 - p) * size) rows of label 0 and int(p * size) of label 1, size being
    all rows by default; p is the observed share or, with p_adj, that share of
    as many trials as there are rows, which positives(rows) counts by replicate.
    """
    own = {y: n for y, n in c.groupBy("y").agg(F.sum("n")).collect() if y in (0, 1)}
    total = sum(own.values())
    if not total or (p_adj is None and size is None):
        return own, [(rep, y, n) for rep in range(reps) for y, n in own.items()]
    shares = [own.get(1, 0) / total] * reps if p_adj is None else [k / total for k in positives(total)]
    sizes = [(rep, y, int(p * (size or total))) for rep, share in enumerate(shares) for y, p in ((0, 1 - share), (1, share))]
    return own, [(rep, y, m) for rep, y, m in sizes if y in own]


def _runs(df: DataFrame, rows: str, draws: int) -> DataFrame:
    """df with (first, last): the numbers below its column `rows` in runs of RUN, dealt evenly to tasks.

    draws: the sum of `rows`. A task of draws costs half a second before its
    first, so there are no more tasks than TASK draws each keep busy, beside one
    for each core, up to the partitions of a shuffle.
    """
    spark = df.sparkSession
    runs = df.withColumn("first", F.explode(F.expr(f"sequence(0L, {rows} - 1, {RUN}L)"))).withColumn("last", F.least(F.col("first") + RUN, F.col(rows)))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shipped(runs).repartition(min(most, max(spark.sparkContext.defaultParallelism, -(-draws // TASK))))


def _by_cell(i: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the sorted numbers i lie in each cell; ends are the numbers after the cells, sorted."""
    if len(ends) < len(i):
        return np.diff(np.searchsorted(i, ends), prepend=0)
    return np.bincount(np.searchsorted(ends, i, side="right"), minlength=len(ends))


def _drawn(runs: DataFrame, name: str, ends: dict[tuple[int, int], np.ndarray] | None) -> DataFrame:
    """Draws of runs (rep, s, first, last, of): draw k is row (key of "name:k") modulo own, name a pattern of rep and s.

    `of` lists (g, m, own): a key is made once for all groups g that take it, which
    are those with more than k draws m. With ends (g, s: a label's cells, as the
    number of the row after each, sorted) counts come out, (rep, s, g, hi, n), a row
    for each cell that a run has drawn; without them a row (rep, s, g, i) for each
    draw. A task holds one run's counts and STEP draws at a time.
    """

    def batch(rep: int, s: int, g: int, **columns: np.ndarray) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        same = [pa.array(np.full(n, rep)), pa.array(np.full(n, s, np.int32)), pa.array(np.full(n, g, np.int32))]
        return pa.RecordBatch.from_arrays(same + [pa.array(x.astype(np.int64)) for x in columns.values()], ["rep", "s", "g", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, s, first, last, of in zip(*(b.column(c).to_pylist() for c in ("rep", "s", "first", "last", "of"))):
                of = [(x["g"], x["m"], x["own"]) for x in of]
                seen = None if ends is None else {g: np.zeros(len(ends[g, s]), np.int64) for g, _, _ in of}
                for keys in numbered_keys(name.format(rep=rep, s=s), first, last):
                    for g, m, own in of:
                        taken = keys[: max(0, m - first)]
                        i = taken % np.uint32(own) if own < 1 << 32 else taken.copy()  # keys are below 2^32
                        if ends is None:
                            yield batch(rep, s, g, i=i)
                        else:
                            i.sort()
                            seen[g] += _by_cell(i, ends[g, s])
                    first += len(keys)
                for g in seen or ():
                    at = np.flatnonzero(seen[g])
                    yield batch(rep, s, g, hi=ends[g, s][at], n=seen[g][at])

    return shipped(runs).mapInArrow(run, "rep long, s int, g int, i long" if ends is None else "rep long, s int, g int, hi long, n long")


def bootstrap_weights(c: DataFrame, reps: int, seed: int = 10221983, p_adj: float | None = None, size: int | None = None, stratified: bool = True, by: str | None = None) -> DataFrame:
    """(by, rep, y, p, n): how often a replicate draws a cell, by hashes that SQL can repeat.

    Stratified by label: draw k of label y in replicate r takes row (key of
    "seed:r:y:k") modulo the label's rows, these being ordered by score; how many
    draws there are says draw_sizes (trial k of p_adj succeeds if the key of
    "seed:r:p:k" is below p_adj of all keys). Not stratified: `size` draws, all
    rows by default, with keys of "seed:r:k" from all rows by label, then score.
    Rows are never numbered, and no draw is a row where there are at most
    MOST_BROADCAST cells: a task hashes a run of draws in arrays and counts them
    by cell. Beyond, draws find their cell by blocks of BLOCK numbers that cells
    cover. by: a column whose values (a handful; null is none) are groups, each drawn
    as by itself; the same keys serve all, so a key is made once (trials: once for
    groups with as many rows).
    """
    spark = c.sparkSession

    @cache
    def positives(total: int) -> list[int]:
        share = int(p_adj * 2**32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                each = list(zip(*(b.column(x).to_pylist() for x in ("rep", "first", "last"))))
                hits = [sum(int((keys < share).sum()) for keys in numbered_keys(f"{seed}:{rep}:p:", first, last)) for rep, first, last in each]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(hits, pa.int64())], ["rep", "n"])

        trials = _runs(spark.createDataFrame([(r, total) for r in range(reps)], "rep long, m long"), "m", reps * total)
        hit = shipped(trials).mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
        found = {r["rep"]: r["n"] for r in hit.collect()}  # a row for each replicate
        return [found[r] for r in range(reps)]

    values = [None] if by is None else sorted(r[0] for r in c.where(F.col(by).isNotNull()).select(by).distinct().collect())
    owns, wanted = [], {}
    for g, value in enumerate(values):
        own, sizes = draw_sizes(c if by is None else c.where(F.col(by) == value), reps, seed, p_adj, size, positives)
        owns.append(own)
        if not stratified:
            sizes = [(r, -1, size or sum(own.values())) for r in range(reps)]
        for r, s, m in sizes:
            if m > 0:
                wanted.setdefault((r, s), []).append((g, m, own.get(s, sum(own.values()))))
    rows = [(r, s, max(m for _, m, _ in of), of) for (r, s), of in wanted.items()]
    group = F.lit(0) if by is None else F.coalesce(*[F.when(F.col(by) == v, g) for g, v in enumerate(values)], F.lit(None).cast("int"))
    ranged = c.select(group.alias("g"), "y", "p", "n").where(F.col("y").isin(0, 1) & F.col("g").isNotNull()).withColumn("r", score_range("p", PER_OCTAVE))
    first = F.sum("n").over(W.partitionBy("g", "y").orderBy("r")) - F.col("n")
    sums = ranged.groupBy("g", "y", "r").agg(F.sum("n").alias("n")).select("g", "y", "r", first.alias("before"))
    inside = F.sum("n").over(W.partitionBy("g", "y", "r").orderBy("p"))
    zeros = F.coalesce(*[F.when(F.col("g") == g, own.get(0, 0)) for g, own in enumerate(owns)], F.lit(0))
    offset = F.when(F.col("y") == 1, zeros).otherwise(0) if not stratified else F.lit(0)
    placed = ranged.join(sums, ["g", "y", "r"]).withColumn("hi", inside + F.col("before") + offset).withColumn("lo", F.col("hi") - F.col("n"))
    runs = _runs(spark.createDataFrame(rows, "rep long, s int, m long, of array<struct<g:int,m:long,own:long>>"), "m", sum(m for _, _, m, _ in rows))
    name = f"{seed}:{{rep}}:{{s}}:" if stratified else f"{seed}:{{rep}}:"
    own_value = [] if by is None else [F.element_at(F.array(*[F.lit(v) for v in values]).cast(ArrayType(c.schema[by].dataType)), F.col("g") + 1).alias(by)]
    found = placed.select("g", "y", "hi").limit(MOST_BROADCAST + 1).collect()
    label = lambda d: (d["s"] == F.col("y")) if stratified else F.lit(True)
    if len(found) <= MOST_BROADCAST:
        each = {(g, s) for _, s, _, of in rows for g, _, _ in of}
        ends = {(g, s): np.array(sorted(hi for h, y, hi in found if h == g and s in (y, -1)), np.uint32 if max(owns[g].values()) < 1 << 31 else np.int64) for g, s in each}
        counts = _drawn(runs, name, ends).groupBy("rep", "s", "g", "hi").agg(F.sum("n").alias("n"))
        cell = F.broadcast(placed.select("y", "p", F.col("g").alias("_g"), F.col("hi").alias("_hi")))  # MOST_BROADCAST rows at most
        return counts.join(cell, (F.col("g") == F.col("_g")) & (F.col("hi") == F.col("_hi")) & label(counts)).select(*own_value, "rep", "y", "p", "n")
    blocks = placed.select(F.col("g").alias("_g"), "y", "p", "lo", "hi", F.explode(F.expr(f"sequence(lo div {BLOCK}, (hi - 1) div {BLOCK})")).alias("_block"))
    draws = _drawn(runs, name, None).withColumn("block", F.expr(f"i div {BLOCK}"))
    met = draws.join(blocks, (F.col("block") == F.col("_block")) & (F.col("g") == F.col("_g")) & label(draws)).where("i >= lo and i < hi")
    return met.groupBy("g", "rep", "y", "p").agg(F.count(F.lit(1)).alias("n")).select(*own_value, "rep", "y", "p", "n")


def multinomial_weights(c: DataFrame, reps: int, seed: int = 10221983, p_adj: float | None = None, size: int | None = None, stratified: bool = True) -> DataFrame:
    """(rep, y, p, n) as bootstrap_weights gives, drawn as counts: cells x reps
    numbers instead of rows x reps draws.

    A label's draws are dealt to ranges of its cells first and within a range to
    its cells, each by a generator seeded with what it is for. A task draws
    REPS_AT_ONCE replicates of a range; what ranges get is a table that is joined,
    so a task holds one number for each range and no more.
    """
    def positives(total: int) -> list[int]:
        return [int(np.random.default_rng([seed, rep, 2]).binomial(total, p_adj)) for rep in range(reps)]

    own, sizes = draw_sizes(c, reps, seed, p_adj, size, positives)
    total = sum(own.values())
    if not stratified:
        one = [int(np.random.default_rng([seed, rep, 3]).binomial(size or total, own.get(1, 0) / max(1, total))) for rep in range(reps)]
        sizes = [(rep, y, m) for rep in range(reps) for y, m in ((1, one[rep]), (0, (size or total) - one[rep])) if y in own]
    ranged = c.where(F.col("y").isin(0, 1)).withColumn("r", score_range("p", PER_OCTAVE))
    held: dict[int, tuple[list[int], np.ndarray]] = {}
    for z in own:
        rows = sorted((r["r"], r["n"]) for r in ranged.where(F.col("y") == z).groupBy("r").agg(F.sum("n").alias("n")).collect())  # a row for each range
        held[z] = [r for r, _ in rows], np.array([n for _, n in rows], float) / own[z]

    def deal(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """What each range of a label gets in each replicate of a block."""
        y, block = key
        ranges, share = held[y]
        g = g.sort_values("rep")
        n = np.stack([np.random.default_rng([seed, rep, y]).multinomial(m, share) for rep, m in zip(g["rep"].tolist(), g["m"].tolist())])
        return pd.DataFrame({"y": y, "r": ranges, "block": block, "reps": [g["rep"].tolist()] * len(ranges), "given": n.T.tolist()})

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y, r, _ = key
        g = g.sort_values("p")
        share, reps_ = g["n"].to_numpy(float) / g["n"].sum(), np.array(g["reps"].iloc[0])
        n = np.stack([np.random.default_rng([seed, rep, y, r + (1 << 20)]).multinomial(k, share) for rep, k in zip(reps_.tolist(), g["given"].iloc[0])])
        rep, cell = np.nonzero(n)
        return pd.DataFrame({"rep": reps_[rep].astype("int64"), "y": y, "p": g["p"].to_numpy()[cell], "n": n[rep, cell]})

    wanted = c.sparkSession.createDataFrame([(y, rep // REPS_AT_ONCE, rep, m) for rep, y, m in sizes], "y int, block int, rep long, m long")
    dealt = shipped(wanted).groupBy("y", "block").applyInPandas(deal, "y int, r long, block int, reps array<long>, given array<long>")
    each = ranged.withColumns({"y": F.col("y").cast("int"), "r": F.col("r").cast("long")}).join(dealt, ["y", "r"])
    return shipped(each).groupBy("y", "r", "block").applyInPandas(draw, "rep long, y int, p double, n long")


def scores(c: DataFrame, by: tuple[str, ...] = (), cut: float = 0.5, digits: int = 4, p_adj: float | None = None, kind: str = "prob") -> DataFrame:
    """(by, metric, value): the panel of weighted cells (y, p, n), a row for each metric; areas have six digits."""
    t = panel(c, by, cut, p_adj, kind, weight="n", digits=digits)
    areas_ = ("auc", "ap", "sens_at", "spec_at")
    each = [F.struct(F.lit(m).alias("metric"), (half_even(m, 6) if m in areas_ else F.col(m)).cast("double").alias("value")) for m in METRICS if m in t.columns]
    return t.select(*by, F.explode(F.array(*each)).alias("s")).select(*by, "s.*")


def jackknife(c: DataFrame, cut: float = 0.5, digits: int = 4, p_adj: float | None = None) -> DataFrame:
    """(y, hit, metric, value, weight): what follows from counts without one row, for each
    of the at most four cells that the row can be in, and the number of such rows."""
    table = c.groupBy("y", (F.col("p") >= cut).alias("hit")).agg(F.sum("n").alias("n"))
    out = table.select(F.col("y").alias("oy"), F.col("hit").alias("oh"), F.col("n").alias("weight")).crossJoin(table)  # at most 4 x 4 rows
    left = out.withColumn("n", F.col("n") - ((F.col("y") == F.col("oy")) & (F.col("hit") == F.col("oh"))).cast("long")).withColumn("p", F.col("hit").cast("double"))
    each = scores(left, ("oy", "oh", "weight"), 0.5, digits, p_adj, "hard").where(~F.col("metric").isin("auc", "ap", "brier"))
    return each.select(F.col("oy").alias("y"), F.col("oh").alias("hit"), "metric", "value", "weight")


def _running(df: DataFrame, names: list[str], order: str) -> DataFrame:
    """df with <name>_to, the sum of a column over rows of the same or a higher
    `order` (which is unique), and <name>_all: within ranges first, then over these."""
    ranged = df.withColumn("_r", score_range(order, PER_OCTAVE))
    sums = ranged.groupBy("_r").agg(*[F.sum(n).alias(n) for n in names])
    above = W.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = [F.coalesce(F.sum(n).over(above), F.lit(0.0)).alias(f"{n}_to") for n in names]
    sums = sums.select("_r", *before, *[F.sum(n).over(whole).alias(f"{n}_all") for n in names])
    here = W.partitionBy("_r").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(sums, "_r").withColumns({f"{n}_to": F.col(f"{n}_to") + F.sum(n).over(here) for n in names}).drop("_r")


def jackknife_cells(c: DataFrame, digits: int = 4, sens_min: float = 0.9, spec_min: float = 0.7) -> DataFrame:
    """(y, p, weight, brier, auc, ap, sens_at, spec_at): what follows without one
    row of each cell (label, score), in closed form, and how many such rows there are.

    A row takes its wins from auc. In ap the terms above its score stay, and
    those from there on have one row less to be found or to be passed, so sums
    from either end give the rest. sens_at and spec_at have one of two values for
    each label, as the row lies before or behind the point where the curve then
    reaches its target. Null where a label has no other row (sens_at: 0).
    """
    r = curve(c, weight="n")
    tps, fps, dp, dn, np_, nn = (F.col(x) for x in ("tps", "fps", "dp", "dn", "np", "nn"))
    rows, frac = tps + fps, lambda x, y: ratio(x, y)  # noqa: E731  0 where no row is left at that score or above
    terms = {"whole": dp * frac(tps, rows), "found": dp * frac(tps - 1, rows - 1), "passed": dp * frac(tps, rows - 1)}
    r = _running(r.withColumns(terms), list(terms), "thr")
    point = F.struct("tps", "fps", "thr")
    first = lambda hits, of: F.max_by(point, F.when(ratio(hits, of, None) >= sens_min, F.col("thr")))
    last = lambda misses, of: F.min_by(point, F.when(1 - ratio(misses, of, None) >= spec_min, F.col("thr")))
    wins = F.sum(dn * (2 * (tps - dp) + dp)).alias("wins2")
    off = F.sum(dp * F.pow(F.col("thr") - 1, 2) + dn * F.pow(F.col("thr"), 2)).alias("off")
    ends = [first(tps, np_ - 1).alias("pa"), first(tps - 1, np_ - 1).alias("pb"), first(tps, np_).alias("pn")]
    ends += [last(fps, nn - 1).alias("na"), last(fps - 1, nn - 1).alias("nb"), last(fps, nn).alias("nn_")]
    each = r.crossJoin(F.broadcast(r.agg(wins, off, *ends)))  # one row
    thr, at_or_above = F.col("thr"), lambda s: F.coalesce((F.col("thr") >= F.col(f"{s}.thr")).cast("long"), F.lit(0))
    above = F.col("whole_to") - F.col("whole")
    one = F.struct(
        F.lit(1).alias("y"), dp.alias("weight"), F.pow(thr - 1, 2).alias("off"),
        ratio(F.col("wins2") - 2 * (nn - fps) - dn, 2 * (np_ - 1) * nn, None).alias("auc"),
        ratio(above + (dp - 1) * frac(tps - 1, rows - 1) + F.col("found_all") - F.col("found_to"), np_ - 1, None).alias("ap"),
        F.coalesce(ratio(F.col("nn_.tps") - at_or_above("nn_"), np_ - 1, None), F.lit(0.0)).alias("sens_at"),
        (1 - ratio(F.when(thr < F.col("pa.thr"), F.col("pa.fps")).otherwise(F.col("pb.fps")), nn, None)).alias("spec_at"),
    )
    zero = F.struct(
        F.lit(0).alias("y"), dn.alias("weight"), F.pow(thr, 2).alias("off"),
        ratio(F.col("wins2") - 2 * (tps - dp) - dp, 2 * np_ * (nn - 1), None).alias("auc"),
        ratio(above + F.col("passed_all") - F.col("passed_to") + F.col("passed"), np_, None).alias("ap"),
        F.coalesce(ratio(F.when(thr >= F.col("nb.thr"), F.col("nb.tps")).otherwise(F.col("na.tps")), np_, None), F.lit(0.0)).alias("sens_at"),
        (1 - ratio(F.col("pn.fps") - at_or_above("pn"), nn - 1, None)).alias("spec_at"),
    )
    brier = half_even(ratio(F.col("all_off") - F.col("o.off"), F.col("rows_") - 1, None), digits)
    out = each.withColumn("all_off", F.col("off")).select("thr", "all_off", (np_ + nn).alias("rows_"), F.explode(F.array(one, zero)).alias("o")).where("o.weight > 0")
    return out.select("o.y", F.col("thr").alias("p"), "o.weight", brier.alias("brier"), "o.auc", "o.ap", "o.sens_at", "o.spec_at")


BY_CELL = ("brier", "auc", "ap", "sens_at", "spec_at")  # metrics that depend on the score left out


def jackknife_brier(c: DataFrame, digits: int = 4) -> DataFrame:
    """(y, p, brier, weight): the mean squared error without one row of each cell."""
    return jackknife_cells(c, digits).select("y", "p", "brier", "weight")


def jackknife_auc(c: DataFrame) -> DataFrame:
    """(y, p, auc, weight): the area without one row of each cell."""
    return jackknife_cells(c).select("y", "p", "auc", "weight")


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of the metrics by cell."""
    each = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BY_CELL]
    return wide.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.metric", "s.value")


def jackknife_panel(c: DataFrame, cut: float = 0.5, p_adj: float | None = None) -> DataFrame:
    """(y, hit, metric, value, weight) of the whole panel: for BY_CELL a row for
    each cell, for the rest at most four."""
    by_cell = _long(jackknife_cells(c).withColumn("hit", F.col("p") >= cut), ["y", "hit", "weight"])
    return jackknife(c, cut, p_adj=p_adj).unionByName(by_cell)


def paired_rows(df: DataFrame, key: list[str], by: str, ref: str, comp: str) -> DataFrame:
    """(key, y, p, y2, p2): label and score of a key's rows whose `by` is ref, and of those where it is comp
    (null: none; of several the largest). One shuffle of the rows, and no join."""
    of = lambda c, v: F.max(F.when(F.col(by) == v, F.col(c)))
    return df.where(F.col(by).isin(ref, comp)).groupBy(*key).agg(*[of(c, v).alias(c + x) for v, x in ((ref, ""), (comp, "2")) for c in ("y", "p")])


def paired_cells(df: DataFrame, ref: tuple[str, str] = ("y", "p"), comp: tuple[str, str] = ("y2", "p2")) -> DataFrame:
    """(ry, rp, cy, cp, n): rows by label and score in both of two panels; rows with a null in one are left out."""
    named = [F.col(x).alias(k) for x, k in zip((*ref, *comp), ("ry", "rp", "cy", "cp"))]
    return df.select(*named).dropna().groupBy("ry", "rp", "cy", "cp").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Intervals:
    cis: DataFrame  # metric, stat, lower, upper
    scores: DataFrame  # rep, metric, value
    counts: DataFrame | None = None  # jackknife of what follows from counts: y, hit, metric, value, weight
    cells: DataFrame | None = None  # and of the rest, as jackknife_cells gives it
    cut: float = 0.5

    @property
    def jack(self) -> DataFrame | None:
        """(metric, value, weight) of the whole panel."""
        return None if self.counts is None else self.counts.select("metric", "value", "weight").unionByName(_long(self.cells, ["weight"]))


def intervals(point: DataFrame, reps: DataFrame, method: str = "bca", a: float = 0.05, jack: DataFrame | None = None) -> DataFrame:
    """(metric, stat, lower, upper) from points (metric, value) and replicates (rep, metric, value).

    pct: percentiles of the replicates; emp: normal with their deviation; diff:
    the point plus percentiles of the point minus replicates; bca: bias
    corrected, with jackknife values (metric, value, weight). All percentiles
    are nearest values.
    """
    stat = point.select("metric", F.col("value").alias("stat"))
    both = reps.join(F.broadcast(stat), "metric")  # METRICS at most
    g = both.groupBy("metric").agg(F.first("stat").alias("stat"), F.collect_list("value").alias("t"), F.stddev_samp("value").alias("sd"), F.avg((F.col("value") < F.col("stat")).cast("double")).alias("below"))
    lo, hi = F.lit(100 * a / 2), F.lit(100 * (1 - a / 2))
    if method == "pct":
        ends = nearest_percentile("t", lo), nearest_percentile("t", hi)
    elif method == "emp":
        g = g.withColumn("z", normal_quantile(F.lit(1 - a / 2)))
        ends = F.col("stat") - F.col("z") * F.col("sd"), F.col("stat") + F.col("z") * F.col("sd")
    elif method == "diff":
        d = F.transform("t", lambda v: F.col("stat") - v)
        ends = F.col("stat") + nearest_percentile(d, lo), F.col("stat") + nearest_percentile(d, hi)
    elif method == "bca":
        jack = jack.where(F.col("value").isNotNull())
        mean = jack.groupBy("metric").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
        d = F.col("mean") - F.col("value")
        acc = jack.join(F.broadcast(mean), "metric").groupBy("metric").agg(F.sum(F.pow(d, 3) * F.col("weight")).alias("c3"), F.sum(F.pow(d, 2) * F.col("weight")).alias("c2"))
        low = 6 * F.pow(F.col("c2"), 1.5)
        acc = acc.select("metric", (F.col("c3") / F.when(low == 0, 1e-6).otherwise(low)).alias("acc"))
        g = g.join(F.broadcast(acc), "metric", "left").withColumn("acc", F.coalesce("acc", F.lit(0.0))).withColumns({"z0": normal_quantile("below"), "zl": normal_quantile(F.lit(a / 2)), "zu": normal_quantile(F.lit(1 - a / 2))})
        g = g.withColumns({f"q{e}": 100 * normal_cdf(F.col("z0") + (F.col("z0") + F.col(f"z{e}")) / (1 - F.col("acc") * (F.col("z0") + F.col(f"z{e}")))) for e in "lu"})
        ends = nearest_percentile("t", "ql"), nearest_percentile("t", "qu")
    else:
        raise ValueError(f"no method {method}")
    return g.select("metric", "stat", ends[0].alias("lower"), ends[1].alias("upper"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bootstrap(df: DataFrame, n: int = 100, method: str = "bca", a: float = 0.05, cut: float = 0.5, seed: int = 10221983, draws=multinomial_weights, p_adj: float | None = None, boot_mean: bool = False) -> Intervals:
    """Intervals for the whole panel of (y, p) rows.

    draws: bootstrap_weights to have draws that SQL can repeat. p_adj: points and
    jackknife are adjusted to that prevalence, and each replicate draws its own
    around it. boot_mean: points are the means of the replicates. Cells, draws
    and replicates are written to the shared folder, so none is worked out twice.
    """
    c = _kept(cells(df), "cells")
    reps = _kept(scores(_kept(draws(c, n, seed, p_adj), "draws"), ("rep",), cut), "replicates")
    return _of_cells(c, reps, method, a, cut, p_adj, boot_mean)


def bootstraps(df: DataFrame, by: str, n: int = 100, method: str = "bca", a: float = 0.05, cut: float = 0.5, seed: int = 10221983, p_adj: float | None = None, boot_mean: bool = False) -> dict[object, Intervals]:
    """What bootstrap gives with bootstrap_weights for the rows of each value of `by`
    (a handful; null is none), from one scan and with each key of a draw made once."""
    c = _kept(cells(df.where(F.col(by).isNotNull()), by=(by,)), "cells")
    reps = _kept(scores(_kept(bootstrap_weights(c, n, seed, p_adj, by=by), "draws"), (by, "rep"), cut), "replicates")
    values = [r[0] for r in c.select(by).distinct().collect()]
    own = lambda x, v: x.where(F.col(by) == v).drop(by)
    return {v: _of_cells(own(c, v), own(reps, v), method, a, cut, p_adj, boot_mean) for v in values}


def _of_cells(c: DataFrame, reps: DataFrame, method: str, a: float, cut: float, p_adj: float | None, boot_mean: bool) -> Intervals:
    """Intervals from cells and the scores of replicates, both kept."""
    point = reps.groupBy("metric").agg(F.avg("value").alias("value")) if boot_mean else scores(c, (), cut, p_adj=p_adj)
    out = Intervals(None, reps, cut=cut)
    if method == "bca":
        out.counts, out.cells = _kept(jackknife(c, cut, p_adj=p_adj), "counts"), _kept(jackknife_cells(c), "left_out")
    out.cis = intervals(point, reps, method, a, out.jack)
    return out


def _differences(ref: Intervals, comp: Intervals, pairs: DataFrame) -> DataFrame:
    """(metric, value, weight): comp less ref without the same row in both, by the cells that the row has in either."""
    r, c = F.col("rp") >= ref.cut, F.col("cp") >= comp.cut
    few = pairs.groupBy("ry", r.alias("rh"), "cy", c.alias("ch")).agg(F.sum("n").alias("n"))  # 16 rows at most
    left = few.join(ref.counts.alias("r"), (F.col("r.y") == F.col("ry")) & (F.col("r.hit") == F.col("rh"))).select("cy", "ch", "n", "metric", F.col("value").alias("rv"))
    same = (F.col("c.y") == F.col("l.cy")) & (F.col("c.hit") == F.col("l.ch")) & (F.col("c.metric") == F.col("l.metric"))
    counts = left.alias("l").join(comp.counts.alias("c"), same).select("l.metric", (F.col("c.value") - F.col("rv")).alias("value"), F.col("n").alias("weight"))
    both = pairs.join(ref.cells.alias("r"), (F.col("r.y") == F.col("ry")) & (F.col("r.p") == F.col("rp"))).join(comp.cells.alias("c"), (F.col("c.y") == F.col("cy")) & (F.col("c.p") == F.col("cp")))
    by_cell = both.select(F.col("n").alias("weight"), *[(F.col(f"c.{m}") - F.col(f"r.{m}")).alias(m) for m in BY_CELL])
    return counts.unionByName(_long(by_cell, ["weight"]))


def difference(ref: Intervals, comp: Intervals, method: str = "pct", a: float = 0.05, pairs: DataFrame | None = None) -> DataFrame:
    """(metric, ref, comp, d, lower, upper) of comp - ref for the panel without
    true_prev, replicates paired by number. bca needs `pairs`, the rows by their
    cells in both panels (see paired_cells), as it leaves the same row out of both."""
    pair = ref.cis.select("metric", F.col("stat").alias("ref")).join(comp.cis.select("metric", F.col("stat").alias("comp")), "metric").where("metric != 'true_prev'")
    point = pair.select("metric", (F.col("comp") - F.col("ref")).alias("value"))
    reps = ref.scores.alias("r").join(comp.scores.alias("c"), ["rep", "metric"]).select("rep", "metric", (F.col("c.value") - F.col("r.value")).alias("value"))
    if method == "bca" and (pairs is None or ref.cells is None or comp.cells is None):
        raise ValueError("bca needs the rows' pairs of cells, and both panels with their jackknife")
    out = intervals(point, reps, method, a, _differences(ref, comp, _kept(pairs, "pairs")) if method == "bca" else None)  # pairs are read several times
    return pair.join(out, "metric").select("metric", "ref", "comp", F.col("stat").alias("d"), "lower", "upper")


def bootstrap_curves(df: DataFrame, n: int = 100, seed: int = 10221983) -> DataFrame:
    """The ROC curve of each replicate, by rep."""
    return curve(_kept(multinomial_weights(_kept(cells(df), "cells"), n, seed), "draws"), ("rep",), weight="n")


def bootstrap_areas(df: DataFrame, n: int = 100, seed: int = 10221983) -> DataFrame:
    return areas(bootstrap_curves(df, n, seed), ("rep",))


def power_simulation(spark, sens: float = 0.8, spec: float = 0.8, prevalences: tuple[float, ...] = (0.12, 0.07), sizes: tuple[int, int, int] = (100, 15000, 100), draws: int = 1000, seed: int = 42) -> DataFrame:
    """(n, p, sensitivity, specificity, count_diff): a row for each draw.

    Each (size, prevalence) has its own generator, seeded by both, so results
    do not depend on partitioning.
    """
    grid = spark.createDataFrame([(n, p) for p in prevalences for n in range(*sizes)], "n long, p double").repartition("n", "p")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, p in zip(b["n"].tolist(), b["p"].tolist()):
                rng = np.random.default_rng([seed, n, round(p * 1e6)])
                prev = rng.binomial(n, p, draws) / n
                q = 1 - prev
                tn, fp, fn, tp = rng.multinomial(n, np.stack([spec * q, (1 - spec) * q, (1 - sens) * prev, sens * prev], axis=1)).T.astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    yield pd.DataFrame({"n": n, "p": p, "sensitivity": np.where(fn + tp > 0, tp / (fn + tp), np.nan), "specificity": np.where(tn + fp > 0, tn / (tn + fp), np.nan), "count_diff": np.where(fn + tp > 0, (fn - fp) / (fn + tp), np.nan)})

    return shipped(grid).mapInPandas(draw, "n long, p double, sensitivity double, specificity double, count_diff double")


def margins(draws: DataFrame, digits: int = 4) -> DataFrame:
    """(n, n_pos, sensitivity, specificity, count_diff): half the width of the central
    95 % of the draws, each draw's ratio taken by itself."""
    moe = lambda c: ((F.percentile(F.nanvl(F.col(c), F.lit(None)), 0.975) - F.percentile(F.nanvl(F.col(c), F.lit(None)), 0.025)) / 2).alias(c)
    out = draws.groupBy("n", "p").agg(*[moe(c) for c in ("sensitivity", "specificity", "count_diff")])
    return out.select("n", F.rint(F.col("n") * F.col("p")).cast("long").alias("n_pos"), *[half_even(c, digits).alias(c) for c in ("sensitivity", "specificity", "count_diff")])
