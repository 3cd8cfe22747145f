"""Contingency, flow and description tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, half_even, ratio


def flow_table(df: DataFrame, row: str = "source", abnormal: str = "abnormal", tb: str = "abnormal_tb") -> DataFrame:
    """(row, n, ab, pct_ab, abtb, pct_abtb): counts and shares of n, in one aggregation."""
    out = df.groupBy(row).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(abnormal) == 1).alias("ab"), F.count_if(F.col(tb) == 1).alias("abtb"))
    return out.select(row, "n", "ab", ratio("ab", "n").alias("pct_ab"), "abtb", ratio("abtb", "n").alias("pct_abtb"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row, one column for each of the values."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def describe(df: DataFrame, variables: dict[str, list[str] | None], split: str | None = "split", digits: int = 0, whole: str = "All") -> DataFrame:
    """(variable, level, split, n, pct) for several variables and all splits in one pass.

    variables: the levels to report, or None for all that occur. A level that is
    missing counts 0 and nulls are no level. With one level the percentage is of
    all rows, null ones too; otherwise of the rows with a level. The split
    `whole` is all rows.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables]))
    one = F.col(split) if split else F.lit(whole)
    long = df.select(one.alias("split"), *{c for c in variables}).select("split", parts.alias("e")).select("split", "e.*")
    counted = long.groupBy("variable", "level", "split").agg(F.count(F.lit(1)).alias("n"))
    if split:  # counts, and not rows, are unfolded for the whole
        splits = F.explode(F.array(F.lit(whole), "split")).alias("split")
        counted = counted.select("variable", "level", "n", splits).groupBy("variable", "level", "split").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("variable", "split").agg(F.sum("n").alias("rows"))
    spark = df.sparkSession
    fixed = spark.createDataFrame([(v, x) for v, xs in variables.items() if xs for x in xs] or [("", "")], "variable string, level string")
    open_ = [v for v, xs in variables.items() if xs is None]
    levels = fixed.unionByName(counted.where(F.col("variable").isin(open_) & F.col("level").isNotNull()).select("variable", "level").distinct())
    grid = rows.join(levels, "variable").join(counted, ["variable", "level", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = grid.groupBy("variable", "split").agg(F.sum("n").alias("levels_n"), F.count(F.lit(1)).alias("levels"))
    out = grid.join(sums, ["variable", "split"]).withColumn("of", F.when(F.col("levels") == 1, F.col("rows")).otherwise(F.col("levels_n")))
    return out.select("variable", "level", "split", "n", half_even(100 * ratio("n", "of"), digits).alias("pct"))


def prevalence(df: DataFrame, by: tuple[str, ...] = (), y: str = "y", digits: int = 4) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(y).cast("long").alias("n_pos"), half_even(ratio(F.sum(y), F.count(F.lit(1))), digits).alias("prevalence"))


def harmonic_p(p: str | Column = "p", smooth: float | None = 1e-7, w: str | Column | None = None) -> Column:
    """Harmonic mean of p-values, smoothed away from 0 (None: not at all). Weights w
    are used as given; without them each of k values weighs 1/k."""
    x = col(p) + (smooth or 0.0)
    if w is None:
        return F.count(F.lit(1)).cast("double") / F.sum(1 / x)
    return 1 / F.sum(col(w) / x)


def fisher_statistic(p: str | Column = "p", smooth: float | None = 1e-7) -> Column:
    """-2 times the sum of logs, smoothed unless None; chi-square with 2k degrees under the null."""
    return -2 * F.sum(F.log(col(p) + (smooth or 0.0)))


def best_x(x: str, y: str, at_least: float) -> Column:
    """The largest x where y is high enough; an error where there is none."""
    out = F.max(F.when(F.col(y) >= at_least, F.col(x)))
    return F.when(out.isNull(), F.raise_error(F.lit("no row reaches the value")).cast("double")).otherwise(out)


def onehot(df: DataFrame, key: str, label: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each lower-cased level, in sorted order."""
    return df.select(key, *[(F.lower(label) == v).cast("int").alias(v) for v in sorted(levels)])


def outer_align(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables side by side on a row label; value columns get the table's name in front."""
    out = None
    for name, t in tables.items():
        t = t.select(key, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != key])
        out = t if out is None else out.join(t, key, "full")
    return out


def merge_intervals(frames: list[tuple[str, DataFrame]], digits: int = 4) -> DataFrame:
    """Stacked (model, metric, ci) with ci as "stat (lower, upper)"."""
    from ..functions.scalar import format_interval

    out = None
    for name, f in frames:
        f = f.select(F.lit(name).alias("model"), "metric", format_interval("stat", "lower", "upper", digits).alias("ci"))
        out = f if out is None else out.unionByName(f)
    return out
