"""Bootstrap intervals kept under the number of their run, and read back by model.

A table holds, for each run, its intervals (metric, stat, lower, upper) and its
replicates (rep, metric, value), so that runs can be compared later without
drawing again. A run is a folder of its own, which a rerun replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import format_interval
from ..operators.resample import Intervals

#: The letter keeps Spark from reading the names of folders as numbers or dates.
FOLDER = "in_run"
INTERVAL, REPLICATE = "interval", "replicate"
FIELDS = ("run", "model", "kind", "metric", "stat", "lower", "upper", "rep", "value")


def _folder(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"a run's name has letters, digits, points, _ and -, not {run!r}")
    return f"x{run}"


def save_run(out: Intervals, path: str, run: str, model: str, **notes) -> None:
    """Keep a run at path. A run of that name is replaced once all of the new one is written;
    runs beside it are not touched, and if a task fails for good the old one stays.

    notes: further columns, the same for all rows of the run; other runs need
    not have them. A run without intervals is an error, as it would replace nothing.
    """
    clash = {n for n in notes if n.lower() in {*FIELDS, FOLDER}}
    if clash:
        raise ValueError(f"{sorted(clash)} are columns of the table")
    if out.cis.isEmpty():
        raise ValueError(f"run {run} has no intervals")
    cis = out.cis.select(F.lit(INTERVAL).alias("kind"), "metric", *[F.col(c).cast("double").alias(c) for c in ("stat", "lower", "upper")])
    reps = out.scores.select(F.lit(REPLICATE).alias("kind"), "metric", F.col("rep").cast("long").alias("rep"), F.col("value").cast("double").alias("value"))
    rows = cis.unionByName(reps, allowMissingColumns=True)
    rows = rows.withColumns({"run": F.lit(run), "model": F.lit(model), FOLDER: F.lit(_folder(run))} | {n: F.lit(v) for n, v in notes.items()})
    # a task a kind: intervals, and replicates times metrics, which do not grow with the rows evaluated
    rows.repartition(2, "kind").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER, "kind").parquet(path)


def _kept(spark: SparkSession, path: str, runs: list[str] | None, kind: str) -> DataFrame:
    rows = spark.read.option("mergeSchema", True).parquet(path).where(F.col("kind") == kind)
    if runs is not None:
        rows = rows.where(F.col(FOLDER).isin([_folder(x) for x in runs]))  # only these runs' folders are read
    return rows.drop(FOLDER, "kind")


def read_intervals(spark: SparkSession, path: str, models: list[str] | None = None, runs: list[str] | None = None) -> DataFrame:
    """(run, model, metric, stat, lower, upper) and notes of the runs, or of those named; a note that a run lacks is null."""
    rows = _kept(spark, path, runs, INTERVAL)
    rows = rows if models is None else rows.where(F.col("model").isin(models))
    return rows.select("run", "model", "metric", "stat", "lower", "upper", *[c for c in rows.columns if c not in FIELDS])


def read_run(spark: SparkSession, path: str, run: str) -> Intervals:
    """A run as `bootstrap` gave it, without its jackknife: fit for resample.difference with pct, emp or diff.
    A run that is not there is an error."""
    cis = _kept(spark, path, [run], INTERVAL).select("metric", "stat", "lower", "upper")
    if cis.isEmpty():
        raise KeyError(f"no run {run} at {path}")
    return Intervals(cis, _kept(spark, path, [run], REPLICATE).select("rep", "metric", "value"))


def interval_table(kept: DataFrame, metrics: list[str], digits: int = 2, by: tuple[str, ...] = ("run", "model")) -> DataFrame:
    """A row for each run, a column "stat (lower, upper)" for each of the metrics; null where a run lacks it."""
    text = format_interval("stat", "lower", "upper", digits)
    return kept.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, text)).alias(m) for m in metrics])
