"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.scratch import new_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not the work
    that led here, and whatever was decided in df (row order, chunk numbers)
    stays fixed for every later reader.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """df staged, and marked for broadcast if it has at most `most` rows (of a few columns); beyond that joins shuffle."""
    df = staged(df, name)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def staged_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As staged, but written in buckets of the key: a later join on the key does
    not shuffle this side again. The table is only in the catalogue while its
    layout is read from there; its files stay, as those of staged do."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    table = "cohortlens_" + path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return held


def give_back() -> None:
    """Return freed memory of this Python worker to the machine: workers are kept
    for later stages, and what one stage held would count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing to do
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many _ in front as it takes to clash with none of the taken ones (case does not count)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def numpy_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each
    round is two aggregations and two joins on the node; the result of a round
    is staged, so the plan stays short. Nodes without a link are not returned.
    A round that changes nothing ends the loop; reaching max_rounds is an error.
    """
    now = staged(_ordered(edges), "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(_ordered(small.union(low.select("a", F.col("m").alias("b")))), "links")
        new_mark = _mark(new)
        now, same, mark = new, new_mark == mark, new_mark
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the links."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
