"""What the operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 16384  # vectors that models are fitted on, at most


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, key) for every row: v the vector of doubles, null if it takes no
    part; key names equal vectors by 128 bits of hash.

    No part take vectors that are null, empty or zero, that hold null or
    non-finite components, and that have another length than most (the smaller
    of equally frequent ones).
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, v).alias("v"))
    usual = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows.withColumn("v", F.lit(None).cast("array<double>")).withColumn("key", F.lit(None).cast("string"))
    rows = rows.withColumn("v", F.when(F.size("v") == usual["n"], F.col("v")))
    part = lambda seed: F.lpad(F.hex(F.xxhash64("v", F.lit(seed))), 16, "0")
    return rows.withColumn("key", F.when(F.col("v").isNotNull(), F.concat(part(1), part(2))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision.

    Each is first divided by its largest component, so that no square overflows.
    """
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))
    x = x / np.abs(x).max(axis=1, keepdims=True) if n else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if n else x


def sample(distinct: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most `rows` unit vectors, those with the smallest keys."""
    return matrix(distinct.orderBy("key").limit(rows).select("v").toArrow().column("v"))
