"""Centroid clustering of quantised vectors by Lloyd's rounds on distinct vectors.

Components become whole numbers, equal vectors are grouped with their
multiplicity, and the rounds run over the distinct vectors alone: a task assigns
its vectors and hands on one row of exact weighted sums for each centroid, so
neither copies nor rows cross the network in a round. At the end the assignments
of distinct vectors are joined back to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import read_table, staged

LARGEST = 1 << 27  # a component beyond would not leave 64-bit distances exact
EXACT = 1 << 20  # components up to this give exact products in double precision
WIDE = "decimal(38,0)"


def quantised(df: DataFrame, components: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, h, q): floor(scale * x) of every vector that has so many
    components, none null or not finite; h is a hash of q that joins sort by first.

    A component beyond LARGEST is an error: its distances would not fit 64 bits.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        y = F.floor(x * scale)
        return F.when(F.abs(x * scale) <= LARGEST, y.cast("int")).otherwise(F.raise_error(F.concat(F.lit("a component is too large to cluster by whole numbers: "), x.cast("string"))).cast("int"))

    rows = df.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("q"))
    return rows.select("vec_id", F.xxhash64("q").alias("h"), "q")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k rows with the smallest sha256 of seed and id, in that
    order (rows with one id in order of their components; a null id counts as an empty string)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()
    return np.array([r["q"] for r in least], np.int64)


def matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller of equally near ones; squared distance) of each row, exactly."""
    if not len(x):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), c.astype(np.float64)  # all sums stay below 2^53
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    near = d.argmin(axis=1)
    return near.astype(np.int32), d[np.arange(len(x)), near]


def weighted_sums(distinct: DataFrame, c: np.ndarray) -> DataFrame:
    """(cluster, place, total, copies): for each centroid the sums of its vectors'
    components, each vector as often as it was, and how many these are."""
    components = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(c.shape, object), np.zeros(len(c), object)
        for b in batches:
            x, copies = matrix(b.column("q"), components), b.column("copies").to_numpy()
            near, _ = nearest(x, c)
            for j in np.unique(near):
                own = near == j
                # halves of the multiplicity keep 64-bit products exact up to 2^46 copies
                high, low = copies[own] >> 16, copies[own] & 0xFFFF
                sums[j] += ((x[own] * high[:, None]).sum(axis=0).astype(object) << 16) + (x[own] * low[:, None]).sum(axis=0).astype(object)
                counts[j] += int(copies[own].sum())
        some = [j for j in range(len(c)) if counts[j]]
        rows = [(j, i, int(sums[j][i]), int(counts[j])) for j in some for i in range(components)]
        for at in range(0, len(rows), 100_000):
            part = list(zip(*rows[at : at + 100_000]))
            kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()) if t == pa.int32() else pa.array([Decimal(n) for n in p], t) for p, t in zip(part, kinds)], ["cluster", "place", "total", "copies"])

    each = shipped(distinct).select("q", "copies").mapInArrow(run, f"cluster int, place int, total {WIDE}, copies {WIDE}")
    return each.groupBy("cluster", "place").agg(F.sum("total").cast(WIDE).alias("total"), F.sum("copies").cast(WIDE).alias("copies"))


def moved(c: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each centroid that has vectors at the floor of their mean; the others where they were."""
    new = c.copy()
    for r in sums.collect():  # centroids times components
        new[r["cluster"], r["place"]] = int(r["total"]) // int(r["copies"])
    return new


def assigned(distinct: DataFrame, c: np.ndarray) -> DataFrame:
    """distinct with cluster and distance."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, d = nearest(matrix(b.column("q"), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d)], [*b.schema.names, "cluster", "distance"])

    return shipped(distinct).mapInArrow(run, f"{kinds}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) for each row that takes part.

    Rows that are null, have another number of components, or hold null or
    non-finite ones take no part. Repeated rows, equal vectors and null ids each
    give a row of their own; ties go to the smaller number; with fewer than k
    rows there are as many centroids; a centroid without vectors stays where it
    was. All sums and distances are exact whole numbers, so results do not
    depend on how rows are dealt. A component beyond LARGEST is an error. An
    empty table gives an empty one; other columns are not read.
    """
    if k < 1 or rounds < 0 or components < 1:
        raise ValueError("k and components must be at least 1, rounds at least 0")
    spark = df.sparkSession
    rows = quantised(df, components, scale, id_col, vec_col)
    distinct = staged(rows.groupBy("h", "q").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    c = first_centroids(rows, k, seed)
    if not len(c):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")], F.col("q").cast("array<long>").alias("centroid"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        c = moved(c, weighted_sums(distinct, c))
    found = staged(assigned(distinct, c), "assigned")
    spent = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("copies").cast("decimal(18,0)")).alias("spent")).collect()
    own = {r["cluster"]: int(r["spent"]) for r in spent}  # a row for each centroid
    ends = [(j, n, sum(own.values()), c[j].tolist(), digest(c[j])) for j, n in sorted(own.items())]
    ends = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    named = rows.join(found.drop("copies").hint("merge"), ["h", "q"]).select("vec_id", "cluster", "distance")
    return named.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES = {"op13_centroids": op13_centroids}


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """The same rounds as SQL over component rows, one block of common table expressions for each."""

    def near(i: int) -> str:
        return (
            f"d{i} AS (SELECT r, j, sum((x - y) * (x - y)) AS d FROM cells JOIN c{i} USING (place) GROUP BY r, j), "
            f"a{i} AS (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{i} GROUP BY r)"
        )

    parts = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 "
        "AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)",
        "cells AS (SELECT r, unnest(range(64)) AS place, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"c0 AS (SELECT j, place, x AS y FROM (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS j FROM kept) JOIN cells USING (r) WHERE j < {k})",
    ]
    for i in range(rounds):
        parts.append(near(i))
        # floor division of whole numbers, negative sums included
        mean = f"m{i} AS (SELECT j, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS y FROM a{i} JOIN cells USING (r) GROUP BY j, place)"
        parts += [mean, f"c{i + 1} AS (SELECT j, place, coalesce(m{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN m{i} USING (j, place))"]
    parts += [near(rounds), f"named AS (SELECT j, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY place)) AS digest FROM c{rounds} GROUP BY j)"]
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN named USING (j)"
    )


ORACLE_SQL = {"op13_centroids": _oracle()}
