"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are merged first. Centroids are fitted on a bounded sample; every
vector has the cell of its nearest centroid as home. A vector is also shown as a
guest to each other cell that may hold a vector within the threshold: if y's
home is c2 and x's is c1, then cosine(x, y) >= t demands that x is at most
sqrt(1 - t^2) from the plane between c1 and c2, and that its angle to c2 is at
most the cell's radius plus acos(t). So no link is missed. Within a cell blocks
of bounded size are multiplied; a task returns a count for each vector and a
spanning star for each group that it sees, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import connected_components, numpy_components, read_table, staged
from .vectors import matrix, sample, vectors

CELL_ROWS = 2048  # vectors a cell should have
FEWEST_CELLS, MOST_CELLS = 8, 1024  # but a table has at least so many cells (one for each vector, if it has fewer) and at most so many
BLOCK = 4096  # rows of a side in a task
EPS = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k unit centroids for the unit rows of x; an emptied one moves to the worst-served row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(p @ c.T).argmax(axis=1) for p in np.array_split(x, max(1, len(x) // 4096))])
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        norm = np.linalg.norm(new, axis=1)
        empty = norm < 1e-12
        new[~empty] /= norm[~empty, None]
        if empty.any():
            worst = np.argsort((x * c[near]).sum(axis=1), kind="stable")[: empty.sum()]
            new[np.flatnonzero(empty)[: len(worst)]] = x[worst]
        c = new
    return c


def _homes(distinct: DataFrame, c: np.ndarray) -> DataFrame:
    """distinct with home and near, the cosine to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = matrix(b.column("v")) @ c.T if b.num_rows else np.empty((0, len(c)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.argmax(axis=1).astype(np.int32)), pa.array(s.max(axis=1) if b.num_rows else [], pa.float64())], [*b.schema.names, "home", "near"])

    return shipped(distinct).mapInArrow(run, "key string, least long, copies long, v array<double>, home int, near double")


def _guests(homes: DataFrame, c: np.ndarray, radius: dict[int, float], t: float) -> DataFrame:
    """homes with guest: the cells in which it meets others.

    Of two cells only one sees both sides, the one that (c1 + c2) mod 2 chooses,
    so that work is spread and each pair of vectors is compared once.
    """
    gap, angle = np.sqrt(1 - t * t) + EPS, np.arccos(min(1.0, t))
    least = np.array([np.cos(min(np.pi, np.arccos(np.clip(radius[i], -1, 1)) + angle)) - EPS if i in radius else 2.0 for i in range(len(c))])
    apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 256 else None
    ids = np.arange(len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            if b.num_rows:
                s, home = matrix(b.column("v")) @ c.T, b.column("home").to_numpy()
                for row, h in zip(s, home):
                    d = apart[h] if apart is not None else np.linalg.norm(c[h] - c, axis=1)
                    may = (row[h] - row <= gap * d) & (row >= least) & (ids != h)
                    may &= np.where((ids + h) % 2 == 0, ids < h, ids > h)
                    out.append(np.flatnonzero(may).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "guest"])

    return shipped(homes).mapInArrow(run, "key string, least long, copies long, v array<double>, home int, near double, guest array<int>")


def _meet(group: pa.Table, t: float) -> pa.Table:
    """Counts and stars of one (cell, block, block): role 0 stands, 1 asks within the cell, 2 asks as a guest."""
    role = group.column("role").to_numpy()
    key = np.array(group.column("key").to_pylist(), dtype=object)
    copies, x = group.column("copies").to_numpy(), matrix(group.column("v"))
    h, q = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
    names, at = np.unique(key, return_inverse=True)
    count, label = np.zeros(len(names), np.int64), np.arange(len(names))
    stand, weight = x[h], copies[h].astype(np.float64)
    for part in np.array_split(q, max(1, len(q) // 1024)) if len(h) else ():
        hit = (x[part] @ stand.T >= t) & (at[part][:, None] != at[h][None, :])
        np.add.at(count, at[part], (hit @ weight).astype(np.int64))
        guest = role[part] == 2
        if guest.any():
            np.add.at(count, at[h], (copies[part[guest]].astype(np.float64) @ hit[guest]).astype(np.int64))
        a, b = np.nonzero(hit)
        a, b = label[at[part][a]], label[at[h][b]]
        pairs = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
        label = numpy_components(len(names), pairs // len(names), pairs % len(names))[label]
    some = np.flatnonzero(count)
    return pa.table({"key": pa.array(names[some], pa.string()), "links": count[some], "root": pa.array(names[label[some]], pa.string())})


def near_duplicates(df: DataFrame, t: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for each row of df.

    n_links: other rows whose vector has a cosine of t or more; component_id:
    the smallest id reachable over such links, its own included. Rows with equal
    vectors are linked. A vector that takes no part (see vectors()) has no links
    and is its own component. A null id takes part and gets its component's
    smallest id that is not null. An empty table gives an empty result; other
    columns are not read. t must be above 0.
    """
    rows = staged(vectors(df, id_col, vec_col), "vectors")
    distinct = staged(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "distinct")
    n = distinct.count()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    fitted = spherical_kmeans(sample(distinct), min(MOST_CELLS, max(min(n, FEWEST_CELLS), n // CELL_ROWS)))
    homes = staged(_homes(distinct, fitted), "homes")
    cells = homes.groupBy("home").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
    shown = staged(_guests(homes, fitted, {r["home"]: r["near"] for r in cells}, t), "guests")
    asked = {r["cell"]: r["n"] for r in shown.select(F.explode("guest").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = df.sparkSession
    plan = spark.createDataFrame([(r["home"], -(-r["n"] // BLOCK), -(-(r["n"] + asked.get(r["home"], 0)) // (2 * BLOCK))) for r in cells], "cell int, blocks int, askers int")
    here = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("role")), F.struct(F.col("home").alias("cell"), F.lit(1).alias("role"))), F.transform("guest", lambda g: F.struct(g.alias("cell"), F.lit(2).alias("role"))))
    each = shown.select("key", "copies", "v", F.explode(here).alias("e")).select("key", "copies", "v", "e.cell", "e.role").join(F.broadcast(plan), "cell")
    own = lambda n: F.pmod(F.xxhash64("key", "role"), F.col(n)).cast("int")
    spread = F.when(F.col("role") == 0, F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda i: F.struct(own("blocks").alias("hb"), i.alias("qb")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("hb"), own("askers").alias("qb")))
    )
    dealt = each.withColumn("at", F.explode(spread)).select("cell", "at.hb", "at.qb", "role", "key", "copies", "v")
    met = staged(shipped(dealt).groupBy("cell", "hb", "qb").applyInArrow(lambda g: _meet(g, t), "key string, links long, root string"), "met")
    root = connected_components(met.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "root")
    named = distinct.select("key", "least", "copies").join(met.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(root, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("key", "n_links", "component_id")
    out = rows.select("id", "key").join(found, "key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUERIES = {"op5_embedding_near_dup": op5_embedding_near_dup}
