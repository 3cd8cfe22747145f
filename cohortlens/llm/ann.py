"""Approximate nearest neighbours with learned partitions.

A neighbour graph of a bounded sample is cut into parts of nearly equal size; a
small network learns to tell from a vector in which parts its neighbours are.
Its output biases are then set so that rows of the sample fall evenly to the
parts, and every row of the table is put into its most probable part. A query
visits the most probable parts until their probabilities come to a share that is
set on sample vectors held back, so that a wanted recall is reached; exact
cosines rank what is there. Parts of any size are compared in bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shipping import shipped
from ._util import read_table, staged
from .near_dup_vectors import spherical_kmeans
from .vectors import matrix, sample, vectors

#: At most so many vectors make graph, parts and network. A part needs PART_SAMPLE of them, so there
#: are at most SAMPLE / PART_SAMPLE parts; more rows than these make good use of take a larger sample.
SAMPLE = 8192
PART_SAMPLE = 32
BLOCK = 4096
TIE = 1e-12  # scores this near to the k-th best are computed again before they are ranked


def part_count(rows: int, sampled: int) -> int:
    """Half the root of the rows, as far as the sample can tell parts apart."""
    return max(1, min(sampled // PART_SAMPLE, round(math.sqrt(rows) / 2)))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k nearest other rows by cosine."""
    out, k, x = [], min(k, len(x) - 1), x.astype(np.float32)
    for i in range(0, len(x), 128):  # few rows at a time: this runs on the driver
        s = x[i : i + 128] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].astype(np.int32))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 12) -> np.ndarray:
    """A part for each node of the graph, none above (1 + slack) times the mean.

    Starts from k-means cells filled up to that size, then moves nodes to the
    part in which most of their neighbours are, as long as there is room.
    """
    n, most = len(x), int(np.ceil((1 + slack) * len(x) / parts))
    s = x @ spherical_kmeans(x, parts).T
    part, size = np.full(n, -1), np.zeros(parts, int)
    for i in np.argsort(-s.max(axis=1), kind="stable"):
        for p in np.argsort(-s[i], kind="stable"):
            if size[p] < most:
                part[i], size[p] = p, size[p] + 1
                break
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            votes[(size >= most)] = 0
            p, now = int(votes.argmax()), part[i]
            if p != now and votes[p] > np.count_nonzero(part[both[i]] == now):
                size[now], size[p], part[i], moved = size[now] - 1, size[p] + 1, p, moved + 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer and a softmax over parts; trained with Adam on where neighbours are."""

    def __init__(self, parts: int, hidden: int = 128, seed: int = 42):
        self.parts, self.hidden, self.seed = parts, hidden, seed

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 25, rate: float = 0.004) -> Router:
        rng = np.random.default_rng(self.seed)
        shapes = [(x.shape[1], self.hidden), (self.hidden,), (self.hidden, self.parts), (self.parts,)]
        self.w = [rng.normal(0, 1.5 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h, p = self._run(x[rows])
                d = (p - y[rows]) / len(rows)
                dh = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def balance(self, x: np.ndarray, rounds: int = 300) -> Router:
        """Set the output biases so that the rows of x fall evenly to their most probable parts."""
        z = np.log(self._run(x)[1] + 1e-12)
        shift, best = np.zeros(self.parts), (np.inf, np.zeros(self.parts))
        for i in range(rounds):
            size = np.bincount((z + shift).argmax(axis=1), minlength=self.parts)
            best = min(best, (size.max(), shift.copy()), key=lambda b: b[0])
            shift -= 0.3 * 0.99**i * (size * self.parts / len(x) - 1).clip(-1, 2)
        self.w[3] += best[1]
        return self

    def parts_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from most to least probable (the first is where a row is kept), and
        for each the sum of the probabilities before it."""
        p = self._run(x)[1]
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(ranked, axis=1) - ranked


def fit_router(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, float]:
    """A router for unit vectors x, and the sum of probabilities below which parts are visited, for the recall of k neighbours."""
    if parts < 2:
        return Router(1).fit(x, np.ones((len(x), 1)), epochs=0), 1.0
    graph = neighbours(x, 10)
    part = balanced_parts(x, graph, parts)
    y = np.zeros((len(x), parts))
    np.add.at(y, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    np.add.at(y, (np.arange(len(x)), part), 3.0)
    asked = np.arange(len(x)) % 8 == 0  # not trained on: visits are set with them
    router = Router(parts).fit(x[~asked], (y / y.sum(axis=1, keepdims=True))[~asked]).balance(x)
    order, before = router.parts_of(x)
    kept = order[:, 0]
    place = (order[asked][:, None, :] == kept[neighbours(x, k)[asked]][:, :, None]).argmax(axis=2)
    return router, float(np.quantile(np.take_along_axis(before[asked], place, axis=1), recall, method="higher"))


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.97, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest other rows found.

    is_query: a condition on the column id. Nearness is the cosine in double
    precision; ties go to the smaller id. Vectors that take no part (see
    vectors()) are neither queries nor candidates. Every row is indexed; only
    the model is fitted on at most sample_rows vectors. Rows stand for
    themselves: of rows that share an id each asks and each can be found, also
    by the others, and only a row itself is no candidate of its own. A null id
    can be found, but does not ask. An empty table gives an empty result.
    """
    rows = staged(vectors(df, id_col, vec_col).where("v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    x = sample(rows.dropDuplicates(["key"]), sample_rows)
    router, share = fit_router(x, part_count(n, len(x)), k, recall)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order, before = router.parts_of(matrix(b.column("v")))
                visits = [o[m] if ask else o[:0] for o, m, ask in zip(order.astype(np.int32), before <= share, b.column("asks").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order[:, 0].astype(np.int32)), pa.array(visits, pa.list_(pa.int32()))], [*b.schema.names, "part", "visits"])

    asks_too = F.coalesce(is_query & F.col("id").isNotNull(), F.lit(False)).alias("asks")
    indexed = staged(shipped(rows).select("row", "id", "v", asks_too).mapInArrow(route, "row long, id long, v array<double>, asks boolean, part int, visits array<int>"), "index")
    kept = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
    asks = indexed.where("asks").select("row", "id", "v", F.explode("visits").alias("part"))
    asked = {r["part"]: r["n"] for r in asks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = df.sparkSession.createDataFrame([(p, -(-m // BLOCK), max(1, -(-asked.get(p, 0) // BLOCK))) for p, m in kept.items()], "part int, blocks int, askers int")
    both = indexed.select("row", "id", "v", "part", F.lit(False).alias("asks")).unionByName(asks.withColumn("asks", F.lit(True))).join(F.broadcast(plan), "part")
    own = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    spread = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("cb"), own("askers").alias("qb")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda i: F.struct(own("blocks").alias("cb"), i.alias("qb")))
    )
    dealt = both.withColumn("at", F.explode(spread)).select("part", "at.cb", "at.qb", "asks", "row", "id", "v")
    found = shipped(dealt).groupBy("part", "cb", "qb").applyInArrow(lambda g: nearest_in(g, k), "row long, query_id long, vec_id long, score double")
    by = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_in(group: pa.Table, k: int) -> pa.Table:
    """For each asking row of a block the k nearest of the others, ties to the smaller id.

    Products of whole blocks may differ in the last bit for equal vectors, so
    those near the k-th best are summed again one by one before they are ranked.
    """
    ask, ids, row = group.column("asks").to_numpy(zero_copy_only=False), group.column("id").to_pylist(), group.column("row").to_numpy()
    x = matrix(group.column("v"))
    c = np.array(sorted(np.flatnonzero(~ask).tolist(), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
    out: tuple[list, ...] = ([], [], [], [])
    for part in np.array_split(np.flatnonzero(ask), max(1, ask.sum() // 512)) if len(c) else ():
        s = x[part] @ x[c].T
        s[row[part][:, None] == row[c]] = -3  # no candidate for itself
        for near, q in zip(s, part.tolist()):
            at = max(0, len(near) - k)
            top = np.flatnonzero((near >= np.partition(near, at)[at] - TIE) & (near > -2))
            score = (x[c[top]] * x[q]).sum(axis=1)
            for i in np.argsort(-score, kind="stable")[:k].tolist():
                for column, value in zip(out, (int(row[q]), ids[q], ids[c[top[i]]], float(score[i]))):
                    column.append(value)
    return pa.table([pa.array(o, kind) for o, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["row", "query_id", "vec_id", "score"])


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {"op6_ann": op6_ann}
