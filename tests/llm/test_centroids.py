"""Clustering of quantised vectors against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from oracle import duck, same
from pyspark.sql import functions as F

from cohortlens.llm import centroids

KIND = "vec_id long, embedding array<float>, label int"


def plainly(rows, k=16, rounds=3, components=64, scale=64, seed=1):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for (vec_id, vector) rows."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [list(q) for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        for j, qs in own.items():
            c[j] = [sum(x) // len(qs) for x in zip(*qs)]
    last = [(i, *near(q)) for i, q in kept]
    spent = {}
    for _, d, j in last:
        spent[j] = spent.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, spent[j], sum(spent.values()), digest[j]) for i, d, j in last), key=repr)


def found(df):
    return sorted(map(tuple, df.drop("centroid").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND)


def made(n, components, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, components))
    return [(i, (centres[i % 5] * spread + rng.normal(size=components) * 0.1).astype(np.float32).tolist()) for i in range(n)]


def test_against_the_plain_version(spark):
    rows = made(300, 64, 1)
    assert found(centroids.cluster(table(spark, rows))) == plainly(rows)


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(2)
    few = [[rng.choice([-1.0, -0.5, 0.0, 0.5]) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.choice(few)) for i in range(200)] + [(1000 + i, few[0]) for i in range(400)]
    rows += [(7, few[1]), (7, few[1]), (7, few[2]), (None, few[3]), (None, few[3]), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5)]
    rows += [(904, [1.0, None, 0.0, 0.0]), (905, [math.nan, 0.0, 0.0, 0.0]), (906, [math.inf, 0.0, 0.0, 0.0]), (907, [0.0] * 4), (908, [-0.0] * 4)]
    for k, rounds in ((16, 3), (3, 5), (1, 1), (40, 0)):
        df = table(spark, rows).withColumn("q", F.lit(1)).withColumn("cluster", F.lit(9)).withColumn("copies", F.lit(2))
        got = centroids.cluster(df, k=k, rounds=rounds, components=4)
        want = plainly(rows, k, rounds, 4)
        assert found(got) == want and len(want) == len(rows) - 7
        assert found(centroids.cluster(df.repartition(7), k=k, rounds=rounds, components=4)) == want


def test_fewer_rows_than_centroids_and_none(spark):
    rows = made(5, 8, 3)
    assert found(centroids.cluster(table(spark, rows), components=8)) == plainly(rows, components=8)
    for none in ([], [(1, None), (2, [1.0])]):
        out = centroids.cluster(table(spark, none), components=8)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-2e6, 2e6))) for _ in range(6)]) for i in range(60)]
    assert found(centroids.cluster(table(spark, rows), k=4, components=6)) == plainly(rows, 4, components=6)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [3e30] * 6)]), components=6).collect()


def test_a_hot_vector_does_not_travel_in_rounds(spark):
    """Of 5,000 copies one row with its multiplicity is left for the rounds."""
    rows = made(50, 8, 5) + [(100 + i, [0.25] * 8) for i in range(5000)]
    q = centroids.quantised(table(spark, rows), 8, 64, "vec_id", "embedding")
    distinct = q.groupBy("h", "q").agg(F.count(F.lit(1)).alias("copies"))
    sums = centroids.weighted_sums(distinct, np.array([[0] * 8, [16] * 8]))
    assert sums.count() <= 16 and distinct.count() <= 51
    assert found(centroids.cluster(table(spark, rows), components=8)) == plainly(rows, components=8)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(centroids.op13_centroids(spark, sf), duck(sf), centroids.ORACLE_SQL["op13_centroids"])
