"""Near-duplicate vectors in odd tables: null and repeated ids, names that clash, against every pair."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import near_dup_vectors


def by_hand(ids, x, t):
    """(id, n_links, component_id) by all pairs of rows that take part."""
    norm = np.linalg.norm(x, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    unit = np.where(fine[:, None], x, 0) / np.where(fine, norm, 1)[:, None]
    link = (unit @ unit.T >= t - 1e-12) & fine[:, None] & fine[None, :]
    np.fill_diagonal(link, False)
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], int(link[i].sum()), min((ids[j] for j in seen if ids[j] is not None), default=None)))
    return sorted(out, key=repr)


def test_ids_that_are_null_or_repeated_and_columns_that_clash(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6))
    x[10:30] = x[:20] + rng.normal(size=(20, 6)) * 0.05  # near copies
    x[30:36] = x[0]  # exact ones
    x[40], x[41, 2] = 0, np.nan
    ids = [None if i in (0, 12, 50) else i - 100 if i % 11 == 0 else i // 2 for i in range(60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    odd = df.withColumns({n: F.lit("own") for n in ("id", "key", "v", "least", "copies", "home", "near", "guest", "root", "n_links", "component_id")})
    for frame in (df, odd):
        got = sorted(((r["id"], r["n_links"], r["component_id"]) for r in near_dup_vectors.near_duplicates(frame, 0.9).collect()), key=repr)
        assert got == by_hand(ids, x, 0.9)
