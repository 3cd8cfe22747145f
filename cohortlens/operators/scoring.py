"""Batch scoring with a model of the user's, and what follows from its scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from . import image


def score_batches(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], names: list[str], features: str = "pixels", suffix: str = "_prob") -> DataFrame:
    """df with a column <name><suffix> for each name.

    load() is called once in a task and gives a function from a matrix (rows,
    features) to scores (rows, names); it sees Arrow batches, so memory does not
    grow with the table. Rows whose features are null get null scores. All rows
    of a batch need equally many features.
    """
    new = [f"{n}{suffix}" for n in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in new])
    at = df.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            x = b.column(at)
            have = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            out = np.full((b.num_rows, len(names)), np.nan)
            if len(have):
                out[have] = model(x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(have), -1))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64(), from_pandas=True) for c in out.T)], [*b.schema.names, *new])

    return shipped(df).mapInArrow(run, schema)


def turn_inverted(df: DataFrame, score: str, pixels: str = "pixels") -> DataFrame:
    """df with the pixels of rows whose score rounds to 1 turned to negatives, and was_inverted."""
    hit = F.coalesce(F.rint(score) == 1, F.lit(False))
    return df.withColumns({"was_inverted": hit, pixels: F.when(hit, image.invert(pixels)).otherwise(F.col(pixels))})
