"""Both sides of a join laid out once in sorted buckets of the key, so that joins of them do not shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..sources.scratch import new_path

ROWS_MOST = 500_000  # rows of either side for each bucket, beyond which there are more buckets


@dataclass(frozen=True)
class Pair:
    """Two tables with as many buckets of (key, piece), sorted by these. Filters and selections of
    either (that keep both columns) may be put in its place with `replace`."""

    left: DataFrame
    right: DataFrame
    key: str
    piece: str

    def join(self, ordered: bool = False) -> DataFrame:
        """The inner join, the key once, from left. ordered: sorted by key over all partitions, which costs an exchange of its result."""
        out = self.left.join(self.right, [self.key, self.piece]).drop(self.piece)
        return out.orderBy(self.key) if ordered else out


def _written(df: DataFrame, buckets: int, key: str, piece: str, name: str) -> DataFrame:
    """df as a table of one file a bucket. It is in the catalogue only while its layout is read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "cohortlens_" + path.rpartition("/")[2].replace("-", "_")
    # rows go to tasks by the same hash as to buckets, so each task writes one file
    df.repartition(buckets, key, piece).write.format("parquet").bucketBy(buckets, key, piece).sortBy(key, piece).option("path", path).saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of an outside path: the files stay
    return held


def _often(df: DataFrame, key: str, n: int, buckets: int, to: str) -> DataFrame:
    """(key, to): into how many pieces rows of a key are dealt, for keys of df's n rows with more rows than
    a bucket holds on average. These are fewer than buckets, whatever the table."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias(to)).where(F.col(to) * buckets > n)
    return counted.select(key, F.ceil(F.col(to) * buckets / F.lit(max(n, 1))).cast("int").alias(to))


def lay_out(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, buckets: int = 64) -> Pair:
    """left and right for repeated inner joins of left's key with right_key (the same name if not given).

    A key with more rows than a bucket holds on average is dealt in pieces by
    the hash of the whole row (identical rows stay together; columns of maps
    have no hash and are an error), and the other side's rows of that key are
    copied to each piece; if it is frequent on both sides, pieces of one meet
    pieces of the other, each pair of rows once. Null keys join with nothing and
    are left out. The keys need one type. Other columns must differ in name from
    each other. `buckets` is the least number; it is doubled until a bucket has
    at most ROWS_MOST rows of either side on average, so that what a task of a
    join holds does not grow with the tables. Choose more for wide rows, so that
    one holds some 200 MB.
    """
    right_key = right_key or key
    kinds = [dict(df.dtypes).get(k) for df, k in ((left, key), (right, right_key))]
    if kinds[0] != kinds[1] or kinds[0] is None:
        raise TypeError(f"keys of one type are needed, not {kinds[0]} and {kinds[1]}")
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {right_key.lower()}
    if both - {key.lower()} or (key.lower() != right_key.lower() and key.lower() in {c.lower() for c in right.columns}):
        raise ValueError(f"columns of both sides: {sorted(both | {key.lower()})}")
    right = right if right_key == key else right.withColumnRenamed(right_key, key)
    taken = [left.columns, right.columns]
    piece, of_left, of_right = (free_name(n, *taken) for n in ("_piece", "_of_left", "_of_right"))
    left, right = (df.where(F.col(key).isNotNull()) for df in (left, right))
    n_left, n_right = left.count(), right.count()
    while max(n_left, n_right) > buckets * ROWS_MOST:
        buckets *= 2
    often = _often(left, key, n_left, buckets, of_left).join(_often(right, key, n_right, buckets, of_right), key, "full")
    spark = left.sparkSession
    path = new_path(spark, "often")
    often.repartition(1).write.parquet(path)  # fewer than 2 x buckets rows; all keys are counted before in many tasks
    often = F.broadcast(spark.read.schema(often.schema).parquet(path))
    a, b = (F.coalesce(c, F.lit(1)) for c in (of_left, of_right))

    def dealt(df: DataFrame, own, other, number) -> DataFrame:
        at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), own).cast("int")
        copies = F.explode(F.transform(F.sequence(F.lit(0), other - 1), lambda i: number(at, i)))
        return df.join(often, key, "left").select(*[F.col(f"`{c}`") for c in df.columns], copies.alias(piece))

    left = dealt(left, a, b, lambda at, i: (at * b + i).cast("int"))
    right = dealt(right, b, a, lambda at, i: (i * b + at).cast("int"))
    return Pair(_written(left, buckets, key, piece, "left"), _written(right, buckets, key, piece, "right"), key, piece)
