"""Sharding by a Feistel permutation with cycle walking over global row numbers.

DataFrame functions only. Rows get a global number from a fixed order, the
number is permuted, and shard = p mod shards, slot = p div shards: shard sizes
differ by one row at most, slots have no gap, and shard and slot of any row
number can be computed without looking at other rows.
"""

from __future__ import annotations

import hashlib
import math
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._util import read_table, staged

ROUNDS = 6
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 4096, 1 << 20, 500_000


def round_keys(seed: int) -> list[int]:
    """A 63-bit number for each round, from sha256 of seed and round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big") >> 1 for i in range(ROUNDS)]


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) with a*b >= n and a*b - n < a: few numbers to walk past."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def _apply(df: DataFrame, n: int, seed: int, only_outside: bool = False) -> DataFrame:
    """df with its column p permuted once within a*b, or only where p >= n.

    Alternating Feistel rounds add a keyed hash of one side to the other, modulo
    the other's range; each round can be undone, so the whole is a permutation.
    """
    a, b = domain(n)
    out = df.withColumns({"_l": F.expr(f"p div {b}"), "_r": F.col("p") % b})
    for i, k in enumerate(round_keys(seed)):
        to, by, side = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        out = out.withColumn(to, F.pmod(F.col(to) + F.pmod(F.xxhash64(F.col(by), F.lit(k)), F.lit(side)), F.lit(side)))
    new = F.col("_l") * b + F.col("_r")
    return out.withColumn("p", F.when(F.col("p") >= n, new).otherwise(F.col("p")) if only_outside else new).drop("_l", "_r")


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """How often the permutation must be repeated until every walk has ended.

    Only the fewer than sqrt(n)+1 numbers in [n, a*b) prolong a walk; they are
    followed in a small table of their own until none is left outside.
    """
    a, b = domain(n)
    steps, left = 0, a * b - n
    out = spark.range(n, a * b, numPartitions=1).select(F.col("id").alias("p"))
    while left:
        # all walks that are still outside after `steps` repeats
        out = staged(_apply(out, n, seed).where(F.col("p") >= n), "walk")
        left, steps = out.count(), steps + 1
        if steps > a:
            break  # the rest are cycles that lie outside altogether; no row number leads there
    return steps


def permuted(df: DataFrame, n: int, seed: int) -> DataFrame:
    """df with p, a number in [0, n), replaced by its place in the shuffle."""
    repeats = walk_length(df.sparkSession, n, seed)
    df = _apply(df, n, seed)
    for _ in range(repeats):
        df = _apply(df, n, seed, only_outside=True)
    return df


def numbered(df: DataFrame, order: list[str], n: int, to: str = "p") -> DataFrame:
    """df, of about n rows, with global row numbers from 0 in the order (bucket, *order).

    order: whole-number columns; rows alike in all of them are interchangeable.
    The bucket comes from a hash of them, so that no value of one column fills
    a bucket. There is a bucket for each BUCKET_ROWS rows, from BUCKETS to
    MOST_BUCKETS; their counts give the offsets and are broadcast.
    """
    buckets = min(MOST_BUCKETS, max(BUCKETS, n // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return df.withColumn("_place", place).join(F.broadcast(first), "_bucket").withColumn(to, F.col("_first") + F.col("_place") - 1).drop("_bucket", "_first", "_place")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes of the text plus 8),
    text_crc32, shard, slot.

    Order of the row numbers: id, crc32 and size of the text. Null ids and texts
    are allowed (a null text has size 8 and the crc32 of no bytes, 0); repeated
    rows get numbers of their own; an empty table gives an empty result; other
    columns of docs are left out, so their names do not matter. The text is read
    once: the slim table is staged before it is counted.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    slim = staged(slim, "shard")
    n = slim.count()
    out = permuted(numbered(slim, ["doc_id", "text_crc32", "size"], n), n, seed) if n else slim.withColumn("p", F.lit(0).cast("long"))
    return out.select("doc_id", "size", "text_crc32", (F.col("p") % shards).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return shard_documents(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_feistel_shards": op3_feistel_shards}
ORACLE_SQL: dict[str, str] = {}
