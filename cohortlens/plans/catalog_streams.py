"""Queries on streams of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..streaming import keyed
from .catalog import query
from .views import table


@query("s17_keyed_stream", "SELECT event_id, user_id, event_type, round_even(value * 100, 0)::BIGINT AS cents, 'train' AS split FROM events")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """All events streamed twice over in four files each time: every key arrives once."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    path = new_path(spark, "arriving")
    for _ in range(2):
        events.repartition(4, "event_id").write.mode("append").parquet(path)
    out = new_path(spark, "arrived")
    stream = keyed.read_files(spark, path, events.schema, 2)
    keyed.append_once(stream, out, new_path(spark, "progress"), "event_id", within="3650 days").awaitTermination()
    got = spark.read.parquet(out)
    return got.select("event_id", "user_id", "event_type", F.rint(F.col("value") * 100).cast("long").alias("cents"), "split")
