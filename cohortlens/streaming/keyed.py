"""New label rows from a stream, each key once, by keys held in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """Parquet files below path as a stream, so many in a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(path)


def first_of_key(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first row of each key. A key is kept in the state store until the watermark, which
    trails the latest `time` by `within`, is past its row's time by `within`; a row that comes
    later counts as new, so `within` must cover how far apart rows of a key may arrive. Nothing but
    the key is kept, and no micro-batch reads what was written before. Rows older than the
    watermark of the micro-batch before are dropped; rows without a time are kept apart by key as others are, but never
    leave the state. Which of several rows with a key in one micro-batch stays is not defined.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "id", time: str = "ts", within: str = "30 days", split: str = "train", stores: int = 32) -> StreamingQuery:
    """Rows of keys not seen before, with split and the micro-batch's number as batch, at path.

    A micro-batch owns the folder batch=<number> and replaces it when it is run
    again after a failure, so each row is written exactly once. The target is not read.

    stores: state stores, and so tasks of a micro-batch. Each is opened and
    committed in every micro-batch, however few its keys, so there should be
    about one for some millions of keys; a checkpoint keeps the number that it
    was begun with. Shuffles of other queries keep the session's number.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("split", F.lit(split)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = first_of_key(stream, key, time, within).writeStream.foreachBatch(put).outputMode("append")
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(stores))
    try:  # a stream takes its settings from the session as it starts
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
