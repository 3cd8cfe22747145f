"""New label rows arrive as a stream and are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Rows whose key the table at path lacks go there with split train and the
    micro-batch's number. Of several rows of a batch with one key the least row
    goes in (columns compared from left to right). A batch that is run again
    after a failure finds its keys in the table, so nothing is added twice. Of the
    table only keys are read, and only those that the batch asks about are joined."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        least = F.min(F.struct(*batch.columns)).alias("row")
        rows = batch.groupBy(F.col(key).alias("_key")).agg(least).select("row.*")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            known = spark.read.parquet(path).select(key).join(rows.select(key), key, "left_semi")
            rows = rows.join(known, key, "left_anti")
        rows.withColumns({"split": F.lit("train"), "batch": F.lit(number)}).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
