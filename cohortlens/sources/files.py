"""Sources and sinks. Reads go through Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import free_name


def read_labels(spark: SparkSession, path: str | list[str], schema: StructType | str, latin1: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; a header that differs is an error. file_name tells the source file."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    reader = reader.option("encoding", "ISO-8859-1") if latin1 else reader
    return reader.csv(path).withColumn("file_name", F.col("_metadata.file_name"))


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, file_name, id, length): a listing; the files' content is not read. id is the name without its last four characters."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("file_name"), F.expr("left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - 4)").alias("id"), "length")


def image_files(listing: DataFrame, kinds: tuple[str, ...] = ("dcm", "dicom"), without: str = "_PR") -> DataFrame:
    hit = None
    for k in kinds:
        c = F.contains("file_name", F.lit(k))
        hit = c if hit is None else hit | c
    return listing.where(hit & ~F.contains("file_name", F.lit(without)))


def not_converted(listing: DataFrame, outputs: DataFrame, prefix: str = "") -> DataFrame:
    """Files whose id has no output; a prefix of the outputs' names is taken off before they are matched."""
    done = outputs.select(F.expr(f"CASE WHEN startswith(id, '{prefix}') THEN substring(id, {len(prefix) + 1}) ELSE id END").alias("id"))
    return listing.join(done, "id", "left_anti")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    return list_files(spark, path, True).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def valid_image_name(name: str | Column) -> Column:
    return F.lower(F.col(name) if isinstance(name, str) else name).rlike(r"\.(png|jpe?g)$")


def valid_image_content(content: str = "content") -> Column:
    """By the first bytes: PNG or JPEG."""
    head = F.hex(F.substring(F.col(content), 1, 8))
    return head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_stats(df: DataFrame, path: str) -> None:
    """Append-or-create; Parquet keeps types, and readers merge the schemas of rows with and without optional columns."""
    df.write.mode("append").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def upsert_columns(table: DataFrame, predictions: DataFrame, key: str, name: str) -> DataFrame:
    """table with column `name` from predictions (key, value); an array of scores becomes its largest."""
    kind = predictions.schema["value"].dataType.typeName()
    value = F.array_max("value") if kind == "array" else F.col("value")
    found = free_name("_new", table.columns, [name])
    new = predictions.select(key, value.alias(found))
    kept = F.col(name) if name in table.columns else F.lit(None)
    return table.join(new, key, "left").withColumn(name, F.coalesce(found, kept)).drop(found)


def reuse_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; where there is none, make() is written there first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_split_manifest(df: DataFrame, path: str) -> None:
    """A folder for each split instead of moved files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
