"""Labels with the files they name, in batches of a bounded number of bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalar import hash_key
from ..shipping import shipped
from .files import list_files

LISTED = ("path", "length")
ADDED = ("path", "length", "shard", "batch")


def matched(labels: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """Rows of labels whose file is listed, with its path and length. Rows without a file and files
    without a row are left out (see unmatched); nothing is read but the listing. A name that stands in
    several folders matches each; a null name matches none."""
    clash = {c.lower() for c in labels.columns} & {*ADDED, "content"}
    if clash:
        raise ValueError(f"labels have the columns {sorted(clash)}, which are added here")
    name = free_name("_file", labels.columns)
    return labels.join(listing.select(F.col("file_name").alias(name), *LISTED), F.col(f"`{file}`") == F.col(name)).drop(name)


def unmatched(labels: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """(name, side): names that only labels have, or only files."""
    named = labels.select(F.col(f"`{file}`").alias("name")).where("name IS NOT NULL").distinct()
    listed = listing.select(F.col("file_name").alias("name")).distinct()
    return named.join(listed, "name", "left_anti").withColumn("side", F.lit("labels")).union(listed.join(named, "name", "left_anti").withColumn("side", F.lit("files")))


def batched(rows: DataFrame, most_bytes: int = 64 << 20, shards: int = 64, seed: int | str = 0, file: str = "file", shuffle: bool = True) -> DataFrame:
    """rows of `matched` with a shard and the number of a batch within it.

    Files are dealt to shards by the hash of their name and ordered in a shard
    by that hash (shuffle) or by name. A batch holds at most `most_bytes`: what
    begins within one half of that by the running sum, and no file of more than
    half; those are batches of their own, and only there may a single file be
    larger. Only lengths are looked at. Choose `shards` so that one holds up to
    some millions of files.
    """
    if most_bytes < 2 or shards < 1:
        raise ValueError("a batch has two bytes at least, and there is one shard at least")
    half, key = most_bytes // 2, hash_key(seed, F.col(f"`{file}`"))
    order, small = free_name("_order", rows.columns), F.col("length") <= half
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]  # rows of one file, in a fixed order
    by = [F.col(order)] if shuffle else []
    w = Window.partitionBy("shard").orderBy(*by, F.col(f"`{file}`"), "path", *rest).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(small, F.col("length")).otherwise(0)).over(w), F.lit(0))
    large = F.coalesce(F.sum(F.when(small, 0).otherwise(1)).over(w), F.lit(0))
    # even numbers for batches of small files, odd ones for large files
    number = F.when(small, 2 * F.floor(before / half)).otherwise(2 * large + 1).cast("long")
    keyed = rows.withColumn(order, key).withColumn("shard", (F.col(order) % shards).cast("int"))
    return keyed.withColumn("batch", number).drop(order)


class Files:
    """Content by the paths that Spark lists, through Arrow's file systems."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[pa.fs.FileSystem, str]] = {}

    def read(self, path: str) -> bytes:
        parts = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)", path)
        if path.startswith("file:"):
            root, rest = "file", "/" + path[5:].lstrip("/")
        elif parts:
            root, rest = f"{parts[1]}://{parts[2]}", parts[3]
        else:
            root, rest = "file", path
        if root not in self.known:
            self.known[root] = (pa.fs.LocalFileSystem(), "") if root == "file" else pa.fs.FileSystem.from_uri(root + "/")
        store, base = self.known[root]
        with store.open_input_stream(base.rstrip("/") + rest) as f:
            return f.read()


def map_batches(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str, tasks: int | None = None) -> DataFrame:
    """run(batch) for each batch of `batched`, which are dealt to so many tasks (as many as shuffles have, if not given).

    A batch is an Arrow table of the rows' columns with `content`; its files are
    read in the task that handles it, and no other batch is held beside it. A
    file that was changed since it was listed is an error.
    """
    # a stated number: rows without their content are small, and would be put together in few tasks
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*rows.columns, "content"]
    key = (rows.columns.index("shard"), rows.columns.index("batch"))

    def full(held: list[pa.RecordBatch], files: Files) -> pa.Table:
        table = pa.Table.from_batches(held)
        content = []
        for path, length in zip(table.column("path").to_pylist(), table.column("length").to_pylist()):
            content.append(files.read(path))
            if len(content[-1]) != length:
                raise OSError(f"{path} has {len(content[-1])} bytes and was listed with {length}")
        return pa.Table.from_arrays([*table.columns, pa.array(content, pa.binary())], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, now = Files(), [], None
        for b in batches:
            ids = list(zip(b.column(key[0]).to_pylist(), b.column(key[1]).to_pylist()))
            begin = 0
            for at in range(1, len(ids) + 1):
                if at < len(ids) and ids[at] == ids[begin]:
                    continue
                if held and now != ids[begin]:
                    yield from run(full(held, files)).to_batches()
                    held = []
                now = ids[begin]
                held.append(b.slice(begin, at - begin))
                begin = at
        if held:
            yield from run(full(held, files)).to_batches()

    dealt = shipped(rows).repartition(tasks, "shard", "batch").sortWithinPartitions("shard", "batch")
    return dealt.mapInArrow(each, schema)


def with_content(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows of `batched` with their files' content."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, lambda t: t, f"{fields}, content binary", tasks)


def labelled_folders(spark: SparkSession, path: str, most_classes: int = 100_000) -> DataFrame:
    """list_files below path, with the folder of each file as label, and its class: its number among the
    labels in order, from 0. More than `most_classes` folders are an error."""
    listing = list_files(spark, path, True).withColumn("label", F.element_at(F.split("path", "/"), -2))
    labels = listing.select("label").distinct()
    if labels.limit(most_classes + 1).count() > most_classes:
        raise ValueError(f"more than {most_classes} folders")
    classes = labels.withColumn("class", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # bounded by the check
    return listing.join(F.broadcast(classes), "label")
