"""Building cohorts from label tables and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from ..functions.scalar import any_positive


def rename_first_wins(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed, spaces taken out of names; of several columns with one target the first stays."""
    seen, out = set(), []
    for c in df.columns:
        target = names.get(c.replace(" ", ""), c.replace(" ", ""))
        if target not in seen:
            seen.add(target)
            out.append(F.col(f"`{c}`").alias(target))
    return df.select(*out)


def stack_sources(sources: list[tuple[DataFrame, str]], columns: list[str]) -> DataFrame:
    """Union in the given order with ids prefixed, projected to columns; missing ones are null; src_ord keeps the order."""
    out = None
    for i, (df, prefix) in enumerate(sources):
        have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns if c != "id"]
        part = df.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), *have, F.lit(i).alias("src_ord"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, nulls first; of rows alike in that order any one.

    Tasks keep one row for each key before rows are shuffled, so a frequent key is no task's burden.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("key")).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def add_flags(df: DataFrame, findings: list[str], tests: list[str]) -> DataFrame:
    """abnormal_tb: any positive among tests and findings given; nulls count as 0."""
    return df.withColumn("abnormal_tb", any_positive(*findings, *tests))


def kind(abnormal: Column, abnormal_tb: Column) -> Column:
    """normal, no TB or TB; the last prevails."""
    return F.when(abnormal_tb == 1, "TB").when((abnormal == 1) & (abnormal_tb == 0), "no TB").otherwise("normal")


def reference_flags(df: DataFrame, good_sites: list[str], site: str = "panel_site", source: str = "source") -> DataFrame:
    """good_any, panel_pos, iom_read, pref_reads, ref_abn and ref_nrm as booleans."""
    good, panel, iom = F.col(site).isin(good_sites), F.col(source) == "pan", F.col(source) == "iom"
    return df.withColumns({"good_any": good, "panel_pos": panel, "iom_read": iom, "pref_reads": good | panel | iom, "ref_abn": (panel | iom) & (F.col("abnormal") == 1), "ref_nrm": good & (F.col("abnormal") == 0)})


def match_files(records: DataFrame, files: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(records with a file, files without a record): the files' keys are made distinct first."""
    f = dedupe_first(files, key, [c for c in files.columns if c != key] or [key])
    return records.join(f, key), f.join(records.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, name: str, value: str, missing: str = "NA", strict: bool = True, most: int = 100_000) -> DataFrame:
    """df with `value` of the table row whose `name` is the key; key 'nan' or null gives `missing`.

    Of several rows with one name the smallest value counts. The table is broadcast if it has at most `most` rows, and joined by shuffle
    beyond that. strict: a key without a row is an error.
    """
    k = free_name("_k", df.columns, [value])
    t = table.groupBy(F.col(name).alias(k)).agg(F.min(F.col(value)).alias(value))
    t = F.broadcast(t) if t.limit(most + 1).count() <= most else t
    none = F.col(key).isNull() | (F.col(key) == "nan")
    found = df.join(t, F.col(key) == F.col(k), "left").drop(k)
    unknown = F.raise_error(F.concat(F.lit("no entry for "), F.col(key))).cast("string") if strict else F.lit(None).cast("string")
    return found.withColumn(value, F.when(none, F.lit(missing)).when(F.col(value).isNull(), unknown).otherwise(F.col(value)))


def add_new_only(old: DataFrame, incoming: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """old with the incoming rows that have a file and are not in old: split train, batch one above the highest."""
    new = incoming.join(files.select(key).distinct(), key, "left_semi").join(old.select(key), key, "left_anti")
    next_ = free_name("_b", new.columns)
    batch = old.agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).alias(next_))  # one row
    return old.unionByName(new.crossJoin(batch).withColumn("split", F.lit("train")).withColumn("batch", F.col(next_)).drop(next_), allowMissingColumns=True)
