"""From raw documents to tokens: toxic texts go, of near copies one stays,
personal data is masked, sources are mixed to target weights, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bpe, mixing, pii, simhash, toxicity
from cohortlens.llm._util import read_table, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the texts that the grammar scores as toxic; it learns from the table labels.

    Null and empty texts and rows without an id stay; repeated rows share their
    fate; all columns stay as they are; an empty table gives an empty one.
    """
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of texts that are alike (five words, similarity 0.8).

    The row with the smallest id stays. All null and empty texts are one group;
    of repeated rows one stays; of a group without ids one row stays; other
    columns pass unless their names start with _dup_; an empty table gives an
    empty one.
    """
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every span of personal data replaced by its kind, and n_chars counted anew.

    No row goes. Null texts stay null; repeated rows are masked alike; other
    columns pass; an empty table gives an empty one.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix of sources takes them: rows left out, once, or up to three times.

    Texts without words are never taken; rows alike in id, text and source share
    what is taken of them; a null source is a source of its own; other columns
    pass; an empty table gives an empty one.
    """
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs.

    Null and empty texts have no tokens; null ids and repeated rows give rows of
    their own; other columns are not read; an empty table gives an empty one.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written as Parquet and read again for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
