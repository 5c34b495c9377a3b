"""The corpus pipeline: rules, near copies, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemis.llm import packing, pii, quality, simhash, substring
from mnemis.llm.common import cut, whole


# Each stage takes doc_id, text and any other columns, whatever their names, and but for the last gives back the columns it got.


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, as they are.

    A null or empty text is rejected, a null doc_id doesn't matter, texts of any length are judged whole and alone,
    so repeated rows pass or go together. An empty table gives no rows.
    """
    return quality.passing(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id; of rows that share it, one.

    A null doc_id comes last. Null, empty and blank texts are one class, repeated rows are one class, ties go as in
    `simhash.heads`; long texts are read whole. An empty table gives no rows.
    """
    return simhash.heads(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those that lost words have what is left, joined by spaces.

    A null text stays null, a null doc_id comes before all others, of repeated rows one stays whole, a text of any
    length is read whole. An empty table gives no rows.
    """
    out = substring.remove_repeats(docs.select("doc_id", "text", whole(docs, but="text").alias("all")), carry=["all"])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.select(*(text.alias(c) if c.lower() == "text" else F.col("row")["all"].getField(c).alias(c) for c in docs.columns))


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind.

    A null text stays null. Rows are judged alone, so repeated rows get equal texts; a text of any length is read
    whole, in time that grows with its length. An empty table gives no rows.
    """
    return pii.masked_rows(docs, pii.fit(docs))


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, and its ids. Groups are smaller, as rows carry their ids.

    A null text is one piece of length 1, a null doc_id stays null, rows that are repeated are packed each, a long
    text is cut into pieces. An empty table gives no rows.
    """
    return packing.pack(packing.pieces(docs), packing.groups_for(docs, 4096))


STAGES = [("quality_rules", _quality), ("near_dedup", _near_copies), ("substring_dedup", _passages), ("pii", _private), ("packing", _packed)]

#: SQL has no SimHash, FM-index or tokenizer, so the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each kept in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
