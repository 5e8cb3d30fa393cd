"""From raw documents to packed training sequences: five stages, each of one operator of loculus.llm.

Every stage works on all rows that the one before kept; all but the last return the columns of documents. Null ids and texts,
empty texts, repeated rows and extra columns of any name go through as each operator's docstring says; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loculus.llm.common import drop_table, read_table, write_table
from loculus.llm.mixing import mixed_rows
from loculus.llm.packing import pack_documents
from loculus.llm.quality import keep_good
from loculus.llm.shingle_join import keep_one
from loculus.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as bad go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix that takes a document, in the order of its slots; where it takes the first words alone, these."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token ids in sequences of at most 2048. Processes that the other stages share remember fewer words."""
    return pack_documents(docs, kept=200_000)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No stage before the mix can be said in SQL: two are learnt models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return docs
