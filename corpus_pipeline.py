"""The corpus pipeline: score, strip boilerplate, drop near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.jaccard_join import one_of_each
from matchloom.llm.line_dedup import without_boilerplate
from matchloom.llm.mixing import mixed_documents
from matchloom.llm.packing import pack_documents
from matchloom.llm.quality_model import good_documents
from matchloom.llm.queries import tokenizer_path
from matchloom.llm.store import settle, table
from matchloom.session import ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    ship_package(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three words and more that ten sources share stay in the first document only."""
    return without_boilerplate(docs, min_sites=10, min_words=3)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    ship_package(spark)
    return one_of_each(docs, words=5, num=80, den=100)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights; a document comes once for each time that the mix takes it."""
    return mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences of 2048."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: A classifier that is trained, a tokenizer and a packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
