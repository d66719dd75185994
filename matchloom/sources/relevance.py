"""Graded relevance judgements as (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_qrels(raw: DataFrame, column: str = "value") -> DataFrame:
    """From a JSON text {query: {document: grade}}; entries that are not maps are skipped."""
    outer = raw.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("query_id", "body"))
    inner = outer.select("query_id", F.from_json("body", "map<string,double>").alias("grades"))
    return inner.select("query_id", F.explode("grades").alias("doc_id", "grade")).filter(F.col("grade").isNotNull())


def read_qrels(spark: SparkSession, path: str, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Judgements on known postings and candidates; a query left without any is gone."""
    return known_only(parse_qrels(spark.read.text(path, wholetext=True)), jobs, resumes)


def known_only(qrels: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    return qrels.join(jobs.select(F.col("job_id").alias("query_id")), "query_id", "left_semi").join(
        resumes.select(F.col("resume_id").alias("doc_id")), "doc_id", "left_semi"
    ).select("query_id", "doc_id", "grade")


def evaluable(qrels: DataFrame, min_relevant: int = 1) -> DataFrame:
    """Judgements of the queries that have enough relevant documents."""
    enough = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n")).filter(F.col("n") >= min_relevant)
    return qrels.join(enough.select("query_id"), "query_id", "left_semi")
