"""Retrieval, fusion and ranking-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import settings
from matchloom.functions.decisions import similarity_band
from matchloom.functions.trajectory import CRITERIA_COLUMNS, TRAJECTORY_COLUMNS, trajectory_score, with_criteria, with_trajectory
from matchloom.operators import channels as ch, fusion, ranking_metrics as rm
from matchloom.plans import tables as t
from matchloom.session import settle

K = 10
KS = [5, 10, 20]


# ---- building blocks over any corpus ---------------------------------------------------


def dense_channel(resumes: DataFrame, jobs: DataFrame, pool: int, encoder: ch.Encoder | None = None) -> DataFrame:
    return ch.text_dense_topk(resumes.select("resume_id", "text"), jobs.select("job_id", "description"), pool, encoder)


def bm25_channel(resumes: DataFrame, jobs: DataFrame, pool: int) -> DataFrame:
    return ch.bm25_topk(resumes.select("resume_id", "text"), jobs.select("job_id", "description"), pool)


def experience_channel(resumes: DataFrame, jobs: DataFrame, pool: int, **options) -> DataFrame:
    profiles = with_trajectory(resumes).select("resume_id", *TRAJECTORY_COLUMNS)
    asks = with_criteria(jobs).select("job_id", *CRITERIA_COLUMNS)
    return ch.experience_topk(profiles, asks, pool, **options)


def with_trajectory_score(pool: DataFrame, resumes: DataFrame, jobs: DataFrame, **options) -> DataFrame:
    """Adds ``trajectory`` to (query_id, doc_id) rows; each pooled candidate is parsed once."""
    pooled = resumes.join(pool.select(F.col("doc_id").alias("resume_id")).distinct(), "resume_id", "left_semi")
    profiles = with_trajectory(pooled).select(F.col("resume_id").alias("doc_id"), *TRAJECTORY_COLUMNS)
    asks = with_criteria(jobs).select(F.col("job_id").alias("query_id"), *CRITERIA_COLUMNS)
    scored = pool.join(profiles, "doc_id").join(asks, "query_id")
    return scored.withColumn("trajectory", trajectory_score(**options)["total"]).drop(*TRAJECTORY_COLUMNS, *CRITERIA_COLUMNS)


# (name, kind, parameter) of the compared retrievers
RETRIEVERS = [
    ("dense", "channel", "dense"), ("bm25", "channel", "bm25"), ("experience", "channel", "experience"),
    ("hybrid2", "rrf", ["dense", "bm25"]), ("hybrid3_equal", "rrf", ["dense", "bm25", "experience"]),
    ("hybrid3_w0.5", "weighted", 0.5), ("hybrid3_w0.3", "weighted", 0.3), ("hybrid3_w0.1", "weighted", 0.1),
    ("rerank_b0.9", "rerank", 0.9), ("rerank_b0.8", "rerank", 0.8), ("rerank_b0.7", "rerank", 0.7),
]


def compare_retrievers(found: dict[str, DataFrame], resumes: DataFrame, jobs: DataFrame, depth: int, pool: int) -> DataFrame:
    """(retriever, query_id, doc_id, rank) of all compared retrievers from one set of channel hits."""
    two = {c: found[c] for c in ("dense", "bm25")}
    fused = settle(
        with_trajectory_score(fusion.rrf(two, pool=pool).select("query_id", "doc_id", "rank"), resumes, jobs), "fused"
    )
    out = None
    for name, kind, value in RETRIEVERS:
        if kind == "channel":
            ranked = found[value]
        elif kind == "rrf":
            ranked = fusion.rrf({c: found[c] for c in value})
        elif kind == "weighted":
            ranked = fusion.rrf(found, {"dense": 1.0, "bm25": 1.0, "experience": value})
        else:
            ranked = fusion.rerank(fused, value)
        part = ranked.filter(F.col("rank") <= depth).select(F.lit(name).alias("retriever"), "query_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


# ---- bindings ------------------------------------------------------------------------


def text_channels(spark: SparkSession, folder: str, pool: int, names=("dense", "bm25")) -> dict[str, DataFrame]:
    make = {"dense": dense_channel, "bm25": bm25_channel, "experience": experience_channel}
    return {n: make[n](t.resumes(spark, folder), t.jobs(spark, folder), pool) for n in names}


def _example_side(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates with vectors and texts, and each label's prototype as a posting."""
    embeddings = t.vectors(spark, folder)
    # the texts are read by every channel and rerank: they are matched to the vectors once
    texts = settle(t.resumes(spark, folder).join(embeddings.select(F.col("vec_id").alias("resume_id")), "resume_id", "left_semi"), "texts")
    chosen = settle(t.prototypes(embeddings), "prototypes")
    asks = t.resumes(spark, folder).join(F.broadcast(chosen.select(F.col("vec_id").alias("resume_id"))), "resume_id").select(
        F.col("resume_id").alias("job_id"), F.lit("").alias("title"), F.col("text").alias("description"),
        F.col("skills").alias("required_skills"), F.col("years_experience").alias("min_years_experience"),
    )
    return embeddings, texts, chosen, asks


def label_qrels(spark: SparkSession, folder: str, chosen: DataFrame) -> DataFrame:
    """Grade 2 for the prototype's label and language, 1 for its label."""
    lang = t.table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    items = t.vectors(spark, folder).select("vec_id", "label").join(lang, "vec_id", "left")
    own = items.join(F.broadcast(chosen.select("vec_id")), "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), "label", F.col("lang").alias("query_lang")
    )
    return items.join(F.broadcast(own), "label").select(
        "query_id", F.col("vec_id").alias("doc_id"), F.when(F.col("lang") == F.col("query_lang"), 2.0).otherwise(1.0).alias("grade")
    )


# ---- queries -----------------------------------------------------------------------------


def dense_topk(spark, folder):
    embeddings = t.vectors(spark, folder)
    return ch.dense_topk(
        embeddings.select("vec_id", "embedding"), t.label_centroids(embeddings), K
    )


def similar_candidates(spark, folder):
    embeddings = t.vectors(spark, folder)
    hits = ch.similar_items(embeddings.select("vec_id", "embedding"), t.prototypes(embeddings).select("vec_id", "embedding"), K)
    return hits.withColumn("band", similarity_band(F.col("score")))


def text_dense_topk(spark, folder):
    return dense_channel(t.resumes(spark, folder), t.jobs(spark, folder), K)


def bm25_topk(spark, folder):
    return bm25_channel(t.resumes(spark, folder), t.jobs(spark, folder), K)


def experience_topk(spark, folder):
    return experience_channel(t.resumes(spark, folder), t.jobs(spark, folder), K)


def experience_topk_no_tier(spark, folder):
    return experience_channel(t.resumes(spark, folder), t.jobs(spark, folder), K, use_company_tier=False)


def rrf_two_channel(spark, folder):
    fused = fusion.rrf(text_channels(spark, folder, settings.pool), pool=settings.pool)
    return fused.select("query_id", "doc_id", "rank", F.round("rrf_score", 9).alias("rrf_score"), "dense_score", "bm25_score")


def rrf_three_channel_weighted(spark, folder):
    found = text_channels(spark, folder, settings.pool, ("dense", "bm25", "experience"))
    fused = fusion.rrf(found, {"dense": 1.0, "bm25": 1.0, "experience": 0.3}, pool=20)
    return fused.select("query_id", "doc_id", "rank", F.round("rrf_score", 9).alias("rrf_score"))


def trajectory_rerank(spark, folder):
    fused = fusion.rrf(text_channels(spark, folder, settings.pool), pool=settings.pool).select("query_id", "doc_id", "rank")
    scored = with_trajectory_score(fused, t.resumes(spark, folder), t.jobs(spark, folder))
    return fusion.rerank(scored, 0.8).select(
        "query_id", "doc_id", "position", "rank", F.round("trajectory", 6).alias("trajectory"), F.round("score", 6).alias("score")
    )


def channel_agreement(spark, folder):
    found = text_channels(spark, folder, settings.pool)
    found = {n: settle(df, n) for n, df in found.items()}
    found["hybrid2"] = fusion.rrf(found)
    pairs = [("dense", "bm25"), ("dense", "hybrid2"), ("bm25", "hybrid2")]
    rows = None
    for a, b in pairs:
        part = fusion.list_overlap(found[a], found[b], K).select(F.lit(f"{a}~{b}").alias("pair"), "jaccard")
        rows = part if rows is None else rows.unionByName(part)
    out = rm.spread_of(settle(rows, "jaccard"), "jaccard", ["pair"])
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p10", "p90")])


def category_mix(spark, folder):
    fused = fusion.rrf(text_channels(spark, folder, settings.pool), pool=K)
    docs = t.table(spark, folder, "documents").select("doc_id", "source")
    return (
        fused.join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source").limit(15)
    )


def structured_filter(spark, folder):
    ranked = t.supplier_rankings(spark, folder, settings.pool)
    pairs = ranked.join(t.customer_candidates(spark, folder), "doc_id").join(t.supplier_jobs(spark, folder), "query_id")
    kept = pairs.filter(fusion.passes_filters(
        F.col("years_experience"), F.col("min_years_experience"), F.col("location"), F.col("wanted_location"),
        F.col("skills"), F.col("required_certifications"),
    ))
    return fusion.renumber(kept.select("query_id", "doc_id", "score", "rank"))


def ranking_quality(spark, folder):
    embeddings = t.vectors(spark, folder)
    chosen = settle(t.prototypes(embeddings), "prototypes")
    ranked = ch.dense_topk(embeddings.select("vec_id", "embedding"), chosen.select("vec_id", "embedding"), max(KS))
    per_query = rm.per_query_metrics(ranked, label_qrels(spark, folder, chosen), KS)
    return per_query.select("query_id", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "rr")])


def retriever_comparison(spark, folder):
    embeddings, texts, chosen, asks = _example_side(spark, folder)
    depth, pool = max(KS), max(4 * max(KS), 50)
    found = {
        "dense": ch.dense_topk(embeddings.select("vec_id", "embedding"), chosen.select("vec_id", "embedding"), pool),
        "bm25": bm25_channel(texts, asks, pool),
        "experience": experience_channel(texts, asks, pool),
    }
    found = {n: settle(df, n) for n, df in found.items()}
    ranked = compare_retrievers(found, texts, asks, depth, pool)
    qrels = settle(label_qrels(spark, folder, chosen), "qrels")  # as many as vectors, and read three times
    per_query = rm.per_query_metrics(ranked, qrels, KS, ["retriever"])
    means = rm.mean_metrics(per_query, ["retriever"])
    names = ["mean_precision", "mean_recall", "mean_ndcg", "mrr"]
    return means.select("retriever", "k", *[F.round(c, 6).alias(c) for c in names], "n_queries")


def document_rank(spark, folder):
    """Full-corpus rank of each label's prototype by closeness to the label's centroid."""
    embeddings = t.vectors(spark, folder)
    dot = F.aggregate(F.zip_with("embedding", "vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    scored = embeddings.join(t.label_centroids(embeddings), "label").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), F.round(dot, 9).alias("score")
    )
    oldest = embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("doc_id"))
    return rm.rank_of(oldest, scored)


def recency_bias_comparison(spark, folder):
    out = None
    profiles = settle(with_trajectory(t.resumes(spark, folder)).select("resume_id", *TRAJECTORY_COLUMNS), "profiles")
    asks = with_criteria(t.jobs(spark, folder)).select("job_id", *CRITERIA_COLUMNS)
    for bias in (0.0, 0.6, 1.0):
        part = ch.experience_topk(profiles, asks, 5, recency_bias=bias).withColumn("recency_bias", F.lit(bias))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "dense_topk": dense_topk,
    "similar_candidates": similar_candidates,
    "text_dense_topk": text_dense_topk,
    "bm25_topk": bm25_topk,
    "experience_topk": experience_topk,
    "experience_topk_no_tier": experience_topk_no_tier,
    "rrf_two_channel": rrf_two_channel,
    "rrf_three_channel_weighted": rrf_three_channel_weighted,
    "trajectory_rerank": trajectory_rerank,
    "channel_agreement": channel_agreement,
    "category_mix": category_mix,
    "structured_filter": structured_filter,
    "ranking_quality": ranking_quality,
    "retriever_comparison": retriever_comparison,
    "document_rank": document_rank,
    "recency_bias_comparison": recency_bias_comparison,
}
