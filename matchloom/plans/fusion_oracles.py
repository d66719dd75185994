"""DuckDB statements for the text vectors, the fusion of the channels, and what is measured on fused lists."""

from __future__ import annotations

from matchloom.config import settings
from matchloom.operators.fairness import EPSILON
from matchloom.operators.fusion import RRF_SMOOTHING
from matchloom.plans.rule_oracles import _TOKENS, _bm25, _d

#: Slots of the hashed text vectors.
_SLOTS = 384


def _vectors(name: str, key: str, source: str) -> str:
    """CTE (id, slot, x): token counts by hashed slot at unit length, in single precision."""
    return f"""
        {name} AS (
            SELECT id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM (
                SELECT id, ('0x' || left(md5(tok), 8))::BIGINT % {_SLOTS} AS slot, count(*)::DOUBLE AS n
                FROM (SELECT {key} AS id, unnest({_TOKENS}) AS tok FROM {source}) GROUP BY ALL
            )
        )
    """


def _dense(k: int) -> str:
    return f"""
        {_vectors('docs_x', 'doc_id', 'documents')}, {_vectors('asks_x', 'item_id', 'benchmark')},
        met AS (SELECT a.id AS query_id, d.id AS doc_id, sum(a.x * d.x) AS score FROM asks_x a JOIN docs_x d USING (slot) GROUP BY a.id, d.id),
        dense_every AS (
            SELECT item_id AS query_id, d.doc_id, round(coalesce(score, 0), 9) AS score
            FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN met m ON m.query_id = item_id AND m.doc_id = d.doc_id
        ),
        dense_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_every),
        dense AS (SELECT * FROM dense_ranked WHERE rank <= {k})
    """


def _fused(channel_pool: int) -> str:
    """CTEs dense and hits (the lexical ones) of a pool, and fused with the ranks and scores of both."""
    return f"""
        {_dense(channel_pool)}, {_bm25(channel_pool)},
        wide AS (
            SELECT query_id, doc_id, d.rank AS dense_rank, d.score AS dense_score, b.rank AS bm25_rank, b.score AS bm25_score,
                coalesce(1 / ({_d(RRF_SMOOTHING)} + d.rank), 0) + coalesce(1 / ({_d(RRF_SMOOTHING)} + b.rank), 0) AS rrf_score
            FROM dense d FULL JOIN hits b USING (query_id, doc_id)
        ),
        fused AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank FROM wide
        )
    """


_LISTS = """
    lists AS (
        SELECT 'dense' AS channel, query_id, doc_id, rank FROM dense WHERE rank <= 10
        UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM hits WHERE rank <= 10
        UNION ALL SELECT 'hybrid2', query_id, doc_id, rank FROM fused WHERE rank <= 10
    )
"""
_EPS = _d(EPSILON)
_SKEW = f"ln(greatest(topk_share, {_EPS}) / greatest(corpus_share, {_EPS}))"
_SKEWED = f"""
    {_fused(50)}, {_LISTS},
    corpus_groups AS (SELECT lang AS "group", count(*)::DOUBLE / (SELECT count(*) FROM documents) AS corpus_share FROM documents GROUP BY lang),
    top AS (
        SELECT channel, query_id, lang AS "group", row_number() OVER (PARTITION BY channel, query_id ORDER BY rank) AS r
        FROM lists JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
    ),
    parts AS (
        SELECT h.channel, h.query_id, h.r, t."group", count(*)::DOUBLE / h.r AS p
        FROM top h JOIN top t ON t.channel = h.channel AND t.query_id = h.query_id AND t.r <= h.r GROUP BY h.channel, h.query_id, h.r, t."group"
    ),
    kl AS (
        SELECT channel, query_id, r, sum(p * ln(p / greatest(coalesce(corpus_share, {_EPS}), {_EPS}))) AS kl
        FROM parts LEFT JOIN corpus_groups USING ("group") GROUP BY channel, query_id, r
    ),
    ndkl AS (SELECT channel, query_id, sum(kl / log2(r + 1)) / greatest(sum(1 / log2(r + 1)), {_EPS}) AS ndkl FROM kl GROUP BY channel, query_id),
    shares AS (SELECT channel, query_id, "group", count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY channel, query_id) AS share FROM top GROUP BY channel, query_id, "group"),
    skewed AS (
        SELECT n.channel, n.query_id, g."group", corpus_share, coalesce(share, 0) AS topk_share, ndkl
        FROM ndkl n CROSS JOIN corpus_groups g LEFT JOIN shares s ON s.channel = n.channel AND s.query_id = n.query_id AND s."group" = g."group"
    )
"""

FUSION_ORACLES = {
    "text_dense_topk": f"WITH {_dense(10)} SELECT query_id, doc_id, score, rank::INT AS rank FROM dense",
    "category_mix": f"""
        WITH {_fused(settings.pool)} SELECT source, count(*) AS n FROM fused JOIN documents USING (doc_id) WHERE rank <= 10
        GROUP BY source ORDER BY n DESC, source NULLS FIRST LIMIT 15
    """,
    "channel_agreement": f"""
        WITH {_fused(settings.pool)}, {_LISTS}, tops AS (SELECT channel, query_id, list(doc_id) AS docs FROM lists GROUP BY channel, query_id),
        agreed AS (
            SELECT a.channel || '~' || b.channel AS pair, len(list_intersect(a.docs, b.docs))::DOUBLE / len(list_distinct(a.docs || b.docs)) AS jaccard
            FROM tops a JOIN tops b USING (query_id) WHERE (a.channel, b.channel) IN (('dense', 'bm25'), ('dense', 'hybrid2'), ('bm25', 'hybrid2'))
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY pair ORDER BY jaccard) - 1 AS place, count(*) OVER (PARTITION BY pair) AS n FROM agreed
        )
        SELECT pair, round(avg(jaccard), 6) AS mean, round(quantile_cont(jaccard, 0.5), 6) AS median,
            round(max(jaccard) FILTER (place = n // 10), 6) AS p10, round(max(jaccard) FILTER (place = greatest(0, 9 * n // 10 - 1)), 6) AS p90
        FROM placed GROUP BY pair
    """,
    "ranking_skew": f"""
        WITH {_SKEWED} SELECT channel, query_id, "group", round(corpus_share, 6) AS corpus_share, round(topk_share, 6) AS topk_share,
            round({_SKEW}, 6) AS skew, round(ndkl, 6) AS ndkl
        FROM skewed
    """,
    "ranking_skew_mean": f"""
        WITH {_SKEWED}, meant AS (
            SELECT channel, "group", any_value(corpus_share) AS corpus_share, avg(topk_share) AS topk_share, avg(ndkl) AS ndkl FROM skewed GROUP BY channel, "group"
        )
        SELECT channel, "group", round(corpus_share, 6) AS corpus_share, round(topk_share, 6) AS topk_share, round({_SKEW}, 6) AS skew, round(ndkl, 6) AS ndkl FROM meant
    """,
    "final_ranking": f"""
        WITH {_fused(30)}, terms AS (
            SELECT query_id, doc_id, rank, coalesce(bm25_score, 0) AS bm25, {_d(0.6)} * coalesce(dense_score, 0) AS sem,
                {_d(0.4)} * (1 - (doc_id * 17 + query_id * 29) % 1000 / 1000::DOUBLE) AS stay, {_d(0.2)} * ((doc_id * 23 + query_id * 5) % 1000 / 1000::DOUBLE) AS traj
            FROM fused WHERE rank <= 30
        ), summed AS (SELECT *, round(sem + stay + traj, 9) AS final, greatest({_d(1e-6)}, sem + stay + traj) AS total FROM terms)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank)::INT AS final_rank, final, round(bm25, 6) AS bm25,
            round(100 * sem / total, 6) AS sem_pct, round(100 * stay / total, 6) AS stay_pct, round(100 * traj / total, 6) AS exp_pct
        FROM summed
    """,
}

#: Not in the gate: lexical scores are sums of rounded parts, and one in some thousands lies so near a half of its ninth
#: decimal that the order of summation decides it. Tests compare them within a tolerance.
CLOSE = {
    "rrf_two_channel": f"""
        WITH {_fused(settings.pool)} SELECT query_id, doc_id, rank::INT AS rank, round(rrf_score, 9) AS rrf_score, dense_score, bm25_score
        FROM fused WHERE rank <= {settings.pool}
    """,
}
