"""DuckDB statements that say what registered queries return, each from the tables alone."""

from __future__ import annotations

from matchloom.functions import vocab as V

_SCORED = """
    scored AS (
        SELECT l.doc_id, d.lang, d.source, l.quality AS label, l.toxic,
            ((d.n_chars * 37 + l.doc_id * 11) % 1000)::DOUBLE / 1000::DOUBLE AS p
        FROM labels l JOIN documents d USING (doc_id)
    )
"""

_GROUPS = f"""
    WITH {_SCORED}, audit AS (
        SELECT lang AS "group", count(*) AS n, avg(label::DOUBLE) AS base_rate,
            (count(*) FILTER (p >= 0.5)) / count(*) AS selection_rate,
            coalesce((count(*) FILTER (p >= 0.5 AND label = 1)) / nullif(count(*) FILTER (label = 1), 0), 0) AS tpr,
            coalesce((count(*) FILTER (p >= 0.5 AND label = 0)) / nullif(count(*) FILTER (label = 0), 0), 0) AS fpr
        FROM scored GROUP BY lang HAVING count(*) >= 20
    )
"""

_GRID = """
    grid AS (SELECT i, 0.05::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(91) AS g(i))
"""

_FORM_EVENTS = f"""
    raw AS (
        SELECT user_id AS session_id, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type
        FROM events
    ), acts AS (
        SELECT session_id, ts, seq, k, CASE event_type
            WHEN 'signup' THEN 'fill' WHEN 'error' THEN 'skip' WHEN 'click' THEN 'back' WHEN 'purchase' THEN 'submit'
            ELSE CASE WHEN k % 2 = 1 THEN 'device' ELSE 'clear' END END AS action
        FROM raw
    ), form AS (
        SELECT session_id, ts, seq, action,
            CASE WHEN action IN ('fill', 'skip', 'clear') THEN ({V.FORM_FIELDS!r})[k % 8 + 1] END AS field,
            CASE WHEN action = 'device' THEN k % 4 = 1 END AS is_mobile
        FROM acts
    )
"""

_STATES = f"""
    {_FORM_EVENTS}, marked AS (
        SELECT *, max(CASE WHEN action = 'clear' THEN (ts, seq) END) OVER (PARTITION BY session_id, field) AS cleared
        FROM form WHERE field IS NOT NULL
    ), opened AS (
        SELECT session_id, field, action, row_number() OVER (PARTITION BY session_id, field ORDER BY ts, seq) AS place
        FROM marked WHERE action <> 'clear' AND (cleared IS NULL OR (ts, seq) > cleared)
    ), states AS (
        SELECT session_id, field, CASE action WHEN 'fill' THEN 'filled' ELSE 'skipped' END AS status FROM opened WHERE place = 1
    )
"""

_CENTROIDS = """
    cells AS (
        SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS slot FROM embeddings
    ), centroids AS (SELECT label, slot, avg(x) AS c FROM cells GROUP BY label, slot),
    closeness AS (
        SELECT label, vec_id, round(sum(x * c), 9) AS score FROM cells JOIN centroids USING (label, slot) GROUP BY label, vec_id
    )
"""

_OFFERS = """
    offers AS (
        SELECT l_discount - l_tax AS offer_salary_gap_pct,
            least(90, greatest(0, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 120))::DOUBLE AS days_interview_to_offer,
            least(8, greatest(1, l_linenumber)) AS interview_rounds, least(720, l_quantity * 12) AS candidate_response_hours,
            l_linenumber % 7 AS negotiation_rounds, (l_returnflag = 'R')::INT AS competing_offer_signal,
            least(180, l_extendedprice / 600) AS commute_minutes, (l_linestatus = 'O')::INT AS remote_option,
            least(40, o_totalprice / 12500) AS cand_yoe, o_orderpriority[1]::INT AS cand_seniority_tier,
            (o_orderstatus <> 'F')::INT AS cand_currently_employed, (l_discount >= 0.08)::INT AS company_brand_tier
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    ), long AS (
        UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM offers) ON COLUMNS(*) INTO NAME feature VALUE v
    )
"""


def _country(text: str, needles: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN contains(lower({text}), '{needle}') THEN '{code}'" for needle, code in needles)
    return f"CASE {whens} ELSE '{V.OTHER_COUNTRY}' END"


_FIT = "CASE WHEN l.toxic = 1 THEN 'No Fit' WHEN l.quality = 1 THEN 'Good Fit' ELSE 'Potential Fit' END"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"

ORACLES = {
    "tokenised_lengths": rf"""
        SELECT doc_id AS resume_id, len(toks)::INT AS n_tokens, len(list_distinct(toks))::INT AS n_distinct
        FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{V.TOKEN_PATTERN}'), lambda t: lower(t)) AS toks FROM documents)
    """,
    "text_previews": r"""
        WITH flat AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS flat FROM documents),
        words AS (SELECT *, string_split(flat, ' ') AS words FROM flat)
        SELECT doc_id AS resume_id, CASE WHEN length(flat) <= 140 THEN flat ELSE rtrim(flat[:140]) || '…' END AS preview,
            array_to_string(words[:20], ' ') || CASE WHEN len(words) > 20 THEN ' …' ELSE '' END AS opening
        FROM words
    """,
    "nation_countries": f"SELECT n_name, {_country('n_name', V.COUNTRY_NEEDLES_AUDIT)} AS country FROM nation",
    "content_duplicates": r"""
        SELECT id, min(doc_id) AS first_seen, count(*) AS copies
        FROM (SELECT doc_id, 'hfr-' || left(sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')), 10) AS id FROM documents) GROUP BY id
    """,
    "qrels_from_json": f"""
        SELECT concat_ws(' ', source, lang) AS query_id, doc_id::VARCHAR AS doc_id, length({_FIT})::DOUBLE AS grade
        FROM labels l JOIN documents d USING (doc_id)
    """,
    "class_balance": f"""
        WITH {_SCORED}, n AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM scored)
        SELECT n_pos, n_neg, round(n_neg / greatest(1, n_pos), 6) AS pos_weight FROM n
    """,
    "confusion_matrix": f"""
        WITH {_SCORED}, n AS (
            SELECT count(*) FILTER (p >= 0.4 AND label = 1) AS tp, count(*) FILTER (p >= 0.4 AND label <> 1) AS fp,
                count(*) FILTER (p < 0.4 AND label <> 1) AS tn, count(*) FILTER (p < 0.4 AND label = 1) AS fn FROM scored
        )
        SELECT 0.4::DOUBLE AS threshold, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
            round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1
        FROM n
    """,
    "threshold_sweep": f"""
        WITH {_SCORED}, {_GRID}
        SELECT round(threshold, 6) AS threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp,
            count(*) FILTER (p < threshold AND label = 1) AS fn, count(*) FILTER (p < threshold AND label = 0) AS tn
        FROM scored, grid GROUP BY threshold
    """,
    "classifier_report": f"""
        WITH {_SCORED}, {_GRID},
        steps AS (SELECT lang, p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY lang, p),
        summed AS (
            SELECT *, sum(neg) OVER w - neg AS neg_below, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp,
                sum(pos) OVER g AS n_pos, sum(neg) OVER g AS n_neg
            FROM steps WINDOW w AS (PARTITION BY lang ORDER BY p), v AS (PARTITION BY lang ORDER BY p DESC), g AS (PARTITION BY lang)
        ), areas AS (
            SELECT lang, sum(pos * (neg_below + neg / 2)) / nullif(max(n_pos) * max(n_neg), 0) AS roc_auc,
                sum(pos * tp / (tp + fp)) / nullif(max(n_pos), 0) AS pr_auc
            FROM summed GROUP BY lang
        ), sweep AS (
            SELECT lang, threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp,
                count(*) FILTER (p < threshold AND label = 1) AS fn
            FROM scored, grid GROUP BY lang, threshold
        ), best AS (
            SELECT lang, {_F1} AS f1, threshold, row_number() OVER (PARTITION BY lang ORDER BY {_F1} DESC, threshold) AS place FROM sweep
        ), half AS (
            SELECT lang, count(*) AS n, avg((p - label) * (p - label)) AS brier, count(*) FILTER (p >= 0.5 AND label = 1) AS tp,
                count(*) FILTER (p >= 0.5 AND label <> 1) AS fp, count(*) FILTER (p < 0.5 AND label = 1) AS fn
            FROM scored GROUP BY lang
        )
        SELECT lang, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round({_F1}, 6) AS f1_at_0_5, round(f1, 6) AS f1_optimal,
            round(CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END, 6) AS threshold_optimal, round(brier, 6) AS brier, n
        FROM areas JOIN half USING (lang) JOIN (SELECT * FROM best WHERE place = 1) USING (lang)
    """,
    "group_audit": f"""
        {_GROUPS} SELECT "group", n, round(base_rate, 6) AS base_rate, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr
        FROM audit
    """,
    "group_audit_summary": f"""
        {_GROUPS}, summary AS (
            SELECT count(*) AS n_groups, coalesce(max(selection_rate) - min(selection_rate), 0) AS parity, coalesce(max(tpr) - min(tpr), 0) AS opportunity,
                CASE WHEN count(*) = 0 THEN 1 WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) ELSE 0 END AS impact
            FROM audit
        )
        SELECT n_groups, round(parity, 6) AS demographic_parity_diff, round(opportunity, 6) AS equal_opportunity_diff,
            round(impact, 6) AS disparate_impact_ratio, impact >= 0.8 AS passes_4_5_rule
        FROM summary
    """,
    "audit_row_counts": f"""
        WITH {_SCORED} SELECT count(*) FILTER (lang IN ('en', 'fr', 'de')) AS n_audited,
            count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de'), false)) AS n_skipped FROM scored
    """,
    "gender_distribution": f"""
        WITH {_SCORED} SELECT nullif(lang, 'es') AS "group", count(*) AS n, round(avg(label::DOUBLE), 6) AS positive_rate FROM scored GROUP BY 1
    """,
    "value_quantiles": """
        SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
        FROM events GROUP BY event_type
    """,
    "field_states": f"WITH {_STATES} SELECT session_id, field, status FROM states",
    "session_features": f"""
        WITH {_STATES}, filled AS (
            SELECT session_id, count(*) FILTER (status = 'filled') AS done, count(*) FILTER (status = 'skipped') AS skipped FROM states GROUP BY session_id
        ), whole AS (
            SELECT session_id, max(ts) AS last, min(ts) FILTER (action IN ('fill', 'skip')) AS started, count(*) FILTER (action = 'back') AS back FROM form GROUP BY session_id
        ), devices AS (
            SELECT session_id, is_mobile, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS place FROM form WHERE action = 'device'
        )
        SELECT session_id, coalesce(floor(epoch(last)) - floor(epoch(started)), 0)::INT AS session_time_on_page_secs,
            hour(last)::INT AS session_hour_of_day, isodow(last) >= 6 AS session_is_weekend, coalesce(is_mobile, false) AS session_device_mobile,
            coalesce(done, 0)::INT AS session_n_fields_completed, coalesce(skipped, 0)::INT AS session_n_fields_skipped,
            round(coalesce(done, 0) / 8, 6) AS completion_rate, back::INT AS session_navigation_back_count
        FROM whole LEFT JOIN filled USING (session_id) LEFT JOIN (SELECT * FROM devices WHERE place = 1) USING (session_id)
    """,
    "abandonment_labels": f"""
        WITH {_FORM_EVENTS}, starts AS (
            SELECT session_id, min(ts) AS started_at FROM form WHERE action IN ('fill', 'skip') GROUP BY session_id
        ), sent AS (
            SELECT session_id, min(ts) AS submitted_at FROM form JOIN starts USING (session_id)
            WHERE action = 'submit' AND ts >= started_at AND ts <= started_at + INTERVAL 7 DAY GROUP BY session_id
        )
        SELECT session_id, (submitted_at IS NULL)::INT AS label, floor(epoch(started_at))::BIGINT AS started, floor(epoch(submitted_at))::BIGINT AS submitted
        FROM starts LEFT JOIN sent USING (session_id)
    """,
    "document_rank": f"""
        WITH {_CENTROIDS}, oldest AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
        placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM closeness)
        SELECT label AS query_id, vec_id AS doc_id, rank, score FROM placed SEMI JOIN oldest USING (label, vec_id)
    """,
    "offer_summary": f"""
        WITH {_OFFERS} SELECT feature, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM long GROUP BY feature
    """,
    "structured_filter": """
        WITH spent AS (
            SELECT l_suppkey AS query_id, o_custkey AS doc_id, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24, 4))), 2)::DOUBLE AS score
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
        ), pool AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM spent QUALIFY rank <= 50
        ), sides AS (
            SELECT pool.*, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 500) END AS years, CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal / 1000) END AS wanted,
                lower(cn.n_name) AS here, CASE WHEN s_suppkey % 3 = 0 THEN lower(sn.n_name) ELSE '' END AS there, lower(c_mktsegment) AS held,
                CASE WHEN s_suppkey % 2 = 0 THEN ['building', 'machinery', 'furniture'][s_suppkey % 3 + 1] END AS needed
            FROM pool JOIN customer ON doc_id = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
                JOIN supplier ON query_id = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
        )
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM sides
        WHERE coalesce(years >= wanted, true) AND (contains(here, there) OR contains(there, here)) AND (needed IS NULL OR needed = held)
    """,
}
