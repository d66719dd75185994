"""DuckDB statements for the rules, the interventions, drift, offers, lexical and dense search, and rank quality."""

from __future__ import annotations

from matchloom import schemas
from matchloom.functions import vocab as V
from matchloom.operators.channels import B, K1, NEGATIVE_IDF_SHARE
from matchloom.plans.oracles import _CENTROIDS, _OFFERS, ORACLES as _FIRST


def _d(x: float) -> str:
    """A number as a double: a bare decimal would be a fixed-point value."""
    return f"({float(x)!r}::DOUBLE)"


# ---- the drop-off rule over sessions ----------------------------------------------------------

_RULE = f"""
    sessions AS ({_FIRST['session_features']}),
    rule AS (
        SELECT session_id, session_time_on_page_secs AS secs, session_device_mobile AS mobile, session_n_fields_skipped AS skipped,
            (session_id * 7 % 11) / 10::DOUBLE AS skill_gap, (session_id * 5 % 13 - 4)::DOUBLE AS yoe_gap, session_id * 3 % 31 AS age,
            session_id % 2 = 0 AS remote, 5 + session_id % 10 AS required
        FROM sessions
    )
"""

#: The inputs of the rule over the columns of `rule`.
_TERMS = {
    "skill_gap": "skill_gap",
    "under_qualification": "greatest(0::DOUBLE, -yoe_gap)",
    "over_qualification": f"least(greatest(0::DOUBLE, yoe_gap), {_d(V.OVER_QUALIFICATION_CAP)})",
    "stale_posting": f"(age > {V.STALE_AFTER_DAYS})::INT::DOUBLE",
    "form_length": "required / 10::DOUBLE",
    "remote": "remote::INT::DOUBLE",
    "mobile": "mobile::INT::DOUBLE",
    "time_on_page": "secs / 600::DOUBLE",
    "skipped_share": "skipped::DOUBLE / greatest(1, required)",
}


def _logit(intercept: float = V.DROPOFF_INTERCEPT) -> str:
    return " + ".join([_d(intercept), *[f"{_d(V.DROPOFF_WEIGHTS[n])} * {term}" for n, term in _TERMS.items()]])


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


def _band(p: str) -> str:
    return f"CASE WHEN {p} < {_d(0.30)} THEN 'low' WHEN {p} < {_d(0.60)} THEN 'moderate' ELSE 'high' END"


_Q = f"least(greatest(p, {_d(1e-9)}), {_d(1.0 - 1e-9)})"


def _attributions(wide: str, key: str, terms: dict[str, str], weights: dict[str, float], intercept: float) -> str:
    """CTEs up to cells (key, base, place by size, feature, value, fv): weight times distance from the mean."""
    base = " + ".join([_d(intercept), *[f"{_d(weights[n])} * m_{n}" for n in terms]])
    cells = ", ".join(
        f"{{'i': {i}, 'feature': '{n}', 'value': {_d(weights[n])} * (t_{n} - m_{n}), 'fv': t_{n}}}" for i, n in enumerate(terms))
    return f"""
        wide AS (SELECT {key}, {', '.join(f'({term})::DOUBLE AS t_{n}' for n, term in terms.items())} FROM {wide}),
        means AS (SELECT {', '.join(f'avg(t_{n}) AS m_{n}' for n in terms)} FROM wide),
        opened AS (SELECT {key}, {base} AS base, unnest([{cells}]) AS c FROM wide, means),
        cells AS (
            SELECT {key}, base, c.feature AS feature, c.value AS value, c.fv AS fv,
                row_number() OVER (PARTITION BY {key} ORDER BY abs(c.value) DESC, c.i) AS place
            FROM opened
        )
    """


_RULE_CELLS = f"{_RULE}, {_attributions('rule', 'session_id', _TERMS, V.DROPOFF_WEIGHTS, V.DROPOFF_INTERCEPT)}"

# ---- interventions: a change has a number, -1 is none -------------------------------------------

#: The catalogue in its order, which settles equal uplifts.
_CHANGES = ["prefill_work_history", "shorten_form", "save_and_resume", "mobile_optimize", "field_auto_save", "reveal_salary_early"]
_CHANGED = """
    greatest(0, skipped - CASE o WHEN 0 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END) AS skipped,
    CASE o WHEN 1 THEN greatest(4, required - 3) ELSE required END AS required,
    CASE o WHEN 2 THEN greatest(60, secs) ELSE secs END AS secs, CASE o WHEN 3 THEN false ELSE mobile END AS mobile,
    skill_gap, yoe_gap, age, remote
"""
_NAME = f"({_CHANGES!r})[o + 1]"


def _greedy(rounds: int) -> str:
    steps = [f"state0 AS (SELECT *, {_sigmoid(_logit())} AS p, {_sigmoid(_logit())} AS baseline, []::VARCHAR[] AS applied FROM rule)"]
    for k in range(1, rounds + 1):
        steps.append(f"""
            tried{k} AS (
                SELECT session_id, o, baseline, applied, {_CHANGED} FROM state{k - 1}, range(-1, 6) AS r(o)
                WHERE o = -1 OR (p > {_d(0.30)} AND NOT list_contains(applied, {_NAME}))
            ), scored{k} AS (SELECT *, {_sigmoid(_logit())} AS p FROM tried{k}),
            placed{k} AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY p, o) AS place FROM scored{k}),
            state{k} AS (
                SELECT * EXCLUDE (o, place, applied), CASE WHEN o = -1 THEN applied ELSE list_append(applied, {_NAME}) END AS applied
                FROM placed{k} WHERE place = 1
            )""")
    return ", ".join(steps)


# ---- monitoring ----------------------------------------------------------------------------------

_MONITORED = ", ".join(
    f"{{'feature': '{f}', 'value': {'completion_rate' if f == 'session_field_completion_rate' else f}::DOUBLE}}" for f in schemas.MONITORED_FEATURES)
_STATS = f"""
    sessions AS ({_FIRST['session_features']}),
    opened AS (SELECT session_id, unnest([{_MONITORED}]) AS c FROM sessions),
    cells AS (SELECT session_id, c.feature AS feature, c.value AS value FROM opened),
    stats AS (
        SELECT feature, avg(value) AS mean, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS std,
            quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95
        FROM cells GROUP BY feature
    )
"""

# ---- offers --------------------------------------------------------------------------------------

_KEYED = _OFFERS.split(", long AS")[0].replace("SELECT ", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ", 1)


def _decline_term(name: str) -> str:
    _, centre, scale, floor = V.DECLINE_TERMS[name]
    moved = f"({name}::DOUBLE - {_d(centre)})"
    return f"{moved if floor is None else f'greatest({_d(floor)}, {moved})'} / {_d(scale)}"


_DECLINE_TERMS = {n: _decline_term(n) for n in V.DECLINE_TERMS}
_DECLINE = " + ".join([_d(-2.0), *[f"{_d(V.DECLINE_TERMS[n][0])} * {term}" for n, term in _DECLINE_TERMS.items()]])
_BOUNDS = " UNION ALL ".join(
    f"SELECT '{c}' AS rule, count(*) FILTER ({c} IS NULL OR {c} < {_d(lo)} OR {c} > {_d(hi)}) AS n_violations FROM offers"
    for c, (lo, hi) in schemas.OFFER_BOUNDS.items() if c != schemas.OFFER_LABEL)

# ---- search -----------------------------------------------------------------------------------------

_TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{V.TOKEN_PATTERN}'), lambda t: lower(t))"


def _bm25(k: int) -> str:
    share = f"tf * {_d(K1 + 1)} / (tf + {_d(K1)} * ({_d(1 - B)} + {_d(B)} * size / mean_size))"
    return f"""
        texts AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
        corpus AS (SELECT count(*) AS n_docs, avg(len(toks)) AS mean_size FROM texts),
        counts AS (SELECT doc_id, tok, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(toks) AS size, unnest(toks) AS tok FROM texts) GROUP BY doc_id, tok),
        raw AS (SELECT tok, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT tok, count(*) AS df FROM counts GROUP BY tok), corpus),
        idf AS (SELECT tok, CASE WHEN raw < 0 THEN {_d(NEGATIVE_IDF_SHARE)} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
        asked AS (SELECT query_id, tok, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS tok FROM benchmark) GROUP BY query_id, tok),
        found AS (
            SELECT query_id, doc_id, sum(n * idf * {share}) AS score FROM asked JOIN idf USING (tok) JOIN counts USING (tok), corpus GROUP BY query_id, doc_id
        ),
        every AS (
            SELECT item_id AS query_id, d.doc_id, round(coalesce(score, 0), 9) AS score
            FROM benchmark CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN found f ON f.query_id = item_id AND f.doc_id = d.doc_id
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every),
        hits AS (SELECT * FROM ranked WHERE rank <= {k})
    """


_POSTINGS = f"""
    {_RULE_CELLS}, {_bm25(20)},
    risks AS (SELECT session_id, {_sigmoid('any_value(base) + sum(value)')} AS p FROM cells GROUP BY session_id),
    paired AS (SELECT query_id, doc_id, rank, (doc_id * 31 + query_id) % (SELECT max(user_id) + 1 FROM events) AS session_id FROM hits)
"""

RULE_ORACLES = {
    "dropoff_risk": f"""
        WITH {_RULE}, scored AS (SELECT session_id, {_sigmoid(_logit())} AS p FROM rule),
        sure AS (SELECT *, 1 - (-{_Q} * ln({_Q}) - (1 - {_Q}) * ln(1 - {_Q})) / ln(2::DOUBLE) AS conf FROM scored),
        banded AS (
            SELECT *, CASE WHEN round(conf, 9) >= {_d(0.12)} THEN 'confident' WHEN round(conf, 9) >= {_d(0.03)} THEN 'uncertain' ELSE 'abstain' END AS band FROM sure
        )
        SELECT session_id, round(p, 6) AS p, {_band('p')} AS risk_band, round(conf, 6) AS confidence, band AS abstention_band,
            p >= 0.5 AND band <> 'abstain' AS reach_out
        FROM banded
    """,
    "model_comparison": f"""
        WITH {_RULE}, both_models AS (SELECT session_id, {_sigmoid(_logit())} AS p, {_sigmoid(_logit(V.DROPOFF_INTERCEPT - 1.0))} AS q FROM rule)
        SELECT session_id, round(p, 6) AS p, round(q, 6) AS p_secondary, round(p - q, 6) AS delta FROM both_models
    """,
    "extreme_samples": f"""
        WITH {_RULE}, scored AS (SELECT session_id, round({_sigmoid(_logit())}, 9) AS p FROM rule)
        SELECT (SELECT session_id FROM scored ORDER BY p DESC, session_id LIMIT 1) AS riskiest,
            (SELECT session_id FROM scored ORDER BY p, session_id LIMIT 1) AS safest,
            (SELECT session_id FROM scored ORDER BY round(abs(p - 0.5), 9), session_id LIMIT 1) AS ambiguous
    """,
    "rule_attributions": f"""
        WITH {_RULE_CELLS}
        SELECT session_id, round(base, 6) AS base_logit, feature, round(value, 6) AS value, round(fv, 6) AS feature_value FROM cells
    """,
    "rule_importance": f"WITH {_RULE_CELLS} SELECT feature, round(avg(abs(value)), 6) AS mean_abs_shap FROM cells GROUP BY feature",
    "rule_waterfall": f"""
        WITH {_RULE_CELLS}
        SELECT session_id, count(*) FILTER (place <= 5) + 1 AS steps, round(any_value(base) + sum(value), 6) AS final_logit,
            max(feature) FILTER (place = 1) AS strongest, count(*) FILTER (place > 5) || ' other features' AS first_label
        FROM cells GROUP BY session_id
    """,
    "intervention_ranking": f"""
        WITH {_RULE}, tried AS (SELECT session_id, o, {_CHANGED} FROM rule, range(-1, 6) AS r(o)),
        scored AS (SELECT session_id, o, {_sigmoid(_logit())} AS p FROM tried),
        based AS (SELECT *, max(p) FILTER (o = -1) OVER (PARTITION BY session_id) AS base FROM scored)
        SELECT session_id, {_NAME} AS intervention, round(base, 6) AS baseline_prob, round(p, 6) AS counterfactual_prob, round(base - p, 6) AS uplift_absolute,
            round(CASE WHEN base > 0 THEN (base - p) / base ELSE 0 END, 6) AS uplift_relative,
            CASE WHEN (base - p) * 100 >= 15 THEN 'strongly_recommended' WHEN (base - p) * 100 >= 5 THEN 'consider'
                WHEN (base - p) * 100 >= -1 THEN 'minor_effect' ELSE 'may_worsen' END AS verdict,
            row_number() OVER (PARTITION BY session_id ORDER BY base - p DESC, o)::INT AS rank
        FROM based WHERE o >= 0
    """,
    "minimum_interventions": f"""
        WITH {_RULE}, {_greedy(3)}
        SELECT session_id, array_to_string(applied, ',') AS applied, round(baseline, 6) AS baseline_prob, round(p, 6) AS final_prob, p <= {_d(0.30)} AS reached_target
        FROM state3
    """,
    "training_statistics": f"""
        WITH {_STATS} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM stats
    """,
    "session_drift": f"""
        WITH {_STATS}, away AS (SELECT session_id, feature, abs(coalesce(value, mean) - mean) / std AS z FROM cells JOIN stats USING (feature))
        SELECT session_id, round(max(z), 6) AS max_abs_z, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (z > 2), '') AS flagged,
            CASE count(*) FILTER (z > 2) WHEN 0 THEN 'in_distribution' WHEN 1 THEN 'one_feature_drifting' ELSE 'multiple_features_drifting' END AS verdict
        FROM away GROUP BY session_id
    """,
    "offer_drivers": f"""
        WITH {_KEYED}, named AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key FROM offers),
        {_attributions('named', 'key', _DECLINE_TERMS, {n: v[0] for n, v in V.DECLINE_TERMS.items()}, -2.0)}
        SELECT feature, round(avg(abs(value)), 6) AS mean_abs_shap FROM cells GROUP BY feature
    """,
    "offer_bounds": f"WITH {_KEYED} {_BOUNDS}",
    "bm25_topk": f"WITH {_bm25(10)} SELECT query_id, doc_id, score, rank::INT AS rank FROM hits",
    "posting_health": f"""
        WITH {_POSTINGS}, health AS (
            SELECT query_id, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.5) AS median, avg((p >= {_d(0.60)})::INT) AS high, avg((p < {_d(0.30)})::INT) AS low,
                greatest(0, least(1, 1 - avg(p))) AS score
            FROM paired JOIN risks USING (session_id) GROUP BY query_id
        )
        SELECT query_id, n AS n_candidates, round(mean, 6) AS mean_dropoff_prob, round(median, 6) AS median_dropoff_prob, round(high, 6) AS pct_high_risk,
            round(low, 6) AS pct_low_risk, round(score, 6) AS health_score,
            CASE WHEN score >= {_d(0.65)} THEN 'healthy' WHEN score >= {_d(0.45)} THEN 'moderate' ELSE 'concerning' END AS health_band
        FROM health
    """,
    "posting_drivers": f"""
        WITH {_POSTINGS}, three AS (SELECT query_id, rank, feature, value, place FROM paired JOIN cells USING (session_id) WHERE place <= 3),
        counted AS (
            SELECT query_id, feature, count(*) AS n, avg(value) AS mean, count(*) FILTER (value > 0) AS ups, min(rank * 10 + place) AS first_seen
            FROM three GROUP BY query_id, feature
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_seen) AS driver_rank FROM counted)
        SELECT query_id, driver_rank::INT AS driver_rank, feature, n AS times_in_top_3, round(mean, 6) AS mean_shap,
            CASE WHEN ups >= n - ups THEN '↑ drop-off' ELSE '↓ drop-off' END AS direction
        FROM placed WHERE driver_rank <= 5
    """,
}

#: Not in the gate: offers have few decimals, so that some sums of terms are halves of the sixth decimal, which the last bit
#: of a sum decides. Tests compare them within a unit of that decimal.
CLOSE = {
    "offer_decline": f"""
        WITH {_KEYED}, scored AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_DECLINE} AS logit FROM offers)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(logit, 6) AS logit, round({_sigmoid('logit')}, 6) AS p,
            {_band(f"round({_sigmoid('logit')}, 9)")} AS band
        FROM scored
    """,
}
