"""DuckDB statements for vocabularies, proxies, corpus loading, vector search and rank quality."""

from __future__ import annotations

from matchloom.functions import vocab as V
from matchloom.plans.oracles import _CENTROIDS, _FIT, _country
from matchloom.plans.reading import _OTHER_WORDS
from matchloom.plans.retrieval import KS
from matchloom.plans.rule_oracles import _bm25, _d


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _found(text: str, words: list[str]) -> str:
    return f"list_filter({words!r}, lambda s: contains(lower(coalesce({text}, '')), s))"


# ---- proxies: a name is a whole word, whatever letters its neighbours have -----------------------

_NAMES = V.MALE_NAMES + V.FEMALE_NAMES
_PROXIES = rf"""
    named AS (
        SELECT doc_id, text, list_filter(
            list_transform(
                list_filter(regexp_extract_all(coalesce(text, '')[:{V.NAME_WINDOW}], '[\pL\pN\pM_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}')),
                lambda w: lower(w)),
            lambda w: list_contains({_NAMES!r}, w))[1] AS name
        FROM documents
    ), proxies AS (
        SELECT doc_id AS resume_id, CASE WHEN list_contains({V.MALE_NAMES!r}, name) THEN 'm' WHEN name IS NOT NULL THEN 'f' ELSE 'unknown' END AS gender,
            {_country('text', V.COUNTRY_NEEDLES_AUDIT)} AS country, {_country('text', V.COUNTRY_NEEDLES_TRAINING)} AS country_training,
            {_country('text', V.COUNTRY_NEEDLES_SERVING)} AS country_serving
        FROM named
    )
"""

_LETTER = r"\pL\pN\pM_"
_ROLES = rf"(?:(?:^|[^{_LETTER}])at|[{_LETTER}]@)\s+[A-Z][A-Za-z0-9&\-\.]+"

# ---- corpora ----------------------------------------------------------------------------------------

_GRADE = "CASE fit " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in V.FIT_GRADES.items()) + " END"
_USABLE = f"""
    pairs AS (
        SELECT doc_id AS row_no, {_strip('text')} AS resume_text, {_strip("concat_ws(' ', source, lang)")} AS job_text, {_FIT} AS fit
        FROM labels l JOIN documents d USING (doc_id)
    ), usable AS (
        SELECT *, {_GRADE} AS grade, 'hfr-' || left(sha1(resume_text), 10) AS resume_id, 'hfj-' || left(sha1(job_text), 10) AS job_id
        FROM pairs WHERE resume_text <> '' AND job_text <> '' AND {_GRADE} IS NOT NULL
    ), qrels AS (SELECT job_id AS query_id, resume_id AS doc_id, arg_max(grade, row_no) AS grade FROM usable GROUP BY ALL)
"""
_LEVELS = ["Internship", "Associate", "Mid-Senior level", "Director", "Executive", "Unlisted"]
_YEARS = ("CASE (" + repr(_LEVELS) + ")[doc_id % 6 + 1] " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in V.LEVEL_MIN_YOE.items())
          + f" ELSE {_d(V.DEFAULT_MIN_YOE)} END")
_LONG = f"long AS (SELECT *, {_strip('text')} AS body FROM documents WHERE length({_strip('text')}) > 50)"

# ---- vectors ------------------------------------------------------------------------------------------

_VECTORS = f"""
    {_CENTROIDS}, prototypes AS (
        SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM closeness) WHERE place = 1
    ), near AS (
        SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(sum(a.x * b.x), 9) AS score
        FROM cells a SEMI JOIN prototypes p ON a.vec_id = p.vec_id JOIN cells b USING (slot) GROUP BY a.vec_id, b.vec_id
    ), others AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near WHERE query_id <> doc_id
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near)
"""
_GAIN = "(pow(2, grade) - 1) / log2({place} + 1)"
_PER_K = " UNION ALL ".join(
    f"""
    SELECT query_id, {k} AS k, (count(*) FILTER (rank <= {k})) / {_d(k)} AS "precision",
        (count(*) FILTER (rank <= {k}))::DOUBLE / n_relevant AS recall,
        coalesce(sum({_GAIN.format(place='rank')}) FILTER (rank <= {k}), 0) / ideal_{k} AS ndcg, coalesce(1::DOUBLE / min(rank), 0) AS rr
    FROM relevant LEFT JOIN hits USING (query_id) GROUP BY query_id, n_relevant, ideal_{k}
    """ for k in KS)

TEXT_ORACLES = {
    "token_frequencies": f"""
        WITH {_bm25(1)}, sizes AS (SELECT tok, count(*) AS df FROM counts GROUP BY tok)
        SELECT tok, df, round(idf, 6) AS idf FROM sizes JOIN idf USING (tok)
    """,
    "skills_found": f"SELECT doc_id AS resume_id, array_to_string(list_sort({_found('text', V.SKILLS)}), ',') AS skills FROM documents",
    "skills_custom_vocabulary": f"""
        SELECT skill, count(*) AS n FROM (SELECT unnest({_found('text', _OTHER_WORDS)}) AS skill FROM documents) GROUP BY skill
    """,
    "postings_by_skills": f"SELECT item_id AS job_id, len({_found('text', V.SKILLS)})::INT AS n_skills FROM benchmark",
    "role_count_spread": f"""
        WITH counted AS (SELECT least({V.MAX_ROLE_MENTIONS}, len(regexp_extract_all(coalesce(text, ''), '{_ROLES}', 0, 'i')))::INT AS roles FROM documents),
        placed AS (SELECT roles, row_number() OVER (ORDER BY roles) - 1 AS place, count(*) OVER () AS n FROM counted)
        SELECT min(roles) AS low, max(roles) FILTER (place = n // 2) AS middle, max(roles) AS high FROM placed
    """,
    "audit_proxies": f"WITH {_PROXIES} SELECT * FROM proxies",
    "proxy_coverage": f"""
        WITH {_PROXIES}, counted AS (
            SELECT 'gender' AS proxy, count(*) FILTER (gender <> 'unknown') AS inferred, count(*) AS total FROM proxies
            UNION ALL SELECT 'country', count(*) FILTER (country <> 'other'), count(*) FROM proxies
        )
        SELECT proxy, inferred, total, round(100::DOUBLE * inferred / greatest(total, 1), 6) AS pct FROM counted
    """,
    "fit_corpus_qrels": f"WITH {_USABLE} SELECT query_id, doc_id, grade FROM qrels",
    "fit_corpus_sides": f"""
        WITH {_USABLE}
        SELECT 'resume' AS side, resume_id AS id, any_value(length(resume_text))::INT AS n_chars, '' AS title FROM usable GROUP BY resume_id
        UNION ALL
        SELECT 'job', job_id, any_value(length(job_text))::INT, 'HF-Fit Query ' || right(job_id, 6) FROM usable GROUP BY job_id
    """,
    "evaluable_queries": f"""
        WITH {_USABLE} SELECT query_id, count(*) AS n_labels, count(*) FILTER (grade > 0) AS n_relevant
        FROM qrels GROUP BY query_id HAVING count(*) FILTER (grade > 0) >= 2
    """,
    "category_resumes": f"""
        SELECT 'kgr-' || doc_id AS resume_id, length({_strip('text')})::INT AS n_chars, lang AS target_role FROM documents
        WHERE lang IN ('en', 'de') AND {_strip('text')} <> ''
    """,
    "union_of_corpora": f"""
        WITH {_USABLE}
        SELECT 0 AS source_rank, 'unlabelled' AS target_role, count(DISTINCT resume_id) AS n FROM usable
        UNION ALL
        SELECT 1, coalesce(lang, 'unlabelled'), count(*) FROM documents WHERE {_strip('text')} <> '' GROUP BY 2
    """,
    "postings_loaded": rf"""
        WITH {_LONG}
        SELECT 'lij-' || doc_id AS job_id, CASE WHEN {_strip("coalesce(lang, '')")} <> '' THEN {_strip('lang')} ELSE 'Untitled' END AS title,
            nullif({_strip('source')}, '') AS company, length(body)::INT AS n_chars, {_YEARS} AS min_years_experience, NULL::VARCHAR AS location,
            array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,;\n]'), lambda s: {_strip('s')}), lambda s: s <> '' AND length(s) <= 40), '|') AS skills
        FROM long
    """,
    "postings_sampled": f"""
        WITH {_LONG} SELECT 'lij-' || doc_id AS job_id, {_YEARS} AS min_years_experience FROM long ORDER BY md5('42|' || doc_id), doc_id LIMIT 300
    """,
    "dense_topk": f"""
        WITH {_CENTROIDS}, near AS (
            SELECT c.label AS query_id, vec_id AS doc_id, round(sum(x * c), 9) AS score FROM cells JOIN centroids c USING (slot) GROUP BY c.label, vec_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM near)
        SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10
    """,
    "similar_candidates": f"""
        WITH {_VECTORS} SELECT query_id, doc_id, score, rank::INT AS rank,
            CASE WHEN score >= {_d(0.75)} THEN 'strong' WHEN score >= {_d(0.55)} THEN 'moderate' ELSE 'weak' END AS band
        FROM others WHERE rank <= 10
    """,
    "label_adjacency": f"""
        WITH {_VECTORS} SELECT query_id, doc_id AS best, round(score, 6) AS similarity,
            CASE WHEN score >= {_d(0.85)} THEN 'matched' WHEN score >= {_d(0.55)} THEN 'adjacent' ELSE 'missing' END AS category
        FROM others WHERE rank = 1
    """,
    "ranking_quality": f"""
        WITH {_VECTORS}, items AS (SELECT vec_id, label, lang FROM embeddings LEFT JOIN (SELECT doc_id, lang FROM documents) ON vec_id = doc_id),
        qrels AS (
            SELECT own.vec_id AS query_id, i.vec_id AS doc_id, CASE WHEN i.lang = own.lang THEN 2 ELSE 1 END AS grade,
                row_number() OVER (PARTITION BY own.vec_id ORDER BY CASE WHEN i.lang = own.lang THEN 2 ELSE 1 END DESC) AS place
            FROM items i JOIN (SELECT items.* FROM items SEMI JOIN prototypes USING (vec_id)) own USING (label)
        ),
        relevant AS (
            SELECT query_id, count(*) AS n_relevant, {', '.join(f"sum({_GAIN.format(place='place')}) FILTER (place <= {k}) AS ideal_{k}" for k in KS)}
            FROM qrels GROUP BY query_id
        ),
        hits AS (SELECT query_id, grade, rank FROM ranked JOIN qrels USING (query_id, doc_id) WHERE rank <= {max(KS)}),
        measured AS ({_PER_K})
        SELECT query_id, k, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr FROM measured
    """,
}
