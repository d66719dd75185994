"""Text reading, loading and explanation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import decisions as dc, phrases, text as tx, vocab as V
from matchloom.functions.trajectory import CRITERIA_COLUMNS, TRAJECTORY_COLUMNS, with_criteria, with_trajectory
from matchloom.operators import adjacency as adj, channels as ch, explanations as ex
from matchloom.operators.ordered import running_totals, value_at
from matchloom.plans import tables as t
from matchloom.plans.retrieval import _example_side, bm25_channel, label_qrels, text_channels
from matchloom.session import settle, spread
from matchloom.sources import corpora, relevance


def tokenised_lengths(spark, folder):
    docs = ch.tokenised(t.resumes(spark, folder), "resume_id", "text")
    return docs.select("resume_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"))


def token_frequencies(spark, folder):
    docs = ch.tokenised(t.resumes(spark, folder), "resume_id", "text")
    n = docs.count()
    df = ch.document_frequencies(docs)
    return df.join(ch.inverse_frequencies(df, n), "tok").select("tok", "df", F.round("idf", 6).alias("idf"))


def skills_found(spark, folder):
    return t.resumes(spark, folder).select("resume_id", F.array_join(F.array_sort(tx.skills_in(F.col("text"))), ",").alias("skills"))


_OTHER_WORDS = ["reth", "tion", "ther", "mente", "aux", "licht"]


def skills_custom_vocabulary(spark, folder):
    found = tx.skills_in(F.col("text"), _OTHER_WORDS)
    return t.resumes(spark, folder).select(F.explode(found).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


def career_trajectories(spark, folder):
    rows = with_trajectory(t.resumes(spark, folder))
    return rows.select("resume_id", *[c for c in TRAJECTORY_COLUMNS if c != "tenure_signal"],
                       F.round("tenure_signal", 6).alias("tenure_signal"), dc.trajectory_line().alias("line"))


def posting_criteria(spark, folder):
    rows = with_criteria(t.jobs(spark, folder))
    return rows.select("job_id", *CRITERIA_COLUMNS, tx.coarse_seniority(F.col("description")).alias("coarse_seniority"))


def extractor_summary(spark, folder):
    """Counts of each extracted value, and experience coverage; the years themselves are in years_spread."""
    rows = settle(with_trajectory(t.resumes(spark, folder)).select("resume_id", *TRAJECTORY_COLUMNS), "profiles")
    cells = F.array(
        F.struct(F.lit("seniority").alias("feature"), F.col("seniority").cast("string").alias("value")),
        F.struct(F.lit("domain").alias("feature"), F.col("domain").alias("value")),
        F.struct(F.lit("tier").alias("feature"), F.col("company_tier").cast("string").alias("value")),
        F.struct(F.lit("yoe_known").alias("feature"), F.col("years_experience").isNotNull().cast("string").alias("value")),
        F.struct(F.lit("has_recent").alias("feature"), (F.col("n_recent_roles") > 0).cast("string").alias("value")),
        F.struct(F.lit("recent_differs").alias("feature"),
                 ((F.col("recent_seniority") != V.UNKNOWN) & (F.col("recent_seniority") != F.col("seniority"))).cast("string").alias("value")),
    )
    return rows.select(F.inline(cells)).groupBy("feature", "value").agg(F.count("*").alias("n"))


def role_count_spread(spark, folder):
    """Minimum, upper middle and maximum of role mentions."""
    rows = t.resumes(spark, folder).select(tx.role_mentions(F.col("text")).alias("roles"))
    ranked = running_totals(rows, "roles", {"n": F.count("*")})
    return ranked.agg(
        F.min("roles").alias("low"), value_at(ranked, "roles", F.floor(F.col("n_all") / 2)).alias("middle"), F.max("roles").alias("high")
    )


def years_spread(spark, folder):
    """Candidates with known years, and the least, upper middle and greatest of them."""
    rows = with_trajectory(t.resumes(spark, folder)).select("years_experience")
    ranked = running_totals(rows, "years_experience", {"n": F.count("*")})
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("years_experience").alias("low"),
        value_at(ranked, "years_experience", F.floor(F.col("n_all") / 2)).alias("middle"), F.max("years_experience").alias("high"))


def high_careers(spark, folder):
    """Candidates of eight years and more with a well-known employer."""
    rows = with_trajectory(t.resumes(spark, folder))
    return rows.filter("years_experience >= 8 and company_tier = 1").select("resume_id", "years_experience", "seniority", "domain")


def postings_by_skills(spark, folder):
    """Postings by how many skills they name, the richest first; equal ones by id."""
    rows = t.jobs(spark, folder).select("job_id", F.size(tx.skills_in(F.col("description"))).alias("n_skills"))
    return rows.orderBy(F.desc("n_skills"), "job_id")


def case_study_posting(spark, folder):
    """The first posting by id that asks for a senior and has five labels or more; without one, the first of all."""
    _, _, chosen, asks = _example_side(spark, folder)
    jobs = with_criteria(asks).select("job_id", "target_seniority")
    counts = label_qrels(spark, folder, chosen).groupBy("query_id").agg(F.count("*").alias("n_labels"))
    rows = jobs.join(counts, jobs["job_id"] == counts["query_id"], "left").select("job_id", "target_seniority", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))
    fits = (F.col("target_seniority") >= V.SENIOR) & (F.col("n_labels") >= 5)
    best = F.min(F.struct((~fits).alias("other"), F.col("job_id").alias("job_id"), F.col("target_seniority").alias("target_seniority"), F.col("n_labels").alias("n_labels")))
    return rows.agg(best.alias("b")).filter("b is not null").select("b.job_id", "b.target_seniority", "b.n_labels", (~F.col("b.other")).alias("eligible"))


def audit_proxies(spark, folder):
    body = F.col("text")
    return t.resumes(spark, folder).select(
        "resume_id", tx.gender_proxy(body).alias("gender"), tx.country(body, V.COUNTRY_NEEDLES_AUDIT).alias("country"),
        tx.country(body, V.COUNTRY_NEEDLES_TRAINING).alias("country_training"),
        tx.country(body, V.COUNTRY_NEEDLES_SERVING).alias("country_serving"),
    )


def nation_countries(spark, folder):
    return t.table(spark, folder, "nation").select("n_name", tx.country(F.col("n_name"), V.COUNTRY_NEEDLES_AUDIT).alias("country"))


def text_previews(spark, folder):
    return t.resumes(spark, folder).select(
        "resume_id", tx.preview(F.col("text")).alias("preview"), tx.first_words(F.col("text"), 20).alias("opening")
    )


# ---- loading --------------------------------------------------------------------------------


def labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as (candidate, posting, fit) triples; the posting is its source and language."""
    rows = t.table(spark, folder, "labels").join(t.table(spark, folder, "documents"), "doc_id")
    fit = F.when(F.col("toxic") == 1, "No Fit").when(F.col("quality") == 1, "Good Fit").otherwise("Potential Fit")
    return rows.select(
        F.col("doc_id").alias("row_no"), F.col("text").alias("resume_text"),
        F.concat_ws(" ", "source", "lang").alias("job_description_text"), fit.alias("label"),
    )


def fit_corpus_qrels(spark, folder):
    _, _, qrels = corpora.fit_corpus(labelled_pairs(spark, folder))
    return qrels


def fit_corpus_sides(spark, folder):
    resumes, jobs, _ = corpora.fit_corpus(labelled_pairs(spark, folder))
    a = resumes.select(F.lit("resume").alias("side"), F.col("resume_id").alias("id"), F.length("text").alias("n_chars"), F.lit("").alias("title"))
    b = jobs.select(F.lit("job").alias("side"), F.col("job_id").alias("id"), F.length("description").alias("n_chars"), "title")
    return a.unionByName(b)


def evaluable_queries(spark, folder):
    resumes, jobs, qrels = corpora.fit_corpus(labelled_pairs(spark, folder))
    kept = relevance.evaluable(relevance.known_only(qrels, jobs, resumes), 2)
    return kept.groupBy("query_id").agg(F.count("*").alias("n_labels"), F.count_if(F.col("grade") > 0).alias("n_relevant"))


def qrels_from_json(spark, folder):
    """Judgements written as one JSON object each, {posting: {candidate: grade}}, and read back: no line grows with its posting."""
    pairs = labelled_pairs(spark, folder)
    grade = F.create_map(F.col("row_no").cast("string"), F.length("label").cast("double"))
    return relevance.parse_qrels(pairs.select(F.to_json(F.create_map("job_description_text", grade)).alias("value")))


def content_duplicates(spark, folder):
    docs = spread(t.table(spark, folder, "documents"), "doc_id").select("doc_id", tx.content_id("hfr", tx.strip(F.col("text"))).alias("id"))
    return docs.groupBy("id").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("copies"))


def category_resumes(spark, folder):
    raw = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), F.lit(None).cast("string").alias("Resume_html"), F.col("lang").alias("Category"),
    )
    return corpora.category_resumes(raw, ["en", "de"]).select("resume_id", F.length("text").alias("n_chars"), "target_role")


def _raw_postings(spark, folder):
    level = F.element_at(F.array(*[F.lit(x) for x in ["Internship", "Associate", "Mid-Senior level", "Director", "Executive", "Unlisted"]]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("company_name"), F.col("lang").alias("title"),
        F.col("text").alias("description"), F.lit("").alias("location"), level.alias("formatted_experience_level"),
        F.col("text").alias("skills_desc"),
    )


def postings_loaded(spark, folder):
    rows = corpora.postings(_raw_postings(spark, folder), sample_size=None)
    return rows.select("job_id", "title", "company", F.length("description").alias("n_chars"), "min_years_experience",
                       "location", F.array_join("required_skills", "|").alias("skills"))


def postings_sampled(spark, folder):
    rows = corpora.postings(_raw_postings(spark, folder), sample_size=300)
    return rows.select("job_id", "min_years_experience")


def union_of_corpora(spark, folder):
    resumes, _, _ = corpora.fit_corpus(labelled_pairs(spark, folder))
    raw = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), F.col("lang").alias("Category"))
    both = corpora.corpus_union(resumes, corpora.category_resumes(raw))
    return both.groupBy("source_rank", F.coalesce("target_role", F.lit("unlabelled")).alias("target_role")).agg(F.count("*").alias("n"))


# ---- explanations ----------------------------------------------------------------------------


def _pool_evidence(spark, folder) -> DataFrame:
    """The BM25 top ten of every posting with the skills of both sides and a stand-in probability."""
    hits = bm25_channel(t.resumes(spark, folder), t.jobs(spark, folder), 10)
    cand = t.resumes(spark, folder).join(hits.select(F.col("doc_id").alias("resume_id")).distinct(), "resume_id", "left_semi")
    cand = cand.select(F.col("resume_id").alias("doc_id"), tx.skills_in(F.col("text"), _OTHER_WORDS + V.SKILLS).alias("cand_skills"))
    asks = t.jobs(spark, folder).select(F.col("job_id").alias("query_id"), tx.skills_in(F.col("description"), _OTHER_WORDS + V.SKILLS).alias("job_skills"))
    rows = hits.join(cand, "doc_id").join(asks, "query_id")
    p = ((F.col("doc_id") * 7 + F.col("query_id") * 13) % 100) / 100.0
    return rows.withColumn("p", p)


def skill_overlap_explanations(spark, folder):
    rows = ex.with_explanation(ex.with_skill_evidence(_pool_evidence(spark, folder)), drivers=F.lit("n/a"))
    return rows.select(
        "query_id", "doc_id", F.array_join("matched_skills", ",").alias("matched"), F.array_join("missing_skills", ",").alias("missing"),
        "skill_overlap_pct", "overall_fit", "dropoff_risk", "recommendation", "recommendation_note",
    )


def rationale_prompts(spark, folder):
    rows = ex.with_explanation(ex.with_skill_evidence(_pool_evidence(spark, folder)), drivers=F.lit("n/a"))
    texts = t.resumes(spark, folder).select(F.col("resume_id").alias("doc_id"), "text")
    asks = t.jobs(spark, folder).select(F.col("job_id").alias("query_id"), "description")
    full = rows.join(texts, "doc_id").join(asks, "query_id")
    prompt = phrases.rationale_prompt(
        F.col("description"), F.col("text"), F.col("matched_skills"), F.col("missing_skills"),
        F.col("skill_overlap_pct"), F.col("dropoff_risk"), F.col("dropoff_drivers"))
    return full.select("query_id", "doc_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("n_chars"))


def answers_parsed(spark, folder):
    """Conversation turns as raw model answers: JSON, JSON inside prose, and no JSON at all."""
    turns = spread(t.table(spark, folder, "conversations"), "conv_id")
    n = F.col("conv_id") + F.col("turn")
    risk = F.element_at(F.array(F.lit("HIGH"), F.lit("low"), F.lit("severe")), (n % 3 + 1).cast("int"))
    advice = F.element_at(F.array(F.lit(" Interview "), F.lit("hire"), F.lit("likely_mismatch"), F.lit("")), (n % 4 + 1).cast("int"))
    body = F.to_json(F.struct(risk.alias("dropoff_risk"), advice.alias("recommendation"), F.col("text").alias("overall_fit")))
    raw = F.when(F.col("role") == "user", body).when(F.col("role") == "assistant", F.concat(F.lit("Sure:\n"), body, F.lit("\nDone"))).otherwise(F.col("text"))
    rows = turns.select(
        "conv_id", "turn", raw.alias("raw"), F.lit(None).cast("string").alias("failure"), F.lit("moderate").alias("dropoff_risk"),
        F.lit("consider").alias("recommendation"), F.lit("Template.").alias("overall_fit"), F.lit("Note.").alias("recommendation_note"),
        (n % 101).cast("int").alias("skill_overlap_pct"),
    )
    return ex.with_model_explanation(rows).select("conv_id", "turn", "dropoff_risk", "recommendation", "overall_fit", "recommendation_note")


def skill_adjacency(spark, folder):
    """How close the top ten of every posting come to its words, by hashed letter-triple vectors."""
    rows = _pool_evidence(spark, folder).select("query_id", "doc_id", F.col("job_skills").alias("required"), F.col("cand_skills").alias("held"))
    rows = settle(rows, "skills")
    words = rows.select(F.explode(F.concat("required", "held")).alias("skill")).distinct()
    spaced = words.select("skill", F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("skill") - 2)), lambda i: F.concat(F.lit("t"), F.hex(F.substring(F.col("skill"), i, F.lit(3)))),
    )).alias("triples"))
    vectors = ch.encode(spaced, "triples", ch.TokenHashEncoder(64)).select("skill", "vector")
    report = adj.adjacency(rows, ["query_id", "doc_id"], vectors, match=0.85, adjacent=0.30)
    out = adj.coverage(report, ["query_id", "doc_id"])
    return out.select("query_id", "doc_id", "n_matched", "n_adjacent", "n_missing", F.round("coverage_score", 6).alias("coverage_score"))


def label_adjacency(spark, folder):
    """Each label's prototype against every vector: best match and its band."""
    hits = ch.similar_items(
        t.vectors(spark, folder).select("vec_id", "embedding"), t.prototypes(t.vectors(spark, folder)).select("vec_id", "embedding"), 1)
    sim = F.col("score")
    band = F.when(sim >= 0.85, adj.MATCHED).when(sim >= 0.55, adj.ADJACENT).otherwise(adj.MISSING)
    return hits.select("query_id", F.col("doc_id").alias("best"), F.round(sim, 6).alias("similarity"), band.alias("category"))


QUERIES = {
    "tokenised_lengths": tokenised_lengths,
    "token_frequencies": token_frequencies,
    "skills_found": skills_found,
    "skills_custom_vocabulary": skills_custom_vocabulary,
    "career_trajectories": career_trajectories,
    "posting_criteria": posting_criteria,
    "extractor_summary": extractor_summary,
    "role_count_spread": role_count_spread,
    "years_spread": years_spread,
    "high_careers": high_careers,
    "postings_by_skills": postings_by_skills,
    "case_study_posting": case_study_posting,
    "audit_proxies": audit_proxies,
    "nation_countries": nation_countries,
    "text_previews": text_previews,
    "fit_corpus_qrels": fit_corpus_qrels,
    "fit_corpus_sides": fit_corpus_sides,
    "evaluable_queries": evaluable_queries,
    "qrels_from_json": qrels_from_json,
    "content_duplicates": content_duplicates,
    "category_resumes": category_resumes,
    "postings_loaded": postings_loaded,
    "postings_sampled": postings_sampled,
    "union_of_corpora": union_of_corpora,
    "skill_overlap_explanations": skill_overlap_explanations,
    "rationale_prompts": rationale_prompts,
    "answers_parsed": answers_parsed,
    "skill_adjacency": skill_adjacency,
    "label_adjacency": label_adjacency,
}
