"""Readers of candidate and posting files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.functions import text as tx, vocab as V
from matchloom.operators.ordered import exact_quantiles

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}

RESUME_COLUMNS = ["resume_id", "candidate_name", "text", "skills", "years_experience", "location", "education", "target_role"]
JOB_COLUMNS = ["job_id", "title", "company", "description", "required_skills", "min_years_experience", "location", "required_certifications"]


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def _csv_with_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file may lack optional columns: only its header line is read to see which."""
    wanted = [part.strip().split(" ") for part in schema.split(",")]
    present = spark.read.options(header=True).csv(path).columns
    read = ", ".join(f"{n} {t}" for c in present for n, t in [next((w for w in wanted if w[0] == c), (c, "string"))])
    df = _csv(spark, path, read)
    return df.select(*[F.col(n) if n in present else F.lit(None).cast(t).alias(n) for n, t in wanted])


def read_resumes_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv_with_optional(spark, path, schemas.RESUME_CSV).withColumn("skills", tx.split_list(F.col("skills")))


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv_with_optional(spark, path, schemas.JOB_CSV)
    return df.withColumns({c: tx.split_list(F.col(c)) for c in ("required_skills", "required_certifications")})


def _as_resumes(df: DataFrame, **columns: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    base = {c: F.lit(None).cast("string") for c in RESUME_COLUMNS}
    base.update(skills=empty, years_experience=F.lit(None).cast("double"), **columns)
    return df.select(*[base[c].alias(c) for c in RESUME_COLUMNS])


def _as_jobs(df: DataFrame, **columns: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    base = {c: F.lit(None).cast("string") for c in JOB_COLUMNS}
    base |= {"required_skills": empty, "required_certifications": empty, "min_years_experience": F.lit(None).cast("double")} | columns
    return df.select(*[base[c].alias(c) for c in JOB_COLUMNS])


# ---- labelled pairs -----------------------------------------------------------------


def _usable_pairs(pairs: DataFrame) -> DataFrame:
    grades = F.create_map(*[x for k, v in V.FIT_GRADES.items() for x in (F.lit(k), F.lit(v))])
    clean = pairs.select(
        "row_no", tx.strip(F.col("resume_text")).alias("resume_text"),
        tx.strip(F.col("job_description_text")).alias("job_text"), grades[tx.strip(F.col("label"))].alias("grade"),
    ).filter((F.col("resume_text") != "") & (F.col("job_text") != "") & F.col("grade").isNotNull())
    return clean.withColumns({
        "resume_id": tx.content_id("hfr", F.col("resume_text")), "job_id": tx.content_id("hfj", F.col("job_text")),
    })


def _one_per_id(pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First-seen row number and text per content id. Copies merge in the map-side combine."""
    return pairs.groupBy(id_col).agg(F.min("row_no").alias("row_no"), F.min_by(text_col, "row_no").alias("text"))


def fit_corpus(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resumes, jobs, qrels) of labelled (row_no, resume_text, job_description_text, label).

    Both sides are unique by content; of repeated labels the last one counts.
    """
    usable = _usable_pairs(pairs)
    resumes = _as_resumes(
        _one_per_id(usable, "resume_id", "resume_text"), resume_id=F.col("resume_id"), text=F.col("text")
    )
    jobs = _as_jobs(
        _one_per_id(usable, "job_id", "job_text"), job_id=F.col("job_id"), description=F.col("text"),
        title=F.concat(F.lit("HF-Fit Query "), F.right("job_id", F.lit(6))),
    )
    qrels = usable.groupBy(F.col("job_id").alias("query_id"), F.col("resume_id").alias("doc_id")).agg(
        F.max_by("grade", "row_no").alias("grade")
    )
    return resumes, jobs, qrels


# ---- other corpora ---------------------------------------------------------------------


def category_resumes(raw: DataFrame, categories: list[str] | None = None, max_rows: int | None = None, order: str = "ID") -> DataFrame:
    """Category-labelled résumés; the row cap is a feature of the loader and off by default."""
    df = raw.filter(F.col("Category").isin(categories)) if categories else raw
    if max_rows:
        df = df.orderBy(order).limit(max_rows)
    df = df.withColumn("text", tx.strip(tx.blank_if_null(F.col("Resume_str")))).filter(F.col("text") != "")
    return _as_resumes(
        df, resume_id=F.concat(F.lit("kgr-"), F.col("ID").cast("string")), text=F.col("text"), target_role=F.col("Category")
    )


def read_category_resumes_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return category_resumes(_csv(spark, path, schemas.CATEGORY_RESUME_CSV), **options)


def postings(raw: DataFrame, sample_size: int | None = None, seed: int = 42, require_description: bool = True) -> DataFrame:
    """Job postings, optionally a seeded sample without replacement.

    The sample takes the lowest seeded digests, a top-k that needs no full sort.
    A missing field is NULL, never the text "nan".
    """
    df = raw.withColumn("description", tx.strip(F.col("description")))
    if require_description:
        df = df.filter(F.length("description") > 50)
    if sample_size is not None:
        df = df.withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("job_id").cast("string"))))
        df = df.orderBy("_draw", "job_id").limit(sample_size)
    df = df.filter(F.col("description") != "")
    level = F.create_map(*[x for k, v in V.LEVEL_MIN_YOE.items() for x in (F.lit(k), F.lit(v))])
    listed = tx.split_list(F.col("skills_desc"), "[,;\n]")
    title = tx.strip(tx.blank_if_null(F.col("title")))

    def or_null(c: str) -> Column:
        return F.nullif(tx.strip(F.col(c)), F.lit(""))

    return _as_jobs(
        df, job_id=F.concat(F.lit("lij-"), F.col("job_id").cast("string")),
        title=F.when(title != "", title).otherwise("Untitled"), company=or_null("company_name"),
        description=F.col("description"), required_skills=F.filter(listed, lambda s: F.length(s) <= 40),
        min_years_experience=F.coalesce(level[tx.strip(F.col("formatted_experience_level"))], F.lit(V.DEFAULT_MIN_YOE)),
        location=or_null("location"),
    )


def read_postings_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return postings(_csv(spark, path, schemas.POSTING_CSV), **options)


def read_hr_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.HR_CSV)


def fill_missing(df: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Missing categories become 'unknown'; missing numbers the column's median."""
    typed = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric})
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in numeric])
    long = typed.select(F.inline(cells))
    # One row per numeric column.
    medians = {r["name"]: r["median"] for r in exact_quantiles(long, "value", {"median": 0.5}, ["name"]).collect()}
    return typed.fillna("unknown", categorical).fillna({c: m for c, m in medians.items() if m is not None})


def corpus_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both corpora; ``source_rank`` keeps the first ahead in any ordering."""
    return first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)))


def choose_source(kind: str, sources: dict) -> DataFrame:
    """The named source of a variant; ``sources`` maps names to functions that load one."""
    if kind not in sources:
        raise ValueError(f"unknown source {kind!r}, expected one of {sorted(sources)}")
    return sources[kind]()
