"""How the star-schema tables stand in for candidates, postings, sessions and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import vocab as V
from matchloom.session import spread

_NO_SKILLS = "array<string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as candidates known by their text alone."""
    return spread(table(spark, folder, "documents"), "doc_id").select(
        F.col("doc_id").alias("resume_id"), "text", F.array().cast(_NO_SKILLS).alias("skills"),
        F.lit(None).cast("double").alias("years_experience"), F.lit(None).cast("string").alias("target_role"),
        F.lit(None).cast("string").alias("location"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as postings known by their text alone."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("job_id"), F.lit("").alias("title"), F.col("text").alias("description"),
        F.array().cast(_NO_SKILLS).alias("required_skills"),
        F.lit(None).cast("double").alias("min_years_experience"), F.lit(None).cast("string").alias("location"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def label_centroids(embeddings: DataFrame) -> DataFrame:
    """(label, vector): the mean vector of each label; partial sums meet per label and slot."""
    cells = embeddings.select("label", F.posexplode("embedding").alias("slot", "x"))
    means = cells.groupBy("label", "slot").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("slot", "x")))
    return means.groupBy("label").agg(packed.alias("cells")).select("label", F.col("cells.x").alias("vector"))


def prototypes(embeddings: DataFrame) -> DataFrame:
    """(label, vec_id, embedding): the vector of each label that is closest to its centroid."""
    dot = F.aggregate(
        F.zip_with("embedding", "vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v
    )
    # a row for each label: neither join sends the vectors round
    near = embeddings.join(F.broadcast(label_centroids(embeddings)), "label").select(
        "label", "vec_id", F.round(dot, 9).alias("closeness")
    )
    best = near.groupBy("label").agg(F.max(F.struct("closeness", (-F.col("vec_id")).alias("order"))).alias("b"))
    chosen = best.select((-F.col("b.order")).alias("vec_id"))
    return embeddings.join(F.broadcast(chosen), "vec_id").select("label", "vec_id", "embedding")


def form_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as application-form events, one session per user.

    signup fills a field, error skips one, click goes back, purchase submits, and a
    view is a device report for an odd key and a clear for an even one.
    """
    key = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "fill").when(kind == "error", "skip").when(kind == "click", "back")
        .when(kind == "purchase", "submit").when(key % 2 == 1, "device").otherwise("clear")
    )
    names = F.array(*[F.lit(f) for f in V.FORM_FIELDS])
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), action.alias("action"), key.alias("key"),
    )
    return events.select(
        "session_id", "ts", "seq", "action",
        F.when(F.col("action").isin("fill", "skip", "clear"), F.element_at(names, F.col("key") % 8 + 1)).alias("field"),
        F.when(F.col("action") == "device", F.col("key") % 4 == 1).alias("is_mobile"),
    )


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as offer situations, every feature inside its declared bounds."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    days = F.date_diff("l_shipdate", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_discount") - F.col("l_tax")).alias("offer_salary_gap_pct"),
        F.least(F.lit(90), F.greatest(F.lit(0), F.abs(days) % 120)).cast("double").alias("days_interview_to_offer"),
        F.least(F.lit(8), F.greatest(F.lit(1), F.col("l_linenumber"))).cast("int").alias("interview_rounds"),
        F.least(F.lit(720.0), F.col("l_quantity") * 12).alias("candidate_response_hours"),
        (F.col("l_linenumber") % 7).cast("int").alias("negotiation_rounds"),
        (F.col("l_returnflag") == "R").cast("int").alias("competing_offer_signal"),
        F.least(F.lit(180.0), F.col("l_extendedprice") / 600).alias("commute_minutes"),
        (F.col("l_linestatus") == "O").cast("int").alias("remote_option"),
        F.least(F.lit(40.0), F.col("o_totalprice") / 12500).alias("cand_yoe"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cand_seniority_tier"),
        (F.col("o_orderstatus") != "F").cast("int").alias("cand_currently_employed"),
        (F.col("l_discount") >= 0.08).cast("int").alias("company_brand_tier"),
    )


def customer_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as candidates with structured fields; a negative balance means unknown years."""
    nation = table(spark, folder, "nation")
    years = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 500).cast("double"))
    return table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("doc_id"), years.alias("years_experience"), F.col("n_name").alias("location"),
        F.array(F.lower("c_mktsegment")).alias("skills"),
    )


def supplier_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as postings: years from the balance, place by nation, a certificate by turns."""
    nation = table(spark, folder, "nation")
    segments = F.array(*[F.lit(s) for s in ("BUILDING", "MACHINERY", "FURNITURE")])
    needs = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.element_at(segments, (F.col("s_suppkey") % 3 + 1).cast("int"))))
    return table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("query_id"),
        F.when(F.col("s_acctbal") >= 0, F.floor(F.col("s_acctbal") / 1000).cast("double")).alias("min_years_experience"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).alias("wanted_location"),
        F.coalesce(needs, F.array().cast(_NO_SKILLS)).alias("required_certifications"),
    )


def supplier_rankings(spark: SparkSession, folder: str, pool: int) -> DataFrame:
    """Each supplier's customers by revenue, cut to a pool. Revenue is summed before ranking, as decimals: a sum of doubles depends on its order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(24,4)").alias("revenue"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    spent = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_suppkey").alias("query_id"), F.col("o_custkey").alias("doc_id")
    ).agg(F.round(F.sum("revenue"), 2).cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return spent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a fixed score in [0, 1) that stands for a prediction."""
    p = ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 1000) / 1000.0
    return table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("label"), "toxic", p.alias("p")
    )
