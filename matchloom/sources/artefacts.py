"""What runs leave behind: feature tables, splits, vectors, models, reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.channels import Encoder, TokenHashEncoder, encode
from matchloom.operators.models import Trained


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None, splits_path: str | None = None) -> DataFrame:
    """A feature table, or the rows of one split of it by a semi-join on the ids."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    ids = spark.read.parquet(splits_path).filter(F.col("split") == split).select("sample_id")
    return df.join(ids, "sample_id", "left_semi")


def write_splits(df: DataFrame, path: str, **provenance: str) -> None:
    notes = F.create_map(*[x for k, v in provenance.items() for x in (F.lit(k), F.lit(str(v)))]) if provenance else F.lit(None).cast("map<string,string>")
    df.select("sample_id", "split", notes.alias("provenance")).write.mode("overwrite").parquet(path)


def encode_with_cache(
    df: DataFrame, id_col: str, text_col: str, path: str, encoder: Encoder | None = None, force: bool = False,
) -> DataFrame:
    """(id, vector), encoding only texts the cache has not seen.

    The cache is a table keyed by content digest and encoder name, so changed
    texts and other encoders never get a stale vector, and each text is encoded once.
    """
    spark = df.sparkSession
    encoder = encoder or TokenHashEncoder()
    name = getattr(encoder, "name", type(encoder).__name__)
    keyed = df.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).withColumn("digest", F.sha1("text"))
    store = f"{path}/encoder={name}"
    unseen = keyed.groupBy("digest").agg(F.min("text").alias("text"))
    try:
        known = None if force else spark.read.schema("digest string, vector array<float>").parquet(store).select("digest")
        if known is not None:
            unseen = unseen.join(known, "digest", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    fresh = encode(unseen, "text", encoder).select("digest", "vector")
    fresh.write.mode("overwrite" if known is None else "append").parquet(store)
    vectors = spark.read.schema("digest string, vector array<float>").parquet(store)
    return keyed.select(id_col, "digest").join(vectors, "digest").select(id_col, "vector")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_trained(trained: Trained, path: str) -> None:
    """A fitted chain with its classifier and calibrator, each as a pipeline of its own."""
    save_model(trained.prepared, f"{path}/prepared")
    save_model(PipelineModel(stages=[trained.classifier]), f"{path}/classifier")
    save_model(PipelineModel(stages=[trained.calibrator] if trained.calibrator is not None else []), f"{path}/calibrator")


def load_trained(path: str) -> Trained:
    """The chain as it was saved, in any session; it scores as the one that was fitted."""
    calibrator = load_model(f"{path}/calibrator").stages
    return Trained(load_model(f"{path}/prepared"), load_model(f"{path}/classifier").stages[0], calibrator[0] if calibrator else None)


def available_models(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The registered models whose folder exists."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    return {name: path for name, path in paths.items() if there(path)}


def write_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
