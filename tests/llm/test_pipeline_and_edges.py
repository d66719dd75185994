"""The pipeline stage by stage, and the operators on nulls, repeats, clashing names and long texts."""

import random

import numpy as np
import pytest
from matchloom.llm import quality_model as quality
from matchloom.llm.jaccard_join import Frequent, frequent_tokens, near_duplicates, one_of_each
from matchloom.llm.line_dedup import dedup_lines, without_boilerplate
from matchloom.llm.mixing import mixed_documents
from matchloom.llm.quality_model import good_documents, quality_scores
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("__at", "__gone", "__cut", "__times", "__copy", "__own", "__n", "__s", "key", "row", "h", "___at")


@pytest.fixture(scope="module")
def labelled(spark):
    good = "The river ran past the old mill and the children played there until the evening came over the hills. "
    rows, labels, rng = [], [], random.Random(9)
    for i in range(240):
        bad = i % 3 == 0
        text = "%%% BUY $$$ now!!! ### " * (i % 7 + 1) if bad else " ".join(rng.choices(good.split(), k=30 + i % 13))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(None, None, None, None, None), (500, "", "en", None, 0), rows[1], rows[1], (501, good * 20000, "en", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def clashing(docs):
    return docs.withColumns({c: F.lit(1) for c in CLASHES})


def test_stages_keep_columns_of_any_name(labelled):
    docs, labels = labelled
    wide = clashing(docs)
    for run in (lambda d: good_documents(d, labels), lambda d: without_boilerplate(d, 3, 3), mixed_documents):
        got = run(wide)
        assert got.columns == wide.columns
        plain = sorted(map(str, run(docs).collect()))
        assert sorted(map(str, got.select(*docs.columns).collect())) == plain
    assert dedup_lines(wide, 3, 3).columns == [*wide.columns, "__lines", "__removed"]


def test_classifier_rejects_bad_rows_and_not_good_ones(labelled):
    docs, labels = labelled
    scores = {r.doc_id: r for r in quality_scores(docs, labels).filter("doc_id is not null").collect()}
    assert quality_scores(docs, labels).count() == docs.count()
    held = [i for i in range(0, 240, 2)]  # without a label
    assert all(scores[i].kept == (i % 3 != 0) for i in held)
    assert scores[501].kept
    assert quality_scores(docs, labels.filter("quality = 1")).filter("not kept").count() == 0
    assert quality_scores(docs.limit(0), labels).count() == 0 and good_documents(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_splits(labelled):
    docs, labels = labelled
    # batches of other sizes add up in another order: equal to twelve digits
    rounded = lambda d: sorted(map(str, quality_scores(d, labels).withColumn("score", F.round("score", 12)).collect()))
    assert rounded(docs.coalesce(1)) == rounded(docs.repartition(7))


def test_highest_takes_whole_bins(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), (F.col("id") % 100).alias("b"))
    assert quality.highest(rows, [F.col("a"), F.col("b")], 250).count() == 250
    got = quality.highest(rows, [F.col("a"), F.col("b")], 255)
    assert got.count() == 250 and got.agg(F.min("a")).first()[0] == 7
    assert quality.highest(rows, [F.col("a")], 5000).count() == 1000 and quality.highest(rows, [F.col("a")], 5).count() == 0


def test_threshold_bears_noise():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0.7, 1, 1000), rng.uniform(0, 0.2, 500)])
    y = np.concatenate([np.ones(1000), np.zeros(500)])
    y[1000:1002] = 1  # junk that is called good
    t = quality.threshold(p, y, 0.01)
    assert 0.2 <= t <= 0.5 and quality.threshold(p, y, 0.0) < 0.2


def test_frequent_tokens_are_all_found(spark):
    rows = [(i, f"one two three four five six own{i} other{i} third{i}", None, None, 1) for i in range(90)]
    tokens = frequent_tokens(spark.createDataFrame(rows, SCHEMA), 3, 50, 100, 64)
    assert len(tokens) > 2 and (np.sort(tokens) == tokens).all() and Frequent(tokens).holds(tokens).all()
    assert not Frequent(tokens).holds(tokens + np.uint64(1 << 23)).any()


def test_near_duplicates_of_rows_without_ids_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, None, None, 1), (3, text, None, None, 1), (3, text, None, None, 1), (1, text + " more", None, None, 1), (2, "x " * 200000, None, None, 1)]
    got = sorted(map(str, near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA))).collect()))
    assert got == sorted(map(str, spark.createDataFrame([(None, 58, None), (3, 58, 1), (3, 58, 1), (1, 59, 1), (2, 1, 2)], "doc_id long, n_shingles long, component_id long").collect()))


def test_pipeline_runs_its_stages(spark, labelled, tmp_path):
    import corpus_pipeline

    docs, labels = labelled
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing to target weights", "best-fit packing"]
    ids = {r.doc_id for r in out}
    assert len(ids) > 50 and not any(i in ids for i in range(0, 240, 3))
    kept = {r.doc_id for r in one_of_each(without_boilerplate(good_documents(docs, labels), 10, 3)).collect()}
    assert ids <= kept and len(kept) > 150
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 and sorted(parts)[0][0] == 0 for parts in used.values())
