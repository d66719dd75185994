"""Models and their attributions: against brute force, and on the smallest tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import models as mo, tree_attributions as ta
from matchloom.plans import modelling

SMALL = "/root/testdata/sf0.001"


def expectation(node, x, known):
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, slot = node.split(), node.split().featureIndex()
    sides = [node.leftChild(), node.rightChild()]
    if slot in known:
        continuous = split.getClass().getSimpleName() == "ContinuousSplit"
        left = x[slot] <= split.threshold() if continuous else x[slot] in list(split.leftCategories())
        return expectation(sides[0 if left else 1], x, known)
    return sum(s.impurityStats().count() * expectation(s, x, known) for s in sides) / node.impurityStats().count()


@pytest.fixture(scope="module")
def trained(spark):
    draw = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1000.0
    rows = spark.range(600).select("id", draw(1).alias("a"), draw(2).alias("b"), F.when(draw(3) < 0.4, "x").otherwise("y").alias("kind"), draw(4).alias("u"))
    rows = rows.withColumn("label", (F.col("a") + F.col("b") * F.when(F.col("kind") == "x", 1.0).otherwise(-0.5) + F.col("u") / 2 > 0.9).cast("int"))
    train, val = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(train)
    return rows, val, mo.calibrated(mo.fit_boosted(prepared, train, val, "label", trees=3, depth=3, step=0.3), val, "label")


def test_attributions_equal_all_subsets(trained):
    rows, _, model = trained
    x = np.array([r["features"].toArray() for r in model.score(rows.filter("id < 3")).select("features").collect()])
    found = ta.shapley(ta.boosted_leaves(model.classifier), x)
    n = x.shape[1]
    trees = [(t._call_java("rootNode"), 2 * w) for t, w in zip(model.classifier.trees, model.classifier.treeWeights)]
    for row, got in zip(x, found):
        worth = {s: sum(w * expectation(t, row, s) for t, w in trees) for k in range(n + 1) for s in combinations(range(n), k)}
        for i in range(n):
            due = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (worth[tuple(sorted((*s, i)))] - v) for s, v in worth.items() if i not in s)
            assert got[i] == pytest.approx(due, abs=1e-9)
        assert ta.expected(ta.boosted_leaves(model.classifier)) == pytest.approx(worth[()], abs=1e-9)


def test_calibration_rises_with_the_score_and_unknown_categories_score(trained, spark):
    rows, val, model = trained
    scored = model.score(val).orderBy("p_raw").toPandas()
    assert scored["p"].is_monotonic_increasing and scored["p"].between(0, 1).all() and len(scored) == val.count()
    assert model.score(rows.limit(1).withColumn("kind", F.lit("new"))).first()["p"] is not None
    with pytest.raises(ValueError):
        mo.class_weights(rows.filter("label = 1"), "label")


def test_attributions_of_offers_meet_the_log_odds(spark):
    rows = modelling.offer_model_drivers(spark, SMALL).agg(F.max("gap").alias("gap"), F.count("*").alias("n")).first()
    assert rows["gap"] <= 1e-6 and rows["n"] == spark.read.parquet(f"{SMALL}/lineitem.parquet").join(
        spark.read.parquet(f"{SMALL}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).count()


def test_rounds_end_by_validation_rows_and_queries_boost_as_the_survey_says(trained):
    rows, val, model = trained
    assert (modelling.OFFER_BOOST, modelling.DROPOFF_BOOST) == ({"trees": 300, "depth": 5, "step": 0.06}, {"trees": 400, "depth": 6, "step": 0.05})
    assert mo.best_rounds([5.0, 4.0, 4.5, 3.0, 3.1, 3.2, 1.0], 2) == 4 and mo.best_rounds([2.0, 1.0], 30) == 2
    short = mo.first_rounds(model.classifier, 1)
    assert len(short.trees) == 1 and list(short.treeWeights) == [model.classifier.treeWeights[0]]
    scored = mo.Trained(model.prepared, short).score(val)
    assert scored.filter("p is null or p_raw <= 0 or p_raw >= 1").count() == 0
    # a small step gains little a round, and goes on all the same
    slow = mo.fit_boosted(model.prepared, rows.filter("id % 4 <> 0"), val, "label", trees=12, depth=2, step=0.01)
    assert len(slow.classifier.trees) > 8


def test_saved_chain_scores_as_the_fitted_one(trained, tmp_path):
    from matchloom.sources import artefacts

    rows, val, model = trained
    for name, chain in (("calibrated", model), ("plain", mo.Trained(model.prepared, model.classifier))):
        artefacts.save_trained(chain, str(tmp_path / name))
        loaded = artefacts.load_trained(str(tmp_path / name))
        assert sorted(map(tuple, loaded.score(val).select("id", "p_raw", "p").collect())) == sorted(map(tuple, chain.score(val).select("id", "p_raw", "p").collect()))
    assert loaded.calibrator is None


def test_presets_rise_from_accept_to_decline_on_one_fit(spark, monkeypatch):
    # where no test before has fitted the whole model in this session, a small one stands in for it
    monkeypatch.setattr(modelling, "OFFER_BOOST", {"trees": 20, "depth": 3, "step": 0.3})
    p = {r["scenario"]: r for r in modelling.offer_presets(spark, SMALL).collect()}
    assert p["likely_accept"]["p_raw"] < p["uncertain"]["p_raw"] < p["likely_decline"]["p_raw"]
    assert p["likely_accept"]["p"] <= p["uncertain"]["p"] <= p["likely_decline"]["p"]
    rows, path = modelling._OFFER_MODELS[(spark.sparkContext.applicationId, SMALL)]
    assert modelling.offer_models(spark, SMALL)[0] is rows
