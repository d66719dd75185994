"""Fits on repeated rows, and attributions by lookups."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import attributions as at, boosting as bo, models as mo, tree_attributions as ta


def labelled(spark, n):
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(0, n, 1, 1).select("id", draw(1).alias("a"), draw(2).alias("b"), F.when(draw(3) < 0.4, "x").otherwise("y").alias("kind"), draw(4).alias("u"))
    return rows.withColumn("label", (F.col("a") + F.col("b") * F.when(F.col("kind") == "x", 1.0).otherwise(-0.5) + F.col("u") / 2 > 0.9).cast("int"))


def test_repeated_rows_are_fitted_once_and_dealt_over_the_cores(spark):
    rows = labelled(spark, 12_000)
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(rows)
    many = rows.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    ready = mo.equal_rows(prepared, mo.class_weights(many, "label"), "label", "weight")
    n = rows.select("a", "b", "kind", "label").distinct().count()
    assert ready.count() == n
    parts = ready.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(parts) >= 2 and max(parts) <= 1.2 * n / len(parts)
    total = mo.class_weights(many, "label").agg(F.sum("weight")).first()[0]
    assert ready.agg(F.sum("weight")).first()[0] == pytest.approx(total)


def test_lookups_equal_the_polynomials(spark):
    rows = labelled(spark, 2_000)
    prepared = mo.preprocessor(["a", "b", "u"], ["kind"]).fit(rows)
    model = mo.fit_boosted(prepared, rows, rows.limit(0), "label", trees=8, depth=5, step=0.3).classifier
    leaves = ta.boosted_leaves(model)
    x = np.array([r["features"].toArray() for r in prepared.transform(rows).select("features").collect()])
    on_bounds = x[:200].copy()
    for leaf in leaves[:200]:
        for slot, factor in leaf.factors.items():
            if np.isfinite(factor.high):
                on_bounds[len(leaf.factors) :: 7, slot] = factor.high
    x = np.concatenate([x, on_bounds])
    tables = ta.Tables(leaves, x.shape[1])
    assert len(tables.tables) < len(leaves) / 2
    assert np.allclose(tables.attributions(x, 100), ta.shapley(leaves, x), atol=1e-9)


def test_importance_counts_a_row_by_its_weight(spark):
    one = "array(named_struct('feature', 'f', 'value', {}))"
    rows = spark.range(1).select(F.expr(one.format("1.0D")).alias("attributions"), F.lit(3).alias("n")).union(
        spark.range(1).select(F.expr(one.format("-5.0D")).alias("attributions"), F.lit(1).alias("n")))
    assert at.global_importance(rows, F.col("n")).first()["mean_abs_shap"] == 2.0
    assert at.global_importance(rows).first()["mean_abs_shap"] == 3.0


def grown_alike(found, due):
    for one, other in zip(found, due, strict=True):
        assert [n["split"]["featureIndex"] for n in one] == [n["split"]["featureIndex"] for n in other]
        for name in ("prediction", "impurity", "gain"):
            assert [n[name] for n in one] == pytest.approx([n[name] for n in other], abs=1e-9)
        assert [n["split"]["leftCategoriesOrThreshold"] for n in one] == [n["split"]["leftCategoriesOrThreshold"] for n in other]
        assert [n["impurityStats"][0] for n in one] == pytest.approx([n["impurityStats"][0] for n in other])


@pytest.mark.parametrize("tasks", [1, 3])
def test_a_fit_grows_the_trees_of_the_library_in_few_jobs(spark, monkeypatch, tasks):
    rows = labelled(spark, 3_000)
    monkeypatch.setattr(mo, "GROW_ROWS", 10**6 if tasks == 1 else 600)
    train, val = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(train)
    spark.sparkContext.setJobGroup(f"fit-{tasks}", "fit")
    found = mo.fit_boosted(prepared, train, val, "label", trees=8, depth=4, step=0.2).classifier
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{tasks}"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 30 + (0 if tasks == 1 else 8 * 4)
    due = mo._library_boosted(prepared, train, val, "label", 8, 4, 0.2, 42, 30, {}).classifier
    assert list(found.treeWeights) == list(due.treeWeights) == [1.0] + [0.2] * 7
    grown_alike(bo.saved_nodes(found), bo.saved_nodes(due))
    assert mo.Trained(prepared, found).score(val).agg(F.max("p_raw")).first()[0] == pytest.approx(mo.Trained(prepared, due).score(val).agg(F.max("p_raw")).first()[0])


def test_lost_rows_are_dealt_anew_and_go_through_the_grown_trees(spark, monkeypatch):
    rows = labelled(spark, 2_000)
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(rows)
    monkeypatch.setattr(mo, "GROW_ROWS", 600)
    due = bo.saved_nodes(mo.fit_boosted(prepared, rows, rows, "label", trees=4, depth=3, step=0.2).classifier)
    ask, asked = bo.Fleet.level, []

    def losing(self, *args):
        asked.append(args)
        if len(asked) == 5:  # in the third tree
            shutil.rmtree(self.folders.first())
        return ask(self, *args)

    monkeypatch.setattr(bo.Fleet, "level", losing)
    grown_alike(bo.saved_nodes(mo.fit_boosted(prepared, rows, rows, "label", trees=4, depth=3, step=0.2).classifier), due)
    assert len(asked) > 8


def test_no_round_is_fitted_that_could_not_be_kept(spark, monkeypatch):
    rows = labelled(spark, 600)
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(rows)
    train, val = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    kept = len(mo.fit_boosted(prepared, train, val, "label", trees=60, depth=5, step=0.5, patience=3).classifier.trees)
    assert kept == len(mo._library_boosted(prepared, train, val, "label", 20, 5, 0.5, 42, 3, {}).classifier.trees) < 20


def test_attributions_take_few_tables_and_come_by_falling_size(spark):
    rows = labelled(spark, 2_000)
    prepared = mo.preprocessor(["a", "b", "u"], ["kind"]).fit(rows)
    trained = mo.fit_boosted(prepared, rows, rows.limit(0), "label", trees=40, depth=5, step=0.1)
    leaves = [leaf for leaf in ta.boosted_leaves(trained.classifier) if leaf.factors]
    tables = ta.Tables(leaves, 5)
    assert len(tables.tables) <= len(leaves) / 12  # leaves on other slots share tables too
    x = np.array([r["features"].toArray() for r in prepared.transform(rows.limit(50)).select("features").collect()])
    due = ta.shapley(leaves, x)
    assert np.allclose(tables.attributions(x, 16), due, atol=1e-9)
    names = ["a", "b", "u", "kind", "kind"]
    got = ta.tree_attributions(trained.score(rows.filter("id < 300")), ["id", "p_raw"], trained.classifier, names).collect()
    assert len(got) == 300
    for r in got:
        sizes = [abs(a["value"]) for a in r["attributions"]]
        assert sorted(a["feature"] for a in r["attributions"]) == ["a", "b", "kind", "u"] and sizes == sorted(sizes, reverse=True)
        logit = r["base_logit"] + sum(a["value"] for a in r["attributions"])
        assert 1 / (1 + np.exp(-logit)) == pytest.approx(r["p_raw"], abs=1e-9)
