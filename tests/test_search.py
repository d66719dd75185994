"""Boosting in stages and the parameter search: rules by hand, and small fits."""

import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import models as mo, search as sr, staged as st
from matchloom.plans import modelling

SPACE = {"x": sr.Span(0.001, 1.0, log=True), "k": sr.Span(1, 9, step=2)}


def peak(params):
    return -abs(math.log10(params["x"]) + 1.0) - abs(params["k"] - 5) / 8, None


def test_values_keep_to_their_span_and_return_from_their_place():
    for span in sr.BOOST_SPACE.values():
        for unit in (0.0, 0.3, 0.77, 1.0):
            value = span.value(unit)
            assert span.low <= value <= span.high and span.value(span.unit(value)) == pytest.approx(value)
            assert not span.step or (value - span.low) % span.step == 0
    assert SPACE["x"].unit(0.0) == 0.0 and SPACE["k"].unit(99) == 1.0


def test_densities_sum_to_one_and_draws_follow_them():
    import random

    mixture, dice = sr.Parzen([0.1, 0.12, 0.9]), random.Random(1)
    assert sum(mixture.density((i + 0.5) / 20000) for i in range(20000)) / 20000 == pytest.approx(1.0, abs=1e-6)
    drawn = [mixture.draw(dice) for _ in range(20000)]
    for low in (0.0, 0.25, 0.5, 0.75):
        due = sum(mixture.density(low + (i + 0.5) / 4000) for i in range(1000)) / 4000
        assert sum(low <= x < low + 0.25 for x in drawn) / len(drawn) == pytest.approx(due, abs=0.02)


def test_search_repeats_itself_and_beats_even_draws():
    wins = 0
    for seed in range(10):
        found = sr.search(peak, SPACE, 60, seed)
        assert found == sr.search(peak, SPACE, 60, seed) and [t.number for t in found] == list(range(60))
        even = sr.search(peak, SPACE, 60, seed, start=1000)
        late = lambda done: sum(t.score for t in done[30:]) / 30
        assert late(found) > late(even)
        wins += sr.best_trial(found).score >= sr.best_trial(even).score
    assert wins >= 6
    given = sr.search(peak, SPACE, 5, first={"x": 0.1, "k": 5})
    assert given[0].params == {"x": 0.1, "k": 5} and sr.best_trial(given).number == 0


def test_stop_counts_from_the_first_best_round():
    assert st.stop_at([0.5, 0.7, 0.6, 0.7], 2) == (2, True) and st.stop_at([0.5, 0.7, 0.6], 2) == (2, False)
    assert st.stop_at([0.5, 0.6, 0.7], 1) == (3, False)


@pytest.fixture(scope="module")
def rows(spark):
    draw = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 1000.0
    rows = spark.range(800).select("id", draw(1).alias("a"), draw(2).alias("b"), F.when(draw(3) < 0.4, "x").otherwise("y").alias("kind"), draw(4).alias("u"))
    rows = rows.withColumn("label", (F.col("a") + F.col("b") * F.when(F.col("kind") == "x", 1.0).otherwise(-0.5) + F.col("u") / 2 > 0.9).cast("int"))
    return modelling.with_split(rows, draw(5))


def test_stages_end_by_auc_and_the_model_scores_as_its_margins(spark, rows):
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    prepared = mo.preprocessor(["a", "b"], ["kind"]).fit(train)
    ready = st.staged_rows(prepared, train, val, "label")
    fit = st.fit_staged(prepared, ready, trees=40, depth=3, step=0.3, patience=3)
    kept = len(fit.trained.classifier.trees)
    assert kept <= fit.rounds_fitted <= min(40, kept + 3 + st.BATCH - 1)
    scored = fit.trained.score(val).select("label", "p").toPandas()
    pos, neg = scored[scored.label == 1].p, scored[scored.label == 0].p
    wins = sum((p > neg).sum() + (p == neg).sum() / 2 for p in pos) / (len(pos) * len(neg))
    assert fit.auc == pytest.approx(wins, abs=1e-9) and fit.auc > 0.8
    # no held rows: all rounds stay
    alone = st.fit_staged(prepared, ready.filter("not held"), trees=3, depth=2, step=0.3)
    assert (alone.rounds_fitted, len(alone.trained.classifier.trees), alone.auc) == (3, 3, None)


def test_tuned_models_are_no_worse_than_the_default_and_repeat(spark, rows):
    space = {**sr.BOOST_SPACE, "trees": sr.Span(4, 8, step=2), "depth": sr.Span(2, 3, step=1)}
    tune = lambda: modelling.tuned_models(rows, ["a", "b"], ["kind"], "label", {"trees": 5, "depth": 2, "step": 0.1}, 4, space=space)
    done, found = tune()
    told = modelling.trial_rows(spark, done).collect()
    assert len(told) == 4 and sum(r["best"] for r in told) == 1 and max(r["val_auc"] for r in told) >= told[0]["val_auc"]
    quality = {(r["model"], r["split"]): r for r in modelling.paired_quality(rows, found, "label").collect()}
    assert sorted(quality) == [(m, s) for m in ("calibrated", "default", "tuned") for s in ("test", "val")]
    assert quality["tuned", "val"]["auc_over_default"] >= 0 == quality["default", "test"]["auc_over_default"]
    assert [(t.params, t.score) for t in tune()[0]] == [(t.params, t.score) for t in done]
