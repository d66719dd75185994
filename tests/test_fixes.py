"""Statistics of whole tables, against plain Python."""

import math
import random

from matchloom.operators.ordered import exact_quantiles
from matchloom.operators.simulate import calibrated_intercept


def test_intercept_meets_the_rate_of_all_rows(spark):
    rng = random.Random(3)
    logits = [rng.gauss(0, 2) for _ in range(5000)] + [math.inf, -math.inf]
    rows = spark.createDataFrame([(x,) for x in logits] + [(None,)], "logit double")
    found = calibrated_intercept(rows, 0.3)
    held = [min(30.0, max(-30.0, x)) for x in logits]
    assert abs(sum(1 / (1 + math.exp(-(x + found))) for x in held) / len(held) - 0.3) < 1e-4


def test_quantiles_leave_out_nan_and_null(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)] + [(math.nan,), (None,)], "value double")
    got = exact_quantiles(rows, "value", {"p25": 0.25, "p50": 0.5}).first()
    assert tuple(got) == (2.5, 5.0)


def test_quantiles_of_no_values(spark):
    assert exact_quantiles(spark.createDataFrame([(math.nan,)], "value double"), "value", {"p50": 0.5}).first()[0] is None
