import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.plans.order_stats import nearest_rank, quartiles_and_median, values_at_ranks


def exact(spark, values, ranks):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = values_at_ranks(df, {"x": ranks}, {"x": (min(values), max(values))})
    return [got["x", r] for r in ranks]


@pytest.mark.parametrize("spread", ["even", "geometric", "outlier", "constant", "negative"])
def test_ranks(spark, spread):
    rng = random.Random(3)
    n = 5000
    values = {
        "even": [rng.random() for _ in range(n)],
        "geometric": [10.0 ** rng.uniform(-200, 200) for _ in range(n)],
        "outlier": [float(rng.randrange(50)) for _ in range(n - 1)] + [1e300],
        "constant": [4.5] * n,
        "negative": [-math.exp(rng.uniform(0, 40)) for _ in range(n)],
    }[spread]
    ranks = [0, n // 4, n // 2, n - 1]
    assert exact(spark, values, ranks) == [sorted(values)[r] for r in ranks]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=60))
def test_any_values(spark, values):
    ranks = sorted({0, len(values) // 2, len(values) - 1})
    assert exact(spark, values, ranks) == [sorted(values)[r] for r in ranks]


def test_quartiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 7)], "x double")
    assert quartiles_and_median(df, {"x": 6}, {"x": (1.0, 6.0)}) == {"x": (2.0, 3.5, 5.0)}
    assert nearest_rank(6, 0.25) == 1
