"""Exact quantiles by brackets against sorting."""

import numpy as np
import pytest

from tallyspark.operators import quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(4)


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(0, 1, 5000), np.random.default_rng(2).integers(0, 7, 3000), 10.0 ** np.random.default_rng(3).uniform(-300, 300, 2000),
    [5], [1, 2], [3] * 500 + [4], [-1.7e308, 0, 1.7e308, 5, 5], np.concatenate([np.full(3000, 7.0), np.random.default_rng(4).exponential(1e9, 1500)]),
])
def test_against_sorting(spark, values):
    rows = quantiles.exact_quantiles(column(spark, [*values, None, float("nan")]), "x", SHARES).collect()
    ordered = sorted(float(v) for v in values)
    for r in rows:
        p = r.share * (len(ordered) - 1)
        low, high = ordered[int(np.floor(p))], ordered[int(np.ceil(p))]
        assert r.quantile == pytest.approx(low + (high - low) * (p - np.floor(p)), rel=1e-12)


def test_without_values_and_wrong_shares(spark):
    assert [r.quantile for r in quantiles.exact_quantiles(column(spark, [None]), "x", (0.5,)).collect()] == [None]
    assert [r.quantile for r in quantiles.exact_quantiles(column(spark, []), "x", (0.5,)).collect()] == [None]
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles.exact_quantiles(column(spark, [1]), "x", (1.2,))


def test_raw_fences(spark):
    values = [10, 11, 12, 13, 14, 15, 16, 100, None]
    found = {r.x: r.is_outlier for r in quantiles.raw_fences(column(spark, values), "x").collect()}
    assert found[100] and not found[None] and sum(found.values()) == 1
    assert [r.is_outlier for r in quantiles.raw_fences(column(spark, [None]), "x").collect()] == [False]


def test_infinite_values(spark):
    values = [float("-inf")] * 3 + [1.0, 2.0, 3.0] + [float("inf")] * 4
    assert quantiles.ranked_values(column(spark, values), "x", range(10)) == dict(enumerate(values))
