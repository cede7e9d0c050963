import pytest
from pyspark.sql import functions as F

from yieldengine.functions import blended_yield, confidence, half_even, yield_range
from yieldengine.functions.scoring import history_weight


@pytest.mark.parametrize("n, std, r2, points", [
    (4, 5, 0.7, (5, 35, 25)), (5, 5.01, 0.69, (10, 25, 20)), (19, 10, 0.5, (10, 25, 20)),
    (20, 10.01, 0.49, (20, 15, 15)), (49, 15, 0.3, (20, 15, 15)), (50, 15.01, 0.29, (30, 10, 10)),
    (99, 20, 0.1, (30, 10, 10)), (100, 20.01, 0.09, (40, 5, 5)),
])
def test_tiers_are_edge_inclusive(spark, n, std, r2, points):
    row = spark.range(1).select(*[
        c.alias(k) for k, c in confidence(F.lit(n), F.lit(float(std)), F.lit(float(r2))).items()
    ]).first()
    assert (row["data_score"], row["consistency_score"], row["model_score"]) == points
    assert row["confidence_score"] == sum(points)


@pytest.mark.parametrize("n, std, r2, level, risk", [
    (100, 1, 0.7, "HIGH", "LOW"), (100, 5, 0.0, "HIGH", "LOW"), (50, 10, 0.0, "MEDIUM", "MEDIUM"),
    (20, 15, 0.0, "LOW", "HIGH"), (1, 99, 0.0, "VERY LOW", "VERY HIGH"),
])
def test_levels(spark, n, std, r2, level, risk):
    found = confidence(F.lit(n), F.lit(float(std)), F.lit(r2))
    row = spark.range(1).select(found["confidence_level"].alias("l"), found["risk_level"].alias("r")).first()
    assert (row["l"], row["r"]) == (level, risk)


def test_documented_range(spark):
    found = yield_range(F.lit(72.5), F.lit(72.5), F.lit(8.2), F.lit(85))
    row = spark.range(1).select(*[c.alias(k) for k, c in found.items()]).first()
    assert (row["margin_of_error"], row["yield_min"], row["yield_max"]) == (1.74, 70.76, 74.24)


@pytest.mark.parametrize("std, n, margin", [(4.0, 1, 7.84), (0.0, 1, 29.4), (0.0, 0, 29.4)])
def test_range_of_a_single_order(spark, std, n, margin):
    found = yield_range(F.lit(90.0), F.lit(90.0), F.lit(std), F.lit(n))
    assert spark.range(1).select(found["margin_of_error"]).first()[0] == margin


@pytest.mark.parametrize("n, weight", [(10, 0.10), (50, 0.50), (75, 0.70), (100, 0.70)])
def test_history_weight(spark, n, weight):
    row = spark.range(1).select(history_weight(F.lit(n)), blended_yield(F.lit(0.0), F.lit(100.0), F.lit(n))).first()
    assert row[0] == pytest.approx(weight) and row[1] == pytest.approx(weight * 100)


@pytest.mark.parametrize("value, digits, expected", [(0.125, 2, 0.12), (0.375, 2, 0.38), (-0.001, 2, 0.0), (2.5, 0, 2.0)])
def test_half_even(spark, value, digits, expected):
    got = spark.range(1).select(half_even(F.lit(value), digits)).first()[0]
    assert got == expected and str(got) != "-0.0"


@pytest.mark.parametrize("pct, points, score", [(80, 85, 0.68), (90, 50, 0.45), (70, 70, 0.49)])
def test_documented_scores(spark, pct, points, score):
    got = spark.range(1).select(half_even((F.lit(pct) / 100) * (F.lit(points) / 100), 4)).first()[0]
    assert got == score
