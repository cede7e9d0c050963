"""Confidence, risk and interval rules as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yieldengine.functions.expressions import half_even

# Points per tier, as (bound, points), with the points below the last bound.
DATA_TIERS = ([(100, 40), (50, 30), (20, 20), (5, 10)], 5)
SPREAD_TIERS = ([(5, 35), (10, 25), (15, 15), (20, 10)], 5)
MODEL_TIERS = ([(0.7, 25), (0.5, 20), (0.3, 15), (0.1, 10)], 5)
LEVEL_TIERS = ([(80, "HIGH"), (60, "MEDIUM"), (40, "LOW")], "VERY LOW")
# Risk is the inverse of confidence.
RISK_OF_LEVEL = {"HIGH": "LOW", "MEDIUM": "MEDIUM", "LOW": "HIGH", "VERY LOW": "VERY HIGH"}

MAX_HISTORY_WEIGHT = 0.7
DEFAULT_SPREAD = 15.0
Z_90, Z_95 = 1.645, 1.96


def _ladder(value: Column, tiers: tuple, reaches) -> Column:
    rungs, otherwise = tiers
    chain = None
    for bound, result in rungs:
        test = reaches(value, bound)
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def _at_least(value: Column, bound: float) -> Column:
    return value >= F.lit(bound)


def _at_most(value: Column, bound: float) -> Column:
    return value <= F.lit(bound)


def confidence(n: Column, std: Column, r2: Column) -> dict[str, Column]:
    """Points for data volume, spread and model fit, their sum, and the level and risk that follow."""
    data = _ladder(n, DATA_TIERS, _at_least)
    spread = _ladder(std, SPREAD_TIERS, _at_most)
    model = _ladder(r2, MODEL_TIERS, _at_least)
    score = data + spread + model
    level = _ladder(score, LEVEL_TIERS, _at_least)
    risk = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RISK_OF_LEVEL.items()])
    return {
        "data_score": data,
        "consistency_score": spread,
        "model_score": model,
        "confidence_score": score,
        "confidence_level": level,
        "risk_level": risk,
    }


def history_weight(n: Column) -> Column:
    return F.least(n / F.lit(100.0), F.lit(MAX_HISTORY_WEIGHT))


def blended_yield(model_yield: Column, history_yield: Column, n: Column) -> Column:
    weight = history_weight(n)
    return weight * history_yield + (F.lit(1.0) - weight) * model_yield


def yield_range(
    model_yield: Column, history_yield: Column, std: Column, n: Column, z: float = Z_95
) -> dict[str, Column]:
    """Blended expectation with a normal interval on the standard error, kept inside 0..150."""
    error = F.when(n > 1, std / F.sqrt(n.cast("double"))).otherwise(
        F.when(std > 0, std).otherwise(F.lit(DEFAULT_SPREAD))
    )
    margin = F.lit(z) * error
    expected = blended_yield(model_yield, history_yield, n)
    low = F.greatest(F.lit(0.0), expected - margin)
    high = F.least(F.lit(150.0), expected + margin)
    return {
        "yield_min": half_even(low, 2),
        "yield_max": half_even(high, 2),
        "yield_expected": half_even(expected, 2),
        "range_width": half_even(high - low, 2),
        "margin_of_error": half_even(margin, 2),
    }


def z_score(level: Column) -> Column:
    """1.645 for a 90% level, 1.96 for any other."""
    return F.when(level == F.lit(0.9), F.lit(Z_90)).otherwise(F.lit(Z_95))
