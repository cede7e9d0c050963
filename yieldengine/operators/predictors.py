"""What the planning operators need from a model: a function that adds a nullable `raw_yield` to request rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.functions import clip, half_even
from yieldengine.staging import stage

Predictor = Callable[[DataFrame], DataFrame]

FALLBACK_YIELD = 70.0


def mean_yield_predictor(
    history: DataFrame, keys: tuple[str, ...] = ("Input_Material", "Input_Plant"), staged: bool = False
) -> Predictor:
    """Mean historical yield of the request's keys, else the overall mean. Needs no trained model.

    With `staged` the means are written first, so scoring a large table joins a table of known size.
    """
    means = history.groupBy(*keys).agg(F.avg("Yield_Percentage").alias("_mean"))
    if staged:
        means = stage(means, "mean-yield")
    overall = history.agg(F.avg("Yield_Percentage").alias("m")).scalar()

    def predict(rows: DataFrame) -> DataFrame:
        return rows.join(means, list(keys), "left").withColumn("raw_yield", F.coalesce("_mean", overall)).drop("_mean")

    return predict


def predict_yield(rows: DataFrame, predictor: Predictor, fallback: float | None = None) -> DataFrame:
    """Unrounded prediction inside 0..150 as `predicted`; `fallback` stands in where the model gives nothing."""
    scored = predictor(rows)
    raw = F.col("raw_yield") if fallback is None else F.coalesce(F.col("raw_yield"), F.lit(fallback))
    return scored.withColumn("predicted", clip(raw, 0, 150)).drop("raw_yield")


def forward_predict(requests: DataFrame, predictor: Predictor) -> DataFrame:
    """Predicted yield and output volume of every request line."""
    scored = predict_yield(requests, predictor, FALLBACK_YIELD)
    return scored.withColumns({
        "predicted_yield_pct": half_even(F.col("predicted"), 2),
        "predicted_output_bf": half_even(F.col("Total_Input_BF") * F.col("predicted") / F.lit(100.0), 2),
    }).drop("predicted")
