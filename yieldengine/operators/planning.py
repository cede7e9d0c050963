"""Forward, reverse, comparison and anomaly operators over request or order tables.

`stats` is the table from `material_stats` (Input_Material, mean, std, count, ...). Pass a staged or saved copy: its
known size lets Spark broadcast it when small, so a material that holds much of the history never becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldengine.functions import half_even
from yieldengine.functions.scoring import z_score
from yieldengine.operators.predictors import Predictor, forward_predict, predict_yield

DEFAULT_RMSE = 5.0
DEFAULT_LEVEL = 0.9
DEFAULT_THRESHOLD = 2.0
FALLBACK_YIELD = 70.0

# Wording of the possible causes.
LOW_YIELD_CAUSES = [
    "Equipment malfunction or misalignment",
    "Raw material quality issue (defects, knots)",
    "Operator error or training gap",
    "Recording error in input or output quantities",
    "Process parameter drift",
]
CRITICAL_CAUSE = "CRITICAL: Severe process deviation - investigate immediately"
HIGH_YIELD_CAUSES = [
    "Recording error (underreported input or overreported output)",
    "Inventory adjustment not captured",
    "Exceptionally good raw material quality",
    "Process improvement not yet reflected in baseline",
]


def usable_spread(stats: DataFrame) -> Column:
    """The deviation of materials with enough rows for one; null for the others."""
    return F.when(F.col("usable"), F.col("std")) if "usable" in stats.columns else F.col("std")


def with_confidence(
    requests: DataFrame, predictor: Predictor, stats: DataFrame, rmse: float = DEFAULT_RMSE,
    level: float = DEFAULT_LEVEL, model_name: str = "model",
) -> DataFrame:
    """Predicted yield with bounds from the material's own spread, or the model's error when it has too little."""
    spread = stats.select("Input_Material", usable_spread(stats).alias("_std"))
    scored = predict_yield(requests, predictor).join(spread, "Input_Material", "left")
    margin = z_score(F.lit(level)) * F.coalesce(F.col("_std"), F.lit(float(rmse)))
    low = F.greatest(F.lit(0.0), F.col("predicted") - margin)
    high = F.least(F.lit(150.0), F.col("predicted") + margin)
    return scored.withColumns({
        "predicted_yield_pct": half_even(F.col("predicted"), 2),
        "lower_bound_pct": half_even(low, 2),
        "upper_bound_pct": half_even(high, 2),
        "confidence_level": F.lit(level),
        "model_used": F.lit(model_name),
    }).drop("predicted", "_std")


def volume_at(input_bf: Column, yield_pct: Column) -> Column:
    return input_bf * yield_pct / F.lit(100.0)


def plan_forward(confident: DataFrame) -> DataFrame:
    """Expected, pessimistic and optimistic output of every request (from `with_confidence`)."""
    bf = F.col("Total_Input_BF")
    return confident.withColumns({
        "expected_output_bf": half_even(volume_at(bf, F.col("predicted_yield_pct")), 2),
        "pessimistic_output_bf": half_even(volume_at(bf, F.col("lower_bound_pct")), 2),
        "optimistic_output_bf": half_even(volume_at(bf, F.col("upper_bound_pct")), 2),
    })


def _needed(output: Column, pct: Column, otherwise: Column) -> Column:
    return F.when(pct > 0, output / (pct / F.lit(100.0))).otherwise(otherwise)


def plan_reverse(confident: DataFrame) -> DataFrame:
    """Input needed for a target output: with safety margin, at the lower bound, and at the upper bound."""
    target = F.col("required_output_bf")
    needed = _needed(target, F.col("predicted_yield_pct"), target)
    return confident.withColumns({
        "required_input_bf": half_even(needed * (F.lit(1.0) + F.col("safety_margin_pct") / F.lit(100.0)), 2),
        "conservative_input_bf": half_even(_needed(target, F.col("lower_bound_pct"), needed * F.lit(1.2)), 2),
        "optimistic_input_bf": half_even(_needed(target, F.col("upper_bound_pct"), needed * F.lit(0.9)), 2),
    })


def reverse_predict(requests: DataFrame, predictor: Predictor) -> DataFrame:
    """Input needed from the point prediction alone, with the expected loss."""
    scored = forward_predict(requests, predictor)
    pct = F.when(F.col("predicted_yield_pct") <= 0, F.lit(FALLBACK_YIELD)).otherwise(F.col("predicted_yield_pct"))
    needed = F.col("required_output_bf") / (pct / F.lit(100.0))
    with_safety = half_even(needed * (F.lit(1.0) + F.col("safety_margin_pct") / F.lit(100.0)), 2)
    return scored.select(
        "request_id", "Input_Material",
        with_safety.alias("required_input_bf"),
        half_even(needed, 2).alias("required_input_no_safety_bf"),
        F.col("required_output_bf").alias("target_output_bf"),
        pct.alias("predicted_yield_pct"),
        "safety_margin_pct",
        half_even(with_safety - F.col("required_output_bf"), 2).alias("expected_waste_bf"),
        half_even(F.lit(100.0) - pct, 2).alias("expected_waste_pct"),
    )


def waste_estimate(df: DataFrame, input_bf: str, yield_pct: str) -> DataFrame:
    bf, pct = F.col(input_bf), F.col(yield_pct)
    output = volume_at(bf, pct)
    return df.withColumns({
        "output_bf": half_even(output, 2),
        "waste_bf": half_even(bf - output, 2),
        "waste_pct": half_even(F.lit(100.0) - pct, 2),
    })


def compare_materials(confident: DataFrame, stats: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Material options with yield, bounds, history and, where priced, the cost per usable board foot."""
    past = stats.select(
        "Input_Material", F.col("count").alias("Historical_Orders"),
        half_even(F.col("mean"), 2).alias("Historical_Mean_Yield"),
    )
    table = confident.join(past, "Input_Material", "left")
    pct = F.col("predicted_yield_pct")
    extra = []
    if prices is not None:
        quoted = prices.select(F.col("material").alias("Input_Material"), F.col("price_per_bf"))
        table = table.join(quoted, "Input_Material", "left")
        per_usable = F.when(pct > 0, half_even(F.col("price_per_bf") / (pct / F.lit(100.0)), 4)).otherwise(
            F.lit(float("inf"))
        )
        extra = [
            F.col("price_per_bf").alias("Price_Per_BF_Input"),
            F.when(F.col("price_per_bf").isNotNull(), per_usable).alias("Effective_Cost_Per_BF_Output"),
        ]
    return table.select(
        "request_id", F.col("Input_Material").alias("Material"),
        pct.alias("Predicted_Yield_Pct"),
        F.col("lower_bound_pct").alias("Yield_Lower_Pct"),
        F.col("upper_bound_pct").alias("Yield_Upper_Pct"),
        *extra, "Historical_Orders", "Historical_Mean_Yield",
    )


def rank_materials(compared: DataFrame) -> DataFrame:
    """Cheapest usable board foot first, unpriced last; by yield when nothing is priced."""
    if "Effective_Cost_Per_BF_Output" in compared.columns:
        return compared.orderBy(F.col("Effective_Cost_Per_BF_Output").asc_nulls_last(), "Material")
    return compared.orderBy(F.col("Predicted_Yield_Pct").desc(), "Material")


def anomaly_causes(kind: Column, deviation_std: Column) -> Column:
    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return (
        F.when(kind.isNull(), F.array().cast("array<string>"))
        .when((kind == "LOW_YIELD") & (F.abs(deviation_std) > 3), texts([CRITICAL_CAUSE, *LOW_YIELD_CAUSES]))
        .when(kind == "LOW_YIELD", texts(LOW_YIELD_CAUSES))
        .otherwise(texts(HIGH_YIELD_CAUSES))
    )


def detect_anomalies(
    history: DataFrame, predictor: Predictor, stats: DataFrame, rmse: float = DEFAULT_RMSE,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Every history row against its prediction, in units of the material's spread (or the model's error)."""
    spread = stats.select("Input_Material", usable_spread(stats).alias("_std"))
    scored = predict_yield(history, predictor).join(spread, "Input_Material", "left")
    deviation = F.col("Yield_Percentage") - F.col("predicted_yield_pct")
    in_std = F.when(F.col("_std") > 0, F.col("deviation") / F.col("_std")).otherwise(F.lit(0.0))
    flagged = F.abs(F.col("in_std")) > F.lit(float(threshold))
    kind = F.when(
        F.col("is_anomaly"), F.when(F.col("deviation") < 0, F.lit("LOW_YIELD")).otherwise(F.lit("HIGH_YIELD"))
    )
    return (
        scored.withColumn("predicted_yield_pct", half_even(F.col("predicted"), 2))
        .withColumns({"deviation": deviation, "_std": F.coalesce(F.col("_std"), F.lit(float(rmse)))})
        .withColumn("in_std", in_std)
        .withColumn("is_anomaly", flagged)
        .withColumn("anomaly_type", kind)
        .withColumns({
            "deviation_pct": half_even(F.col("deviation"), 2),
            "deviation_std": half_even(F.col("in_std"), 2),
            "threshold_std": F.lit(float(threshold)),
            "possible_causes": anomaly_causes(F.col("anomaly_type"), F.col("in_std")),
        })
        .drop("predicted", "deviation", "in_std", "_std")
    )
