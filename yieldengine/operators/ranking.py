"""Presentation order of the result tables: within a request, best first, names breaking ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best_first(df: DataFrame, value: str, name: str) -> DataFrame:
    request = [c for c in ("request_id",) if c in df.columns]
    return df.orderBy(*request, F.col(value).desc_nulls_last(), name)


def by_mean_yield(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("Mean_Yield").desc(), "Input_Material", "Output_Material")


def by_predicted_yield(results: DataFrame) -> DataFrame:
    return _best_first(results, "Predicted_Yield_Pct", "Output_Material")


def by_recommendation(results: DataFrame) -> DataFrame:
    return _best_first(results, "Recommendation_Score", "Output_Material")


def by_contribution(plan: DataFrame) -> DataFrame:
    return _best_first(plan, "Contribution_Pct", "KD_Material")


def by_expected_volume(allocation: DataFrame) -> DataFrame:
    return _best_first(allocation, "Expected_Output_BF", "Output_Material")


def by_material_and_volume(distribution: DataFrame) -> DataFrame:
    return distribution.orderBy("request_id", "Output_Material", F.col("BF_Output").desc(), "Output_Grade")
