"""Result files: the planning exports and the evaluation tables, written in parallel by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldengine.operators.cleaning import display_columns

# Column choice and order of the result files.
PRODUCTION_ORDER = {
    "material": "Input_Material", "input_bf": "Input_Quantity_BF", "wastage_pct": "Wastage_Pct",
    "available_bf": "Available_Output_BF", "Output_Material": "Output_Material", "Output_Grade": "Output_Grade",
    "BF_Output": "Historical_BF_Output", "Order_Count": "Historical_Order_Count",
    "Percentage": "Historical_Percentage", "Avg_Yield": "Avg_Yield_Pct", "Yield_Std": "Yield_Std",
    "Planned_Output_BF": "Planned_Output_BF",
}
DISTRIBUTION = {
    "KD_Material": "KD_Material", "Historical_BF_Output": "Historical_BF_Output", "Order_Count": "Order_Count",
    "Contribution_Pct": "Contribution_Pct", "Expected_BF_Output": "Expected_BF_Output",
    "ks_material": "KS_Material", "plant": "Plant", "input_bf": "Input_BF",
}
KD_PREDICTION = DISTRIBUTION | {
    "predicted_output_bf": "Predicted_Total_Output_BF", "historical_yield_pct": "Yield_Pct",
}
ML_PREDICTION = DISTRIBUTION | {
    "ml_yield_pct": "ML_Yield_Pct", "historical_yield_pct": "Historical_Yield_Pct",
    "predicted_output_bf": "Predicted_Total_Output_BF", "prediction_method": "Prediction_Method",
}
BASIC_RESULTS = {
    "Input_Material": "Input Materials Used", "Output_Material": "Output Material", "Input_BF": "Total Input (BF)",
    "Predicted_Output_BF": "Predicted Output (BF)", "Predicted_Yield_Pct": "Predicted Yield %",
    "Model_Yield_Pct": "Model Yield %", "Historical_Yield_Pct": "Historical Yield %",
    "Yield_Std": "Yield Std Dev", "Historical_Orders": "Historical Orders",
    "Historical_Total_Output_BF": "Hist. Total Output (BF)", "Historical_Total_Input_BF": "Hist. Total Input (BF)",
    "Historical_Avg_Output_BF": "Hist. Avg Output (BF)", "Model_Type": "Model Type",
}
ENHANCED_RESULTS = {
    "Output_Material": "Output Material", "Predicted_Yield_Pct": "Yield %", "Yield_Min_Pct": "Min Yield %",
    "Yield_Max_Pct": "Max Yield %", "Predicted_Output_BF": "Output (BF)", "Confidence_Level": "Confidence",
    "Risk_Level": "Risk", "Confidence_Score": "Score", "Historical_Orders": "Hist. Orders",
    "Historical_Yield_Pct": "Hist. Yield %", "Yield_Std": "Std Dev", "Recommendation_Score": "Rec. Score",
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def display_table(results: DataFrame) -> DataFrame:
    """Named result columns; the enhanced set when confidence is available."""
    return display_columns(results, ENHANCED_RESULTS if "Confidence_Level" in results.columns else BASIC_RESULTS)


def export_distribution(forward: DataFrame, path: str) -> None:
    """Distribution rows of material-level or model-based forward plans."""
    rows = forward.where(F.col("status") == "ok")
    write_csv(display_columns(rows, ML_PREDICTION if "ml_yield_pct" in forward.columns else KD_PREDICTION), path)


def export_production_order(order: DataFrame, path: str) -> None:
    write_csv(display_columns(order, PRODUCTION_ORDER), path)


def export_results(results: DataFrame, path: str) -> None:
    """Simulation results (basic or enhanced) with all their columns."""
    write_csv(results, path)


def with_context(df: DataFrame, **values: Column | str | float) -> DataFrame:
    """Add context columns that apply to every row of a file."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})
