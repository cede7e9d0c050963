"""The joined yield history and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldengine.functions import column_quantiles, grouped_quantiles
from yieldengine.operators.aggregates import (
    aggregate_inputs, aggregate_outputs, order_inputs_simple, order_outputs_simple,
)
from yieldengine.operators.states import (
    chosen_inputs, chosen_outputs, input_candidates, input_states, output_candidates, output_states,
)
from yieldengine.operators.volume import with_valid_yield, with_yield
from yieldengine.schema import ORDER
from yieldengine.staging import stage, stage_clustered

# The columns trimmed in turn and the percentile bounds.
OUTLIER_COLUMNS = ["Yield_Percentage", "Total_Input_BF", "Total_Output_BF"]
LOWER_PCT, UPPER_PCT = 1.0, 99.0


def join_on_order(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inner join on the order alone: one input row to many output rows, never matched by material."""
    return inputs.join(outputs, ORDER, "inner")


def yield_history(ledger_261: DataFrame, ledger_101: DataFrame, with_grade: bool = True) -> DataFrame:
    """Cleaned ledgers to joined history with a yield per order and output material.

    Columns a query does not read are pruned down to the ledger scan; only the dominant grade has to be declined.
    """
    return with_yield(join_on_order(aggregate_inputs(ledger_261), aggregate_outputs(ledger_101, with_grade)))


def clustered_sides(ledger_261: DataFrame, ledger_101: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The aggregates of both sides, each from one read of its cleaned ledger.

    They are written clustered by order with every volume they might be measured by. Which one counts is then decided
    from the totals of that table, and a join of the two sides on the order needs no exchange.
    """
    inputs, outputs = stage_clustered(
        {"inputs": input_candidates(input_states(ledger_261)), "outputs": output_candidates(output_states(ledger_101))}, ORDER
    )
    return chosen_inputs(inputs), chosen_outputs(outputs)


def clustered_history(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """`yield_history` from `clustered_sides`: the way for a history of many columns, or one that is read several times.

    For a few columns read once, `yield_history` writes nothing and prunes down to the scan, but reads the volume
    columns twice.
    """
    return with_yield(join_on_order(*clustered_sides(ledger_261, ledger_101)))


def valid_yield_orders(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """Order-grain history restricted to 0 < yield <= 100."""
    joined = order_inputs_simple(ledger_261).join(order_outputs_simple(ledger_101), ORDER, "inner")
    return with_valid_yield(joined)


def same_material_count(history: DataFrame) -> DataFrame:
    """How many history rows have the same input and output material (unusual, so worth a warning)."""
    same = F.col("Input_Material") == F.col("Output_Material")
    return history.agg(F.count(F.lit(1)).alias("joined_rows"), F.count_if(same).alias("same_material_rows"))


def yield_statistics(history: DataFrame) -> DataFrame:
    y = F.col("Yield_Percentage")
    return history.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(y).alias("mean_yield"),
        F.stddev_samp(y).alias("std_yield"),
        F.min(y).alias("min_yield"),
        F.max(y).alias("max_yield"),
    )


def yield_median(history: DataFrame) -> DataFrame:
    return grouped_quantiles(history, [], "Yield_Percentage", {"median_yield": 0.5})


def yield_by_material(history: DataFrame) -> DataFrame:
    """Per input and output material: yield mean, deviation, extremes, count and volumes."""
    y = F.col("Yield_Percentage")
    return history.groupBy("Input_Material", "Output_Material").agg(
        F.avg(y).alias("Mean_Yield"),
        F.stddev_samp(y).alias("Std_Yield"),
        F.min(y).alias("Min_Yield"),
        F.max(y).alias("Max_Yield"),
        F.count(y).alias("Order_Count"),
        F.sum("Total_Output_BF").alias("Total_Output"),
        F.sum("Total_Input_BF").alias("Total_Input"),
    )


def material_stats(history: DataFrame, minimum: int = 3) -> DataFrame:
    """Yield spread of every input material, without quartiles; `usable` tells those with at least `minimum` rows, whose
    deviation may serve as a spread."""
    y = F.col("Yield_Percentage")
    return (
        history.where(F.col("Input_Material").isNotNull())
        .groupBy("Input_Material")
        .agg(
            F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.count(F.lit(1)).alias("count"),
            F.min(y).alias("min"), F.max(y).alias("max"),
        )
        .withColumn("usable", F.col("count") >= minimum)
    )


def material_yield_stats(history: DataFrame, minimum: int = 3) -> DataFrame:
    """`material_stats` with exact quartiles."""
    quartiles = grouped_quantiles(history, ["Input_Material"], "Yield_Percentage", {"q25": 0.25, "q75": 0.75})
    return material_stats(history, minimum).join(quartiles, "Input_Material")


def remove_outliers(
    df: DataFrame, column: str, lower_pct: float = LOWER_PCT, upper_pct: float = UPPER_PCT
) -> DataFrame:
    """Keep rows inside the inclusive percentile bounds; unchanged when the column is absent or empty."""
    if column not in df.columns:
        return df
    low, high = column_quantiles(df, column, [lower_pct / 100, upper_pct / 100])
    return df if low is None else df.where(F.col(column).between(low, high))


def remove_outlier_chain(history: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trim the columns one after the other, each on the rows the previous step left.

    The history is staged once; the bounds become literals, so each later step is a pushed-down filter on that table.
    """
    staged = stage(history, "history")
    for column in columns or OUTLIER_COLUMNS:
        staged = remove_outliers(staged, column)
    return staged


def fill_medians(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls in numeric columns by the column's exact median, touching only columns that have nulls."""
    numeric = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    numeric = [c for c in numeric if c in df.columns]
    if not numeric:
        return df
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    filled = {}
    for column in [c for c in numeric if nulls[c]]:
        (median,) = column_quantiles(df, column, [0.5])
        if median is not None:
            filled[column] = F.coalesce(F.col(column), F.lit(median))
    return df.withColumns(filled) if filled else df


def quality_summary(df: DataFrame, ledger: str) -> DataFrame:
    """Rows, distinct orders / materials / plants and the posting date range of one ledger."""
    return df.agg(
        F.lit(ledger).alias("ledger"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(ORDER).alias("orders"),
        F.countDistinct("MATERIAL").alias("materials"),
        F.countDistinct("PLANT").alias("plants"),
        F.min("POSTINGDATE").alias("first_posting"),
        F.max("POSTINGDATE").alias("last_posting"),
    )
