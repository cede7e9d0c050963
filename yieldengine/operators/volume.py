"""Board-foot sources and the yield column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldengine.functions import board_feet, safe_ratio
from yieldengine.schema import DIMENSION_COLUMNS, has


def not_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _table_total(df: DataFrame, column: str) -> Column:
    """The column's sum over the whole table as a scalar subquery, no join: another scan of the table for this column and
    what its filters read. Aggregates that are to read a ledger once use `states`."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total")).scalar()


def _from_dimensions(df: DataFrame, target: str) -> Column:
    if has(df, *DIMENSION_COLUMNS):
        return board_feet()
    return F.raise_error(F.lit(f"cannot derive {target}: dimension columns are missing")).cast("double")


def derive_input_volume(df: DataFrame) -> DataFrame:
    """BFIN, or thickness x width x length / 144 when the table carries no BFIN at all."""
    if "BFIN" not in df.columns:
        if not has(df, *DIMENSION_COLUMNS):
            raise ValueError("cannot derive BFIN: dimension columns are missing")
        return df.withColumn("BFIN", not_negative(board_feet()))
    chosen = F.when(_table_total(df, "BFIN") == 0, _from_dimensions(df, "BFIN")).otherwise(F.col("BFIN"))
    return df.withColumn("BFIN", not_negative(chosen))


def derive_output_volume(df: DataFrame) -> DataFrame:
    """BFOUT if the table has any, else BFIN if the table has any, else dimensions. Decided once per table."""
    sources = [c for c in ("BFOUT", "BFIN") if c in df.columns]
    if not sources and not has(df, *DIMENSION_COLUMNS):
        raise ValueError("cannot derive BFOUT: BFOUT, BFIN and dimension columns are missing")
    chosen = None
    for column in sources:
        usable, value = _table_total(df, column) > 0, F.coalesce(F.col(column), F.lit(0.0))
        chosen = F.when(usable, value) if chosen is None else chosen.when(usable, value)
    fallback = _from_dimensions(df, "BFOUT")
    chosen = fallback if chosen is None else chosen.otherwise(fallback)
    return df.withColumn("BFOUT", not_negative(chosen))


def with_yield(df: DataFrame) -> DataFrame:
    """Output over input in percent; 0 where nothing was consumed."""
    ratio = safe_ratio(F.col("Total_Output_BF"), F.col("Total_Input_BF"))
    return df.withColumn("Yield_Percentage", ratio * F.lit(100.0))


def with_valid_yield(df: DataFrame) -> DataFrame:
    """Unguarded yield, keeping only 0 < yield <= 100 (a zero input gives null and is dropped)."""
    ratio = F.try_divide(F.col("Total_Output_BF"), F.col("Total_Input_BF")) * F.lit(100.0)
    return df.withColumn("Yield_Percentage", ratio).where(
        (F.col("Yield_Percentage") > 0) & (F.col("Yield_Percentage") <= 100)
    )
