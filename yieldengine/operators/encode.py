"""Category encoding: sorted classes numbered from 0, looked up by join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.schema import ENCODED_CATEGORIES

UNKNOWN = "Unknown"


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = [c for c in (columns or ENCODED_CATEGORIES) if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in wanted}) if wanted else df


def fit_encoders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long table (column, value, code): per column the distinct values in order, coded 0, 1, 2, ...

    The distinct values are a dimension of the data, so the ranking handles a handful of rows per column.
    """
    wanted = [c for c in (columns or ENCODED_CATEGORIES) if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias("value"))
        for c in wanted
    ])
    distinct = df.select(F.inline(pairs)).distinct()
    code = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    return distinct.withColumn("code", code.cast("int"))


def apply_encoders(df: DataFrame, encoders: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add `<column>_Encoded`; a value the encoders have not seen gets code 0.

    `encoders` should be a staged or saved table: Spark then knows its size and broadcasts it below the session's
    threshold, and joins by shuffle above it.
    """
    wanted = [c for c in (columns or ENCODED_CATEGORIES) if c in df.columns]
    df = fill_unknown(df, wanted)
    for column in wanted:
        lookup = encoders.where(F.col("column") == column).select(
            F.col("value").alias(column), F.col("code").alias(f"{column}_Encoded")
        )
        df = df.join(lookup, column, "left").withColumn(
            f"{column}_Encoded", F.coalesce(F.col(f"{column}_Encoded"), F.lit(0))
        )
    return df


def encoder_classes(encoders: DataFrame) -> DataFrame:
    """Column to its ordered class list."""
    pairs = F.sort_array(F.collect_list(F.struct("code", "value")))
    return encoders.groupBy("column").agg(F.transform(pairs, lambda p: p["value"]).alias("classes"))


def decode(df: DataFrame, encoders: DataFrame, column: str, code: str, name: str) -> DataFrame:
    """Class name of a code; a code outside the classes reads `Material_<code>`."""
    lookup = encoders.where(F.col("column") == column).select(F.col("code").alias(code), F.col("value").alias(name))
    fallback = F.concat(F.lit("Material_"), F.col(code).cast("string"))
    return df.join(lookup, code, "left").withColumn(name, F.coalesce(F.col(name), fallback))
