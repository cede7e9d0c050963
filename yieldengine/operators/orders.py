"""Per-order drill-down over filtered ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.functions import half_even
from yieldengine.schema import ORDER, SEQ


def common_orders(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(ORDER).intersect(right.select(ORDER))


def within_orders(df: DataFrame, orders: DataFrame) -> DataFrame:
    return df.join(orders.select(ORDER), ORDER, "left_semi")


def volume_per_order(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(ORDER).agg(F.sum(column).alias(column))


def ledger_totals(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """Total BFIN and BFOUT of the two (filtered) ledgers on one row."""
    bfout = ledger_101.agg(F.coalesce(F.sum("BFOUT"), F.lit(0.0))).scalar()
    return ledger_261.agg(
        F.coalesce(F.sum("BFIN"), F.lit(0.0)).alias("total_bfin"), F.count(F.lit(1)).alias("input_rows"),
    ).withColumn("total_bfout", bfout)


def materials_in_order(df: DataFrame, part: Column) -> DataFrame:
    """Every material of an order with its position in row order (from 1), repeats included; one row each.

    `part` is a coarse, order-preserving prefix of the row sequence. Positions are the counts of an order's earlier
    parts plus the place in the row's own part, so an order with most rows is never sorted in one task.
    """
    rows = df.where(F.col("MATERIAL").isNotNull()).select(ORDER, SEQ, "MATERIAL", part.alias("_part"))
    counts = rows.groupBy(ORDER, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(ORDER).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(
        F.col(ORDER).alias("_order"), F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead")
    )
    place = F.row_number().over(Window.partitionBy(ORDER, "_part").orderBy(SEQ))
    return (
        rows.withColumn("_place", place)
        .join(ahead, (F.col(ORDER) == F.col("_order")) & F.col("_part").eqNullSafe(F.col("_of")))
        .select(ORDER, (F.col("_ahead") + F.col("_place")).alias("position"), "MATERIAL")
    )


#: Positions of an order that make one list.
BLOCK_POSITIONS = 1000


def materials_per_order(df: DataFrame, part: Column) -> DataFrame:
    """The same as lists: one row per order and block (from 0) of BLOCK_POSITIONS positions, so every list is bounded."""
    placed = materials_in_order(df, part).withColumn("block", F.floor((F.col("position") - 1) / BLOCK_POSITIONS).cast("int"))
    in_order = F.sort_array(F.collect_list(F.struct("position", F.col("MATERIAL").alias("material"))))
    return placed.groupBy(ORDER, "block").agg(F.transform(in_order, lambda p: p["material"]).alias("Materials"))


def distinct_materials_per_order(df: DataFrame) -> DataFrame:
    """The different materials of an order in first-seen order."""
    first_seen = df.where(F.col("MATERIAL").isNotNull()).groupBy(ORDER, "MATERIAL").agg(F.min(SEQ).alias("seq"))
    in_order = F.sort_array(F.collect_list(F.struct(F.col("seq"), F.col("MATERIAL").alias("material"))))
    return first_seen.groupBy(ORDER).agg(F.transform(in_order, lambda p: p["material"]).alias("KD_Materials"))


def first_material_per_order(df: DataFrame) -> DataFrame:
    """Material of an order's first row (null if that row has none)."""
    return df.groupBy(ORDER).agg(F.min_by("MATERIAL", SEQ).alias("KS_Material"))


def input_then_output_materials(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """The order's input material followed by its different output materials."""
    joined = first_material_per_order(ledger_261).join(distinct_materials_per_order(ledger_101), ORDER, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        ORDER, F.concat(F.array("KS_Material"), F.coalesce("KD_Materials", none)).alias("Materials")
    )


def order_yield_summary(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """Per order: first input material, that material's BFIN, total BFOUT and the resulting yield."""
    per_material = ledger_261.groupBy(ORDER, "MATERIAL").agg(F.sum("BFIN").alias("bfin"), F.min(SEQ).alias("seq"))
    first = per_material.groupBy(ORDER).agg(
        F.min_by("MATERIAL", "seq").alias("KS_Material"), F.min_by("bfin", "seq").alias("KS_BFIN")
    )
    joined = first.join(volume_per_order(ledger_101, "BFOUT"), ORDER, "left")
    bfout = F.coalesce(F.col("BFOUT"), F.lit(0.0))
    share = F.when(F.col("KS_BFIN") > 0, half_even(bfout / F.col("KS_BFIN") * F.lit(100.0), 2))
    return joined.select(
        ORDER, "KS_Material", "KS_BFIN", bfout.alias("Total_BFOUT"), share.alias("Yield_Percentage")
    )


def order_output_mix(ledger_101: DataFrame) -> DataFrame:
    """Per order and output material: volume and its share of the order."""
    per_material = (
        ledger_101.where(F.col("MATERIAL").isNotNull()).groupBy(ORDER, "MATERIAL")
        .agg(F.sum("BFOUT").alias("Total_BFOUT"))
    )
    of_order = F.sum("Total_BFOUT").over(Window.partitionBy(ORDER))
    share = half_even(F.try_divide(F.col("Total_BFOUT"), of_order) * F.lit(100.0), 2)
    return per_material.withColumn("Input_Percentage", share)
