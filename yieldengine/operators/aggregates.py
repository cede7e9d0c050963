"""Ledger rows to order grain (inputs) and order x material grain (outputs).

All groupings are plain aggregates with a map-side combine, so an order or material that holds a large share of the
ledger is reduced on every executor before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.functions import first_by
from yieldengine.operators.volume import derive_input_volume, derive_output_volume
from yieldengine.schema import (
    CATEGORY_COLUMNS, DIMENSION_COLUMNS, INPUT_NAMES, ORDER, OUTPUT_NAMES, SEQ,
)


def aggregate_inputs(df: DataFrame) -> DataFrame:
    """One row per order: total BFIN, first material / species / grade / plant, mean dimensions."""
    df = derive_input_volume(df)
    firsts = [c for c in CATEGORY_COLUMNS if c in df.columns]
    means = [c for c in DIMENSION_COLUMNS if c in df.columns]
    return df.groupBy(ORDER).agg(
        F.sum("BFIN").alias("Total_Input_BF"),
        *[first_by(F.col(c)).alias(INPUT_NAMES[c]) for c in firsts],
        *[F.avg(c).alias(INPUT_NAMES[c]) for c in means],
    )


def aggregate_outputs(df: DataFrame, with_grade: bool = True) -> DataFrame:
    """One row per order and output material: total BFOUT, first species, mean dimensions, dominant grade.

    `with_grade=False` leaves the grade out and with it the aggregation level it needs.

    The dominant grade is the one with the largest volume in the group, the smallest name on a tie. Volumes are summed
    per grade first; the second level merges those few rows, so no separate ranking or join is needed.
    """
    df = derive_output_volume(df).where(F.col("MATERIAL").isNotNull() & F.col(ORDER).isNotNull())
    has_grade, has_specie = "TALLYGRADE" in df.columns, "MATERIALSPECIE" in df.columns
    means = [c for c in DIMENSION_COLUMNS if c in df.columns]
    grade_keys = ["TALLYGRADE"] if has_grade else []
    specie = []
    if has_specie:
        known = F.col("MATERIALSPECIE").isNotNull()
        specie = [
            first_by(F.col("MATERIALSPECIE")).alias("_specie"),
            F.min(F.when(known, F.col(SEQ))).alias("_specie_seq"),
        ]
    if not with_grade:
        return df.groupBy(ORDER, F.col("MATERIAL").alias("Output_Material")).agg(
            F.sum("BFOUT").alias("Total_Output_BF"),
            *([first_by(F.col("MATERIALSPECIE")).alias("Output_Specie")] if has_specie else []),
            *[F.avg(c).alias(OUTPUT_NAMES[c]) for c in means],
        )
    by_grade = df.groupBy(ORDER, "MATERIAL", *grade_keys).agg(
        F.sum("BFOUT").alias("_bf"),
        *specie,
        *[F.sum(c).alias(f"_sum_{c}") for c in means],
        *[F.count(c).alias(f"_n_{c}") for c in means],
    )
    grade = F.lit("N/A")
    if has_grade:
        grade = F.min_by(
            F.col("TALLYGRADE"),
            F.when(F.col("TALLYGRADE").isNotNull(), F.struct(-F.col("_bf"), F.col("TALLYGRADE"))),
        )
    merged = by_grade.groupBy(ORDER, F.col("MATERIAL").alias("Output_Material")).agg(
        F.sum("_bf").alias("Total_Output_BF"),
        *([F.min_by("_specie", "_specie_seq").alias("Output_Specie")] if has_specie else []),
        *[
            F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(OUTPUT_NAMES[c])
            for c in means
        ],
        *([grade.alias("Output_Grade")] if has_grade else []),
    )
    return merged if has_grade else merged.withColumn("Output_Grade", grade)


def order_inputs_simple(df: DataFrame) -> DataFrame:
    """Order grain for the four-feature model: total BFIN with first plant, material and thickness."""
    return df.groupBy(ORDER).agg(
        F.sum("BFIN").alias("Total_Input_BF"),
        first_by(F.col("PLANT")).alias("Plant"),
        first_by(F.col("MATERIAL")).alias("Input_Material"),
        first_by(F.col("MATERIALTHICKNESS")).alias("Thickness"),
    )


def order_outputs_simple(df: DataFrame) -> DataFrame:
    return df.groupBy(ORDER).agg(F.sum("BFOUT").alias("Total_Output_BF"))
