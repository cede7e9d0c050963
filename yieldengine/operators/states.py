"""Mergeable states of the order aggregates: a ledger is read once, and a year can be read again by itself.

A state holds, per order (inputs) or per order, material and grade (outputs), every volume that the ledger might be
measured by, the first values with their row order, and sums with counts. States of parts of a ledger merge into those of
the whole. Which volume counts is decided once for all states, from their totals; the ledger is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldengine.functions import board_feet
from yieldengine.operators.volume import not_negative
from yieldengine.schema import CATEGORY_COLUMNS, DIMENSION_COLUMNS, INPUT_NAMES, ORDER, OUTPUT_NAMES, SEQ, has

_KEYS = {"inputs": [ORDER], "outputs": [ORDER, "MATERIAL", "TALLYGRADE"]}


def _volumes(df: DataFrame, sources: list[str], needed: str) -> list[Column]:
    """raw_X and sum_X of the volume columns there are, and sum_dims where the dimensions are."""
    there = [c for c in sources if c in df.columns]
    if not there and not has(df, *DIMENSION_COLUMNS):
        raise ValueError(f"cannot derive {needed}: its columns and the dimension columns are missing")
    out = []
    for c in there:
        out += [F.sum(c).alias(f"raw_{c}"), F.sum(not_negative(F.coalesce(F.col(c), F.lit(0.0)))).alias(f"sum_{c}")]
    if has(df, *DIMENSION_COLUMNS):
        out.append(F.sum(not_negative(board_feet())).alias("sum_dims"))
    return out


def _first(column: str) -> Column:
    """The first known value with its place; merged by the same minimum."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(F.col(SEQ).alias("seq"), F.col(column).alias("value")))).alias(f"first_{column}")


def _means(df: DataFrame) -> list[Column]:
    return [x for c in DIMENSION_COLUMNS if c in df.columns for x in (F.sum(c).alias(f"total_{c}"), F.count(c).alias(f"count_{c}"))]


def input_states(df: DataFrame) -> DataFrame:
    """One row per order of a cleaned 261 ledger, or of a part of it."""
    firsts = [_first(c) for c in CATEGORY_COLUMNS if c in df.columns]
    return df.groupBy(ORDER).agg(*_volumes(df, ["BFIN"], "BFIN"), *firsts, *_means(df))


def output_states(df: DataFrame) -> DataFrame:
    """One row per order, output material and grade of a cleaned 101 ledger, or of a part of it."""
    df = df.where(F.col("MATERIAL").isNotNull() & F.col(ORDER).isNotNull())
    keys = [c for c in _KEYS["outputs"] if c in df.columns]
    specie = [_first("MATERIALSPECIE")] if "MATERIALSPECIE" in df.columns else []
    return df.groupBy(*keys).agg(*_volumes(df, ["BFOUT", "BFIN"], "BFOUT"), *specie, *_means(df))


def merge_states(states: DataFrame, side: str) -> DataFrame:
    """States of parts, put together: one row per key."""
    keys = [c for c in _KEYS[side] if c in states.columns]
    merged = [F.min(c).alias(c) if c.startswith("first_") else F.sum(c).alias(c) for c in states.columns if c.split("_")[0] in ("first", "raw", "sum", "total", "count")]
    return states.groupBy(*keys).agg(*merged)


def _chosen(rows: DataFrame, sources: list[str], usable: Callable[[Column], Column], kind: str = "sum") -> Column:
    """The volume that the whole table is measured by, or what else (`kind`) goes with that volume."""
    missing = F.raise_error(F.lit("cannot derive a volume: dimension columns are missing"))
    type_of = dict(rows.dtypes)
    there = [c for c in sources if f"raw_{c}" in rows.columns]
    kept = [c for c in (*there, "dims") if f"{kind}_{c}" in rows.columns]
    fallback = F.col(f"{kind}_dims") if "dims" in kept else missing.cast(type_of[f"{kind}_{kept[0]}"])
    chosen = None
    for c in there:
        test = usable(rows.agg(F.coalesce(F.sum(f"raw_{c}"), F.lit(0.0)).alias("total")).scalar())
        value = F.col(f"{kind}_{c}")
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return fallback if chosen is None else chosen.otherwise(fallback)


def _mean(columns: list[str], names: dict[str, str], merged: bool) -> list[Column]:
    add = F.sum if merged else F.col
    return [F.try_divide(add(f"total_{c}"), add(f"count_{c}")).alias(names[c]) for c in DIMENSION_COLUMNS if f"total_{c}" in columns]


def input_candidates(states: DataFrame) -> DataFrame:
    """One row per order from states of one row per order: the aggregates, with every volume they might be measured by."""
    firsts = [F.col(f"first_{c}.value").alias(INPUT_NAMES[c]) for c in CATEGORY_COLUMNS if f"first_{c}" in states.columns]
    return states.select(ORDER, *_volume_columns(states), *firsts, *_mean(states.columns, INPUT_NAMES, False))


def output_candidates(states: DataFrame) -> DataFrame:
    """One row per order and output material from states of one row per key: the aggregates, with every volume they might
    be measured by and the dominant grade by each. Rows stay where their order is."""
    volumes = _volume_columns(states)
    grades = []
    if "TALLYGRADE" in states.columns:
        known = F.col("TALLYGRADE").isNotNull()
        grades = [
            F.min_by("TALLYGRADE", F.when(known, F.struct(-F.col(c), F.col("TALLYGRADE")))).alias(f"grade_{c.removeprefix('sum_')}")
            for c in volumes if c.startswith("sum_")
        ]
    specie = [F.min("first_MATERIALSPECIE")["value"].alias("Output_Specie")] if "first_MATERIALSPECIE" in states.columns else []
    return states.repartition(ORDER).groupBy(ORDER, F.col("MATERIAL").alias("Output_Material")).agg(
        *[F.sum(c).alias(c) for c in volumes], *specie, *_mean(states.columns, OUTPUT_NAMES, True), *grades,
    )


def _volume_columns(states: DataFrame) -> list[str]:
    return [c for c in states.columns if c.startswith(("raw_", "sum_"))]


def chosen_inputs(candidates: DataFrame) -> DataFrame:
    """The staged candidates with the volume that the whole table is measured by."""
    names = [c for c in candidates.columns if c not in (ORDER, *_volume_columns(candidates))]
    return candidates.select(ORDER, _chosen(candidates, ["BFIN"], lambda total: total != 0).alias("Total_Input_BF"), *names)


def chosen_outputs(candidates: DataFrame) -> DataFrame:
    """The same for outputs, with the dominant grade by that volume."""
    def of(kind: str) -> Column:
        return _chosen(candidates, ["BFOUT", "BFIN"], lambda total: total > 0, kind)

    grades = [c for c in candidates.columns if c.startswith("grade_")]
    names = [c for c in candidates.columns if c not in (ORDER, "Output_Material", *_volume_columns(candidates), *grades)]
    return candidates.select(
        ORDER, "Output_Material", of("sum").alias("Total_Output_BF"), *names,
        (of("grade") if grades else F.lit("N/A")).alias("Output_Grade"),
    )


def inputs_of(states: DataFrame) -> DataFrame:
    """What `aggregate_inputs` gives for the ledger that the staged states (one per order) are of."""
    return chosen_inputs(input_candidates(states))


def outputs_of(states: DataFrame) -> DataFrame:
    """What `aggregate_outputs` gives for the ledger that the staged states (one per key) are of."""
    return chosen_outputs(output_candidates(states))


def refresh_year(states: DataFrame, path: str, year: str) -> None:
    """Put the states of one year into a folder of yearly states, in place of what it held of that year."""
    states.withColumn("_year", F.lit(str(year))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_year").parquet(path)


def read_states(spark: SparkSession, path: str, side: str, years: list[str] | None = None) -> DataFrame:
    """The merged states of all years of a folder, or of some; an order with lines in several years is one."""
    rows = spark.read.parquet(path)
    if years is not None:
        rows = rows.where(F.col("_year").cast("string").isin([str(y) for y in years]))
    return merge_states(rows, side)
