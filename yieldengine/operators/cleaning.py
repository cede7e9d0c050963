"""Ledger cleaning: header, key and number normalisation, delete rules, filters and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from yieldengine.functions import to_double
from yieldengine.schema import NUMERIC_COLUMNS, ORDER, SEQ

KEY_COLUMNS = [ORDER, "PLANT", "MATERIAL"]


def normalise_headers(df: DataFrame) -> DataFrame:
    """Upper-case and trim every column name."""
    return df.select(*[F.col(f"`{name}`").alias(name.strip().upper()) for name in df.columns])


def normalise_key(df: DataFrame) -> DataFrame:
    """Order id as trimmed text. A null id stays null, so two unknown orders never join."""
    if ORDER not in df.columns:
        return df
    return df.withColumn(ORDER, F.trim(F.col(ORDER).cast("string")))


def coerce_numeric(df: DataFrame, columns: list[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """Make the numeric ledger columns doubles; text that is not a number becomes `fill` (None keeps null)."""
    wanted = [c for c in (columns or NUMERIC_COLUMNS) if c in df.columns]
    filled = {c: to_double(c) if fill is None else F.coalesce(to_double(c), F.lit(float(fill))) for c in wanted}
    return df.withColumns(filled) if filled else df


def _deleted(df: DataFrame) -> Column:
    return F.col("IS_DELETED").try_cast("boolean")


def clean_strict(df: DataFrame, report: Observation | None = None) -> DataFrame:
    """Normalise, coerce and keep only rows explicitly marked as not deleted; rows without an order id go too."""
    df = coerce_numeric(normalise_key(normalise_headers(df)))
    if report is not None:
        kept = ~_deleted(df) if "IS_DELETED" in df.columns else F.lit(True)
        df = df.observe(report, F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"))
    if "IS_DELETED" in df.columns:
        df = df.where(~_deleted(df))
    return df.where(F.col(ORDER).isNotNull())


def raw_ledger(df: DataFrame) -> DataFrame:
    """Minimal typing for totals over everything that was booked, deleted rows included."""
    return coerce_numeric(normalise_key(normalise_headers(df)), ["BFIN", "BFOUT", "MATERIALTHICKNESS"])


def drop_deleted_text(df: DataFrame) -> DataFrame:
    """Keep every row whose delete flag does not read TRUE; unknown flags are kept."""
    if "IS_DELETED" not in df.columns:
        return df
    flag = F.col("IS_DELETED").cast("string")
    return df.where(flag.isNull() | (F.upper(flag) != "TRUE"))


def parse_posting_date(df: DataFrame) -> DataFrame:
    if "POSTINGDATE" not in df.columns:
        return df
    return df.withColumn("POSTINGDATE", F.try_to_timestamp(F.col("POSTINGDATE").cast("string")))


def drop_missing_keys(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[c for c in KEY_COLUMNS if c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup over the business columns; the row sequence only breaks ties and is not compared."""
    business = [c for c in df.columns if c != SEQ]
    if SEQ not in df.columns:
        return df.dropDuplicates()
    return df.groupBy(*business).agg(F.min(SEQ).alias(SEQ))


def drop_negative_volume(df: DataFrame) -> DataFrame:
    """Keep rows whose volumes are known and not negative."""
    for column in ("BFIN", "BFOUT"):
        if column in df.columns:
            df = df.where(F.col(column) >= 0)
    return df


def clean_lenient(df: DataFrame, report: Observation | None = None) -> DataFrame:
    """The stricter row checks: flag text, dates, numbers, required keys, duplicates, negative volumes."""
    df = normalise_key(normalise_headers(df))
    if report is not None:
        df = df.observe(report, F.count(F.lit(1)).alias("rows"))
    df = coerce_numeric(parse_posting_date(drop_deleted_text(df)), fill=None)
    return drop_negative_volume(drop_duplicate_rows(drop_missing_keys(df)))


def matching(df: DataFrame, **values) -> DataFrame:
    """Conjunctive equality filter, e.g. ``matching(df, PLANT="1Y01", MATERIALTHICKNESS=4)``."""
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def matching_given(df: DataFrame, **values) -> DataFrame:
    """Equality filter that ignores values that are None and columns that are absent."""
    return matching(df, **{c: v for c, v in values.items() if v is not None and c in df.columns})


def order_rows(df: DataFrame, order_id: str) -> DataFrame:
    return matching(df, **{ORDER: str(order_id)})


def search_material(df: DataFrame, term: str, column: str = "MATERIAL", limit: int | None = None) -> DataFrame:
    """Case-insensitive substring search over a material column."""
    found = df.where(F.upper(F.col(column)).contains(term.upper()))
    return found if limit is None else found.orderBy(column).limit(limit)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column with its type and number of nulls, from a single pass."""
    columns = [c for c in df.columns if c != SEQ]
    types = dict(df.dtypes)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    profile = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), F.col(c).alias("null_count"))
        for c in columns
    ])
    return counts.select(F.inline(profile))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def display_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Choose and rename the columns that exist, in the given order."""
    return df.select(*[F.col(c).alias(label) for c, label in names.items() if c in df.columns])
