"""CSV and Parquet movement ledgers, their year discovery and the option lists."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldengine.operators.cleaning import normalise_headers, raw_ledger
from yieldengine.schema import ORDER, SEQ

# Naming of the yearly ledgers (movement type, then year), each one file or a folder of part files.
YEAR_LEDGER = r"(?i)^(.*(?:^|/)(101|261)_(\d{4})\.(csv|parquet))(?:/.*)?$"


class NoLedger(ValueError):
    """A ledger that is not there."""


def is_missing(error: Exception) -> bool:
    """Whether an error says that a source is not there; any other error is one of the work and must be raised."""
    return isinstance(error, NoLedger) or (
        isinstance(error, AnalysisException) and error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
    )


# Option lists and the ledger columns that feed them.
INPUT_OPTIONS = {
    "Input_Material": "MATERIAL", "Input_Specie": "MATERIALSPECIE", "Input_Grade": "TALLYGRADE",
    "Input_Plant": "PLANT", "Input_Thickness": "MATERIALTHICKNESS",
}
OUTPUT_OPTIONS = {"Output_Material": "MATERIAL", "Output_Specie": "MATERIALSPECIE", "Output_Grade": "TALLYGRADE"}


def _ledgers(spark: SparkSession, data_dir: str) -> DataFrame:
    """Yearly ledgers of a folder: path, kind, year, format. The content column is pruned, so nothing is read."""
    part = {name: F.regexp_extract("path", YEAR_LEDGER, i) for i, name in enumerate(("root", "kind", "year", "format"), 1)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(data_dir)
    return files.select(*[c.alias(n) for n, c in part.items()]).where(F.col("kind") != "").select(
        F.col("root").alias("path"), "kind", "year", F.lower("format").alias("format")
    ).distinct()


def available_years(spark: SparkSession, data_dir: str) -> DataFrame:
    """Years for which both ledgers exist, in order."""
    files = _ledgers(spark, data_dir)
    issued = files.where(F.col("kind") == "261").select("year")
    received = files.where(F.col("kind") == "101").select("year")
    return issued.intersect(received).orderBy("year")


def with_row_sequence(df: DataFrame, rank: Column | None = None) -> DataFrame:
    """Add the file row order: source rank, file, split offset, then position inside the split.

    The number within a split follows how splits are packed into tasks, so it only orders rows of one split.
    """
    return df.withColumn(SEQ, F.struct(
        (F.lit(0) if rank is None else rank).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ))


def read_ledger_csv(spark: SparkSession, path: str, rank: int = 0) -> DataFrame:
    """All columns as text under normalised headers; typing is a separate, tolerant step."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return normalise_headers(with_row_sequence(raw, F.lit(rank)))


def read_ledger_columns(spark: SparkSession, path: str, rank: int = 0) -> DataFrame:
    """A Parquet ledger in the same form as a CSV one: all columns as text."""
    raw = with_row_sequence(spark.read.parquet(path), F.lit(rank))
    return normalise_headers(raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns if c != SEQ], SEQ))


def read_ledgers(spark: SparkSession, path_261: str, path_101: str) -> tuple[DataFrame, DataFrame]:
    return read_ledger_csv(spark, path_261), read_ledger_csv(spark, path_101)


def read_year_ledgers(spark: SparkSession, data_dir: str, years: list[str]) -> tuple[DataFrame, DataFrame]:
    """Yearly ledgers, files or folders of part files, tagged with their year and unioned; columns may differ.

    A missing ledger is reported and skipped; it is an error when one side has none at all.
    """
    rows = _ledgers(spark, data_dir).where(F.col("year").isin([str(y) for y in years])).orderBy("format").collect()
    paths = {(r["kind"], r["year"]): r for r in rows}  # a year given in both formats is read as Parquet
    sides: dict[str, list[DataFrame]] = {"261": [], "101": []}
    for rank, year in enumerate(str(y) for y in years):
        for kind, parts in sides.items():
            if (kind, year) not in paths:
                warnings.warn(f"{kind}_{year} not found", stacklevel=2)
                continue
            found = paths[kind, year]
            read = read_ledger_csv if found["format"] == "csv" else read_ledger_columns
            ledger = read(spark, found["path"], rank)
            parts.append(ledger.withColumn("_SOURCE_YEAR", F.lit(year)))
    if not sides["261"] or not sides["101"]:
        raise NoLedger(f"could not load data for years: {years}")
    return _union(sides["261"]), _union(sides["101"])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_raw_ledgers(
    spark: SparkSession, data_dir: str, years: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Untrimmed pair for booked totals: deleted rows stay, nothing is aggregated."""
    if years:
        pair = read_year_ledgers(spark, data_dir, years)
    else:
        pair = read_ledgers(spark, f"{data_dir}/261.csv", f"{data_dir}/101.csv")
    return raw_ledger(pair[0]), raw_ledger(pair[1])


def write_ledger(df: DataFrame, path: str) -> None:
    """Columnar copy partitioned by source year, so later reads prune years and columns."""
    years = ["_SOURCE_YEAR"] if "_SOURCE_YEAR" in df.columns else []
    df.write.mode("overwrite").partitionBy(*years).parquet(path)


def read_ledger_parquet(spark: SparkSession, path: str, years: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("_SOURCE_YEAR").isin([str(y) for y in years])) if years else df


def _options(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """Distinct non-null values of several columns in one scan; duplicates go map-side before the shuffle."""
    present = {o: c for o, c in options.items() if c in df.columns}
    pairs = F.array(*[
        F.struct(F.lit(o).alias("option"), F.col(c).cast("string").alias("value")) for o, c in present.items()
    ])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()


def option_lists(ledger_261: DataFrame, ledger_101: DataFrame) -> DataFrame:
    """Sorted distinct values for the eight option lists."""
    return _options(ledger_261, INPUT_OPTIONS).unionByName(_options(ledger_101, OUTPUT_OPTIONS)).orderBy(
        "option", "value"
    )


def read_option_lists(spark: SparkSession, json_path: str) -> DataFrame:
    """Precomputed option lists: one JSON object of name to list."""
    df = spark.read.option("multiLine", True).json(json_path)
    lists = [
        F.struct(F.lit(c).alias("option"), F.col(c).cast("array<string>").alias("values")) for c in df.columns
    ]
    return df.select(F.inline(F.array(*lists))).select("option", F.explode("values").alias("value"))


def load_option_lists(
    spark: SparkSession, json_path: str | None, ledgers: tuple[DataFrame, DataFrame] | None
) -> DataFrame:
    """The precomputed lists if they are there, else the ledgers; the ledgers are then never touched."""
    if json_path:
        try:
            return read_option_lists(spark, json_path)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            warnings.warn(f"option lists not readable: {error}", stacklevel=2)
    if ledgers is None:
        return spark.createDataFrame([], "option string, value string")
    return option_lists(*ledgers)


def from_rows(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """Request rows given in code, typed by one of the request schemas; absent keys become null."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def demo_ledgers(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Worked example: 100 orders of 1000 BF, each giving four outputs (910 BF in all)."""
    order = F.format_string("MO%04d", F.col("id"))
    orders = spark.range(1, 101)
    inputs = orders.select(
        order.alias(ORDER), F.lit("KS").alias("Input_Material"), F.lit(1000.0).alias("Total_Input_BF")
    )
    # Outputs per order in board feet.
    parts = [("KS1C", 91.0), ("KS2C", 182.0), ("KS3C", 364.0), ("KS4C", 273.0)]
    each = F.array(*[
        F.struct(F.lit(m).alias("Output_Material"), F.lit(bf).alias("Total_Output_BF")) for m, bf in parts
    ])
    return inputs, orders.select(order.alias(ORDER), F.inline(each))
