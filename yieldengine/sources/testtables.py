"""Movement ledgers read out of the star-schema test tables.

`ledger_261` / `ledger_101` split the line items by status. `full_ledgers` books every line item on both sides, with an
output volume close to the input, which gives the narrow yields real ledgers have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldengine.schema import ORDER, SEQ


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a test table; its schema is inferred from the footers once and reused."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def movements(spark: SparkSession, sf_dir: str, kept: Column | None = None) -> DataFrame:
    """Line items in ledger roles. `kept` is applied below the joins, so it reaches the scan."""
    lines = table(spark, sf_dir, "lineitem")
    if kept is not None:
        lines = lines.where(kept)
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.col("n_name").alias("PLANT"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("MATERIAL"), F.col("p_type").alias("MATERIALSPECIE"),
        F.col("p_size").cast("double").alias("MATERIALTHICKNESS"),
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").cast("string").alias(ORDER),
            "MATERIAL", "MATERIALSPECIE",
            F.col("l_returnflag").alias("TALLYGRADE"),
            "PLANT", "MATERIALTHICKNESS",
            F.col("l_quantity").alias("TALLYLENGTH"),
            F.col("l_linenumber").cast("double").alias("TALLYWIDTH"),
            F.col("l_quantity").alias("VOLUME"),
            F.col("l_discount").alias("LOSS"),
            (F.col("l_linenumber") == 7).alias("IS_DELETED"),
            F.col("l_shipdate").alias("POSTINGDATE"),
            F.year("l_shipdate").cast("string").alias("SOURCE_YEAR"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias(SEQ),
        )
    )


def ledger_261(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movements(spark, sf_dir, F.col("l_linestatus") == "F")
    return rows.withColumnRenamed("VOLUME", "BFIN").drop("LOSS")


def ledger_101(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movements(spark, sf_dir, F.col("l_linestatus") == "O")
    return rows.withColumnRenamed("VOLUME", "BFOUT").drop("LOSS")


def sequence_part() -> Column:
    """Coarse, order-preserving prefix of the row sequence."""
    seq = F.col(SEQ)
    return seq["l_linenumber"].cast("bigint") * F.lit(1 << 40) + F.floor(seq["l_partkey"] / F.lit(65536))


def full_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line as input and output. One of six output materials per order, by order number.

    The loss is the line's discount in 64ths per percent point, so volumes are exact binary fractions.
    """
    rows = movements(spark, sf_dir)
    kept = F.lit(1.0) - F.rint(F.col("LOSS") * F.lit(100.0)) / F.lit(64.0)
    product = F.concat(F.lit("Product#"), (F.col(ORDER).cast("bigint") % 6).cast("string"))
    received = rows.withColumns({"MATERIAL": product, "BFOUT": F.col("VOLUME") * kept}).drop("VOLUME", "LOSS")
    return rows.withColumnRenamed("VOLUME", "BFIN").drop("LOSS"), received
