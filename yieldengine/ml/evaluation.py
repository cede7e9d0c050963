"""Splits, folds, class weights, metrics and error tables. All repeatable: they depend on row keys, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.functions import repeatable_bucket
from yieldengine.staging import stage

TEST_PERCENT = 20
STRATA_BUCKETS = 4096


def with_split(df: DataFrame, keys: list[str], seed: int, test_percent: int = TEST_PERCENT) -> DataFrame:
    return df.withColumn("is_test", repeatable_bucket(keys, seed, 100) < test_percent)


def with_folds(df: DataFrame, keys: list[str], seed: int, folds: int) -> DataFrame:
    """Fold number 0..folds-1, independent of the split (the seed is shifted)."""
    return df.withColumn("fold", repeatable_bucket(keys, seed + 1, folds))


def with_stratified_split(
    df: DataFrame, label: str, keys: list[str], seed: int, test_percent: int = TEST_PERCENT
) -> DataFrame:
    """Hold out exactly the rounded share of every class.

    Each class is cut at a hash bucket: buckets below the cut are test rows without any ranking. The bucket where the
    share is reached is cut again by a second hash, and only the rows of one bucket of that, one in STRATA_BUCKETS
    squared of the class, are ranked. A class with most of the rows is therefore never sorted, nor a share of it.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    wanted = counts.select(label, F.floor(F.col("_c") * F.lit(test_percent / 100.0) + F.lit(0.5)).alias("_wanted"))
    edge, parts = df.join(stage(wanted, "strata"), label), []
    for level in range(2):
        below, above, edge = _cut(edge, label, repeatable_bucket(keys, seed + 1000 * level, STRATA_BUCKETS), df.columns)
        parts += [below.withColumn("is_test", F.lit(True)), above.withColumn("is_test", F.lit(False))]
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*keys))
    edge = edge.withColumn("is_test", rank <= F.col("_wanted")).drop("_wanted")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(edge)


def _cut(df: DataFrame, label: str, bucket: Column, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows below and above the bucket in which a class reaches its _wanted rows, and that bucket's with the rest."""
    hashed = df.withColumn("_bucket", bucket)
    counts = hashed.groupBy(label, "_wanted", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        counts.withColumn("_upto", F.sum("_c").over(order)).where(F.col("_upto") >= F.col("_wanted"))
        .groupBy(label).agg(F.min_by(
            F.struct(F.col("_bucket").alias("cut"), (F.col("_wanted") - F.col("_upto") + F.col("_c")).alias("rest")),
            "_bucket",
        ).alias("_at"))
    )
    placed = hashed.join(stage(cuts, "strata"), label)
    edge = placed.where(F.col("_bucket") == F.col("_at.cut"))
    return (
        placed.where(F.col("_bucket") < F.col("_at.cut")).select(*columns),
        placed.where(F.col("_bucket") > F.col("_at.cut")).select(*columns),
        edge.select(*columns, F.col("_at.rest").alias("_wanted")),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per class: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("weight", totals["n"] / (totals["k"] * F.col("rows")))


def test_results(scored: DataFrame, actual: str, predicted: str, keep: list[str] | None = None) -> DataFrame:
    """Actual, Predicted, Error and Error_Pct (null where the actual value is 0)."""
    error = F.col(actual) - F.col(predicted)
    return scored.select(
        *(keep or []),
        F.col(actual).alias("Actual"),
        F.col(predicted).alias("Predicted"),
        error.alias("Error"),
        (F.try_divide(error, F.col(actual)) * F.lit(100.0)).alias("Error_Pct"),
    )


def regression_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """r2, MAE, RMSE and MAPE (over positive actuals) in one pass."""
    return scored.agg(*metric_columns(actual, predicted))


def metric_columns(actual: str, predicted: str) -> list[Column]:
    y, p = F.col(actual), F.col(predicted)
    n = F.count(F.lit(1))
    residual = F.sum((y - p) * (y - p))
    percent_error = F.avg(F.when(y > 0, F.abs((y - p) / y))) * F.lit(100.0)
    return [
        n.alias("rows"),
        (F.lit(1.0) - F.try_divide(residual, F.var_pop(y) * n)).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.try_divide(residual, n.cast("double"))).alias("rmse"),
        percent_error.alias("mape"),
    ]


def error_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed, empty ones too, with the overall mean error.

    Without a value there is no bin; if all values are equal they are in the first.
    """
    span = stage(df.agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"),
    ).where(F.col("low").isNotNull()), "error-span")
    row = span.first()
    low, high, mean = row if row else (0.0, 0.0, 0.0)
    width = (high - low) / bins
    place = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width else F.lit(0)
    counted = df.where(F.col(column).isNotNull()).groupBy(
        F.least(place, F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    every = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.coalesce("_rows", F.lit(0)).alias("rows"), (F.lit(low) + F.lit(width) * F.col("bin")).alias("bin_from"),
        (F.lit(low) + F.lit(width) * (F.col("bin") + 1)).alias("bin_to"), F.lit(mean).alias("mean_error"),
    )


def display_sample(df: DataFrame, keys: list[str], rows: int, seed: int) -> DataFrame:
    """A repeatable sample of at most `rows` rows (all of them when there are fewer)."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(text)).limit(rows)
