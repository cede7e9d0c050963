"""Column helpers shared by the operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yieldengine.schema import SEQ


def to_double(name: str) -> Column:
    """Numeric coercion: text that is not a number, and NaN, become null."""
    value = F.col(f"`{name}`").try_cast("double")
    return F.when(~F.isnan(value), value)


def half_even(value: Column, digits: int) -> Column:
    """Round like numpy does (scale, nearest even, unscale); the added zero turns -0.0 into 0.0."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def board_feet() -> Column:
    """Thickness x width x length in inches over 144; blanks count as zero."""
    zero = F.lit(0.0)
    return (
        F.coalesce(F.col("MATERIALTHICKNESS"), zero)
        * F.coalesce(F.col("TALLYWIDTH"), zero)
        * F.coalesce(F.col("TALLYLENGTH"), zero)
    ) / F.lit(144.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, or 0 when the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def first_by(value: Column, seq: Column | None = None) -> Column:
    """First non-null value in row order. A null ordering key is skipped by min_by, so nulls never win."""
    seq = F.col(SEQ) if seq is None else seq
    return F.min_by(value, F.when(value.isNotNull(), seq))


def moments(value: Column, prefix: str) -> list[Column]:
    """Mergeable sums from which mean and sample deviation of any union of groups follow."""
    return [
        F.count(F.lit(1)).alias(f"{prefix}_n"),
        F.sum(value).alias(f"{prefix}_s1"),
        F.sum(value * value).alias(f"{prefix}_s2"),
    ]


def pooled_std(n: Column, s1: Column, s2: Column) -> Column:
    """Sample standard deviation from merged sums; null for fewer than two values."""
    spread = (s2 - s1 * s1 / n) / F.greatest(n - F.lit(1), F.lit(1))
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))))


def repeatable_bucket(keys: list[str], seed: int, buckets: int) -> Column:
    """Bucket 0..buckets-1 that depends only on the row's key and the seed, never on partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
