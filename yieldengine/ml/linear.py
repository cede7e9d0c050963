"""Ridge regression by sufficient statistics: one aggregate gives counts, sums and products per part of the rows.

The statistics of a training part are the total less the fold's, so the full fit and every fold come from the same
pass, as do their r2. The driver solves systems as large as the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, sums and products of (features..., target) over some rows."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)


@dataclass
class RidgeModel:
    features: list[str]
    weights: list[float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [F.lit(w) * F.col(f).cast("double") for w, f in zip(self.weights, self.features)]
        return df.withColumn("prediction", sum(terms, F.lit(self.intercept)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.features, self.weights, self.intercept)], "features array<string>, weights array<double>, intercept double"
        )

    @classmethod
    def from_table(cls, rows: DataFrame) -> RidgeModel:
        row = rows.first()
        return cls(list(row["features"]), list(row["weights"]), row["intercept"])


def centres(rows: DataFrame, columns: list[str]) -> list[float]:
    """The columns' means; products are summed of differences from them, which keeps their digits."""
    return [x or 0.0 for x in rows.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()]


def moments_table(rows: DataFrame, columns: list[str], part: str, centre: list[float]) -> DataFrame:
    """One row per value of `part`: n, s_i and p_i_j of the columns less their centres."""
    shifted = [F.col(c).cast("double") - F.lit(m) for c, m in zip(columns, centre)]
    sums = [F.sum(x).alias(f"s_{i}") for i, x in enumerate(shifted)]
    products = [F.sum(x * y).alias(f"p_{i}_{j}") for i, x in enumerate(shifted) for j, y in enumerate(shifted) if i <= j]
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def moments_by_part(rows: DataFrame, columns: list[str], part: str, centre: list[float]) -> dict[int, Moments]:
    size, out = len(columns), {}
    for row in moments_table(rows, columns, part, centre).collect():
        products = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                products[i, j] = products[j, i] = row[f"p_{i}_{j}"]
        out[row[part]] = Moments(row["n"], np.array([row[f"s_{i}"] for i in range(size)]), products)
    return out


def solve(known: Moments, features: list[str], centre: list[float], alpha: float) -> RidgeModel:
    """The closed form on features scaled to unit population deviation; a constant feature has weight 0."""
    d, n = len(features), max(known.n, 1.0)
    mean = known.sums / n
    cross = known.products - np.outer(known.sums, known.sums) / n
    spread = np.sqrt(np.maximum(np.diag(cross)[:d] / n, 0.0))
    scale = np.where(spread > 1e-12 * (1.0 + np.abs(mean[:d])), spread, np.inf)
    gram = cross[:d, :d] / np.outer(scale, scale) + alpha * np.eye(d)
    weights = np.linalg.solve(gram, cross[:d, d] / scale) / scale
    shift = mean + np.array(centre)
    return RidgeModel(features, [float(w) for w in weights], float(shift[d] - weights @ shift[:d]))


def r2(model: RidgeModel, rows: Moments, centre: list[float]) -> float | None:
    """r2 over rows known by their moments alone."""
    w = np.array([*model.weights, -1.0])
    shift = model.intercept + w @ np.array(centre)  # the error at the centres
    error = w @ rows.products @ w + 2 * shift * (w @ rows.sums) + rows.n * shift * shift
    spread = rows.products[-1, -1] - rows.sums[-1] ** 2 / rows.n if rows.n else 0.0
    return float(1.0 - error / spread) if spread > 0 else None
