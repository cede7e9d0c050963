"""Where the planning history comes from: yearly ledgers, generic ledgers, or a saved summary."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from yieldengine.plans.datasets import prepare_dataset
from yieldengine.sources.ledgers import (
    NoLedger, available_years, is_missing, read_ledgers, read_raw_ledgers, read_year_ledgers,
)


@dataclass
class HistorySources:
    history: DataFrame | None
    raw_261: DataFrame | None
    raw_101: DataFrame | None


def rename_summary(summary: DataFrame) -> DataFrame:
    """A saved per-pair summary under the names the simulation reads."""
    return summary.withColumnsRenamed({"Mean_Yield": "Yield_Percentage", "Order_Count": "Historical_Orders"})


def load_history(
    spark: SparkSession, data_dir: str, year: str | None = None, summary_path: str | None = None
) -> HistorySources:
    """First source that is there wins. The raw pair is kept beside it for booked totals.

    Only a missing source is passed over. An error while a source is read or prepared is raised: falling through would
    answer from other, older data.
    """
    try:
        years = [year] if year else [r["year"] for r in available_years(spark, data_dir).collect()]
    except AnalysisException as error:
        if not is_missing(error):
            raise
        years = []

    def there(what: str, read):
        try:
            return read()
        except (NoLedger, AnalysisException) as error:
            if not is_missing(error):
                raise
            warnings.warn(f"no {what}: {error}", stacklevel=3)
            return None

    raw_261, raw_101 = there("raw ledgers", lambda: read_raw_ledgers(spark, data_dir, years)) or (None, None)
    pair = there("yearly ledgers", lambda: read_year_ledgers(spark, data_dir, years)) if years else None
    pair = pair or there("generic ledgers", lambda: read_ledgers(spark, f"{data_dir}/261.csv", f"{data_dir}/101.csv"))
    if pair:
        return HistorySources(prepare_dataset(*pair).history, raw_261, raw_101)
    summary = there("saved summary", lambda: spark.read.parquet(summary_path)) if summary_path else None
    return HistorySources(rename_summary(summary) if summary is not None else None, raw_261, raw_101)
