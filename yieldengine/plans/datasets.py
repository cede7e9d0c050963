"""The composed preparation jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from yieldengine.operators.cleaning import clean_strict
from yieldengine.operators.encode import apply_encoders, fill_unknown, fit_encoders
from yieldengine.operators.history import clustered_sides, fill_medians, join_on_order, remove_outlier_chain
from yieldengine.operators.volume import with_yield
from yieldengine.staging import stage


@dataclass
class PreparedDataset:
    history: DataFrame
    encoders: DataFrame
    inputs: DataFrame
    outputs: DataFrame


def prepare_dataset(
    ledger_261: DataFrame, ledger_101: DataFrame, trim_outliers: bool = True
) -> PreparedDataset:
    """Ledgers to encoded history: clean, aggregate, join, yield, trim, encode, fill medians.

    The aggregates before the join are returned too (all orders, matched or not). Encoders, medians and bounds are
    fitted on all rows, before any train / test split. Each ledger is read once, to the states of its aggregates; the
    history is written once and everything after reads that.
    """
    inputs, outputs = clustered_sides(clean_strict(ledger_261), clean_strict(ledger_101))
    history = with_yield(join_on_order(inputs, outputs))
    history = remove_outlier_chain(history) if trim_outliers else stage(history, "history")
    history = fill_unknown(history)
    encoders = stage(fit_encoders(history).coalesce(1), "encoders")
    return PreparedDataset(fill_medians(apply_encoders(history, encoders)), encoders, inputs, outputs)
