"""Feature vectors from encoded history or request rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.operators.encode import apply_encoders
from yieldengine.operators.history import fill_medians

# Features of the smaller order-grain model.
SIMPLE_FEATURES = ["Total_Input_BF", "Plant_Encoded", "Input_Material_Encoded", "Thickness"]


def prepare_features(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Keep the features that exist and fill their gaps with the column median."""
    available = [c for c in features if c in df.columns]
    return fill_medians(df, available), available


def complete_features(df: DataFrame, features: list[str]) -> DataFrame:
    """For scoring: absent features become 0 and nulls become 0."""
    zero = F.lit(0.0)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), zero) if c in df.columns else zero for c in features
    })


def encode_requests(requests: DataFrame, encoders: DataFrame, features: list[str]) -> DataFrame:
    return complete_features(apply_encoders(requests, encoders), features)

