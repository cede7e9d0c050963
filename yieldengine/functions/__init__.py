from yieldengine.functions.expressions import (
    board_feet, clip, first_by, half_even, moments, pooled_std, repeatable_bucket, safe_ratio, to_double,
)
from yieldengine.functions.quantiles import column_quantiles, grouped_quantiles
from yieldengine.functions.scoring import blended_yield, confidence, yield_range

__all__ = [
    "blended_yield", "board_feet", "clip", "column_quantiles", "confidence", "first_by", "grouped_quantiles",
    "half_even", "moments", "pooled_std", "repeatable_bucket", "safe_ratio", "to_double", "yield_range",
]
