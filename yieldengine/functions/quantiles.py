"""Exact, linearly interpolated quantiles by range descent: no group's values are ever gathered or sorted.

The range of a group's values is cut into BINS equal parts, counted with a map-side sum; the part that holds a wanted
rank, shrunk to the smallest and largest value in it, is the next range, until it is a single value. A pass leaves about
one value in BINS, so a few passes settle any size, and ties settle at once. All groups and ranks share the passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.staging import stage

BINS = 4096


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Part of the range, non-decreasing in the value; halved where the range is wider than a double can say."""
    width = high - low
    share = F.when(width == float("inf"), (value * 0.5 - low * 0.5) / (high * 0.5 - low * 0.5)).otherwise((value - low) / width)
    return F.least(F.floor(share * F.lit(BINS)), F.lit(BINS - 1)).cast("int")


def _inside(values: DataFrame, open_ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the open range (_low, _high) of their group that holds them."""
    if keys:
        return values.join(open_ranks.select(*keys, "_low", "_high").distinct(), keys).where(
            F.col("_v").between(F.col("_low"), F.col("_high"))
        )
    # without groups there are as many ranges as wanted ranks, at most
    ranges = [(r["_low"], r["_high"]) for r in open_ranks.select("_low", "_high").distinct().collect()]
    spans = F.array(*[F.struct(F.lit(a).alias("_low"), F.lit(b).alias("_high")) for a, b in ranges])
    return values.select("_v", F.inline(spans)).where(F.col("_v").between(F.col("_low"), F.col("_high")))


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, names: dict[str, float]) -> DataFrame:
    """One row per key with a column per requested quantile, e.g. ``{"q25": 0.25, "q75": 0.75}``.

    Null and NaN values take no part, nor do groups with a null key. `df` is scanned once per pass: pass a staged table.
    """
    value = F.col(column).cast("double")
    values = df.where(value.isNotNull() & ~F.isnan(value)).select(*keys, value.alias("_v"))
    for key in keys:
        values = values.where(F.col(key).isNotNull())
    position = {label: F.lit(p) * (F.col("_n") - 1) for label, p in names.items()}
    wanted = F.array(*[
        F.struct(F.lit(f"{label}|{end}").alias("_rank"), rounding(at).alias("_at"))
        for label, at in position.items() for end, rounding in (("low", F.floor), ("high", F.ceil))
    ])
    groups = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    fields = [*keys, "_n", "_rank", "_at", "_low", "_high", "_below"]
    ranks = stage(
        groups.where("_n > 0").select(*keys, "_n", "_low", "_high", F.inline(wanted)).withColumn("_below", F.lit(0).cast("long"))
        .select(*fields), "ranks",
    )
    while not ranks.where("_low < _high").isEmpty():
        still_open = ranks.where("_low < _high")
        counted = (
            _inside(values, still_open, keys)
            .groupBy(*keys, "_low", "_high", _bin(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        )
        upto = F.sum("_c").over(
            Window.partitionBy(*keys, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        # at most BINS rows for each group and rank
        placed = still_open.join(counted, [*keys, "_low", "_high"]).withColumn("_upto", F.col("_below") + upto)
        narrowed = placed.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at"))).select(
            *keys, "_n", "_rank", "_at", F.col("_least").alias("_low"), F.col("_most").alias("_high"),
            (F.col("_upto") - F.col("_c")).alias("_below"),
        )
        ranks = stage(ranks.where("_low = _high").select(*fields).unionByName(narrowed), "ranks")

    def at_rank(name: str) -> Column:
        return F.max(F.when(F.col("_rank") == name, F.col("_low")))

    def quantile(label: str, p: float) -> Column:
        at, low, high = F.lit(p) * (F.max("_n") - 1), at_rank(f"{label}|low"), at_rank(f"{label}|high")
        return low + (at - F.floor(at)) * (high - low)

    found = ranks.groupBy(*keys).agg(*[quantile(label, p).alias(label) for label, p in names.items()])
    return found


#: Size of the sketch that brackets the quantiles of a whole column, and the share of rows to each side of them it leaves.
SKETCH, SLACK = 1024, 0.01


def column_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float]:
    """Exact quantiles of one column as driver scalars, nulls where there is no value; pass a staged table.

    The first pass takes count, range and a sketch, which brackets every quantile; the second counts what is below and
    above each bracket and its BINS parts. That leaves single values but where a part of a bracket holds several; those are
    descended into as in `grouped_quantiles`, and so is the side that holds a rank the sketch has missed.
    """
    value = F.col(column).cast("double")
    values = df.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("_v"))
    sketch = F.kll_sketch_agg_double("_v", SKETCH)
    ends = [min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-SLACK, SLACK)]
    # an empty sketch has no quantiles to ask for
    bounds = [F.when(F.count("_v") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(e))) for e in ends]
    n, low, high, *found = values.agg(F.count("_v"), F.min("_v"), F.max("_v"), *bounds).first()
    if not n:
        return [None] * len(probabilities)
    ranks = sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)})
    # a range of values and how many are below it, for every rank
    bracket = {}
    for p, a, b in zip(probabilities, found[::2], found[1::2]):
        for f in (math.floor, math.ceil):
            bracket[f(p * (n - 1))] = (a, b)
    at = {k: (*bracket[k], 0) for k in ranks}
    settled = {k: low for k in ranks if low == high}
    first = True
    while open_ := [k for k in ranks if k not in settled]:
        spans = sorted({at[k][:2] for k in open_})
        inside = F.col("_v").between(F.col("_low"), F.col("_high"))
        place = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), BINS).when(
            F.col("_low") == F.col("_high"), 0
        ).otherwise(_bin(F.col("_v"), F.col("_low"), F.col("_high")))
        span = F.array(*[F.struct(F.lit(i).alias("_span"), F.lit(a).alias("_low"), F.lit(b).alias("_high")) for i, (a, b) in enumerate(spans)])
        spread = values.select("_v", F.inline(span))
        counted = (
            (spread if first else spread.where(inside)).groupBy("_span", place.alias("_bin"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most")).collect()
        )  # at most BINS + 2 rows for each rank
        for k in open_:
            upto = at[k][2]
            for row in sorted((r for r in counted if spans[r["_span"]] == at[k][:2]), key=lambda r: r["_bin"]):
                if upto + row["c"] > k:
                    at[k] = (row["least"], row["most"], upto)
                    break
                upto += row["c"]
            if at[k][0] == at[k][1]:
                settled[k] = at[k][0]
        first = False

    def between(p: float) -> float:
        place = p * (n - 1)
        lower, upper = settled[math.floor(place)], settled[math.ceil(place)]
        return lower + (place - math.floor(place)) * (upper - lower)

    return [between(p) for p in probabilities]
