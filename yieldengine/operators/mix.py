"""Output mix: volume and count shares, filtered distributions, wastage allocation, production orders.

Requests never meet raw history rows. History is first reduced to one row per combination of input attributes and
output (its size follows the product catalogue, not the ledger), and requests join that.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldengine.functions import half_even, moments, pooled_std, safe_ratio
from yieldengine.schema import ORDER

DEFAULT_WASTAGE_PCT = 9.0
# Optional request filters and the history / ledger columns they apply to.
HISTORY_FILTERS = {
    "thickness": "Input_Thickness", "grade": "Input_Grade", "species": "Input_Specie", "plant": "Input_Plant",
}
LEDGER_FILTERS = {
    "thickness": "MATERIALTHICKNESS", "grade": "TALLYGRADE", "species": "MATERIALSPECIE", "plant": "PLANT",
}


def share_of(value: Column, *partition: str) -> Column:
    """Percent of the partition's total, null when that total is 0."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*partition))) * F.lit(100.0)


def _optional_match(
    requests: DataFrame, facts: DataFrame, filters: dict[str, str], material: str, keys: list[str]
) -> DataFrame:
    """request_id with the facts under its material and every filter it gives; a null filter accepts anything.

    `facts` holds sums at the finest grain. Which filters a request gives is a pattern, a bit for each; the facts are summed
    to every pattern at once by grouping sets, one pass and one shuffle, and joined by equality on the pattern and on
    all filters. So no pair is joined to be thrown away, and a material with most rows is spread over its plants,
    grades and species. `keys` are kept beside the sums.
    """
    columns = [c for c in filters.values() if c in facts.columns]
    given = {g: c for g, c in filters.items() if g in requests.columns and c in columns}
    measures = [c for c in facts.columns if c not in (material, *columns, *keys)]
    sums = [F.sum(c).alias(c) for c in measures]
    if not given:
        cells = facts.groupBy(material, *keys).agg(*sums).withColumn("_pattern", F.lit(0))
    else:
        subsets = [s for n in range(len(given) + 1) for s in combinations(given.values(), n)]
        pattern = sum(((1 - F.grouping(c).cast("int")) * (1 << i) for i, c in enumerate(given.values())), F.lit(0))
        cells = facts.groupingSets([[material, *s, *keys] for s in subsets], material, *given.values(), *keys).agg(*sums, pattern.alias("_pattern"))
    asked = sum((F.col(g).isNotNull().cast("int") * (1 << i) for i, g in enumerate(given)), F.lit(0))
    on = (F.col("r.material") == F.col(f"h.{material}")) & (F.col("r._pattern") == F.col("h._pattern"))
    for g, c in given.items():
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"h.{c}"))
    joined = requests.withColumn("_pattern", asked).alias("r").join(cells.alias("h"), on)
    return joined.select("r.request_id", *[F.col(f"h.{c}").alias(c) for c in (*keys, *measures)])


def share_by_count(outputs: DataFrame) -> DataFrame:
    """Distinct orders per output material and their share of the sum of those counts."""
    counted = outputs.groupBy("Output_Material").agg(F.countDistinct(ORDER).alias("Order_Count"))
    total = counted.agg(F.sum("Order_Count").alias("t")).scalar()
    return counted.withColumn("Historical_Pct", F.col("Order_Count") * F.lit(100.0) / total)


def share_by_volume(outputs: DataFrame) -> DataFrame:
    """Volume per output material and its share of the total volume."""
    summed = outputs.groupBy("Output_Material").agg(F.sum("Total_Output_BF").alias("Total_BF_Output"))
    total = summed.agg(F.sum("Total_BF_Output").alias("t")).scalar()
    return summed.withColumn("Historical_Pct", F.col("Total_BF_Output") * F.lit(100.0) / total)


def compare_shares(outputs: DataFrame) -> DataFrame:
    """Both shares side by side; the two summaries meet in one aggregation of the order x material grain."""
    summary = outputs.groupBy("Output_Material").agg(
        F.countDistinct(ORDER).alias("Order_Count"), F.sum("Total_Output_BF").alias("Total_BF_Output")
    )
    totals = summary.agg(F.struct(F.sum("Order_Count").alias("n"), F.sum("Total_BF_Output").alias("bf"))).scalar()
    return summary.select(
        "Output_Material",
        "Order_Count",
        (F.col("Order_Count") * F.lit(100.0) / totals["n"]).alias("Historical_Pct_count"),
        "Total_BF_Output",
        (F.col("Total_BF_Output") * F.lit(100.0) / totals["bf"]).alias("Historical_Pct_bf"),
    )


def expected_volume(input_bf: Column, total_in: Column, total_out: Column, share_pct: Column) -> dict[str, Column]:
    """Expected total output at the historical ratio, and one material's share of it."""
    total = input_bf * (total_out / total_in)
    return {"expected_output": total, "expected_material_bf": total * (share_pct / F.lit(100.0))}


def _usable(filters: dict[str, str], requests: DataFrame, facts: DataFrame) -> list[str]:
    """Fact columns that some request can filter on; grouping by any other would only make the cells finer."""
    return [c for given, c in filters.items() if given in requests.columns and c in facts.columns]


def distribution_cells(history: DataFrame, filters: list[str]) -> DataFrame:
    """Order counts, volumes and yield sums per input material, filter columns and output material / grade."""
    if "Output_Grade" not in history.columns:
        history = history.withColumn("Output_Grade", F.lit("N/A"))
    return (
        history.where(F.col("Output_Material").isNotNull() & F.col("Output_Grade").isNotNull())
        .groupBy("Input_Material", *filters, "Output_Material", "Output_Grade")
        .agg(F.sum("Total_Output_BF").alias("bf"), *moments(F.col("Yield_Percentage"), "y"))
    )


def kd_distribution(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Historical outputs of a material by output material and grade, with volume share and yield statistics.

    Shares use volume; a request whose matching history carries no volume falls back to order counts.
    """
    cells = distribution_cells(history, _usable(HISTORY_FILTERS, requests, history))
    outputs = ["Output_Material", "Output_Grade"]
    found = _optional_match(requests, cells, HISTORY_FILTERS, "Input_Material", outputs)
    n, s1, s2 = F.sum("y_n"), F.sum("y_s1"), F.sum("y_s2")
    stats = found.groupBy("request_id", *outputs).agg(
        half_even(F.sum("bf"), 2).alias("BF_Output"),
        n.alias("Order_Count"),
        half_even(s1 / n, 2).alias("Avg_Yield"),
        half_even(F.coalesce(pooled_std(n, s1, s2), F.lit(0.0)), 2).alias("Yield_Std"),
    )
    by_volume = share_of(F.col("BF_Output"), "request_id")
    by_count = share_of(F.col("Order_Count").cast("double"), "request_id")
    has_volume = F.sum("BF_Output").over(Window.partitionBy("request_id")) > 0
    percentage = half_even(F.when(has_volume, by_volume).otherwise(by_count), 2)
    return stats.withColumn("Percentage", percentage)


def allocate_with_wastage(requests: DataFrame, distribution: DataFrame) -> DataFrame:
    """Take wastage off the input and spread the rest over the distribution; zeros where there is none."""
    joined = requests.select("request_id", "material", "input_bf", "wastage_pct").join(
        distribution, "request_id", "left"
    )
    wastage = F.col("input_bf") * (F.col("wastage_pct") / F.lit(100.0))
    available = F.col("input_bf") - wastage
    known = F.col("Output_Material").isNotNull()
    expected = available * (F.col("Percentage") / F.lit(100.0))
    zero = F.lit(0.0)
    return joined.select(
        *joined.columns,
        F.when(known, half_even(wastage, 2)).otherwise(zero).alias("wastage_bf"),
        F.when(known, half_even(available, 2)).otherwise(zero).alias("available_bf"),
        F.when(known, half_even(expected, 2)).otherwise(zero).alias("Expected_Output_BF"),
        half_even(
            F.coalesce(F.sum(expected).over(Window.partitionBy("request_id")), zero), 2
        ).alias("total_expected_bf"),
    )


def kd_lookup_totals(requests: DataFrame, raw_261: DataFrame, raw_101: DataFrame) -> DataFrame:
    """Input and output totals of the raw ledgers under the request's filters, deleted rows included.

    The output of an order is credited in full to every matching request that consumed anything in it. Both ledgers
    are reduced to order grain first, so an order with very many lines enters the join as a few rows.
    """
    filters = _usable(LEDGER_FILTERS, requests, raw_261)
    lines = raw_261.groupBy(ORDER, "MATERIAL", *filters).agg(F.sum("BFIN").alias("bfin"))
    orders = _optional_match(requests, lines, LEDGER_FILTERS, "MATERIAL", [ORDER])
    outputs = raw_101.groupBy(ORDER).agg(F.sum("BFOUT").alias("bfout"))
    return _with_totals(requests, orders.join(outputs, ORDER, "left"))


def kd_lookup_totals_from_history(requests: DataFrame, history: DataFrame) -> DataFrame:
    """The same totals from the joined history, an order's input counted once however many outputs it has."""
    filters = _usable(HISTORY_FILTERS, requests, history)
    per_order = history.groupBy(ORDER, "Input_Material", *filters).agg(
        F.max("Total_Input_BF").alias("bfin"), F.sum("Total_Output_BF").alias("bfout")
    )
    cells = per_order.groupBy("Input_Material", *filters).agg(
        F.sum("bfin").alias("bfin"), F.sum("bfout").alias("bfout")
    )
    found = _optional_match(requests, cells, HISTORY_FILTERS, "Input_Material", [])
    return _with_totals(requests, found)


def _with_totals(requests: DataFrame, found: DataFrame) -> DataFrame:
    totals = found.groupBy("request_id").agg(F.sum("bfin").alias("bfin"), F.sum("bfout").alias("bfout"))
    total_in = F.coalesce(F.col("bfin"), F.lit(0.0))
    total_out = F.coalesce(F.col("bfout"), F.lit(0.0))
    return requests.join(totals, "request_id", "left").select(
        "request_id",
        "material",
        total_in.alias("total_hist_input_bf"),
        total_out.alias("total_hist_output_bf"),
        half_even(safe_ratio(total_out, total_in) * F.lit(100.0), 2).alias("historical_yield_pct"),
    )


def kd_lookup(requests: DataFrame, history: DataFrame, raw_261: DataFrame, raw_101: DataFrame) -> DataFrame:
    """Mix and allocation from the cleaned history beside totals from the raw ledgers."""
    allocation = allocate_with_wastage(requests, kd_distribution(requests, history))
    totals = kd_lookup_totals(requests, raw_261, raw_101).drop("material")
    return allocation.join(totals, "request_id")


def production_order(kd_rows: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected outputs as planned volumes, with the totals of the selection."""
    keys = ["request_id", "Output_Material", "Output_Grade"]
    chosen = kd_rows.join(selection.select(*keys), keys, "left_semi")
    whole = Window.partitionBy("request_id")
    return chosen.withColumnRenamed("Expected_Output_BF", "Planned_Output_BF").withColumns({
        "selected_bf": F.sum("Planned_Output_BF").over(whole),
        "selected_pct": F.sum("Percentage").over(whole),
    })


def distribution_totals(rows: DataFrame, share: str, volume: str) -> DataFrame:
    """Totals line of a distribution, per request."""
    return rows.groupBy("request_id").agg(
        F.sum(share).alias("total_pct"), F.sum(volume).alias("total_bf"), F.count(F.lit(1)).alias("materials")
    )
