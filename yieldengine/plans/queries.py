"""Every operator as a query over the test tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldengine.functions import half_even
from yieldengine.ml import artifacts, classification, evaluation, regression
from yieldengine.ml.features import complete_features, prepare_features
from yieldengine.operators import cleaning, encode, forward, history, mix, orders, planning, ranking, simulate, states
from yieldengine.operators.aggregates import aggregate_inputs, aggregate_outputs
from yieldengine.operators.predictors import forward_predict, mean_yield_predictor
from yieldengine.operators.volume import derive_input_volume, derive_output_volume, with_yield
from yieldengine.plans.datasets import prepare_dataset
from yieldengine.schema import ORDER, SEQ
from yieldengine.sources import exports, ledgers
from yieldengine.sources.history import load_history
from yieldengine.sources.testtables import full_ledgers, ledger_101, ledger_261, movements, sequence_part, table
from yieldengine.staging import checkpoint_root, stage

Query = Callable[[SparkSession, str], DataFrame]

# The stand-in model used where a query is compared with SQL: its assumed fit and error.
STAND_IN_R2 = 0.3
STAND_IN_RMSE = 3.8
SEED = 42

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def clean_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return cleaning.clean_strict(ledger_261(spark, sf_dir)), cleaning.clean_strict(ledger_101(spark, sf_dir))


def split_history(spark: SparkSession, sf_dir: str, with_grade: bool = True) -> DataFrame:
    return history.yield_history(*clean_pair(spark, sf_dir), with_grade)


def wide_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all columns, from states clustered by order."""
    return history.clustered_history(*clean_pair(spark, sf_dir))


def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued, received = full_ledgers(spark, sf_dir)
    return history.yield_history(cleaning.clean_strict(issued), cleaning.clean_strict(received), with_grade=False)


def joined_text(column: str) -> Column:
    return F.array_join(column, ",")


# ---------------------------------------------------------------- requests


def as_table(fn: Query) -> Query:
    """Requests and histories that several steps read are written once, as they would be in a planning run."""

    @functools.wraps(fn)
    def written(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stage(fn(spark, sf_dir), fn.__name__)

    return written


@as_table
def planning_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_history(spark, sf_dir).select(
        ORDER, "Input_Material", "Input_Plant", "Output_Material", "Total_Input_BF", "Total_Output_BF",
        "Yield_Percentage",
    )


def material_plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_261(spark, sf_dir).select("MATERIAL", "PLANT").distinct()


@as_table
def forward_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return material_plants(spark, sf_dir).select(
        F.concat_ws("|", "MATERIAL", "PLANT").alias("request_id"),
        F.col("MATERIAL").alias("ks_material"), F.col("PLANT").alias("plant"),
        F.lit(10000.0).alias("input_bf"), F.lit(5).alias("min_order_count"),
    )


@as_table
def kd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per material and plant, plus per material with no further filter."""
    per_plant = material_plants(spark, sf_dir)
    everywhere = per_plant.select("MATERIAL").distinct().withColumn("PLANT", F.lit(None).cast("string"))
    return per_plant.unionByName(everywhere).select(
        F.concat_ws("|", "MATERIAL", F.coalesce("PLANT", F.lit("*"))).alias("request_id"),
        F.col("MATERIAL").alias("material"),
        F.col("PLANT").alias("plant"),
        F.lit(10000.0).alias("input_bf"), F.lit(9.0).alias("wastage_pct"),
    )


@as_table
def line_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plant and material: a request of two lines, for it and the plant's next material (after the last one, the
    first); per plant one for a material nobody has used."""
    used = movements(spark, sf_dir).select("PLANT", "MATERIAL").distinct()
    at_plant = Window.partitionBy("PLANT").orderBy("MATERIAL")
    following = F.coalesce(F.lead("MATERIAL").over(at_plant), F.min("MATERIAL").over(Window.partitionBy("PLANT")))
    two = used.withColumn("next", following).select(
        F.concat_ws("|", "PLANT", "MATERIAL").alias("request_id"), F.col("PLANT").alias("Input_Plant"),
        F.posexplode(F.array("MATERIAL", "next")).alias("place", "Input_Material"),
    ).select(
        "request_id", (F.col("place") + 1).alias("line_no"), "Input_Plant", "Input_Material", F.lit(5000.0).alias("Total_Input_BF"),
    )
    new = used.select("PLANT").distinct().select(
        F.concat("PLANT", F.lit("|new")).alias("request_id"), F.lit(1).alias("line_no"),
        F.col("PLANT").alias("Input_Plant"), F.concat(F.lit("New-"), "PLANT").alias("Input_Material"),
        F.lit(8000.0).alias("Total_Input_BF"),
    )
    return two.unionByName(new)


@as_table
def material_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per material and plant that uses it."""
    return movements(spark, sf_dir).select("MATERIAL", "PLANT").distinct().select(
        F.concat_ws("|", "MATERIAL", "PLANT").alias("request_id"), F.col("MATERIAL").alias("Input_Material"),
        F.col("PLANT").alias("Input_Plant"),
        F.lit(10000.0).alias("Total_Input_BF"), F.lit(5000.0).alias("required_output_bf"),
        F.lit(5.0).alias("safety_margin_pct"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("material")).agg(
        half_even(F.avg("p_retailprice"), 2).alias("price_per_bf")
    )


# ---------------------------------------------------------------- cleaning and sources


@query
def clean_strict(spark, sf_dir):
    return cleaning.clean_strict(ledger_261(spark, sf_dir)).drop(SEQ, "POSTINGDATE")


@query
def clean_lenient(spark, sf_dir):
    cleaned = cleaning.clean_lenient(ledger_101(spark, sf_dir))
    return cleaned.withColumn("POSTINGDATE", F.date_format("POSTINGDATE", "yyyy-MM-dd")).drop(SEQ)


@query
def material_search(spark, sf_dir):
    used = ledger_261(spark, sf_dir).select("MATERIAL").distinct()
    return cleaning.search_material(used, "brand#1")


@query
def filtered_lines(spark, sf_dir):
    """Lines of one plant with one species and grade; a filter that is not given is skipped."""
    rows = cleaning.matching(ledger_261(spark, sf_dir), PLANT="NATION_1", MATERIALSPECIE="ECONOMY")
    rows = cleaning.matching_given(rows, TALLYGRADE="A", MATERIALTHICKNESS=None)
    return cleaning.display_columns(rows, {ORDER: "order_id", "MATERIAL": "material", "BFIN": "bf", "ABSENT": "x"})


@query
def null_profile(spark, sf_dir):
    sparse = ledger_261(spark, sf_dir).withColumns({
        "TALLYGRADE": F.when(F.col("TALLYGRADE") != "N", F.col("TALLYGRADE")),
        "MATERIALTHICKNESS": F.when(F.col("MATERIALTHICKNESS") < 40, F.col("MATERIALTHICKNESS")),
    })
    return cleaning.null_profile(sparse)


@query
def quality_summary(spark, sf_dir):
    both = history.quality_summary(ledger_261(spark, sf_dir), "261").unionByName(
        history.quality_summary(ledger_101(spark, sf_dir), "101")
    )
    return both.withColumns({
        c: F.date_format(c, "yyyy-MM-dd") for c in ("first_posting", "last_posting")
    })


@query
def option_lists(spark, sf_dir):
    return ledgers.option_lists(ledger_261(spark, sf_dir), ledger_101(spark, sf_dir))


@query
def available_years(spark, sf_dir):
    issued = ledger_261(spark, sf_dir).select(F.col("SOURCE_YEAR").alias("year"))
    received = ledger_101(spark, sf_dir).select(F.col("SOURCE_YEAR").alias("year"))
    return issued.intersect(received).orderBy("year")


# ---------------------------------------------------------------- volumes, aggregates, history


@query
def bf_from_dimensions(spark, sf_dir):
    """Volume per material when the ledgers carry no volume, and when the receipts carry it under BFIN."""
    issued = derive_input_volume(cleaning.clean_strict(ledger_261(spark, sf_dir)).drop("BFIN"))
    received = cleaning.clean_strict(ledger_101(spark, sf_dir))
    empty = derive_output_volume(received.withColumn("BFOUT", F.lit(0.0)))
    moved = derive_output_volume(received.withColumns({"BFIN": F.col("BFOUT"), "BFOUT": F.lit(0.0)}))

    def per_material(df: DataFrame, column: str, label: str) -> DataFrame:
        return df.groupBy("MATERIAL").agg(half_even(F.sum(column), 4).alias("total_bf")).withColumn(
            "source", F.lit(label)
        )

    return (
        per_material(issued, "BFIN", "261 dimensions")
        .unionByName(per_material(empty, "BFOUT", "101 dimensions"))
        .unionByName(per_material(moved, "BFOUT", "101 BFIN"))
    )


@query
def input_agg(spark, sf_dir):
    return aggregate_inputs(cleaning.clean_strict(ledger_261(spark, sf_dir)))


@query
def output_agg_dominant_grade(spark, sf_dir):
    return aggregate_outputs(cleaning.clean_strict(ledger_101(spark, sf_dir)))


@query
def yield_history(spark, sf_dir):
    return wide_history(spark, sf_dir)


@query
def yield_outliers_removed(spark, sf_dir):
    past = split_history(spark, sf_dir, with_grade=False).select(
        ORDER, "Input_Material", "Output_Material", "Total_Input_BF", "Total_Output_BF", "Yield_Percentage"
    )
    return history.remove_outlier_chain(past)


@query
def yield_valid_range(spark, sf_dir):
    issued = cleaning.clean_lenient(ledger_261(spark, sf_dir))
    received = cleaning.clean_lenient(ledger_101(spark, sf_dir))
    return history.valid_yield_orders(issued, received)


@query
def same_material_orders(spark, sf_dir):
    return history.same_material_count(split_history(spark, sf_dir, with_grade=False))


@query
def yield_statistics(spark, sf_dir):
    return rounded(
        history.yield_statistics(split_history(spark, sf_dir, with_grade=False)), 4,
        "mean_yield", "std_yield", "min_yield", "max_yield",
    )


@query
def yield_median(spark, sf_dir):
    return rounded(history.yield_median(stage(
        split_history(spark, sf_dir, with_grade=False).select("Input_Material", "Yield_Percentage"), "history"
    )), 6, "median_yield")


@query
def yield_by_material(spark, sf_dir):
    stats = history.yield_by_material(split_history(spark, sf_dir, with_grade=False))
    return ranking.by_mean_yield(rounded(stats, 4, "Mean_Yield", "Std_Yield", "Min_Yield", "Max_Yield"))


@query
def material_yield_stats(spark, sf_dir):
    stats = history.material_yield_stats(stage(
        split_history(spark, sf_dir, with_grade=False).select("Input_Material", "Yield_Percentage"), "history"
    ))
    return rounded(stats, 4, "mean", "std", "min", "max", "q25", "q75")


@query
def median_fill(spark, sf_dir):
    """Order features with gaps filled by the exact column median (thickness above 40 counts as a gap here)."""
    inputs = aggregate_inputs(cleaning.clean_strict(ledger_261(spark, sf_dir))).select(
        ORDER, "Total_Input_BF", "Input_Length",
        F.when(F.col("Input_Thickness") <= 40, F.col("Input_Thickness")).alias("Input_Thickness"),
    )
    return history.fill_medians(stage(inputs, "inputs"))


# ---------------------------------------------------------------- order drill-down


@query
def common_orders(spark, sf_dir):
    return orders.common_orders(ledger_101(spark, sf_dir), ledger_261(spark, sf_dir))


@query
def bf_per_order(spark, sf_dir):
    bfin = orders.volume_per_order(ledger_261(spark, sf_dir), "BFIN").withColumnRenamed("BFIN", "BF")
    bfout = orders.volume_per_order(ledger_101(spark, sf_dir), "BFOUT").withColumnRenamed("BFOUT", "BF")
    return bfin.withColumn("side", F.lit("261")).unionByName(bfout.withColumn("side", F.lit("101")))


@query
def filtered_totals(spark, sf_dir):
    chosen = {"PLANT": "NATION_1", "MATERIALSPECIE": "ECONOMY"}
    return orders.ledger_totals(
        cleaning.matching(ledger_261(spark, sf_dir), **chosen),
        cleaning.matching(ledger_101(spark, sf_dir), **chosen),
    )


@query
def materials_per_order(spark, sf_dir):
    received = ledger_101(spark, sf_dir)
    shared = orders.within_orders(received, orders.common_orders(received, ledger_261(spark, sf_dir)))
    return orders.materials_per_order(shared, sequence_part()).withColumn("Materials", joined_text("Materials"))


@query
def materials_in_order(spark, sf_dir):
    return orders.materials_in_order(ledger_101(spark, sf_dir), sequence_part())


@query
def input_then_output_materials(spark, sf_dir):
    both = orders.input_then_output_materials(ledger_261(spark, sf_dir), ledger_101(spark, sf_dir))
    return both.withColumn("Materials", joined_text("Materials"))


@query
def order_yield_summary(spark, sf_dir):
    return orders.order_yield_summary(ledger_261(spark, sf_dir), ledger_101(spark, sf_dir))


@query
def order_output_mix(spark, sf_dir):
    return orders.order_output_mix(ledger_101(spark, sf_dir))


# ---------------------------------------------------------------- mix and allocation


@query
def share_count_vs_bf(spark, sf_dir):
    outputs = aggregate_outputs(cleaning.clean_strict(ledger_101(spark, sf_dir)), with_grade=False)
    return rounded(mix.compare_shares(outputs), 6, "Historical_Pct_count", "Historical_Pct_bf")


@query
def expected_volume_by_material(spark, sf_dir):
    """Expected output of 90,000 BF at the ledgers' overall ratio, spread by volume share."""
    issued, received = clean_pair(spark, sf_dir)
    outputs = aggregate_outputs(received, with_grade=False)
    shares = mix.share_by_volume(outputs)
    total_in = issued.agg(F.sum("BFIN")).scalar()
    total_out = received.agg(F.sum("BFOUT")).scalar()
    expected = mix.expected_volume(F.lit(90000.0), total_in, total_out, F.col("Historical_Pct"))
    return rounded(shares.withColumns(expected), 4, "Historical_Pct", "expected_output", "expected_material_bf")


@query
def share_by_count(spark, sf_dir):
    outputs = aggregate_outputs(cleaning.clean_strict(ledger_101(spark, sf_dir)), with_grade=False)
    return rounded(mix.share_by_count(outputs), 6, "Historical_Pct")


@query
def kd_distribution(spark, sf_dir):
    found = mix.kd_distribution(kd_requests(spark, sf_dir), wide_history(spark, sf_dir))
    return ranking.by_material_and_volume(found)


@as_table
def graded_requests(spark, sf_dir):
    """Per material and input grade; every other one asks for the species too, as a filter that may be null."""
    seen = ledger_261(spark, sf_dir).select("MATERIAL", "TALLYGRADE").distinct()
    species = F.when(F.col("TALLYGRADE") == "R", F.lit("ECONOMY"))
    return seen.select(
        F.concat_ws("|", "MATERIAL", "TALLYGRADE").alias("request_id"), F.col("MATERIAL").alias("material"),
        F.col("TALLYGRADE").alias("grade"), species.alias("species"),
        F.lit(10000.0).alias("input_bf"), F.lit(9.0).alias("wastage_pct"),
    )


@query
def kd_distribution_by_grade(spark, sf_dir):
    return mix.kd_distribution(graded_requests(spark, sf_dir), wide_history(spark, sf_dir))


@query
def kd_distribution_by_thickness(spark, sf_dir):
    """Requests that give any of thickness, grade, species and plant: one for each of the orders' own attributes."""
    past = stage(wide_history(spark, sf_dir), "history")
    given = {"thickness": "Input_Thickness", "grade": "Input_Grade", "species": "Input_Specie", "plant": "Input_Plant"}
    # which filters a request gives follows from its thickness and plant, so that every pattern occurs
    pattern = F.pmod(F.floor("Input_Thickness") + F.length("Input_Plant"), F.lit(16)).cast("int")
    asked = past.select("Input_Material", pattern.alias("pattern"), *[
        F.when(F.shiftright(pattern, i) % 2 == 1, F.col(c)).alias(g) for i, (g, c) in enumerate(given.items())
    ]).distinct()
    requests = stage(asked.select(
        F.concat_ws("|", "Input_Material", *[F.coalesce(F.col(g).cast("string"), F.lit("*")) for g in given]).alias("request_id"),
        F.col("Input_Material").alias("material"), *given,
    ).distinct(), "thickness-requests")
    found = mix.kd_distribution(requests, past)
    return requests.join(found, "request_id").select(
        "material", *given, "Output_Material", "Output_Grade", "BF_Output", "Order_Count", "Percentage"
    )


@query
def kd_wastage_allocation(spark, sf_dir):
    requests = kd_requests(spark, sf_dir)
    allocated = mix.allocate_with_wastage(requests, mix.kd_distribution(requests, wide_history(spark, sf_dir)))
    return allocated.select(
        "request_id", "Output_Material", "Output_Grade", "Percentage", "wastage_bf", "available_bf",
        "Expected_Output_BF", "total_expected_bf",
    )


@query
def kd_lookup_totals(spark, sf_dir):
    return mix.kd_lookup_totals(
        kd_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir)
    )


@query
def kd_totals_from_history(spark, sf_dir):
    return mix.kd_lookup_totals_from_history(
        kd_requests(spark, sf_dir), split_history(spark, sf_dir, with_grade=False)
    )


@query
def kd_lookup(spark, sf_dir):
    found = mix.kd_lookup(
        kd_requests(spark, sf_dir), wide_history(spark, sf_dir),
        ledger_261(spark, sf_dir), ledger_101(spark, sf_dir),
    )
    return found.select(
        "request_id", "Output_Material", "Output_Grade", "BF_Output", "Expected_Output_BF",
        "total_hist_input_bf", "total_hist_output_bf", "historical_yield_pct",
    )


def selected_outputs(spark, sf_dir, rows):
    """The chosen (request, output) pairs: everything at plants of the first region, nothing at those of the second,
    elsewhere outputs of a brand with an even last digit."""
    plants = table(spark, sf_dir, "nation").select(F.col("n_name").alias("plant"), "n_regionkey")
    asked = kd_requests(spark, sf_dir).select("request_id", "plant").join(plants, "plant", "left")
    even = F.substring("Output_Material", -1, 1).cast("int") % 2 == 0
    region = F.coalesce("n_regionkey", F.lit(-1))
    return rows.join(asked.select("request_id", region.alias("region")), "request_id").where(
        (F.col("region") == 0) | ((F.col("region") != 1) & even)
    )


@query
def production_order(spark, sf_dir):
    requests = kd_requests(spark, sf_dir)
    rows = stage(
        mix.allocate_with_wastage(requests, mix.kd_distribution(requests, wide_history(spark, sf_dir))), "allocation"
    )
    order = mix.production_order(rows, selected_outputs(spark, sf_dir, rows))
    return rounded(order, 2, "selected_bf", "selected_pct").select(
        "request_id", "Output_Material", "Output_Grade", "Percentage", "Planned_Output_BF", "selected_bf",
        "selected_pct",
    )


@query
def material_forward(spark, sf_dir):
    return forward.material_forward(
        forward_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir)
    )


@query
def forward_by_contribution(spark, sf_dir):
    """The rows of the plans, the largest contribution first."""
    plan = forward.material_forward(forward_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir))
    return ranking.by_contribution(plan.where(F.col("status") == "ok").select("request_id", "KD_Material", "Contribution_Pct"))


@query
def allocation_by_expected_volume(spark, sf_dir):
    """The rows of the allocations, the largest expected volume first."""
    requests = kd_requests(spark, sf_dir)
    allocated = mix.allocate_with_wastage(requests, mix.kd_distribution(requests, wide_history(spark, sf_dir)))
    return ranking.by_expected_volume(allocated.select("request_id", "Output_Material", "Output_Grade", "Expected_Output_BF"))


@query
def forward_statuses(spark, sf_dir):
    """Plans on receipts of every 16th order alone, for brands of even number by any order, else by more than five; with
    a request per plant for a material that nobody has used."""
    even = F.regexp_extract("ks_material", r"(\d+)$", 1).cast("int") % 2 == 0
    asked = forward_requests(spark, sf_dir).withColumn("min_order_count", F.when(even, 0).otherwise(F.col("min_order_count")))
    unused = asked.select(F.concat(F.lit("unused|"), "plant").alias("request_id"), F.lit("unused").alias("ks_material"),
                          "plant", "input_bf", "min_order_count").distinct()
    received = ledger_101(spark, sf_dir).where(F.col(ORDER).cast("bigint") % 16 == 0)
    plan = forward.material_forward(asked.unionByName(unused), ledger_261(spark, sf_dir), received)
    return plan.select("request_id", "status", "total_orders", "kd_materials_count", "KD_Material", "Order_Count", "Contribution_Pct")


@query
def forward_totals(spark, sf_dir):
    plan = material_forward(spark, sf_dir).where(F.col("status") == "ok")
    return rounded(mix.distribution_totals(plan, "Contribution_Pct", "Expected_BF_Output"), 2, "total_pct", "total_bf")


@query
def typical_features(spark, sf_dir):
    return forward.typical_features(forward_requests(spark, sf_dir), ledger_261(spark, sf_dir))


@query
def advanced_forward(spark, sf_dir):
    predictor = mean_yield_predictor(planning_history(spark, sf_dir))
    plan = forward.advanced_forward(
        forward_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir), predictor
    )
    return rounded(plan, 2, "yield_difference")


# ---------------------------------------------------------------- encoders


@query
def encoders(spark, sf_dir):
    return encode.fit_encoders(wide_history(spark, sf_dir))


@query
def encoder_classes(spark, sf_dir):
    return encode.encoder_classes(encode.fit_encoders(wide_history(spark, sf_dir))).withColumn(
        "classes", joined_text("classes")
    )


@query
def encode_lookup(spark, sf_dir):
    """Codes fitted on the input side of one ledger half, applied to orders of the other (unseen values give 0)."""
    issued = aggregate_inputs(cleaning.clean_strict(ledger_261(spark, sf_dir)))
    columns = ["Input_Material", "Input_Specie", "Input_Grade", "Input_Plant"]
    fitted = encode.fit_encoders(issued.where((F.col("Input_Plant") != "NATION_1") | (F.col("Input_Grade") != "N")),
                                 columns)
    seen = fitted.where(F.col("value") != "Brand#7")
    return encode.apply_encoders(issued, stage(seen.coalesce(1), "encoders"), columns).select(
        ORDER, *[c for name in columns for c in (name, f"{name}_Encoded")]
    )


# ---------------------------------------------------------------- the composed preparation job and its sources


@query
def prepared_history(spark, sf_dir):
    """The whole preparation job over the split ledgers: cleaned, joined, trimmed, encoded, gaps filled."""
    return prepare_dataset(ledger_261(spark, sf_dir), ledger_101(spark, sf_dir)).history


@query
def prepared_full_history(spark, sf_dir):
    """The same over the full ledgers, without trimming, with the features and codes that training reads."""
    prepared = prepare_dataset(*full_ledgers(spark, sf_dir), trim_outliers=False).history
    return prepared.select(ORDER, "Output_Material", "Total_Input_BF", "Yield_Percentage", *[
        c for c in prepared.columns if c.endswith("_Encoded")
    ])


def yearly_ledgers(spark, sf_dir):
    """The split ledgers written by year, receipts as CSV folders and issues as Parquet folders, and their folder."""
    folder = f"{checkpoint_root(spark)}/ledgers-{uuid.uuid4().hex}"
    for kind, ledger in (("261", ledger_261(spark, sf_dir)), ("101", ledger_101(spark, sf_dir))):
        rows = stage(ledger.drop(SEQ), "ledger")
        for year in [r[0] for r in rows.select("SOURCE_YEAR").distinct().orderBy("SOURCE_YEAR").collect()]:
            of_year = rows.where(F.col("SOURCE_YEAR") == year).drop("SOURCE_YEAR")
            if kind == "261":
                of_year.write.parquet(f"{folder}/261_{year}.parquet")
            else:
                of_year.write.option("header", True).csv(f"{folder}/101_{year}.csv")
    return folder


@query
def years_found(spark, sf_dir):
    """Years for which both ledgers are found in the folder of yearly ledgers."""
    return ledgers.available_years(spark, yearly_ledgers(spark, sf_dir))


@query
def year_ledgers(spark, sf_dir):
    """Totals per year, material and deletion mark of the yearly ledgers, read back and typed."""
    folder = yearly_ledgers(spark, sf_dir)
    years = [r["year"] for r in ledgers.available_years(spark, folder).collect()]
    issued, received = ledgers.read_raw_ledgers(spark, folder, years)

    def totals(ledger: DataFrame, volume: str, kind: str) -> DataFrame:
        return ledger.groupBy(F.col("_SOURCE_YEAR").alias("year"), "MATERIAL", "IS_DELETED").agg(
            F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("rows"), F.countDistinct(ORDER).alias("orders"),
        ).withColumn("ledger", F.lit(kind))

    return totals(issued, "BFIN", "261").unionByName(totals(received, "BFOUT", "101"))


@query
def refreshed_history(spark, sf_dir):
    """The yield history from yearly states, after the last year was read again over a wrong version of it."""
    folder = f"{checkpoint_root(spark)}/states-{uuid.uuid4().hex}"
    sides = {"inputs": (ledger_261(spark, sf_dir), states.input_states), "outputs": (ledger_101(spark, sf_dir), states.output_states)}
    merged = {}
    for side, (ledger, of) in sides.items():
        rows = stage(cleaning.clean_strict(ledger), "ledger")
        years = [r[0] for r in rows.select("SOURCE_YEAR").distinct().orderBy("SOURCE_YEAR").collect()]
        for year in years:
            of_year = rows.where(F.col("SOURCE_YEAR") == year)
            states.refresh_year(of(of_year if year != years[-1] else of_year.limit(10)), f"{folder}/{side}", year)
        states.refresh_year(of(rows.where(F.col("SOURCE_YEAR") == years[-1])), f"{folder}/{side}", years[-1])
        merged[side] = stage(states.read_states(spark, f"{folder}/{side}", side), "states")
    return with_yield(history.join_on_order(states.inputs_of(merged["inputs"]), states.outputs_of(merged["outputs"])))


@query
def default_ledgers(spark, sf_dir):
    """Totals per material and deletion mark of the two ledgers under their default names, deleted rows included."""
    issued, received = ledgers.read_raw_ledgers(spark, default_folder(spark, sf_dir))

    def totals(ledger: DataFrame, volume: str, kind: str) -> DataFrame:
        return ledger.groupBy("MATERIAL", "IS_DELETED").agg(
            F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("rows"), F.countDistinct(ORDER).alias("orders"),
        ).withColumn("ledger", F.lit(kind))

    return totals(issued, "BFIN", "261").unionByName(totals(received, "BFOUT", "101"))


def default_folder(spark, sf_dir):
    """The split ledgers written as 261.csv and 101.csv (folders of part files); the lines of an order are in one, in order."""
    folder = f"{checkpoint_root(spark)}/ledgers-{uuid.uuid4().hex}"
    for kind, ledger in (("261", ledger_261(spark, sf_dir)), ("101", ledger_101(spark, sf_dir))):
        rows = ledger.repartition(ORDER).sortWithinPartitions(ORDER, SEQ).drop(SEQ, "SOURCE_YEAR")
        rows.write.option("header", True).csv(f"{folder}/{kind}.csv")
    return folder


@query
def saved_option_lists(spark, sf_dir):
    """The option lists saved as one JSON object and read from it, without a ledger at hand."""
    path = f"{checkpoint_root(spark)}/options-{uuid.uuid4().hex}"
    lists = ledgers.option_lists(ledger_261(spark, sf_dir), ledger_101(spark, sf_dir)).groupBy("option").agg(F.collect_list("value").alias("values"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("option", "values"))))).coalesce(1).write.text(path)
    return ledgers.load_option_lists(spark, path, None)


@query
def history_sources(spark, sf_dir):
    """Yields per input material from ledgers under their default names, and from a saved summary where there are none."""
    found = load_history(spark, default_folder(spark, sf_dir)).history
    by_material = found.groupBy("Input_Material").agg(F.count(F.lit(1)).alias("rows"), F.avg("Yield_Percentage").alias("mean_yield"))
    root = f"{checkpoint_root(spark)}/summary-{uuid.uuid4().hex}"
    pairs = history.yield_by_material(split_history(spark, sf_dir, with_grade=False))
    pairs.write.parquet(f"{root}/summary")
    spark.createDataFrame([("no ledger",)], "note string").write.text(f"{root}/data")
    saved = load_history(spark, f"{root}/data", None, f"{root}/summary").history
    by_summary = saved.groupBy("Input_Material").agg(
        F.sum("Historical_Orders").alias("rows"), (F.sum(F.col("Yield_Percentage") * F.col("Historical_Orders")) / F.sum("Historical_Orders")).alias("mean_yield"),
    )
    both = by_material.withColumn("source", F.lit("ledgers")).unionByName(by_summary.withColumn("source", F.lit("summary")))
    return rounded(both, 6, "mean_yield")


@query
def exported_distribution(spark, sf_dir):
    """The forward plans written as a result file and read back."""
    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    plan = forward.material_forward(forward_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir))
    exports.export_distribution(plan, path)
    schema = (
        "KD_Material string, Historical_BF_Output double, Order_Count long, Contribution_Pct double, Expected_BF_Output double, "
        "KS_Material string, Plant string, Input_BF double, Predicted_Total_Output_BF double, Yield_Pct double"
    )
    return spark.read.option("header", True).schema(schema).csv(path)


@query
def exported_results(spark, sf_dir):
    """The enhanced simulation under its display names, with a context column, written and read back."""
    path = f"{checkpoint_root(spark)}/export-{uuid.uuid4().hex}"
    shown = exports.display_table(_enhanced(spark, sf_dir).select("*"))
    exports.export_results(exports.with_context(shown, run="all plants"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col("run"), F.col("Output Material").alias("output_material"), F.col("Confidence").alias("confidence"),
        F.col("Score").cast("int").alias("score"), F.col("`Hist. Orders`").cast("long").alias("orders"),
        F.col("`Yield %`").cast("double").alias("yield_pct"), F.col("`Rec. Score`").cast("double").alias("recommendation"),
    )


@query
def prepared_features(spark, sf_dir):
    """Features that exist with their gaps filled by medians, and for scoring absent ones as 0."""
    inputs = aggregate_inputs(cleaning.clean_strict(ledger_261(spark, sf_dir))).select(
        ORDER, "Total_Input_BF", F.when(F.col("Input_Length") <= 40, F.col("Input_Length")).alias("Input_Length"),
    )
    filled, used = prepare_features(stage(inputs, "inputs"), ["Total_Input_BF", "Input_Length", "Input_Absent"])
    scoring = complete_features(inputs.withColumnRenamed("Input_Length", "Scoring_Length"), ["Scoring_Length", "Input_Absent"])
    return filled.withColumn("used", F.lit(",".join(used))).join(scoring.select(ORDER, "Scoring_Length", "Input_Absent"), ORDER)


@query
def order_lines(spark, sf_dir):
    """The issued and received lines of one order."""
    both = ((ledger_261(spark, sf_dir), "BFIN"), (ledger_101(spark, sf_dir), "BFOUT"))
    issued, received = (
        cleaning.order_rows(ledger, "7").select(ORDER, "MATERIAL", "PLANT", F.col(volume).alias("bf"), F.lit(volume).alias("side"))
        for ledger, volume in both
    )
    return issued.unionByName(received)


@query
def preview_lines(spark, sf_dir):
    """The first 25 issued lines by order and line."""
    rows = ledger_261(spark, sf_dir).orderBy(F.col(ORDER).cast("bigint"), SEQ).select(ORDER, "MATERIAL", "PLANT", "BFIN")
    return cleaning.preview(rows, 25)


# ---------------------------------------------------------------- simulation


@query
def simulate_lines(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    rows = simulate.simulate_lines(line_requests(spark, sf_dir), past, mean_yield_predictor(past))
    return rounded(
        rows, 4, "Predicted_Yield_Pct", "Model_Yield_Pct", "Historical_Yield_Pct", "Yield_Std", "Predicted_Output_BF"
    )


@query
def simulate_outputs(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    found = simulate.simulate_outputs(line_requests(spark, sf_dir), past, mean_yield_predictor(past))
    return ranking.by_predicted_yield(found)


def _enhanced(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    return simulate.simulate_outputs_enhanced(
        line_requests(spark, sf_dir), past, mean_yield_predictor(past), STAND_IN_R2
    )


@query
def simulate_outputs_enhanced(spark, sf_dir):
    return ranking.by_recommendation(_enhanced(spark, sf_dir))


@query
def top_recommendation(spark, sf_dir):
    return simulate.top_recommendation(_enhanced(spark, sf_dir))


@query
def thin_history_estimate(spark, sf_dir):
    return simulate.thin_history_estimate(simulate.top_recommendation(_enhanced(spark, sf_dir)))


@query
def prediction_summary(spark, sf_dir):
    summary = simulate.prediction_summary(_enhanced(spark, sf_dir), 1, STAND_IN_R2, STAND_IN_RMSE)
    return rounded(summary, 4, "avg_yield_pct")


@query
def best_case_waste(spark, sf_dir):
    return simulate.best_case_waste(
        simulate.prediction_summary(_enhanced(spark, sf_dir), 1, STAND_IN_R2, STAND_IN_RMSE)
    )


@query
def fallback_predictions(spark, sf_dir):
    return simulate.fallback_predictions(
        line_requests(spark, sf_dir), mean_yield_predictor(planning_history(spark, sf_dir))
    )


@query
def predictions_with_fallback(spark, sf_dir):
    """Simulated outputs of requests with history for their materials, and a cautious row per line of the others."""
    requests, past = line_requests(spark, sf_dir), planning_history(spark, sf_dir)
    predictor = mean_yield_predictor(past)
    known = requests.where(~F.col("Input_Material").startswith("New-"))
    found = simulate.simulate_outputs(known, past, predictor).select(
        "request_id", "Output_Material", "Predicted_Yield_Pct", "Predicted_Output_BF", "Historical_Yield_Pct", "Historical_Orders", "Model_Type"
    )
    return simulate.with_fallback(found, requests, predictor)


# A history with groups of every size, spread and level, so that every tier and branch of the recommendations occurs:
# wide or narrow, and high or low yields by the brand's number, and fine or coarse groups by the plant.
SPREADS = (1.0, 3.0, 4.5, 6.0, 9.0)


@as_table
def varied_history(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    plants = table(spark, sf_dir, "nation").select(F.col("n_name").alias("Input_Plant"), F.col("n_nationkey").cast("int").alias("_key"))
    number = F.regexp_extract("Input_Material", r"(\d+)$", 1).cast("int")
    spread = F.element_at(F.array(*[F.lit(x) for x in SPREADS]), number % 5 + 1)
    level = F.lit(92.0) - F.lit(9.0) * F.floor((number - 1) / 5)
    part = F.col("_key") % 4
    order = F.col(ORDER).cast("bigint") % 6
    told = past.join(plants, "Input_Plant").select(
        ORDER,
        F.when(part % 2 == 0, F.col("Input_Material")).when(part == 1, F.concat("Input_Material", F.lit("*")))
        .otherwise(F.concat_ws("@", "Input_Material", "Input_Plant")).alias("Input_Material"),
        F.lit("any").alias("Input_Plant"),
        F.when(part % 2 == 0, "Main").when((part == 1) & (order < 3), "Half").otherwise(F.col("Output_Material")).alias("Output_Material"),
        "Total_Input_BF", F.greatest(F.lit(0.0), level + (F.col("Yield_Percentage") - 92.0) * spread).alias("Yield_Percentage"),
    )
    return told.withColumn("Total_Output_BF", F.col("Total_Input_BF") * F.col("Yield_Percentage") / 100.0)


def _varied(spark, sf_dir):
    past = varied_history(spark, sf_dir)
    requests = past.select("Input_Material").distinct().select(
        F.col("Input_Material").alias("request_id"), F.lit(1).alias("line_no"), F.lit("any").alias("Input_Plant"), "Input_Material",
        F.lit(5000.0).alias("Total_Input_BF"),
    )
    requests = stage(requests, "varied-requests")
    return simulate.simulate_outputs_enhanced(requests, past, mean_yield_predictor(past), STAND_IN_R2)


@query
def varied_confidence(spark, sf_dir):
    """Enhanced simulation over groups of every size, spread and level."""
    return _varied(spark, sf_dir).select(
        "request_id", "Output_Material", "Predicted_Yield_Pct", "Yield_Min_Pct", "Yield_Max_Pct", "Yield_Std", "Confidence_Score",
        "Confidence_Level", "Risk_Level", "Historical_Orders", "Recommendation_Score",
    )


@query
def varied_recommendations(spark, sf_dir):
    return simulate.top_recommendation(_varied(spark, sf_dir)).select(
        "request_id", "strength", "output_material", "expected_yield", "confidence_level", "risk_level", "historical_orders", "message"
    )


@query
def varied_thin_history(spark, sf_dir):
    return simulate.thin_history_estimate(simulate.top_recommendation(_varied(spark, sf_dir)))


@query
def deduplicated_input(spark, sf_dir):
    """Input volume per input material with every order counted once although it has several outputs."""
    return simulate.order_deduplicated_input(split_history(spark, sf_dir, with_grade=False), ["Input_Material"])


# ---------------------------------------------------------------- planning


def _confident(spark, sf_dir, past):
    return planning.with_confidence(
        material_requests(spark, sf_dir), mean_yield_predictor(past), history.material_stats(past),
        rmse=STAND_IN_RMSE, model_name="mean",
    )


@query
def forward_confidence(spark, sf_dir):
    plan = planning.plan_forward(_confident(spark, sf_dir, planning_history(spark, sf_dir)))
    return plan.drop("required_output_bf", "safety_margin_pct")


@query
def forward_predict_lines(spark, sf_dir):
    return forward_predict(line_requests(spark, sf_dir), mean_yield_predictor(planning_history(spark, sf_dir)))


@query
def reverse_plan(spark, sf_dir):
    return planning.plan_reverse(_confident(spark, sf_dir, planning_history(spark, sf_dir)))


@query
def reverse_predict(spark, sf_dir):
    return planning.reverse_predict(
        material_requests(spark, sf_dir), mean_yield_predictor(planning_history(spark, sf_dir))
    )


@query
def compare_materials(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    compared = planning.compare_materials(
        _confident(spark, sf_dir, past), history.material_stats(past), prices(spark, sf_dir)
    )
    return planning.rank_materials(compared)


@query
def waste_estimate(spark, sf_dir):
    scored = forward_predict(
        material_requests(spark, sf_dir), mean_yield_predictor(planning_history(spark, sf_dir))
    )
    return planning.waste_estimate(scored, "Total_Input_BF", "predicted_yield_pct").select(
        "request_id", "predicted_yield_pct", "output_bf", "waste_bf", "waste_pct"
    )


@query
def anomaly_orders(spark, sf_dir):
    past = planning_history(spark, sf_dir)
    stats = stage(history.material_stats(past).coalesce(1), "material-stats")
    found = planning.detect_anomalies(past, mean_yield_predictor(past, staged=True), stats)
    return found.select(
        ORDER, "Input_Material", "Output_Material", "is_anomaly", "anomaly_type", "predicted_yield_pct",
        "deviation_pct", "deviation_std", "threshold_std",
        F.array_join("possible_causes", "; ").alias("possible_causes"),
    )


# ---------------------------------------------------------------- evaluation


def _scored_test_rows(spark, sf_dir):
    """Held-out fifth of the history (by order hash) scored with the means of the rest."""
    past = evaluation.with_split(planning_history(spark, sf_dir), [ORDER, "Output_Material"], SEED)
    predictor = mean_yield_predictor(past.where(~F.col("is_test")))
    scored = forward_predict(past.where("is_test"), predictor)
    return evaluation.test_results(
        scored, "Yield_Percentage", "predicted_yield_pct", [ORDER, "Output_Material"]
    )


@query
def model_test_results(spark, sf_dir):
    return rounded(_scored_test_rows(spark, sf_dir), 6, "Actual", "Error", "Error_Pct")


@query
def regression_metrics(spark, sf_dir):
    scored = _scored_test_rows(spark, sf_dir)
    return rounded(evaluation.regression_metrics(scored, "Actual", "Predicted"), 6, "r2", "mae", "rmse", "mape")


@query
def error_histogram(spark, sf_dir):
    return rounded(
        evaluation.error_histogram(_scored_test_rows(spark, sf_dir), "Error", 50), 4, "bin_from", "bin_to", "mean_error"
    )


@query
def test_row_sample(spark, sf_dir):
    """At most 500 held-out rows for display, the same ones on every run."""
    sample = evaluation.display_sample(_scored_test_rows(spark, sf_dir), [ORDER, "Output_Material"], 500, SEED)
    return rounded(sample, 6, "Actual", "Error", "Error_Pct")


@query
def split_and_folds(spark, sf_dir):
    """How many rows of every input material fall in the test part and in each cross-validation fold."""
    keys = [ORDER, "Output_Material"]
    past = evaluation.with_folds(
        evaluation.with_split(split_history(spark, sf_dir, with_grade=False), keys, SEED), keys, SEED, 5
    )
    return past.groupBy("Input_Material", "is_test", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query
def stratified_split(spark, sf_dir):
    """Per output material: rows and how many a stratified split holds out."""
    labelled = split_history(spark, sf_dir, with_grade=False).select(ORDER, "Output_Material")
    past = evaluation.with_stratified_split(
        stage(labelled, "labelled"), "Output_Material", [ORDER, "Output_Material"], SEED
    )
    return past.groupBy("Output_Material").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("held_out")
    )


@query
def class_weights(spark, sf_dir):
    return rounded(evaluation.class_weights(split_history(spark, sf_dir, with_grade=False), "Output_Material"), 8, "weight")


# ---------------------------------------------------------------- trained models
#
# All rows are used, with the published parameters, which are the defaults in yieldengine.ml. A query trains what its
# result needs and nothing is kept for another query.


def prepared(spark, sf_dir):
    return prepare_dataset(*full_ledgers(spark, sf_dir))


def yield_models(spark, sf_dir, *names, folds=1):
    """The named models (all, if none is named), each with its folds' scores where there are two folds or more."""
    data = prepared(spark, sf_dir)
    spec = regression.TrainingSpec(folds=folds)
    return regression.train_yield_models(data.history, data.encoders, replace(spec, models=names or spec.models))


@query
def ridge_model(spark, sf_dir):
    """The weights of the ridge model on the features as they are, and its intercept."""
    model = yield_models(spark, sf_dir, "Ridge").models["Ridge"]
    rows = [*zip(model.features, model.weights), ("(intercept)", model.intercept)]
    return rounded(spark.createDataFrame(rows, "feature string, weight double"), 6, "weight")


@query
def ridge_scores(spark, sf_dir):
    """The ridge model on the training and the held-out part, and held-out r2 of each fold (-1: the model itself)."""
    found = yield_models(spark, sf_dir, "Ridge", folds=5).metrics[0]
    rows = [(-1, found["train_r2"], found["test_r2"], found["MAE"], found["RMSE"], found["MAPE"])]
    rows += [(k, None, r2, None, None, None) for k, r2 in enumerate(found["cv_scores"])]
    schema = "fold int, train_r2 double, held_r2 double, mae double, rmse double, mape double"
    return rounded(spark.createDataFrame(rows, schema), 6, "train_r2", "held_r2", "mae", "rmse", "mape")


def stored_ridge(spark, sf_dir):
    """A store with the ridge model under each of the last two years of the ledgers; the earlier year's was replaced once."""
    model = yield_models(spark, sf_dir, "Ridge")
    years = [r["year"] for r in available_years(spark, sf_dir).collect()][-2:]
    store = f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}"
    for year in (years[0], *years):
        artifacts.save_yield_models(replace(model, years=[year]), f"{store}/{year}")
    return store


@query
def stored_models(spark, sf_dir):
    """What is read back from a model store: per year the model's weights and what its metadata say."""
    store = stored_ridge(spark, sf_dir)
    found = []
    for row in artifacts.available_model_years(spark, store).collect():
        loaded = artifacts.load_artifacts(spark, store, row["year"])
        told, model = loaded.metadata.first(), loaded.yields.best
        found += [
            (row["year"], ",".join(told["trained_years"]), told["best_model"], told["num_features"], feature, weight)
            for feature, weight in zip(model.features, model.weights)
        ]
    schema = "year string, trained_years string, best_model string, num_features int, feature string, weight double"
    return rounded(spark.createDataFrame(found, schema), 6, "weight")


@query
def stored_test_results(spark, sf_dir):
    """The held-out rows as they were written beside the last year's model."""
    store = stored_ridge(spark, sf_dir)
    year = artifacts.available_model_years(spark, store).collect()[-1]["year"]
    return rounded(artifacts.load_yield_models(spark, f"{store}/{year}").test_results, 4, "Actual", "Predicted", "Error", "Error_Pct")


@query
def train_forest(spark, sf_dir):
    return yield_models(spark, sf_dir, "RandomForest").comparison()


@query
def train_gradient_boosting(spark, sf_dir):
    return yield_models(spark, sf_dir, "GradientBoosting").comparison()


@query
def train_boosted_columns(spark, sf_dir):
    return yield_models(spark, sf_dir, "BoostedColumns").comparison()


@query
def train_yield_models(spark, sf_dir):
    """All models, compared on the held-out part; their folds' scores are `cv_scores`, `cv_scores_forest` and `ridge_scores`."""
    return yield_models(spark, sf_dir).comparison()


@query
def cv_scores(spark, sf_dir):
    """Held-out r2 of the boosted models in every fold."""
    spec = replace(regression.TrainingSpec(), models=("GradientBoosting", "BoostedColumns"))
    return regression.cross_validate(prepared(spark, sf_dir).history, spec)


@query
def cv_scores_forest(spark, sf_dir):
    """Held-out r2 of the forest in every fold."""
    return regression.cross_validate(prepared(spark, sf_dir).history, replace(regression.TrainingSpec(), models=("RandomForest",)))


@query
def feature_importance(spark, sf_dir):
    """Every feature with its importance in the first tree model there is, the forest, as read from the model's store."""
    store = f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}"
    artifacts.save_yield_models(yield_models(spark, sf_dir, "RandomForest"), store)
    return artifacts.load_importance(spark, store)


@query
def top_five_features(spark, sf_dir):
    return regression.top_features(yield_models(spark, sf_dir, "RandomForest").importance())


@query
def model_predictions(spark, sf_dir):
    """Held-out rows with the best model's prediction and error."""
    return yield_models(spark, sf_dir).test_results


def typical_requests(spark, sf_dir):
    """One typical request per material and plant."""
    requests = forward_requests(spark, sf_dir)
    return forward.typical_features(requests, ledger_261(spark, sf_dir)).withColumns({
        "Input_Material": F.col("ks_material"), "Input_Plant": F.col("plant"), "Total_Input_BF": F.lit(10000.0),
    })


@query
def score_yield(spark, sf_dir):
    """Typical requests scored by the best model."""
    return forward_predict(typical_requests(spark, sf_dir), yield_models(spark, sf_dir).predictor())


@query
def advanced_forward_model(spark, sf_dir):
    return forward.advanced_forward(
        forward_requests(spark, sf_dir), ledger_261(spark, sf_dir), ledger_101(spark, sf_dir),
        yield_models(spark, sf_dir).predictor(),
    )


@query
def simple_forest(spark, sf_dir):
    """The four-feature forest on orders with a valid yield."""
    issued, received = full_ledgers(spark, sf_dir)
    past = history.valid_yield_orders(cleaning.clean_lenient(issued), cleaning.clean_lenient(received))
    return regression.simple_yield_forest(past).comparison()


def output_classifiers(spark, sf_dir):
    data = prepared(spark, sf_dir)
    return classification.train_output_classifier(data.history, data.encoders)


@query
def simple_predictions(spark, sf_dir):
    """Typical requests, and one for a plant and material never seen, by the four-feature forest, unclipped."""
    issued, received = full_ledgers(spark, sf_dir)
    past = history.valid_yield_orders(cleaning.clean_lenient(issued), cleaning.clean_lenient(received))
    trained = regression.simple_yield_forest(past, regression.TrainingSpec(forest_trees=100, folds=1))
    asked = typical_requests(spark, sf_dir).select(
        F.concat_ws("|", "ks_material", "plant").alias("request_id"), F.col("plant").alias("Plant"), "Input_Material",
        F.col("Input_Thickness").alias("Thickness"), "Total_Input_BF",
    )
    new = asked.limit(1).withColumns({"request_id": F.lit("new"), "Plant": F.lit("new"), "Input_Material": F.lit("new")})
    return regression.predict_simple(asked.unionByName(new), trained)


@query
def output_classifier_topk(spark, sf_dir):
    """The most likely outputs of typical requests, by classifiers read back from their store."""
    data = prepared(spark, sf_dir)
    store = f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}"
    artifacts.save_classifiers(classification.train_output_classifier(data.history, data.encoders), store)
    loaded = replace(artifacts.load_classifiers(spark, store), encoders=data.encoders)
    return classification.predict_top_k(typical_requests(spark, sf_dir), loaded, 5)


@query
def output_probabilities(spark, sf_dir):
    """The most likely output's code for typical requests, with the probability of every class, by the forest."""
    data = prepared(spark, sf_dir)
    spec = classification.ClassifierSpec(models=("RandomForest_Classifier",))
    trained = classification.train_output_classifier(data.history, data.encoders, spec)
    return classification.predict_class(typical_requests(spark, sf_dir), trained)


@query
def classifier_importance(spark, sf_dir):
    data = prepared(spark, sf_dir)
    spec = classification.ClassifierSpec(models=("RandomForest_Classifier",))
    return classification.train_output_classifier(data.history, data.encoders, spec).importance()


@query
def classifier_metrics(spark, sf_dir):
    return classification.metrics_table(spark, output_classifiers(spark, sf_dir).metrics)
