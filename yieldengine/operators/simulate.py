"""Which outputs a set of input materials can give, how much of each, and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldengine.functions import blended_yield, confidence, half_even, moments, pooled_std, yield_range
from yieldengine.operators.predictors import Predictor, forward_predict, predict_yield
from yieldengine.schema import ORDER

#: Units without history of their own that share a copy of the totals of all history.
UNITS_A_COPY = 1000
DEFAULT_R2 = 0.2
NO_HISTORY_SPREAD = 15.0
SAFE_YIELD_PCT = 91.5
THIN_HISTORY = 5

_SUMS = ["y_n", "y_s1", "y_s2", "sum_in", "sum_out"]


def history_pairs(history: DataFrame) -> DataFrame:
    """Mergeable sums per input and output material. Input volume counts an order once per output material."""
    one_per_order = history.where(F.col("Output_Material").isNotNull())
    return one_per_order.groupBy("Input_Material", "Output_Material").agg(
        *moments(F.col("Yield_Percentage"), "y"),
        F.sum("Total_Input_BF").alias("sum_in"),
        F.sum("Total_Output_BF").alias("sum_out"),
    )


def order_deduplicated_input(history: DataFrame, keys: list[str]) -> DataFrame:
    """Input volume with every order counted once per key, for histories that repeat an order."""
    per_order = history.groupBy(*keys, ORDER).agg(F.max("Total_Input_BF").alias("bf"))
    return per_order.groupBy(*keys).agg(F.sum("bf").alias("Total_Input_BF"))


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _history_for(units: DataFrame, unit: list[str], pairs: DataFrame) -> DataFrame:
    """History sums per unit (request or request line) and output, over all of the unit's distinct materials.

    A unit none of whose materials has history gets everything: it joins the per-output totals, which are kept in
    as many copies as such units ask for, so that no key holds many of them.
    """
    wanted = units.select(*unit, "Input_Material").distinct()
    known = pairs.select("Input_Material").distinct().withColumn("_known", F.lit(True))
    unmatched = (
        wanted.join(known, "Input_Material", "left")
        .groupBy(*unit).agg(F.count("_known").alias("_hits"))
        .where(F.col("_hits") == 0).select(*unit)
    )
    copies = unmatched.agg(F.ceil((F.count(F.lit(1)) + 1) / UNITS_A_COPY).alias("copies")).scalar()
    unmatched = unmatched.withColumn("_salt", F.pmod(F.xxhash64(*unit), copies))
    everything = _merged(pairs, "Output_Material").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))
    )
    found = wanted.join(pairs, "Input_Material").select(*unit, "Output_Material", *_SUMS)
    rest = unmatched.join(everything, "_salt").select(*unit, "Output_Material", *_SUMS)
    return _merged(found.unionByName(rest), *unit, "Output_Material")


def _candidates(requests: DataFrame, history: DataFrame, predictor: Predictor) -> DataFrame:
    """One row per request and possible output: pooled history beside the mean model yield of its lines.

    The material names of a request are listed in line order; a request is one planning form, so its lines are few.
    """
    lines = forward_predict(requests, predictor)
    names = F.sort_array(F.collect_list(F.struct("line_no", "Input_Material")))
    asked = lines.groupBy("request_id").agg(
        F.sum("Total_Input_BF").alias("Input_BF"),
        F.avg("predicted_yield_pct").alias("model_yield"),
        F.count(F.lit(1)).alias("lines"),
        F.array_join(F.transform(names, lambda p: p["Input_Material"]), ", ").alias("Input_Material"),
    )
    n = F.col("y_n")
    return _history_for(requests, ["request_id"], history_pairs(history)).join(asked, "request_id").withColumns({
        "hist_yield": F.col("y_s1") / n,
        "hist_std": pooled_std(n, F.col("y_s1"), F.col("y_s2")),
        "hist_avg_out": F.col("sum_out") / n,
        "Model_Type": F.when(F.col("lines") > 1, F.lit("Multi-Input")).otherwise(F.lit("Single-Input")),
    })


def simulate_outputs(requests: DataFrame, history: DataFrame, predictor: Predictor) -> DataFrame:
    """Blend of model and pooled history per possible output of a request."""
    rows = _candidates(requests, history, predictor)
    final = blended_yield(F.col("model_yield"), F.col("hist_yield"), F.col("y_n"))
    return rows.select(
        "request_id", "Input_Material", "Output_Material",
        half_even(final, 2).alias("Predicted_Yield_Pct"),
        half_even(F.col("model_yield"), 2).alias("Model_Yield_Pct"),
        half_even(F.col("hist_yield"), 2).alias("Historical_Yield_Pct"),
        half_even(F.coalesce(F.col("hist_std"), F.lit(0.0)), 2).alias("Yield_Std"),
        F.col("y_n").alias("Historical_Orders"),
        "Input_BF",
        half_even(F.col("Input_BF") * final / F.lit(100.0), 2).alias("Predicted_Output_BF"),
        half_even(F.col("sum_out"), 2).alias("Historical_Total_Output_BF"),
        half_even(F.col("sum_in"), 2).alias("Historical_Total_Input_BF"),
        half_even(F.col("hist_avg_out"), 2).alias("Historical_Avg_Output_BF"),
        "Model_Type",
    )


def usable_r2(best_test_r2: float | None) -> float:
    """The best model's r2 never counts for less than the default."""
    return max(DEFAULT_R2, best_test_r2 or 0.0)


def simulate_outputs_enhanced(
    requests: DataFrame, history: DataFrame, predictor: Predictor, best_test_r2: float | None = None
) -> DataFrame:
    """`simulate_outputs` with a yield interval, confidence, risk and a recommendation score."""
    r2 = usable_r2(best_test_r2)
    rows = _candidates(requests, history, predictor)
    std = F.coalesce(F.col("hist_std"), F.lit(NO_HISTORY_SPREAD))
    rows = rows.withColumn("std", std)
    rows = rows.withColumns(yield_range(F.col("model_yield"), F.col("hist_yield"), F.col("std"), F.col("y_n")))
    rows = rows.withColumns(confidence(F.col("y_n"), F.col("std"), F.lit(r2)))

    def share(pct: str) -> Column:
        return half_even(F.col("Input_BF") * F.col(pct) / F.lit(100.0), 2)

    score = (F.col("yield_expected") / F.lit(100.0)) * (F.col("confidence_score") / F.lit(100.0))
    return rows.select(
        "request_id", "Input_Material", "Output_Material", "Input_BF",
        F.col("yield_expected").alias("Predicted_Yield_Pct"),
        F.col("yield_min").alias("Yield_Min_Pct"),
        F.col("yield_max").alias("Yield_Max_Pct"),
        F.col("range_width").alias("Yield_Range_Width"),
        half_even(F.col("model_yield"), 2).alias("Model_Yield_Pct"),
        half_even(F.col("hist_yield"), 2).alias("Historical_Yield_Pct"),
        half_even(F.col("std"), 2).alias("Yield_Std"),
        share("yield_expected").alias("Predicted_Output_BF"),
        share("yield_min").alias("Output_Min_BF"),
        share("yield_max").alias("Output_Max_BF"),
        F.col("confidence_score").alias("Confidence_Score"),
        F.col("confidence_level").alias("Confidence_Level"),
        F.col("risk_level").alias("Risk_Level"),
        F.col("y_n").alias("Historical_Orders"),
        half_even(F.col("sum_out"), 2).alias("Historical_Total_Output_BF"),
        half_even(F.col("sum_in"), 2).alias("Historical_Total_Input_BF"),
        half_even(F.col("hist_avg_out"), 2).alias("Historical_Avg_Output_BF"),
        half_even(score, 4).alias("Recommendation_Score"),
        "Model_Type",
        half_even(F.lit(r2), 4).alias("Model_R2"),
    )


def simulate_lines(requests: DataFrame, history: DataFrame, predictor: Predictor) -> DataFrame:
    """Per-line simulation rolled up by output: every line is blended with its own material's history first."""
    line = ["request_id", "line_no"]
    scored = predict_yield(requests, predictor).select(
        *line, F.col("Total_Input_BF").alias("line_bf"), F.col("predicted").alias("model_yield")
    )
    n = F.col("y_n")
    rows = _history_for(requests, line, history_pairs(history)).join(scored, line).withColumns({
        "hist_yield": F.col("y_s1") / n, "hist_std": pooled_std(n, F.col("y_s1"), F.col("y_s2")),
    })
    model = F.coalesce(F.col("model_yield"), F.col("hist_yield"))
    final = blended_yield(model, F.col("hist_yield"), n)
    per_line = rows.select(
        *line, "Output_Material", "line_bf",
        half_even(final, 2).alias("final"),
        half_even(model, 2).alias("model"),
        half_even(F.col("hist_yield"), 2).alias("hist"),
        half_even(F.coalesce(F.col("hist_std"), F.lit(0.0)), 2).alias("std"),
        n.alias("orders"),
        half_even(F.col("line_bf") * final / F.lit(100.0), 2).alias("out_bf"),
    )
    lines = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_lines"))
    rolled = per_line.groupBy("request_id", "Output_Material").agg(
        F.avg("final").alias("Predicted_Yield_Pct"),
        F.avg("model").alias("Model_Yield_Pct"),
        F.avg("hist").alias("Historical_Yield_Pct"),
        F.avg("std").alias("Yield_Std"),
        F.sum("orders").alias("Historical_Orders"),
        F.sum("line_bf").alias("Input_BF"),
        F.sum("out_bf").alias("Predicted_Output_BF"),
    )
    kind = F.when(F.col("_lines") > 1, F.lit("Multi-Input")).otherwise(F.lit("Single-Input"))
    return rolled.join(lines, "request_id").withColumn("Model_Type", kind).drop("_lines")


def fallback_predictions(requests: DataFrame, predictor: Predictor) -> DataFrame:
    """One cautious row per line, for use when there is no history at all."""
    scored = forward_predict(requests, predictor)
    return scored.select(
        "request_id", "line_no",
        F.lit("Predicted Output").alias("Output_Material"),
        F.col("predicted_yield_pct").alias("Predicted_Yield_Pct"),
        F.col("predicted_output_bf").alias("Predicted_Output_BF"),
        F.col("predicted_yield_pct").alias("Historical_Yield_Pct"),
        F.lit(0).cast("bigint").alias("Historical_Orders"),
        F.lit("Single-Input").alias("Model_Type"),
        F.lit("LOW").alias("Confidence_Level"),
        F.lit("HIGH").alias("Risk_Level"),
        F.lit(30).alias("Confidence_Score"),
    )


def with_fallback(results: DataFrame, requests: DataFrame, predictor: Predictor) -> DataFrame:
    """Append fallback rows for requests that got no result."""
    missing = requests.join(results.select("request_id").distinct(), "request_id", "left_anti")
    return results.unionByName(fallback_predictions(missing, predictor).drop("line_no"), allowMissingColumns=True)


def top_recommendation(results: DataFrame) -> DataFrame:
    """Best output per request by recommendation score (smallest name on a tie) with its strength and wording."""
    carried = [c for c in results.columns if c != "request_id"]
    best = F.min_by(F.struct(*carried), F.struct(-F.col("Recommendation_Score"), F.col("Output_Material")))
    top = results.groupBy("request_id").agg(best.alias("b")).select("request_id", "b.*")
    level, expected = F.col("Confidence_Level"), F.col("Predicted_Yield_Pct")
    strength = (
        F.when((level == "HIGH") & (expected >= 70), F.lit("STRONG"))
        .when(level.isin("HIGH", "MEDIUM") & (expected >= 60), F.lit("MODERATE"))
        .otherwise(F.lit("WEAK"))
    )

    def whole(name: str) -> Column:
        return F.format_number(F.rint(F.col(name)).cast("bigint"), 0)

    def tenth(name: str) -> Column:
        return half_even(F.col(name), 1)

    return top.select(
        "request_id",
        F.lit(True).alias("has_recommendation"),
        strength.alias("strength"),
        F.col("Output_Material").alias("output_material"),
        expected.alias("expected_yield"),
        F.format_string("%.1f%% - %.1f%%", tenth("Yield_Min_Pct"), tenth("Yield_Max_Pct")).alias("yield_range"),
        F.col("Predicted_Output_BF").alias("expected_output_bf"),
        F.concat(whole("Output_Min_BF"), F.lit(" - "), whole("Output_Max_BF"), F.lit(" BF")).alias("output_range_bf"),
        level.alias("confidence_level"),
        F.col("Confidence_Score").alias("confidence_score"),
        F.col("Risk_Level").alias("risk_level"),
        F.col("Historical_Orders").alias("historical_orders"),
        F.col("Recommendation_Score").alias("recommendation_score"),
        F.col("Yield_Std").alias("yield_std"),
        F.col("Model_R2").alias("model_r2"),
        F.col("Historical_Yield_Pct").alias("historical_yield"),
        F.format_string(
            "%d historical orders of %s: %s confidence, expected yield %.1f%%",
            F.col("Historical_Orders"), F.col("Output_Material"), level, tenth("Predicted_Yield_Pct"),
        ).alias("message"),
    )


def thin_history_estimate(recommendations: DataFrame) -> DataFrame:
    """Loss figures of a recommendation and, for thin history, the output at the fixed average yield."""
    expected, output = F.col("expected_yield"), F.col("expected_output_bf")
    total = F.when(expected > 0, output / (expected / F.lit(100.0))).otherwise(F.lit(0.0))
    thin = F.col("historical_orders") <= THIN_HISTORY
    return recommendations.select(
        "request_id", "output_material", "historical_orders",
        half_even(F.lit(100.0) - expected, 2).alias("production_loss_pct"),
        half_even(total - output, 2).alias("loss_bf"),
        thin.alias("limited_data"),
        half_even(F.when(thin, total * F.lit(SAFE_YIELD_PCT / 100)), 2).alias("safer_output_bf"),
    )


def prediction_summary(results: DataFrame, models_evaluated: int, best_r2: float, lowest_rmse: float) -> DataFrame:
    """Per request: number of outputs, the best by yield (smallest name on a tie), mean yield, model figures."""
    best = F.min_by(
        F.struct("Output_Material", "Predicted_Yield_Pct", "Predicted_Output_BF"),
        F.struct(-F.col("Predicted_Yield_Pct"), F.col("Output_Material")),
    )
    summed = results.groupBy("request_id").agg(
        F.max("Input_BF").alias("total_input_bf"),
        F.count(F.lit(1)).alias("num_outputs"),
        best.alias("b"),
        F.avg("Predicted_Yield_Pct").alias("avg_yield_pct"),
        F.bool_or(F.col("Model_Type") == "Multi-Input").alias("multi_input_advantage"),
    )
    return summed.select(
        "request_id", "total_input_bf", "num_outputs",
        F.col("b.Output_Material").alias("best_output"),
        F.col("b.Predicted_Yield_Pct").alias("best_yield_pct"),
        F.col("b.Predicted_Output_BF").alias("best_output_bf"),
        "avg_yield_pct", "multi_input_advantage",
        F.lit(models_evaluated).alias("models_evaluated"),
        F.lit(float(best_r2)).alias("best_r2"),
        F.lit(float(lowest_rmse)).alias("lowest_rmse"),
    )


def best_case_waste(summary: DataFrame) -> DataFrame:
    """What is lost even if the best output of the request is made."""
    return summary.select(
        "request_id", "best_output",
        half_even(F.col("total_input_bf") - F.col("best_output_bf"), 2).alias("waste_bf"),
        half_even(F.lit(100.0) - F.col("best_yield_pct"), 2).alias("waste_pct"),
    )
