import math
import statistics

import pytest
from conftest import by
from pyspark.sql import functions as F

from yieldengine.operators import planning, simulate
from yieldengine.operators.history import material_stats
from yieldengine.operators.predictors import forward_predict, mean_yield_predictor
from yieldengine.schema import REQUEST, REVERSE_REQUEST
from yieldengine.sources.ledgers import from_rows

HIST = [(f"a{i}", "M1", "P", "A", "K1", "G", 100.0, 80.0 + i % 5) for i in range(60)]
HIST += [(f"b{i}", "M1", "P", "A", "K2", "G", 100.0, 95.0) for i in range(3)]
HIST += [(f"c{i}", "M2", "P", "A", "K1", "G", 200.0, 190.0 - i) for i in range(10)]
HIST += [("d", "M3", "P", "A", "K3", "G", 50.0, 20.0)]


def lines(spark, *rows, schema=REQUEST):
    return from_rows(spark, [{"Input_Plant": "P", "line_no": 1, **r} for r in rows], schema)


@pytest.fixture
def requests(spark):
    return lines(
        spark, {"request_id": "one", "Input_Material": "M1", "Total_Input_BF": 1000.0},
        {"request_id": "two", "Input_Material": "M1", "Total_Input_BF": 1000.0},
        {"request_id": "two", "Input_Material": "M2", "Total_Input_BF": 500.0, "line_no": 2},
        {"request_id": "new", "Input_Material": "M9", "Total_Input_BF": 100.0},
        {"request_id": "new2", "Input_Material": "M8", "Total_Input_BF": 100.0},
    )


def yields(*materials, output):
    return [o / i * 100 for _, m, _, _, k, _, i, o in HIST if k == output and (m in materials or not materials)]


@pytest.mark.parametrize("request_id, materials", [("one", ["M1"]), ("two", ["M1", "M2"]), ("new", []), ("new2", [])])
def test_simulation_against_brute_force(requests, history, request_id, materials):
    past = history(HIST)
    model = mean_yield_predictor(past)
    got = by(simulate.simulate_outputs(requests, past, model), "request_id", "Output_Material")
    enhanced = by(simulate.simulate_outputs_enhanced(requests, past, model, 0.3), "request_id", "Output_Material")
    per_material = {m: statistics.mean(o / i * 100 for _, x, _, _, _, _, i, o in HIST if x == m) for m in ("M1", "M2", "M3")}
    overall = statistics.mean(o / i * 100 for *_, i, o in HIST)
    asked = {"one": ["M1"], "two": ["M1", "M2"], "new": ["M9"], "new2": ["M8"]}[request_id]
    model_yield = statistics.mean(round(per_material.get(m, overall), 2) for m in asked)
    outputs = {k for _, m, _, _, k, *_ in HIST if m in materials or not materials}
    assert {k for r, k in got if r == request_id} == outputs
    for output in outputs:
        y = yields(*materials, output=output)
        w = min(len(y) / 100, 0.7)
        row, rich = got[request_id, output], enhanced[request_id, output]
        assert row["Historical_Orders"] == len(y)
        assert row["Predicted_Yield_Pct"] == pytest.approx(w * statistics.mean(y) + (1 - w) * model_yield, abs=0.006)
        assert row["Yield_Std"] == pytest.approx(statistics.stdev(y) if len(y) > 1 else 0, abs=0.006)
        assert row["Model_Type"] == ("Multi-Input" if request_id == "two" else "Single-Input")
        assert rich["Predicted_Yield_Pct"] == row["Predicted_Yield_Pct"] and rich["Model_R2"] == 0.3
        assert rich["Yield_Min_Pct"] <= rich["Predicted_Yield_Pct"] <= rich["Yield_Max_Pct"]
        if len(y) == 1:
            assert rich["Yield_Std"] == 15
        assert rich["Recommendation_Score"] == pytest.approx(
            rich["Predicted_Yield_Pct"] / 100 * rich["Confidence_Score"] / 100, abs=1e-4)
    if request_id == "two":
        assert row["Input_Material"] == "M1, M2" and row["Input_BF"] == 1500


def test_lines_are_blended_before_the_roll_up(requests, history):
    past = history(HIST)
    got = by(simulate.simulate_lines(requests, past, mean_yield_predictor(past)), "request_id", "Output_Material")
    row = got["two", "K1"]
    parts = []
    for material, bf in (("M1", 1000.0), ("M2", 500.0)):
        y = yields(material, output="K1")
        model = statistics.mean(o / i * 100 for _, x, _, _, _, _, i, o in HIST if x == material)
        w = min(len(y) / 100, 0.7)
        final = w * statistics.mean(y) + (1 - w) * model
        parts.append((round(final, 2), round(bf * final / 100, 2)))
    assert row["Predicted_Yield_Pct"] == pytest.approx(statistics.mean(p[0] for p in parts), abs=0.011)
    assert row["Predicted_Output_BF"] == pytest.approx(sum(p[1] for p in parts), abs=0.02)
    assert row["Model_Type"] == "Multi-Input" and got["two", "K2"]["Input_BF"] == 1000


def test_recommendation_summary_and_fallback(spark, requests, history):
    past = history(HIST)
    model = mean_yield_predictor(past)
    results = simulate.simulate_outputs_enhanced(requests, past, model, 0.3)
    top = by(simulate.top_recommendation(results), "request_id")
    assert top["one"]["output_material"] == "K1" and top["one"]["strength"] == "STRONG"
    assert "60 historical orders of K1" in top["one"]["message"]
    summary = by(simulate.prediction_summary(results, 3, 0.3, 3.9), "request_id")
    assert summary["one"]["num_outputs"] == 2 and summary["two"]["multi_input_advantage"]
    assert summary["one"]["best_output"] == "K2"  # highest yield, not highest score
    waste = by(simulate.best_case_waste(simulate.prediction_summary(results, 3, 0.3, 3.9)), "request_id")
    assert waste["one"]["waste_pct"] == pytest.approx(100 - summary["one"]["best_yield_pct"])
    empty = results.where("request_id <> 'new'")
    filled = by(simulate.with_fallback(empty, requests, model), "request_id", "Output_Material")
    assert filled["new", "Predicted Output"]["Confidence_Score"] == 30
    thin = simulate.thin_history_estimate(spark.createDataFrame(
        [("r", "K", 5, 80.0, 800.0), ("s", "K", 6, 80.0, 800.0)],
        "request_id string, output_material string, historical_orders bigint, expected_yield double, expected_output_bf double"))
    rows = by(thin, "request_id")
    assert rows["r"]["safer_output_bf"] == 915 and rows["s"]["safer_output_bf"] is None and rows["r"]["loss_bf"] == 200
    assert simulate.usable_r2(None) == 0.2 and simulate.usable_r2(0.1) == 0.2 and simulate.usable_r2(0.4) == 0.4


def test_deduplicated_input_not_above_repeated(history):
    rows = [("1", "M1", "P", "A", "K1", "G", 100.0, 50.0), ("1", "M1", "P", "A", "K2", "G", 100.0, 20.0), ("2", "M1", "P", "A", "K1", "G", 10.0, 5.0)]
    assert simulate.order_deduplicated_input(history(rows), ["Input_Material"]).first()["Total_Input_BF"] == 110


def fixed_model(value):
    return lambda rows: rows.withColumn("raw_yield", F.lit(value).cast("double"))


def stats_table(spark, std=4.0):
    return spark.createDataFrame([("M1", 80.0, std, 10)], "Input_Material string, mean double, std double, count bigint")


def test_bounds_and_plans(spark):
    asked = lines(
        spark, {"request_id": "known", "Input_Material": "M1", "Total_Input_BF": 1000.0, "required_output_bf": 800.0, "safety_margin_pct": 5.0},
        {"request_id": "new", "Input_Material": "M7", "Total_Input_BF": 1000.0, "required_output_bf": 800.0, "safety_margin_pct": 5.0},
        schema=REVERSE_REQUEST)
    confident = planning.with_confidence(asked, fixed_model(80.0), stats_table(spark))
    forward = by(planning.plan_forward(confident), "request_id")
    assert (forward["known"]["lower_bound_pct"], forward["known"]["upper_bound_pct"]) == (73.42, 86.58)
    assert forward["new"]["lower_bound_pct"] == pytest.approx(80 - 1.645 * 5, abs=0.006)  # model error instead
    assert forward["known"]["expected_output_bf"] == 800 and forward["known"]["pessimistic_output_bf"] == 734.2
    reverse = by(planning.plan_reverse(confident), "request_id")
    assert reverse["known"]["required_input_bf"] == 1050
    assert reverse["known"]["conservative_input_bf"] == pytest.approx(800 / 0.7342, abs=0.006)
    zero = by(planning.plan_reverse(planning.with_confidence(asked, fixed_model(0.0), stats_table(spark, 0.0))), "request_id")
    assert zero["known"]["required_input_bf"] == 840 and zero["known"]["conservative_input_bf"] == 960
    assert zero["known"]["optimistic_input_bf"] == 720
    ninety_five = planning.with_confidence(asked, fixed_model(80.0), stats_table(spark), level=0.95)
    assert by(ninety_five, "request_id")["known"]["lower_bound_pct"] == pytest.approx(80 - 1.96 * 4)
    simple = by(planning.reverse_predict(asked, fixed_model(0.0)), "request_id")
    assert simple["known"]["predicted_yield_pct"] == 70 and simple["known"]["required_input_no_safety_bf"] == pytest.approx(1142.86)
    assert by(forward_predict(asked, fixed_model(None)), "request_id")["new"]["predicted_yield_pct"] == 70
    assert by(forward_predict(asked, fixed_model(400.0)), "request_id")["new"]["predicted_yield_pct"] == 150
    waste = planning.waste_estimate(asked.withColumn("y", F.lit(72.5)), "Total_Input_BF", "y").first()
    assert (waste["output_bf"], waste["waste_bf"], waste["waste_pct"]) == (725, 275, 27.5)


def test_comparison_order_and_costs(spark):
    asked = lines(spark, *[{"request_id": m, "Input_Material": m, "Total_Input_BF": 1.0} for m in ("M1", "M2", "M3")])
    confident = planning.with_confidence(asked, fixed_model(80.0), stats_table(spark))
    prices = spark.createDataFrame([("M2", 2.0), ("M1", 4.0)], "material string, price_per_bf double")
    ranked = planning.rank_materials(planning.compare_materials(confident, stats_table(spark), prices)).collect()
    assert [r["Material"] for r in ranked] == ["M2", "M1", "M3"]
    assert ranked[0]["Effective_Cost_Per_BF_Output"] == 2.5 and ranked[2]["Effective_Cost_Per_BF_Output"] is None
    assert ranked[1]["Historical_Orders"] == 10
    worthless = planning.with_confidence(asked, fixed_model(0.0), stats_table(spark))
    costs = by(planning.compare_materials(worthless, stats_table(spark), prices), "Material")
    assert math.isinf(costs["M1"]["Effective_Cost_Per_BF_Output"])
    unpriced = planning.rank_materials(planning.compare_materials(confident, stats_table(spark)))
    assert "Price_Per_BF_Input" not in unpriced.columns


@pytest.mark.parametrize("actual, material, kind, causes", [
    (80.0, "M1", None, 0), (88.0, "M1", None, 0), (88.1, "M1", "HIGH_YIELD", 4), (71.0, "M1", "LOW_YIELD", 5),
    (60.0, "M1", "LOW_YIELD", 6), (70.1, "M7", None, 0), (69.9, "M7", "LOW_YIELD", 5),
])
def test_anomalies(spark, actual, material, kind, causes):
    rows = spark.createDataFrame([(material, "P", actual)], "Input_Material string, Input_Plant string, Yield_Percentage double")
    row = planning.detect_anomalies(rows, fixed_model(80.0), stats_table(spark)).first()
    assert row["anomaly_type"] == kind and len(row["possible_causes"]) == causes and row["is_anomaly"] == (kind is not None)
    flat = planning.detect_anomalies(rows, fixed_model(80.0), stats_table(spark, 0.0)).first()
    if material == "M1":
        assert flat["deviation_std"] == 0 and not flat["is_anomaly"]


def test_material_stats_of_fewer_than_three_rows_are_not_usable(history):
    got = by(material_stats(history(HIST)), "Input_Material")
    assert {m for m, r in got.items() if r["usable"]} == {"M1", "M2"} and "M3" in got and got["M1"]["count"] == 63
