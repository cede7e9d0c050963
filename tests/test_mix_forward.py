import random

import pytest
from conftest import by
from pyspark.sql import functions as F

from yieldengine.operators import forward, mix, ranking
from yieldengine.operators.predictors import mean_yield_predictor
from yieldengine.schema import FORWARD_REQUEST, KD_REQUEST, ORDER
from yieldengine.sources.ledgers import demo_ledgers, from_rows

HIST = [
    ("1", "M1", "P", "A", "K1", "G1", 100.0, 60.0), ("1", "M1", "P", "A", "K2", "G1", 100.0, 30.0),
    ("2", "M1", "Q", "A", "K1", "G1", 200.0, 100.0), ("3", "M1", "P", "B", "K1", "G2", 100.0, 10.0),
    ("4", "M2", "P", "A", "K1", "G1", 100.0, 0.0), ("5", "M2", "P", "A", "K1", "G1", 50.0, 0.0),
    ("6", "M2", "P", "A", "K2", "G1", 50.0, 0.0), ("7", "M1", "P", "A", "K2", None, 50.0, 5.0),
]


def kd(spark, *requests):
    rows = [{"input_bf": 10_000.0, "wastage_pct": 9.0, **r} for r in requests]
    return from_rows(spark, rows, KD_REQUEST)


def test_demo_shares(spark):
    inputs, outputs = demo_ledgers(spark)
    got = by(mix.compare_shares(outputs), "Output_Material")
    assert [got[k]["Historical_Pct_bf"] for k in ("KS1C", "KS2C", "KS3C", "KS4C")] == pytest.approx([10, 20, 40, 30])
    assert {r["Historical_Pct_count"] for r in got.values()} == {25.0}
    total_in, total_out = inputs.agg(F.sum("Total_Input_BF")).first()[0], outputs.agg(F.sum("Total_Output_BF")).first()[0]
    expected = mix.expected_volume(F.lit(90_000.0), F.lit(total_in), F.lit(total_out), F.lit(40.0))
    row = spark.range(1).select(*[c.alias(k) for k, c in expected.items()]).first()
    assert row["expected_output"] == pytest.approx(81_900) and row["expected_material_bf"] == pytest.approx(32_760)


def test_distribution_filters_and_fallback(spark, history):
    requests = kd(
        spark, {"request_id": "any", "material": "M1"}, {"request_id": "P", "material": "M1", "plant": "P"},
        {"request_id": "PA", "material": "M1", "plant": "P", "grade": "A"},
        {"request_id": "zero", "material": "M2"}, {"request_id": "none", "material": "M9"},
    )
    found = mix.kd_distribution(requests, history(HIST))
    got = by(found, "request_id", "Output_Material", "Output_Grade")
    assert got["any", "K1", "G1"]["BF_Output"] == 160 and got["any", "K1", "G1"]["Order_Count"] == 2
    assert got["any", "K1", "G1"]["Percentage"] == 80 and got["any", "K1", "G1"]["Avg_Yield"] == 55
    assert got["any", "K1", "G1"]["Yield_Std"] == 7.07 and got["any", "K2", "G1"]["Yield_Std"] == 0
    assert got["P", "K1", "G1"]["BF_Output"] == 60 and ("PA", "K1", "G2") not in got
    assert got["zero", "K1", "G1"]["Percentage"] == 66.67  # no volume: by order count
    assert not [k for k in got if k[0] == "none" or k[2] is None]
    for request in ("any", "P", "PA"):
        assert sum(r["Percentage"] for k, r in got.items() if k[0] == request) == pytest.approx(100, abs=0.05)

    allocated = mix.allocate_with_wastage(requests, found)
    plan = by(allocated, "request_id", "Output_Material", "Output_Grade")
    assert plan["any", "K1", "G1"]["Expected_Output_BF"] == 7280 and plan["any", "K1", "G1"]["total_expected_bf"] == 9100
    assert plan["none", None, None]["available_bf"] == 0 and plan["none", None, None]["total_expected_bf"] == 0
    ranked = ranking.by_expected_volume(allocated.where("request_id = 'any'")).collect()
    assert [r["Expected_Output_BF"] for r in ranked] == [7280, 1365, 455]
    listed = ranking.by_material_and_volume(found.where("request_id = 'any'")).collect()
    assert [(r["Output_Material"], r["BF_Output"]) for r in listed] == [("K1", 160), ("K1", 10), ("K2", 30)]
    order = mix.production_order(allocated, allocated.where("Percentage >= 10 and request_id = 'any'"))
    assert {(r["Output_Material"], r["Planned_Output_BF"]) for r in order.collect()} == {("K1", 7280.0), ("K2", 1365.0)}
    assert order.first()["selected_pct"] == 95


def test_documented_allocation(spark):
    requests = kd(spark, {"request_id": "r", "material": "M"})
    distribution = spark.createDataFrame([("r", "K", "1C", 34.0)], "request_id string, Output_Material string, Output_Grade string, Percentage double")
    row = mix.allocate_with_wastage(requests, distribution).first()
    assert (row["available_bf"], row["Expected_Output_BF"]) == (9100, 3094)


def test_history_totals_count_an_order_once(spark, history):
    got = mix.kd_lookup_totals_from_history(
        kd(spark, {"request_id": "a", "material": "M1", "plant": "P"}, {"request_id": "b", "material": "M9"}), history(HIST)
    )
    rows = by(got, "request_id")
    assert rows["a"]["total_hist_input_bf"] == 250 and rows["a"]["total_hist_output_bf"] == 105
    assert rows["b"]["historical_yield_pct"] == 0


def random_ledgers(ledger, n=4000):
    """A third of all lines belong to one order, and one material holds half of the input."""
    rng = random.Random(11)

    def order():
        return "hot" if rng.random() < 0.34 else str(rng.randrange(60))

    def line(materials):
        material = materials[0] if rng.random() < 0.5 else rng.choice(materials)
        return (order(), material, rng.choice("ST"), rng.choice("AB"), rng.choice("PQ"), 4.0, 96.0, 8.0,
                float(rng.randrange(50)), rng.random() < 0.1)

    issued = [line(["M1", "M2", "M3"]) for _ in range(n)]
    received = [line(["K1", "K2", "K3", "K4"]) for _ in range(n)]
    return issued, received, ledger("BFIN", issued), ledger("BFOUT", received)


@pytest.mark.parametrize("threshold", [5, 40, 1000])
def test_material_forward_against_brute_force(spark, ledger, threshold):
    issued, received, raw_261, raw_101 = random_ledgers(ledger)
    wanted = [(m, p) for m in ("M1", "M2", "M3", "M9") for p in "PQ"]
    requests = from_rows(spark, [
        {"request_id": f"{m}{p}", "ks_material": m, "plant": p, "input_bf": 10_000.0, "min_order_count": threshold}
        for m, p in wanted
    ], FORWARD_REQUEST)
    got = by(forward.material_forward(requests, raw_261, raw_101), "request_id", "KD_Material")
    for m, p in wanted:
        lines = [r for r in issued if r[1] == m and r[4] == p]
        if not lines:
            assert got[f"{m}{p}", None]["status"] == "no input history"
            continue
        orders = {r[0] for r in lines}
        outputs = [r for r in received if r[0] in orders]
        total_in, total_out = sum(r[8] for r in lines), sum(r[8] for r in outputs)
        kept = {}
        for k in {r[1] for r in outputs}:
            mine = [r for r in outputs if r[1] == k]
            if len({r[0] for r in mine}) > threshold:
                kept[k] = sum(r[8] for r in mine)
        if not kept:
            row = got[f"{m}{p}", None]
            assert row["status"] == "no output above threshold" and row["total_orders"] == len(orders)
            continue
        assert {k for r, k in got if r == f"{m}{p}"} == set(kept)
        for k, bf in kept.items():
            row = got[f"{m}{p}", k]
            assert row["Contribution_Pct"] == pytest.approx(bf / sum(kept.values()) * 100, abs=0.006)
            assert row["historical_yield_pct"] == pytest.approx(total_out / total_in * 100, abs=0.006)
            assert row["total_orders"] == len(orders) and row["kd_materials_count"] == len(kept)


def test_lookup_totals_against_brute_force(spark, ledger):
    issued, received, raw_261, raw_101 = random_ledgers(ledger)
    requests = kd(spark, {"request_id": "1", "material": "M1"}, {"request_id": "2", "material": "M1", "plant": "P", "grade": "A", "thickness": 4.0},
                  {"request_id": "3", "material": "M2", "species": "S"}, {"request_id": "4", "material": "M2", "thickness": 5.0})
    got = by(mix.kd_lookup_totals(requests, raw_261, raw_101), "request_id")
    tests = {"1": lambda r: r[1] == "M1", "2": lambda r: r[1] == "M1" and r[4] == "P" and r[3] == "A",
             "3": lambda r: r[1] == "M2" and r[2] == "S", "4": lambda r: False}
    for key, test in tests.items():
        lines = [r for r in issued if test(r)]
        orders = {r[0] for r in lines}
        assert got[key]["total_hist_input_bf"] == sum(r[8] for r in lines)
        assert got[key]["total_hist_output_bf"] == sum(r[8] for r in received if r[0] in orders)


def test_advanced_forward_with_and_without_model(spark, ledger, history):
    _, _, raw_261, raw_101 = random_ledgers(ledger)
    requests = from_rows(spark, [{"request_id": "r", "ks_material": "M1", "plant": "P", "input_bf": 1000.0, "min_order_count": 5}], FORWARD_REQUEST)
    model = mean_yield_predictor(history([("1", "M1", "P", "A", "K1", "G", 100.0, 80.0)]))
    row = forward.advanced_forward(requests, raw_261, raw_101, model).first()
    assert row["ml_yield_pct"] == 80 and row["predicted_output_bf"] == 800 and row["ml_confidence"] == "MEDIUM"
    row = forward.advanced_forward(requests, raw_261, raw_101, None).first()
    assert row["ml_yield_pct"] == row["historical_yield_pct"] and row["ml_confidence"] == "LOW"
    features = forward.typical_features(requests, raw_261.drop("TALLYLENGTH", "TALLYGRADE")).first()
    assert features["Input_Length"] == 96.0 and features["Input_Grade"] == "2C" and features["Input_Thickness"] == 4.0
