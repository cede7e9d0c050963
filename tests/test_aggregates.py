import pytest
from conftest import by
from pyspark.sql import functions as F

from yieldengine import staging
from yieldengine.operators import aggregates, history, orders
from yieldengine.operators.volume import derive_input_volume, derive_output_volume, with_valid_yield, with_yield
from yieldengine.schema import ORDER

IN = [
    ("1", None, "S1", "1C", "P", 4.0, 10.0, 2.0, 100.0, False),
    ("1", "M1", "S2", "1c", "P", 6.0, 20.0, 4.0, 50.0, False),
    ("2", "M2", None, None, "Q", 4.0, 0.0, 0.0, 0.0, False),
]
OUT = [
    ("1", "K1", "S", "B", "P", 1.0, 1.0, 1.0, 30.0, False),
    ("1", "K1", "S", "A", "P", 3.0, 1.0, 1.0, 30.0, False),
    ("1", "K1", "S", "C", "P", 2.0, 1.0, 1.0, 10.0, False),
    ("1", "K2", None, None, "P", 2.0, 1.0, 1.0, 20.0, False),
    ("2", "K1", "S", "A", "P", 2.0, 1.0, 1.0, 5.0, False),
    ("9", "K1", "S", "A", "P", 2.0, 1.0, 1.0, 5.0, False),
    ("1", None, "S", "A", "P", 2.0, 1.0, 1.0, 5.0, False),
]


def test_inputs_take_first_known_value_and_means(ledger):
    got = by(aggregates.aggregate_inputs(ledger("BFIN", IN)), ORDER)
    assert got["1"]["Total_Input_BF"] == 150 and got["1"]["Input_Material"] == "M1"
    assert got["1"]["Input_Specie"] == "S1" and got["1"]["Input_Grade"] == "1C" and got["1"]["Input_Thickness"] == 5
    assert got["2"]["Input_Specie"] is None


def test_outputs_dominant_grade(ledger):
    got = by(aggregates.aggregate_outputs(ledger("BFOUT", OUT)), ORDER, "Output_Material")
    assert got["1", "K1"]["Output_Grade"] == "A"  # tie with B, smallest name
    assert got["1", "K2"]["Output_Grade"] is None and got["1", "K2"]["Output_Specie"] is None
    assert got["1", "K1"]["Total_Output_BF"] == 70 and got["1", "K1"]["Output_Thickness"] == 2
    assert len(got) == 4
    plain = aggregates.aggregate_outputs(ledger("BFOUT", OUT), with_grade=False)
    assert "Output_Grade" not in plain.columns and plain.count() == 4
    ungraded = aggregates.aggregate_outputs(ledger("BFOUT", OUT).drop("TALLYGRADE"))
    assert {r[0] for r in ungraded.select("Output_Grade").distinct().collect()} == {"N/A"}


def test_yield_and_statistics(ledger):
    joined = history.yield_history(ledger("BFIN", IN), ledger("BFOUT", OUT))
    got = by(joined, ORDER, "Output_Material")
    assert got["1", "K1"]["Yield_Percentage"] == pytest.approx(46.6667, abs=1e-3)
    assert got["2", "K1"]["Yield_Percentage"] == 0  # nothing consumed
    assert history.same_material_count(joined).first()["same_material_rows"] == 0
    stats = by(history.yield_by_material(joined), "Input_Material", "Output_Material")
    assert stats["M1", "K1"]["Std_Yield"] is None and stats["M1", "K1"]["Order_Count"] == 1


@pytest.mark.parametrize("bfout, bfin, dims, expected", [
    (5.0, 7.0, True, 5.0), (0.0, 7.0, True, 7.0), (0.0, 0.0, True, 2.0), (-1.0, None, True, 2.0),
])
def test_output_volume_priority(spark, bfout, bfin, dims, expected):
    df = spark.createDataFrame(
        [(bfout, bfin, 4.0, 12.0, 6.0)],
        "BFOUT double, BFIN double, MATERIALTHICKNESS double, TALLYWIDTH double, TALLYLENGTH double",
    )
    assert derive_output_volume(df).first()["BFOUT"] == expected


def test_volume_sources_missing(spark):
    df = spark.createDataFrame([(0.0,)], "BFOUT double")
    with pytest.raises(Exception, match="dimension columns"):
        derive_output_volume(df).collect()
    with pytest.raises(ValueError):
        derive_output_volume(df.drop("BFOUT").withColumn("x", F.lit(1)))
    with pytest.raises(ValueError):
        derive_input_volume(df)


def test_choice_is_per_table_not_per_row(spark):
    df = spark.createDataFrame(
        [(0.0, 4.0, 12.0, 6.0), (9.0, 4.0, 12.0, 6.0), (-3.0, 1.0, 1.0, 1.0)],
        "BFIN double, MATERIALTHICKNESS double, TALLYWIDTH double, TALLYLENGTH double",
    )
    assert [r[0] for r in derive_input_volume(df).select("BFIN").collect()] == [0.0, 9.0, 0.0]


def test_valid_yield(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.0, 11.0), (0.0, 5.0), (10.0, 0.0), (10.0, 10.0)],
                               "Total_Input_BF double, Total_Output_BF double")
    assert [r["Yield_Percentage"] for r in with_valid_yield(df).collect()] == [50.0, 100.0]
    assert with_yield(df).count() == 5


def test_states_of_parts_give_the_aggregates_of_the_whole(ledger, spark, tmp_path):
    """Whatever the volume comes from: given, from BFIN, from dimensions; orders that span years; a year read again."""
    from yieldengine.operators import states

    rows = [(str(i % 5), "AB"[i % 2], "ST"[i % 3 > 0] if i % 4 else None, "XY"[i % 3 == 1] if i % 7 else None, "P", float(i % 3), 2.0 + i, 12.0,
             float(i - 2), False) for i in range(40)]
    for volume, change in (("BFIN", {}), ("BFIN", {"BFIN": F.lit(0.0)}), ("BFOUT", {}), ("BFOUT", {"BFOUT": F.lit(0.0)}),
                           ("BFOUT", {"BFOUT": F.lit(0.0), "BFIN": F.col("BFOUT")})):
        df = ledger(volume, rows).withColumns(change)
        side, of, whole, plain = (
            ("inputs", states.input_states, states.inputs_of, aggregates.aggregate_inputs) if volume == "BFIN"
            else ("outputs", states.output_states, states.outputs_of, aggregates.aggregate_outputs)
        )
        folder = f"{tmp_path}/{volume}{len(change)}"
        for year, part in (("2024", df.where("ROW_SEQ.n % 3 = 0")), ("2025", df.limit(3)), ("2025", df.where("ROW_SEQ.n % 3 > 0"))):
            states.refresh_year(of(part), folder, year)
        want = sorted(plain(df).collect(), key=str)
        for got in (whole(states.read_states(spark, folder, side)), whole(of(df))):
            assert set(got.columns) == set(plain(df).columns)
            assert sorted(got.select(*plain(df).columns).collect(), key=str) == want
    with pytest.raises(ValueError, match="BFIN"):
        states.input_states(ledger("BFIN", rows).select(ORDER, "ROW_SEQ"))


def test_order_lists(ledger, monkeypatch):
    rows = [("1", m, "S", "A", "P", 1.0, 1.0, 1.0, float(i), False) for i, m in enumerate("BABCA")]
    rows.append(("2", "Z", "S", "A", "P", 1.0, 1.0, 1.0, 4.0, False))
    df = ledger("BFOUT", rows)
    part = F.floor(F.col("ROW_SEQ.n") / 2)
    got = by(orders.materials_per_order(df, part), ORDER)
    assert got["1"]["Materials"] == list("BABCA")
    monkeypatch.setattr(orders, "BLOCK_POSITIONS", 2)
    got = by(orders.materials_per_order(df, part), ORDER, "block")
    assert {k: r["Materials"] for k, r in got.items()} == {("1", 0): ["B", "A"], ("1", 1): ["B", "C"], ("1", 2): ["A"], ("2", 0): ["Z"]}
    assert by(orders.distinct_materials_per_order(df), ORDER)["1"]["KD_Materials"] == list("BAC")
    placed = orders.materials_in_order(df, F.floor(F.col("ROW_SEQ.n") / 2)).orderBy(ORDER, "position").collect()
    assert [tuple(r) for r in placed] == [*(("1", i + 1, m) for i, m in enumerate("BABCA")), ("2", 1, "Z")]
    joined = by(orders.input_then_output_materials(df, df.where("MATERIAL <> 'Z'")), ORDER)
    assert joined["1"]["Materials"] == list("BBAC") and joined["2"]["Materials"] == ["Z"]
    mixed = by(orders.order_output_mix(df), ORDER, "MATERIAL")
    assert mixed["1", "A"]["Total_BFOUT"] == 5 and mixed["1", "A"]["Input_Percentage"] == 50.0


def test_order_summary(ledger):
    issued = ledger("BFIN", [("1", "A", "S", "A", "P", 1.0, 1.0, 1.0, 10.0, False), ("1", "B", "S", "A", "P", 1.0, 1.0, 1.0, 5.0, False),
                             ("1", "A", "S", "A", "P", 1.0, 1.0, 1.0, 10.0, False), ("2", "A", "S", "A", "P", 1.0, 1.0, 1.0, 0.0, False)])
    received = ledger("BFOUT", [("1", "K", "S", "A", "P", 1.0, 1.0, 1.0, 15.0, False)])
    got = by(orders.order_yield_summary(issued, received), ORDER)
    assert got["1"]["KS_BFIN"] == 20 and got["1"]["Yield_Percentage"] == 75.0
    assert got["2"]["Yield_Percentage"] is None and got["2"]["Total_BFOUT"] == 0


def test_clustered_history_equals_yield_history(ledger):
    """Whatever the ledgers are measured by, with grades or without, and after its tables are removed."""
    without = [("BFIN", "BFOUT"), ("TALLYGRADE",), ("MATERIALSPECIE", "TALLYGRADE")]
    issued, received = ledger("BFIN", IN), ledger("BFOUT", OUT)
    zero = received.withColumn("BFOUT", F.lit(0.0))
    pairs = [(issued, received), (issued, zero), (issued, zero.withColumn("BFIN", F.lit(2.0)))]
    pairs += [(issued.drop(*c), received.drop(*c)) for c in without] + [(issued.limit(0), received.limit(0))]
    for left, right in pairs:
        plain = history.yield_history(left, right)
        clustered = history.clustered_history(left, right)
        assert sorted(clustered.columns) == sorted(plain.columns)
        got = sorted(map(repr, clustered.select(plain.columns).collect()))
        assert got == sorted(map(repr, plain.collect()))


def test_staged_tables_are_removed(spark, ledger, monkeypatch):
    monkeypatch.setattr(staging, "_staged", [])  # those of other tests stay
    monkeypatch.setattr(staging, "_tables", [])
    sides = history.clustered_sides(ledger("BFIN", IN), ledger("BFOUT", OUT))
    assert sides[0].count() > 0
    names = list(staging._tables)
    assert len(names) == 2 and all(spark.catalog.tableExists(name) for name in names)
    staging.remove_staged(spark)
    assert not any(spark.catalog.tableExists(name) for name in names) and not staging._staged
