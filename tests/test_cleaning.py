import pytest
from conftest import as_dicts, by
from pyspark.sql import Observation
from pyspark.sql import functions as F

from yieldengine.operators import cleaning
from yieldengine.schema import LEDGER_261, ORDER, canonicalise

RAW = " manufacturingorder  string, material string, plant string, is_deleted string, postingdate string, bfin string"


@pytest.fixture
def raw(spark):
    rows = [
        (" 1 ", "M1", "P", "FALSE", "2024-01-02", "10.5"),
        ("1", "M1", "P", "FALSE", "not a date", ""),
        ("2", "M2", "P", "TRUE", "2024-01-03", "5"),
        ("2", "M2", "P", None, "2024-01-03", "x"),
        (None, "M3", "P", "FALSE", None, "7"),
        ("3", None, "P", "FALSE", None, "7"),
        ("4", "M4", "P", "FALSE", None, "-1"),
        ("5", "M5", "P", "FALSE", None, "NaN"),
    ]
    names = [" manufacturingorder ", "Material", "plant", "is_deleted", "PostingDate", "bfin"]
    return spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(6))).toDF(*names)


def test_strict_drops_unknown_flags_and_fills_numbers(raw):
    report = Observation()
    rows = as_dicts(cleaning.clean_strict(raw, report))
    assert [(r[ORDER], r["BFIN"]) for r in rows] == [("1", 10.5), ("1", 0.0), ("3", 7.0), ("4", -1.0), ("5", 0.0)]
    assert report.get == {"rows": 8, "kept": 6}


def test_lenient_keeps_unknown_flags_and_drops_bad_rows(raw):
    rows = as_dicts(cleaning.clean_lenient(raw.unionByName(raw)))
    kept = sorted((r[ORDER], r["BFIN"]) for r in rows)
    assert kept == [("1", 10.5)]  # blanks and text are unknown volumes here, and -1 is negative
    assert rows[0]["POSTINGDATE"].isoformat().startswith("2024-01-02")


def test_lenient_without_volume_column(raw):
    rows = cleaning.clean_lenient(raw.drop("bfin"))
    assert rows.count() == 5 and rows.where(F.col("POSTINGDATE").isNull()).count() == 3


def test_raw_keeps_deleted_rows(raw):
    assert cleaning.raw_ledger(raw).agg(F.sum("BFIN")).first()[0] == pytest.approx(28.5)


def test_filters_and_search(spark):
    df = spark.createDataFrame([("4SM", "P1", 4.0), ("6sm", "P2", 6.0), ("4PO", "P1", 4.0)], "MATERIAL string, PLANT string, T double")
    assert cleaning.matching(df, PLANT="P1", T=4).count() == 2
    assert cleaning.matching_given(df, PLANT=None, T=4, ABSENT=1).count() == 2
    assert {r[0] for r in cleaning.search_material(df, "Sm").select("MATERIAL").collect()} == {"4SM", "6sm"}
    assert cleaning.search_material(df, "s", limit=1).count() == 1
    assert cleaning.display_columns(df, {"T": "Thickness", "X": "no"}).columns == ["Thickness"]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    got = by(cleaning.null_profile(df), "column_name")
    assert got["a"]["null_count"] == 1 and got["b"]["null_count"] == 2 and got["a"]["data_type"] == "int"


def test_canonicalise_adds_typed_columns(spark):
    df = canonicalise(spark.createDataFrame([("1", "4.5")], f"{ORDER} string, BFIN string"), LEDGER_261)
    assert df.schema["BFIN"].dataType.simpleString() == "double" and df.first()["PLANT"] is None
