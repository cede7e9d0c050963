import random

import numpy as np
import pytest
from conftest import by

from yieldengine.functions import column_quantiles, grouped_quantiles
from yieldengine.functions import quantiles as module
from yieldengine.operators.history import fill_medians, remove_outliers, remove_outlier_chain


@pytest.fixture
def skewed(spark):
    """One group holds most rows, one is all ties, one is tiny; values repeat."""
    rng = random.Random(7)
    rows = [("hot", round(rng.gauss(90, 5), 2)) for _ in range(30_000)]
    rows += [("ties", 5.0)] * 12_000 + [("two", 1.0)] * 9_000 + [("two", 2.0)] * 9_000
    rows += [("small", float(v)) for v in (4, 1, 3, 2)] + [("one", 7.5), ("none", None)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(6)


def test_grouped_matches_numpy(skewed):
    rows, df = skewed
    wanted = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99}
    got = by(grouped_quantiles(df, ["k"], "v", wanted), "k")
    assert set(got) == {"hot", "ties", "two", "small", "one"}
    for key, row in got.items():
        values = [v for k, v in rows if k == key]
        for label, p in wanted.items():
            assert row[label] == pytest.approx(np.quantile(values, p), abs=1e-9), (key, label)


def test_ungrouped_matches_numpy(skewed):
    rows, df = skewed
    values = [v for _, v in rows if v is not None]
    got = grouped_quantiles(df, [], "v", {"q": 0.3}).first()["q"]
    assert got == pytest.approx(np.quantile(values, 0.3), abs=1e-9)


@pytest.mark.parametrize("bins", [2, 64, 4096])
def test_column_quantiles_descend_to_the_exact_value(skewed, monkeypatch, bins):
    monkeypatch.setattr(module, "BINS", bins)
    rows, df = skewed
    values = [v for _, v in rows if v is not None]
    probabilities = [0.0, 0.01, 0.5, 0.99, 1.0] if bins > 2 else [0.5]
    got = column_quantiles(df, "v", probabilities)
    assert got == pytest.approx([np.quantile(values, p) for p in probabilities], abs=1e-9)


def test_extreme_values(spark):
    values = [-1.7e308, -1.0, 0.0, 5e-324, 1e-300, 3.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    assert column_quantiles(df, "v", [i / 6 for i in range(7)])[1:6] == pytest.approx(values[1:6])


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert column_quantiles(df, "v", [0.5]) == [None]
    assert remove_outliers(df, "v").count() == 1 and remove_outliers(df, "absent").count() == 1


def test_outliers_are_trimmed_one_column_after_the_other(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(100, 20, size=(500, 3))
    columns = ["Yield_Percentage", "Total_Input_BF", "Total_Output_BF"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in columns))
    kept = data
    for i in range(3):
        low, high = np.quantile(kept[:, i], [0.01, 0.99])
        kept = kept[(kept[:, i] >= low) & (kept[:, i] <= high)]
    assert sorted(r[0] for r in remove_outlier_chain(df).collect()) == pytest.approx(sorted(kept[:, 0]))


def test_median_fill_touches_only_gaps(spark):
    df = spark.createDataFrame([(1.0, 1, "a"), (None, 2, None), (4.0, None, "b"), (3.0, 4, "c")], "x double, n int, s string")
    got = [tuple(r) for r in fill_medians(df).collect()]
    assert got == [(1.0, 1, "a"), (3.0, 2, None), (4.0, 2.0, "b"), (3.0, 4, "c")]


def test_a_sketch_that_misses_the_rank_only_costs_passes(skewed, monkeypatch):
    """Brackets beside the wanted ranks: the sides are descended into."""
    monkeypatch.setattr(module, "SLACK", -0.02)
    rows, df = skewed
    values = [v for _, v in rows if v is not None]
    wanted = [0.0, 0.2, 0.5, 0.8, 1.0]
    assert column_quantiles(df, "v", wanted) == pytest.approx([np.quantile(values, p) for p in wanted], abs=1e-9)


def test_a_column_takes_two_passes(spark, monkeypatch):
    """Distinct values: one pass for the sketch, one that counts."""
    df = spark.createDataFrame([(float(v) ** 1.5,) for v in range(20_000)], "v double").cache()
    df.count()
    passes = []
    for name in ("collect", "first"):
        method = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, *a, _m=method: (passes.append(1), _m(self, *a))[1])
    assert column_quantiles(df, "v", [0.01, 0.5, 0.99]) == pytest.approx(np.quantile(np.arange(20_000) ** 1.5, [0.01, 0.5, 0.99]))
    assert len(passes) <= 3
