import json
import threading
from dataclasses import replace

import numpy as np
import pytest
from conftest import as_dicts, by
from pyspark.sql import functions as F

from yieldengine.jobs import train as job
from yieldengine.ml import artifacts, classification, evaluation, regression
from yieldengine.operators import encode
from yieldengine.operators.predictors import forward_predict
from yieldengine.plans.datasets import prepare_dataset
from yieldengine.schema import FEATURE_COLUMNS, ORDER
from yieldengine.sources import exports, ledgers
from yieldengine.sources.history import load_history

HEADER_261 = " ManufacturingOrder ,MATERIAL,MATERIALSPECIE,TALLYGRADE,PLANT,MATERIALTHICKNESS,TALLYLENGTH,TALLYWIDTH,BFIN,IS_DELETED"
HEADER_101 = "MANUFACTURINGORDER,MATERIAL,MATERIALSPECIE,TALLYGRADE,PLANT,MATERIALTHICKNESS,TALLYLENGTH,TALLYWIDTH,BFOUT,IS_DELETED"


def write_year(folder, year, orders, start=0):
    rng = np.random.default_rng(int(year))
    issued, received = [HEADER_261], [HEADER_101]
    for n in range(start, start + orders):
        k = n % 3
        loss = 0.80 + 0.05 * k + rng.normal(0, 0.01)
        bf = 100 + rng.integers(0, 50)
        issued.append(f" {n} ,M{k},S{k % 2},G{n % 2},P{n % 2},{4 + k},{96 + n % 4},8,{bf},False")
        issued.append(f"{n},X{k},S0,G0,P0,4,96,8,9999,True")
        received.append(f"{n},K{k},S{k % 2},G0,P{n % 2},{4 + k},96,8,{bf * loss:.4f},False")
    (folder / f"261_{year}.csv").write_text("\n".join(issued) + "\n")
    (folder / f"101_{year}.csv").write_text("\n".join(received) + "\n")


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledgers")
    write_year(folder, "2024", 150)
    write_year(folder, "2025", 150, start=150)
    (folder / "261_2026.csv").write_text(HEADER_261 + "\n")
    (folder / "notes.csv").write_text("a\n1\n")
    return folder


def test_years_need_both_ledgers(spark, data_dir):
    assert [r["year"] for r in ledgers.available_years(spark, str(data_dir)).collect()] == ["2024", "2025"]


def test_yearly_union_and_errors(spark, data_dir):
    with pytest.warns(UserWarning, match="101_2026"):
        issued, received = ledgers.read_year_ledgers(spark, str(data_dir), ["2024", "2026"])
    assert issued.where("_SOURCE_YEAR = '2024'").count() == 300 and received.count() == 150
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        ledgers.read_year_ledgers(spark, str(data_dir), ["2026"])


def test_raw_ledgers_keep_deleted_rows(spark, data_dir):
    raw_261, raw_101 = ledgers.read_raw_ledgers(spark, str(data_dir), ["2024"])
    assert raw_261.count() == 300 and raw_261.agg(F.sum("BFIN")).first()[0] > 9999 * 150
    assert dict(raw_101.dtypes)["BFOUT"] == "double" and raw_261.first()[ORDER] == "0"


def test_row_sequence_follows_the_file(spark, data_dir):
    issued, _ = ledgers.read_year_ledgers(spark, str(data_dir), ["2025", "2024"])
    first = issued.orderBy("ROW_SEQ").limit(3).collect()
    assert [r[ORDER].strip() for r in first] == ["150", "150", "151"]


def test_parquet_round_trip_prunes_years(spark, data_dir, tmp_path):
    issued, _ = ledgers.read_year_ledgers(spark, str(data_dir), ["2024", "2025"])
    ledgers.write_ledger(issued, str(tmp_path / "l"))
    assert ledgers.read_ledger_parquet(spark, str(tmp_path / "l"), ["2025"]).count() == 300


def test_option_lists(spark, data_dir, tmp_path):
    pair = ledgers.read_year_ledgers(spark, str(data_dir), ["2024"])
    found = ledgers.load_option_lists(spark, None, pair)
    assert [r["value"] for r in found.where("option = 'Output_Material'").collect()] == ["K0", "K1", "K2"]
    path = tmp_path / "options.json"
    path.write_text(json.dumps({"Input_Grade": ["1C", "1c"], "Input_Thickness": [4.0, 6.5]}))
    cached = ledgers.load_option_lists(spark, str(path), pair)
    assert {(r["option"], r["value"]) for r in cached.collect()} == {
        ("Input_Grade", "1C"), ("Input_Grade", "1c"), ("Input_Thickness", "4.0"), ("Input_Thickness", "6.5")}
    with pytest.warns(UserWarning):
        assert ledgers.load_option_lists(spark, str(tmp_path / "gone.json"), pair).count() == found.count()


def test_encoders(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("B", 4)], "c string, n int")
    fitted = encode.fit_encoders(df, ["c"])
    assert {r["value"]: r["code"] for r in fitted.collect()} == {"B": 0, "Unknown": 1, "a": 2, "b": 3}
    scored = by(encode.apply_encoders(df.union(spark.createDataFrame([("zz", 5)], df.schema)), fitted, ["c"]), "n")
    assert [scored[n]["c_Encoded"] for n in (1, 2, 3, 4, 5)] == [3, 2, 1, 0, 0]
    assert encode.encoder_classes(fitted).first()["classes"] == ["B", "Unknown", "a", "b"]
    codes = spark.createDataFrame([(0,), (9,)], "k int")
    assert by(encode.decode(codes, fitted, "c", "k", "name"), "k")[9]["name"] == "Material_9"


def test_split_folds_and_strata(spark):
    rows = [(f"o{i}", "big" if i % 10 else "small") for i in range(5000)] + [("only", "rare")]
    df = spark.createDataFrame(rows, "k string, label string").repartition(5)
    split = evaluation.with_folds(evaluation.with_split(df, ["k"], 42), ["k"], 42, 5)
    again = evaluation.with_split(df.repartition(3), ["k"], 42)
    assert split.where("is_test").count() == pytest.approx(1000, abs=100)
    assert {r["k"] for r in split.where("is_test").collect()} == {r["k"] for r in again.where("is_test").collect()}
    assert split.select("fold").distinct().count() == 5
    strata = by(evaluation.with_stratified_split(df, "label", ["k"], 42).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")), "label")
    assert {k: (r["n"], r["t"]) for k, r in strata.items()} == {"big": (4500, 900), "small": (500, 100), "rare": (1, 0)}
    weights = by(evaluation.class_weights(df, "label"), "label")
    assert weights["small"]["weight"] == pytest.approx(5001 / (3 * 500))


def test_metrics_and_histogram(spark):
    df = spark.createDataFrame([(100.0, 90.0), (50.0, 55.0), (0.0, 1.0), (80.0, 80.0)], "y double, p double")
    row = evaluation.regression_metrics(df, "y", "p").first()
    assert row["mae"] == 4 and row["rmse"] == pytest.approx((126 / 4) ** 0.5) and row["mape"] == pytest.approx(20 / 3)
    y = np.array([100.0, 50, 0, 80])
    assert row["r2"] == pytest.approx(1 - 126 / ((y - y.mean()) ** 2).sum())
    results = evaluation.test_results(df, "y", "p")
    assert [r["Error_Pct"] for r in results.collect()] == [10.0, -10.0, None, 0.0]
    errors = [10.0, -5.0, -1.0, 0.0]
    counts, _ = np.histogram(errors, bins=3)
    bins = by(evaluation.error_histogram(results, "Error", 3), "bin")
    assert [bins[b]["rows"] if b in bins else 0 for b in range(3)] == counts.tolist()
    assert evaluation.display_sample(df, ["y"], 3, 42).count() == 3


SMALL = regression.TrainingSpec(forest_trees=5, forest_depth=4, boost_rounds=3, boost_depth=3, folds=2)


@pytest.fixture(scope="module")
def trained(spark, data_dir):
    data = prepare_dataset(*ledgers.read_year_ledgers(spark, str(data_dir), ["2024", "2025"]))
    return data, regression.train_yield_models(data.history, data.encoders, SMALL, years=["2024", "2025"])


def test_spreads_of_materials_are_found_beside_the_fits(trained, monkeypatch):
    data, before = trained
    started, found, spreads, fits = threading.Event(), [], regression.material_yield_stats, regression.fit_all
    monkeypatch.setattr(regression, "material_yield_stats", lambda rows: started.set() or spreads(rows))
    monkeypatch.setattr(regression, "fit_all", lambda *given: found.append(started.wait(60)) or fits(*given))
    again = regression.train_yield_models(data.history, data.encoders, replace(SMALL, models=("Ridge",)))
    assert found == [True]
    assert sorted(map(tuple, again.stats.collect())) == sorted(map(tuple, before.stats.collect()))


def test_prepared_history(trained):
    data, _ = trained
    assert data.inputs.count() == 300 and 250 < data.history.count() < 300
    assert set(FEATURE_COLUMNS) <= set(data.history.columns)
    assert data.history.where("Input_Material like 'X%'").count() == 0


def test_training_finds_the_signal(trained):
    _, models = trained
    metrics = {m["model"]: m for m in models.metrics}
    assert set(metrics) == {"RandomForest", "GradientBoosting", "Ridge", "BoostedColumns"}
    assert metrics["RandomForest"]["test_r2"] > 0.7 and metrics["Ridge"]["test_r2"] > 0.7
    assert all(len(m["cv_scores"]) == 2 for m in metrics.values())
    ranked = [r["test_r2"] for r in models.comparison().collect()]
    assert ranked == sorted(ranked, reverse=True)
    assert regression.top_features(models.importance(), 3).count() == 3


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2)) * [3, 10] + [1, 50]
    y = x @ [2.0, -0.3] + rng.normal(size=80) + 90
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, Yield_Percentage double")
    model = regression.fit("Ridge", regression.TrainingSpec(ridge_alpha=1.0), ["a", "b"], df)
    got = np.array([r["prediction"] for r in model.transform(df).select("a", "b", "prediction").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert got == pytest.approx(z @ w + y.mean(), abs=1e-6)


def test_save_and_load(spark, trained, tmp_path):
    data, models = trained
    folder = str(tmp_path / "models")
    artifacts.save_yield_models(models, f"{folder}/2025")
    classes = classification.train_output_classifier(data.history, data.encoders, classification.ClassifierSpec(
        forest_trees=5, forest_depth=4, boost_rounds=2, boost_depth=2))
    assert {m["model"]: m["accuracy"] > 0.9 for m in classes.metrics} == {
        "RandomForest_Classifier": True, "GradientBoosting_Classifier": True, "BoostedColumns_Classifier": True}
    artifacts.save_classifiers(classes, f"{folder}/2025")
    (tmp_path / "models" / "drafts").mkdir()
    assert [r["year"] for r in artifacts.available_model_years(spark, folder).collect()] == ["2025"]
    assert artifacts.load_artifacts(spark, folder) is None
    loaded = artifacts.load_artifacts(spark, folder, "2025")
    assert loaded.yields.best_name == models.best_name and loaded.yields.features == models.features
    assert loaded.metadata.first()["trained_years"] == ["2024", "2025"]
    assert loaded.yields.test_results.columns == ["Actual", "Predicted", "Error", "Error_Pct"]
    requests = spark.createDataFrame([("r1", "P0", "M0", 4.0, "S0", "G0", 96.0, 8.0, 120.0), ("r2", "P9", "M9", 4.0, "S0", "G0", None, 8.0, 120.0)],
        "request_id string, Input_Plant string, Input_Material string, Input_Thickness double, Input_Specie string, Input_Grade string, Input_Length double, Input_Width double, Total_Input_BF double")
    before = by(forward_predict(requests, models.predictor()), "request_id")
    after = by(forward_predict(requests, loaded.yields.predictor()), "request_id")
    assert before == after and 75 < before["r1"]["predicted_yield_pct"] < 85
    for name in ("RandomForest_Classifier", "GradientBoosting_Classifier", "BoostedColumns_Classifier"):
        top = as_dicts(classification.predict_top_k(requests.where("request_id = 'r1'"), loaded.classifiers, 2, name).orderBy("rank"))
        assert top[0]["output_material"] == "K0" and [r["rank"] for r in top] == [1, 2]
        assert top[0]["probability"] >= top[1]["probability"]
    assert sum(classification.predict_class(requests, classes).first()["probabilities"]) == pytest.approx(1)
    assert classification.train_output_classifier(data.history.drop("Output_Material_Encoded"), data.encoders) is None
    assert classes.importance().count() == len(FEATURE_COLUMNS)


def test_history_fallback_chain(spark, data_dir, tmp_path):
    found = load_history(spark, str(data_dir), "2024")
    assert found.history.count() > 100 and found.raw_261.count() == 300
    summary = tmp_path / "summary"
    spark.createDataFrame([("M", "K", 91.0, 7)], "Input_Material string, Output_Material string, Mean_Yield double, Order_Count int").write.parquet(str(summary))
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "other.csv").write_text("a\n1\n")
    with pytest.warns(UserWarning):
        saved = load_history(spark, str(empty), None, str(summary))
    assert saved.history.first()["Yield_Percentage"] == 91 and saved.raw_261 is None
    for side in ("261", "101"):
        (empty / f"{side}.csv").write_bytes((data_dir / f"{side}_2024.csv").read_bytes())
    assert load_history(spark, str(empty), None, None).history.count() > 100


def test_job(spark, data_dir, tmp_path, capsys):
    args = job.parse_arguments(["--data-dir", str(data_dir), "--years", "2024", "--output-dir", str(tmp_path / "m")])
    job.run(spark, args, regression.TrainingSpec(models=("Ridge", "RandomForest"), forest_trees=3, forest_depth=3, folds=1))
    assert artifacts.load_yield_models(spark, str(tmp_path / "m")).years == ["2024"]


def test_simple_forest(spark, data_dir):
    from yieldengine.operators.cleaning import clean_lenient
    from yieldengine.operators.history import valid_yield_orders

    issued, received = (clean_lenient(x) for x in ledgers.read_year_ledgers(spark, str(data_dir), ["2024", "2025"]))
    model = regression.simple_yield_forest(valid_yield_orders(issued, received), SMALL)
    assert model.metrics[0]["test_r2"] > 0.7
    ask = spark.createDataFrame([(100.0, "P0", "M1", 5.0), (100.0, "new", "new", 5.0)], "Total_Input_BF double, Plant string, Input_Material string, Thickness double")
    rows = regression.predict_simple(ask, model).collect()
    assert rows[0]["expected_output_bf"] == pytest.approx(rows[0]["predicted_yield_pct"])


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("K", 50.0, "ok", "M", "P", 10.0, 5.0, 90.0)],
        "KD_Material string, Contribution_Pct double, status string, ks_material string, plant string, input_bf double, Expected_BF_Output double, historical_yield_pct double")
    exports.export_distribution(df, str(tmp_path / "d"))
    got = spark.read.option("header", True).csv(str(tmp_path / "d"))
    assert got.columns == ["KD_Material", "Contribution_Pct", "Expected_BF_Output", "KS_Material", "Plant", "Input_BF", "Yield_Pct"]
    assert exports.with_context(df, run="r").first()["run"] == "r"
    assert exports.display_table(df.withColumn("Yield_Std", F.lit(1.0))).columns == ["Yield Std Dev"]


def test_every_requested_classifier_is_trained_whatever_the_number_of_classes(spark):
    rows = [(str(n), f"K{n % 36}", n % 36, *[float((n * k) % 7 + n % 36) for k in range(1, len(FEATURE_COLUMNS) + 1)]) for n in range(216)]
    schema = f"{ORDER} string, Output_Material string, {classification.LABEL} int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    spec = classification.ClassifierSpec(forest_trees=2, forest_depth=2, boost_rounds=1, boost_depth=1)
    trained = classification.train_output_classifier(spark.createDataFrame(rows, schema), None, spec)
    assert set(trained.models) == set(spec.models)
    assert all(m["n_classes"] == 36 for m in trained.metrics)


def test_ledgers_as_folders_and_in_columns(spark, data_dir, tmp_path):
    issued, received = ledgers.read_year_ledgers(spark, str(data_dir), ["2024"])
    plain = [c for c in issued.columns if c not in ("ROW_SEQ", "_SOURCE_YEAR")]
    as_is = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    issued.select(*plain).repartition(3).write.options(**as_is).csv(f"{tmp_path}/261_2024.csv")
    received.drop("ROW_SEQ", "_SOURCE_YEAR").repartition(2).write.parquet(f"{tmp_path}/101_2024.parquet")
    assert [r["year"] for r in ledgers.available_years(spark, str(tmp_path)).collect()] == ["2024"]
    got = ledgers.read_year_ledgers(spark, str(tmp_path), ["2024"])
    for folder, file in zip(got, (issued, received)):
        names = [c for c in file.columns if c != "ROW_SEQ"]
        assert folder.select(*names).exceptAll(file.select(*names)).isEmpty() and folder.count() == file.count()


def test_a_failing_source_is_raised_not_passed_over(spark, data_dir, monkeypatch):
    def broken(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr("yieldengine.sources.history.prepare_dataset", broken)
    with pytest.raises(RuntimeError, match="executor lost"):
        load_history(spark, str(data_dir), "2024")


def test_registered_queries_train_with_the_published_parameters(spark, monkeypatch):
    from types import SimpleNamespace

    from yieldengine.ml import classification, regression
    from yieldengine.plans import queries

    from dataclasses import replace

    given = {}

    class Seen(Exception):
        pass

    def note(name, plain):
        def train(*args):
            given[name] = args[plain:]
            raise Seen

        return train

    monkeypatch.setattr(queries, "prepared", lambda *_: SimpleNamespace(history=None, encoders=None))
    monkeypatch.setattr(queries, "full_ledgers", lambda *_: (None, None))
    monkeypatch.setattr(queries.cleaning, "clean_lenient", lambda ledger: ledger)
    monkeypatch.setattr(queries.history, "valid_yield_orders", lambda *_: None)
    monkeypatch.setattr(regression, "train_yield_models", note("yield", 2))
    monkeypatch.setattr(regression, "cross_validate", note("folds", 1))
    monkeypatch.setattr(classification, "train_output_classifier", note("classes", 2))
    monkeypatch.setattr(regression, "simple_yield_forest", note("simple", 1))
    for run in ("train_yield_models", "cv_scores", "classifier_metrics", "simple_forest"):
        with pytest.raises(Seen):
            queries.all_queries()[run](spark, "published")
    plain = regression.TrainingSpec()
    boosted = replace(plain, models=("GradientBoosting", "BoostedColumns"))
    assert given == {"yield": (replace(plain, folds=1),), "folds": (boosted,), "classes": (), "simple": ()}  # no other sizes than the defaults
