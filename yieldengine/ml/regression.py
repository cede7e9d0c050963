"""Yield models: training with cross-validation, selection, scoring and importances.

A model is fitted with all its folds in the same passes: `trees` grows the boosted models and the forest, `linear`
solves ridge from sums. Each model is fitted by itself or with the others, as asked.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldengine.functions import half_even
from yieldengine.ml import evaluation, linear, trees
from yieldengine.ml.features import SIMPLE_FEATURES, complete_features, encode_requests, prepare_features
from yieldengine.ml.linear import RidgeModel
from yieldengine.ml.trees import Ensemble, Growth, Squared, TreeModel
from yieldengine.operators.encode import apply_encoders, fit_encoders
from yieldengine.operators.history import material_yield_stats
from yieldengine.operators.predictors import Predictor
from yieldengine.schema import FEATURE_COLUMNS, ORDER
from yieldengine.staging import stage

TARGET = "Yield_Percentage"
TREE_MODELS = ["RandomForest", "GradientBoosting", "BoostedColumns"]
#: The part of the rows that no model is fitted on; the others are numbered by fold.
TEST_PART = -1


@dataclass(frozen=True)
class TrainingSpec:
    """Training parameters. The defaults are the fixed values the published models were trained with.

    `max_bins` bounds the values of a feature that a tree can separate.
    """

    seed: int = 42
    test_percent: int = 20
    folds: int = 5
    ridge_alpha: float = 1.0
    forest_trees: int = 200
    forest_depth: int = 15
    forest_min_split: int = 5
    forest_min_leaf: int = 2
    boost_rounds: int = 200
    boost_depth: int = 8
    boost_rate: float = 0.05
    boost_rows: float = 0.8
    boost_min_split: int = 5
    boost_min_leaf: int = 3
    column_share: float = 0.8
    column_min_weight: float = 3.0
    column_l1: float = 0.1
    column_l2: float = 1.0
    max_bins: int = 256
    models: tuple[str, ...] = ("RandomForest", "GradientBoosting", "Ridge", "BoostedColumns")
    keys: tuple[str, ...] = (ORDER, "Output_Material")


@dataclass
class TrainedYieldModels:
    spark: SparkSession
    models: dict[str, TreeModel | RidgeModel]
    metrics: list[dict]
    features: list[str]
    encoders: DataFrame | None = None
    stats: DataFrame | None = None
    test_results: DataFrame | None = None
    years: list[str] = field(default_factory=list)

    @property
    def best_name(self) -> str:
        return max(self.metrics, key=lambda m: m["test_r2"])["model"]

    @property
    def best(self) -> TreeModel | RidgeModel:
        return self.models[self.best_name]

    def metric(self, name: str, model: str | None = None) -> float:
        return next(m[name] for m in self.metrics if m["model"] == (model or self.best_name))

    def predictor(self, model: str | None = None) -> Predictor:
        """Scores raw request rows: encode, complete, predict."""
        chosen = self.models.get(model, self.best)

        def predict(rows: DataFrame) -> DataFrame:
            encoded = encode_requests(rows, self.encoders, self.features) if self.encoders is not None else (
                complete_features(rows, self.features)
            )
            scored = chosen.transform(encoded)
            return scored.select(*rows.columns, F.col("prediction").alias("raw_yield"))

        return predict

    def comparison(self) -> DataFrame:
        return model_comparison(metrics_table(self.spark, self.metrics))

    def importance(self) -> DataFrame:
        return feature_importance(self.spark, self.models, self.features)


def tree_ensemble(name: str, spec: TrainingSpec, columns: int) -> Ensemble:
    """The rules of a tree model by its name."""
    if name in ("RandomForest", "SimpleForest"):
        sampled = max(1, math.isqrt(columns)) if name == "RandomForest" else None
        growth = Growth(
            spec.forest_depth, spec.forest_min_leaf, spec.forest_min_split, node_columns=sampled
        )
        return Ensemble(Squared(), growth, spec.forest_trees, bagged=True, seed=spec.seed)
    if name == "GradientBoosting":
        growth = Growth(spec.boost_depth, spec.boost_min_leaf, spec.boost_min_split)
    else:
        growth = Growth(
            spec.boost_depth, min_weight=spec.column_min_weight, l1=spec.column_l1, l2=spec.column_l2,
            tree_columns=max(1, int(spec.column_share * columns)),
        )
    return Ensemble(Squared(), growth, spec.boost_rounds, spec.boost_rate, spec.boost_rows, seed=spec.seed)


@dataclass
class Fit:
    """A model to fit: the parts it leaves out and those that it is held against. `fold` is None for the model itself."""

    name: str
    fold: int | None
    leave_out: tuple[int, ...]
    held: tuple[int, ...]


@dataclass
class Fitted:
    model: TreeModel | RidgeModel
    train: dict
    held: dict


def fit_all(fits: list[Fit], spec: TrainingSpec, features: list[str], rows: DataFrame) -> list[Fitted]:
    """The fits over `rows` (key, part, the features and the target), those of trees in shared passes."""
    done: dict[int, Fitted] = {}
    ridge = [i for i, fit in enumerate(fits) if fit.name == "Ridge"]
    if ridge:
        columns = [*features, TARGET]
        centre = linear.centres(rows, columns)
        parts = linear.moments_by_part(rows, columns, "part", centre)
        for i in ridge:
            used, held = _added(parts, lambda p: p not in fits[i].leave_out), _added(parts, lambda p: p in fits[i].held)
            model = linear.solve(used, features, centre, spec.ridge_alpha)
            done[i] = Fitted(model, {"r2": linear.r2(model, used, centre)}, {"r2": linear.r2(model, held, centre) if held.n else None})
            if fits[i].fold is None:
                done[i].held = _scores(model, rows.where(F.col("part").isin(*fits[i].held)))
    grown = [i for i in range(len(fits)) if i not in ridge]
    if grown:
        for i, fitted in zip(grown, _fit_trees([fits[i] for i in grown], spec, features, rows)):
            done[i] = fitted
    return [done[i] for i in range(len(fits))]


def _added(parts: dict[int, linear.Moments], wanted) -> linear.Moments:
    size = len(next(iter(parts.values())).sums) if parts else 0
    total = linear.Moments(0, 0.0, 0.0)
    for part, moments in parts.items():
        if wanted(part):
            total = total + moments
    if not total.n:
        return linear.Moments(0, np.zeros(size), np.zeros((size, size)))
    return total


def _fit_trees(fits: list[Fit], spec: TrainingSpec, features: list[str], rows: DataFrame) -> list[Fitted]:
    sums = {r["part"]: (r["n"], r["s"]) for r in rows.groupBy("part").agg(F.count(TARGET).alias("n"), F.sum(TARGET).alias("s")).collect()}
    models = []
    for fit in fits:
        used = [sums[p] for p in sums if p not in fit.leave_out]
        n = sum(x for x, _ in used)
        model = tree_ensemble(fit.name, spec, len(features))
        base = 0.0 if model.bagged or not n else sum(s for _, s in used) / n
        models.append(replace(model, leave_out=fit.leave_out, base=[base], done=[]))
    edges = trees.bin_edges(rows, features, spec.max_bins)
    given = rows.withColumns({"y": F.col(TARGET), "w": F.lit(1.0)})
    table = trees.training_table(given, features, edges, [m.base[0] for m in models])
    trees.train(table, models)
    scored = trees.scores(table, [1] * len(models))
    cells = [
        F.struct(
            F.lit(i).alias("fit"), F.when(F.col("part").isin(*fit.held), "held").when(~F.col("part").isin(*fit.leave_out), "train").alias("rows"),
            F.col(f"score_{i}")[0].alias("p"),
        )
        for i, fit in enumerate(fits)
    ]
    told = scored.select("y", F.explode(F.array(*cells)).alias("cell")).select("y", "cell.*").where("rows is not null")
    found = {(r["fit"], r["rows"]): r for r in told.groupBy("fit", F.col("rows").alias("set")).agg(*evaluation.metric_columns("y", "p")).select(
        "fit", F.col("set").alias("rows"), "r2", "mae", "rmse", "mape").collect()}
    table.rows.unpersist()
    nothing = {"r2": None, "mae": None, "rmse": None, "mape": None}
    return [
        Fitted(TreeModel.of(model, features, edges), *(
            found[i, which].asDict() if (i, which) in found else nothing for which in ("train", "held")
        ))
        for i, model in enumerate(models)
    ]


def fit(name: str, spec: TrainingSpec, features: list[str], train: DataFrame) -> TreeModel | RidgeModel:
    """One model on all rows of `train`."""
    rows = train.select(F.xxhash64(*features, TARGET).alias("key"), F.lit(0).alias("part"), *features, TARGET)
    return fit_all([Fit(name, None, (TEST_PART,), (TEST_PART,))], spec, features, stage(rows, "training"))[0].model


def _scores(model: TreeModel | RidgeModel, rows: DataFrame) -> dict:
    return evaluation.regression_metrics(model.transform(rows), TARGET, "prediction").first().asDict()


def _spread(scores: list[float]) -> tuple[float | None, float | None]:
    known = [s for s in scores if s is not None]
    if not known:
        return None, None
    mean = sum(known) / len(known)
    return mean, (sum((s - mean) ** 2 for s in known) / len(known)) ** 0.5


def split_rows(
    history: DataFrame, spec: TrainingSpec, features: list[str] | None = None
) -> tuple[DataFrame, list[str], list[str]]:
    """The rows that training reads, staged: key, part (fold, or TEST_PART), features, target; with the features and keys."""
    prepared, used = prepare_features(history, features or FEATURE_COLUMNS)
    keys = [k for k in spec.keys if k in history.columns]
    wanted = dict.fromkeys([*keys, *used, TARGET, *[c for c in ("Input_Material",) if c in history.columns]])
    rows = evaluation.with_folds(
        evaluation.with_split(prepared.select(*wanted), keys, spec.seed, spec.test_percent), keys, spec.seed, spec.folds
    )
    part = F.when(F.col("is_test"), TEST_PART).otherwise(F.col("fold")).cast("int")
    return stage(rows.withColumns({"key": F.xxhash64(*keys), "part": part}), "training"), used, keys


def _metrics(name: str, full: Fitted, folds: list[Fitted]) -> dict:
    scores = [f.held["r2"] for f in folds]
    mean, std = _spread(scores)
    return {
        "model": name, "train_r2": full.train["r2"], "test_r2": full.held["r2"], "cv_r2_mean": mean, "cv_r2_std": std,
        "cv_scores": scores, "MAE": full.held["mae"], "RMSE": full.held["rmse"], "MAPE": full.held["mape"],
    }


def train_yield_models(
    history: DataFrame, encoders: DataFrame | None = None, spec: TrainingSpec = TrainingSpec(),
    features: list[str] | None = None, years: list[str] | None = None,
) -> TrainedYieldModels:
    """Fit every model on the training part, cross-validate there (with two folds or more), score the held-out part."""
    rows, used, keys = split_rows(history, spec, features)
    folds = range(spec.folds) if spec.folds > 1 else range(0)
    fits = [
        fit for name in spec.models
        for fit in [Fit(name, None, (TEST_PART,), (TEST_PART,)), *(Fit(name, k, (TEST_PART, k), (k,)) for k in folds)]
    ]
    with ThreadPoolExecutor(1) as pool:  # rounds of boosting leave cores idle
        beside = inheritable_thread_target(history.sparkSession)(material_yield_stats)
        stats = pool.submit(beside, rows) if "Input_Material" in history.columns else None
        done = fit_all(fits, spec, used, rows)
    by_name = {name: [f for fit, f in zip(fits, done) if fit.name == name] for name in spec.models}
    metrics = [_metrics(name, full, parts) for name, (full, *parts) in by_name.items()]
    trained = TrainedYieldModels(history.sparkSession, {n: f[0].model for n, f in by_name.items()}, metrics, used, encoders, years=years or [])
    test = rows.where("is_test")
    trained.test_results = evaluation.test_results(trained.best.transform(test), TARGET, "prediction", keys)
    if stats is not None:
        trained.stats = stats.result()
    return trained


def cross_validate(history: DataFrame, spec: TrainingSpec = TrainingSpec(), features: list[str] | None = None) -> DataFrame:
    """model, fold, r2: every model fitted on the training part less a fold, and held against that fold."""
    rows, used, _ = split_rows(history, spec, features)
    fits = [Fit(name, k, (TEST_PART, k), (k,)) for name in spec.models for k in range(spec.folds)]
    found = [(fit.name, fit.fold, fitted.held["r2"]) for fit, fitted in zip(fits, fit_all(fits, spec, used, rows))]
    return history.sparkSession.createDataFrame(found, "model string, fold int, r2 double")


METRICS_SCHEMA = (
    "model string, train_r2 double, test_r2 double, cv_r2_mean double, cv_r2_std double, cv_scores array<double>, "
    "MAE double, RMSE double, MAPE double"
)


def metrics_table(spark: SparkSession, metrics: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in METRICS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in metrics], METRICS_SCHEMA)


def cv_table(metrics: DataFrame) -> DataFrame:
    """One row per model and fold."""
    return metrics.select("model", F.posexplode("cv_scores").alias("fold", "r2"))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Rounded metrics, best held-out fit first."""
    return metrics.select(
        "model",
        *[half_even(F.col(c), 4).alias(c) for c in ("train_r2", "test_r2", "cv_r2_mean", "cv_r2_std")],
        *[half_even(F.col(c), 2).alias(c) for c in ("MAE", "RMSE", "MAPE")],
    ).orderBy(F.col("test_r2").desc())


def feature_importance(
    spark: SparkSession, models: dict[str, TreeModel | RidgeModel], features: list[str], order: list[str] | None = None
) -> DataFrame:
    """Importances of the first tree model there is (not necessarily the best model)."""
    schema = "Feature string, Importance double"
    for name in order or TREE_MODELS:
        if name in models:
            values = models[name].importances
            rows = [(f, float(v)) for f, v in zip(features, values)]
            return spark.createDataFrame(rows, schema).orderBy(F.col("Importance").desc())
    return spark.createDataFrame([], schema)


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    return importance.orderBy(F.col("Importance").desc()).limit(n)


def simple_yield_forest(orders: DataFrame, spec: TrainingSpec | None = None) -> TrainedYieldModels:
    """The four-feature forest on order grain (100 trees, all features at every split, folds over all rows)."""
    spec = spec or TrainingSpec(forest_trees=100)
    encoders = stage(fit_encoders(orders, ["Plant", "Input_Material"]).coalesce(1), "encoders")
    encoded = apply_encoders(orders, encoders, ["Plant", "Input_Material"])
    rows = evaluation.with_folds(
        evaluation.with_split(encoded, [ORDER], spec.seed, spec.test_percent), [ORDER], spec.seed, spec.folds
    ).select(ORDER, *SIMPLE_FEATURES, TARGET, "is_test", "fold")
    rows, used = prepare_features(stage(rows, "training"), SIMPLE_FEATURES)
    # folds are of all rows, held out from the model or not: those held out are numbered after the others
    part = (F.col("fold") + F.when(F.col("is_test"), spec.folds).otherwise(0)).cast("int")
    rows = stage(rows.withColumns({"key": F.xxhash64(ORDER), "part": part}), "training")
    held = tuple(range(spec.folds, 2 * spec.folds))
    fits = [Fit("SimpleForest", None, held, held)]
    if spec.folds > 1:
        fits += [Fit("SimpleForest", k, (k, k + spec.folds), (k, k + spec.folds)) for k in range(spec.folds)]
    full, *folds = fit_all(fits, spec, used, rows)
    trained = TrainedYieldModels(
        orders.sparkSession, {"RandomForest": full.model}, [_metrics("RandomForest", full, folds)], used, encoders
    )
    trained.test_results = evaluation.test_results(full.model.transform(rows.where("is_test")), TARGET, "prediction", [ORDER])
    return trained


def predict_simple(requests: DataFrame, trained: TrainedYieldModels) -> DataFrame:
    """Unclipped prediction for (Total_Input_BF, Plant, Input_Material, Thickness) rows; unknown values code as 0."""
    encoded = complete_features(
        apply_encoders(requests, trained.encoders, ["Plant", "Input_Material"]), trained.features
    )
    scored = trained.best.transform(encoded)
    return scored.select(
        *requests.columns,
        F.col("prediction").alias("predicted_yield_pct"),
        (F.col("Total_Input_BF") * F.col("prediction") / F.lit(100.0)).alias("expected_output_bf"),
    )
