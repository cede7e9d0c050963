"""Training job: spark-submit jobs/train.py --input261 PATH --output101 PATH --output-dir DIR [--years 2024 2025]"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from yieldengine.ml.artifacts import save_classifiers, save_yield_models
from yieldengine.ml.classification import ClassifierSpec, train_output_classifier
from yieldengine.ml.regression import TrainedYieldModels, TrainingSpec, top_features, train_yield_models
from yieldengine.operators.history import yield_statistics
from yieldengine.plans.datasets import prepare_dataset
from yieldengine.session import configure
from yieldengine.sources.ledgers import read_ledgers, read_year_ledgers
from yieldengine.staging import remove_staged


def parse_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Prepare the yield history and train the models")
    parser.add_argument("--input261", default="data/261.csv", help="goods-issue ledger")
    parser.add_argument("--output101", default="data/101.csv", help="goods-receipt ledger")
    parser.add_argument("--data-dir", default="data", help="folder of yearly ledgers, with --years")
    parser.add_argument("--years", nargs="*", default=[], help="train on these years' ledgers")
    parser.add_argument("--output-dir", default="models")
    parser.add_argument("--checkpoint-dir", help="shared folder for intermediate tables, unless spark.checkpoint.dir is set")
    parser.add_argument("--classifier", action="store_true", help="also train the output-material classifier")
    return parser.parse_args(argv)


def run(
    spark: SparkSession, args: argparse.Namespace, spec: TrainingSpec = TrainingSpec(),
    classifier_spec: ClassifierSpec = ClassifierSpec(),
) -> TrainedYieldModels:
    if args.years:
        ledgers = read_year_ledgers(spark, args.data_dir, args.years)
    else:
        ledgers = read_ledgers(spark, args.input261, args.output101)
    prepared = prepare_dataset(*ledgers)
    yield_statistics(prepared.history).show()
    trained = train_yield_models(prepared.history, prepared.encoders, spec, years=args.years)
    save_yield_models(trained, args.output_dir)
    if args.classifier:
        classifiers = train_output_classifier(prepared.history, prepared.encoders, classifier_spec)
        if classifiers is not None:
            save_classifiers(classifiers, args.output_dir)
    trained.comparison().show(truncate=False)
    top_features(trained.importance()).show(truncate=False)
    return trained


def main(argv: list[str] | None = None) -> int:
    args = parse_arguments(argv)
    spark = configure(SparkSession.builder.appName("yieldengine-train")).getOrCreate()
    if args.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(args.checkpoint_dir)
    try:
        run(spark, args)
        remove_staged(spark)
    except (AnalysisException, ValueError) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
