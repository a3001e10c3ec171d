"""Job: train on window features, evaluate on the test subjects, write predictions.

    spark-submit -m biospark.plans.train --data DIR --model random_forest --output OUT --cross-val
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.contracts import feature_columns
from biospark.operators.ml import BaselineModel, cross_validate_model, evaluate_model, summarize_scores
from biospark.operators.splits import split_table
from biospark.session import build_session, stage
from biospark.sources.readers import read_splits, read_table
from biospark.sources.writers import write_report, write_reports, write_table


def load(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(train, test, feature columns) of a windows folder, or of a single table split by subject.

    The feature columns of a windows folder are those of its metadata, if there are any, else all that are not
    identifiers.
    """
    splits = f"{data.rstrip('/')}/splits"
    if _exists(spark, splits):
        train, _, test = read_splits(spark, splits)
        metadata = f"{data.rstrip('/')}/metadata"
        listed = spark.read.json(metadata).first() if _exists(spark, metadata) else None
        named = listed["feature_columns"] if listed and "feature_columns" in listed else None
        return train, test, list(named) if named else feature_columns(train.columns)
    table = read_table(spark, data)
    halves = table.join(stage(split_table(table)), "subject")
    train, test = (halves.filter(F.col("split") == s).select(*table.columns) for s in ("train", "test"))
    return train, test, feature_columns(table.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:  # the path does not exist
        return False


def run(
    spark: SparkSession, data: str, output: str, cross_val: bool = False, cv_folds: int = 5, **model_options
) -> dict[str, DataFrame]:
    """Fit, evaluate and write; returns the evaluation tables."""
    train, test, columns = load(spark, data)
    out = output.rstrip("/")
    model = BaselineModel(**model_options).fit(train, columns)
    write_table(model.predictions(test), f"{out}/predictions")
    predictions = spark.read.parquet(f"{out}/predictions")
    tables = evaluate_model(predictions) | {"feature_importance": model.feature_importance(spark)}
    write_reports(tables, f"{out}/evaluation")
    info = spark.createDataFrame(
        [(model.model_type, model.n_estimators, model.max_depth, model.random_state, model.feature_cols, model.classes)],
        "model_type string, n_estimators int, max_depth int, random_state int, feature_cols array<string>, label_classes array<string>",
    )
    report = tables["classification_report"]
    for metric, row in (("test_accuracy", "accuracy"), ("test_f1_weighted", "weighted avg")):
        info = info.withColumn(metric, report.filter(F.col("name") == row).select("f1").scalar())
    write_report(info, f"{out}/model_info")
    model.save(f"{out}/model")
    if cross_val:
        scores = summarize_scores(cross_validate_model(train, columns, cv_folds, **model_options))
        write_report(scores, f"{out}/cross_validation")
        tables["cross_validation"] = spark.read.json(f"{out}/cross_validation")
    return tables


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--model", choices=["random_forest", "xgboost"], default="random_forest")
    parser.add_argument("--output", required=True)
    parser.add_argument("--cross-val", action="store_true")
    parser.add_argument("--cv-folds", type=int, default=5)
    parser.add_argument("--random-state", type=int, default=42)
    parser.add_argument("--n-estimators", type=int, default=100)
    parser.add_argument("--max-depth", type=int)
    parser.add_argument("--class-weight", choices=["balanced", "balanced_subsample"], default="balanced")
    args = parser.parse_args()
    tables = run(
        build_session("train"), args.data, args.output, args.cross_val, args.cv_folds, model_type=args.model,
        n_estimators=args.n_estimators, max_depth=args.max_depth, random_state=args.random_state,
        class_weight=args.class_weight,
    )
    tables["classification_report"].filter(F.col("name").isin("accuracy", "weighted avg")).show()


if __name__ == "__main__":
    main()
