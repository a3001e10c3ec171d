"""Model preparation and training on MLlib."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.contracts import feature_columns
from biospark.functions.scalars import nan_to_null
from biospark.operators import metrics
from biospark.operators.ensembles import FITS_AT_ONCE, SoftmaxModel, fit_softmax, fit_subsample_forest
from biospark.operators.forests import GrownForest, fit_forest
from biospark.operators.ranks import around_the_middle, as_doubles, medians_between, summaries
from biospark.operators.splits import grouped_folds, stratified_folds
from biospark.session import stage

# MLlib's limit; the depth of trees when none is given.
DEEPEST_TREE = 30
# Labelled rows that a model is trained on unless more are allowed.
MOST_TRAINING_ROWS = 10_000_000
# Rows times trees up to which MLlib fits a forest on the driver; the trees of a larger one grow on the executors.
MOST_DRIVER_TREE_ROWS = 1_000_000
# Fixed value: depth of boosted trees when none is given.
BOOSTED_DEPTH = 6


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each column as (feature, median), without sorting whole columns.

    One pass brackets the middle of each column; a second counts what lies below the bracket and the distinct values in it.
    """
    doubles = as_doubles(df, columns)
    return medians_between(doubles, summaries(doubles, around_the_middle), columns)


def impute_medians(df: DataFrame, columns: list[str], medians: DataFrame | None = None) -> DataFrame:
    """Fill missing values with column medians, taken from ``df`` itself unless given."""
    medians = column_medians(df, columns) if medians is None else medians
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    clean = nan_to_null(df).withColumn("__m", lookup)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("__m")[c]) for c in columns}
    return clean.withColumns(filled).drop("__m")


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre each column and divide by its population deviation (by 1 where that is 0)."""
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]).alias("s")
    )
    scaled = {
        c: (F.col(c) - F.col("__s")[c]["mean"]) / F.when(F.col("__s")[c]["sd"] > 0, F.col("__s")[c]["sd"]).otherwise(1.0)
        for c in columns
    }
    return df.withColumn("__s", stats.scalar()).withColumns(scaled).drop("__s")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: total / (classes * rows of the class)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes")).alias("t")).scalar()
    return counts.withColumn("__t", totals).select(
        "label", "n", (F.col("__t.rows") / (F.col("__t.classes") * F.col("n"))).alias("weight")
    )


@dataclass
class FeatureScaling:
    """Fitted medians, means and deviations; a few numbers per feature."""

    columns: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> FeatureScaling:
        medians = {r["feature"]: r["median"] for r in column_medians(df, columns).collect()}
        used = [c for c in columns if c in medians]
        doubles = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in used]))
        row = doubles.agg(
            F.count("*").alias("rows"),
            *[f(c).alias(f"{n}_{c}") for c in used for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))],
        ).first()
        means, deviations = {}, {}
        for c in used:
            # Moments of the column with its gaps filled, from those of the known part.
            known, mean, variance, fill = row[f"n_{c}"], row[f"m_{c}"], row[f"v_{c}"], medians[c]
            gaps = row["rows"] - known
            means[c] = (known * mean + gaps * fill) / row["rows"]
            spread = known * (variance + (mean - means[c]) ** 2) + gaps * (fill - means[c]) ** 2
            deviations[c] = (spread / row["rows"]) ** 0.5 or 1.0
        return cls(used, medians, means, deviations)

    def transform(self, df: DataFrame, own_medians: bool = False) -> DataFrame:
        """Add the assembled ``__features``; ``own_medians`` fills gaps from ``df`` instead of the training data."""
        medians = self.medians
        if own_medians:
            medians = medians | {r["feature"]: r["median"] for r in column_medians(df, self.columns).collect()}
        scaled = {
            f"__x_{c}": (F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(medians[c])) - self.means[c])
            / self.deviations[c]
            for c in self.columns
        }
        assembler = VectorAssembler(inputCols=list(scaled), outputCol="__features")
        return assembler.transform(df.withColumns(scaled)).drop(*scaled)


@dataclass
class BaselineModel:
    """Median filling, scaling, label encoding and a tree model.

    ``max_depth=None`` means DEEPEST_TREE for forests and BOOSTED_DEPTH for boosted trees. ``class_weight`` is "balanced",
    "balanced_subsample" (forests only: the weights of each tree's bootstrap sample) or None. More than two classes are
    boosted with one softmax and ``learning_rate`` by "xgboost", one against the rest by "gbt". ``impute`` fills gaps with training medians ("train") or with those of the scored table ("per_frame"). More than
    ``max_training_rows`` labelled rows are an error. What cannot be done as asked is an error too.
    """

    model_type: str = "random_forest"
    n_estimators: int = 100
    max_depth: int | None = None
    random_state: int = 42
    class_weight: str | None = "balanced"
    impute: str = "train"
    learning_rate: float = 0.3
    max_training_rows: int = MOST_TRAINING_ROWS
    feature_cols: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    scaling: FeatureScaling | None = None
    model: Model | SoftmaxModel | GrownForest | None = None

    def __post_init__(self):
        if self.model_type not in ("random_forest", "xgboost", "gbt"):
            raise ValueError(f"Unsupported model type: {self.model_type}")
        if self.max_depth is not None and not 0 <= self.max_depth <= DEEPEST_TREE:
            raise ValueError(f"max_depth {self.max_depth} is not between 0 and {DEEPEST_TREE}")
        if self.class_weight == "balanced_subsample" and self.model_type != "random_forest":
            raise ValueError("class weights per bootstrap sample ('balanced_subsample') need a forest, use 'balanced'")
        if self.class_weight not in (None, "balanced", "balanced_subsample"):
            raise ValueError(f"Unknown class_weight: {self.class_weight}")
        if self.impute not in ("train", "per_frame"):
            raise ValueError(f"Unknown impute: {self.impute}")

    def _fitted(self, prepared: DataFrame, rows: int, class_shares: list[float]) -> Model | SoftmaxModel | GrownForest:
        columns = {"featuresCol": "__features", "labelCol": "__label", "weightCol": "__weight"}
        depth = self.max_depth
        if depth is None:
            depth = DEEPEST_TREE if self.model_type == "random_forest" else BOOSTED_DEPTH
        size, seed, classes = self.n_estimators, self.random_state, len(self.classes)
        if self.class_weight == "balanced_subsample":
            return fit_subsample_forest(prepared, classes, size, depth, seed)
        if self.model_type == "random_forest" and rows * size > MOST_DRIVER_TREE_ROWS:
            return fit_forest(prepared, class_shares, size, depth, seed)
        if self.model_type == "random_forest":
            return RandomForestClassifier(numTrees=size, maxDepth=depth, seed=seed, **columns).fit(prepared)
        if self._softmax:
            return fit_softmax(prepared, classes, size, depth, self.learning_rate, seed)
        boosted = GBTClassifier(maxIter=size, maxDepth=depth, seed=seed, **columns)
        # A fit is many short jobs one after another; those of different classes do not depend on each other.
        apart = OneVsRest(classifier=boosted, parallelism=min(max(classes, 1), FITS_AT_ONCE), **columns)
        return (boosted if classes == 2 else apart).fit(prepared)

    @property
    def _softmax(self) -> bool:
        return self.model_type == "xgboost" and len(self.classes) > 2

    def fit(self, train: DataFrame, feature_cols: list[str] | None = None) -> BaselineModel:
        """Fit on a window table; it is read several times, so give a stored or staged one."""
        self.feature_cols = feature_cols or feature_columns(train.columns)
        labelled = train.filter(F.col("label").isNotNull())
        counted = class_weights(labelled).collect()
        rows = sum(r["n"] for r in counted)
        if rows > self.max_training_rows:
            raise ValueError(f"{rows} labelled rows exceed max_training_rows ({self.max_training_rows}); sample or raise it")
        weights = {r["label"]: r["weight"] for r in counted}
        self.classes = sorted(weights)
        self.scaling = FeatureScaling.fit(labelled, self.feature_cols)
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("label")) - 1
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("label")]
        prepared = self.scaling.transform(labelled).select(
            "__features",
            code.cast("double").alias("__label"),
            (weight if self.class_weight else F.lit(1.0)).alias("__weight"),
        )
        self.model = self._fitted(prepared, rows, [weights[c] if self.class_weight else 1.0 for c in self.classes])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``predicted_label`` and one ``prob_<class>`` column per class."""
        scored = self.model.transform(self.scaling.transform(df, own_medians=self.impute == "per_frame"))
        if "probability" in scored.columns:
            shares = vector_to_array("probability")
        elif "__shares" in scored.columns:
            shares = F.col("__shares")
        else:
            raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
            scored = scored.withColumn("__shares", raw)
            total = F.aggregate("__shares", F.lit(0.0), lambda a, x: a + x)
            shares = F.transform("__shares", lambda x: x / total)
        scored = scored.withColumn("__p", shares)
        names = F.array(*[F.lit(c) for c in self.classes])
        return scored.select(
            *df.columns,
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted_label"),
            *[F.col("__p")[i].alias(f"prob_{c}") for i, c in enumerate(self.classes)],
        )

    def predictions(self, df: DataFrame) -> DataFrame:
        """Window id, subject, label, predicted label and class probabilities."""
        scored = self.transform(df)
        kept = [c for c in ("window_id", "subject", "label", "predicted_label") if c in scored.columns]
        return scored.select(*kept, *[f"prob_{c}" for c in self.classes])

    def save(self, path: str) -> None:
        """The fitted model with everything that ``transform`` needs, under ``path``."""
        spark = SparkSession.getActiveSession()
        settings = {f: getattr(self, f) for f in ("model_type", "n_estimators", "max_depth", "random_state", "class_weight", "impute", "learning_rate")}
        settings |= {"feature_cols": self.feature_cols, "classes": self.classes, "scaling": vars(self.scaling)}
        settings["grown"] = isinstance(self.model, GrownForest)
        spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode("overwrite").text(f"{path}/settings")
        if isinstance(self.model, SoftmaxModel | GrownForest):
            self.model.save(f"{path}/trees")
        else:
            self.model.write().overwrite().save(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BaselineModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        scaling = FeatureScaling(**settings.pop("scaling"))
        grown = settings.pop("grown", False)
        found = cls(**settings, scaling=scaling)
        classes = len(found.classes)
        if grown:
            found.model = GrownForest.load(spark, f"{path}/trees")
            return found
        if found._softmax:
            found.model = SoftmaxModel.load(f"{path}/trees", classes)
            return found
        if found.model_type == "random_forest":
            reader = RandomForestClassificationModel
        else:
            reader = GBTClassificationModel if classes == 2 else OneVsRestModel
        found.model = reader.load(f"{path}/trees")
        return found

    def feature_importance(self, spark) -> DataFrame:
        """feature, importance in descending order; features without any value have importance 0."""
        weights = dict.fromkeys(self.feature_cols, 0.0)
        parts = getattr(self.model, "models", [self.model])
        for part in parts:
            for column, value in zip(self.scaling.columns, part.featureImportances.toArray()):
                weights[column] += float(value) / len(parts)
        table = spark.createDataFrame(list(weights.items()), "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")


def evaluate_model(predictions: DataFrame, positive: str = "stress") -> dict[str, DataFrame]:
    """All evaluation tables of a prediction table, by name."""
    score = f"prob_{positive}"
    tables = {
        "classification_report": metrics.classification_report(predictions),
        "confusion_matrix": metrics.confusion_matrix(predictions),
    }
    if score in predictions.columns:
        points = metrics.score_table(predictions, score, positive=positive)
        tables |= {
            "roc_auc": metrics.roc_auc_of(points),
            "pr_auc": metrics.average_precision_of(points),
            "roc_curve": metrics.roc_curve_of(points),
            "pr_curve": metrics.pr_curve_of(points),
        }
    if "subject" in predictions.columns:
        tables["per_subject"] = metrics.per_group_report(predictions)
    return tables


def cross_validate_model(
    train: DataFrame,
    feature_cols: list[str] | None = None,
    cv_folds: int = 5,
    by_subject: bool = False,
    positive: str = "stress",
    **model_options,
) -> DataFrame:
    """Scores per metric and fold (metric, fold, score); one fit per fold serves all metrics.

    The folds are stored once, as every fit reads them several times.
    """
    seed = model_options.get("random_state", 42)
    folds = grouped_folds(train, cv_folds, seed) if by_subject else stratified_folds(train, k=cv_folds, random_state=seed)
    folds = stage(folds)
    scores = None
    for fold in range(cv_folds):
        model = BaselineModel(**model_options).fit(folds.filter(F.col("fold") != fold).drop("fold"), feature_cols)
        held_out = model.predictions(folds.filter(F.col("fold") == fold))
        report = metrics.classification_report(held_out)
        found = report.filter(F.col("name").isin("accuracy", "weighted avg")).select(
            F.when(F.col("name") == "accuracy", "accuracy").otherwise("f1_weighted").alias("metric"),
            F.lit(fold).alias("fold"),
            F.col("f1").alias("score"),
        )
        if len(model.classes) == 2 and f"prob_{positive}" in held_out.columns:
            auc = metrics.roc_auc(held_out, f"prob_{positive}", positive=positive)
            found = found.unionByName(
                auc.select(F.lit("roc_auc").alias("metric"), F.lit(fold).alias("fold"), F.col("roc_auc").alias("score"))
            )
        scores = found if scores is None else scores.unionByName(found)
    return scores


def summarize_scores(scores: DataFrame) -> DataFrame:
    """Mean, population deviation and the scores in fold order per metric."""
    listed = F.sort_array(F.collect_list(F.struct("fold", "score"))).getField("score")
    return scores.groupBy("metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), listed.alias("scores")
    )
