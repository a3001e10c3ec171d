"""Tree ensembles that MLlib does not fit itself: boosting with one softmax, forests weighted per bootstrap sample.

Both fit MLlib's distributed trees one after another and join them to MLlib's own ensemble models, which score them in
one pass.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from biospark.operators.fairness import copies
from biospark.session import stage

# Rounds between two stored tables of scores; a longer chain of trees would be evaluated again by every fit.
ROUNDS_STORED = 5
# Bound on a row's Newton step, as a row that is far off has next to no curvature.
FARTHEST_STEP = 4.0
# Trees of one round that are fitted at the same time.
FITS_AT_ONCE = 8
REGRESSORS = "org.apache.spark.ml.regression"
CLASSIFIERS = "org.apache.spark.ml.classification"


def softmax(scores: list[str]) -> list[Column]:
    """The share of each score's exponential, from columns."""
    highest = F.greatest(*scores)
    powers = [F.exp(F.col(s) - highest) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


@dataclass
class SoftmaxModel:
    """One sum of regression trees per class; their softmax is the classes' probabilities."""

    sums: list[GBTRegressionModel]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (the first of the likeliest classes) and ``__shares``, an array of probabilities."""
        names = [f"__score_{k}" for k in range(len(self.sums))]
        scored = df
        for name, part in zip(names, self.sums):
            scored = part.setPredictionCol(name).transform(scored)
        scored = scored.withColumn("__shares", F.array(*softmax(names))).drop(*names)
        return scored.withColumn("prediction", (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double"))

    def first(self, rounds: int) -> SoftmaxModel:
        """The model as it was after its first rounds."""
        return SoftmaxModel([_sum_of_trees(part.trees[:rounds], list(part.treeWeights)[:rounds]) for part in self.sums])

    def log_loss(self, df: DataFrame) -> float:
        """Mean of -log of the probability of each row's ``__label``."""
        own = F.element_at("__shares", F.col("__label").cast("int") + 1)
        return self.transform(df).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-300))))).first()[0]

    @property
    def models(self) -> list[GBTRegressionModel]:
        return self.sums

    def save(self, path: str) -> None:
        for k, part in enumerate(self.sums):
            part.write().overwrite().save(f"{path}/class-{k}")

    @classmethod
    def load(cls, path: str, classes: int) -> SoftmaxModel:
        return cls([GBTRegressionModel.load(f"{path}/class-{k}") for k in range(classes)])


def fit_softmax(
    prepared: DataFrame, classes: int, rounds: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42
) -> SoftmaxModel:
    """Newton boosting of the multinomial log loss over rows of ``__features``, ``__label`` (0, 1, ...), ``__weight``.

    A round fits one tree per class to (indicator - p) / (p (1 - p)) with weights p (1 - p): the weighted mean in a leaf
    is the Newton step. All trees of a round see the same probabilities and are fitted at the same time.
    """
    scores = [f"__s_{k}" for k in range(classes)]
    rows = stage(prepared.select("__features", "__label", "__weight", *[F.lit(0.0).alias(s) for s in scores]))
    trees: list[list] = [[] for _ in scores]
    for done in range(1, rounds + 1):
        shares = softmax(scores)
        curvature = [F.greatest(p * (1 - p), F.lit(1e-12)) for p in shares]

        def grow(k: int, rows=rows, shares=shares, curvature=curvature, done=done):
            step = ((F.col("__label") == k).cast("double") - shares[k]) / curvature[k]
            bounded = F.greatest(F.least(step, F.lit(FARTHEST_STEP)), F.lit(-FARTHEST_STEP))
            target = rows.select("__features", bounded.alias("__step"), (F.col("__weight") * curvature[k]).alias("__mass"))
            return DecisionTreeRegressor(
                featuresCol="__features", labelCol="__step", weightCol="__mass", predictionCol=f"__p_{k}", maxDepth=depth,
                seed=seed + done * classes + k,
            ).fit(target)

        with ThreadPool(min(classes, FITS_AT_ONCE)) as pool:
            grown = pool.map(inheritable_thread_target(prepared.sparkSession)(grow), range(classes))
        stepped = rows
        for k, tree in enumerate(grown):
            trees[k].append(tree)
            stepped = tree.transform(stepped)
        rows = stepped.select(
            "__features", "__label", "__weight", *[(F.col(s) + rate * F.col(f"__p_{k}")).alias(s) for k, s in enumerate(scores)]
        )
        if done % ROUNDS_STORED == 0 and done < rounds:
            rows = stage(rows)
    return SoftmaxModel([_sum_of_trees(grown, [rate] * rounds) for grown in trees])


def sample_weights(rows: DataFrame, samples: int, seed: int, unit: str = "__unit", label: str = "__label") -> list[dict]:
    """For each bootstrap sample the weight of each class that is in it: sample size / (classes in it * the class's size).

    ``unit`` names a row; all samples are counted in one aggregation.
    """
    drawn = [F.sum(copies(F.col(unit), seed, F.lit(i))).alias(f"n{i}") for i in range(1, samples + 1)]
    sizes = {r[label]: r for r in rows.groupBy(label).agg(*drawn).collect()}
    found = []
    for i in range(1, samples + 1):
        inside = {k: r[f"n{i}"] for k, r in sizes.items() if r[f"n{i}"]}
        found.append({k: sum(inside.values()) / (len(inside) * n) for k, n in inside.items()})
    return found


def fit_subsample_forest(
    prepared: DataFrame, classes: int, trees: int = 100, depth: int = 30, seed: int = 42
) -> RandomForestClassificationModel:
    """A forest whose class weights are those of each tree's bootstrap sample, over ``__features`` and ``__label``.

    A row is in a tree's sample Poisson(1) times. Rows are numbered and stored first, so that every tree draws from the
    same numbers. A sample without any row, possible for a handful of rows, gives no tree.
    """
    names = {"ml_attr": {"type": "nominal", "vals": [str(k) for k in range(max(classes, 2))]}}
    rows = stage(prepared.select("__features", "__label", F.monotonically_increasing_id().alias("__unit")))
    grown = []
    for i, weights in enumerate(sample_weights(rows, trees, seed), 1):
        if not weights:
            continue
        pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        times = copies(F.col("__unit"), seed, F.lit(i))
        # The number of classes comes from the column's metadata, as a sample may lack the last one.
        sample = rows.withColumn("__times", times).filter("__times > 0").select(
            "__features",
            F.col("__label").alias("__label", metadata=names),
            (F.col("__times") * pairs[F.col("__label")]).alias("__weight"),
        )
        single = RandomForestClassifier(
            featuresCol="__features", labelCol="__label", weightCol="__weight", numTrees=1, bootstrap=False,
            featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + i,
        )
        grown.append(single.fit(sample).trees[0])
    return _forest(grown, max(classes, 2))


def _java_trees(kind: str, trees: list):
    context = SparkSession.getActiveSession().sparkContext
    listed = context._gateway.new_array(getattr(context._jvm, kind), len(trees))
    for i, tree in enumerate(trees):
        listed[i] = tree._java_obj
    return context, listed


def _sum_of_trees(trees: list, weights: list[float]) -> GBTRegressionModel:
    context, listed = _java_trees(f"{REGRESSORS}.DecisionTreeRegressionModel", trees)
    factors = context._gateway.new_array(context._jvm.double, len(weights))
    for i, weight in enumerate(weights):
        factors[i] = weight
    joined = getattr(context._jvm, f"{REGRESSORS}.GBTRegressionModel")(f"gbtr_{uuid.uuid4().hex[:12]}", listed, factors)
    joined.set("maxIter", len(trees))
    return GBTRegressionModel(joined).setFeaturesCol("__features")


def _forest(trees: list, classes: int) -> RandomForestClassificationModel:
    context, listed = _java_trees(f"{CLASSIFIERS}.DecisionTreeClassificationModel", trees)
    features = trees[0].numFeatures
    kind = getattr(context._jvm, f"{CLASSIFIERS}.RandomForestClassificationModel")
    joined = kind(f"rfc_{uuid.uuid4().hex[:12]}", listed, features, classes)
    joined.set("numTrees", len(trees))
    return RandomForestClassificationModel(joined).setFeaturesCol("__features")
