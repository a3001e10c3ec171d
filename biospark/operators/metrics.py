"""Classification metrics as aggregations over a prediction table.

All class metrics come from the (label, predicted) counts; all ranking metrics from one table with
one row per distinct score and running counts, built without a global single-task window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.contracts import POSITIVE_LABEL
from biospark.operators.ordered import previous_value, quantile_bucket, running_sums
from biospark.session import stage


def _counts(df: DataFrame, label: str, predicted: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """One row per (label, predicted) over all classes seen on either side, zeros included."""
    counts = _counts(df, label, predicted, [])
    seen = counts.select(F.explode(F.array("label", "predicted")).alias("c"))
    cells = (
        seen.agg(F.collect_set("c").alias("classes"))
        .select("classes", F.explode("classes").alias("label"))
        .select("label", F.explode("classes").alias("predicted"))
    )
    return cells.join(counts, ["label", "predicted"], "left").select(
        "label", "predicted", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def class_metrics(
    df: DataFrame, label: str = "label", predicted: str = "predicted_label", group: list[str] = ()
) -> DataFrame:
    """Precision, recall, F1, specificity and support per class (and group); 0 where undefined."""
    group = list(group)
    counts = _counts(df, label, predicted, group)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("called"), hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("called"), zero.alias("tp")),
    )
    per_class = (
        counts.select(*group, F.inline(sides))
        .groupBy(*group, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    )
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    per_class = per_class.join(totals, group) if group else per_class.withColumn("total", totals.scalar())
    negatives = F.col("total") - F.col("support")
    false_alarms = F.col("called") - F.col("tp")
    return per_class.select(
        *group, "class",
        _ratio(F.col("tp"), F.col("called")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        _ratio(negatives - false_alarms, negatives).alias("specificity"),
        "support", "tp", "total",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def classification_report(
    df: DataFrame, label: str = "label", predicted: str = "predicted_label", group: list[str] = ()
) -> DataFrame:
    """Class rows followed by the rows ``accuracy``, ``macro avg`` and ``weighted avg``."""
    group = list(group)
    per_class = class_metrics(df, label, predicted, group)
    scores = ("precision", "recall", "f1")
    rows = per_class.select(*group, F.col("class").alias("name"), *scores, "support")
    accuracy = F.sum("tp") / F.max("total")
    averages = per_class.groupBy(*group).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("name"), *[accuracy.alias(s) for s in scores], F.sum("support").alias("support")),
            F.struct(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support")),
            F.struct(
                F.lit("weighted avg").alias("name"),
                *[(F.sum(F.col(s) * F.col("support")) / F.max("total")).alias(s) for s in scores],
                F.sum("support").alias("support"),
            ),
        ).alias("rows")
    )
    return rows.unionByName(averages.select(*group, F.inline("rows")))


def per_group_report(
    df: DataFrame, group: str = "subject", label: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Rows, accuracy and weighted F1 per group, for groups in which at least two labels occur."""
    per_class = class_metrics(df, label, predicted, [group])
    return (
        per_class.groupBy(group)
        .agg(
            F.max("total").alias("n_samples"),
            (F.sum("tp") / F.max("total")).alias("accuracy"),
            (F.sum(F.col("f1") * F.col("support")) / F.max("total")).alias("f1_weighted"),
            F.count(F.when(F.col("support") > 0, 1)).alias("labels"),
        )
        .filter("labels > 1")
        .drop("labels")
    )


def score_table(
    df: DataFrame, score: str, label: str = "label", positive: object = POSITIVE_LABEL
) -> DataFrame:
    """One row per distinct score: positives and negatives there, and running counts from the top score down.

    The counts and the result are stored, so the predictions are read once however many metrics follow.
    """
    is_positive = F.col(label) == F.lit(positive)
    counted = stage(
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.when(is_positive, 1)).alias("pos"),
            F.count(F.when(~is_positive, 1)).alias("neg"),
        )
        .withColumn("down", -F.col("score"))
    )
    return stage(
        running_sums(
            quantile_bucket(counted, "down"), [], "__bucket", ["down"], {"tp": F.col("pos"), "fp": F.col("neg")}
        )
    )


def _with_totals(points: DataFrame) -> DataFrame:
    totals = points.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t"))
    return points.withColumn("__t", totals.scalar())


def roc_auc(df: DataFrame, score: str, label: str = "label", positive: object = POSITIVE_LABEL) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; null unless both classes occur."""
    return roc_auc_of(score_table(df, score, label, positive))


def roc_auc_of(points: DataFrame) -> DataFrame:
    outranked = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return points.agg(F.when(pairs > 0, outranked / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str = "label", positive: object = POSITIVE_LABEL) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    return average_precision_of(score_table(df, score, label, positive))


def average_precision_of(points: DataFrame) -> DataFrame:
    # As doubles: products of counts do not fit whole numbers.
    steps = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.agg(F.when(F.sum("pos") > 0, steps / F.sum("pos")).alias("average_precision"))


def roc_curve(
    df: DataFrame, score: str, label: str = "label", positive: object = POSITIVE_LABEL, drop_intermediate: bool = True
) -> DataFrame:
    """threshold, fpr, tpr; the start (0, 0) has a null threshold. Points on a straight stretch may be left out."""
    return roc_curve_of(score_table(df, score, label, positive), drop_intermediate)


def roc_curve_of(points: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    curve = _with_totals(points)
    if drop_intermediate:
        # Below a point comes the next lower score: the curve bends there if its step differs.
        curve = curve.withColumn("__step", F.struct("pos", "neg"))
        curve = previous_value(curve, [], F.col("__bucket") * -1, "score", "__step", "__next_step")
        ends = points.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("e")).scalar()
        bends = ~F.col("__step").eqNullSafe(F.col("__next_step"))
        curve = curve.withColumn("__ends", ends).filter(
            bends | (F.col("score") == F.col("__ends.lo")) | (F.col("score") == F.col("__ends.hi"))
        )
    curve = curve.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("__t.n")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("__t.p")).alias("tpr"),
    )
    return curve.unionByName(_single_point(points, "fpr", 0.0, "tpr", 0.0))


def pr_curve(df: DataFrame, score: str, label: str = "label", positive: object = POSITIVE_LABEL) -> DataFrame:
    """threshold, precision, recall; the end (1, 0) has a null threshold."""
    return pr_curve_of(score_table(df, score, label, positive))


def pr_curve_of(points: DataFrame) -> DataFrame:
    curve = _with_totals(points).select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.col("__t.p")).alias("recall"),
    )
    return curve.unionByName(_single_point(points, "precision", 1.0, "recall", 0.0))


def _single_point(df: DataFrame, x: str, x_value: float, y: str, y_value: float) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(x_value).alias(x), F.lit(y_value).alias(y)
    )
