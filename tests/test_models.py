from __future__ import annotations

import itertools
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from biospark.operators import ensembles, forests, metrics, ml, ordered, ranks, splits


def windows(spark, counts, labels=("stress", "baseline"), seed=1):
    rng = random.Random(seed)
    rows = [(f"{s}_{i}", s, rng.choice(labels), rng.gauss(0, 1)) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "window_id string, subject string, label string, x double")


def test_running_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN_IN", 3)
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(1000), rng.randrange(9)) for _ in range(400)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    table = spark.createDataFrame(rows, "k string, o int, v int").withColumn("b", F.floor(F.col("o") / 20))
    got = {(r.k, r.o): r.s for r in ordered.running_sums(table, ["k"], "b", ["o"], {"s": F.col("v")}).collect()}
    assert len(got) == len(rows)
    for k, o, _ in rows:
        assert got[k, o] == sum(v for k2, o2, v in rows if k2 == k and o2 <= o)


def test_previous_value_crosses_buckets(spark):
    table = spark.createDataFrame([(o, v) for o, v in [(1, None), (2, 5), (30, 6), (31, None), (90, 7)]], "o int, v int")
    got = {r.o: r.p for r in ordered.previous_value(table, [], F.floor(F.col("o") / 10), "o", "v", "p").collect()}
    assert got == {1: None, 2: None, 30: 5, 31: 6, 90: None}


def test_split_counts_and_disjoint_subjects(spark):
    table = windows(spark, {f"s{i:02d}": 10 + i % 3 for i in range(15)} | {"few": 9})
    split = splits.split_subjects(table)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"test": 3, "val": 3, "train": 9, "excluded": 1}
    joined = splits.create_stratified_splits(table)
    assert joined.count() == table.count()
    assert joined.groupBy("subject").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, splits.split_subjects(table).collect()))


def test_split_fallback(spark):
    sizes = lambda n: {
        r.split: r["count"] for r in splits.split_subjects(windows(spark, {f"s{i}": 3 for i in range(n)})).groupBy("split").count().collect()
    }
    assert sizes(2) == {"test": 1, "val": 1}
    assert sizes(12) == {"test": 2, "val": 2, "train": 8}


def test_three_valid_subjects(spark):
    split = splits.split_subjects(windows(spark, {"a": 10, "b": 10, "c": 10}))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 1, "val": 1, "train": 1}


def test_single_table_split(spark):
    got = splits.split_table(windows(spark, {f"s{i}": 1 for i in range(11)}))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"test": 2, "train": 9}


def test_folds(spark):
    folds = splits.stratified_folds(windows(spark, {"a": 50, "b": 53})).groupBy("label", "fold").count().collect()
    for label in ("stress", "baseline"):
        sizes = [r["count"] for r in folds if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    by_subject = splits.grouped_folds(windows(spark, {f"s{i}": 4 for i in range(10)}), k=5)
    assert by_subject.groupBy("subject").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert by_subject.select("fold").distinct().count() == 5


def scored(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), "stress" if rng.random() < 0.4 else "baseline", rng.randrange(20) / 20) for _ in range(n)]
    table = spark.createDataFrame(rows, "subject string, label string, score double")
    return rows, table.withColumn("predicted_label", F.when(F.col("score") > 0.5, "stress").otherwise("baseline"))


def test_ranking_metrics(spark):
    rows, table = scored(spark)
    pos = [s for _, y, s in rows if y == "stress"]
    neg = [s for _, y, s in rows if y != "stress"]
    pairs = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)]
    assert metrics.roc_auc(table, "score").first()[0] == pytest.approx(statistics.mean(pairs))
    thresholds = sorted({s for _, _, s in rows}, reverse=True)
    points = [(sum(s >= t for s in neg) / len(neg), sum(s >= t for s in pos) / len(pos), t) for t in thresholds]
    curve = metrics.roc_curve(table, "score", drop_intermediate=False).collect()
    assert sorted((r.fpr, r.tpr, r.threshold or 9.0) for r in curve) == sorted([(0.0, 0.0, 9.0), *((f, t, s or 9.0) for f, t, s in points)])
    before, area = 0.0, 0.0
    for t in thresholds:
        hits, called = sum(s >= t for s in pos), sum(s >= t for _, _, s in rows)
        area += (hits / len(pos) - before) * hits / called
        before = hits / len(pos)
    assert metrics.average_precision(table, "score").first()[0] == pytest.approx(area)
    pr = {r.threshold: r for r in metrics.pr_curve(table, "score").collect()}
    assert (pr[None].precision, pr[None].recall) == (1.0, 0.0) and pr[thresholds[-1]].recall == 1.0


def test_straight_stretches_of_the_curve_drop_out(spark):
    rows = [("stress", 0.9), ("baseline", 0.8), ("baseline", 0.7), ("baseline", 0.6), ("stress", 0.5)]
    table = spark.createDataFrame(rows, "label string, score double")
    kept = {r.threshold for r in metrics.roc_curve(table, "score").collect()}
    assert kept == {None, 0.9, 0.6, 0.5}
    one_class = table.filter("label = 'stress'")
    assert metrics.roc_auc(one_class, "score").first()[0] is None
    assert {r.fpr for r in metrics.roc_curve(one_class, "score").collect()} == {0.0, None}


def test_class_metrics(spark):
    rows = [("a", "a", "x")] * 3 + [("a", "b", "x"), ("b", "b", "y"), ("c", "a", "y")]
    table = spark.createDataFrame(rows, "label string, predicted_label string, subject string")
    cells = {(r.label, r.predicted): r.n for r in metrics.confusion_matrix(table).collect()}
    assert len(cells) == 9 and cells["a", "a"] == 3 and cells["c", "c"] == 0
    report = {r.name: r for r in metrics.classification_report(table).collect()}
    assert report["a"].precision == report["a"].recall == 0.75 and report["c"].f1 == 0
    assert report["accuracy"].f1 == pytest.approx(4 / 6) and report["macro avg"].recall == pytest.approx(1.75 / 3)
    assert report["weighted avg"].precision == pytest.approx((4 * 0.75 + 0.5) / 6)
    per_subject = metrics.per_group_report(table).collect()
    assert [(r.subject, r.n_samples, r.accuracy) for r in per_subject] == [("y", 2, 0.5)]


@pytest.mark.parametrize("n", [1, 2, 7, 10, 30001, 30002])
def test_medians(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 0.25]) for _ in range(n)]
    table = spark.createDataFrame([(v, None if i % 2 else -v, None) for i, v in enumerate(values)], "a double, b double, c double")
    got = {r.feature: r["median"] for r in ml.column_medians(table, ["a", "b", "c"]).collect()}
    assert got == {"a": statistics.median(values), "b": statistics.median([-v for v in values[::2]])}


def test_medians_of_chunks_that_hand_on_a_part_of_their_values(spark):
    n = 5 * ranks.POINTS + 1
    rng = np.random.default_rng(1)
    values = pd.DataFrame({"a": rng.normal(size=n), "b": np.floor(rng.exponential(size=n) * 50), "c": np.full(n, 5.1)})
    table = spark.createDataFrame(values).coalesce(1)
    got = {r.feature: r["median"] for r in ml.column_medians(table, ["a", "b", "c"]).collect()}
    assert got == values.median().to_dict()
    fitted = ml.FeatureScaling.fit(table, ["a", "b", "c"])
    assert fitted.means == pytest.approx(values.mean().to_dict()) and fitted.deviations["c"] == 1
    assert fitted.deviations["a"] == pytest.approx(values["a"].std(ddof=0))
    kept = ranks.kept_ranks(n)
    assert kept[0] == 1 and kept[-1] == n and len(kept) <= ranks.POINTS + 1 and np.diff(kept).max() <= -(-n // ranks.POINTS)


def test_imputing_and_scaling(spark):
    table = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "a double, b double")
    filled = ml.impute_medians(table, ["a"])
    assert sorted(r.a for r in filled.collect()) == [1, 2, 2, 3]
    scaled = ml.scale_standard(filled, ["a", "b"]).collect()
    assert sorted(r.a for r in scaled) == pytest.approx([-(2**0.5), 0, 0, 2**0.5]) and {r.b for r in scaled} == {0.0}
    fitted = ml.FeatureScaling.fit(table, ["a", "b"])
    assert (fitted.medians["a"], fitted.means["a"], fitted.deviations) == (2, 2, {"a": pytest.approx(0.5**0.5), "b": 1.0})


def separable(spark, labels, n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = i % len(labels)
        rows.append((f"w{i}", f"s{i // 6 % 5}", labels[k], None if i % 9 == 0 else k * 3 + rng.gauss(0, 0.5), rng.gauss(0, 1), None))
    return spark.createDataFrame(rows, "window_id string, subject string, label string, x double, noise double, void double")


@pytest.mark.parametrize("model_type, labels", [
    ("random_forest", ["baseline", "stress"]), ("random_forest", ["baseline", "physical", "stress"]),
    ("xgboost", ["baseline", "stress"]), ("xgboost", ["baseline", "physical", "stress"])])
def test_models(spark, model_type, labels):
    table = separable(spark, labels)
    model = ml.BaselineModel(model_type, n_estimators=5, max_depth=3).fit(table)
    predictions = model.predictions(table)
    assert predictions.columns == ["window_id", "subject", "label", "predicted_label", *[f"prob_{c}" for c in labels]]
    assert predictions.filter("label = predicted_label").count() > 0.85 * 120
    total = sum(F.col(f"prob_{c}") for c in labels)
    assert predictions.filter(F.abs(total - 1) > 1e-9).count() == 0
    weights = model.feature_importance(spark).collect()
    assert weights[0].feature == "x" and {r.feature: r.importance for r in weights}["void"] == 0
    tables = ml.evaluate_model(predictions)
    assert tables["roc_auc"].first()[0] > 0.9 and tables["per_subject"].count() > 0


def test_models_repeat_with_the_same_seed(spark):
    table = separable(spark, ["baseline", "stress"])
    one, two = (sorted(map(tuple, ml.BaselineModel(n_estimators=4).fit(table).predictions(table).collect())) for _ in range(2))
    assert one == two
    with pytest.raises(ValueError, match="Unsupported model type"):
        ml.BaselineModel("svm").fit(table)


def test_cross_validation(spark):
    scores = ml.cross_validate_model(separable(spark, ["baseline", "stress"]), ["x", "noise"], 3, n_estimators=3, max_depth=3)
    found = {r.metric: r for r in ml.summarize_scores(scores).collect()}
    assert set(found) == {"accuracy", "f1_weighted", "roc_auc"}
    assert all(len(r.scores) == 3 and r["mean"] > 0.8 and r["std"] == pytest.approx(statistics.pstdev(r.scores)) for r in found.values())


@pytest.mark.parametrize(
    "options", [{"max_depth": 31}, {"class_weight": "typo"}, {"class_weight": "balanced_subsample", "model_type": "gbt"}, {"impute": "mean"}, {"model_type": "svm"}]
)
def test_options_that_cannot_be_met_are_errors(options):
    with pytest.raises(ValueError):
        ml.BaselineModel(**options)


def test_bound_on_training_rows(spark):
    with pytest.raises(ValueError, match="max_training_rows"):
        ml.BaselineModel(max_training_rows=10).fit(separable(spark, ["baseline", "stress"]), ["x"])


@pytest.mark.parametrize(
    "model_type, labels, weight",
    [("random_forest", 2, "balanced"), ("random_forest", 3, "balanced_subsample"), ("gbt", 2, None), ("gbt", 3, None), ("xgboost", 3, "balanced")],
)
def test_saved_models_predict_alike(spark, tmp_path, model_type, labels, weight):
    table = separable(spark, ["baseline", "physical", "stress"][-labels:])
    model = ml.BaselineModel(model_type, n_estimators=3, max_depth=3, class_weight=weight).fit(table, ["x", "noise"])
    model.save(str(tmp_path / "m"))
    again = ml.BaselineModel.load(spark, str(tmp_path / "m"))
    assert again.predictions(table).collect() == model.predictions(table).collect()


def test_counts_beyond_whole_numbers(spark):
    big = 4_000_000_000
    points = spark.createDataFrame([(0.9, big, 1, big, 1), (0.1, 1, big, big + 1, big + 1)], "score double, pos long, neg long, tp long, fp long")
    assert metrics.average_precision_of(points).first()[0] == pytest.approx(1.0, abs=1e-6)
    assert metrics.roc_auc_of(points).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_median_of_counts(spark):
    rng = np.random.default_rng(1)
    spreads = {"a": (1001, 2**40), "b": (400, 50), "c": (1, 2**50), "d": (2, 2**30), "e": (3000, 2**14), "f": (6, 1)}
    values = {k: rng.integers(0, most, n) for k, (n, most) in spreads.items()}
    values["g"] = np.array([4095, 4096, 8191, 8192, 0, 2**62])
    rows = [(k, int(v)) for k, vs in values.items() for v in vs] + [(None, 3), (None, 4), ("h", None)]
    counted = spark.createDataFrame(rows, "k string, v long").groupBy("k", "v").count()
    got = {r.k: r["median"] for r in ordered.median_of_counts(counted, ["k"], "v", "count").collect()}
    assert got == {k: float(np.median(vs)) for k, vs in values.items()} | {None: 3.5}
    total = ordered.median_of_counts(counted, [], "v", "count").first()["median"]
    assert total == float(np.median(np.concatenate([*values.values(), [3, 4]])))


def test_previous_values_over_sparse_orders(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN_IN", 4)
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 10)
    orders = np.cumsum(np.random.default_rng(2).integers(1, 10**6, 500))
    rows = [("hot" if i % 3 else "cold", int(o), i % 11 if i % 5 else None) for i, o in enumerate(orders)]
    df = ordered.quantile_bucket(spark.createDataFrame(rows, "k string, o long, v long"), "o").withColumnRenamed("__bucket", "b")
    assert df.select("b").distinct().count() > 20
    got = {r.o: r.previous for r in ordered.previous_value(df, ["k"], F.col("b"), "o", "v").collect()}
    before, expected = {}, {}
    for k, o, v in rows:
        expected[o], before[k] = before.get(k), v
    assert got == expected


def known_windows(spark, leading):
    """Windows of a train and a test split in which ``leading`` tells the labels apart and the others are noise."""
    rng = random.Random(7)
    names = ["eda_mean", "hrv_hr_mean", "temp_mean"]
    rows = []
    for i in range(160):
        stress = i % 2
        values = [rng.gauss(3 * stress if n == leading else 0, 1) for n in names]
        rows.append((f"w{i}", f"s{i % 8}", "stress" if stress else "baseline", "test" if i % 8 == 7 else "train", *values))
    columns = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"window_id string, subject string, label string, split string, {columns}")


def test_queries_fit_the_tables_as_they_are(spark, monkeypatch):
    from biospark.plans import catalogue

    leads, reads = [], []
    for leading in ("hrv_hr_mean", "temp_mean"):
        monkeypatch.setattr(catalogue, "_training_windows", lambda *_: reads.append(leading) or known_windows(spark, leading))
        leads.append(catalogue.QUERIES["importance_top20"](spark, "a-folder-of-this-test").first()["feature"])
        catalogue.QUERIES["rf_checks"](spark, "a-folder-of-this-test")
    assert leads == ["hrv_hr_mean", "temp_mean"] and len(reads) == 4


def test_importance_of_a_known_leading_feature(spark, monkeypatch):
    from biospark.plans import catalogue

    monkeypatch.setattr(catalogue, "_training_windows", lambda *_: known_windows(spark, "temp_mean"))
    rows = catalogue.QUERIES["importance_top20"](spark, "a-folder-of-this-test").collect()
    weights = [r["importance"] for r in rows]
    assert rows[0]["feature"] == "temp_mean" and weights == sorted(weights, reverse=True)
    assert {r["feature"] for r in rows} == {"eda_mean", "hrv_hr_mean", "temp_mean"}
    assert weights[0] > 0.5 and sum(weights) == pytest.approx(1)


def ringed(spark, n=600, seed=11):
    """Three classes by distance from the middle, in two noisy columns: no single split tells any of them apart."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.uniform(-3, 3), rng.uniform(-3, 3)
        ring = min(int((a * a + b * b) ** 0.5 + rng.gauss(0, 0.1)), 2)
        rows.append((f"w{i}", f"s{i % 10}", ["baseline", "physical", "stress"][max(ring, 0)], a, b, rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "window_id string, subject string, label string, a double, b double, noise double")


def losses(predictions, classes):
    own = F.coalesce(*[F.when(F.col("label") == c, F.col(f"prob_{c}")) for c in classes])
    return predictions.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-6)))), F.avg((F.col("label") == F.col("predicted_label")).cast("int"))).first()


def test_softmax_boosting_falls_and_beats_one_against_the_rest(spark):
    table = ringed(spark).cache()
    train, held_out = table.filter("subject < 's7'"), table.filter("subject >= 's7'")
    columns = ["a", "b", "noise"]
    shared = ml.BaselineModel("xgboost", n_estimators=12, max_depth=3, class_weight=None).fit(train, columns)
    scaled = shared.scaling.transform(train).withColumn(
        "__label", F.array_position(F.array(*[F.lit(c) for c in shared.classes]), F.col("label")) - 1
    )
    falling = [shared.model.first(r).log_loss(scaled) for r in (1, 3, 6, 12)]
    assert falling == sorted(falling, reverse=True) and falling[0] < np.log(3) and falling[-1] < 0.35
    predictions = shared.predictions(held_out)
    assert predictions.filter(F.abs(F.col("prob_baseline") + F.col("prob_physical") + F.col("prob_stress") - 1) > 1e-9).isEmpty()
    loss, right = losses(predictions, shared.classes)
    apart = ml.BaselineModel("gbt", n_estimators=12, max_depth=3, class_weight=None).fit(train, columns)
    loss_apart, _ = losses(apart.predictions(held_out), apart.classes)
    assert right > 0.85 and loss < loss_apart
    weights = {r.feature: r.importance for r in shared.feature_importance(spark).collect()}
    assert min(weights["a"], weights["b"]) > weights["noise"]


def test_a_round_is_the_newton_step(spark):
    """Depth 0: the leaf is sum(w (y - p)) / sum(w p (1 - p)), at p = 1/3 in the first round."""
    rows = [(0.0, 1.0)] * 5 + [(1.0, 2.0)] * 3 + [(2.0, 0.5)] * 4
    table = spark.createDataFrame([(1.0, *r) for r in rows], "x double, __label double, __weight double")
    table = ml.VectorAssembler(inputCols=["x"], outputCol="__features").transform(table)
    total = sum(w for _, w in rows)
    scores = []
    for k in range(3):
        step = (sum(w for y, w in rows if y == k) - total / 3) / (total * 2 / 9)
        scores.append(0.5 * step)
    powers = np.exp(scores)
    got = ensembles.fit_softmax(table, 3, rounds=1, depth=0, rate=0.5).transform(table).first()["__shares"]
    assert got == pytest.approx(list(powers / powers.sum()))


def test_weights_of_each_bootstrap_sample(spark):
    from biospark.operators.fairness import copies

    rows = spark.range(60).select(F.col("id").alias("__unit"), F.when(F.col("id") < 50, 0.0).when(F.col("id") < 59, 1.0).otherwise(2.0).alias("__label"))
    got = ensembles.sample_weights(rows, 12, 5)
    drawn = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i"))
    counted = drawn.groupBy("i", "__label").agg(F.sum(copies(F.col("__unit"), 5, F.col("i"))).alias("n")).collect()
    for i, weights in enumerate(got, 1):
        sizes = {r["__label"]: r.n for r in counted if r.i == i and r.n}
        assert weights == {k: pytest.approx(sum(sizes.values()) / (len(sizes) * n)) for k, n in sizes.items()}
        # Every class of a sample weighs the same in it.
        assert len({round(weights[k] * sizes[k], 9) for k in sizes}) == 1
    assert {len(w) for w in got} == {2, 3}


def test_forest_weighted_per_sample(spark):
    rare = separable(spark, ["baseline"] * 19 + ["stress"], n=400)
    model = ml.BaselineModel(n_estimators=12, max_depth=4, class_weight="balanced_subsample").fit(rare, ["x", "noise"])
    predictions = model.predictions(rare)
    assert model.model.getNumTrees == 12
    assert losses(predictions, model.classes)[1] > 0.95 and predictions.filter("label = 'stress' and predicted_label = 'stress'").count() >= 18
    again = ml.BaselineModel(n_estimators=12, max_depth=4, class_weight="balanced_subsample").fit(rare, ["x", "noise"])
    assert sorted(map(tuple, again.predictions(rare).collect())) == sorted(map(tuple, predictions.collect()))


@pytest.mark.parametrize("model_type, weight", [("random_forest", "balanced"), ("random_forest", "balanced_subsample"), ("gbt", "balanced")])
def test_models_find_a_planted_rule(spark, model_type, weight):
    table = ringed(spark).withColumn("label", F.when((F.col("a") > 0) != (F.col("b") > 0.5), "stress").otherwise("baseline"))
    train, held_out = table.filter("subject < 's7'"), table.filter("subject >= 's7'")
    model = ml.BaselineModel(model_type, n_estimators=15, max_depth=5, class_weight=weight).fit(train, ["a", "b", "noise"])
    assert losses(model.predictions(held_out), model.classes)[1] > 0.9
    assert ml.evaluate_model(model.predictions(held_out))["roc_auc"].first()[0] > 0.95


def grown(spark, monkeypatch, table, rows_per_task=50_000, **options):
    """A forest whose trees grow on the executors, however small its table is."""
    monkeypatch.setattr(ml, "MOST_DRIVER_TREE_ROWS", 0)
    monkeypatch.setattr(forests, "ROWS_PER_TASK", rows_per_task)
    return ml.BaselineModel(**({"n_estimators": 12} | options)).fit(table, ["a", "b", "noise"])


@pytest.mark.parametrize("rows_per_task", [50_000, 60])
def test_forest_on_the_executors(spark, monkeypatch, tmp_path, rows_per_task):
    table = ringed(spark).cache()
    train, held_out = table.filter("subject < 's7'"), table.filter("subject >= 's7'")
    model = grown(spark, monkeypatch, train, rows_per_task)
    assert isinstance(model.model, forests.GrownForest)
    # With few rows per task the trees begin on the driver, else every tree is a single task's.
    assert all((len(top["feature"]) > 1) == (rows_per_task == 60) for top in model.model.tops)
    monkeypatch.setattr(forests, "SCORED_PER_TASK", 50)
    predictions = model.predictions(held_out)
    assert predictions.count() == held_out.count()
    assert predictions.filter(F.abs(F.col("prob_baseline") + F.col("prob_physical") + F.col("prob_stress") - 1) > 1e-9).isEmpty()
    loss, right = losses(predictions, model.classes)
    monkeypatch.setattr(ml, "MOST_DRIVER_TREE_ROWS", 10**9)
    plain = ml.BaselineModel(n_estimators=12).fit(train, ["a", "b", "noise"])
    assert right > 0.85 and abs(right - losses(plain.predictions(held_out), plain.classes)[1]) < 0.06
    weights = {r.feature: r.importance for r in model.feature_importance(spark).collect()}
    assert min(weights["a"], weights["b"]) > weights["noise"] and sum(weights.values()) == pytest.approx(1)
    model.save(str(tmp_path / "m"))
    again = ml.BaselineModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.predictions(held_out).collect())) == sorted(map(tuple, predictions.collect()))


def test_trees_on_the_executors_fit_their_samples_exactly(spark, monkeypatch):
    """Without a limit of depth, values of one class each end in leaves of one class, also below upper nodes."""
    classes = "abbabbbaaabaabbbabaa"
    rows = [(f"w{i}", "s", classes[i % 20], float(i % 20), -float(i % 20), float(i % 20) ** 2) for i in range(400)]
    table = spark.createDataFrame(rows, "window_id string, subject string, label string, a double, b double, noise double")
    model = grown(spark, monkeypatch, table, 100, n_estimators=4)
    for row in model.model.lower.collect():
        shares = forests.unpacked(row)["shares"].reshape(-1, 2)
        assert set(shares.ravel()) == {0.0, 1.0}
    assert losses(model.predictions(table), model.classes)[1] == 1
    shallow = grown(spark, monkeypatch, table, 100, n_estimators=4, max_depth=1)
    assert all(len(forests.unpacked(row)["feature"]) <= 3 for row in shallow.model.lower.collect())
    assert all(len(top["feature"]) <= 3 for top in shallow.model.tops)
    assert losses(shallow.predictions(table), shallow.classes)[1] < 1


@pytest.mark.parametrize("classes, field", [(2, 13), (4, 13), (9, 13), (4, 26), (30, 26)])
def test_counts_packed_in_fields_split_as_histograms_do(classes, field):
    rng = np.random.default_rng(classes)
    sizes = np.array([3000, 40, 7, 2, 1, 300])
    rows, weights = sizes.sum(), np.linspace(0.3, 4, classes)
    bins, label, times = rng.integers(0, 32, (rows, 10)).astype(np.uint8), rng.integers(0, classes, rows), rng.integers(1, 3, rows)
    # The first feature is the same for all rows, the second has few values.
    bins[:, 0], bins[:, 1] = 5, bins[:, 1] % 2
    drawn, node = forests.drawn_features(len(sizes), 10, 7), np.repeat(np.arange(len(sizes)), sizes)
    total = np.array([np.bincount(label[node == k], times[node == k], classes) for k in range(len(sizes))])
    got = forests.packed_splits(bins, label, times, sizes, drawn, total, weights, field)
    expected = forests.best_splits(forests.histograms(bins, label, times, node, drawn, classes), weights)
    split = expected[2] > 0
    assert split[:4].all() and not split[4] and np.allclose(got[2], expected[2])
    assert all((np.asarray(g)[split] == e[split]).all() for g, e in zip((got[0], got[1], got[3]), (expected[0], expected[1], expected[3])))


def test_rows_and_trees_travel_small(spark, monkeypatch):
    """Bins take five bits each on their way, leaves of one class no shares of their own, votes a record per block and tree."""
    bins = np.random.default_rng(1).integers(0, 32, (50, 10)).astype(np.uint8)
    packed = [row.tobytes() for row in forests.squeezed(bins)]
    assert {len(row) for row in packed} == {8} and (forests.unsqueezed(pd.Series(packed), 10) == bins).all()
    rows = [(f"w{i}", "s", "ab"[i % 2], float(i), -float(i), float(i)) for i in range(30)]
    table = spark.createDataFrame(rows, "window_id string, subject string, label string, a double, b double, noise double")
    model = grown(spark, monkeypatch, table, n_estimators=3)
    trees = [forests.unpacked(row) for row in model.model.lower.collect()]
    assert all(len(tree["feature"]) > 5 and tree["shares"].tolist() == [1, 0, 0, 1] for tree in trees)
    scored = model.transform(table.repartition(3))
    assert "sum(" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 30


def test_leaves_of_several_classes_keep_their_shares(spark, monkeypatch):
    rows = [(f"w{i}", "s", "aab"[i % 3], float(i % 2), 0.0, 0.0) for i in range(300)]
    table = spark.createDataFrame(rows, "window_id string, subject string, label string, a double, b double, noise double")
    model = grown(spark, monkeypatch, table, n_estimators=20, class_weight=None)
    found = model.predictions(table).agg(F.avg("prob_a").alias("a"), F.avg("prob_b").alias("b")).first()
    assert found.a == pytest.approx(2 / 3, abs=0.05) and found.a + found.b == pytest.approx(1)


def test_draws_of_rows_are_poisson(spark):
    times = [forests.drawn_times(np.arange(200_000), 42, t).astype(float) for t in (0, 1)]
    assert all(t.mean() == pytest.approx(1, abs=0.02) and t.var() == pytest.approx(1, abs=0.03) for t in times)
    assert abs(np.corrcoef(*times)[0, 1]) < 0.01


def test_classes_against_the_rest_are_fitted_at_the_same_time(spark, monkeypatch):
    used = []
    plain = ml.OneVsRest
    monkeypatch.setattr(ml, "OneVsRest", lambda **options: used.append(options["parallelism"]) or plain(**options))
    table = separable(spark, ["baseline", "physical", "stress"])
    model = ml.BaselineModel("gbt", n_estimators=3, max_depth=2).fit(table, ["x", "noise"])
    assert used == [3]
    alone = ml.BaselineModel("gbt", n_estimators=3, max_depth=2)
    monkeypatch.setattr(ml, "OneVsRest", lambda **options: plain(**(options | {"parallelism": 1})))
    assert sorted(map(tuple, alone.fit(table, ["x", "noise"]).predictions(table).collect())) == sorted(map(tuple, model.predictions(table).collect()))
