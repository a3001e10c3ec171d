"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biospark.contracts import ACC_COLUMNS, EDA_COLUMNS, HRV_COLUMNS, TEMP_COLUMNS, feature_columns
from biospark.functions.scalars import file_stem, subject_from_file
from biospark.operators import align, cycles, fairness, harmonize, load, metrics, ml, quality, splits, states
from biospark.operators.windows import WindowOptions, align_and_extract, extract_features_from_windows
from biospark.plans import views
from biospark.session import scratch_dir, stage
from biospark.sources.readers import extract_wesad
from biospark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Naming the checked columns saves the scan that looks for columns without values (as hop_windows does).
SIGNALS = ("hr", "eda_scl", "temp", "acc_mag")
AXES = ("hr", "eda_scl", "temp", "acc_x", "acc_y", "acc_z")
SHORT = views.windows_of(20, 10, ratio_columns=SIGNALS)
SHORT_AXES = views.windows_of(20, 10, ratio_columns=AXES)
LONG = views.windows_of(40, 20, ratio_columns=SIGNALS)
DENSE = views.windows_of(20, 5, ratio_columns=SIGNALS)
ON_GRID = views.windows_of(48, 24, 0.25, ratio_columns=SIGNALS)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero.

    A small shift keeps values halfway between two digits from depending on the order of summation.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double") + views.SHIFT * 10**-digits
    return F.when(F.abs(value) < 0.5 * 10**-digits, F.lit(0.0)).otherwise(F.round(value, digits))


def clock(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, instants as text, whole numbers as long."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = rounded(column, digits)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = clock(column)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


# Contract, cohort, labels, sources


def _raw_source(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    return views.raw_samples(spark, sf_dir).select(*[F.col(c).alias(n) for n, c in names.items()])


@query
def harmonize_source1(spark, sf_dir):
    names = {"timestamp": "timestamp", "subject_id": "subject", "BVP_HR": "hr", "EDA": "eda_scl", "TEMP": "temp",
             "ACC_magnitude": "acc_z", "activity_label": "label", "extra": "value"}
    return tidy(harmonize.harmonize_columns(_raw_source(spark, sf_dir, names), "hongn"))


@query
def harmonize_source2(spark, sf_dir):
    names = {"timestamp": "timestamp", "participant_id": "subject", "HR": "hr", "RMSSD": "eda_scl", "SDNN": "temp",
             "EDA_tonic": "acc_z", "stress_label": "label"}
    return tidy(harmonize.harmonize_columns(_raw_source(spark, sf_dir, names), "SWELL"))


@query
def harmonize_source3(spark, sf_dir):
    names = {"timestamp": "timestamp", "hr": "hr", "temp": "temp", "label": "label", "unused": "event_type"}
    return tidy(harmonize.harmonize_columns(_raw_source(spark, sf_dir, names), "wesad"))


@query
def validate_issues(spark, sf_dir):
    """Schema issues of a table with text where numbers belong, with the rows they concern."""
    raw = views.raw_samples(spark, sf_dir)
    broken = raw.select(clock("timestamp").alias("timestamp"), F.col("hr").cast("string").alias("hr"), "temp", "label")
    issues = F.array(*[F.lit(i) for i in quality.schema_issues(broken)])
    return broken.agg(F.count("*").alias("rows")).select(F.explode(issues).alias("issue"), "rows")


@query
def validate_null_columns(spark, sf_dir):
    names = {"timestamp": "timestamp", "subject_id": "subject", "BVP_HR": "hr", "EDA": "eda_scl"}
    table = harmonize.harmonize_columns(_raw_source(spark, sf_dir, names), "hongn")
    return quality.null_columns(table)


@query
def validate_order(spark, sf_dir):
    """Out-of-order rows per subject when the source order is by value instead of by time."""
    cents = F.round(F.col("value") * 100).cast("long")
    ordered = views.raw_samples(spark, sf_dir).withColumn("source_order", cents * 100000000 + F.col("event_id"))
    late = quality.out_of_order(ordered, "source_order")
    return late.groupBy("subject").agg(F.count("*").alias("late_rows"))


@query
def cohort_prefix(spark, sf_dir):
    picked = harmonize.filter_female_subjects(views.raw_samples(spark, sf_dir))
    return tidy(picked.select("event_id", "subject", "hr"))


@query
def cohort_list(spark, sf_dir):
    """Cohort given as a table: subjects with a purchase."""
    raw = views.raw_samples(spark, sf_dir)
    listed = raw.filter(F.col("event_type") == "purchase").select("subject")
    return tidy(harmonize.filter_female_subjects(raw, listed).select("event_id", "subject", "hr"))


@query
def label_map(spark, sf_dir):
    return harmonize.harmonize_stress_labels(views.raw_samples(spark, sf_dir)).select("event_id", "label")


@query
def label_distribution(spark, sf_dir):
    return quality.value_counts(harmonize.harmonize_stress_labels(views.raw_samples(spark, sf_dir)), "label")


@query
def parsed_timestamps(spark, sf_dir):
    """Text timestamps of a raw source become instants of the contract."""
    raw = views.raw_samples(spark, sf_dir)
    text = raw.select(clock("timestamp").alias("timestamp"), F.col("subject").alias("subject_id"), F.col("hr").alias("BVP_HR"))
    parsed = harmonize.harmonize_columns(text, "hongn").select("subject", F.unix_micros("timestamp").alias("micros"), "hr")
    return tidy(parsed)


@query
def subjects_from_names(spark, sf_dir):
    """Subject from the stem and from the pattern of file names made of a document's source and number."""
    name = F.concat("source", F.lit("_f"), F.col("doc_id").cast("string"), F.lit(".part.csv"))
    named = views.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return named.select("doc_id", file_stem("name").alias("stem"), subject_from_file("name").alias("subject"))


@query
def relative_time(spark, sf_dir):
    timed = harmonize.synchronize_timestamps(views.raw_samples(spark, sf_dir))
    return tidy(timed.select("event_id", "subject", "timestamp_relative"))


def _two_sources(spark, sf_dir):
    signal = views.signal(spark, sf_dir)
    first = harmonize.with_dataset(signal.filter(F.col("subject").startswith("f")), "hongn")
    second = harmonize.with_dataset(signal.filter(F.col("subject").startswith("m")).drop("acc_mag"), "swell")
    return first, second


@query
def merge_sources(spark, sf_dir):
    """Two sources on a common hourly grid with class labels and relative time."""
    merged = harmonize.merge_datasets(*_two_sources(spark, sf_dir), grid=views.hourly_grid())
    return tidy(merged.select(
        "dataset", "subject", "timestamp", "hr", "eda_scl", "acc_mag", "label", "timestamp_relative"))


@query
def merge_without_resampling(spark, sf_dir):
    merged = harmonize.merge_datasets(*_two_sources(spark, sf_dir), resample_1hz=False)
    return tidy(merged.select("dataset", "subject", "timestamp", "hr", "acc_mag", "label", "timestamp_relative"))


@query
def tumbling_mean(spark, sf_dir):
    """Mean per subject and hour of raw samples."""
    raw = views.raw_samples(spark, sf_dir).select("subject", "timestamp", "hr", "temp")
    return tidy(align.tumbling_mean(raw, ["subject"], "timestamp", "1h"))


@query
def pair_modalities(spark, sf_dir):
    """Clicks as one signal, sign-ups as the other, on the same hour; some subjects lack the second."""
    hourly = views.hourly_samples(spark, sf_dir)
    left = hourly.filter(F.col("event_type") == "click").select("subject", "timestamp", "hr", "temp")
    right = hourly.filter(F.col("event_type") == "signup").select("subject", "timestamp", "hr", "eda_scl")
    return tidy(harmonize.pair_modalities(left, right))


@query
def drop_incomplete(spark, sf_dir):
    raw = views.raw_samples(spark, sf_dir).select("event_id", "hr", "eda_scl", "temp")
    kept = raw.na.drop("any").select("event_id", F.lit("kept").alias("fate"))
    return kept.unionByName(harmonize.incomplete_rows(raw).select("event_id", F.lit("dropped").alias("fate")))


@query
def wrist_extraction(spark, sf_dir):
    """One-second pulse means joined with temperature and label on exact instants."""
    raw = views.raw_samples(spark, sf_dir)
    seconds = raw.withColumn("timestamp", F.date_trunc("second", "timestamp"))
    return tidy(extract_wesad(
        raw.select("subject", "timestamp", "hr"), seconds.select("subject", "timestamp", "temp"),
        seconds.select("subject", "timestamp", "label"), keys=["subject"]))


# Alignment


def _grid(spark, sf_dir, columns, **options):
    picked = views.signal(spark, sf_dir).select("event_id", "subject", "timestamp", *columns)
    return tidy(align.align_to_grid(picked, views.hourly_grid(**options)).drop("event_id"))


@query
def grid_linear(spark, sf_dir):
    return _grid(spark, sf_dir, ["hr", "eda_scl", "temp"])


@query
def grid_forward(spark, sf_dir):
    return _grid(spark, sf_dir, ["hr", "eda_scl", "temp"], method="forward")


@query
def grid_backward(spark, sf_dir):
    return _grid(spark, sf_dir, ["hr", "eda_scl", "temp"], method="backward")


@query
def grid_unlimited(spark, sf_dir):
    return _grid(spark, sf_dir, ["hr", "eda_scl"], max_gap=None)


@query
def grid_text_fill(spark, sf_dir):
    return _grid(spark, sf_dir, ["label"])


@query
def grid_bucket_mean(spark, sf_dir):
    """Off-grid samples averaged into their hour before alignment."""
    raw = views.raw_samples(spark, sf_dir).select("subject", "timestamp", "hr", "temp")
    return tidy(align.align_to_grid(raw, views.hourly_grid(grid="bucket_mean", on_duplicate="unchecked", tie_breaker=None)))


@query
def grid_off_grid_samples(spark, sf_dir):
    """Grid anchored on a subject's first minute: samples at other minutes drop out."""
    raw = views.raw_samples(spark, sf_dir).select(
        "event_id", "subject", F.date_trunc("minute", "timestamp").alias("timestamp"), "hr")
    options = views.hourly_grid(step="20min", max_gap="3h")
    return tidy(align.align_to_grid(raw, options).select("subject", "timestamp", "hr"))


@query
def grid_rejects(spark, sf_dir):
    """Subjects that hold an hour twice."""
    return align.duplicate_subjects(views.hourly_samples(spark, sf_dir))


@query
def grid_reject_subject(spark, sf_dir):
    """Half-hour samples; subjects with a repeated instant are left out."""
    halves = views.raw_samples(spark, sf_dir).select(
        "subject", F.timestamp_micros(F.floor(F.unix_micros("timestamp") / 300000000).cast("long") * 300000000).alias("timestamp"), "hr")
    options = views.hourly_grid(on_duplicate="reject_subject", tie_breaker=None, step="5min", max_gap="2h")
    aligned = align.align_to_grid(halves, options)
    return tidy(aligned.groupBy("subject").agg(
        F.count("*").alias("grid_points"), F.count("hr").alias("known"), F.avg("hr").alias("hr_mean")))


# Windows and features


def _short_windows(spark, sf_dir):
    return extract_features_from_windows(views.signal(spark, sf_dir), SHORT)


@query
def hop_windows(spark, sf_dir):
    windows = extract_features_from_windows(views.signal(spark, sf_dir), views.windows_of(20, 10))
    return tidy(windows.select("window_id", "window_length", "subject", "label", "timestamp_start", "timestamp_end"))


@query
def valid_windows(spark, sf_dir):
    """Windows kept at a high threshold, over the columns named."""
    options = views.windows_of(20, 10, 0.95, ratio_columns=("hr", "eda_scl"))
    return extract_features_from_windows(views.signal(spark, sf_dir), options).select("window_id", "subject")


@query
def hrv_time(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", *HRV_COLUMNS[:8]))


@query
def hrv_spectral(spark, sf_dir):
    windows = extract_features_from_windows(views.signal(spark, sf_dir), LONG)
    return tidy(windows.select("window_id", *HRV_COLUMNS[8:]))


@query
def eda_basic(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", *EDA_COLUMNS[:5]))


@query
def eda_slope_auc(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", "eda_slope", "eda_auc"))


@query
def eda_peaks(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", "eda_peak_count", "eda_peak_rate"))


@query
def eda_peaks_spaced(spark, sf_dir):
    """Four samples per second: of peaks less than four samples apart the highest stays."""
    options = views.windows_of(10, 5, rate=4.0, ratio_columns=SIGNALS)
    windows = extract_features_from_windows(views.signal(spark, sf_dir), options)
    return tidy(windows.select("window_id", "eda_peak_count", "eda_peak_rate", "eda_auc"))


@query
def temp_features(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", *TEMP_COLUMNS))


@query
def acc_magnitude_features(spark, sf_dir):
    return tidy(_short_windows(spark, sf_dir).select("window_id", *ACC_COLUMNS))


@query
def acc_axes_features(spark, sf_dir):
    windows = extract_features_from_windows(views.signal(spark, sf_dir, axes=True), SHORT_AXES)
    return tidy(windows.select("window_id", *ACC_COLUMNS[:5]))


@query
def acc_dominant_freq(spark, sf_dir):
    windows = extract_features_from_windows(views.signal(spark, sf_dir, axes=True), SHORT_AXES)
    return tidy(windows.select("window_id", "acc_dominant_freq"))


@query
def window_features(spark, sf_dir):
    """The whole feature table over the samples as they are."""
    return tidy(_short_windows(spark, sf_dir))


@query
def aligned_window_features(spark, sf_dir):
    """The whole feature table over the aligned grid, in one pass."""
    return tidy(align_and_extract(views.signal(spark, sf_dir), views.hourly_grid(), ON_GRID))


# Quality


def _two_datasets(spark, sf_dir):
    dataset = F.when(F.col("subject").startswith("f"), "hongn").otherwise("swell")
    raw = views.raw_samples(spark, sf_dir)
    return raw.select(dataset.alias("dataset"), "subject", "timestamp", "hr", "eda_scl", "temp", "label")


@query
def quality_overall(spark, sf_dir):
    report = quality.get_data_quality_report(_two_datasets(spark, sf_dir), "1 day", ["overall"])
    return tidy(report.select(
        "total_rows", "total_subjects", "start", "end", "duration_hours", "sampling_rate"))


@query
def quality_by_group(spark, sf_dir):
    return tidy(quality.get_data_quality_report(_two_datasets(spark, sf_dir), "1 day"))


@query
def missing_by_column(spark, sf_dir):
    return tidy(quality.missing_by_column(_two_datasets(spark, sf_dir)))


@query
def sampling_rate(spark, sf_dir):
    return tidy(quality.sampling_rate(_two_datasets(spark, sf_dir), "1 day"))


@query
def quality_from_states(spark, sf_dir):
    """The exact part of the report from states that were stored in one load per half of the days."""
    samples, path = _two_datasets(spark, sf_dir), f"{scratch_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    for half in (0, 1):
        part = samples.filter(F.dayofyear("timestamp") % 2 == half)
        states.store_states(states.quality_states(part), path, f"half-{half}")
    stored = spark.read.parquet(path)
    report = states.report_of_states(stored).select("level", "dataset", "subject", "total_rows", "start", "end", "duration_hours")
    missing = states.missing_of_states(stored).groupBy("level", "dataset", "subject").agg(F.sum("missing_count").alias("missing"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("level", "dataset", "subject")]
    return tidy(report.alias("r").join(missing.alias("m"), on).select("r.*", "missing"))


@query
def dataset_counts(spark, sf_dir):
    data = _two_datasets(spark, sf_dir)
    return quality.value_counts(data, "dataset").join(quality.subjects_by_dataset(data), "dataset")


@query
def distinct_subjects(spark, sf_dir):
    return quality.subjects(_two_datasets(spark, sf_dir))


@query
def unusable_rows(spark, sf_dir):
    """Rows whose timestamp or subject is missing (here: those without a heart rate)."""
    data = _two_datasets(spark, sf_dir)
    return quality.unusable_rows(data.withColumn("timestamp", F.when(F.col("hr").isNotNull(), F.col("timestamp"))))


@query
def subject_profile(spark, sf_dir):
    return tidy(quality.subject_profile(_labelled_windows(spark, sf_dir)))


@query
def cohort_compare(spark, sf_dir):
    windows = _labelled_windows(spark, sf_dir)
    return tidy(quality.cohort_means(windows, ["hrv_hr_mean", "hrv_rmssd", "eda_mean", "temp_mean"]))


@query
def window_metadata(spark, sf_dir):
    windows = _labelled_windows(spark, sf_dir)
    meta = quality.window_metadata(windows, {"window_size_sec": 20, "hop_size_sec": 5})
    return meta.select(
        F.size("feature_columns").cast("long").alias("feature_count"), "total_windows",
        F.col("total_subjects").alias("subject_count"),
        F.concat_ws(",", F.transform("label_distribution", lambda x: F.concat_ws("=", x["label"], x["count"]))).alias("labels"))


# Beyond the window: loads, temperature rises, cycles, subgroups, streams

RISES = cycles.RiseOptions(rise=0.3, min_after=1, min_before=2)


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text."""
    return tidy(df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.DateType)}))


@query
def stress_load_daily(spark, sf_dir):
    """Time under stress windows per subject and day; overlaps count once, midnight parts a window."""
    return _dated(load.daily_load(views.predicted_windows(spark, sf_dir)))


@query
def stress_load_weekly(spark, sf_dir):
    return _dated(load.weekly_load(load.daily_load(views.predicted_windows(spark, sf_dir))))


@query
def temperature_nights(spark, sf_dir):
    """Each night with the means of the nights around it and whether the temperature rises there."""
    nights = cycles.nightly_means(views.raw_samples(spark, sf_dir), RISES)
    return _dated(cycles.night_rises(nights, RISES).withColumn("hit", F.col("hit").cast("int")))


@query
def temperature_rises(spark, sf_dir):
    """Biphasic rises as episodes of nights."""
    return _dated(cycles.temperature_rises(views.raw_samples(spark, sf_dir), RISES))


def _cycle_loads(spark, sf_dir):
    rises = cycles.temperature_rises(views.raw_samples(spark, sf_dir), RISES)
    daily = load.daily_load(views.predicted_windows(spark, sf_dir))
    return cycles.cycle_loads(cycles.cycles_of(rises), daily)


@query
def cycle_stress(spark, sf_dir):
    """Stress load and irregularity of each cycle."""
    return _dated(_cycle_loads(spark, sf_dir))


@query
def cycle_correlation(spark, sf_dir):
    """Per subject: how stress load goes with irregularity."""
    samples, daily = views.raw_samples(spark, sf_dir), load.daily_load(views.predicted_windows(spark, sf_dir))
    return tidy(cycles.load_and_regularity(samples, daily, RISES, least=3)[0].select("subject", "n", "r"))


@query
def cycle_correlation_pooled(spark, sf_dir):
    samples, daily = views.raw_samples(spark, sf_dir), load.daily_load(views.predicted_windows(spark, sf_dir))
    return tidy(cycles.load_and_regularity(samples, daily, RISES, least=3)[1])


@query
def subgroup_spread(spark, sf_dir):
    """Gaps of four metrics between subgroups, with intervals from a bootstrap over subjects."""
    return tidy(fairness.subgroup_spread(views.predicted_windows(spark, sf_dir), "event_type", "subject", replicates=50, seed=7))


def _stream(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events as a stream of one file, and a new folder for what the stream writes."""
    file = spark.read.parquet(f"{sf_dir}/events.parquet")
    # A stream reads folders and patterns; a pattern also finds a single file.
    events = spark.readStream.schema(file.schema).parquet(f"{sf_dir}/events.parque[t]")
    return views.samples_of(events), f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query
def stream_moments(spark, sf_dir):
    """Moments of event-time windows of five days every two, as a stream leaves them: windows that are final."""
    samples, place = _stream(spark, sf_dir)
    picked = samples.select("subject", "timestamp", "hr", "eda_scl", "temp", "label")
    live.start_moments(
        picked, f"{place}/out", f"{place}/checkpoint", window="5 days", hop="2 days", delay="1 hour"
    ).awaitTermination()
    found = spark.read.schema(live.windowed_moments(picked, "5 days", "2 days").schema).parquet(f"{place}/out")
    return tidy(found.select("subject", "window_start", "window_length", "hrv_hr_mean", "hrv_hr_std", "eda_max", "temp_range"))


@query
def stream_features(spark, sf_dir):
    """Ordered features of the hourly grid's closed windows, as a stream leaves them."""
    samples, place = _stream(spark, sf_dir)
    options = live.LiveOptions(ON_GRID, step="1h", max_gap="5h", delay="1 hour", idle="60 days")
    live.start_ordered_features(views.hourly_signal(samples), f"{place}/out", f"{place}/checkpoint", options).awaitTermination()
    return tidy(spark.read.parquet(f"{place}/out/batch=*"))


# Splits and model preparation


def _labelled_windows(spark, sf_dir):
    return extract_features_from_windows(harmonize.harmonize_stress_labels(views.signal(spark, sf_dir)), DENSE)


@query
def split_subjects(spark, sf_dir):
    return tidy(splits.split_subjects(_labelled_windows(spark, sf_dir)))


@query
def split_windows(spark, sf_dir):
    return splits.create_stratified_splits(_labelled_windows(spark, sf_dir)).select("window_id", "split")


@query
def split_fallback(spark, sf_dir):
    """Windows are long here, so no subject has enough of them and all take part."""
    windows = extract_features_from_windows(views.signal(spark, sf_dir), LONG)
    return tidy(splits.split_subjects(windows).select("subject", "n_windows", "split"))


@query
def split_table(spark, sf_dir):
    return splits.split_table(views.raw_samples(spark, sf_dir))


@query
def kfold(spark, sf_dir):
    return tidy(splits.stratified_folds(_labelled_windows(spark, sf_dir)).select("window_id", "label", "fold"))


@query
def kfold_by_subject(spark, sf_dir):
    folds = splits.grouped_folds(views.raw_samples(spark, sf_dir).select("subject", "event_id"))
    return tidy(folds.groupBy("subject", "fold").agg(F.count("*").alias("rows")))


@query
def column_medians(spark, sf_dir):
    return tidy(ml.column_medians(views.raw_samples(spark, sf_dir), ["hr", "eda_scl", "temp", "value"]))


@query
def impute_median(spark, sf_dir):
    raw = views.raw_samples(spark, sf_dir).select("event_id", "hr", "eda_scl")
    return tidy(ml.impute_medians(raw, ["hr", "eda_scl"]))


@query
def scale_standard(spark, sf_dir):
    raw = views.raw_samples(spark, sf_dir).select("event_id", "temp", "value")
    return tidy(ml.scale_standard(raw, ["temp", "value"]))


@query
def class_weights(spark, sf_dir):
    return tidy(ml.class_weights(harmonize.harmonize_stress_labels(views.raw_samples(spark, sf_dir))))


# Evaluation


@query
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(views.scored_documents(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    return tidy(metrics.classification_report(views.scored_documents(spark, sf_dir)))


@query
def class_metrics(spark, sf_dir):
    """Sensitivity (recall) and specificity per class."""
    return tidy(metrics.class_metrics(views.scored_documents(spark, sf_dir)).select(
        "class", "recall", "specificity", "support"))


@query
def roc_auc(spark, sf_dir):
    return tidy(metrics.roc_auc(views.scored_documents(spark, sf_dir), "score"))


@query
def average_precision(spark, sf_dir):
    return tidy(metrics.average_precision(views.scored_documents(spark, sf_dir), "score"))


@query
def roc_curve(spark, sf_dir):
    return tidy(metrics.roc_curve(views.scored_documents(spark, sf_dir), "score"))


@query
def roc_curve_all_points(spark, sf_dir):
    return tidy(metrics.roc_curve(views.scored_documents(spark, sf_dir), "score", drop_intermediate=False))


@query
def pr_curve(spark, sf_dir):
    return tidy(metrics.pr_curve(views.scored_documents(spark, sf_dir), "score"))


@query
def per_subject_report(spark, sf_dir):
    return tidy(metrics.per_group_report(views.scored_documents(spark, sf_dir)))


# Models: the predictions have no SQL counterpart, what must hold for them has one


def _training_windows(spark, sf_dir):
    windows = _labelled_windows(spark, sf_dir)
    split = splits.create_stratified_splits(windows)
    return stage(split.select("window_id", "subject", "label", "split", *feature_columns(windows.columns)))


def _fit(spark, sf_dir, **options) -> tuple[ml.BaselineModel, DataFrame]:
    """A model at its defaults and the windows it was fitted for; every query reads its tables and fits its own."""
    data = _training_windows(spark, sf_dir)
    return ml.BaselineModel(**options).fit(data.filter("split = 'train'").drop("split")), data


def _fit_and_predict(spark, sf_dir, **options) -> DataFrame:
    """The predictions for the test windows."""
    model, data = _fit(spark, sf_dir, **options)
    return stage(model.predictions(data.filter("split = 'test'").drop("split")))


def _checks(predictions: DataFrame) -> DataFrame:
    """Per window: what its probabilities add up to, and whether the predicted class is the likeliest one."""
    shares = [c for c in predictions.columns if c.startswith("prob_")]
    likeliest = F.element_at(F.create_map(*[x for c in shares for x in (F.lit(c[5:]), F.col(c))]), F.col("predicted_label"))
    return tidy(predictions.select(
        "window_id", "subject", "label", sum(map(F.col, shares), F.lit(0.0)).alias("total"),
        (likeliest == F.greatest(*shares)).cast("int").alias("likeliest")))


@query
def rf_predictions(spark, sf_dir):
    return tidy(_fit_and_predict(spark, sf_dir))


@query
def rf_checks(spark, sf_dir):
    return _checks(_fit_and_predict(spark, sf_dir))


@query
def gbt_predictions(spark, sf_dir):
    return tidy(_fit_and_predict(spark, sf_dir, model_type="gbt"))


@query
def softmax_predictions(spark, sf_dir):
    """Ten rounds of boosting with one softmax over all classes."""
    return tidy(_fit_and_predict(spark, sf_dir, model_type="xgboost", n_estimators=10))


@query
def importance_top20(spark, sf_dir):
    model, _ = _fit(spark, sf_dir)
    return model.feature_importance(spark).limit(20)


@query
def importance_checks(spark, sf_dir):
    """Number of features with an importance, and the sum of all importances."""
    table = _fit(spark, sf_dir)[0].feature_importance(spark)
    return tidy(table.agg(F.count("*").alias("features"), F.sum("importance").alias("total")))


@query
def cross_validation(spark, sf_dir):
    scores = ml.cross_validate_model(_training_windows(spark, sf_dir).drop("split"))
    return tidy(ml.summarize_scores(scores).drop("scores"))
