"""The recording contract: column names, types, source maps and issue texts."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract columns in order with their types.
CONTRACT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("subject", T.StringType()),
        T.StructField("hr", T.DoubleType()),
        T.StructField("rmssd", T.DoubleType()),
        T.StructField("sdnn", T.DoubleType()),
        T.StructField("eda_scl", T.DoubleType()),
        T.StructField("eda_peak_rate", T.DoubleType()),
        T.StructField("temp", T.DoubleType()),
        T.StructField("acc_mag", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)

# Raw column name -> contract name, for each known source.
SOURCE_COLUMNS = {
    "hongn": {
        "timestamp": "timestamp",
        "subject_id": "subject",
        "BVP_HR": "hr",
        "EDA": "eda_scl",
        "TEMP": "temp",
        "ACC_magnitude": "acc_mag",
        "activity_label": "label",
    },
    "swell": {
        "timestamp": "timestamp",
        "participant_id": "subject",
        "HR": "hr",
        "RMSSD": "rmssd",
        "SDNN": "sdnn",
        "EDA_tonic": "eda_scl",
        "stress_label": "label",
    },
    "wesad": {
        "timestamp": "timestamp",
        "hr": "hr",
        "temp": "temp",
        "label": "label",
    },
}

# Raw label -> class. Anything else, null included, is OTHER_LABEL.
LABEL_CLASSES = {
    "stress": "stress",
    "stressed": "stress",
    "high_stress": "stress",
    "mental_stress": "stress",
    "cognitive_load": "stress",
    "baseline": "baseline",
    "rest": "baseline",
    "relaxed": "baseline",
    "calm": "baseline",
    "neutral": "baseline",
    "low_stress": "baseline",
    "physical": "physical",
    "exercise": "physical",
    "movement": "physical",
    "unknown": "other",
    "other": "other",
}
OTHER_LABEL = "other"
POSITIVE_LABEL = "stress"
UNKNOWN = "unknown"

# Columns of the window feature table, by group.
WINDOW_ID_COLUMNS = ["window_id", "window_length", "subject", "label", "timestamp_start", "timestamp_end"]
HRV_COLUMNS = [
    "hrv_hr_mean", "hrv_hr_std", "hrv_hr_min", "hrv_hr_max", "hrv_hr_range", "hrv_rmssd",
    "hrv_sdnn", "hrv_pnn50", "hrv_lf_power", "hrv_hf_power", "hrv_lf_hf_ratio",
]
EDA_COLUMNS = [
    "eda_mean", "eda_std", "eda_min", "eda_max", "eda_range", "eda_slope", "eda_peak_count",
    "eda_peak_rate", "eda_auc",
]
TEMP_COLUMNS = [
    "temp_mean", "temp_std", "temp_min", "temp_max", "temp_range", "temp_slope", "temp_delta",
]
ACC_COLUMNS = [
    "acc_mag_mean", "acc_mag_std", "acc_mag_min", "acc_mag_max", "acc_activity_count",
    "acc_dominant_freq",
]
FEATURE_TABLE_COLUMNS = WINDOW_ID_COLUMNS + HRV_COLUMNS + EDA_COLUMNS + TEMP_COLUMNS + ACC_COLUMNS

# Columns of the feature table that are not model inputs.
NON_FEATURE_COLUMNS = ["window_id", "subject", "label", "timestamp_start", "timestamp_end"]


def feature_columns(columns: list[str]) -> list[str]:
    """Model inputs among ``columns``: everything but ids, label, time bounds and split columns."""
    skip = set(NON_FEATURE_COLUMNS) | {"dataset", "split"}
    return [c for c in columns if c not in skip]


def series_keys(columns: list[str]) -> list[str]:
    """The columns that identify one recording: subject, and dataset when the table has it."""
    return [c for c in ("dataset", "subject") if c in columns]
