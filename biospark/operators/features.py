"""Per-window signal features as expressions over one grouped aggregation.

"Adjacent" always means adjacent among the non-null samples of the window. The previous
non-null sample is looked up once per chunk and counts inside a window only if it lies
inside that window too. Arrays are collected per window only, so their length is at most
the window length; they hold what needs the whole window at once: counts above a threshold that is itself
a window statistic, and the spectra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.contracts import (
    ACC_COLUMNS, EDA_COLUMNS, FEATURE_TABLE_COLUMNS, HRV_COLUMNS, TEMP_COLUMNS, UNKNOWN, WINDOW_ID_COLUMNS,
)
from biospark.functions import spectral
from biospark.functions.scalars import magnitude, nan_to_null, window_id

AXES = ["acc_x", "acc_y", "acc_z"]
# Fixed value: a successive RR difference above this many seconds counts for pNN50.
PNN_SECONDS = 0.05
MILLISECONDS = 1000


def _has_axes(columns: list[str]) -> bool:
    return "acc_mag" not in columns and all(a in columns for a in AXES)


def with_neighbours(rows: DataFrame, partition: list[str], pos: str, rate: float) -> DataFrame:
    """Add RR and, per row, what it shares with its previous known sample along ``pos`` within ``partition``.

    ``__<signal>_from`` is the position of that sample: a window that starts later does not contain it.
    """
    columns = rows.columns
    order = Window.partitionBy(*partition).orderBy(pos)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    over = f"over (partition by {', '.join(f'`{p}`' for p in partition)} order by `{pos}`)"

    def known_pos(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(pos))

    derived: dict[str, Column] = {}
    seen: dict[str, Column] = {}
    shared: dict[str, Column] = {}
    if _has_axes(columns):
        derived["__acc"] = magnitude(*[F.col(a) for a in AXES])
    if "hr" in columns:
        derived["__rr"] = F.try_divide(F.lit(60.0), F.col("hr"))
        seen["__rr_before"] = F.last("__rr", True).over(earlier)
        seen["__rr_from"] = F.last(known_pos("__rr"), True).over(earlier)
        jump = F.col("__rr") - F.col("__rr_before")
        shared["__rr_jump2"] = jump * jump
        shared["__rr_far"] = (F.abs(jump) > PNN_SECONDS).cast("int")
    if "eda_scl" in columns:
        seen["__eda_before"] = F.last("eda_scl", True).over(earlier)
        seen["__eda_from"] = F.last(known_pos("eda_scl"), True).over(earlier)
        seen["__eda_rank"] = F.count("eda_scl").over(so_far)
        shared["__eda_area"] = (F.col("eda_scl") + F.col("__eda_before")) / 2
        # A plateau is one candidate: only rows where the level changes are compared.
        step = F.col("eda_scl").isNotNull() & ~F.col("eda_scl").eqNullSafe(F.col("__eda_before"))
        shared["__eda_step"] = F.when(step, F.col("eda_scl"))
        shared["__eda_step_pos"] = F.when(step, F.col(pos))
        shared["__eda_step_rank"] = F.when(step, F.col("__eda_rank"))
    if "temp" in columns:
        seen["__temp_rank"] = F.count("temp").over(so_far)
    for added in (derived, seen, shared):
        rows = rows.withColumns(added) if added else rows
    if "eda_scl" in columns and int(rate) >= 1:
        rows = rows.withColumns(
            {
                "__eda_after": F.expr(f"lead(__eda_step, 1) ignore nulls {over}"),
                "__eda_until": F.expr(f"lead(__eda_step_pos, 1) ignore nulls {over}"),
                "__eda_step_end": F.expr(f"lead(__eda_step_rank, 1) ignore nulls {over}") - 1,
            }
        )
        peak = (F.col("__eda_step") > F.col("__eda_before")) & (F.col("__eda_step") > F.col("__eda_after"))
        # The middle of a plateau, counted in known samples.
        middle = F.floor((F.col("__eda_step_rank") + F.col("__eda_step_end")) / 2).alias("at")
        rows = rows.withColumn("__eda_top", F.when(peak, F.struct(F.col("__eda_step").alias("v"), middle)))
    return rows.drop(
        "__rr_before", "__eda_before", "__eda_step", "__eda_step_pos", "__eda_step_rank", "__eda_step_end", "__eda_after"
    )


def aggregate_windows(
    rows: DataFrame, group: list[str], size: int | None, rate: float, timestamp: str, checked: list[str],
    start: str = "__start", pos: str = "__pos",
) -> DataFrame:
    """One row of raw statistics per window; ``finish`` turns them into the feature columns."""
    columns = rows.columns
    aggs = [F.count("*").alias("window_length")]
    if "label" in columns:
        aggs.append(F.coalesce(F.mode("label", True), F.lit(UNKNOWN)).alias("label"))
    if timestamp in columns:
        aggs += [F.min(timestamp).alias("timestamp_start"), F.max(timestamp).alias("timestamp_end")]
    aggs += [F.count(c).alias(f"__valid_{c}") for c in checked]

    def inside(neighbour: str) -> Column:
        return F.col(f"{neighbour}_from") >= F.col(start)

    def in_order(c: str) -> Column:
        pairs = F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(pos), F.col(c).alias("v"))))
        return F.sort_array(pairs).getField("v")

    if "hr" in columns:
        aggs += _moments("hr", "hr") + [
            F.avg(F.when(inside("__rr"), F.col("__rr_jump2"))).alias("__rr_jump2"),
            F.avg(F.when(inside("__rr"), F.col("__rr_far"))).alias("__rr_far"),
            F.stddev_pop("__rr").alias("__rr_sd"),
            in_order("__rr").alias("__rr_list"),
        ]
    if "eda_scl" in columns:
        aggs += _moments("eda_scl", "eda") + [
            F.regr_slope("eda_scl", "__eda_rank").alias("__eda_slope"),
            F.sum(F.when(inside("__eda"), F.col("__eda_area"))).alias("__eda_area"),
        ]
        if int(rate) >= 1:
            ends_inside = inside("__eda")
            if size is not None:
                ends_inside &= F.col("__eda_until") < F.col(start) + size
            aggs.append(F.collect_list(F.when(ends_inside, F.col("__eda_top"))).alias("__eda_tops"))
    if "temp" in columns:
        known_at = F.when(F.col("temp").isNotNull(), F.col(pos))
        aggs += _moments("temp", "temp") + [
            F.regr_slope("temp", "__temp_rank").alias("__temp_slope"),
            F.min_by("temp", known_at).alias("__temp_first"),
            F.max_by("temp", known_at).alias("__temp_last"),
        ]
    if "acc_mag" in columns:
        aggs += _moments("acc_mag", "acc") + [F.collect_list("acc_mag").alias("__acc_list")]
    elif _has_axes(columns):
        aggs += _moments("__acc", "acc") + [in_order("__acc").alias("__acc_list")]
    return rows.groupBy(*group).agg(*aggs)


def _moments(column: str, name: str) -> list[Column]:
    return [
        F.count(column).alias(f"__{name}_n"),
        F.avg(column).alias(f"__{name}_mean"),
        F.stddev_samp(column).alias(f"__{name}_std"),
        F.min(column).alias(f"__{name}_min"),
        F.max(column).alias(f"__{name}_max"),
    ]


# Columns with moments: signal -> (name of its statistics, prefix of its features).
MOMENTS = {"hr": ("hr", "hrv_hr"), "eda_scl": ("eda", "eda"), "temp": ("temp", "temp"), "acc_mag": ("acc", "acc_mag")}


def moment_aggregates(columns: list[str], timestamp: str) -> list[Column]:
    """Aggregates of a window that need no order: its length, label, bounds and the moments of each signal."""
    aggs = [F.count("*").alias("window_length"), F.min(timestamp).alias("timestamp_start"), F.max(timestamp).alias("timestamp_end")]
    if "label" in columns:
        aggs.append(F.coalesce(F.mode("label", True), F.lit(UNKNOWN)).alias("label"))
    for signal, (name, _) in MOMENTS.items():
        aggs += _moments(signal, name) if signal in columns else []
    return aggs


def moment_columns(columns: list[str]) -> list[Column]:
    """The feature columns over ``moment_aggregates``."""
    out: dict[str, Column] = {}
    for signal, (name, prefix) in MOMENTS.items():
        if signal == "acc_mag" and signal in columns:
            out |= {f"{prefix}_{s}": F.col(f"__{name}_{s}") for s in ("mean", "std", "min", "max")}
        elif signal in columns:
            out |= _basic(name, prefix)
    fixed = ["window_length", "timestamp_start", "timestamp_end", *(["label"] if "label" in columns else [])]
    return [F.col(c) for c in fixed] + [value.alias(c) for c, value in out.items()]


def window_id_column(aggregated: DataFrame, size: int) -> Column:
    subject = F.col("subject") if "subject" in aggregated.columns else F.lit(UNKNOWN)
    return window_id(subject, F.col("__start"), size)


def finish(stats: DataFrame, source_columns: list[str], rate: float, extra: list[str] = ()) -> DataFrame:
    """Feature columns from window statistics; a group is absent when its signal column is."""
    if "hr" in source_columns:
        stats = stats.withColumn("__bands", spectral.band_powers(float(spectral.UPSAMPLING * rate))(F.col("__rr_list")))
    out: dict[str, Column] = {}
    if "hr" in source_columns:
        out |= _hrv(stats)
    if "eda_scl" in source_columns:
        out |= _eda(rate)
    if "temp" in source_columns:
        out |= _temperature()
    if "acc_mag" in source_columns:
        out |= _acceleration_from_magnitude()
    elif _has_axes(source_columns):
        out |= _acceleration_from_axes(rate)
    if "label" not in stats.columns:
        stats = stats.withColumn("label", F.lit(UNKNOWN))
    names = [c for c in WINDOW_ID_COLUMNS if c in stats.columns]
    values = [out[c].alias(c) for c in FEATURE_TABLE_COLUMNS if c in out]
    return nan_to_null(stats.select(*extra, *names, *values))


def _at_least_two(name: str, value: Column) -> Column:
    return F.when(F.col(f"__{name}_n") >= 2, value)


def _basic(name: str, prefix: str, spread: bool = True) -> dict[str, Column]:
    stats = {f"{prefix}_{s}": _at_least_two(name, F.col(f"__{name}_{s}")) for s in ("mean", "std", "min", "max")}
    if spread:
        stats[f"{prefix}_range"] = stats[f"{prefix}_max"] - stats[f"{prefix}_min"]
    return stats


def _hrv(stats: DataFrame) -> dict[str, Column]:
    lf, hf = F.col("__bands.lf"), F.col("__bands.hf")
    return _basic("hr", "hrv_hr") | {
        "hrv_rmssd": _at_least_two("hr", F.sqrt("__rr_jump2") * MILLISECONDS),
        "hrv_sdnn": _at_least_two("hr", F.col("__rr_sd") * MILLISECONDS),
        "hrv_pnn50": _at_least_two("hr", F.col("__rr_far") * 100),
        "hrv_lf_power": lf,
        "hrv_hf_power": hf,
        "hrv_lf_hf_ratio": F.when(hf > spectral.ZERO_POWER, lf / hf),
    }


def _spaced(peaks: Column, spacing: int) -> Column:
    """How many peaks stay if, from the highest down (the later one first on ties), each must lie ``spacing`` known samples
    from those that stay already."""
    order = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["v"]).alias("v"), (-p["at"]).alias("at"))))
    none = F.array().cast("array<bigint>")
    stay = F.aggregate(
        order,
        none,
        lambda kept, p: F.when(
            F.forall(kept, lambda k: F.abs(k + p["at"]) >= spacing), F.concat(kept, F.array(-p["at"]))
        ).otherwise(kept),
    )
    return F.size(stay)


def _eda(rate: float) -> dict[str, Column]:
    height = F.col("__eda_mean") + F.col("__eda_std") * 0.5
    if int(rate) < 1:
        # No whole sample per second: the spacing is undefined and peaks are reported as none.
        peaks, area = F.lit(0).cast("long"), F.lit(None).cast("double")
    else:
        high = F.filter("__eda_tops", lambda top: top["v"] >= height)
        peaks, area = (F.size(high) if int(rate) == 1 else _spaced(high, int(rate))).cast("long"), F.col("__eda_area")
    per_minute = peaks / (F.col("__eda_n") / F.lit(float(rate))) * 60
    return _basic("eda", "eda") | {
        "eda_slope": _at_least_two("eda", F.col("__eda_slope")),
        "eda_peak_count": _at_least_two("eda", peaks),
        "eda_peak_rate": _at_least_two("eda", per_minute),
        "eda_auc": _at_least_two("eda", area),
    }


def _temperature() -> dict[str, Column]:
    return _basic("temp", "temp") | {
        "temp_slope": _at_least_two("temp", F.col("__temp_slope")),
        "temp_delta": _at_least_two("temp", F.col("__temp_last") - F.col("__temp_first")),
    }


def _active_samples() -> Column:
    limit = F.col("__acc_mean") + F.col("__acc_std")
    return F.size(F.filter("__acc_list", lambda v: v > limit)).cast("long")


def _acceleration_from_magnitude() -> dict[str, Column]:
    stats = {f"acc_mag_{s}": F.col(f"__acc_{s}") for s in ("mean", "std", "min", "max")}
    return stats | {
        "acc_activity_count": F.coalesce(_active_samples(), F.lit(0).cast("long")),
        "acc_dominant_freq": F.lit(None).cast("double"),
    }


def _acceleration_from_axes(rate: float) -> dict[str, Column]:
    return _basic("acc", "acc_mag", spread=False) | {
        "acc_activity_count": _at_least_two("acc", _active_samples()),
        "acc_dominant_freq": _at_least_two("acc", spectral.dominant_frequency(rate)(F.col("__acc_list"))),
    }


def compute_window_features(
    df: DataFrame, window_keys: list[str], order: str = "timestamp", sampling_rate: float = 1.0
) -> DataFrame:
    """All feature groups of ready-made windows: one output row per ``window_keys`` group.

    The groups are windows, that is short; use ``extract_features_from_windows`` on recordings.
    """
    df = nan_to_null(df)
    numbered = df.withColumns(
        {"__pos": F.row_number().over(Window.partitionBy(*window_keys).orderBy(order)) - 1, "__start": F.lit(0)}
    )
    rows = with_neighbours(numbered, window_keys, "__pos", sampling_rate)
    stats = aggregate_windows(rows, window_keys, None, sampling_rate, "timestamp", [])
    if "subject" in df.columns and "subject" not in window_keys:
        subjects = df.groupBy(*window_keys).agg(F.min_by("subject", order).alias("subject"))
        stats = stats.join(subjects, window_keys)
    extra = [k for k in window_keys if k not in WINDOW_ID_COLUMNS]
    return finish(stats, df.columns, sampling_rate, extra)


def compute_hrv_features(df: DataFrame, window_keys: list[str], order: str, hr: str = "hr", sampling_rate: float = 1.0):
    """Heart-rate features of ready-made windows."""
    return _one_group(df, window_keys, order, {"hr": hr}, HRV_COLUMNS, sampling_rate)


def compute_eda_features(df: DataFrame, window_keys: list[str], order: str, eda: str = "eda_scl", sampling_rate: float = 1.0):
    """Electrodermal features of ready-made windows."""
    return _one_group(df, window_keys, order, {"eda_scl": eda}, EDA_COLUMNS, sampling_rate)


def compute_temperature_features(df: DataFrame, window_keys: list[str], order: str, temp: str = "temp"):
    """Temperature features of ready-made windows."""
    return _one_group(df, window_keys, order, {"temp": temp}, TEMP_COLUMNS, 1.0)


def compute_accelerometer_features(
    df: DataFrame, window_keys: list[str], order: str, axes: list[str] = tuple(AXES), sampling_rate: float = 1.0
):
    """Movement features of ready-made windows from the three axes."""
    return _one_group(df, window_keys, order, dict(zip(AXES, axes)), ACC_COLUMNS, sampling_rate)


def _one_group(df, window_keys, order, signals, wanted, rate) -> DataFrame:
    picked = df.select(*window_keys, F.col(order).alias("__order"), *[F.col(c).alias(n) for n, c in signals.items()])
    return compute_window_features(picked, window_keys, "__order", rate).select(*window_keys, *wanted)
