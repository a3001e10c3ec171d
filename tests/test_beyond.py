"""Stress loads, temperature rises, cycles and subgroup gaps on small cases."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from biospark.operators import cycles, fairness, load

DAY = datetime(2024, 3, 4)  # a Monday


def windows(spark, rows):
    full = [(s, DAY + timedelta(hours=a), DAY + timedelta(hours=b), label) for s, a, b, label in rows]
    return spark.createDataFrame(full, "subject string, timestamp_start timestamp, timestamp_end timestamp, predicted_label string")


def hours(df, name):
    return {(r["subject"], r[name]): (r["n_windows"], r["covered_us"] / 3.6e9, r["stress_us"] / 3.6e9) for r in df.collect()}


def test_overlaps_count_once_and_midnight_parts_windows(spark):
    rows = [
        ("a", 10, 12, "stress"), ("a", 11, 13, "stress"), ("a", 11, 11.5, "baseline"), ("a", 12.5, 14, "baseline"),
        ("a", 23, 25, "stress"), ("a", 23.5, 24.5, "stress"), ("b", 0, 60, "stress"), ("b", 5, 6, None),
        ("c", 3, 3, "stress"), ("c", 5, 4, "stress"),
    ]
    daily = load.daily_load(windows(spark, rows))
    d = [date(2024, 3, 4) + timedelta(days=i) for i in range(3)]
    assert hours(daily, "day") == {
        ("a", d[0]): (6, 5, 4), ("a", d[1]): (2, 1, 1), ("b", d[0]): (2, 24, 24), ("b", d[1]): (1, 24, 24), ("b", d[2]): (1, 12, 12),
    }
    assert hours(load.weekly_load(daily), "week") == {("a", d[0]): (8, 6, 5), ("b", d[0]): (4, 60, 60)}


def test_load_against_minutes(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        start = rng.randrange(0, 6 * 1440)
        rows.append((rng.choice("ab"), start / 60, (start + rng.randrange(1, 900)) / 60, rng.choice(["stress", "baseline"])))
    minutes = {}
    for s, a, b, label in rows:
        for m in range(round(a * 60), round(b * 60)):
            day = minutes.setdefault((s, (DAY + timedelta(minutes=m)).date()), (set(), set()))
            day[0].add(m)
            if label == "stress":
                day[1].add(m)
    got = hours(load.daily_load(windows(spark, rows)), "day")
    assert {k: (round(v[1] * 60), round(v[2] * 60)) for k, v in got.items()} == {k: (len(v[0]), len(v[1])) for k, v in minutes.items()}


def nights(spark, temps, subject="a"):
    """Two samples per known night, one before and one after midnight, and one by day that counts nowhere."""
    rows = []
    for n, temp in enumerate(temps):
        if temp is not None:
            evening = DAY + timedelta(days=n, hours=21)
            rows += [(subject, evening, temp - 0.1), (subject, evening + timedelta(hours=8), temp + 0.1), (subject, evening + timedelta(hours=15), 99.0)]
    return spark.createDataFrame(rows, "subject string, timestamp timestamp, temp double")


def test_a_rise_is_found_and_missing_nights_are_missing(spark):
    low, high = [36.0] * 8, [36.5] * 5
    options = cycles.RiseOptions()
    got = cycles.temperature_rises(nights(spark, low + high + low + high), options).orderBy("episode").collect()
    assert [(r["episode"], r["hits"] > 0) for r in got] == [(1, True), (2, True)]
    # The first hit sees two of three nights after it that are high.
    assert [r["start"] for r in got] == [date(2024, 3, 4) + timedelta(days=n) for n in (7, 20)]
    means = cycles.nightly_means(nights(spark, [36.0, None, 36.2])).orderBy("night").collect()
    assert [(r["night"].day, round(r["mean"], 6), r["n_samples"]) for r in means] == [(4, 36.0, 2), (6, 36.2, 2)]
    # Five nights without a value leave too few before the rise.
    sparse = low[:3] + [None] * 5 + high
    assert cycles.temperature_rises(nights(spark, sparse), options).count() == 0


@pytest.mark.parametrize("block", [7, 64])
def test_blocks_do_not_change_a_history(spark, block):
    rng = random.Random(5)
    temps = [None if rng.random() < 0.2 else 36 + rng.random() for _ in range(200)]
    known = {n: t for n, t in enumerate(temps) if t is not None}
    hits = {}
    for n in known:
        after = [known[k] for k in range(n, n + 3) if k in known]
        before = [known[k] for k in range(n - 6, n) if k in known]
        if len(after) >= 2 and len(before) >= 3 and sum(after) / len(after) - sum(before) / len(before) >= 0.2:
            hits[n] = True
    episodes = []
    for n in sorted(hits):
        if episodes and n - episodes[-1][1] <= 3:
            episodes[-1] = (episodes[-1][0], n, episodes[-1][2] + 1)
        else:
            episodes.append((n, n, 1))
    got = cycles.temperature_rises(nights(spark, temps), cycles.RiseOptions(block=block)).orderBy("episode").collect()
    first = date(2024, 3, 4)
    assert [((r["start"] - first).days, (r["last"] - first).days, r["hits"]) for r in got] == episodes and len(episodes) > 10


def test_cycles_meet_the_days_inside_them(spark):
    days = [(0,), (28,), (50,), (90,)]
    episodes = spark.createDataFrame([("a", i + 1, date(2024, 3, 4) + timedelta(days=d)) for i, (d,) in enumerate(days)], "subject string, episode long, start date")
    found = cycles.cycles_of(episodes)
    daily = spark.createDataFrame([("a", date(2024, 3, 4) + timedelta(days=d), d, 100) for d in range(100)], "subject string, day date, stress_us long, covered_us long")
    got = cycles.cycle_loads(found, daily).orderBy("cycle").collect()
    assert [(r["days"], r["irregularity"], r["stress_us"]) for r in got] == [(28, 2.0, sum(range(28))), (22, 8.0, sum(range(28, 50))), (40, 10.0, sum(range(50, 90)))]


def test_correlations(spark):
    rng = random.Random(2)
    rows = [(s, x := rng.random(), (0.8 if s < "c" else -0.5) * x + 0.2 * rng.random()) for s in "abcd" for _ in range(12)]
    rows += [("e", 1.0, 2.0), ("e", None, 3.0), ("f", 1.0, 1.0), ("f", 1.0, 2.0), ("f", 1.0, 3.0), ("f", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "subject string, x double, y double")
    found = cycles.correlation(cycles.co_moments(df, ["subject"], "x", "y"))
    got = {r["subject"]: r["r"] for r in found.collect()}
    expected = {r["subject"]: r["r"] for r in df.filter("subject < 'e'").groupBy("subject").agg(F.corr("x", "y").alias("r")).collect()}
    assert got["e"] is None and got["f"] is None
    assert all(got[s] == pytest.approx(expected[s]) for s in "abcd")
    pooled = cycles.pooled_correlation(found).first()
    assert pooled["subjects"] == 4 and pooled["pairs"] == 48 and pooled["r_low"] < pooled["r"] < pooled["r_high"]


def predictions(spark, groups, seed):
    """``groups``: subgroup -> share of right predictions; windows of a subject share their luck."""
    rng = random.Random(seed)
    rows = []
    for group, share in groups.items():
        for s in range(60):
            luck = rng.gauss(0, 0.05)
            for _ in range(20):
                label = rng.choice(["stress", "baseline"])
                other = "baseline" if label == "stress" else "stress"
                rows.append((group, f"{group}{s}", label, label if rng.random() < share + luck else other))
    return spark.createDataFrame(rows, "team string, subject string, label string, predicted_label string")


def test_gaps_and_their_intervals(spark):
    df = predictions(spark, {"x": 0.9, "y": 0.7, "z": 0.8}, 1).cache()
    got = {r["metric"]: r for r in fairness.subgroup_spread(df, "team", "subject", replicates=100).collect()}
    assert set(got) == set(fairness.METRICS)
    for r in got.values():
        assert (r["subgroups"], r["lowest_in"], r["highest_in"], r["replicates"]) == (3, "y", "x", 100)
        assert r["gap"] == pytest.approx(r["highest"] - r["lowest"])
    # The planted gap lies in the interval, which is not wide.
    assert got["accuracy"]["gap_low"] < 0.2 < got["accuracy"]["gap_high"] < 0.3
    again = {r["metric"]: r for r in fairness.subgroup_spread(df.repartition(7), "team", "subject", replicates=100).collect()}
    assert again == got
    other = fairness.subgroup_spread(df, "team", "subject", replicates=100, seed=1).collect()
    assert {r["metric"]: r["gap_low"] for r in other} != {k: r["gap_low"] for k, r in got.items()}


def test_copies_are_poisson(spark):
    drawn = spark.range(20_000).select(fairness.copies(F.col("id"), 3, F.lit(1)).alias("w"))
    row = drawn.agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert row[0] == pytest.approx(1, abs=0.03) and row[1] == pytest.approx(1, abs=0.05) and row[2] == pytest.approx(0.3679, abs=0.015)


def test_spread_leaves_out_what_is_unknown(spark):
    df = predictions(spark, {"x": 0.9}, 2).limit(5).unionByName(spark.createDataFrame([(None, "s", "stress", "stress"), ("x", "s", None, "stress")], "team string, subject string, label string, predicted_label string"))
    counts = fairness.unit_counts(df, "team", "subject").agg(F.sum("n")).first()[0]
    assert counts == 5
    empty = df.filter("false")
    assert fairness.subgroup_spread(empty, "team", "subject", replicates=3).count() == 0
