"""SQL counterparts of the catalogue, for DuckDB.

Written per window and per grid point in the plainest way, so that they share no method with the
DataFrame operators they check.
"""

from __future__ import annotations

from biospark.contracts import EDA_COLUMNS, FEATURE_TABLE_COLUMNS, HRV_COLUMNS, LABEL_CLASSES, TEMP_COLUMNS
from biospark.operators.fairness import POISSON_STEPS
from biospark.plans.views import EVENT_LABELS, SHIFT


def rnd(expr: str, digits: int = 6) -> str:
    """The rounding of ``catalogue.rounded``."""
    shifted = f"({expr} + {SHIFT * 10**-digits!r})"
    return f"CASE WHEN abs({shifted}) < {0.5 * 10**-digits!r} THEN CAST(0 AS DOUBLE) ELSE round({shifted}, {digits}) END"


def dbl(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"{rnd(c, digits)} AS {c}" for c in columns)


def clock(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LABELS.items())
_CLASSES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_CLASSES.items())


def label_class(expr: str) -> str:
    return f"CASE lower({expr}) {_CLASSES} ELSE 'other' END"


RAW = f"""raw AS (
  SELECT event_id, (CASE WHEN user_id % 3 = 0 THEN 'm' ELSE 'f' END) || lpad(CAST(user_id AS VARCHAR), 6, '0') AS subject,
    ts AS timestamp, CASE WHEN value >= 5 THEN value % 60 + 50 END AS hr,
    CASE WHEN value <= 150 THEN value / 10 END AS eda_scl, value % 8 + 30 AS temp,
    (minute(ts) - 30) / CAST(30 AS DOUBLE) AS acc_x, (second(ts) - 30) / CAST(30 AS DOUBLE) AS acc_y, value % 1 AS acc_z,
    CASE event_type {_LABELS} END AS label, event_type, value
  FROM events)"""

SIG = RAW + """, sig AS (
  SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_mag FROM (
    SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp),
      row_number() OVER (PARTITION BY subject, date_trunc('hour', timestamp) ORDER BY event_id) AS pick
    FROM raw) WHERE pick = 1)"""

# All samples of an hour, where SIG has the first one only.
ALL = RAW + """, sig AS (
  SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp), sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_mag FROM raw)"""

CLASSED = ALL + f", sigc AS (SELECT * REPLACE ({label_class('label')} AS label) FROM sig)"


def grid(source: str, step: str, step_us: int, numeric: list[str], text: list[str], method: str, limit: int | None, key: str = "subject") -> str:
    """CTEs ``gb, gg, gd, gf, grid``: every grid point with its filled values."""
    windows, values = [], []
    for c in numeric:
        before = f"OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        after = f"OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        known = f"CASE WHEN {c} IS NOT NULL THEN p END"
        windows += [
            f"last_value({known} IGNORE NULLS) {before} AS {c}_p0", f"last_value({c} IGNORE NULLS) {before} AS {c}_v0",
            f"first_value({known} IGNORE NULLS) {after} AS {c}_p1", f"first_value({c} IGNORE NULLS) {after} AS {c}_v1",
        ]
        fill = {
            "forward": f"{c}_v0",
            "backward": f"{c}_v1",
            "linear": f"CASE WHEN {c}_p0 IS NULL THEN {c}_v1 WHEN {c}_p1 IS NULL THEN {c}_v0 "
                      f"ELSE ({c}_v1 - {c}_v0) / CAST({c}_p1 - {c}_p0 AS DOUBLE) * (p - {c}_p0) + {c}_v0 END",
        }[method]
        run = f"coalesce({c}_p1, n) - coalesce({c}_p0, -1) - 1"
        short = "TRUE" if limit is None else f"{run} <= {limit}"
        values.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {short} THEN {fill} END AS {c}")
    for c in text:
        windows.append(
            f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}_t"
        )
        values.append(f"{c}_t AS {c}")
    kept = "".join(f", s.{c}" for c in numeric + text)
    return f"""gb AS (SELECT {key}, min(timestamp) AS a,
        CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / {step_us}) AS BIGINT) + 1 AS n FROM {source} GROUP BY {key}),
      gg AS (SELECT {key}, a, n, unnest(range(n)) AS p FROM gb),
      gp AS (SELECT *, a + p * INTERVAL {step} AS timestamp FROM gg),
      gd AS (SELECT gp.*{kept} FROM gp LEFT JOIN {source} s ON {' AND '.join(f'gp.{k.strip()} = s.{k.strip()}' for k in key.split(','))} AND gp.timestamp = s.timestamp),
      gf AS (SELECT *, {', '.join(windows)} FROM gd),
      grid AS (SELECT {key}, timestamp, p AS pos, {', '.join(values)} FROM gf)"""


def windows(source: str, size: int, hop: int, pos: str | None = None) -> str:
    """CTEs ``wp, w, full_w``: rows of each full window ``k``."""
    position = f"{pos}" if pos else "row_number() OVER (PARTITION BY subject ORDER BY timestamp, event_id) - 1"
    return f"""wp AS (SELECT *, {position} AS spot FROM {source}),
      wk AS (SELECT *, unnest(range(greatest(CAST(0 AS BIGINT), CAST(floor((spot - {size}) / CAST({hop} AS DOUBLE)) AS BIGINT) + 1),
        CAST(floor(spot / CAST({hop} AS DOUBLE)) AS BIGINT) + 1)) AS k FROM wp),
      ids AS (SELECT subject, k, count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1,
        printf('%s_%06d_%06d', subject, k * {hop}, k * {hop} + {size}) AS window_id FROM wk GROUP BY subject, k HAVING count(*) = {size}),
      w AS (SELECT wk.*, ids.window_id FROM wk JOIN ids USING (subject, k))"""


def kept(size: int, ratio: float, columns: list[str]) -> str:
    """CTE ``kept``: windows that pass the validity threshold."""
    share = " + ".join(f"count({c})" for c in columns)
    return f"kept AS (SELECT window_id FROM w GROUP BY window_id HAVING ({share}) / CAST({size * len(columns)} AS DOUBLE) >= {ratio})"


LABEL = """lab AS (SELECT window_id, label FROM (SELECT window_id, label,
  row_number() OVER (PARTITION BY window_id ORDER BY count(*) DESC, label) AS r FROM w WHERE label IS NOT NULL GROUP BY window_id, label) WHERE r = 1)"""


def _adjacent(name: str, column: str) -> str:
    return f"""{name}_seq AS (SELECT window_id, spot, {column} AS v, lag({column}) OVER o AS before,
      row_number() OVER o - 1 AS i FROM w WHERE {column} IS NOT NULL WINDOW o AS (PARTITION BY window_id ORDER BY spot))"""


HRV = _adjacent("hr", "hr") + """,
  hrv AS (SELECT window_id, avg(v) AS hrv_hr_mean, stddev_samp(v) AS hrv_hr_std, min(v) AS hrv_hr_min, max(v) AS hrv_hr_max,
    max(v) - min(v) AS hrv_hr_range, sqrt(avg((60 / v - 60 / before) * (60 / v - 60 / before))) * 1000 AS hrv_rmssd,
    stddev_pop(60 / v) * 1000 AS hrv_sdnn,
    100 * count(*) FILTER (abs(60 / v - 60 / before) > 0.05) / CAST(count(before) AS DOUBLE) AS hrv_pnn50
    FROM hr_seq GROUP BY window_id HAVING count(*) >= 2)"""

EDA = _adjacent("eda", "eda_scl") + """,
  eda_stat AS (SELECT window_id, count(*) AS n, avg(v) AS eda_mean, stddev_samp(v) AS eda_std, min(v) AS eda_min, max(v) AS eda_max,
    max(v) - min(v) AS eda_range, regr_slope(v, i) AS eda_slope, sum((v + before) / 2) AS eda_auc
    FROM eda_seq GROUP BY window_id HAVING count(*) >= 2),
  eda_steps AS (SELECT window_id, i, v, lag(v) OVER o AS l, lead(v) OVER o AS r, lead(i) OVER o AS next_i
    FROM eda_seq WHERE before IS NULL OR before <> v WINDOW o AS (PARTITION BY window_id ORDER BY i)),
  eda_tops AS (SELECT s.window_id, (i + next_i - 1) // 2 AS top_at, v FROM eda_steps s JOIN eda_stat t USING (window_id)
    WHERE v > l AND v > r AND v >= eda_mean + 0.5 * eda_std)"""
EDA_PEAKS = """,
  eda_n AS (SELECT window_id, count(*) AS peaks FROM eda_tops GROUP BY window_id),
  eda AS (SELECT eda_stat.*, coalesce(peaks, 0) AS eda_peak_count, coalesce(peaks, 0) / CAST(n AS DOUBLE) * 60 AS eda_peak_rate
    FROM eda_stat LEFT JOIN eda_n USING (window_id))"""

TEMP = _adjacent("temp", "temp") + """,
  tmp AS (SELECT window_id, avg(v) AS temp_mean, stddev_samp(v) AS temp_std, min(v) AS temp_min, max(v) AS temp_max,
    max(v) - min(v) AS temp_range, regr_slope(v, i) AS temp_slope, arg_max(v, i) - arg_min(v, i) AS temp_delta
    FROM temp_seq GROUP BY window_id HAVING count(*) >= 2)"""

ACC_MAG = """acc_stat AS (SELECT window_id, avg(acc_mag) AS acc_mag_mean, stddev_samp(acc_mag) AS acc_mag_std,
    min(acc_mag) AS acc_mag_min, max(acc_mag) AS acc_mag_max FROM w GROUP BY window_id),
  acc AS (SELECT s.*, (SELECT count(*) FROM w WHERE w.window_id = s.window_id AND w.acc_mag > s.acc_mag_mean + s.acc_mag_std) AS acc_activity_count,
    CAST(NULL AS DOUBLE) AS acc_dominant_freq FROM acc_stat s)"""

# Periodic Hann, half overlap, mean removed; frequencies as multiples of 1 / (length * spacing).
SPECTRUM = """sp_n AS (SELECT window_id, count(*) AS n FROM hr_seq GROUP BY window_id HAVING count(*) >= 10),
  sp_dense AS (SELECT window_id, n, least(256, 2 * n) AS len, unnest(range(4 * n)) AS j FROM sp_n),
  sp_pos AS (SELECT *, j * (n - 1) / CAST(4 * n - 1 AS DOUBLE) AS x, least(CAST(floor(j * (n - 1) / CAST(4 * n - 1 AS DOUBLE)) AS BIGINT), n - 2) AS lo FROM sp_dense),
  sp_x AS (SELECT p.window_id, p.n, p.len, p.j, 60 / a.v + (60 / b.v - 60 / a.v) * (p.x - p.lo) AS y FROM sp_pos p
    JOIN hr_seq a ON a.window_id = p.window_id AND a.i = p.lo JOIN hr_seq b ON b.window_id = p.window_id AND b.i = p.lo + 1),
  sp_seg AS (SELECT *, unnest(range((4 * n - len) // (len - len // 2) + 1)) AS s FROM sp_x),
  sp_piece AS (SELECT window_id, len, s, j - s * (len - len // 2) AS t, y FROM sp_seg
    WHERE j >= s * (len - len // 2) AND j < s * (len - len // 2) + len),
  sp_taper AS (SELECT window_id, len, s, t, (y - avg(y) OVER (PARTITION BY window_id, s)) * (0.5 - 0.5 * cos(2 * pi() * t / len)) AS z,
    power(0.5 - 0.5 * cos(2 * pi() * t / len), 2) AS w2 FROM sp_piece),
  sp_bin AS (SELECT *, unnest(range(1, len // 2)) AS b FROM sp_taper),
  sp_dft AS (SELECT window_id, s, b, b * (1 / (len * CAST(0.25 AS DOUBLE))) AS f,
    2 * (power(sum(z * cos(2 * pi() * b * t / len)), 2) + power(sum(z * sin(2 * pi() * b * t / len)), 2)) / (4 * sum(w2)) AS pw
    FROM sp_bin WHERE b * (1 / (len * CAST(0.25 AS DOUBLE))) BETWEEN 0.03 AND 0.41 GROUP BY window_id, len, s, b),
  sp_psd AS (SELECT window_id, b, f, avg(pw) AS psd FROM sp_dft GROUP BY window_id, b, f),
  sp_band AS (SELECT window_id, 'lf' AS band, b, psd FROM sp_psd WHERE f >= 0.04 AND f <= 0.15
    UNION ALL SELECT window_id, 'hf', b, psd FROM sp_psd WHERE f >= 0.15 AND f <= 0.4),
  sp_area AS (SELECT window_id, band, (psd + lead(psd) OVER (PARTITION BY window_id, band ORDER BY b)) / 2 AS area FROM sp_band),
  spec AS (SELECT sp_n.window_id, coalesce(sum(area) FILTER (band = 'lf'), 0) AS hrv_lf_power, coalesce(sum(area) FILTER (band = 'hf'), 0) AS hrv_hf_power
    FROM sp_n LEFT JOIN sp_area USING (window_id) GROUP BY sp_n.window_id)"""
RATIO = "CASE WHEN hrv_hf_power > 1e-18 THEN hrv_lf_power / hrv_hf_power END AS hrv_lf_hf_ratio"

SIGNALS = ["hr", "eda_scl", "temp", "acc_mag"]
AXES = ["hr", "eda_scl", "temp", "acc_x", "acc_y", "acc_z"]


def short(*ctes: str, size: int = 20, hop: int = 10, ratio: float = 0.8, columns: list[str] = SIGNALS, source: str = ALL, name: str = "sig") -> str:
    parts = [source, windows(name, size, hop), kept(size, ratio, columns), *ctes]
    return "WITH " + ",\n  ".join(parts) + "\n"


_COUNTS = {"eda_peak_count", "acc_activity_count"}


def feature_select(extra_first: str = "") -> str:
    numbers = [c for c in FEATURE_TABLE_COLUMNS[6:]]
    picked = ", ".join(c if c in _COUNTS else f"{rnd(c)} AS {c}" for c in numbers if c != "hrv_lf_hf_ratio")
    return f"""SELECT window_id, n AS window_length, subject, label, {clock('t0')} AS timestamp_start, {clock('t1')} AS timestamp_end,
      {picked}, {rnd('hrv_lf_hf_ratio')} AS hrv_lf_hf_ratio
      FROM (SELECT ids.window_id, ids.n, ids.subject, coalesce(lab.label, 'unknown') AS label, t0, t1,
        hrv.* EXCLUDE (window_id), spec.* EXCLUDE (window_id), {RATIO}, eda.* EXCLUDE (window_id, n), tmp.* EXCLUDE (window_id), acc.* EXCLUDE (window_id)
        FROM ids JOIN kept USING (window_id) LEFT JOIN lab USING (window_id) LEFT JOIN hrv USING (window_id) LEFT JOIN spec USING (window_id)
        LEFT JOIN eda USING (window_id) LEFT JOIN tmp USING (window_id) LEFT JOIN acc USING (window_id))"""


ALL_GROUPS = [LABEL, HRV, SPECTRUM, EDA + EDA_PEAKS, TEMP, ACC_MAG]

DENSE = dict(size=20, hop=5, source=CLASSED, name="sigc")
LABELLED = """lw AS (SELECT ids.window_id, ids.subject, coalesce(lab.label, 'unknown') AS label
  FROM ids JOIN kept USING (window_id) LEFT JOIN lab USING (window_id))"""
PROFILE = """prof AS (SELECT subject, avg(CASE WHEN label = 'stress' THEN 1.0 ELSE 0.0 END) AS stress_ratio, count(*) AS n_windows FROM lw GROUP BY subject)"""
RANKED = """tot AS (SELECT count(*) AS n_all, count(*) FILTER (n_windows >= 10) AS n_valid FROM prof),
  sz AS (SELECT *, CASE WHEN n_valid >= 3 THEN CAST(ceil(CAST(0.2 AS DOUBLE) * n_valid) AS BIGINT) ELSE greatest(1, CAST(floor(CAST(0.2 AS DOUBLE) * n_all) AS BIGINT)) END AS n_test FROM tot),
  sv AS (SELECT *, CASE WHEN n_valid >= 3 THEN CAST(ceil(0.25 * (n_valid - n_test)) AS BIGINT)
    ELSE greatest(1, CAST(floor(CAST(0.2 AS DOUBLE) * (n_all - n_test)) AS BIGINT)) END AS n_val FROM sz),
  rk AS (SELECT prof.*, row_number() OVER (ORDER BY md5(subject || ':42'), subject) - 1 AS place, n_test, n_val FROM prof, sv WHERE n_valid < 3 OR n_windows >= 10),
  spl AS (SELECT subject, stress_ratio, n_windows, CASE WHEN place < n_test THEN 'test' WHEN place < n_test + n_val THEN 'val' ELSE 'train' END AS split FROM rk
    UNION ALL SELECT subject, stress_ratio, n_windows, 'excluded' FROM prof, sv WHERE n_valid >= 3 AND n_windows < 10)"""

SCORED = """docs AS (SELECT doc_id, source AS subject, CASE WHEN toxic = 1 THEN 'stress' WHEN quality = 1 THEN 'baseline' ELSE 'physical' END AS label,
  CASE WHEN n_chars < 400 THEN 'stress' WHEN n_chars < 4000 THEN 'baseline' ELSE 'physical' END AS predicted,
  CAST(1000 AS DOUBLE) / (n_chars + 1000) AS score FROM documents JOIN labels USING (doc_id))"""
CURVE = SCORED + """, pts AS (SELECT score, count(*) FILTER (label = 'stress') AS pos, count(*) FILTER (label <> 'stress') AS neg FROM docs GROUP BY score),
  cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM pts)"""


def per_class(group: str = "") -> str:
    g = f"{group}, " if group else ""
    gg = f"{group}, " if group else ""
    return f"""sides AS (SELECT {g}label AS class, 1 AS support, 0 AS called, CASE WHEN label = predicted THEN 1 ELSE 0 END AS tp FROM docs
    UNION ALL SELECT {g}predicted, 0, 1, 0 FROM docs),
  pc0 AS (SELECT {gg}class, sum(support) AS support, sum(called) AS called, sum(tp) AS tp FROM sides GROUP BY {gg}class),
  pc AS (SELECT *, sum(support) OVER ({'PARTITION BY ' + group if group else ''}) AS total,
    CASE WHEN called > 0 THEN tp / CAST(called AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS recall,
    CASE WHEN called + support > 0 THEN 2 * tp / CAST(called + support AS DOUBLE) ELSE 0 END AS f1 FROM pc0)"""


TWO = RAW + """, two AS (SELECT CASE WHEN starts_with(subject, 'f') THEN 'hongn' ELSE 'swell' END AS dataset, subject, timestamp, hr, eda_scl, temp, label FROM raw)"""
GAPS = """gaps AS (SELECT dataset, subject, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY dataset, subject ORDER BY timestamp))) / CAST(1000000 AS DOUBLE) AS gap FROM two),
  med AS (SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' WHEN grouping(subject) = 1 THEN 'dataset' ELSE 'subject' END AS level, dataset, subject, quantile_cont(gap, 0.5) AS median_interval
    FROM gaps WHERE gap IS NOT NULL GROUP BY GROUPING SETS ((), (dataset), (dataset, subject)))"""
RATE = "CASE WHEN median_interval > 0 THEN printf('%.1f Hz', 1 / median_interval) ELSE 'Unknown' END"
QUALITY = TWO + ", " + GAPS + f""", rep AS (SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' WHEN grouping(subject) = 1 THEN 'dataset' ELSE 'subject' END AS level,
    dataset, subject, count(*) AS total_rows, count(DISTINCT subject) AS total_subjects, min(timestamp) AS a, max(timestamp) AS b
    FROM two GROUP BY GROUPING SETS ((), (dataset), (dataset, subject))),
  full_rep AS (SELECT rep.level, rep.dataset, rep.subject, total_rows, total_subjects, {clock('a')} AS start, {clock('b')} AS "end",
    {rnd('(epoch_us(b) - epoch_us(a)) / CAST(3600000000 AS DOUBLE)')} AS duration_hours, {RATE} AS sampling_rate
    FROM rep LEFT JOIN med ON rep.level = med.level AND rep.dataset IS NOT DISTINCT FROM med.dataset AND rep.subject IS NOT DISTINCT FROM med.subject)"""


def _contract(mapping: dict[str, str]) -> str:
    numbers = ["hr", "rmssd", "sdnn", "eda_scl", "eda_peak_rate", "temp", "acc_mag"]
    cells = [f"{rnd(mapping[c])} AS {c}" if c in mapping else f"CAST(NULL AS DOUBLE) AS {c}" for c in numbers]
    subject = "subject" if "subject" in mapping else "CAST(NULL AS VARCHAR) AS subject"
    return f"WITH {RAW} SELECT {clock('timestamp')} AS timestamp, {subject}, {', '.join(cells)}, label FROM raw"


def _hourly(columns: list[str], text: list[str] = (), method: str = "linear", limit: int | None = 5) -> str:
    cells = [dbl(*columns)] if columns else []
    return (
        f"WITH {SIG}, {grid('sig', '1 HOUR', 3600000000, list(columns), list(text), method, limit)} "
        f"SELECT subject, {clock('timestamp')} AS timestamp, {', '.join([*cells, *text])} FROM grid"
    )


PREDICTED = RAW + """, pw AS (
  SELECT subject, timestamp AS s, timestamp + to_microseconds(CAST(round(value * 100) AS BIGINT) * 6000000) AS e, event_type,
    CASE WHEN event_type IN ('error', 'click') THEN 'stress' ELSE 'baseline' END AS predicted_label,
    CASE WHEN value % 1 < 0.4 THEN 'stress' ELSE 'baseline' END AS label FROM raw)"""
DAY = 86400000000


def islands(name: str, where: str) -> str:
    """Microseconds of each day under at least one piece: overlapping pieces are put together before they are measured."""
    return f"""{name} AS (SELECT subject, d, sum(t1 - f1) AS us FROM (SELECT subject, d, g, min(f) AS f1, max(t) AS t1 FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY subject, d ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CAST(f > coalesce(max(t) OVER (PARTITION BY subject, d ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS INTEGER) AS fresh
        FROM pc WHERE {where})) GROUP BY ALL) GROUP BY ALL)"""


DAILY = PREDICTED + f""", pc AS (SELECT subject, predicted_label, d, greatest(epoch_us(s), d * {DAY}) AS f, least(epoch_us(e), (d + 1) * {DAY}) AS t
    FROM (SELECT *, unnest(range(epoch_us(s) // {DAY}, (epoch_us(e) - 1) // {DAY} + 1)) AS d FROM pw WHERE s < e)),
  {islands("cov", "true")}, {islands("str", "predicted_label = 'stress'")},
  dn AS (SELECT subject, d, count(*) AS n_windows FROM pc GROUP BY ALL),
  daily AS (SELECT subject, DATE '1970-01-01' + CAST(d AS INTEGER) AS day, n_windows, CAST(cov.us AS BIGINT) AS covered_us, CAST(coalesce(str.us, 0) AS BIGINT) AS stress_us
    FROM dn JOIN cov USING (subject, d) LEFT JOIN str USING (subject, d))"""
NIGHTS = """ns AS (SELECT subject, CAST(timestamp - INTERVAL 8 HOUR AS DATE) AS night, avg(temp) AS mean, count(*) AS n_samples FROM raw
    WHERE temp IS NOT NULL AND (hour(timestamp) >= 20 OR hour(timestamp) < 8) GROUP BY ALL),
  na AS (SELECT x.subject, x.night, count(*) AS n_after, avg(y.mean) AS mean_after FROM ns x JOIN ns y
    ON x.subject = y.subject AND y.night - x.night BETWEEN 0 AND 2 GROUP BY ALL),
  nb AS (SELECT x.subject, x.night, count(*) AS n_before, avg(y.mean) AS mean_before FROM ns x JOIN ns y
    ON x.subject = y.subject AND x.night - y.night BETWEEN 1 AND 6 GROUP BY ALL),
  nr AS (SELECT *, CASE WHEN n_before >= 2 THEN mean_after - mean_before END AS rise FROM
    (SELECT ns.*, n_after, coalesce(n_before, 0) AS n_before, mean_after, mean_before FROM ns JOIN na USING (subject, night) LEFT JOIN nb USING (subject, night))),
  hits AS (SELECT *, lag(night) OVER (PARTITION BY subject ORDER BY night) AS earlier FROM nr WHERE rise >= 0.3),
  ep AS (SELECT subject, episode, min(night) AS start, max(night) AS last, count(*) AS hits, max(rise) AS peak FROM
    (SELECT *, sum(CAST(earlier IS NULL OR night - earlier > 3 AS INTEGER)) OVER (PARTITION BY subject ORDER BY night) AS episode FROM hits) GROUP BY subject, episode)"""
CYCLES = DAILY + ", " + NIGHTS + """, cy AS (SELECT *, abs(days - avg(days) OVER (PARTITION BY subject)) AS irregularity FROM
    (SELECT subject, episode AS cycle, start, stop, stop - start AS days FROM (SELECT *, lead(start) OVER (PARTITION BY subject ORDER BY episode) AS stop FROM ep) WHERE stop IS NOT NULL)),
  cl AS (SELECT cy.subject, cy.cycle, cy.start, cy.stop, cy.days, irregularity, CAST(sum(stress_us) AS BIGINT) AS stress_us, CAST(sum(covered_us) AS BIGINT) AS covered_us,
    sum(stress_us) / CAST(sum(covered_us) AS DOUBLE) AS load
    FROM cy LEFT JOIN daily ON cy.subject = daily.subject AND day >= start AND day < stop GROUP BY ALL),
  co AS (SELECT subject, count(*) AS n, var_pop(load) * count(*) AS xx, var_pop(irregularity) * count(*) AS yy, covar_pop(load, irregularity) * count(*) AS xy,
    CASE WHEN count(*) >= 3 AND var_pop(load) * count(*) > 1e-12 AND var_pop(irregularity) * count(*) > 1e-12 THEN corr(load, irregularity) END AS r
    FROM cl WHERE load IS NOT NULL GROUP BY subject)"""


def days(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


def spread(replicates: int, seed: int) -> str:
    """The bootstrap of subgroup gaps, metric by metric."""
    steps = ", ".join(f"CAST({s!r} AS DOUBLE)" for s in POISSON_STEPS)
    share = f"CAST('0x' || substr(md5(unit || '|{seed}|' || b), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
    values = {"accuracy": "right_n / n", "precision": "tp / nullif(said, 0)", "recall": "tp / nullif(positive, 0)", "f1": "2 * tp / nullif(said + positive, 0)"}
    metrics = " UNION ALL ".join(f"SELECT b, subgroup, '{m}' AS metric, {v} AS value FROM sm" for m, v in values.items())
    return f"""WITH {PREDICTED}, uc AS (SELECT event_type AS subgroup, subject AS unit, count(*) AS n, count(*) FILTER (label = predicted_label) AS right_n,
        count(*) FILTER (label = 'stress' AND predicted_label = 'stress') AS tp, count(*) FILTER (predicted_label = 'stress') AS said,
        count(*) FILTER (label = 'stress') AS positive FROM pw GROUP BY ALL),
      rp AS (SELECT *, CASE WHEN b = 0 THEN 1 ELSE len([x FOR x IN [{steps}] IF {share} >= x]) END AS w FROM (SELECT *, unnest(range({replicates + 1})) AS b FROM uc)),
      sm AS (SELECT b, subgroup, CAST(sum(n * w) AS DOUBLE) AS n, CAST(sum(right_n * w) AS DOUBLE) AS right_n, CAST(sum(tp * w) AS DOUBLE) AS tp,
        CAST(sum(said * w) AS DOUBLE) AS said, CAST(sum(positive * w) AS DOUBLE) AS positive FROM rp WHERE w > 0 GROUP BY ALL),
      mv AS ({metrics}),
      gp AS (SELECT metric, b, count(*) AS subgroups, min(value) AS lowest, max(value) AS highest, arg_min(subgroup, (value, subgroup)) AS lowest_in,
        arg_max(subgroup, (value, subgroup)) AS highest_in FROM mv WHERE value IS NOT NULL GROUP BY ALL),
      dr AS (SELECT metric, count(*) AS replicates, quantile_cont(highest - lowest, 0.025) AS gap_low, quantile_cont(highest - lowest, 0.975) AS gap_high FROM gp WHERE b > 0 GROUP BY metric)
      SELECT metric, subgroups, {dbl("lowest")}, lowest_in, {dbl("highest")}, highest_in, {rnd("highest - lowest")} AS gap, replicates, {dbl("gap_low", "gap_high")}
      FROM gp JOIN dr USING (metric) WHERE b = 0"""


def statements() -> dict[str, str]:
    hourly_all = grid("sig", "1 HOUR", 3600000000, SIGNALS, ["label"], "linear", 5)
    # The first sample of an hour starts the relative time as well: they share the hour.
    first_classed = SIG + f", sigc AS (SELECT * REPLACE ({label_class('label')} AS label) FROM sig)"
    source = """, src AS (SELECT CASE WHEN starts_with(subject, 'f') THEN 'hongn' ELSE 'swell' END AS dataset, subject, timestamp, hr, eda_scl,
      CASE WHEN starts_with(subject, 'f') THEN acc_mag END AS acc_mag, label,
      (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY subject))) / CAST(1000000 AS DOUBLE) AS timestamp_relative FROM sigc)"""
    off_grid = """mins AS (SELECT * FROM (SELECT event_id, subject, date_trunc('minute', timestamp) AS timestamp, hr,
        row_number() OVER (PARTITION BY subject, date_trunc('minute', timestamp) ORDER BY event_id) AS pick FROM raw) WHERE pick = 1)"""
    five = """five AS (SELECT subject, make_timestamp(CAST(epoch_us(timestamp) // 300000000 * 300000000 AS BIGINT)) AS timestamp, hr FROM raw),
      dup AS (SELECT DISTINCT subject FROM (SELECT subject, timestamp FROM five GROUP BY ALL HAVING count(*) > 1)),
      uniq AS (SELECT * FROM five WHERE subject NOT IN (SELECT subject FROM dup))"""
    mag_axes = short("acc_seq AS (SELECT window_id, spot, acc_mag AS v, row_number() OVER (PARTITION BY window_id ORDER BY spot) - 1 AS i FROM w WHERE acc_mag IS NOT NULL)",
                     columns=AXES)
    out = {
        "harmonize_source1": _contract({"subject": "subject", "hr": "hr", "eda_scl": "eda_scl", "temp": "temp", "acc_mag": "acc_z"}),
        "harmonize_source2": _contract({"subject": "subject", "hr": "hr", "rmssd": "eda_scl", "sdnn": "temp", "eda_scl": "acc_z"}),
        "harmonize_source3": _contract({"hr": "hr", "temp": "temp"}),
        "validate_issues": """SELECT unnest(['Missing required columns: [''subject'']', 'Column ''timestamp'' should be datetime, got string',
            'Column ''hr'' should be numeric, got string']) AS issue, count(*) AS rows FROM events""",
        "validate_null_columns": f"""WITH {RAW}, known AS (SELECT count(timestamp) AS timestamp, count(subject) AS subject, count(hr) AS hr, 0 AS rmssd, 0 AS sdnn,
            count(eda_scl) AS eda_scl, 0 AS eda_peak_rate, 0 AS temp, 0 AS acc_mag, 0 AS label FROM raw)
            SELECT name AS "column" FROM (UNPIVOT known ON COLUMNS(*)) WHERE value = 0""",
        "validate_order": f"""WITH {RAW}, o AS (SELECT subject, timestamp, lag(timestamp) OVER (PARTITION BY subject ORDER BY CAST(round(value * 100) AS BIGINT), event_id) AS before FROM raw)
            SELECT subject, count(*) AS late_rows FROM o WHERE timestamp < before GROUP BY subject""",
        "cohort_prefix": f"WITH {RAW} SELECT event_id, subject, {rnd('hr')} AS hr FROM raw WHERE subject LIKE 'f%'",
        "cohort_list": f"""WITH {RAW} SELECT event_id, subject, {rnd('hr')} AS hr FROM raw
            WHERE subject IN (SELECT subject FROM raw WHERE event_type = 'purchase')""",
        "label_map": f"WITH {RAW} SELECT event_id, {label_class('label')} AS label FROM raw",
        "label_distribution": f"WITH {RAW} SELECT {label_class('label')} AS label, count(*) AS count FROM raw GROUP BY 1",
        "parsed_timestamps": f"""WITH {RAW} SELECT subject, epoch_us(date_trunc('second', timestamp)) AS micros, {rnd('hr')} AS hr FROM raw""",
        "subjects_from_names": """SELECT doc_id, source || '_f' || doc_id AS stem, 'f' || doc_id AS subject FROM documents""",
        "relative_time": f"""WITH {RAW}, r AS (SELECT event_id, subject,
            (epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY subject))) / CAST(1000000 AS DOUBLE) AS timestamp_relative FROM raw)
            SELECT event_id, subject, {dbl('timestamp_relative')} FROM r""",
        "merge_sources": f"""WITH {first_classed + source}, {grid('src', '1 HOUR', 3600000000, ['hr', 'eda_scl', 'acc_mag', 'timestamp_relative'], ['label'], 'linear', 5, key='dataset, subject')}
            SELECT dataset, subject, {clock('timestamp')} AS timestamp, {dbl('hr', 'eda_scl', 'acc_mag')}, label, {dbl('timestamp_relative')} FROM grid""",
        "merge_without_resampling": f"""WITH {CLASSED + source} SELECT dataset, subject, {clock('timestamp')} AS timestamp, {dbl('hr', 'acc_mag')}, label, {dbl('timestamp_relative')} FROM src""",
        "tumbling_mean": f"""WITH {RAW}, t AS (SELECT subject, date_trunc('hour', timestamp) AS h, avg(hr) AS hr, avg(temp) AS temp FROM raw GROUP BY ALL)
            SELECT subject, {clock('h')} AS timestamp, {dbl('hr', 'temp')} FROM t""",
        "pair_modalities": f"""WITH {RAW}, h AS (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM raw),
            l AS (SELECT subject, timestamp, hr, temp FROM h WHERE event_type = 'click'),
            r AS (SELECT subject, timestamp, hr AS hr_eda, eda_scl FROM h WHERE event_type = 'signup'),
            u AS (SELECT l.*, hr_eda, eda_scl FROM l JOIN r USING (subject, timestamp) WHERE hr IS NOT NULL AND temp IS NOT NULL AND hr_eda IS NOT NULL AND eda_scl IS NOT NULL
              UNION ALL SELECT l.*, NULL, NULL FROM l WHERE subject NOT IN (SELECT subject FROM r) AND hr IS NOT NULL AND temp IS NOT NULL)
            SELECT subject, {clock('timestamp')} AS timestamp, {dbl('hr', 'temp', 'hr_eda', 'eda_scl')} FROM u""",
        "drop_incomplete": f"""WITH {RAW} SELECT event_id, CASE WHEN hr IS NULL OR eda_scl IS NULL OR temp IS NULL THEN 'dropped' ELSE 'kept' END AS fate FROM raw""",
        "wrist_extraction": f"""WITH {RAW}, s AS (SELECT *, date_trunc('second', timestamp) AS sec FROM raw),
            h AS (SELECT subject, sec, avg(hr) AS hr FROM s GROUP BY ALL),
            j AS (SELECT h.subject, h.sec, h.hr, a.temp, b.label FROM h JOIN s a ON a.subject = h.subject AND a.sec = h.sec JOIN s b ON b.subject = h.subject AND b.sec = h.sec)
            SELECT subject, {clock('sec')} AS timestamp, {dbl('hr', 'temp')}, label FROM j WHERE hr IS NOT NULL AND temp IS NOT NULL AND label IS NOT NULL""",
        "grid_linear": _hourly(["hr", "eda_scl", "temp"]),
        "grid_forward": _hourly(["hr", "eda_scl", "temp"], method="forward"),
        "grid_backward": _hourly(["hr", "eda_scl", "temp"], method="backward"),
        "grid_unlimited": _hourly(["hr", "eda_scl"], limit=None),
        "grid_text_fill": _hourly([], ["label"]),
        "grid_bucket_mean": f"""WITH {RAW}, mean AS (SELECT subject, date_trunc('hour', timestamp) AS timestamp, avg(hr) AS hr, avg(temp) AS temp FROM raw GROUP BY ALL),
            {grid('mean', '1 HOUR', 3600000000, ['hr', 'temp'], [], 'linear', 5)} SELECT subject, {clock('timestamp')} AS timestamp, {dbl('hr', 'temp')} FROM grid""",
        "grid_off_grid_samples": f"""WITH {RAW}, {off_grid}, {grid('mins', '20 MINUTE', 1200000000, ['hr'], [], 'linear', 9)}
            SELECT subject, {clock('timestamp')} AS timestamp, {dbl('hr')} FROM grid""",
        "grid_rejects": f"""WITH {RAW}, h AS (SELECT subject, date_trunc('hour', timestamp) AS t, count(*) AS n FROM raw GROUP BY ALL)
            SELECT subject, count(*) AS duplicate_instants, 'duplicate timestamp' AS reason FROM h WHERE n > 1 GROUP BY subject""",
        "grid_reject_subject": f"""WITH {RAW}, {five}, {grid('uniq', '5 MINUTE', 300000000, ['hr'], [], 'linear', 24)},
            s AS (SELECT subject, count(*) AS grid_points, count(hr) AS known, avg(hr) AS hr_mean FROM grid GROUP BY subject)
            SELECT subject, grid_points, known, {dbl('hr_mean')} FROM s""",
        "hop_windows": short(LABEL) + f"""SELECT ids.window_id, n AS window_length, subject, coalesce(label, 'unknown') AS label, {clock('t0')} AS timestamp_start, {clock('t1')} AS timestamp_end
            FROM ids JOIN kept USING (window_id) LEFT JOIN lab USING (window_id)""",
        "valid_windows": short(ratio=0.95, columns=["hr", "eda_scl"]) + "SELECT window_id, subject FROM ids JOIN kept USING (window_id)",
        "hrv_time": short(HRV) + f"SELECT window_id, {dbl(*HRV_COLUMNS[:8])} FROM kept LEFT JOIN hrv USING (window_id)",
        "hrv_spectral": short(HRV, SPECTRUM, size=40, hop=20)
        + f"SELECT window_id, {dbl('hrv_lf_power', 'hrv_hf_power', 'hrv_lf_hf_ratio')} FROM (SELECT kept.window_id, hrv_lf_power, hrv_hf_power, {RATIO} FROM kept LEFT JOIN spec USING (window_id))",
        "eda_basic": short(EDA) + f"SELECT window_id, {dbl(*EDA_COLUMNS[:5])} FROM kept LEFT JOIN eda_stat USING (window_id)",
        "eda_slope_auc": short(EDA) + f"SELECT window_id, {dbl('eda_slope', 'eda_auc')} FROM kept LEFT JOIN eda_stat USING (window_id)",
        "eda_peaks": short(EDA + EDA_PEAKS) + f"SELECT window_id, eda_peak_count, {dbl('eda_peak_rate')} FROM kept LEFT JOIN eda USING (window_id)",
        # Peaks in the order of their heights, the later first on ties; one by one those far enough from the ones that stay.
        "eda_peaks_spaced": short(EDA, size=40, hop=20).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
            po AS (SELECT window_id, list(top_at ORDER BY v DESC, top_at DESC) AS tops FROM eda_tops GROUP BY window_id),
            pg AS (SELECT window_id, tops, 1 AS i, [tops[1]] AS stay FROM po
              UNION ALL SELECT window_id, tops, i + 1, CASE WHEN len([s FOR s IN stay IF abs(s - tops[i + 1]) < 4]) = 0 THEN list_append(stay, tops[i + 1]) ELSE stay END
              FROM pg WHERE i < len(tops)),
            pn AS (SELECT window_id, len(stay) AS peaks FROM pg WHERE i = len(tops)),
            e AS (SELECT window_id, CASE WHEN n IS NOT NULL THEN coalesce(peaks, 0) END AS eda_peak_count,
              coalesce(peaks, 0) / (n / CAST(4 AS DOUBLE)) * 60 AS eda_peak_rate, eda_auc FROM kept LEFT JOIN eda_stat USING (window_id) LEFT JOIN pn USING (window_id))
            SELECT window_id, eda_peak_count, {dbl('eda_peak_rate', 'eda_auc')} FROM e""",
        "temp_features": short(TEMP) + f"SELECT window_id, {dbl(*TEMP_COLUMNS)} FROM kept LEFT JOIN tmp USING (window_id)",
        "acc_magnitude_features": short(ACC_MAG)
        + f"SELECT window_id, {dbl('acc_mag_mean', 'acc_mag_std', 'acc_mag_min', 'acc_mag_max')}, acc_activity_count, acc_dominant_freq FROM kept LEFT JOIN acc USING (window_id)",
        "acc_axes_features": short(ACC_MAG, columns=AXES)
        + f"SELECT window_id, {dbl('acc_mag_mean', 'acc_mag_std', 'acc_mag_min', 'acc_mag_max')}, acc_activity_count FROM kept LEFT JOIN acc USING (window_id)",
        "acc_dominant_freq": mag_axes.rstrip() + f""",
            an AS (SELECT window_id, count(*) AS n, count(*) // 2 AS len FROM acc_seq GROUP BY window_id),
            ase AS (SELECT a.window_id, a.i, a.v, n, len, unnest(range((n - len) // (len - len // 2) + 1)) AS s FROM acc_seq a JOIN an USING (window_id)),
            ap AS (SELECT window_id, len, s, i - s * (len - len // 2) AS t, v FROM ase WHERE i >= s * (len - len // 2) AND i < s * (len - len // 2) + len),
            az AS (SELECT window_id, len, s, t, (v - avg(v) OVER (PARTITION BY window_id, s)) * (0.5 - 0.5 * cos(2 * pi() * t / len)) AS z FROM ap),
            ab AS (SELECT *, unnest(range(0, len // 2 + 1)) AS b FROM az),
            ad AS (SELECT window_id, len, s, b, (CASE WHEN b = 0 OR 2 * b = len THEN 1 ELSE 2 END) * (power(sum(z * cos(2 * pi() * b * t / len)), 2) + power(sum(z * sin(2 * pi() * b * t / len)), 2)) AS pw FROM ab GROUP BY window_id, len, s, b),
            af AS (SELECT window_id, len, b, avg(pw) AS pw FROM ad GROUP BY window_id, len, b),
            best AS (SELECT window_id, b / CAST(len AS DOUBLE) AS acc_dominant_freq, row_number() OVER (PARTITION BY window_id ORDER BY pw DESC, b) AS r FROM af)
            SELECT window_id, {dbl('acc_dominant_freq')} FROM kept JOIN best USING (window_id) WHERE r = 1""",
        "window_features": short(*ALL_GROUPS) + feature_select(),
        "aligned_window_features": "WITH " + ",\n  ".join([SIG, hourly_all, windows("grid", 48, 24, pos="pos"), kept(48, 0.25, SIGNALS), *ALL_GROUPS]) + "\n" + feature_select(),
        # A stream's windows are final once its watermark and the series' own samples are five hours behind them.
        "stream_features": "WITH " + ",\n  ".join([SIG, hourly_all, windows("grid", 48, 24, pos="pos"), kept(48, 0.25, SIGNALS), *ALL_GROUPS]) + f"""
            SELECT * FROM ({feature_select()}) WHERE window_id IN (SELECT window_id FROM ids JOIN gb USING (subject)
              WHERE k * 24 + 47 + 5 <= least(gb.n - 1, (epoch_us((SELECT max(timestamp) FROM sig)) - 3600000000 - 1 - epoch_us(a)) // 3600000000))""",
        "stream_moments": f"""WITH {RAW}, wm AS (SELECT epoch_ms(max(timestamp)) * 1000 - 3600000000 AS at FROM raw),
            sw AS (SELECT *, unnest(range((epoch_us(timestamp) - {5 * DAY}) // {2 * DAY} + 1, epoch_us(timestamp) // {2 * DAY} + 1)) AS k FROM raw),
            sg AS (SELECT subject, k, count(*) AS window_length, CASE WHEN count(hr) >= 2 THEN avg(hr) END AS hrv_hr_mean, CASE WHEN count(hr) >= 2 THEN stddev_samp(hr) END AS hrv_hr_std,
              CASE WHEN count(eda_scl) >= 2 THEN max(eda_scl) END AS eda_max, CASE WHEN count(temp) >= 2 THEN max(temp) - min(temp) END AS temp_range FROM sw GROUP BY subject, k)
            SELECT subject, {clock(f"make_timestamp(k * {2 * DAY})")} AS window_start, window_length, {dbl("hrv_hr_mean", "hrv_hr_std", "eda_max", "temp_range")}
            FROM sg, wm WHERE k * {2 * DAY} + {5 * DAY} <= wm.at""",
        "stress_load_daily": f"""WITH {DAILY} SELECT subject, {days("day")}, n_windows, covered_us, stress_us, {rnd("stress_us / CAST(covered_us AS DOUBLE)")} AS load FROM daily""",
        "stress_load_weekly": f"""WITH {DAILY} SELECT subject, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS days, CAST(sum(n_windows) AS BIGINT) AS n_windows,
            CAST(sum(covered_us) AS BIGINT) AS covered_us, CAST(sum(stress_us) AS BIGINT) AS stress_us, {rnd("sum(stress_us) / CAST(sum(covered_us) AS DOUBLE)")} AS load FROM daily GROUP BY 1, 2""",
        "temperature_nights": f"""WITH {RAW}, {NIGHTS} SELECT subject, {days("night")}, {dbl("mean")}, n_samples, n_after, n_before, {dbl("mean_after", "mean_before", "rise")},
            CAST(coalesce(rise >= 0.3, false) AS BIGINT) AS hit FROM nr""",
        "temperature_rises": f"""WITH {RAW}, {NIGHTS} SELECT subject, CAST(episode AS BIGINT) AS episode, {days("start", "last")}, hits, {dbl("peak")} FROM ep""",
        "cycle_stress": f"""WITH {CYCLES} SELECT subject, CAST(cycle AS BIGINT) AS cycle, {days("start", "stop")}, days, {dbl("irregularity")}, stress_us, covered_us, {dbl("load")} FROM cl""",
        "cycle_correlation": f"WITH {CYCLES} SELECT subject, n, {dbl('r')} FROM co",
        "cycle_correlation_pooled": f"""WITH {CYCLES}, us AS (SELECT *, atanh(greatest(least(r, 1 - 1e-9), 1e-9 - 1)) AS z FROM co WHERE r IS NOT NULL AND n > 3),
            pl AS (SELECT count(*) AS subjects, CAST(sum(n) AS BIGINT) AS pairs, sum((n - 3) * z) / sum(n - 3) AS z, 1.959963984540054 / sqrt(sum(n - 3)) AS h, sum(xy) / sqrt(sum(xx) * sum(yy)) AS w FROM us)
            SELECT subjects, pairs, {rnd("tanh(z)")} AS r, {rnd("tanh(z - h)")} AS r_low, {rnd("tanh(z + h)")} AS r_high, {rnd("w")} AS r_within FROM pl""",
        "subgroup_spread": spread(50, 7),
        "quality_overall": f'WITH {QUALITY} SELECT total_rows, total_subjects, start, "end", duration_hours, sampling_rate FROM full_rep WHERE level = \'overall\'',
        "quality_by_group": f"WITH {QUALITY} SELECT * FROM full_rep",
        "quality_from_states": f"""WITH {TWO} SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' WHEN grouping(subject) = 1 THEN 'dataset' ELSE 'subject' END AS level, dataset, subject,
            count(*) AS total_rows, CASE WHEN count(*) > 1 THEN {clock('min(timestamp)')} END AS start, CASE WHEN count(*) > 1 THEN {clock('max(timestamp)')} END AS "end",
            CASE WHEN count(*) > 1 THEN {rnd('(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / CAST(3600000000 AS DOUBLE)')} END AS duration_hours,
            CAST(4 * count(*) - count(hr) - count(eda_scl) - count(temp) - count(label) AS BIGINT) AS missing
            FROM two GROUP BY GROUPING SETS ((), (dataset), (dataset, subject))""",
        "missing_by_column": f"""WITH {TWO}, miss AS (SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' WHEN grouping(subject) = 1 THEN 'dataset' ELSE 'subject' END AS level, dataset, subject, count(*) AS n,
              0 AS m1, 0 AS m2, count(*) - count(timestamp) AS m3, count(*) - count(hr) AS m4, count(*) - count(eda_scl) AS m5, count(*) - count(temp) AS m6, count(*) - count(label) AS m7
              FROM two GROUP BY GROUPING SETS ((), (dataset), (dataset, subject))),
            lng AS (SELECT level, dataset, subject, n, unnest(['dataset', 'subject', 'timestamp', 'hr', 'eda_scl', 'temp', 'label']) AS "column", unnest([m1, m2, m3, m4, m5, m6, m7]) AS missing_count FROM miss)
            SELECT level, dataset, subject, "column", CAST(missing_count AS BIGINT) AS missing_count, {rnd('missing_count / CAST(n AS DOUBLE) * 100')} AS missing_pct FROM lng""",
        "sampling_rate": f"WITH {TWO}, {GAPS} SELECT level, dataset, subject, {rnd('median_interval')} AS median_interval, {RATE} AS sampling_rate FROM med",
        "dataset_counts": f"WITH {TWO} SELECT dataset, count(*) AS count, count(DISTINCT subject) AS subjects FROM two GROUP BY dataset",
        "distinct_subjects": f"WITH {TWO} SELECT DISTINCT subject FROM two",
        "unusable_rows": f"WITH {TWO} SELECT count(*) - count(dataset) AS null_dataset, count(*) - count(subject) AS null_subject, count(*) - count(hr) AS null_timestamp FROM two",
        "subject_profile": short(LABEL, LABELLED, PROFILE, **DENSE) + f"SELECT subject, {dbl('stress_ratio')}, n_windows FROM prof",
        "cohort_compare": short(LABEL, LABELLED, HRV, EDA, TEMP, **DENSE) + f""", cc AS (SELECT label, unnest(['hrv_hr_mean', 'hrv_rmssd', 'eda_mean', 'temp_mean']) AS feature,
              unnest([hrv_hr_mean, hrv_rmssd, eda_mean, temp_mean]) AS v FROM lw LEFT JOIN hrv USING (window_id) LEFT JOIN eda_stat USING (window_id) LEFT JOIN tmp USING (window_id))
            SELECT feature, {rnd("avg(v) FILTER (label = 'stress')")} AS stress, {rnd("avg(v) FILTER (label = 'baseline')")} AS baseline FROM cc GROUP BY feature""",
        "window_metadata": short(LABEL, LABELLED, **DENSE) + """, lc AS (SELECT label, count(*) AS c FROM lw GROUP BY label)
            SELECT CAST(34 AS BIGINT) AS feature_count, (SELECT count(*) FROM lw) AS total_windows, (SELECT count(DISTINCT subject) FROM lw) AS subject_count,
              (SELECT string_agg(label || '=' || c, ',' ORDER BY label) FROM lc) AS labels""",
        "split_subjects": short(LABEL, LABELLED, PROFILE, RANKED, **DENSE) + f"SELECT subject, {dbl('stress_ratio')}, n_windows, split FROM spl",
        "split_windows": short(LABEL, LABELLED, PROFILE, RANKED, **DENSE) + "SELECT window_id, split FROM lw JOIN spl USING (subject)",
        "split_fallback": short(LABEL, LABELLED, PROFILE, RANKED, size=40, hop=20) + "SELECT subject, n_windows, split FROM spl",
        "split_table": f"""WITH {RAW}, s AS (SELECT DISTINCT subject FROM raw), r AS (SELECT subject, row_number() OVER (ORDER BY md5(subject || ':42'), subject) - 1 AS place, count(*) OVER () AS n FROM s)
            SELECT subject, CASE WHEN place < greatest(1, n // 5) THEN 'test' ELSE 'train' END AS split FROM r""",
        "rf_checks": short(LABEL, LABELLED, PROFILE, RANKED, **DENSE) + """SELECT window_id, subject, label, CAST(1 AS DOUBLE) AS total, CAST(1 AS BIGINT) AS likeliest
            FROM lw JOIN spl USING (subject) WHERE split = 'test'""",
        "importance_checks": "SELECT CAST(34 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total",
        "kfold": short(LABEL, LABELLED, **DENSE) + """SELECT window_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(window_id || ':42'), window_id) - 1) % 5 AS fold FROM lw""",
        "kfold_by_subject": f"""WITH {RAW}, s AS (SELECT subject, count(*) AS rows FROM raw GROUP BY subject)
            SELECT subject, (row_number() OVER (ORDER BY md5(subject || ':42'), subject) - 1) % 5 AS fold, rows FROM s""",
        "column_medians": f"""WITH {RAW} SELECT unnest(['hr', 'eda_scl', 'temp', 'value']) AS feature,
            unnest([{', '.join(rnd(f'median({c})') for c in ('hr', 'eda_scl', 'temp', 'value'))}]) AS median FROM raw""",
        "impute_median": f"""WITH {RAW}, m AS (SELECT median(hr) AS mh, median(eda_scl) AS me FROM raw)
            SELECT event_id, {rnd('coalesce(hr, mh)')} AS hr, {rnd('coalesce(eda_scl, me)')} AS eda_scl FROM raw, m""",
        "scale_standard": f"""WITH {RAW}, z AS (SELECT event_id, (temp - avg(temp) OVER ()) / stddev_pop(temp) OVER () AS temp, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value FROM raw)
            SELECT event_id, {dbl('temp', 'value')} FROM z""",
        "class_weights": f"""WITH {RAW}, c AS (SELECT {label_class('label')} AS label, count(*) AS n FROM raw GROUP BY 1)
            SELECT label, n, {rnd('(SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE)')} AS weight FROM c""",
        "confusion": f"""WITH {SCORED}, c AS (SELECT label AS c FROM docs UNION SELECT predicted FROM docs)
            SELECT a.c AS label, b.c AS predicted, (SELECT count(*) FROM docs WHERE docs.label = a.c AND docs.predicted = b.c) AS n FROM c a, c b""",
        "class_report": f"""WITH {SCORED}, {per_class()}, rep AS (SELECT class AS name, precision, recall, f1, support FROM pc
            UNION ALL SELECT 'accuracy', sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(tp) / CAST(sum(support) AS DOUBLE), sum(support) FROM pc
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pc
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pc)
            SELECT name, {dbl('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM rep""",
        "class_metrics": f"""WITH {SCORED}, k AS (SELECT label AS class FROM docs UNION SELECT predicted FROM docs),
            m AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (label = class AND predicted = class) AS tp,
              count(*) FILTER (label <> class) AS neg, count(*) FILTER (label <> class AND predicted <> class) AS tn FROM k, docs GROUP BY class)
            SELECT class, {rnd('CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END')} AS recall,
              {rnd('CASE WHEN neg > 0 THEN tn / CAST(neg AS DOUBLE) ELSE 0 END')} AS specificity, support FROM m""",
        "roc_auc": f"""WITH {SCORED}, p AS (SELECT score FROM docs WHERE label = 'stress'), q AS (SELECT score FROM docs WHERE label <> 'stress'),
            a AS (SELECT avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS roc_auc FROM p, q) SELECT {dbl('roc_auc')} FROM a""",
        "average_precision": f"""WITH {CURVE}, a AS (SELECT sum(pos / CAST(np AS DOUBLE) * tp / (tp + fp)) AS average_precision FROM cum) SELECT {dbl('average_precision')} FROM a""",
        "roc_curve_all_points": f"""WITH {CURVE}, c AS (SELECT score AS threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr FROM cum UNION ALL SELECT NULL, 0, 0)
            SELECT {dbl('threshold', 'fpr', 'tpr')} FROM c""",
        "roc_curve": f"""WITH {CURVE}, n AS (SELECT *, lead(pos) OVER o AS pos1, lead(neg) OVER o AS neg1, row_number() OVER o AS r, count(*) OVER () AS total FROM cum WINDOW o AS (ORDER BY score DESC)),
            c AS (SELECT score AS threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr FROM n WHERE r = 1 OR r = total OR pos1 <> pos OR neg1 <> neg UNION ALL SELECT NULL, 0, 0)
            SELECT {dbl('threshold', 'fpr', 'tpr')} FROM c""",
        "pr_curve": f"""WITH {CURVE}, c AS (SELECT score AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(np AS DOUBLE) AS recall FROM cum UNION ALL SELECT NULL, 1, 0)
            SELECT {dbl('threshold', 'precision', 'recall')} FROM c""",
        "per_subject_report": f"""WITH {SCORED}, {per_class('subject')}, r AS (SELECT subject, max(total) AS n_samples, sum(tp) / CAST(max(total) AS DOUBLE) AS accuracy,
            sum(f1 * support) / max(total) AS f1_weighted FROM pc GROUP BY subject HAVING count(*) FILTER (support > 0) > 1)
            SELECT subject, CAST(n_samples AS BIGINT) AS n_samples, {dbl('accuracy', 'f1_weighted')} FROM r""",
    }
    return out
