"""SQL for the queries of queries.py, as DuckDB runs it on the same tables."""

from __future__ import annotations

TYPES = ["view", "click", "purchase", "signup", "error"]
_Q = '"{}"'.format

DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) AS date, " + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {_Q(t)}" for t in TYPES) + " FROM events GROUP BY 1, 2)"
RAW = """raw AS (SELECT *, 'sit' AS record_type, 'full' AS segment_label, CASE WHEN day(date) % 5 <> 0 THEN user_id % 4 <> 0 END AS hrv_validated, user_id % 3 <> 0 AS morphology_validated FROM (
  SELECT user_id, CAST(ts AS DATE) AS date, event_type AS phase, avg(value) AS hrv_mean, max(value) AS hrv_max, CAST(count(*) AS DOUBLE) AS morph_n FROM events GROUP BY 1, 2, 3))"""
BEATS = """beats AS (SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS rr FROM (SELECT user_id, event_id, epoch_us(ts) / 3.6e9 AS t FROM events)),
diffs AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM (SELECT *, rr * 1000 AS ms FROM beats WHERE rr IS NOT NULL))"""
WAVES = "waves AS (SELECT label, vec_id, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS x FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def iso(x: str = "date") -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def settle(faults: list[tuple[str, str]], value: str) -> tuple[str, str]:
    """(value, reason) for conditions that are checked in order."""
    reason = "CASE " + " ".join(f"WHEN {c} THEN {why}" for why, c in faults) + " ELSE '' END"
    return f"CASE WHEN {reason} = '' THEN {value} END", reason


def formula(name: str, a: str, b: str, before: list[tuple[str, str]] | None = None, center: str = "", spread: str = "") -> tuple[str, str]:
    missing = ("'missing_value'", f"{a} IS NULL OR {b} IS NULL")
    own, value = {
        "delta": ([missing], f"{a} - {b}"),
        "percent_delta": ([missing, ("'percent_delta_division_by_zero'", f"{b} = 0")], f"({a} - {b}) * 100.0 / nullif(abs({b}), 0)"),
        "ratio": ([missing, ("'ratio_division_by_zero'", f"{b} = 0")], f"{a} / nullif({b}, 0)"),
        "log_ratio": ([missing, ("'log_ratio_requires_positive_values'", f"{a} <= 0 OR {b} <= 0")], f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"),
        "robust_z": ([("'missing_value'", f"{a} IS NULL OR {b} IS NULL OR {spread or b} IS NULL"), ("'robust_z_zero_scale'", f"{spread or b} = 0")], f"({a} - {b}) / nullif({spread or b}, 0)"),
    }[name]
    return settle([*(before or []), *own], value)


def rows(source: str, results: dict[str, tuple[str, str]], kind: str, left: str, right: str, lv: str = "lv", rv: str = "rv", feature: str = "feature", base: str = "NULL", where: str = "TRUE", date: str = "strftime(date, '%Y-%m-%d')") -> str:
    """Canonical rows, one per row of the source and formula."""
    one = []
    for name, (value, reason) in results.items():
        one.append(
            f"SELECT user_id, {date} AS date, 'op' AS operation_id, '{kind}' AS operation_type, {feature} AS feature, '{name}' AS formula, CAST({base} AS VARCHAR) AS base_formula, {left} AS left_source, {right} AS right_source, "
            f"{r(lv)} AS left_value, {r(rv)} AS right_value, {r(value)} AS value, ({reason}) = '' AS valid, {reason} AS reason FROM {source} WHERE {where}"
        )
    return " UNION ALL ".join(one)


def absent(source: str, feature: str, formulas: list[str], kind: str, left: str, right: str) -> str:
    one = f"SELECT user_id, {iso()} AS date, 'op' AS operation_id, '{kind}' AS operation_type, '{feature}' AS feature, '{{}}' AS formula, NULL AS base_formula, '{left}' AS left_source, '{right}' AS right_source, CAST(NULL AS DOUBLE) AS left_value, CAST(NULL AS DOUBLE) AS right_value, CAST(NULL AS DOUBLE) AS value, FALSE AS valid, 'feature_missing' AS reason FROM {source}"
    return " UNION ALL ".join(one.format(f) for f in formulas)


def melt(source: str, features: list[str], more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT user_id, date, '{f}' AS feature, CAST({_Q(f)} AS DOUBLE) AS v{more} FROM {source}" for f in features)


def _computed(value: str) -> str:
    return f"WITH {DAILY} SELECT user_id, {iso()} AS date, {r(value)} AS value FROM daily"


_COMPOSITE = '(coalesce("view", 0) + coalesce(click * 0.5, 0) + coalesce(10 - error, 0)) / nullif(CAST("view" IS NOT NULL AS INT) + CAST(click IS NOT NULL AS INT) + CAST(error IS NOT NULL AS INT), 0)'


def _false(flag: str, side: str) -> str:
    return f"{side}.{flag} IS NOT NULL AND NOT {side}.{flag}"


def _pairwise(formulas: list[str], left: str = "view", right: str = "click", flags: bool = False, policy: str = "valid_only") -> str:
    parts = []
    for f, flag in (("hrv_mean", "hrv_validated"), ("hrv_max", "hrv_validated"), ("morph_n", "morphology_validated"), ("hrv_none", None)):
        q = f"concat_ws(';', CASE WHEN {_false(flag, 'l')} THEN '{flag}=false' END, CASE WHEN {_false(flag, 'r')} THEN '{flag}=false' END)" if flag and flags else "''"
        lv, rv = (f"l.{f}", f"r.{f}") if flag else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        parts.append(f"SELECT s.user_id, s.date, '{f}' AS feature, {lv} AS lv, {rv} AS rv, l.user_id IS NULL AS nl, r.user_id IS NULL AS nr, {flag is None} AS lost, {q} AS q FROM spine s LEFT JOIN l USING (user_id, date) LEFT JOIN r USING (user_id, date)")
    ctes = f"WITH {RAW}, spine AS (SELECT DISTINCT user_id, date FROM raw), l AS (SELECT * FROM raw WHERE phase = '{left}'), r AS (SELECT * FROM raw WHERE phase = '{right}'), cells AS ({' UNION ALL '.join(parts)})"
    gaps = [("'missing_left_and_right'", "nl AND nr"), ("'missing_left'", "nl"), ("'missing_right'", "nr"), ("'feature_missing'", "lost")]
    results = {}
    for name in formulas:
        if policy == "valid_only":
            results[name] = formula(name, "lv", "rv", [*gaps, ("q", "q <> ''")])
        else:
            value, reason = formula(name, "lv", "rv", gaps)
            results[name] = value, f"CASE WHEN {reason} <> '' THEN {reason} ELSE q END"
    return ctes + " " + rows("cells", results, "pairwise", f"'{left}'", f"'{right}'")


def _pairwise_derived() -> str:
    a, b = (_pairwise(["delta"], left, "click") for left in ("purchase", "view"))
    results = {f: formula(f, "lv", "rv", [("'invalid_left_or_right_derived'", "NOT (lok AND rok)")]) for f in ("delta", "percent_delta")}
    raw_value = lambda s: s.replace("round(", "(").replace(", 6) + 0.0", ")")  # noqa: E731  the operations are not rounded in between
    joined = f"sides AS (SELECT a.user_id, a.date, a.feature, a.value AS lv, b.value AS rv, a.valid AS lok, b.valid AS rok FROM ({raw_value(b)}) a JOIN ({raw_value(a)}) b USING (user_id, date, feature, formula))"
    return f"WITH {joined} " + rows("sides", results, "pairwise_derived", "'a'", "'b'", base="'delta'", date="date")


PAIR_SQL = 'pairs AS (SELECT user_id, date, \'reach\' AS feature, \'view\' AS ls, \'click\' AS rs, "view" AS lv, click AS rv FROM daily UNION ALL SELECT user_id, date, \'sale\', \'purchase\', \'view\', purchase, "view" FROM daily UNION ALL SELECT user_id, date, \'gone\', \'view\', \'nothing\', "view", NULL FROM daily)'
COLUMNS_OP = f"WITH {DAILY}, {PAIR_SQL} "


def _columns(formulas: list[str]) -> str:
    return rows("pairs", {f: formula(f, "lv", "rv") for f in formulas}, "pairwise_columns", "ls", "rs")


def frame(days: int, current: bool) -> str:
    return f"OVER (PARTITION BY user_id, feature ORDER BY date RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL {0 if current else 1} DAYS PRECEDING)"


def _stats(current: bool = False, statistic: str = "median", scale: str = "iqr", days: int = 7) -> str:
    w = frame(days, current)
    c = f"quantile_cont(v, 0.5) {w}" if statistic == "median" else f"avg(v) {w}"
    s = f"quantile_cont(v, 0.75) {w} - quantile_cont(v, 0.25) {w}" if scale == "iqr" else f"stddev_samp(v) {w}"
    return f"stats AS (SELECT *, CASE WHEN n >= 3 THEN c0 END AS c, CASE WHEN n >= 3 THEN s0 END AS s FROM (SELECT *, count(v) {w} AS n, {c} AS c0, {s} AS s0 FROM long))"


def _baseline(formulas: list[str], **how) -> str:
    gaps = [("'insufficient_baseline'", "n < 3"), ("'invalid_baseline'", "c IS NULL")]
    results = {f: formula(f, "v", "c", gaps, spread="s") for f in formulas}
    ctes = f"WITH {DAILY}, long AS ({melt('daily', TYPES)}), {_stats(**how)} "
    return ctes + rows("stats", results, "baseline_deviation", "feature", "'baseline:p'", "v", "c") + " UNION ALL " + absent("daily", "nothing", formulas, "baseline_deviation", "nothing", "")


def _baseline_source() -> str:
    flags = {"hrv_mean": "hrv_validated", "morph_n": "morphology_validated"}
    long = " UNION ALL ".join(f"SELECT user_id, date, '{f}' AS feature, {f} AS v, CASE WHEN {flag} IS NOT NULL AND NOT {flag} THEN '{flag}=false' ELSE '' END AS q FROM src" for f, flag in flags.items())
    gaps = [("'missing_source'", "n IS NULL"), ("q", "q <> ''"), ("'insufficient_baseline'", "n < 3"), ("'invalid_baseline'", "c IS NULL")]
    results = {f: formula(f, "v", "c", gaps, spread="s") for f in ("delta", "robust_z")}
    ctes = f"WITH {RAW}, src AS (SELECT * FROM raw WHERE phase = 'view'), spine AS (SELECT DISTINCT user_id, date FROM raw), long AS ({long}), {_stats()}, want AS (SELECT * FROM spine CROSS JOIN (SELECT unnest(['hrv_mean', 'morph_n']) AS feature)), judged AS (SELECT * FROM want LEFT JOIN stats USING (user_id, date, feature)) "
    return ctes + rows("judged", results, "baseline_deviation", "'view'", "CASE WHEN n IS NULL THEN 'baseline' ELSE 'baseline:p' END", "v", "c") + " UNION ALL " + absent("spine", "hrv_none", ["delta", "robust_z"], "baseline_deviation", "view", "baseline")


def _together() -> str:
    """Each operation alone, under its own name."""
    gaps = [("'insufficient_baseline'", "n < 3"), ("'invalid_baseline'", "c IS NULL")]
    long = f"SELECT * FROM ({melt('daily', ['view', 'click'])})"
    one = f"WITH {DAILY}, long AS ({long}), {_stats()} " + rows("stats", {f: formula(f, "v", "c", gaps, spread="s") for f in ("delta", "robust_z")}, "baseline_deviation", "feature", "'baseline:p'", "v", "c")
    two = f"WITH {DAILY}, long AS ({melt('daily', ['click', 'error'])}), {_stats(statistic='mean', scale='std', days=5)} " + rows("stats", {"delta": formula("delta", "v", "c", gaps, spread="s")}, "baseline_deviation", "feature", "'baseline:m'", "v", "c")
    two += " UNION ALL " + absent("daily", "nothing", ["delta"], "baseline_deviation", "nothing", "")
    three = _rolling(["view", "error"], ["sum", "max"], 7, 2, True)
    return " UNION ALL ".join(f"SELECT * FROM ({x.replace(chr(39) + 'op' + chr(39), chr(39) + name + chr(39))})" for name, x in (("week", one), ("mean", two), ("sums", three)))


def _lagged(days: int) -> str:
    results = {f: formula(f, "a.v", "b.v", [("'missing_lagged_day'", "b.user_id IS NULL")]) for f in ("delta", "ratio")}
    source = f"long a LEFT JOIN long b ON a.user_id = b.user_id AND a.feature = b.feature AND b.date = a.date - INTERVAL {days} DAYS"
    text = rows(source, results, "lagged_pairwise", "a.feature", f"a.feature || ':lag_{days}d'", "a.v", "b.v", "a.feature", date=iso("a.date")).replace("SELECT user_id,", "SELECT a.user_id,")
    return f"WITH {DAILY}, long AS ({melt('daily', TYPES)}) " + text + " UNION ALL " + absent("daily", "nothing", ["delta", "ratio"], "lagged_pairwise", "nothing", "")


_AGG = {"sum": "sum(v)", "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "std": "stddev_samp(v)", "min": "min(v)", "max": "max(v)"}


def _rolling(features: list[str], names: list[str], days: int, least: int, current: bool, lost: str = "") -> str:
    w = frame(days, current)
    stats = f"stats AS (SELECT *, count(v) {w} AS n, {', '.join(f'{_AGG[a]} {w} AS a_{a}' for a in names)} FROM long)"
    results = {f"rolling_{days}d_{a}": settle([("'insufficient_window'", f"n < {least}"), ("'invalid_aggregate'", f"a_{a} IS NULL")], f"a_{a}") for a in names}
    text = f"WITH {DAILY}, long AS ({melt('daily', features)}), {stats} " + rows("stats", results, "rolling_aggregate", "feature", f"'previous_{days}d'", "v", "CAST(NULL AS DOUBLE)")
    return text + (" UNION ALL " + absent("daily", lost, names, "rolling_aggregate", lost, "") if lost else "")


_SEG = "SELECT o_orderkey, {} AS label, {} AS start_sec, {} AS end_sec, {} AS window_idx FROM {} WHERE {}"
_TOTAL = "t AS (SELECT o_orderkey, o_orderkey % 97 / 4.0::DOUBLE AS total FROM orders)"


def _windows(size: float, step: float, least: float) -> str:
    some = f"(SELECT o_orderkey, CAST(total AS DOUBLE) AS total, k FROM t, unnest(range(0, 20)) AS u(k))"
    ok = f"k * {step} < total AND least(k * {step} + {size}, total) - k * {step} >= {least}"
    return f"WITH {_TOTAL} " + _SEG.format("'window'", f"CAST(k * {step} AS DOUBLE)", f"CAST(least(k * {step} + {size}, total) AS DOUBLE)", "CAST(k + 1 AS INT)", some, ok)


_NAMED = f"WITH {_TOTAL} " + " UNION ALL ".join(
    _SEG.format(f"'{label}'", f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)", "CAST(NULL AS INT)", "t", f"{b} > {a}") for label, a, b in (("full", "0", "total"), ("start", "0", "least(5, total)"), ("end", "greatest(total - 5, 0)", "total"))
)

_TIME = {
    "MeanNN_ms": "avg(ms)", "MedianNN_ms": "quantile_cont(ms, 0.5)", "SDNN_ms": "stddev_samp(ms)", "RMSSD_ms": "sqrt(avg(d * d))", "SDSD_ms": "stddev_samp(d)", "NN_min_ms": "min(ms)", "NN_max_ms": "max(ms)",
    "NN_range_ms": "max(ms) - min(ms)", "pNN20_percent": "100.0 * avg(CAST(abs(d) > 20 AS INT))", "pNN50_percent": "100.0 * avg(CAST(abs(d) > 50 AS INT))", "MeanHR_bpm": "avg(60 / nullif(rr, 0))", "HR_min_bpm": "min(60 / nullif(rr, 0))",
    "HR_max_bpm": "max(60 / nullif(rr, 0))", "HR_std_bpm": "stddev_samp(60 / nullif(rr, 0))",
}

_ENTROPY = f"""WITH {BEATS}, s AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM diffs),
lim AS (SELECT user_id, 0.2 * stddev_pop(ms) AS r, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT user_id, i, ms AS a, lead(ms) OVER w AS b, lead(ms, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
p AS (SELECT x.user_id, x.i AS i, y.i AS j, n, x.b IS NOT NULL AND y.b IS NOT NULL AS has2, x.c IS NOT NULL AND y.c IS NOT NULL AS has3,
  greatest(abs(x.a - y.a), abs(x.b - y.b)) <= r AS m2, greatest(abs(x.a - y.a), abs(x.b - y.b), abs(x.c - y.c)) <= r AS m3 FROM t x JOIN t y USING (user_id) JOIN lim USING (user_id)),
phi AS (SELECT user_id, i, sum(CAST(has2 AND m2 AS INT)) / nullif(sum(CAST(has2 AS INT)), 0) AS c2, sum(CAST(has3 AND m3 AS INT)) / nullif(sum(CAST(has3 AS INT)), 0) AS c3 FROM p GROUP BY 1, 2),
ap AS (SELECT user_id, avg(ln(c2)) - avg(ln(c3)) AS v FROM phi GROUP BY 1),
sa AS (SELECT user_id, any_value(n) AS n, sum(CAST(j > i AND has2 AND m2 AS INT)) AS b, sum(CAST(j > i AND has3 AND m3 AS INT)) AS a FROM p GROUP BY 1)
SELECT user_id, {r('CASE WHEN n >= 4 THEN ap.v END')} AS ApproxEntropy, {r('CASE WHEN n >= 4 AND a > 0 AND b > 0 THEN -ln(a / b) END')} AS SampleEntropy FROM sa JOIN ap USING (user_id)"""


def _dfa(lo: int, hi: int) -> str:
    return f"""(SELECT user_id, CASE WHEN count(*) >= 3 THEN regr_slope(ln(f), ln(k)) END AS v FROM (
  SELECT user_id, k, sqrt(sum(syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END) / (count(*) * k)) AS f, count(*) AS boxes FROM (
    SELECT user_id, k, box, any_value(n) AS n, regr_sxx(y, CAST(i AS DOUBLE)) AS sxx, regr_sxy(y, CAST(i AS DOUBLE)) AS sxy, regr_syy(y, CAST(i AS DOUBLE)) AS syy FROM (SELECT *, (i - 1) // k AS box FROM prof, unnest(range({lo}, {hi})) AS u(k)) WHERE (box + 1) * k <= n AND k < n AND n >= 20 GROUP BY 1, 2, 3)
  GROUP BY 1, 2) WHERE boxes >= 2 AND f > 0 GROUP BY 1)"""


_FRACTAL = f"""WITH {BEATS}, s AS (SELECT user_id, ms, rr, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(rr) OVER (PARTITION BY user_id) AS m FROM diffs),
prof AS (SELECT user_id, i, n, sum(rr - m) OVER (PARTITION BY user_id ORDER BY i) AS y FROM s),
h AS (SELECT user_id, n, k, (i - 1) % k AS m, ms, lag(ms) OVER (PARTITION BY user_id, k, (i - 1) % k ORDER BY i) AS p FROM s, unnest(range(1, 10)) AS u(k) WHERE n >= 20),
hl AS (SELECT user_id, k, m, sum(abs(ms - p)) * (any_value(n) - 1) / (count(*) * k) AS l, count(*) AS c FROM h GROUP BY 1, 2, 3),
hk AS (SELECT user_id, k, avg(l) AS l FROM hl WHERE c > 1 GROUP BY 1, 2),
fd AS (SELECT user_id, CASE WHEN count(*) >= 3 THEN regr_slope(ln(l), -ln(k)) END AS v FROM hk WHERE l > 0 GROUP BY 1)
SELECT u.user_id, {r('a1.v', 5)} AS DFA_alpha1, {r('a2.v', 5)} AS DFA_alpha2, {r('fd.v', 5)} AS FractalDimension FROM (SELECT DISTINCT user_id FROM s) u
LEFT JOIN {_dfa(4, 16)} a1 USING (user_id) LEFT JOIN {_dfa(16, 64)} a2 USING (user_id) LEFT JOIN fd USING (user_id)"""

_SUSPECT = f"""{BEATS}, m AS (SELECT *, CASE WHEN rr IS NOT NULL THEN quantile_cont(rr, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS local_median FROM beats),
o AS (SELECT *, coalesce(rr < 1.0 OR rr > 40.0, FALSE) AS bad_rr, coalesce(local_median > 1e-9 AND (rr < 0.7 * local_median OR rr > 1.5 * local_median), FALSE) AS rr_outlier FROM m),
sus AS (SELECT *, bad_rr OR rr_outlier OR coalesce(lead(bad_rr OR rr_outlier) OVER (PARTITION BY user_id ORDER BY t, event_id), FALSE) AS suspicious FROM o)"""

_WELCH = f"""WITH {BEATS}, s AS (SELECT user_id, rr, row_number() OVER w AS i, sum(rr) OVER w - first_value(rr) OVER w AS a, count(*) OVER (PARTITION BY user_id) AS n FROM beats WHERE rr IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
line AS (SELECT user_id, n, a, rr AS x, lead(a) OVER w AS b, lead(rr) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
grid AS (SELECT user_id, g, x + (y - x) / (b - a) * (g / 4.0 - a) AS v FROM (SELECT *, unnest(generate_series(CAST(ceil(a * 4) AS BIGINT), CAST(ceil(b * 4) AS BIGINT) - 1)) AS g FROM line WHERE b > a AND n >= 4)),
z AS (SELECT user_id, g, v - avg(v) OVER w AS v, count(*) OVER w AS size, least(count(*) OVER w, 256) AS m FROM grid WINDOW w AS (PARTITION BY user_id)),
h AS (SELECT *, greatest(1, m - m // 2) AS hop FROM z WHERE size >= 16),
part AS (SELECT user_id, m, p, g - p * hop AS j, v FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((g - m + 1) / hop) AS BIGINT)), least(g // hop, (size - m) // hop))) AS p FROM h)),
c AS (SELECT user_id, m, p, j, (v - avg(v) OVER (PARTITION BY user_id, p)) * (0.5 - 0.5 * cos(2 * pi() * j / m)) AS y FROM part),
f AS (SELECT user_id, m, p, k, sum(y * cos(2 * pi() * k * j / m)) AS re, sum(y * sin(2 * pi() * k * j / m)) AS im FROM (SELECT *, unnest(generate_series(0, least(m // 2, CAST(ceil(m / 10) AS BIGINT)))) AS k FROM c) GROUP BY 1, 2, 3, 4),
d AS (SELECT user_id, k * 4.0 / m AS f, avg(re * re + im * im) / (4.0 * 0.375 * m) * CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END AS p FROM f GROUP BY user_id, m, k),
band AS (SELECT * FROM (VALUES ('VLF', 0.0033, 0.04), ('LF', 0.04, 0.15), ('HF', 0.15, 0.40), ('Total', 0.0033, 0.40)) AS b(band, lo, hi)),
inside AS (SELECT user_id, band, f, p, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM d JOIN band ON f >= lo AND f < hi WINDOW w AS (PARTITION BY user_id, band ORDER BY f)),
per AS (SELECT user_id, band, sum((p + p2) / 2 * (f2 - f)) AS power, arg_max(f, p) AS peak FROM inside GROUP BY 1, 2),
wide AS (SELECT user_id, {", ".join(f"max(CASE WHEN band = '{b}' THEN {c} END) AS {b}_{c}" for b in ("VLF", "LF", "HF", "Total") for c in ("power", "peak"))} FROM per GROUP BY 1)
SELECT u.user_id, {", ".join(f"{r(f'{b}_power')} AS {b}_power" for b in ("VLF", "LF", "HF", "Total"))}, {r("CASE WHEN HF_power > 1e-12 THEN LF_power / HF_power END")} AS LF_HF_ratio, {r("CASE WHEN LF_power + HF_power > 1e-12 THEN 100 * LF_power / (LF_power + HF_power) END")} AS LF_nu,
{r("CASE WHEN LF_power + HF_power > 1e-12 THEN 100 * HF_power / (LF_power + HF_power) END")} AS HF_nu, {r("LF_peak")} AS LF_peak_Hz, {r("HF_peak")} AS HF_peak_Hz FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN wide USING (user_id)"""

_STATS = "count(*) AS n_total, count(v) AS n_valid, count(DISTINCT v) AS n_unique, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(v) AS min, max(v) AS max"
_STAT_COLUMNS = f"n_total, n_valid, {r('n_valid / n_total')} AS valid_ratio, n_total - n_valid AS n_missing, {r('1 - n_valid / n_total')} AS missing_ratio, n_unique, " + ", ".join(f"{r(c)} AS {c}" for c in ("mean", "median", "std", "iqr", "min", "max"))


def _flat(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS col, CAST({expr} AS DOUBLE) AS v FROM {source}" for name, expr in columns.items())


def _summary(source: str, columns: dict[str, str]) -> str:
    return f"(SELECT col, {_STATS} FROM ({_flat(source, columns)}) GROUP BY 1)"


def _rule_reason(unique: int) -> str:
    text = f"concat_ws(';', CASE WHEN n_valid < 10 THEN 'low_valid_n' END, CASE WHEN n_valid / n_total < 0.6 THEN 'low_valid_ratio' END, CASE WHEN n_unique < {unique} THEN 'low_unique_values' END, CASE WHEN iqr <= 1e-9 THEN 'low_iqr' END)"
    return f"CASE WHEN {text} = '' THEN 'ok' ELSE {text} END"


_SALE = 'purchase - "view"'
_SET = f"""{DAILY}, {RAW}, days AS (SELECT user_id, date FROM daily UNION SELECT user_id, date FROM raw),
ds AS (SELECT d.user_id, d.date, {', '.join(f"w.raw_ecg__{t}__sit__full__hrv_mean" for t in TYPES[:3])}, {', '.join(f'x.{_Q(t)} AS ctx__{t}' for t in TYPES)}, x.{_SALE.replace('"view"', 'x."view"')} AS target__sale, x."view" AS target__view FROM days d
LEFT JOIN daily x USING (user_id, date) LEFT JOIN (SELECT user_id, date, {', '.join(f"max(CASE WHEN phase = '{t}' AND coalesce(hrv_validated, FALSE) THEN hrv_mean END) AS raw_ecg__{t}__sit__full__hrv_mean" for t in TYPES[:3])} FROM raw GROUP BY 1, 2) w USING (user_id, date))"""
_CTX = {f"ctx__{t}": f"ctx__{t}" for t in TYPES}
_TARGETS = {"target__sale": "target__sale", "target__view": "target__view"}
_LABELS = "(VALUES ('sale', 'target__sale', 'Sales response', 'higher_worse', 'acute', 'numeric', 'continuous'), ('view', 'target__view', 'Views', 'higher_better', 'same_day', 'numeric', 'continuous'){}) AS l(target, col, label, direction, horizon, data_type, scale_type)"
_OVERLAP = "(" + " UNION ALL ".join(f"SELECT '{t}' AS target, '{c}' AS target_column, '{f}' AS feature, count({c}) AS n_target_valid, count({f}) AS n_feature_valid, count(CASE WHEN {c} IS NOT NULL THEN {f} END) AS n_overlap, count(*) AS total FROM ds" for t, c in (("sale", "target__sale"), ("view", "target__view")) for f in _CTX) + ")"
_OVERLAP_REASON = "concat_ws(';', CASE WHEN n_overlap < 10 THEN 'low_overlap_n' END, CASE WHEN n_overlap / total < 0.5 THEN 'low_overlap_ratio' END)"


def _qc(context: bool, hrv: bool) -> str:
    per = ", ".join(f"max(CAST(phase = '{t}' AS INT)) AS f_{t}, max(CAST(phase = '{t}' AND coalesce(hrv_validated, FALSE) AS INT)) AS h_{t}, max(CAST(phase = '{t}' AND coalesce(morphology_validated, FALSE) AS INT)) AS m_{t}" for t in TYPES[:3])
    total = lambda k: " + ".join(f"{k}_{t}" for t in TYPES[:3])
    done = f"{total('f')} = 3" + (f" AND {total('h')} = 3" if hrv else "") + (' AND coalesce(x."view" IS NOT NULL AND x.error IS NOT NULL, FALSE)' if context else "")
    return f"""WITH {RAW}, {DAILY}, per AS (SELECT user_id, date, {per} FROM raw GROUP BY 1, 2) SELECT per.user_id, {iso('per.date')} AS date, CAST(3 AS BIGINT) AS n_ecg_records_expected, CAST({total('f')} AS BIGINT) AS n_ecg_records_found,
CAST({total('h')} AS BIGINT) AS n_ecg_records_valid_hrv, CAST({total('m')} AS BIGINT) AS n_ecg_records_valid_morphology, {done} AS complete_core_day FROM per LEFT JOIN daily x USING (user_id, date)"""


USERS = f"{DAILY}, users AS (SELECT user_id, {', '.join(f'round(avg({_Q(t)}), 6) AS {_Q(t)}' for t in TYPES)} FROM daily GROUP BY 1)"


def _pairs_sql(source: str, ids: str, targets: list[str], features: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {ids}, '{t}' AS target, '{f}' AS feature, {_Q(f)} AS x, {_Q(t)} AS y FROM {source} WHERE {_Q(f)} IS NOT NULL AND {_Q(t)} IS NOT NULL" for t in targets for f in features) + ")"


def _rho(source: str, by: str) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"
    return f"(SELECT {by}, count(*) AS n, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) END AS rho FROM (SELECT {by}, {rank('x')} AS rx, {rank('y')} AS ry FROM {source}) GROUP BY {by})"


def _stability(pairs: str) -> str:
    left_out = f"(SELECT p.target, p.feature, o.user_id AS gone, p.x, p.y FROM {pairs} p JOIN {pairs} o ON p.target = o.target AND p.feature = o.feature AND p.user_id <> o.user_id)"
    return f"(SELECT e.target, e.feature, avg(CAST(coalesce(sign(e.rho) = sign(w.rho), FALSE) AS INT)) AS stability FROM {_rho(left_out, 'target, feature, gone')} e JOIN {_rho(pairs, 'target, feature')} w USING (target, feature) GROUP BY 1, 2)"


def _ranked(min_abs: float, min_stability: float) -> str:
    pairs = _pairs_sql("users", "user_id", ["view", "error"], ["click", "purchase", "signup"])
    return f"""(SELECT target, feature, n, rho, stability, score, abs(rho) >= {min_abs} AND stability >= {min_stability} AS passed, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, feature) AS rank FROM (
SELECT *, abs(rho) * 0.7 + stability * 0.3 AS score FROM {_rho(pairs, 'target, feature')} JOIN {_stability(pairs)} USING (target, feature) WHERE rho IS NOT NULL))"""


_EDGE = "CASE WHEN n_valid IS NULL THEN 'missing_target_column' ELSE {} END"
_FLAG = "lower(trim(f)) IN ('true', '1', 'yes', 'y', 'valid')"
_GATE_TEXT = "concat_ws(';', {})"


def _gate(asked: list[tuple[str, str]]) -> str:
    return _GATE_TEXT.format(", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in asked))


def _num(x: str, kind: str = "DOUBLE") -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'nan')"


_SIGNAL = _gate([
    ("bad > 10.0", f"'bad_rr_fraction=' || {_num('bad')} || ' > 10.0'"), ("odd > 50.0", f"'suspicious_peak_fraction=' || {_num('odd')} || ' > 50.0'"), ("n_rpeaks < 60", f"'n_rpeaks=' || {_num('n_rpeaks')} || ' < 60'"),
    ("amp > 3.0", f"'rpeak_amp_bad_ratio=' || {_num('amp')} || ' > 3.0'"), ("med IS NULL OR med < 20.0", f"'rpeak_amp_median=' || {_num('med')} || ' < 20.0'"),
])
_SHAPE = _gate([
    ("err IS NOT NULL", "'morphology_error: ' || err"), ("nx < 3", f"'n_beats_extracted=' || {_num('nx')} || ' < 3'"), ("ng < 3", f"'n_beats_good=' || {_num('ng')} || ' < 3'"),
    ("main IS NULL", "'QRS_main_idx is missing'"), ("dur IS NULL", "'QRS_duration_ms is missing'"), ("dur IS NULL OR dur < 20.0", f"'QRS_duration_ms=' || {_num('dur')} || ' < 20.0'"),
    ("dur IS NULL OR dur > 180.0", f"'QRS_duration_ms=' || {_num('dur')} || ' > 180.0'"), ("NOT p", "'P wave required but not detected'"),
])
_TIME_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_EVENT_AGG = f"count(*) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS low, {r('max(value)')} AS high"


def oracle_sql() -> dict[str, str]:
    out = {
        "computed_difference": _computed('"view" - click'),
        "computed_sum": _computed('"view" + click + purchase'),
        "computed_product": _computed('"view" * click'),
        "computed_ratio": _computed('"view" / nullif(click, 0)'),
        "computed_weighted_sum": _computed('"view" * 0.25::DOUBLE + click * 2.0::DOUBLE'),
        "computed_composite_mean": _computed(_COMPOSITE),
        "computed_chain": f'WITH {DAILY}, a AS (SELECT *, "view" + click + purchase AS a FROM daily), b AS (SELECT *, a / nullif("view", 0) AS b FROM a) SELECT user_id, {iso()} AS date, {r("a")} AS a, {r("b")} AS b, {r("b - a")} AS c FROM b',
        **{f"pairwise_{f}": _pairwise([f]) for f in ("delta", "percent_delta", "ratio", "log_ratio")},
        "pairwise_valid_only": _pairwise(["delta", "ratio"], flags=True),
        "pairwise_keep_invalid": _pairwise(["delta", "ratio"], flags=True, policy="keep"),
        "pairwise_derived": _pairwise_derived(),
        "pairwise_columns": COLUMNS_OP + _columns(["delta", "percent_delta", "ratio", "log_ratio"]),
        "baseline_delta": _baseline(["delta"]),
        "baseline_robust_z": _baseline(["delta", "robust_z"]),
        "baseline_mean_std": _baseline(["robust_z"], statistic="mean", scale="std"),
        "baseline_include_current": _baseline(["delta", "robust_z"], current=True),
        "baseline_of_source": _baseline_source(),
        "trailing_together": _together(),
        "lagged_pairwise_1d": _lagged(1),
        "lagged_pairwise_7d": _lagged(7),
        "rolling_aggregates": _rolling(TYPES, list(_AGG), 7, 2, False, "nothing"),
        "rolling_include_current": _rolling(["view"], ["sum", "mean"], 3, 1, True),
        "source_selection": "SELECT event_id, event_type AS phase, event_type AS record_type, CASE WHEN event_id % 3 = 1 THEN 'start' ELSE 'full' END AS segment FROM events WHERE event_type = 'view'",
        "date_policy": "SELECT o_orderkey, day, strftime(try_strptime(day, '%d.%m.%Y'), '%Y-%m-%d') AS date FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '31.02.2024' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day FROM orders)",
        "numeric_sniff": f"SELECT event_id, {r('round(value, 2)')} AS a, hour(ts) || ':' || minute(ts) AS b, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS DOUBLE) END AS c, event_type FROM events",
        "flags": f"SELECT event_id, f, {_FLAG} AS is_set, lower(f) IN ('true', '1', 'yes', 'valid') AS is_set_in_report, lower(trim(f)) IN ('false', '0', 'no', 'bad', 'invalid', '0.0') AS is_false FROM (SELECT event_id, ['true', ' Yes', 'y', '1', 'no', 'valid', '0', 'bad'][event_id % 8 + 1] AS f FROM events)",
        "segment_names": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN printf('window_%02d', p_size) ELSE regexp_replace(p_name, '[^\\p{{L}}\\p{{N}}]', '_', 'g') END AS name, {r('round_even(p_retailprice / 2, 0)')} AS half FROM part",
        "segments_full": f"WITH {_TOTAL} " + _SEG.format("'full'", "CAST(0 AS DOUBLE)", "total", "CAST(NULL AS INT)", "t", "TRUE"),
        "segments_fixed": _windows(5.0, 5.0, 2.0),
        "segments_sliding": _windows(5.0, 2.0, 0.0),
        "segments_named": _NAMED,
        "segment_cut": f"""WITH w AS (SELECT vec_id, embedding[14:47] AS part, [CAST(i * 8 - vec_id % 5 AS INT) FOR i IN range(1, 9)] AS p FROM embeddings) SELECT vec_id, CAST(len(part) AS INT) AS n, {r('list_sum([CAST(v AS DOUBLE) FOR v IN part])', 4)} AS total,
            array_to_string([q - 13 FOR q IN p IF q >= 6 AND q < 58 AND q >= 13 AND q < 47], ',') AS peaks, FALSE AS long_enough FROM w""",
        "rr_intervals": f"WITH {BEATS} SELECT user_id, event_id, {r('rr')} AS rr FROM beats",
        "rr_time_domain": f"WITH {BEATS} SELECT user_id, count(*) AS n_rr, {', '.join(f'CASE WHEN count(*) >= 3 THEN {r(x, 3)} END AS {n}' for n, x in _TIME.items())} FROM diffs GROUP BY 1",
        "rr_poincare": f"""WITH {BEATS}, v AS (SELECT user_id, count(*) AS n, sqrt(var_samp(d) / 2) AS a, sqrt(greatest(2 * var_samp(ms) - var_samp(d) / 2, 0)) AS b FROM diffs GROUP BY 1)
            SELECT user_id, {r('a', 2)} AS SD1_ms, {r('b', 2)} AS SD2_ms, {r('a / nullif(b, 0)', 2)} AS SD1_SD2_ratio, {r('pi() * a * b', 2)} AS Ellipse_area FROM v WHERE n >= 3""",
        "rr_shannon": f"""WITH {BEATS}, b AS (SELECT user_id, ms, min(ms) OVER w AS lo, max(ms) OVER w AS hi, count(*) OVER w AS n FROM diffs WINDOW w AS (PARTITION BY user_id)),
            c AS (SELECT user_id, least(coalesce(floor((ms - lo) * 10.0 / nullif(hi - lo, 0)), 5), 9) AS bin, any_value(n) AS n, count(*) / any_value(n) AS p FROM b GROUP BY 1, 2) SELECT user_id, CASE WHEN any_value(n) >= 3 THEN {r('abs(sum(p * ln(p)))')} END AS ShannonEntropy FROM c GROUP BY 1""",
        "rr_entropies": _ENTROPY,
        "rr_fractals": _FRACTAL,
        "basic_qc": f"WITH {BEATS} SELECT user_id, count(*) AS n_rpeaks, {r('avg(CASE WHEN rr IS NOT NULL THEN CAST(rr < 2.0 OR rr > 40.0 AS INT) END)')} AS rr_phys_bad_ratio, {r('60 / nullif(avg(rr), 0)')} AS mean_hr_bpm_rough FROM beats GROUP BY 1",
        "clipping": f"SELECT user_id, {r('avg(CAST(value <= 2 AS INT)) + avg(CAST(value >= 98 AS INT))')} AS clipping_ratio FROM events GROUP BY 1",
        "suspicious_beats": f"WITH {_SUSPECT} SELECT user_id, event_id, {r('local_median')} AS local_median, bad_rr, rr_outlier, suspicious FROM sus",
        "signal_gate": f"""WITH {_SUSPECT}, per AS (SELECT user_id, count(*) AS n_rpeaks, CAST(floor(count(CASE WHEN bad_rr THEN 1 END) * 100 / count(rr)) AS DOUBLE) AS bad, CAST(floor(count(CASE WHEN suspicious THEN 1 END) * 100 / count(*)) AS DOUBLE) AS odd,
            CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 7 AS DOUBLE) END AS amp, CAST(user_id AS DOUBLE) AS med FROM sus GROUP BY user_id) SELECT user_id, {_SIGNAL} AS reasons, {_SIGNAL} = '' AS passed FROM per""",
        "morphology_gate": f"""WITH per AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'no_median_beat' END AS err, p_partkey % 9 AS nx, p_partkey % 5 AS ng, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 40 END AS main,
            CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 250 AS DOUBLE) END AS dur, p_partkey % 2 = 0 AS p FROM part) SELECT p_partkey, {_SHAPE} AS reasons FROM per""",
        "validation_flags": f"""WITH e AS (SELECT event_id, value, CASE WHEN event_id % 3 = 0 AND event_id % 6 <> 0 THEN 'skipped' ELSE 'accepted' END AS s, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 <> 0 END AS q FROM events)
            SELECT event_id, {r("CASE WHEN s = 'accepted' AND coalesce(q, TRUE) THEN value END")} AS hrv_x, s AS hrv_review_status, q AS hrv_qc_passed, s = 'accepted' AND coalesce(q, TRUE) AS hrv_ok, s = 'accepted' AND coalesce(q, FALSE) AS morph_ok FROM e""",
        "review_windows": f"""WITH RECURSIVE {BEATS}, s AS (SELECT user_id, start, row_number() OVER (PARTITION BY user_id ORDER BY start) AS i FROM (SELECT DISTINCT user_id, greatest(floor(t - 473352) - 24, 0) AS start, floor(t - 473352) AS x FROM beats WHERE rr > 18)),
            w AS (SELECT user_id, i, start, start AS last, TRUE AS taken FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, s.start, CASE WHEN abs(s.start - w.last) > 24 THEN s.start ELSE w.last END, abs(s.start - w.last) > 24 FROM w JOIN s ON s.user_id = w.user_id AND s.i = w.i + 1)
            SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INT) AS pos, {r('start')} AS start FROM w WHERE taken""",
        "median_wave": f"WITH {WAVES} SELECT label, CAST(pos AS INT) AS pos, {r('quantile_cont(x, 0.5)')} AS m FROM waves GROUP BY 1, 2",
        "template_correlation": f"""WITH {WAVES}, z AS (SELECT label, vec_id, pos, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM waves WINDOW w AS (PARTITION BY label, vec_id)), t AS (SELECT label, pos, quantile_cont(z, 0.5) AS m FROM z GROUP BY 1, 2)
            SELECT label, vec_id, {r('corr(z, m)', 5)} AS r FROM z JOIN t USING (label, pos) GROUP BY 1, 2""",
        "wave_area": f"WITH {WAVES} SELECT vec_id, {r('(sum(x) - (first(x ORDER BY pos) + last(x ORDER BY pos)) / 2 - (count(*) - 1) * (first(x ORDER BY pos) + last(x ORDER BY pos)) / 2) / 64.0')} AS area FROM waves GROUP BY 1",
        "wave_width": f"""WITH {WAVES}, p AS (SELECT vec_id, abs(x) * 0.5 AS b FROM waves WHERE pos = 32) SELECT vec_id, {r('(coalesce(min(CASE WHEN pos > 32 AND abs(x) <= b THEN pos END), 63) - coalesce(max(CASE WHEN pos < 32 AND abs(x) <= b THEN pos END), 0)) / 64.0 * 1000')} AS width_ms
            FROM waves JOIN p USING (vec_id) GROUP BY 1""",
        "wide_raw": f"WITH {RAW} SELECT user_id, {iso()} AS date, " + ", ".join(f"{r(f'max(CASE WHEN phase = {chr(39)}{t}{chr(39)} AND coalesce({v}, FALSE) THEN {f} END)')} AS raw_ecg__{t}__sit__full__{f}" for t in TYPES[:3] for f, v in (("hrv_mean", "hrv_validated"), ("morph_n", "morphology_validated"))) + " FROM raw GROUP BY user_id, date",
        "wide_derived": f"""WITH {DAILY} SELECT user_id, {iso()} AS date, {r('"view" - click')} AS der__op__delta__reach, {r('purchase - "view"')} AS der__op__delta__sale, {r('"view" / nullif(click, 0)')} AS der__op__ratio__reach, {r('purchase / nullif("view", 0)')} AS der__op__ratio__sale FROM daily
            WHERE "view" IS NOT NULL AND (click IS NOT NULL OR purchase IS NOT NULL)""",
        "wide_context": f'WITH {DAILY} SELECT user_id, {iso()} AS date, {r(_Q("view"))} AS ctx__view, {r("click")} AS ctx__click FROM daily',
        "first_non_null": f"SELECT user_id, {iso('CAST(ts AS DATE)')} AS date, {r('min_by(value, event_id) FILTER (WHERE event_id % 3 <> 0)')} AS ctx__v FROM events GROUP BY 1, 2",
        "named_items": f'WITH {DAILY} SELECT user_id, {iso()} AS date, {r(_SALE)} AS target__sale, {r(_Q("view"))} AS target__view FROM daily',
        "qc_summary": _qc(True, True),
        "analysis_dataset": f"WITH {_SET} SELECT user_id, {iso()} AS date, " + ", ".join(f"{r(c)} AS {c}" for c in [*(f"raw_ecg__{t}__sit__full__hrv_mean" for t in TYPES[:3]), *_CTX, *_TARGETS]) + " FROM ds",
        "report_summarize": f"WITH {DAILY} SELECT col AS \"column\", {_STAT_COLUMNS} FROM {_summary('daily', {t: _Q(t) for t in TYPES})}",
        "report_completeness": f"""WITH {DAILY} SELECT col AS "column", TRUE AS present, {_STAT_COLUMNS}, 'ok' AS reason FROM {_summary('daily', {t: _Q(t) for t in ('view', 'error')})}
            UNION ALL SELECT 'nothing', FALSE, count(*), 0, 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing_column' FROM daily""",
        "report_targets": f"""WITH {_SET} SELECT target, l.col AS "column", label, direction, horizon, data_type, scale_type, n_valid IS NOT NULL AS present, {_STAT_COLUMNS}, coalesce({_rule_reason(4)} = 'ok' AND n_valid IS NOT NULL, FALSE) AS usable, {_EDGE.format(_rule_reason(4))} AS reason
            FROM {_LABELS.format(", ('none', 'target__none', 'x', '', '', '', '')")} LEFT JOIN {_summary('ds', _TARGETS)} s ON s.col = l.col""",
        "report_availability": f"WITH {_SET} SELECT col AS feature, 'input' AS role, 'context_computed' AS source_table, 'context' AS feature_family, {_STAT_COLUMNS}, {_rule_reason(5)} = 'ok' AS usable, {_rule_reason(5)} AS reason FROM {_summary('ds', _CTX)}",
        "report_overlap": f"WITH {_SET} SELECT target, target_column, feature, n_target_valid, n_feature_valid, n_overlap, {r('n_overlap / total')} AS overlap_ratio, {_OVERLAP_REASON} = '' AS usable, CASE WHEN {_OVERLAP_REASON} = '' THEN 'ok' ELSE {_OVERLAP_REASON} END AS reason FROM {_OVERLAP}",
        "report_readiness": f"""WITH {_SET}, o AS (SELECT target, count(DISTINCT feature) AS nf FROM {_OVERLAP} WHERE {_OVERLAP_REASON} = '' GROUP BY 1), t AS (SELECT target, n_valid, {_rule_reason(4)} = 'ok' AS usable FROM {_LABELS.format("")} JOIN {_summary('ds', _TARGETS)} s ON s.col = l.col),
            w AS (SELECT target, n_valid AS n_samples, coalesce(nf, 0) AS nf, usable FROM t LEFT JOIN o USING (target)), x AS (SELECT *, concat_ws(';', CASE WHEN n_samples < 15 THEN 'too_few_samples_for_regression' END, CASE WHEN nf / n_samples > 0.5 THEN 'too_many_features_for_samples' END, CASE WHEN NOT usable THEN 'target_not_usable' END) AS why FROM w)
            SELECT target, n_samples, nf AS n_usable_features_by_overlap, {r('nf / n_samples')} AS feature_sample_ratio, CASE WHEN why = '' THEN 'descriptive_or_feature_analysis' ELSE 'diagnostic_only' END AS recommended_use, CASE WHEN why = '' THEN 'ok' ELSE why END AS warning FROM x""",
        "report_ecg_quality": f"WITH {RAW} SELECT phase, record_type, segment_label, count(*) AS n_total, count(DISTINCT date) AS n_dates, count(CASE WHEN hrv_validated THEN 1 END) AS hrv_valid_n, {r('avg(CAST(coalesce(hrv_validated, FALSE) AS INT))')} AS hrv_valid_ratio, count(CASE WHEN morphology_validated THEN 1 END) AS morphology_valid_n, {r('avg(CAST(morphology_validated AS INT))')} AS morphology_valid_ratio FROM raw GROUP BY 1, 2, 3",
        "report_derived_operations": f"""WITH {DAILY}, {PAIR_SQL}, x AS ({_columns(['delta', 'ratio'])}), y AS (SELECT formula, reason, row_number() OVER (PARTITION BY formula ORDER BY count(*) DESC, reason) AS k FROM x WHERE reason <> '' GROUP BY 1, 2)
            SELECT 'context_derived' AS "table", 'op' AS operation_id, 'pairwise_columns' AS operation_type, formula, CAST(NULL AS VARCHAR) AS base_formula, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT feature) AS n_features, count(CASE WHEN valid THEN 1 END) AS valid_n, {r('avg(CAST(valid AS INT))')} AS valid_ratio,
            coalesce(any_value(y.reason), '') AS main_invalid_reason FROM x LEFT JOIN (SELECT formula, reason FROM y WHERE k = 1) y USING (formula) GROUP BY formula""",
        "report_coverage": _qc(False, False),
        "report_summary": f"""WITH {_SET} SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns, {iso('min(date)')} AS date_min, {iso('max(date)')} AS date_max, CAST(2 AS BIGINT) AS n_targets, (SELECT count(*) FROM {_summary('ds', _TARGETS)} WHERE {_rule_reason(4)} = 'ok') AS n_usable_targets,
            CAST(5 AS BIGINT) AS n_features_total, (SELECT count(*) FROM {_summary('ds', _CTX)} WHERE {_rule_reason(5)} = 'ok') AS n_usable_features FROM ds""",
        "spearman": f"WITH {DAILY} SELECT target, feature, n, {r('rho')} AS rho FROM {_rho(_pairs_sql('daily', 'user_id, date', ['view', 'error'], ['click', 'purchase', 'signup']), 'target, feature')}",
        "direction_stability": f"WITH {USERS} SELECT target, feature, {r('stability')} AS stability FROM {_stability(_pairs_sql('users', 'user_id', ['view'], ['click', 'purchase', 'signup']))}",
        "redundancy": f"WITH {USERS}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_Q(a)} AS x, {_Q(b)} AS y FROM users WHERE {_Q(a)} IS NOT NULL AND {_Q(b)} IS NOT NULL" for a in TYPES for b in TYPES if a < b) + f") SELECT a, b, n, {r('rho')} AS rho FROM {_rho('p', 'a, b')} WHERE abs(rho) >= 0.05",
        "ranking": f"WITH {USERS} SELECT target, feature, n, {r('rho')} AS rho, {r('stability')} AS stability, {r('score')} AS score, passed, CAST(rank AS INT) AS rank FROM {_ranked(0.05, 0.7)}",
        "multi_target": f"""WITH {USERS}, p AS (SELECT feature, count(CASE WHEN passed THEN 1 END) AS n_passed, greatest(avg(CAST(rho > 0 AS INT)), 1 - avg(CAST(rho > 0 AS INT))) AS c, avg(score) AS score FROM {_ranked(0.0, 0.0)} GROUP BY 1)
            SELECT feature, n_passed, {r('c')} AS consistency, {r('score')} AS score, n_passed >= 2 AND c >= 1.0 AS validated FROM p""",
        "directed_targets": f'WITH {DAILY} SELECT user_id, {iso()} AS date, {r("-" + _Q("view"))} AS "view", {r("error")} AS error FROM daily',
        "feature_rules": f"WITH {DAILY} SELECT col AS \"column\", {r('1 - n_valid / n_total')} AS missing_ratio, n_unique FROM {_summary('daily', {t: _Q(t) for t in TYPES})} WHERE 1 - n_valid / n_total <= 0.5 AND n_unique >= 4",
        "event_windows": f"SELECT event_type, {_TIME_TEXT.format('w')} AS start, {_TIME_TEXT.format('w + INTERVAL 6 HOURS')} AS \"end\", {_EVENT_AGG} FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w FROM events) GROUP BY event_type, w",
        "event_sessions": f"""WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events))
            SELECT user_id, {_TIME_TEXT.format('min(ts)')} AS start, {_TIME_TEXT.format('max(ts) + INTERVAL 6 HOURS')} AS "end", {_EVENT_AGG} FROM s GROUP BY user_id, k""",
        "rr_frequency": _WELCH,
        "review_outcomes": """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'manual' WHEN 2 THEN 'bad_only' ELSE 'none' END AS mode, value > 40 AS passed, CASE WHEN event_id % 5 = 0 THEN 'accepted' WHEN event_id % 5 = 1 THEN 'skipped' END AS said, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS gate FROM events),
            o AS (SELECT *, mode NOT IN ('auto', 'none') AND NOT (mode = 'bad_only' AND passed) AS human FROM e)
            SELECT event_id, CASE WHEN said IS NOT NULL THEN said WHEN human THEN 'pending' WHEN passed THEN 'accepted' ELSE 'skipped' END AS status, CASE WHEN said = 'accepted' OR said IS NULL AND human THEN 'manual' WHEN said IS NOT NULL THEN 'manual_skipped' ELSE 'auto' END AS source,
            CASE WHEN said IS NOT NULL THEN said = 'accepted' AND coalesce(gate, TRUE) ELSE passed END AS passed FROM o""",
        "suspicious_near_edges": f"WITH {_SUSPECT}, e AS (SELECT *, round(t - min(t) OVER w, 3) AS since, round(max(t) OVER w - min(t) OVER w, 3) AS total FROM sus WINDOW w AS (PARTITION BY user_id)) SELECT user_id, event_id, suspicious OR since < 24 OR since >= total - 24 AS suspicious FROM e",
        "exact_quantiles": "SELECT event_type, " + ", ".join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for n, q in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p95", 0.95))) + " FROM events GROUP BY 1",
        "redundancy_of_days": f"WITH {DAILY}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_Q(a)} AS x, {_Q(b)} AS y FROM daily WHERE {_Q(a)} IS NOT NULL AND {_Q(b)} IS NOT NULL" for a in TYPES for b in TYPES if a < b) + f") SELECT a, b, n, {r('rho')} AS rho FROM {_rho('p', 'a, b')} WHERE rho IS NOT NULL",
        "feature_rules_met": f"""WITH {RAW}, x AS (SELECT hrv_mean, morph_n, CASE WHEN hrv_validated THEN hrv_max END AS hrv_max, CASE WHEN morph_n > 1 THEN hrv_mean END AS often_gone FROM raw)
            SELECT col AS "column", {r('1 - n_valid / n_total')} AS missing_ratio, n_unique FROM {_summary('x', {c: c for c in ('hrv_mean', 'hrv_max', 'morph_n', 'often_gone')})} WHERE 1 - n_valid / n_total <= 0.5 AND n_unique >= 4""",
        "templated_names": f"WITH {RAW} SELECT user_id, {iso()} AS date, " + ", ".join(f"{r(f'max(CASE WHEN phase = {chr(39)}{t}{chr(39)} AND coalesce(hrv_validated, FALSE) THEN hrv_mean END)')} AS hrv_mean_{t}_sit" for t in TYPES[:3]) + " FROM raw GROUP BY user_id, date",
    }
    out["spearman_by_parts"] = out["spearman"]
    out["stability_by_parts"] = out["direction_stability"]
    out["report_top"] = f"SELECT * FROM ({out['report_derived_operations']}) ORDER BY \"table\", operation_id, formula LIMIT 1"
    return out
