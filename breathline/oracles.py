"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

#: Fixed values, from the definition of the filters by hand (bilinear transform with warped
#: edges): (b, a) of the second-order Butterworth band-pass of 0.1 to 0.4 Hz at 2 Hz, and of
#: the second-order low-pass of 0.1 Hz at 20 Hz.
BAND_PASS = ([0.13110643991662596, 0.0, -0.2622128798332519, 0.0, 0.13110643991662596], [1.0, -2.180657838602799, 2.0200041161835105, -1.0255108477134176, 0.27221493792500717])
#: Of the live trace at 20 Hz: first-order high-pass of 0.04 Hz, second-order band-pass of 0.1 to
#: 1 Hz, third-order one of 0.65 to 3 Hz.
LIVE_LEVEL = ([0.9937559649536571, -0.9937559649536571], [1.0, -0.9875119299073142])
LIVE_RESP = ([0.016581931669303045, 0.0, -0.03316386333860609, 0.0, 0.016581931669303045], [1.0, -3.5862398081169085, 4.846289804288024, -2.9304272168201377, 0.6704579059531743])
LIVE_HEART = (
    [0.027171780063721753, 0.0, -0.08151534019116527, 0.0, 0.08151534019116527, 0.0, -0.027171780063721753],
    [1.0, -4.097521456746443, 7.296427636512965, -7.310099388868765, 4.376412677117433, -1.4810247785375679, 0.2194733574359357],
)
#: Of the analyser at 2 Hz: second-order low-pass of 0.1 Hz, second-order band-pass of 0.1 to 0.92 Hz,
#: third-order one of 0.65 to 0.92 Hz.
FRAME_STILL = ([0.020083365564211232, 0.040166731128422464, 0.020083365564211232], [1.0, -1.561018075800718, 0.641351538057563])
FRAME_RESP = ([0.668774252767284, 0.0, -1.337548505534568, 0.0, 0.668774252767284], [1.0, 0.0872941174941284, -1.221789458279622, -0.03645123368826283, 0.4504454300560408])
FRAME_HEART = ([0.03830909878457767, 0.0, -0.11492729635373301, 0.0, 0.11492729635373301, 0.0, -0.03830909878457767], [1.0, 3.7160974178151753, 6.103919359928876, 5.785679366852963, 3.377576627642097, 1.1415748728377846, 0.17173621648207624])
LOW_PASS = ([0.00024135904904198075, 0.0004827180980839615, 0.00024135904904198075], [1.0, -1.9555782403150352, 0.9565436765112032])

S = "SELECT user_id AS session_id, event_id AS seq, epoch_us(ts)::DOUBLE / 1000 AS t_ms, value AS x FROM events"
F = "SELECT label::BIGINT AS session_id, vec_id AS seq, list_slice(embedding::DOUBLE[], 1, 32) AS re, list_slice(embedding::DOUBLE[], 33, 64) AS im FROM embeddings"
LONG = "SELECT session_id, seq, bin::INTEGER AS bin, 0.2::DOUBLE + bin * 0.02::DOUBLE AS distance_m, re[bin + 1] AS re, im[bin + 1] AS im FROM (SELECT *, unnest(range(0, 32)) AS bin FROM f)"
AXES = """SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq,
  l_discount AS ax, l_tax AS ay, l_quantity / 50 AS az, l_extendedprice / 1000 AS gx, l_quantity AS gy, l_linenumber::DOUBLE AS gz FROM lineitem"""
SERIES = "SELECT session_id * 100 + bin AS session_id, seq, re[bin + 1] AS x FROM (SELECT *, unnest(range(0, 32)) AS bin FROM f)"
MAG = "SELECT *, list_transform(range(1, 33), lambda k: sqrt(re[k] * re[k] + im[k] * im[k])) AS a FROM f"
PEAK = "SELECT *, list_position(a, list_max(a)) - 1 AS peak_bin FROM mag"
ROBUST = """g AS (SELECT *, (t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY seq)) / 1000 AS gap FROM s),
a AS (SELECT session_id, count(*) AS n, (max_by(t_ms, seq) - min_by(t_ms, seq)) / 1000 AS elapsed, median(gap) FILTER (gap > 0) AS middle, count(*) FILTER (gap <= 0) AS back FROM g GROUP BY session_id),
b AS (SELECT session_id, any_value(n) AS n, any_value(elapsed) AS elapsed, any_value(middle) AS middle, any_value(back) AS back,
  count(*) FILTER (gap > 0 AND gap < greatest(0.002, 0.2 * middle)) AS short, avg(gap) FILTER (gap > 0.25 * middle AND gap < 4 * middle) AS usual, avg(gap) FILTER (gap > 0) AS ahead
  FROM g JOIN a USING (session_id) GROUP BY session_id),
c AS (SELECT *, CASE WHEN elapsed > 0 THEN (n - 1) / elapsed ELSE 0 END AS total, coalesce((back + short)::DOUBLE / nullif(n - 1, 0), 0) AS bursty FROM b),
rate AS (SELECT session_id, bursty, CASE WHEN n < 2 THEN 20 WHEN middle IS NULL THEN CASE WHEN total > 0 THEN total ELSE 20 END
  WHEN total > 0 AND (bursty > 0.05 OR abs(1 / middle - total) / total > 0.25) THEN total ELSE 1 / coalesce(usual, ahead) END AS fs FROM c)"""
GAPPY = "SELECT session_id, seq, CASE WHEN seq % 5 = 0 OR seq % 17 = 1 THEN NULL ELSE x END AS x FROM s"
FILLED = """i AS (SELECT *, row_number() OVER w AS i FROM gappy WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
j AS (SELECT *, CASE WHEN x IS NOT NULL THEN i END AS p FROM i),
k AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS v0, last_value(p IGNORE NULLS) OVER b AS i0, first_value(x IGNORE NULLS) OVER n AS v1, first_value(p IGNORE NULLS) OVER n AS i1 FROM j
  WINDOW b AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT session_id, seq, coalesce(x, v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1, 0) AS x FROM k)"""


def despiked(source: str, limit: float, tag: str = "") -> str:
    return f"""{tag}m1 AS (SELECT session_id, median(x) AS m, count(*) AS n, avg(x) AS mean FROM {source} GROUP BY session_id),
{tag}m2 AS (SELECT session_id, median(abs(x - m)) * 1.4826 AS d FROM {source} JOIN {tag}m1 USING (session_id) GROUP BY session_id),
{tag}spiked AS (SELECT session_id, seq, CASE WHEN n < 8 THEN x - mean WHEN d > 1e-12 THEN least(greatest(x, m - {limit} * d), m + {limit} * d) ELSE x END AS x FROM {source} JOIN {tag}m1 USING (session_id) JOIN {tag}m2 USING (session_id))"""


def detrended(source: str, tag: str = "") -> str:
    return f"""{tag}n0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1.0::DOUBLE AS i FROM {source}),
{tag}line AS (SELECT session_id, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base, count(*) AS n FROM {tag}n0 GROUP BY session_id),
{tag}flat AS (SELECT session_id, seq, CASE WHEN n < 3 THEN x ELSE x - (base + slope * i) END AS x FROM {tag}n0 JOIN {tag}line USING (session_id))"""


def cleaned(source: str, tag: str = "") -> str:
    """``flat``: finite values less spikes and line."""
    return f"{despiked(source, 7.0, tag)}, {detrended(f'{tag}spiked', tag)}"


POWER = """t AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n, x - avg(x) OVER (PARTITION BY session_id) AS y FROM series),
h AS (SELECT session_id, i, n, y * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM t),
e AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM h),
power AS (SELECT session_id, k, any_value(n) AS n, sum(y * cos(2 * pi() * ((i * k) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((i * k) % n) / n)) ** 2 AS power FROM e GROUP BY session_id, k)"""


RATIO = """rz AS (SELECT *, k * 8.0::DOUBLE / n AS hz FROM power), rv AS (SELECT *, hz >= 0.1::DOUBLE AND hz <= 3.0::DOUBLE AS vital, hz >= 0.03::DOUBLE AND hz <= 3.68::DOUBLE AS wide FROM rz),
ratios AS (SELECT session_id, CASE WHEN max(n) < 16 OR count(*) FILTER (vital) = 0 OR count(*) FILTER (wide AND NOT vital) = 0 THEN 1 ELSE avg(power) FILTER (vital) / (avg(power) FILTER (wide AND NOT vital) + 1e-18) END AS ratio FROM rv GROUP BY 1)"""


def unwrapped(step: str, base: str = "0") -> str:
    return f"""WITH f AS ({F}), l AS ({LONG}), a AS (SELECT session_id, bin, seq, atan2(im, re) AS angle FROM l),
d AS (SELECT *, angle - lag(angle) OVER w AS d, first_value(angle) OVER w AS first FROM a WINDOW w AS (PARTITION BY session_id, bin ORDER BY seq))
SELECT session_id, bin, seq, round(sum(coalesce({step}, 0)) OVER (PARTITION BY session_id, bin ORDER BY seq) + {base}, 6) + 0.0 AS phase FROM d"""


MOD = "(d + pi() - floor((d + pi()) / (2 * pi())) * (2 * pi()) - pi())"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


SQL: dict[str, str] = {
    "scan_events": f"WITH s AS ({S}) SELECT * FROM s WHERE x >= 100",
    "radar_line_parse": """WITH l AS (SELECT user_id AS session_id, string_split(CASE WHEN event_id % 7 = 0 THEN concat_ws(',', event_id, value) WHEN event_id % 11 = 0 THEN concat_ws(',', 'x', value, user_id)
  ELSE concat_ws(',', event_id, user_id, value) END, ',') AS p FROM events),
q AS (SELECT session_id, list_transform(p, lambda v: try_cast(v AS DOUBLE)) AS p FROM l)
SELECT session_id, p[1] AS "Timestamp_ms", p[2] AS "RawADC", p[3] AS "Voltage_mV" FROM q WHERE len(p) = 3 AND len(list_filter(p, lambda v: v IS NULL)) = 0""",
    "imu_line_parse": f"""WITH a AS ({AXES}) SELECT session_id, seq * 50.0::DOUBLE AS "Time_ms", seq::DOUBLE AS ax, gy AS ay, gz AS az, seq::DOUBLE AS gx, gy, gz FROM a WHERE seq % 13 <> 0""",
    "json_array_roundtrip": f"WITH f AS ({F}), r AS (SELECT seq, list_transform(re, lambda x: round(x, 8)) AS b FROM f) SELECT seq, len(b)::INTEGER AS n, round(list_reduce(list_prepend(0.0::DOUBLE, b), lambda a, x: a + x), 10) + 0.0 AS total, b[4] + 0.0 AS fourth FROM r",
    "session_list_topk": "SELECT o_orderkey AS id, lower(o_orderpriority) AS sensor, strftime(o_orderdate, '%Y-%m-%d') AS started_at, o_custkey % 9 AS sample_count FROM orders ORDER BY id DESC LIMIT 500",
    "catalogue_union": """WITH o AS (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 500)
SELECT 'file' AS source, 'radar' AS sensor, c_name AS label, '' AS samples, '/raw/' || c_name AS path FROM customer
UNION ALL SELECT 'file', 'imu', s_name, '', '/raw/' || s_name FROM supplier
UNION ALL SELECT 'store', lower(o_orderpriority), strftime(o_orderdate, '%Y-%m-%d'), coalesce(nullif(o_custkey % 9, 0)::VARCHAR, ''), 'session #' || o_orderkey::VARCHAR FROM o""",
    "session_load": f'WITH s AS ({S}) SELECT session_id, seq, t_ms AS "Timestamp_ms", x * 10 AS "RawADC", x AS "Voltage_mV" FROM s WHERE session_id = 7',
    "session_join_samples": "SELECT o_orderpriority AS sensor, count(*) AS n, count(DISTINCT o_orderkey) AS n_sessions, round(avg(l_quantity), 6) + 0.0 AS mean_x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "session_stats": f"WITH s AS ({S}) SELECT session_id, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_x, round(sqrt(avg(x * x)), 6) + 0.0 AS rms_x, round(stddev_pop(x), 6) + 0.0 AS std_x, round(quantile_cont(x, 0.65), 6) + 0.0 AS p65_x FROM s GROUP BY 1",
    "latest_by_request": f"WITH s AS ({S}) SELECT session_id, seq % 5 AS request_id, max(x) AS x FROM s WHERE seq % 5 = 4 GROUP BY 1, 2",
    "rank_ports": "SELECT n_name AS device, CASE WHEN n_nationkey % 3 = 0 THEN 30 ELSE 10 END::BIGINT AS score FROM nation WHERE n_nationkey % 3 < 2",
    "oversample_average": f"""WITH s AS ({S}), r AS (SELECT session_id, floor(x * 8)::BIGINT AS raw, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 16 AS block FROM s),
g AS (SELECT session_id, block, floor(sum(raw) / 16) AS m FROM r GROUP BY 1, 2 HAVING count(*) = 16) SELECT session_id, block, m::BIGINT AS raw_adc, floor(m * 3100 / 4095)::BIGINT AS voltage_mv FROM g""",
    "oversample_calibrated": f"""WITH s AS ({S}), r AS (SELECT session_id, floor(x * 8)::BIGINT AS raw, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 16 AS block FROM s),
g AS (SELECT session_id, block, floor(sum(raw) / 16)::BIGINT AS m FROM r GROUP BY 1, 2 HAVING count(*) = 16)
SELECT session_id, block, m AS raw_adc, (CASE WHEN session_id % 3 > 0 THEN ((40000 + 7 * session_id) * m + 32768) // 65536 + 75 + session_id % 140 ELSE m * 3100 // 4095 END)::BIGINT AS voltage_mv FROM g""",
    "imu_scaling": f"""WITH a AS ({AXES}), r AS (SELECT session_id, seq, list_transform(range(0, 6), lambda j: ((seq * (2 * j + 4)) % 256) * 256 + (seq * (2 * j + 3)) % 256) AS r FROM a),
v AS (SELECT session_id, seq, list_transform(r, lambda x: CASE WHEN x >= 32768 THEN x - 65536 ELSE x END) AS r FROM r)
SELECT session_id, seq, round(r[1] * 0.061::DOUBLE / 1000, 6) + 0.0 AS ax, round(r[2] * 0.061::DOUBLE / 1000, 6) + 0.0 AS ay, round(r[3] * 0.061::DOUBLE / 1000, 6) + 0.0 AS az,
  round(r[4] * 8.75::DOUBLE / 1000, 6) + 0.0 AS gx, round(r[5] * 8.75::DOUBLE / 1000, 6) + 0.0 AS gy, round(r[6] * 8.75::DOUBLE / 1000, 6) + 0.0 AS gz FROM v""",
    "tilt_and_displacement": f"""WITH a AS ({AXES}), b AS (SELECT session_id, avg(az) AS base FROM a WHERE seq <= 20 GROUP BY 1),
m AS (SELECT session_id, (seq - 21) // 10 AS block, avg(ay) AS ay, avg(az) AS az FROM a WHERE seq > 20 GROUP BY 1, 2 HAVING count(*) = 10)
SELECT session_id, block, round(az - base, 6) + 0.0 AS displacement, round(degrees(atan2(ay, az)), 6) + 0.0 AS tilt_deg FROM m JOIN b USING (session_id)""",
    "sample_rate_simple": f"""WITH s AS ({S}), g AS (SELECT *, (t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY seq)) / 1000 AS gap FROM s)
SELECT session_id, round(CASE WHEN max(t_ms) > min(t_ms) THEN (count(*) - 1) / ((max(t_ms) - min(t_ms)) / 1000) ELSE 500 END, 12) + 0.0 AS fs_all,
  round(CASE WHEN max_by(t_ms, seq) > min_by(t_ms, seq) THEN (count(*) - 1) / ((max_by(t_ms, seq) - min_by(t_ms, seq)) / 1000) ELSE 100 END, 12) + 0.0 AS fs_stored,
  round(coalesce(1 / avg(gap) FILTER (gap > 0), 500), 12) + 0.0 AS fs_positive FROM g GROUP BY 1""",
    "sample_rate_robust": f"WITH s AS ({S}), {ROBUST} SELECT session_id, round(fs, 12) + 0.0 AS fs, round(bursty, 6) + 0.0 AS bursty FROM rate",
    "even_time_axis": f"""WITH s AS ({S}), {ROBUST},
z AS (SELECT session_id, seq, fs, row_number() OVER w - 1 AS i, count(*) OVER p AS n, avg((gap <= 0)::INT) OVER p AS back, sum(coalesce(gap > 0 AND gap < greatest(0.002, 0.2 * middle), false)::INT) OVER p / (count(*) OVER p - 1) AS short,
  (t_ms - first_value(t_ms) OVER w) / 1000 AS wall, (max_by(t_ms, seq) OVER p - min_by(t_ms, seq) OVER p) / 1000 AS span FROM g JOIN a USING (session_id) JOIN rate USING (session_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY seq), p AS (PARTITION BY session_id))
SELECT session_id, seq, round(CASE WHEN n >= 3 AND fs > 0 AND (back > 0.05 OR short > 0.05) AND span > 0 THEN i / fs * (span / greatest((n - 1) / fs, 1e-9)) ELSE wall END, 3) + 0.0 AS time_s FROM z""",
    "time_rebase": f"WITH s AS ({S}) SELECT session_id, seq, round((t_ms - min(t_ms) OVER (PARTITION BY session_id)) / 1000, 6) + 0.0 AS since_min, round((t_ms - first_value(t_ms) OVER (PARTITION BY session_id ORDER BY seq)) / 1000, 6) + 0.0 AS since_first FROM s",
    "trailing_window": f"WITH s AS ({S}), l AS (SELECT session_id, max_by(t_ms, seq) AS last FROM s GROUP BY 1) SELECT session_id, seq, x FROM s JOIN l USING (session_id) WHERE t_ms >= last - 432000000",
    "analysis_cutoff": f"WITH s AS ({S}), l AS (SELECT session_id, max(x) >= 489 AS late, max(seq) AS last FROM s GROUP BY 1) SELECT session_id, seq, x FROM s JOIN l USING (session_id) WHERE x >= 489 OR NOT late AND seq = last",
    "tail_n": f"WITH s AS ({S}) SELECT session_id, seq, x FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 12",
    "plot_range": f"""WITH s AS ({S}), i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM s),
t AS (SELECT *, CASE WHEN n > 20 THEN least(greatest(n // 20, 1), 50) ELSE 0 END AS trim FROM i), r AS (SELECT session_id, min(x) AS lo, max(x) AS hi FROM t WHERE i > trim AND i <= n - trim GROUP BY 1)
SELECT session_id, round((lo + hi) / 2 - 0.65::DOUBLE * greatest(hi - lo, 1e-3), 6) + 0.0 AS y_min, round((lo + hi) / 2 + 0.65::DOUBLE * greatest(hi - lo, 1e-3), 6) + 0.0 AS y_max FROM r""",
    "running_integral": f"""WITH a AS ({AXES}), b AS (SELECT session_id, seq, seq * 50.0::DOUBLE / 1000 AS t, ax FROM a),
c AS (SELECT *, coalesce((ax + lag(ax) OVER w) / 2 * (t - lag(t) OVER w), 0) AS d FROM b WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
v AS (SELECT *, sum(d) OVER (PARTITION BY session_id ORDER BY seq) AS velocity FROM c),
e AS (SELECT *, coalesce((velocity + lag(velocity) OVER w) / 2 * (t - lag(t) OVER w), 0) AS d2 FROM v WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, seq, round(velocity, 9) + 0.0 AS velocity, round(sum(d2) OVER (PARTITION BY session_id ORDER BY seq), 9) + 0.0 AS path FROM e""",
    "interp_gaps": f"WITH s AS ({S}), gappy AS ({GAPPY}), {FILLED} SELECT session_id, seq, round(x, 6) + 0.0 AS x FROM filled",
    "despike_mad": f"WITH s AS ({S}), {despiked('s', 1.0)} SELECT session_id, seq, round(x, 6) + 0.0 AS x FROM spiked",
    "detrend_linear": f"WITH s AS ({S}), {detrended('s')} SELECT session_id, seq, round(x, 6) + 0.0 AS x FROM flat",
    "clean_signal": f"WITH s AS ({S}), gappy AS ({GAPPY}), {FILLED}, {despiked('filled', 7.0)}, {detrended('spiked')} SELECT session_id, seq, round(x, 6) + 0.0 AS x FROM flat",
    "frame_peak": f"""WITH f AS ({F}), mag AS ({MAG}), p AS ({PEAK})
SELECT seq, peak_bin::INTEGER AS peak_bin, round(0.2::DOUBLE + peak_bin * 0.02::DOUBLE, 6) + 0.0 AS peak_distance_m, round(list_max(a), 6) + 0.0 AS peak_amplitude, round(atan2(im[peak_bin + 1], re[peak_bin + 1]), 6) + 0.0 AS peak_phase_rad, round(list_avg(a), 6) + 0.0 AS mean_amplitude FROM p""",
    "complex_mean": f"WITH f AS ({F}), l AS ({LONG}) SELECT session_id, bin, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM l GROUP BY 1, 2",
    "vector_magnitude": f"WITH a AS ({AXES}) SELECT session_id, seq, round(sqrt(ax * ax + ay * ay + az * az), 6) + 0.0 AS accel, round(sqrt(gx * gx + gy * gy + gz * gz), 6) + 0.0 AS gyro FROM a",
    "nearest_bin": f"WITH f AS ({F}), l AS ({LONG}) SELECT session_id, seq, bin FROM l QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY abs(distance_m - 0.45::DOUBLE), bin) = 1",
    "near_range_mask": f"WITH f AS ({F}), l AS ({LONG}) SELECT session_id, count(*) AS n FROM l WHERE distance_m >= 0.28::DOUBLE GROUP BY 1",
    "gate_bins": f"""WITH f AS ({F}), l AS ({LONG}), mag AS ({MAG}), p AS ({PEAK})
SELECT session_id, l.seq, bin, round(l.re, 6) + 0.0 AS re FROM l JOIN p USING (session_id, seq) WHERE abs(distance_m - (0.2::DOUBLE + peak_bin * 0.02::DOUBLE)) <= 0.05001::DOUBLE""",
    "knn_bins": f"""WITH f AS ({F}), l AS ({LONG}), mag AS ({MAG}), p AS ({PEAK})
SELECT session_id, seq, bin FROM l JOIN p USING (session_id, seq) QUALIFY row_number() OVER (PARTITION BY session_id, seq ORDER BY abs(bin - peak_bin), bin) <= 3""",
    "bin_median": f"WITH f AS ({F}), l AS ({LONG}) SELECT session_id, bin, round(median(sqrt(re * re + im * im)), 6) + 0.0 AS median_amplitude FROM l GROUP BY 1, 2",
    "target_select": f"""WITH f AS ({F}), l AS ({LONG}), mag AS ({MAG}), p AS ({PEAK}), series AS ({SERIES}), {POWER}, {RATIO},
b AS (SELECT l.session_id, bin, distance_m, distance_m >= 0.28::DOUBLE AS far, median(sqrt(re * re + im * im)) AS a, any_value(ratio) AS ratio FROM l JOIN ratios ON ratios.session_id = l.session_id * 100 + bin GROUP BY 1, 2, 3),
c AS (SELECT *, CASE WHEN max(far::INT) OVER (PARTITION BY session_id) = 1 THEN far ELSE true END AS searched FROM b),
lp AS (SELECT session_id, max_by(0.2::DOUBLE + peak_bin * 0.02::DOUBLE, seq) AS peak_m FROM p GROUP BY 1),
fl AS (SELECT session_id, median(a) + 1e-12 AS floor FROM c WHERE searched GROUP BY 1),
d AS (SELECT session_id, bin, searched, peak_m, distance_m, CASE WHEN searched THEN a / floor ELSE 0 END + 0.15::DOUBLE * least(greatest(ratio, 0), 5) AS score FROM c JOIN lp USING (session_id) JOIN fl USING (session_id)),
best AS (SELECT *, max(score) OVER (PARTITION BY session_id) AS best, first_value(bin) OVER (PARTITION BY session_id ORDER BY abs(distance_m - peak_m), bin) AS near FROM d),
g AS (SELECT session_id, bin, score + CASE WHEN bin = near AND searched AND peak_m > 0 THEN 0.5 * best ELSE 0 END AS score FROM best)
SELECT session_id, bin AS target_bin, round(score, 6) + 0.0 AS score FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, bin) = 1""",
    "candidate_weights": f"""WITH f AS ({F}), l AS ({LONG}), b AS (SELECT session_id, bin, median(sqrt(re * re + im * im)) AS a FROM l WHERE bin BETWEEN 8 AND 10 GROUP BY 1, 2)
SELECT session_id, bin, round(a / (sum(a) OVER (PARTITION BY session_id) + 1e-12), 6) + 0.0 AS weight FROM b""",
    "session_plan": """WITH c AS (SELECT p_partkey, 0.2::DOUBLE AS s, 0.3::DOUBLE + p_size::DOUBLE / 25 AS e, 1 + p_partkey % 32 AS sweeps, 5.0::DOUBLE + p_size AS hz FROM part),
d AS (SELECT *, least(floor(921600 / (48 * greatest(hz, 1))), 4095)::BIGINT AS cap, greatest(e - s, 0.0025::DOUBLE) AS span FROM c),
g AS (SELECT *, greatest(1, ceil(span / (0.0025::DOUBLE * (greatest(cap // sweeps, 2) - 1)))) AS least_step FROM d),
h AS (SELECT *, CASE WHEN least_step <= 4 THEN least_step WHEN least_step <= 6 THEN 6 WHEN least_step <= 8 THEN 8 WHEN least_step <= 12 THEN 12 WHEN least_step <= 24 THEN 24 ELSE ceil(least_step / 24) * 24 END::BIGINT AS step_length FROM g),
p AS (SELECT *, greatest(ceil(span / (0.0025::DOUBLE * step_length)) + 1, 2)::BIGINT AS num_points, greatest(round(s / 0.0025::DOUBLE), 0)::BIGINT AS start_point FROM h)
SELECT p_partkey, start_point, step_length, num_points, greatest(least(sweeps, greatest(cap // num_points, 1)), 1)::BIGINT AS sweeps_per_frame, round((start_point + (num_points - 1) * step_length) * 0.0025::DOUBLE, 6) + 0.0 AS planned_end_m FROM p""",
    "circle_fit": f"""WITH f AS ({F}), l AS ({LONG}), m AS (SELECT *, avg(re) OVER w AS mx, avg(im) OVER w AS my FROM l WINDOW w AS (PARTITION BY session_id, bin)),
u AS (SELECT *, re - mx AS u, im - my AS v FROM m), q AS (SELECT *, u * u + v * v AS r2 FROM u),
s AS (SELECT session_id, bin, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u * u) AS suu, sum(v * v) AS svv, sum(u * v) AS suv, sum(u * r2) AS su, sum(v * r2) AS sv, avg(r2) AS r2, median(sqrt(re * re + im * im)) AS typical FROM q GROUP BY 1, 2),
d AS (SELECT *, suu * svv - suv * suv AS det FROM s),
c AS (SELECT *, CASE WHEN det > 1e-12 THEN (svv * su - suv * sv) / det / 2 ELSE 0 END AS cu, CASE WHEN det > 1e-12 THEN (suu * sv - suv * su) / det / 2 ELSE 0 END AS cv FROM d),
r AS (SELECT *, sqrt(greatest(cu * cu + cv * cv + CASE WHEN det > 1e-12 THEN r2 ELSE 0 END, 0)) AS radius, mx + cu AS cx, my + cv AS cy FROM c),
o AS (SELECT session_id, bin, sqrt(avg((sqrt((re - cx) * (re - cx) + (im - cy) * (im - cy)) - radius) ** 2)) AS off FROM l JOIN r USING (session_id, bin) GROUP BY 1, 2),
z AS (SELECT *, off / (radius + 1e-12) AS rms FROM r JOIN o USING (session_id, bin)),
y AS (SELECT *, n >= 8 AND det > 1e-12 AND radius > 0.05 * typical AND radius < 20 * typical AND rms < 0.45 AS plausible FROM z)
SELECT session_id, bin, {rounded('cx', 'cy', 'radius', 'rms')}, round(CASE WHEN plausible THEN least(greatest(1 - rms / 0.45::DOUBLE, 0), 1) ELSE 0.25 END, 6) + 0.0 AS quality, plausible FROM y""",
    "covariance": f"WITH a AS ({AXES}) SELECT session_id, " + ", ".join(f"round(covar_samp({p}, {q}), 6) + 0.0 AS cov_{p}_{q}" for p, q in (("ax", "ax"), ("ax", "ay"), ("ax", "az"), ("ay", "ay"), ("ay", "az"), ("az", "az"))) + " FROM a GROUP BY 1",
    "presence_quality": f"""WITH s AS ({S}), a AS (SELECT seq, 1 + x / 500 AS amp, x % 6 AS ratio, seq % 4 AS bins, x % 20 AS rc, x % 40 AS hc FROM s),
b AS (SELECT *, least(greatest((amp - 1) * 35 + least(bins, 5) * 6 + least(greatest(ratio, 0), 5) * 10, 0), 100) AS score FROM a),
c AS (SELECT *, score >= 20 AND (amp >= 1.08::DOUBLE OR ratio >= 1.30::DOUBLE) AS present FROM b)
SELECT seq, round(score, 6) + 0.0 AS score, present, round(least(greatest(0.18::DOUBLE * ln(1 + greatest(amp - 1, 0)) + 0.22::DOUBLE * least(rc / 5, 1) + 0.22::DOUBLE * least(hc / 5, 1) + 0.20::DOUBLE * least(greatest(ratio, 0) / 4, 1) + CASE WHEN present THEN 0.18::DOUBLE ELSE 0 END, 0), 1), 6) + 0.0 AS quality FROM c""",
    "band_limits": f"""WITH s AS ({S}), a AS (SELECT seq, x / 100 AS low, x / 100 + (seq % 5)::DOUBLE / 10 AS high, x / 50 AS fs, x / 400 AS resp, x / 150 AS heart FROM s),
b AS (SELECT *, greatest(low, 0.65::DOUBLE) AS lo, least(high, 3.0::DOUBLE) AS hi, least(1.0::DOUBLE, 0.5::DOUBLE * fs * 0.92::DOUBLE) AS top FROM a),
c AS (SELECT *, hi - lo < 0.8::DOUBLE AS narrow, least(greatest((lo + hi) / 2, 1.05::DOUBLE), 2.6::DOUBLE) AS mid FROM b),
d AS (SELECT *, fs > 0 AND top - 0.1::DOUBLE >= 0.02::DOUBLE AS ok FROM c)
SELECT seq, round(CASE WHEN narrow THEN greatest(0.65::DOUBLE, mid - 0.4::DOUBLE) ELSE lo END, 6) + 0.0 AS low, round(CASE WHEN narrow THEN least(3.0::DOUBLE, mid + 0.4::DOUBLE) ELSE hi END, 6) + 0.0 AS high,
  round(CASE WHEN ok THEN 0.1::DOUBLE END, 6) + 0.0 AS band_low, round(CASE WHEN ok THEN top END, 6) + 0.0 AS band_high,
  heart > 0 AND resp > 0 AND len(list_filter(range(2, 8), lambda k: k * resp >= 0.5525::DOUBLE AND k * resp <= 3.15::DOUBLE AND abs(heart - k * resp) <= greatest(0.03::DOUBLE, 0.02::DOUBLE * (k * resp)))) > 0 AS near FROM d""",
    "target_and_gate": f"""WITH s AS ({S}), a AS (SELECT seq, CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN x / 100 END AS a, (seq % 2) * 0.5::DOUBLE AS b, trunc(x % 40)::INT AS i0, trunc(x % 37)::INT AS i1 FROM s),
b AS (SELECT seq, coalesce(nullif(a, 0), nullif(b, 0), 0.7::DOUBLE) AS target, least(greatest(i0, 0), 31) AS start, i1 FROM a),
c AS (SELECT *, least(greatest(i1, start + 1), 32) AS stop FROM b)
SELECT seq, round(target, 6) + 0.0 AS target, start::INT AS start, stop::INT AS stop, least(greatest((start + stop - 1) // 2, 0), 31)::INT AS centre, round(greatest(abs(target - start * 0.02::DOUBLE), abs(stop * 0.02::DOUBLE - target), 0.0025::DOUBLE), 6) + 0.0 AS half_width FROM c""",
    "rates_and_speed": f"WITH s AS ({S}) SELECT seq, round(x / 70.16::DOUBLE, 6) + 0.0 AS speed_mps, round(x / 100 * 60, 6) + 0.0 AS bpm FROM s",
    "unwrap_live": unwrapped("CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END"),
    "unwrap_mod": unwrapped(MOD),
    "unwrap": unwrapped(f"CASE WHEN abs(d) < pi() THEN d WHEN {MOD} = -pi() AND d > 0 THEN pi() ELSE {MOD} END", "first"),
    "differential_phase": f"""WITH f AS ({F}), l AS ({LONG}), u AS (SELECT session_id, bin, seq, re / (sqrt(re * re + im * im) + 1e-12) AS a, im / (sqrt(re * re + im * im) + 1e-12) AS b FROM l),
p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, row_number() OVER w - 1.0::DOUBLE AS i FROM u WINDOW w AS (PARTITION BY session_id, bin ORDER BY seq)),
t AS (SELECT session_id, bin, seq, i, sum(coalesce(atan2(b * pa - a * pb, a * pa + b * pb), 0)) OVER (PARTITION BY session_id, bin ORDER BY seq) AS x FROM p),
line AS (SELECT session_id, bin, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base FROM t GROUP BY 1, 2)
SELECT session_id, bin, seq, round(x - coalesce(base + slope * i, 0), 6) + 0.0 AS phase FROM t JOIN line USING (session_id, bin)""",
    "dft_band_peak": f"WITH f AS ({F}), series AS ({SERIES}), {POWER}, z AS (SELECT *, k * 2.0::DOUBLE / n AS hz FROM power) SELECT session_id, round(hz, 6) + 0.0 AS peak_hz, round(power, 6) + 0.0 AS power FROM z WHERE hz BETWEEN 0.1::DOUBLE AND 1.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY power DESC, k) = 1",
    "band_energy_ratio": f"WITH f AS ({F}), series AS ({SERIES}), {POWER}, {RATIO} SELECT session_id, round(ratio, 6) + 0.0 AS energy_ratio FROM ratios",
    "acf_peak": f"""WITH f AS ({F}), series AS ({SERIES}), {detrended('series')}, d AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, x FROM flat),
en AS (SELECT session_id, sum(x * x) + 1e-12 AS e FROM d GROUP BY 1),
c AS (SELECT p.session_id, q.i - p.i AS lag, sum(p.x * q.x) AS s FROM d p JOIN d q ON p.session_id = q.session_id AND q.i - p.i BETWEEN 1 AND 13 GROUP BY 1, 2),
a AS (SELECT session_id, lag, s / e AS acf FROM c JOIN en USING (session_id)), n AS (SELECT *, lag(acf) OVER w AS y0, lead(acf) OVER w AS y2 FROM a WINDOW w AS (PARTITION BY session_id ORDER BY lag)),
b AS (SELECT *, coalesce(acf > y0 AND acf > y2, false) AS top FROM n WHERE lag BETWEEN 2 AND 12 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY coalesce(acf > y0 AND acf > y2, false) DESC, acf DESC, lag) = 1)
SELECT session_id, lag::INTEGER AS lag, round(acf, 6) + 0.0 AS acf, round(lag + coalesce(CASE WHEN abs(y0 - 2 * acf + y2) > 1e-12 THEN 0.5 * (y0 - y2) / (y0 - 2 * acf + y2) ELSE 0 END, 0), 6) + 0.0 AS refined_lag FROM b""",
    "harmonic_notch": f"WITH f AS ({F}), series AS ({SERIES}), {POWER}, z AS (SELECT *, k * 2.0::DOUBLE / n AS hz FROM power) SELECT session_id, k::INTEGER AS k, round(power * (1 - 0.5 * exp(-0.5 * ((hz - 0.25) / 0.02) ** 2)) * (1 - 0.5 * exp(-0.5 * ((hz - 0.5) / 0.02) ** 2)), 6) + 0.0 AS notched FROM z",
    "smooth_bins": f"""WITH f AS ({F}), series AS ({SERIES}) SELECT session_id, seq, round(0.12::DOUBLE * coalesce(lag(x, 2) OVER w, 0) + 0.20::DOUBLE * coalesce(lag(x, 1) OVER w, 0) + 0.36::DOUBLE * x + 0.20::DOUBLE * coalesce(lead(x, 1) OVER w, 0) + 0.12::DOUBLE * coalesce(lead(x, 2) OVER w, 0), 6) + 0.0 AS smooth
FROM series WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "local_maxima": f"WITH f AS ({F}), series AS ({SERIES}) SELECT session_id, seq, round(x, 6) + 0.0 AS x FROM series WINDOW w AS (PARTITION BY session_id ORDER BY seq) QUALIFY x > lag(x) OVER w AND x > lead(x) OVER w",
    "latest_profile": f"""WITH f AS ({F}), l AS ({LONG}), m AS (SELECT session_id, max(seq) AS seq FROM l GROUP BY 1),
a AS (SELECT session_id, bin, distance_m, distance_m >= 0.28::DOUBLE AS far, sqrt(re * re + im * im) AS amplitude FROM l JOIN m USING (session_id, seq))
SELECT session_id, bin, round(distance_m, 6) + 0.0 AS distance_m, round(amplitude, 6) + 0.0 AS amplitude, round(max(amplitude) OVER (PARTITION BY session_id), 6) + 0.0 AS top_amplitude FROM a
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY far DESC, amplitude DESC, bin) = 1""",
    "raw_iq_trace": f"""WITH f AS ({F}), l AS ({LONG}), s AS (SELECT session_id, seq, seq * 50.0::DOUBLE AS t_ms, re, im, atan2(im, re) AS angle FROM l WHERE bin = 9),
r AS (SELECT * FROM s QUALIFY t_ms >= max(t_ms) OVER (PARTITION BY session_id) - 10000),
d AS (SELECT *, angle - lag(angle) OVER w AS d, first_value(angle) OVER w AS first, t_ms - first_value(t_ms) OVER w AS ms, count(*) OVER (PARTITION BY session_id) AS n FROM r WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
p AS (SELECT *, first + sum(coalesce(CASE WHEN abs(d) < pi() THEN d WHEN {MOD} = -pi() AND d > 0 THEN pi() ELSE {MOD} END, 0)) OVER (PARTITION BY session_id ORDER BY seq) AS phase FROM d)
SELECT session_id, seq, round(ms / 1000, 6) + 0.0 AS time_s, round(re, 6) + 0.0 AS raw_i, round(im, 6) + 0.0 AS raw_q, round(phase - median(phase) OVER (PARTITION BY session_id), 6) + 0.0 AS raw_phase FROM p WHERE n >= 2""",
    "ema_amplitude": f"""WITH RECURSIVE s AS ({S}), i AS MATERIALIZED (SELECT session_id, x, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM s),
r AS (SELECT session_id, i, x AS e FROM i WHERE i = 1 UNION ALL SELECT i.session_id, i.i, exp(-1.0::DOUBLE / 40) * e + (1 - exp(-1.0::DOUBLE / 40)) * x FROM r JOIN i ON i.session_id = r.session_id AND i.i = r.i + 1)
SELECT session_id, round(max_by(e, i), 6) + 0.0 AS ema FROM r GROUP BY 1""",
}


def recursion(source: str, out: str, b: list[float], a: list[float], settled: bool = False) -> str:
    """The difference equation over ``source`` (session_id, i from 1, x), from rest or from an endless first value.

    A band-pass gives 0 for a constant, so its settled past has outputs of 0.
    """
    n = len(b)
    y = " + ".join([f"({b[0]!r}::DOUBLE) * i.x", *(f"({b[k]!r}::DOUBLE) * x{k} - ({a[k]!r}::DOUBLE) * y{k}" for k in range(1, n))])
    columns = ", ".join(f"x{k}, y{k}" for k in range(1, n))
    past = ", ".join(("x" if settled else "0::DOUBLE") + ", 0::DOUBLE" for _ in range(1, n))
    move = ", ".join(["i.x", f"{y}", *(f"x{k - 1}, y{k - 1}" for k in range(2, n))])
    return f"""{out}_r(session_id, i, {columns}) AS (SELECT session_id, 0::BIGINT, {past} FROM {source} WHERE i = 1
UNION ALL SELECT i.session_id, i.i, {move} FROM {out}_r r JOIN {source} i ON i.session_id = r.session_id AND i.i = r.i + 1),
{out} AS MATERIALIZED (SELECT session_id, i, y1 AS y FROM {out}_r WHERE i > 0)"""


def numbered(source: str) -> str:
    return f"SELECT session_id, seq, x, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM {source}"


_Y = "SELECT session_id, seq, round(y, 6) + 0.0 AS y FROM y JOIN i USING (session_id, i)"
SQL["bandpass_causal"] = f"WITH RECURSIVE s AS ({S}), i AS MATERIALIZED ({numbered('s')}), {recursion('i', 'y', *BAND_PASS)} {_Y}"
SQL["bandpass_causal_clean"] = f"WITH RECURSIVE s AS ({S}), {cleaned('s')}, i AS MATERIALIZED ({numbered('flat')}), {recursion('i', 'y', *BAND_PASS)} {_Y}"
#: Odd extension by 15 rows, forward and back. Sessions have 20 rows or more.
SQL["bandpass_zero_phase"] = f"""WITH RECURSIVE s AS ({S}), {cleaned('s')}, c AS MATERIALIZED ({numbered('flat')}),
ends AS (SELECT session_id, count(*) AS n, min_by(x, i) AS a, max_by(x, i) AS z FROM c GROUP BY 1),
e AS MATERIALIZED (SELECT session_id, i + 15 AS i, x FROM c UNION ALL SELECT session_id, 17 - i, 2 * a - x FROM c JOIN ends USING (session_id) WHERE i BETWEEN 2 AND 16
  UNION ALL SELECT session_id, 2 * n - i + 15, 2 * z - x FROM c JOIN ends USING (session_id) WHERE i BETWEEN n - 15 AND n - 1),
{recursion('e', 'f', *BAND_PASS, settled=True)}, t AS MATERIALIZED (SELECT session_id, n + 31 - i AS i, y AS x FROM f JOIN ends USING (session_id)),
{recursion('t', 'g', *BAND_PASS, settled=True)}
SELECT session_id, seq, round(y, 6) + 0.0 AS y FROM c JOIN ends USING (session_id) JOIN g USING (session_id) WHERE g.i = ends.n + 31 - (c.i + 15)"""
SQL["static_clutter"] = f"""WITH RECURSIVE f AS ({F}), p AS (SELECT session_id, seq, unnest(range(0, 64)) AS k, list_concat(re, im) AS v FROM f),
s AS (SELECT session_id * 100 + k AS session_id, seq, v[k + 1] AS x FROM p), i AS MATERIALIZED ({numbered('s')}), {recursion('i', 'y', *LOW_PASS)},
z AS (SELECT session_id // 100 AS session_id, session_id % 100 AS k, seq, CASE WHEN count(*) OVER (PARTITION BY session_id) < 4 THEN 0 ELSE y END AS y FROM y JOIN i USING (session_id, i))
SELECT session_id, seq, (k % 32)::INTEGER AS bin, round(max(y) FILTER (k < 32), 6) + 0.0 AS re, round(max(y) FILTER (k >= 32), 6) + 0.0 AS im FROM z GROUP BY session_id, seq, k % 32"""


# -- spectra of whole series -----------------------------------------------------------


def welch(low: float, high: float) -> str:
    """``inside``: Welch power of ``flat`` within a band at the rates of ``rate``; segments of 24 s, 64 rows at least."""
    return f"""b AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, x, count(*) OVER (PARTITION BY session_id) AS n FROM flat),
p AS (SELECT session_id, any_value(n) AS n, any_value(fs) AS fs, least(any_value(n), greatest(64, round_even(any_value(fs) * least(24, any_value(n) / any_value(fs)), 0)))::BIGINT AS size FROM b JOIN rate USING (session_id) GROUP BY 1),
g AS (SELECT *, unnest(range(0, n - size + 1, size - size // 2)) AS seg FROM p),
h AS (SELECT g.session_id, seg, size, fs, g.n, i - seg AS j, (x - avg(x) OVER (PARTITION BY g.session_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * (i - seg) / size)) AS y FROM g JOIN b ON b.session_id = g.session_id AND i >= seg AND i < seg + size),
k AS (SELECT *, unnest(range(0, size // 2 + 1)) AS k FROM h),
q AS (SELECT session_id, seg, k, any_value(size) AS size, any_value(fs) AS fs, any_value(n) AS n, (sum(y * cos(2 * pi() * ((j * k) % size) / size)) ** 2 + sum(y * sin(2 * pi() * ((j * k) % size) / size)) ** 2) / (any_value(size) / 2) ** 2 AS p FROM k GROUP BY 1, 2, 3),
inside AS (SELECT session_id, k, any_value(size) AS size, any_value(fs) AS fs, k * any_value(fs) / any_value(size) AS hz, avg(p) * CASE WHEN k = 0 OR 2 * k = any_value(size) THEN 1 ELSE 2 END AS p FROM q WHERE n >= 16 AND fs > 0
  GROUP BY 1, 2 HAVING hz >= greatest({low!r}::DOUBLE, any_value(fs) / any_value(n)) AND hz <= least({high!r}::DOUBLE, 0.46::DOUBLE * any_value(fs)))"""


def vertex(a: str, b: str, c: str) -> str:
    return f"CASE WHEN abs({a} - 2 * {b} + {c}) > 1e-12 THEN 0.5 * ({a} - {c}) / ({a} - 2 * {b} + {c}) ELSE 0 END"


def series_peaks(low: float, high: float, rejected: bool = False) -> str:
    """``found``: Welch, autocorrelation, fused and weighted peaks of ``s`` at the rates of ``rate``.

    ``rejected``: a table of that name has a list hs of rates by session; the fused peak keeps off them.
    """
    notch = "(1 - 0.5 * exp(-0.5 * ((inside.hz - h) / greatest(0.02::DOUBLE, 0.015::DOUBLE * h)) ** 2))"
    score = f"coalesce(list_reduce(list_prepend(1.0::DOUBLE, list_transform(hs, lambda h: {notch})), lambda a, c: a * c), 1) * p" if rejected else "p"
    kept = "len(list_filter(hs, lambda h: abs(lag_hz - h) <= greatest(0.04::DOUBLE, 0.03::DOUBLE * h))) = 0" if rejected else "true"
    rejects = "LEFT JOIN rejected USING (session_id)" if rejected else ""
    lo, hi = f"greatest({low!r}::DOUBLE, fs / n)", f"least({high!r}::DOUBLE, 0.46::DOUBLE * fs)"
    return f"""{cleaned('s')}, {welch(low, high)},
wc AS (SELECT inside.*, {score} AS score FROM inside {rejects}),
wn AS (SELECT *, lag(ln(score + 1e-24)) OVER w AS y0, ln(score + 1e-24) AS y1, lead(ln(score + 1e-24)) OVER w AS y2, median(p) OVER (PARTITION BY session_id) AS mid FROM wc WINDOW w AS (PARTITION BY session_id ORDER BY k)),
wt AS (SELECT * FROM wn QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, k) = 1),
we AS (SELECT session_id, CASE WHEN y0 IS NULL OR y2 IS NULL THEN hz ELSE least(greatest(hz + least(greatest({vertex('y0', 'y1', 'y2')}, -0.5), 0.5) * wt.fs / wt.size, greatest({low!r}::DOUBLE, p.fs / n)), least({high!r}::DOUBLE, 0.46::DOUBLE * p.fs)) END AS hz, wt.p / (mid + 1e-18) AS conf FROM wt JOIN p USING (session_id)),
lr AS (SELECT session_id, n, fs, greatest(1, floor(fs / {high!r}::DOUBLE))::BIGINT AS first, least(n - 2, ceil(fs / {low!r}::DOUBLE))::BIGINT AS last FROM p WHERE n >= 12 AND fs > 0),
ac AS (SELECT u.session_id, v.i - u.i AS l, sum(u.x * v.x) AS s FROM b u JOIN lr USING (session_id) JOIN b v ON v.session_id = u.session_id AND v.i - u.i BETWEEN 0 AND last + 1 WHERE first < last GROUP BY 1, 2),
an AS (SELECT session_id, l, s / (max(s) FILTER (l = 0) OVER (PARTITION BY session_id) + 1e-12) AS r FROM ac),
ap AS (SELECT *, lag(r) OVER w AS y0, lead(r) OVER w AS y2 FROM an WINDOW w AS (PARTITION BY session_id ORDER BY l)),
lt AS (SELECT * FROM ap JOIN lr USING (session_id) WHERE l BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY (r > y0 AND r > y2)::INT DESC, r DESC, l) = 1),
le AS (SELECT session_id, fs / (l + {vertex('y0', 'r', 'y2')}) AS hz, r AS conf FROM lt),
fp AS (SELECT session_id, n, fs, least(n, round_even(fs * 20, 0))::BIGINT AS m FROM p WHERE n >= 16 AND n / fs >= 20),
tail AS (SELECT session_id, seq, x FROM s JOIN fp USING (session_id) WHERE m >= 16 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= m),
{cleaned('tail', 't')},
ti AS (SELECT session_id, m, fs, n, 2 ** (floor(log2(m)) + 1) AS size, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, x FROM tflat JOIN fp USING (session_id)),
th AS (SELECT session_id, size::BIGINT AS size, fs, n, i, x * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / (m - 1))) AS y FROM ti),
tk AS (SELECT *, unnest(range(0, size // 2 + 1)) AS k FROM th),
ta AS (SELECT session_id, k, any_value(size) AS size, any_value(fs) AS fs, any_value(n) AS n, sqrt(sum(y * cos(2 * pi() * ((i * k) % size) / size)) ** 2 + sum(y * sin(2 * pi() * ((i * k) % size) / size)) ** 2) AS p FROM tk GROUP BY 1, 2),
tn AS (SELECT *, k * fs / size AS hz, lag(p) OVER w AS y0, lead(p) OVER w AS y2 FROM ta WINDOW w AS (PARTITION BY session_id ORDER BY k)),
tb AS (SELECT *, median(p) OVER (PARTITION BY session_id) AS mid FROM tn WHERE hz >= {lo} AND hz <= {hi}),
tt AS (SELECT * FROM tb QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p DESC, k) = 1),
te AS (SELECT session_id, CASE WHEN y0 IS NULL OR y2 IS NULL THEN hz ELSE least(greatest(hz + ({vertex('y0', 'p', 'y2')}) * fs / size, {lo}), {hi}) END AS hz, p / (mid + 1e-18) AS conf FROM tt),
al AS (SELECT p.session_id, coalesce(we.hz, 0) AS welch_hz, coalesce(we.conf, 0) AS welch_confidence, coalesce(le.hz, 0) AS lag_hz, coalesce(le.conf, 0) AS lag_confidence, coalesce(te.hz, 0) AS weighted_hz, coalesce(te.conf, 0) AS weighted_confidence FROM p LEFT JOIN we USING (session_id) LEFT JOIN le USING (session_id) LEFT JOIN te USING (session_id)),
ag AS (SELECT *, {kept} AND lag_hz > 0 AND lag_confidence >= 0.22::DOUBLE AND welch_hz > 0 AND welch_confidence >= 2 AND abs(lag_hz - welch_hz) <= 0.25 AS agrees FROM al {rejects}),
found AS (SELECT *, CASE WHEN agrees THEN lag_hz ELSE welch_hz END AS fused_hz, CASE WHEN agrees THEN greatest(welch_confidence, 10 * lag_confidence) ELSE welch_confidence END AS fused_confidence FROM ag)"""


PEAKS = [f"{n}_{m}" for n in ("welch", "lag", "fused", "weighted") for m in ("hz", "confidence")]
TWO = "rate AS (SELECT DISTINCT session_id, 2.0::DOUBLE AS fs FROM s)"
QUICK = f"SELECT session_id, seq, t_ms / 86400 AS t_ms, x FROM ({S})"
SQL["spectrum_peaks"] = f"WITH s AS ({S}), {TWO}, {series_peaks(0.1, 0.7)} SELECT session_id, {rounded(*PEAKS)} FROM found"
SQL["session_vitals"] = f"""WITH s AS ({QUICK}), {ROBUST.replace('g AS', 'rg AS').replace('FROM g ', 'FROM rg ').replace('a AS', 'ra AS').replace('JOIN a ', 'JOIN ra ').replace('b AS (', 'rb AS (').replace('FROM b)', 'FROM rb)').replace('c AS (', 'rc AS (').replace('FROM c)', 'FROM rc)')},
{series_peaks(0.1, 1.0)}, m AS (SELECT session_id, count(*) AS n, avg(x) AS mean_x FROM s GROUP BY 1)
SELECT session_id, m.n, round(mean_x, 9) + 0.0 AS mean_x, round(rate.fs, 6) + 0.0 AS sample_rate_hz, {rounded(*PEAKS)} FROM found JOIN m USING (session_id) JOIN rate USING (session_id)"""
SQL["band_spectra"] = f"WITH s AS ({S}), {TWO}, {cleaned('s')}, {welch(0.1, 0.7)} SELECT session_id, round(hz, 6) + 0.0 AS hz, round(p, 6) + 0.0 AS power FROM inside"
#: Segments of 30 s are 64 rows here too, and the band has no lower limit by length; sessions have 20 rows or more.
SQL["spectral_entropy"] = f"""WITH s AS ({S}), {TWO}, {cleaned('s')}, {welch(0.1, 0.7)}, sh AS (SELECT session_id, p / sum(p) OVER (PARTITION BY session_id) AS p, count(*) OVER (PARTITION BY session_id) AS m FROM inside)
SELECT session_id, round(-sum(p * ln(p + 1e-18)) / ln(any_value(m)), 6) + 0.0 AS entropy FROM sh GROUP BY 1"""

RADAR = f"SELECT session_id, seq, seq * 50.0::DOUBLE AS t_ms, gy AS x FROM ({AXES})"
SIZE = f"SELECT session_id, seq, seq * 50.0::DOUBLE AS t_ms, sqrt(ax * ax + ay * ay + az * az) AS x, sqrt(gx * gx + gy * gy + gz * gz) AS turn FROM ({AXES})"
RATES = """n AS (SELECT session_id, count(*) AS n, (max(t_ms) - min(t_ms)) / 1000 / (count(*) - 1) AS gap FROM s GROUP BY 1),
rate AS (SELECT session_id, n, CASE WHEN n > 1 THEN 1 / gap END AS fs FROM n)"""


def spectrum(hann: str, last: str = "") -> str:
    """``power``: amplitude squared of mean-free series, with frequencies as an FFT's."""
    return f"""o AS (SELECT session_id, seq, x FROM s {last}), t AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n, x - avg(x) OVER (PARTITION BY session_id) AS y FROM o),
h AS (SELECT session_id, i, n, y * {hann} AS y FROM t), e AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM h),
d AS (SELECT session_id, k, any_value(n) AS n, sum(y * cos(2 * pi() * ((i * k) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((i * k) % n) / n)) ** 2 AS power FROM e GROUP BY 1, 2),
power AS (SELECT d.session_id, k, d.n, power, k * (1.0::DOUBLE / (d.n * (1.0::DOUBLE / fs))) AS hz, fs FROM d JOIN rate USING (session_id))"""


def top(low: str, high: str = "1e9") -> str:
    return f"coalesce(max_by(hz, power) FILTER (hz >= {low}::DOUBLE AND hz <= {high}::DOUBLE), 0)"


SQL["radar_vitals"] = f"""WITH s AS ({RADAR}), {RATES}, {spectrum('(0.5 - 0.5 * cos(2 * pi() * i / n))')},
z AS (SELECT session_id, k, hz, power * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS power FROM power WHERE k > 0), w AS (SELECT session_id, max_by(hz, power) AS hz FROM z GROUP BY 1)
SELECT session_id, CASE WHEN n >= 10 THEN round(fs, 6) + 0.0 END AS sample_rate_hz, CASE WHEN n >= 10 THEN round(hz, 6) + 0.0 END AS peak_frequency_hz, CASE WHEN n >= 10 THEN round(hz / 70.16::DOUBLE, 6) + 0.0 END AS peak_speed_mps,
  CASE WHEN n < 10 THEN n || ' samples are fewer than 10' END AS error FROM rate LEFT JOIN w USING (session_id)"""
_SHORT = "CASE WHEN n > 32 THEN {} ELSE 0 END"
SQL["radar_stats"] = f"""WITH s AS ({RADAR}), {RATES}, {spectrum('(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))', 'QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 4096')},
w AS (SELECT session_id, {top('0.05')} AS peak, {top('0.1', '0.6')} * 60 AS resp FROM power GROUP BY 1)
SELECT session_id, round(coalesce(fs, 500), 6) + 0.0 AS sample_rate_hz, round({_SHORT.format('peak')}, 6) + 0.0 AS peak_hz, round({_SHORT.format('resp')}, 6) + 0.0 AS resp_bpm, round({_SHORT.format('peak')} / 70.16::DOUBLE, 6) + 0.0 AS speed_mps, NULL::VARCHAR AS error
FROM rate JOIN w USING (session_id)"""
SQL["imu_stats"] = f"""WITH s AS ({SIZE}), {RATES}, {spectrum('(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))')},
w AS (SELECT session_id, {top('0.1', '0.6')} * 60 AS resp, {top('0.65', '4.0')} * 60 AS heart FROM power GROUP BY 1), r AS (SELECT session_id, sqrt(avg(x * x)) AS a, sqrt(avg(turn * turn)) AS g FROM s GROUP BY 1)
SELECT session_id, round(coalesce(fs, 100), 6) + 0.0 AS sample_rate_hz, round(a, 6) + 0.0 AS accel_rms_g, round(g, 6) + 0.0 AS gyro_rms_dps, round({_SHORT.format('resp')}, 6) + 0.0 AS resp_bpm, round({_SHORT.format('heart')}, 6) + 0.0 AS heart_bpm, NULL::VARCHAR AS error
FROM rate JOIN w USING (session_id) JOIN r USING (session_id)"""


# -- trackers as recursions -------------------------------------------------------------

MEASURED = f"""SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, 0.7::DOUBLE + (x % 100) / 50 AS hz, 0.5::DOUBLE + (x % 7) / 10 AS dt, x % 31 AS confidence, (x % 11) / 10 AS quality, seq % 23 <> 0 AS present FROM ({S})"""
_COV = ("rr", "rv", "rb", "vv", "vb", "bb")
SQL["kalman_track"] = f"""WITH RECURSIVE m AS MATERIALIZED ({MEASURED}),
k(session_id, i, locked, missed, r, v, b, {', '.join(_COV)}) AS (
SELECT DISTINCT session_id, 0::BIGINT, false, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, {', '.join('0::DOUBLE' for _ in _COV)} FROM m
UNION ALL
SELECT session_id, i, still, CASE WHEN still THEN miss ELSE 0 END, CASE WHEN still THEN r ELSE 0 END, v, b, {', '.join(_COV)} FROM (
 SELECT session_id, i, CASE WHEN locked THEN miss < 12 ELSE sure END AS still, CASE WHEN locked THEN miss ELSE 0 END AS miss,
  CASE WHEN locked THEN r ELSE hz END AS r, CASE WHEN locked THEN v ELSE 0 END AS v, CASE WHEN locked THEN b ELSE 0 END AS b,
  CASE WHEN locked THEN rr ELSE 0.10::DOUBLE * 0.10::DOUBLE END AS rr, CASE WHEN locked THEN rv ELSE 0 END AS rv, CASE WHEN locked THEN rb ELSE 0 END AS rb,
  CASE WHEN locked THEN vv ELSE 0.06::DOUBLE * 0.06::DOUBLE END AS vv, CASE WHEN locked THEN vb ELSE 0 END AS vb, CASE WHEN locked THEN bb ELSE 0.03::DOUBLE * 0.03::DOUBLE END AS bb FROM (
  SELECT session_id, i, hz, sure, locked, CASE WHEN takes THEN 0 ELSE miss END AS miss,
   CASE WHEN takes THEN least(greatest(r + rr / sp * off, 0.65::DOUBLE), 3) ELSE r END AS r, CASE WHEN takes THEN v + rv / sp * off ELSE v END AS v, CASE WHEN takes THEN b + rb / sp * off ELSE b END AS b,
   CASE WHEN takes THEN rr - rr / sp * rr ELSE rr END AS rr, CASE WHEN takes THEN rv - rr / sp * rv ELSE rv END AS rv, CASE WHEN takes THEN rb - rr / sp * rb ELSE rb END AS rb,
   CASE WHEN takes THEN vv - rv / sp * rv ELSE vv END AS vv, CASE WHEN takes THEN vb - rv / sp * rb ELSE vb END AS vb, CASE WHEN takes THEN bb - rb / sp * rb ELSE bb END AS bb FROM (
   SELECT *, locked AND sure AND (off * off / sp <= 9 OR miss > 4) AS takes FROM (
    SELECT *, hz - r AS off, greatest(rr + least(greatest(0.22::DOUBLE / sqrt(greatest(confidence, 1)), 0.035::DOUBLE), 0.22::DOUBLE) ** 2, 1e-9) AS sp FROM (
     SELECT session_id, i, hz, confidence, sure, locked, missed + 1 AS miss, least(greatest(r + d * v + d * d / 2 * b, 0.65::DOUBLE), 3) AS r, v + d * b AS v, b,
      rr + 2 * d * rv + d * d * rb + d * d * vv + d * d * d * vb + d ** 4 / 4 * bb + q * d ** 4 / 4 AS rr, rv + d * (rb + vv) + 1.5 * d * d * vb + d ** 3 / 2 * bb + q * d ** 3 / 2 AS rv,
      rb + d * vb + d * d / 2 * bb + q * d * d / 2 AS rb, vv + 2 * d * vb + d * d * bb + q * d * d AS vv, vb + d * bb + q * d AS vb, bb + q AS bb FROM (
      SELECT k.*, m.i, m.hz, m.confidence, least(greatest(m.dt, 0.05::DOUBLE), 2) AS d, 0.065::DOUBLE * 0.065::DOUBLE AS q, m.hz >= 0.65::DOUBLE AND m.hz <= 3 AND m.confidence >= 14 AND m.quality >= 0.25 AS sure
      FROM (SELECT * EXCLUDE (i), i AS at FROM k) k JOIN m ON m.session_id = k.session_id AND m.i = k.at + 1)))))))
SELECT session_id, seq, round(CASE WHEN locked THEN r ELSE 0 END, 6) + 0.0 AS tracked_hz FROM k JOIN m USING (session_id, i)"""
SQL["rate_stabiliser"] = f"""WITH RECURSIVE m AS MATERIALIZED (SELECT * REPLACE (hz / 3 AS hz) FROM ({MEASURED})),
k(session_id, i, shown, candidate, votes, missed) AS (SELECT DISTINCT session_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::BIGINT FROM m
UNION ALL
SELECT session_id, i, CASE kind WHEN 'absent' THEN 0 WHEN 'lost' THEN 0 WHEN 'near' THEN shown + (hz - shown) * CASE WHEN confidence >= 8 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END WHEN 'won' THEN hz ELSE shown END,
 CASE WHEN kind = 'absent' THEN 0 WHEN kind IN ('won', 'vote') THEN new_candidate ELSE candidate END, CASE kind WHEN 'vote' THEN new_votes WHEN 'missed' THEN votes ELSE 0 END, CASE WHEN kind IN ('missed', 'lost') THEN missed + 1 ELSE 0 END FROM (
 SELECT *, CASE WHEN NOT present THEN 'absent' WHEN NOT good AND missed < 40 THEN 'missed' WHEN NOT good THEN 'lost' WHEN shown > 0 AND abs(hz - shown) <= 0.1::DOUBLE THEN 'near'
  WHEN new_votes >= CASE WHEN shown > 0 THEN 4 WHEN confidence >= 8 THEN 1 ELSE 2 END THEN 'won' ELSE 'vote' END AS kind FROM (
  SELECT k.*, m.i, m.hz, m.confidence, m.present, m.hz >= 0.9::DOUBLE * 0.1::DOUBLE AND m.hz <= 1.05::DOUBLE AND m.confidence >= 4 AND m.quality >= 0.25 AS good,
   CASE WHEN abs(m.hz - candidate) <= 0.06::DOUBLE THEN candidate ELSE m.hz END AS new_candidate, CASE WHEN abs(m.hz - candidate) <= 0.06::DOUBLE THEN votes + 1 ELSE 1 END AS new_votes
  FROM (SELECT * EXCLUDE (i), i AS at FROM k) k JOIN m ON m.session_id = k.session_id AND m.i = k.at + 1)))
SELECT session_id, seq, round(shown, 6) + 0.0 AS shown_hz FROM k JOIN m USING (session_id, i)"""


def unit(x: str, y: str, z: str) -> str:
    return f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"


SQL["complementary_filter"] = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT session_id, seq, ax, ay, az, radians(gx) AS p, radians(gy) AS q, radians(gz) AS r FROM ({AXES})),
k(session_id, seq, x, y, z) AS (SELECT session_id, seq, ax / n, ay / n, az / n FROM (SELECT *, {unit('ax', 'ay', 'az')} AS n FROM a) WHERE seq = 1
UNION ALL
SELECT session_id, seq, x / n, y / n, z / n FROM (SELECT *, {unit('x', 'y', 'z')} AS n FROM (
 SELECT session_id, seq, 0.98::DOUBLE * tx + 0.02::DOUBLE * ax / m AS x, 0.98::DOUBLE * ty + 0.02::DOUBLE * ay / m AS y, 0.98::DOUBLE * tz + 0.02::DOUBLE * az / m AS z FROM (
  SELECT session_id, seq, ax, ay, az, m, x / n AS tx, y / n AS ty, z / n AS tz FROM (SELECT *, {unit('x', 'y', 'z')} AS n, {unit('ax', 'ay', 'az')} AS m FROM (
   SELECT a.session_id, a.seq, ax, ay, az, x - (q * z - r * y) * 0.05::DOUBLE AS x, y - (r * x - p * z) * 0.05::DOUBLE AS y, z - (p * y - q * x) * 0.05::DOUBLE AS z FROM k JOIN a ON a.session_id = k.session_id AND a.seq = k.seq + 1))))))
SELECT session_id, seq, round(x, 6) + 0.0 AS g_x, round(y, 6) + 0.0 AS g_y, round(z, 6) + 0.0 AS g_z FROM k"""


# -- stores, histories, bins ----------------------------------------------------------------

SQL["csv_radar"] = f'WITH s AS ({S}) SELECT session_id, t_ms AS "Timestamp_ms", x * 10 AS "RawADC", x AS "Voltage_mV" FROM s'
SQL["csv_imu"] = f"""WITH a AS ({AXES}) SELECT session_id, seq * 50.0::DOUBLE AS "Time_ms", ax, ay, az, gx, gy, gz FROM a"""
SQL["csv_frames"] = f"""WITH f AS ({F}), mag AS ({MAG}), p AS ({PEAK})
SELECT session_id, seq AS "Frame", round(0.2::DOUBLE + peak_bin * 0.02::DOUBLE, 6) + 0.0 AS peak_distance_m, round(list_max(a), 6) + 0.0 AS peak_amplitude, 32::INTEGER AS n_bins, round(list_sum(list_transform(re, lambda x: round(x, 8))), 8) + 0.0 AS total_re FROM p"""
SQL["capture_sinks"] = f"""WITH g AS (SELECT session_id, count(*) AS n, sum(round(x * 1000)::BIGINT)::BIGINT AS total_uv FROM ({S}) GROUP BY 1)
SELECT session_id, n AS samples, CASE WHEN n < 10 THEN 'fewer than 10 samples' END AS error, n AS n_rows, CASE WHEN n >= 10 THEN n END AS n_file, total_uv AS total_uv_rows, CASE WHEN n >= 10 THEN total_uv END AS total_uv_file FROM g"""
SQL["sweep_frames"] = """WITH e AS (SELECT label::BIGINT AS session_id, vec_id AS seq, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 = 0 THEN [2, 3] ELSE [0, 1, 2, 3] END AS s,
  CASE WHEN vec_id % 5 <> 1 THEN vec_id / 64::DOUBLE END AS tick FROM embeddings),
m AS (SELECT *, list_transform(range(1, 9), lambda p: list_sum(list_transform(s, lambda n: v[16 * n + p])) / len(s)) AS re, list_transform(range(1, 9), lambda p: list_sum(list_transform(s, lambda n: v[16 * n + 8 + p])) / len(s)) AS im FROM e),
a AS (SELECT *, list_transform(range(1, 9), lambda p: sqrt(re[p] * re[p] + im[p] * im[p])) AS a, row_number() OVER w - 1 AS frame, min(tick) OVER w AS first FROM m WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
p AS (SELECT *, list_position(a, list_max(a)) AS peak FROM a)
SELECT session_id, seq, frame AS "Frame", round(1000 + coalesce((tick - first) * 1000, frame * 1000 / 32::DOUBLE), 6) + 0.0 AS timestamp_ms,
  CASE WHEN seq % 2 = 0 THEN 0.25::DOUBLE + (peak - 1) * 0.125::DOUBLE ELSE (peak - 1)::DOUBLE END AS peak_distance_m, round(list_max(a), 6) + 0.0 AS peak_amplitude, round(atan2(im[peak], re[peak]), 6) + 0.0 AS peak_phase_rad,
  round(list_sum(a) / 8, 6) + 0.0 AS mean_amplitude, 8::INTEGER AS n_points, round(list_sum(re), 6) + 0.0 AS total_re, round(list_sum(im), 6) + 0.0 AS total_im FROM p"""
SQL["session_store"] = f"""WITH s AS ({S}) SELECT 1 + session_id % 2 AS id, 'radar' AS sensor, count(*) AS sample_count, true AS stopped, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_mv FROM s GROUP BY session_id % 2"""
SQL["snapshot_since"] = f"WITH s AS ({S}) SELECT session_id, seq, x FROM s QUALIFY session_id % 3 = 0 OR seq > max(seq) OVER (PARTITION BY session_id) - session_id * 7"
SQL["bounded_history"] = f"WITH s AS ({S}) SELECT session_id, seq, x FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= greatest(32, round_even(30 * greatest(session_id % 3 / 10, 1) * 1.2::DOUBLE, 0))"
SQL["view_horizon"] = f"""WITH s AS ({QUICK}), l AS (SELECT *, max_by(t_ms, seq) OVER (PARTITION BY session_id) AS last FROM s) SELECT session_id, seq, x, t_ms >= last - 5000 AS shown FROM l WHERE t_ms >= last - 30000"""
SQL["heart_search_band"] = f"""WITH s AS ({S}), p AS (SELECT seq, CASE WHEN seq % 9 > 0 THEN x / 150 - 0.2::DOUBLE END AS prior, CASE WHEN seq % 4 > 0 THEN (x % 50) / 100 END AS deviation FROM s),
h AS (SELECT *, greatest(0.4::DOUBLE, 3 * coalesce(deviation, 0.12::DOUBLE)) AS half FROM p), b AS (SELECT *, greatest(prior - half, 0.65::DOUBLE) AS lo, least(prior + half, 3) AS hi FROM h),
c AS (SELECT *, hi - lo < 0.8::DOUBLE AS narrow, least(greatest((lo + hi) / 2, 1.05::DOUBLE), 2.6::DOUBLE) AS mid FROM b)
SELECT seq, round(CASE WHEN prior IS NULL OR prior <= 0 THEN 0.65::DOUBLE WHEN narrow THEN greatest(0.65::DOUBLE, mid - 0.4::DOUBLE) ELSE lo END, 6) + 0.0 AS low, round(CASE WHEN prior IS NULL OR prior <= 0 THEN 3 WHEN narrow THEN least(3, mid + 0.4::DOUBLE) ELSE hi END, 6) + 0.0 AS high FROM c"""
SQL["presence_of_phase"] = f"""WITH s AS ({S}), m AS (SELECT session_id, median(x) AS m FROM s GROUP BY 1), d AS (SELECT session_id, any_value(m) AS m, 1.4826 * median(abs(x - m)) AS d FROM s JOIN m USING (session_id) GROUP BY 1),
c AS (SELECT session_id, least(greatest(40 * m / (d + m + 1e-9), 0), 100) AS score FROM d) SELECT session_id, round(score, 6) + 0.0 AS score, score >= 20 AS present FROM c"""
SQL["weighted_bins"] = f"""WITH f AS ({F}), l AS ({LONG}), a AS (SELECT session_id, bin, median(sqrt(re * re + im * im)) AS score FROM l GROUP BY 1, 2),
b AS (SELECT *, bin >= 5 AND session_id % 4 > 0 AND bin < 25 - session_id % 3 * 9 AS own, ((bin * 7 + session_id) % 5) * CASE WHEN session_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.7::DOUBLE END AS ratio FROM a),
c AS (SELECT * FROM b QUALIFY CASE WHEN max(own::INT) OVER (PARTITION BY session_id) = 1 THEN own ELSE bin = 31 END),
e AS (SELECT session_id, avg(score) + 0.2 * max(score) AS high, quantile_cont(score, 0.65) AS cut FROM c GROUP BY 1),
g AS (SELECT *, score >= high AND ratio >= 1.8::DOUBLE AS vital FROM c JOIN e USING (session_id)),
h AS (SELECT * FROM g QUALIFY CASE WHEN max(vital::INT) OVER (PARTITION BY session_id) = 1 THEN vital ELSE score >= cut END),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, bin DESC) <= 9)
SELECT session_id, bin, round(score / (sum(score) OVER w + 1e-12), 6) + 0.0 AS weight, first_value(bin) OVER (PARTITION BY session_id ORDER BY score DESC, bin) AS best_bin, count(*) OVER w AS n_bins FROM t WINDOW w AS (PARTITION BY session_id)"""
#: By power iteration.
COMPONENT = f"""a AS ({AXES}), c AS MATERIALIZED (SELECT session_id, covar_samp(ax, ax) AS xx, covar_samp(ax, ay) AS xy, covar_samp(ax, az) AS xz, covar_samp(ay, ay) AS yy, covar_samp(ay, az) AS yz, covar_samp(az, az) AS zz FROM a GROUP BY 1),
k(session_id, i, x, y, z) AS (SELECT session_id, 0, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE FROM c UNION ALL SELECT session_id, i + 1, x / n, y / n, z / n FROM (SELECT *, {unit('x', 'y', 'z')} AS n FROM (
 SELECT session_id, i, xx * x + xy * y + xz * z AS x, xy * x + yy * y + yz * z AS y, xz * x + yz * y + zz * z AS z FROM k JOIN c USING (session_id) WHERE i < 60))),
v AS (SELECT session_id, x, y, z, (x * (xx * x + xy * y + xz * z) + y * (xy * x + yy * y + yz * z) + z * (xz * x + yz * y + zz * z)) / (xx + yy + zz) AS share,
  sign(CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END) AS turn FROM k JOIN c USING (session_id) WHERE i = 60)"""
SQL["first_component"] = f"WITH RECURSIVE {COMPONENT} SELECT session_id, round(x * turn, 6) + 0.0 AS axis_ax, round(y * turn, 6) + 0.0 AS axis_ay, round(z * turn, 6) + 0.0 AS axis_az, round(share, 6) + 0.0 AS share FROM v"
SQL["projected_component"] = f"WITH RECURSIVE {COMPONENT} SELECT session_id, seq, round(turn * (ax * x + ay * y + az * z), 6) + 0.0 AS component FROM a JOIN v USING (session_id)"
SQL["polynomial_detrend"] = f"""WITH s AS ({S}), {detrended('s')}, m AS (SELECT session_id, avg(x) AS mean, count(*) AS n FROM s GROUP BY 1) SELECT session_id, seq, round(CASE WHEN n < 24 THEN s.x - mean ELSE flat.x END, 7) + 0.0 AS x FROM s JOIN flat USING (session_id, seq) JOIN m USING (session_id)"""
_UNWRAPPED = f"CASE WHEN abs(d) < pi() THEN d WHEN {MOD} = -pi() AND d > 0 THEN pi() ELSE {MOD} END"
SQL["phase_matrix"] = f"""WITH f AS ({F}), l AS ({LONG}), a AS (SELECT session_id * 100 + bin AS session_id, seq, atan2(im, re) AS angle FROM l),
d AS (SELECT *, angle - lag(angle) OVER w AS d, first_value(angle) OVER w AS first FROM a WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
u AS (SELECT session_id, seq, first + sum(coalesce({_UNWRAPPED}, 0)) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM d), s AS (SELECT session_id, seq, p - median(p) OVER (PARTITION BY session_id) AS x FROM u),
{cleaned('s')} SELECT session_id // 100 AS session_id, (session_id % 100)::INTEGER AS bin, seq, round(x, 6) + 0.0 AS phase FROM flat"""
THREE = "w AS (SELECT session_id, bin, a / (sum(a) OVER (PARTITION BY session_id) + 1e-12) AS w FROM (SELECT session_id, bin, median(sqrt(re * re + im * im)) AS a FROM l WHERE bin BETWEEN 8 AND 10 GROUP BY 1, 2))"
SQL["aligned_mean"] = f"""WITH f AS ({F}), l AS ({LONG}), {THREE}, s AS (SELECT session_id * 100 + bin AS session_id, seq, re AS x FROM l WHERE bin BETWEEN 8 AND 10), {cleaned('s')},
c AS (SELECT session_id // 100 AS session_id, session_id % 100 AS bin, seq, x FROM flat), r AS (SELECT session_id, seq, x AS r FROM c WHERE bin = 8),
t AS (SELECT session_id, bin, CASE WHEN sum(x * r) < 0 THEN -1 ELSE 1 END AS turn FROM c JOIN r USING (session_id, seq) GROUP BY 1, 2)
SELECT session_id, seq, round(sum(turn * w * x) / (sum(w) + 1e-12), 6) + 0.0 AS mean FROM c JOIN t USING (session_id, bin) JOIN w USING (session_id, bin) GROUP BY 1, 2"""
SQL["coherent_phase"] = f"""WITH f AS ({F}), l AS ({LONG}), {THREE}, o AS (SELECT l.session_id, l.bin, seq, re, im, w, w / (sum(w) OVER (PARTITION BY l.session_id, seq) + 1e-12) AS share, sqrt(re * re + im * im) + 1e-12 AS n FROM l JOIN w USING (session_id, bin)),
p AS (SELECT *, re / n AS a, im / n AS b, lag(re / n) OVER v AS pa, lag(im / n) OVER v AS pb FROM o WINDOW v AS (PARTITION BY session_id, bin ORDER BY seq)),
x AS (SELECT session_id, seq, atan2(sum(share * (b * pa - a * pb)), sum(share * (a * pa + b * pb))) AS step FROM p GROUP BY 1, 2), s AS (SELECT session_id, seq, sum(coalesce(step, 0)) OVER (PARTITION BY session_id ORDER BY seq) AS x FROM x), {cleaned('s')},
h AS (SELECT session_id, max_by(bin, w) AS bin FROM w GROUP BY 1), r AS (SELECT o.session_id, seq, re AS hr, im AS hi FROM o JOIN h USING (session_id, bin)),
t AS (SELECT session_id, bin, atan2(avg(im * hr - re * hi), avg(re * hr + im * hi)) AS turn FROM o JOIN r USING (session_id, seq) GROUP BY 1, 2),
z AS (SELECT session_id, seq, sum(w * (re * cos(turn) + im * sin(turn))) AS raw_i, sum(w * (im * cos(turn) - re * sin(turn))) AS raw_q FROM o JOIN t USING (session_id, bin) GROUP BY 1, 2)
SELECT session_id, seq, round(x, 6) + 0.0 AS phase, round(raw_i, 6) + 0.0 AS raw_i, round(raw_q, 6) + 0.0 AS raw_q FROM flat JOIN z USING (session_id, seq)"""
#: Of the harmonics of 0.4 Hz only 0.8 Hz lies in the heart band and below 0.46 * 2.5 Hz: two waves, solved by Cramer's rule.
SQL["harmonics_removed"] = f"""WITH s0 AS ({S}), {cleaned('s0', 'c')}, w AS (SELECT session_id, seq, x, sin(2 * pi() * 0.8::DOUBLE * i / 2.5::DOUBLE) AS a, cos(2 * pi() * 0.8::DOUBLE * i / 2.5::DOUBLE) AS b FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM cflat)),
n AS (SELECT session_id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * x) AS ax, sum(b * x) AS bx FROM w GROUP BY 1),
s AS (SELECT session_id, seq, x - ((ax * bb - bx * ab) * a + (bx * aa - ax * ab) * b) / (aa * bb - ab * ab) AS x FROM w JOIN n USING (session_id)),
{cleaned('s')} SELECT session_id, seq, round(CASE WHEN n < 24 THEN w.x ELSE flat.x END, 6) + 0.0 AS x FROM flat JOIN w USING (session_id, seq) JOIN n USING (session_id)"""
SQL["live_trace"] = f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM ({F})), l AS (SELECT session_id, seq, i, bin, 0.2::DOUBLE + bin * 0.02::DOUBLE AS distance_m, re[bin + 1] AS re, im[bin + 1] AS im FROM (SELECT *, unnest(range(0, 32)) AS bin FROM f)),
sel AS (SELECT session_id, bin AS own, distance_m AS target FROM l WHERE i = 1 AND distance_m >= 0.28::DOUBLE QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sqrt(re * re + im * im) DESC, bin) = 1),
g AS MATERIALIZED (SELECT l.*, own, target, session_id * 100 + bin AS sid, sqrt(re * re + im * im) AS size, atan2(im, re) AS angle FROM l JOIN sel USING (session_id) WHERE bin BETWEEN own - 1 AND own + 1),
d AS (SELECT sid, i, angle - lag(angle) OVER (PARTITION BY sid ORDER BY i) AS d FROM g),
u AS MATERIALIZED (SELECT sid AS session_id, i, sum(coalesce(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END, 0)) OVER (PARTITION BY sid ORDER BY i) AS x FROM d),
{recursion('u', 'level', *LIVE_LEVEL)}, moved AS MATERIALIZED (SELECT session_id, i, y AS x FROM level), {recursion('moved', 'resp', *LIVE_RESP)}, {recursion('moved', 'heart', *LIVE_HEART)},
e AS (SELECT sid, i, exp(-i / 400.0::DOUBLE) * sum(CASE WHEN i = 1 THEN 1 ELSE 1 - exp(-1 / 400.0::DOUBLE) END * size * exp(i / 400.0::DOUBLE)) OVER (PARTITION BY sid ORDER BY i) AS smooth FROM g),
w1 AS (SELECT g.session_id, g.seq, g.i, g.sid, bin, own, target, re, im, u.x AS phase, resp.y AS r, heart.y AS h, smooth / (sum(smooth) OVER (PARTITION BY g.session_id, g.i) + 1e-12) AS w, count(*) OVER (PARTITION BY g.session_id, g.i) AS m
  FROM g JOIN e USING (sid, i) JOIN u ON u.session_id = g.sid AND u.i = g.i JOIN resp ON resp.session_id = g.sid AND resp.i = g.i JOIN heart ON heart.session_id = g.sid AND heart.i = g.i),
w2 AS (SELECT *, CASE WHEN m > 1 THEN 0.35::DOUBLE * w + CASE WHEN bin = own THEN 0.65::DOUBLE ELSE 0 END ELSE w END AS v FROM w1)
SELECT session_id::VARCHAR AS session_id, seq AS frame, own::BIGINT AS selected_index, round(target, 6) + 0.0 AS target_distance_m, round((i - 1) * 0.05::DOUBLE, 6) + 0.0 AS time_s, round(max(phase) FILTER (bin = own), 6) + 0.0 AS raw_phase,
 round(max(re) FILTER (bin = own), 6) + 0.0 AS raw_i, round(max(im) FILTER (bin = own), 6) + 0.0 AS raw_q, round(sum(v * r) / (sum(v) + 1e-12), 6) + 0.0 AS resp_signal, round(sum(v * h) / (sum(v) + 1e-12), 6) + 0.0 AS heart_signal FROM w2 GROUP BY session_id, seq, i, own, target"""


# -- the analyser of range profiles ---------------------------------------------------------

_CIRCLE = SQL["circle_fit"].rpartition("SELECT session_id, bin, ")[0]
_REACH = "least(0.92::DOUBLE, 0.46::DOUBLE * 2)"
ANALYSED = f"""f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ({F})),
l AS MATERIALIZED (SELECT session_id, bin::INTEGER AS bin, i, n, 0.2::DOUBLE + bin * 0.02::DOUBLE AS distance_m, re[bin + 1] AS re, im[bin + 1] AS im FROM (SELECT *, unnest(range(0, 32)) AS bin FROM f)),
parts AS MATERIALIZED (SELECT (session_id * 100 + bin) * 2 AS session_id, i, re AS x FROM l UNION ALL SELECT (session_id * 100 + bin) * 2 + 1, i, im FROM l),
{recursion('parts', 'still', *FRAME_STILL)},
moving AS (SELECT l.session_id, bin, l.i, n, distance_m, sqrt((re - a.y) ** 2 + (im - b.y) ** 2) AS size FROM l JOIN still a ON a.session_id = (l.session_id * 100 + bin) * 2 AND a.i = l.i JOIN still b ON b.session_id = (l.session_id * 100 + bin) * 2 + 1 AND b.i = l.i),
seen AS MATERIALIZED (SELECT session_id, bin, any_value(n) AS n, any_value(distance_m) AS distance_m, distance_m >= 0.28::DOUBLE AS searched, median(size) AS typical,
  sum(size * exp(-1.0::DOUBLE / 40) ** (n - i) * CASE WHEN i = 1 THEN 1 ELSE 1 - exp(-1.0::DOUBLE / 40) END) AS smooth FROM moving GROUP BY session_id, bin, moving.distance_m),
circle AS MATERIALIZED ({_CIRCLE} SELECT session_id, bin, cx, cy, plausible FROM y),
phase AS MATERIALIZED (WITH z AS (SELECT session_id, bin, i, CASE WHEN plausible THEN re - cx ELSE re END AS re, CASE WHEN plausible THEN im - cy ELSE im END AS im FROM l JOIN circle USING (session_id, bin)),
  u AS (SELECT session_id, bin, i, re / (sqrt(re * re + im * im) + 1e-12) AS a, im / (sqrt(re * re + im * im) + 1e-12) AS b FROM z),
  p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM u WINDOW w AS (PARTITION BY session_id, bin ORDER BY i)),
  s AS (SELECT session_id, bin, i, sum(coalesce(atan2(b * pa - a * pb, a * pa + b * pb), 0)) OVER (PARTITION BY session_id, bin ORDER BY i) AS x FROM p),
  line AS (SELECT session_id, bin, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base FROM s GROUP BY 1, 2)
  SELECT session_id, bin, i, x - coalesce(base + slope * i, 0) AS x FROM s JOIN line USING (session_id, bin)),
vital AS MATERIALIZED (WITH series AS (SELECT session_id * 100 + bin AS session_id, i AS seq, x FROM phase), {POWER}, z AS (SELECT *, k * (1.0::DOUBLE / (n * 0.5::DOUBLE)) AS hz FROM power),
  v AS (SELECT *, hz >= 0.1::DOUBLE AND hz <= 0.46::DOUBLE * 2 AS vital, hz >= 0.03::DOUBLE AND hz <= 0.46::DOUBLE * 2 AS wide FROM z)
  SELECT session_id // 100 AS session_id, session_id % 100 AS bin, CASE WHEN max(n) < 16 OR count(*) FILTER (vital) = 0 OR count(*) FILTER (wide AND NOT vital) = 0 THEN 1 ELSE avg(power) FILTER (vital) / (avg(power) FILTER (wide AND NOT vital) + 1e-18) END AS ratio FROM v GROUP BY session_id),
latest AS MATERIALIZED (WITH f AS ({F}), mag AS ({MAG}), p AS ({PEAK}) SELECT session_id, 0.2::DOUBLE + peak_bin * 0.02::DOUBLE AS peak_m, list_max(a) AS peak_amplitude, list_avg(a) AS mean_amplitude FROM p QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1),
floors AS (SELECT session_id, median(typical) + 1e-12 AS floor FROM seen WHERE searched GROUP BY 1),
scored AS (SELECT session_id, bin, n, searched, distance_m, typical, floor, smooth, ratio, peak_m, CASE WHEN searched THEN typical / floor ELSE 0 END + 0.15::DOUBLE * least(greatest(ratio, 0), 5) AS score FROM seen JOIN floors USING (session_id) JOIN vital USING (session_id, bin) JOIN latest USING (session_id)),
lifted AS (SELECT *, score + CASE WHEN bin = first_value(bin) OVER (PARTITION BY session_id ORDER BY abs(distance_m - peak_m), bin) AND searched AND peak_m > 0 THEN 0.5 * max(score) OVER (PARTITION BY session_id) ELSE 0 END AS total FROM scored),
target AS MATERIALIZED (SELECT session_id, n, bin AS own, distance_m AS target_m, typical / floor AS amp_ratio, ratio AS phase_ratio FROM lifted QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total DESC, bin) = 1),
gate AS MATERIALIZED (SELECT session_id, bin, own, target.n, smooth FROM seen JOIN target USING (session_id) WHERE abs(distance_m - target_m) <= 0.05::DOUBLE QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY abs(bin - own), bin) <= 3),
weight AS (SELECT session_id, bin, own, n, count(*) OVER w AS m, smooth / (sum(smooth) OVER w + 1e-12) AS w FROM gate WINDOW w AS (PARTITION BY session_id)),
turned AS (SELECT session_id, bin, i, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY session_id, bin ORDER BY i) AS d FROM l JOIN gate USING (session_id, bin)),
wrapped AS (SELECT session_id * 100 + bin AS session_id, i AS seq, sum(coalesce({MOD}, 0)) OVER (PARTITION BY session_id, bin ORDER BY i) AS x FROM turned),
{cleaned('wrapped', 'w_')}, w_i AS MATERIALIZED ({numbered('w_flat')}), {recursion('w_i', 'breath', *FRAME_RESP)},
late AS (SELECT breath.session_id, breath.i AS seq, y AS x FROM breath JOIN target ON target.session_id = breath.session_id // 100 WHERE breath.i > n - 40 AND n >= 40), {cleaned('late', 'l_')},
tones AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS j, x FROM l_flat), waves AS (SELECT session_id, j, x * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * j / 39)) AS y, unnest(range(0, 33)) AS k FROM tones),
sums AS (SELECT session_id // 100 AS session_id, k, sqrt(sum(y * cos(2 * pi() * ((j * k) % 64) / 64)) ** 2 + sum(y * sin(2 * pi() * ((j * k) % 64) / 64)) ** 2) AS a FROM waves GROUP BY waves.session_id, k),
level AS (SELECT session_id, k, k / 32.0::DOUBLE AS hz, avg(a) AS p FROM sums GROUP BY 1, 2), near AS (SELECT *, lag(p) OVER w AS y0, lead(p) OVER w AS y2 FROM level WINDOW w AS (PARTITION BY session_id ORDER BY k)),
band AS (SELECT near.*, n, median(p) OVER (PARTITION BY session_id) AS mid FROM near JOIN target USING (session_id) WHERE hz >= greatest(0.1::DOUBLE, 2.0::DOUBLE / n) AND hz <= {_REACH}),
resp AS (SELECT session_id, least(greatest(hz + ({vertex('y0', 'p', 'y2')}) / 32, greatest(0.1::DOUBLE, 2.0::DOUBLE / n)), {_REACH}) AS hz, p / (mid + 1e-18) AS conf FROM band QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p DESC, k) = 1),
breathing AS (SELECT session_id, target.n, coalesce(hz, 0) AS hz, coalesce(conf, 0) AS conf, coalesce(hz >= 0.9::DOUBLE * 0.1::DOUBLE AND hz <= {_REACH} AND conf >= 4, false) AS sure FROM target LEFT JOIN resp USING (session_id)),
bins AS (SELECT session_id * 100 + bin AS session_id, i AS seq, x FROM phase JOIN gate USING (session_id, bin)), {cleaned('bins', 'b_')},
own AS (SELECT session_id // 100 AS session_id, session_id % 100 AS bin, seq AS i, x FROM b_flat), main AS (SELECT own.session_id, i, x AS r FROM own JOIN target USING (session_id) WHERE bin = target.own),
signs AS (SELECT session_id, bin, CASE WHEN sum(x * r) < 0 THEN -1 ELSE 1 END AS sign FROM own JOIN main USING (session_id, i) GROUP BY 1, 2),
mixed AS (SELECT session_id, i AS seq, sum(sign * w * x) / (sum(w) + 1e-12) AS x FROM own JOIN signs USING (session_id, bin) JOIN weight USING (session_id, bin) GROUP BY 1, 2), {cleaned('mixed', 'm_')}, beats AS MATERIALIZED ({numbered('m_flat')}),
ends AS (SELECT session_id, count(*) AS n, min_by(x, i) AS a, max_by(x, i) AS z FROM beats GROUP BY 1),
wide AS MATERIALIZED (SELECT session_id, i + 21 AS i, x FROM beats UNION ALL SELECT session_id, 23 - i, 2 * a - x FROM beats JOIN ends USING (session_id) WHERE i BETWEEN 2 AND 22
  UNION ALL SELECT session_id, 2 * n - i + 21, 2 * z - x FROM beats JOIN ends USING (session_id) WHERE i BETWEEN n - 21 AND n - 1),
{recursion('wide', 'ahead', *FRAME_HEART, settled=True)}, behind AS MATERIALIZED (SELECT session_id, n + 43 - i AS i, y AS x FROM ahead JOIN ends USING (session_id)), {recursion('behind', 'twice', *FRAME_HEART, settled=True)},
pulse AS MATERIALIZED (SELECT session_id, n + 22 - twice.i AS seq, y AS x FROM twice JOIN ends USING (session_id) WHERE twice.i BETWEEN 22 AND n + 21),
heart AS (WITH s AS (SELECT * FROM pulse), rate AS (SELECT DISTINCT session_id, 2.0::DOUBLE AS fs FROM pulse),
  rejected AS (SELECT session_id, CASE WHEN sure THEN list_filter(list_transform(range(2, 8), lambda k: k * hz), lambda h: h >= 0.85::DOUBLE * 0.65::DOUBLE AND h <= 1.05::DOUBLE * 3) ELSE [] END AS hs FROM breathing),
  {series_peaks(0.65, 3.0, rejected=True)} SELECT session_id, fused_hz AS hz, fused_confidence AS conf FROM found),
judged AS MATERIALIZED (SELECT target.*, m, breathing.hz AS r_hz, breathing.conf AS r_conf, CASE WHEN target.n >= 20 THEN heart.hz ELSE 0 END AS h_hz, CASE WHEN target.n >= 20 THEN heart.conf ELSE 0 END AS h_conf,
  least(greatest((amp_ratio - 1) * 35 + least(m, 5) * 6 + least(greatest(phase_ratio, 0), 5) * 10, 0), 100) AS score FROM target JOIN (SELECT DISTINCT session_id, m FROM weight) USING (session_id) JOIN breathing USING (session_id) JOIN heart USING (session_id)),
shown AS (SELECT *, score >= 20 AND (amp_ratio >= 1.08::DOUBLE OR phase_ratio >= 1.30::DOUBLE) AS present FROM judged),
rates AS MATERIALIZED (SELECT shown.*, CASE WHEN present THEN r_conf ELSE 0 END AS resp_confidence, CASE WHEN present THEN h_conf ELSE 0 END AS heart_confidence, peak_m, peak_amplitude, mean_amplitude FROM shown JOIN latest USING (session_id)),
numbers AS (SELECT *, CASE WHEN n >= 40 AND resp_confidence >= 4 THEN r_hz ELSE 0 END AS resp_hz, CASE WHEN heart_confidence >= 14 THEN h_hz ELSE 0 END AS heart_hz, 2.0::DOUBLE AS sample_rate_hz, target_m AS target_distance_m, target_m - 0.05::DOUBLE AS gate_min_m, target_m + 0.05::DOUBLE AS gate_max_m,
  peak_m AS peak_distance_m, score AS presence_score, least(greatest(0.18::DOUBLE * ln(1 + greatest(amp_ratio - 1, 0)) + 0.22::DOUBLE * least(resp_confidence / 5, 1) + 0.22::DOUBLE * least(heart_confidence / 5, 1) + 0.20::DOUBLE * least(greatest(phase_ratio, 0) / 4, 1) + CASE WHEN present THEN 0.18::DOUBLE ELSE 0 END, 0), 1) AS signal_quality
  FROM rates), all_numbers AS (SELECT *, resp_hz * 60 AS resp_bpm, heart_hz * 60 AS heart_bpm FROM numbers)"""
_FRAME_NUMBERS = (
    "sample_rate_hz", "target_distance_m", "gate_min_m", "gate_max_m", "peak_distance_m", "peak_amplitude", "mean_amplitude", "presence_score",
    "resp_bpm", "heart_bpm", "resp_hz", "heart_hz", "resp_confidence", "heart_confidence", "signal_quality",
)
#: Sessions have 30 to 900 frames.
SQL["frame_vitals"] = f"WITH RECURSIVE {ANALYSED} SELECT session_id, {rounded(*_FRAME_NUMBERS)}, present, own AS selected_index, m::INTEGER AS candidate_bins, NULL::VARCHAR AS error FROM all_numbers"
SQL["frame_stats"] = f"""WITH RECURSIVE {ANALYSED} SELECT session_id, {rounded(*(n for n in _FRAME_NUMBERS if n not in ('resp_hz', 'heart_hz', 'resp_confidence', 'heart_confidence', 'signal_quality')))}, present::INTEGER::DOUBLE AS present, NULL::VARCHAR AS error FROM all_numbers"""


# -- the inertial analyser ------------------------------------------------------------------

#: Fourth-order Butterworth band-passes at 25 Hz as second-order sections (b, a), from
#: their poles by hand, each with a gain of 1 at the centre.
SLOW = [
    ([0.10559116569126444, 0.0, -0.10559116569126444], [1.0, -1.8242491391769096, 0.8359162775270101]),
    ([0.14356469874563987, 0.0, -0.14356469874563987], [1.0, -1.9009950902235513, 0.9216461185772541]),
    ([0.03346393517152271, 0.0, -0.03346393517152271], [1.0, -1.9468974085131336, 0.9479986131832936]),
    ([0.026205627250779052, 0.0, -0.026205627250779052], [1.0, -1.9850352374898776, 0.985697649713637]),
]
FAST = [
    ([0.49663322127346776, 0.0, -0.49663322127346776], [1.0, -0.8831162676326009, 0.26141068093027436]),
    ([0.7399405722579228, 0.0, -0.7399405722579228], [1.0, -0.8934762664888459, 0.6121956755089271]),
    ([0.19906483413155815, 0.0, -0.19906483413155815], [1.0, -1.665266585534414, 0.7039522247123374]),
    ([0.17556820221419342, 0.0, -0.17556820221419342], [1.0, -1.8812276457334165, 0.9079843562922582]),
]


def cascade(source: str, out: str, sections: list) -> str:
    """Sections in a row, forward, from an endless first value; what they hold then is nothing but for the first."""
    steps = []
    for k, (b, a) in enumerate(sections):
        last = out if k == len(sections) - 1 else f"{out}{k}"
        steps.append(recursion(source, last, b, a, settled=k == 0))
        if last != out:
            steps.append(f"{last}x AS MATERIALIZED (SELECT session_id, i, y AS x FROM {last})")
            source = f"{last}x"
    return ", ".join(steps)


def there_and_back(source: str, out: str, sections: list, pad: int) -> str:
    """Zero-phase filter of series numbered from 1, with odd extension by ``pad`` rows; (session_id, i, x)."""
    return f"""{out}_n AS (SELECT session_id, count(*) AS n, min_by(x, i) AS a, max_by(x, i) AS z FROM {source} GROUP BY 1),
{out}_w AS MATERIALIZED (SELECT session_id, i + {pad} AS i, x FROM {source} UNION ALL SELECT session_id, {pad + 2} - i, 2 * a - x FROM {source} JOIN {out}_n USING (session_id) WHERE i BETWEEN 2 AND {pad + 1}
  UNION ALL SELECT session_id, 2 * n - i + {pad}, 2 * z - x FROM {source} JOIN {out}_n USING (session_id) WHERE i BETWEEN n - {pad} AND n - 1),
{cascade(f'{out}_w', f'{out}_f', sections)}, {out}_t AS MATERIALIZED (SELECT session_id, n + {2 * pad + 1} - i AS i, y AS x FROM {out}_f JOIN {out}_n USING (session_id)),
{cascade(f'{out}_t', f'{out}_b', sections)}, {out} AS MATERIALIZED (SELECT session_id, n + {pad + 1} - b.i AS i, y AS x FROM {out}_b b JOIN {out}_n USING (session_id) WHERE b.i BETWEEN {pad + 1} AND n + {pad})"""


def top_peaks(source: str, out: str, distance: int) -> str:
    """Local maxima, higher ones first, none nearer than ``distance`` to one kept before."""
    return f"""{out}_m AS (SELECT session_id, i, x, row_number() OVER (PARTITION BY session_id ORDER BY x DESC) AS r FROM (SELECT * FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY i) QUALIFY x > lag(x) OVER w AND x > lead(x) OVER w)),
{out}_g(session_id, r, kept) AS (SELECT DISTINCT session_id, 0::BIGINT, []::BIGINT[] FROM {source} UNION ALL
 SELECT g.session_id, m.r, CASE WHEN len(list_filter(kept, lambda q: abs(q - m.i) < {distance})) = 0 THEN list_append(kept, m.i) ELSE kept END FROM {out}_g g JOIN {out}_m m ON m.session_id = g.session_id AND m.r = g.r + 1),
{out} AS (SELECT session_id, unnest(max_by(kept, r)) AS p FROM {out}_g GROUP BY 1)"""


_GRAVITY = SQL["complementary_filter"].removeprefix("WITH RECURSIVE ").rpartition("\nSELECT")[0].replace("0.05::DOUBLE", "0.04::DOUBLE")
#: Principal axes by squaring the covariance, its trace kept at 1.
_SQUARED = "xx * xx + xy * xy + xz * xz, xx * xy + xy * yy + xz * yz, xx * xz + xy * yz + xz * zz, xy * xy + yy * yy + yz * yz, xy * xz + yy * yz + yz * zz, xz * xz + yz * yz + zz * zz"
_NAMES = ("xx", "xy", "xz", "yy", "yz", "zz")
SQL["imu_vitals"] = f"""WITH RECURSIVE {_GRAVITY},
six AS MATERIALIZED (SELECT session_id * 16 AS session_id, seq AS i, ax AS x FROM a UNION ALL SELECT session_id * 16 + 1, seq, ay FROM a UNION ALL SELECT session_id * 16 + 2, seq, az FROM a
  UNION ALL SELECT session_id * 16 + 4, seq, x FROM k UNION ALL SELECT session_id * 16 + 5, seq, y FROM k UNION ALL SELECT session_id * 16 + 6, seq, z FROM k),
three AS MATERIALIZED (SELECT session_id, i, x FROM six WHERE session_id % 16 < 4),
{there_and_back('six', 'slow', SLOW, 27)}, {there_and_back('three', 'fast', FAST, 27)},
part AS (SELECT session_id // 16 AS session_id, session_id % 16 // 4 AS kind, session_id % 4 AS axis, i, x FROM slow UNION ALL SELECT session_id // 16, 2, session_id % 4, i, x FROM fast),
vec AS MATERIALIZED (SELECT session_id * 4 + kind AS session_id, i, max(x) FILTER (axis = 0) AS x, max(x) FILTER (axis = 1) AS y, max(x) FILTER (axis = 2) AS z FROM part GROUP BY session_id, kind, i),
cov AS (SELECT session_id, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy, covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM vec GROUP BY 1),
sq(session_id, step, {', '.join(_NAMES)}) AS (SELECT session_id, 0, {', '.join(f'{n} / (xx + yy + zz)' for n in _NAMES)} FROM cov UNION ALL SELECT session_id, step + 1, {', '.join(f'{n} / (xx + yy + zz)' for n in _NAMES)} FROM (SELECT session_id, step, {', '.join(f'{e} AS {n}' for e, n in zip(_SQUARED.split(', '), _NAMES))} FROM sq WHERE step < 22)),
col AS (SELECT session_id, CASE WHEN xx >= yy AND xx >= zz THEN [xx, xy, xz] WHEN yy >= zz THEN [xy, yy, yz] ELSE [xz, yz, zz] END AS v FROM sq WHERE step = 22),
axis AS (SELECT session_id, list_transform(v, lambda e: e / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) AS v FROM col),
along AS MATERIALIZED (SELECT session_id // 4 AS session_id, session_id % 4 AS kind, i, (x * v[1] + y * v[2] + z * v[3]) * sign(CASE WHEN abs(v[1]) >= abs(v[2]) AND abs(v[1]) >= abs(v[3]) THEN v[1] WHEN abs(v[2]) >= abs(v[3]) THEN v[2] ELSE v[3] END) AS x FROM vec JOIN axis USING (session_id)),
tilt AS MATERIALIZED (SELECT session_id, i, degrees(x) AS x FROM along WHERE kind = 1),
moved AS (SELECT session_id, i, coalesce((x + lag(x) OVER w) / 2 * 0.04::DOUBLE, 0) AS d FROM along WHERE kind = 0 WINDOW w AS (PARTITION BY session_id ORDER BY i)), speed AS (SELECT session_id, i, sum(d) OVER (PARTITION BY session_id ORDER BY i) AS v FROM moved),
stepped AS (SELECT session_id, i, coalesce((v + lag(v) OVER w) / 2 * 0.04::DOUBLE, 0) AS d FROM speed WINDOW w AS (PARTITION BY session_id ORDER BY i)), way AS (SELECT session_id, i, sum(d) OVER (PARTITION BY session_id ORDER BY i) AS x FROM stepped),
line AS (SELECT session_id, regr_slope(x, i) AS slope, regr_intercept(x, i) AS base FROM way GROUP BY 1), path AS MATERIALIZED (SELECT session_id, i, x - base - slope * i AS x FROM way JOIN line USING (session_id)),
{top_peaks('tilt', 'tips', 37)}, {top_peaks('path', 'turns', 37)},
high AS (SELECT tips.session_id, p, x AS h FROM tips JOIN tilt ON tilt.session_id = tips.session_id AND tilt.i = p),
edge AS (SELECT high.session_id, p, h, max(i) FILTER (i < p AND x > h) AS l, min(i) FILTER (i > p AND x > h) AS r FROM high JOIN tilt USING (session_id) GROUP BY 1, 2, 3),
rise AS (SELECT edge.session_id, p, h - greatest(min(x) FILTER (i > coalesce(l, 0) AND i <= p), min(x) FILTER (i >= p AND i < coalesce(r, 1000000000))) AS prominence FROM edge JOIN tilt USING (session_id) GROUP BY edge.session_id, p, h),
breaths AS (SELECT session_id, count(*) AS c FROM rise WHERE prominence >= 0.0005::DOUBLE GROUP BY 1), sways AS (SELECT session_id, count(*) AS c FROM turns GROUP BY 1),
s AS (SELECT session_id, i AS seq, x FROM along WHERE kind = 2), n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1), rate AS (SELECT session_id, n, 25.0::DOUBLE AS fs FROM n), {spectrum('1')},
pulse AS (SELECT session_id, {top('0.65', '4.0')} * 60 AS bpm FROM power GROUP BY 1)
SELECT n.session_id, 25.0::DOUBLE AS sample_rate_hz, round(coalesce(breaths.c, 0) / ((n - 1) * 0.04::DOUBLE / 60), 6) + 0.0 AS respiratory_bpm, round(coalesce(sways.c, 0) / ((n - 1) * 0.04::DOUBLE / 60), 6) + 0.0 AS displacement_bpm, round(bpm, 6) + 0.0 AS heart_bpm, NULL::VARCHAR AS error
FROM n JOIN pulse USING (session_id) LEFT JOIN breaths USING (session_id) LEFT JOIN sways USING (session_id)"""


# -- views ------------------------------------------------------------------------------

#: Second-order band-passes of 0.1 to 0.7 Hz and of 0.65 to 3 Hz at 20 Hz, as above.
VIEW_RESP = [([0.20078443336478757, 0.0, -0.20078443336478757], [1.0, -1.7623014104847556, 0.797350500978769]), ([0.038948278521618446, 0.0, -0.038948278521618446], [1.0, -1.9594923827232358, 0.9606899349821317])]
VIEW_HEART = [([0.48305901149900893, 0.0, -0.48305901149900893], [1.0, -0.9603349285926864, 0.44861767548339115]), ([0.1826015411834471, 0.0, -0.1826015411834471], [1.0, -1.7440331190764604, 0.7915715060865789])]


def listed(source: str, x: str, by: str = "i") -> str:
    return f"(SELECT session_id, list(round({x}, 6) + 0.0 ORDER BY {by}) AS v FROM {source} GROUP BY 1)"


#: Sessions have from 202 to 4,096 rows.
SQL["radar_view"] = f"""WITH RECURSIVE stats AS ({SQL['radar_stats']}), o0 AS ({RADAR}), last AS (SELECT session_id, max(t_ms) AS last FROM o0 GROUP BY 1),
s AS (SELECT session_id, seq, t_ms, x FROM o0 JOIN last USING (session_id) WHERE t_ms >= last - 10000), rate AS (SELECT DISTINCT session_id, 20.0::DOUBLE AS fs FROM s), v AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, t_ms, x FROM s),
{spectrum('(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))')}, {cleaned('s')}, c AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i, x FROM flat),
{there_and_back('c', 'slow', VIEW_RESP, 15)}, {there_and_back('c', 'quick', VIEW_HEART, 15)}, w AS (SELECT session_id, i, (t_ms - min(t_ms) OVER (PARTITION BY session_id)) / 1000 AS t, x FROM v)
SELECT stats.* EXCLUDE (error), tt.v AS t, xx.v AS x, hh.v AS hz, aa.v AS amplitude, rr.v AS resp, bb.v AS heart, NULL::VARCHAR AS error FROM stats JOIN {listed('w', 't')} tt USING (session_id) JOIN {listed('w', 'x')} xx USING (session_id)
JOIN {listed('power', 'hz', 'k')} hh USING (session_id) JOIN {listed('power', 'sqrt(power) / n', 'k')} aa USING (session_id) JOIN {listed('slow', 'x')} rr USING (session_id) JOIN {listed('quick', 'x')} bb USING (session_id)"""
SQL["imu_view"] = f"""WITH stats AS ({SQL['imu_stats']}), s AS ({SIZE}), {RATES}, {spectrum('(0.5 - 0.5 * cos(2 * pi() * i / (n - 1)))')}, w AS (SELECT session_id, seq AS i, (t_ms - min(t_ms) OVER (PARTITION BY session_id)) / 1000 AS t, x FROM s)
SELECT stats.* EXCLUDE (error), tt.v AS t, xx.v AS x, hh.v AS hz, aa.v AS amplitude, []::DOUBLE[] AS resp, []::DOUBLE[] AS heart, NULL::VARCHAR AS error FROM stats JOIN {listed('w', 't')} tt USING (session_id) JOIN {listed('w', 'x')} xx USING (session_id)
JOIN {listed('power', 'hz', 'k')} hh USING (session_id) JOIN {listed('power', 'sqrt(power) / n', 'k')} aa USING (session_id)"""

# -- long recordings -------------------------------------------------------------------

WHOLE = f"SELECT session_id % 3 AS session_id, seq, t_ms, x FROM ({S})"
_AHEAD = "w AS (PARTITION BY session_id ORDER BY seq)"
_STEP = f"d AS (SELECT session_id, seq, x / 80 - lag(x / 80) OVER w AS d, first_value(x / 80) OVER w AS first FROM s WINDOW {_AHEAD})"
_SUM = "round(sum(coalesce({step}, 0)) OVER (PARTITION BY session_id ORDER BY seq){base}, 6) + 0.0"
_LIVE = "CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END"
SQL["long_unwrap"] = f"""WITH s AS ({WHOLE}), {_STEP} SELECT session_id, seq, {_SUM.format(step=_LIVE, base="")} AS live, {_SUM.format(step=MOD, base="")} AS mod,
{_SUM.format(step=f"CASE WHEN abs(d) < pi() THEN d WHEN {MOD} = -pi() AND d > 0 THEN pi() ELSE {MOD} END", base=" + first")} AS first FROM d"""
SQL["long_turned_phase"] = f"""WITH s AS ({WHOLE}), {_STEP} SELECT session_id, seq, {_SUM.format(step=MOD, base="")} AS phase FROM d"""
SQL["long_integral"] = f"""WITH s AS (SELECT session_id, seq, t_ms % 86400000 / 86400000 + seq / 100::DOUBLE AS t, x / 1000 AS x FROM ({WHOLE})),
a AS (SELECT session_id, seq, t, coalesce((x + lag(x) OVER w) / 2 * (t - lag(t) OVER w), 0) AS step FROM s WINDOW {_AHEAD}),
v AS (SELECT session_id, seq, t, sum(step) OVER w AS v FROM a WINDOW {_AHEAD}), b AS (SELECT session_id, seq, v, coalesce((v + lag(v) OVER w) / 2 * (t - lag(t) OVER w), 0) AS step FROM v WINDOW {_AHEAD})
SELECT session_id, seq, round(v, 6) + 0.0 AS velocity, round(sum(step) OVER w, 3) + 0.0 AS path FROM b WINDOW {_AHEAD}"""
for _name in ("time_rebase", "clean_signal", "bandpass_causal", "bandpass_causal_clean", "bandpass_zero_phase", "band_spectra"):
    _long = {"time_rebase": "long_rebase", "clean_signal": "long_clean", "bandpass_causal_clean": "long_bandpass_clean", "band_spectra": "long_spectrum"}
    SQL[_long.get(_name, f"long_{_name}")] = SQL[_name].replace(f"s AS ({S})", f"s AS ({WHOLE})")
#: From the first value on: y = keep * y + (1 - keep) * x, a weighted sum of all values so far.
SQL["long_average"] = f"""WITH RECURSIVE s AS ({WHOLE}), i AS MATERIALIZED ({numbered("s")}),
r(session_id, i, y) AS (SELECT session_id, 1::BIGINT, x FROM i WHERE i = 1 UNION ALL SELECT i.session_id, i.i, exp(-1 / 40::DOUBLE) * y + (1 - exp(-1 / 40::DOUBLE)) * i.x FROM r JOIN i ON i.session_id = r.session_id AND i.i = r.i + 1)
SELECT session_id, seq, round(y, 6) + 0.0 AS y FROM r JOIN i USING (session_id, i)"""


# -- files and the clustered store -----------------------------------------------------

_RADAR_NAMES, _IMU_NAMES = "['Timestamp_ms', 'RawADC', 'Voltage_mV']", "['Time_ms', 'ax', 'ay', 'az', 'gx', 'gy', 'gz']"
_FRAME_NAMES = "['Timestamp_ms', 'Frame', 'PeakDistance_m', 'PeakAmplitude', 'PeakPhase_rad', 'MeanAmplitude', 'Distances_m', 'Amplitude', 'Phase', 'Real', 'Imag']"
SQL["sensor_detect"] = f"""WITH p AS (SELECT p_partkey, [{_RADAR_NAMES}, list_append({_FRAME_NAMES}, 'extra'), {_IMU_NAMES}, list_concat({_RADAR_NAMES}, {_IMU_NAMES}), {_RADAR_NAMES}[1:2], list_concat({_FRAME_NAMES}[1:10], {_IMU_NAMES})][p_size % 6 + 1] AS c FROM part)
SELECT p_partkey, CASE WHEN list_has_all(c, {_RADAR_NAMES}) THEN 'radar' WHEN list_has_all(c, {_FRAME_NAMES}) THEN 'a121' WHEN list_has_all(c, {_IMU_NAMES}) THEN 'imu' END AS sensor FROM p"""
SQL["batch_radar"] = f"""SELECT session_id::VARCHAR AS session_id, sample_rate_hz, peak_frequency_hz, peak_speed_mps, error FROM ({SQL["radar_vitals"]})
UNION ALL SELECT 'respiratory_6axis_raw_' || k || '.csv', NULL, NULL, NULL, 'missing radar columns: Timestamp_ms, RawADC, Voltage_mV' FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey <= 3)"""
SQL["batch_imu"] = SQL["imu_vitals"]
SQL["clustered_store"] = f"""WITH s AS ({S}) SELECT session_id, 'radar' AS sensor, count(*) + (session_id % 2 = 0)::INT AS sample_count, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_mv, min_by(x, seq) AS first_mv FROM s GROUP BY 1"""
