"""The bar queries in DuckDB's SQL."""

from __future__ import annotations

from tickloom.plans import queries as q


def _bars(unit: str) -> str:
    return f"""bars AS (SELECT event_type AS symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS "close", count(*) AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, (high + low + "close") / 3 AS tp FROM bars)"""


H, D = f"WITH {_bars('hour')}", f"WITH {_bars('day')}"
HR, DR = H.replace("WITH", "WITH RECURSIVE", 1), D.replace("WITH", "WITH RECURSIVE", 1)
ONE = "o AS (SELECT *, 100000 * (dense_rank() OVER (ORDER BY symbol) - 1) + i AS g FROM b)"
DIRTY = f"""{D},
t AS (SELECT symbol, i, CASE WHEN i % 13 = 5 THEN CAST('NaN' AS DOUBLE) ELSE open END AS open, CASE WHEN i % 7 = 0 THEN low * 0.5 ELSE high END AS high, low, CASE WHEN i % 11 = 3 THEN -"close" ELSE "close" END AS "close", CASE WHEN i % 5 = 2 THEN 0 ELSE volume END AS volume FROM b),
n AS (SELECT *, isnan(open) AS bad, CASE WHEN (NOT isnan(open) AND open <= 0) OR high <= 0 OR low <= 0 OR "close" <= 0 THEN 'All prices must be positive' WHEN high < low THEN 'High price cannot be less than low price' WHEN (NOT isnan(open) AND high < open) OR high < "close" THEN 'High price must be >= open and close prices' WHEN (NOT isnan(open) AND low > open) OR low > "close" THEN 'Low price must be <= open and close prices' END AS e FROM t)"""
CELLS = f"""{H},
cells AS (SELECT symbol, i AS row_idx, f AS field, p AS price FROM (SELECT symbol, i, unnest(['open', 'high', 'low', 'close']) f, unnest([open, high, low, "close"]) p FROM b)),
ranked AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY price) - 1 r, count(*) OVER (PARTITION BY symbol) n FROM cells)"""
VWAP = "CASE WHEN sum(volume) = 0 THEN 0 ELSE round(sum(tp * volume) / sum(volume), 6) END AS vwap"
SCOPE = f"SELECT symbol, {VWAP}, CAST(sum(volume) AS DOUBLE) AS total_volume, count(*) AS data_points FROM"
#: Signals of single bars.
SIGNALS = """g AS (SELECT *, CASE WHEN volume = 0 THEN 0 ELSE tp * volume / volume END AS vw, ("close" - tp) / tp AS dev FROM b),
s AS (SELECT symbol, i, ts, "close" AS price, volume, vw AS vwap, CASE WHEN dev > 0.001 THEN 'Buy' WHEN -dev > 0.001 THEN 'Sell' ELSE 'Hold' END AS sig, abs(dev) AS power, 0.5 + least(abs(dev) * 10, 0.4) AS conf FROM g)"""
#: The strategy as a recursion over the bars of all symbols at once.
STRATEGY = f"""{HR},
{SIGNALS},
st AS (SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS opened, CAST(NULL AS VARCHAR) AS closed, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS pnl, CAST(NULL AS DOUBLE) AS duration, CAST(NULL AS DOUBLE) AS standard_pnl, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS DOUBLE) AS entry, CAST(NULL AS DOUBLE) AS held, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS target, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS rec FROM b
UNION ALL
SELECT symbol, i, CASE WHEN out_ THEN 'Exit' WHEN NOT cold THEN sig END, price, CASE WHEN out_ THEN 1.0 ELSE conf END, op, CASE WHEN out_ THEN side END, CASE WHEN out_ THEN held WHEN op IS NOT NULL THEN 10000 * least(power, 1.0) END, CASE WHEN out_ THEN price - rec END, CASE WHEN out_ THEN greatest(0, t - last) END, CASE WHEN out_ THEN CASE side WHEN 'Long' THEN price - entry ELSE entry - price END END,
CASE WHEN out_ THEN NULL ELSE coalesce(op, side) END, CASE WHEN op IS NOT NULL THEN price ELSE entry END, CASE WHEN op IS NOT NULL THEN 10000 * least(power, 1.0) ELSE held END, CASE op WHEN 'Long' THEN price * 0.98 WHEN 'Short' THEN price * 1.02 ELSE stop END, CASE op WHEN 'Long' THEN price * 1.04 WHEN 'Short' THEN price * 0.96 ELSE target END, CASE WHEN out_ OR cold THEN last ELSE t END, CASE WHEN out_ OR cold THEN rec ELSE price END
FROM (SELECT *, CASE WHEN NOT out_ AND NOT cold AND side IS NULL AND conf >= 0.6 AND sig = 'Buy' THEN 'Long' WHEN NOT out_ AND NOT cold AND side IS NULL AND conf >= 0.6 AND sig = 'Sell' THEN 'Short' END AS op FROM (SELECT s.symbol, s.i, s.price, s.sig, s.power, s.conf, CAST(epoch(s.ts) AS DOUBLE) AS t, st.side, st.entry, st.held, st.stop, st.target, st.last, st.rec, coalesce((st.side = 'Long' AND (s.price <= st.stop OR s.price >= st.target)) OR (st.side = 'Short' AND (s.price >= st.stop OR s.price <= st.target)), false) AS out_, coalesce(CAST(epoch(s.ts) AS DOUBLE) - st.last < 60, false) AS cold FROM st JOIN s ON s.symbol = st.symbol AND s.i = st.i + 1))),
em AS (SELECT * FROM st WHERE signal IS NOT NULL),
tr AS (SELECT symbol, i, row_number() OVER (PARTITION BY symbol ORDER BY i) AS trade, pnl FROM em WHERE signal = 'Exit'),
eq AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY trade)) AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY trade) AS equity FROM tr))"""
ALERTS = f"""{STRATEGY},
up AS (SELECT symbol, i, coalesce(sum(p) OVER w, 0) AS pnl, count(*) FILTER (p > 0) OVER w AS won, count(*) FILTER (p < 0) OVER w AS lost FROM (SELECT symbol, i, CASE WHEN signal = 'Exit' THEN pnl END AS p FROM em) WINDOW w AS (PARTITION BY symbol ORDER BY i)),
mt AS (SELECT *, CASE WHEN peak > 0 THEN (peak - pnl) / peak ELSE 0 END AS dd, CASE WHEN won + lost > 0 THEN won / (won + lost) ELSE 0 END AS rate FROM (SELECT *, greatest(0, max(pnl) OVER (PARTITION BY symbol ORDER BY i)) AS peak FROM up)),
al AS (SELECT symbol, i AS row_idx, 'DrawdownExceeded' AS alert_type, dd AS current, CAST(0.1 AS DOUBLE) AS threshold FROM mt WHERE dd > 0.1 UNION ALL SELECT symbol, i, 'WinRateLow', rate, 0.5 FROM mt WHERE rate < 0.5 AND won + lost > 10 UNION ALL SELECT symbol, i, 'PnLLow', pnl, -1000.0 FROM mt WHERE pnl < -1000)"""

#: The strategy's closed trades at a commission of 0.001, and the curve of a capital of 10000.
CURVE = f"""{STRATEGY},
ga AS (SELECT em.symbol, em.i, b.ts, size * (standard_pnl / price) - size * 0.001 * 2 AS g FROM em JOIN b USING (symbol, i) WHERE signal = 'Exit'),
cu AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY i)) AS peak FROM (SELECT *, 10000 + sum(g) OVER (PARTITION BY symbol ORDER BY i) AS equity FROM ga)),
be AS (SELECT *, (peak - equity) / peak AS below, g > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY i) - row_number() OVER (PARTITION BY symbol, g > 0 ORDER BY i) AS island FROM cu)"""
REASON = "CASE WHEN dev > 0.001 THEN printf('Price %.2f%% above VWAP', power * 100) WHEN -dev > 0.001 THEN printf('Price %.2f%% below VWAP', power * 100) ELSE 'Price within VWAP threshold' END"


def _square(a: str, b: str, names: str = "o h l c") -> str:
    return " + ".join(f"({a}.{n} - {b}.{n}) * ({a}.{n} - {b}.{n})" for n in names.split())


def _kmeans(last: str) -> str:
    parts = [f"{D}, x AS (SELECT symbol, i, open o, high h, low l, \"close\" c, volume / 1000.0 v FROM b), c0 AS (SELECT row_number() OVER (ORDER BY symbol, i) - 1 k, o, h, l, c, v FROM x ORDER BY symbol, i LIMIT 3)"]
    for t in (1, 2, 3):
        parts.append(f"a{t} AS (SELECT x.symbol, x.i, arg_min(c{t - 1}.k, (sqrt({_square('x', f'c{t - 1}', 'o h l c v')}), c{t - 1}.k)) k FROM x, c{t - 1} GROUP BY x.symbol, x.i)")
        parts.append(f"c{t} AS (SELECT r.k, coalesce(avg(o), 0) o, coalesce(avg(h), 0) h, coalesce(avg(l), 0) l, coalesce(avg(c), 0) c, coalesce(avg(v), 0) v FROM (SELECT unnest(range(3)) k) r LEFT JOIN (SELECT * FROM x JOIN a{t} USING (symbol, i)) y ON r.k = y.k GROUP BY r.k)")
    return ", ".join(parts) + last


EDGES = f"e AS (SELECT a.p, a.g AS i, b.g AS j FROM x a JOIN x b ON a.p = b.p WHERE sqrt({_square('a', 'b')}) <= {q.EPSILON})"
COMPONENTS = f"""{EDGES},
core AS (SELECT p, i FROM e GROUP BY p, i HAVING count(*) >= {q.MIN_POINTS}),
ce AS (SELECT e.p, e.i, e.j FROM e JOIN core u ON e.i = u.i JOIN core v ON e.j = v.i),
cc(p, i, r) AS (SELECT p, i, i FROM core UNION SELECT ce.p, ce.j, cc.r FROM cc JOIN ce ON ce.i = cc.i),
lab AS (SELECT p, i, seed, dense_rank() OVER (PARTITION BY p ORDER BY seed) AS cl FROM (SELECT p, i, min(r) AS seed FROM cc GROUP BY p, i)),
bo AS (SELECT e.i, min(l.seed) AS seed, arg_min(l.cl, l.seed) AS cl FROM e JOIN lab l ON l.i = e.j WHERE e.i NOT IN (SELECT i FROM core) GROUP BY e.i)"""


def _dbscan(late: bool, part: str = "0") -> str:
    keep = "bo.cl" if late else "CASE WHEN bo.seed < x.g THEN bo.cl END"
    return f"""{DR}, {ONE}, x AS (SELECT symbol, g, {part} AS p, open o, high h, low l, "close" c FROM o), {COMPONENTS},
r AS (SELECT x.*, CAST(coalesce(lab.cl, {keep}, 0) AS INTEGER) AS cluster, lab.cl IS NOT NULL AS is_core, lab.cl IS NULL AND {keep} IS NOT NULL AS is_border FROM x LEFT JOIN lab ON lab.i = x.g LEFT JOIN bo ON bo.i = x.g)"""


def _gmm(last: str) -> str:
    names = "o h l c v".split()
    rows = ", ".join(f"({k}, 0.5, {', '.join(map(str, m))}, {', '.join(['5001.0'] * 5)})" for k, m in enumerate(q.GMM_MEANS))
    parts = [f"{D}, x AS (SELECT symbol, i, open o, high h, low l, \"close\" c, CAST(volume AS DOUBLE) v FROM b), p0(k, w, {', '.join(names)}, {', '.join('s' + n for n in names)}) AS (VALUES {rows})"]
    e = lambda t: f"e{t} AS (SELECT symbol, i, x.o, x.h, x.l, x.c, x.v, k, w * exp(-0.5 * ({' + '.join(f'(x.{n} - p.{n}) * (x.{n} - p.{n}) / p.s{n}' for n in names)}) - 0.5 * ({' + '.join(f'ln(p.s{n})' for n in names)})) d FROM x, p{t} p)"
    for t in (0, 1):
        parts.append(e(t))
        parts.append(f"r{t} AS (SELECT *, CASE WHEN sum(d) OVER (PARTITION BY symbol, i) > 0 THEN d / sum(d) OVER (PARTITION BY symbol, i) ELSE 0 END z FROM e{t})")
        parts.append(f"m{t} AS (SELECT k, sum(z) s, {', '.join(f'sum(z * {n}) / sum(z) {n}' for n in names)} FROM r{t} GROUP BY k)")
        parts.append(f"p{t + 1} AS (SELECT m.k, m.s / (SELECT sum(s) FROM m{t}) w, {', '.join(f'm.{n}' for n in names)}, {', '.join(f'sum(z * (r.{n} - m.{n}) * (r.{n} - m.{n})) / m.s + 5000 s{n}' for n in names)} FROM r{t} r JOIN m{t} m USING (k) GROUP BY m.k, m.s, {', '.join(f'm.{n}' for n in names)})")
    parts.append(e(2))
    return ", ".join(parts) + last


THIRDS = f"{D}, {ONE}, x AS (SELECT g, CAST(g % 3 AS INTEGER) AS k, open o, high h, low l, \"close\" c, CAST(volume AS DOUBLE) v FROM o)"
_PAIR = f"sqrt({_square('a', 'b', 'o h l c v')})"
SIL = f"""{THIRDS},
pr AS (SELECT a.g, a.k, b.k AS k2, sum({_PAIR}) AS d, count(*) AS n FROM x a, x b GROUP BY a.g, a.k, b.k),
sl AS (SELECT g, k, max(CASE WHEN k = k2 AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN k <> k2 THEN d / n END) AS b FROM pr GROUP BY g, k),
si AS (SELECT g, k, CASE WHEN b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM sl WHERE a IS NOT NULL)"""
_MEANS = ", ".join(f"avg({n}) AS {n}" for n in "ohlcv")
INDICES = f"""{SIL},
ce AS (SELECT k, count(*) AS n, {_MEANS} FROM x GROUP BY k), gm AS (SELECT count(*) AS t, {_MEANS} FROM x),
sp AS (SELECT b.k, avg({_PAIR}) AS s, sum({_square('a', 'b', 'o h l c v')}) AS w FROM x a JOIN ce b ON a.k = b.k GROUP BY b.k),
dbi AS (SELECT avg(r) AS davies_bouldin FROM (SELECT a.k, max((sa.s + sb.s) / {_PAIR}) AS r FROM ce a JOIN ce b ON a.k <> b.k JOIN sp sa ON sa.k = a.k JOIN sp sb ON sb.k = b.k GROUP BY a.k)),
chi AS (SELECT (SELECT sum(a.n * ({_square('a', 'b', 'o h l c v')})) FROM ce a, gm b) / ((SELECT count(*) FROM ce) - 1) / ((SELECT sum(w) FROM sp) / ((SELECT t FROM gm) - (SELECT count(*) FROM ce))) AS calinski_harabasz),
du AS (SELECT min(CASE WHEN a.k <> b.k THEN {_PAIR} END) / max(CASE WHEN a.k = b.k THEN {_PAIR} END) AS dunn FROM x a JOIN x b ON a.g < b.g),
sv AS (SELECT avg(s) AS silhouette FROM si)"""
SIZES = f"{THIRDS}, sz AS (SELECT CAST(r.k AS INTEGER) AS cluster, count(x.g) AS size FROM (SELECT unnest(range(4)) AS k) r LEFT JOIN x ON x.k = r.k GROUP BY r.k)"
ROLL = f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {q.ROLLING - 1} PRECEDING AND CURRENT ROW)"
TECH = f"""r AS (SELECT *, CASE WHEN lag("close") OVER (PARTITION BY symbol ORDER BY i) IS NOT NULL THEN ("close" - lag("close") OVER (PARTITION BY symbol ORDER BY i)) / lag("close") OVER (PARTITION BY symbol ORDER BY i) END AS ret FROM b),
te AS (SELECT symbol, i, "close", volume, ret, stddev_pop(ret) OVER {ROLL} AS vol, volume / avg(volume) OVER {ROLL} AS vr, (high - low) / "close" AS rr, sum(tp * volume) OVER {ROLL} / sum(volume) OVER {ROLL} AS vw, sum(tp * volume) OVER (PARTITION BY symbol ORDER BY i) / sum(volume) OVER (PARTITION BY symbol ORDER BY i) AS run FROM r)"""
SWING = """sw AS (SELECT *, high > lag(high) OVER w AND high > lag(high, 2) OVER w AND high > lead(high) OVER w AND high > lead(high, 2) OVER w AS top, low < lag(low) OVER w AND low < lag(low, 2) OVER w AND low < lead(low) OVER w AND low < lead(low, 2) OVER w AS bottom, sum(tp * volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vw FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i)),
pt AS (SELECT symbol, i, ts, 'high' AS kind, high AS price, vw FROM sw WHERE top UNION ALL SELECT symbol, i, ts, 'low', low, vw FROM sw WHERE bottom)"""


def _sql() -> dict[str, str]:
    stamp = lambda t: f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'"
    out = {
        "bars_hourly": f'{H} SELECT symbol, ts AS timestamp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round("close", 6) AS "close", volume, i AS row_idx FROM b',
        "bars_lineitem": """WITH l AS (SELECT l_returnflag AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS timestamp, l_extendedprice / l_quantity AS p, l_quantity AS v, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem)
SELECT symbol, timestamp, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS "close", CAST(sum(v) AS BIGINT) AS volume FROM l GROUP BY 1, 2""",
        "candle_metrics": f'{H} SELECT symbol, ts AS timestamp, round(high - low, 6) AS "range", round(abs("close" - open), 6) AS body, round(high - greatest(open, "close"), 6) AS upper, round(least(open, "close") - low, 6) AS lower, round(tp, 6) AS typical, round((high + low + "close" + "close") / 4, 6) AS weighted FROM b',
        "candle_flags": f'{H} SELECT symbol, ts AS timestamp, "close" > open AS bullish, "close" < open AS bearish, abs("close" - open) <= 5 AS doji FROM b',
        "features_f11": f'{H} SELECT symbol, i AS row_idx, round(open, 6) AS f0, round(high, 6) AS f1, round(low, 6) AS f2, round("close", 6) AS f3, CAST(volume AS DOUBLE) AS f4, round(high - low, 6) AS f5, round(abs("close" - open), 6) AS f6, round(high - greatest(open, "close"), 6) AS f7, round(least(open, "close") - low, 6) AS f8, round(tp, 6) AS f9, round((high + low + "close" + "close") / 4, 6) AS f10 FROM b',
        "returns": f'{H} SELECT symbol, i AS row_idx, round(("close" - p) / p, 6) AS returns, round(ln("close" / p), 6) AS log_returns FROM (SELECT *, lag("close") OVER (PARTITION BY symbol ORDER BY i) AS p FROM b)',
        "validate_logical": f"{DIRTY} SELECT symbol, i AS row_idx, 'LogicalConsistency' AS error_type, 'Invalid OHLCV data: ' || e AS message FROM n WHERE e IS NOT NULL",
        "validate_price_range": f"{DIRTY} SELECT symbol, i AS row_idx, 'PriceRange' AS error_type FROM n WHERE bad OR NOT (open >= 0 AND open < 490 AND high >= 0 AND high < 490 AND low >= 0 AND low < 490 AND \"close\" >= 0 AND \"close\" < 490)",
        "validate_volume": f"{DIRTY} SELECT symbol, i AS row_idx, 'VolumeThreshold' AS error_type, 'Volume ' || volume || ' is below threshold 10' AS message FROM n WHERE volume < 10",
        "validate_missing": f"{DIRTY} SELECT symbol, i AS row_idx, 'NoMissingValues' AS error_type FROM n WHERE bad",
        "validate_custom": f"{DIRTY} SELECT symbol, i AS row_idx, 'Custom' AS error_type, 'close above 200' AS message FROM n WHERE \"close\" > 200",
        "validate_all": f"{DIRTY} SELECT symbol, i AS row_idx, k AS error_type FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS r FROM (SELECT symbol, i, CASE WHEN e IS NOT NULL THEN 'LogicalConsistency' WHEN volume < 10 THEN 'VolumeThreshold' WHEN bad THEN 'NoMissingValues' END AS k FROM n) WHERE k IS NOT NULL) WHERE r <= 5",
        "dup_timestamps": f"{H} SELECT symbol, i AS row_idx, p AS previous_idx FROM (SELECT symbol, i, lag(i) OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY i) AS p FROM b) WHERE p IS NOT NULL",
        "chrono_order": f"{H} SELECT symbol, j AS row_idx FROM (SELECT symbol, j, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY j) AS p FROM (SELECT symbol, ts, i * 7919 % 100003 AS j FROM b)) WHERE ts <= p",
        "time_gaps": f"{H} SELECT symbol, i AS row_idx, g AS gap_seconds FROM (SELECT symbol, i, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY i)) AS BIGINT) AS g FROM b) WHERE g > 3600",
        "outlier_zscore": f"{CELLS}, st AS (SELECT symbol, avg(price) AS m, stddev_pop(price) AS s FROM cells GROUP BY 1) SELECT symbol, row_idx, field, round(price, 6) AS price, round(abs(price - m) / s, 6) AS score FROM cells JOIN st USING (symbol) WHERE abs(price - m) / s > 2",
        "outlier_iqr": f"{CELLS}, qu AS (SELECT symbol, max(CASE WHEN r = n // 4 THEN price END) AS q1, max(CASE WHEN r = 3 * n // 4 THEN price END) AS q3 FROM ranked GROUP BY 1), bd AS (SELECT symbol, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM qu) SELECT symbol, row_idx, field, round(price, 6) AS price, round(low, 6) AS low, round(high, 6) AS high FROM cells JOIN bd USING (symbol) WHERE price < low OR price > high",
        "outlier_modz": f"{CELLS}, md AS (SELECT symbol, price AS m FROM ranked WHERE r = n // 2), o AS (SELECT cells.*, abs(price - m) AS d FROM cells JOIN md USING (symbol)), ma AS (SELECT symbol, max(d) AS mad FROM o GROUP BY 1) SELECT symbol, row_idx, field, round(price, 6) AS price, round(0.6745 * d / mad, 6) AS score FROM o JOIN ma USING (symbol) WHERE 0.6745 * d / mad > 0.3",
        "outlier_modz_standard": f"{CELLS}, md AS (SELECT symbol, price AS m FROM ranked WHERE r = n // 2), o AS (SELECT cells.*, abs(price - m) AS d FROM cells JOIN md USING (symbol)), ma AS (SELECT symbol, d AS mad FROM (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n FROM o) WHERE r = n // 2) SELECT symbol, row_idx, field, round(price, 6) AS price, round(0.6745 * d / mad, 6) AS score FROM o JOIN ma USING (symbol) WHERE 0.6745 * d / mad > 3.5",
        "price_stats": f"{CELLS} SELECT symbol, count(*) AS n, round(min(price), 6) AS min, round(max(price), 6) AS max, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std_dev, round(median(price), 6) AS median FROM cells GROUP BY 1",
        "volume_stats": f"{H} SELECT symbol, count(*) AS n, min(volume) AS min, max(volume) AS max, round(avg(volume), 6) AS mean, round(stddev_pop(volume), 6) AS std_dev, CAST(floor(median(volume)) AS BIGINT) AS median FROM b GROUP BY 1",
        "time_stats": f"{H} SELECT symbol, min(ts) AS first, max(ts) AS last, CAST(coalesce(sum(g), 0) AS BIGINT) AS total_seconds, round(coalesce(avg(g), 0), 6) AS avg_seconds, coalesce(min(g), 0) AS min_seconds, coalesce(max(g), 0) AS max_seconds FROM (SELECT *, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY i)) AS BIGINT) AS g FROM b) GROUP BY 1",
        "suspicious_bars": f'{DIRTY} SELECT symbol, i AS row_idx FROM n WHERE high < low OR open < 0 OR "close" < 0 OR volume = 0',
        "vwap_session": f"{H} {SCOPE} b GROUP BY 1",
        "vwap_rolling": f"{H} {SCOPE} (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= {q.ROLLING}) GROUP BY 1",
        "vwap_rolling_series": f"{H} SELECT symbol, i AS row_idx, ts AS timestamp, round(sum(tp * volume) OVER {ROLL} / sum(volume) OVER {ROLL}, 6) AS vwap, count(*) OVER {ROLL} AS data_points FROM b",
        "vwap_anchored": f"{H} {SCOPE} b WHERE ts >= {stamp(q.ANCHOR)} GROUP BY 1",
        "vwap_custom": f"{H} {SCOPE} b WHERE ts BETWEEN {stamp(q.START)} AND {stamp(q.END)} GROUP BY 1",
        "vwap_running": f"{H} SELECT symbol, i AS row_idx, ts AS timestamp, round(sum(tp * volume) OVER (PARTITION BY symbol ORDER BY i) / sum(volume) OVER (PARTITION BY symbol ORDER BY i), 6) AS vwap FROM b",
        "vwap_incremental": f"{H} SELECT symbol, i AS row_idx, ts AS timestamp, round(tp, 6) AS vwap, CAST(1 AS BIGINT) AS data_points FROM b WHERE ts >= {stamp(q.ANCHOR)}",
        "multi_timeframe_vwap": f"""{H}, en AS (SELECT symbol, max(ts) AS e, arg_max("close", ts) AS last_close FROM b GROUP BY 1), w AS (SELECT * FROM (VALUES ('1 DAY', INTERVAL 1 DAY), ('7 DAYS', INTERVAL 7 DAY)) t(timeframe, n)),
r AS (SELECT b.symbol, timeframe, sum(tp * volume) / sum(volume) AS vw, max(last_close) AS last_close FROM b JOIN en USING (symbol) JOIN w ON ts > e - n GROUP BY 1, 2) SELECT symbol, timeframe, round(vw, 6) AS vwap, round(last_close, 6) AS last_close, last_close > vw AS bullish, bool_and(last_close > vw) OVER (PARTITION BY symbol) AS all_bullish FROM r""",
        "signal_batch": f"""{H}, st AS (SELECT symbol, count(*) AS n, max(i) AS e, avg(volume) AS mv, sum(tp * volume) / sum(volume) AS vw FROM b GROUP BY 1),
r AS (SELECT b.symbol, b.ts, b."close" AS c, b.volume, vw, mv, n, (b."close" - vw) / vw AS dev, p."close" AS prev FROM st JOIN b ON b.symbol = st.symbol AND b.i = e LEFT JOIN b p ON p.symbol = st.symbol AND p.i = e - 1)
SELECT symbol, ts AS timestamp, CASE WHEN dev > 0.001 THEN 'Buy' WHEN -dev > 0.001 THEN 'Sell' ELSE 'Hold' END AS signal, CASE WHEN abs(dev) > 0.001 THEN round(abs(dev), 6) END AS strength, round(c, 6) AS price, volume, round(vw, 6) AS vwap, round(dev, 6) AS deviation, round(least(1, 0.5 + least(abs(dev) * 10, 0.3) + CASE WHEN n > 1 AND volume / mv > 1.5 THEN 0.2 ELSE 0 END + CASE WHEN n > 1 AND abs((c - prev) / prev) > 0.005 THEN 0.1 ELSE 0 END), 6) AS confidence FROM r""",
        "signal_incremental": f"{H}, {SIGNALS} SELECT symbol, i AS row_idx, ts AS timestamp, sig AS signal, CASE WHEN sig <> 'Hold' THEN round(power, 6) END AS strength, round(price, 6) AS price, volume, round(vwap, 6) AS vwap, round(conf, 6) AS confidence FROM s",
        "signal_counts": f"{H}, {SIGNALS} SELECT symbol, count(*) AS total, count(*) FILTER (sig = 'Buy') AS buys, count(*) FILTER (sig = 'Sell') AS sells, count(*) FILTER (sig = 'Hold') AS holds FROM s GROUP BY 1",
        "strategy_incremental": f"{STRATEGY} SELECT symbol, i AS row_idx, signal, round(price, 6) AS price, round(confidence, 6) AS confidence, opened, closed, round(size, 6) AS size, round(pnl, 6) AS pnl, duration, round(standard_pnl, 6) AS standard_pnl FROM em",
        "trade_metrics": f"{STRATEGY}, m AS (SELECT symbol, count(*) FILTER (pnl > 0) AS winning, count(*) FILTER (pnl < 0) AS losing, sum(pnl) AS t FROM tr GROUP BY 1) SELECT symbol, winning + losing AS total, winning, losing, CASE WHEN winning + losing > 0 THEN round(winning / (winning + losing), 6) ELSE 0 END AS win_rate, round(t, 6) AS total_pnl, CASE WHEN winning + losing > 0 THEN round(t / (winning + losing), 6) ELSE 0 END AS avg_pnl FROM m",
        "drawdown": f"{STRATEGY}, m AS (SELECT symbol, max((peak - equity) / greatest(peak, 1)) AS md, max(peak) AS pk, arg_max(equity, trade) AS ce FROM eq GROUP BY 1) SELECT symbol, round(md, 6) AS max_drawdown, CASE WHEN pk > 0 THEN round((pk - ce) / pk, 6) ELSE 0 END AS current_drawdown, round(pk, 6) AS peak_equity, round(ce, 6) AS current_equity FROM m",
        "sharpe_sortino": f"{STRATEGY}, m AS (SELECT symbol, avg(pnl) AS m, stddev_pop(pnl) AS s, sqrt(avg(CASE WHEN pnl < 0 THEN pnl * pnl END)) AS d FROM tr GROUP BY 1) SELECT symbol, CASE WHEN s > 0 THEN round(m / s, 6) ELSE 0 END AS sharpe, CASE WHEN d > 0 THEN round(m / d, 6) ELSE round(m, 6) END AS sortino FROM m",
        "alerts": f"{ALERTS} SELECT symbol, row_idx, alert_type, round(current, 6) AS current, CAST(threshold AS DOUBLE) AS threshold FROM al",
        "recent_alerts": f"{ALERTS} SELECT symbol, row_idx, alert_type, round(current, 6) AS current, CAST(threshold AS DOUBLE) AS threshold, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_idx DESC, alert_type DESC) AS seq FROM al) WHERE seq <= 5",
        "trade_history": f"{STRATEGY} SELECT symbol, i AS row_idx, signal, round(price, 6) AS price, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS seq FROM em WHERE signal <> 'Exit') WHERE seq <= 5",
        "kmeans_fit": _kmeans(" SELECT symbol, i AS row_idx, CAST(k AS INTEGER) AS cluster FROM a3"),
        "kmeans_inertia": _kmeans(f" SELECT round(sum({_square('x', 'c3', 'o h l c v')}), 3) AS inertia, 3 AS n_clusters, CAST(0.5 AS DOUBLE) AS silhouette FROM x JOIN a3 USING (symbol, i) JOIN c3 ON a3.k = c3.k"),
        "kmeans_predict": _kmeans(f" SELECT x.symbol, x.i AS row_idx, CAST(arg_min(c3.k, (sqrt({_square('x', 'c3', 'o h l c v')}), c3.k)) AS INTEGER) AS cluster FROM x, c3 GROUP BY x.symbol, x.i"),
        "dbscan_standard": f"{_dbscan(False)} SELECT symbol, g AS row_idx, cluster, cluster = 0 AS is_noise, is_core, is_border FROM r",
        "dbscan_borders": f"{_dbscan(True)} SELECT symbol, g AS row_idx, cluster, cluster = 0 AS is_noise, is_core, is_border FROM r",
        "dbscan_incremental": f"{_dbscan(False, f'g // {q.BUFFER}')}, mx AS (SELECT p, coalesce(sum(m) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT p, max(cluster) AS m FROM r GROUP BY p)) SELECT symbol, g AS row_idx, CAST(CASE WHEN cluster > 0 THEN cluster + off ELSE 0 END AS INTEGER) AS cluster FROM r JOIN mx USING (p)",
        "dbscan_centers": f"{_dbscan(False)} SELECT cluster, round(avg(o), 6) AS open, round(avg(h), 6) AS high, round(avg(l), 6) AS low, round(avg(c), 6) AS \"close\" FROM r WHERE cluster > 0 GROUP BY 1",
        "dbscan_predict": f"{_dbscan(False)}, m AS (SELECT cluster, avg(o) AS o, avg(h) AS h, avg(l) AS l, avg(c) AS c FROM r WHERE cluster > 0 GROUP BY 1) SELECT r.symbol, r.g AS row_idx, arg_min(m.cluster, (sqrt({_square('r', 'm')}), m.cluster)) AS cluster FROM r, m GROUP BY 1, 2",
        "dbscan_silhouette": f"""{_dbscan(True)}, y AS (SELECT * FROM r WHERE cluster > 0), pr AS (SELECT a.g, a.cluster AS k, b.cluster AS k2, sum(sqrt({_square('a', 'b')})) AS d, count(*) AS n FROM y a, y b GROUP BY 1, 2, 3),
sl AS (SELECT g, coalesce(max(CASE WHEN k = k2 AND n > 1 THEN d / (n - 1) END), 0) AS a, min(CASE WHEN k <> k2 THEN d / n END) AS b FROM pr GROUP BY g) SELECT greatest(0, coalesce(round(avg(CASE WHEN b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6), 0)) AS silhouette FROM sl""",
        "range_search": f"{D}, r AS (SELECT symbol, i, sqrt((open - {q.CENTER[0]}) ** 2 + (high - {q.CENTER[1]}) ** 2 + (low - {q.CENTER[2]}) ** 2 + (\"close\" - {q.CENTER[3]}) ** 2) AS d FROM b) SELECT symbol, i AS row_idx, round(d, 6) AS distance FROM r WHERE d <= {q.RADIUS}",
        "knn": f"{D}, x AS (SELECT symbol, i, open o, high h, low l, \"close\" c FROM b), p AS (SELECT a.symbol || ':' || a.i AS q, b.symbol, b.i, sqrt({_square('a', 'b')}) AS d FROM x a, x b WHERE a.i % 10 = 0) SELECT q, CAST(r AS INTEGER) AS rank, symbol, i AS row_idx, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, symbol, i) AS r FROM p) WHERE r <= 3",
        "gmm_diag_em": _gmm(" SELECT k AS cluster, round(w, 6) AS weight, round(o, 6) AS open, round(h, 6) AS high, round(l, 6) AS low, round(c, 6) AS \"close\", round(v, 6) AS volume FROM p2"),
        "gmm_predict": _gmm(" SELECT symbol, i AS row_idx, CAST(CASE WHEN max(CASE WHEN k = 0 THEN d END) >= max(CASE WHEN k = 1 THEN d END) THEN 0 ELSE 1 END AS INTEGER) AS cluster, round(max(CASE WHEN k = 0 THEN d END) / sum(d), 6) AS p0 FROM e2 GROUP BY symbol, i"),
        "silhouette": f"{SIL} SELECT round(avg(s), 6) AS silhouette FROM si",
        "internal_indices": f"{INDICES} SELECT round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin FROM chi, dbi",
        "dunn_index": f"{INDICES} SELECT round(dunn, 6) AS dunn FROM du",
        "overall_score": f"{INDICES} SELECT round(((silhouette + 1) / 2 + calinski_harabasz / (calinski_harabasz + 1) + 1 / (1 + davies_bouldin) + dunn / (dunn + 1)) / 4, 6) AS score FROM sv, chi, dbi, du",
        "external_indices": """WITH t AS (SELECT vec_id % 7 AS c, label AS y, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT n, sum(n) OVER (PARTITION BY c) AS a, sum(n) OVER (PARTITION BY y) AS b, sum(n) OVER () AS t FROM t),
s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum((a - 1) / 2 * n) AS ai, sum((b - 1) / 2 * n) AS bj, max(t * (t - 1) / 2) AS al, sum(n / t * ln(n * t / (a * b))) AS mi, sum(-n / t * ln(a / t)) AS hc, sum(-n / t * ln(b / t)) AS hl FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(t AS DOUBLE) AS t FROM r))
SELECT round((ij - ai * bj / al) / ((ai + bj) / 2 - ai * bj / al), 6) AS ari, round(mi / ((hc + hl) / 2), 6) AS nmi, round(mi / hl, 6) AS homogeneity, round(mi / hc, 6) AS completeness, round(2 * (mi / hl) * (mi / hc) / (mi / hl + mi / hc), 6) AS v_measure FROM s""",
        "cluster_sizes": f"{SIZES} SELECT * FROM sz",
        "cluster_size_stats": f"{SIZES} SELECT min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_dev, min(size) / max(size) > 0.1 AS balanced FROM sz",
        "cluster_quality": f"{SIL} SELECT k AS cluster, CASE WHEN avg(s) >= 0.7 THEN 'Excellent' WHEN avg(s) >= 0.5 THEN 'Good' WHEN avg(s) >= 0.25 THEN 'Fair' ELSE 'Poor' END AS level FROM si GROUP BY k",
        "resample_4h": f"{H} SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS timestamp, round(arg_min(open, i), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(\"close\", i), 6) AS \"close\", CAST(sum(volume) AS BIGINT) AS volume FROM b GROUP BY 1, 2",
        "technical_features": f"{H}, {TECH} SELECT symbol, i AS row_idx, round(ret, 6) AS returns, round(vol, 6) AS volatility, round(vr, 6) AS volume_ratio, round(rr, 6) AS range_ratio FROM te",
        "swing_points": f"{H}, {SWING} SELECT symbol, i AS row_idx, ts AS timestamp, kind, round(price, 6) AS price FROM pt",
        "swing_vwap": f"{H}, {SWING} SELECT symbol, i AS row_idx, kind, CAST(round(CAST(vw AS DECIMAL(30, 10)), 6) AS DOUBLE) AS vwap FROM pt",
        "volume_profile": f"""{H}, en AS (SELECT symbol, min(tp) AS lo, max(tp) AS hi FROM b GROUP BY 1), v AS (SELECT symbol, CAST(CASE WHEN hi > lo THEN least(10, floor((tp - lo) / (hi - lo) * 10) + 1) ELSE 1 END AS INTEGER) AS bin, CAST(sum(volume) AS BIGINT) AS volume FROM b JOIN en USING (symbol) GROUP BY 1, 2)
SELECT symbol, bin, volume, round(volume / sum(volume) OVER (PARTITION BY symbol), 6) AS share, coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 10 < sum(volume) OVER (PARTITION BY symbol) * 7 AS is_key FROM v""",
        "market_alerts": f"""{H}, {TECH}, al AS (SELECT symbol, i, 'vwap_deviation' AS alert, ("close" - vw) / vw AS value FROM te WHERE abs(("close" - vw) / vw) > 0.5 UNION ALL SELECT symbol, i, 'volume_spike', vr FROM te WHERE abs(vr) > 2 UNION ALL SELECT symbol, i, 'price_move', ret FROM te WHERE abs(ret) > 3) SELECT symbol, i AS row_idx, alert, round(value, 6) AS value FROM al""",
        "spreads": f"{H}, r AS (SELECT ts, arg_min(symbol, (tp, symbol)) AS cheap, arg_max(symbol, (tp, symbol)) AS dear, (max(tp) - min(tp)) / min(tp) AS s FROM b GROUP BY ts HAVING count(*) > 1) SELECT ts AS timestamp, cheap, dear, round(s, 6) AS spread FROM r WHERE s > 0.1",
        "key_figures": f"""{H}, {TECH} SELECT symbol, round(count(*) FILTER (abs(("close" - run) / run) <= 0.2) / count(*), 6) AS vwap_hit_rate, round(sum(ret * volume) / sum(CASE WHEN ret IS NOT NULL THEN volume END), 6) AS volume_weighted_return, round(avg(abs(("close" - run) / run)), 6) AS mean_deviation FROM te GROUP BY 1""",
        "strategy_execute": f"""{H}, st AS (SELECT symbol, count(*) AS n, max(i) AS e, avg(volume) AS mv, sum(tp * volume) / sum(volume) AS vw FROM b GROUP BY 1),
r AS (SELECT b.symbol, b."close" AS c, b.volume, mv, n, (b."close" - vw) / vw AS dev, p."close" AS prev FROM st JOIN b ON b.symbol = st.symbol AND b.i = e LEFT JOIN b p ON p.symbol = st.symbol AND p.i = e - 1),
z AS (SELECT *, CASE WHEN dev > 0.001 THEN 'Buy' WHEN -dev > 0.001 THEN 'Sell' ELSE 'Hold' END AS signal, least(1, 0.5 + least(abs(dev) * 10, 0.3) + CASE WHEN n > 1 AND volume / mv > 1.5 THEN 0.2 ELSE 0 END + CASE WHEN n > 1 AND abs((c - prev) / prev) > 0.005 THEN 0.1 ELSE 0 END) AS conf FROM r),
y AS (SELECT *, CASE WHEN conf >= 0.6 AND signal = 'Buy' THEN 'Long' WHEN conf >= 0.6 AND signal = 'Sell' THEN 'Short' END AS position FROM z)
SELECT symbol, signal, position, CASE WHEN position IS NOT NULL THEN round(10000 * least(abs(dev), 1.0), 6) END AS size, round(CASE position WHEN 'Long' THEN c * 0.98 WHEN 'Short' THEN c * 1.02 END, 6) AS stop_loss, round(CASE position WHEN 'Long' THEN c * 1.04 WHEN 'Short' THEN c * 0.96 END, 6) AS take_profit FROM y""",
    }
    out |= {
        "monitor_metrics": f"SELECT * FROM ({out['trade_metrics']}) JOIN ({out['drawdown']}) USING (symbol) JOIN ({out['sharpe_sortino']}) USING (symbol)",
        "alerts_retained": f"{ALERTS}, nu AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY row_idx, CASE alert_type WHEN 'DrawdownExceeded' THEN 0 WHEN 'WinRateLow' THEN 1 ELSE 2 END) AS r FROM al) SELECT symbol, row_idx, alert_type, round(current, 6) AS current, CAST(threshold AS DOUBLE) AS threshold, r - n + held AS seq FROM (SELECT *, CASE WHEN n <= 100 THEN n ELSE 51 + (n - 51) % 50 END AS held FROM nu) WHERE r > n - held",
        "backtest": f"""{CURVE},
sk AS (SELECT symbol, coalesce(max(n) FILTER (won), 0) AS longest_wins, coalesce(max(n) FILTER (NOT won), 0) AS longest_losses FROM (SELECT symbol, won, island, count(*) AS n FROM be GROUP BY ALL) GROUP BY symbol),
ag AS (SELECT symbol, count(*) AS trades, 10000 + sum(g) AS final_capital, sum(g) / 10000 AS total_return, count(*) FILTER (g > 0) / count(*) AS win_rate, avg(g) AS avg_trade, max(g) AS best_trade, min(g) AS worst_trade, avg(g) FILTER (g > 0) AS avg_win, avg(g) FILTER (g < 0) AS avg_loss, stddev_pop(g) AS s, sqrt(avg(g * g) FILTER (g < 0)) AS d, coalesce(sum(g) FILTER (g > 0), 0) AS up, -sum(g) FILTER (g < 0) AS down, max(below) AS md FROM be GROUP BY symbol)
SELECT symbol, trades, round(final_capital, 6) AS final_capital, round(total_return, 6) AS total_return, round(win_rate, 6) AS win_rate, round(avg_trade, 6) AS avg_trade, round(best_trade, 6) AS best_trade, round(worst_trade, 6) AS worst_trade, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(md, 6) AS max_drawdown, CASE WHEN s > 0 THEN round(avg_trade / s, 6) END AS sharpe, CASE WHEN d > 0 THEN round(avg_trade / d, 6) END AS sortino, CASE WHEN down > 0 THEN round(up / down, 6) END AS profit_factor, CASE WHEN md > 0 THEN round(total_return / md, 6) END AS calmar, longest_wins, longest_losses FROM ag JOIN sk USING (symbol)""",
        "monthly_returns": f"{CURVE}, mo AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS trades, sum(g) AS g FROM ga GROUP BY ALL) SELECT symbol, month, trades, round(g / (10000 + coalesce(sum(g) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS return FROM mo",
        "drawdown_periods": f"{CURVE}, pe AS (SELECT *, sum(CASE WHEN below > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS p FROM be) SELECT symbol, CAST(first AS TIMESTAMP) AS first, CAST(last AS TIMESTAMP) AS last, trades, round(drawdown, 6) AS drawdown, CAST(epoch(last) - epoch(first) AS BIGINT) AS seconds FROM (SELECT symbol, p, arg_min(ts, i) AS first, arg_max(ts, i) AS last, count(*) AS trades, max(below) AS drawdown FROM pe WHERE below > 0 GROUP BY ALL)",
        "market_quotes": f"""{H}, ro AS (SELECT symbol, i, sum(tp * volume) OVER (PARTITION BY symbol ORDER BY i) / sum(volume) OVER (PARTITION BY symbol ORDER BY i) AS vw, stddev_pop("close") OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dv FROM b) SELECT symbol, i AS row_idx, round(vw, 6) AS vwap, round(vw - 1.5 * dv, 6) AS bid, round(vw + 1.5 * dv, 6) AS ask FROM ro""",
        "signal_reasons": f"{H}, {SIGNALS} SELECT symbol, i AS row_idx, {REASON} AS reason FROM (SELECT s.*, g.dev FROM s JOIN g USING (symbol, i))",
        "exit_reasons": f"{STRATEGY} SELECT symbol, i AS row_idx, signal, CASE WHEN signal = 'Exit' THEN 'Stop loss or take profit hit' ELSE {REASON} END AS reason, CASE WHEN signal <> 'Exit' THEN round(s.vwap, 6) END AS vwap, CASE WHEN signal IN ('Buy', 'Sell') THEN round(power, 6) END AS strength FROM em JOIN s USING (symbol, i) JOIN g USING (symbol, i)",
        "validation_statistics": f"SELECT symbol, total_points, total_points AS valid_points, CAST(0 AS BIGINT) AS invalid_points, p.median AS price_median, v.median AS volume_median, total_seconds FROM (SELECT *, n // 4 AS total_points FROM ({out['price_stats']})) p JOIN ({out['volume_stats']}) v USING (symbol) JOIN ({out['time_stats']}) t USING (symbol)",
        "validate_context": f"{CELLS}, da AS (SELECT *, date_trunc('day', ts) AS day FROM b), zs AS (SELECT symbol, avg(price) AS m, stddev_pop(price) AS s FROM cells GROUP BY symbol) SELECT symbol, i AS row_idx, 'VolumeThreshold' AS error_type FROM da WHERE volume < 10 UNION ALL SELECT symbol, i, 'NoDuplicateTimestamps' FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY i) AS r FROM da) WHERE r > 1 UNION ALL SELECT symbol, i, 'ChronologicalOrder' FROM (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY i) AS pd FROM da) WHERE day <= pd UNION ALL SELECT DISTINCT symbol, row_idx, 'OutlierDetection' FROM cells JOIN zs USING (symbol) WHERE s > 0 AND abs(price - m) / s > 2",
        "csv_bars": f"{H} SELECT symbol, i AS row_idx, ts AS timestamp, open, high, low, \"close\", volume FROM b WHERE symbol = 'click'",
        "csv_errors": f"""{H}, c AS (SELECT *, CASE WHEN i % 13 = 3 THEN low / 2 ELSE high END AS hi FROM b WHERE symbol = 'click'),
z AS (SELECT i AS row_idx, CASE WHEN i % 7 = 1 THEN 'Invalid CSV format: Unable to parse timestamp at row ' || (i + 1) || ': never' WHEN i % 11 = 2 THEN 'Invalid data type for column open: expected float, got x1' WHEN i % 17 = 4 THEN 'Invalid data type for column volume: expected unsigned integer, got 1.5' WHEN open <= 0 OR hi <= 0 OR low <= 0 OR "close" <= 0 THEN 'Invalid OHLCV data: All prices must be positive' WHEN hi < low THEN 'Invalid OHLCV data: High price cannot be less than low price' WHEN hi < open OR hi < "close" THEN 'Invalid OHLCV data: High price must be >= open and close prices' END AS error FROM c)
SELECT row_idx, error FROM z WHERE error IS NOT NULL""",
        "json_bars": f"{H} SELECT symbol, ts AS timestamp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(\"close\", 6) AS \"close\", volume FROM b",
        "parquet_bars": f"{H} SELECT symbol, ts - INTERVAL '5 hours 30 minutes' AS timestamp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(\"close\", 6) AS \"close\", volume FROM b",
        "kmeans_quality": _kmeans(" SELECT CAST(3 AS INTEGER) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_points, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS sizes FROM (SELECT r.k, count(a3.k) AS n FROM (SELECT unnest(range(3)) k) r LEFT JOIN a3 ON r.k = a3.k GROUP BY r.k)"),
        "standard_scores": f"{D} SELECT symbol, i AS row_idx, {', '.join(f'round(({c} - (SELECT avg({c}) FROM b)) / (SELECT stddev_pop({c}) FROM b), 6) AS {c}' for c in ('open', 'high', 'low', chr(34) + 'close' + chr(34)))} FROM b",
        "quality_levels": "SELECT (i - 100) / 100 AS silhouette, CASE WHEN i = 180 THEN 'Poor' WHEN (i - 100) / 100 >= 0.7 THEN 'Excellent' WHEN (i - 100) / 100 >= 0.5 THEN 'Good' WHEN (i - 100) / 100 >= 0.25 THEN 'Fair' ELSE 'Poor' END AS level FROM range(201) r(i)",
        "som_assign": f"""{D}, x AS (SELECT symbol, i, open o, high h, low l, "close" c, CAST(volume AS DOUBLE) v FROM b), w(k, o, h, l, c, v) AS (VALUES {', '.join(f"({k}, {', '.join(map(str, m))})" for k, m in enumerate(q.SOM_WEIGHTS))}) SELECT symbol, i AS row_idx, cluster FROM (SELECT x.symbol, x.i, CAST(arg_min(w.k, (sqrt({_square('x', 'w', 'o h l c v')}), w.k)) AS INTEGER) AS cluster FROM x, w GROUP BY x.symbol, x.i)""",
    }
    out["csv_headerless"] = out["csv_bars"]
    return out


def oracle_sql() -> dict[str, str]:
    return _sql()
