"""The catalogue in SQL (DuckDB): written apart from the engine, to compare its results with."""

from __future__ import annotations

ROW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIMS = [f"d{i}" for i in range(8)]


def _settle(e: str) -> str:
    return f"(CASE WHEN len(list_distinct({e})) < 2 THEN [{e}[1] - 0.5, {e}[1] + 0.5] ELSE list_sort(list_distinct({e})) END)"


def _quantiles(c: str) -> str:
    return _settle(f"quantile_cont({c}, [0.0, 1.0/3, 2.0/3, 1.0])")


def _widths(c: str) -> str:
    return _settle(f"[min({c}), min({c}) + (max({c}) - min({c})) * 1 / 3, min({c}) + (max({c}) - min({c})) * 2 / 3, max({c})]")


def _bin(v: str, e: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN greatest(0, least(len({e}) - 2, len(list_filter({e}, lambda x: x <= {v})) - 1)) END"


def _text(items: str = "items", by: str = " & ") -> str:
    return f"array_to_string({items}, '{by}')"


EDGES = "e AS (SELECT " + ", ".join(f"{_quantiles(c)} AS e_{c}" for c in ROW) + " FROM lineitem)"
STATES = f"{EDGES}, st AS (SELECT l_returnflag, l_linestatus, " + ", ".join(f"{_bin(c, f'e_{c}')} AS {c}" for c in ROW) + " FROM lineitem, e)"


def _items(flag: bool) -> str:
    parts = [f"'{c}=' || {c}" for c in ROW] + ["'status=' || l_linestatus"] + (["'flag=' || l_returnflag"] if flag else [])
    return f"list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)))"


WEIGHTS = f"{STATES}, w AS (SELECT {_items(True)} AS items, count(*) AS weight FROM st GROUP BY 1)"
LABELLED = f"{STATES}, t AS (SELECT {_items(False)} AS items, CAST(l_returnflag = 'R' AS INT) AS label, l_returnflag AS cls, count(*) AS weight FROM st GROUP BY 1, 2, 3)"
LABELLED_W = f"{LABELLED}, w AS (SELECT items, sum(weight) AS weight FROM t GROUP BY 1)"
BASKETS = "b AS (SELECT list_sort(list(DISTINCT p_type)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey), w AS (SELECT items, count(*) AS weight FROM b GROUP BY 1)"


def _least(share: float, frame: str = "w", times: int = 1) -> str:
    return f"(SELECT {times} * greatest(1, CAST(ceil({share} * sum(weight) - 1e-9) AS BIGINT)) FROM {frame})"


def _frequent(share: float | None, frame: str = "w", least: str | None = None, out: str = "f") -> str:
    least = least or _least(share, frame)
    sub = f"sub AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, weight FROM (SELECT items, weight, unnest(range(1, CAST(1 AS BIGINT) << len(items))) AS m FROM {frame}))"
    return f"{sub}, {out} AS (SELECT items, CAST(sum(weight) AS BIGINT) AS support FROM sub GROUP BY items HAVING sum(weight) >= {least})"


def _maximal(src: str = "f", out: str = "mx") -> str:
    return f"{out} AS (SELECT * FROM {src} a WHERE NOT EXISTS (SELECT 1 FROM {src} b WHERE len(b.items) > len(a.items) AND list_has_all(b.items, a.items)))"


SERIES = "s AS (SELECT user_id, ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_type = 'error' AS INT) AS label FROM events)"


def _dealt(size: int, hop: int, src: str = "s", unit: str = "user_id", order: str = "ts, event_id") -> str:
    pos = f"pos AS (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY {order}) - 1 AS seq, count(*) OVER (PARTITION BY {unit}) AS n FROM {src})"
    return f"{pos}, dealt AS (SELECT *, unnest(range(CAST(greatest(0, ceil((seq - {size} + 1) / {hop})) AS BIGINT), least(seq // {hop}, (n - {size}) // {hop}) + 1)) AS win FROM pos WHERE n >= {size})"


def _medians(size: int, hop: int) -> str:
    return f"WITH {SERIES}, {_dealt(size, hop)} SELECT user_id, CAST(win AS INT) AS win, round(median(value), 6) AS value, median(k) AS k, max(label) AS label, count(*) AS n_rows FROM dealt GROUP BY user_id, win"


SERIES_W = f"""{SERIES}, se AS (SELECT {_quantiles('value')} AS e_value, {_quantiles('k')} AS e_k FROM s), {_dealt(20, 10)},
md AS (SELECT user_id, CAST(win AS INT) AS win, median(value) AS value, median(k) AS k, max(label) AS label FROM dealt GROUP BY user_id, win),
sw AS (SELECT user_id, win, label, list_sort(list_filter(['value=' || {_bin('value', 'e_value')}, 'k=' || {_bin('k', 'e_k')}], lambda x: x IS NOT NULL)) AS items FROM md, se)"""

CONTINGENCY = """ct AS (SELECT m.items, CAST(coalesce(sum(CASE WHEN t.label = 1 THEN weight END), 0) AS BIGINT) AS pos, CAST(coalesce(sum(weight), 0) AS BIGINT) AS cnt,
(SELECT CAST(sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS BIGINT) FROM t) AS npos, (SELECT CAST(sum(weight) AS BIGINT) FROM t) AS n
FROM mx m LEFT JOIN t ON list_has_all(t.items, m.items) GROUP BY m.items)"""
TABLE = f"{LABELLED_W}, {_frequent(0.05)}, {_maximal()}, {CONTINGENCY}"
ANOM, NORM = "(CAST(pos AS DOUBLE) / greatest(1, npos))", "((CAST(cnt AS DOUBLE) - CAST(pos AS DOUBLE)) / greatest(1, n - npos))"
LIFT = {
    "eps": f"({ANOM} + 1e-9) / ({NORM} + 1e-9)",
    "table": f"(round_even({ANOM}, 3) + 1e-3) / (round_even({NORM}, 3) + 1e-3)",
    "pos": f"{ANOM} * n / CAST(cnt AS DOUBLE)",
    "rate": "CASE WHEN cnt = 0 THEN 0.0 ELSE CAST(pos AS DOUBLE) * n / (CAST(npos AS DOUBLE) * cnt) END",
    "ratio": f"CASE WHEN {NORM} = 0 THEN 'infinity'::DOUBLE ELSE {ANOM} / {NORM} END",
}

STAGES = f"{WEIGHTS}, sup AS (SELECT unnest(items) AS item, weight FROM w), rk AS (SELECT item, CAST(sum(weight) AS BIGINT) AS least FROM sup GROUP BY item), stg AS (SELECT CAST(row_number() OVER (ORDER BY least DESC, item) AS INT) AS stage, item, least, least / (SELECT sum(weight) FROM w) AS share FROM rk)"
POOLS = f"""{STAGES}, {_frequent(None, least='(SELECT min(least) FROM stg WHERE stage <= 8)')},
fs AS (SELECT stage, items, support FROM f JOIN stg ON support >= least WHERE stage <= 8),
pool AS (SELECT * FROM fs a WHERE NOT EXISTS (SELECT 1 FROM fs b WHERE b.stage = a.stage AND len(b.items) > len(a.items) AND list_has_all(b.items, a.items))),
fst AS (SELECT items, min(stage) AS stage, max(support) AS support FROM pool GROUP BY items),
truth AS (SELECT items FROM pool WHERE stage = 8 AND len(items) >= 2),
cum AS (SELECT p.stage, p.pool, sum(coalesce(x.new, 0)) OVER (ORDER BY p.stage) AS cum_pool, sum(coalesce(y.hit, 0)) OVER (ORDER BY p.stage) AS truth_found
 FROM (SELECT stage, count(*) AS pool FROM pool GROUP BY 1) p LEFT JOIN (SELECT stage, count(*) AS new FROM fst GROUP BY 1) x USING (stage)
 LEFT JOIN (SELECT stage, count(*) AS hit FROM fst WHERE items IN (SELECT items FROM truth) GROUP BY 1) y USING (stage))"""

_ROLL = "((doc_id * 7 + m * 3 + c * 5) % 20)"
_TRUTH = "(CASE WHEN toxic = 1 THEN 'anomalous' ELSE 'normal' END)"
CALLS = f"""lg AS (SELECT doc_id, quality, toxic, m, c, {_ROLL} AS roll FROM labels, (SELECT unnest(range(0, 3)) AS m), (SELECT unnest(range(0, 2)) AS c)),
bd AS (SELECT *, '{{"diagnosis": "' || CASE WHEN roll < 12 + c * 4 - m THEN {_TRUTH} WHEN toxic = 1 THEN 'normal' ELSE ' Anomalous' END || '", "cited_patterns": ' ||
 CASE WHEN c = 0 THEN CASE WHEN roll = 3 THEN '["made up"]' ELSE '[]' END WHEN roll % 4 = 0 THEN '["p1", "p2 "]' WHEN roll % 4 = 1 THEN '["p3","other"]' ELSE '["p1"]' END || ', "reason": "r"}}' AS body FROM lg),
cl AS (SELECT 'm' || m AS model, CASE WHEN c = 1 THEN 'lib' ELSE 'nolib' END AS cond, doc_id AS case_key, 'g' || quality AS grp, {_TRUTH} AS truth, CAST(roll % 4 AS INT) AS budget,
 CASE WHEN roll = 19 THEN '__ERROR__ timeout' WHEN roll = 18 THEN 'I can not tell {{' WHEN roll % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS reply FROM bd),
pr AS (SELECT *, regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS j FROM cl WHERE NOT starts_with(reply, '__ERROR__')),
fc AS (SELECT *, j <> '' AND json_valid(j) AS parsed, CASE WHEN j <> '' THEN lower(trim(json_extract_string(j, '$.diagnosis'))) END AS pred,
 CASE WHEN j <> '' THEN list_transform(CAST(json_extract(j, '$.cited_patterns') AS VARCHAR[]), lambda x: trim(x)) ELSE [] END AS cited FROM pr),
fa AS (SELECT *, coalesce(pred = truth, false) AS correct, CAST(len(cited) AS INT) AS n_cited, CAST(len(list_filter(cited, lambda x: list_contains(['p1', 'p2', 'p3'], x))) AS INT) AS n_valid FROM fc)"""
_WILSON = "(p + 3.8416 / (2 * n){0} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"
PAIRED = f"""{CALLS}, cs AS (SELECT model, case_key, max(CASE WHEN cond = 'nolib' THEN CAST(correct AS INT) END) AS x, max(CASE WHEN cond = 'lib' THEN CAST(correct AS INT) END) AS y FROM fa GROUP BY 1, 2),
mc AS (SELECT model, count(*) AS n_paired, CAST(sum(CASE WHEN x = 0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN x = 1 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM cs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY model)"""
RUNS = "SELECT o_orderpriority AS dataset, o_orderstatus AS engine, count(*) AS reps, min(o_totalprice) AS best, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1, 2"
CODED = f"{{}}, words AS (SELECT item, CAST(row_number() OVER (ORDER BY item) AS INT) AS item_id FROM (SELECT DISTINCT unnest(items) AS item FROM w)), coded AS (SELECT items, any_value(weight) AS weight, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS ids FROM (SELECT items, weight, unnest(items) AS item FROM w) JOIN words USING (item) GROUP BY items)"
SENSORS = "sn AS (SELECT label, vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {d}" for i, d in enumerate(DIMS)) + " FROM embeddings)"
SENSOR_W = f"""{SENSORS}, se AS (SELECT {', '.join(f'{_quantiles(d)} AS e_{d}' for d in DIMS)} FROM sn), {_dealt(10, 5, 'sn', 'label', 'vec_id')},
md AS (SELECT label, win, {', '.join(f'median({d}) AS {d}' for d in DIMS)} FROM dealt GROUP BY label, win),
w AS (SELECT list_sort([{', '.join(f"'{d}=' || ({_bin(d, f'e_{d}')})" for d in DIMS)}]) AS items, count(*) AS weight FROM md, se GROUP BY 1)"""
RATES = """mt AS (SELECT label, weight, EXISTS (SELECT 1 FROM lib WHERE list_has_all(t.items, lib.items)) AS flagged FROM t),
fr AS (SELECT CAST(coalesce(sum(CASE WHEN label = 1 THEN weight END), 0) AS BIGINT) AS n_anom, CAST(coalesce(sum(CASE WHEN label = 0 THEN weight END), 0) AS BIGINT) AS n_norm,
 CAST(coalesce(sum(CASE WHEN label = 1 AND flagged THEN weight END), 0) AS BIGINT) AS flagged_anom, CAST(coalesce(sum(CASE WHEN label = 0 AND flagged THEN weight END), 0) AS BIGINT) AS flagged_norm FROM mt)"""


def _library(k: int, sup: float, lift: float) -> str:
    return f"""sc AS (SELECT *, {ANOM} AS sup_anom, {NORM} AS sup_norm, {LIFT['ratio']} AS lift FROM ct),
lib AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY lift DESC, pos DESC, items) AS INT) AS rank FROM sc WHERE sup_anom >= {sup} AND lift >= {lift}) WHERE rank <= {k})"""


def _channels(expr) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS channel, {expr(c)}" for c in ROW)


def _roll(text: str) -> str:
    """28 bits of a text's MD5 as a number."""
    return f"CAST('0x' || substr(md5(CAST({text} AS VARCHAR)), 1, 7) AS BIGINT)"


def _markers(mode: str) -> str:
    """Quantile markers of every series by recursion over its samples: (user_id, channel, q, f, h) after sample f, with the windows' ends as f."""
    fed = {
        "textbook": "fed AS (SELECT user_id, seq + 1 AS f, value, k FROM pos), ends AS (SELECT DISTINCT user_id, win, win * 10 + 20 AS f FROM dealt)",
        "shifted": "fed AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY win, seq) AS f, value, k FROM dealt), ends AS (SELECT DISTINCT user_id, win, (win + 1) * 20 AS f FROM dealt)",
    }[mode]
    place = {"textbook": "CAST([1, 2, 3, 4, 5] AS DOUBLE[])", "shifted": "[0.0::DOUBLE, 1 + 2 * q, 1 + 4 * q, 3 + 2 * q, 4.0::DOUBLE]"}[mode]
    put = lambda a, i, v: f"list_concat(list_concat({a}[:{i - 1}], [{v}]), {a}[{i + 1}:])"
    step = "SELECT user_id, channel, q, f, h0 AS h, " + {
        "textbook": "list_transform(n, lambda v, i: v + CAST(i - 1 > cell AS INT)) AS n, list_transform(w, lambda v, i: v + [0.0::DOUBLE, q / 2, q, (1 + q) / 2, 1.0::DOUBLE][i]) AS w",
        "shifted": "list_transform(n, lambda v, i: v + 1 + CAST(i BETWEEN 2 AND 4 AND i - 1 <= cell AS INT)) AS n, w",
    }[mode]
    step += f" FROM (SELECT *, CAST(x >= h[2] AS INT) + CAST(x >= h[3] AS INT) + CAST(x >= h[4] AS INT) AS cell, list_concat(list_concat([least(h[1], x)], h[2:4]), [greatest(h[5], x)]) AS h0 FROM (SELECT m.user_id, m.channel, m.q, l.f, m.h, m.n, m.w, l.x FROM mk m JOIN long l ON l.user_id = m.user_id AND l.channel = m.channel AND l.f = m.f + 1))"
    for i in (2, 3, 4):
        if mode == "textbook":
            step = f"SELECT *, CASE WHEN w[{i}] - n[{i}] >= 1 AND n[{i + 1}] - n[{i}] > 1 THEN 1 WHEN w[{i}] - n[{i}] <= -1 AND n[{i}] - n[{i - 1}] > 1 THEN -1 ELSE 0 END AS s FROM ({step})"
            step = f"SELECT *, h[{i}] + s / (n[{i + 1}] - n[{i - 1}]) * ((n[{i}] - n[{i - 1}] + s) * (h[{i + 1}] - h[{i}]) / (n[{i + 1}] - n[{i}]) + (n[{i + 1}] - n[{i}] - s) * (h[{i}] - h[{i - 1}]) / (n[{i}] - n[{i - 1}])) AS curve, h[{i}] + CASE WHEN s > 0 THEN (h[{i + 1}] - h[{i}]) / (n[{i + 1}] - n[{i}]) ELSE -(h[{i}] - h[{i - 1}]) / (n[{i}] - n[{i - 1}]) END AS line FROM ({step})"
            step = f"SELECT user_id, channel, q, f, CASE WHEN s = 0 THEN h WHEN h[{i - 1}] < curve AND curve < h[{i + 1}] THEN {put('h', i, 'curve')} ELSE {put('h', i, 'line')} END AS h, {put('n', i, f'n[{i}] + s')} AS n, w FROM ({step})"
        else:
            step = f"SELECT *, h[{i}] + (n[{i}] - n[{i - 1}] + 1) * (h[{i + 1}] - h[{i - 1}]) / (n[{i + 1}] - n[{i - 1}]) AS moved FROM ({step})"
            step = f"SELECT user_id, channel, q, f, CASE WHEN n[{i}] - n[{i - 1}] >= 1 AND n[{i + 1}] - n[{i - 1}] > 1 AND h[{i - 1}] < moved AND moved < h[{i + 1}] THEN {put('h', i, 'moved')} ELSE h END AS h, n, w FROM ({step})"
    return f"""WITH RECURSIVE {SERIES}, ss AS (SELECT * FROM s WHERE value IS NOT NULL AND k IS NOT NULL), {_dealt(20, 10, 'ss')}, {fed},
long AS (SELECT user_id, 'value' AS channel, f, value AS x FROM fed UNION ALL SELECT user_id, 'k' AS channel, f, k AS x FROM fed),
mk AS (SELECT user_id, channel, q, CAST(5 AS BIGINT) AS f, h, {place} AS n, [1.0::DOUBLE, 1 + 2 * q, 1 + 4 * q, 3 + 2 * q, 5.0::DOUBLE] AS w FROM (SELECT user_id, channel, list_sort(list(x)) AS h FROM long WHERE f <= 5 GROUP BY ALL HAVING count(*) = 5), (SELECT unnest([1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE]) AS q)
 UNION ALL {step}),
ed AS (SELECT user_id, channel, win, list_sort(list(h[3])) AS e FROM ends JOIN mk USING (user_id, f) GROUP BY ALL),
sp AS (SELECT *, greatest(e[2] - e[1], 1e-9) AS span FROM ed),
ap AS (SELECT *, CASE WHEN e[2] - e[1] < 0.05 * span THEN [(e[1] + e[2]) / 2 - 0.025 * span, (e[1] + e[2]) / 2 + 0.025 * span] ELSE e END AS i FROM sp),
md AS (SELECT user_id, win, unnest(['value', 'k']) AS channel, unnest([median(value), median(k)]) AS x FROM dealt GROUP BY user_id, win),
os AS (SELECT user_id, CAST(win AS INT) AS win, max(CASE WHEN channel = 'value' THEN CAST(x >= i[1] AS INT) + CAST(x >= i[2] AS INT) END) AS value, max(CASE WHEN channel = 'k' THEN CAST(x >= i[1] AS INT) + CAST(x >= i[2] AS INT) END) AS k FROM md JOIN ap USING (user_id, win, channel) GROUP BY ALL)"""


#: Tails by Simpson's rule, since there is no erfc: the integral of exp(-t * t) from x on, 8 further, in 4,000 steps.
_TAIL = "(2 / sqrt(pi()) * 8 / 4000 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(({0}) + i * 8.0 / 4000) * (({0}) + i * 8.0 / 4000)))))"
_BINOMIAL = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)))))"
_CHI2 = "CASE WHEN b + c = 0 THEN 0.0 ELSE CAST((abs(b - c) - 1) * (abs(b - c) - 1) AS DOUBLE) / (b + c) END"
_SIDE = "max(CASE WHEN budget = {0} THEN CAST(correct AS INT) END)"


def oracle_sql() -> dict[str, str]:
    pat = f"{_text()} AS pattern"
    edges = lambda make: " UNION ALL ".join(f"SELECT '{c}' AS channel, CAST(unnest(range(0, len(x))) AS INT) AS k, round(unnest(x), 6) AS edge FROM (SELECT {make(c)} AS x FROM lineitem)" for c in ROW)
    mined = f"SELECT {pat}, support FROM "
    frequent = f"WITH {WEIGHTS}, {_frequent(0.05)} {mined} f"
    maximal = f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} {mined} mx"
    acc = lambda by, src="fa": f"SELECT {by}, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k FROM {src} GROUP BY {by}"
    out = {
        "edges_quantile": edges(_quantiles),
        "edges_equal_width": edges(_widths),
        "bin_histogram": f"WITH {STATES} SELECT channel, CAST(state AS INT) AS state, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS state FROM st" for c in ROW) + ") GROUP BY 1, 2",
        "items_rowwise": f"WITH {WEIGHTS} SELECT {pat}, weight FROM w",
        "channel_select_variance": "WITH v AS (SELECT i AS position, 'd' || i AS channel, var_samp(CAST(embedding[i + 1] AS DOUBLE)) AS variance FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY i) SELECT CAST(position AS INT) AS position, channel, round(variance, 9) AS variance FROM v WHERE variance > (SELECT quantile_cont(variance, 0.4) FROM v) ORDER BY position LIMIT 25",
        "empty_bins": f"WITH e AS (SELECT {', '.join(f'{_widths(c)} AS e_{c}' for c in ROW)} FROM lineitem), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, count(DISTINCT {_bin(c, f'e_{c}')}) AS used FROM lineitem, e" for c in ROW) + ") SELECT channel, used, 3 - used AS empty FROM u",
        "count_windows_median": _medians(20, 10),
        "windows_w15": _medians(15, 7),
        "windows_w30": _medians(30, 15),
        "windows_w60": _medians(60, 30),
        "windows_label_max": f"WITH {SERIES_W} SELECT user_id, win, {pat}, label FROM sw",
        "raw_concat_windows": f"WITH {SERIES}, {_dealt(30, 15, unit='event_type', order='user_id, ts, event_id')} SELECT event_type AS grp, CAST(win AS INT) AS win, round(median(value), 6) AS value, count(DISTINCT user_id) AS n_runs FROM dealt GROUP BY 1, 2",
        "tail_label_units": "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events), q AS (SELECT *, max(cycle) OVER (PARTITION BY user_id) AS top FROM p) SELECT user_id, CAST(sum(CAST(cycle > (1 - 0.15) * top AS INT)) AS BIGINT) AS n_tail, count(*) AS n FROM q GROUP BY user_id",
        "signal_features": f"WITH lg AS (SELECT label, vec_id, i AS channel, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE label IS NOT NULL), {_dealt(16, 16, 'lg', 'label, channel', 'vec_id')} SELECT label, CAST(channel AS INT) AS channel, CAST(win AS INT) AS win, round(sqrt(avg(x * x)), 6) AS rms, round(kurtosis(x), 6) AS kurt, round(max(x) - min(x), 6) AS pp FROM dealt GROUP BY label, channel, win",
        "progress_segments": f"WITH {SERIES_W}, p AS (SELECT least(4, win * 5 // (max(win) OVER (PARTITION BY user_id) + 1)) AS segment FROM sw) SELECT CAST(segment AS INT) AS segment, count(*) AS n FROM p GROUP BY 1",
        "time_split_guard": f"WITH {SERIES_W}, p AS (SELECT win, CASE WHEN win < 2 THEN 'fit' WHEN win >= 4 THEN 'test' END AS part FROM sw) SELECT part, count(*) AS n, max(win) AS last FROM p WHERE part IS NOT NULL GROUP BY part",
        "dictionary": f"{'WITH ' + CODED.format(WEIGHTS)} SELECT item, item_id FROM words",
        "encode_ids": f"{'WITH ' + CODED.format(WEIGHTS)} SELECT ids, weight FROM coded",
        "txn_text_roundtrip": f"{'WITH ' + CODED.format(BASKETS)} SELECT ids AS line, weight AS n FROM coded",
        "txn_profile": f"WITH {BASKETS} SELECT count(*) AS n_txns, CAST(sum(len(items)) AS BIGINT) AS n_items, CAST(min(len(items)) AS BIGINT) AS min_len, CAST(max(len(items)) AS BIGINT) AS max_len, avg(len(items)) AS mean_len, min(list_min(items)) AS min_item, max(list_max(items)) AS max_item, (SELECT count(DISTINCT i) FROM (SELECT unnest(items) AS i FROM b)) AS n_distinct FROM b",
        "reduce_infrequent": f"WITH {WEIGHTS}, good AS (SELECT item FROM (SELECT unnest(items) AS item, weight FROM w) GROUP BY item HAVING sum(weight) >= {_least(0.3)}), g AS (SELECT list(item) AS ok FROM good), r AS (SELECT list_sort(list_filter(items, lambda x: list_contains(ok, x))) AS items, weight FROM w, g) SELECT {pat}, CAST(sum(weight) AS BIGINT) AS weight FROM r WHERE len(items) > 0 GROUP BY items",
        "reduction_rates": f"""WITH {BASKETS}, sup AS (SELECT item FROM (SELECT unnest(items) AS item, weight FROM w) GROUP BY item HAVING sum(weight) >= {_least(0.15)}), g AS (SELECT list(item) AS ok FROM sup),
            r AS (SELECT list_filter(items, lambda x: list_contains(ok, x)) AS items, weight FROM w, g), z AS (SELECT * FROM r WHERE len(items) > 0),
            a AS (SELECT CAST(sum(weight) AS BIGINT) AS n_txns_before, CAST(sum(weight * len(items)) AS BIGINT) AS n_items_before, (SELECT count(DISTINCT i) FROM (SELECT unnest(items) AS i FROM w)) AS n_kinds_before FROM w),
            c AS (SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS n_txns_after, CAST(coalesce(sum(weight * len(items)), 0) AS BIGINT) AS n_items_after, (SELECT count(DISTINCT i) FROM (SELECT unnest(items) AS i FROM z)) AS n_kinds_after FROM z)
            SELECT *, 1 - n_txns_after / n_txns_before AS n_txns_gone, 1 - n_items_after / n_items_before AS n_items_gone, 1 - n_kinds_after / n_kinds_before AS n_kinds_gone FROM a, c""",
        "replicate_invariance": f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} SELECT {pat}, 4 * support AS support FROM mx",
        "item_support": f"WITH {WEIGHTS} SELECT item, CAST(sum(weight) AS BIGINT) AS support FROM (SELECT unnest(items) AS item, weight FROM w) GROUP BY item",
        "frequent_itemsets": frequent,
        "frequent_levelwise": frequent,
        "frequent_fpgrowth": frequent,
        "closed_itemsets": f"WITH {WEIGHTS}, {_frequent(0.05)} {mined} f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.support = a.support AND len(b.items) > len(a.items) AND list_has_all(b.items, a.items))",
        "maximal_itemsets": maximal,
        "maximal_vertical": maximal,
        "maximal_partitioned": maximal,
        "maximal_fpmax": maximal,
        "support_hot": frequent,
        "maximal_topn": f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} SELECT {pat}, support FROM mx ORDER BY len(items) DESC, support DESC, items LIMIT 10",
        **dict.fromkeys(("basket_frequent", "basket_levelwise", "basket_index", "incremental_baskets"), f"WITH {BASKETS}, {_frequent(0.02)} {mined} f"),
        **dict.fromkeys(("basket_maximal", "basket_fpmax", "basket_vertical"), f"WITH {BASKETS}, {_frequent(0.02)}, {_maximal()} {mined} mx"),
        **dict.fromkeys(("support_of_sets", "support_by_trie", "support_by_index"), f"WITH {WEIGHTS}, fl AS (SELECT DISTINCT i FROM (SELECT unnest(items) AS i FROM w) WHERE starts_with(i, 'flag=') OR starts_with(i, 'l_tax=')), ps AS (SELECT [a.i, b.i] AS items FROM fl a JOIN fl b ON a.i < b.i) SELECT {_text('ps.items')} AS pattern, CAST(coalesce(sum(weight), 0) AS BIGINT) AS support FROM ps LEFT JOIN w ON list_has_all(w.items, ps.items) GROUP BY ps.items"),
        "closure_check": f"WITH {WEIGHTS}, {_frequent(0.05)} SELECT count(*) AS n_frequent, CAST(sum(support) AS BIGINT) AS sum_support, CAST(max(len(items)) AS INT) AS longest, (SELECT count(*) FROM (SELECT DISTINCT list_filter(items, lambda y: y <> x) AS part FROM (SELECT items, unnest(items) AS x FROM f WHERE len(items) > 1)) WHERE part NOT IN (SELECT items FROM f)) AS missing FROM f",
        "planted_recall": f"""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT unnest(range(8)) AS p),
            c AS (SELECT p, count(*) FILTER (WHERE {_roll("l_orderkey || ':' || p")} % 10000 < 50 * (p + 1)) AS support FROM o, p GROUP BY p)
            SELECT CAST(p AS INT) AS p, support, support >= (SELECT greatest(1, CAST(ceil(0.02 * count(*) - 1e-9) AS BIGINT)) FROM o) AS found FROM c""",
        "sensor_maximal": f"WITH {SENSOR_W}, {_frequent(0.1)}, {_maximal()} {mined} mx",
        "sensor_maximal_vertical": f"WITH {SENSOR_W}, {_frequent(0.1)}, {_maximal()} {mined} mx",
        "class_spec_join": "SELECT r_name AS cls, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "resume_keys": f"WITH {CALLS} SELECT model, cond, case_key FROM cl WHERE starts_with(reply, '__ERROR__')",
        "citation_membership": f"WITH {CALLS}, u AS (SELECT unnest(cited) AS pattern FROM fa) SELECT pattern, count(*) AS n, pattern IN ('p1', 'p2', 'p3') AS known FROM u GROUP BY pattern",
        "stage_thresholds": f"WITH {STAGES} SELECT * FROM stg",
        "stage_pools": f"WITH {POOLS} SELECT {pat}, stage, support FROM pool",
        "anytime_border": f"WITH {POOLS} SELECT {pat}, stage, support FROM pool WHERE stage <= 4",
        "first_stage": f"WITH {POOLS} SELECT {pat}, stage, support FROM fst",
        "cumulative_pool": f"WITH {POOLS} SELECT stage, pool, CAST(cum_pool AS BIGINT) AS cum_pool FROM cum",
        "coverage_curve": f"WITH {POOLS} SELECT stage, CAST(truth_found AS BIGINT) AS truth_found, CAST(cum_pool AS BIGINT) AS cum_pool, truth_found / (SELECT count(*) FROM truth) AS coverage, truth_found / cum_pool AS precision, coalesce(truth_found >= lag(truth_found) OVER (ORDER BY stage), true) AS monotone FROM cum",
        "prefix_coverage": f"WITH {POOLS}, p AS (SELECT items, row_number() OVER (ORDER BY support DESC, items) AS i, count(*) OVER () AS n FROM pool WHERE stage = 8), g AS (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS fraction) SELECT fraction, count(*) AS found, count(*) FILTER (WHERE items IN (SELECT items FROM truth)) AS truth_found, (SELECT count(*) FROM truth) AS n_truth, count(*) FILTER (WHERE items IN (SELECT items FROM truth)) / (SELECT count(*) FROM truth) AS coverage FROM g JOIN p ON i <= greatest(1, CAST(round_even(fraction * n, 0) AS INT)) GROUP BY fraction",
        "identity_gate": f"""WITH {POOLS}, alone AS (SELECT stage, sub.items, CAST(sum(weight) AS BIGINT) AS support FROM (SELECT stage, least FROM stg WHERE stage <= 4) x, sub GROUP BY stage, least, sub.items HAVING sum(weight) >= least),
            own AS (SELECT * FROM alone a WHERE NOT EXISTS (SELECT 1 FROM alone b WHERE b.stage = a.stage AND len(b.items) > len(a.items) AND list_has_all(b.items, a.items))),
            fj AS (SELECT coalesce(o.stage, p.stage) AS stage, o.items IS NOT NULL AS mine, p.items IS NOT NULL AS gold FROM own o FULL JOIN (SELECT * FROM pool WHERE stage <= 4) p ON o.stage = p.stage AND o.items = p.items AND o.support = p.support)
            SELECT stage, count(*) FILTER (WHERE mine) AS n_mine, count(*) FILTER (WHERE gold) AS n_gold, CAST(count(*) FILTER (WHERE NOT mine) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE NOT gold) AS BIGINT) AS extra, count(*) FILTER (WHERE NOT (mine AND gold)) = 0 AS identical FROM fj GROUP BY stage""",
        "contingency": f"WITH {TABLE} SELECT {pat}, pos, cnt, npos, n FROM ct",
        "truth_patterns": f"WITH {TABLE} SELECT {pat}, pos, cnt FROM ct WHERE cnt >= 20 AND CAST(pos AS DOUBLE) / cnt >= 0.3",
        "class_support_pivot": f"WITH {LABELLED_W}, {_frequent(0.1)}, {_maximal()} SELECT {_text('m.items')} AS pattern, " + ", ".join(f"coalesce(sum(CASE WHEN cls = '{c}' THEN weight END), 0) / (SELECT sum(weight) FROM t WHERE cls = '{c}') AS sup_{c}" for c in "ANR") + " FROM mx m LEFT JOIN t ON list_has_all(t.items, m.items) GROUP BY m.items",
        "class_topk": f"""WITH {LABELLED_W}, {_frequent(0.1)}, {_maximal()}, ct AS (SELECT m.items, k.cls, sum(CASE WHEN t.cls = k.cls THEN weight ELSE 0 END) AS pos, sum(weight) AS cnt, (SELECT sum(weight) FROM t x WHERE x.cls = k.cls) AS npos, (SELECT sum(weight) FROM t) AS n
            FROM mx m CROSS JOIN (SELECT DISTINCT cls FROM t) k JOIN t ON list_has_all(t.items, m.items) GROUP BY m.items, k.cls),
            r AS (SELECT *, {LIFT['rate']} AS lift FROM ct WHERE pos >= greatest(2, ceil(npos * 0.1))), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY cls ORDER BY lift DESC, pos DESC, items) AS INT) AS rank FROM r) SELECT {pat}, cls, rank, CAST(pos AS BIGINT) AS pos, lift FROM q WHERE rank <= 2""",
        "discriminative_topk": f"WITH {TABLE}, r AS (SELECT *, {LIFT['ratio']} AS lift, {ANOM} AS sup_anom FROM ct), q AS (SELECT *, CAST(row_number() OVER (ORDER BY lift DESC, sup_anom DESC, items) AS INT) AS rank FROM r WHERE lift >= 1.0 AND sup_anom >= 0.05) SELECT {pat}, rank, lift, sup_anom FROM q WHERE rank <= 5",
        "library_top8": f"WITH {TABLE}, {_library(8, 0.05, 0.9)} SELECT {pat}, rank, pos, cnt, sup_anom, sup_norm, lift FROM lib",
        "library_grid": f"WITH {TABLE}, r AS (SELECT *, {LIFT['ratio']} AS lift, {ANOM} AS sup_anom FROM ct), g AS (SELECT a::DOUBLE AS min_lift, b::DOUBLE AS min_sup FROM (SELECT unnest([0.9, 1.0, 1.05]) AS a), (SELECT unnest([0.02, 0.05, 0.1]) AS b)), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY min_lift, min_sup ORDER BY sup_anom DESC, lift DESC, items) AS INT) AS rank FROM r JOIN g ON lift >= min_lift AND sup_anom >= min_sup) SELECT {pat}, min_lift, min_sup, rank, sup_anom, lift FROM q WHERE rank <= 8",
        "union_coverage": f"WITH {TABLE}, {_library(5, 0.0, 0.0)}, {RATES} SELECT n_anom, flagged_anom, flagged_anom / n_anom AS coverage FROM fr",
        "window_flagging": f"WITH {SERIES_W}, t AS (SELECT items, label, count(*) AS weight FROM sw GROUP BY 1, 2), w AS (SELECT items, sum(weight) AS weight FROM t GROUP BY 1), {_frequent(0.05, out='mx')}, {CONTINGENCY}, {_library(2, 0.0, 0.0)}, {RATES} SELECT *, flagged_anom / n_anom AS coverage, flagged_norm / n_norm AS false_rate FROM fr",
        "reply_parse": f"WITH {CALLS} SELECT model, cond, case_key, parsed, pred, correct, n_cited, n_valid FROM fa",
        "accuracy_by_condition": f"WITH {CALLS}, a AS ({acc('model, cond')}), b AS (SELECT *, k / n AS p FROM a) SELECT model, cond, n, k, p AS accuracy, round(greatest(0, {_WILSON.format(' -')}), 9) AS low, round(least(1, {_WILSON.format(' +')}), 9) AS high FROM b",
        "accuracy_parsed_only": f"WITH {CALLS}, x AS (SELECT * FROM fa WHERE parsed), a AS ({acc('model, cond, grp', 'x')}) SELECT *, k / n AS accuracy FROM a",
        "faithfulness": f"WITH {CALLS} SELECT model, CAST(sum(n_cited) AS BIGINT) AS cited, CAST(sum(n_valid) AS BIGINT) AS valid, sum(n_valid) / sum(n_cited) AS by_citation, avg(CASE WHEN n_cited > 0 THEN CAST(n_valid = n_cited AS INT) END) AS by_reply FROM fa WHERE cond = 'lib' GROUP BY model",
        "hallucination_rate": f"WITH {CALLS}, a AS (SELECT model, count(*) AS n, CAST(sum(CAST(n_cited > 0 AS INT)) AS BIGINT) AS hallucinated FROM fa WHERE cond = 'nolib' GROUP BY model) SELECT *, hallucinated / n AS rate FROM a",
        "fpr_cells": f"WITH {CALLS}, a AS (SELECT model, cond, grp, count(*) AS n, CAST(sum(CAST(NOT correct AS INT)) AS BIGINT) AS fp FROM fa WHERE truth = 'normal' GROUP BY 1, 2, 3) SELECT *, fp / n AS fpr FROM a",
        "macro_cells": f"WITH {CALLS}, a AS ({acc('model, cond, grp')}) SELECT model, cond, count(*) AS cells, round(avg(k / n), 9) AS mean, round(stddev_samp(k / n), 9) AS std FROM a GROUP BY 1, 2",
        "mcnemar_chi2": f"WITH {PAIRED} SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE CAST((abs(b - c) - 1) * (abs(b - c) - 1) AS DOUBLE) / (b + c) END AS chi2 FROM mc",
        "mcnemar_exact": f"WITH {PAIRED} SELECT model, b, c, round({_BINOMIAL}, 9) AS p, round(least(1.0, {_TAIL.format(f'sqrt(({_CHI2}) / 2)')}), 9) AS p_chi2, CASE WHEN b > c THEN 'better' WHEN b < c THEN 'worse' ELSE 'equal' END AS direction FROM mc",
        "budget_contrasts": f"""WITH {CALLS}, pairs AS (SELECT unnest([0, 1, 2, 0]) AS lo, unnest([1, 2, 3, 3]) AS hi),
            cs AS (SELECT lo, hi, model, case_key, max(CASE WHEN budget = lo THEN CAST(correct AS INT) END) AS x, max(CASE WHEN budget = hi THEN CAST(correct AS INT) END) AS y FROM fa, pairs GROUP BY ALL),
            mc AS (SELECT lo, hi, model, count(*) AS n_paired, count(*) FILTER (WHERE x = 0 AND y = 1) AS b, count(*) FILTER (WHERE x = 1 AND y = 0) AS c FROM cs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
            SELECT CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, model, n_paired, b, c, {_CHI2} AS chi2 FROM mc""",
        "budget_peak": f"""WITH {CALLS}, a AS (SELECT model, budget, avg(CAST(correct AS INT)) AS acc FROM fa GROUP BY ALL), t AS (SELECT model, arg_max(budget, (acc, -budget)) AS peak FROM a WHERE budget > 0 GROUP BY model),
            cs AS (SELECT model, peak, case_key, max(CASE WHEN budget = 0 THEN CAST(correct AS INT) END) AS x, max(CASE WHEN budget = peak THEN CAST(correct AS INT) END) AS y FROM fa JOIN t USING (model) GROUP BY ALL),
            mc AS (SELECT model, peak, count(*) AS n_paired, count(*) FILTER (WHERE x = 0 AND y = 1) AS b, count(*) FILTER (WHERE x = 1 AND y = 0) AS c FROM cs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
            SELECT model, peak, n_paired, b, c, {_CHI2} AS chi2 FROM mc""",
        "online_states": f"{_markers('textbook')} SELECT * FROM os",
        "online_states_shifted": f"{_markers('shifted')} SELECT * FROM os",
        "online_vs_offline": f"""{_markers('textbook')}, oe AS (SELECT {_quantiles('value')} AS e FROM s),
            off AS (SELECT user_id, CAST(win AS INT) AS win, {_bin('med', 'e')} AS state FROM (SELECT user_id, win, median(value) AS med FROM dealt GROUP BY ALL), oe),
            seg AS (SELECT *, CAST(least(4, win * 5 // (max(win) OVER (PARTITION BY user_id) + 1)) AS INT) AS segment FROM off)
            SELECT segment, count(*) AS n, CAST(sum(CAST(state = value AS INT)) AS BIGINT) AS same, sum(CAST(state = value AS INT)) / count(*) AS agreement FROM seg JOIN os USING (user_id, win) GROUP BY segment""",
        "candidate_join": f"WITH {WEIGHTS}, {_frequent(0.05)}, two AS (SELECT items FROM f WHERE len(items) = 2), j AS (SELECT list_concat(a.items, [b.items[2]]) AS items FROM two a JOIN two b ON a.items[1] = b.items[1] AND a.items[2] < b.items[2]) SELECT {pat} FROM j WHERE items[2:3] IN (SELECT items FROM two)",
        "levelwise_resumed": frequent,
        "truth_top": f"WITH {TABLE} SELECT {pat}, CAST(row_number() OVER (ORDER BY pos DESC, items) AS INT) AS rank, pos, cnt FROM ct WHERE cnt >= 20 AND CAST(pos AS DOUBLE) / cnt >= 0.3 QUALIFY row_number() OVER (ORDER BY pos DESC, items) <= 10",
        "minsup_library": f"WITH {LABELLED_W}, {_frequent(0.05, out='mx')}, {CONTINGENCY}, r AS (SELECT *, {LIFT['rate']} AS lift FROM ct WHERE len(items) >= 2) SELECT {pat}, CAST(row_number() OVER (ORDER BY lift DESC, pos DESC, items) AS INT) AS rank, pos, cnt, lift FROM r QUALIFY row_number() OVER (ORDER BY lift DESC, pos DESC, items) <= 8",
        "result_fingerprint": f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} SELECT count(*) AS n, md5(string_agg({_text()} || ':' || support, chr(10) ORDER BY {_text()})) AS md5 FROM mx",
        "holm_adjust": f"WITH {PAIRED}, p AS (SELECT model, (c % 7 + 1) / 100.0 AS p FROM mc), q AS (SELECT model, CAST(p AS DOUBLE) AS p, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * CAST(p AS DOUBLE) AS step FROM p) SELECT model, p, least(1.0, max(step) OVER (ORDER BY p, model)) AS p_holm FROM q",
        "budget_curve": f"WITH {CALLS}, a AS (SELECT model, budget, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS k, sum(CAST(correct AS INT)) / count(*) AS accuracy FROM fa GROUP BY 1, 2) SELECT *, accuracy - (SELECT accuracy FROM a z WHERE z.model = a.model AND z.budget = 0) AS gain FROM a",
        "prompt_render": f"""WITH {SERIES_W} SELECT user_id, win, md5('Pump diagnosis.' || chr(10) || 'Observed states: ' || {_text('items', ', ')} || chr(10) || 'Known patterns:' || chr(10) || '- value=2 (support in anomalous windows 0.250, lift 2.50)' || chr(10) || '- k=1 (support in anomalous windows 0.125, lift only in anomalous windows)' || chr(10) || 'Answer with JSON: {{"diagnosis": "normal or anomalous", "cited_patterns": [], "reason": ""}}') AS prompt_md5 FROM sw""",
        "median_iqr": f"SELECT dataset, engine, reps, best, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3 FROM ({RUNS})",
        "speedup_pivot": f"WITH r AS ({RUNS}), x AS (SELECT dataset, max(CASE WHEN engine = 'F' THEN median END) AS base_median, max(CASE WHEN engine = 'O' THEN median END) AS other_median FROM r GROUP BY dataset) SELECT dataset, round(base_median, 6) AS base_median, round(other_median, 6) AS other_median, round(base_median / other_median, 6) AS speedup FROM x",
        "flagship": f"WITH {TABLE} SELECT {pat}, pos, cnt, npos, n, {LIFT['pos']} AS lift FROM ct",
    }
    ids = f"WITH {CODED.format(WEIGHTS + ', ' + _frequent(0.05) + ', ' + _maximal())}, cs AS (SELECT m.items, m.support, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS ids FROM (SELECT items, support, unnest(items) AS item FROM mx) m JOIN words USING (item) GROUP BY m.items, m.support)"
    lines = "lines AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN [] WHEN 1 THEN list_sort(list_distinct([CAST(l_linenumber AS INT), CAST(l_suppkey % 5 AS INT)])) ELSE list_sort(list_distinct([7, CAST(l_partkey % 4 AS INT)])) END AS t FROM lineitem)"
    join = lambda x: f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ' ')"
    out |= {
        "sensor_files": f"WITH {SERIES} SELECT event_type AS kind, count(*) AS n, CAST(1 AS BIGINT) AS runs, CAST(count(*) - 1 AS INT) AS last_seq, round(sum(value), 4) AS value, CAST(sum(label) AS BIGINT) AS positives FROM s GROUP BY 1",
        "sensor_runs": f"""WITH {SERIES}, r AS (SELECT event_type AS kind, event_id, (event_id // 500) || '.csv' AS run FROM s),
            n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY run, event_id) - 1 AS seq FROM r)
            SELECT kind, count(*) AS n, CAST(max(seq) AS INT) AS last_seq, count(DISTINCT run) AS runs, CAST(sum(seq * (event_id % 97)) AS BIGINT) AS places FROM n GROUP BY 1""",
        "turbofan_text": "SELECT CAST(o_custkey % 20 AS INT) AS bucket, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS cycles, round(sum(o_totalprice), 2) AS op1, CAST(sum(length(o_orderstatus)) AS DOUBLE) AS s1, CAST(0 AS BIGINT) AS s2 FROM orders GROUP BY 1",
        "labelled_csv": "SELECT l_returnflag AS label, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1",
        "telemetry_gz": f"WITH {SERIES}, h AS (SELECT * FROM s ORDER BY event_id LIMIT 1000), x AS (SELECT 'value' AS channel, value AS x FROM h UNION ALL SELECT 'k', k FROM h) SELECT channel, count(x) AS n, round(sum(x), 4) AS total, (SELECT count(*) - 1 FROM h) AS last_seq FROM x GROUP BY channel",
        "signal_arrays": "SELECT 'X_DE_time' AS channel, CAST(count(*) AS INT) AS n, round(sum(round(CAST(embedding[1] AS DOUBLE), 6)), 4) AS total FROM embeddings WHERE label IS NOT NULL GROUP BY label",
        "signal_source": "WITH c AS (SELECT printf('X%02d_DE_time', i) AS channel, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE label IS NOT NULL), s AS (SELECT channel, count(x) AS n, round(sum(x), 3) AS total FROM c GROUP BY 1 UNION ALL SELECT 'damaged', 0, NULL) SELECT form, s.* FROM s, (SELECT unnest(['mat', 'npz']) AS form)",
        "txn_lines": f"WITH {lines}, m AS (SELECT 'kept' AS mode, t FROM lines UNION ALL SELECT 'dropped', t FROM lines WHERE len(t) > 0 UNION ALL SELECT 'shifted', list_filter(list_transform(t, lambda v: v - 1), lambda v: v >= 0) FROM lines) SELECT mode, {join('t')} AS line, count(*) AS n FROM m GROUP BY 1, 2",
        "dictionary_file": f"{'WITH ' + CODED.format(WEIGHTS)} SELECT item, item_id FROM words",
        "labels_file": "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INT) AS position, r_name AS label FROM region",
        "txn_labels": "SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM labels GROUP BY 1",
        "patterns_file": f"WITH {TABLE}, {_library(8, 0.05, 0.9)} SELECT {pat}, sup_anom, lift FROM lib",
        "summary_file": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
        "results_file": f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} SELECT {pat}, support FROM mx",
        "results_header": f"{ids} SELECT 'transactions' AS key, CAST((SELECT sum(weight) FROM w) AS VARCHAR) AS value UNION ALL SELECT 'items', CAST((SELECT count(*) FROM words) AS VARCHAR) UNION ALL SELECT 'sets', CAST((SELECT count(*) FROM mx) AS VARCHAR)",
        "decoded_file": f"WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()} SELECT support || chr(9) || {_text(by=', ')} AS line FROM mx",
        "stage_file": f"WITH {CODED.format(POOLS)} SELECT stage, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY item_id) AS ids, support FROM (SELECT stage, items, support, unnest(items) AS item FROM pool WHERE stage <= 4) JOIN words USING (item) GROUP BY stage, items, support",
        "sets_files": f"{ids} SELECT 'semicolon' AS form, len(items) || ';' || support || ';' || ids AS line FROM cs UNION ALL SELECT 'ratio', ids || ' ' || printf('%.6f', round(support / (SELECT sum(weight) FROM w), 9)) FROM cs",
        **dict.fromkeys(("append_log", "append_log_commits"), f"WITH {CALLS} SELECT model, cond, count(*) AS n, (SELECT count(*) FROM cl) AS appended FROM cl GROUP BY 1, 2"),
        "call_file": f"WITH {CALLS} SELECT model, cond, count(*) AS n FROM cl WHERE NOT starts_with(reply, '__ERROR__') AND case_key % 10 <> 3 GROUP BY 1, 2",
        "file_checksums": "SELECT CAST(octet_length(encode(t)) AS BIGINT) AS bytes, md5(t) AS md5, sha256(t) AS sha256 FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS t FROM region)",
        "run_logs": "WITH r AS (SELECT o_totalprice, o_orderstatus = 'F' AS ok FROM orders WHERE o_orderkey % 50 = 1), p AS (SELECT 'counting' AS phase, ok, o_totalprice AS ms FROM r UNION ALL SELECT 'merge', ok, 1.5 FROM r) SELECT phase, ok, count(*) AS n, round(sum(ms), 2) AS ms FROM p GROUP BY 1, 2",
        "validation_report": f"""WITH {WEIGHTS}, {_frequent(0.05)}, {_maximal()}, f2 AS (SELECT * FROM f WHERE support >= {_least(0.2)}), {_maximal('f2', 'mx2')},
            tm AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'rows-0.05' ELSE 'rows-0.2' END AS config, round(median(o_totalprice), 4) AS median_s FROM orders GROUP BY 1),
            mine AS (SELECT 'rows-0.05' AS config, items FROM mx UNION ALL SELECT 'rows-0.2', items FROM mx2),
            gold AS (SELECT * FROM mine WHERE NOT (config = 'rows-0.2' AND list_contains(items, 'status=F'))),
            v AS (SELECT coalesce(m.config, g.config) AS config, count(m.items) AS n_mine, count(g.items) AS n_gold, count(*) FILTER (WHERE m.items IS NULL) AS missing, count(*) FILTER (WHERE g.items IS NULL) AS extra
                FROM mine m FULL JOIN gold g ON m.config = g.config AND m.items = g.items GROUP BY 1)
            SELECT config, n_mine, n_gold, missing, extra, median_s, CASE WHEN missing = 0 AND extra = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v JOIN tm USING (config)""",
    }
    for name, expr in LIFT.items():
        out[f"lift_{name}"] = f"WITH {TABLE} SELECT {pat}, {expr} AS lift FROM ct"
    return out
