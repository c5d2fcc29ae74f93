"""The SQL each registered query is checked against, over the same tables."""

from __future__ import annotations

import ipaddress

from ..functions.tables import (
    CLASS_SEED_OTHER,
    CLASS_SEEDS,
    FALLBACK_GEO,
    MODEL_FEATURES,
    SUBNETS,
    WALLET_FEATURES,
)
from ..sources.star import RELAY_PREFIXES

ORACLES: dict[str, str] = {}


def ask(name: str, body: str, *parts: str) -> None:
    """Register a query made of shared WITH parts and a final SELECT.

    A body that opens with a comma adds relations of its own first.
    """
    ctes = ",\n".join(p.strip() for p in parts)
    ORACLES[name] = exact_rounding((f"WITH {ctes}\n" if parts else "") + body.strip())


def exact_rounding(sql: str) -> str:
    """Expand RND(x, d): rounding by way of decimals, so ties do not hang on float noise."""
    while (start := sql.rfind("RND(")) >= 0:
        depth, comma, at = 0, -1, start + 3
        while True:
            ch = sql[at]
            depth += (ch in "([{") - (ch in ")]}")
            if ch == "," and depth == 1:
                comma = at
            if depth == 0:
                break
            at += 1
        inner, digits = sql[start + 4 : comma], sql[comma + 1 : at]
        sql = f"{sql[:start]}CAST(round(CAST({inner} AS DECIMAL(38,9)),{digits}) AS DOUBLE){sql[at + 1 :]}"
    return sql


# --- shared relations ------------------------------------------------------------------------------


def relay(u: str) -> str:
    prefixes = "[" + ",".join(f"'{p}'" for p in RELAY_PREFIXES) + "]"
    host = f"({u} % 250 + 1)"
    return f"""CASE WHEN {u} % 20 < {len(RELAY_PREFIXES)} THEN {prefixes}[CAST({u} % 20 AS INT) + 1] || '.' || {host}
      WHEN {u} % 20 = 15 THEN '127.0.0.1' WHEN {u} % 20 = 16 THEN '2001:db8::' || {host}
      WHEN {u} % 20 = 17 THEN 'host-' || {host}
      ELSE (10 + {u} % 80) || '.' || ({u} * 7 % 256) || '.0.' || {host} END"""


def _subnet_rows() -> str:
    rows = []
    for i, (cidr, country, asn, org) in enumerate(SUBNETS):
        net = ipaddress.ip_network(cidr)
        rows.append(f"({i}, {int(net.network_address)}, {int(net.broadcast_address)}, '{country}', '{asn}', '{org}')")
    return ", ".join(rows)


def _fallback_rows() -> str:
    return ", ".join(f"({i}, '{c}', '{a}', '{o}')" for i, (c, a, o) in enumerate(FALLBACK_GEO))


IS4 = r"regexp_full_match({0}, '((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)')"


def geo(ips: str) -> str:
    """CTEs ending in geo(ip, country, asn, fb_country, fb_asn, fb_org) for a relation of ips."""
    part = lambda i: f"TRY_CAST(split_part(ip, '.', {i}) AS BIGINT)"
    return f"""
subnets(pos, lo, hi, country, asn, org) AS (VALUES {_subnet_rows()}),
fallback(b, country, asn, org) AS (VALUES {_fallback_rows()}),
ipn AS (SELECT ip, CASE WHEN {IS4.format('ip')} THEN {part(1)}*16777216 + {part(2)}*65536 + {part(3)}*256 + {part(4)} END AS n,
        ({part(1)} * 31 + {part(2)}) % 10 AS b FROM (SELECT DISTINCT ip FROM {ips})),
hit AS (SELECT ip, min(pos) AS pos FROM ipn JOIN subnets ON n BETWEEN lo AND hi GROUP BY ip),
geo AS (SELECT i.ip,
  CASE WHEN i.ip IN ('127.0.0.1','localhost','::1') THEN 'US' WHEN s.country IS NOT NULL THEN s.country WHEN n IS NOT NULL THEN f.country ELSE 'UNKNOWN' END AS country,
  CASE WHEN i.ip IN ('127.0.0.1','localhost','::1') THEN 'AS0' WHEN s.asn IS NOT NULL THEN s.asn WHEN n IS NOT NULL THEN f.asn ELSE 'AS_UNKNOWN' END AS asn,
  CASE WHEN i.ip IN ('127.0.0.1','localhost','::1') THEN 'US' WHEN n IS NOT NULL THEN f.country ELSE 'UNKNOWN' END AS fb_country,
  CASE WHEN i.ip IN ('127.0.0.1','localhost','::1') THEN 'AS0' WHEN n IS NOT NULL THEN f.asn ELSE 'AS_UNKNOWN' END AS fb_asn,
  CASE WHEN i.ip IN ('127.0.0.1','localhost','::1') THEN 'Internal Loopback' WHEN n IS NOT NULL THEN f.org ELSE 'Unknown Organization' END AS fb_org
  FROM ipn i LEFT JOIN hit h ON h.ip = i.ip LEFT JOIN subnets s ON s.pos = h.pos LEFT JOIN fallback f ON f.b = i.b)"""


TIMES = """
tt AS (SELECT 'T' || o_orderkey AS txid, epoch_us(o_orderdate) AS ts_us, o_orderdate AS ts FROM orders)"""
TX = """
paid AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 10000 AS output_total,
  CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) / 1000000.0 AS fee FROM lineitem GROUP BY l_orderkey),
tx AS (SELECT 'T' || o_orderkey AS txid, epoch_us(o_orderdate) AS ts_us, coalesce(fee, 0.0) AS fee, o_totalprice / 10000 AS input_total,
  coalesce(output_total, 0.0) AS output_total FROM orders LEFT JOIN paid USING (o_orderkey))"""
LEGS = """
legs AS (SELECT 'T' || o_orderkey AS txid, 'IN' AS direction, 'CW' || o_custkey AS address, o_totalprice / 10000 AS amount, 0 AS leg_no FROM orders
  UNION ALL SELECT 'T' || l_orderkey, 'OUT', 'SW' || l_suppkey, l_extendedprice / 10000,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) FROM lineitem)"""
ROBS = f"""
robs AS (SELECT 'T' || event_id AS txid, epoch_us(ts) AS ts_us, {relay('user_id')} AS src_ip, 8333 + user_id % 3 AS src_port FROM events)"""
OBS = f"""{ROBS.strip()},
oips AS (SELECT src_ip AS ip FROM robs),
{geo('oips').strip()},
obs AS (SELECT r.txid, ts_us, src_ip, src_port, country, asn FROM robs r JOIN geo ON ip = src_ip)"""

AMT = "CAST(CAST({0} / 10000 AS DECIMAL(18,6)) AS VARCHAR)"
TXID_OK = r"regexp_full_match(trim({0}), '[a-fA-F0-9]{{64}}|[a-zA-Z0-9_\-]{{3,64}}')"
ADDR_OK = r"(length(trim({0})) BETWEEN 3 AND 90 AND regexp_full_match(trim({0}), '[a-zA-Z0-9_\-]{{3,90}}'))"
RAW = f"""
items AS (SELECT l_orderkey AS k,
  list(CASE WHEN l_orderkey % 67 = 0 AND l_linenumber = 2 THEN 'S?' ELSE 'SW' || l_suppkey END ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS addrs,
  list({AMT.format('l_extendedprice')} ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS amts FROM lineitem GROUP BY l_orderkey),
raw AS (SELECT o_orderkey AS k, o_orderkey * 10 + c AS src_pos, 'TRANSACTION' AS record_type,
  CASE WHEN o_orderkey % 97 = 0 THEN 'T!' || o_orderkey WHEN o_orderkey % 89 = 0 THEN '' ELSE 'T' || o_orderkey END AS txid,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts_text, epoch_us(o_orderdate) AS ts_us,
  CASE WHEN o_orderkey % 53 = 0 THEN '-0.5' WHEN o_orderkey % 47 = 0 THEN 'free' ELSE printf('%.3f', (o_orderkey % 7) * 0.001) END AS fee,
  CASE WHEN o_orderkey % 3 = 0 THEN 'taproot' WHEN o_orderkey % 5 = 0 THEN 'weird' ELSE 'P2WPKH' END AS script_type,
  [CASE WHEN o_orderkey % 71 = 0 THEN 'C#' ELSE 'CW' END || o_custkey] AS ins,
  coalesce(addrs, []) AS outs,
  [CASE WHEN o_orderkey % 61 = 0 THEN '-1.5' ELSE {AMT.format('o_totalprice')} END] AS in_amts,
  CASE WHEN o_orderkey % 59 = 0 AND len(coalesce(amts, [])) > 0 THEN list_concat(['n/a'], amts[2:]) ELSE coalesce(amts, []) END AS out_amts,
  {relay('user_id')} AS src_ip,
  CASE WHEN event_id IS NULL THEN NULL WHEN o_orderkey % 13 = 0 THEN 'http' ELSE CAST(8333 + user_id % 3 AS VARCHAR) END AS src_port,
  CASE WHEN o_orderkey % 11 = 0 THEN 'FR' WHEN o_orderkey % 2 = 0 THEN 'UNKNOWN' END AS geo_country,
  CASE WHEN o_orderkey % 11 = 0 THEN 'AS3215' END AS asn0
  FROM orders LEFT JOIN items ON items.k = o_orderkey LEFT JOIN events ON event_id = o_orderkey
  JOIN (VALUES (0), (1)) copies(c) ON c = 0 OR o_orderkey % 41 = 0)"""
BAD_IN = "[x FOR x IN ins IF NOT " + ADDR_OK.format("x") + "]"
BAD_OUT = "[x FOR x IN outs IF NOT " + ADDR_OK.format("x") + "]"
BAD_AMT = "[x FOR x IN {0} IF TRY_CAST(x AS DOUBLE) IS NULL OR TRY_CAST(x AS DOUBLE) < 0]"


def _bad_amount(c: str, side: str) -> str:
    first = BAD_AMT.format(c) + "[1]"
    return f"""WHEN len({BAD_AMT.format(c)}) > 0 THEN CASE WHEN TRY_CAST({first} AS DOUBLE) IS NULL THEN 'Non-numeric {side} amount: ' || {first}
      ELSE 'Negative {side} amount: ' || CAST(CAST({first} AS DOUBLE) AS VARCHAR) END"""


REASON = f"""CASE WHEN NOT {TXID_OK.format('txid')} THEN 'Missing or invalid TXID format: ' || txid
    WHEN len(ins) < 1 THEN 'At least one input address is required'
    WHEN len({BAD_IN}) > 0 THEN 'Malformed input wallet address: ' || {BAD_IN}[1]
    WHEN len(outs) < 1 THEN 'At least one output address is required'
    WHEN len({BAD_OUT}) > 0 THEN 'Malformed output wallet address: ' || {BAD_OUT}[1]
    {_bad_amount('in_amts', 'input')}
    {_bad_amount('out_amts', 'output')}
    WHEN TRY_CAST(fee AS DOUBLE) IS NULL THEN 'Non-numeric fee: ' || fee
    WHEN CAST(fee AS DOUBLE) < 0 THEN 'Negative fee: ' || fee ELSE '' END"""
CHECKED = f"{RAW.strip()},\nchecked AS (SELECT *, {REASON} AS reason FROM raw)"
RIPS = "rips AS (SELECT src_ip AS ip FROM raw WHERE src_ip IS NOT NULL)"
NORM = f"""{CHECKED},
{RIPS},
{geo('rips').strip()},
firsts AS (SELECT txid, min(src_pos) AS src_pos, count(*) - 1 AS copies FROM checked WHERE reason = '' GROUP BY txid),
norm AS (SELECT c.*, list_sum([CAST(x AS DOUBLE) FOR x IN in_amts]) AS input_total, list_sum([CAST(x AS DOUBLE) FOR x IN out_amts]) AS output_total,
  CAST(fee AS DOUBLE) AS fee_n,
  CASE WHEN c.src_ip IS NULL THEN coalesce(nullif(geo_country, 'UNKNOWN'), 'UNKNOWN') WHEN geo_country IS NULL OR geo_country = 'UNKNOWN' THEN g.country ELSE geo_country END AS country,
  CASE WHEN asn0 IS NOT NULL THEN asn0 WHEN c.src_ip IS NULL THEN 'UNKNOWN' ELSE g.asn END AS asn
  FROM checked c JOIN firsts f ON f.txid = c.txid AND f.src_pos = c.src_pos LEFT JOIN geo g ON g.ip = c.src_ip)"""

# event ledger
K = "CAST(json_extract_string(props, '$.k') AS INT)"
ETX = f"""
etx AS (SELECT CAST(event_id AS VARCHAR) AS txid, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, epoch_us(ts) AS ts_us,
  CASE WHEN {K} % 4 = 0 THEN 0.02 ELSE 0.001 END AS fee, 'P2PKH' AS script_type, 1 + {K} % 6 AS fan_in, 1 + {K} % 8 AS fan_out,
  value AS amount, value / (1 + {K} % 8) AS per_output, 'U' || user_id AS sender, 'M' || {K} AS receiver, {K} AS k, user_id
  FROM events WHERE event_type = 'purchase')"""
CAP = f"""
cap AS (SELECT event_id AS obs_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS network_timestamp, epoch_us(ts) AS obs_us, {relay('user_id')} AS src_ip,
  CAST(8333 + user_id % 3 AS INT) AS src_port, '10.0.0.1' AS dst_ip, 8333 AS dst_port,
  CASE WHEN event_type = 'signup' THEN CAST({K} AS VARCHAR) END AS network_txid
  FROM events WHERE event_type IN ('click', 'view', 'signup'))"""
EDGES = """
eedges AS (SELECT txid, 'IN' AS side, 'U' || ((user_id + i * 2) % 150) AS address FROM etx, generate_series(0, 4) g(i) WHERE i <= k % 5
  UNION ALL SELECT txid, 'OUT', 'M' || (k + i) FROM etx, generate_series(0, 2) g(i) WHERE i <= k % 3)"""
LABELS = """
labs AS (SELECT txid AS key, CASE WHEN k % 9 = 0 THEN 'mixer' WHEN k % 10 = 0 THEN 'illicit' ELSE 'licit' END AS class FROM etx WHERE k % 3 <> 1 OR k % 9 = 0)"""
LINKS = """
links AS (SELECT txid, side, address FROM eedges UNION SELECT txid, 'IN', sender FROM etx UNION SELECT txid, 'OUT', receiver FROM etx),
wcount AS (SELECT txid, count(DISTINCT address) AS wallet_count FROM links GROUP BY txid)"""


def near(window: float, source: str = "etx") -> str:
    w = int(window * 1e6)
    return f"""
near AS (SELECT txid, obs_id, src_ip, src_port, dst_ip, dst_port, network_timestamp, network_txid, gap FROM (
  SELECT e.txid, c.*, abs(e.ts_us - c.obs_us) AS gap, row_number() OVER (PARTITION BY e.txid ORDER BY abs(e.ts_us - c.obs_us), c.obs_us, c.obs_id) AS rn
  FROM {source} e JOIN cap c ON c.obs_us BETWEEN e.ts_us - {w} AND e.ts_us + {w}) WHERE rn = 1)"""


EXACT = """
exact AS (SELECT txid, obs_id, src_ip, src_port, dst_ip, dst_port, network_timestamp, network_txid, gap FROM (
  SELECT e.txid, c.*, abs(e.ts_us - c.obs_us) AS gap, row_number() OVER (PARTITION BY e.txid ORDER BY c.obs_id DESC) AS rn
  FROM etx e JOIN cap c ON c.network_txid = e.txid) WHERE rn = 1)"""
MATCHED = f"""{ETX.strip()},
{CAP.strip()},
{EDGES.strip()},
{LABELS.strip()},
{LINKS.strip()},
{EXACT.strip()},
rest AS (SELECT * FROM etx WHERE txid NOT IN (SELECT txid FROM exact)),
{near(120, 'rest').strip()},
matched AS (SELECT e.*, coalesce(l.class, 'unknown') AS tx_class, coalesce(w.wallet_count, 0) AS wallet_count,
  CASE WHEN x.txid IS NOT NULL THEN 'exact_txid' WHEN n.txid IS NOT NULL THEN 'timestamp_window' ELSE 'none' END AS correlation_method,
  CASE WHEN x.txid IS NOT NULL THEN 1.0 WHEN n.txid IS NOT NULL THEN RND(greatest(0.0, 1.0 - (n.gap / 1000000.0) / 120.0), 4) ELSE 0.0 END AS network_confidence,
  RND(coalesce(x.gap, n.gap) / 1000000.0, 2) AS time_difference_seconds,
  coalesce(x.src_ip, n.src_ip) AS src_ip, coalesce(x.src_port, n.src_port) AS src_port, coalesce(x.dst_ip, n.dst_ip) AS dst_ip,
  coalesce(x.dst_port, n.dst_port) AS dst_port, coalesce(x.network_timestamp, n.network_timestamp) AS network_timestamp,
  CASE WHEN x.txid IS NOT NULL THEN x.network_txid ELSE n.network_txid END AS network_txid
  FROM etx e LEFT JOIN exact x ON x.txid = e.txid LEFT JOIN near n ON n.txid = e.txid LEFT JOIN labs l ON l.key = e.txid LEFT JOIN wcount w ON w.txid = e.txid)"""
SCORED = f"""{MATCHED},
points AS (SELECT *, CASE WHEN fan_in >= 4 THEN 15 ELSE 0 END AS p1, CASE WHEN fan_out >= 4 THEN 15 ELSE 0 END AS p2,
  CASE WHEN RND(amount, 6) >= 50 THEN 20 WHEN RND(amount, 6) >= 10 THEN 15 ELSE 0 END AS p3,
  CASE WHEN network_confidence >= 0.5 THEN 25 WHEN correlation_method = 'timestamp_window' AND network_confidence > 0 THEN 10 ELSE 0 END AS p4,
  CASE WHEN wallet_count >= 5 THEN 10 ELSE 0 END AS p5, CASE WHEN tx_class = 'illicit' THEN 20 WHEN fee >= 0.01 THEN 10 ELSE 0 END AS p6 FROM matched),
scored AS (SELECT *, CAST(least(100, p1 + p2 + p3 + p4 + p5 + p6) AS INT) AS risk_score,
  CASE WHEN least(100, p1 + p2 + p3 + p4 + p5 + p6) >= 70 THEN 'HIGH' WHEN p1 + p2 + p3 + p4 + p5 + p6 >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM points)"""

# wallet features
CELLS = """
lt AS (SELECT address, txid, count(*) AS legs FROM legs GROUP BY address, txid),
cells AS (SELECT address, src_ip, country, asn, count(*) * 1 AS obs_rows, sum(legs) AS n FROM lt JOIN obs USING (txid) GROUP BY address, src_ip, country, asn),
spread AS (SELECT address, count(DISTINCT src_ip) AS unique_observed_ips, count(DISTINCT asn) FILTER (asn <> 'UNKNOWN') AS unique_asns,
  count(DISTINCT country) FILTER (country <> 'UNKNOWN') AS unique_countries FROM cells GROUP BY address),
byc AS (SELECT address, country, sum(n) AS c FROM cells WHERE country <> 'UNKNOWN' GROUP BY address, country),
bycs AS (SELECT *, sum(c) OVER (PARTITION BY address) AS t FROM byc),
entropy AS (SELECT address, greatest(0.0, -sum((c / t) * log2(c / t))) AS foreign_geo_entropy FROM bycs GROUP BY address)"""
PEERS = """
pairs AS (SELECT DISTINCT a.address, b.address AS peer FROM legs a JOIN legs b ON a.txid = b.txid AND a.direction <> b.direction AND a.address <> b.address),
peers AS (SELECT address, count(*) AS unique_counterparties FROM pairs GROUP BY address)"""
FEATURES = f"""{TIMES.strip()},
{LEGS.strip()},
{OBS},
{CELLS.strip()},
{PEERS.strip()},
base AS (SELECT address, count(*) AS n, count(*) FILTER (direction = 'OUT') AS n_in, count(*) FILTER (direction = 'IN') AS n_out,
  coalesce(sum(amount) FILTER (direction = 'OUT'), 0.0) AS tin, coalesce(sum(amount) FILTER (direction = 'IN'), 0.0) AS tout,
  avg(amount) AS av, max(amount) AS mx, CASE WHEN count(*) > 1 THEN stddev_pop(amount) ELSE 0.0 END AS sd,
  (max(ts_us) - min(ts_us)) / 1000000.0 AS span, count(DISTINCT txid) AS txs FROM legs JOIN tt USING (txid) GROUP BY address),
feats AS (SELECT b.address, CAST(n AS DOUBLE) AS tx_count_total, CAST(n_in AS DOUBLE) AS tx_incoming_count, CAST(n_out AS DOUBLE) AS tx_outgoing_count,
  tin AS total_incoming_btc, tout AS total_outgoing_btc, av AS avg_tx_amount, mx AS max_tx_amount, sd AS std_tx_amount, tin - tout AS net_flow_btc,
  CASE WHEN n > 1 THEN n / greatest(1.0, span / 3600.0) ELSE CAST(n AS DOUBLE) END AS tx_velocity_per_hour,
  CASE WHEN n > 1 THEN span / (n - 1) ELSE 86400.0 END AS avg_time_between_txs_sec,
  CAST(coalesce(p.unique_counterparties, 0) AS DOUBLE) AS unique_counterparties, CAST(n_in AS DOUBLE) / greatest(1, n) AS fan_in_ratio,
  CAST(n_out AS DOUBLE) / greatest(1, n) AS fan_out_ratio, CAST(coalesce(p.unique_counterparties, 0) + txs AS DOUBLE) AS graph_degree,
  CAST(n_in AS DOUBLE) AS graph_in_degree, CAST(n_out AS DOUBLE) AS graph_out_degree, CAST(coalesce(unique_observed_ips, 0) AS DOUBLE) AS unique_observed_ips,
  CAST(coalesce(unique_asns, 0) AS DOUBLE) AS unique_asns, CAST(coalesce(unique_countries, 0) AS DOUBLE) AS unique_countries,
  coalesce(foreign_geo_entropy, 0.0) AS foreign_geo_entropy
  FROM base b LEFT JOIN peers p USING (address) LEFT JOIN spread s USING (address) LEFT JOIN entropy e USING (address))"""
RISK = f"""{FEATURES},
sub AS (SELECT *, RND(least(1.0, max_tx_amount / 50.0), 4) AS anomaly_score FROM feats),
sub2 AS (SELECT *, least(100.0, anomaly_score * 100.0) AS s1, least(100.0, tx_velocity_per_hour / 8.0 * 100.0) AS s2, least(100.0, unique_counterparties / 20.0 * 100.0) AS s3,
  least(100.0, unique_observed_ips * 15.0 + unique_asns * 15.0 + unique_countries * 10.0) AS s4, least(100.0, graph_degree / 25.0 * 100.0) AS s5 FROM sub),
risk AS (SELECT *, CAST(round_even(0.40 * s1 + 0.20 * s2 + 0.15 * s3 + 0.15 * s4 + 0.10 * s5, 0) AS INT) AS priority_score FROM sub2),
ranked AS (SELECT *, CASE WHEN priority_score >= 80 THEN 'CRITICAL' WHEN priority_score >= 60 THEN 'HIGH' WHEN priority_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM risk),
cands AS (SELECT * FROM ranked WHERE priority_score >= 35 OR anomaly_score > 0.65)"""
LONG = (
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT address, '{f}' AS feature, {i} AS pos, {f} AS value FROM feats" for i, f in enumerate(WALLET_FEATURES)
    )
    + ")"
)
POP = f"""{LONG},
pop AS (SELECT feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1.0 END AS std,
  quantile_cont(value, 0.9) AS p90, min(value) AS min, max(value) AS max FROM long GROUP BY feature),
dev AS (SELECT address, feature, pos, value, (value - mean) / std AS z, value / greatest(0.0001, median) AS ratio FROM long JOIN pop USING (feature))"""
ROLLUP = """
rollup AS (SELECT address, min(ts_us) AS first_us, max(ts_us) AS last_us, coalesce(sum(amount) FILTER (direction = 'OUT'), 0.0) AS total_received,
  coalesce(sum(amount) FILTER (direction = 'IN'), 0.0) AS total_sent, count(*) AS tx_count FROM legs JOIN tt USING (txid) GROUP BY address)"""

# profiles
EVENTS = """
fans AS (SELECT txid, count(*) FILTER (direction = 'IN') AS fi, count(*) FILTER (direction = 'OUT') AS fo FROM legs GROUP BY txid),
ev AS (SELECT address, txid, ts_us, direction, leg_no, amount, greatest(1, fi) AS fan_in, greatest(1, fo) AS fan_out FROM legs JOIN tt USING (txid) JOIN fans USING (txid))"""
PRIOR = f"""{TIMES.strip()},
{LEGS.strip()},
{EVENTS.strip()},
prior AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts_us DESC, txid DESC, direction DESC, leg_no DESC) AS back,
  count(*) OVER (PARTITION BY address) AS all_n FROM ev) WHERE back > 1 OR all_n <= 3)"""
AMOUNTS = """
amounts AS (SELECT address,
  RND(coalesce(avg(amount) FILTER (direction = 'IN'), 0.0), 4) AS avg_input_amount,
  RND(CASE WHEN count(*) FILTER (direction = 'IN') > 1 THEN stddev_pop(amount) FILTER (direction = 'IN') ELSE 0.0 END, 4) AS input_amount_dispersion,
  RND(coalesce(sum(amount) FILTER (direction = 'IN'), 0.0), 4) AS total_input_value,
  RND(coalesce(avg(amount) FILTER (direction = 'OUT'), 0.0), 4) AS avg_output_amount,
  RND(CASE WHEN count(*) FILTER (direction = 'OUT') > 1 THEN stddev_pop(amount) FILTER (direction = 'OUT') ELSE 0.0 END, 4) AS output_amount_dispersion,
  RND(coalesce(sum(amount) FILTER (direction = 'OUT'), 0.0), 4) AS total_output_value,
  RND(CASE WHEN count(*) > 1 THEN stddev_pop(amount) ELSE 0.0 END, 4) AS amount_dispersion,
  RND(coalesce(quantile_cont(amount, 0.5) FILTER (direction = 'IN'), 0.0), 4) AS median_input_amount,
  RND(coalesce(quantile_cont(amount, 0.5) FILTER (direction = 'OUT'), 0.0), 4) AS median_output_amount FROM prior GROUP BY address)"""
TEMPO = """
gaps AS (SELECT address, ts_us, (ts_us - lag(ts_us) OVER (PARTITION BY address ORDER BY ts_us)) / 1000000.0 AS gap FROM prior),
spans AS (SELECT address, count(*) AS n, min(ts_us) AS lo, max(ts_us) AS hi, (max(ts_us) - min(ts_us)) / 1000000.0 AS span, min(gap) AS gmin, max(gap) AS gmax FROM gaps GROUP BY address),
tempo AS (SELECT address, lo, hi,
  RND(CASE WHEN n > 1 THEN n / greatest(0.5, span / 3600.0) ELSE 1.0 END, 2) AS transaction_velocity,
  RND(CASE WHEN n > 1 THEN n / greatest(1.0 / 24.0, span / 86400.0) ELSE 1.0 END, 2) AS transaction_frequency,
  RND(CASE WHEN n > 1 THEN span / (n - 1) ELSE 86400.0 END, 1) AS avg_inter_transaction_time,
  RND(CASE WHEN n > 1 THEN 1.0 / greatest(0.01, gmax / 3600.0) ELSE 0.5 END, 2) AS min_velocity,
  RND(CASE WHEN n > 1 THEN 1.0 / greatest(0.01, gmin / 3600.0) ELSE 1.5 END, 2) AS max_velocity,
  RND(CASE WHEN n > 1 THEN greatest(0.5, span / 3600.0) ELSE 1.0 END, 2) AS active_duration_hours FROM spans)"""
FLOW = """
mine AS (SELECT DISTINCT address, txid, direction FROM prior),
ppeers AS (SELECT m.address, count(DISTINCT l.address) AS c FROM mine m JOIN legs l ON l.txid = m.txid AND l.direction <> m.direction AND l.address <> m.address GROUP BY m.address),
flow AS (SELECT p.address, RND(avg(fan_in), 2) AS typical_fan_in, RND(avg(fan_out), 2) AS typical_fan_out, coalesce(any_value(c), 0) AS unique_counterparty_count
  FROM prior p LEFT JOIN ppeers q ON q.address = p.address GROUP BY p.address)"""
ONDEMAND = """
ptx AS (SELECT address, txid, any_value(ts_us) AS ts_us, arg_max(amount, leg_no) FILTER (direction = 'IN') AS sent, arg_max(amount, leg_no) FILTER (direction = 'OUT') AS received
  FROM legs JOIN tt USING (txid) GROUP BY address, txid),
cutx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts_us DESC, txid DESC) AS back, count(*) OVER (PARTITION BY address) AS all_n FROM ptx) WHERE back > 1 OR all_n <= 3),
both_sides AS (SELECT address, 'S' AS side, sent AS amount FROM cutx WHERE sent IS NOT NULL UNION ALL SELECT address, 'R', received FROM cutx WHERE received IS NOT NULL),
dam AS (SELECT address, avg(amount) AS av, CASE WHEN count(*) > 1 THEN stddev_pop(amount) ELSE 0.0 END AS sd, max(amount) AS mx, min(amount) AS mn,
  coalesce(quantile_cont(amount, 0.5) FILTER (side = 'S'), quantile_cont(amount, 0.5)) AS med, coalesce(avg(amount) FILTER (side = 'S'), avg(amount)) AS avo,
  count(*) FILTER (side = 'R') AS ci, count(*) FILTER (side = 'S') AS co, count(*) AS c FROM both_sides GROUP BY address),
dgap AS (SELECT address, ts_us, all_n, (ts_us - lag(ts_us) OVER (PARTITION BY address ORDER BY ts_us)) / 1000000.0 AS gap FROM cutx),
dspan AS (SELECT address, any_value(all_n) AS all_n, count(*) AS n, (max(ts_us) - min(ts_us)) / 1000000.0 AS span, min(gap) AS gmin, max(gap) AS gmax FROM dgap GROUP BY address),
dpeer AS (SELECT c.address, count(DISTINCT l.address) AS p FROM cutx c JOIN legs l ON l.txid = c.txid AND l.address <> c.address GROUP BY c.address),
ondemand AS (SELECT s.address, s.n AS observation_count, all_n AS total_recorded_transactions, all_n >= 3 AS has_sufficient_history,
  CASE WHEN all_n < 3 THEN 'INSUFFICIENT_HISTORY' WHEN s.n >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS profile_reliability,
  RND(av, 4) AS avg_amount, RND(sd, 4) AS std_amount, RND(mx, 4) AS max_amount, RND(mn, 4) AS min_amount,
  RND(med, 4) AS median_output_amount, RND(avo, 4) AS avg_output_amount,
  RND(CASE WHEN s.n > 1 THEN s.n / greatest(1.0, span / 3600.0) ELSE 1.0 END, 2) AS avg_velocity_per_hour,
  RND(CASE WHEN s.n > 1 THEN 1.0 / greatest(0.01, gmax / 3600.0) ELSE 0.5 END, 2) AS min_velocity_per_hour,
  RND(CASE WHEN s.n > 1 THEN 1.0 / greatest(0.01, gmin / 3600.0) ELSE 1.5 END, 2) AS max_velocity_per_hour,
  RND(CASE WHEN s.n > 1 THEN span / (s.n - 1) ELSE 86400.0 END, 1) AS avg_time_between_txs_sec,
  coalesce(p, 0) AS counterparties_count, RND(ci / c, 2) AS fan_in_ratio, RND(co / c, 2) AS fan_out_ratio
  FROM dspan s JOIN dam USING (address) LEFT JOIN dpeer USING (address))"""
BASE_COLS = (
    "has_sufficient_history, observation_count, profile_reliability, median_output_amount, avg_output_amount, std_amount, max_amount, "
    "avg_velocity_per_hour, min_velocity_per_hour, max_velocity_per_hour, avg_time_between_txs_sec, counterparties_count"
)
RESOLVED = f"""
{EVENTS.strip()},
prior AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY ts_us DESC, txid DESC, direction DESC, leg_no DESC) AS back,
  count(*) OVER (PARTITION BY address) AS all_n FROM ev) WHERE back > 1 OR all_n <= 3),
{AMOUNTS.strip()},
{TEMPO.strip()},
{FLOW.strip()},
{ONDEMAND.strip()},
pcount AS (SELECT address, count(*) AS n FROM prior GROUP BY address),
override AS (SELECT 'CW' || c_custkey AS address, true AS has_sufficient_history, 12 AS observation_count, 'HIGH' AS profile_reliability, abs(c_acctbal) / 1000.0 AS median_output_amount,
  abs(c_acctbal) / 1000.0 AS avg_output_amount, abs(c_acctbal) / 1000.0 / 4 AS std_amount, abs(c_acctbal) / 1000.0 * 1.3 AS max_amount, 0.5 AS avg_velocity_per_hour,
  0.25 AS min_velocity_per_hour, 0.75 AS max_velocity_per_hour, 9e6 AS avg_time_between_txs_sec, 8 AS counterparties_count FROM customer WHERE c_custkey % 10 = 0),
stored AS (SELECT address, n >= 3 AS has_sufficient_history, n AS observation_count, CASE WHEN n < 3 THEN 'INSUFFICIENT_HISTORY' WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS profile_reliability,
  median_output_amount, avg_output_amount, output_amount_dispersion AS std_amount,
  coalesce(coalesce(nullif(median_output_amount, 0), nullif(avg_output_amount, 0), nullif(median_input_amount, 0), nullif(avg_input_amount, 0)) * 1.5, 1.0) AS max_amount,
  transaction_velocity AS avg_velocity_per_hour, min_velocity AS min_velocity_per_hour, max_velocity AS max_velocity_per_hour, avg_inter_transaction_time AS avg_time_between_txs_sec,
  unique_counterparty_count AS counterparties_count
  FROM pcount JOIN amounts USING (address) JOIN tempo USING (address) JOIN flow USING (address) WHERE address NOT LIKE 'SW%'),
every AS (SELECT 1 AS o, 'override' AS baseline_source, address, {BASE_COLS} FROM override UNION ALL SELECT 2, 'stored', address, {BASE_COLS} FROM stored
  UNION ALL SELECT 3, 'computed', address, {BASE_COLS} FROM ondemand),
resolved AS (SELECT * EXCLUDE (o, r) FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY o) AS r FROM every WHERE address IN (SELECT address FROM legs)) WHERE r = 1)"""
VERDICT = f"""{FEATURES},
{RESOLVED.strip()},
sig AS (SELECT f.address, baseline_source, RND(least(1.0, max_tx_amount / 50.0), 4) AS raw, avg_tx_amount AS amount, median_output_amount AS med, avg_output_amount AS mean,
  CASE WHEN median_output_amount > 0.001 THEN median_output_amount ELSE avg_output_amount END AS ref, std_amount AS std, max_amount AS peak, tx_velocity_per_hour AS vel,
  avg_velocity_per_hour AS bvel, min_velocity_per_hour AS vmin, max_velocity_per_hour AS vmax, f.unique_counterparties AS peers, counterparties_count AS bpeers,
  f.avg_time_between_txs_sec AS gap, r.avg_time_between_txs_sec AS bgap, unique_observed_ips AS ips, unique_asns AS asns, unique_countries AS countries,
  has_sufficient_history AS known, profile_reliability AS rel, observation_count FROM feats f JOIN resolved r USING (address)),
rules AS (SELECT *,
  known AND ref > 0 AND amount >= ref * 2 AND amount > peak AS s1, known AND bvel > 0 AND vel >= bvel * 2 AND vel > vmax AS s2,
  known AND bpeers > 0 AND peers >= greatest(5, floor(bpeers * 2)) AS s3, known AND bgap > 120 AND gap <= bgap * 0.25 AS s4,
  known AND (ips >= 3 OR (asns >= 2 AND countries >= 2)) AS s5,
  known AND bvel > 0 AND ((vmin <= vel AND vel <= vmax * 1.1) OR abs(vel - bvel) / greatest(0.1, bvel) <= 0.25) AS c1,
  known AND ref > 0 AND ((amount <= peak AND abs(amount - ref) / greatest(0.01, ref) <= 0.25) OR (std > 0 AND abs(amount - mean) <= 1.2 * std)) AS c2,
  known AND bpeers > 0 AND peers <= bpeers + 1 AS c3, known AND ips <= 1 AS c4,
  known AND amount > 0 AND ref > 0 AND (amount / nullif(ref, 0) >= 2 OR (CASE WHEN std > 0 THEN (amount - mean) / greatest(0.01, std) ELSE 0 END) >= 2) AS d1,
  known AND vel > 0 AND bvel > 0 AND vel >= bvel * 2 AND vel > vmax AS d2, known AND peers > 0 AND bpeers > 0 AND peers >= greatest(5, floor(bpeers * 2)) AS d3 FROM sig),
counts AS (SELECT *, CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) + CAST(s4 AS INT) AS nb, CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) + CAST(s4 AS INT) + CAST(s5 AS INT) AS ns,
  CAST(c1 AS INT) + CAST(c2 AS INT) AS nc, CASE WHEN known THEN CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) + CAST(c4 AS INT) ELSE 1 END AS nall FROM rules),
mixed AS (SELECT *, 0.35 * raw + 0.45 * (CASE WHEN nb > 0 THEN least(1.0, 0.40 * nb + CASE WHEN s1 OR s2 THEN 0.20 ELSE 0 END) ELSE 0 END) + 0.20 * (CASE WHEN s5 THEN 0.85 ELSE 0.20 END) AS mix FROM counts),
verdict AS (SELECT *,
  RND(CASE WHEN NOT known THEN raw * 0.70 WHEN nc = 0 THEN mix ELSE mix * (1.0 - CASE WHEN nb = 0 THEN greatest(0.65, 0.60 * nc / (nc + 1.0)) ELSE 0.60 * nc / (nc + 1.0) END) END, 4) AS validation_score,
  RND(CASE WHEN NOT known THEN 0.35 WHEN ns > 0 AND nc = 0 THEN least(0.95, 0.65 + CASE WHEN rel = 'HIGH' THEN 0.05 ELSE 0.0 END + 0.08 * ns)
    WHEN ns = 0 AND nc > 0 THEN 0.38 WHEN ns > 0 AND nc > 0 THEN greatest(0.45, least(0.65, 0.65 + CASE WHEN rel = 'HIGH' THEN 0.05 ELSE 0.0 END - 0.15))
    ELSE 0.65 + CASE WHEN rel = 'HIGH' THEN 0.05 ELSE 0.0 END END, 2) AS confidence FROM mixed)"""

# graph
GEDGES = """
gedges AS (SELECT CASE WHEN direction = 'IN' THEN address ELSE txid END AS src, CASE WHEN direction = 'IN' THEN txid ELSE address END AS dst,
  CASE WHEN direction = 'IN' THEN 'INPUT_OF' ELSE 'OUTPUT_TO' END AS type, amount, NULL::INT AS port, leg_no FROM legs
  UNION ALL SELECT src_ip, txid, 'OBSERVED_IN', NULL, src_port, NULL FROM obs JOIN tt USING (txid)
  UNION ALL SELECT src_ip, asn, 'BELONGS_TO_ASN', NULL, NULL, NULL FROM obs JOIN tt USING (txid) WHERE asn <> 'UNKNOWN'
  UNION ALL SELECT src_ip, 'GEO_' || country, 'LOCATED_IN', NULL, NULL, NULL FROM obs JOIN tt USING (txid) WHERE country <> 'UNKNOWN')"""
GVERTS = """
gverts AS (SELECT txid AS id, 'TRANSACTION' AS type, 'TX: ' || left(txid, 8) || '...' AS label FROM tt
  UNION ALL SELECT DISTINCT address, 'WALLET', CASE WHEN length(address) > 12 THEN left(address, 6) || '...' || right(address, 4) ELSE address END FROM legs
  UNION ALL SELECT DISTINCT src_ip, 'IP', 'IP: ' || src_ip FROM obs JOIN tt USING (txid)
  UNION ALL SELECT DISTINCT asn, 'ASN', asn FROM obs JOIN tt USING (txid) WHERE asn <> 'UNKNOWN'
  UNION ALL SELECT DISTINCT 'GEO_' || country, 'COUNTRY', 'Country: ' || country FROM obs JOIN tt USING (txid) WHERE country <> 'UNKNOWN')"""
GDEG = "gdeg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM gedges UNION ALL SELECT dst FROM gedges) GROUP BY id)"
GSTEP = "gstep AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM gedges UNION ALL SELECT dst, src FROM gedges) WHERE a <> b)"
GRAPH = f"{GEDGES.strip()},\n{GVERTS.strip()},\n{GDEG},\n{GSTEP}"
EGO = """
hop1 AS (SELECT DISTINCT s.seed, g.b AS id FROM seeds s JOIN gstep g ON g.a = s.seed WHERE g.b <> s.seed),
cut1 AS (SELECT seed, id FROM (SELECT h.seed, h.id, row_number() OVER (PARTITION BY h.seed ORDER BY degree DESC, h.id) AS r FROM hop1 h JOIN gdeg d ON d.id = h.id) WHERE r <= 149),
hop2 AS (SELECT DISTINCT c.seed, g.b AS id FROM cut1 c JOIN gstep g ON g.a = c.id WHERE g.b <> c.seed AND NOT EXISTS (SELECT 1 FROM cut1 x WHERE x.seed = c.seed AND x.id = g.b)),
used AS (SELECT seed, count(*) + 1 AS u FROM cut1 GROUP BY seed),
cut2 AS (SELECT seed, id FROM (SELECT h.seed, h.id, u, row_number() OVER (PARTITION BY h.seed ORDER BY degree DESC, h.id) AS r FROM hop2 h JOIN gdeg d ON d.id = h.id JOIN used ON used.seed = h.seed) WHERE r + u <= 150),
nodes AS (SELECT seed, seed AS id, 0 AS distance FROM seeds UNION ALL SELECT seed, id, 1 FROM cut1 UNION ALL SELECT seed, id, 2 FROM cut2)"""


def rounded(cols: list[str], digits: int) -> str:
    return ", ".join(f"RND({c}, {digits}) AS {c}" for c in cols)


# --- sources ----------------------------------------------------------------------------------------

_FILE = """SELECT record_type, coalesce(nullif(txid, ''), '') AS txid, ts_text AS timestamp, fee, script_type, array_to_string(ins, '~') AS ins, array_to_string(outs, '~') AS outs,
  array_to_string(in_amts, '~') AS in_amts, array_to_string(out_amts, '~') AS out_amts, src_ip, src_port, geo_country, asn0 AS asn FROM raw"""
for _name in ("in3_json_ledger", "in4_xml_ledger"):
    ask(_name, _FILE, RAW)
ask("in1_csv_ledger", _FILE.replace("fee, script_type,", "fee, CASE WHEN txid LIKE '%7' THEN script_type || chr(10) || 'second line' ELSE script_type END AS script_type,"), RAW)
ask(
    "in2_record_kinds",
    """SELECT 'TRANSACTION' AS record_type, count(*) AS n, 0 AS classes FROM raw
    UNION ALL SELECT 'WALLET', count(*), count(DISTINCT toxic) FROM labels UNION ALL SELECT 'TX_CLASS', count(*), count(DISTINCT quality) FROM labels""",
    RAW,
)
ask("in5_list_columns", "SELECT k AS order_key, array_to_string(outs, '~') AS items, len(outs) AS n FROM raw WHERE src_pos % 10 = 0", RAW)
ask(
    "in6_schema_detection",
    """SELECT count(event_id) AS txid, count(ts) AS timestamp, count(value) AS fee, 0 AS script_type, count(user_id) AS input_addresses, 0 AS output_addresses,
    RND(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS fee_sum FROM events""",
)
ask("in7_txid_normalised", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'T' || o_orderkey WHEN o_orderkey % 4 = 3 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS txid FROM orders")
ask(
    "in8_tx_features",
    """, f AS (SELECT CAST(k AS VARCHAR) AS txid, CASE WHEN k % 7 = 0 THEN '1970-01-01T00:00:00Z' ELSE CAST(k % 49 + 1 AS VARCHAR) END AS timestamp,
      CASE WHEN k % 7 = 0 THEN 0 ELSE (k % 49 + 1) * 10800000000 END AS ts_us, CASE WHEN k % 5 = 0 THEN 0.0 ELSE (k % 9) * 0.001 END AS fee,
      CASE WHEN k % 3 <> 0 THEN k % 11 + 1 WHEN k % 2 = 0 THEN 2 ELSE k % 13 + 1 END AS ic, CASE WHEN k % 6 = 0 THEN 1 ELSE k % 17 + 1 END AS oc,
      CASE WHEN k % 4 = 0 THEN k % 100 + 2.5 WHEN k % 8 = 0 THEN 0.0 ELSE CAST(k % 1000 AS DOUBLE) END AS total FROM o WHERE k % 31 <> 0)
    SELECT txid, timestamp, ts_us, RND(fee, 6) AS fee, 'P2PKH' AS script_type, ic AS input_count, oc AS output_count, ic AS fan_in, oc AS fan_out,
      RND(CAST(total AS DOUBLE), 6) AS total_input_amount, RND(CAST(total AS DOUBLE) / oc, 6) AS amount_per_output FROM f""",
    "o AS (SELECT o_orderkey AS k FROM orders)",
)
ask(
    "in9_amount_lists",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 2 END AS n,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 50 + 0.5 + 20.0 WHEN 1 THEN o_orderkey % 50 + 7.25 WHEN 2 THEN o_orderkey % 50 + 3.5 ELSE 0.0 END::DOUBLE AS total FROM orders""",
)
ask(
    "in10_capture",
    f"""SELECT event_id AS obs_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS obs_us,
    CASE WHEN user_id % 5 = 0 THEN '127.0.0.1' ELSE {relay('user_id')} END AS src_ip, CASE WHEN user_id % 3 = 0 THEN 8333 ELSE user_id % 1000 END AS src_port,
    '127.0.0.1' AS dst_ip, 8333 AS dst_port, CASE WHEN user_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS network_txid FROM events""",
)
ask("in11_labels", "SELECT key, class FROM labs", ETX, LABELS)
ask("in12_edge_sets", "SELECT txid, side, count(DISTINCT address) AS addresses FROM eedges GROUP BY txid, side", ETX, EDGES)
ask("in13_edge_filter", "SELECT side, count(*) AS edges, count(DISTINCT address) AS addresses FROM eedges WHERE txid IN (SELECT txid FROM etx WHERE k % 3 = 0) GROUP BY side", ETX, EDGES)
ask("in14_utc_times", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN epoch_us(TIMESTAMP '2024-02-01 00:00:00') ELSE epoch_us(date_trunc('second', ts)) END AS ts_us FROM events")
ask(
    "in15_epochs",
    "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN (event_id % 49 + 1) * 10800 ELSE NULL END AS DOUBLE) AS epoch FROM events",
)
ask(
    "in16_preflight",
    """SELECT * FROM (VALUES ('txs_features.csv', true, 0, 0, 'OK'), ('txs_classes.csv', true, NULL, NULL, 'OK'), ('txs_edgelist.csv', false, NULL, NULL, 'MISSING'),
    ('wallets_features.csv', false, NULL, NULL, 'MISSING'), ('wallets_classes.csv', false, NULL, NULL, 'MISSING'), ('wallets_features_classes_combined.csv', false, NULL, NULL, 'MISSING'),
    ('AddrTx_edgelist.csv', false, NULL, NULL, 'MISSING'), ('TxAddr_edgelist.csv', false, NULL, NULL, 'MISSING'), ('network_data.csv', false, NULL, NULL, 'MISSING'))
    v(file, present, missing_txid, time_errors, status)""",
)
ask(
    "in17_many_files",
    """SELECT 'a.json' AS file, 'COMPLETED' AS status, count(*) AS records FROM raw UNION ALL SELECT 'b.csv', 'COMPLETED', count(*) FROM labels
    UNION ALL SELECT 'c.xml', 'FAILED', 0 UNION ALL SELECT 'missing.csv', 'FAILED', 0""",
    RAW,
)
ask("in18_row_cap", "SELECT txid, timestamp FROM etx ORDER BY CAST(txid AS BIGINT) LIMIT 150", ETX)
ask(
    "in19_correlation_sink",
    """SELECT 'transaction_correlations' AS output, count(*) AS n FROM etx UNION ALL SELECT 'investigation_leads', count(*) FROM etx
    UNION ALL SELECT 'graph_edges', (SELECT count(*) FROM links) + (SELECT count(*) FROM matched WHERE src_ip IS NOT NULL)""",
    MATCHED,
)
ask(
    "in20_ledger_sink",
    """SELECT 'd1' AS dataset_id, count(*) AS n, 'transactions' AS output FROM norm UNION ALL SELECT 'd1', sum(len(ins) + len(outs))::BIGINT, 'legs' FROM norm
    UNION ALL SELECT 'd1', count(*), 'observations' FROM norm WHERE src_ip IS NOT NULL UNION ALL SELECT 'd1', count(*), 'rejects' FROM checked WHERE reason <> ''""",
    NORM,
)

# --- quality ----------------------------------------------------------------------------------------

ask("dq1_reject_reasons", "SELECT src_pos, reason FROM checked", CHECKED)
ask(
    "dq2_patterns",
    f"SELECT src_pos, {TXID_OK.format('txid')} AS txid_ok, len({BAD_IN}) = 0 AS inputs_ok, len({BAD_OUT}) = 0 AS outputs_ok FROM raw",
    RAW,
)
ask("dq3_ip_validity", "SELECT src_ip, count(*) AS n, src_ip NOT LIKE 'host-%' AS ok FROM robs GROUP BY src_ip", ROBS)
ask(
    "dq4_amount_alignment",
    """SELECT src_pos, len(outs) AS n, RND(coalesce(list_sum([greatest(0.0, coalesce(TRY_CAST(x AS DOUBLE), 0.0)) FOR x IN out_amts]), 0.0), 6) AS total FROM raw""",
    RAW,
)
ask(
    "dq5_canonical_fields",
    """SELECT src_pos, greatest(0.0, coalesce(TRY_CAST(fee AS DOUBLE), 0.0)) AS fee, CASE script_type WHEN 'taproot' THEN 'TAPROOT' WHEN 'weird' THEN 'P2PKH' ELSE script_type END AS script_type,
    CASE WHEN src_port IS NULL THEN NULL ELSE coalesce(TRY_CAST(src_port AS INT), 8333) END AS src_port FROM raw""",
    RAW,
)
_score = " ".join(f"WHEN '{c}' THEN {s}" for c, (s, _) in CLASS_SEEDS.items())
_anom = " ".join(f"WHEN '{c}' THEN {a}" for c, (_, a) in CLASS_SEEDS.items())
ask(
    "dq6_class_seeds",
    f"""SELECT key, CASE code {_score} ELSE {CLASS_SEED_OTHER[0]} END AS risk_score, CAST(CASE code {_anom} ELSE {CLASS_SEED_OTHER[1]} END AS DOUBLE) AS anomaly_score FROM wl""",
    "wl AS (SELECT 'U' || doc_id AS key, CASE WHEN toxic = 1 THEN '1' WHEN quality = 1 THEN '2' ELSE '3' END AS code FROM labels)",
)
ask(
    "dq7_geo_enrichment",
    """SELECT src_pos, CASE WHEN src_ip IS NULL THEN coalesce(geo_country, 'UNKNOWN') WHEN geo_country IS NULL OR geo_country = 'UNKNOWN' THEN g.country ELSE geo_country END AS country,
    CASE WHEN asn0 IS NOT NULL THEN asn0 WHEN src_ip IS NULL THEN 'UNKNOWN' ELSE g.asn END AS asn FROM raw LEFT JOIN geo g ON g.ip = src_ip""",
    RAW, RIPS, geo("rips"),
)
ask(
    "dq8_geo_fallback",
    "SELECT src_ip, count(*) AS n, any_value(fb_country) AS country, any_value(fb_asn) AS asn, any_value(fb_org) AS org FROM robs JOIN geo ON ip = src_ip GROUP BY src_ip",
    OBS,
)
ask("dq9_dedupe", "SELECT txid, min(src_pos) AS src_pos, count(*) - 1 AS copies FROM raw WHERE txid <> '' GROUP BY txid", RAW)
ask(
    "dq10_quality_report",
    """SELECT (SELECT count(*) FROM checked) AS total_records, count(*) AS valid_records, (SELECT count(*) FROM checked WHERE reason <> '') AS rejected_records,
    (SELECT CAST(sum(copies) AS BIGINT) FROM firsts) AS duplicate_records, (SELECT count(DISTINCT a) FROM (SELECT unnest(ins) AS a FROM norm UNION ALL SELECT unnest(outs) FROM norm)) AS unique_wallets,
    count(DISTINCT txid) AS unique_txids, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT country) FILTER (country <> 'UNKNOWN') AS unique_countries,
    count(DISTINCT asn) FILTER (asn <> 'UNKNOWN') AS unique_asns, min(ts_us) AS time_min, max(ts_us) AS time_max, RND(sum(greatest(input_total, output_total)), 4) AS total_btc_volume,
    RND(sum(fee_n) / count(*), 6) AS avg_fee FROM norm""",
    NORM,
)
_fields = {
    "txid": "txid <> ''", "timestamp": "ts_us IS NOT NULL", "input_addresses": "len(ins) > 0", "output_addresses": "len(outs) > 0", "input_amounts": "len(ins) > 0",
    "output_amounts": "len(outs) > 0", "fee": "fee_n > 0", "src_ip": "src_ip IS NOT NULL", "geo_country": "country <> 'UNKNOWN'", "asn": "asn <> 'UNKNOWN'",
}
ask(
    "dq11_completeness",
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, RND(count(*) FILTER ({c}) / (SELECT count(*) FROM checked) * 100.0, 1) AS percent FROM norm" for f, c in _fields.items()
    ),
    NORM,
)
ask(
    "dq12_reject_histogram",
    "SELECT reason, count(*) AS n FROM checked WHERE reason <> '' GROUP BY reason UNION ALL SELECT 'Duplicate TXID: ' || txid, copies FROM firsts WHERE copies > 0",
    NORM,
)
ask(
    "dq13_leg_explode",
    """SELECT txid, 'IN' AS direction, i - 1 AS leg_no, ins[i] AS address, RND(CAST(in_amts[i] AS DOUBLE), 6) AS amount FROM norm, generate_series(1, 60) g(i) WHERE i <= len(ins)
    UNION ALL SELECT txid, 'OUT', i - 1, outs[i], RND(CAST(out_amts[i] AS DOUBLE), 6) FROM norm, generate_series(1, 60) g(i) WHERE i <= len(outs)""",
    NORM,
)
ask(
    "dq14_top_legs",
    """SELECT txid, direction, address, RND(amount, 6) AS amount, leg_no FROM (SELECT *, row_number() OVER (PARTITION BY txid, direction ORDER BY amount DESC, leg_no) AS r FROM legs) WHERE r <= 3""",
    LEGS,
)
ask(
    "dq15_observations",
    "SELECT txid, ts_us, src_ip, CASE WHEN src_port = 'http' THEN 8333 ELSE CAST(src_port AS INT) END AS src_port, country, asn FROM norm WHERE src_ip IS NOT NULL",
    NORM,
)
ask(
    "dq16_wallet_merge",
    """, late AS (SELECT DISTINCT address, count(*) AS c FROM legs JOIN tt USING (txid) WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY address), early AS (SELECT DISTINCT address FROM legs JOIN tt USING (txid) WHERE ts < TIMESTAMP '1998-01-01')
    SELECT r.address, first_us, last_us, RND(total_received, 6) AS total_received, RND(total_sent, 6) AS total_sent, tx_count,
    CASE WHEN coalesce(l.c, 0) > 15 THEN 90 WHEN e.address IS NOT NULL THEN 40 ELSE 0 END AS risk_score, CAST(CASE WHEN e.address IS NOT NULL THEN 0.35 ELSE 0 END AS DOUBLE) AS anomaly_score
    FROM rollup r LEFT JOIN late l USING (address) LEFT JOIN early e USING (address)""",
    TIMES, LEGS, ROLLUP,
)
ask(
    "dq17_purge",
    """, d AS (SELECT txid FROM tt WHERE CAST(substr(txid, 2) AS BIGINT) % 3 = 0)
    SELECT 'transactions' AS name, count(*) AS n FROM d UNION ALL SELECT 'legs', count(*) FROM legs WHERE CAST(substr(txid, 2) AS BIGINT) % 3 = 0
    UNION ALL SELECT 'observations', count(*) FROM robs WHERE CAST(substr(txid, 2) AS BIGINT) % 3 = 0 UNION ALL SELECT 'wallets', count(DISTINCT address) FROM legs WHERE CAST(substr(txid, 2) AS BIGINT) % 3 = 0""",
    TIMES, LEGS, ROBS,
)
ask(
    "dq18_dataset_list",
    """, page AS (SELECT * FROM ds ORDER BY dataset_id DESC LIMIT 20 OFFSET 5)
    SELECT dataset_id, records, status, datasets FROM page JOIN (SELECT status, count(*) AS datasets FROM ds GROUP BY status) USING (status)""",
    """ds AS (SELECT strftime(o_orderdate, '%Y-%m') AS dataset_id, count(*) AS records, CASE WHEN count(*) FILTER (o_orderstatus = 'P') % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM orders GROUP BY 1)""",
)

# --- correlation --------------------------------------------------------------------------------------

ask("co1_tx_class", "SELECT txid, coalesce(class, 'unknown') AS tx_class FROM etx LEFT JOIN labs ON key = txid", ETX, LABELS)
ask(
    "co2_wallet_union",
    """SELECT txid, count(DISTINCT address) AS wallet_count, string_agg(DISTINCT address, ';' ORDER BY address) FILTER (side = 'IN') AS ins,
    string_agg(DISTINCT address, ';' ORDER BY address) FILTER (side = 'OUT') AS outs, string_agg(DISTINCT address, ';' ORDER BY address) AS related FROM links GROUP BY txid""",
    ETX, EDGES, LINKS,
)
ask(
    "co3_wallet_classes",
    "SELECT DISTINCT txid, address, class FROM links JOIN wl ON key = address",
    ETX, EDGES, LINKS,
    "wl AS (SELECT 'U' || doc_id AS key, CASE WHEN toxic = 1 THEN 'illicit' WHEN quality = 1 THEN 'licit' ELSE 'unknown' END AS class FROM labels)",
)
ask("co4_exact_match", "SELECT txid, obs_id, src_ip, RND(gap / 1000000.0, 2) AS time_difference_seconds, CAST(1.0 AS DOUBLE) AS network_confidence FROM exact", ETX, CAP, EXACT)
ask("co5_nearest_window", "SELECT txid, obs_id, src_ip, RND(gap / 1000000.0, 2) AS time_difference_seconds FROM near", ETX, CAP, near(120))
ask("co6_confidence_decay", "SELECT txid, RND(greatest(0.0, 1.0 - (gap / 1000000.0) / 300.0), 4) AS network_confidence FROM near", ETX, CAP, near(300))
_NOTES = """CASE correlation_method WHEN 'exact_txid' THEN 'network observation exactly matched by transaction identifier (TXID)'
  WHEN 'timestamp_window' THEN 'network observation temporally correlated with transaction within observation window' ELSE 'no network observation correlated' END"""
ask(
    "co7_tiered_match",
    f"""SELECT txid, correlation_method, network_confidence, time_difference_seconds, src_ip, network_txid,
    coalesce(correlation_method = 'timestamp_window' AND network_txid <> txid, false) AS names_other_tx, {_NOTES} AS observation_note FROM matched""",
    MATCHED,
)
ask(
    "co8_correlation_records",
    """, lists AS (SELECT txid, string_agg(DISTINCT address, ';' ORDER BY address) FILTER (side = 'IN') AS input_wallets, string_agg(DISTINCT address, ';' ORDER BY address) FILTER (side = 'OUT') AS output_wallets,
      string_agg(DISTINCT address, ';' ORDER BY address) AS related_wallets, bool_or(address IN (SELECT 'U' || doc_id FROM labels)) AS wallet_classes FROM links GROUP BY txid)
    SELECT txid, timestamp, tx_class, fee, script_type, fan_in AS input_count, fan_out AS output_count, fan_in, fan_out, amount AS total_input_amount, RND(per_output, 6) AS amount_per_output,
    input_wallets, output_wallets, related_wallets, wallet_classes, network_timestamp, time_difference_seconds, src_ip, src_port, dst_ip, dst_port, network_txid, correlation_method, network_confidence
    FROM matched JOIN lists USING (txid)""",
    MATCHED,
)
ask(
    "co9_feature_vector",
    """SELECT txid, fan_in + fan_out AS degree, RND(fan_in / fan_out, 4) AS fan_ratio, RND(amount, 6) AS transaction_amount, RND(fee, 8) AS fee_rounded,
    RND(per_output, 6) AS amount_per_output_rounded, wallet_count, network_confidence AS network_correlation_strength, coalesce(time_difference_seconds, 999.0) AS temporal_distance FROM matched""",
    MATCHED,
)
ask("co10_lead_score", "SELECT txid, risk_score FROM scored", SCORED)
def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST(RND({x}, {digits}) AS DOUBLE))"


# Evidence wording.
_EV = f"""list_filter([CASE WHEN p1 > 0 THEN '+15 High fan-in: Aggregated from ' || fan_in || ' input sources (threshold >= 4)' END,
  CASE WHEN p2 > 0 THEN '+15 High fan-out: Peeling/splitting across ' || fan_out || ' output addresses (threshold >= 4)' END,
  CASE p3 WHEN 20 THEN '+20 Very large transaction: ' || {_fixed("RND(amount, 6)", 2)} || ' BTC moved (exceeds 50.0 BTC)' WHEN 15 THEN '+15 Large transaction: ' || {_fixed("RND(amount, 6)", 2)} || ' BTC moved (threshold >= 10.0 BTC)' END,
  CASE p4 WHEN 25 THEN '+25 Strong network correlation: Confidence ' || {_fixed("network_confidence", 2)} || ' via ' || correlation_method || ' (time difference: ' || coalesce({_fixed("time_difference_seconds", 1)} || 's', 'exact') || ')'
    WHEN 10 THEN '+10 Moderate temporal network correlation: Confidence ' || {_fixed("network_confidence", 2)} END,
  CASE WHEN p5 > 0 THEN '+10 Highly connected entity: ' || wallet_count || ' associated counterparties' END,
  CASE p6 WHEN 20 THEN '+20 Known illicit category label in benchmark forensic dataset' WHEN 10 THEN '+10 Anomalous high transaction fee: ' || {_fixed("fee", 6)} || ' BTC' END], lambda x: x IS NOT NULL)"""
ask(
    "co11_evidence",
    f"""SELECT txid, CASE WHEN len(e) = 0 THEN 'Standard transaction profile within normal baseline operating bounds' ELSE array_to_string(e, ' | ') END AS evidence, greatest(1, len(e)) AS n
    FROM (SELECT txid, {_EV} AS e FROM scored)""",
    SCORED,
)
ask("co12_priority", "SELECT priority, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS points FROM scored GROUP BY priority", SCORED)
ask(
    "co13_ranked_leads",
    "SELECT txid, timestamp, amount, fee, tx_class, fan_in, fan_out, wallet_count, network_confidence, risk_score, priority FROM scored ORDER BY risk_score DESC, txid",
    SCORED,
)
ask(
    "co14_run_metrics",
    """SELECT count(*) AS transactions_processed, (SELECT count(DISTINCT address) FROM links) AS wallets_connected, (SELECT count(*) FROM cap) AS network_observations,
    count(*) FILTER (correlation_method <> 'none') AS correlated_transactions, count(*) AS investigation_leads, count(*) FILTER (priority = 'HIGH') AS high_priority_leads FROM scored""",
    SCORED,
)
ask(
    "co15_lead_page",
    """, kept AS (SELECT * FROM scored WHERE priority = 'MEDIUM' AND risk_score >= 45 AND tx_class = 'licit' AND timestamp LIKE '%2024-01%')
    SELECT txid, risk_score, (SELECT count(*) FROM kept) AS total FROM kept ORDER BY risk_score DESC, txid LIMIT 40 OFFSET 10""",
    SCORED,
)
ask(
    "co16_lead_detail",
    f"""SELECT txid, risk_score, priority, greatest(1, len({_EV})) AS evidence_n, script_type, wallet_count AS related_n, correlation_method, src_ip FROM scored""",
    SCORED,
)
ask(
    "co17_record_breakdown",
    """SELECT txid, wallet_count AS total_wallets, (SELECT count(DISTINCT address) FROM links l WHERE l.txid = m.txid AND side = 'IN') AS ins,
    (SELECT count(DISTINCT address) FROM links l WHERE l.txid = m.txid AND side = 'OUT') AS outs, correlation_method, dst_port FROM matched m""",
    MATCHED,
)

# --- features ------------------------------------------------------------------------------------------

ask("fe1_leg_union", "SELECT direction, count(*) AS legs, count(DISTINCT address) AS wallets FROM legs JOIN tt USING (txid) WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY direction", TIMES, LEGS)
ask(
    "fe2_leg_counts",
    "SELECT address, count(*) AS tx_count_total, count(*) FILTER (direction = 'OUT') AS tx_incoming_count, count(*) FILTER (direction = 'IN') AS tx_outgoing_count FROM legs GROUP BY address",
    LEGS,
)
ask("fe3_flows", "SELECT address, " + rounded(["total_incoming_btc", "total_outgoing_btc", "net_flow_btc"], 5) + " FROM feats", FEATURES)
ask("fe4_amounts", "SELECT address, " + rounded(["avg_tx_amount", "max_tx_amount", "std_tx_amount"], 5) + " FROM feats", FEATURES)
ask("fe5_mean_gap", "SELECT address, RND(avg_time_between_txs_sec, 5) AS avg_time_between_txs_sec FROM feats", FEATURES)
ask("fe6_velocity", "SELECT address, RND(tx_velocity_per_hour, 5) AS tx_velocity_per_hour FROM feats", FEATURES)
ask("fe7_counterparties", "SELECT address, unique_counterparties FROM peers", LEGS, PEERS)
ask("fe8_fan_ratios", "SELECT address, " + rounded(["fan_in_ratio", "fan_out_ratio"], 6) + " FROM feats", FEATURES)
ask("fe9_graph_degree", "SELECT address, CAST(graph_degree AS BIGINT) AS graph_degree FROM feats", FEATURES)
ask("fe10_network_spread", "SELECT address, unique_observed_ips, unique_asns, unique_countries FROM spread", LEGS, OBS, CELLS)
ask("fe11_geo_entropy", "SELECT address, RND(foreign_geo_entropy, 6) AS foreign_geo_entropy FROM entropy", LEGS, OBS, CELLS)
ask("fe12_feature_documents", "SELECT address AS entity_id, tx_count_total AS legs, 21 AS fields FROM feats", FEATURES)
ask("fe_all_wallet_features", "SELECT address, " + rounded(WALLET_FEATURES, 4) + " FROM feats", FEATURES)

# --- models -----------------------------------------------------------------------------------------------

ask("ml1_clean_matrix", "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 0.0 ELSE value END AS x FROM events")
_SCALED = ["avg_tx_amount", "max_tx_amount", "unique_counterparties", "unique_countries"]


def _scaled(centre: str, scale: str) -> str:
    cols = ", ".join(
        f"RND(({c} - (SELECT {centre.format(c)} FROM feats)) / (SELECT CASE WHEN {scale.format(c)} = 0 THEN 1.0 ELSE {scale.format(c)} END FROM feats), 4) AS {c}" for c in WALLET_FEATURES
    )
    return f"SELECT address, {cols} FROM feats"


ask("ml2_robust_scaling", _scaled("quantile_cont({0}, 0.5)", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"), FEATURES)
ask("ml3_standard_scaling", _scaled("avg({0})", "stddev_pop({0})"), FEATURES)
ask("ml6_score_range", "SELECT address, RND((max_tx_amount - (SELECT min(max_tx_amount) FROM feats)) / (SELECT max(max_tx_amount) - min(max_tx_amount) FROM feats), 6) AS anomaly_score FROM feats", FEATURES)
ask("ml7_contamination_cut", "SELECT event_id, CASE WHEN value > (SELECT quantile_cont(value, 0.95) FROM events) THEN 1 ELSE 0 END AS prediction FROM events")
_Z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0.0)" for c in WALLET_FEATURES)
_IQR = "(quantile_cont({0}, 0.75) OVER () - quantile_cont({0}, 0.25) OVER ())"
_R = ", ".join(f"({c} - quantile_cont({c}, 0.5) OVER ()) / CASE WHEN {_IQR.format(c)} = 0 THEN 1.0 ELSE {_IQR.format(c)} END" for c in WALLET_FEATURES)


def _factor(scaled: str) -> str:
    """CTEs up to lof(address, raw): the outlier factor with 20 neighbours of the scaled features."""
    return f""", z AS (SELECT address, [{scaled}] AS x FROM feats), pts AS (SELECT x, min(address) AS pid, count(*) AS w FROM z GROUP BY x),
    d AS (SELECT a.pid, b.pid AS other, round(list_distance(a.x, b.x), 9) AS distance, b.w - CAST(a.pid = b.pid AS INT) AS w FROM pts a, pts b),
    r AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY pid ORDER BY distance, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b4 FROM d WHERE w > 0),
    near AS (SELECT pid, other, distance, least(w, 20 - b4) AS taken FROM r WHERE b4 < 20),
    kd AS (SELECT pid AS other, max(distance) AS k_distance FROM near GROUP BY 1),
    dens AS (SELECT pid, 1 / (sum(greatest(distance, k_distance) * taken) / sum(taken) + 1e-10) AS density FROM near JOIN kd USING (other) GROUP BY pid),
    m AS (SELECT near.pid, sum(o.density * taken) / sum(taken) AS mean FROM near JOIN dens o ON o.pid = near.other GROUP BY near.pid),
    lof AS (SELECT address, mean / density AS raw FROM z JOIN pts USING (x) JOIN m USING (pid) JOIN dens USING (pid))"""


ask("ml8_local_outlier_factor", _factor(_Z) + " SELECT address, RND(raw, 4) AS raw_score FROM lof", FEATURES)
ask(
    "ml9_comparison_guard",
    _factor(_R)
    + """ SELECT address, RND(raw, 4) AS raw_score, RND(coalesce((raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0), 0.0), 4) AS anomaly_score,
    CASE WHEN raw > quantile_cont(raw, 0.95) OVER () THEN 1 ELSE 0 END AS prediction FROM lof""",
    FEATURES,
)
ask("ml17_training_sample", "SELECT txid, fan_in, fan_out FROM etx ORDER BY md5('42:' || txid), txid LIMIT 500", ETX)
_PROFILE = _SCALED + ["tx_velocity_per_hour", "unique_observed_ips"]
CLUSTERED = f"""{FEATURES},
cl AS (SELECT CAST(floor(unique_counterparties / 40) - 1 AS INT) AS cluster_label, count(*) AS member_count, avg(tx_velocity_per_hour) AS v, avg(unique_counterparties) AS p, avg(unique_observed_ips) AS i,
  {', '.join(f'RND(RND(avg({c}), 4), 3) AS {c}' for c in _PROFILE)} FROM feats GROUP BY 1),
cln AS (SELECT *, CASE WHEN cluster_label = -1 THEN 'Noise / Outlier Group' WHEN v > 5 AND p > 10 THEN 'Cluster ' || cluster_label || ': High-Velocity Fan-Out Entities'
  WHEN i > 3 THEN 'Cluster ' || cluster_label || ': Multi-IP Network Dispersal Cohort' WHEN p < 2 THEN 'Cluster ' || cluster_label || ': Isolated Peer Transfer Chain'
  ELSE 'Cluster ' || cluster_label || ': Behaviorally Correlated Group' END AS cluster_name FROM cl)"""
ask("ml12_cluster_profile", f"SELECT cluster_label, cluster_name, member_count, {', '.join(_PROFILE)} FROM cln", CLUSTERED)


def evaluation(rel: str) -> str:
    """CTEs for metrics of rel(y, p, s): conf, auc, ap."""
    return f"""
conf AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn FROM {rel}),
auc AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS v
  FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {rel})),
ths AS (SELECT s, sum(y) AS pos, count(*) AS c FROM {rel} GROUP BY s),
cum AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tpc, sum(c) OVER (ORDER BY s DESC) AS allc, sum(pos) OVER () AS tot FROM ths),
ap AS (SELECT sum(CASE WHEN tot > 0 THEN pos / tot * tpc / allc ELSE 0 END) AS v FROM cum)"""


METRICS = """SELECT RND(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision, RND(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
  RND(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1_score, RND(coalesce((SELECT v FROM auc), 0.5), 4) AS roc_auc, RND((SELECT v FROM ap), 4) AS pr_auc,
  RND(fp / greatest(1.0, fp + tn), 4) AS false_positive_rate, RND(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS detection_rate, CAST(tp + fp + fn + tn AS BIGINT) AS sample_count"""
_TRUTH = f"SELECT event_id, CASE WHEN {K} % 10 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN value > 60 THEN 1 ELSE 0 END AS p, floor(value) AS s FROM events"
ask("ml13_evaluation", f"{METRICS} FROM conf", f"truth AS ({_TRUTH})", evaluation("truth"))
ask("ml15_self_evaluation", f"{METRICS}, true AS self_evaluated FROM conf", f"truth AS (SELECT p AS y, p, s FROM ({_TRUTH}))", evaluation("truth"))
_second = evaluation("other")
for _n in ("conf", "auc", "ths", "cum", "ap"):
    _second = _second.replace(f"{_n} AS (", f"{_n}2 AS (").replace(f"FROM {_n})", f"FROM {_n}2)")
_second = _second.replace("FROM ths)", "FROM ths2)")
ask(
    "ml14_model_comparison",
    f"{METRICS}, 'ISOLATION_FOREST' AS model FROM conf UNION ALL {METRICS.replace('FROM auc', 'FROM auc2').replace('FROM ap', 'FROM ap2')}, 'LOCAL_OUTLIER_FACTOR' AS model FROM conf2",
    f"truth AS ({_TRUTH})", evaluation("truth"), "other AS (SELECT y, y AS p, s * 0.5 + y AS s FROM truth)", _second,
)
_mm = {
    "fan_in": "fan_in", "fan_out": "fan_out", "transaction_amount": "amount", "fee": "fee", "wallet_count": "wallet_count", "network_confidence": "network_confidence",
    "time_difference_seconds": "coalesce(time_difference_seconds, 999.0)", "degree": "fan_in + fan_out", "unique_counterparties": "wallet_count",
}
ask("ml16_model_matrix", "SELECT txid, " + ", ".join(f"RND(CAST({_mm[c]} AS DOUBLE), 6) AS {c}" for c in MODEL_FEATURES) + " FROM matched", MATCHED)
_H = "least(1.0, fan_in * 0.05 + fan_out * 0.05 + RND(amount, 6) * 0.01 + network_confidence * 0.4)"
ask("ml19_heuristic_score", f"SELECT txid, RND({_H}, 4) AS ml_anomaly_score, CASE WHEN {_H} > 0.6 THEN -1 ELSE 1 END AS ml_anomaly_label FROM matched", MATCHED)
ask("ml20_minimum_population", "SELECT count(DISTINCT address) AS entities, count(DISTINCT address) >= 3 AS enough FROM legs", LEGS)
ask(
    "ml21_run_records",
    """SELECT m AS model_type, '1.0.0' AS version, (SELECT count(*) FROM events) AS dataset_records_count, epoch_us(TIMESTAMP '2024-02-01 00:00:00') AS trained_us
    FROM (VALUES ('ISOLATION_FOREST'), ('LOCAL_OUTLIER_FACTOR')) v(m)""",
)

# --- priority ------------------------------------------------------------------------------------------------

ask(
    "re1_subscores",
    """SELECT address, RND(s1, 1) AS ml_score, RND(s2, 1) AS velocity_score, RND(s3, 1) AS counterparty_score, RND(s4, 1) AS network_score, RND(s5, 1) AS graph_score FROM risk""",
    RISK,
)
ask("re2_composite", "SELECT address, priority_score FROM risk", RISK)
ask("re3_severity", "SELECT address, severity FROM ranked", RISK)
ask("re4_population_baseline", "SELECT feature, " + rounded(["mean", "median", "std", "p90", "min", "max"], 4) + " FROM pop", FEATURES, POP)
ask("re5_deviations", "SELECT address, feature, RND(value, 4) AS value, RND(z, 2) AS z_score, RND(ratio, 2) AS ratio_to_median FROM dev", FEATURES, POP)
ask(
    "re6_top_reasons",
    "SELECT address, r AS rank, feature, RND(z, 2) AS z_score FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY round(z, 9) DESC, pos) AS r FROM dev WHERE z > 1.2) WHERE r <= 4",
    FEATURES, POP,
)
# Reason wording.
_REASON = f"""CASE WHEN feature = 'tx_velocity_per_hour' THEN 'Transaction velocity (' || {_fixed("value", 1)} || ' tx/hr) is ' || {_fixed("ratio", 1)} || 'x higher than population median (' || {_fixed("median", 1)} || ' tx/hr).'
  WHEN feature = 'unique_counterparties' THEN 'Connected to ' || trunc(value)::BIGINT || ' counterparties, significantly exceeding typical baseline (' || trunc(median)::BIGINT || ' peers).'
  WHEN feature = 'unique_observed_ips' THEN 'Observed broadcasting across ' || trunc(value)::BIGINT || ' distinct IP addresses (population normal: ' || trunc(median)::BIGINT || ').'
  WHEN feature = 'unique_asns' THEN 'Associated with transactions routed through ' || trunc(value)::BIGINT || ' autonomous systems (ASNs).'
  WHEN feature = 'unique_countries' THEN 'Transaction broadcast observed in ' || trunc(value)::BIGINT || ' geographic jurisdictions.'
  WHEN feature = 'avg_time_between_txs_sec' AND value < median * 0.2 THEN 'Extremely rapid inter-transaction intervals (' || {_fixed("value", 0)} || 's vs ' || {_fixed("median", 0)} || 's baseline), characteristic of automated peeling chains.'
  WHEN feature = 'graph_degree' THEN 'Unusually high topological graph connectivity (Degree: ' || trunc(value)::BIGINT || ' vs ' || {_fixed("median", 1)} || ' average).'
  WHEN feature = 'foreign_geo_entropy' THEN 'High jurisdictional entropy (' || {_fixed("value", 2)} || ') indicating intentional multi-country network dispersal.'
  ELSE 'Elevated ' || replace(feature, '_', ' ') || ': ' || {_fixed("value", 2)} || ' (z-score: +' || {_fixed("z", 1)} || ').' END"""
ask(
    "re7_reason_texts",
    f"""SELECT f.address, greatest(1, coalesce(n, 0)) AS n, coalesce(t, 'Multivariate Isolation Forest anomaly score: ' || {_fixed("anomaly_score", 2)} || ' (investigation priority: ' || priority_score || '/100).') AS reasons
    FROM risk f LEFT JOIN (SELECT address, count(*) AS n, string_agg({_REASON}, ' | ' ORDER BY r) AS t
      FROM (SELECT dev.*, median, row_number() OVER (PARTITION BY address ORDER BY round(z, 9) DESC, pos) AS r FROM dev JOIN pop USING (feature) WHERE z > 1.2) WHERE r <= 4 GROUP BY address) x ON x.address = f.address""",
    RISK, POP,
)
ask(
    "re8_plain_reasons",
    f"""SELECT address, CASE WHEN len(l) = 0 THEN 'Elevated multivariate statistical anomaly score.' ELSE array_to_string(l, '|') END AS reasons FROM (SELECT address, list_filter([
    CASE WHEN tx_count_total / 10.0 > 4 THEN 'High transaction frequency (' || {_fixed("tx_count_total / 10.0", 1)} || ' tx/hr)' END,
    CASE WHEN unique_counterparties > 10 THEN 'Large counterparty network (' || trunc(unique_counterparties)::BIGINT || ' distinct peers)' END,
    CASE WHEN unique_observed_ips > 3 THEN 'Dispersed network relay observations (' || trunc(unique_observed_ips)::BIGINT || ' unique IPs)' END], lambda x: x IS NOT NULL) AS l FROM feats)""",
    FEATURES,
)
ask("re9_alert_candidates", "SELECT address, priority_score, anomaly_score FROM cands", RISK)
ask("re10_triage", "SELECT address, priority_score, anomaly_score FROM cands ORDER BY priority_score DESC, anomaly_score DESC, address LIMIT 200", RISK)
ask(
    "re11_evidence_sample",
    """, picked AS (SELECT DISTINCT address, txid FROM (SELECT address, direction, txid, row_number() OVER (PARTITION BY address, direction ORDER BY txid) AS r FROM (SELECT DISTINCT address, direction, txid FROM legs)) WHERE r <= 5),
    ips AS (SELECT address, src_ip FROM (SELECT address, src_ip, row_number() OVER (PARTITION BY address ORDER BY src_ip) AS r FROM (SELECT DISTINCT address, src_ip FROM picked JOIN robs USING (txid))) WHERE r <= 5)
    SELECT address, string_agg(txid, ',' ORDER BY txid) AS txs, coalesce((SELECT string_agg(src_ip, ',' ORDER BY src_ip) FROM ips WHERE ips.address = picked.address), '') AS ips FROM picked GROUP BY address""",
    LEGS, ROBS,
)
ask(
    "re12_score_write_back",
    """SELECT address, first_us, last_us, RND(total_received, 6) AS total_received, RND(total_sent, 6) AS total_sent, tx_count, priority_score AS risk_score, anomaly_score FROM rollup JOIN ranked USING (address)""",
    RISK, ROLLUP,
)

# --- profiles -------------------------------------------------------------------------------------------------

ask("bp1_wallet_events", "SELECT address, txid, ts_us, direction, leg_no, RND(amount, 4) AS amount, fan_in, fan_out FROM ev", TIMES, LEGS, EVENTS)
ask("bp2_leak_free_split", "SELECT address, count(*) AS n, max(ts_us) AS last_us, (arg_max(txid, {'t': ts_us, 'x': txid})) AS last_txid FROM prior GROUP BY address", PRIOR)
ask(
    "bp3_point_in_time",
    """, cuts AS (SELECT 'CW' || o_custkey AS address, epoch_us(max(o_orderdate)) AS t FROM orders GROUP BY 1)
    SELECT address, count(*) AS n, max(ts_us) AS last_us FROM ev LEFT JOIN cuts USING (address) WHERE t IS NULL OR ts_us < t GROUP BY address""",
    TIMES, LEGS, EVENTS,
)
ask("bp4_history_tiers", "SELECT address, count(*) AS n, CASE WHEN count(*) < 3 THEN 'INSUFFICIENT_HISTORY' WHEN count(*) >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS reliability FROM prior GROUP BY address", PRIOR)
ask("bp5_amount_profile", "SELECT * FROM amounts", PRIOR, AMOUNTS)
ask("bp6_tempo_profile", "SELECT address, transaction_velocity, transaction_frequency, avg_inter_transaction_time, min_velocity, max_velocity FROM tempo", PRIOR, TEMPO)
ask("bp7_flow_profile", "SELECT * FROM flow", PRIOR, FLOW)
ask(
    "bp8_network_profile",
    """, mtx AS (SELECT DISTINCT address, txid FROM prior), mo AS (SELECT address, src_ip, src_port, country, asn FROM mtx JOIN obs USING (txid)),
    agg AS (SELECT address, count(DISTINCT src_ip) AS unique_observed_ips, count(DISTINCT src_port) AS unique_ports, count(DISTINCT asn) FILTER (asn <> 'UNKNOWN') AS unique_asns,
      count(DISTINCT country) FILTER (country <> 'UNKNOWN') AS unique_countries, list_sort(list(DISTINCT src_ip))[1:10] AS li, list_sort(list(DISTINCT asn) FILTER (asn <> 'UNKNOWN'))[1:5] AS la,
      list_sort(list(DISTINCT country) FILTER (country <> 'UNKNOWN'))[1:5] AS lc FROM mo GROUP BY address),
    ne AS (SELECT address, count(*) AS c FROM prior WHERE txid IN (SELECT txid FROM obs) GROUP BY address)
    SELECT address, unique_observed_ips, unique_ports, unique_asns, unique_countries, c AS network_observation_count, array_to_string(li, ',') AS observed_ips, array_to_string(la, ',') AS asns,
    array_to_string(lc, ',') AS countries FROM agg JOIN ne USING (address)""",
    PRIOR, OBS,
)
ask("bp9_temporal_stats", "SELECT address, lo AS first_us, hi AS last_us, active_duration_hours, max_velocity AS peak_velocity FROM tempo", PRIOR, TEMPO)
ask("bp10_on_demand_baseline", "SELECT * FROM ondemand", TIMES, LEGS, ONDEMAND)
_DBL = ["median_output_amount", "avg_output_amount", "std_amount", "max_amount", "avg_velocity_per_hour", "min_velocity_per_hour", "max_velocity_per_hour", "avg_time_between_txs_sec"]
ask(
    "bp11_resolved_baseline",
    "SELECT address, baseline_source, has_sufficient_history, observation_count, profile_reliability, counterparties_count, "
    + ", ".join(f"RND(CAST({c} AS DOUBLE), 4) AS {c}" for c in _DBL)
    + " FROM resolved",
    TIMES, LEGS, RESOLVED,
)
ask(
    "bp12_deviations",
    """SELECT address, d1 OR d2 OR d3 OR s4 AS has_deviation, CASE WHEN known THEN 'DEVIATION_ANALYSIS_COMPLETE' ELSE 'INSUFFICIENT_HISTORY' END AS status, d1 AS amount_significant, d2 AS velocity_significant,
    d3 AS peers_significant, s4 AS interval_significant FROM verdict""",
    VERDICT,
)
_SK = ["UNUSUAL_VOLUME_SURGE", "HISTORICAL_VELOCITY_SURGE", "COUNTERPARTY_NETWORK_EXPANSION", "RAPID_INTERVAL_COMPRESSION", "NETWORK_INFRASTRUCTURE_DISPERSAL"]
_CK = ["CONSISTENT_WITH_HISTORICAL_VELOCITY", "CONSISTENT_TRANSACTION_VOLUME", "NORMAL_COUNTERPARTY_SCOPE", "WEAK_NETWORK_ATTRIBUTION"]
_whole = "CAST(trunc({0}) AS BIGINT)".format
# Wording of the evidence.
_SUP = [
    f"'Output amount = ' || {_fixed('amount', 2)} || ' BTC; entity historical median = ' || {_fixed('ref', 2)} || ' BTC (' || {_fixed('amount / greatest(0.001, ref)', 1)} || 'x deviation).'",
    f"'Transaction velocity (' || {_fixed('vel', 1)} || ' tx/hr) is ' || {_fixed('vel / greatest(0.01, bvel)', 1)} || 'x higher than entity''s historical baseline (' || {_fixed('bvel', 1)} || ' tx/hr).'",
    f"'Transacted with ' || {_whole('peers')} || ' distinct counterparties, significantly exceeding the entity''s historical interaction scope (' || {_whole('bpeers')} || ' peers).'",
    f"'Inter-transaction interval dropped to ' || {_fixed('gap', 0)} || 's (historical normal: ' || {_fixed('bgap', 0)} || 's), indicating rapid burst/peeling sequence.'",
    f"'Transaction propagation observed across ' || {_whole('ips')} || ' distinct IPs (' || {_whole('asns')} || ' ASNs, ' || {_whole('countries')} || ' jurisdictions).'",
]
_CON = [
    f"'Current transaction velocity (' || {_fixed('vel', 1)} || ' tx/hr) is consistent with the entity''s normal historical operational range (' || {_fixed('vmin', 1)} || '–' || {_fixed('vmax', 1)} || ' tx/hr).'",
    f"'Transaction amount (' || {_fixed('amount', 2)} || ' BTC) aligns with the entity''s established historical volume (' || {_fixed('ref', 2)} || ' BTC median/avg, peak ' || {_fixed('peak', 2)} || ' BTC).'",
    f"'Counterparty interactions (' || {_whole('peers')} || ' peers) are within the entity''s typical historical interaction scope (' || {_whole('bpeers')} || ' peers).'",
    "'Network attribution is single-hop or unverified; no corroborated multi-jurisdiction relaying.'",
]
_UNKNOWN = "Entity has insufficient historical observations to establish a baseline; anomaly cannot be verified against historical behaviour."


def _texts(prefix: str, reasons: list[str], kinds=None) -> str:
    """List of the reasons whose rule fired, with their kinds if given."""
    cases = [f"CASE WHEN {prefix}{i} THEN {f"'{kinds[i - 1]}: ' || " if kinds else ''}{x} END" for i, x in enumerate(reasons, 1)]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


ask("bp13_supporting_evidence", f"SELECT address, coalesce(array_to_string({_texts('s', _SUP, _SK)}, ' | '), '') AS evidence FROM verdict", VERDICT)
ask(
    "bp14_counter_evidence",
    f"SELECT address, CASE WHEN NOT known THEN 'INSUFFICIENT_HISTORICAL_CONTEXT: {_UNKNOWN}' ELSE coalesce(array_to_string({_texts('c', _CON, _CK)}, ' | '), '') END AS evidence FROM verdict",
    VERDICT,
)
ask("bp15_validation_score", "SELECT address, validation_score FROM verdict", VERDICT)
ask("bp16_confidence", "SELECT address, confidence FROM verdict", VERDICT)
# Wording of the verdict.
ask(
    "bp17_explanation",
    f""", told AS (SELECT *, {_texts('s', _SUP)} AS sup, {_texts('c', _CON[:2])} AS con, CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.50 THEN 'Medium' ELSE 'Low' END AS level FROM verdict)
    SELECT address, CASE WHEN NOT known THEN 'Insufficient historical context (' || observation_count || ' transaction observation' || CASE WHEN observation_count <> 1 THEN 's' ELSE '' END || ') to establish a reliable baseline for this entity. Anomaly score (' || {_fixed('raw', 2)} || ') reflects global population outlier divergence without historical entity corroboration. Contextual confidence is limited.'
    WHEN ns = 0 AND nc > 0 THEN 'Although the entity was flagged by the anomaly detector (raw score: ' || {_fixed('raw', 2)} || '), ' || array_to_string(con[1:2], '; ') || ' Contextual validation score (' || {_fixed('validation_score', 2)} || ') and confidence (' || level || ') were reduced.'
    WHEN ns > 0 AND nc = 0 THEN array_to_string(sup[1:2], ' ') || ' Current activity substantially deviates from the entity''s historical baseline. Contextual confidence: ' || level || '.'
    WHEN ns > 0 AND nc > 0 THEN sup[1] || ' However, ' || con[1] || ' Contextual confidence: ' || level || ' due to conflicting contextual indicators.'
    ELSE 'Contextual validation completed. Raw anomaly score: ' || {_fixed('raw', 2)} || ', Validation score: ' || {_fixed('validation_score', 2)} || '. Contextual confidence: ' || level || '.' END AS validation_explanation FROM told""",
    VERDICT,
)
ask(
    "bp18_verdicts",
    "SELECT address, baseline_source, raw AS raw_anomaly_score, validation_score, confidence, d1 OR d2 OR d3 OR s4 AS has_deviation, ns AS supporting, nall AS counter FROM verdict",
    VERDICT,
)

# --- graph ----------------------------------------------------------------------------------------------------

ask("gr1_vertices", "SELECT id, type, label FROM gverts", TIMES, LEGS, OBS, GVERTS)
ask("gr2_edges", "SELECT src, dst, type, RND(amount, 4) AS amount, port FROM gedges", TIMES, LEGS, OBS, GEDGES)
ask(
    "gr3_recency_cap",
    "SELECT type, count(*) AS n FROM gedges GROUP BY type",
    "tt0 AS (SELECT 'T' || o_orderkey AS txid, epoch_us(o_orderdate) AS ts_us FROM orders)",
    "tt AS (SELECT * FROM tt0 ORDER BY ts_us DESC, txid LIMIT 1500)",
    LEGS.replace("legs AS (", "legs0 AS ("),
    "legs AS (SELECT * FROM legs0 WHERE txid IN (SELECT txid FROM tt))",
    OBS, GEDGES,
)
ask(
    "gr4_score_enrichment",
    """SELECT id, type, CASE WHEN type = 'WALLET' THEN coalesce(priority_score, 0) ELSE 0 END AS risk_score, CAST(CASE WHEN type = 'WALLET' THEN coalesce(anomaly_score, 0) ELSE 0 END AS DOUBLE) AS anomaly_score
    FROM gverts LEFT JOIN ranked ON address = id""",
    RISK, GVERTS,
)
EEDGES = """SELECT address AS source, txid AS target, 'wallet' AS source_type, 'transaction' AS target_type, 'input_to' AS relationship FROM links WHERE side = 'IN'
  UNION SELECT txid, address, 'transaction', 'wallet', 'output_to' FROM links WHERE side = 'OUT' UNION SELECT src_ip, txid, 'ip', 'transaction', 'network_observation' FROM matched WHERE src_ip IS NOT NULL"""
ask("gr5_correlation_edges", EEDGES, MATCHED)
ask("gr6_degree", "SELECT id, degree FROM gdeg", TIMES, LEGS, OBS, GEDGES, GDEG)
ask(
    "gr7_ego_network",
    "SELECT n.id, v.type, n.distance, n.id = n.seed AS is_focal FROM nodes n JOIN gverts v USING (id)",
    TIMES, LEGS, OBS, GRAPH,
    "seeds AS (SELECT id AS seed FROM gverts JOIN gdeg USING (id) WHERE type = 'WALLET' ORDER BY degree DESC, id LIMIT 1)",
    EGO,
)
ask("gr10_density", "SELECT (SELECT count(*) FROM gverts) AS node_count, count(*) AS edge_count, RND(count(*) / ((SELECT count(*) FROM gverts) * ((SELECT count(*) FROM gverts) - 1)), 4) AS density FROM gedges", TIMES, LEGS, OBS, GEDGES, GVERTS)
ask(
    "gr11_correlation_ego",
    """SELECT id, any_value(type) AS type, min(d) AS distance, min(d) = 0 AS is_center FROM (SELECT b AS id, 1 AS d FROM st JOIN ctr ON a = c UNION ALL SELECT s2.b, 2 FROM st s1 JOIN ctr ON s1.a = c JOIN st s2 ON s2.a = s1.b
      UNION ALL SELECT c, 0 FROM ctr) JOIN kinds USING (id) GROUP BY id""",
    MATCHED, f"ee AS ({EEDGES})", "ctr AS (SELECT target AS c FROM ee GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)",
    "st AS (SELECT source AS a, target AS b FROM ee UNION SELECT target, source FROM ee)",
    "kinds AS (SELECT id, min(type) AS type FROM (SELECT source AS id, source_type AS type FROM ee UNION ALL SELECT target, target_type FROM ee) GROUP BY id)",
)
SEEDS = "seeds AS (SELECT address AS seed FROM cands ORDER BY priority_score DESC, anomaly_score DESC, address LIMIT 200)"
ask(
    "gr12_fund_flows",
    """SELECT seed, r AS pos, src, dst, type, RND(amount, 4) AS amount FROM (SELECT a.seed, e.*, row_number() OVER (PARTITION BY a.seed ORDER BY src, dst, type, leg_no, amount) AS r
    FROM gedges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst AND b.seed = a.seed WHERE type IN ('INPUT_OF', 'OUTPUT_TO')) WHERE r <= 10""",
    RISK, GRAPH, SEEDS, EGO,
)

# --- investigation ------------------------------------------------------------------------------------------------


def _search(q: str, i: int) -> str:
    return f"""SELECT entity_id, entity_type, label, risk_score FROM (SELECT * FROM (SELECT 0 AS k, address AS entity_id, 'WALLET' AS entity_type, CASE WHEN length(address) > 16 THEN 'Wallet ' || address ELSE address END AS label, priority_score AS risk_score FROM ranked WHERE contains(lower(address), '{q}')
      UNION ALL SELECT 1, txid, 'TRANSACTION', 'TX: ' || left(txid, 10) || '...', 0 FROM tt WHERE contains(lower(txid), '{q}')
      UNION ALL SELECT DISTINCT 2, src_ip, 'IP', 'IP: ' || src_ip, 0 FROM robs WHERE contains(lower(src_ip), '{q}') OR contains('10.0.0.1', '{q}')) ORDER BY k, entity_id LIMIT 30) s{i}"""


ask("qs1_search", " UNION ALL ".join(_search(q, i) for i, q in enumerate(["w99", "t12", "203.0"])), RISK)
DOSSIER = f"{RISK},\n{ROLLUP.strip()}"
ask(
    "qs2_wallet_dossiers",
    """SELECT r.address AS entity_id, k.priority_score AS risk_score, k.severity, first_us, RND(total_received + total_sent, 4) AS total_volume_btc, tx_count AS transaction_count, b.txs AS distinct_transactions,
    CAST(k.unique_counterparties AS BIGINT) AS unique_counterparties, CAST(unique_observed_ips AS BIGINT) AS observed_ip_count, CAST(unique_countries AS BIGINT) AS observed_country_count,
    CAST(unique_asns AS BIGINT) AS observed_asn_count, CAST(floor(k.unique_counterparties / 40) - 1 AS INT) AS cluster_label, k.priority_score >= 35 OR k.anomaly_score > 0.65 AS has_alert
    FROM rollup r JOIN ranked k USING (address) JOIN base b USING (address)""",
    DOSSIER,
)
ask(
    "qs2_dossier_transactions",
    "SELECT DISTINCT address AS entity_id, txid, ts_us, RND(input_total, 4) AS input_total, RND(output_total, 4) AS output_total FROM legs JOIN tx USING (txid)",
    TX, LEGS,
)
ask(
    "qs3_tx_dossiers",
    """SELECT t.txid AS entity_id, t.ts_us AS first_us, RND(input_total + output_total, 4) AS total_volume_btc, i AS input_count, o AS output_count, i + o AS unique_counterparties, coalesce(n, 0) AS observation_count,
    coalesce(c, 0) AS country_count, coalesce(a, 0) AS asn_count FROM tx t JOIN (SELECT txid, count(*) FILTER (direction = 'IN') AS i, count(*) FILTER (direction = 'OUT') AS o FROM legs GROUP BY txid) USING (txid)
    LEFT JOIN (SELECT txid, count(*) AS n, count(DISTINCT country) AS c, count(DISTINCT asn) AS a FROM obs GROUP BY txid) USING (txid)""",
    TX, LEGS, OBS,
)
ask("qs4_ip_dossiers", "SELECT src_ip AS entity_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT txid) AS relayed_tx_count, min(country) AS country, min(asn) AS asn FROM obs GROUP BY src_ip", OBS)
_SEV = ", ".join(f"(SELECT count(*) FROM cands WHERE severity = '{s}') AS {s.lower()}_count" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
ask(
    "qs5_alert_list",
    f""", kept AS (SELECT * FROM cands WHERE severity = 'MEDIUM' AND priority_score % 4 <> 0 AND priority_score >= 36)
    SELECT address AS entity_id, priority_score, (SELECT count(*) FROM kept) AS total, {_SEV} FROM kept ORDER BY priority_score DESC, anomaly_score DESC, address LIMIT 40 OFFSET 10""",
    RISK,
)
TRIAGE = f"""
te AS (SELECT 'A' || user_id AS alert_id, ts, event_id, CASE {K} % 3 WHEN 0 THEN 'TRIAGED' WHEN 1 THEN 'ESCALATED' ELSE 'CLOSED' END AS status, {K} % 2 = 0 AS noted,
  CASE WHEN {K} % 5 = 0 THEN 'analyst' || ({K} % 4) END AS assigned_to FROM events)"""
ask(
    "qs6_triage_fold",
    """SELECT alert_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(assigned_to, {'t': ts, 'e': event_id}) FILTER (assigned_to IS NOT NULL) AS assigned_to, count(*) FILTER (noted) AS notes_count,
    epoch_us(max(ts)) AS updated_at FROM te GROUP BY alert_id""",
    TRIAGE,
)
ask(
    "qs6_triage_history",
    """SELECT alert_id, event_id, coalesce(lower(lag(status) OVER (PARTITION BY alert_id ORDER BY ts, event_id)), 'NEW') || ' -> ' || status AS status_change FROM te""",
    TRIAGE,
)
_ST = ["anomaly_detected", "contextual_validation", "historical_baseline", "evidence_collected", "graph_investigation", "investigative_lead"]
ask(
    "qs7_replay",
    """SELECT v.address AS entity_id, stage_order, stage_id, CASE WHEN stage_order = 2 THEN RND(validation_score - raw, 4) END AS score_adjustment, CAST(CASE WHEN stage_order = 5 THEN nn END AS DOUBLE) AS nodes,
    CAST(CASE WHEN stage_order = 5 THEN coalesce(ne, 0) END AS DOUBLE) AS edges, CAST(CASE WHEN stage_order = 5 THEN coalesce(nf, 0) END AS DOUBLE) AS flows
    FROM verdict v JOIN seeds ON seed = v.address JOIN ncount USING (seed) LEFT JOIN ecount USING (seed), stages""",
    VERDICT,
    RISK[len(FEATURES) + 2 :],
    GRAPH, SEEDS, EGO,
    "ncount AS (SELECT seed, count(*) AS nn FROM nodes GROUP BY seed)",
    "ecount AS (SELECT a.seed, count(*) AS ne, count(*) FILTER (type IN ('INPUT_OF', 'OUTPUT_TO')) AS nf FROM gedges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst AND b.seed = a.seed GROUP BY a.seed)",
    "stages(stage_order, stage_id) AS (VALUES " + ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(_ST)) + ")",
)
ask("qs8_top_alert", "SELECT address AS entity_id, priority_score, CASE WHEN priority_score % 4 = 0 THEN 'CLOSED' ELSE 'NEW' END AS status FROM cands", RISK)
ask(
    "qs9_briefs",
    """SELECT 1 AS section, 9 * count(*) + (SELECT count(*) FROM cands) AS lines, count(*) AS entities FROM feats UNION ALL SELECT 2, 21 * count(*), count(*) FROM feats
    UNION ALL SELECT 3, count(*), count(DISTINCT address) FROM lt UNION ALL SELECT 4, count(*), count(DISTINCT address) FROM lt JOIN obs USING (txid)""",
    RISK,
)
ask(
    "qs10_hourly_volume",
    """, h AS (SELECT hour(ts) AS hr, count(*) AS c, CAST(sum(CAST(value + value * 2 AS DECIMAL(24,6))) AS DOUBLE) AS v FROM events GROUP BY 1),
    al AS (SELECT hour(ts) AS hr, count(*) AS a FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT printf('%02d:00', i) AS time, i AS hour, coalesce(c, 0) AS tx_count, RND(coalesce(v, 0.0), 4) AS volume, coalesce(a, 0) AS alerts, CAST(sum(coalesce(c, 0)) OVER () AS BIGINT) AS total_transactions,
    CAST(sum(coalesce(a, 0)) OVER () AS BIGINT) AS total_alerts FROM hours LEFT JOIN h ON h.hr = i LEFT JOIN al ON al.hr = i""",
    "hours AS (SELECT CAST(i AS INT) AS i FROM generate_series(0, 23) g(i))",
)
ask(
    "qs11_cluster_list",
    """SELECT cluster_label, cluster_name, member_count, (SELECT count(*) FROM cln WHERE cluster_label <> -1) AS total_clusters, (SELECT CAST(coalesce(sum(member_count), 0) AS BIGINT) FROM cln WHERE cluster_label = -1) AS noise_count
    FROM cln ORDER BY cluster_label""",
    CLUSTERED,
)
ask("qs12_severity_counts", "SELECT severity, count(*) AS n FROM cands GROUP BY severity", RISK)
ask(
    "qs13_top_deviations",
    "SELECT address, r AS rank, feature, zs AS z_score FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY abs(zs) DESC, pos) AS r FROM (SELECT *, RND(z, 2) AS zs FROM dev)) WHERE r <= 6",
    FEATURES, POP,
)

# --- streaming --------------------------------------------------------------------------------------------------------

ORACLES["st1_ingest_stream"] = ORACLES["in20_ledger_sink"].replace("'d1' AS dataset_id, ", "").replace("'d1', ", "")
ask("st2_stream_dedupe", "SELECT DISTINCT txid FROM raw WHERE txid <> ''", RAW)
ask(
    "st3_wallet_merge_stream",
    "SELECT address, first_us, last_us, RND(total_received, 6) AS total_received, RND(total_sent, 6) AS total_sent, tx_count, 0 AS risk_score, CAST(0 AS DOUBLE) AS anomaly_score FROM rollup",
    TIMES, LEGS, ROLLUP,
)
ask("st4_correlation_stream", "SELECT txid, correlation_method, network_confidence, time_difference_seconds, src_ip FROM matched", MATCHED)
ask("st5_live_counters", "SELECT count(*) AS records, count(*) FILTER (reason = '') AS valid, count(*) FILTER (reason <> '') AS rejected FROM checked", CHECKED)
ask("st6_hourly_stream", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS tx_count, RND(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS volume FROM events GROUP BY 1")
