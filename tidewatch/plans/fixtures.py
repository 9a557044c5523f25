"""Domain tables derived by SQL from the given star-schema tables.

Each text runs unchanged in Spark and in other SQL engines, so a query and its plain-SQL twin start
from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _addr(tag: str, key: str) -> str:
    k = f"CAST({key} AS STRING)"
    return f"concat('0x', substr(concat(md5(concat('{tag}', {k})), md5(concat({k}, '{tag}'))), 1, 40))"


TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"

VIEWS: dict[str, str] = {
    "fx_blocks": """
SELECT concat('c', CAST(o_orderkey % 5 AS STRING)) AS chain, CAST(floor(o_orderkey / 5) AS BIGINT) AS number,
  md5(concat('b', CAST(o_orderkey AS STRING))) AS block_hash,
  md5(concat('b', CAST(CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_orderkey - 5 END AS STRING))) AS parent_hash,
  o_orderdate AS ts
FROM orders""",
    "fx_tx": f"""
SELECT DISTINCT concat('c', CAST(l.l_orderkey % 5 AS STRING)) AS chain, CAST(floor(l.l_orderkey / 5) AS BIGINT) AS block_number,
  md5(concat_ws('|', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING))) AS tx_hash,
  {_addr("C", "o.o_custkey")} AS from_addr,
  CASE WHEN l.l_partkey % 10 = 0 THEN NULL ELSE {_addr("S", "l.l_suppkey")} END AS to_addr, l.l_partkey AS partkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "fx_receipts": """
SELECT tx_hash, concat('0x', substr(concat(md5(concat('D', tx_hash)), md5(concat(tx_hash, 'D'))), 1, 40)) AS contract_address
FROM fx_tx WHERE to_addr IS NULL AND partkey % 70 <> 0""",
    "fx_logs": f"""
SELECT concat('c', CAST(l.l_orderkey % 5 AS STRING)) AS chain, {_addr("P", "l.l_partkey")} AS address,
  CASE WHEN l.l_linestatus = 'F' THEN '{TRANSFER}' ELSE '0x00' END AS topic0,
  concat('0x', lpad(substr({_addr("S", "l.l_suppkey")}, 3, 40), 64, '0')) AS topic2,
  CAST(floor(l.l_orderkey / 5) AS BIGINT) AS block_number
FROM lineitem l""",
    "fx_code": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("S", "s.s_suppkey")} AS address,
  CASE WHEN (s.s_suppkey + n.n_regionkey) % 11 = 0 THEN NULL WHEN (s.s_suppkey + n.n_regionkey) % 3 = 0 THEN 0 ELSE 1 END AS has_code,
  CASE WHEN s.s_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-01-31 12:00:00' END AS checked_at
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_tokens": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("P", "p.p_partkey")} AS token, p.p_name AS symbol,
  CASE WHEN p.p_size % 10 = 0 THEN NULL WHEN n.n_regionkey = 4 THEN 7 ELSE 6 END AS decimals,
  CASE WHEN p.p_partkey % 20 = 0 THEN 'seed' ELSE 'transfer_log' END AS source
FROM part p CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_prices": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("P", "p.p_partkey")} AS token,
  CASE WHEN p.p_size % 7 = 0 THEN 0.0 WHEN p.p_size = 13 THEN NULL ELSE p.p_retailprice + n.n_regionkey END AS price,
  CASE WHEN p.p_partkey % 9 = 0 THEN TIMESTAMP '2024-01-31 23:50:00' ELSE TIMESTAMP '2024-01-31 23:59:00' END AS ts
FROM part p CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_native": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("S", "s.s_suppkey")} AS address, 'native' AS token,
  CASE WHEN (s.s_suppkey + n.n_regionkey) % 17 = 0 THEN NULL WHEN s.s_suppkey % 3 = 0 THEN '0'
    ELSE concat(CAST(s.s_suppkey * 10 + n.n_regionkey AS STRING), '000000000000000000') END AS raw_amount
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_native_prices": """
SELECT DISTINCT concat('c', CAST(n_regionkey AS STRING)) AS chain, 'native' AS token,
  CASE WHEN n_regionkey = 3 THEN NULL ELSE 2000.0 + n_regionkey END AS price, TIMESTAMP '2024-01-31 23:59:30' AS ts
FROM nation""",
    "fx_history": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("S", "s.s_suppkey")} AS address,
  CASE WHEN s.s_suppkey % 6 = 1 THEN NULL ELSE TIMESTAMP '2024-01-20 00:00:00' END AS history_completed_at,
  s.s_suppkey % 10 = 3 AND n.n_regionkey = 2 AS history_limited, s.s_suppkey % 14 = 2 AS overdue
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n WHERE s.s_suppkey % 2 = 1 OR s.s_suppkey % 14 = 2""",
    "fx_balances": f"""
SELECT concat('c', CAST(l.l_orderkey % 5 AS STRING)) AS chain, {_addr("S", "l.l_suppkey")} AS address, {_addr("P", "l.l_partkey")} AS token,
  CASE WHEN l.l_suppkey % 4 = 3 AND l.l_partkey % 29 = 0 THEN NULL
    ELSE concat(CAST(CAST(floor((SUM(l.l_quantity) - 1) / CASE WHEN l.l_suppkey % 8 IN (0, 2, 3) THEN 10 ELSE 1 END) AS BIGINT) AS STRING), '000000') END AS raw_amount
FROM lineitem l
GROUP BY l.l_orderkey % 5, l.l_suppkey, l.l_partkey""",
    "fx_policies": f"""
SELECT concat('c', CAST(s_suppkey % 5 AS STRING)) AS chain, {_addr("S", "s_suppkey")} AS address,
  'native' AS asset, CASE s_suppkey % 3 WHEN 0 THEN 'exclude_from_total' WHEN 1 THEN 'include' ELSE 'quarantine' END AS policy
FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL
SELECT DISTINCT concat('c', CAST(l_orderkey % 5 AS STRING)) AS chain, {_addr("S", "l_suppkey")} AS address, {_addr("P", "l_partkey")} AS asset,
  CASE l_suppkey % 3 WHEN 0 THEN 'exclude_from_total' WHEN 1 THEN 'include_verified' ELSE 'quarantine' END AS policy
FROM lineitem WHERE l_suppkey % 5 = 0 AND l_partkey % 3 = 0""",
    "fx_scans": """
SELECT event_id AS id, user_id AS address, CAST(ts AS TIMESTAMP) AS scanned_at, round(value * 10000, 2) AS total_usd,
  CASE event_type WHEN 'error' THEN 'incomplete' ELSE CASE WHEN value >= 50 THEN 'qualifying' ELSE 'below' END END AS status,
  CAST(event_id % 21 AS INT) AS coverage, 20 AS total_networks
FROM events""",
    "fx_r_discoveries": f"""
SELECT chain, to_addr AS address, 'active_call' AS source, min(block_number) AS observed_block, 1 AS canonical FROM fx_tx WHERE to_addr IS NOT NULL GROUP BY chain, to_addr
UNION ALL
SELECT chain, to_addr AS address, 'direct_deploy' AS source, min(block_number) - 40 AS observed_block, CASE WHEN to_addr < '0x2' THEN 0 ELSE 1 END AS canonical FROM fx_tx WHERE to_addr < '0x6' GROUP BY chain, to_addr
UNION ALL
SELECT t.chain, r.contract_address AS address, 'direct_deploy' AS source, t.block_number AS observed_block, 1 AS canonical FROM fx_tx t JOIN fx_receipts r ON r.tx_hash = t.tx_hash""",
    "fx_r_contracts": """
SELECT chain, address, min(observed_block) AS created_block, concat('tx', CAST(min(observed_block) AS STRING)) AS created_tx, concat('by', substr(address, 3, 4)) AS creator,
  CASE WHEN address > '0xf8' THEN 0 ELSE 1 END AS canonical FROM fx_r_discoveries GROUP BY chain, address""",
    "fx_r_links": """
SELECT chain, concat('0x', substr(topic2, 27, 40)) AS contract, address AS token, min(block_number) AS first_block, max(block_number) AS last_block, 1 AS canonical
FROM fx_logs GROUP BY chain, concat('0x', substr(topic2, 27, 40)), address""",
    "fx_r_tasks": """
SELECT chain, contract AS address, min(first_block) AS start_block, max(first_block) + 200 AS next_block, CASE WHEN contract < '0x8' THEN min(first_block) + 100 END AS historical_cursor,
  TIMESTAMP '2024-03-01 00:00:00' AS history_due_at, CASE WHEN contract < '0xc' THEN TIMESTAMP '2024-01-15 00:00:00' END AS completed_at FROM fx_r_links WHERE token < '0xa' GROUP BY chain, contract""",
    "fx_r_states": """
SELECT chain, address, CASE WHEN address < '0xc' THEN 'verified' ELSE 'historical_pending' END AS coverage,
  CASE WHEN address < '0x4' THEN NULL WHEN address < '0x8' THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS next_retry_at FROM fx_r_contracts""",
    "fx_r_code": """
SELECT chain, address, 1 AS has_code, observed_block + 10 AS checked_block FROM fx_r_discoveries WHERE source = 'active_call'""",
    "fx_r_cursors": """
SELECT chain, 'live' AS role, max(number) + 1 AS next_block, CASE WHEN chain = 'c4' THEN 'active' ELSE 'reorg_alert' END AS status FROM fx_blocks GROUP BY chain
UNION ALL
SELECT chain, 'backfill' AS role, max(number) - 500 AS next_block, CASE WHEN chain = 'c1' THEN 'complete' ELSE 'reorg_alert' END AS status FROM fx_blocks GROUP BY chain""",
    "fx_r_gaps": """
SELECT DISTINCT chain, CAST(5 AS BIGINT) AS start_block, CAST(90 AS BIGINT) AS end_block, CAST(7 AS BIGINT) AS next_block,
  CASE WHEN chain = 'c3' THEN 'active' ELSE 'reorg_alert' END AS status, CASE WHEN chain = 'c3' THEN 'reorg_replay' ELSE 'tip_reanchor' END AS reason FROM fx_blocks""",
    "fx_log_tasks": f"""
SELECT concat('c', CAST(c_custkey % 5 AS STRING)) AS chain, {_addr("C", "c_custkey")} AS address, c_custkey * 3 % 700 AS first_block, c_custkey * 3 % 700 + c_custkey % 90 AS next_block,
  c_custkey % 6 = 0 AS history_limited, c_custkey % 8 <> 0 AS recent_complete, CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 50 ELSE 10 END AS priority,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 400) END AS recent_due_at, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 ELSE 0 END AS recent_failures,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-18 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 500) END AS history_due_at, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS history_failures,
  CASE WHEN c_custkey % 10 < 3 THEN TIMESTAMP '2024-01-15 00:00:00' END AS completed_at, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 37) AS updated_at,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-11 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 29) END AS recent_updated_at,
  TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 31) AS history_updated_at, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'rate_limit' ELSE 'range' END END AS last_error
FROM customer WHERE c_custkey % 3 <> 0""",
    "fx_log_contracts": f"""
SELECT concat('c', CAST(c_custkey % 5 AS STRING)) AS chain, {_addr("C", "c_custkey")} AS address, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 % 700 - 9 END AS created_block,
  CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS canonical, CAST(c_acctbal * 40 AS DOUBLE) AS last_total_usd
FROM customer""",
    "fx_log_chains": """
SELECT DISTINCT concat('c', CAST(n_regionkey AS STRING)) AS chain, CAST(n_regionkey * 50 AS BIGINT) AS start_block, CASE WHEN n_regionkey < 4 THEN CAST(650 AS BIGINT) END AS last_indexed FROM nation""",
    "fx_log_minutes": """
SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, chain, workload AS lane, count(*) AS completed, CAST(sum(floor(ms)) AS BIGINT) AS links, count(CASE WHEN error_class <> 'ok' THEN 1 END) AS retry_success
FROM fx_attempts GROUP BY 1, 2, 3""",
    "fx_v_tokens": f"""
SELECT concat('c', CAST(l_orderkey % 5 AS STRING)) AS chain, {_addr("S", "l_suppkey")} AS address, {_addr("P", "l_partkey")} AS token, CAST(CAST(sum(l_quantity) AS BIGINT) AS STRING) AS raw_amount,
  CASE WHEN l_partkey % 23 = 1 THEN NULL ELSE CAST(sum(l_quantity) AS DOUBLE) END AS amount, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey % 50 + 1 AS DOUBLE) END AS price,
  CASE WHEN l_partkey % 3 <> 0 THEN CAST(sum(l_quantity) AS DOUBLE) * (l_partkey % 50 + 1) END AS usd_value, CASE WHEN l_partkey % 3 <> 0 THEN 1 ELSE 0 END AS priced,
  CASE WHEN l_partkey % 11 = 0 THEN 'stale' WHEN l_partkey % 13 = 0 THEN 'quarantine' WHEN l_partkey % 17 = 0 THEN 'exclude_from_total' ELSE 'included' END AS valuation
FROM lineitem GROUP BY l_orderkey % 5, l_suppkey, l_partkey
UNION ALL
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("S", "s.s_suppkey")} AS address, 'native' AS token, CAST(s.s_suppkey % 9 AS STRING) AS raw_amount, CAST(s.s_suppkey % 9 AS DOUBLE) AS amount,
  CASE WHEN s.s_suppkey % 4 <> 0 THEN CAST(2000 AS DOUBLE) END AS price, CASE WHEN s.s_suppkey % 4 <> 0 THEN CAST(s.s_suppkey % 9 * 2000 AS DOUBLE) END AS usd_value, CASE WHEN s.s_suppkey % 4 <> 0 THEN 1 ELSE 0 END AS priced, 'included' AS valuation
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_v_states": f"""
SELECT concat('c', CAST(n.n_regionkey AS STRING)) AS chain, {_addr("S", "s.s_suppkey")} AS address, CASE WHEN (s.s_suppkey + n.n_regionkey) % 6 = 5 THEN NULL ELSE 1 END AS has_code,
  CASE (s.s_suppkey + n.n_regionkey) % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'price_missing' WHEN 2 THEN 'absent' ELSE 'complete' END AS status,
  CASE WHEN s.s_suppkey % 4 <> 0 THEN CAST(s.s_suppkey % 9 * 2000 + 500 AS DOUBLE) END AS observed_native_usd, CASE WHEN s.s_suppkey % 4 <> 0 THEN CAST(s.s_suppkey % 9 * 2000 AS DOUBLE) END AS included_native_usd,
  CAST(700 AS DOUBLE) AS tokens_usd, CAST(s.s_suppkey % 9 * 2000 + 700 AS DOUBLE) AS total_usd, CAST(0 AS DOUBLE) AS excluded_usd, 'included' AS valuation,
  CASE WHEN s.s_suppkey % 8 = 3 THEN 'history_unknown' ELSE 'verified' END AS coverage, CASE WHEN s.s_suppkey % 3 <> 2 THEN TIMESTAMP '2024-01-25 00:00:00' END AS last_success_at,
  TIMESTAMP '2024-02-20 00:00:00' AS next_retry_at, CASE WHEN s.s_suppkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' END AS price_retry_at
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation) n""",
    "fx_v_contracts": f"""
SELECT concat('c', CAST(s_suppkey % 5 AS STRING)) AS chain, {_addr("S", "s_suppkey")} AS address, CAST(1 AS DOUBLE) AS last_total_usd, 'old' AS last_status FROM supplier""",
    "fx_v_scans": f"""
SELECT s.s_suppkey * 2 + r.n_regionkey AS scan_id, {_addr("S", "s.s_suppkey")} AS address, CAST(5 AS DOUBLE) AS total_usd, 'old' AS status
FROM supplier s CROSS JOIN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey < 2) r""",
    "fx_v_scan_parts": """
SELECT a.scan_id, s.chain, s.status, s.has_code, s.included_native_usd AS native_usd, CASE WHEN a.scan_id % 3 = 0 THEN s.observed_native_usd END AS observed_native_usd, s.included_native_usd, s.tokens_usd, s.total_usd, s.excluded_usd, s.valuation
FROM fx_v_scans a JOIN fx_v_states s ON s.address = a.address""",
    "fx_v_scan_tokens": """
SELECT a.scan_id, t.chain, t.token, t.raw_amount, t.amount, t.price, CASE WHEN a.scan_id % 2 = 0 THEN t.usd_value / 2 ELSE t.usd_value END AS usd_value, t.priced, t.valuation
FROM fx_v_scans a JOIN fx_v_tokens t ON t.address = a.address""",
    "fx_v_work": """
SELECT chain, address, CASE WHEN token < '0x8' THEN 'token_balance' ELSE 'token_metadata' END AS kind, token AS asset, 'pending' AS status, TIMESTAMP '2024-02-03 00:00:00' AS due_at, CAST(length(raw_amount) AS INT) AS failure_streak
FROM fx_v_tokens WHERE token LIKE '0x_2%'
UNION ALL
SELECT chain, address, 'code' AS kind, '' AS asset, 'pending' AS status, TIMESTAMP '2024-02-03 00:00:00' AS due_at, 0 AS failure_streak FROM fx_v_states WHERE address < '0x9'
UNION ALL
SELECT chain, address, 'native_balance' AS kind, '' AS asset, 'pending' AS status, TIMESTAMP '2024-02-04 00:00:00' AS due_at, 3 AS failure_streak FROM fx_v_states WHERE address < '0x3'""",
    "fx_samples": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_type AS chain, CASE WHEN user_id % 2 = 0 THEN 'live' ELSE 'backfill' END AS role,
  CASE WHEN user_id % 50 = 0 THEN 'none' ELSE concat('rpc', CAST(user_id % 4 AS STRING)) END AS active_rpc,
  event_id * 10 AS cursor_block, event_id * 10 + CAST(floor(value) AS BIGINT) AS safe_head,
  CAST(floor(event_id / 700) AS BIGINT) AS run_id, event_id % 700 AS scans, CAST(floor(value) AS BIGINT) + 1 AS rpc_requests, CAST(floor(value / 5) AS BIGINT) AS rpc_errors, props AS errors_json
FROM events""",
    "fx_attempts": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, concat('c', CAST(user_id % 5 AS STRING)) AS chain,
  CASE user_id % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'balances' ELSE 'token_logs' END AS workload,
  event_type AS method_group, concat('e', CAST(user_id % 4 AS STRING)) AS endpoint,
  CASE WHEN event_type = 'error' THEN 'rate_limit' ELSE 'ok' END AS error_class, value AS ms
FROM events""",
    "fx_resources": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN value > 100 THEN 100.0 ELSE value END AS cpu_percent,
  value / 25 AS load1, CAST(4 AS DOUBLE) AS cpu_cores, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 2 END AS ram_percent
FROM events""",
}


def needed(names: list[str]) -> list[str]:
    """The views with those they build on, these first."""
    out: list[str] = []
    for name in names:
        for other in [*needed([v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]), name]:
            if other not in out:
                out.append(other)
    return out


def _tx_keys(frames: dict[str, DataFrame]) -> DataFrame:
    rows = frames["lineitem"].join(frames["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey").distinct()


def _policy_keys(frames: dict[str, DataFrame]) -> DataFrame:
    rows = frames["lineitem"].where("l_suppkey % 5 = 0 AND l_partkey % 3 = 0")
    return rows.select((F.col("l_orderkey") % 5).alias("l_orderkey"), "l_suppkey", "l_partkey").distinct()


#: Views of distinct rows whose texts follow one to one from keys: distinct keys are shuffled in Spark, a fifth of the texts' bytes.
KEYS = {"fx_tx": _tx_keys, "fx_policies": _policy_keys}


def _spark_text(name: str) -> str:
    """The text of a view, over distinct keys in place of lineitem where it has them."""
    text = VIEWS[name]
    if name in KEYS:
        text = text.replace("SELECT DISTINCT", "SELECT").replace(" JOIN orders o ON l.l_orderkey = o.o_orderkey", "").replace("o.o_custkey", "l.o_custkey")
    return text


def tasks_for(rows: DataFrame, most: int = 500_000) -> int:
    """How many tasks hold rows with at most about `most` each; never fewer than the session's shuffles have."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def view(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    """A derived table over the Parquet files of sf_dir; with tasks, lines are dealt to so many by supplier and part before they are summed."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if any(re.search(rf"\b{t}\b", VIEWS[v]) for v in needed([name]))}
    if tasks and "lineitem" in frames:
        frames["lineitem"] = frames["lineitem"].repartition(tasks, "l_suppkey", "l_partkey")
    for v in needed([name]):
        text, own = _spark_text(v), frames | ({"lineitem": KEYS[v](frames)} if v in KEYS else {})
        for t in [*BASE, *VIEWS]:
            if t in frames:
                text = re.sub(rf"(?<=FROM )({t})\b|(?<=JOIN )({t})\b", f"{{{t}}}", text)
        frames[v] = spark.sql(text, **{t: f for t, f in own.items() if f"{{{t}}}" in text})
    return frames[name]


def sql(*names: str, body: str) -> str:
    """body behind the derived tables as common table expressions."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed(list(names))) + body
