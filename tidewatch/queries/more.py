"""Queries of merges, reports and scheduling that need small state tables, made from the derived ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import discovery, merge, reorg, reports, schedule, sui, telemetry, valuation
from tidewatch.plans.fixtures import AS_OF, sql, tasks_for, view


def next_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap of each chain to work on next."""
    r = reorg.missing_ranges(view(spark, sf_dir, "fx_tx").withColumnRenamed("block_number", "number"))
    status = F.when(F.col("start_block") % 3 == 0, "complete").when(F.col("start_block") % 7 == 0, "reorg_replay").otherwise("active")
    return schedule.next_gap(r.withColumn("status", status))


NEXT_GAPS = sql("fx_tx", body=""", p AS (SELECT chain, block_number AS n, lead(block_number) OVER (PARTITION BY chain ORDER BY block_number) AS x FROM (SELECT DISTINCT chain, block_number FROM fx_tx)),
r AS (SELECT chain, n + 1 AS start_block, x - 1 AS end_block, CASE WHEN (n + 1) % 3 = 0 THEN 'complete' WHEN (n + 1) % 7 = 0 THEN 'reorg_replay' ELSE 'active' END AS status FROM p WHERE x > n + 1)
SELECT * FROM r WHERE status <> 'complete' QUALIFY row_number() OVER (PARTITION BY chain ORDER BY status DESC, start_block) = 1""")


def replay_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to replay per conflict; chains without an ancestor raise an alert."""
    blocks = view(spark, sf_dir, "fx_blocks")
    conflicts = reorg.parent_conflicts(blocks).select("chain", F.when(F.col("number") % 2 == 0, F.col("number") - 1).alias("ancestor"))
    return reorg.replay_ranges(conflicts, blocks.groupBy("chain").agg(F.max("number").alias("tip")))


REPLAY = sql("fx_blocks", body=""", c AS (SELECT b.chain, CASE WHEN b.number % 2 = 0 THEN b.number - 1 END AS a FROM fx_blocks b JOIN fx_blocks p ON p.chain = b.chain AND p.number = b.number - 1 WHERE b.parent_hash <> p.block_hash)
SELECT c.chain, a + 1 AS start_block, t.tip AS end_block, CASE WHEN a IS NULL THEN 'reorg_alert' ELSE 'reorg_replay' END AS status FROM c JOIN (SELECT chain, max(number) AS tip FROM fx_blocks GROUP BY chain) t ON t.chain = c.chain""")


def contract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of each chain by the status of the latest scan of their number."""
    latest = schedule.latest_by_id(view(spark, sf_dir, "fx_scans")).select(F.col("address").alias("k"), F.col("status").alias("last_status"))
    code = view(spark, sf_dir, "fx_code").where("has_code = 1").withColumn("k", F.conv(F.substring("address", 3, 2), 16, 10).cast("bigint"))
    return reports.contract_counts(code.join(latest, "k", "left"))


CONTRACT_COUNTS = sql("fx_scans", "fx_code", body=""", l AS (SELECT address, status FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1),
c AS (SELECT chain, l.status FROM fx_code f LEFT JOIN l ON l.address = CAST(concat('0x', substr(f.address, 3, 2)) AS BIGINT) WHERE has_code = 1)
SELECT chain, count(*) AS contracts, count(*) FILTER (WHERE status IS NULL) AS unchecked, count(*) FILTER (WHERE status = 'qualifying') AS qualifying, count(*) FILTER (WHERE status = 'below') AS below, count(*) FILTER (WHERE status = 'incomplete') AS incomplete FROM c GROUP BY chain""")


def merge_chain_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code states with a later read: unknown facts keep the old ones."""
    code = view(spark, sf_dir, "fx_code")
    old = code.where("chain <> 'c4'").select("address", "chain", "has_code", F.lit("old").alias("status"))
    new = code.where("chain >= 'c2'").select("address", "chain", F.when(F.col("checked_at") < "2024-01-31", F.lit(None)).otherwise(1 - F.col("has_code")).cast("int").alias("has_code"), F.lit("new").alias("status"))
    return merge.merge_chain_state(old, new)


MERGE_CHAIN_STATE = sql("fx_code", body="""
SELECT address, chain, CASE WHEN chain < 'c2' THEN has_code WHEN checked_at >= TIMESTAMP '2024-01-31 00:00:00' AND has_code IS NOT NULL THEN 1 - has_code WHEN chain <> 'c4' THEN has_code END AS has_code,
  CASE WHEN chain < 'c2' THEN 'old' ELSE 'new' END AS status FROM fx_code""")


def wake_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain states that new links wake, without capped addresses."""
    links = discovery.token_links(view(spark, sf_dir, "fx_logs"), view(spark, sf_dir, "fx_code"))
    state = view(spark, sf_dir, "fx_code").select("chain", "address", F.lit("2024-03-01 00:00:00").cast("timestamp").alias("next_retry_at"))
    capped = state.where("address < '0x4'").select("address").distinct()
    out = merge.wake_chains(state, links.where("token < '0x9'"), links.where("first_block % 2 = 1"), capped, AS_OF)
    return out.select("chain", "address", (F.col("next_retry_at") == F.lit(AS_OF).cast("timestamp")).alias("woken"))


WAKE = sql("fx_logs", "fx_code", body=""", l AS (SELECT l.chain, concat('0x', right(l.topic2, 40)) AS contract, l.address AS token, min(l.block_number) AS f FROM fx_logs l WHERE l.topic0 <> '0x00' GROUP BY 1, 2, 3)
SELECT chain, address, address >= '0x4' AND EXISTS (SELECT 1 FROM l WHERE l.chain = c.chain AND l.contract = c.address AND l.f % 2 = 1 AND l.token >= '0x9') AS woken FROM fx_code c""")


def pull_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Healthy chains of valuable addresses are due within three days."""
    latest = schedule.latest_by_id(view(spark, sf_dir, "fx_scans"))
    state = latest.select("address", F.when(F.col("status") == "incomplete", "partial").otherwise("complete").alias("status"), F.lit("2024-03-01 00:00:00").cast("timestamp").alias("due_at"))
    out = schedule.pull_forward(state, latest.select("address", "total_usd"), AS_OF)
    return out.select("address", "status", F.unix_seconds("due_at").alias("due_at"))


PULL = sql("fx_scans", body=""", l AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY id DESC) = 1)
SELECT address, CASE WHEN status = 'incomplete' THEN 'partial' ELSE 'complete' END AS status, CASE WHEN status <> 'incomplete' AND total_usd >= 150000 THEN CAST(epoch(TIMESTAMP '2024-02-04 00:00:00') AS BIGINT) ELSE CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') AS BIGINT) END AS due_at FROM l""")


def refresh_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty balances to refresh of each address and chain, by amount."""
    tasks = tasks_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    b = view(spark, sf_dir, "fx_balances", tasks).where("raw_amount is not null").withColumn("address", S.packed(F.col("address")))
    out = schedule.first_per_key(b, ["address", "chain"], [F.length("raw_amount").desc(), F.col("raw_amount").desc(), F.col("token")], 20, tasks)
    return out.select(S.unpacked(F.col("address")).alias("address"), "chain", "token", "place")


REFRESH = sql("fx_balances", body=" SELECT address, chain, token, CAST(row_number() OVER w AS INT) AS place FROM fx_balances WHERE raw_amount IS NOT NULL WINDOW w AS (PARTITION BY address, chain ORDER BY length(raw_amount) DESC, raw_amount DESC, token) QUALIFY row_number() OVER w <= 20")


def due_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = view(spark, sf_dir, "fx_code")
    state = code.where("has_code is not null").select("address", "chain", "has_code", F.lit("complete").alias("status"), F.col("checked_at").alias("next_retry_at"))
    return schedule.due_chains(valuation.address_chain_matrix(code, code, state), "2024-01-31 00:00:00").select("address", "chain", "status")


DUE_CHAINS = sql("fx_code", body=" SELECT address, chain, CASE WHEN has_code IS NULL THEN 'rpc_error' ELSE 'complete' END AS status FROM fx_code WHERE has_code IS NULL OR checked_at <= TIMESTAMP '2024-01-31 00:00:00'")


def network_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by who waits and who lags, with their place."""
    last = telemetry.latest_samples(view(spark, sf_dir, "fx_samples"), ["chain"])
    rows = last.select("chain", (F.col("id") % 61).alias("wait_seconds"), (F.col("safe_head") - F.col("cursor_block")).alias("lag_blocks"))
    return schedule.network_order(rows)


NETWORK_ORDER = sql("fx_samples", body=" SELECT chain, id % 61 AS wait_seconds, safe_head - cursor_block AS lag_blocks, id % 61 >= 30 AS starved FROM fx_samples QUALIFY row_number() OVER (PARTITION BY chain ORDER BY id DESC) = 1")


def network_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "fx_samples").withColumn("chain", F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    gaps = reorg.missing_ranges(view(spark, sf_dir, "fx_tx").withColumnRenamed("block_number", "number")).groupBy("chain").agg(F.count("*").alias("gaps"))
    return reports.network_report(samples, view(spark, sf_dir, "fx_attempts"), gaps).select("chain", "id", "cursor_block", "error_class", "failures", "gaps")


NETWORK_REPORT = sql("fx_samples", "fx_attempts", "fx_tx", body=""", s AS (SELECT concat('c', CAST(id % 5 AS STRING)) AS chain, id, cursor_block FROM fx_samples WHERE role = 'live' QUALIFY row_number() OVER (PARTITION BY id % 5 ORDER BY id DESC) = 1),
n AS (SELECT chain, workload, endpoint, error_class, count(*) AS n FROM fx_attempts WHERE error_class <> 'ok' GROUP BY 1, 2, 3, 4), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY chain ORDER BY n DESC, workload, endpoint) = 1),
p AS (SELECT chain, block_number AS b, lead(block_number) OVER (PARTITION BY chain ORDER BY block_number) AS x FROM (SELECT DISTINCT chain, block_number FROM fx_tx)), g AS (SELECT chain, count(*) AS gaps FROM p WHERE x > b + 1 GROUP BY chain)
SELECT s.chain, s.id, s.cursor_block, f.error_class, f.n AS failures, g.gaps FROM s LEFT JOIN f ON f.chain = s.chain LEFT JOIN g ON g.chain = s.chain""")


def absent_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("project_key"), "s_suppkey")
    return merge.absent_projects(s.select("project_key"), s.where("s_suppkey % 3 <> 0").select("project_key"))


def package_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with their active objects as owners."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(S.sui_id(F.hex("s_suppkey")).alias("package_id"))
    n = sup.count()
    objects = part.select(S.sui_id(F.hex(F.col("p_partkey") % n)).alias("package_id"), S.sui_id(F.hex("p_partkey")).alias("object_id"), (F.col("p_partkey") % 4 != 0).cast("int").alias("active"))
    return sui.owners(sup, objects).select("package_id", F.size("owners").alias("owners"))


_ID = "concat('0x', lpad(lower(to_hex(CAST({} AS BIGINT))), 64, '0'))"
OWNERS = f"""WITH n AS (SELECT count(*) AS n FROM supplier), o AS (SELECT DISTINCT p_partkey % n AS k, p_partkey AS p FROM part CROSS JOIN n WHERE p_partkey % 4 <> 0)
SELECT {_ID.format('s_suppkey')} AS package_id, CAST(1 + count(p) - count(*) FILTER (WHERE p = s_suppkey) AS INT) AS owners FROM supplier LEFT JOIN o ON o.k = s_suppkey GROUP BY s_suppkey"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events priced by the last error event of their user within a day: an as-of lookup at each one's own time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = valuation.price_history(e.where("event_type <> 'error'").select("event_id", "token", "ts"), e.where("event_type = 'error'").select("token", F.col("value").alias("price"), "ts"), 86400)
    return out.select("event_id", F.round("price", 6).alias("price"))


PRICE_HISTORY = """WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events), p AS (SELECT * FROM e WHERE event_type = 'error' AND value > 0)
SELECT o.event_id, round(CASE WHEN floor(epoch(o.ts)) - floor(epoch(p.ts)) <= 86400 THEN p.value END, 6) AS price FROM (SELECT * FROM e WHERE event_type <> 'error') o ASOF LEFT JOIN p ON p.user_id = o.user_id AND p.ts <= o.ts"""

QUERIES = {
    "next_gaps": (next_gaps, NEXT_GAPS),
    "replay_ranges": (replay_ranges, REPLAY),
    "contract_counts": (contract_counts, CONTRACT_COUNTS),
    "merge_chain_state": (merge_chain_state, MERGE_CHAIN_STATE),
    "wake_chains": (wake_chains, WAKE),
    "pull_forward": (pull_forward, PULL),
    "refresh_items": (refresh_items, REFRESH),
    "due_chains": (due_chains, DUE_CHAINS),
    "network_order": (network_order, NETWORK_ORDER),
    "network_report": (network_report, NETWORK_REPORT),
    "absent_projects": (absent_projects, "SELECT concat('p', CAST(s_suppkey AS STRING)) AS project_key FROM supplier WHERE s_suppkey % 3 = 0"),
    "package_owners": (package_owners, OWNERS),
    "price_history": (price_history, PRICE_HISTORY),
}
