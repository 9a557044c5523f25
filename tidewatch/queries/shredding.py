"""Nested and encoded inputs, made from the given tables and taken apart again.

Each query builds the text that a provider would land (JSON documents, hex words, metric lines, stream
frames) from rows of the tables, and runs the operators over it; the SQL twin computes the result from
the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import discovery, sui, telemetry
from tidewatch.sources import landed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks in JSON with their lines as transactions; lines of every tenth part deploy."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(
            F.concat(F.lit("0xA"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("hash"),
            F.when(F.col("l_partkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("0xB"), F.col("l_suppkey").cast("string"))).alias("to"),
            F.concat(F.lit("0xF"), F.col("l_partkey").cast("string")).alias("from"),
        ))).alias("transactions"),
    )
    text = rows.select(F.to_json(F.struct(F.lit("c0").alias("chain"), F.concat(F.lit("0x"), F.lower(F.hex("l_orderkey"))).alias("number"), "transactions")).alias("j"))
    blocks = text.select(F.from_json("j", landed.BLOCKS).alias("b")).select("b.*")
    return discovery.shred_blocks(blocks).groupBy("block_number", "kind").agg(F.count("*").alias("n"), F.count("to_addr").alias("targets"), F.min("from_addr").alias("first_from"))


SHRED_BLOCKS = """SELECT l_orderkey AS block_number, CASE WHEN l_partkey % 10 = 0 THEN 'deploy' ELSE 'call' END AS kind, count(*) AS n,
  count(*) FILTER (WHERE l_partkey % 10 <> 0) AS targets, min(concat('0xf', CAST(l_partkey AS STRING))) AS first_from FROM lineitem GROUP BY 1, 2"""


def sui_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as raw transactions with a call, a published package and a changed object."""
    s = lambda c: F.col(c).cast("string")
    payload = F.concat(
        F.lit('{"result":{"transaction":{"data":{"transaction":{"transactions":[{"MoveCall":{"package":"0x'), F.lower(F.hex("l_partkey")), F.lit('"}},{"Publish":{}}]}}},"objectChanges":[{"type":"published","packageId":"0x'),
        F.lower(F.hex(F.col("l_suppkey") + 16)), F.lit('"},{"type":"mutated","objectType":"0x'), F.lower(F.hex("l_suppkey")), F.lit('::m::T","objectId":"0x'), F.lower(F.hex("l_orderkey")),
        F.when(F.col("l_linenumber") % 3 == 0, '","owner":{"Shared":{"v":1}}}]}}').when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit('","owner":{"ObjectOwner":"0x'), F.lower(F.hex("l_partkey")), F.lit('"}}]}}'))).otherwise('","owner":{"AddressOwner":"0x1"}}]}}'),
    )
    raw = _table(spark, sf_dir, "lineitem").select(s("l_orderkey").alias("digest"), payload.alias("payload"))
    facts = sui.raw_facts(raw)
    o = F.get("objects", F.lit(0))
    return facts.groupBy(F.get("calls", F.lit(0)).alias("call")).agg(
        F.count("*").alias("n"), F.sum(F.size("published")).cast("bigint").alias("published"), F.sum(F.size("objects")).cast("bigint").alias("objects"),
        F.count_if(o["owner_kind"] == "shared").alias("shared"), F.min(o["parent_object"]).alias("first_parent"),
    )


_SUI = "concat('0x', lpad(lower(to_hex(CAST({} AS BIGINT))), 64, '0'))"
SUI_CALLS = f"""WITH r AS (SELECT CASE WHEN l_partkey > 3 THEN {_SUI.format('l_partkey')} END AS call, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 AND l_suppkey > 3 THEN {_SUI.format('l_partkey')} END AS parent FROM lineitem)
SELECT call, count(*) AS n, count(*) AS published, count(*) FILTER (WHERE l_suppkey > 3 AND l_linenumber % 3 IN (0, 1)) AS objects,
  count(*) FILTER (WHERE l_suppkey > 3 AND l_linenumber % 3 = 0) AS shared, min(parent) AS first_parent FROM r GROUP BY call"""


def sui_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as projects with values under one of three names and packages from their nation."""
    t = _table(spark, sf_dir, "supplier")
    k, v = F.col("s_suppkey"), (F.col("s_acctbal") * 1000).cast("string")
    ids = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("0x"), F.hex("s_nationkey")), F.concat(F.lit("0X"), F.hex("s_nationkey")), F.lit("bad!")))
    rows = t.select(
        F.concat(F.lit(" P"), k.cast("string")).alias("projectName"), F.when(k % 3 == 0, v).alias("currTvl"), F.when(k % 3 == 1, v).alias("currentTvl"), F.when(k % 3 == 2, F.when(k % 5 == 0, "NaN").otherwise(v)).alias("tvl"),
        F.when(k % 2 == 0, ids).alias("packages"), F.when(k % 2 == 1, ids).alias("projectPackages"),
    )
    policies = t.select(F.concat(F.lit("p"), k.cast("string")).alias("project_key"), F.when(k % 11 == 0, "quarantine").when(k % 11 == 1, "include_verified").alias("policy")).where("policy is not null")
    out = sui.project_snapshot(rows, policies, 2_000_000.0, 8_000_000.0)
    return out.select("project_key", F.round("indexed_tvl", 2).alias("indexed_tvl"), F.size("packages").alias("n_packages"), "status", "valuation")


SUI_PROJECTS = """WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal * 1000 END AS v, s_suppkey % 3 = 2 AND s_suppkey % 5 = 0 AS bad FROM supplier),
q AS (SELECT *, k % 11 = 0 OR ((bad OR v >= 8000000) AND NOT (k % 11 = 1 AND NOT bad)) AS quarantined FROM t)
SELECT concat('p', CAST(k AS STRING)) AS project_key, round(v, 2) AS indexed_tvl, CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END AS INT) AS n_packages,
  CASE WHEN v IS NULL OR k % 7 = 0 OR quarantined THEN 'incomplete' WHEN v >= 2000000 THEN 'qualifying' ELSE 'below' END AS status, CASE WHEN quarantined THEN 'anomalous_balance' ELSE 'included' END AS valuation FROM q"""


def pool_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pools of suppliers' projects: by key, by name, or only by what the pool says."""
    k = F.col("p_partkey")
    pools = _table(spark, sf_dir, "part").select(
        F.concat(F.lit("0x"), F.hex("p_partkey")).alias("pool_id"), F.when(k % 3 == 0, F.concat(F.lit("P"), (k % 400).cast("string"))).alias("projectId"),
        F.when(k % 3 == 1, F.concat(F.lit(" Name "), (k % 400).cast("string"))).when(k % 3 == 0, F.lit("Other")).alias("projectName"), "p_retailprice", (k % 2).alias("object_exists"),
    ).withColumnRenamed("p_retailprice", "liquidity_usd")
    projects = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("project_key"), F.concat(F.lit("name "), F.col("s_suppkey").cast("string")).alias("project_name"))
    placed = sui.pool_projects(pools, projects)
    known = sui.project_pools(projects.select("project_key"), placed)
    return known.select("project_key", F.round("verified_pool_tvl", 2).alias("verified_pool_tvl"), "pool_count", "verified_pool_count")


POOL_PROJECTS = """WITH p AS (SELECT concat('p', CAST(s_suppkey AS STRING)) AS project_key, s_suppkey FROM supplier),
l AS (SELECT p_retailprice AS v, p_partkey % 2 AS e, p_partkey % 400 AS k FROM part WHERE p_partkey % 3 IN (0, 1))
SELECT project_key, round(coalesce(sum(CASE WHEN e = 1 THEN v END), 0.0), 2) AS verified_pool_tvl, count(l.k) AS pool_count, count(*) FILTER (WHERE e = 1) AS verified_pool_count FROM p LEFT JOIN l ON l.k = p.s_suppkey GROUP BY project_key"""


def checkpoint_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of checkpoint ranges: pages of a user end by limits or at the bound."""
    e = _table(spark, sf_dir, "events").select((F.col("event_id") / 40).cast("bigint").alias("g"), "event_id", "user_id")
    at = F.col("event_id") % 40
    last = at % 10 == 9
    reason = F.when(last, F.when(at < 39, F.lit(1)).when(F.col("g") % 5 == 0, F.lit(2)).when(F.col("g") % 7 == 0, F.lit(None)).otherwise(F.lit(3)))
    frames = e.select(
        (F.col("g") * 40).alias("range_start"), (F.col("g") * 40 + 40).alias("range_end"), F.floor(at / 10).cast("int").alias("page"), (at % 10).cast("int").alias("frame"),
        F.col("event_id").cast("string").alias("digest"), F.when((F.col("g") % 11 == 0) & (at == 5), F.col("event_id") + 100).otherwise(F.col("event_id")).alias("checkpoint"),
        F.when((F.col("g") % 13 == 0) & (at < 20), F.lit("same")).otherwise(F.col("event_id").cast("string")).alias("cursor"), reason.cast("int").alias("end_reason"),
    )
    return sui.verify_checkpoints(frames)


CHECKPOINTS = """WITH g AS (SELECT CAST(floor(event_id / 40) AS BIGINT) AS g, max(event_id % 40) AS top FROM events GROUP BY 1),
s AS (SELECT g, g * 40 AS range_start, g * 40 + 40 AS range_end, CASE WHEN top < 39 THEN 'odd' WHEN g % 11 = 0 OR g % 13 = 0 OR (g % 7 = 0 AND g % 5 <> 0) THEN 'error' WHEN g % 5 = 0 THEN 'resume' ELSE 'verified' END AS state FROM g)
SELECT range_start, range_end, state, CASE WHEN state = 'resume' THEN CAST(range_start + 39 AS STRING) END AS resume_cursor FROM s"""


def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scraped metric lines of a host a user, and the wide sample of each."""
    e = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    n, v = F.col("n").cast("string"), F.round("v", 2).cast("string")
    lines = F.array(
        F.lit("# HELP node_load1 load"), F.concat(F.lit("node_load1 "), v), F.concat(F.lit('node_cpu_seconds_total{cpu="0",mode="idle"} '), n), F.concat(F.lit('node_cpu_seconds_total{cpu="1",mode="idle"} '), n),
        F.concat(F.lit('node_cpu_seconds_total{cpu="1",mode="user"} '), v), F.lit("node_memory_MemTotal_bytes 1000"), F.concat(F.lit("node_memory_MemAvailable_bytes "), n),
        F.lit('node_filesystem_size_bytes{mountpoint="/"} 200'), F.lit('node_filesystem_avail_bytes{mountpoint="/"} 50'), F.lit('node_filesystem_size_bytes{mountpoint="/b"} 100'), F.lit('node_filesystem_avail_bytes{mountpoint="/b"} 10'), F.lit("broken line x"),
    )
    out = telemetry.scrape_metrics(e.select("user_id", F.explode(lines).alias("value")), "value", ["user_id"])
    wide = telemetry.node_sample(out, ["user_id"])
    return wide.select("user_id", F.round("load1", 2).alias("load1"), "cpu_cores", F.round("cpu_idle", 2).alias("cpu_idle"), F.round("cpu_total", 2).alias("cpu_total"), F.round("ram_percent", 4).alias("ram_percent"), F.round("disk_free_percent", 4).alias("disk_free_percent"))


METRICS = """WITH e AS (SELECT user_id, round(sum(value), 2) AS v, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, v AS load1, 2 AS cpu_cores, CAST(2 * n AS DOUBLE) AS cpu_idle, round(2 * n + v, 2) AS cpu_total, round(100 * (1 - n / 1000), 4) AS ram_percent, CAST(10 AS DOUBLE) AS disk_free_percent FROM e"""


def decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys and prices as 32-byte words, names as text responses, some malformed."""
    k = F.col("o_orderkey")
    word = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_orderkey")), 64, "0"))
    broken = F.when(k % 9 == 0, F.substring(word, 1, 65)).when(k % 9 == 1, F.lit("0x")).otherwise(word)
    name = F.concat(F.lit("T"), k.cast("string"))
    fixed = F.concat(F.lit("0x"), F.rpad(F.hex(name), 64, "0"))
    dynamic = F.concat(F.lit("0x"), F.lpad(F.lit("20"), 64, "0"), F.lpad(F.hex(F.length(name).cast("bigint")), 64, "0"), F.rpad(F.hex(name), 64, "0"))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", S.abi_uint256(broken).alias("value"), S.abi_uint256_text(broken).alias("word"), S.abi_uint256_decimal(F.concat(F.lit("0xff"), F.substring(broken, 5, 62))).alias("amount"), S.hex_to_long(F.substring(broken, 1, 10)).alias("head"),
        S.abi_string(F.when(k % 2 == 0, fixed).otherwise(dynamic)).alias("name"), S.has_bytecode(F.when(k % 4 == 0, F.lit("0x0000")).when(k % 4 == 1, F.lit("0x6000")).when(k % 4 == 2, F.lit("0x600")).otherwise(F.lit("0x"))).alias("code"),
        S.topic_address(word).alias("address"), S.sui_id(F.hex("o_orderkey")).alias("sui"), S.coin_type(F.concat(F.lit("0x2::"), name, F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("::C")))).alias("coin"),
    )


DECODE = """WITH t AS (SELECT o_orderkey, lower(to_hex(CAST(o_orderkey AS BIGINT))) AS h, o_orderkey % 9 IN (0, 1) AS bad FROM orders)
SELECT o_orderkey, CASE WHEN NOT bad THEN CAST(o_orderkey AS DOUBLE) END AS value, CASE WHEN NOT bad THEN concat('0x', h) END AS word, CASE WHEN NOT bad THEN concat('115339776388732929035197660848497720713218148788040405586178452820', CAST(382218977280 + o_orderkey AS VARCHAR)) END AS amount, CAST(0 AS BIGINT) AS head,
  concat('T', CAST(o_orderkey AS STRING)) AS name, CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 0 END AS code, concat('0x', lpad(h, 40, '0')) AS address, concat('0x', lpad(h, 64, '0')) AS sui,
  CASE WHEN o_orderkey % 3 <> 0 THEN concat('0x', lpad('2', 64, '0'), '::T', CAST(o_orderkey AS STRING), '::C') END AS coin FROM t"""


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of orders' lines as provider messages: kinds of failures by status and text."""
    k = F.col("event_id")
    status = F.when(k % 10 == 0, 429).when(k % 10 == 1, 401).when(k % 10 == 2, 503).when(k % 10 == 3, 404).otherwise(200)
    body = F.when(k % 7 == 0, F.lit("Too Many Requests now")).when(k % 7 == 1, F.lit("query TIMED OUT")).when(k % 7 == 2, F.lit("Forbidden key")).otherwise(F.col("event_type"))
    e = _table(spark, sf_dir, "events").select(S.classify_error(status, body).alias("kind"), S.method_group(F.when(k % 3 == 0, F.lit("eth_getLogs")).otherwise(F.lit("other"))).alias("method_group"))
    return e.groupBy("kind", "method_group").agg(F.count("*").alias("n"))


CLASSIFY = """SELECT CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 THEN 'rate_limit' WHEN event_id % 10 = 1 OR event_id % 7 = 2 THEN 'auth' WHEN event_id % 7 = 1 THEN 'range' WHEN event_id % 10 IN (2, 3) THEN 'http' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'logs' ELSE 'head' END AS method_group, count(*) AS n FROM events GROUP BY 1, 2"""

QUERIES = {
    "shred_blocks": (shred_blocks, SHRED_BLOCKS),
    "sui_calls": (sui_calls, SUI_CALLS),
    "sui_projects": (sui_projects, SUI_PROJECTS),
    "pool_projects": (pool_projects, POOL_PROJECTS),
    "checkpoint_verify": (checkpoint_verify, CHECKPOINTS),
    "metrics_wide": (metrics_wide, METRICS),
    "decode_words": (decode_words, DECODE),
    "classify_errors": (classify_errors, CLASSIFY),
}
