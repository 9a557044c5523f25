"""Sources and sinks: given tables written as landed extracts into the scratch folder and read back by each reader."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import merge, reports, schedule, sinks, sui
from tidewatch.plans.fixtures import sql, view
from tidewatch.sources import landed
from tidewatch.streaming import jobs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = f"{jobs.scratch(spark, name)}/rows"
    df.write.json(path)
    return path


def _counted(spark: SparkSession, name: str, extract: DataFrame, rows: Callable[[str], list[DataFrame]]) -> DataFrame:
    """What rows makes of an extract (few rows), which is landed as compressed JSON for it and removed behind it."""
    folder = jobs.scratch(spark, name)
    extract.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(f"{folder}/rows")
    out = jobs.landed(reduce(DataFrame.unionByName, rows(f"{folder}/rows")), f"{name}-counts")
    fs, hadoop = sinks._files(spark, folder)
    fs.delete(hadoop(folder), True)
    return out


def landed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, receipts, code, balances, prices, chains and seed tokens: rows of each reader and a sum over them.

    Extracts are landed one after the other, so that one of them is on disk at a time.
    """
    row = lambda name, df, c: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum(c).cast("bigint").alias("total"))
    out = []
    # transactions travel as bytes, half as many
    tx = view(spark, sf_dir, "fx_tx").select("chain", "block_number", F.struct(F.unhex("tx_hash").alias("h"), S.packed(F.col("to_addr")).alias("t"), S.packed(F.col("from_addr")).alias("f")).alias("x"))
    text = lambda x: F.struct(F.lower(F.hex(x["h"])).alias("hash"), S.unpacked(x["t"]).alias("to"), S.unpacked(x["f"]).alias("from"))
    blocks = tx.groupBy("chain", "block_number").agg(F.collect_list("x").alias("xs"))
    blocks = blocks.select("chain", F.concat(F.lit("0x"), F.lower(F.hex("block_number"))).alias("number"), F.transform("xs", text).alias("transactions"))
    out.append(_counted(spark, "blocks", blocks, lambda path: [row("blocks", landed.read_blocks(spark, path), F.size("transactions"))]))
    receipts = view(spark, sf_dir, "fx_receipts").select("tx_hash", F.col("contract_address").alias("contractAddress"))
    out.append(_counted(spark, "receipts", receipts, lambda path: [row("receipts", landed.read_receipts(spark, path), F.col("contract_address").isNotNull().cast("int"))]))
    code = view(spark, sf_dir, "fx_code").select("chain", "address", F.when(F.col("has_code") == 1, "0x6000").when(F.col("has_code") == 0, "0x").alias("code"), "checked_at")
    out.append(_counted(spark, "code", code, lambda path: [row("code", landed.read_code(spark, path), "has_code")]))
    b = view(spark, sf_dir, "fx_balances")
    word = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.substring_index("raw_amount", "000000", 1).try_cast("bigint"))), 64, "0"))
    balances = b.select("chain", "address", F.upper("token").alias("token"), F.when(F.col("token") < "0x1", F.lit("0x12")).otherwise(word).alias("raw"), F.when(F.col("raw_amount").isNull(), "timeout").alias("error"))

    def of_balances(path: str) -> list[DataFrame]:
        r = landed.read_balances(spark, path)
        return [row("balances", r, F.col("raw_amount").cast("bigint")), row("failed", r.where("error is not null"), (F.col("error") == "malformed").cast("int"))]

    out.append(_counted(spark, "balances", balances, of_balances))
    prices = view(spark, sf_dir, "fx_prices").select(F.concat("chain", F.lit(":"), "token").alias("price_key"), F.col("price").cast("double").alias("price"), "ts")
    out.append(_counted(spark, "prices", prices, lambda path: [row("prices", landed.read_prices(spark, path), "price")]))
    nations = _table(spark, sf_dir, "nation")
    chains = nations.select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("chain"), F.col("n_nationkey").cast("bigint").alias("chain_id"))
    accepted, rejected = landed.chain_dim(spark, _json(chains, spark, "chains"), spark.range(15).withColumnRenamed("id", "chain_id"))
    out += [row("chains", accepted, "chain_id"), row("rejected", rejected, "chain_id")]
    tokens = view(spark, sf_dir, "fx_tokens").select("chain", F.upper("token").alias("token"), "symbol", "decimals")
    known = accepted.select("chain").distinct().where("chain <> 'c1'")
    out.append(_counted(spark, "tokens", tokens, lambda path: [row("seeds", landed.token_seed(spark, path, known), "decimals")]))
    return reduce(DataFrame.unionByName, out)


LANDED_CHAIN = sql("fx_tx", "fx_receipts", "fx_code", "fx_balances", "fx_prices", "fx_tokens", body="""
SELECT 'blocks' AS source, (SELECT count(*) FROM (SELECT DISTINCT chain, block_number FROM fx_tx)) AS n, count(*) AS total FROM fx_tx
UNION ALL SELECT 'receipts', count(*), count(contract_address) FROM fx_receipts
UNION ALL SELECT 'code', count(*), CAST(sum(has_code) AS BIGINT) FROM fx_code
UNION ALL SELECT 'balances', count(*), CAST(sum(CASE WHEN token >= '0x1' THEN TRY_CAST(split_part(raw_amount, '000000', 1) AS BIGINT) END) AS BIGINT) FROM fx_balances
UNION ALL SELECT 'failed', count(*), CAST(coalesce(sum(CASE WHEN raw_amount IS NULL THEN 0 ELSE 1 END), 0) AS BIGINT) FROM fx_balances WHERE raw_amount IS NULL OR token < '0x1' OR split_part(raw_amount, '000000', 1) = ''
UNION ALL SELECT 'prices', count(*), CAST(floor(sum(CAST(price AS DOUBLE))) AS BIGINT) FROM fx_prices WHERE price > 0
UNION ALL SELECT 'chains', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_nationkey < 15
UNION ALL SELECT 'rejected', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_nationkey >= 15
UNION ALL SELECT 'seeds', count(*), CAST(sum(decimals) AS BIGINT) FROM fx_tokens WHERE chain <> 'c1' AND chain IN (SELECT concat('c', CAST(n_regionkey AS STRING)) FROM nation WHERE n_nationkey < 15)""")


def landed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in files by chain and bucket of blocks; a range of one chain opens its own buckets only."""
    path = f"{jobs.scratch(spark, 'logs')}/rows"
    rows = view(spark, sf_dir, "fx_logs")
    top = rows.agg(F.max("block_number").alias("m")).first().m or 0
    # a bucket of so many blocks that files grow with the table, not only their number
    bucket = max(100, top // 200 + 1)
    rows = rows.withColumn("block_bucket", F.floor(F.col("block_number") / bucket))
    rows.repartition("chain", "block_bucket").write.partitionBy("chain", "block_bucket").parquet(path)
    out = landed.read_logs(spark, path, "c2", top // 3, 2 * top // 3, bucket)
    return out.groupBy("topic0").agg(F.count("*").alias("n"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


LANDED_LOGS = sql("fx_logs", body=", m AS (SELECT max(block_number) AS m FROM fx_logs) SELECT topic0, count(*) AS n, min(block_number) AS first_block, max(block_number) AS last_block FROM fx_logs, m WHERE chain = 'c2' AND block_number BETWEEN CAST(floor(m / 3) AS BIGINT) AND CAST(floor(2 * m / 3) AS BIGINT) GROUP BY topic0")


def landed_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider answers by address; an address that names a chain twice has no parts."""
    t = _table(spark, sf_dir, "supplier")
    item = lambda k, v: F.struct(k.cast("string").alias("community_id"), v.cast("string").alias("usd_value"))
    k = F.col("s_suppkey")
    rows = t.select(F.concat(F.lit("a"), k.cast("string")).alias("address"), F.array(item(k % 5, F.col("s_acctbal")), item(F.when(k % 9 == 0, k % 5).otherwise((k + 1) % 5), F.lit(10)), item(F.lit("x"), F.lit(1))).alias("chain_list"))
    portfolio = landed.read_portfolio(spark, _json(rows, spark, "portfolio"))
    chains = spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chain"), F.col("id").alias("chain_id"))
    code = t.select(F.lit("c0").alias("chain"), F.concat(F.lit("a"), k.cast("string")).alias("address"), F.lit(1).alias("has_code"))
    parts, twice = landed.portfolio_parts(portfolio, chains, code)
    a = parts.groupBy("chain").agg(F.count("*").alias("n"), F.count("provider_usd").alias("valued"), F.count("has_code").alias("known"))
    return a.unionByName(twice.agg(F.lit("twice").alias("chain"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("valued"), F.lit(0).cast("bigint").alias("known")))


LANDED_PORTFOLIO = """WITH g AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 9 <> 0), c AS (SELECT range AS c FROM range(5))
SELECT concat('c', CAST(c AS STRING)) AS chain, count(*) AS n, count(*) FILTER (WHERE k % 5 = c OR (k + 1) % 5 = c) AS valued, CASE WHEN c = 0 THEN count(*) ELSE 0 END AS known FROM g, c GROUP BY c
UNION ALL SELECT 'twice', count(*), 0, 0 FROM supplier WHERE s_suppkey % 9 = 0"""


def landed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed transactions with packages, projects and pools of the object network, and frames of checkpoints."""
    row = lambda name, df, c: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total"))
    e, s, p = (_table(spark, sf_dir, x) for x in ("events", "supplier", "part"))
    tx = e.select(F.col("event_id").cast("string").alias("digest"), F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("txStatus"), F.col("event_id").alias("checkpoint"), F.array(F.struct(F.concat(F.lit("0x"), F.hex("user_id")).alias("packageId"), F.lit("n").alias("name"))).alias("packagesMetadata"))
    meta = sui.package_metadata(landed.read_sui_transactions(spark, _json(tx, spark, "suitx")))
    packages = s.select(F.concat(F.lit("0x"), F.hex("s_suppkey")).alias("packageId"), F.array(F.concat(F.lit("0x"), F.hex(F.col("s_suppkey") + 1)), F.concat(F.lit("0X"), F.hex("s_suppkey"))).alias("project_packages"), F.col("s_suppkey").alias("checkpoint"))
    lines = sui.lineage(landed.read_sui_packages(spark, _json(packages, spark, "suipackages"))).where("lineage like '0x%'")
    projects = s.select(F.col("s_name").alias("projectName"), F.col("s_acctbal").cast("string").alias("tvl"))
    r_projects = landed.read_sui_projects(spark, _json(projects, spark, "suiprojects"))
    pools = p.select(F.concat(F.lit("0x"), F.hex("p_partkey")).alias("poolAddress"), F.when(F.col("p_partkey") % 4 == 0, F.lit("bad!")).otherwise(F.concat(F.lit("0x"), F.hex("p_partkey"))).alias("poolId"), F.col("p_retailprice").alias("liquidity_usd"))
    r_pools = landed.read_sui_pools(spark, _json(pools, spark, "suipools"), 1000.0, 1_000_000)
    frames = e.select(F.lit(0).cast("bigint").alias("range_start"), F.col("event_id").alias("checkpoint"), F.col("user_id").cast("int").alias("page"))
    r_frames = landed.read_checkpoint_frames(spark, _json(frames, spark, "frames"))
    out = row("metadata", meta, "checkpoint")
    for x in (
        row("packages", lines, "checkpoint"), row("projects", r_projects, (F.col("tvl").cast("double") >= 0).cast("int")), row("pools", r_pools, F.lit(1)), row("frames", r_frames, "checkpoint"),
    ):
        out = out.unionByName(x)
    return out


LANDED_OBJECTS = """SELECT 'metadata' AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'packages', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL SELECT 'projects', count(*), CAST(sum(CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END) AS BIGINT) FROM supplier
UNION ALL SELECT 'pools', count(*), count(*) FROM part WHERE p_partkey % 4 <> 0 AND p_retailprice >= 1000 UNION ALL SELECT 'frames', count(*), CAST(sum(event_id) AS BIGINT) FROM events"""


def landed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as JSON, classified on reading; samples by day, of which only the last days are opened."""
    e = _table(spark, sf_dir, "events")
    k = F.col("event_id")
    attempts = e.select("ts", F.when(k % 2 == 0, "eth_getLogs").otherwise("other").alias("method"), F.when(k % 5 == 0, 429).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"), F.col("value").alias("ms"))
    a = landed.read_rpc_attempts(spark, _json(attempts, spark, "attempts")).groupBy(F.concat_ws("/", "error_class", "method_group").alias("what")).agg(F.count("*").alias("n"))
    path = jobs.scratch(spark, "samples")
    e.withColumn("day", F.to_date(F.col("ts").cast("timestamp"))).repartition("day").write.partitionBy("day").parquet(f"{path}/events")
    s = landed.read_samples(spark, path, "events", "2024-01-20").agg(F.lit("samples").alias("what"), F.count("*").alias("n"))
    text = f"{jobs.scratch(spark, 'metrics')}/rows"
    e.select(F.concat(F.lit("node_load1 "), F.col("event_id").cast("string"))).write.text(text)
    return a.unionByName(s).unionByName(landed.read_metrics(spark, text).agg(F.lit("metrics").alias("what"), F.count("*").alias("n")))


LANDED_ATTEMPTS = """SELECT concat(CASE WHEN event_id % 5 = 0 THEN 'rate_limit' ELSE 'ok' END, '/', CASE WHEN event_id % 2 = 0 THEN 'logs' ELSE 'head' END) AS what, count(*) AS n FROM events GROUP BY 1
UNION ALL SELECT 'samples', count(*) FROM events WHERE CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'metrics', count(*) FROM events"""


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by kind, written twice, a daily archive, and a snapshot that changes once."""
    scans = view(spark, sf_dir, "fx_scans")
    path = jobs.scratch(spark, "reports")
    for _ in range(2):
        for kind in ("qualifying", "below"):
            sinks.write_report(reports.select_report(scans, kind, 400_000.0).select("address", "total_usd"), kind, path, {"min_usd": "400000"})
    rows = spark.read.parquet(f"{path}/rows").groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    sinks.archive_daily(scans.select("id", "scanned_at"), "scanned_at", f"{path}/archive", "UTC")
    days = spark.read.parquet(f"{path}/archive").agg(F.lit("days").alias("what"), F.countDistinct("snapshot_day").alias("n"))
    latest = schedule.latest_by_id(scans).select("address", "total_usd")
    wrote = [sinks.write_if_changed(x, f"{path}/snapshot", str(k)) for k, x in enumerate((latest, latest, latest.where("address % 2 = 0")))]
    kept = sinks.read_snapshot(spark, f"{path}/snapshot").agg(F.lit("snapshot").alias("what"), (F.count("*") * F.lit(sum(wrote))).alias("n"))
    return rows.unionByName(days).unionByName(kept)


WRITTEN_REPORTS = sql("fx_scans", body=""", t AS (SELECT * FROM fx_scans QUALIFY row_number() OVER (PARTITION BY address ORDER BY scanned_at DESC, id DESC) = 1)
SELECT 'qualifying' AS what, count(*) AS n FROM t WHERE total_usd >= 400000 HAVING count(*) > 0 UNION ALL SELECT 'below', count(*) FROM t WHERE total_usd < 400000 AND status = 'below' HAVING count(*) > 0
UNION ALL SELECT 'days', count(DISTINCT CAST(scanned_at AS DATE)) FROM fx_scans UNION ALL SELECT 'snapshot', 2 * count(DISTINCT address) FROM fx_scans WHERE address % 2 = 0""")


def _streamed(spark: SparkSession, path: str, parts: list[DataFrame], run) -> None:
    """Land parts one after the other and stream each, all of its files as one batch; the stream stops and starts again in between."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code answers from a stream, merged into a snapshot; the second batch has newer answers for some addresses."""
    code = view(spark, sf_dir, "fx_code")
    path = jobs.scratch(spark, "upsert")
    second = code.where("chain >= 'c2'").withColumn("has_code", 1 - F.col("has_code"))
    _streamed(spark, path, [code.where("chain < 'c3'"), second], sinks.upsert_batches(f"{path}/table", merge.merge_code))
    return sinks.read_snapshot(spark, f"{path}/table").select("chain", "address", F.col("has_code").cast("int").alias("has_code"))


UPSERTED = sql("fx_code", body=" SELECT chain, address, CASE WHEN chain >= 'c2' THEN 1 - has_code ELSE has_code END AS has_code FROM fx_code")


def committed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from a stream of two batches: blocks without all receipts wait, and go through when the receipts are there."""
    tx = view(spark, sf_dir, "fx_tx").select("chain", "block_number", "tx_hash", "to_addr")
    path = jobs.scratch(spark, "commits")
    late: list[DataFrame] = [view(spark, sf_dir, "fx_receipts").select("tx_hash"), tx.select("tx_hash")]

    def commit(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/done/b={batch_id}")

    # the receipts are those that are there when a batch runs: some at first, then all
    run = jobs.range_commits(f"{path}/wait", lambda: late[0], commit)

    def batch(rows: DataFrame, batch_id: int) -> None:
        run(rows, batch_id)
        late[:] = late[-1:]

    _streamed(spark, path, [tx.where("block_number % 2 = 0"), tx.where("block_number % 2 = 1")], batch)
    done = spark.read.parquet(f"{path}/done")
    return done.groupBy("chain", F.col("b").cast("int").alias("batch")).agg(F.count("*").alias("n"), F.countDistinct("block_number").alias("blocks"))


COMMITTED = sql("fx_tx", "fx_receipts", body=""", w AS (SELECT DISTINCT chain, block_number FROM fx_tx t WHERE to_addr IS NULL AND NOT EXISTS (SELECT 1 FROM fx_receipts r WHERE r.tx_hash = t.tx_hash)),
b AS (SELECT t.chain, t.block_number, CAST(CASE WHEN t.block_number % 2 = 0 AND w.chain IS NULL THEN 0 ELSE 1 END AS INT) AS batch FROM fx_tx t LEFT JOIN w ON w.chain = t.chain AND w.block_number = t.block_number)
SELECT chain, batch, count(*) AS n, count(DISTINCT block_number) AS blocks FROM b GROUP BY 1, 2""")


def confirmed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks from a stream of three batches, passed on when the head of their chain is far enough ahead, by the confirmations that each chain asks for."""
    rows = view(spark, sf_dir, "fx_blocks").select("chain", F.col("number").alias("block_number"), "block_hash")
    path = jobs.scratch(spark, "confirmed")
    asks = rows.select("chain").distinct().withColumn("confirmations", F.substring("chain", 2, 1).cast("bigint") * 40)

    def commit(done: DataFrame, batch_id: int) -> None:
        done.write.mode("overwrite").parquet(f"{path}/done/b={batch_id}")

    third = rows.agg(F.floor(F.max("block_number") / 3) + 1).first()[0]
    parts = [rows.where(F.floor(F.col("block_number") / third) == k) for k in range(3)]
    _streamed(spark, path, parts, jobs.confirmed_commits(f"{path}/wait", asks, commit))
    return spark.read.parquet(f"{path}/done").select("chain", "block_number", "block_hash", F.col("b").cast("int").alias("batch"))


CONFIRMED = sql("fx_blocks", body=""", t AS (SELECT floor(max(number) / 3) + 1 AS w FROM fx_blocks), b AS (SELECT chain, number, block_hash, CAST(floor(number / (SELECT w FROM t)) AS INT) AS k, CAST(substr(chain, 2, 1) AS BIGINT) * 40 AS c FROM fx_blocks),
h AS (SELECT chain, k, max(max(number)) OVER (PARTITION BY chain ORDER BY k) - max(c) AS lim FROM b GROUP BY chain, k)
SELECT b.chain, number AS block_number, block_hash, min(h.k) AS batch FROM b JOIN h ON h.chain = b.chain AND h.k >= b.k AND b.number <= h.lim GROUP BY 1, 2, 3""")


def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects in answers of every shape that a provider gives: a bare list, lists under content, value and data, nested ones, none, an empty one, and broken text."""
    k = F.col("s_suppkey")
    one = lambda n: F.concat(F.lit('{"id":'), n.cast("string"), F.lit(',"'), F.when(k % 2 == 0, "tvl").otherwise("currTvl"), F.lit('":'), F.when(k % 5 == 0, F.lit('"n/a"')).otherwise((n * 3).cast("string")), F.lit("}"))
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    shapes = [
        text("[", one(k), ",7,null]"), text('{"content":[', one(k), "]}"), text('{"value":[', one(k), "]}"), text('{"data":[', one(k), "]}"), text('{"data":{"items":[', one(k), ",", one(k + 100_000), "]}}"),
        text('{"content":null,"value":{"content":[', one(k), "]}}"), text('{"x":', k.cast("string"), "}"), text('{"broken ', k.cast("string")), F.lit("[]"),
    ]
    payload = shapes[-1]
    for i, x in enumerate(shapes[:-1]):
        payload = F.when(k % 9 == i, x).otherwise(payload)
    path = f"{jobs.scratch(spark, 'answers')}/rows"
    _table(spark, sf_dir, "supplier").select(payload.alias("value")).write.text(path)
    rows = sui.result_items(landed.read_sui_raw(spark, path))
    item = F.col("item")
    return rows.select("error", F.when(F.col("error"), F.col("payload")).alias("answer"), sui.item_field(item, "id", kind="bigint").alias("id"), sui.item_field(item, "currTvl", "tvl", kind="double").alias("tvl"))


PROVIDER_ANSWERS = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 9 AS m FROM supplier), i AS (SELECT k, k AS id FROM s WHERE m < 6 UNION ALL SELECT k, k + 100000 FROM s WHERE m = 4)
SELECT false AS error, NULL AS answer, CAST(id AS BIGINT) AS id, CASE WHEN k % 5 <> 0 THEN CAST(id * 3 AS DOUBLE) END AS tvl FROM i
UNION ALL SELECT true, CASE WHEN m = 6 THEN concat('{"x":', CAST(k AS STRING), '}') ELSE concat('{"broken ', CAST(k AS STRING)) END, NULL, NULL FROM s WHERE m IN (6, 7)"""

QUERIES = {
    "provider_answers": (provider_answers, PROVIDER_ANSWERS),
    "landed_chain": (landed_chain, LANDED_CHAIN),
    "landed_logs": (landed_logs, LANDED_LOGS),
    "landed_portfolio": (landed_portfolio, LANDED_PORTFOLIO),
    "landed_objects": (landed_objects, LANDED_OBJECTS),
    "landed_attempts": (landed_attempts, LANDED_ATTEMPTS),
    "written_reports": (written_reports, WRITTEN_REPORTS),
    "upserted": (upserted, UPSERTED),
    "committed_ranges": (committed_ranges, COMMITTED),
    "confirmed_blocks": (confirmed_blocks, CONFIRMED),
}
