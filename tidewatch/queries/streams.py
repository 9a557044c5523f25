"""Streaming forms, run over all events that are there; the SQL twin is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import tables
from tidewatch.plans.fixtures import sql, view
from tidewatch.queries import telemetry
from tidewatch.streaming import incidents, jobs, live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a stream takes a folder or a pattern; this pattern also fits one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.minute_counts(_events(spark, sf_dir), "ts", ["event_type"], "value", delay="40 days")
    rows = jobs.run_available(out, "minutes", ["minute", "event_type"], "update")
    return rows.select(F.unix_seconds("minute").alias("minute"), "event_type", "n", F.round("total", 6).alias("total"), F.round("longest", 6).alias("longest"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each type, once: digests over a horizon of 40 days."""
    rows = _events(spark, sf_dir).withColumn("digest", F.concat_ws(":", "user_id", "event_type"))
    out = jobs.dedupe_digests(rows, horizon="40 days").select("digest")
    return jobs.run_available(out, "digests", ["digest"], "append")


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error share of each user over sliding five minutes."""
    rows = _events(spark, sf_dir).withColumn("error_class", F.when(F.col("event_type") == "error", "rate_limit").otherwise("ok"))
    out = jobs.run_available(jobs.trailing_errors(rows, "ts", ["user_id"], delay="40 days"), "errors", ["at", "user_id"], "update")
    return out.groupBy("user_id").agg(F.count("*").alias("windows"), F.sum("errors").alias("errors"), F.max("rate").alias("worst"))


def _arriving(rows: DataFrame, folder: str, phases: int, run) -> None:
    """Land rows in phases of time and call run after each: every seventh row comes a phase late, every fifth comes again in the next.

    After the last phase a row of a far time lets the watermark pass all others.
    """
    ends = rows.agg(F.min("ts"), F.max("ts")).first()
    width = (ends[1] - ends[0]) / phases
    phase = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(ends[0]))) / (width.total_seconds() * 1e6)), F.lit(phases - 1))
    rows = rows.withColumn("phase", phase)
    for k in range(phases + 1):
        late = F.col("id") % 7 == 0
        now = rows.where((~late & (F.col("phase") == k)) | (late & (F.col("phase") == k - 1)) | ((F.col("id") % 5 == 0) & (F.col("phase") == k - 1))).drop("phase")
        if k == phases:
            now = now.unionByName(rows.limit(1).drop("phase").withColumn("key", F.lit("clock")).withColumn("ts", F.col("ts") + F.expr("interval 10 years")))
        now.repartition(3).write.mode("append").parquet(folder)
        run()


def _streamed_incidents(spark: SparkSession, sf_dir: str, rows, rule) -> DataFrame:
    """Incidents of rows that arrive late and repeatedly, by a stream that is stopped and started again between phases."""
    own = incidents.with_state_store(spark)
    rows = rows(own, sf_dir)
    folder = jobs.scratch(own, "incidents")
    stream = lambda: incidents.incident_stream(own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"), rule, "25 days")
    _arriving(rows, f"{folder}/in", 3, lambda: jobs.append_to(stream(), folder))
    return incidents.newest(spark.read.parquet(f"{folder}/rows")).where("key <> 'clock'")


def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CPU incidents of each host, from a stream."""
    rows = lambda s, d: view(s, d, "fx_resources").select(telemetry.host().alias("key"), "id", "ts", F.col("cpu_percent").cast("double").alias("value"))
    return _streamed_incidents(spark, sf_dir, rows, telemetry.RULE).withColumnRenamed("key", "host")


def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalled cursors, from a stream."""
    up = F.col("active_rpc") != "none"
    rows = lambda s, d: telemetry.still_samples(s, d).select(F.concat_ws("/", "chain", "role").alias("key"), "id", "ts", F.col("cursor_block").cast("double").alias("value"), F.col("safe_head").cast("double").alias("other"), up.alias("up"))
    out = _streamed_incidents(spark, sf_dir, rows, incidents.Stall())
    return out.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("chain"), F.split_part("key", F.lit("/"), F.lit(2)).alias("role"), "opened_at", "closed_at", "repeats")


def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error share and p95 of each user over sliding five minutes, windows closed by the watermark."""
    path = jobs.scratch(spark, "latency")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", F.when(F.col("event_type") == "error", "rate_limit").otherwise("ok").alias("error_class"))
    clock = rows.limit(1).select((F.col("ts") + F.expr("interval 10 years")).alias("ts"), F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), "value", "error_class")
    for part in (rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1"), clock):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        jobs.append_to(jobs.trailing_latency(stream, "ts", ["user_id"], "value", "40 days"), path)
    out = spark.read.parquet(f"{path}/rows").where("user_id is not null")
    return out.select(F.unix_seconds("at").alias("at"), "user_id", "n", "errors", F.round("rate", 9).alias("rate"), F.round("p95", 6).alias("p95"))


STREAM_LATENCY = """WITH w AS (SELECT user_id, date_trunc('minute', ts) + to_minutes(k.k) AS at_, event_type, value FROM events CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(1, 6)) k),
g AS (SELECT user_id, at_, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, list_sort(list(value)) AS v FROM w GROUP BY 1, 2),
x AS (SELECT *, v[CAST(ceil(n * CAST(0.95 AS DECIMAL(9, 6))) AS BIGINT)] AS exact FROM g)
SELECT CAST(epoch(at_) AS BIGINT) AS at, user_id, n, errors, round(errors / n, 9) AS rate, round(CASE WHEN exact <= 0 THEN 0 ELSE 2 * pow(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE), ceil(ln(exact) / ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE)))) / (CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE) + 1) END, 6) AS p95 FROM x"""


def live_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called contracts found by a stream of five days, all files of one a batch, stopped and started again after each, and how often each address was asked for."""
    path = jobs.scratch(spark, "live")
    tx = view(spark, sf_dir, "fx_tx").select("chain", "block_number", "tx_hash", "from_addr", "to_addr")
    width = tx.agg(F.floor(F.max("block_number") / 5) + 1).first()[0]
    day = F.floor(F.col("block_number") / width)
    tx = tx.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + day * 86400))
    code = view(spark, sf_dir, "fx_code").select("chain", "address", "has_code")
    known = lambda: view(spark, sf_dir, "fx_log_contracts").select("chain", "address").unionByName(code.where("address < '0x3'").select("chain", "address"))
    run = live.discovery_batches(f"{path}/tables", known, lambda asked: asked.join(code, ["chain", "address"], "left"))
    for k in range(5):
        tx.where(day == k).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(tx.schema).parquet(f"{path}/in")
        q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    t = tables.opened(spark, f"{path}/tables")
    found = t["discoveries"].select("chain", "address", "observed_block", "observed_tx")
    return found.join(t["asked"].select("chain", "address", "times", F.unix_seconds("last_at").alias("last_at")), ["chain", "address"], "full_outer")


LIVE_DISCOVERY = sql("fx_tx", "fx_code", "fx_log_contracts", body=""", w AS (SELECT floor(max(block_number) / 5) + 1 AS w FROM fx_tx),
c AS (SELECT chain, to_addr AS address, CAST(floor(block_number / (SELECT w FROM w)) AS BIGINT) AS day, block_number, tx_hash FROM fx_tx WHERE to_addr IS NOT NULL),
k AS (SELECT chain, address FROM fx_log_contracts UNION SELECT chain, address FROM fx_code WHERE address < '0x3'),
a AS (SELECT DISTINCT c.chain, c.address, c.day, k.address IS NOT NULL AS known, x.has_code FROM c LEFT JOIN k ON k.chain = c.chain AND k.address = c.address LEFT JOIN fx_code x ON x.chain = c.chain AND x.address = c.address),
r AS (SELECT *, day - row_number() OVER (PARTITION BY chain, address ORDER BY day) AS g FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY chain, address, g ORDER BY day) AS pos FROM r),
q AS (SELECT chain, address, count(*) AS times, CAST(1700000000 + max(day) * 86400 AS BIGINT) AS last_at FROM p WHERE NOT known AND (has_code IS NULL OR pos % 2 = 1) GROUP BY 1, 2),
f AS (SELECT c.chain, c.address, min(c.block_number) AS observed_block, arg_min(c.tx_hash, concat(lpad(CAST(c.block_number AS STRING), 12, '0'), c.tx_hash)) AS observed_tx FROM c JOIN (SELECT DISTINCT chain, address FROM a WHERE known OR has_code = 1) g ON g.chain = c.chain AND g.address = c.address GROUP BY 1, 2)
SELECT coalesce(f.chain, q.chain) AS chain, coalesce(f.address, q.address) AS address, observed_block, observed_tx, times, last_at FROM f FULL OUTER JOIN q ON q.chain = f.chain AND q.address = f.address""")

QUERIES = {
    "stream_latency": (stream_latency, STREAM_LATENCY),
    "live_discovery": (live_discovery, LIVE_DISCOVERY),
    "stream_incidents": (stream_incidents, telemetry.INCIDENTS),
    "stream_stalls": (stream_stalls, telemetry.STALL_INCIDENTS),
    "stream_minutes": (stream_minutes, "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, event_type, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS longest FROM events GROUP BY 1, 2"),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT concat_ws(':', CAST(user_id AS STRING), event_type) AS digest FROM events"),
    "stream_errors": (stream_errors, """WITH w AS (SELECT user_id, date_trunc('minute', ts) + to_minutes(k.k) AS at_, event_type FROM events CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(1, 6)) k),
g AS (SELECT user_id, at_, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM w GROUP BY 1, 2)
SELECT user_id, count(*) AS windows, CAST(sum(errors) AS BIGINT) AS errors, max(errors / n) AS worst FROM g GROUP BY user_id"""),
}
