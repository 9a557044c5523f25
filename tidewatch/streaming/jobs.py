"""Structured Streaming forms of discovery and telemetry."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import discovery, sinks


def dedupe_digests(stream: DataFrame, ts: str = "ts", digest: str = "digest", horizon: str = "30 days") -> DataFrame:
    """Each digest once within the horizon."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([digest])


def minute_counts(stream: DataFrame, ts: str, keys: list[str], value: str, delay: str = "2 minutes") -> DataFrame:
    """One-minute tumbling count, sum and maximum."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, "1 minute"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("longest"))
    return out.select(F.col("window.start").alias("minute"), *keys, "n", "total", "longest")


def trailing_errors(stream: DataFrame, ts: str, keys: list[str], delay: str = "2 minutes") -> DataFrame:
    """Error share over sliding five minutes."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, "5 minutes", "1 minute"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col("error_class") != "ok").alias("errors"))
    return out.select(F.col("window.end").alias("at"), *keys, "n", "errors", (F.col("errors") / F.col("n")).alias("rate"))


def latency_bucket(value: Column, error: float = 0.01) -> Column:
    """Number of the logarithmic bucket of a value: all values of a bucket are within `error` of its middle.  0 and less have one of their own, the least."""
    base = (1 + error) / (1 - error)
    return F.when(value > 0, F.ceil(F.log(value) / math.log(base)).cast("int")).when(value.isNotNull(), -(1 << 30))


def bucket_value(bucket: Column, error: float = 0.01) -> Column:
    """Middle of a bucket."""
    base = (1 + error) / (1 - error)
    return F.when(bucket == -(1 << 30), 0.0).otherwise(2 * F.pow(F.lit(base), bucket) / (base + 1))


def bucket_percentile(counts: Column, share: float, error: float = 0.01) -> Column:
    """Percentile by nearest rank of an array of (bucket, n), within `error` of the exact one, relatively; null for none."""
    rank = F.ceil(F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) * F.lit(share).cast("decimal(9,6)"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("at"))
    step = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.coalesce(s["at"], F.when(s["n"] + x["n"] >= rank, x["bucket"])).alias("at"))
    return bucket_value(F.aggregate(F.array_sort(counts), start, step, lambda s: s["at"]), error)


def trailing_latency(stream: DataFrame, ts: str, keys: list[str], value: str, delay: str = "2 minutes", error: float = 0.01, share: float = 0.95) -> DataFrame:
    """(at, keys, n, errors, rate, p95) over sliding five minutes, each window once, when the watermark has passed it.

    The sketch of a window is the counts of its logarithmic buckets, which add up over tasks and
    batches: state is a row a window, key and bucket, and a bucket is 2 % wide, so a key's values from
    a millisecond to a day are 900 rows at most.  p95 is within `error` (1 %) of the exact one.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    bucket = latency_bucket(F.col(value), error)
    counts = rows.groupBy(F.window(ts, "5 minutes", "1 minute").alias("w"), *keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("error_class") != "ok").alias("errors"))
    out = counts.groupBy("w", *keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n"))).alias("counts"))
    return out.select(F.col("w.end").alias("at"), *keys, "n", "errors", (F.col("errors") / F.col("n")).alias("rate"), bucket_percentile(F.col("counts"), share, error).alias("p95"))


def confirmed(blocks: DataFrame, heads: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Rows at or below head - confirmations of their chain; the unit is blocks, so no watermark expresses it."""
    limit = heads.join(confirmations, "chain").select("chain", (F.col("head") - F.col("confirmations")).alias("__limit"))
    return blocks.join(F.broadcast(limit), "chain").where(F.col("block_number") <= F.col("__limit")).drop("__limit")


def range_commits(path: str, receipts: Callable[[], DataFrame], commit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over transactions: blocks whose deployments all have receipts are committed, others wait.

    A block is passed to commit whole or not at all.  What waits is kept as a snapshot under path and
    comes again with the next batch.  commit must do nothing for a batch id that it has seen: after a
    crash between commit and the snapshot the same rows come again under the same id; a batch whose
    snapshot is written is over.  receipts is called anew for each batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = sinks.current(spark, path)
        if own is not None and int(own["version"]) >= batch_id:
            return
        waiting = sinks.read_snapshot(spark, path)
        rows = batch if waiting is None else waiting.unionByName(batch)
        open_ = discovery.missing_receipts(rows, receipts()).select("chain", "block_number").distinct()
        commit(rows.join(open_, ["chain", "block_number"], "left_anti"), batch_id)
        sinks.write_snapshot(rows.join(open_, ["chain", "block_number"], "left_semi"), path, str(batch_id))

    return run


def confirmed_commits(path: str, confirmations: DataFrame, commit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over blocks (chain, block_number, ...): each is committed when its chain's head is `confirmations` blocks ahead.

    confirmations: (chain, confirmations), a row a configured chain.  The head is the highest block seen
    so far, kept with the blocks that wait under path.  commit must do nothing for a batch id that it has
    seen, as for range_commits().
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = sinks.current(spark, path)
        if own is not None and int(own["version"]) >= batch_id:
            return
        waiting = sinks.read_snapshot(spark, path)
        # a waiting row of no block carries each chain's head, so that it is known without any waiting block
        rows = batch.withColumn("is_head", F.lit(False))
        rows = rows if waiting is None else waiting.unionByName(rows)
        heads = rows.groupBy("chain").agg(F.max("block_number").alias("head"))
        blocks = rows.where("not is_head")
        done = confirmed(blocks, heads, confirmations).drop("is_head")
        commit(done, batch_id)
        left = blocks.join(done.select("chain", "block_number").distinct(), ["chain", "block_number"], "left_anti")
        rest = [c for c in rows.columns if c not in ("chain", "block_number", "is_head")]
        marks = heads.select("chain", F.col("head").alias("block_number"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest), F.lit(True).alias("is_head"))
        sinks.write_snapshot(left.unionByName(marks.select(*left.columns)), path, str(batch_id))

    return run


def scratch(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidewatch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str) -> DataFrame:
    """rows written once into the scratch folder and read back: what follows from them doesn't work them out again."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def append_to(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over all that is there, into folder/rows; its state is in folder/state, so that a later run goes on from here.

    Each batch is a folder of its own, written anew when the batch is run again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/b={batch_id}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(stream: DataFrame, name: str, keys: list[str], mode: str) -> DataFrame:
    """Run a stream over all that is there and return its last rows a key."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    append_to(stream, folder, mode)
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch", "b")]
    if not rest:
        return rows.select(*keys).distinct()
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
