"""Discovery of called contracts from a stream of transactions, with answers about code that expire.

Each batch looks at the contracts known by then, asks for the code of called addresses that are neither
known nor answered within the time to live, and commits what it found together with the answers and
the questions as one version of several tables.  Answers older than that are dropped with the commit:
the state is as large as the answers of one such time, not as the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import discovery, merge, tables

KEYS = ["chain", "address"]
EMPTY = {
    "discoveries": "chain string, address string, source string, observed_block bigint, observed_tx string, actor string, canonical int",
    "code": "chain string, address string, has_code int, checked_at timestamp",
    "asked": "chain string, address string, times bigint, last_at timestamp",
}


def discovery_batches(
    path: str, contracts: Callable[[], DataFrame], answers: Callable[[DataFrame], DataFrame], ttl_seconds: int = 86400, ts: str = "ts"
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over transactions (chain, block_number, tx_hash, from_addr, to_addr, ts).

    contracts() gives the known contracts and is called anew for each batch; answers(asked) gives
    (chain, address, has_code) for the addresses asked, null where there is no answer: such an address
    is asked again by the next batch that calls it.  A batch's time is its latest ts, so that a batch
    that is run again gives what it gave.  A batch is committed once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = batch.agg(F.max(F.col(ts).cast("timestamp")).cast("string")).first()[0]
        if at is None:
            return
        now = F.lit(at).cast("timestamp")

        def step(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
            had = {name: old[name] if name in old else spark.createDataFrame([], kind) for name, kind in EMPTY.items()}
            calls, known = discovery.first_calls(batch), contracts()
            fresh = discovery.fresh_code(had["code"], at, ttl_seconds)
            asked = discovery.unknown_targets(calls, known, fresh).select(*KEYS)
            got = answers(asked).where("has_code is not null").select(*KEYS, F.col("has_code").cast("int").alias("has_code"), now.alias("checked_at"))
            code = fresh.select(*KEYS, "has_code", "checked_at").unionByName(got)
            found = discovery.active_contracts(calls, known, code).withColumn("source", F.lit("active_call")).withColumn("canonical", F.lit(1))
            times = had["asked"].unionByName(asked.select(*KEYS, F.lit(1).cast("bigint").alias("times"), now.alias("last_at")))
            return {
                "discoveries": merge.merge_discoveries(had["discoveries"], found.select(*had["discoveries"].columns)),
                "code": code,
                "asked": times.groupBy(*KEYS).agg(F.sum("times").alias("times"), F.max("last_at").alias("last_at")),
            }

        tables.change(spark, path, step, "live", str(batch_id))

    return run
