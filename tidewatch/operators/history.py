"""Token histories of contracts: where they start, how far they were read, and what that proves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import intervals


def history_start(discoveries: DataFrame) -> DataFrame:
    """(chain, address, start_block, history_limited): the earliest block that any source names.

    A history is limited unless a direct deployment is known: before a first call there may be more.
    """
    rows = discoveries.where("observed_block is not null").groupBy("chain", "address").agg(F.min("observed_block").alias("start_block"), F.max((F.col("source") == "direct_deploy").cast("int")).alias("deployed"))
    return rows.select("chain", "address", "start_block", (F.col("deployed") == 0).alias("history_limited"))


def merge_history(tasks: DataFrame, starts: DataFrame) -> DataFrame:
    """Tasks (chain, address, start_block, next_block, history_limited, completed) with new starts merged in.

    An earlier start begins the task anew; a known deployment lifts the limit for good; contracts
    without a task get one.
    """
    n = starts.select("chain", "address", F.col("start_block").alias("new_start"), F.col("history_limited").alias("new_limited"))
    both = tasks.join(n, ["chain", "address"], "full_outer")
    reset = F.col("start_block").isNull() | F.coalesce(F.col("new_start") < F.col("start_block"), F.lit(False))
    return both.select(
        "chain", "address", F.least("start_block", "new_start").alias("start_block"), F.when(reset, F.col("new_start")).otherwise(F.col("next_block")).alias("next_block"),
        (F.coalesce("history_limited", F.lit(True)) & F.coalesce("new_limited", F.lit(True))).alias("history_limited"), (~reset & F.coalesce("completed", F.lit(False))).alias("completed"),
    )


def covered_to(tasks: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("chain", "address"), bucket: int = 1 << 10) -> DataFrame:
    """tasks with next_block: the first block from start_block on that no scanned range (keys, from_block, to_block) covers.

    Ranges of a key hold for all of its tasks.  They are made maximal first, and a task meets only those
    of its start's bucket, so tasks that share many ranges are not multiplied by them.
    """
    own = list(keys)
    whole = intervals.union(ranges.select(*own, F.col("from_block").alias("start_block"), F.col("to_block").alias("end_block")), None, own)
    pieces = whole.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_block") / bucket), F.floor(F.col("end_block") / bucket))))
    pieces = pieces.select(*own, "__b", F.col("start_block").alias("__from"), F.col("end_block").alias("__to"))
    rows = tasks.withColumn("__b", F.floor(F.col("start_block") / bucket)).alias("t")
    on = [F.col(f"t.{k}") == F.col(f"p.{k}") for k in (*own, "__b")] + [F.col("t.start_block").between(F.col("p.__from"), F.col("p.__to"))]
    return rows.join(pieces.alias("p"), on, "left").select(*(F.col(f"t.{c}").alias(c) for c in tasks.columns), F.coalesce(F.col("p.__to") + 1, F.col("t.start_block")).alias("next_block"))


def promoted(tasks: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """tasks (with next_block, history_limited, recent_from) with coverage: what their reads prove.

    verified: read from the start to the head, nothing before it unknown.  history_unknown: read, or its
    last `window` blocks read, but the start is only where the contract was first seen.  recent_only: the
    last `window` blocks of a known history were read.  historical_pending: not even these.
    """
    rows = tasks.join(heads.select("chain", "head"), "chain", "left")
    done = F.coalesce(F.col("next_block") > F.col("head"), F.lit(False))
    recent = F.coalesce(F.col("recent_from") <= F.col("head") - window + 1, F.lit(False))
    state = F.when(done & ~F.col("history_limited"), "verified").when((done | recent) & F.col("history_limited"), "history_unknown").when(recent, "recent_only").otherwise("historical_pending")
    return rows.withColumn("coverage", state).drop("head")


def merge_coverage(state: DataFrame, coverage: DataFrame, fresh_links: DataFrame, as_of: str) -> DataFrame:
    """Chain states (chain, address, coverage, next_retry_at) with what new reads prove.

    A verified state is never taken back, and a read that proves nothing (historical_pending) changes
    nothing.  A chain whose read found a new token link is due at once, and not verified by that read:
    its balances have to be read first.
    """
    keys = ["chain", "address"]
    new = coverage.select(*keys, F.col("coverage").alias("__new"))
    linked = fresh_links.select("chain", F.col("contract").alias("address")).distinct().withColumn("__due", F.lit(True))
    rows = state.join(new, keys, "left").join(linked, keys, "left")
    due = F.coalesce("__due", F.lit(False))
    keep = F.col("__new").isNull() | (F.col("coverage") == "verified") | ((F.col("__new") == "historical_pending") & F.col("coverage").isNotNull()) | (due & (F.col("__new") == "verified"))
    out = rows.withColumn("coverage", F.when(F.coalesce(keep, F.lit(False)), F.col("coverage")).otherwise(F.col("__new")))
    return out.withColumn("next_retry_at", F.when(due, F.lit(as_of).cast("timestamp")).otherwise(F.col("next_retry_at"))).drop("__new", "__due")
