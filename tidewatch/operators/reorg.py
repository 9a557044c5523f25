"""Reorganised blocks: conflicts, common ancestors, orphaned provenance, gaps and verified prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import tables


def hash_conflicts(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Blocks whose stored hash differs from what is seen now."""
    o = observed.select("chain", "number", F.col("block_hash").alias("observed_hash"))
    return stored.join(o, ["chain", "number"]).where(F.lower("block_hash") != F.lower("observed_hash")).select("chain", "number", "block_hash", "observed_hash")


def parent_conflicts(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash is not the hash of the block before; a missing predecessor is no conflict."""
    before = blocks.select("chain", (F.col("number") + 1).alias("number"), F.col("block_hash").alias("previous_hash"))
    return blocks.join(before, ["chain", "number"]).where("parent_hash != previous_hash").select("chain", "number", "parent_hash", "previous_hash")


def common_ancestor(conflicts: DataFrame, stored: DataFrame, canonical: DataFrame, depth: int = 64) -> DataFrame:
    """For each conflict the nearest lower block whose stored hash is still canonical, within depth blocks.

    The walk down ends at the first block that is not stored: then there is no ancestor.
    """
    c = conflicts.select("chain", F.col("number").alias("conflict"))
    s = stored.select("chain", "number", F.lower("block_hash").alias("stored_hash"))
    o = canonical.select("chain", "number", F.lower("block_hash").alias("now_hash"))
    # a conflict looks at `depth` numbers: these are made first, so that the join is on equality
    lower = c.withColumn("number", F.explode(F.sequence(F.greatest(F.col("conflict") - depth, F.lit(0)), F.greatest(F.col("conflict") - 1, F.lit(0))))).where("number < conflict")
    rows = lower.join(s, ["chain", "number"], "left").join(o, ["chain", "number"], "left")
    out = rows.groupBy("chain", "conflict").agg(
        F.max(F.when(F.col("stored_hash") == F.col("now_hash"), F.col("number"))).alias("match"),
        F.max(F.when(F.col("stored_hash").isNull(), F.col("number"))).alias("hole"),
    )
    ancestor = F.when(F.col("match").isNotNull() & (F.col("hole").isNull() | (F.col("hole") < F.col("match"))), F.col("match"))
    return c.join(out, ["chain", "conflict"], "left").select("chain", "conflict", ancestor.alias("ancestor"))


def orphaned(provenance: DataFrame, intervals: DataFrame, block: str = "block_number", bucket: int = 1024) -> DataFrame:
    """provenance inside an interval (ancestor, end] of its chain; both sides meet in buckets of blocks."""
    i = intervals.select("chain", "ancestor", F.col("end").alias("end_block")).withColumn("__b", F.explode(F.sequence(F.floor((F.col("ancestor") + 1) / bucket), F.floor(F.col("end_block") / bucket))))
    p = provenance.withColumn("__b", F.floor(F.col(block) / bucket))
    return p.join(i, ["chain", "__b"]).where((F.col(block) > F.col("ancestor")) & (F.col(block) <= F.col("end_block"))).drop("__b")


def dimension(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast if it has at most `most` rows, which is counted first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quarantine(contracts: DataFrame, discoveries: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts, discoveries) after blocks of intervals (chain, ancestor, end) were orphaned.

    Discoveries inside an interval become non-canonical, never deleted.  A contract does when it has
    non-canonical discoveries and no canonical one; a creation of it above the ancestor is then unknown
    again.  Other contracts, also those without any discovery, stay as they are.
    """
    keys = ["chain", "address", "source"]
    hit = orphaned(discoveries, intervals, "observed_block").select(*keys).distinct().withColumn("__hit", F.lit(True))
    d = discoveries.join(hit, keys, "left").withColumn("canonical", F.when(F.col("__hit"), 0).otherwise(F.col("canonical"))).drop("__hit")
    alive = d.groupBy("chain", "address").agg(F.max("canonical").alias("__alive"))
    cuts = intervals.groupBy("chain").agg(F.min("ancestor").alias("__ancestor"))
    c = contracts.join(alive, ["chain", "address"], "left").join(dimension(cuts), "chain", "left")
    dead = F.coalesce((F.col("__alive") == 0) & F.col("__ancestor").isNotNull(), F.lit(False))
    new = {"canonical": F.when(dead, 0).otherwise(F.col("canonical"))}
    if "created_block" in contracts.columns:
        forget = dead & F.coalesce(F.col("created_block") > F.col("__ancestor"), F.lit(False))
        new |= {x: F.when(~forget, F.col(x)) for x in ("created_block", "created_tx", "creator") if x in contracts.columns}
    return c.withColumns(new).select(*contracts.columns), d


def replay_interval(conflicts: DataFrame, hashes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(chain, ancestor, end): one interval a chain to take back and read again, from conflicts (chain, ancestor, conflict).

    It ends at the highest stored block; chains that are being replayed already, conflicts without an
    ancestor and ancestors that aren't below their conflict are left out.
    """
    good = conflicts.where("ancestor is not null and ancestor < conflict").groupBy("chain").agg(F.min("ancestor").alias("ancestor"), F.max("conflict").alias("conflict"))
    busy = gaps.where("reason = 'reorg_replay' and status = 'active'").select("chain").distinct()
    top = hashes.groupBy("chain").agg(F.max("number").alias("top"))
    rows = good.join(busy, "chain", "left_anti").join(top, "chain", "left")
    return rows.select("chain", "ancestor", F.greatest("conflict", "top").alias("end"))


def corrected(t: dict[str, DataFrame], conflicts: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """All tables that a reorganisation touches, as they are once its replay has begun.

    t: discoveries, contracts, pending (addresses that wait for a first scan), hashes, code, links,
    tasks, states, cursors, gaps.  Discoveries and links that began inside the interval are no longer
    canonical; hashes and code answers above the ancestor go; of contracts whose links were taken back
    the histories are read again from the ancestor on and the states are of unknown history and due
    now, others stay; halted cursors and gaps wait for the replay, which is a gap of its own.
    """
    cut = dimension(replay_interval(conflicts, t["hashes"], t["gaps"]).select("chain", F.col("ancestor").alias("__a"), F.col("end").alias("__e")))
    now, out = F.lit(as_of).cast("timestamp"), {}
    known = F.col("__a").isNotNull()
    intervals = cut.select("chain", F.col("__a").alias("ancestor"), F.col("__e").alias("end"))
    out["contracts"], out["discoveries"] = quarantine(t["contracts"], t["discoveries"], intervals)
    canonical = out["contracts"].where("canonical = 1").select(F.lower("address").alias("address")).distinct()
    out["pending"] = t["pending"].join(canonical, "address", "left_semi")
    above = lambda name, block: t[name].join(cut, "chain", "left").where(~known | F.coalesce(F.col(block) <= F.col("__a"), F.lit(True))).select(*t[name].columns)
    out["hashes"], out["code"] = above("hashes", "number"), above("code", "checked_block")
    inside = known & (F.col("first_block") > F.col("__a")) & (F.col("first_block") <= F.col("__e"))
    links = t["links"].join(cut, "chain", "left").withColumn("__hit", F.coalesce(inside, F.lit(False)))
    out["links"] = links.withColumn("canonical", F.when(F.col("__hit"), 0).otherwise(F.col("canonical"))).select(*t["links"].columns)
    touched = links.where("__hit").groupBy("chain", F.col("contract").alias("address")).agg((F.min("__a") + 1).alias("__from"))
    tasks, hit = t["tasks"].join(touched, ["chain", "address"], "left"), F.col("__from").isNotNull()
    out["tasks"] = tasks.withColumns({
        "historical_cursor": F.when(hit, F.least(F.coalesce("historical_cursor", "next_block"), "__from")).otherwise(F.col("historical_cursor")),
        "next_block": F.when(hit, F.least("next_block", "__from")).otherwise(F.col("next_block")),
        "history_due_at": F.when(hit, now).otherwise(F.col("history_due_at")),
        "completed_at": F.when(~hit, F.col("completed_at")),
    }).select(*t["tasks"].columns)
    states = t["states"].join(touched, ["chain", "address"], "left")
    due = F.when(F.col("next_retry_at").isNotNull(), F.least("next_retry_at", now))
    out["states"] = states.withColumns({"coverage": F.when(hit, "history_unknown").otherwise(F.col("coverage")), "next_retry_at": F.when(hit, due).otherwise(F.col("next_retry_at"))}).select(*t["states"].columns)
    waits = F.when(known & (F.col("status") == "reorg_alert"), "reorg_replay").otherwise(F.col("status"))
    for name in ("cursors", "gaps"):
        out[name] = t[name].join(cut, "chain", "left").withColumn("status", waits).select(*t[name].columns)
    fresh = cut.select("chain", (F.col("__a") + 1).alias("start_block"), F.col("__e").alias("end_block"), (F.col("__a") + 1).alias("next_block"), F.lit("active").alias("status"), F.lit("reorg_replay").alias("reason"))
    out["gaps"] = out["gaps"].unionByName(fresh.select(*t["gaps"].columns))
    return out


def begin_replay(spark: SparkSession, path: str, conflicts: DataFrame, as_of: str) -> tables.Version:
    """Correct all tables under path and publish them together: a reader sees none or all of it."""
    return tables.change(spark, path, lambda t: corrected(t, conflicts, as_of))


def finished(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cursors and gaps of chains whose replays are complete, active again."""
    r = t["gaps"].where("reason = 'reorg_replay'").groupBy("chain").agg(F.min((F.col("status") == "complete").cast("int")).alias("__done"))
    back = F.when((F.col("__done") == 1) & (F.col("status") == "reorg_replay"), "active").otherwise(F.col("status"))
    return {name: t[name].join(dimension(r), "chain", "left").withColumn("status", back).select(*t[name].columns) for name in ("cursors", "gaps")}


def replay_ranges(conflicts: DataFrame, tips: DataFrame) -> DataFrame:
    """Ranges to read again: from the ancestor to the tip; without an ancestor a person must look."""
    rows = conflicts.join(tips, "chain")
    return rows.select("chain", (F.col("ancestor") + 1).alias("start_block"), F.col("tip").alias("end_block"), F.when(F.col("ancestor").isNull(), "reorg_alert").otherwise("reorg_replay").alias("status"))


def finish_replay(gaps: DataFrame) -> DataFrame:
    done = (F.col("status") == "reorg_replay") & (F.col("next_block") > F.col("end_block"))
    return gaps.withColumn("status", F.when(done, "active").otherwise(F.col("status")))


def missing_ranges(present: DataFrame, key: str = "chain", number: str = "number", bucket: int = 1 << 16) -> DataFrame:
    """Maximal runs of missing numbers between the least and the greatest of each key.

    Runs are found within buckets of numbers; between buckets they follow from the ends of each.
    """
    rows = present.select(key, number).distinct().withColumn("__b", F.floor(F.col(number) / bucket))
    inside = rows.select(key, F.col(number).alias("__last"), F.lead(number).over(Window.partitionBy(key, "__b").orderBy(number)).alias("__next"))
    ends = rows.groupBy(key, "__b").agg(F.min(number).alias("__first"), F.max(number).alias("__last"))
    between = ends.select(key, "__last", F.lead("__first").over(Window.partitionBy(key).orderBy("__b")).alias("__next"))
    gaps = inside.unionByName(between).where(F.col("__next") > F.col("__last") + 1)
    return gaps.select(key, (F.col("__last") + 1).alias("start_block"), (F.col("__next") - 1).alias("end_block"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Per chain: open gaps, blocks left in them, alerts, the lowest next block."""
    is_open = F.col("status") != "complete"
    return gaps.groupBy("chain").agg(
        F.count_if(is_open).alias("open_gaps"),
        F.coalesce(F.sum(F.when(is_open, F.col("end_block") - F.col("next_block") + 1)), F.lit(0)).alias("remaining_blocks"),
        F.count_if(F.col("status") == "reorg_alert").alias("alerts"),
        F.min(F.when(is_open, F.col("next_block"))).alias("oldest_next"),
    )


def verified_prefix(present: DataFrame, key: str = "chain", number: str = "number") -> DataFrame:
    """Per key the first number, from the least one on, that is missing: all before it are verified."""
    ends = present.groupBy(key).agg(F.min(number).alias("first"), F.max(number).alias("last"))
    hole = missing_ranges(present, key, number).groupBy(key).agg(F.min("start_block").alias("hole"))
    return ends.join(hole, key, "left").select(key, "first", F.coalesce("hole", F.col("last") + 1).alias("verified_next"))


def rebuilt_discoveries(discoveries: DataFrame, contracts: DataFrame) -> DataFrame:
    """Discoveries that contracts imply and the table lacks."""
    made = contracts.where("created_block is not null").select("chain", "address", F.lit("direct_deploy").alias("source"), F.col("created_block").alias("observed_block"))
    return made.join(discoveries.select("chain", "address", "source"), ["chain", "address", "source"], "left_anti")
