"""Which addresses, chains and contracts are due for work, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import ranks

NEVER = "9999-12-31 00:00:00"


def latest_by_time(scans: DataFrame) -> DataFrame:
    """The scan of each address that is last by time, then by id."""
    rest = [c for c in scans.columns if c not in ("address", "scanned_at", "id")]
    out = scans.groupBy("address").agg(F.max(F.struct("scanned_at", "id", *rest)).alias("r"))
    return out.select("address", *(F.col(f"r.{c}").alias(c) for c in ("scanned_at", "id", *rest))).select(*scans.columns)


def latest_by_id(scans: DataFrame) -> DataFrame:
    """The scan of each address with the greatest id; counts use this rule, reports the other one."""
    rest = [c for c in scans.columns if c not in ("address", "id")]
    out = scans.groupBy("address").agg(F.max(F.struct("id", *rest)).alias("r"))
    return out.select("address", *(F.col(f"r.{c}").alias(c) for c in ("id", *rest))).select(*scans.columns)


def recheck_at(scans: DataFrame, threshold: float) -> DataFrame:
    """When each latest scan is due again, by the table of delays."""
    status = F.when(F.col("status") == "incomplete", "partial").otherwise("complete")
    delay = S.retry_delay(status, F.lit(1), F.col("total_usd"), threshold, F.lit(1))
    return scans.withColumn("delay_seconds", delay.cast("long")).withColumn("due_at", F.timestamp_seconds(F.unix_seconds(F.col("scanned_at").cast("timestamp")) + F.col("delay_seconds")))


def capped_addresses(scans: DataFrame, most: int = 3) -> DataFrame:
    return scans.groupBy("address").agg(F.count("*").alias("scans")).where(F.col("scans") >= most)


def apply_cap(state: DataFrame, capped: DataFrame) -> DataFrame:
    """Capped addresses are never due again."""
    out = state.join(capped.select("address").withColumn("__cap", F.lit(True)), "address", "left")
    due = F.when(F.col("__cap"), F.lit(NEVER).cast("timestamp")).otherwise(F.col("due_at"))
    return out.withColumn("due_at", due).withColumn("work", F.when(F.col("__cap"), "capped").otherwise("open")).drop("__cap")


def pending_tiers(new: DataFrame, valued: DataFrame, due: DataFrame, limit: int) -> DataFrame:
    """New addresses, then valuable ones that are due, then others that are due; the first tier of each counts.

    Each side: (address, due_at).  Within a tier the oldest comes first, ties to the smaller address.
    """
    tiers = [d.select("address", "due_at").withColumn("tier", F.lit(k)) for k, d in enumerate((new, valued, due), 1)]
    rows = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    best = rows.groupBy("address").agg(F.min(F.struct("tier", "due_at")).alias("b"))
    return best.select("address", "b.tier", "b.due_at").orderBy("tier", "due_at", "address").limit(limit)


def due_chains(matrix: DataFrame, as_of: str) -> DataFrame:
    """Chains of an address that are due; a chain without state is."""
    return matrix.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(as_of).cast("timestamp")))


#: Lanes of the work on token histories and their orders, by whose turn it is.
RECENT_FIRST = ("recent", "high_value", "retry", "historical")
HISTORY_FIRST = ("historical", "high_value", "recent", "retry")


def log_lanes(tasks: DataFrame, hidden: DataFrame, as_of: str, prefer_history: bool = False, allow_history: bool = True) -> DataFrame:
    """A row a task and lane in which it is due, with lane, lane_rank, work and the columns of its order.

    tasks: (chain, address, priority, recent_due_at, recent_failures, recent_updated_at, history_due_at,
    history_failures, history_updated_at, completed_at, updated_at).  Each of the two clocks makes a task
    due on its own, and a null one never; tasks of hidden contracts (not canonical) are left out.
    Without allow_history the lanes of old blocks rest.  work says which of its clocks a task runs by.
    """
    now = F.lit(as_of).cast("timestamp")
    recent = F.coalesce(F.col("recent_due_at") <= now, F.lit(False))
    past = F.coalesce(F.col("history_due_at") <= now, F.lit(False)) & F.col("completed_at").isNull()
    calm, tried = F.col("history_failures") == 0, F.col("recent_failures") > 0
    in_lane = {
        "recent": recent & ~tried, "high_value": past & calm & (F.col("priority") >= 50),
        "retry": (recent & tried) | (past & ~calm), "historical": past & calm & (F.col("priority") < 50),
    }
    order = [x for x in (HISTORY_FIRST if prefer_history else RECENT_FIRST) if allow_history or x not in ("high_value", "historical")]
    rows = tasks.join(hidden.select("chain", "address"), ["chain", "address"], "left_anti")
    found = F.filter(F.array(*(F.when(in_lane[x], F.lit(x)) for x in order)), lambda x: x.isNotNull())
    rows = rows.withColumn("lane", F.explode(found)).withColumn("lane_rank", F.array_position(F.array(*map(F.lit, order)), F.col("lane")).cast("int"))
    lane = F.col("lane")
    work = F.when(lane == "recent", "recent").when((lane == "retry") & tried & recent, "recent").otherwise("history")
    weight = F.when(lane == "historical", 0).otherwise(-F.col("priority"))
    first = F.when(lane == "recent", F.col("recent_due_at")).when(lane == "retry", F.col("updated_at")).otherwise(F.col("history_due_at"))
    second = F.when(lane == "recent", F.col("recent_updated_at")).when(lane != "retry", F.col("history_updated_at"))
    return rows.withColumns({"work": work, "__weight": weight, "__first": first, "__second": second})


def rank_log_work(tasks: DataFrame, hidden: DataFrame, as_of: str, prefer_history: bool = False, allow_history: bool = True) -> DataFrame:
    """log_lanes() with the place of each task in its lane: by priority, when it was due and when it was last looked at; ties by chain and address."""
    rows = log_lanes(tasks, hidden, as_of, prefer_history, allow_history)
    order = [F.col(c) for c in ("__weight", "__first", "__second", "chain", "address")]
    return ranks.places(rows, ["lane"], order).drop("__weight", "__first", "__second")


def next_log_task(tasks: DataFrame, hidden: DataFrame, as_of: str, prefer_history: bool = False, allow_history: bool = True) -> DataFrame:
    """The one task to do next: the first of the first lane that has any; a top of one, not a sort."""
    rows = log_lanes(tasks, hidden, as_of, prefer_history, allow_history)
    return rows.orderBy("lane_rank", "__weight", F.col("__first").asc_nulls_first(), F.col("__second").asc_nulls_first(), "chain", "address").limit(1).drop("__weight", "__first", "__second")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int, tasks: int | None = None) -> DataFrame:
    """The first rows of each key with their place; with tasks, keys are dealt to so many, so that one task's rows needn't grow with df."""
    df = df.repartition(tasks, *keys) if tasks else df
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def next_gap(gaps: DataFrame) -> DataFrame:
    """The gap of each chain to work on: replays first, then the lowest start."""
    replay = (F.col("status") == "reorg_replay").desc()
    return first_per_key(gaps.where("status in ('active', 'reorg_replay')"), ["chain"], [replay, F.col("start_block")], 1).drop("place")


def price_retries(state: DataFrame, limit: int) -> DataFrame:
    return state.where("status = 'price_missing'").orderBy("due_at", "address").limit(limit)


def estimate_candidates(latest: DataFrame, estimates: DataFrame, as_of: str, min_age_seconds: int) -> DataFrame:
    """Latest scans that are incomplete, old enough and without a newer estimate."""
    old = latest.where((F.col("status") == "incomplete") & (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("scanned_at").cast("timestamp")) >= min_age_seconds))
    e = estimates.groupBy("address").agg(F.max("estimated_at").alias("estimated_at"))
    return old.join(e, "address", "left").where(F.col("estimated_at").isNull() | (F.col("estimated_at") < F.col("scanned_at")))


def network_order(chains: DataFrame) -> DataFrame:
    """Chains waiting for 30 s or longer first, in their order of waiting, then those with the largest lag."""
    starved = F.col("wait_seconds") >= 30
    return chains.withColumn("starved", starved).orderBy(starved.desc(), F.when(starved, F.col("wait_seconds")).desc_nulls_last(), F.col("lag_blocks").desc(), "chain")


def failure_streaks(attempts: DataFrame, keys: list[str], failed: Column, order: list[str], chunk_seconds: int = 3600) -> DataFrame:
    """attempts with the number of failures in a row up to each one; keys are not null, and order begins with a timestamp or a number.

    Streaks are counted in chunks of it.  What runs into a chunk from those before comes from one row
    a chunk, and is added to the attempts before its first success.
    """
    own = [*keys, "__chunk"]
    rows = attempts.withColumn("__chunk", F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / chunk_seconds)).withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int"))
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__island", F.sum(1 - F.col("__f")).over(w))
    streak = F.sum("__f").over(Window.partitionBy(*own, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("streak", streak)
    # a chunk's last streak; where all of it failed, that of the chunk before goes on
    ends = rows.groupBy(*own).agg(F.max("__island").alias("islands"), F.max_by("streak", F.struct(*order)).alias("last"))
    c = Window.partitionBy(*keys).orderBy("__chunk")
    ends = ends.withColumn("__run", F.sum((F.col("islands") > 0).cast("int")).over(c.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*keys, "__run").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.withColumn("__sum", F.sum("last").over(r)).withColumn("__carry", F.coalesce(F.lag("__sum").over(c), F.lit(0))).select(*own, "__carry")
    out = rows.join(carry, own).withColumn("streak", F.when(F.col("__island") == 0, F.col("streak") + F.col("__carry")).otherwise(F.col("streak")))
    return out.drop("__chunk", "__f", "__island", "__carry")


def pull_forward(state: DataFrame, totals: DataFrame, as_of: str, min_usd: float = 150_000, within: int = 3 * S.DAY) -> DataFrame:
    """Healthy chains of valuable addresses are due after `within` seconds at the latest."""
    rich = totals.where(F.col("total_usd") >= min_usd).select("address").withColumn("__rich", F.lit(True))
    limit = F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) + within)
    out = state.join(rich, "address", "left")
    healthy = F.col("__rich") & F.col("status").isin("complete", "absent")
    return out.withColumn("due_at", F.when(healthy, F.least("due_at", limit)).otherwise(F.col("due_at"))).drop("__rich")


def raised(tasks: DataFrame, states: DataFrame, totals: DataFrame, capped: DataFrame, as_of: str, min_usd: float) -> tuple[DataFrame, DataFrame]:
    """(tasks, states) after addresses were found to be worth totals (address, total_usd); capped addresses are left alone.

    Healthy chains with code and value are due after the delay of that worth at the latest.  Histories of
    addresses worth 150,000 and more, whose recent blocks are read, get at least priority 50 and are due now.
    """
    worth = totals.join(capped.select("address"), "address", "left_anti").select("address", F.col("total_usd").alias("__usd"))
    now = F.lit(as_of).cast("timestamp")
    t = tasks.join(worth, "address", "left")
    up = F.coalesce((F.col("__usd") >= 150_000) & F.col("recent_complete") & (F.col("priority") < 50), F.lit(False))
    t = t.withColumns({"priority": F.when(up, 50).otherwise(F.col("priority")), "history_due_at": F.when(up & (F.col("history_due_at") > now), now).otherwise(F.col("history_due_at"))}).select(*tasks.columns)
    s = states.join(worth, "address", "left")
    delay = S.retry_delay(F.lit("complete"), F.lit(1), F.col("__usd"), min_usd, F.lit(0)).cast("long")
    limit = F.timestamp_seconds(F.unix_seconds(now) + delay)
    healthy = F.coalesce(F.col("__usd").isNotNull() & (F.col("has_code") == 1) & (F.col("status") == "complete") & (F.col("total_usd") > 0), F.lit(False))
    s = s.withColumn("next_retry_at", F.when(healthy & (F.col("next_retry_at") > limit), limit).otherwise(F.col("next_retry_at"))).select(*states.columns)
    return t, s
