"""Telemetry: roll-ups, rates, percentiles, sustained thresholds, incidents and load states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidewatch.functions import scalars as S


def seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def minute_rollup(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum and maximum of value by minute and keys."""
    return df.groupBy(S.minute_bucket(F.col(ts)).alias("minute"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("longest"))


def slowest_stage(minutes: DataFrame, by: str = "chain", stage: str = "workload") -> DataFrame:
    """The stage of each chain with the longest mean time; ties go to the stage that is last by name."""
    means = minutes.groupBy(by, stage).agg((F.sum("total") / F.sum("n")).alias("mean_ms"))
    return means.groupBy(by).agg(F.max(F.struct("mean_ms", stage)).alias("m")).select(by, f"m.{stage}", "m.mean_ms")


def dominant_failure(attempts: DataFrame) -> DataFrame:
    """The most frequent failure of each chain, ok left out; ties to the smaller name."""
    n = attempts.where("error_class <> 'ok'").groupBy("chain", "workload", "endpoint", "error_class").agg(F.count("*").alias("n"))
    w = Window.partitionBy("chain").orderBy(F.desc("n"), "workload", "endpoint", "error_class")
    return n.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def latency(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, errors and interpolated percentiles of ms."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("error_class") != "ok").alias("errors"),
        F.percentile("ms", 0.5).alias("p50"),
        F.percentile("ms", 0.95).alias("p95"),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float = 0.95) -> DataFrame:
    """The value at index round((n - 1) * q), half to even, of the sorted values.

    Rows become counts by value first.  Counts by a coarse logarithmic scale, some thousand a key, find
    the step of the scale that holds the index, and only the values of that step are put in order.
    """
    v = F.col(value).cast("double")
    scale = F.when(v.isNull() | F.isnan(v), F.lit(None)).otherwise(F.signum(v) * F.floor(64 * F.log2(F.abs(v) + 1)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("__b", scale.cast("long"))
    coarse = counts.groupBy(*keys, "__b").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys)
    upto = F.sum("n").over(own.orderBy(F.col("__b").asc_nulls_last()))  # NaN is the greatest value
    index = F.bround((F.sum("n").over(own) - 1) * F.lit(q), 0)
    step = coarse.select(*keys, "__b", (index - (upto - F.col("n"))).alias("__i"), F.col("n").alias("__n")).where("__i >= 0 and __i < __n").drop("__n")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "__b")]
    fine = counts.alias("c").join(step.alias("s"), on).select(*(F.col(f"c.{k}").alias(k) for k in keys), F.col(f"c.{value}").alias("nearest"), F.col("c.n").alias("n"), "s.__i")
    before = F.sum("n").over(own.orderBy("nearest")) - F.col("n")
    return fine.withColumn("__before", before).where((F.col("__before") <= F.col("__i")) & (F.col("__i") < F.col("__before") + F.col("n"))).select(*keys, "nearest")


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.8, chunk_seconds: int = 3600) -> DataFrame:
    """keep * previous + (1 - keep) * value in order; the first value is the seed.

    A key's samples are folded in chunks (order begins with a timestamp or a number) to the factor and the
    sum by which a chunk changes the average, and these few are folded in turn.
    """
    chunk = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / chunk_seconds)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v"))))
    parts = df.groupBy(*keys, chunk.alias("__c")).agg(items.alias("xs"))
    parts = parts.select(*keys, F.struct("__c", F.get("xs", F.lit(0))["__v"].alias("first"), F.pow(F.lit(keep), F.size("xs")).alias("a"), F.aggregate("xs", F.lit(0.0), lambda s, x: s * keep + x["__v"] * (1 - keep)).alias("s")).alias("p"))
    folded = F.aggregate("ps", F.get("ps", F.lit(0))["first"], lambda y, p: y * p["a"] + p["s"])
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(*keys, folded.alias("ewma"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free sum of row hashes."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def invariant_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were lost or whose rows changed."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.xxhash64(*rest).alias("h0"))
    b = after.select(*keys, F.xxhash64(*rest).alias("h1"))
    out = a.join(b, keys, "left")
    return out.where(F.col("h1").isNull() | (F.col("h0") != F.col("h1"))).select(*keys, F.when(F.col("h1").isNull(), "lost").otherwise("changed").alias("change"))


def metric_stats(df: DataFrame, metrics: list[str], order: str = "id") -> DataFrame:
    """current, average, peak and p95 of each metric, a row a metric."""
    long = df.select(order, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(order, "x.*").where("value is not null")
    return long.groupBy("metric").agg(F.max_by("value", order).alias("current"), F.avg("value").alias("average"), F.max("value").alias("peak"), F.percentile("value", 0.95).alias("p95"))


def period_change(df: DataFrame, value: str, ts: str, cut: str) -> DataFrame:
    """Average before and from cut on, and their difference."""
    late = F.col(ts).cast("timestamp") >= F.lit(cut).cast("timestamp")
    out = df.agg(F.avg(F.when(~late, F.col(value))).alias("before"), F.avg(F.when(late, F.col(value))).alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


def counter_growth(df: DataFrame, keys: list[str], counters: list[str], order: str = "id", per_run: list[str] | None = None, run: str = "run_id") -> DataFrame:
    """Last minus first of each counter, never under 0; those per run begin anew with each, and count only where the first and the last sample are of one run."""
    grown = lambda c: F.greatest(F.max_by(c, order) - F.min_by(c, order), F.lit(0))
    same = (F.max_by(run, order) == F.min_by(run, order)) if per_run else None
    return df.groupBy(*keys).agg(*(grown(c).alias(c) for c in counters), *(F.when(same, grown(c)).alias(c) for c in per_run or []))


def pending_notifications(incidents: DataFrame) -> DataFrame:
    """Incidents (opened_at, closed_at, open_notified_at, recovery_notified_at) to tell of, and what: an open one that nobody was told of, or the end of one that somebody was."""
    tell = F.when(F.col("closed_at").isNull() & F.col("open_notified_at").isNull(), "open").when(F.col("closed_at").isNotNull() & F.col("open_notified_at").isNotNull() & F.col("recovery_notified_at").isNull(), "recovery")
    return incidents.withColumn("tell", tell).where("tell is not null")


def error_totals(samples: DataFrame, json_column: str = "errors_json") -> DataFrame:
    """Sum of each kind in JSON maps of errors."""
    m = F.from_json(json_column, "map<string,bigint>")
    return samples.select(F.explode(m).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def top_errors(samples: DataFrame, keys: list[str], json_column: str = "errors_json", most: int = 15) -> DataFrame:
    m = F.from_json(json_column, "map<string,bigint>")
    return samples.select(*keys, F.explode(m).alias("kind", "n")).groupBy(*keys, "kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *keys, "kind").limit(most)


def restart_delta(df: DataFrame, counter: str = "restart_count") -> DataFrame:
    return df.agg((F.max(counter) - F.min(counter)).alias("restarts"))


def error_rate(samples: DataFrame, keys: list[str], least: int = 50, above: float = 0.2) -> DataFrame:
    """Share of failed requests; an alert needs enough requests."""
    out = samples.groupBy(*keys).agg(F.sum("rpc_requests").alias("requests"), F.sum("rpc_errors").alias("errors"))
    return out.withColumn("rate", F.col("errors") / F.col("requests")).withColumn("alert", (F.col("requests") >= least) & (F.col("rate") > above))


def latest_samples(samples: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in samples.columns if c not in keys and c != "id"]
    out = samples.groupBy(*keys).agg(F.max(F.struct("id", *rest)).alias("r"))
    return out.select(*keys, *(F.col(f"r.{c}").alias(c) for c in ["id", *rest]))


def _before(df: DataFrame, keys: list[str], order: str, columns: list[str], chunk: int = 1 << 16) -> DataFrame:
    """df with __b, the columns of the row before by a numeric order, which is unique within keys; keys are not null.

    Rows are looked at in chunks of the order; the first of a chunk follows the last of the chunk
    before, which comes from one row a chunk.
    """
    own = [*keys, "__c"]
    rows = df.withColumn("__c", F.floor(F.col(order) / chunk))
    last = rows.groupBy(*own).agg(F.max_by(F.struct(*columns), order).alias("__l"))
    last = last.withColumn("__l", F.lag("__l").over(Window.partitionBy(*keys).orderBy("__c")))
    inside = F.lag(F.struct(*columns)).over(Window.partitionBy(*own).orderBy(order))
    return rows.withColumn("__b", inside).join(last, own).withColumn("__b", F.coalesce("__b", "__l")).drop("__l", "__c")


def rates(samples: DataFrame, keys: list[str], value: str, order: str = "id", per: float = 3600.0) -> DataFrame:
    """Change of a counter since the sample before, per hour, never under 0."""
    rows = _before(samples, keys, order, ["ts", value])
    gone = seconds("ts") - seconds("__b.ts")
    diff = F.col(value) - F.col(f"__b.{value}")
    return rows.withColumn("rate", F.when(gone > 0, F.greatest(F.lit(0.0), diff * per / gone))).drop("__b")


def busy_percent(samples: DataFrame, keys: list[str], total: str, idle: str, order: str = "id") -> DataFrame:
    """Share of time since the sample before that was not idle, between 0 and 100."""
    rows = _before(samples, keys, order, [total, idle])
    all_, rest = F.col(total) - F.col(f"__b.{total}"), F.col(idle) - F.col(f"__b.{idle}")
    return rows.withColumn("busy", F.when(all_ > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - rest / all_))))).drop("__b")


def stalls(samples: DataFrame, keys: list[str], cursor: str = "cursor_block", head: str = "safe_head", age: int = 900) -> DataFrame:
    """Latest sample against the last one that is at least `age` seconds older: cursor still, head ahead."""
    last = latest_samples(samples, keys).select(*keys, F.col("ts").alias("last_ts"), F.col(cursor).alias("last_cursor"), F.col(head).alias("last_head"), "active_rpc")
    rows = samples.select(*keys, "id", "ts", cursor, head).join(last, keys).where(seconds("last_ts") - seconds("ts") >= age)
    base = rows.groupBy(*keys).agg(F.max(F.struct("id", "ts", cursor, head)).alias("b"))
    out = last.join(base, keys, "left")
    still = (F.col("last_cursor") == F.col(f"b.{cursor}")) & (F.col("last_head") > F.col(f"b.{head}"))
    up = F.coalesce("active_rpc", F.lit("")).isin("", "none")
    return out.select(*keys, "last_cursor", F.col(f"b.{cursor}").alias("base_cursor"), (~up & F.coalesce(still, F.lit(False))).alias("stalled"))


def _frames(rows: DataFrame, keys: list[str], at: Column, window: int, **aggs: tuple[str, Column]) -> DataFrame:
    """rows with aggregates (min, max, sum or count of a column) over those of the last `window` of at, a whole number, up to each row and its peers.

    A sliding frame would add up all of its rows for each row, which with more samples a second grows with
    their square.  Here at is cut into blocks of a window: a frame is the end of one block and the beginning
    of the next, which two running passes add up, and no series lies in one task.
    """
    both = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0))}
    of = {n: getattr(F, kind) for n, (kind, _) in aggs.items()}
    own = rows.withColumn("__row", F.struct(*rows.columns)).withColumn("__pos", at).withColumns({f"__{n}": c for n, (_, c) in aggs.items()}).withColumn("__block", F.floor(F.col("__pos") / max(window, 1)).cast("bigint"))
    own = own.select(*keys, "__row", "__pos", "__block", *(f"__{n}" for n in aggs))
    begin = Window.partitionBy(*keys, "__block").orderBy("__pos").rangeBetween(Window.unboundedPreceding, 0)
    asked = own.select(*keys, "__row", (F.col("__pos") - window).alias("__pos"), (F.col("__block") - 1).alias("__block"), *(F.lit(None).cast(own.schema[f"__{n}"].dataType).alias(f"__{n}") for n in aggs), *(of[n](f"__{n}").over(begin).alias(f"__begin_{n}") for n in aggs))
    marks = own.withColumn("__row", F.lit(None).cast(own.schema["__row"].dataType))
    # with the latest first, rows of a place come before what asks for all from there on
    end = Window.partitionBy(*keys, "__block").orderBy(F.desc("__pos"), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = asked.unionByName(marks, allowMissingColumns=True).withColumns({f"__end_{n}": of[n](f"__{n}").over(end) for n in aggs}).where("__row is not null")
    ended = {n: F.when(F.col("__pos").isNotNull(), F.col(f"__end_{n}")) for n in aggs}
    return out.select("__row.*", *(both[kind](F.col(f"__begin_{n}"), ended[n]).alias(n) for n, (kind, _) in aggs.items()))


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _chunked(rows: DataFrame, window: int) -> DataFrame:
    """rows in chunks of a day (or a window, if that is longer), each with the window before it: __chunk, and __own for the chunk's own rows.

    Frames of `window` seconds within a chunk then hold the same rows as over the whole series, and no
    series lies in one task.
    """
    long = max(S.DAY, window)
    own = rows.withColumn("__own", F.lit(True)).withColumn("__chunk", F.floor(seconds("ts") / long))
    lead = own.where(seconds("ts") >= (F.col("__chunk") + 1) * long - window)
    return own.unionByName(lead.withColumn("__own", F.lit(False)).withColumn("__chunk", F.col("__chunk") + 1))


def _spans(rows: DataFrame, window: int, keys: list[str], known: Column, holds: Column) -> DataFrame:
    """rows with __first, the time of the first sample with known in the frame of the last `window` seconds, and __broke, when holds was last not true of one, up to each sample.

    A sliding frame would add up all of its rows for each row, which with more samples a second grows with
    their square.  So the start of each frame is a row of its own, and one pass backward finds the sample
    that follows it; keys are not null.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    payload = F.struct(*rows.columns)
    marks = rows.select(*keys, at.alias("__at"), at.alias("__pos"), F.lit(1).alias("__kind"), F.when(known, at).alias("__known"), F.when(known & ~F.coalesce(holds, F.lit(False)), at).alias("__no"), payload.alias("__row"))
    starts = marks.withColumns({"__pos": F.col("__at") - window * 1_000_000, "__kind": F.lit(0), "__known": F.lit(None).cast("bigint")}).where("__row is not null")
    ends = marks.withColumn("__row", F.lit(None).cast(marks.schema["__row"].dataType))
    # the last break up to a sample and its peers is known at its own place
    upto = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    starts = starts.withColumn("__broke", F.max("__no").over(upto))
    both = starts.unionByName(ends.withColumn("__broke", F.lit(None).cast("bigint")))
    back = Window.partitionBy(*keys).orderBy(F.desc("__pos"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__first", F.min("__known").over(back)).where("__kind = 0")
    return out.select("__row.*", F.when(F.col("__first") <= F.col("__at"), F.col("__first")).alias("__first"), F.when(F.col("__broke") >= F.col("__pos"), F.col("__broke")).alias("__broke"))


def sustained(df: DataFrame, value: Column, above: Column, window: int, least_span: int, keys: list[str] | None = None) -> DataFrame:
    """Whether at each sample all of the last `window` seconds lie above a limit and span long enough.

    Samples without a value don't count.  Frames run over midnight.
    """
    rows = _spans(_chunked(df.where(value.isNotNull()), window), window, [*(keys or []), "__chunk"], F.lit(True), value > above)
    span = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("__first")) / 1e6
    rows = rows.withColumn("span", span).withColumn("sustained", F.col("__broke").isNull() & (F.col("span") >= least_span))
    return rows.where("__own").drop("__first", "__broke", "__own", "__chunk")


def held(df: DataFrame, holds: Column, window: int, least_span: int, keys: list[str], name: str) -> DataFrame:
    """df with name: whether at each sample a condition held for all of the last `window` seconds, spanning long enough.

    Samples for which the condition is unknown don't count and are not held.  Frames run over midnight.
    """
    rows = _spans(_chunked(df, window), window, [*keys, "__chunk"], holds.isNotNull(), holds)
    span = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("__first")) / 1e6
    rows = rows.withColumn(name, F.coalesce(holds.isNotNull() & F.col("__broke").isNull() & (span >= least_span), F.lit(False)))
    return rows.where("__own").drop("__first", "__broke", "__own", "__chunk")


def stall_incidents(samples: DataFrame, keys: list[str], cursor: str = "cursor_block", head: str = "safe_head", age: int = 900, chunk_blocks: int = 1 << 16) -> DataFrame:
    """(keys, opened_at, closed_at, repeats): stalls of a cursor that never goes back within keys.

    A stall opens at the first sample whose cursor stands where it stood at the last sample at least
    `age` seconds before, while the head advanced and an endpoint is up.  Only progress of the cursor
    closes it: neither a lost endpoint nor a head that stands still does.  Samples of one cursor are an
    island, and the next island's first sample is the progress; islands are chained in chunks of blocks
    with one row of the first island a chunk, so no series lies in one task.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = [*keys, cursor]
    rows = samples.where(F.col(cursor).isNotNull()).withColumn("__at", at)
    w = Window.partitionBy(*own).orderBy("__at").rangeBetween(Window.unboundedPreceding, -age * 1_000_000)
    base = F.last(F.struct(head)).over(w)
    up = ~F.coalesce("active_rpc", F.lit("")).isin("", "none")
    rows = rows.withColumn("__stalled", F.coalesce(up & (F.col(head) > base[head]), F.lit(False)))
    islands = rows.groupBy(*own).agg(F.min("__at").alias("first"), F.min(F.when(F.col("__stalled"), F.col("__at"))).alias("opened_at"), F.count_if("__stalled").alias("repeats"))
    islands = islands.withColumn("__chunk", F.floor(F.col(cursor) / chunk_blocks))
    inside = islands.withColumn("__next", F.lead("first").over(Window.partitionBy(*keys, "__chunk").orderBy(cursor)))
    ends = islands.groupBy(*keys, "__chunk").agg(F.min_by("first", cursor).alias("__first"))
    ends = ends.withColumn("__later", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__chunk"))).drop("__first")
    out = inside.where("opened_at is not null").join(ends, [*keys, "__chunk"])
    return out.select(*keys, "opened_at", F.coalesce("__next", "__later").alias("closed_at"), "repeats")


def request_pressure(series: DataFrame, key: list[str]) -> DataFrame:
    """series (key, ts, rpc_attempts, rpc_errors, rpc_p95_ms) with pressure.

    Pressure begins when requests were bad (a fifth failed, or p95 of 15 s) for 120 seconds or severe
    (35 % failed) for 60, and ends after 600 healthy seconds (under a tenth failed, p95 under 8 s).
    Fewer than 50 attempts are neither.  Runs are islands of samples, and the last event decides.
    """
    enough, share = F.coalesce(F.col("rpc_attempts") >= 50, F.lit(False)), F.col("rpc_errors") / F.col("rpc_attempts")
    marks = {
        "bad": (enough & ((share >= 0.20) | (F.col("rpc_p95_ms") >= 15_000)), 120),
        "severe": (enough & (share >= 0.35), 60),
        "healthy": (enough & (share < 0.10) & (F.col("rpc_p95_ms") < 8_000), 600),
    }
    w = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = series
    for name, (holds, long) in marks.items():
        yes = F.coalesce(holds, F.lit(False))
        # samples that hold after the same break are one run
        rows = rows.withColumn("__run", F.coalesce(F.max(F.when(~yes, seconds("ts"))).over(w), F.lit(-1.0)))
        since = F.min(F.when(yes, seconds("ts"))).over(Window.partitionBy(*key, "__run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(f"__{name}", F.when(yes & (seconds("ts") - since >= long), 1).otherwise(0)).drop("__run")
    event = F.when((F.col("__bad") == 1) | (F.col("__severe") == 1), True).when(F.col("__healthy") == 1, False)
    return rows.withColumn("pressure", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))).drop(*(f"__{m}" for m in marks))


def outages(samples: DataFrame, keys: list[str], window: int = 120, least_span: int = 100) -> DataFrame:
    """At each sample: two or more without any endpoint within the window, and long enough apart."""
    rows = _frames(samples.where("active_rpc = 'none'"), keys, _micros(), window * 1_000_000, n=("count", F.lit(1)), __first=("min", _micros()))
    span = seconds("ts") - F.col("__first") / 1e6
    return rows.withColumn("outage", (F.col("n") >= 2) & (span >= least_span)).drop("__first")


def counter_stall(samples: DataFrame, keys: list[str], counter: str, pending: str, window: int = 600, least_span: int = 540) -> DataFrame:
    """Whether at each sample a counter stood still for all of the last `window` seconds, spanning long enough, while work waited."""
    rows = _frames(samples, keys, _micros(), window * 1_000_000, __first=("min", _micros()), __least=("min", F.col(counter)), __most=("max", F.col(counter)), __waits=("max", F.col(pending)))
    span = seconds("ts") - F.col("__first") / 1e6
    rows = rows.withColumn("stalled", (F.col("__least") == F.col("__most")) & (F.col("__waits") > 0) & (span >= least_span))
    return rows.drop("__first", "__least", "__most", "__waits")


def growth_alert(samples: DataFrame, keys: list[str], value: str, size: str, window: int = 600, floor: int = 1 << 30) -> DataFrame:
    """Whether at each sample a value is over a floor, its size and twice what it was first in the last `window` seconds; of first samples of one time the least counts."""
    rows = _frames(samples, keys, _micros(), window * 1_000_000, __n=("count", F.lit(1)), __first=("min", F.struct(_micros().alias("at"), F.col(value).alias("value"))))
    grown = (F.col("__n") >= 2) & (F.col(value) > floor) & (F.col(value) > F.greatest(2 * F.col("__first.value"), F.col(size)))
    return rows.withColumn("runaway", grown).drop("__n", "__first")


def rate_budget(attempts: DataFrame, total: int, per_chain: int, window: int = 60) -> DataFrame:
    """Requests of the last minute at each attempt, over all chains and on its own, against their budgets.

    Times are summed to one row a second and chain first.
    """
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = attempts.groupBy(sec.alias("s"), "chain").agg(F.count("*").alias("n"))
    own = _frames(counts, ["chain"], F.col("s"), window - 1, chain_used=("sum", F.col("n")))
    used = _frames(counts.groupBy("s").agg(F.sum("n").alias("n")), [], F.col("s"), window - 1, used=("sum", F.col("n"))).select("s", "used")
    return own.join(used, "s").withColumn("over", (F.col("used") > total) | (F.col("chain_used") > per_chain))


def incidents(df: DataFrame, key: list[str], open_if: Column, close_if: Column, order: list[str], chunk_seconds: int = S.DAY) -> DataFrame:
    """Intervals (key, opened_at, closed_at, repeats) of an incident that opens and closes by two conditions; order begins with ts, keys are not null.

    The first close after an opening ends it, and only then can it open again: between one close and
    the next only the first opening counts, so windows express the fold.  Closes are counted in chunks
    of time, on top of those of the chunks before (one row a chunk): an incident over midnight is one.
    """
    own = [*key, "__chunk"]
    rows = df.withColumn("__c", F.coalesce(close_if, F.lit(False)).cast("int")).withColumn("__o", (F.coalesce(open_if, F.lit(False)) & (F.col("__c") == 0)).cast("int")).where("__c + __o > 0")
    rows = rows.withColumn("__chunk", F.floor(seconds("ts") / chunk_seconds))
    closes = rows.groupBy(*own).agg(F.sum("__c").alias("__n"))
    c = Window.partitionBy(*key).orderBy("__chunk") if key else Window.partitionBy(F.lit(0)).orderBy("__chunk")
    closes = closes.withColumn("__past", F.coalesce(F.sum("__n").over(c.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    before = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(closes, own).withColumn("__epoch", F.col("__past") + F.coalesce(F.sum("__c").over(before), F.lit(0)))
    out = rows.groupBy(*key, "__epoch").agg(
        F.min(F.when(F.col("__o") == 1, F.col("ts"))).alias("opened_at"),
        F.max(F.when(F.col("__c") == 1, F.col("ts"))).alias("closed_at"),
        F.sum("__o").alias("repeats"),
    )
    return out.where("opened_at is not null").drop("__epoch")


def load_states(series: DataFrame, key: list[str], base_live: int = 6, base_backfill: int = 3, allow_balance_only: bool = True) -> DataFrame:
    """(key, ts, state, live, backfill) of a load governor: normal, drain or balance_only, as a fold over each key's samples.

    series: (key, ts, pending, oldest_sec, wait_sec), and for request pressure rpc_attempts, rpc_errors
    and rpc_p95_ms.  Heavier states hold at once; lighter ones after 600 healthy seconds.  live and
    backfill are how many slots each may use.  A key is one fleet and a bounded time, such as a day: its
    samples are read once, in order, by one task.
    """
    pressed = request_pressure(series, key) if "rpc_attempts" in series.columns else series.withColumn("pressure", F.lit(False))
    rows = pressed.select(*key, F.col("ts").cast("timestamp").alias("ts"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("pending", "oldest_sec", "wait_sec")), "pressure")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "pending", "oldest_sec", "wait_sec"], kind="stable")
        state, since, out = "normal", None, []
        for t, pending, oldest, wait, pressure in zip(group["t"], group["pending"], group["oldest_sec"], group["wait_sec"], group["pressure"]):
            critical = allow_balance_only and (pending >= 20_000 or oldest >= 21_600)
            drain = pending >= 5_000 or oldest >= 3_600 or wait >= 30 or pressure
            if state == "balance_only":
                better = not critical and pending < 5_000 and oldest < 3_600
            else:
                better = state == "drain" and not critical and not drain and pending < 2_000 and oldest < 1_800 and wait < 15
            since = (t if since is None else since) if better else None
            ripe = since is not None and t - since >= 600
            if critical:
                state = "balance_only"
            elif state == "balance_only":
                state = "drain" if ripe else state
            elif drain:
                state = "drain"
            elif state == "drain":
                state = "normal" if ripe else state
            since = None if ripe else since
            out.append(state)
        return group[[*key, "ts", "pressure"]].assign(state=out)

    schema = StructType([*(rows.schema[k] for k in key), rows.schema["ts"], StructField("pressure", BooleanType()), StructField("state", StringType())])
    folded = rows.groupBy(*key).applyInPandas(fold, schema)
    drained = F.when(F.lit(allow_balance_only) | F.col("pressure"), 0).otherwise(min(base_backfill, 1))
    slots = lambda normal, drain: F.when(F.col("state") == "balance_only", 0).when(F.col("state") == "drain", drain).otherwise(normal)
    return folded.select(*key, "ts", "state", slots(base_live, F.lit(min(base_live, 3))).alias("live"), slots(base_backfill, drained).alias("backfill"))


def scrape_metrics(lines: DataFrame, column: str = "value", keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, labels, value) of lines of scraped metrics; comments and bad lines are left out."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    c = F.col(column)
    body = F.regexp_extract(c, pattern, 2)
    # values can hold commas; of a label that comes twice the first value counts
    pair = F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"')
    names, values = F.regexp_extract_all(body, pair, 1), F.regexp_extract_all(body, pair, 2)
    once = F.array_distinct(names)
    labels = F.when(body != "", F.map_from_arrays(once, F.transform(once, lambda k: F.get(values, (F.array_position(names, k) - 1).cast("int")))))
    out = lines.where(~c.startswith("#")).select(*(keys or []), F.regexp_extract(c, pattern, 1).alias("metric"), labels.alias("labels"), F.regexp_extract(c, pattern, 3).try_cast("double").alias("number"))
    return out.where("metric <> '' and number is not null").withColumnRenamed("number", "value")


def node_sample(metrics: DataFrame, key: list[str]) -> DataFrame:
    """Wide resource sample from node metrics: load, cores, idle and total CPU seconds, memory and free disk shares."""
    m, label = F.col("metric"), lambda k: F.try_element_at("labels", F.lit(k))
    of = lambda name: F.max(F.when(m == name, F.col("value")))
    cpu = m == "node_cpu_seconds_total"
    disk = metrics.where(m.isin("node_filesystem_avail_bytes", "node_filesystem_size_bytes")).groupBy(*key, label("mountpoint").alias("mount")).agg(of("node_filesystem_avail_bytes").alias("a"), of("node_filesystem_size_bytes").alias("s"))
    free = disk.where("s > 0").groupBy(*key).agg(F.min(100 * F.col("a") / F.col("s")).alias("disk_free_percent"))
    out = metrics.groupBy(*key).agg(
        of("node_load1").alias("load1"),
        F.count_distinct(F.when(cpu, label("cpu"))).alias("cpu_cores"),
        F.sum(F.when(cpu & (label("mode") == "idle"), F.col("value"))).alias("cpu_idle"),
        F.sum(F.when(cpu, F.col("value"))).alias("cpu_total"),
        (100 * (1 - of("node_memory_MemAvailable_bytes") / of("node_memory_MemTotal_bytes"))).alias("ram_percent"),
    )
    return out.join(free, key, "left")
