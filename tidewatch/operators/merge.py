"""Keyed snapshot merge with a policy a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("first", "last", "min", "max", "coalesce_new", "coalesce_old", "min_strict", "max_strict")


def _merged(name: str, policy: str) -> Column:
    old, new = F.col(f"o.{name}"), F.col(f"n.{name}")
    both = F.col("o.__in").isNotNull() & F.col("n.__in").isNotNull()
    if policy == "first":
        return F.when(F.col("o.__in").isNotNull(), old).otherwise(new)
    if policy == "last":
        return F.when(F.col("n.__in").isNotNull(), new).otherwise(old)
    if policy == "min":
        return F.least(old, new)
    if policy == "max":
        return F.greatest(old, new)
    if policy == "coalesce_new":
        return F.coalesce(new, old)
    if policy == "coalesce_old":
        return F.coalesce(old, new)
    if policy in ("min_strict", "max_strict"):  # null if either side of a match is null
        pick = F.least(old, new) if policy == "min_strict" else F.greatest(old, new)
        return F.when(both, F.when(old.isNotNull() & new.isNotNull(), pick)).otherwise(F.coalesce(new, old))
    raise ValueError(f"no such policy: {policy}")


def latest(delta: DataFrame, keys: list[str], sequence: list[str], newest: bool = True) -> DataFrame:
    """One row a key: the newest (or oldest) by sequence, whose columns must end in a unique one."""
    rest = [c for c in delta.columns if c not in keys and c not in sequence]
    pick = (F.max if newest else F.min)(F.struct(*sequence, *rest)).alias("r")
    return delta.groupBy(*keys).agg(pick).select(*keys, *(F.col(f"r.{c}").alias(c) for c in [*sequence, *rest])).select(*delta.columns)


def merge(target: DataFrame, delta: DataFrame, keys: list[str], policy: dict[str, str], default: str = "last") -> DataFrame:
    """target with delta merged in; each side has one row a key.  Columns not in policy follow default.

    The result is a new snapshot: nothing is written over what is being read.
    """
    old, new = target.withColumn("__in", F.lit(True)).alias("o"), delta.withColumn("__in", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.join(new, on, "full_outer")
    cols = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    return both.select(*cols, *(_merged(c, policy.get(c, default)).alias(c) for c in target.columns if c not in keys))


def earliest(target: DataFrame, delta: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Union of both sides, the earliest row of each key by the columns by; they end in a unique one."""
    return latest(target.unionByName(delta), keys, by, newest=False)


def merge_contracts(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Contracts keep the earliest creation with its transaction and creator, and are canonical again.

    A creation whose block is not known comes last: it never takes the place of a known one.
    """
    known = lambda df: df.drop("canonical").withColumn("__unknown", F.col("created_block").isNull())
    rows = earliest(known(target), known(delta), ["chain", "address"], ["__unknown", "created_block", "created_tx"])
    return rows.drop("__unknown").withColumn("canonical", F.lit(1))


def fill_contracts(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Contracts of a pass over a closed range: the first known creation stays, and all are canonical again."""
    return merge(target, delta, ["chain", "address"], {c: "coalesce_old" for c in ("created_block", "created_tx", "creator")}).withColumn("canonical", F.lit(1))


def merge_discoveries(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Discoveries (chain, address, source, observed_block, ..., canonical) with new ones.

    A new observation replaces a stored one only where its block is known and the stored one is not
    canonical or later; it is then canonical.  An unknown block never takes the place of another row,
    and a stored canonical row without a block stays.  Of several new rows of a key the earliest known
    block counts.
    """
    keys = ["chain", "address", "source"]
    rest = [c for c in target.columns if c not in keys]
    own = delta.withColumn("canonical", F.lit(1).cast(target.schema["canonical"].dataType)).withColumn("__unknown", F.col("observed_block").isNull())
    new = latest(own, keys, ["__unknown", "observed_block"], newest=False).withColumn("__in", F.lit(True)).alias("n")
    old = target.withColumn("__in", F.lit(True)).alias("o")
    both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    later = (F.col("o.canonical") == 0) | (F.col("o.observed_block") > F.col("n.observed_block"))
    take = F.col("o.__in").isNull() | F.coalesce(F.col("n.observed_block").isNotNull() & later, F.lit(False))
    return both.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest)).select(*target.columns)


def merge_tokens(target: DataFrame, delta: DataFrame) -> DataFrame:
    """New symbols and decimals win where they are known; the first source stays."""
    return merge(target, delta, ["chain", "token"], {"symbol": "coalesce_new", "decimals": "coalesce_new", "source": "first"})


def merge_links(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Links (chain, contract, token, first_block, last_block, canonical) with those of a closed range: canonical again.

    A link that was taken back begins at its new first block, others keep theirs; the last block grows,
    an unknown one counting as 0.
    """
    keys = ["chain", "contract", "token"]
    old, new = target.withColumn("__in", F.lit(True)).alias("o"), delta.groupBy(*keys).agg(F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block")).withColumn("__in", F.lit(True)).alias("n")
    both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    fresh, hit = F.col("o.__in").isNull(), F.col("n.__in").isNotNull()
    dead = F.coalesce(F.col("o.canonical") == 0, F.lit(False))
    last = F.when(F.col("n.last_block").isNull(), F.col("o.last_block")).otherwise(F.greatest(F.coalesce("o.last_block", F.lit(0)), "n.last_block"))
    return both.select(
        *(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys),
        F.when(fresh | (hit & dead), F.col("n.first_block")).otherwise(F.col("o.first_block")).alias("first_block"),
        F.when(fresh, F.col("n.last_block")).when(hit, last).otherwise(F.col("o.last_block")).alias("last_block"),
        F.when(hit, 1).otherwise(F.col("o.canonical")).cast("int").alias("canonical"),
    )


def merge_code(target: DataFrame, delta: DataFrame) -> DataFrame:
    return merge(target, delta, ["chain", "address"], {})


def merge_chain_state(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Unknown facts of a new read keep the old ones; status and times follow the new read."""
    keep = {c: "coalesce_new" for c in ("has_code", "native_raw", "native_usd", "tokens_usd", "total_usd")}
    return merge(target, delta, ["address", "chain"], keep)


def merge_packages(target: DataFrame, delta: DataFrame) -> DataFrame:
    return merge(target, delta, ["package_id"], {"first_checkpoint": "first", "last_checkpoint": "max", "name": "coalesce_new"})


def merge_objects(target: DataFrame, delta: DataFrame) -> DataFrame:
    out = merge(target, delta, ["object_id"], {"checkpoint": "max"})
    return out.withColumn("active", F.lit(1))


def merge_pools(target: DataFrame, delta: DataFrame) -> DataFrame:
    """Listings change; what verification found stays."""
    return merge(target, delta, ["pool_id"], {"object_exists": "first", "verified_at": "first"})


def new_keys(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.join(target.select(*keys), keys, "left_anti")


def wake_chains(state: DataFrame, links: DataFrame, delta: DataFrame, capped: DataFrame, as_of: str) -> DataFrame:
    """Chain states that a new link of an uncapped address makes due at once."""
    fresh = new_keys(links, delta, ["chain", "contract", "token"]).select("chain", F.col("contract").alias("address")).distinct()
    fresh = fresh.join(capped.select("address"), "address", "left_anti").withColumn("__wake", F.lit(True))
    out = state.join(fresh, ["chain", "address"], "left")
    due = F.when(F.col("__wake"), F.lit(as_of).cast("timestamp")).otherwise(F.col("next_retry_at"))
    return out.withColumn("next_retry_at", due).drop("__wake")


def absent_projects(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stored projects that the newest snapshot lacks; an empty snapshot proves nothing."""
    any_row = snapshot.agg(F.count("*").alias("n"))
    return stored.join(snapshot.select("project_key"), "project_key", "left_anti").join(F.broadcast(any_row), F.col("n") > 0).drop("n")


def retain(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(column).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))


def validated_policies(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): known names only, and include_verified needs a reason."""
    known = F.col("policy").isin("include", "include_verified", "exclude_from_total", "quarantine")
    good = F.coalesce(known & ((F.col("policy") != "include_verified") | (F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0)), F.lit(False))
    return policies.where(good), policies.where(~good)
