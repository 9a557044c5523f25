"""Sharding by fixed virtual slots.

Records are hashed by their key into thousands of slots, a number that never changes.  Bytes and rows
are added up a slot; a map, stored by version, says which shard holds which slot.  Rebalancing and
growing write a new version in which some slots have moved; a record's slot stays.  A slot that is too
heavy for one shard, as that of a key with a third of all rows, has several parts, to which its rows
are dealt by number.  The map has a row a part: a number that doesn't grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import materialize

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: entry e is part part[e] of slot[e] and belongs to shard[e]."""

    version: int
    shards: int
    slot: np.ndarray
    part: np.ndarray
    shard: np.ndarray


def first_map(slots: int, shards: int) -> SlotMap:
    """Version 1: slots dealt to the shards in turn."""
    every = np.arange(slots)
    return SlotMap(1, shards, every, np.zeros(slots, np.int64), every % shards)


def split_heavy(old: SlotMap, weight: np.ndarray, pieces: int = 4) -> SlotMap:
    """The next version, in which slots heavier than 1 / pieces of an even shard have parts lighter than that; the same map if there are none.

    weight: bytes a slot.  Only the first part stays where the slot was; more than 256 * shards parts are never made.
    """
    limit = max(1.0, weight.sum() / old.shards / pieces)
    parts = np.minimum(np.ceil(weight / limit), 256 * old.shards).astype(np.int64)
    if old.part.any() or parts.max(initial=1) <= 1:
        return old
    parts = np.maximum(1, parts)
    slot = np.repeat(old.slot, parts)
    part = np.arange(len(slot)) - np.repeat(np.cumsum(parts) - parts, parts)
    return SlotMap(old.version + 1, old.shards, slot, part, (np.repeat(old.shard, parts) + part) % old.shards)


def rebalanced(old: SlotMap, weight: np.ndarray) -> SlotMap:
    """The next version: entries moved from the fullest shard to the emptiest while that evens them out.

    weight: bytes an entry.  Each move takes the entry nearest to half the difference, so few are needed
    and no two shards end further apart than the lightest entry that is left in the fuller one.
    """
    shard = old.shard.copy()
    load = np.bincount(shard, weight, old.shards)
    while True:
        full, empty = int(load.argmax()), int(load.argmin())
        own = np.flatnonzero((shard == full) & (weight > 0) & (weight < load[full] - load[empty]))
        if not len(own):
            return replace(old, version=old.version + 1, shard=shard)
        e = own[np.abs(weight[own] - (load[full] - load[empty]) / 2).argmin()]
        shard[e] = empty
        load[full] -= weight[e]
        load[empty] += weight[e]


def grown(old: SlotMap, weight: np.ndarray) -> SlotMap:
    """The next version, with one more shard: entries move into it, from the fullest shard each, until it has its share; none moves elsewhere."""
    shard, new = old.shard.copy(), old.shards
    load = np.bincount(shard, weight, new + 1)
    share = weight.sum() / (new + 1)
    while True:
        full = int(load[:new].argmax())
        own = np.flatnonzero((shard == full) & (weight > 0) & (weight <= share - load[new]))
        if not len(own):
            return replace(old, version=old.version + 1, shards=new + 1, shard=shard)
        e = own[np.abs(weight[own] - max(load[full] - share, 1)).argmin()]
        shard[e] = new
        load[full] -= weight[e]
        load[new] += weight[e]


def store_map(spark: SparkSession, folder: str, maps: list[SlotMap]) -> None:
    """Add versions to the stored map; a version is written once and never changed."""
    for m in maps:
        rows = list(zip(m.slot.tolist(), m.part.tolist(), m.shard.tolist()))
        frame = spark.createDataFrame(rows, "slot int, part int, shard int").coalesce(1).withColumn("shards", F.lit(m.shards))
        frame.write.mode("errorifexists").parquet(f"{folder}/version={m.version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """A version of the stored map, the newest by default."""
    frame = spark.read.parquet(folder)
    if version is None:
        version = frame.agg(F.max("version")).first()[0]
    rows = frame.where(F.col("version") == version).orderBy("slot", "part").collect()
    cols = [np.array([r[c] for r in rows], np.int64) for c in ("slot", "part", "shard")]
    return SlotMap(version, rows[0].shards, *cols)


def parts_column(m: SlotMap, slot: Column, row: Column) -> Column:
    """Part of a slot that a row belongs to, by the row's number; 0 wherever the slot has only one."""
    slots, counts = np.unique(m.slot, return_counts=True)
    heavy = {int(s): int(n) for s, n in zip(slots, counts) if n > 1}
    if not heavy:
        return F.lit(0)
    table = F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair))
    return F.pmod(row, F.coalesce(table[slot], F.lit(1))).cast("int")


def slotted(docs: DataFrame, key_column: str, size: Column, slots: int = SLOTS) -> DataFrame:
    """(doc, key, size, slot, row): the whole row as one column, its key, its bytes, its slot and its number.

    A null key is a key like any other.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs[key_column].alias("key"), size.cast("long").alias("size"))
    return rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int")).withColumn("row", F.monotonically_increasing_id())


def weights(rows: DataFrame, m: SlotMap) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each entry of the map; a row an entry reaches the driver."""
    got = rows.select("slot", parts_column(m, F.col("slot"), F.col("row")).alias("part"), "size").groupBy("slot", "part").agg(F.sum("size"), F.count("*")).collect()
    at = {(s, p): e for e, (s, p) in enumerate(zip(m.slot.tolist(), m.part.tolist()))}
    size, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for s, p, b, c in got:
        size[at[s, p]], n[at[s, p]] = b, c
    return size, n


def even_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> tuple[list[SlotMap], np.ndarray, np.ndarray]:
    """All versions from the first to one that is even by bytes, and bytes and rows of the last one's entries."""
    maps = [first_map(slots, shards)]
    size, n = weights(rows, maps[0])
    apart = split_heavy(maps[0], size)
    if apart is not maps[0]:
        maps.append(apart)
        size, n = weights(rows, apart)
    maps.append(rebalanced(maps[-1], size))
    return maps, size, n


def entry_table(spark: SparkSession, m: SlotMap, **columns: np.ndarray) -> DataFrame:
    """(slot, part, shard, ...): the map as a table of bounded size, with more columns by entry."""
    cols = {"slot": m.slot, "part": m.part, "shard": m.shard} | columns
    kinds = ", ".join(f"{c} {'long' if c == 'base' else 'int'}" for c in cols)
    return spark.createDataFrame(list(zip(*(v.tolist() for v in cols.values()))), kinds)


def assigned(docs: DataFrame, key_column: str = "doc_id", size: Column | None = None, text_column: str = "text", shards: int = 16, slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """docs with virtual_slot, shard, place, first_shard, map_version and next_shard.

    shard: by the newest version of a map that is even by bytes; place numbers the rows of a shard from
    0 without a gap, in the order of slots and keys; first_shard: by version 1, before slots were moved;
    next_shard: after one more shard was added, which takes rows only into itself.  size: bytes of a
    row, by default those of the text (null: none) and one more.  Null and repeated keys and repeated
    rows are rows of their own; an empty table gives no rows; columns of docs with the name of a result
    are replaced.  With map_folder all versions are stored there.  A shard is no heavier than an even
    one by more than the lightest entries, except where a single row is.

    The rows are written once with their numbers.  They are dealt by range, so a slot of any size
    spreads over tasks, and a place is a task's own count on top of what the tasks before it hold: the
    table of these has a row a slot and task boundary.
    """
    spark = docs.sparkSession
    if size is None:
        size = F.coalesce(F.octet_length(text_column), F.lit(0)) + 1
    rows = materialize(slotted(docs, key_column, size, slots), "slotted")
    maps, bytes_of, n = even_map(rows, shards, slots)
    last, more = maps[-1], grown(maps[-1], bytes_of)
    if map_folder:
        store_map(spark, map_folder, [*maps, more])
    # where an entry's rows begin in its shard
    order = np.lexsort((last.part, last.slot, last.shard))
    ends = np.cumsum(n[order])
    begin = np.searchsorted(last.shard[order], np.arange(shards))
    shard_start = np.where(begin > 0, ends[begin - 1], 0)
    base = np.empty(len(n), np.int64)
    base[order] = ends - n[order] - shard_start[last.shard[order]]
    table = entry_table(spark, last, base=base, first=last.slot % shards, more=more.shard)

    keyed = rows.withColumn("part", parts_column(last, F.col("slot"), F.col("row")))
    laid = keyed.repartitionByRange("slot", "part", "key", "row").sortWithinPartitions("slot", "part", "key", "row")
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33).cast("int")), "laid_out")
    runs = laid.groupBy("task", "slot", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by slot, part order by task rows between unbounded preceding and 1 preceding), 0)")
    starts = runs.withColumn("before", before).join(F.broadcast(table), ["slot", "part"])
    starts = starts.select("task", "slot", "part", (F.col("base") + F.col("before") - F.col("begin")).alias("shift"), "shard", "first", "more")
    out = laid.join(F.broadcast(starts), ["task", "slot", "part"])  # at most a row an entry and a row a task
    found = {"virtual_slot": F.col("slot"), "shard": F.col("shard"), "place": F.col("at") + F.col("shift"), "first_shard": F.col("first"), "map_version": F.lit(last.version), "next_shard": F.col("more")}
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in found), *(v.alias(k) for k, v in found.items()))


def write_shards(docs: DataFrame, folder: str, map_folder: str, key_column: str = "doc_id", text_column: str = "text", shards: int = 16, slots: int = SLOTS, rows_a_file: int = 1_000_000) -> SlotMap:
    """Write docs under folder/shard=N as Parquet, whole rows, by a map that is even by bytes and stored in map_folder; returns the map.

    docs must be the same rows in the same order at each reading, as files are, for shards to come out
    even; every row is written once in any case.  A column shard of docs is left out.
    """
    size = F.coalesce(F.octet_length(text_column), F.lit(0)) + 1
    rows = slotted(docs, key_column, size, slots)
    maps, _, _ = even_map(rows.select("slot", "row", "size"), shards, slots)
    store_map(docs.sparkSession, map_folder, maps)
    m = maps[-1]
    placed = rows.withColumn("part", parts_column(m, F.col("slot"), F.col("row"))).join(F.broadcast(entry_table(docs.sparkSession, m)), ["slot", "part"])
    placed = placed.repartition(F.col("shard"), F.col("slot"), F.col("part")).sortWithinPartitions("shard", "slot", "part", "key")
    out = placed.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c != "shard"), "shard")
    out.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(folder)
    return m
