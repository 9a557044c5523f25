"""Fingerprints of whole tables as hash trees, so that two versions are compared by ranges.

A row lies under the hexadecimal digits of its key's hash: the range of a node of depth d is all keys
whose hash begins with its d digits.  A leaf is known by the number of its rows and two sums over their
hashes, which don't depend on order or partitions; a node's digest is over its children's in order.  The
root's digest is equal for two versions exactly if their sorted rows are (up to collisions of SHA-256).
To find what changed, nodes are compared from the root down, and only rows of leaves that differ are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 15  # of 4 bits: sums of these are exact in a decimal


def row_text(columns: list[str]) -> Column:
    """Columns as one text: a null differs from every value, and no value runs into the next."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({"__k": F.sha2(row_text(keys), 256), "__r": F.sha2(row_text(df.columns), 256)})


def leaf_depth(rows: int, per_leaf: int = 1024) -> int:
    """Digits of a leaf, so that a leaf has about per_leaf rows: 0 for small tables, at most 12."""
    depth = 0
    while depth < 12 and rows > per_leaf * 16**depth:
        depth += 1
    return depth


def tree(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(level, node, rows, digest): leaves at level depth, the root at level 0 with an empty node; ranges without rows have none.

    Partial sums a task and leaf are all that is shuffled.  Keys may be null or repeat.
    """
    part = lambda at: F.sum(F.conv(F.substring("__r", at, DIGITS), 16, 10).cast("decimal(38,0)"))
    leaves = _hashed(df, keys).groupBy(F.substring("__k", 1, depth).alias("node")).agg(F.count("*").alias("rows"), part(1).alias("a"), part(17).alias("b"))
    level = leaves.select(F.lit(depth).alias("level"), "node", "rows", F.sha2(F.concat_ws("|", "node", "rows", "a", "b"), 256).alias("digest"))
    levels = [level]
    for d in range(depth - 1, -1, -1):
        up = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("kids"))  # at most 16
        level = up.select(F.lit(d).alias("level"), "node", "rows", F.sha2(F.concat_ws("|", "node", F.array_join(F.transform("kids", lambda x: x["digest"]), "|")), 256).alias("digest"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def root(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(rows, digest) of a whole table; no row for an empty one."""
    return tree(df, keys, depth).where("level = 0").select("rows", "digest")


def differing(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """(node): leaves in which two trees of one depth differ; below a node that is equal none is looked at."""
    node = None
    for d in range(depth + 1):
        x, y = (t.where(F.col("level") == d).select("node", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        both = x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        node = both if node is None else both.withColumn("__up", F.substring("node", 1, d - 1)).join(node.withColumnRenamed("node", "__up"), "__up", "left_semi").select("node")
    return node


def changes(before: DataFrame, after: DataFrame, keys: list[str], depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, change): lost, new or changed keys, found in the differing leaves alone; keys are unique in each version.

    trees: those of the versions where they are stored.
    """
    a, b = trees or (tree(before, keys, depth), tree(after, keys, depth))
    leaves = differing(a, b, depth)
    x, y = (_hashed(df, keys).withColumn("node", F.substring("__k", 1, depth)).join(leaves, "node", "left_semi").select(*keys, F.col("__r").alias(n)) for df, n in ((before, "x"), (after, "y")))
    both = x.alias("x").join(y.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys], "full_outer")
    change = F.when(F.col("y.y").isNull(), "lost").when(F.col("x.x").isNull(), "new").otherwise("changed")
    rows = both.where(~F.col("x.x").eqNullSafe(F.col("y.y")))
    return rows.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys), change.alias("change"))
