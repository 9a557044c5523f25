"""Exact top-k by integer inner product: columnar branch and bound over blocks of vectors.

Vectors are packed into blocks of bounded size, a column a dimension.  Query blocks form groups that a
task can hold, and candidate blocks are dealt to lanes; each cell of the grid of groups and lanes gets
its query blocks once and then its candidate blocks one after the other, so the product of blocks is
never stored.  For a pair of blocks scores grow dimension block by dimension block;
after each a candidate whose score plus the most that the remaining dimensions can add (the product
of the norms of what is left) stays under the query's k-th best is dropped, and the survivors are
compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = np.int64(2**63 - 1)


def quantize(vector: list[float | None] | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of each component, exact as doubles; None for a vector that takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        own = np.floor(np.asarray(vector, np.float64) * scale)
    return own if np.isfinite(own).all() else None


def narrow(columns: np.ndarray) -> np.ndarray:
    small = columns.size == 0 or (columns.min() >= -(2**15) and columns.max() < 2**15)
    return np.ascontiguousarray(columns, np.int16 if small else np.float64)


def unpack(raw: pa.Buffer, dims: int, n: int) -> np.ndarray:
    kind = np.int16 if dims and raw.size == 2 * dims * n else np.float64
    return np.frombuffer(raw, kind).reshape(dims, n).astype(np.float64)


def pack_blocks(df: DataFrame, id_column: str, vector_column: str, scale: float, block: int) -> DataFrame:
    """Blocks of at most `block` vectors of one length: (dims, block_id, ids, columns).

    columns is the block in vertical layout, dimension after dimension, as integers of 2 bytes where
    all fit, else as doubles, which hold them exactly.  Rows with a null id, or a vector that is null
    or has a component that is null, non-finite or so large that scale times it is, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, rows = open_blocks.pop(dims)
            flat = np.asarray(rows, dtype=np.float64).reshape(len(ids), dims).T
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int64()), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([narrow(flat).tobytes()], pa.binary())], ["dims", "ids", "columns"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = quantize(vector, scale)
                if key is None or own is None:
                    continue
                ids, rows = open_blocks.setdefault(len(own), ([], []))
                ids.append(key)
                rows.append(own)
                if len(ids) >= block:
                    yield out(len(own))
        for dims in list(open_blocks):
            yield out(dims)

    return df.select(df[id_column].cast("long").alias("id"), df[vector_column].alias("v")).mapInArrow(run, "dims long, ids binary, columns binary")


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, cand_ids: np.ndarray, cand: np.ndarray, k: int, floors: np.ndarray, step: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Branch and bound for a block of queries (dims x q) over a block of candidates (dims x n).

    The first dimension blocks are summed for all queries at once; each query then goes on alone with
    its survivors.  Sums of products are exact in 64-bit floats while they stay under 2**53; larger
    ones are redone in Python's integers.
    """
    dims, n = cand.shape
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(cand).max(initial=0)) * max(1, dims)
    if most >= 2**53:
        return [_exact(query_ids[j], queries[:, j], cand_ids, cand, k) for j in range(len(query_ids))]
    qf, cf = queries, cand
    # suffix norms after each dimension block
    cuts = list(range(step, dims, step))
    c_rest = {d: np.sqrt((cf[d:] ** 2).sum(axis=0)) for d in cuts}
    first = cuts[0] if cuts else dims
    head = qf[:first].T @ cf[:first]
    out = []
    for j, own in enumerate(query_ids):
        alive = np.flatnonzero(cand_ids != own)
        score, at, floor = head[j, alive], first, floors[j]
        while at < dims:
            if len(alive) > k:
                rest = np.sqrt((qf[at:, j] ** 2).sum()) * c_rest[at][alive] * (1 + 1e-9)
                least = max(floor, np.partition(score - rest, len(score) - k)[len(score) - k])
                keep = np.flatnonzero(score + rest >= least)
                alive, score = alive[keep], score[keep]
            end = min(dims, at + step)
            score = score + qf[at:end, j] @ cf[at:end, alive]
            at = end
        keep = np.flatnonzero(score >= floor)
        alive, score = alive[keep], score[keep]
        order = np.lexsort((cand_ids[alive], -score))[:k]
        out.append((cand_ids[alive[order]], score[order].astype(np.int64)))
    return out


def _exact(own: int, query: np.ndarray, cand_ids: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    alive = np.flatnonzero(cand_ids != own)
    score = [sum(int(a) * int(b) for a, b in zip(query.tolist(), cand[:, c].tolist())) for c in alive]
    order = sorted(range(len(alive)), key=lambda i: (-score[i], cand_ids[alive[i]]))[:k]
    return cand_ids[alive[order]], np.array([max(-int(LONG) - 1, min(int(LONG), score[i])) for i in order], np.int64)


def topk(
    queries: DataFrame, candidates: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, scale: float = 256.0, query_block: int = 512, candidate_block: int = 4096, group_blocks: int = 32
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest score for each query, ties to the smaller id.

    Components become floor(scale * x); the score is the inner product of vectors of equal length.
    Rows that share the query's id are its own and no candidates; any other row counts as often as it
    occurs, and so does a repeated query row.  Rows with a null id or a null or non-finite component
    take no part.  Scores beyond 64 bits are held at their limits.  With fewer than k candidates all
    are returned; without any, or with empty tables, the query has no rows.  A task holds at most about
    group_blocks query blocks.  Other columns don't matter.
    """
    q = pack_blocks(queries, id_column, vector_column, scale, query_block).withColumn("q_block", F.monotonically_increasing_id())
    c = pack_blocks(candidates, id_column, vector_column, scale, candidate_block)
    groups = max(1, -(-queries.count() // (query_block * group_blocks)))
    lanes = max(8, candidates.sparkSession.sparkContext.defaultParallelism * 2 // groups)
    lane = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("group", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int")).withColumn("lane", lane(lanes)).withColumn("part", F.lit(0))
    c = c.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")).withColumn("group", lane(groups)).withColumn("part", F.lit(1)).withColumn("q_block", F.lit(None).cast("long"))
    names = ["part", "q_block", "dims", "ids", "columns"]
    cells = [x.select((F.col("group") * lanes + F.col("lane")).alias("cell"), *names) for x in (q, c)]
    work = cells[0].unionByName(cells[1]).repartition(groups * lanes, "cell").sortWithinPartitions("cell", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        held: list[tuple[int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for block, q_ids, _, best in held:
                n = [len(x[0]) for x in best]
                if sum(n):
                    columns = [pa.array([block] * sum(n), pa.int64()), pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([x[0] for x in best])), pa.array(np.concatenate([x[1] for x in best]))]
                    yield pa.RecordBatch.from_arrays(columns, ["q_block", "q_row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("cell", *names)}
                if row["cell"].as_py() != cell:
                    yield from out()
                    cell, held = row["cell"].as_py(), []
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                cols = unpack(row["columns"].as_buffer(), row["dims"].as_py(), len(ids))
                if row["part"].as_py() == 0:
                    held.append((row["q_block"].as_py(), ids, cols, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)))
                    continue
                for _, q_ids, q_cols, best in held:
                    if len(q_cols) != len(cols):
                        continue
                    floors = np.array([x[1][-1] if len(x[1]) >= k else -np.inf for x in best])
                    for j, (a, s) in enumerate(search_blocks(q_ids, q_cols, ids, cols, k, floors)):
                        a, s = np.r_[best[j][0], a], np.r_[best[j][1], s]
                        order = np.lexsort((a, -s))[:k] if len(s) and abs(s).max() < 2**53 else np.array(sorted(range(len(s)), key=lambda i: (-int(s[i]), a[i]))[:k], np.int64)
                        best[j] = (a[order], s[order])
        yield from out()

    partial = work.mapInArrow(run, "q_block long, q_row long, query_id long, vec_id long, score long")
    ranked = partial.groupBy("q_block", "q_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
