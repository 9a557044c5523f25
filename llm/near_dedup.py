"""Near-duplicate documents by HyperMinHash, checked on full shingle sets.

A document's set holds its distinct word shingles.  One hash a shingle picks a bucket by its top
bits; the bucket keeps the least of the rest as a leading-zero count and a few mantissa bits.
Documents whose registers agree in a whole band are candidates; for the bands an empty register borrows
the value of another one, in an order fixed for each register, so that short texts don't agree in what
they lack.  The share of equal registers, corrected for chance, must allow the wanted similarity, and
only then are full sets compared.

Documents with equal sets are one node from the start, so copies never form pairs.  In a bucket of a
band every node is first compared with one pivot.  Where nodes of a bucket are then still in different
components, no link may be lost, but pairs are not made into rows either: blocks of the bucket's nodes
are compared by their registers, and what comes out is which node may belong to which other component.
Blocks of such nodes are then compared with blocks of the component's nodes on full sets, until a link
is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, materialize, slices

BUCKET_BITS, MANTISSA_BITS, BAND_ROWS = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND_ROWS
EMPTY = np.uint16(0xFFFF)
#: Odd multipliers, one for each place in a shingle: powers of one constant.
STEP = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words; kept while there is room."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < 200_000:
            self[w] = h
        return h


HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z count as lower case.

    A text with fewer words than size is one shingle; without words there is none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(STEP) + h[k : k + n]
        return np.unique(mix(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: (leading zeros << mantissa bits | mantissa) of the least rest in each bucket."""
    out = np.full(BUCKETS, EMPTY)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rest = shingles[first] << np.uint64(BUCKET_BITS)
        top = np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64)  # exact: 53 bits
        exponent = np.frexp(top)[1]
        zeros = 53 - exponent
        # the bits after the leading one
        mantissa = (np.ldexp(top, MANTISSA_BITS + 1 - exponent).astype(np.int64)) & ((1 << MANTISSA_BITS) - 1)
        out[bucket[first]] = (np.minimum(zeros, 62) << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out


def borrow_order(tries: int = 48) -> np.ndarray:
    """For each register the registers that it borrows from, in order of trying."""
    k = np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(tries, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        return (mix(k + np.uint64(STEP)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


ORDER = borrow_order()


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers without empty ones, unless all are empty."""
    full = regs != EMPTY
    if full.all() or not full.any():
        return regs
    holes = np.flatnonzero(~full)
    order = ORDER[holes]
    first = np.argmax(full[order], axis=1)
    source = order[np.arange(len(holes)), first]
    # none of the tries hit: the next full register, in a circle
    filled = np.flatnonzero(full)
    following = filled[np.searchsorted(filled, holes) % len(filled)]
    out = regs.copy()
    out[holes] = regs[np.where(full[source], source, following)]
    return out


def bands_of(nodes: DataFrame) -> DataFrame:
    """(node, bucket): a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            full = np.stack([densified(r) for r in regs])[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS)
            h = np.repeat(salt[None, :], len(regs), axis=0)
            with np.errstate(over="ignore"):
                for k in range(BAND_ROWS):
                    h = mix(h * np.uint64(STEP) + full[:, :, k].astype(np.uint64) + np.uint64(1))
            at = pa.array(np.repeat(np.arange(len(regs)), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array(h.ravel().view(np.int64))], ["node", "bucket"])

    return nodes.select("node", "regs").mapInArrow(run, "node binary, bucket long")


def may_reach(a: np.ndarray, b: np.ndarray, similarity: float, sigmas: float = 5.0) -> np.ndarray:
    """For rows of registers: whether the estimated Jaccard similarity allows the wanted one.

    Equal registers less those expected to be equal by chance (two unrelated minima agree in zeros
    with probability 1/3 and in their mantissa with 2**-bits), over registers that are not empty in
    both.  The margin is so many standard errors of the estimate at the wanted similarity.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(axis=1), 1)
    chance = 1 / (3 * (1 << MANTISSA_BITS))
    share = ((a == b) & used).sum(axis=1) / n
    estimate = (share - chance) / (1 - chance)
    return estimate >= similarity - sigmas * np.sqrt(similarity * (1 - similarity) / n)


def sketch(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5) -> DataFrame:
    """(id, n, node, regs): set size, 128-bit hash of the set as the node's key, registers; a row for a row."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, size) for t in part.column("text").to_pylist()]
                node = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                regs = [registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "node", "regs"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n long, node binary, regs binary")


def full_sets(docs: DataFrame, ids: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(node, shingles) of the documents with the given ids: sorted 64-bit hashes as bytes."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).join(ids.distinct(), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, size).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes (a, b) whose registers allow the similarity."""
    own = nodes.select("node", "regs")
    rows = pairs.join(own.select(F.col("node").alias("a"), F.col("regs").alias("ra")), "a").join(own.select(F.col("node").alias("b"), F.col("regs").alias("rb")), "b").select("a", "b", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(may_reach(x, y, similarity)))

    return rows.mapInArrow(run, "a binary, b binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                keep.append(linked(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def in_pairs_of_blocks(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Groups (i, j, m) of a block of left and a block of right rows of one key; m lists both, those of right with side 1.

    left and right: (keys, nodes' columns, blocks_left, blocks_right).  A group never grows with its key.
    """
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    x = left.withColumn("i", own("blocks_left")).withColumn("j", other("blocks_right")).withColumn("side", F.lit(0))
    y = right.withColumn("j", own("blocks_right")).withColumn("i", other("blocks_left")).withColumn("side", F.lit(1))
    both = x.select(*keys, "i", "j", F.struct("side", *columns).alias("x")).unionByName(y.select(*keys, "i", "j", F.struct("side", *columns).alias("x")))
    return both.groupBy(*keys, "i", "j").agg(F.collect_list("x").alias("m")).select("m")


def doubtful(members: DataFrame, nodes: DataFrame, similarity: float, block: int = 1024) -> DataFrame:
    """(comp, node): nodes that registers allow to link to a node of another component in one of their buckets.

    members: (bucket, node, comp, size), size being that of the component.  Of two components the
    smaller one's nodes are named.  A bucket's largest component is not compared with itself: the nodes
    outside it are dealt to blocks of about `block` nodes, each of which meets blocks of all nodes.
    """
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    parts = parts.select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / block).alias("blocks_left"), F.ceil(F.col("all") / block).alias("blocks_right"))
    rows = members.join(parts, "bucket").join(nodes.select("node", "regs"), "node").withColumn("inside", F.col("comp") == F.col("main"))
    groups = in_pairs_of_blocks(rows.where("not inside"), rows, ["bucket"], ["inside", "node", "comp", "size", "regs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for group in batch.column("m"):
                m = group.values
                node, comp = (m.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp"))
                size, side, inside = (m.field(c).to_numpy(zero_copy_only=False) for c in ("size", "side", "inside"))
                regs = np.frombuffer(b"".join(m.field("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                _, code = np.unique(comp.astype("S16"), return_inverse=True)
                _, place = np.unique(node.astype("S16"), return_inverse=True)
                for x in np.flatnonzero(side == 0).tolist():
                    # of two nodes outside the largest component the one with the smaller key looks at the other
                    y = np.flatnonzero((side == 1) & (code != code[x]) & (inside | (place > place[x])))
                    if not len(y):
                        continue
                    y = y[may_reach(np.broadcast_to(regs[x], (len(y), BUCKETS)), regs[y], similarity)]
                    less = (size[x] < size[y]) | ((size[x] == size[y]) & (code[x] < code[y]))
                    found = {(comp[k], node[x]) for k in y[less].tolist()} | {(comp[x], node[k]) for k in y[~less].tolist()}
                    for pair in found - seen:
                        out.append(pair)
                        if len(seen) < 1_000_000:
                            seen.add(pair)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["comp", "node"])

    return groups.mapInArrow(run, "comp binary, node binary").distinct()


def member_links(doubts: DataFrame, placed: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) of the nodes in doubts (comp, node) to a node of the component, on full sets, one each and pair of blocks.

    placed: (node, comp) of all nodes.  Both sides come in blocks of about `block` sets, and each pair
    of blocks is a group of its own.
    """
    inside = placed.join(doubts.select("comp").distinct(), "comp", "left_semi").select("comp", "node")
    count = lambda rows, name: rows.groupBy("comp").agg(F.ceil(F.count("*") / block).alias(name))
    n = count(doubts, "blocks_left").join(count(inside, "blocks_right"), "comp")
    groups = in_pairs_of_blocks(doubts.join(n, "comp").join(sets, "node"), inside.join(n, "comp").join(sets, "node"), ["comp"], ["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for group in batch.column("m"):
                m = group.values
                rows = [(k, r.as_py(), np.frombuffer(x.as_buffer(), np.uint64)) for k, r, x in zip(m.field("side").to_pylist(), m.field("node"), m.field("shingles"))]
                own, other = ([(r, x) for k, r, x in rows if k == side] for side in (0, 1))
                sizes = np.array([len(x) for _, x in other])
                for a, x in own:
                    fit = (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))).nonzero()[0]
                    hit = next((other[k][0] for k in fit.tolist() if linked(x, other[k][1], percent)), None)
                    if hit is not None:
                        found.append((a, hit))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return groups.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for a row.

    Linked are documents whose sets have at least percent of their union in common.  component_id is
    the smallest id reachable, itself included; kept: id = component_id.  Texts without words have an
    empty set, n_shingles 0, and are linked with nothing.  Rows with a null id are no document's
    copies: their component_id is null and they are kept.  Rows that repeat an id are one document;
    ties don't arise, as the smallest id is unique.  Whole texts count, however long; an empty table
    gives no rows; other columns of docs don't matter.  Candidates come from bands, of which a pair at
    similarity 0.8 shares none with probability 3e-6, and registers rule out pairs whose estimate lies
    five standard errors too low; links are decided on full sets.
    """
    own = materialize(sketch(docs, id_column, text_column, size), "sketch")
    nodes = own.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")

    bands = bands_of(nodes).repartition("bucket")
    shared = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot != top").select("bucket", "pivot")
    members = materialize(bands.join(shared, "bucket"), "members")

    # first every member with the pivot of its bucket
    star = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = materialize(likely(star, nodes, percent / 100), "pairs")
    reps = nodes.select("node", "rep")
    asked = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
    sets = materialize(full_sets(docs, asked.join(reps, "node").select(F.col("rep").alias("id")), id_column, text_column, size), "sets")
    links = materialize(verified(star, sets, percent), "links")

    # then members of a bucket that are still in different components
    group = components(links, name="star").select(F.col("id").alias("node"), F.col("component_id").alias("comp"))
    placed = nodes.select("node").join(group, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("comp").agg(F.count("*").alias("size"))
    placed = materialize(placed.join(sizes, "comp"), "placed")
    spread = members.select("bucket", "node").join(placed, "node")
    mixed = spread.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("bucket")
    doubts = materialize(doubtful(spread.join(mixed, "bucket"), nodes, percent / 100), "doubts")
    touched = placed.join(doubts.select("comp").distinct(), "comp", "left_semi").select("node").union(doubts.select("node")).distinct()
    lacking = touched.join(sets.select("node"), "node", "left_anti")
    sets = sets.union(full_sets(docs, lacking.join(reps, "node").select(F.col("rep").alias("id")), id_column, text_column, size))
    links = links.union(member_links(doubts, placed, sets, percent))

    by_id = links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    # an id whose rows have different texts ties their nodes together
    found = components(by_id.select("x", "y"), "x", "y", name="ids").select(F.col("id").alias("rep"), "component_id")
    rows = own.join(reps, "node", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    rows = rows.join(found, "rep", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
