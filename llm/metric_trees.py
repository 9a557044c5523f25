"""Codes of vectors by parts, fitted exactly with metric trees.

A vector is cut into equal parts, and each part position has a codebook.  Vectors lie in blocks of
bounded size; for each block and part position an anchors hierarchy is built from the middle out: about
sqrt(n) anchors each own the points nearest to them and are joined pairwise into a tree of balls, whose
large leaves are taken apart in the same way.  A ball caches the number and the sum of its points.  In
a round a ball inherits the entries that can be nearest to one of its points from the ball above and
drops those that can't; when one is left, the whole ball is that entry's and its cached sum is added,
without a look at its points.  Points of leaves with several entries left are compared exactly, in
integers.  So results are those of comparing every part with every entry.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from llm.common import materialize

#: Components up to this size are compared in 64-bit integers, others in Python's.
SMALL = 1 << 24
LIMB = 40
MOST = 2**63 - 1


def exact_floor(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no finite double."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


class Tree:
    """An anchors hierarchy over points (n x d integers).

    order lists the points ball by ball; ball k holds order[start[k]:end[k]], has its children at
    left[k] and right[k] (-1: a leaf), and caches center, radius and the sum of its points.  Ball 0 is
    the whole.
    """

    names = ("order", "start", "end", "left", "right", "center", "radius", "sums")

    def __init__(self, points: np.ndarray, leaf: int = 48):
        self.points, self.leaf = points, leaf
        self.rows: list[list] = []
        self.float = points.astype(np.float64)
        top = self.middle_out(np.arange(len(points)))
        # the order of points and the numbers of balls follow the tree from the top
        order, flat = [], []
        self._lay(top, order, flat)
        self.order = np.concatenate(order).astype(np.int32)
        self.start, self.end, self.left, self.right = (np.array([r[c] for r in flat], np.int32) for c in range(4))
        self.center = np.array([r[4] for r in flat])
        self.radius = np.array([r[5] for r in flat])
        total = np.r_[np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.order], axis=0)]
        self.sums = total[self.end] - total[self.start]
        del self.points, self.float, self.rows

    def _lay(self, top: tuple, order: list, flat: list) -> None:
        stack, at = [(top, -1, 2)], 0
        while stack:
            node, above, side = stack.pop()
            if node is None:
                flat[above][1] = at
                continue
            own = len(flat)
            if above >= 0:
                flat[above][side] = own
            ids, kids, center, radius = node
            flat.append([at, at, -1, -1, center, radius])
            if kids is None:
                order.append(ids)
                at += len(ids)
                flat[own][1] = at
            else:
                stack += [(None, own, 1), (kids[1], own, 3), (kids[0], own, 2)]  # what comes last is taken first; None ends the ball

    def ball(self, ids: np.ndarray, kids: tuple | None) -> tuple:
        own = self.float[ids]
        center = own.mean(axis=0)
        return ids, kids, center, float(np.sqrt(((own - center) ** 2).sum(axis=1).max()))

    def middle_out(self, ids: np.ndarray) -> tuple:
        """A ball over these points: anchors first, then the tree above them and the trees below."""
        own = self.float[ids]
        if len(ids) <= self.leaf or (own == own[0]).all():
            return self.ball(ids, None)
        pivots = [own[0]]
        far = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
        owner = np.zeros(len(ids), np.int64)
        for k in range(1, math.isqrt(len(ids) - 1) + 1):
            new = own[far.argmax()]  # the point furthest from its anchor is the next anchor
            if not far.max():
                break
            # only points more than half as far from their anchor as that is from the new one can change
            near = np.sqrt(((np.array(pivots) - new) ** 2).sum(axis=1)) / 2
            ask = np.flatnonzero(far > near[owner] * (1 - 1e-9))
            d = np.sqrt(((own[ask] - new) ** 2).sum(axis=1))
            won = d < far[ask]
            owner[ask[won]], far[ask[won]] = k, d[won]
            pivots.append(new)
        by = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.r_[True, owner[by][1:] != owner[by][:-1]])
        return self.joined([self.middle_out(ids[x]) for x in np.split(by, cuts[1:])])

    def joined(self, balls: list[tuple]) -> tuple:
        """One ball over all: again and again the two that fit into the smallest ball become one."""
        n = len(balls)
        count = np.array([len(b[0]) for b in balls], np.float64)
        center = np.array([b[2] for b in balls])
        radius = np.array([b[3] for b in balls])

        def cost(i: int) -> np.ndarray:
            w = (count[i] / (count[i] + count))[:, None]
            c = w * center[i] + (1 - w) * center
            one = np.sqrt(((c - center[i]) ** 2).sum(axis=1)) + radius[i]
            return np.maximum(one, np.sqrt(((c - center) ** 2).sum(axis=1)) + radius)

        table = np.array([cost(i) for i in range(n)])
        np.fill_diagonal(table, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(table.argmin()), n)
            balls[i] = self.ball(np.r_[balls[i][0], balls[j][0]], (balls[i], balls[j]))
            count[i], center[i], radius[i] = len(balls[i][0]), balls[i][2], balls[i][3]
            table[j] = table[:, j] = np.inf
            row = cost(i)
            row[np.isinf(table[i])] = np.inf
            row[i] = np.inf
            table[i] = table[:, i] = row
            last = i
        return balls[last]

    def pack(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.names}

    @classmethod
    def unpack(cls, arrays: dict[str, np.ndarray]) -> "Tree":
        own = cls.__new__(cls)
        for name in cls.names:
            setattr(own, name, arrays[name])
        return own

    def assign(self, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each point (ties to the lower index), and number and sum of each entry's points."""
        m = len(entries)
        code = np.empty(len(points), np.int64)
        n, total = np.zeros(m, np.int64), np.zeros(entries.shape, np.int64)
        wide = entries.astype(np.float64)
        front, lists = np.zeros(1, np.int64), np.ones((1, m), bool)
        while len(front):
            far = np.sqrt(((self.center[front][:, None, :] - wide) ** 2).sum(axis=2))
            far[~lists] = np.inf
            most = far.min(axis=1) + 2 * self.radius[front]
            lists = far <= (most * (1 + 1e-9) + 1e-6)[:, None]
            single = lists.sum(axis=1) == 1
            owned, entry = front[single], lists[single].argmax(axis=1)
            np.add.at(n, entry, (self.end - self.start)[owned])
            np.add.at(total, entry, self.sums[owned])
            code[self.order[_ranges(self.start[owned], self.end[owned])]] = np.repeat(entry, (self.end - self.start)[owned])
            leaf = ~single & (self.left[front] < 0)
            if leaf.any():
                own = front[leaf]
                at = self.order[_ranges(self.start[own], self.end[own])]
                open_ = np.repeat(lists[leaf], (self.end - self.start)[own], axis=0)
                got = nearest(points[at], entries, open_)
                code[at] = got
                np.add.at(n, got, 1)
                np.add.at(total, got, points[at])
            down = ~single & ~leaf
            front, lists = np.r_[self.left[front[down]], self.right[front[down]]], np.r_[lists[down], lists[down]]
        return code, n, total


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = (end - start).astype(np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None, step: int = 4096) -> np.ndarray:
    """Index of the nearest of the allowed entries by squared distance in integers, ties to the lower one."""
    out = np.empty(len(points), np.int64)
    for k in range(0, len(points), step):
        far = ((points[k : k + step, None, :] - entries[None]) ** 2).sum(axis=2)
        if allowed is not None:
            far[~allowed[k : k + step]] = MOST
        out[k : k + step] = far.argmin(axis=1)
    return out


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers where all are small, else as Python's integers."""
    with np.errstate(over="ignore"):
        own = np.floor(values.astype(np.float64) * scale)
    if not own.size or np.abs(own).max() <= SMALL:
        return own.astype(np.int64)
    flat = [exact_floor(x, scale) for x in values.ravel().tolist()]
    return np.array(flat + [None], object)[:-1].reshape(values.shape)


def _assign(tree: Tree | None, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if tree is not None and entries.dtype != object:
        return tree.assign(points, entries)
    exact = entries.astype(object)
    code = nearest(points.astype(object), exact)
    n, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64).astype(object)
    np.add.at(n, code, 1)
    for c, p in zip(code.tolist(), points):
        total[c] += p
    return code, n, total


def part_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v): the rows that take part: no null or non-finite component, and any number of them."""
    v = F.col(vector_column)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(good).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), v.alias("v"))


def tree_blocks(rows: DataFrame, parts: int, scale: int, block: int) -> DataFrame:
    """(ids, labels, wide, points, trees): blocks of at most `block` vectors of one length and their trees.

    Vectors with components beyond SMALL lie in blocks of their own (wide), as decimal text and without
    trees, and are compared one by one.
    """
    schema = StructType([StructField(f"{c}s", rows.select(F.array(c)).schema[0].dataType) for c in ("id", "label")])
    schema = schema.add("wide", "boolean").add("points", "binary").add("trees", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}

        def out(wide: bool, full: bool) -> Iterator[pa.RecordBatch]:
            while held[wide] and (sum(len(x[0]) for x in held[wide]) >= block or not full):
                got = held[wide]
                ids, labels = (pa.concat_arrays([x[c] for x in got]) for c in (0, 1))
                points = np.concatenate([x[2] for x in got])
                held[wide] = [(ids[block:], labels[block:], points[block:])] if len(ids) > block else []
                ids, labels, points = ids[:block], labels[:block], points[:block]
                if wide:
                    raw, packed = ",".join(map(str, points.ravel().tolist())).encode(), b""
                else:
                    raw, buffer = points.astype("<i4").tobytes(), io.BytesIO()
                    trees = [Tree(x) for x in np.split(points, parts, axis=1)]
                    np.savez(buffer, **{f"{k}_{name}": x for k, t in enumerate(trees) for name, x in t.pack().items()})
                    packed = buffer.getvalue()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([wide]), pa.array([raw], pa.binary()), pa.array([packed], pa.binary())], ["ids", "labels", "wide", "points", "trees"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            values = flat.reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                large = (np.abs(np.floor(values.astype(np.float64) * scale)) > SMALL).any(axis=1)
            for wide in (False, True):
                at = np.flatnonzero(large == wide)
                if len(at):
                    take = pa.array(at)
                    held[wide].append((batch.column("id").take(take), batch.column("label").take(take), integers(values[at], scale)))
                    yield from out(wide, True)
        for wide in (False, True):
            yield from out(wide, False)

    return rows.mapInArrow(run, schema)


def _points(wide: bool, raw: bytes, dims: int) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in raw.split(b",")] + [None], object)[:-1].reshape(-1, dims)
    return np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, dims)


def _trees(wide: bool, packed: bytes, parts: int) -> list[Tree | None]:
    if wide:
        return [None] * parts
    arrays = np.load(io.BytesIO(packed))
    return [Tree.unpack({name: arrays[f"{k}_{name}"] for name in Tree.names}) for k in range(parts)]


def limbs(value: int) -> list[int]:
    """value by powers of 2**LIMB, the highest with its sign: sums of limbs stay in 64 bits."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        value, low = divmod(value, 1 << LIMB)
        out.append(low)
    return [*out, value]


def one_round(blocks: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """The next codebooks: each entry the floor of the mean of its parts, unused ones as they were.

    A task adds up its blocks; of all tasks together, a number a component reaches the driver.
    """
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64).astype(object) for b in books]
        for batch in batches:
            for wide, raw, packed in zip(*(batch.column(c).to_pylist() for c in ("wide", "points", "trees"))):
                points = np.split(_points(wide, raw, dims), parts, axis=1)
                for k, tree in enumerate(_trees(wide, packed, parts)):
                    _, own, sums = _assign(tree, points[k], books[k])
                    n[k] += own
                    total[k] += sums
        rows = [(k, e, -1, 0, int(n[k][e])) for k in range(parts) for e in np.flatnonzero(n[k]).tolist()]
        for k, e, _, _, _ in list(rows):
            rows += [(k, e, i, j, x) for i, v in enumerate(total[k][e].tolist()) for j, x in enumerate(limbs(v)) if x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "entry", "place", "limb", "value"])

    got = blocks.select("wide", "points", "trees").mapInArrow(run, "part long, entry long, place long, limb long, value long")
    sums: dict[tuple[int, int, int], int] = {}
    for k, e, i, j, x in got.groupBy("part", "entry", "place", "limb").agg(F.sum("value")).collect():
        sums[k, e, i] = sums.get((k, e, i), 0) + (x << LIMB * j)
    out = []
    for k, book in enumerate(books):
        rows = []
        for e, old in enumerate(book.tolist()):
            used = sums.get((k, e, -1))
            rows.append([sums.get((k, e, i), 0) // used for i in range(len(old))] if used else old)
        out.append(as_book(rows))
    return out


def as_book(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= SMALL for r in rows for x in r)
    return np.array(rows, np.int64) if small else np.array(rows, object)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for r in b.tolist() for x in r).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every vector, and the codebooks.

    Components become floor(scale * x).  A codebook starts as that part of the `entries` vectors of
    smallest id (null ids last, equal ids by their components); in each round every part goes to its
    nearest entry by squared distance, ties to the lower index, and entries become the floor of the mean
    of their parts.  code: the entry of each part, two hex digits each; error: squared distances, held
    at the limit of a long.  Left out are vectors that are null or have a null or non-finite component,
    and those whose length isn't that of the smallest id whose length is a multiple of parts.  Fewer
    vectors than entries make smaller codebooks; without any there are no rows.  Null and repeated ids
    and repeated rows count as often as they occur; other columns don't matter.  Blocks and trees are
    written once; each round reads them.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits")
    rows = part_vectors(vectors, id_column, vector_column, label_column)
    rows = rows.where(f"size(v) > 0 and size(v) % {parts} = 0")
    smallest = lambda df, n: df.orderBy(F.col("id").asc_nulls_last(), "v").limit(n).select("v").collect()
    seeds = [r.v for r in smallest(rows, entries)]
    id_type, label_type = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = f"id {id_type}, label {label_type}, code string, error long"
    if not seeds:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    dims = len(seeds[0])
    rows = rows.where(F.size("v") == dims)
    if any(len(s) != dims for s in seeds):
        seeds = [r.v for r in smallest(rows, entries)]
    first = np.array([[exact_floor(x, scale) for x in s] for s in seeds], object)
    books = [as_book(x.tolist()) for x in np.split(first, parts, axis=1)]
    blocks = materialize(tree_blocks(rows, parts, scale, block), "tree_blocks")
    for _ in range(rounds):
        books = one_round(blocks, books, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{e:02x}" for e in range(256)])
        for batch in batches:
            for i, (wide, raw, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("wide", "points", "trees")))):
                points = np.split(_points(wide, raw, dims), parts, axis=1)
                codes, error = [], 0
                for k, tree in enumerate(_trees(wide, packed, parts)):
                    code, _, _ = _assign(tree, points[k], books[k])
                    exact = points[k].dtype == object or books[k].dtype == object
                    kind = object if exact or dims * (2 * SMALL) ** 2 > MOST else np.int64
                    error = error + ((points[k].astype(kind) - books[k].astype(kind)[code]) ** 2).sum(axis=1)
                    codes.append(digits[code])
                text = ["".join(x) for x in zip(*(c.tolist() for c in codes))]
                own = [batch.column(c)[i].values for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(text), pa.array([min(int(x), MOST) for x in error.tolist()], pa.int64())], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema), books


def with_label_errors(coded: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """coded with label_error: the errors of all rows of an equal label together, nulls too, held at the limit of a long.

    The totals are broadcast where they are at most max_broadcast rows, else joined by label.
    """
    coded = materialize(coded, "coded")
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = materialize(total.withColumnRenamed("label", "of"), "label_errors")
    few = total.count() <= max_broadcast
    return coded.join(F.broadcast(total) if few else total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
