"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both tokenizers encode a text; byte offsets where a token of each ends cut it into groups, and every
token of one side is linked with every token of the other side in its group.  An index of the corpus
holds, for each pair of ids, which documents have it linked: documents are numbered in chunks, and a
pair's documents in a chunk are compressed bitmaps, one plane for each binary digit of the number of
links.  The planes or-ed together are the pair's documents, and their bits are counted; weighted by
their places they give the links.  Counts are added up by pair, the best partner of each id is found,
and the scores go back to the chunks, whose planes say which documents get them and how often.

Neither tokenizer merges over a space or newline that stands alone between other characters, so a text
is cut there into units, and each distinct unit is aligned once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import materialize, slices
from llm.encoding import BLANK, BYTES, TextEncoder

#: White space as Python's patterns write it; a unit that is no plain word is marked by RAW.  Fixed values.
BLANKS = re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), BLANK)
CUT = re.compile(f"(?<={BLANKS.replace('[', '[^', 1)})(?=[ \\n]{BLANKS.replace('[', '[^', 1)})")
ODD = f"{BLANK}{BLANK}|^{BLANK}|{BLANK}$|\\x00"
RAW = "\x00"
#: Bucket of the rows of documents: behind all others.
LAST = (1 << 31) - 1
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligner(paths: tuple[str, str]) -> "Aligner":
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def units_of(text: str) -> list[str]:
    """Units of a space and a text: a plain word for itself with the space before it, a line's first word with its newline, others marked."""
    out = []
    for x in CUT.split(" " + text):
        if x[0] == "\n" and RAW not in x and not re.search(BLANKS, x[1:]):
            out.append(x)
        elif x[0] == " " and RAW not in x and not re.search(BLANKS, x[1:]):
            out.append(x[1:])
        else:
            out.append(RAW + x)
    return out


class Aligner:
    """Alignments of the units that a worker has met, in flat arrays.

    Of unit u: na, nb, ng, nl (tokens of each side, groups, links), good (both sides give the unit's
    bytes back), text (its groups as text), and pairs (key and links) from start[u] to start[u + 1].
    """

    def __init__(self, a_path: str, b_path: str, room: int = 300_000):
        import json

        from sentencepiece import SentencePieceProcessor

        self.a = TextEncoder(a_path)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {chr(BYTES.get(b, b)): b for b in range(256)}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in back for c in t):
                self.a_bytes[i] = bytes(back[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        # no piece has a space behind another character, and none but a byte a newline: units can be encoded alone
        self.simple = self.a.simple and not any(re.search("[^\u2581]\u2581|\n", p) for p in pieces)
        self.space = self.b.piece_to_id("\u2581")
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.n_b = len(self.b_bytes)
        self.numbers = [f"{i}{x}" for i in range(max(len(self.a_bytes), self.n_b)) for x in (",", "|", ";", "")]
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # na, nb, ng, nl, good
        self.start = np.zeros(1, np.int64)
        self.pair = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def encode_a(self, unit: str) -> bytes:
        return self.a.word(unit)

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of the units; the processor puts a space before what it gets, which a newline's unit doesn't have."""
        bare = [u[1:] if u[0] == RAW else u for u in units]
        strip = [u[0] == "\n" for u in bare]
        got = self.b.encode([u[1:] if u[0] == " " else u for u in bare], num_threads=1)
        return [g[1:] if s and g[0] == self.space else g for s, g in zip(strip, got)]

    def learn(self, units: list[str]) -> None:
        """Align units that are not known yet."""
        n = len(units)
        raw_a, ids_b = list(map(self.encode_a, units)), self.encode_b(units)
        n_a = np.fromiter(map(len, raw_a), np.int64, n) // 4
        n_b = np.fromiter(map(len, ids_b), np.int64, n)
        a = np.frombuffer(b"".join(raw_a), "<u4").astype(np.int64)
        b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
        plain = [(u[1:] if u[0] == RAW else u if u[0] == "\n" else " " + u).encode() for u in units]
        good = np.ones(n, bool)
        for ids, count, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            whole = list(map(table.__getitem__, ids.tolist()))
            if b"".join(whole) != b"".join(plain) or not np.array_equal(self._lengths(ids, count, table is self.b_bytes), [len(x) for x in plain]):
                ends = np.r_[0, np.cumsum(count)].tolist()
                good &= [b"".join(whole[s:e]) == x for s, e, x in zip(ends, ends[1:], plain)]
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        n_a, n_b = n_a * good, n_b * good
        a, b = a[keep_a], b[keep_b]
        unit_a = np.repeat(np.arange(n), n_a)
        # offsets run on through all units, so their ends are common ends too
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        count_a, count_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        unit_of = np.zeros(len(cut), np.int64)
        unit_of[group_a] = unit_a
        ng = np.bincount(unit_of, minlength=n)
        nl = np.bincount(unit_of, count_a * count_b, minlength=n).astype(np.int64)
        self._add_texts(n, a, b, group_a, group_b, count_a, count_b, unit_of)
        pair_unit, pair, links = self._pairs(a, b, count_a, count_b, unit_of)
        self.facts = np.r_[self.facts, np.stack([n_a, n_b, ng, nl, good], axis=1)]
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(np.bincount(pair_unit, minlength=n))]
        self.pair, self.links = np.r_[self.pair, pair], np.r_[self.links, links]
        self.known.update(zip(units, range(len(self.known), len(self.known) + n)))

    def _lengths(self, ids: np.ndarray, count: np.ndarray, side: bool) -> np.ndarray:
        total = np.r_[0, np.cumsum(self.sizes[int(side)][ids])]
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def _add_texts(self, n: int, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, unit_of: np.ndarray) -> None:
        """Decimal ids with what stands behind each: , in a side, | between sides, ; between groups, nothing at a unit's end."""
        last_a = np.r_[group_a[1:] != group_a[:-1], True][: len(a)]
        last_b = np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
        final = np.r_[unit_of[1:] != unit_of[:-1], True][: len(unit_of)]
        mark_a = np.where(last_a, 1, 0)
        mark_b = np.where(last_b, np.where(final[group_b], 3, 2), 0)
        at = np.argsort(np.r_[group_a * 2, group_b * 2 + 1], kind="stable")
        words = list(map(self.numbers.__getitem__, np.r_[a * 4 + mark_a, b * 4 + mark_b][at].tolist()))
        ends = np.r_[0, np.cumsum(np.bincount(unit_of, count_a + count_b, minlength=n).astype(np.int64))].tolist()
        self.text += ["".join(words[s:e]) for s, e in zip(ends, ends[1:])]

    def _pairs(self, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, links) of all groups; large ones by their distinct ids."""
        begin_a, begin_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        size = count_a * count_b
        large = size > 4096
        of = np.repeat(np.flatnonzero(~large), size[~large])
        place = np.arange(len(of)) - np.repeat(np.cumsum(size[~large]) - size[~large], size[~large])
        pair = a[begin_a[of] + place // count_b[of]] * self.n_b + b[begin_b[of] + place % count_b[of]]
        parts = [(unit_of[of], pair, np.ones(len(of), np.int64))]
        for g in np.flatnonzero(large).tolist():
            x, nx = np.unique(a[begin_a[g] : begin_a[g] + count_a[g]], return_counts=True)
            y, ny = np.unique(b[begin_b[g] : begin_b[g] + count_b[g]], return_counts=True)
            parts.append((np.full(len(x) * len(y), unit_of[g]), np.add.outer(x * self.n_b, y).ravel(), np.multiply.outer(nx, ny).ravel()))
        unit, pair, links = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((pair, unit))
        unit, pair, links = unit[order], pair[order], links[order]
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])][: len(unit)])
        return unit[first], pair[first], np.add.reduceat(links, first) if len(first) else links

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after the other, and how many each text has; unknown ones are learnt."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not self.simple:
            odd = full
        easy = np.flatnonzero(full & ~odd)
        pieces = pc.split_pattern(pc.replace_substring(texts.take(pa.array(easy)), "\n", " \n"), " ")
        distinct = pieces.flatten().dictionary_encode()
        if isinstance(distinct, pa.ChunkedArray):
            distinct = distinct.combine_chunks()
        words = distinct.dictionary.to_pylist()
        own = {k: units_of(t) if self.simple else [RAW + " " + t] for k, t in zip(np.flatnonzero(full & odd).tolist(), texts.take(pa.array(np.flatnonzero(full & odd))).to_pylist())}
        fresh = list({w: None for w in words if w not in self.known} | {w: None for x in own.values() for w in x if w not in self.known})
        for k in range(0, len(fresh), 20_000):
            self.learn(fresh[k : k + 20_000])
        table = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = np.zeros(n, np.int64)
        counts[easy] = np.diff(pieces.offsets.to_numpy())
        for k, x in own.items():
            counts[k] = len(x)
        out = np.empty(int(counts.sum()), np.int64)
        place = np.repeat(np.isin(np.arange(n), easy), counts)
        out[place] = table[distinct.indices.to_numpy()]
        begin = np.cumsum(counts) - counts
        for k, x in own.items():
            out[begin[k] : begin[k] + len(x)] = [self.known[w] for w in x]
        return out, counts


def encode_plane(counts: np.ndarray, lows: np.ndarray, width: int) -> bytes:
    """Containers of documents: counts[p] of the rising lows belong to pair p; long lists become bitmaps of width bits."""
    dense = counts * 16 > width
    at = np.repeat(dense, counts)
    rows = np.repeat(np.arange(int(dense.sum())), counts[dense])
    bits = np.zeros((int(dense.sum()), width), bool)
    bits[rows, lows[at]] = True
    return counts.astype("<u2").tobytes() + lows[~at].astype("<u2").tobytes() + np.packbits(bits, axis=1, bitorder="little").tobytes()


def decode_plane(raw: bytes, pairs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """counts and lows of a plane as encode_plane() got them."""
    counts = np.frombuffer(raw, "<u2", pairs).astype(np.int64)
    dense = counts * 16 > width
    n = int(counts[~dense].sum())
    out = np.empty(int(counts.sum()), np.int64)
    at = np.repeat(dense, counts)
    out[~at] = np.frombuffer(raw, "<u2", n, 2 * pairs)
    step = -(-width // 8)
    bits = np.frombuffer(raw, np.uint8, int(dense.sum()) * step, 2 * (pairs + n)).reshape(-1, step)
    out[at] = np.nonzero(np.unpackbits(bits, axis=1, count=width, bitorder="little"))[1]
    return counts, out


def whole(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


class Chunk:
    """Documents of one chunk and what they link, until it is written."""

    def __init__(self, number: int):
        self.number, self.width = number, 0
        self.low: list[np.ndarray] = []
        self.unit: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, units: np.ndarray, counts: np.ndarray) -> None:
        low = np.repeat(np.arange(len(counts)) + self.width, counts)
        key, times = np.unique(low << 32 | units, return_counts=True)
        self.low.append(key >> 32)
        self.unit.append(key & 0xFFFFFFFF)
        self.times.append(times)
        self.width += len(counts)

    def segments(self, own: Aligner, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, list[bytes]]]:
        """(bucket, pairs, documents, links, planes) of each bucket: all batches of the chunk or-ed together."""
        low, unit, times = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (self.low, self.unit, self.times))
        begin, size = own.start[unit], own.start[unit + 1] - own.start[unit]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair, links, low = own.pair[at], own.links[at] * np.repeat(times, size), np.repeat(low, size)
        if not len(pair):
            return
        # one sort by bucket, pair and document; an id's pairs share a bucket
        bucket = bucket_of(pair // own.n_b, buckets)
        order = np.lexsort((pair << 16 | low, bucket))
        bucket, pair, links, low = bucket[order], pair[order], links[order], low[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (low[1:] != low[:-1])])
        bucket, pair, low, links = bucket[first], pair[first], low[first], np.add.reduceat(links, first)
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])  # of each pair
        docs, total = np.diff(np.r_[begin, len(pair)]), np.add.reduceat(links, begin)
        head = bucket[begin]
        cuts = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True][: len(head) + 1])
        bits = [(k, links >> k & 1) for k in range(int(links.max()).bit_length())]
        in_plane = [(k, np.add.reduceat(b, begin), b.astype(bool)) for k, b in bits]
        ends = np.r_[begin, len(pair)]
        for s, e in zip(cuts, cuts[1:]):
            planes = []
            for _, counts, has in in_plane:
                part = slice(ends[s], ends[e])
                planes.append(encode_plane(counts[s:e], low[part][has[part]], self.width) if counts[s:e].any() else b"")
            yield int(head[s]), whole(pair[begin[s:e]]), whole(docs[s:e]), whole(total[s:e]), planes


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids * 2654435761 % (1 << 32) >> 7) % buckets


FACTS = "id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def index(docs: DataFrame, id_column: str, text_column: str, buckets: int, paths: tuple[str, str], chunk_docs: int, chunk_bytes: int) -> DataFrame:
    """The inverted index: rows of segments (chunk, bucket, pairs, docs, links, planes, width) and of documents (chunk, bucket LAST, low, facts)."""
    id_type = docs.schema[id_column].dataType.simpleString()
    names = ["chunk", "bucket", "low", "width", "pairs", "docs", "links", "planes", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"chunk long, bucket int, low int, width int, pairs binary, docs binary, links binary, planes array<binary>, {FACTS.format(id_type)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held, chunk = aligner(paths), TaskContext.get().partitionId() << 24, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            rows = list(chunk.segments(own, buckets))
            for k in range(0, len(rows), 256):
                part = list(zip(*rows[k : k + 256]))
                n = len(part[0])
                cols = [pa.array([chunk.number] * n), pa.array(part[0], pa.int32()), pa.nulls(n, pa.int32()), pa.array([chunk.width] * n, pa.int32()), *(pa.array(c, pa.binary()) for c in part[1:4]), pa.array(part[4], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, id_arrow), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string())], names)
            if len(own.known) > own.room:
                own.clear()

        for batch in batches:
            id_arrow = batch.column("id").type
            for part in slices(batch, "text"):
                for k in range(0, part.num_rows, chunk_docs):
                    piece = part.slice(k, chunk_docs)
                    size = int(pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0)
                    if chunk and (chunk.width + piece.num_rows > chunk_docs or held + size > chunk_bytes):
                        yield from close()
                        chunk, number, held = None, number + 1, 0
                    if chunk is None:
                        chunk = Chunk(number)
                    held += size
                    units, counts = own.units(piece.column("text"))
                    n, doc = piece.num_rows, np.repeat(np.arange(piece.num_rows), counts)
                    bad = np.bincount(doc, own.facts[units, 4] == 0, minlength=n) > 0
                    keep = ~bad[doc]
                    units, counts, doc = units[keep], np.where(bad, 0, counts), doc[keep]
                    facts = [pa.array(np.bincount(doc, own.facts[units, c], minlength=n).astype(np.int64)) for c in range(4)]
                    texts, ends = list(map(own.text.__getitem__, units.tolist())), np.r_[0, np.cumsum(counts)].tolist()
                    sha = [hashlib.sha256(";".join(texts[s:e]).encode()).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]
                    low = np.arange(n, dtype=np.int32) + chunk.width
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.number] * n), pa.array([LAST] * n, pa.int32()), pa.array(low), *[pa.nulls(n, pa.int32())], *[pa.nulls(n, pa.binary())] * 3, pa.nulls(n, pa.list_(pa.binary())), piece.column("id"), *facts, pa.array(sha)], names)
                    chunk.add(units, counts)
        if chunk:
            yield from close()

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, schema)


def numbers(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8")


def merged(pair: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs, rising, and the sums of their values."""
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    return (pair[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def pair_counts(segments: DataFrame, n_b: int, most: int = 2_000_000) -> DataFrame:
    """(bucket, pairs, docs, links, best): the counts of a bucket's pairs over all chunks, and whether each is its first id's most frequent one.

    A task goes through its buckets one after the other and holds the distinct pairs of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def fold() -> list:
            return [merged(*(np.concatenate(c) for c in zip(*held)))]

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            pair, docs, links = fold()[0]
            head = np.flatnonzero(np.r_[True, pair[1:] // n_b != pair[:-1] // n_b])
            best = docs == np.repeat(np.maximum.reduceat(docs, head), np.diff(np.r_[head, len(pair)]))
            cols = [pa.array([bucket], pa.int32()), *(pa.array([whole(x)], pa.binary()) for x in (pair, docs, links)), pa.array([best.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "pairs", "docs", "links", "best"])

        for batch in batches:
            for b, *raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pairs", "docs", "links"))):
                if b != bucket:
                    yield from out()
                    bucket, held, size = b, [], 0
                held.append(tuple(map(numbers, raw)))
                size += len(held[-1][0])
                if size > most:
                    held = fold()
                    size = 0
        yield from out()

    rows = segments.select("bucket", "pairs", "docs", "links").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "bucket int, pairs binary, docs binary, links binary, best binary")


def returned_scores(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, bucket, scores, best): for each segment the counts of its pairs, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = docs = best = None
        for batch in batches:
            out = []
            for kind, chunk, bucket, pairs, count, flag in zip(*(batch.column(c).to_pylist() for c in ("kind", "chunk", "bucket", "pairs", "docs", "best"))):
                if kind == 0:
                    pair, docs, best = numbers(pairs), numbers(count), np.frombuffer(flag, bool)
                else:
                    at = np.searchsorted(pair, numbers(pairs))
                    out.append((chunk, bucket, whole(docs[at]), best[at].tobytes()))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())], ["chunk", "bucket", "docs", "best"])

    none = F.lit(None)
    first = counts.select(F.lit(0).alias("kind"), none.cast("long").alias("chunk"), "bucket", "pairs", "docs", "best")
    rest = segments.select(F.lit(1).alias("kind"), "chunk", "bucket", "pairs", none.cast("binary").alias("docs"), none.cast("binary").alias("best"))
    rows = first.unionByName(rest).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(run, "chunk long, bucket int, docs binary, best binary")


def scored(rows: DataFrame, scores: DataFrame, id_type: str) -> DataFrame:
    """Documents with n_best and count_sum: a chunk's segments, each behind its scores, then its documents."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total, most, docs, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            numbers_of = batch.column("chunk").to_numpy(zero_copy_only=False)
            rank = np.r_[0, np.cumsum((kinds[1:] == 2) & (kinds[:-1] == 2) & (numbers_of[1:] == numbers_of[:-1]) ^ True)][: len(kinds)] if len(kinds) else kinds
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True][: len(kinds) + 1])
            for s, e in zip(cuts, cuts[1:]):
                if numbers_of[s] != chunk:
                    chunk, total, most = int(numbers_of[s]), np.zeros(0, np.int64), np.zeros(0, np.int64)
                part = batch.slice(s, e - s)
                if kinds[s] == 0:
                    docs, best = numbers(part.column("docs")[0].as_py()), np.frombuffer(part.column("best")[0].as_py(), bool)
                elif kinds[s] == 1:
                    width = part.column("width")[0].as_py()
                    if len(total) < width:
                        total, most = np.r_[total, np.zeros(width - len(total), np.int64)], np.r_[most, np.zeros(width - len(most), np.int64)]
                    for k, plane in enumerate(part.column("planes")[0].as_py()):
                        if plane:
                            counts, low = decode_plane(plane, len(docs), width)
                            np.add.at(total, low, np.repeat(docs << k, counts))
                            most += np.bincount(low[np.repeat(best, counts)], minlength=len(most)) << k
                else:
                    low = part.column("low").to_numpy(zero_copy_only=False)
                    short = max(0, int(low.max()) + 1 - len(total))
                    total, most = np.r_[total, np.zeros(short, np.int64)], np.r_[most, np.zeros(short, np.int64)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(most[low]), pa.array(total[low])], [*names, "n_best", "count_sum"])

    none = F.lit(None)
    wanted = ["kind", "chunk", "bucket", "low", "width", "planes", "docs", "best", *names]
    kind = F.when(F.col("bucket") == LAST, 2).otherwise(1)
    one = rows.withColumn("kind", kind).withColumn("docs", none.cast("binary")).withColumn("best", none.cast("binary"))
    two = scores.withColumns({"kind": F.lit(0)} | {c: none.cast(rows.schema[c].dataType) for c in ("low", "width", "planes", *names)})
    all_rows = one.select(wanted).union(two.select(wanted)).repartition("chunk").sortWithinPartitions("chunk", "bucket", "kind")
    return all_rows.mapInArrow(run, f"{FACTS.format(id_type)}, n_best long, count_sum long")


def align(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str] | None = None, buckets: int | None = None, chunk_docs: int = 4096, chunk_bytes: int = 32 << 20
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    paths: a byte-level BPE of the tokenizers library and a sentencepiece model, which puts a space
    before a text; the first gets that space written out.  n_links: pairs of tokens that share a group;
    count_sum: for each of them, how many documents of the corpus have its ids linked; n_best: those
    whose count is the highest that their first id has with any.  Null and empty texts, and texts that
    one tokenizer can't give back, have no tokens: zeros and an empty digest.  Every row is a document
    of its own, with a null or repeated id too; whole texts are aligned, however long; an empty table
    gives no rows; other columns don't matter.  buckets, by default as many as shuffle partitions, up
    to 4096, deal the ids of the first tokenizer; a chunk has at most chunk_docs documents (65,535 at
    most) and closes at about chunk_bytes of text.
    """
    spark = docs.sparkSession
    buckets = buckets or max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    paths = paths or default_paths()
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = materialize(index(docs, id_column, text_column, buckets, paths, min(chunk_docs, 65_535), chunk_bytes), "pair_index")
    segments = rows.where(F.col("bucket") != LAST)
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    counts = materialize(pair_counts(segments, n_b), "pair_counts")
    scores = returned_scores(segments, counts)
    out = scored(rows, scores, id_type)
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(names).withColumnRenamed("id", id_column)


def pair_table(counts: DataFrame, n_b: int) -> DataFrame:
    """(a, b, n_docs, n_links, best): the counts of pair_counts() with a row a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, docs, links, best in zip(*(batch.column(c).to_pylist() for c in ("pairs", "docs", "links", "best"))):
                pair = numbers(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pair // n_b), pa.array(pair % n_b), pa.array(numbers(docs)), pa.array(numbers(links)), pa.array(np.frombuffer(best, bool))], ["a", "b", "n_docs", "n_links", "best"])

    return counts.select("pairs", "docs", "links", "best").mapInArrow(run, "a long, b long, n_docs long, n_links long, best boolean")
