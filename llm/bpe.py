"""Byte-pair encoding and decoding by batched numpy merge rounds.

The words that are new to a worker lie in one flat array of symbols.  A round looks up the pair at
every place by binary search over sorted pair keys, finds each word's lowest rank, and merges that
pair wherever it stands in the word, from left to right.  Finished words leave the array.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from llm.common import slices
from llm.encoding import BYTES, default_tokenizer

#: How a byte-level pre-tokenizer cuts a text.  Fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside white space.
UNSAFE = regex.compile(r"\s\s")
_CODECS: dict[str, "MergeCodec"] = {}


def codec(path: str) -> "MergeCodec":
    if path not in _CODECS:
        _CODECS[path] = MergeCodec(path)
    return _CODECS[path]


class MergeCodec:
    def __init__(self, path: str, max_words: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        letters = {b: BYTES.get(b, b) for b in range(256)}
        self.first = np.array([vocab[chr(letters[b])] for b in range(256)], dtype=np.int64)
        back = {chr(c): b for b, c in letters.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.max_words = max_words
        self.spaced: dict[str, tuple[str, int, bytes]] = {}
        self.bare: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of each word; words are what the pre-tokenizer cuts, as UTF-8."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        last = len(self.keys)
        while len(sym):
            key = np.append(sym[:-1] * self.size + sym[1:], -1)
            key[:-1][word[:-1] != word[1:]] = -1
            at = np.searchsorted(self.keys, key)
            at[at == last] = 0
            rank = np.where(self.keys[at] == key, self.ranks[at], last)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            done = best == last
            if done.any():
                whole = np.flatnonzero(done[starts])
                for s, n in zip(starts[whole].tolist(), lengths[whole].tolist()):
                    out[word[s]] = sym[s : s + n]
                sym, word, rank, best = sym[~done], word[~done], rank[~done], best[~done]
                if not len(sym):
                    break
            hit = rank == best
            # a pair of equal symbols can overlap itself: of a run of hits every second one counts
            run = np.flatnonzero(hit)
            head = np.r_[True, np.diff(run) != 1]
            place = np.arange(len(run)) - np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))
            run = run[place % 2 == 0]
            sym[run] = self.merged[rank[run]]
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def _entries(self, pieces: list[list[str]]) -> list[tuple[str, int, bytes]]:
        """For each list of pieces: decimal ids joined by commas, their number, the bytes they decode to."""
        ids = self.merge([x.encode() for p in pieces for x in p])
        out, k, of = [], 0, self.bytes_of
        for p in pieces:
            own = [i for x in ids[k : k + len(p)] for i in x.tolist()]
            k += len(p)
            out.append((",".join(map(str, own)), len(own), b"".join([of[i] for i in own])))
        return out

    def _learn(self, known: dict, words: set[str], lead: str) -> None:
        fresh = [w for w in words if w not in known]
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            known.update(zip(part, self._entries([[lead + w] if w.isalpha() else PIECES.findall(lead + w) for w in part])))

    def _odd(self, text: str) -> list[tuple[str, int, bytes]]:
        """A text with added tokens or runs of white space."""
        out, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            out.append(PIECES.findall(text[at : m.start()]))
            out.append(self.added[m[0]])
            at = m.end()
        out.append(PIECES.findall(text[at:]))
        done = iter(self._entries([x for x in out if isinstance(x, list)]))
        return [next(done) if isinstance(x, list) else (str(x), 1, self.bytes_of[x]) for x in out]

    def encode_parts(self, texts: list[str | None]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text the entries of its parts, in order.  Null counts as empty."""
        if len(self.spaced) + len(self.bare) > self.max_words:
            self.spaced.clear()
            self.bare.clear()
        split: list[list[list[str]] | None] = []
        for text in texts:
            odd = text and (UNSAFE.search(text) or text[0].isspace() or text[-1].isspace() or any(x in text for x in self.added))
            split.append(None if odd else [line.split(" ") for line in (text or "").split("\n")])
        self._learn(self.spaced, {w for lines in split if lines for line in lines for w in line[1:]}, " ")
        self._learn(self.bare, {line[0] for lines in split if lines for line in lines}, "")
        end = self._entries([["\n"]])[0]
        for text, lines in zip(texts, split):
            if lines is None:
                yield self._odd(text)
                continue
            parts = []
            for k, line in enumerate(lines):
                if k:
                    parts.append(end)
                parts.append(self.bare[line[0]])
                parts.extend(map(self.spaced.__getitem__, line[1:]))
            yield parts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for p in parts if p[1] for i in p[0].split(",")] for parts in self.encode_parts(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


def encode_digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256).

    A null or empty text has no ids; its digests are those of the empty string.  Null ids and
    repeated rows are kept, a row for a row; other columns of df don't matter.
    """
    path = tokenizer_path or default_tokenizer()
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids, back = [], [], []
                for parts in own.encode_parts(part.column("text").to_pylist()):
                    n.append(sum([p[1] for p in parts]))
                    ids.append(hashlib.sha256(",".join([p[0] for p in parts if p[1]]).encode()).hexdigest())
                    raw = b"".join([p[2] for p in parts])
                    back.append(hashlib.sha256(raw.decode("utf-8", errors="replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def encode_ids(df: DataFrame, text_column: str = "text", ids_column: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """df with its encoded ids as one more column, an array of int; a column of that name is replaced.

    A null or empty text has no ids; rows stay as they are, repeated ones and those of null ids too.
    """
    path = tokenizer_path or default_tokenizer()
    names = [c for c in df.columns if c != ids_column]
    rows = df.select(*names)
    schema = StructType([*rows.schema.fields, StructField(ids_column, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch, text_column):
                ids = own.encode(part.column(text_column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, ids_column])

    return rows.mapInArrow(run, schema)
