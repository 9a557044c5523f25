"""Whole-text encoding with the tokenizers library, each distinct word once.

A byte-level pre-tokenizer always starts a new piece at a space or newline that stands alone between
two characters that are no white space, a newline there is a piece of its own, and merges never cross
pieces.  So the ids of a text are those of its words, one after the other.  Arrow cuts a batch of
texts into words and finds the distinct ones; those that a worker has not met before go to the
library's BPE model if they are plain, else through the whole library.  Texts with any other run of
white space, or with the string of an added token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any white space, as broad as any library counts it.  Fixed values.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts that are not cut into words: white space beside white space or at an end, or the mark of a first word.
UNSAFE = f"{BLANK}{BLANK}|^{BLANK}|{BLANK}$|\\x00"
FIRST = "\x00"
#: Words of printable ASCII, and how the pre-tokenizer cuts them, after an optional space.  Fixed values.
PLAIN = re.compile(r"[!-~]+")
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~']+")
#: Byte-level alphabet: bytes that print stand for themselves, the others for U+0100 and on, in order.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}
_ENCODERS: dict[str, "TextEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "TextEncoder":
    """One per Python worker, so that its cache serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


class Words(dict):
    """ids of words as bytes; a word that is missing is encoded, and kept while there is room."""

    def __init__(self, owner: "TextEncoder", room: int):
        self.owner, self.room, self.tokenize = owner, room, owner.tokenizer.model.tokenize

    def __missing__(self, w: str) -> bytes:
        if w.isalpha() and w.isascii():
            ids = array("I", [t.id for t in self.tokenize("\u0120" + w)]).tobytes()
        else:
            ids = self.owner.word(w)
        if len(self) < self.room:
            self[w] = ids
        return ids


class TextEncoder:
    """ids of texts, equal to encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, max_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.words = Words(self, max_words)
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.simple = level and not spec.get("normalizer") and not spec.get("post_processor") and spec["model"]["type"] == "BPE" and len(newline) == 1
        self.newline = array("I", newline).tobytes()
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        self.unsafe = "|".join([UNSAFE, *added])
        self.model = self.tokenizer.model

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def word(self, w: str) -> bytes:
        """ids of a word: after a space, or the first of a text (marked), or behind a newline."""
        model, mark = self.model.tokenize, "\u0120"
        if w[:1] == FIRST or w[:1] == "\n":
            before, w, lead = (b"" if w[0] == FIRST else self.newline), w[1:], ""
        else:
            before, lead = b"", " "
        if w.isalpha() and w.isascii():
            tokens = model(mark + w if lead else w)
        elif PLAIN.fullmatch(w):
            tokens = [t for x in CUTS.findall(lead + w) for t in model(mark + x[1:] if x[0] == " " else x)]
        elif w.isalpha() and max(w) < "\u0250":
            tokens = model((mark if lead else "") + w.encode().decode("latin-1").translate(BYTES))
        else:
            return before + self._raw(lead + w)
        return before + array("I", [t.id for t in tokens]).tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more at the end).  Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False) if self.simple else np.ones(n, bool)
        odd |= pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        plain = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        pieces = pc.split_pattern(pc.binary_join_element_wise(FIRST, plain, ""), " ")
        distinct = pieces.flatten().dictionary_encode()
        if isinstance(distinct, pa.ChunkedArray):
            distinct = distinct.combine_chunks()
        own = list(map(self.words.__getitem__, distinct.dictionary.to_numpy(zero_copy_only=False)))
        # texts that went to the library whole are words of their own, behind the others
        place = np.flatnonzero(odd)
        own += [self._raw(t) for t in texts.take(pa.array(place)).to_pylist()]
        index = distinct.indices.to_numpy()
        counts = np.ones(n, np.int64)
        counts[~odd] = np.diff(pieces.offsets.to_numpy())
        word = np.empty(int(counts.sum()), np.int64)
        starts = np.r_[0, np.cumsum(counts)]
        whole = np.zeros(len(word), bool)
        whole[starts[:-1][place]] = True
        word[~whole] = index
        word[whole] = np.arange(len(place)) + len(own) - len(place)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        blob, begin = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        each = size[word]
        ends = np.r_[0, np.cumsum(each)]
        at = np.repeat(begin[word] - ends[:-1], each)
        at += np.arange(len(at))
        return blob[at], ends[starts]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
