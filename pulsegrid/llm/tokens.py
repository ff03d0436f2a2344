"""Token ids of whole texts, made by a public tokenizer inside Spark tasks.

The tokenizer works on pieces that never reach over white space, so a text's
ids are those of its chunks one after another. A worker keeps the ids of the
chunks it has met; only new chunks go through the tokenizer. Where a chunk is
cut from the full stops and commas around it, the character on the other side
is a letter or digit, with which they never share a piece.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from pulsegrid.llm.common import hash_words, ranges, text_buffer

# A worker starts its memory of chunks anew beyond this number.
MAX_CHUNKS = 2_000_000

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True


def chunk_breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places besides white space at which texts may be cut without changing their ids."""
    mark = np.flatnonzero(_MARK[data])
    n = len(data)
    # Latin letters of two bytes: C3 80-BF without the signs for times (97) and divided by (B7).
    tail = (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    before = mark[mark > 0]
    left = _ALNUM[data[before - 1]] | ((before > 1) & tail[before - 1] & (data[np.maximum(before - 2, 0)] == 0xC3))
    after = mark[mark < n - 1] + 1
    follow = np.minimum(after + 1, n - 1)
    right = _ALNUM[data[after]] | ((data[after] == 0xC3) & (after < n - 1) & tail[follow])
    return np.concatenate((offsets[:-1], before[left], after[right]))


class Encoder:
    """Encodes columns of text; ``ids`` of all rows lie one after another."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int32)
        self.lengths = np.empty(0, np.int32)
        self.pool = np.empty(0, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        mask = np.int64(len(self.table) - 1)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.table[at]
        if not len(self.keys):
            return entry
        todo = np.flatnonzero((entry >= 0) & (self.keys[entry] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            entry[todo] = self.table[at[todo]]
            e = entry[todo]
            todo = todo[(e >= 0) & (self.keys[e] != h[todo])]
        return entry

    def _place(self, first: int) -> None:
        mask = np.int64(len(self.table) - 1)
        number = np.arange(first, len(self.keys), dtype=np.int32)
        at = (self.keys[first:] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.table[at] < 0)
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], (at[left] + 1) & mask

    def _add(self, h: np.ndarray, chunks: list[str]) -> None:
        # A chunk of ASCII letters is one piece as it stands, so only the model has to see it.
        coded = [[t.id for t in self.model.tokenize(c.lower())] if c.isascii() and c.isalpha() else None for c in chunks]
        rest = [k for k, c in enumerate(coded) if c is None]
        encodings = self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)
        for k, e in zip(rest, encodings):
            coded[k] = e.ids
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter((i for c in coded for i in c), np.uint32, int(lengths.sum()))
        begin = len(self.pool) + np.concatenate(([0], np.cumsum(lengths)[:-1]))
        old = len(self.keys)
        self.keys = np.concatenate((self.keys, h))
        self.starts = np.concatenate((self.starts, begin.astype(np.int32)))
        self.lengths = np.concatenate((self.lengths, lengths.astype(np.int32)))
        self.pool = np.concatenate((self.pool, ids))
        if len(self.keys) * 2 > len(self.table):
            while len(self.keys) * 2 > (1 << self.bits):
                self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            old = 0
        self._place(old)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, for each row, where its ids begin (one place more at the end)."""
        data, offsets = text_buffer(col)
        start, stop, h = hash_words(data, chunk_breaks(data, offsets), "chunks")
        if len(self.keys) > MAX_CHUNKS:
            self.clear()
        entry = self._find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            raw = data.tobytes()
            self._add(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), stop[at].tolist())])
            entry[missing] = self._find(h[missing])
        lengths = self.lengths[entry]
        ids = self.pool[ranges(self.starts[entry], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        return ids, ends[np.searchsorted(start, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each row's, and the new bounds."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.uint32)
    new = bounds + np.arange(n + 1)
    last = new[1:] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end_id
    return out, new
