"""Row keys, Arrow helpers and the word hashing that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that are hashed at once; bounds the working arrays of a task.
WINDOW_BYTES = 1 << 19
# Bytes of text that an operator's task takes up at once.
SLICE_BYTES = 1 << 20


def content_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes, ``__k1`` and ``__k2``, that stand for the values of a row."""
    return [
        F.xxhash64(F.lit(1), *cols).alias("__k1"),
        F.xxhash64(F.lit(2), *reversed(cols), F.lit(3)).alias("__k2"),
    ]


def spark_crc32(col: Column | str) -> Column:
    """CRC-32 of a value's text."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values one after another, and where each begins. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.empty(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[first:last], offsets - first


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        # Arrow would keep what it has freed
        pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def byte_values(kind: str) -> np.ndarray:
    """A random value for each byte of a word; 0 marks the bytes between words.

    ``words``: ASCII digits, letters and everything beyond ASCII, A-Z as a-z.
    ``chunks``: everything but ASCII white space, case kept.
    """
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if kind == "words":
        for b in range(0x41, 0x5B):
            values[b] = values[b + 0x20]
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    else:
        keep = np.ones(256, bool)
        keep[[9, 10, 11, 12, 13, 32]] = False
    values[~keep] = 0
    return values


def hash_words(data: np.ndarray, breaks: np.ndarray, kind: str = "words") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of each word of ``data``; no word goes over a place in ``breaks``."""
    values = byte_values(kind)
    n, at, parts = len(data), 0, []
    breaks = np.unique(breaks)
    while at < n:
        end = min(at + WINDOW_BYTES, n)
        if end < n:
            # cut at a break or behind a separator, so that no word is cut
            back = np.flatnonzero(values[data[at:end]] == 0)
            k = np.searchsorted(breaks, end, side="right") - 1
            cut = max(at + int(back[-1]) + 1 if len(back) else 0, int(breaks[k]) if k >= 0 else 0)
            while cut <= at:
                later = np.flatnonzero(values[data[end : end + WINDOW_BYTES]] == 0)
                k = np.searchsorted(breaks, end)
                edge = int(breaks[k]) if k < len(breaks) else n
                if len(later):
                    cut = min(end + int(later[0]) + 1, edge)
                elif end + WINDOW_BYTES >= edge:
                    cut = edge
                else:
                    end += WINDOW_BYTES
            end = cut
        v = values[data[at:end]]
        inside = v != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        here = breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, end)] - at
        first[here] |= inside[here]
        start = np.flatnonzero(first)
        if len(start):
            size = max(WINDOW_BYTES, 1 << int(end - at - 1).bit_length())
            power, inverse = _powers(size)
            sums = np.cumsum(v * power[: len(v)], dtype=np.uint64)
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            edge = here[here > 0] - 1
            last[edge] |= inside[edge]
            stop = np.flatnonzero(last)
            before = np.where(start > 0, sums[start - 1], np.uint64(0))
            h = mix((sums[stop] - before) * inverse[start])
            parts.append((start + at, stop + 1 + at, h))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def words_of_rows(col: pa.Array, kind: str = "words") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, where its words begin (one place more at the end)."""
    data, offsets = text_buffer(col)
    start, _, h = hash_words(data, offsets[:-1], kind)
    return h, np.searchsorted(start, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``; empty segments give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys``, each as one table."""
    held: list[pa.Table] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            this = tuple(c[a] for c in cols)
            if held and this != name:
                yield pa.concat_tables(held)
                held = []
            name = this
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)
