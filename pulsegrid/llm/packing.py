"""Best-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegrid.llm.common import slices
from pulsegrid.llm.tokens import encoder, with_end
from pulsegrid.session import freeze


def token_pieces(
    docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its end id included.

    Returns ``doc_id, piece, start, length, ids_crc32``. A null or empty text
    is the end id alone; rows that repeat an id are packed each for itself; a
    null id is kept.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            ids, bounds = with_end(*encoder(tokenizer).encode(batch.column(1)), end_id)
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = bounds[:-1][row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(pieces, schema)


def exact_fill(left: np.ndarray, gap: int, most: int = 3) -> list[int] | None:
    """One, two or three lengths on hand, ``most`` of them, that add up to ``gap``; the largest first."""
    if left[gap] > 0:
        return [gap]
    pair = _exact_pair(left, gap, gap) if most > 1 else None
    if pair or most < 3:
        return pair
    for first in np.flatnonzero(left[1 : gap - 1])[::-1] + 1:
        if first * 3 < gap:
            break
        left[first] -= 1
        pair = _exact_pair(left, gap - int(first), int(first))
        left[first] += 1
        if pair:
            return [int(first), *pair]
    return None


def _exact_pair(left: np.ndarray, total: int, largest: int) -> list[int] | None:
    """Two lengths of at most ``largest``, on hand, that add up to ``total``."""
    low, high = (total + 1) // 2, min(total - 1, largest)
    if high < low:
        return None
    there = left > 0
    both = there[low : high + 1] & there[total - high : total - low + 1][::-1]
    if total % 2 == 0 and left[total // 2] < 2:
        both[0] = False
    found = np.flatnonzero(both)
    return [low + int(found[-1]), total - low - int(found[-1])] if len(found) else None


Pattern = tuple[int, list[tuple[int, int]]]


def plan_patterns(counts: np.ndarray) -> list[Pattern]:
    """The plan of ``_patterns`` with the fewest sequences, with exact sums of up to three, two or one length."""
    plans = [_patterns(counts, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _patterns(counts: np.ndarray, most: int) -> list[Pattern]:
    """Patterns ``(how often, [(length, copies), ...])`` that use up all lengths.

    ``counts[l]`` is the number of pieces of length ``l``, the last index is
    the capacity. The longest piece left opens a sequence. Its gap is closed
    exactly if one to ``most`` lengths on hand do so; else the longest piece that
    fits goes in (best fit) and the smaller gap is tried again. A pattern is
    repeated until a length in it runs out, so the number of patterns depends on
    the capacity and not on the number of pieces.
    """
    counts = counts.copy()
    capacity = len(counts) - 1
    out = []
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return out
        left = counts.copy()
        used = [int(there[-1])]
        left[used[0]] -= 1
        gap = capacity - used[0]
        while gap > 0:
            fill = exact_fill(left, gap, most)
            if fill is None:
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits):
                    break
                fill = [int(fits[-1])]
            for length in fill:
                left[length] -= 1
            used += fill
            gap -= sum(fill)
        copies = Counter(used)
        times = min(int(counts[length]) // n for length, n in copies.items())
        for length, n in copies.items():
            counts[length] -= times * n
        out.append((times, sorted(copies.items(), reverse=True)))


def _placements(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences; sorted by length and first rank."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for times, copies in patterns:
        offset = 0
        for length, n in copies:
            rows.append((length, int(rank[length]), sequence, n, offset))
            rank[length] += times * n
            offset += length * n
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "first", "sequence", "copies", "offset"), table.T.copy()))


def best_fit_pack(items: DataFrame, *, capacity: int = 4096, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: a place for every item in sequences of ``capacity``.

    Each item keeps its row; offsets of a sequence follow one another without
    gaps. Lengths must lie between 1 and ``capacity``, anything else raises;
    no items give no rows. Only the number of items of each length, at most
    ``capacity`` numbers, comes to the driver, and what it plans goes back as one
    row per pattern and length. Items are numbered within their length by task,
    so that a length that many share meets in no single task.
    """
    names = items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            if not (sizes >= 1).all() or not (sizes <= capacity).all():
                raise ValueError(f"lengths must lie between 1 and {capacity}")
            sizes = sizes.astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            within = np.arange(len(sizes)) - np.repeat(begin, np.diff([*begin, len(sizes)]))
            rank = np.empty(len(sizes), np.int64)
            rank[order] = within + seen[ordered]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.record_batch(
                [*batch.columns, pa.array(np.full(len(sizes), part), pa.int32()), pa.array(rank)], names=schema.names
            )

    numbered = freeze(items.mapInArrow(number, schema))
    size = F.col(f"`{length}`").cast("bigint")
    counts = numbered.groupBy("__part", size.alias("__length")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", "__length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    hist = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("__length").agg(F.sum("__n").alias("__n")).collect():
        hist[row["__length"]] = row["__n"]
    plan = _placements(plan_patterns(hist), capacity)
    stride = int(hist.max()) + 1
    keys = plan["length"] * stride + plan["first"]
    out = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            sizes = col["__size"].to_numpy(zero_copy_only=False)
            rank = col["__base"].to_numpy(zero_copy_only=False) + col["__rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, sizes * stride + rank, side="right") - 1
            nth = rank - plan["first"][at]
            sequence = plan["sequence"][at] + nth // plan["copies"][at]
            offset = plan["offset"][at] + nth % plan["copies"][at] * sizes
            yield pa.record_batch([*(col[n] for n in names), pa.array(sequence), pa.array(offset)], names=out.names)

    sized = numbered.withColumn("__size", size)
    joined = sized.join(base.withColumnRenamed("__length", "__size"), ["__part", "__size"])
    return joined.mapInArrow(place, out)


def pack_documents(
    docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token pieces of all documents with their places in packed sequences.

    See ``token_pieces`` for nulls, empty and very long texts and repeated rows.
    """
    pieces = token_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, doc_id=doc_id, text=text)
    # written first: two Python steps in one task would keep twice as many workers in memory
    return best_fit_pack(freeze(pieces), capacity=capacity)
