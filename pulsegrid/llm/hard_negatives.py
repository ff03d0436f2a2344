"""Hard negatives: rows of another label that score nearly as high with an anchor as its positives.

Scores are exact integer inner products. Anchors and candidates are cut into
blocks, each pair of blocks is one tile, and a tile is multiplied by Strassen's
recursion on 64-bit integers, zero-padded to halves of equal size. Its sums and
differences wrap around at 64 bits, which is exact for every score that fits.
A tile hands on a short heap per anchor; heaps of tiles are merged by Spark.
Positives come from tiles of one label, negatives from a second pass in which
every positive of an anchor keeps a heap of the scores in its window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import freeze

ANCHOR_ROWS, CANDIDATE_ROWS = 256, 1024
# Halving stops where a side would fall below this.
LEAST_SIDE = 32
# Scores stay below 2^55, so that a percentage of them fits in 64 bits too.
SCORE_BITS = 55


def strassen(a: np.ndarray, b: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """The product of two int64 matrices by Strassen's seven products, modulo 2^64."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    levels = 0
    while min(n, k, m) >> (levels + 1) >= least:
        levels += 1
    if not levels:
        return a @ b
    unit = 1 << levels
    pad = lambda size: -size % unit
    a = np.pad(a, ((0, pad(n)), (0, pad(k))))
    b = np.pad(b, ((0, pad(k)), (0, pad(m))))
    return _seven(a, b, levels)[:n, :m]


def _seven(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = _seven(a11 + a22, b11 + b22, levels - 1)
    p2 = _seven(a21 + a22, b11, levels - 1)
    p3 = _seven(a11, b12 - b22, levels - 1)
    p4 = _seven(a22, b21 - b11, levels - 1)
    p5 = _seven(a11 + a12, b22, levels - 1)
    p6 = _seven(a21 - a11, b11 + b12, levels - 1)
    p7 = _seven(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m] = p1 + p4 - p5 + p7
    out[:n, m:] = p3 + p5
    out[n:, :m] = p2 + p4
    out[n:, m:] = p1 - p2 + p3 + p6
    return out


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    whole = col.combine_chunks()
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


def _ids(table: pa.Table, name: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Ids and which are null; those sort behind all others."""
    col = table[name].combine_chunks()
    null = col.is_null().to_numpy(zero_copy_only=False)
    return col.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), null


def _tiles(anchors: DataFrame, rows: DataFrame, by: str | None, tile: Callable, schema: str) -> DataFrame:
    """``tile`` of each pair of an anchor block and a block of rows; with ``by``, of blocks with the same value.

    Blocks are dealt by a hash of the row number, so no label or copy makes a large one.
    """
    group = F.col(by) if by else F.lit(0)
    sizes = rows.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    asked = anchors.groupBy(group.alias("g")).agg(F.count("*").alias("m"))
    blocks = sizes.join(asked, "g").select(
        "g", F.ceil(F.col("m") / ANCHOR_ROWS).alias("a_blocks"), F.ceil(F.col("n") / CANDIDATE_ROWS).alias("c_blocks")
    )
    blocks = freeze(blocks)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # both sides come from one table, so their columns are named anew
        known = df.select(group.alias("g"), *[F.col(c).alias(c) for c in df.columns]).join(blocks, "g")
        mine = F.pmod(F.xxhash64("row"), F.col(f"{own}_blocks"))
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_blocks") - 1))
        return known.withColumn(f"{own}_block", mine).withColumn(f"{other}_block", others).drop("a_blocks", "c_blocks")

    keys = ["g", "a_block", "c_block"]
    return dealt(anchors, "a", "c").groupBy(*keys).cogroup(dealt(rows, "c", "a").groupBy(*keys)).applyInArrow(tile, schema)


def _best(heaps: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """Heaps merged: of each key the first ``k`` rows. Each task passes on no more than ``k`` rows a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return heaps.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def prepared(df: DataFrame, *, row_id: str, vector: str, label: str, anchor: Column, scale: int = 256) -> DataFrame:
    """``row, id, label, v, anchor``: the rows that take part, with ``floor(scale * x)`` of each component, written once."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    fits = df.where(whole).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{row_id}`").cast("bigint").alias("id"),
        F.col(f"`{label}`").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("v"),
    )
    return freeze(fits)


def mine(
    df: DataFrame,
    *,
    row_id: str,
    vector: str,
    label: str,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all rows where ``anchor`` holds.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part. A row's score is its integer inner product with the anchor
    after ``floor(scale * x)``; shorter vectors count as filled up with zeros. The
    positives of an anchor are its first rows of the same label, the negatives of a
    positive the first rows of other labels whose score is between ``low`` and
    ``high`` per cent of the positive's. Higher scores come first, ties by the
    smaller id, null ids last, then by place in the table. Each row stands for
    itself: a copy of the anchor with the same id can be its positive. An anchor
    without positives, or a positive without negatives, gives no row. Vectors so
    large that a score might not fit in 55 bits are refused. Further columns are not read.
    """
    rows = prepared(df, row_id=row_id, vector=vector, label=label, anchor=anchor, scale=scale)
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda v: F.abs(v)))).alias("largest")).first()
    width = facts["width"] or 0
    if width * (facts["largest"] or 0) ** 2 >= 1 << SCORE_BITS:
        raise ValueError(f"scores of vectors with components of {facts['largest']} may not fit in {SCORE_BITS} bits")
    anchors = rows.where("anchor")

    def scores(a: pa.Table, c: pa.Table) -> np.ndarray:
        return strassen(_matrix(a["v"], width), np.ascontiguousarray(_matrix(c["v"], width).T))

    def positive_heaps(a: pa.Table, c: pa.Table) -> pa.Table:
        names = ["a_row", "anchor_id", "label", "row", "positive_id", "positive_score"]
        if not a.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], pa.string() if n == "label" else pa.int64()) for n in names})
        s, (ids, null) = scores(a, c), _ids(c)
        own, row = a["row"].to_numpy(), c["row"].to_numpy()
        at, pick = [], []
        for k in range(len(own)):
            others = np.flatnonzero(row != own[k])
            best = others[np.lexsort((row[others], ids[others], -s[k, others]))[:positives]]
            at.append(np.full(len(best), k))
            pick.append(best)
        at, pick = np.concatenate(at), np.concatenate(pick)
        return pa.table(
            [a["row"].take(at), a["id"].take(at), a["label"].take(at), c["row"].take(pick), pa.array(ids[pick], mask=null[pick]), pa.array(s[at, pick])], names=names
        )

    schema = "a_row bigint, anchor_id bigint, label string, row bigint, positive_id bigint, positive_score bigint"
    heaps = _tiles(anchors, rows, "label", positive_heaps, schema)
    order = [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), F.col("row")]
    chosen = freeze(_best(heaps, ["a_row"], order, positives, "place").drop("row", "label"))

    windows = chosen.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("windows"))
    windows = windows.select(
        F.col("a_row").alias("row"), F.transform("windows", lambda w: w["place"].cast("bigint")).alias("places"), F.transform("windows", lambda w: w["positive_score"]).alias("tops")
    )

    def negative_heaps(a: pa.Table, c: pa.Table) -> pa.Table:
        names = ["a_row", "place", "row", "negative_id", "negative_score"]
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and c.num_rows:
            s, (ids, null) = scores(a, c), _ids(c)
            own, row = a["row"].to_numpy(), c["row"].to_numpy()
            kinds, mine_ = c["label"].to_numpy(), a["label"].to_pylist()
            by_id = np.lexsort((row, ids))
            for k, (places, tops) in enumerate(zip(a["places"].to_pylist(), a["tops"].to_pylist())):
                others = by_id[kinds[by_id] != mine_[k]]
                others = others[(-s[k, others]).argsort(kind="stable")]
                falling = -s[k, others]
                for place, top in zip(places, tops):
                    # low * top <= high * score and score <= top
                    floor = -((-low * top) // high) if high > 0 else top
                    first, last = np.searchsorted(falling, -top), np.searchsorted(falling, -floor, side="right")
                    best = others[first : max(min(last, first + negatives), first)]
                    if len(best):
                        out.append((np.full(len(best), own[k]), np.full(len(best), place), row[best], best, s[k, best]))
        if not out:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        a_row, place, r, best, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(a_row), pa.array(place), pa.array(r), pa.array(ids[best], mask=null[best]), pa.array(score)], names=names)

    schema = "a_row bigint, place bigint, row bigint, negative_id bigint, negative_score bigint"
    heaps = _tiles(anchors.join(windows, "row"), rows, None, negative_heaps, schema)
    order = [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), F.col("row")]
    found = _best(heaps, ["a_row", "place"], order, negatives, "rank").drop("row")
    return found.join(chosen, ["a_row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
