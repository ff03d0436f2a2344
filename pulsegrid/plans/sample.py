"""Several random samples of exact size in one read of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 16_384


def mixed(h: np.ndarray, draw: int) -> np.ndarray:
    """Another 64-bit hash of the same values for each draw."""
    u = h.astype(np.uint64) ^ np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        u = (u ^ (u >> np.uint64(33))) * np.uint64(factor)
    return u ^ (u >> np.uint64(33))


class BottomK:
    """The ``k`` rows with the smallest keys met so far, for each of several draws."""

    def __init__(self, draws: int, k: int):
        self.k = k
        self.keys = [np.empty(0, np.uint64) for _ in range(draws)]
        self.rows: list[pa.Table | None] = [None] * draws

    def add(self, h: np.ndarray, rows: pa.Table) -> None:
        for draw, held in enumerate(self.keys):
            key = mixed(h, draw)
            # once k rows are held, hardly any row has a smaller key
            new = np.flatnonzero(key < held.max()) if len(held) >= self.k else np.arange(len(key))
            if not len(new):
                continue
            both = np.concatenate((held, key[new]))
            old = self.rows[draw]
            table = rows.take(new) if old is None else pa.concat_tables([old, rows.take(new)])
            keep = np.argsort(both, kind="stable")[: self.k]
            self.keys[draw], self.rows[draw] = both[keep], table.take(keep).combine_chunks()


def bottom_k(df: DataFrame, row_hash: str, columns: Sequence[str], draws: int, k: int) -> DataFrame:
    """``draw`` and ``columns``: for each of ``draws`` samples the ``k`` rows with the smallest hashes, or all if there are fewer.

    Every row is equally likely in every sample, samples are independent of each
    other, and the rows of one are different. The table is read once: a task keeps
    ``k`` rows per sample, and samples of tasks are merged with no more than ``k``
    rows of each leaving a task. ``row_hash`` is a 64-bit hash that tells rows apart;
    rows that share it are in a sample together or decided by their values.
    """
    fields = [df.schema[c] for c in columns]
    schema = ", ".join(["draw int", "sortkey bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BottomK(draws, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best.add(part.column(0).to_numpy(), pa.Table.from_arrays(part.columns[1:], names=list(columns)))
        for draw, (keys, rows) in enumerate(zip(best.keys, best.rows)):
            if rows is not None:
                # the order of unsigned keys, kept as signed ones
                order = (keys ^ np.uint64(1 << 63)).view(np.int64)
                table = pa.Table.from_arrays([pa.array(np.full(len(keys), draw), pa.int32()), pa.array(order), *rows.columns], names=["draw", "sortkey", *columns])
                yield from table.to_batches()

    partial = df.select(row_hash, *columns).mapInArrow(gather, schema)
    w = Window.partitionBy("draw").orderBy("sortkey", *columns)
    return partial.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= k).drop("__place", "sortkey")
