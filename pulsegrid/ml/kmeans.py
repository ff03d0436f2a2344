"""K-means for many starts and numbers of clusters at once.

All runs of a round share one read of the table: a task lays its rows beside the
centres of every run that still moves and hands on sums per centre. Seeding
shares its reads too: in each of its rounds every run draws rows with odds by
their squared distance to the centres drawn so far, as the rows with the least
``-ln(u) / d2``, which partial samples can be merged by.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import freeze

ROWS = 4_096  # rows of one matrix
SEED_ROUNDS = 2
STILL = 1e-18  # squared way of a centre, by the size of the data, that counts as none


@dataclass
class KMeansFit:
    """``centres`` (k x d) and ``cost``, the sum of squared distances; ``rounds`` reads of the table it took to settle."""

    centres: np.ndarray
    cost: float
    rounds: int

    def transform(self, df: DataFrame, vector: str, out: str = "cluster") -> DataFrame:
        """``df`` with the number of the nearest centre, the first of equally near ones."""
        return df.withColumn(out, self.predict(as_array(df, vector)))

    def predict(self, x: Column) -> Column:
        centres = self.centres

        @F.arrow_udf(T.IntegerType())
        def nearest(v: pa.Array) -> pa.Array:
            return pa.array(_squares(_points(v), centres).argmin(1), pa.int32())

        return nearest(x)


def _points(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d2, 0.0)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _points(part.column(part.schema.get_field_index("x")))


def _sums(rows: DataFrame, width: int, centres: Mapping[int, np.ndarray]) -> dict[int, list]:
    """Of each run per centre: rows, cost, squared length and sum of its rows. One read of the table.

    What reaches the driver is as large as the centres.
    """
    names = ["n", "cost", "sq", *[f"s{i}" for i in range(width)]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {run: np.zeros((len(c), 3 + width)) for run, c in centres.items()}
        for _, x in _matrices(batches):
            length = (x * x).sum(1)
            for run, c in centres.items():
                own = _squares(x, c).argmin(1)
                one = np.zeros((len(c), len(x)))
                one[own, np.arange(len(x))] = 1.0
                cost = ((x - c[own]) ** 2).sum(1)
                total[run] += one @ np.column_stack([np.ones(len(x)), cost, length, x])
        for run, t in total.items():
            some = t[:, 0] > 0
            at = np.flatnonzero(some)
            yield pa.record_batch([pa.array(np.full(len(at), run), pa.int32()), pa.array(at, pa.int32()), *[pa.array(v) for v in t[some].T]], names=["run", "cluster", *names])

    partial = rows.select("x").mapInArrow(gather, "run int, cluster int, " + ", ".join(f"{n} double" for n in names))
    out = {run: np.zeros((len(c), 3 + width)) for run, c in centres.items()}
    for r in partial.groupBy("run", "cluster").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["run"]][r["cluster"]] = r[2:]
    return out


def lloyd(rows: DataFrame, start: Mapping[int, np.ndarray], rounds: int = 300) -> dict[int, KMeansFit]:
    """Every run from its centres until they stand still. ``rows``: ``x``; a run that has settled is left out of further reads.

    A centre without rows stays where it is.
    """
    centres = {run: np.asarray(c, float) for run, c in start.items()}
    width = next(iter(centres.values())).shape[1]
    moving, fits = dict(centres), {}
    for number in range(1, rounds + 1):
        sums = _sums(rows, width, moving)
        for run, t in sums.items():
            n = t[:, :1]
            new = np.where(n > 0, t[:, 3:] / np.maximum(n, 1.0), moving[run])
            way = ((new - moving[run]) ** 2).sum(1).max()
            size = max(1.0, t[:, 2].sum() / max(t[:, 0].sum(), 1.0))
            if way <= STILL * size or number == rounds:
                fits[run] = KMeansFit(moving[run], float(t[:, 1].sum()), number)
            moving[run] = new
        moving = {run: c for run, c in moving.items() if run not in fits}
        if not moving:
            break
    return fits


def _drawn(rows: DataFrame, wanted: Mapping[int, int], centres: Mapping[int, np.ndarray], seed: int, number: int) -> dict[int, np.ndarray]:
    """For each run, up to ``wanted`` different rows, with odds by the squared distance to its centres (even odds without any).

    What is drawn depends on the values, the run and the seed, not on how rows are spread over tasks. A task keeps no more than that many rows per run, and the same again where they are merged.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, x in _matrices(batches):
            h = part.column(part.schema.get_field_index("h")).to_numpy().astype(np.uint64)
            for run, n in wanted.items():
                # a number in (0, 1] that only depends on the row's values, the run and the round
                u = h ^ np.uint64((run * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03 + seed) & (2**64 - 1))
                for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                    u = (u ^ (u >> np.uint64(shift))) * np.uint64(factor)
                u = ((u ^ (u >> np.uint64(33))) >> np.uint64(11)).astype(float) + 1.0
                d2 = _squares(x, centres[run]).min(1) if run in centres else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = -np.log(u / (1 << 53)) / d2
                old = best.get(run)
                if old is not None:
                    key, x_all = np.concatenate((old[0], key)), np.concatenate((old[1], x))
                else:
                    x_all = x
                # equal rows have equal keys, and one of them is enough
                keep = np.unique(key, return_index=True)[1][:n]
                keep = keep[np.isfinite(key[keep])]
                best[run] = key[keep], x_all[keep]
        for run, (key, x) in best.items():
            values = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(np.full(len(key), run), pa.int32()), pa.array(key), values], names=["run", "key", "x"])

    some = rows.mapInArrow(draw, "run int, key double, x array<double>")
    most = max(wanted.values())
    w = Window.partitionBy("run").orderBy("key", "x")
    some = some.groupBy("run", "key").agg(F.min("x").alias("x"))
    chosen = some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).collect()  # runs x wanted rows
    out: dict[int, list] = {run: [] for run in wanted}
    for r in chosen:
        if r["place"] <= wanted[r["run"]]:
            out[r["run"]].append(r["x"])
    return {run: np.array(x, float) for run, x in out.items()}


def _spread(candidates: np.ndarray, weight: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """``k`` of the candidates, each next one with odds by weight and squared distance to those before."""
    chosen = [int(draw.choice(len(candidates), p=weight / weight.sum()))]
    while len(chosen) < min(k, len(candidates)):
        odds = weight * _squares(candidates, candidates[chosen]).min(1)
        odds[chosen] = 0.0
        if odds.sum() <= 0:
            rest = np.setdiff1d(np.arange(len(candidates)), chosen)
            chosen.append(int(rest[0]))
        else:
            chosen.append(int(draw.choice(len(candidates), p=odds / odds.sum())))
    return candidates[chosen]


def seeded(rows: DataFrame, ks: Mapping[int, int], seed: int = 42) -> dict[int, np.ndarray]:
    """First centres of every run, ``ks[run]`` each, in four reads of the table for all runs together."""
    centres = _drawn(rows, dict.fromkeys(ks, 1), {}, seed, 0)
    if not all(len(c) for c in centres.values()):
        raise ValueError("no rows to cluster")
    for number in range(1, SEED_ROUNDS + 1):
        more = _drawn(rows, {run: 2 * k for run, k in ks.items()}, centres, seed, number)
        centres = {run: np.concatenate((c, more[run])) if len(more[run]) else c for run, c in centres.items()}
    centres = {run: np.unique(c, axis=0) for run, c in centres.items()}
    weight = _sums(rows, next(iter(centres.values())).shape[1], centres)
    return {run: _spread(c, np.maximum(weight[run][:, 0], 1e-9), ks[run], np.random.default_rng([seed, run])) for run, c in centres.items()}


def as_array(df: DataFrame, vector: str) -> Column:
    if df.schema[vector].dataType.typeName() == "array":
        return F.col(vector).cast("array<double>")
    return vector_to_array(F.col(vector))


def array_rows(df: DataFrame, vector: str) -> DataFrame:
    """The vectors as arrays ``x`` with a hash of their values, written once. Rows without a vector take no part."""
    return freeze(df.where(F.col(vector).isNotNull()).select(as_array(df, vector).alias("x")).withColumn("h", F.xxhash64("x")))


def fit_all(df: DataFrame, vector: str, ks: Sequence[int], starts: int = 20, seed: int = 42) -> tuple[dict[int, KMeansFit], DataFrame]:
    """For each k the fit with the least cost of all starts, and the rows it was fitted on. Ties go to the first start.

    Fewer different rows than k give as many clusters as there are different rows.
    """
    rows = array_rows(df, vector)
    runs = {i * starts + s: k for i, k in enumerate(ks) for s in range(starts)}
    fits = lloyd(rows, seeded(rows, runs, seed))
    best = {k: min((fits[i * starts + s] for s in range(starts)), key=lambda f: f.cost) for i, k in enumerate(ks)}
    return best, rows


def mean_silhouettes(rows: DataFrame, fits: Mapping[int, KMeansFit]) -> dict[int, float]:
    """Mean squared-Euclidean silhouette of several fits, from sums per cluster, in two reads for all of them.

    A row alone in its cluster counts 0.
    """
    width = next(iter(fits.values())).centres.shape[1]
    sums = _sums(rows, width, {k: f.centres for k, f in fits.items()})
    facts = {k: t[t[:, 0] > 0] for k, t in sums.items()}
    full = {k: np.flatnonzero(t[:, 0] > 0) for k, t in sums.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(fits, 0.0)
        for _, x in _matrices(batches):
            for k, t in facts.items():
                if len(t) < 2:
                    continue
                own = np.searchsorted(full[k], _squares(x, fits[k].centres).argmin(1))
                n, mean = t[:, 0], t[:, 3:] / t[:, :1]
                away = np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ mean.T + (t[:, 2] / n)[None, :], 0.0)
                at = np.arange(len(x))
                a = away[at, own] * n[own] / np.maximum(n[own] - 1, 1)
                away[at, own] = np.inf
                b = away.min(1)
                most = np.maximum(a, b)
                s = np.where((n[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
                total[k] += float(s.sum())
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["k", "s"])

    got = rows.select("x").mapInArrow(gather, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    n = {k: t[:, 0].sum() for k, t in facts.items()}
    return {r["k"]: float(r["s"] / n[r["k"]]) for r in got}
