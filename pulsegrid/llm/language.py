"""Language identification with interpolated Kneser-Ney character models.

Counting and smoothing are Spark jobs over tables keyed by whole n-grams, with an
array of numbers per language. The two halves of the corpus are counted beside
each other, so one run gives the model of the whole and those that lack a half,
by which the rejection is calibrated. For scoring, the n-grams that occur most go
to the tasks as sorted arrays of 64-bit keys, up to a documented number of
values. As long as that is all of them, scoring needs no more; beyond it, what a
text has besides is looked up in the tables by joins, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import segment_sum, slices, text_buffer
from pulsegrid.session import freeze

ORDER = 4
# An n-gram is four 16-bit units in one integer; 0 stands for no character. A letter
# beyond the basic plane is two units, as in UTF-16, which no other letter has.
GAP = 1
# Values (n-grams or contexts, times languages) that a task holds of a model.
HEAD_VALUES = 8_000_000
KAPPAS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
# Characters beyond which a text's length no longer narrows what entropy is usual.
FULL_LENGTH = 400.0


@cache
def _letters() -> np.ndarray:
    """For each code point, its small letter; ``GAP`` for all that are no letters."""
    small = np.full(0x110000, GAP, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            small[point] = ord(low) if len(low) == 1 else point
    return small


def ngram_keys(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the 4-grams of each text, where each text's begin, and which texts have a letter.

    Runs of other characters are one gap; a text begins behind gaps and ends with one.
    """
    data, offsets = text_buffer(col)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    whole = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = whole[offsets]
    codes, bounds = _units(_letters()[points], bounds)
    n = len(bounds) - 1
    letters = segment_sum((codes != GAP).astype(np.int64), bounds)
    sizes = np.diff(bounds)
    out = np.full(len(codes) + n * ORDER, GAP, np.uint16)
    place = np.arange(len(codes)) + np.repeat(np.arange(n) * ORDER + ORDER - 1, sizes)
    out[place] = codes
    begins = bounds[:-1] + np.arange(n) * ORDER
    # a gap behind a gap goes, but for the padding in front
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
    front = (begins[:, None] + np.arange(ORDER - 1)).ravel()
    keep[front] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    seq = out[keep].astype(np.uint64)
    start = kept[np.append(begins, len(out))]
    grams = np.zeros(max(len(seq) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        grams = (grams << np.uint64(16)) | seq[k : k + len(grams)]
    own = np.zeros(len(grams), bool)
    counts = np.diff(start) - (ORDER - 1)
    edges = np.concatenate(([0], np.cumsum(counts)))
    own_at = np.arange(edges[-1]) + np.repeat(start[:-1] - edges[:-1], counts)
    own[own_at] = True
    return grams[own], edges, letters > 0


def _units(small: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as 16-bit units, and where each text's begin."""
    wide = small >= 0x10000
    if not wide.any():
        return small.astype(np.uint16), bounds
    place = np.concatenate(([0], np.cumsum(1 + wide)))
    out = np.empty(int(place[-1]), np.uint16)
    out[place[:-1]] = np.where(wide, 0xD7C0 + (small >> 10), small)
    out[place[:-1][wide] + 1] = 0xDC00 + (small[wide] & 0x3FF)
    return out, place[bounds]


def _half(text: Column) -> Column:
    """0 or 1 by the text, so that equal texts are never on both sides of a calibration."""
    return F.pmod(F.xxhash64(text.cast("string")), F.lit(2)).cast("int")


MODELS = 3  # the whole corpus, without its first half, without its second


def _values(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _whole_groups(batches: Iterator[pa.RecordBatch], group) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come sorted by a group, with where each group begins; no group is cut.

    A group has as many rows as there are letters, at most.
    """
    held: list[pa.RecordBatch] = []

    def joined(parts):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = group(whole.column(0).to_numpy().view(np.uint64))
        return whole, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))

    for batch in batches:
        if not batch.num_rows:
            continue
        whole, starts = joined([*held, batch])
        last = int(starts[-1])
        held = [whole.slice(last)]
        if last:
            yield whole.slice(0, last), starts[:-1]
    if held:
        yield joined(held)


def _suffix_of(gram: np.ndarray, order: int) -> np.ndarray:
    return gram & np.uint64((1 << 16 * (order - 1)) - 1)


def count_ngrams(docs: DataFrame, languages: list[str], *, lang: str = "lang", text: str = "text") -> DataFrame:
    """``gram, n``: of each 4-gram of all texts with a language, the counts by model and language, over the whole input."""
    number = {name: i for i, name in enumerate(languages)}
    width = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(parts):
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in slices(batches, "text"):
            grams, edges, _ = ngram_keys(batch.column(2))
            which = np.fromiter(map(number.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            of = np.repeat(2 * which + batch.column(1).to_numpy(), np.diff(edges))
            for k in np.unique(of).tolist():
                own = held.setdefault(k, [])
                own.append(np.unique(grams[of == k], return_counts=True))
                if len(own) > 8:
                    held[k] = [fold(own)]
        for k, parts in held.items():
            keys, n = fold(parts)
            for a in range(0, len(keys), 100_000):
                part = slice(a, a + 100_000)
                yield pa.record_batch([pa.array(keys[part].view(np.int64)), pa.array(np.full(len(keys[part]), k), pa.int32()), pa.array(n[part])], names=["gram", "of", "n"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, lambda g: g):
            of, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            halves = np.zeros((2, len(starts), width), np.int64)
            np.add.at(halves, (of % 2, row, of // 2), n)
            values = np.concatenate((halves[0] + halves[1], halves[1], halves[0]), axis=1)
            yield pa.record_batch([rows.column(0).take(pa.array(starts)), _listed(values)], names=["gram", "n"])

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{lang}`").cast("string").alias("lang"), _half(F.col(f"`{text}`")).alias("half"), F.col(f"`{text}`").cast("string").alias("text")
    )
    counted = rows.mapInArrow(count, "gram bigint, of int, n bigint")
    return counted.repartition("gram").sortWithinPartitions("gram").mapInArrow(gathered, "gram bigint, n array<bigint>")


@dataclass
class LanguageModel:
    """One of the ``MODELS`` in the tables.

    ``grams[k]``: ``gram, count, p``, ``contexts[k]``: ``context, back`` of order ``k + 1``,
    with arrays by model and language. ``places`` are the array places of this
    model's languages, ``floor`` the logarithm of the even share of a letter.
    """

    languages: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    places: list[int]
    floor: float
    kappa: float = 16.0
    usual: np.ndarray | None = None


def _continued(table: DataFrame, order: int, width: int) -> DataFrame:
    """``gram, n`` of the order below: how many different characters come before."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, lambda g: _suffix_of(g, order)):
            n = np.add.reduceat((_values(rows, 1, width) > 0).astype(np.int64), starts)
            keys = _suffix_of(rows.column(0).to_numpy().view(np.uint64)[starts], order).view(np.int64)
            yield pa.record_batch([pa.array(keys), _listed(n)], names=["gram", "n"])

    suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
    sorted_rows = table.withColumn("__s", suffix).repartition("__s").sortWithinPartitions("__s")
    return sorted_rows.select("gram", "n").mapInArrow(fold, "gram bigint, n array<bigint>")


def _discounts(levels: list[DataFrame], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per order and array place the discount, whether the place has any n-gram, and per model the number of letters.

    One row per order and place reaches the driver, and one per model.
    """

    def facts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 3), np.int64)
        letters = np.zeros(MODELS, np.int64)
        for batch in batches:
            n = _values(batch, 1, width)
            total += np.stack([(n == 1).sum(0), (n == 2).sum(0), (n > 0).sum(0)], 1)
            letters += (n.reshape(len(n), MODELS, -1) > 0).any(2).sum(0)
        rows = np.concatenate((total, np.column_stack([letters, letters, letters])))
        at = pa.array(np.arange(len(rows)), pa.int32())
        yield pa.record_batch([pa.array(np.full(len(rows), order), pa.int32()), at, *[pa.array(c) for c in rows.T]], names=["level", "at", "n1", "n2", "types"])

    schema = "level int, at int, n1 bigint, n2 bigint, types bigint"
    whole = None
    for order, table in enumerate(levels):
        part = table.mapInArrow(lambda it, order=order: facts(it, order), schema)
        whole = part if whole is None else whole.unionAll(part)
    d, some, letters = np.full((len(levels), width), 0.5), np.zeros((len(levels), width), bool), np.zeros(MODELS, np.int64)
    for r in whole.groupBy("level", "at").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "types")]).collect():
        if r["at"] >= width:
            if r["level"] == 0:
                letters[r["at"] - width] = r["types"]
            continue
        if r["n1"]:
            d[r["level"], r["at"]] = r["n1"] / (r["n1"] + 2 * r["n2"])
        some[r["level"], r["at"]] = r["types"] > 0
    return np.clip(d, 0.1, 0.9), some, letters


def _weighed(table: DataFrame, d: np.ndarray) -> DataFrame:
    """``gram, count, alpha, back, first``: the discounted share of each n-gram, and what its context leaves to the order below."""
    width = len(d)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, lambda g: g >> np.uint64(16)):
            n = _values(rows, 1, width)
            total, types = np.add.reduceat(n, starts), np.add.reduceat((n > 0).astype(np.int64), starts)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
            back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            alpha = np.where(n > 0, (n - d) / np.maximum(total, 1)[of], 0.0)
            first = np.zeros(len(n), bool)
            first[starts] = True
            count = n[:, : width // MODELS].sum(1)
            yield pa.record_batch([rows.column(0), pa.array(count), _listed(alpha), _listed(back[of]), pa.array(first)], names=["gram", "count", "alpha", "back", "first"])

    schema = "gram bigint, count bigint, alpha array<double>, back array<double>, first boolean"
    by_context = table.withColumn("__c", F.shiftrightunsigned("gram", 16)).repartition("__c").sortWithinPartitions("__c", "gram")
    return by_context.select("gram", "n").mapInArrow(weigh, schema)


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Count, smooth and calibrate on all ``docs`` with a text and a language.

    Counts and smoothing are Spark jobs over the n-grams of the whole input. Every
    n-gram that any language has gets its interpolated probability in all of them.
    The number of languages is taken from the data and is meant to be that of
    languages: each n-gram carries that many numbers. Without documents with a
    text and a language the model knows none and predicts ``und``. Repeated rows
    count each, a very long text is counted like others.
    """
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    languages = sorted(r[0] for r in known.select(F.col(f"`{lang}`").cast("string")).distinct().collect())
    if not languages:
        return LanguageModel([], [], [], [], 0.0)
    whole, *halves = _smoothed(freeze(count_ngrams(docs, languages, lang=lang, text=text)), languages)
    return _calibrated(docs, whole, halves, lang, text)


def _smoothed(counts: DataFrame, languages: list[str]) -> list[LanguageModel]:
    """The ``MODELS`` before they are calibrated; they share their tables."""
    width = MODELS * len(languages)
    levels = [counts]
    for order in range(ORDER, 1, -1):
        levels.append(freeze(_continued(levels[-1], order, width)))
    levels.reverse()
    d, some, letters = _discounts(levels, width)
    even = np.repeat(1.0 / (letters + 1.0), len(languages))
    grams, contexts = [], []
    for order, table in enumerate(levels, 1):
        weighed = freeze(_weighed(table, d[order - 1]))
        if order == 1:
            below = weighed.withColumn("below", F.array(*[F.lit(float(v)) for v in even]))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            below = weighed.withColumn("__s", suffix).join(grams[-1].select(F.col("gram").alias("__s"), F.col("p").alias("below")), "__s")
        left = F.zip_with("back", "below", lambda b, q: b * q)
        grams.append(freeze(below.select("gram", "count", F.zip_with("alpha", left, lambda a, q: a + q).alias("p"))))
        contexts.append(weighed.where("first").select(F.shiftrightunsigned("gram", 16).alias("context"), "back"))
    out = []
    for model in range(MODELS):
        places = [p for p in range(model * len(languages), (model + 1) * len(languages)) if some[0, p]]
        out.append(LanguageModel([languages[p % len(languages)] for p in places], grams, contexts, places, float(-np.log(letters[model] + 1.0))))
    return out


@dataclass
class _Head:
    """What a task holds of a model: per order sorted keys of n-grams and contexts with logarithms per language.

    ``whole`` says of each order whether all its n-grams and contexts are there.
    """

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    whole: bool
    floor: float
    width: int


def _head(model: LanguageModel, limit: int) -> _Head:
    """All of the model if it has no more than ``limit`` values, else the 4-grams with the highest counts."""
    places = F.array(*[F.lit(p + 1) for p in model.places])
    rows = limit // max(1, len(model.places))

    def fetched(table: DataFrame, key: str, values: str) -> tuple[np.ndarray, np.ndarray]:
        logs = F.transform(places, lambda p: F.ln(F.element_at(values, p)).cast("float"))
        got = table.select(key, logs.alias("v")).toArrow().combine_chunks()
        if not got.num_rows:
            return np.empty(0, np.uint64), np.empty((0, len(model.places)), np.float32)
        keys = got[key].to_numpy().view(np.uint64)
        order = keys.argsort()
        v = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        return keys[order], v[order].astype(np.float32)

    sizes = [t.count() for t in [*model.grams, *model.contexts]]
    if sum(sizes) <= rows:
        grams = [fetched(t, "gram", "p") for t in model.grams]
        return _Head(grams, [fetched(t, "context", "back") for t in model.contexts], True, model.floor, len(model.places))
    most = model.grams[-1].orderBy(F.col("count").desc(), "gram").limit(rows)
    return _Head([fetched(most, "gram", "p")], [], False, model.floor, len(model.places))


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _log_shares(head: _Head, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the shares of 4-grams per language, and which of them the head cannot tell."""
    keys, logs = head.grams[-1]
    at = _found(keys, grams)
    out = np.zeros((len(grams), head.width), np.float64)
    out[at >= 0] = logs[at[at >= 0]]
    todo = np.flatnonzero(at < 0)
    if not head.whole:
        return out, todo
    for order in range(ORDER, 0, -1):
        key = grams[todo] & np.uint64((1 << 16 * order) - 1)
        if order < ORDER:
            at = _found(head.grams[order - 1][0], key)
            out[todo[at >= 0]] += head.grams[order - 1][1][at[at >= 0]]
            todo, key = todo[at < 0], key[at < 0]
        keys, logs = head.contexts[order - 1]
        at = _found(keys, key >> np.uint64(16))
        out[todo[at >= 0]] += logs[at[at >= 0]]
    out[todo] += head.floor
    return out, np.empty(0, np.int64)


def _by_joins(model: LanguageModel, grams: DataFrame) -> DataFrame:
    """``gram, logs`` of different 4-grams, looked up in the tables order by order."""
    places = F.array(*[F.lit(p + 1) for p in model.places])
    logs = lambda c: F.transform(places, lambda p: F.ln(F.element_at(c, p)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zeros = F.array(*[F.lit(0.0) for _ in model.places])
    rows, done = grams.select("gram", F.col("gram").alias("key"), zeros.alias("sum")), None
    for order in range(ORDER, 0, -1):
        hit = rows.join(model.grams[order - 1].select(F.col("gram").alias("key"), "p"), "key", "left")
        told = hit.where(F.col("p").isNotNull()).select("gram", plus(F.col("sum"), logs("p")).alias("logs"))
        done = told if done is None else done.unionAll(told)
        open_rows = hit.where(F.col("p").isNull()).withColumn("context", F.shiftrightunsigned("key", 16))
        less = open_rows.join(model.contexts[order - 1], "context", "left")
        total = F.when(F.col("back").isNull(), F.col("sum")).otherwise(plus(F.col("sum"), logs("back")))
        rows = freeze(less.select("gram", F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("key"), total.alias("sum")))
    return done.unionAll(rows.select("gram", F.transform("sum", lambda v: v + model.floor).alias("logs")))


N_GRAMS, HAS_LETTER, ENTROPY = "__n_grams", "__has_letter", "__entropy"


def entropies(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep_text: bool = False, head_values: int = HEAD_VALUES) -> DataFrame:
    """``docs`` with ``__n_grams``, ``__has_letter`` and ``__entropy``, an array with nats per 4-gram for each language.

    The text itself is only returned with ``keep_text``, as ``__text`` in front. A
    null or empty text has one n-gram, of gaps, and no letter. ``head_values`` bounds
    what a task holds of the model; it changes no result.
    """
    kept = [c for c in docs.columns if c != text and c not in ("__text", N_GRAMS, HAS_LETTER, ENTROPY)]
    body = [T.StructField("__text", T.StringType())] if keep_text else []
    missing = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]))
    schema = T.StructType(
        [
            *body,
            *[docs.schema[c] for c in kept],
            T.StructField(N_GRAMS, T.LongType()),
            T.StructField(HAS_LETTER, T.BooleanType()),
            T.StructField(ENTROPY, T.ArrayType(T.DoubleType())),
            T.StructField("__missing", missing),
        ]
    )
    head = _head(model, head_values) if model.languages else _Head([], [], True, model.floor, 0)
    whole = head.whole
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in slices(batches, "__text"):
            grams, edges, letters = ngram_keys(batch.column(0))
            counts = np.diff(edges)
            if head.width:
                distinct, of = np.unique(grams, return_inverse=True)
                logs, unknown = _log_shares(head, distinct)
                h = -segment_sum(logs[of], edges) / np.maximum(counts, 1)[:, None]
            else:
                h, unknown = np.empty((len(counts), 0)), np.empty(0, np.int64)
            yield pa.record_batch(
                [*batch.columns[0 if keep_text else 1 :], pa.array(counts), pa.array(letters), _listed(h) if head.width else _empty_lists(len(counts)), _told(unknown, grams, edges, distinct if len(unknown) else None)],
                names=schema.names,
            )

    # under names of their places, it does not matter what the columns are called
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rated = rows.mapInArrow(rate, schema)
    if whole:
        return rated.drop("__missing")
    # the rest of the n-grams: looked up once each, summed up per row
    rated = freeze(rated.withColumn("__row", F.monotonically_increasing_id()))
    each = rated.select("__row", N_GRAMS, F.explode("__missing").alias("m")).select("__row", N_GRAMS, "m.gram", "m.n")
    logs = _by_joins(model, freeze(each.select("gram").distinct()))
    share = F.col("n") / F.col(N_GRAMS)
    more = each.join(logs, "gram").groupBy("__row").agg(*[F.sum(-F.col("logs")[i] * share).alias(f"__e{i}") for i in range(len(model.languages))])
    joined = rated.join(more, "__row", "left")
    total = F.array(*[F.col(ENTROPY)[i] + F.coalesce(F.col(f"__e{i}"), F.lit(0.0)) for i in range(len(model.languages))])
    return joined.withColumn(ENTROPY, total).select(*schema.names[:-1])


def _empty_lists(n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.float64()))


def _told(unknown: np.ndarray, grams: np.ndarray, edges: np.ndarray, distinct: np.ndarray | None) -> pa.Array:
    """Per text the n-grams that the head cannot tell, with how often they occur."""
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
    n = len(edges) - 1
    if distinct is None:
        return pa.array([[]] * n, kind)
    at = np.flatnonzero(np.isin(grams, distinct[unknown]))
    row = np.searchsorted(edges, at, side="right") - 1
    order = np.lexsort((grams[at], row))
    row, gram = row[order], grams[at][order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))))
    times = np.diff(np.append(first, len(row)))
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=n))))
    cells = pa.StructArray.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(times)], names=["gram", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)


def _total(kappa: float, least: Column) -> Column:
    return F.aggregate(ENTROPY, F.lit(0.0), lambda s, x: s + F.exp(-kappa * (x - least)))


def _calibrated(docs: DataFrame, model: LanguageModel, others: list[LanguageModel], lang: str, text: str) -> LanguageModel:
    """Sets the sharpness of the score and, per language, the entropy that is usual.

    Both come from all documents with a language, each rated by the model of the
    half it is not in (``others``), so that no text is taken as usual for having
    been counted: the sharpness with the least log loss of the true language, and
    the mean entropy of the true language with the 99.9 % quantile of how far a
    text, by its length, lies above. How far texts of an unknown language lie above
    is told by texts whose own language is left out: the least 5 % quantile that
    any of the other languages shows where this one is the nearest of the rest.
    A language with texts in one half only has nothing held out; no limit is known for it.
    """
    known = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rated = []
    for half, other in enumerate(others):
        if not other.languages:
            continue
        own = known.where((_half(F.col("text")) == half) & F.col("lang").isin(other.languages))
        at = F.array_position(F.lit(other.languages), F.col("lang")).cast("int")
        true = F.element_at(ENTROPY, at)
        least = F.array_min(ENTROPY)
        rest = F.array_min(F.filter(ENTROPY, lambda x, i: i != at - 1))
        nearest = F.element_at(F.lit(other.languages), F.array_position(F.transform(ENTROPY, lambda x, i: F.when(i != at - 1, x)), rest).cast("int"))
        losses = [(F.ln(_total(k, least)) + k * (true - least)).alias(f"k{i}") for i, k in enumerate(KAPPAS)]
        scored = entropies(own, other).where(HAS_LETTER)
        rated.append(freeze(scored.select("lang", F.col(N_GRAMS).alias("n_grams"), true.alias("true"), rest.alias("rest"), nearest.alias("nearest"), *losses)))
    usual = np.full((len(model.languages), 3), np.inf)
    if rated:
        scored = rated[0] if len(rated) == 1 else rated[0].unionAll(rated[1])
        facts = scored.groupBy("lang").agg(F.avg("true").alias("mean"), F.count("*").alias("n"), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(len(KAPPAS))]).collect()
        rows = sum(r["n"] for r in facts)
        if rows:
            loss = [sum(r[f"k{i}"] for r in facts) / rows for i in range(len(KAPPAS))]
            model.kappa = min(zip(KAPPAS, loss), key=lambda x: x[1])[0]
        # a row per language
        mean_of = F.create_map(*[F.lit(v) for r in facts for v in (r["lang"], r["mean"])]) if facts else F.lit(None).cast("map<string,double>")
        above = lambda h, name: (F.col(h) - F.try_element_at(mean_of, F.col(name))) * F.sqrt(F.least(F.col("n_grams").cast("double"), F.lit(FULL_LENGTH)))
        high = scored.groupBy("lang").agg(F.percentile_approx(above("true", "lang"), 0.999, 10000).alias("v")).select(F.lit("high").alias("kind"), "lang", "v")
        low = scored.where(F.col("nearest").isNotNull()).groupBy("nearest", "lang").agg(F.percentile_approx(above("rest", "nearest"), 0.05, 10000).alias("v"))
        low = low.groupBy(F.col("nearest").alias("lang")).agg(F.min("v").alias("v")).select(F.lit("low").alias("kind"), "lang", "v")
        for r in facts:
            usual[model.languages.index(r["lang"]), 0] = r["mean"]
        for r in high.unionAll(low).collect():
            if r["v"] is not None:
                usual[model.languages.index(r["lang"]), 1 if r["kind"] == "high" else 2] = r["v"]
    model.usual = usual
    return model


def identify(
    docs: DataFrame, model: LanguageModel, *, text: str = "text", slack: float = 2.0, keep_text: bool = False, head_values: int = HEAD_VALUES
) -> DataFrame:
    """``docs`` without the text (``keep_text`` leaves it as ``__text``), with ``lang_pred``, ``score`` and ``rejected``.

    The language with the lowest entropy per character, ties to the first by
    name. ``score`` from 0 to 1 is its calibrated share among all languages. A text that
    is null or has no letter is ``und`` with score 0. ``rejected`` holds for those
    and for texts in no known language: their entropy lies farther above the
    language's mean than 99.9 % of its own texts of that length do when the model
    has not counted them, by half of what lies between those and texts of other
    languages, and at most ``slack`` times as far.
    A model that knows no language calls everything ``und`` and rejects only
    texts without a letter. Columns of ``docs`` named like the new ones are replaced;
    repeated rows are rated each, and very long texts whole.
    """
    rows = entropies(docs, model, text=text, keep_text=keep_text, head_values=head_values)
    new = ("lang_pred", "score", "rejected")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (N_GRAMS, HAS_LETTER, ENTROPY, *new)]
    if not model.languages:
        und = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), (~F.col(HAS_LETTER)).alias("rejected")]
        return rows.select(*kept, *und)
    least = F.array_min(ENTROPY)
    at = F.array_position(ENTROPY, least).cast("int")
    total = _total(model.kappa, least)
    own = model.usual[:, 1]
    limit = np.minimum(slack * np.maximum(own, 0.5), np.maximum(own, (own + model.usual[:, 2]) / 2))
    mean, high = (F.element_at(F.lit([float(v) for v in values]), at) for values in (model.usual[:, 0], limit))
    above = (least - mean) * F.sqrt(F.least(F.col(N_GRAMS).cast("double"), F.lit(FULL_LENGTH)))
    letter = F.col(HAS_LETTER)
    foreign = above > high
    return rows.select(
        *kept,
        F.when(letter, F.element_at(F.lit(model.languages), at)).otherwise("und").alias("lang_pred"),
        F.when(letter, 1 / total).otherwise(0.0).alias("score"),
        (~letter | foreign).alias("rejected"),
    )


def of_known_language(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text ``identify`` does not reject."""
    others = [c for c in docs.columns if c != text]
    carried = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)]
    kept = identify(docs.select(F.col(f"`{text}`").alias("__body"), *carried), model, text="__body", keep_text=True)
    names = {c: f"__c{i}" for i, c in enumerate(others)} | {text: "__text"}
    return kept.where("not rejected").select(*[F.col(names[c]).alias(c) for c in docs.columns])
