"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by document: a row holds the sorted terms of some
documents and, for each term, its postings (places of the word, ascending).
A term that occurs everywhere therefore meets in no single task. Queries are
windows of consecutive benchmark words; each row of the index starts from a
window's rarest term there and intersects its postings, moved by the word's
place in the window, with those of the next rarest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import content_key, ranges, slices, words_of_rows
from pulsegrid.session import freeze, scratch_path

# Bytes of text behind one row of the index.
SHARD_BYTES = 8 << 20
# Windows that go to the index at once; more are searched in further passes.
WINDOWS_PER_PASS = 200_000
# Candidate places that a task checks at once.
CANDIDATES = 2_000_000


def build_index(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the positional index of all words of all documents to ``path``.

    Words are runs of ASCII letters and digits and of anything beyond ASCII,
    A-Z taken as a-z. A null text has no words; every row is a document of its
    own, whether its id is null, repeated or neither; very long texts get a row
    of the index for themselves.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            *[T.StructField(c, T.BinaryType()) for c in ("first_words", "terms", "begins", "postings")],
        ]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, "__text", SHARD_BYTES)):
            h, bounds = words_of_rows(batch.column(1))
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            begins = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), ordered[1:] != ordered[:-1])))
            ids = batch.column(0)
            yield pa.record_batch(
                [
                    pa.array([base + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([bounds.astype("<i8").tobytes()], pa.binary()),
                    pa.array([ordered[begins].astype("<u8").tobytes()], pa.binary()),
                    pa.array([np.append(begins, len(h)).astype("<i8").tobytes()], pa.binary()),
                    pa.array([order.astype("<u4").tobytes()], pa.binary()),
                ],
                names=schema.names,
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    rows.mapInArrow(index, schema).write.option("compression", "zstd").parquet(path)


def indexed_documents(spark: SparkSession, path: str) -> DataFrame:
    """``shard, doc_no, doc_id, n_words`` of every document in the index."""
    store = spark.read.parquet(path).select("shard", "doc_ids", "first_words")
    kind = store.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("doc_no", T.LongType()),
            T.StructField("doc_id", kind),
            T.StructField("n_words", T.LongType()),
        ]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(1)[row].values
                words = np.diff(np.frombuffer(batch.column(2)[row].as_py(), "<i8"))
                shard = np.full(len(ids), batch.column(0)[row].as_py())
                yield pa.record_batch(
                    [pa.array(shard, pa.int64()), pa.array(np.arange(len(ids))), ids, pa.array(words)], names=schema.names
                )

    return store.mapInArrow(documents, schema)


def query_windows(benchmark: DataFrame, *, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, terms``: each run of ``window`` words of an item; a shorter item is one window, one without words none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            h, bounds = words_of_rows(batch.column(1))
            items, terms = [], []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                for start in range(a, max(b - window, a) + 1) if b > a else ():
                    items.append(row)
                    terms.append(h[start : min(start + window, b)].astype("<u8").tobytes())
            yield pa.record_batch(
                [batch.column(0).take(pa.array(items, pa.int64())), pa.array(terms, pa.binary())], names=["item", "terms"]
            )

    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(cut, "item string, terms binary").distinct()


def _search(
    terms: np.ndarray, begins: np.ndarray, postings: np.ndarray, bounds: np.ndarray, queries: np.ndarray, sizes: np.ndarray, slop: int
) -> tuple[np.ndarray, np.ndarray]:
    """Windows and places where each word of the window lies within ``slop`` words of its place."""
    none = np.empty(0, np.int64)
    total = len(postings)
    if not total or not len(queries):
        return none, none
    valid = np.arange(queries.shape[1])[None, :] < sizes[:, None]
    at = np.minimum(np.searchsorted(terms, queries), len(terms) - 1)
    found = (terms[at] == queries) & valid
    alive = np.flatnonzero((found | ~valid).all(axis=1))
    if not len(alive):
        return none, none
    at, sizes = at[alive], sizes[alive]
    counts = np.where(valid[alive], begins[at + 1] - begins[at], np.iinfo(np.int64).max)
    rarest = np.argsort(counts, axis=1, kind="stable")
    keyed = np.repeat(np.arange(len(terms)), np.diff(begins)) * total + postings
    amount = np.take_along_axis(counts, rarest[:, :1], axis=1)[:, 0]
    shifts = np.arange(-slop, slop + 1)
    out, done = [], 0
    while done < len(alive):
        load = np.cumsum(amount[done:]) * len(shifts)
        end = done + max(1, int(np.searchsorted(load, CANDIDATES, side="right")))
        w = np.arange(done, end)
        offset = rarest[w, 0]
        lists = at[w, offset]
        cand = np.repeat(w, amount[w])
        start = postings[ranges(begins[lists], amount[w])].astype(np.int64) - np.repeat(offset, amount[w])
        if slop:
            cand, start = np.repeat(cand, len(shifts)), (start[:, None] + shifts).ravel()
            both = np.unique(np.stack((cand, start)), axis=1)
            cand, start = both[0], both[1]
        doc = np.searchsorted(bounds, start, side="right") - 1
        inside = (start >= 0) & (doc < len(bounds) - 1)
        cand, start, doc = cand[inside], start[inside], doc[inside]
        inside = start + sizes[cand] <= bounds[doc + 1]
        cand, start, doc = cand[inside], start[inside], doc[inside]
        for nth in range(0 if slop else 1, queries.shape[1]):
            if not len(cand):
                break
            offset = rarest[cand, nth]
            there = nth < sizes[cand]
            term = at[cand, np.where(there, offset, 0)]
            low = np.maximum(start + offset - slop, bounds[doc])
            high = np.minimum(start + offset + slop, bounds[doc + 1] - 1)
            k = np.minimum(np.searchsorted(keyed, term * total + low), len(keyed) - 1)
            ok = ~there | ((keyed[k] >= term * total + low) & (keyed[k] <= term * total + high))
            cand, start, doc = cand[ok], start[ok], doc[ok]
        out.append((alive[cand], start))
        done = end
    return tuple(np.concatenate(x) for x in zip(*out))


def benchmark_matches(
    spark: SparkSession,
    path: str,
    benchmark: DataFrame,
    *,
    window: int = 10,
    slop: int = 0,
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Every passage of an indexed document that holds windows of a benchmark item.

    Returns ``shard, doc_no, doc_id, item, first_word, n_words``: windows of one item
    that touch or overlap are one passage. With ``slop`` 0 a window must occur
    word for word; otherwise each of its words must lie within ``slop`` words of
    its place. The windows reach the tasks in passes of bounded size, all of
    them against all rows of the index. Without documents or items no rows.
    """
    windows = freeze(query_windows(benchmark, window=window, item_id=item_id, text=text))
    passes = max(1, -(-windows.count() // WINDOWS_PER_PASS))
    found = None
    for number in range(passes):
        rows = windows.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == number).collect()
        part = _matches_of(spark, path, [r["item"] for r in rows], [bytes(r["terms"]) for r in rows], window, slop)
        found = part if found is None else found.unionByName(part)
    return found


def _matches_of(spark: SparkSession, path: str, items: list[str], terms: list[bytes], window: int, slop: int) -> DataFrame:
    store = spark.read.parquet(path)
    kind = store.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("doc_no", T.LongType()),
            T.StructField("doc_id", kind),
            T.StructField("item", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
    sizes = np.array([len(t) // 8 for t in terms], np.int64)
    queries = np.zeros((len(terms), window), np.uint64)
    for row, t in enumerate(terms):
        queries[row, : len(t) // 8] = np.frombuffer(t, "<u8")
    names, number = np.unique(np.array([i if i is not None else "" for i in items], dtype=object).astype(str), return_inverse=True)
    unnamed = {"" if None in items else None}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                col = {n: batch.column(k)[row] for k, n in enumerate(batch.schema.names)}
                bounds, begins = (np.frombuffer(col[n].as_py(), "<i8") for n in ("first_words", "begins"))
                postings = np.frombuffer(col["postings"].as_py(), "<u4")
                hit, start = _search(np.frombuffer(col["terms"].as_py(), "<u8"), begins, postings, bounds, queries, sizes, slop)
                if not len(hit):
                    continue
                doc = np.searchsorted(bounds, start, side="right") - 1
                item, stop = number[hit], start + sizes[hit]
                order = np.lexsort((start, item, doc))
                doc, item, start, stop = doc[order], item[order], start[order], stop[order]
                # the furthest end so far within the same document and item
                own = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
                reach = np.maximum.accumulate(own * (int(stop.max()) + 1) + stop) - own * (int(stop.max()) + 1)
                new = np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] > reach[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(new)) - 1
                doc, item = doc[first], item[first]
                label = [None if names[i] in unnamed else str(names[i]) for i in item]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(first), col["shard"].as_py()), pa.int64()), pa.array(doc),
                        col["doc_ids"].values.take(pa.array(doc)), pa.array(label, pa.string()),
                        pa.array(start[first] - bounds[doc]), pa.array(reach[last] - start[first]),
                    ],
                    names=schema.names,
                )

    return store.mapInArrow(search, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    slop: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: ``shard, doc_no, doc_id, n_words, n_hit, items``.

    ``n_hit`` counts the document's words inside matched passages, each once;
    ``items`` has the sorted ids, as strings, of the items found. An item
    without an id counts for ``n_hit`` but is not listed; items that share an id
    are listed once.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "postings")
    build_index(docs, path, doc_id=doc_id, text=text)
    matches = benchmark_matches(spark, path, benchmark, window=window, slop=slop, item_id=item_id, text=item_text)
    span = F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words")).alias("b"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(span)),
        zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], x["b"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    hits = matches.groupBy("shard", "doc_no").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return (
        indexed_documents(spark, path)
        .join(hits, ["shard", "doc_no"], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    )


def without_benchmark_text(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no window of the benchmark occurs."""
    keyed = docs.select("*", *content_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    named = keyed.select(F.concat_ws(":", "__k1", "__k2").alias("__name"), F.col(f"`{text}`").alias("__body"))
    hit = contamination(named, benchmark, doc_id="__name", text="__body", **settings).where("n_hit > 0")
    leave = hit.select(F.col("doc_id").alias("__name")).distinct()
    clean = keyed.withColumn("__name", F.concat_ws(":", "__k1", "__k2")).join(leave, "__name", "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
