"""Jaccard join on word n-grams: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import content_key, groups_of, mix, slices, words_of_rows
from pulsegrid.plans.components import connected_components
from pulsegrid.session import freeze

# A block of a candidate cluster holds about so many n-grams, and so many texts.
BLOCK_GRAMS = 2_000_000
BLOCK_TEXTS = 4_096


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows a band: the longest bands with which a pair at the threshold is found with probability ``recall``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def ngram_hashes(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` consecutive words at each place, and where each row's begin.

    A row of fewer words, but not none, has one n-gram of all its words.
    """
    sizes = np.diff(bounds)
    grams = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.cumsum(np.concatenate(([0], grams)))
    starts = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], grams)
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    g = np.zeros(len(starts), np.uint64)
    for k in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + padded[starts + k]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    for row in short:
        v = 0
        for w in h[bounds[row] : bounds[row + 1]].tolist():
            v = (v * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
        g[out[row]] = v ^ int(sizes[row])
    return mix(g), out


def _sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``__k1, __k2, id, n_grams, set1, set2, bands`` of every row; no n-grams, no bands."""
    kind = docs.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("__k1", T.LongType()),
            T.StructField("__k2", T.LongType()),
            T.StructField("id", kind),
            T.StructField("n_grams", T.LongType()),
            T.StructField("set1", T.LongType()),
            T.StructField("set2", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    draw = np.random.default_rng(11)
    flips = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factors = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            grams, bounds = ngram_hashes(*words_of_rows(col["text"]), n)
            count = len(bounds) - 1
            full = np.flatnonzero(np.diff(bounds))
            sets = np.zeros((3, count), np.uint64)
            for row in full.tolist():
                own = np.sort(grams[bounds[row] : bounds[row + 1]])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                sets[:, row] = len(own), own.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own))
            x = (grams >> np.uint64(32)).astype(np.uint32)
            t = np.empty_like(x)
            hashes = np.zeros((bands, len(full)), np.uint64)
            for k in range(bands * rows if len(full) else 0):
                np.bitwise_xor(x, flips[k], out=t)
                np.multiply(t, factors[k], out=t)
                least = np.minimum.reduceat(t, bounds[full]).astype(np.uint64)
                hashes[k // rows] = mix(hashes[k // rows] + least + np.uint64(k + 1))
            offsets = np.zeros(count + 1, np.int32)
            offsets[full + 1] = bands
            yield pa.record_batch(
                [
                    col["__k1"], col["__k2"], col["id"], *(pa.array(s.view(np.int64)) for s in sets),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(hashes.T.ravel().view(np.int64))),
                ],
                names=schema.names,
            )

    return docs.select("__k1", "__k2", "id", "text").mapInArrow(sketch, schema)


def _clusters(classes: DataFrame) -> DataFrame:
    """``cid, root``: classes that may be linked, directly or over others, because they share bands."""
    keyed = classes.select("cid", F.posexplode("bands")).select("cid", F.xxhash64("pos", "col").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("cid").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = freeze(
        keyed.join(shared.select("band", "least"), "band")
        .where("cid <> least")
        .select(F.col("cid").alias("u"), F.col("least").alias("v"))
        .distinct()
    )
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    return connected_components(nodes, edges).select(F.col("id").alias("cid"), "root")


def _verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``cid, n_links, local``: links of each class within its group of blocks, and the least class it hangs together with.

    All pairs of a group that share a band are compared on their whole sets of
    n-grams. Only one row per class leaves a group.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["root", "b1", "b2"]):
            cid, first = np.unique(group["cid"].to_numpy(), return_index=True)
            group = group.take(pa.array(first))
            if len(cid) < 2:
                continue
            block = group["block"].to_numpy()
            across = group["b1"][0].as_py() != group["b2"][0].as_py()
            flat = group["bands"].combine_chunks()
            bands = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)
            grams, bounds = ngram_hashes(*words_of_rows(group["text"]), n)
            sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.array([len(s) for s in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            begins = np.concatenate(([0], np.cumsum(sizes)))
            near = np.zeros((len(cid), len(cid)), bool)
            for band in bands.T:
                order = np.argsort(band, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], band[order][1:] != band[order][:-1], [True])))
                for a, b in zip(edges[:-1], edges[1:]):
                    if b - a > 1:
                        near[np.ix_(order[a:b], order[a:b])] = True
            if across:
                near &= block[:, None] != block[None, :]
            links = np.zeros(len(cid), np.int64)
            head = np.arange(len(cid))
            mark = np.zeros(int(code.max()) + 1, bool)
            for a in range(len(cid) - 1):
                others = a + 1 + np.flatnonzero(near[a, a + 1 :])
                ratio = np.minimum(sizes[others], sizes[a]) / np.maximum(sizes[others], sizes[a])
                others = others[ratio >= threshold]
                if not len(others):
                    continue
                own = code[begins[a] : begins[a + 1]]
                mark[own] = True
                # the places of the other sets, one after another
                lengths = sizes[others]
                at = np.arange(int(lengths.sum())) + np.repeat(begins[others] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
                both = np.add.reduceat(mark[code[at]].astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
                mark[own] = False
                linked = others[both / (sizes[a] + lengths - both) >= threshold]
                links[a] += len(linked)
                links[linked] += 1
                if len(linked):
                    joined = np.unique(head[np.append(linked, a)])
                    head[np.isin(head, joined)] = joined[0]
            some = np.flatnonzero(links)
            if len(some):
                yield pa.record_batch(
                    [pa.array(cid[some]), pa.array(links[some]), pa.array(cid[head[some]])], names=["cid", "n_links", "local"]
                )

    return members.mapInArrow(verify, "cid bigint, n_links bigint, local bigint")


def jaccard_classes(
    docs: DataFrame,
    *,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9995,
    max_hashes: int = 384,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, text_class, n_links, n_grams, __class, __k1, __k2``.

    Two texts are linked if the Jaccard similarity of their sets of ``n`` words
    (runs of ASCII letters and digits and anything beyond ASCII, A-Z as a-z)
    reaches ``threshold``. Texts with the same set are one text; ``text_class`` is
    the smallest id that has it. ``n_links`` counts the other texts that a text is
    linked to, ``class_id`` is the smallest id of all that hang together by
    links. A pair at the threshold is found with probability ``recall``, more
    similar ones with a higher one; what is found is verified on whole sets.

    A text without words (null, empty or other signs only) is never linked and
    is a class of its own. A text of fewer than ``n`` words is one n-gram. Null ids
    come after all others. ``__k1, __k2`` identify id and text; rows that repeat
    both are alike in every column. A class whose ids are all null has a null id;
    ``__class`` tells classes apart even where they share an id (null: no words).

    Equal texts are folded before anything is compared. Clusters of texts that
    share bands are cut into blocks of bounded size, and pairs of blocks are
    compared by task, so neither a large group of copies nor one of near copies
    meets in one place or is written out as pairs.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    keyed = docs.select(
        *content_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    sketch = freeze(_sketches(keyed, n, bands, rows))
    by_set = ["set1", "set2", "n_grams"]
    least = F.min(F.struct(F.col("id").isNull(), "id", "__k1", "__k2")).alias("rep")
    grouped = sketch.where("n_grams > 0").groupBy(*by_set).agg(least, F.first("bands").alias("bands"))
    classes = freeze(grouped.select(F.monotonically_increasing_id().alias("cid"), *by_set, "rep.id", "rep.__k1", "rep.__k2", "bands"))
    cluster = freeze(_clusters(classes))
    sizes = cluster.join(classes.select("cid", "n_grams"), "cid").groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n_grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_TEXTS), F.lit(1)).cast("int").alias("blocks")
    )
    members = cluster.join(sizes, "root").join(classes.select("cid", "__k1", "__k2", "bands"), "cid")
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    texts = (
        keyed.select("__k1", "__k2", "text")
        .join(members, ["__k1", "__k2"])
        .select("cid", "root", "block", "bands", "text", other.alias("other"))
        .select("cid", "root", "block", "bands", "text", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
        .repartition("root", "b1", "b2")
        .sortWithinPartitions("root", "b1", "b2")
    )
    checked = freeze(_verified(texts, n, threshold))
    links = checked.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    edges = checked.where("cid <> local").select(F.col("cid").alias("u"), F.col("local").alias("v"))
    groups = connected_components(links.select(F.col("cid").alias("id")), edges).select(F.col("id").alias("cid"), "root")
    named = classes.select("cid", "id", *by_set)
    order = F.struct(F.col("id").isNull(), "id").alias("first")
    heads = named.join(groups, "cid").groupBy("root").agg(F.min(order).alias("head")).select("root", F.col("head.id").alias("class_id"))
    linked = groups.join(heads, "root").join(links, "cid").select("cid", "root", "class_id", "n_links", F.lit(True).alias("linked"))
    result = named.join(linked, "cid", "left").select(
        *by_set,
        F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.col("id").alias("text_class"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("root", "cid").alias("__class"),
    )
    wordless = sketch.where("n_grams = 0").select(
        "__k1", "__k2", F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("text_class"),
        F.lit(0).cast("bigint").alias("n_links"), "n_grams", F.lit(None).cast("bigint").alias("__class"),
    )
    worded = sketch.where("n_grams > 0").join(result, by_set)
    columns = ["doc_id", "class_id", "text_class", "n_links", "n_grams", "__class", "__k1", "__k2"]
    return worded.withColumnRenamed("id", "doc_id").select(*columns).unionByName(wordless.select(*columns))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest id stays, nulls last.

    Texts without words all stay. Of rows that repeat id and text in a class one stays.
    """
    found = freeze(jaccard_classes(docs, doc_id=doc_id, text=text, **settings))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2").alias("first")
    worded = found.where("n_grams > 0")
    heads = worded.groupBy("__class").agg(F.min(order).alias("first"))
    rows = worded.groupBy("__class", "__k1", "__k2").agg(F.count("*").alias("n"))
    joined = rows.join(heads, "__class")
    stays = (F.col("first.__k1") == F.col("__k1")) & (F.col("first.__k2") == F.col("__k2"))
    decided = freeze(joined.select("__k1", "__k2", "n", stays.alias("stays")))
    keyed = docs.select("*", *content_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    leave = decided.where("n > 1 or not stays").select("__k1", "__k2")
    repeated = decided.where("n > 1 and stays").select("__k1", "__k2")
    once = keyed.join(leave, ["__k1", "__k2"], "left_anti")
    first = keyed.join(repeated, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return once.unionByName(first).select(*[F.col(f"`{c}`") for c in docs.columns])
