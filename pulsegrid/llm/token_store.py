"""Token ids in shards of raw binary payload, with a minimal perfect hash index over the keys.

A store has two folders of Parquet files that Spark writes and commits. In
``blocks`` a row is a block: the ids of some documents as one binary payload (2
bytes an id where the vocabulary allows, else 4, little-endian), the documents' keys
and ends, and the block's own index. In ``directory`` a row is a bucket of keys, by
their hash, with a minimal perfect hash to the shard and block of each key. Both
kinds of index take one displacement, one slot and one stored fingerprint,
whatever the number of keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import groups_of, mix, slices
from pulsegrid.llm.tokens import encoder, with_end

BLOCK_SCHEMA = (
    "shard int, block int, n_docs bigint, n_tokens bigint, width int, min_key bigint, max_key bigint, "
    "keys binary, has_key binary, ends binary, displacements binary, fingerprints binary, places binary, payload binary"
)
DIRECTORY_SCHEMA = "bucket bigint, buckets bigint, displacements binary, fingerprints binary, places binary, first binary, last binary"
# Keys of one bucket of the directory.
BUCKET_KEYS = 50_000
# Bytes of a row group, so that a reader skips all but a few blocks.
GROUP_BYTES = 4 << 20
# Stretches of blocks that a lookup asks the scan for; beyond that the nearest ones become one.
STRETCHES = 200
# Bytes of text behind one block.
BLOCK_BYTES = 2 << 20
KEYS_PER_BUCKET = 4
TRIALS = 2048
STEP = np.uint64(0xD1B54A32D192ED03)


def _hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _slot(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + displacement.astype(np.uint64) * STEP) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and displace: ``n`` distinct keys to ``n`` slots, each taken once.

    Returns a displacement per bucket, and per slot the key's fingerprint and
    its place. Buckets are settled from the largest down, those of one size side
    by side; a bucket of one key takes a free slot by its number, kept as ``-1 - slot``.
    """
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    h = _hash(keys)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    displacements = np.zeros(buckets, np.int64)
    free = np.ones(n, bool)
    slots = np.empty(n, np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for size in range(int(sizes.max(initial=0)), 1, -1):
        open_ = np.flatnonzero(sizes == size)
        members = order[begin[open_][:, None] + np.arange(size)]
        trial = np.zeros(len(open_), np.int64)
        while len(open_):
            tried = trial[:, None] + np.arange(max(TRIALS // len(open_), 1))
            s = _slot(h[members][:, None, :], tried[:, :, None], n)
            ranked = np.sort(s, axis=2)
            good = free[s].all(axis=2) & (ranked[:, :, 1:] != ranked[:, :, :-1]).all(axis=2)
            some, at = good.any(axis=1), good.argmax(axis=1)
            able = np.flatnonzero(some)
            asked = s[able, at[able]]
            # of buckets that ask for one slot the first has it, the others try on
            _, first, slot = np.unique(asked, return_index=True, return_inverse=True)
            wins = (first[slot].reshape(asked.shape) // size == np.arange(len(able))[:, None]).all(axis=1)
            won = able[wins]
            displacements[open_[won]] = tried[won, at[won]]
            slots[members[won]] = asked[wins]
            free[asked[wins]] = False
            trial = np.where(some, tried[np.arange(len(open_)), at], trial + tried.shape[1])
            left = np.ones(len(open_), bool)
            left[won] = False
            open_, members, trial = open_[left], members[left], trial[left]
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    displacements[single] = -1 - left
    slots[order[begin[single]]] = left
    fingerprints = np.empty(n, np.uint32)
    stored = np.empty(n, np.uint32)
    fingerprints[slots] = _fingerprint(h)
    stored[slots] = places
    return displacements, fingerprints, stored


def find(keys: np.ndarray, displacements: np.ndarray, fingerprints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where its fingerprint is not in the index."""
    n = len(fingerprints)
    if not n:
        return np.full(len(keys), -1, np.int64)
    h = _hash(keys)
    d = displacements[(h % np.uint64(len(displacements))).astype(np.int64)]
    slot = np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), n))
    return np.where(fingerprints[slot] == _fingerprint(h), places[slot].astype(np.int64), -1)


def write_token_store(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending order of the key.

    The key is an integer; null keys come first, can be read and have no place in
    the index. Rows that share a key lie one after another in the order of a hash
    of their text, and a key leads to the first of them. A null or empty text is
    the end id alone. No rows give an empty store. Each block is made from some
    2 MB of text or from one longer text, and a hot key is spread over shards.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    order = ["__key", F.xxhash64("__text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, schema = TaskContext.get().partitionId(), None
        for number, batch in enumerate(slices(batches, "__text", BLOCK_BYTES)):
            enc = encoder(tokenizer)
            ids, bounds = with_end(*enc.encode(batch.column(1)), end_id)
            width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            there = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            distinct, first = np.unique(keys[there], return_index=True)
            index = build_index(distinct, np.flatnonzero(there)[first])
            values = {
                "shard": shard, "block": number, "n_docs": len(keys), "n_tokens": len(ids), "width": width,
                "min_key": int(distinct[0]) if len(distinct) else None,
                "max_key": int(distinct[-1]) if len(distinct) else None,
                "keys": keys.astype("<i8").tobytes(), "has_key": there.astype(np.uint8).tobytes(),
                "ends": bounds[1:].astype("<i8").tobytes(), "displacements": index[0].astype("<i8").tobytes(),
                "fingerprints": index[1].astype("<u4").tobytes(), "places": index[2].astype("<u4").tobytes(),
                "payload": ids.astype(f"<u{width}").tobytes(),
            }
            schema = schema or pa.schema(
                [(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BLOCK_SCHEMA.split(", "))]
            )
            yield pa.RecordBatch.from_pylist([values], schema=schema)

    _written(placed.mapInArrow(blocks, BLOCK_SCHEMA), f"{path}/blocks")
    _write_directory(_blocks(docs.sparkSession, path), f"{path}/directory")


def _written(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES)).parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By other bits than those that the index of a bucket uses."""
    return (mix(_hash(keys) + STEP) % np.uint64(buckets)).astype(np.int64)


def _write_directory(store: DataFrame, path: str) -> None:
    """Buckets of keys, each with a perfect hash to the first and last block that hold the key.

    A block gives each of its keys once; keys that many blocks hold are reduced
    before the shuffle. Blocks are numbered ``shard * 2**32 + block``, in key order.
    """
    total = store.agg(F.sum("n_docs")).first()[0] or 0
    buckets = -(-total // BUCKET_KEYS) or 1

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                there = _array(batch, row, "has_key", "u1") > 0
                keys = np.unique(_array(batch, row, "keys", "<i8")[there])
                at = (batch.column(0)[row].as_py() << 32) + batch.column(1)[row].as_py()
                yield pa.record_batch([pa.array(_bucket(keys, buckets)), pa.array(keys), pa.array(np.full(len(keys), at))], names=["bucket", "key", "at"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket"]):
            keys, first, last = (group.column(c).to_numpy() for c in ("key", "first", "last"))
            found = build_index(keys, np.arange(len(keys)))
            yield pa.record_batch(
                [
                    pa.array([group.column("bucket")[0].as_py()], pa.int64()), pa.array([buckets], pa.int64()),
                    *[pa.array([a.astype(kind).tobytes()], pa.binary()) for a, kind in zip(found, ("<i8", "<u4", "<u4"))],
                    *[pa.array([a.astype("<i8").tobytes()], pa.binary()) for a in (first, last)],
                ],
                names=[c.split()[0] for c in DIRECTORY_SCHEMA.split(", ")],
            )

    keys = store.select("shard", "block", "keys", "has_key").mapInArrow(keys_of, "bucket bigint, key bigint, at bigint")
    places = keys.groupBy("bucket", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    _written(places.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(index, DIRECTORY_SCHEMA), path)


def _array(batch: pa.RecordBatch, row: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)


def _index_of(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, ...]:
    kinds = (("displacements", "<i8"), ("fingerprints", "<u4"), ("places", "<u4"))
    return tuple(_array(batch, row, n, k) for n, k in kinds)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document as ``key, start, n_tokens, ids_crc32``, read from the files.

    ``start`` counts the ids of all documents before it. Every key is looked up
    in the index on the way; one that the index does not take to the first
    document of that key raises.
    """
    store = _blocks(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, there = _array(batch, row, "keys", "<i8"), _array(batch, row, "has_key", "u1") > 0
                ends = _array(batch, row, "ends", "<i8")
                width = batch.column(batch.schema.get_field_index("width"))[row].as_py()
                ids = _array(batch, row, "payload", f"<u{width}").astype("<u4")
                place = find(keys[there], *_index_of(batch, row))
                own = np.flatnonzero(there)
                if not ((place >= 0) & (place <= own)).all() or not (keys[place] == keys[own]).all():
                    raise ValueError("the index of a block does not lead to its documents")
                begin = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
                n = len(keys)
                at = [np.full(n, batch.column(batch.schema.get_field_index(c))[row].as_py()) for c in ("shard", "block")]
                yield pa.record_batch(
                    [
                        pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(keys, mask=~there),
                        pa.array(begin, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "block", "key", "begin", "n_tokens", "ids_crc32"],
                )

    rows = store.mapInArrow(
        documents, "shard int, block int, key bigint, begin bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return (
        rows.join(block_starts(store), ["shard", "block"])
        .select("key", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
    )


def block_starts(store: DataFrame) -> DataFrame:
    """``shard, block, base``: ids before each block. Only one row per shard meets in one task."""
    earlier = (Window.unboundedPreceding, -1)
    sizes = store.select("shard", "block", "n_tokens")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(*earlier)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    of_shard = shards.select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*earlier)), F.lit(0)).alias("of_shard")
    )
    return (
        sizes.withColumn("of_block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(of_shard, "shard")
        .select("shard", "block", (F.col("of_shard") + F.col("of_block")).alias("base"))
    )


def places(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """``key, first, last``: the numbers of the first and last block that hold each key, from the buckets of the keys alone.

    A key that is not in the store gives no row, or, where its fingerprint
    is another key's, a block that does not hold it.
    """
    directory = spark.read.schema(DIRECTORY_SCHEMA).parquet(f"{path}/directory")
    wanted = np.unique(np.asarray(list(keys), np.int64))
    some = directory.select("buckets").first()
    buckets = some[0] if some else 1
    bucket = _bucket(wanted, buckets)

    def find_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                mine = wanted[bucket == batch.column(0)[row].as_py()]
                place = find(mine, *_index_of(batch, row))
                first, last = (_array(batch, row, c, "<i8")[place[place >= 0]] for c in ("first", "last"))
                yield pa.record_batch([pa.array(mine[place >= 0]), pa.array(first), pa.array(last)], names=["key", "first", "last"])

    asked = directory.where(F.col("bucket").isin(np.unique(bucket).tolist()))
    return asked.mapInArrow(find_keys, "key bigint, first bigint, last bigint")


def blocks_with(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """The blocks to which the directory takes the keys. The caller holds the keys, so their places fit the driver too."""
    stretches: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in places(spark, path, keys).collect()):
        if stretches and first <= stretches[-1][1] + 1:
            stretches[-1][1] = max(stretches[-1][1], last)
        else:
            stretches.append([first, last])
    gaps = sorted(range(1, len(stretches)), key=lambda k: stretches[k][0] - stretches[k - 1][1], reverse=True)
    edges = [0, *sorted(gaps[: STRETCHES - 1]), len(stretches)]
    number = F.col("shard").cast("bigint") * (1 << 32) + F.col("block")
    inside = F.lit(False)
    for a, b in zip(edges, edges[1:]):
        if a < b:
            first, last = stretches[a][0], stretches[b - 1][1]
            # plain conditions on shard and block reach the scan's statistics
            near = F.col("shard").between(first >> 32, last >> 32)
            if first >> 32 == last >> 32:
                near &= F.col("block").between(first & 0xFFFFFFFF, last & 0xFFFFFFFF)
            inside |= near & number.between(first, last)
    return _blocks(spark, path).where(inside)


def lookup(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """``key, ids`` of the documents stored under ``keys``, a list that the caller holds.

    The directory's buckets of the keys name the blocks, only those are read, and
    in each a key takes one step in the block's index. All documents of a repeated
    key are returned; unknown keys give no row.
    """
    wanted = np.unique(np.asarray(list(keys), np.int64))
    store = blocks_with(spark, path, wanted.tolist())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                stored, ends = _array(batch, row, "keys", "<i8"), _array(batch, row, "ends", "<i8")
                there = _array(batch, row, "has_key", "u1") > 0
                width = batch.column(batch.schema.get_field_index("width"))[row].as_py()
                ids = _array(batch, row, "payload", f"<u{width}")
                for key, place in zip(wanted.tolist(), find(wanted, *_index_of(batch, row)).tolist()):
                    while 0 <= place < len(stored) and there[place] and stored[place] == key:
                        a, b = int(ends[place - 1]) if place else 0, int(ends[place])
                        yield pa.record_batch(
                            [pa.array([key], pa.int64()), pa.array([ids[a:b].astype(np.int64).tolist()], pa.list_(pa.int64()))],
                            names=["key", "ids"],
                        )
                        place += 1

    return store.mapInArrow(documents, "key bigint, ids array<bigint>")
