"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import freeze

# Characters behind the prefix hash.
PREFIX = 256
# Bits of the filter that marks lengths and prefixes met more than once: 1 MiB,
# whatever the size of the corpus. A false mark only costs one full hash.
FILTER_BITS = 1 << 23


def without_space(text: Column) -> Column:
    """The text, null as empty, without the white space of ASCII."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "")


def _bit(length: Column, prefix: Column) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(FILTER_BITS))


def exact_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept`` and the columns in ``carry``.

    Texts are equal if they are identical without the white space of ASCII; null
    counts as empty, so null and empty texts are one group. Of equal texts the one
    with the most code points stays, then the one with the smallest id (nulls
    last); of rows that repeat text and id exactly one stays.

    Lengths are counted first. Only rows whose length occurs twice are counted
    by prefix hash, and only rows whose prefix does get a full hash. The first
    pass keeps two numbers per row; what it found comes back as a bit filter of
    fixed size, so no text is ever shuffled.
    """
    body = without_space(F.col(f"`{text}`"))
    sketch = freeze(docs.select(F.length(body).alias("length"), F.xxhash64(F.substring(body, 1, PREFIX)).alias("prefix")))
    lengths = sketch.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    repeated = sketch.join(lengths, "length", "left_semi").groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    bit = _bit(F.col("length"), F.col("prefix"))
    marks = repeated.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits")
    )
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("__id"),
        F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).alias("__points"),
        body.alias("__body"),
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)],
    )
    bit = _bit(F.length("__body"), F.xxhash64(F.substring("__body", 1, PREFIX)))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    # marks has at most FILTER_BITS / 8 bytes
    hashed = freeze(
        rows.withColumn("__bucket", F.bitmap_bucket_number(bit))
        .join(F.broadcast(marks), "__bucket", "left")
        .select(
            "__id",
            "__points",
            F.when(marked, F.sha2("__body", 256)).alias("__full"),
            *[f"__c{i}" for i in range(len(carry))],
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    order = F.struct(-F.col("__points"), F.col("__id").isNull(), F.col("__id").alias("id"), F.col("__row").alias("row"))
    best = (
        hashed.where("__full is not null").groupBy("__full").agg(F.min(order).alias("__best"), F.count("*").alias("__n"))
    )
    shared = hashed.where("__full is not null").join(best, "__full")
    carried = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    many = shared.select(
        F.col("__id").alias("doc_id"),
        F.col("__best.id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__best.row")).alias("kept"),
        *carried,
    )
    alone = hashed.where("__full is null").select(
        F.col("__id").alias("doc_id"),
        F.col("__id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        *carried,
    )
    return many.unionByName(alone)
