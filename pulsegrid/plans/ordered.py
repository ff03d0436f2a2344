"""Ordered computation per key that no single key can overload.

A window partitioned by entity puts all rows of an entity into one task. That
is the right plan while the largest entity is small, so it is measured first.
Beyond the limit (and always when there is no key at all) rows are
range-partitioned on ``(keys, order)``, whatever the key distribution; each
range is processed on its own, and what crosses range borders travels in a
carry table. Only the key that a range begins or ends with can need a carry, so
that table has at most two rows per range. Whether to broadcast it is left to
Spark's own check of its size.

``order`` must be unique within a key; pass a tie-break column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.session import freeze, max_group_rows

CHUNK, POS, RN = "__chunk", "__pos", "__rn"
_POS_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


# Rows that one range is meant to hold; a large table is cut into as many ranges as that takes.
RANGE_ROWS = 1_000_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the table; one partial aggregation over the key columns."""
    sizes = df.groupBy(*keys).count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, total or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


def _plan(df: DataFrame, keys: Sequence[str]) -> tuple[bool, int]:
    """Whether every key fits one task, and the number of ranges to use otherwise."""
    largest, total = group_sizes(df, keys)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    return bool(keys) and largest <= max_group_rows(df.sparkSession), ranges


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int) -> DataFrame:
    """Rows sorted by ``(keys, order)`` in balanced ranges, frozen, with range id and position.

    Writing the result makes the placement data: a re-computed task or a second
    branch of the plan cannot see other range borders.
    """
    by = [F.col(k) for k in keys] + list(order)
    mid = F.col("__mid")
    ranged = (
        df.repartitionByRange(ranges, *by)
        .sortWithinPartitions(*by)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumns(
            {
                CHUNK: F.shiftright(mid, _POS_BITS),
                POS: mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)),
            }
        )
        .drop("__mid")
    )
    return freeze(ranged)


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left JOIN right USING (on)``, a NULL key being a key like any other, as it is for windows and groupings."""
    named = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(on)})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(on)]
    return left.join(named, same, how).drop(*[f"__r{i}" for i in range(len(on))])


def _unbounded_to(w: WindowSpec, end: int) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, end)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """Running totals per key, current row included."""
    fits, ranges = _plan(df, keys)
    if fits:
        w = _unbounded_to(Window.partitionBy(*keys).orderBy(*order), 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    parts = range_chunks(
        df.withColumns({f"__w_{name}": c for name, c in sums.items()}), keys, order, ranges
    )
    local = _unbounded_to(Window.partitionBy(CHUNK, *keys).orderBy(POS), 0)
    totals = parts.groupBy(CHUNK, *keys).agg(
        *[F.sum(f"__w_{name}").alias(f"__t_{name}") for name in sums]
    )
    before = _unbounded_to(Window.partitionBy(*keys).orderBy(CHUNK), -1)
    carry = totals.select(
        CHUNK, *keys, *[F.sum(f"__t_{name}").over(before).alias(f"__c_{name}") for name in sums]
    ).where(" or ".join(f"__c_{name} is not null" for name in sums))
    summed = parts.withColumns({f"__l_{name}": F.sum(f"__w_{name}").over(local) for name in sums})
    joined = matched(summed, carry, [CHUNK, *keys], "left")
    return joined.select(
        *df.columns,
        *[
            # a NULL part means "nothing summed yet", so it must not wipe out the other part
            F.coalesce(
                F.col(f"__l_{name}") + F.col(f"__c_{name}"), f"__l_{name}", f"__c_{name}"
            ).alias(name)
            for name in sums
        ],
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = RN
) -> DataFrame:
    """1-based row number per key (or over the whole table)."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: dict[str, tuple[str, str]]
) -> DataFrame:
    """For each column the last non-null value up to, and the first from, the current row.

    ``cols`` maps a column to the two output names ``(previous, next)``; ``order`` is ascending. The
    next value is the last one seen in reverse order: a frame that ends at the current row is
    extended row by row, one that begins there is evaluated anew for each row.
    """
    fits, ranges = _plan(df, keys)
    if fits:
        by = Window.partitionBy(*keys)
        back = _unbounded_to(by.orderBy(*order), 0)
        ahead = _unbounded_to(by.orderBy(*[c.desc() for c in order]), 0)
        return df.withColumns(
            {p: F.last(c, ignorenulls=True).over(back) for c, (p, _) in cols.items()}
            | {n: F.last(c, ignorenulls=True).over(ahead) for c, (_, n) in cols.items()}
        )
    parts = range_chunks(df, keys, order, ranges)
    by = Window.partitionBy(CHUNK, *keys)
    back, ahead = _unbounded_to(by.orderBy(POS), 0), _unbounded_to(by.orderBy(F.col(POS).desc()), 0)
    edges = parts.groupBy(CHUNK, *keys).agg(
        *[
            agg(c, F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"{side}_{c}")
            for c in cols
            for side, agg in (("__last", F.max_by), ("__first", F.min_by))
        ]
    )
    over_keys = Window.partitionBy(*keys)
    before = _unbounded_to(over_keys.orderBy(CHUNK), -1)
    after = _unbounded_to(over_keys.orderBy(F.col(CHUNK).desc()), -1)
    carry = edges.select(
        CHUNK,
        *keys,
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__cp_{c}") for c in cols],
        *[F.last(f"__first_{c}", ignorenulls=True).over(after).alias(f"__cn_{c}") for c in cols],
    ).where(" or ".join(f"`__cp_{c}` is not null or `__cn_{c}` is not null" for c in cols))
    local = parts.withColumns(
        {f"__lp_{c}": F.last(c, ignorenulls=True).over(back) for c in cols}
        | {f"__ln_{c}": F.last(c, ignorenulls=True).over(ahead) for c in cols}
    )
    return matched(local, carry, [CHUNK, *keys], "left").select(
        *df.columns,
        *[F.coalesce(f"__lp_{c}", f"__cp_{c}").alias(p) for c, (p, _) in cols.items()],
        *[F.coalesce(f"__ln_{c}", f"__cn_{c}").alias(n) for c, (_, n) in cols.items()],
    )


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int,
) -> DataFrame:
    """Window expressions that look at most ``back`` rows behind the current one.

    Large keys are cut into blocks of consecutive rows; the last ``back`` rows of
    a block are copied to the next one as context and dropped afterwards.
    """
    if _plan(df, keys)[0]:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))
    block_rows = max(max_group_rows(df.sparkSession), back + 1)
    numbered = position(df, keys, order)
    at = F.col(RN) - 1
    own = F.floor(at / block_rows)
    targets = F.when(at % block_rows >= block_rows - back, F.array(own, own + 1)).otherwise(
        F.array(own)
    )
    spread = numbered.withColumn("__own", own).withColumn("__block", F.explode(targets))
    out = spread.withColumns(build(Window.partitionBy(*keys, "__block").orderBy(RN)))
    new = [c for c in out.columns if c not in spread.columns]
    return out.where(F.col("__own") == F.col("__block")).select(*df.columns, *new)
