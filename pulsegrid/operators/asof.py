"""Nearest-in-time join of two series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import micros
from pulsegrid.plans.ordered import neighbours


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    ts: str,
    tie: str,
    values: Sequence[str],
    tolerance_s: float,
    by: Sequence[str] = (),
    suffixes: tuple[str, str] = ("_left", "_right"),
    drop_incomplete: bool = True,
) -> DataFrame:
    """Each left row with the right row closest in time, at most ``tolerance_s`` away.

    At equal distance the earlier right row wins; among right rows of one moment
    the last one by ``tie`` looking back and the first one looking ahead. Both series are put into one ordered
    sequence; the neighbours of a left row are the last right row before it and
    the first one after it. Without ``by`` the sequence is cut into ranges.
    """
    on_left = left.where(F.col(ts).isNotNull()).select(
        *by,
        F.col(ts).alias("__ts"),
        F.lit(1).alias("__side"),
        F.col(tie).alias("__tie"),
        F.struct(tie, *values).alias("__l"),
        F.lit(None).alias("__r"),
    )
    # the right rows of one moment are reduced to two before they are ordered
    picked = F.struct(F.col(ts).alias("ts"), tie, *values)
    moments = right.where(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).alias("__ts")).agg(
        F.max_by(picked, F.col(tie)).alias("last"), F.min_by(picked, F.col(tie)).alias("first")
    )
    on_right = moments.select(
        *by,
        "__ts",
        F.lit(0).alias("__side"),
        F.col(f"last.{tie}").alias("__tie"),
        F.lit(None).alias("__l"),
        F.struct("last", "first").alias("__r"),
    )
    line = on_left.unionByName(on_right)
    order = [F.col("__ts"), F.col("__side"), F.col("__tie")]
    near = neighbours(line, list(by), order, {"__r": ("__before", "__after")}).where("__side = 1")
    before, after = F.col("__before.last"), F.col("__after.first")
    gap_before = micros(F.col("__ts")) - micros(before["ts"])
    gap_after = micros(after["ts"]) - micros(F.col("__ts"))
    take_after = gap_before.isNull() | (gap_after < gap_before)
    best = F.when(take_after, after).otherwise(before)
    gap = F.when(take_after, gap_after).otherwise(gap_before)
    hit = gap <= int(tolerance_s * 1_000_000)
    out = near.select(
        *by,
        F.col("__ts").alias(ts),
        F.col(f"__l.{tie}").alias(tie),
        *[F.col(f"__l.{v}").alias(f"{v}{suffixes[0]}") for v in values],
        F.when(hit, best["ts"]).alias(f"{ts}{suffixes[1]}"),
        *[F.when(hit, best[v]).alias(f"{v}{suffixes[1]}") for v in values],
        F.when(hit, gap / 1_000_000).alias("gap_s"),
    )
    return out.dropna(how="any") if drop_incomplete else out
