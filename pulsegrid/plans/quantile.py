"""Exact quantiles with linear interpolation, for groups of any size.

``percentile`` keeps one counter per distinct value of a group in one task.
That is used while the largest group is small. Beyond that, values are reduced
to counts per ``(group, value)``, a running total over ranges gives each value
its rank, and the two order statistics of each quantile fall out of a plain
``min`` aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import largest_group, matched, running_sums
from pulsegrid.session import freeze, max_group_rows


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per group with a column for each named probability; NULL values are skipped."""
    data = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    spark = df.sparkSession
    if largest_group(data, keys) <= max_group_rows(spark):
        q = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs.values()]))
        return data.groupBy(*keys).agg(q.alias("__q")).select(
            *keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
        )
    # read for the ranges, the ranks and the totals, so it is written once
    counts = freeze(data.groupBy(*keys, "__v").agg(F.count("*").alias("__n")))
    ranked = running_sums(counts, keys, [F.col("__v")], {"__cum": F.col("__n")})
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    # the totals have one row per group; without keys it is a single row
    ranked = matched(ranked, totals, list(keys)) if keys else ranked.crossJoin(F.broadcast(totals))
    picks, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        picks += [
            F.min(F.when(F.col("__cum") > F.floor(pos), F.col("__v"))).alias(f"__lo{i}"),
            F.min(F.when(F.col("__cum") > F.ceil(pos), F.col("__v"))).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
        outs.append(
            (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name)
        )
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outs)


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "column") -> DataFrame:
    """Long form ``(keys, column, value)`` of numeric columns."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot([F.col(k) for k in keys], [F.col(c) for c in cols], name, "value")


def columns_as_rows(row: DataFrame, cols: Sequence[str], fields: Sequence[str], name: str = "column") -> DataFrame:
    """One aggregate row with columns ``<field>_<position>`` as one row per column."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias(name), *[F.col(f"{f}_{i}").alias(f) for f in fields])
            for i, c in enumerate(cols)
        ]
    )
    return row.select(F.explode(entries).alias("__e")).select("__e.*")


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], name: str = "column"
) -> DataFrame:
    """Quantiles of whole columns, one row per column.

    A small table takes one aggregation over all columns. A large one is put in
    long form, where each column is a group like any other.
    """
    if df.count() > max_group_rows(df.sparkSession):
        found = exact_quantiles(melt(df, [], cols, name), [name], "value", probs)
        # a column without any value has a row as well
        return df.sparkSession.createDataFrame([(c,) for c in cols], f"`{name}` string").join(found, name, "left")
    q = F.array(*[F.lit(float(p)) for p in probs.values()])
    row = df.agg(*[F.percentile(F.col(c).cast("double"), q).alias(f"q_{i}") for i, c in enumerate(cols)])
    return columns_as_rows(row, cols, ["q"], name).select(
        name, *[F.col("q")[i].alias(p) for i, p in enumerate(probs)]
    )


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float]
) -> dict[str, dict[str, float]]:
    """Quantiles of whole columns, as numbers for the driver (one row per column)."""
    found = {r["column"]: {p: r[p] for p in probs} for r in quantile_table(df, cols, probs).collect()}
    return {c: found.get(c, dict.fromkeys(probs)) for c in cols}
