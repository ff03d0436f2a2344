"""Ordered features per entity. ``order`` must end in a tie-break column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import seconds_between
from pulsegrid.plans.ordered import neighbours, position, windowed
from pulsegrid.plans.quantile import exact_quantiles


def _cols(order: Sequence[str]) -> list:
    return [F.col(c) for c in order]


def lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, steps: Sequence[int]) -> DataFrame:
    return windowed(
        df, keys, _cols(order), lambda w: {f"{col}_lag{n}": F.lag(col, n).over(w) for n in steps}, max(steps)
    )


def first_difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    return windowed(
        df,
        keys,
        _cols(order),
        lambda w: {out: F.col(c) - F.lag(c, 1).over(w) for c, out in cols.items()},
        1,
    )


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, rows: int = 3) -> DataFrame:
    """Mean and sample std over the last ``rows`` rows, current one included; std of one row is NULL."""
    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return {
            f"{col}_rolling_mean": F.avg(col).over(frame),
            f"{col}_rolling_std": F.stddev_samp(col).over(frame),
        }

    return windowed(df, keys, _cols(order), build, rows - 1)


def sequence_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq_position") -> DataFrame:
    """Position within the entity, from 0."""
    return position(df, keys, _cols(order), "__p").withColumn(out, F.col("__p") - 1).drop("__p")


def median_spacing(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Median seconds between consecutive rows."""
    gaps = windowed(
        df.where(F.col(ts).isNotNull()).select(*keys, ts, tie),
        keys,
        _cols([ts, tie]),
        lambda w: {"__gap": seconds_between(F.col(ts), F.lag(ts, 1).over(w))},
        1,
    )
    return exact_quantiles(gaps, keys, "__gap", {"median_spacing_s": 0.5})


def fill_missing(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, then the column mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    names = {c: (f"__p_{c}", f"__n_{c}") for c in cols}
    near = neighbours(df, keys, _cols(order), names)
    filled = {
        c: F.coalesce(F.col(p).cast("double"), F.col(n).cast("double"), F.lit(means[c]))
        for c, (p, n) in names.items()
    }
    return near.withColumns(filled).select(*df.columns)


def sliding_sequences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], label: str, length: int = 3
) -> DataFrame:
    """Arrays of ``length`` consecutive rows; the label is that of the last row. Entities with
    fewer rows give nothing."""
    step = F.array(*[F.col(c).cast("double") for c in features])
    # a NULL would be left out of the collected list, so the row array wraps it
    out = windowed(
        df.withColumn("__step", step),
        keys,
        _cols(order),
        lambda w: {"sequence": F.collect_list("__step").over(w.rowsBetween(-(length - 1), 0))},
        length - 1,
    )
    return out.where(F.size("sequence") == length).select(
        *keys, *order, "sequence", F.col(label).alias("label")
    )
