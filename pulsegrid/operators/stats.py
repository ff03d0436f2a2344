"""Distribution and association statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import seconds_between
from pulsegrid.plans.gram import correlations
from pulsegrid.plans.quantile import columns_as_rows, exact_quantiles, quantile_table

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _basic(v: Column) -> list[Column]:
    return [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def group_describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, std, min, quartiles, max per group."""
    data = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    stats = data.groupBy(*keys).agg(*_basic(F.col(value)))
    return stats.join(exact_quantiles(data, keys, value, QUARTILES), list(keys), "left")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Describe table, one row per column, with missing count and percentage."""
    names = ["count", "mean", "std", "min", "max", "total"]
    row = df.agg(
        *[
            agg.alias(f"{n}_{i}")
            for i, c in enumerate(cols)
            for n, agg in zip(names, [*_basic(F.col(c).cast("double")), F.count("*")])
        ]
    )
    stats = columns_as_rows(row, cols, names)
    missing = F.col("total") - F.col("count")
    return (
        stats.join(quantile_table(df, cols, QUARTILES), "column", "left")
        .withColumn("missing", missing)
        .withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("total")))
        .drop("total")
    )


def robust_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """p05, median, p95 and max per column; text that is no number is skipped."""
    typed = df.select(*[F.col(c).try_cast("double").alias(c) for c in cols])
    tails = quantile_table(typed, cols, {"p05": 0.05, "median": 0.5, "p95": 0.95})
    tops = columns_as_rows(typed.agg(*[F.max(c).alias(f"max_{i}") for i, c in enumerate(cols)]), cols, ["max"])
    return tails.join(tops, "column")


def group_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], user: str) -> DataFrame:
    """Mean per column, rows and distinct users per group."""
    return df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols],
        F.count("*").alias("rows"),
        F.count_distinct(user).alias("users"),
    )


def target_summary(df: DataFrame, user: str, targets: Sequence[str]) -> DataFrame:
    """Responses and rounded target means per user."""
    return df.groupBy(user).agg(
        F.count("*").alias("responses"), *[F.round(F.avg(t), 2).alias(f"{t}_mean") for t in targets]
    )


def sigma_outliers(df: DataFrame, cols: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Values further than ``sigmas`` sample deviations from the mean, per column with spread."""
    row = df.agg(
        *[F.avg(c).alias(f"__a{i}") for i, c in enumerate(cols)],
        *[F.stddev_samp(c).alias(f"__s{i}") for i, c in enumerate(cols)],
    ).first()
    used = [(i, c) for i, c in enumerate(cols) if row[f"__s{i}"]]
    counts = df.agg(
        *[
            F.count_if(F.abs(F.col(c) - row[f"__a{i}"]) > sigmas * row[f"__s{i}"]).alias(f"__o{i}")
            for i, c in used
        ],
        *[F.count(c).alias(f"__n{i}") for i, c in used],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"__o{i}").alias("outliers"),
                F.try_divide(F.col(f"__o{i}") * 100.0, F.col(f"__n{i}")).alias("outlier_pct"),
            )
            for i, c in used
        ]
    )
    return counts.select(F.explode(entries).alias("__e")).select("__e.*")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL without spread, where ``corr`` raises.

    The three sums skip incomplete pairs by themselves, and the deviation sum of
    a constant column is exactly 0.
    """
    x, y = x.cast("double"), y.cast("double")
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full pairwise-complete Pearson matrix in long form, however many columns; see ``plans/gram.py``.

    The diagonal is 1 for a column with spread; a column without spread has NULL
    everywhere. NULL and NaN are no values.
    """
    diagonal = F.col("var_a") == F.col("var_b")
    return correlations(df, cols).withColumn("r", F.when(diagonal & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r")))


def strong_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs of different columns beyond the threshold, the column that is named first in ``cols`` as ``var_a``."""
    order = F.array(*[F.lit(c) for c in cols])
    pairs = correlations(df, cols).where(F.array_position(order, F.col("var_a")) < F.array_position(order, F.col("var_b")))
    return pairs.where(F.abs("r") > threshold).orderBy(F.abs("r").desc(), "var_a", "var_b")


def target_correlations(
    df: DataFrame, cols: Sequence[str], targets: Sequence[str], k: int, by: str = "abs"
) -> DataFrame:
    """Top k correlations per target: ``abs``, ``top`` (largest) or ``bottom`` (smallest)."""
    order = {"abs": F.abs("r").desc(), "top": F.col("r").desc(), "bottom": F.col("r").asc()}[by]
    pairs = correlations(df, targets, cols).where(F.col("var_a") != F.col("var_b"))
    # one row per pair of columns: the window is over the schema, not over data
    w = Window.partitionBy("var_a").orderBy(order, "var_b")
    return (
        pairs.where(F.col("r").isNotNull())
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
        .select(F.col("var_a").alias("target"), F.col("var_b").alias("variable"), "r", "place")
    )


def correlation_filled(df: DataFrame, x: str, y: str, fill: float = 0.0) -> DataFrame:
    """Single correlation with NULL counted as a value."""
    filled = df.select(*[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in (x, y)])
    return filled.agg(pearson(F.col(x), F.col(y)).alias("r"))


def overlap_statistics(aligned: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Correlation and mean difference of aligned series, with the number of aligned rows."""
    aggs = [F.count("*").alias("aligned_rows")]
    for name, (a, b) in pairs.items():
        aggs += [
            pearson(F.col(a), F.col(b)).alias(f"{name}_r"),
            F.avg(F.col(a) - F.col(b)).alias(f"{name}_mean_diff"),
        ]
    return aligned.agg(*aggs)


def linear_trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x; NULL without spread in x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x).cast("double"))
    b = F.when(both, F.col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(a, b), F.when(F.min(a) < F.max(a), F.var_pop(a)))
    return df.groupBy(*keys).agg(
        slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"), F.count(a).alias("pairs")
    )


def cohen_d(value: Column, first: Column, second: Column) -> Column:
    """Standardised mean difference with pooled sample variance; NULL if a group has fewer than two
    values or there is no spread."""
    a, b = F.when(first, value), F.when(second, value)
    n1, n2 = F.count(a), F.count(b)
    pooled = F.sqrt(
        F.try_divide((n1 - 1) * F.var_samp(a) + (n2 - 1) * F.var_samp(b), n1 + n2 - F.lit(2))
    )
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), F.try_divide(F.avg(a) - F.avg(b), pooled))


def flag_rate(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(flag).alias("flagged"),
        F.count("*").alias("rows"),
        F.try_divide(F.sum(flag) * 100.0, F.count("*")).alias("rate_pct"),
    )


def response_latency(df: DataFrame, sent: str, stop: str) -> DataFrame:
    """Absolute latency statistics in seconds and minutes, and how many latencies were negative."""
    raw = seconds_between(F.col(stop), F.col(sent))
    data = df.select(raw.alias("__raw")).withColumn("latency", F.abs("__raw"))
    stats = data.agg(*_basic(F.col("latency")), F.count_if(F.col("__raw") < 0).alias("negatives"))
    both = stats.crossJoin(exact_quantiles(data, [], "latency", QUARTILES))  # two single rows
    names = ["mean", "median", "std", "min", "max", "q25", "q75"]
    return both.select(
        F.col("count").alias("responses"),
        "negatives",
        *[F.col(n).alias(f"{n}_s") for n in names],
        *[(F.col(n) / 60).alias(f"{n}_min") for n in names],
    )


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of the column; the last bin includes its upper edge."""
    low, high = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, at.alias("bin"))
        .agg(F.count("*").alias("rows"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
        .withColumn("bin_end", F.lit(low) + (F.col("bin") + 1) * F.lit(width))
    )


def user_profile(df: DataFrame, user: str, cols: Sequence[str], stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.groupBy(user).agg(*[agg[s](c).alias(f"{c}_{s}") for c in cols for s in stats])


def user_means(df: DataFrame, user: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(user).agg(*[F.avg(c).alias(c) for c in cols])


def target_count_range(df: DataFrame, user: str, targets: Sequence[str]) -> DataFrame:
    """Non-null target counts per user, then their mean and range over users."""
    per_user = df.groupBy(user).agg(*[F.count(t).alias(t) for t in targets])
    entries = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.col(f"__a{i}").alias("mean_count"),
                F.col(f"__lo{i}").alias("min_count"),
                F.col(f"__hi{i}").alias("max_count"),
            )
            for i, t in enumerate(targets)
        ]
    )
    row = per_user.agg(
        *[f(t).alias(f"__{n}{i}") for i, t in enumerate(targets) for n, f in (("a", F.avg), ("lo", F.min), ("hi", F.max))]
    )
    return row.select(F.explode(entries).alias("__e")).select("__e.*")
