"""Samples and statistics in the last N minutes before each response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import assigned_date, micros
from pulsegrid.plans.ordered import largest_group
from pulsegrid.plans.quantile import exact_quantiles, melt
from pulsegrid.plans.skew import salted_join
from pulsegrid.session import freeze, max_group_rows

BUCKET, DAY = "__bucket", "__day"


def _pairs(
    responses: DataFrame,
    samples: DataFrame,
    user: str,
    response_ts: str,
    sample_ts: str,
    width_us: int,
    same_assigned_date: bool,
    known_small: bool = False,
) -> DataFrame:
    """One row per (response, sample) with ``0 < t - ts <= width``.

    Equi-join on user and time bucket of the widest window: a window touches two
    buckets, so only the (few) responses are doubled. Without buckets the join
    would compare all rows of a user with each other.
    """
    t = micros(F.col(response_ts))
    touched = F.array_distinct(F.array(F.floor((t - width_us) / width_us), F.floor(t / width_us)))
    left = samples.where(F.col(sample_ts).isNotNull() & F.col(user).isNotNull()).withColumns(
        {BUCKET: F.floor(micros(F.col(sample_ts)) / width_us), DAY: F.to_date(sample_ts)}
    )
    right = responses.where(F.col(response_ts).isNotNull()).withColumns(
        {BUCKET: F.explode(touched), DAY: assigned_date(F.col(response_ts))}
    )
    on = [user, BUCKET]
    if same_assigned_date:
        on.append(DAY)
    else:
        left, right = left.drop(DAY), right.drop(DAY)
    joined = salted_join(left, right, on, [sample_ts], known_small=known_small)
    gap = micros(F.col(response_ts)) - micros(F.col(sample_ts))
    return joined.withColumn("__gap", gap).where((gap > 0) & (gap <= width_us)).drop(BUCKET, DAY)


def _check_names(responses: DataFrame, samples: DataFrame, user: str) -> None:
    clash = set(responses.columns) & set(samples.columns) - {user}
    if clash:
        raise ValueError(f"rename columns found on both sides: {sorted(clash)}")


def lookback_join(
    responses: DataFrame,
    samples: DataFrame,
    user: str,
    response_ts: str,
    sample_ts: str,
    widths: Mapping[str, int],
    same_assigned_date: bool = True,
) -> DataFrame:
    """Detailed windows: one row per response, sample and width (seconds by label).

    A sample belongs to a window if ``t - width <= ts < t`` and, by default, if
    its calendar date is the response's assigned date.
    """
    _check_names(responses, samples, user)
    pairs = _pairs(
        responses, samples, user, response_ts, sample_ts, max(widths.values()) * 1_000_000, same_assigned_date
    )
    options = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(s * 1_000_000).cast("bigint").alias("us"))
            for label, s in widths.items()
        ]
    )
    fitting = F.filter(options, lambda o: o["us"] >= F.col("__gap"))
    return (
        pairs.withColumn("__w", F.explode(fitting))
        .withColumns(
            {
                "time_window": F.col("__w.label"),
                "window_start": F.col(response_ts)
                - F.make_dt_interval(secs=(F.col("__w.us") / 1_000_000).cast("decimal(18,6)")),
                "window_end": F.col(response_ts),
            }
        )
        .drop("__w", "__gap")
    )


def lookback_features(
    responses: DataFrame,
    samples: DataFrame,
    user: str,
    response_id: str,
    response_ts: str,
    sample_ts: str,
    metrics: Sequence[str],
    widths: Mapping[str, int],
    same_assigned_date: bool = True,
) -> DataFrame:
    """Mean, std, min, max, median and non-null count of each metric per response and width.

    ``record_count`` counts all rows of the window. A metric without a value
    gives NULL, a response without a sample gives no row. Pairs are grouped once
    per response with one conditional aggregate per width, so no pair is
    multiplied by the widths before the shuffle.
    """
    _check_names(responses, samples, user)
    widest = max(widths.values()) * 1_000_000
    numeric = samples.select(user, sample_ts, *[F.col(m).try_cast("double").alias(m) for m in metrics])
    facts = responses.select(user, response_id, response_ts)

    # a window spans at most two buckets, which bounds the rows behind one median
    buckets = numeric.select(user, F.floor(micros(F.col(sample_ts)) / widest).alias(BUCKET))
    small = 2 * largest_group(buckets, [user, BUCKET]) <= max_group_rows(samples.sparkSession)
    pairs = _pairs(
        facts, numeric, user, response_ts, sample_ts, widest, same_assigned_date, known_small=small
    )

    aggs = []
    for i, seconds in enumerate(widths.values()):
        inside = F.col("__gap") <= seconds * 1_000_000
        aggs.append(F.count(F.when(inside, 1)).alias(f"__n{i}"))
        for j, m in enumerate(metrics):
            v = F.when(inside, F.col(m))
            aggs += [
                F.avg(v).alias(f"__mean{i}_{j}"),
                F.stddev_samp(v).alias(f"__std{i}_{j}"),
                F.min(v).alias(f"__min{i}_{j}"),
                F.max(v).alias(f"__max{i}_{j}"),
                F.count(v).alias(f"__count{i}_{j}"),
            ]
            if small:
                aggs.append(F.median(v).alias(f"__median{i}_{j}"))
    per_response = pairs.groupBy(user, response_id, response_ts).agg(*aggs)
    stats = ["mean", "std", "min", "max"] + (["median"] if small else []) + ["count"]
    by_width = F.array(
        *[
            F.struct(
                F.lit(label).alias("time_window"),
                F.col(f"__n{i}").alias("record_count"),
                *[F.col(f"__{s}{i}_{j}").alias(f"{m}_{s}") for j, m in enumerate(metrics) for s in stats],
            )
            for i, label in enumerate(widths)
        ]
    )
    out = (
        per_response.select(user, response_id, response_ts, F.explode(by_width).alias("__w"))
        .select(user, response_id, response_ts, "__w.*")
        .where("record_count > 0")
    )
    if small:
        return out
    # hot buckets: the pairs are written once, all medians come from one quantile pass
    keys = [response_id, "time_window"]
    detailed = lookback_join(facts, numeric, user, response_ts, sample_ts, widths, same_assigned_date)
    long = freeze(melt(detailed.select(*keys, *metrics), keys, metrics, "metric"))
    medians = exact_quantiles(long, [*keys, "metric"], "value", {"median": 0.5})
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}_median") for m in metrics]
    )
    out = out.join(wide, keys, "left")
    ordered = [f"{m}_{s}" for m in metrics for s in ("mean", "std", "min", "max", "median", "count")]
    return out.select(user, response_id, response_ts, "time_window", "record_count", *ordered)
