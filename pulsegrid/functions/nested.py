"""Features of nested stage records: a summary per stage, a list of segments and a
list of micro-events. All of it is array and map expressions on the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import micros

LEVELS_SCHEMA = (
    "summary map<string, struct<count:double, minutes:double, thirtyDayAvgMinutes:double>>, "
    "data array<struct<dateTime:string, level:string, seconds:double>>, "
    "shortData array<struct<dateTime:string, level:string, seconds:double>>"
)
# Stage names.
MAIN_STAGES = ("deep", "light", "rem", "wake")
EXTRA_STAGES = ("restless", "asleep")
FIRST_STAGES = ("deep", "rem")


def parse_levels(text: Column, python_literal: bool = False) -> Column:
    """Nested record from JSON. A Python literal is rewritten to JSON first; nothing is evaluated."""
    if python_literal:
        for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
            text = F.regexp_replace(text, rf"(?<=[\s:\[,]){word}(?=[\s,\}}\]])", json_word)
        return F.from_json(text, LEVELS_SCHEMA, {"allowSingleQuotes": "true"})
    return F.from_json(text, LEVELS_SCHEMA)


def stage_summary(
    levels: Column, stages: Sequence[str] = MAIN_STAGES, extra: Sequence[str] = EXTRA_STAGES
) -> dict[str, Column]:
    """Minutes, count and 30-day average per stage; a deviation only where both are non-zero."""
    out: dict[str, Column] = {}
    for stage in [*stages, *extra]:
        entry = F.try_element_at(levels["summary"], F.lit(stage))
        # every stage but waking and the extra ones is a kind of sleep
        name = stage if stage == "wake" or stage in extra else f"{stage}_sleep"
        minutes, usual = entry["minutes"], entry["thirtyDayAvgMinutes"]
        out[f"{name}_minutes"] = minutes
        out[f"{name}_count"] = entry["count"]
        if stage not in extra:
            out[f"{name}_30day_avg"] = usual
            out[f"{name}_deviation_from_avg"] = F.when(
                (minutes != 0) & (usual != 0), minutes - usual
            )
    return out


def _of_stage(data: Column, stage: str) -> Column:
    return F.filter(data, lambda s: s["level"] == stage)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values))


def _moment(segment: Column) -> Column:
    return micros(segment["dateTime"].try_cast("timestamp_ntz"))


def _minutes_of(data: Column, stage: str) -> Column:
    """Count, mean and sum of squared deviations of a stage's minutes, in one pass over the segments."""
    start = F.struct(*[F.lit(0.0).alias(name) for name in ("n", "mean", "m2")])

    def add(acc: Column, segment: Column) -> Column:
        minutes, n = segment["seconds"] / 60, acc["n"] + 1
        off = minutes - acc["mean"]
        mean = acc["mean"] + off / n
        moved = F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + off * (minutes - mean)).alias("m2"))
        counts = (segment["level"] == stage) & segment["seconds"].isNotNull()
        return F.when(counts, moved).otherwise(acc)

    return F.aggregate(data, start, add)


def segment_features(levels: Column, stages: Sequence[str] = MAIN_STAGES) -> dict[str, Column]:
    """Number of segments, minutes to the first segment of a stage, duration mean and population
    std per stage (0 for one segment), last stage."""
    data = levels["data"]
    some = F.size(data) > 0
    out = {"sleep_stage_transitions": F.when(some, F.size(data))}
    for stage in FIRST_STAGES:
        hits = _of_stage(data, stage)
        out[f"minutes_to_first_{stage}_sleep"] = F.when(
            F.size(hits) > 0, (_moment(F.get(hits, F.lit(0))) - _moment(F.get(data, F.lit(0)))) / 60e6
        )
    for stage in stages:
        minutes = _minutes_of(data, stage)
        spread = F.sqrt(F.try_divide(minutes["m2"], minutes["n"]))
        some_minutes = minutes["n"] > 0
        out[f"{stage}_avg_segment_duration_minutes"] = F.when(some_minutes, minutes["mean"])
        out[f"{stage}_segment_duration_std"] = F.when(some_minutes, spread)
    out["last_sleep_stage"] = F.try_element_at(data, F.lit(-1))["level"]
    return out


def micro_event_features(levels: Column) -> dict[str, Column]:
    """Count, total minutes, frequency per hour of sleep, mean and longest micro-event."""
    short, data = levels["shortData"], levels["data"]
    some = F.size(short) > 0
    seconds = F.transform(short, lambda s: s["seconds"])
    hours = _total(F.transform(data, lambda s: s["seconds"])) / 3600
    return {
        "micro_awakening_count": F.when(some, F.size(short)),
        "micro_awakening_total_minutes": F.when(some, _total(seconds) / 60),
        "micro_awakening_per_hour": F.when(some & (hours > 0), F.try_divide(F.size(short), hours)),
        "micro_awakening_avg_duration_seconds": F.when(some, _mean(seconds)),
        "micro_awakening_max_duration_seconds": F.when(some, F.array_max(seconds)),
    }
