"""Calendar intervals: containment, next and previous entry, derived categories.

A calendar has columns ``(group, start, end, name)`` plus an entry order
``seq``. It is folded to one row per group that holds a sorted array; every
feature is then an array expression on the row after one small join, without a
shuffle of the rows. The fold is used up to ``MAX_ENTRIES`` entries; a larger
calendar is joined by day instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ENTRIES = 10_000


def _is_small(calendar: DataFrame) -> bool:
    return calendar.limit(MAX_ENTRIES + 1).count() <= MAX_ENTRIES


def calendar_facts(
    df: DataFrame, calendar: DataFrame, group: str, day: str, inclusive_next: bool = False
) -> DataFrame:
    """Adds ``cal_in`` (first containing entry), ``cal_next`` (days to the next start),
    ``cal_prev`` (days since the last end), NULL where there is none, and ``cal_known`` (the
    group has a calendar).

    Containment includes both ends; an entry that ends before it starts contains no
    day, but its start and end count as next and previous. ``inclusive_next`` counts a start on the
    same day as next.
    """
    if _is_small(calendar):
        folded = calendar.groupBy(F.col("group").alias("__g")).agg(
            F.sort_array(F.collect_list(F.struct("seq", "start", "end", "name"))).alias("__cal")
        )
        # at most MAX_ENTRIES entries, checked above
        joined = df.join(F.broadcast(folded), F.col(group) == F.col("__g"), "left")
        d = F.col(day)
        inside = F.filter("__cal", lambda e: (e["start"] <= d) & (e["end"] >= d))
        later = F.filter("__cal", lambda e: e["start"] >= d if inclusive_next else e["start"] > d)
        earlier = F.filter("__cal", lambda e: e["end"] < d)
        return joined.withColumns(
            {
                "cal_in": F.get(inside, F.lit(0))["name"],
                "cal_next": F.datediff(F.array_min(F.transform(later, lambda e: e["start"])), d),
                "cal_prev": F.datediff(d, F.array_max(F.transform(earlier, lambda e: e["end"]))),
                "cal_known": F.col("__g").isNotNull(),
            }
        ).drop("__g", "__cal")
    facts = _facts_by_day(
        df.select(F.col(group).alias("__g"), F.col(day).alias("__d")).distinct(), calendar, inclusive_next
    )
    groups = calendar.select(F.col("group").alias("__grp")).distinct()
    return (
        df.join(facts, (F.col(group) == F.col("__g")) & (F.col(day) == F.col("__d")), "left")
        .join(groups, F.col(group) == F.col("__grp"), "left")
        .withColumn("cal_known", F.col("__grp").isNotNull())
        .drop("__g", "__d", "__grp")
    )


def _facts_by_day(days: DataFrame, calendar: DataFrame, inclusive_next: bool) -> DataFrame:
    """The same facts for distinct (group, day) pairs: every table here has at most one row per
    group and calendar day, so the windows per group are bounded by the length of the calendar."""
    days = days.where("__g is not null and __d is not null")
    inside = (
        calendar.where(F.col("start") <= F.col("end")).select(
            F.col("group").alias("__g"),
            "seq",
            "name",
            F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("__d"),
        )
        .groupBy("__g", "__d")
        .agg(F.min_by("name", "seq").alias("cal_in"))
    )

    def marks(col: str) -> DataFrame:
        return calendar.select(F.col("group").alias("__g"), F.col(col).alias("__d"), F.col(col).alias("__m")).distinct()

    # Range frames over the day number, so that rows of one day are peers. Looking ahead is looking
    # back in reverse order, where the frame grows row by row.
    number = F.datediff("__d", F.lit("1970-01-01").cast("date"))
    behind = Window.partitionBy("__g").orderBy(number).rangeBetween(Window.unboundedPreceding, -1)
    ahead = (
        Window.partitionBy("__g")
        .orderBy(-number)
        .rangeBetween(Window.unboundedPreceding, 0 if inclusive_next else -1)
    )
    starts, ends = marks("start"), marks("end")
    query = days.withColumn("__m", F.lit(None).cast("date"))
    nxt = (
        query.unionByName(starts)
        .withColumn("__next", F.min("__m").over(ahead))
        .groupBy("__g", "__d")
        .agg(F.min("__next").alias("__next"))
    )
    prv = (
        query.unionByName(ends)
        .withColumn("__prev", F.max("__m").over(behind))
        .groupBy("__g", "__d")
        .agg(F.max("__prev").alias("__prev"))
    )
    return (
        days.join(inside, ["__g", "__d"], "left")
        .join(nxt, ["__g", "__d"], "left")
        .join(prv, ["__g", "__d"], "left")
        .select(
            "__g",
            "__d",
            "cal_in",
            F.datediff("__next", "__d").alias("cal_next"),
            F.datediff("__d", "__prev").alias("cal_prev"),
        )
    )


def in_holiday(day: Column, start: str, end: str) -> Column:
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def exam_features(
    df: DataFrame, calendar: DataFrame, group: str, day: str, holiday: tuple[str, str]
) -> DataFrame:
    """Daily variant: flags, name, days and weeks to the next and since the last entry, category.

    The next entry starts strictly later. Rows whose group has no calendar keep
    zeros, NULLs and an empty category. The post-exam categories are reached
    only when there is no next entry.
    """
    facts = calendar_facts(df, calendar, group, day)
    known, holi = F.col("cal_known"), in_holiday(F.col(day), *holiday)
    exam, nxt, prv = F.col("cal_in").isNotNull(), F.col("cal_next"), F.col("cal_prev")
    category = (
        F.when(~known, "")
        .when(exam, "exam_week")
        .when(holi, "holiday")
        .when(nxt <= 7, "pre_exam_week")
        .when(nxt <= 14, "pre_exam_2weeks")
        .when(nxt.isNotNull(), "normal")
        .when(prv <= 7, "post_exam_week")
        .when(prv <= 14, "post_exam_2weeks")
        .when(prv.isNotNull(), "normal")
        .otherwise("")
    )
    return facts.withColumns(
        {
            "is_exam_period": exam.cast("int"),
            "exam_period_name": F.coalesce("cal_in", F.lit("")),
            "is_holiday": F.coalesce(known & holi, F.lit(False)).cast("int"),
            "is_holiday_period": F.coalesce(exam | (known & holi), F.lit(False)).cast("int"),
            "days_to_next_exam": nxt.cast("double"),
            "days_since_last_exam": prv.cast("double"),
            "weeks_to_next_exam": nxt / 7,
            "weeks_since_last_exam": prv / 7,
            "exam_proximity_category": category,
        }
    ).drop("cal_in", "cal_next", "cal_prev", "cal_known")


def window_exam_flags(
    df: DataFrame, calendar: DataFrame, group: str, day: str, holiday: tuple[str, str]
) -> DataFrame:
    """Window variant: the next entry may start on the same day; -1 when there is none."""
    facts = calendar_facts(df, calendar, group, day, inclusive_next=True)
    nxt = F.col("cal_next")
    return facts.withColumns(
        {
            "is_exam_period": F.col("cal_in").isNotNull().cast("int"),
            "is_easter_break": F.coalesce(in_holiday(F.col(day), *holiday), F.lit(False)).cast("int"),
            "days_until_exam": F.coalesce(nxt, F.lit(-1)),
            "is_pre_exam_week": F.coalesce(nxt.between(0, 7), F.lit(False)).cast("int"),
        }
    ).drop("cal_in", "cal_next", "cal_prev", "cal_known")
