"""Typed values out of text and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.columns import STAT_SUFFIXES

# Category codes.
SLEEP_TYPE_CODES = {"stages": 0, "classic": 1}
MAIN_SLEEP_CODES = {"true": 0, "false": 1}
SLEEP_STAGE_CODES = {
    "light": 0,
    "rem": 1,
    "wake": 2,
    "asleep": 3,
    "deep": 4,
    "restless": 5,
    "awake": 6,
    "unknown": 7,
}


def to_number(c: Column) -> Column:
    """Numeric value of a text; NULL where it is none."""
    return c.try_cast("double")


def unified_date(cols: Sequence[Column]) -> Column:
    """First column that holds a date."""
    return F.coalesce(*[c.try_cast("date") for c in cols])


def encode_map(c: Column, codes: dict[str, int]) -> Column:
    """Code of a category; NULL for a value outside the map."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def unmapped(df: DataFrame, col: str, codes: dict[str, int]) -> DataFrame:
    """Values outside the map, with their row counts."""
    return (
        df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(codes)))
        .groupBy(col)
        .agg(F.count("*").alias("rows"))
    )


def label_mapping(df: DataFrame, col: str, seq: str, max_values: int = 20) -> DataFrame:
    """Codes 0.. by first appearance, for a column with at most ``max_values`` values.

    A column with more values is not a category: the mapping is empty then.
    """
    firsts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(seq).alias("first_seen"))
    # sorted in one value: the list is emptied first when it is over the limit
    listed = firsts.limit(max_values + 1).agg(
        F.sort_array(F.collect_list(F.struct("first_seen", F.col(col).alias("value")))).alias("all")
    )
    return (
        listed.where(F.size("all") <= max_values)
        .select(F.posexplode("all").alias("code", "entry"))
        .select(F.col("entry.value").alias(col), "code", F.col("entry.first_seen"))
    )


def label_encode(df: DataFrame, col: str, seq: str, max_values: int = 20) -> DataFrame:
    mapping = label_mapping(df, col, seq, max_values)
    # at most max_values rows by construction
    codes = F.broadcast(mapping.select(col, F.col("code").alias(f"{col}_encoded")))
    return df.join(codes, col, "left")


def feature_name_parts(name: Column, windows: dict[str, str] | None = None) -> dict[str, Column]:
    """Window, base variable and statistic of a feature name.

    All occurrences of the window prefix and of the matching suffix are removed
    from the base variable.
    """
    windows = windows or {}
    window, base = F.lit("N/A"), name
    for prefix, label in reversed(windows.items()):
        hit = name.startswith(prefix)
        window = F.when(hit, F.lit(label)).otherwise(window)
        base = F.when(hit, F.replace(name, F.lit(prefix), F.lit(""))).otherwise(base)
    stat, variable = F.lit("N/A"), base
    for suffix in reversed(STAT_SUFFIXES):
        hit = base.endswith(suffix)
        stat = F.when(hit, F.lit(suffix[1:])).otherwise(stat)
        variable = F.when(hit, F.replace(base, F.lit(suffix), F.lit(""))).otherwise(variable)
    return {"window": window, "base_variable": variable, "statistic": stat}
