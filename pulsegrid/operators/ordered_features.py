"""Several ordered features of one table from one sort.

Each function in ``sequences`` measures, splits and sorts for itself. Here the
features are named first and made together: one aggregation measures the
largest key (and the means that fills need), then one exchange and one sort serve
all features. Where a key is too large for one task the table is cut into sorted
ranges and written once; ranges get the last rows of a key's earlier ranges as
context, and one small table (at most two rows per range) brings positions and
the nearest values from further away.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.plans import ordered
from pulsegrid.plans.ordered import CHUNK, POS, matched
from pulsegrid.session import freeze, max_group_rows


class OrderedFeatures:
    """Features of the rows of each key in ascending order; ``order`` must end in a tie-break column.

    A NULL key is a key like any other. No keys mean one order over the whole table.
    Column names that begin with two underscores are reserved.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        self.df, self.keys, self.order = df, list(keys), list(order)
        self._makers: list[Callable[[WindowSpec], dict[str, Column]]] = []
        self._back = 0
        self._positions: list[str] = []
        self._fills: dict[str, str] = {}

    def _behind(self, back: int, maker: Callable[[WindowSpec], dict[str, Column]]) -> OrderedFeatures:
        self._makers.append(maker)
        self._back = max(self._back, back)
        return self

    def lags(self, col: str, steps: Sequence[int]) -> OrderedFeatures:
        """``{col}_lag{n}``: the value ``n`` rows before."""
        return self._behind(max(steps), lambda w: {f"{col}_lag{n}": F.lag(col, n).over(w) for n in steps})

    def differences(self, cols: Mapping[str, str]) -> OrderedFeatures:
        """Each value less the one before it."""
        return self._behind(1, lambda w: {out: F.col(c) - F.lag(c, 1).over(w) for c, out in cols.items()})

    def rolling(self, col: str, rows: int = 3) -> OrderedFeatures:
        """Mean and sample deviation of the last ``rows`` rows, the current one included."""

        def maker(w: WindowSpec) -> dict[str, Column]:
            frame = w.rowsBetween(-(rows - 1), 0)
            return {f"{col}_rolling_mean": F.avg(col).over(frame), f"{col}_rolling_std": F.stddev_samp(col).over(frame)}

        return self._behind(rows - 1, maker)

    def sequences(self, features: Sequence[str], length: int = 3, out: str = "sequence") -> OrderedFeatures:
        """The values of the last ``length`` rows as arrays; NULL where a key has fewer rows so far."""
        step = F.array(*[F.col(c).cast("double") for c in features])

        def maker(w: WindowSpec) -> dict[str, Column]:
            steps = F.collect_list(step).over(w.rowsBetween(-(length - 1), 0))
            return {out: F.when(F.size(steps) == length, steps)}

        return self._behind(length - 1, maker)

    def position(self, out: str = "seq_position") -> OrderedFeatures:
        """Position within the key, from 0."""
        self._positions.append(out)
        return self

    def filled(self, cols: Mapping[str, str]) -> OrderedFeatures:
        """The last value, else the next one, else the mean of the whole column; needs a second sort, in the other direction."""
        self._fills |= cols
        return self

    def _measure(self) -> tuple[int, int, dict[str, float | None]]:
        """Rows of the largest key and of the table, and the means for fills, by one partial aggregation."""
        cols = list(self._fills)
        parts = [f(c).alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("s", lambda c: F.sum(F.col(c).cast("double"))), ("n", F.count))]
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__rows"), *parts)
        row = sizes.agg(F.max("__rows"), F.sum("__rows"), *[F.try_divide(F.sum(f"__s{i}"), F.sum(f"__n{i}")) for i in range(len(cols))]).first()
        return row[0] or 0, row[1] or 0, dict(zip(cols, row[2:]))

    def table(self) -> DataFrame:
        """The table's columns and the features in the order in which they were named, positions and fills last."""
        largest, total, means = self._measure()
        spark = self.df.sparkSession
        if self.keys and largest <= max_group_rows(spark):
            rows, by = self.df, Window.partitionBy(*self.keys)
            ascending = by.orderBy(*self.order)
            descending = by.orderBy(*[F.col(c).desc() for c in self.order])
            own, before = F.lit(1), F.lit(0)
            far = {c: (F.lit(None), F.lit(None)) for c in self._fills}
        else:
            ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ordered.RANGE_ROWS))
            rows, by = self._ranges(ranges), Window.partitionBy(CHUNK, *self.keys)
            ascending, descending = by.orderBy(POS), by.orderBy(F.col(POS).desc())
            own, before = F.col("__own"), F.coalesce("__before", F.lit(0))
            far = {c: (F.col(f"__cp{i}"), F.col(f"__cn{i}")) for i, c in enumerate(self._fills)}
        until_now = Window.unboundedPreceding, Window.currentRow
        made: dict[str, Column] = {}
        for maker in self._makers:
            made |= maker(ascending)
        for out in self._positions:
            made[out] = F.sum(own).over(ascending.rowsBetween(*until_now)) + before - 1
        for c, out in self._fills.items():
            last = F.last(c, ignorenulls=True).over(ascending.rowsBetween(*until_now))
            following = F.last(c, ignorenulls=True).over(descending.rowsBetween(*until_now))
            made[out] = F.coalesce(*[v.cast("double") for v in (last, far[c][0], following, far[c][1], F.lit(means[c]))])
        names = {out: f"__f{i}" for i, out in enumerate(made)}
        every = rows.select("*", *[col.alias(names[out]) for out, col in made.items()])
        if "__own" in rows.columns:
            every = every.where("__own = 1")
        replaced = set(made)
        return every.select(*[F.col(f"`{c}`") for c in self.df.columns if c not in replaced], *[F.col(n).alias(out) for out, n in names.items()])

    def _ranges(self, ranges: int) -> DataFrame:
        """Sorted ranges with their context rows (``__own`` 0), rows before each range and the nearest values outside of it."""
        keys, fills = self.keys, list(self._fills)
        parts = ordered.range_chunks(self.df, keys, [F.col(c) for c in self.order], ranges)
        there = {c: F.when(F.col(c).isNotNull(), F.col(POS)) for c in fills}
        runs = parts.groupBy(CHUNK, *keys).agg(
            F.count(F.lit(1)).alias("__n"),
            F.max(POS).alias("__end"),
            *[F.max_by(c, there[c]).alias(f"__l{i}") for i, c in enumerate(fills)],
            *[F.min_by(c, there[c]).alias(f"__h{i}") for i, c in enumerate(fills)],
        )
        by = Window.partitionBy(*keys)
        earlier = by.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        later = by.orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = runs.select(
            CHUNK, *keys, "__n", "__end",
            F.sum("__n").over(earlier).alias("__before"),
            F.count(F.lit(1)).over(later).alias("__after"),
            *[F.last(f"__l{i}", ignorenulls=True).over(earlier).alias(f"__cp{i}") for i in range(len(fills))],
            *[F.last(f"__h{i}", ignorenulls=True).over(later).alias(f"__cn{i}") for i in range(len(fills))],
        )
        # keys that lie in one range only need nothing from outside
        edges = freeze(edges.where("__before is not null or __after > 0"))
        carry = edges.drop("__n", "__end", "__after")
        rows = parts.withColumn("__own", F.lit(1))
        if self._back:
            tails = matched(parts, edges.where("__after > 0").select(CHUNK, *keys, "__n", "__end", F.coalesce("__before", F.lit(0)).alias("__b")), [CHUNK, *keys])
            tails = tails.where(F.col(POS) > F.col("__end") - self._back).withColumn("__rank", F.col("__b") + F.col("__n") - F.col("__end") + F.col(POS))
            # a start at most that many rows on has the row's bucket or the next one; starts of a key differ
            bucket = F.floor(F.col("__rank") / self._back)
            tails = tails.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
            starts = edges.where("__before is not null").select(
                *keys, F.col(CHUNK).alias("__to"), F.col("__before").alias("__start"), F.floor(F.col("__before") / self._back).alias("__bucket")
            )
            behind = F.col("__rank") - F.col("__start")
            context = matched(tails, starts, [*keys, "__bucket"])
            context = context.where((behind <= 0) & (behind > -self._back)).withColumns({CHUNK: F.col("__to"), POS: behind - 1, "__own": F.lit(0)})
            rows = rows.unionByName(context.select(*rows.columns))
        return matched(rows, carry, [CHUNK, *keys], "left")
