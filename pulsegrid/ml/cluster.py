"""K-means on profiles, cluster quality and cluster reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.ml.classify import VECTOR
from pulsegrid.ml.kmeans import KMeansFit, fit_all, mean_silhouettes
from pulsegrid.plans.ordered import position, windowed
from pulsegrid.session import freeze

MAX_CLUSTERS = 10_000
# Rows of one side of a task that sums up distances between rows: at least, at most.
PAIR_BLOCK, MAX_PAIR_BLOCK = 1_024, 32_768
BLOCK_SUMS = 4_000_000  # sums of one block's rows by the other's clusters, with clusters of the mean size
MATRIX = 500_000  # distances that are worked on at once


def best_kmeans(df: DataFrame, k: int, starts: int = 20, seed: int = 42) -> KMeansFit:
    """K-means with the least cost of several starts, which share every read of the table (``ml/kmeans.py``)."""
    return fit_all(df, VECTOR, [k], starts, seed)[0][k]


def sweep_k(df: DataFrame, ks: Sequence[int] = range(2, 11), starts: int = 20, seed: int = 42) -> DataFrame:
    """Inertia and silhouette (squared Euclidean) of the best of several starts for each k, all runs side by side."""
    fits, rows = fit_all(df, VECTOR, ks, starts, seed)
    silhouettes = mean_silhouettes(rows, fits)
    return df.sparkSession.createDataFrame([(k, fits[k].cost, silhouettes[k]) for k in ks], "k int, inertia double, silhouette double")


def silhouette(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """``clusters, rows, silhouette``: the exact Euclidean silhouette over all pairs of rows, whatever the clusters' sizes.

    Equal rows of a cluster are folded first. Rows in the order of their clusters are
    cut into blocks, some pairs of blocks for every core and none larger than a task
    can keep, and each pair is one task that hands on, for the rows of both sides,
    their summed distances to each cluster of the other. No pairs are written, a large
    cluster is many blocks and many small ones share one. The work is quadratic in the
    distinct rows. A row that is alone in its cluster counts 0. Rows with a NULL cluster
    or feature take no part; fewer than two clusters give NULL.
    """
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.col(f"`{cluster}`").alias("k"), x.alias("x")).where(F.col("k").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    folded = freeze(rows.groupBy("k", "x").agg(F.count("*").alias("m")))
    numbered = freeze(position(folded, [], [F.col("k"), F.col("x")], "id").withColumn("id", F.col("id") - 1))
    sizes = freeze(numbered.groupBy("k").agg(F.sum("m").alias("n"), F.count("*").alias("points"), F.min("id").alias("first")))
    n, clusters = sizes.agg(F.sum("points"), F.count("*")).first()
    n = n or 0
    # one half of the pairs of blocks, and sums of a block's rows by another's clusters that a task can keep
    wanted = -(-n // math.ceil(math.sqrt(8 * df.sparkSession.sparkContext.defaultParallelism)))
    block = min(MAX_PAIR_BLOCK, math.isqrt(BLOCK_SUMS * n // max(1, clusters)), max(PAIR_BLOCK, wanted))
    block = max(PAIR_BLOCK, block)
    blocks = max(1, -(-n // block))
    # a cluster is named by the number of its first row
    named = numbered.join(sizes.select("k", "first"), "k").select("id", F.col("first").alias("c"), "x", "m", F.floor(F.col("id") / block).alias("own"))
    # each pair of blocks once: (i, j) with i <= j
    ahead = named.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.lit(blocks - 1).cast("bigint"))))
    behind = named.select(*[F.col(c).alias(c) for c in named.columns]).withColumn("j", F.col("own"))
    behind = behind.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")))

    def sums(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.table({"id": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})]
        if a.num_rows and b.num_rows:
            a, b = a.sort_by("id"), b.sort_by("id")
            u, v = (t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b))
            (cu, at_u), (cv, at_v) = (np.unique(t["c"].to_numpy(), return_index=True) for t in (a, b))
            mu, mv = (t["m"].to_numpy().astype(float) for t in (a, b))
            same = key[0].as_py() == key[1].as_py()
            to_v, to_u = np.zeros((len(u), len(cv))), np.zeros((0 if same else len(v), len(cu)))
            # a matrix of some rows of one side at a time
            step = max(1, MATRIX // len(v))
            for lo in range(0, len(u), step):
                hi = min(lo + step, len(u))
                d = np.zeros((hi - lo, len(v)))
                for f in range(u.shape[1]):
                    d += (u[lo:hi, f, None] - v[None, :, f]) ** 2
                np.sqrt(d, out=d)
                if not same:
                    # the clusters that these rows belong to
                    p, q = np.searchsorted(at_u, lo, "right") - 1, np.searchsorted(at_u, hi, "left")
                    start = np.maximum(at_u[p:q] - lo, 0)
                    to_u[:, p:q] += np.add.reduceat(d * mu[lo:hi, None], start, axis=0).T
                d *= mv
                to_v[lo:hi] = np.add.reduceat(d, at_v, axis=1)
            for of, c, s in [(a, cv, to_v)] if same else [(a, cv, to_v), (b, cu, to_u)]:
                out.append(pa.table({"id": np.repeat(of["id"].to_numpy(), len(c)), "c": np.tile(c, of.num_rows), "s": s.ravel()}))
        return pa.concat_tables(out)

    ahead = ahead.select(*[F.col(c).alias(c) for c in ahead.columns])
    met = ahead.groupBy("i", "j").cogroup(behind.groupBy("i", "j")).applyInArrow(sums, "id bigint, c bigint, s double")
    away = met.groupBy("id", "c").agg(F.sum("s").alias("s"))
    facts = sizes.select(F.col("first").alias("c"), "n")
    per_row = away.join(facts, "c").join(named.select("id", F.col("c").alias("k"), "m"), "id")
    mine = F.col("c") == F.col("k")
    means = per_row.groupBy("id", "m").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b")
    )
    value = F.when(F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    # without a value the row does not count, as in a mean
    counted = F.sum(F.when(value.isNotNull(), F.col("m")))
    whole = means.agg(F.try_divide(F.sum(value * F.col("m")), counted).alias("silhouette"))
    # two single rows
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).crossJoin(whole)


def cluster_quality(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz from sums per cluster, and the squared-Euclidean silhouette.

    The mean squared distance of a point x to a cluster is
    ``|x|^2 - 2 x.mean + mean |y|^2``, so the silhouette needs one small row
    per cluster instead of pairs of points.
    """
    x = [F.col(c).cast("double") for c in features]
    norm2 = sum((v * v for v in x[1:]), x[0] * x[0])
    data = df.select(F.col(cluster).alias("__k"), *[v.alias(f"__x{i}") for i, v in enumerate(x)], norm2.alias("__n2"))
    centres = data.groupBy("__k").agg(
        F.count("*").alias("__size"),
        F.avg("__n2").alias("__m2"),
        F.array(*[F.avg(f"__x{i}") for i in range(len(x))]).alias("__c"),
    )

    def distance2(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    point = F.array(*[F.col(f"__x{i}") for i in range(len(x))])
    if centres.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    # one row that holds all clusters, at most MAX_CLUSTERS
    listed = centres.agg(F.collect_list(F.struct("__k", "__size", "__m2", "__c")).alias("__all"))
    joined = data.crossJoin(F.broadcast(listed)).withColumn("__p", point)

    def mean_distance2(c):
        dot = F.aggregate(F.zip_with("__p", c["__c"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return F.col("__n2") - 2 * dot + c["__m2"]

    own = F.get(F.filter("__all", lambda c: c["__k"] == F.col("__k")), F.lit(0))
    others = F.filter("__all", lambda c: c["__k"] != F.col("__k"))
    per_point = joined.select(
        "__k",
        distance2(F.col("__p"), own["__c"]).alias("__d2"),
        # the point itself is not among its neighbours
        F.try_divide(mean_distance2(own) * own["__size"], own["__size"] - 1).alias("__a"),
        F.array_min(F.transform(others, mean_distance2)).alias("__b"),
    )
    silhouette = F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b")), F.lit(0.0))
    per_cluster = per_point.groupBy("__k").agg(
        F.avg(F.sqrt("__d2")).alias("__s"), F.sum("__d2").alias("__w"), F.sum(silhouette).alias("__sil")
    )
    both = per_cluster.join(centres, "__k")
    clusters = both.agg(F.collect_list(F.struct("__k", "__size", "__c", "__s", "__w", "__sil")).alias("__all"))
    n = F.aggregate("__all", F.lit(0).cast("bigint"), lambda s, c: s + c["__size"])
    k = F.size("__all")

    def total(field):
        return F.aggregate("__all", F.lit(0.0), lambda s, c: s + c[field])

    dims = F.sequence(F.lit(0), F.lit(len(x) - 1))
    centre = F.transform(
        dims, lambda i: F.aggregate("__all", F.lit(0.0), lambda s, c: s + F.get(c["__c"], i) * c["__size"]) / n
    )
    between = F.aggregate(
        "__all", F.lit(0.0), lambda s, c: s + distance2(c["__c"], F.col("__centre")) * c["__size"]
    )
    worst = F.transform(
        "__all",
        lambda a: F.array_max(
            F.transform(
                F.filter("__all", lambda b: b["__k"] != a["__k"]),
                lambda b: F.try_divide(a["__s"] + b["__s"], F.sqrt(distance2(a["__c"], b["__c"]))),
            )
        ),
    )
    return (
        clusters.withColumn("__centre", centre)
        .select(
            k.alias("clusters"),
            n.alias("rows"),
            (total("__sil") / n).alias("silhouette"),
            (F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / k).alias("davies_bouldin"),
            F.try_divide(between * (n - k), total("__w") * (k - F.lit(1))).alias("calinski_harabasz"),
        )
    )


def cluster_profile(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Members, mean and std of each feature per cluster, and the z-score of its mean between clusters.

    Long form, one row per cluster and feature; with equal means the z-score is 0.
    """
    stats = df.groupBy(cluster).agg(
        F.count("*").alias("members"),
        *[F.avg(c).alias(f"__a{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(c).alias(f"__s{i}") for i, c in enumerate(features)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"__a{i}").alias("mean"), F.col(f"__s{i}").alias("std"))
            for i, c in enumerate(features)
        ]
    )
    long = stats.select(cluster, "members", F.explode(entries).alias("__e")).select(cluster, "members", "__e.*")
    # clusters x features rows
    between = long.groupBy("feature").agg(F.avg("mean").alias("__m"), F.stddev_samp("mean").alias("__sd"))
    z = (F.col("mean") - F.col("__m")) / F.coalesce(F.nullif("__sd", F.lit(0.0)), F.lit(1.0))
    return long.join(between, "feature").withColumn("between_z", z).drop("__m", "__sd")


def cluster_shares(df: DataFrame, cluster: str, values: Sequence[str], user: str | None = None) -> DataFrame:
    """Rows, share and value statistics per cluster, or per user and cluster (share within the user)."""
    keys = [user, cluster] if user else [cluster]
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[
            f(v).alias(f"{v}_{n}")
            for v in values
            for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ],
    )
    over = [user] if user else []
    totals = counts.groupBy(*over).agg(F.sum("rows").alias("__t"))
    # without a user the totals are one row
    joined = counts.join(totals, over) if over else counts.crossJoin(totals)
    return joined.withColumn("share_pct", F.col("rows") * 100.0 / F.col("__t")).drop("__t")


def highest_cluster(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """The cluster with the highest mean; the smaller label on ties. Noise (-1) is not a cluster."""
    means = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.avg(value).alias("mean"))
    return means.orderBy(F.col("mean").desc(), cluster).limit(1)


def label_progression(df: DataFrame, user: str, order: Sequence[str], cluster: str) -> DataFrame:
    """Each row with the label before it, per user in time order."""
    out = windowed(
        df, [user], [F.col(c) for c in order], lambda w: {"previous": F.lag(cluster, 1).over(w)}, 1
    )
    return out.withColumn("changed", (F.col(cluster) != F.col("previous")).cast("int"))
