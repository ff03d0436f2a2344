"""A Merkle manifest of a table: a hash tree per group, one above the groups, and a proof per row.

Every node carries the interval ``[lo, hi)`` of the leaf ranks it covers, so a
node is an ancestor of another one exactly if its interval holds the other's.
Levels are taken in bands, and within a band nodes lie in buckets of one interval
each, which are one row of a table and bounded in number whatever the size of the
tree or of its largest group. Leaves meet their bucket in a join and keep the nodes
whose interval holds them; what a parent's interval has beside the child's are the
siblings. A bucket's top is a leaf of the next band, and proofs are put together
from the top band down, so no level is joined with all leaves of the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import CHUNK, POS, RANGE_ROWS, matched, range_chunks
from pulsegrid.session import freeze

# A bucket covers this many nodes of the level it begins with, at most.
BUCKET_NODES = 64
TOP = ""


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*cols: Column | str) -> Column:
    """The leaf of a row: the digest of its fields in order."""
    return digest(*[field(F.col(c) if isinstance(c, str) else c) for c in cols])


@dataclass
class Manifest:
    """``nodes``: ``tree, level, lo, hi, digest, children`` of all inner nodes, the tree above the groups being ``''``.

    ``proofs``: the rows of the table with ``rank`` in their group, ``subroot``,
    ``root`` and ``path``, an array of ``level, left, right`` from the leaf
    up: the digests of the siblings on either side, one after another.
    """

    nodes: DataFrame
    proofs: DataFrame


def _ranked(rows: DataFrame, group: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``__i``, the rank within the group, and the number of rows per group.

    Rows are sorted over ranges whatever the groups' sizes; each range adds what
    the ranges before it hold of the group.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    placed = range_chunks(rows, [group], order, ranges)
    facts = placed.groupBy(CHUNK, group).agg(F.count("*").alias("__n"), F.min(POS).alias("__first"))
    # at most a row per range and group
    before = Window.partitionBy(group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    ranked = matched(placed, facts.select(CHUNK, group, shift.alias("__shift")), [CHUNK, group])
    sizes = facts.groupBy(F.col(group).alias("t")).agg(F.sum("__n").alias("size"))
    return ranked.withColumn("__i", F.col(POS) + F.col("__shift")).drop(CHUNK, POS, "__shift"), sizes


def _levels(fanout: int) -> int:
    """Levels of a band, so that a bucket has at most ``BUCKET_NODES`` nodes at its bottom."""
    n = 1
    while fanout ** (n + 1) <= BUCKET_NODES:
        n += 1
    return n


def _parent(below: str, level: int, fanout: int) -> Callable[[Column], Column]:
    """The parent with a number in its bucket, made of its run of the nodes in ``below``."""

    def made(number: Column) -> Column:
        own = F.slice(below, number * fanout + 1, F.lit(fanout))
        children = F.transform(own, lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest")))
        return F.struct(
            number.cast("bigint").alias("i"),
            F.get(own, F.lit(0))["lo"].alias("lo"),
            F.element_at(own, -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform(own, lambda c: c["digest"]), "")).alias("digest"),
            F.lit(level).alias("level"),
            children.alias("children"),
        )

    return made


def _climb(items: DataFrame, sizes: DataFrame, fanout: int) -> list[DataFrame]:
    """The bands from the bottom, each a written table ``t, bucket, lo, hi, digest, nodes`` with the parents of each bucket.

    ``items``: ``t, i, lo, hi, digest``, nodes of one level by their rank.
    """
    levels = _levels(fanout)
    width = fanout**levels
    largest = sizes.agg(F.max("size")).first()[0] or 0
    bands, level, base = [], items, 0
    while True:
        kids = F.sort_array(F.collect_list(F.struct("i", "lo", "hi", "digest")))
        held = level.groupBy("t", F.floor(F.col("i") / width).alias("bucket")).agg(kids.alias("l0"))
        left = F.ceil(F.col("size") / F.lit(width**len(bands)))
        held = held.join(sizes, "t").withColumn("more", left > width).withColumn("n0", F.array())
        for k in range(1, levels + 1):
            below = f"l{k - 1}"

            # a group ends where one node is left, which only its last bucket can tell
            going = F.col("more") | (F.size(below) > 1)
            count = F.ceil(F.size(below) / F.lit(fanout)).cast("int")
            made = F.transform(F.sequence(F.lit(0), count - 1), _parent(below, base + k, fanout))
            held = held.withColumn(f"p{k}", F.when(going, made))
            plain = F.transform(f"p{k}", lambda c: F.struct(c["i"].alias("i"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["digest"].alias("digest")))
            held = held.withColumn(f"l{k}", F.coalesce(plain, below))
        made = [F.coalesce(f"p{k}", F.array().cast(held.schema[f"p{k}"].dataType)) for k in range(1, levels + 1)]
        top = F.get(f"l{levels}", F.lit(0))
        band = freeze(
            held.select("t", "bucket", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), F.concat(*made).alias("nodes"))
        )
        bands.append(band)
        base += levels
        if largest <= width ** len(bands):
            return bands
        level = band.select("t", F.col("bucket").alias("i"), "lo", "hi", "digest")


def _nodes(band: DataFrame) -> DataFrame:
    return band.select("t", "bucket", F.explode("nodes").alias("n")).select("t", "bucket", "n.level", "n.lo", "n.hi", "n.digest", "n.children")


def _paths(items: DataFrame, bands: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``items`` (``t, i, lo, hi, row``) as ``t, i, row, path, above``, the siblings up to the tree's root and what ``above`` says of the tree."""
    width = fanout ** _levels(fanout)
    # the whole tree is the one bucket of a band above all
    upper = above.select("t", F.lit(0).cast("bigint").alias("bucket"), F.array().cast("array<struct<level:int,left:string,right:string>>").alias("higher"), "above")
    for number in reversed(range(len(bands))):
        below = items if number == 0 else bands[number - 1].select("t", F.col("bucket").alias("i"), "lo", "hi", F.lit(0).alias("row"))
        below = below.withColumn("bucket", F.floor(F.col("i") / width))
        # a bucket has a bounded number of nodes; ancestors are those whose interval holds the item's, lowest first
        met = below.join(bands[number].select("t", "bucket", "nodes"), ["t", "bucket"]).join(upper, ["t", "bucket"])
        ancestors = F.filter("nodes", lambda n: (n["lo"] <= F.col("lo")) & (F.col("hi") <= n["hi"]))

        def step(n: Column) -> Column:
            # what the parent's interval has on either side of the part that holds the item
            beside = lambda side: F.array_join(F.transform(F.filter(n["children"], side), lambda c: c["digest"]), "")
            left, right = beside(lambda c: c["hi"] <= F.col("lo")), beside(lambda c: c["lo"] >= F.col("hi"))
            return F.struct(n["level"].alias("level"), left.alias("left"), right.alias("right"))

        full = met.select("t", "i", "row", F.concat(F.transform(ancestors, step), "higher").alias("path"), "above")
        upper = full.select("t", F.col("i").alias("bucket"), F.col("path").alias("higher"), "above")
    return full


def manifest(rows: DataFrame, *, leaf: str = "leaf", group: str, order: Sequence[str], fanout: int = 2) -> Manifest:
    """The tree of each group, its leaves by ``order`` (nulls first), and the tree of the groups' roots.

    While a level has several nodes, every ``fanout`` consecutive ones, the last
    run possibly fewer or one, become the digest of their digests. The root of a
    group with one row is its leaf. Groups come by their UTF-8 bytes, null first,
    and are joined the same way. Rows that tie in ``order`` come by their leaves, so
    repeated rows change no digest. ``leaf`` must not be null. An empty table has
    no nodes and no proofs. Columns of ``rows`` named ``rank``, ``subroot``, ``root``
    or ``path`` are replaced.
    """
    kept = [c for c in rows.columns if c not in ("rank", "subroot", "root", "path")]
    # '-' sorts before ':', and so null before any group
    name = F.when(F.col(f"`{group}`").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(f"`{group}`").cast("string")))
    packed = rows.select(name.alias("__t"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    by = [F.col("__row")[c] for c in [*order, leaf]]
    ranked, sizes = _ranked(freeze(packed), "__t", by)
    rank = F.col("__i")
    items = ranked.select(F.col("__t").alias("t"), rank.alias("i"), rank.alias("lo"), (rank + 1).alias("hi"), F.col("__row").alias("row"))
    items, sizes = freeze(items), freeze(sizes)
    bands = _climb(items.withColumn("digest", F.col("row")[leaf]), sizes, fanout)

    groups, _ = _ranked(freeze(bands[-1].select(F.lit(TOP).alias("__t"), "t", "digest")), "__t", [F.col("t")])
    tops = groups.select(
        F.col("__t").alias("t"), rank.alias("i"), rank.alias("lo"), (rank + 1).alias("hi"), F.struct("t", "digest").alias("row"), "digest"
    )
    tops = freeze(tops)
    one = freeze(tops.groupBy("t").agg(F.count("*").alias("size")))
    upper = _climb(tops.select("t", "i", "lo", "hi", "digest"), one, fanout)
    root = upper[-1].select("t", F.struct("digest").alias("above"))
    led = _paths(tops.drop("digest"), upper, root, fanout)
    above = freeze(led.select(F.col("row.t").alias("t"), F.struct(F.col("row.digest").alias("subroot"), F.col("above.digest").alias("root"), "path").alias("above")))

    found = _paths(items, bands, above, fanout)
    proofs = found.select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("i").alias("rank"), F.col("above.subroot").alias("subroot"),
        F.col("above.root").alias("root"), F.concat("path", "above.path").alias("path"),
    )
    label = F.when(F.col("t") == "-", F.lit(None)).otherwise(F.substring("t", 2, 1 << 30))
    inner = [_nodes(b).select(label.alias("tree"), F.lit(False).alias("top"), "level", "lo", "hi", "digest", "children") for b in bands]
    outer = [_nodes(b).select(F.lit(None).cast("string").alias("tree"), F.lit(True).alias("top"), "level", "lo", "hi", "digest", "children") for b in upper]
    nodes = inner[0]
    for part in [*inner[1:], *outer]:
        nodes = nodes.unionByName(part)
    return Manifest(nodes, proofs)


def proof_digest(path: Column | str = "path") -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and the siblings on its path give; it is the manifest's root if the leaf is."""
    leaf, path = (F.col(c) if isinstance(c, str) else c for c in (leaf, path))
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))
