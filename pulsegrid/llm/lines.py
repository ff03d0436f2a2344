"""Repeated runs of lines, found by winnowing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import content_key
from pulsegrid.session import freeze

BLANK = " \t\r\f\x0b"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _nonblank(line: Column) -> Column:
    return _bare(line) != ""


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _hashed(text: Column) -> Column:
    """``h, w`` of each line that is not blank: hash of the line without outer white space, and its words."""
    bare = F.filter(F.transform(_lines(text), _bare), lambda x: x != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("w")))


# Lines that are tried first; most runs are no longer.
FEW = 4


def _reaching(part: Callable[[int], Column], words: int) -> Column:
    """The leading lines of ``part(most)`` that just reach ``words``: hash, number, and whether they do.

    Every line has a word, so no more than ``words`` lines are ever needed.
    """
    start = F.struct(F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("k"))

    def grow(a: Column, s: Column) -> Column:
        longer = F.struct((a["w"] + s["w"]).alias("w"), F.xxhash64(a["h"], s["h"]).alias("h"), (a["k"] + 1).alias("k"))
        return F.when(a["w"] >= words, a).otherwise(longer)

    def run(most: int) -> Column:
        done = lambda a: F.struct(a["h"].alias("h"), a["k"].alias("k"), (a["w"] >= words).alias("ok"))
        return F.aggregate(part(most), start, grow, done)

    return F.get(F.transform(F.array(run(FEW)), lambda a: F.when(a["ok"], a).otherwise(run(words))), F.lit(0))


def _grams(noise_words: int) -> Column:
    """For each line the run from it that just reaches ``noise_words``."""
    return F.transform("__lines", lambda _, i: _reaching(lambda most: F.slice("__lines", i + 1, most), noise_words))


def _selected() -> Column:
    """The places of the window minima. The window of a line are the runs that begin within its own run; of equal hashes the last counts."""

    def minimum(g: Column, i: Column) -> Column:
        window = F.slice("__grams", i + 1, g["k"])
        whole = g["ok"] & ~F.exists(window, lambda x: ~x["ok"])
        least = F.array_min(F.transform(window, lambda x, j: F.struct(x["h"].alias("h"), (-(i + j)).alias("p"))))
        return F.when(whole, -least["p"])

    return F.array_distinct(F.filter(F.transform("__grams", minimum), lambda p: p.isNotNull()))


def _print(p: Column, around: int) -> Column:
    """The fingerprint at a place: run, place, and the hashes of the lines around it, nearest first, up to ``around`` words."""
    gram = F.get("__grams", p)
    end = p + gram["k"]
    before = lambda most: F.reverse(F.slice("__lines", F.greatest(p - most, F.lit(0)) + 1, F.least(p, F.lit(most))))
    behind = lambda most: F.slice("__lines", end + 1, most)

    def near(part: Callable[[int], Column]) -> Column:
        return F.transform(F.slice(part(around), F.lit(1), _reaching(part, around)["k"]), lambda s: s["h"])

    return F.struct(gram["h"].alias("gram"), gram["k"].alias("k"), p.alias("p"), near(before).alias("left"), near(behind).alias("right"))


def _parts() -> Column:
    """What a place may lose: its run, and each line around it under the hash of all lines between it and the run."""
    p, end = F.col("__at.p"), F.col("__at.p") + F.col("__k")
    part = lambda pre, first, last: F.struct(pre.alias("pre"), first.alias("first"), last.alias("last"))
    left = F.transform("__left", lambda _, i: part(F.xxhash64(F.lit(1), F.slice("__left", 1, i + 1)), p - i - 1, p - i - 1))
    right = F.transform("__right", lambda _, i: part(F.xxhash64(F.lit(2), F.slice("__right", 1, i + 1)), end + i, end + i))
    return F.concat(F.array(part(F.lit(0).cast("bigint"), p, end - 1)), left, right)


def repeated_runs(
    docs: DataFrame, *, noise_words: int = 25, guaranteed_words: int = 50, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``__k1, __k2, first, last``: later occurrences of runs of lines, counted in lines that are not blank, in parts.

    ``content_key`` of id and text names the document. A run is hashed from each
    line on, as long as it takes to reach ``noise_words`` words (parts between
    spaces). Of the runs that begin within such a run the one with the least hash
    is a fingerprint, so two documents that share lines of twice ``noise_words``,
    ``guaranteed_words``, share a fingerprint as well. Each occurrence is laid beside
    all earlier ones in the order of ids (nulls last), and extended both ways as long
    as the lines are equal to those of any of them. No pairs are made for that: the
    earliest place of each run with the next 1, 2, ... lines on one side is enough,
    and what has an earlier one with more lines has one with fewer. A part is the
    run itself or one line of an extension. Runs below ``noise_words`` are never reported.

    An extension takes in the lines that just reach ``guaranteed_words`` words on
    either side: what lies beyond has a fingerprint of its own.
    """
    if guaranteed_words < 2 * noise_words:
        raise ValueError("only runs of twice the noise words are guaranteed")
    keyed = docs.select(
        *content_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.col(f"`{doc_id}`").alias("__id"), _hashed(F.col(f"`{text}`")).alias("__lines")
    )
    hashed = freeze(keyed.where(F.size("__lines") > 0))
    marked = hashed.withColumn("__grams", _grams(noise_words)).withColumn("__places", _selected())
    # only the fingerprints leave their document, not its lines
    found = marked.select(
        "__k1", "__k2", "__id", F.explode(F.transform("__places", lambda p: _print(p, guaranteed_words))).alias("__print")
    )
    at = F.struct(
        F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__print.p").alias("p")
    )
    prints = freeze(
        found.select(
            F.col("__print.gram").alias("__gram"), F.col("__print.k").alias("__k"), at.alias("__at"),
            F.col("__print.left").alias("__left"), F.col("__print.right").alias("__right"),
        )
    )
    several = prints.groupBy("__gram").agg(F.count("*").alias("__n")).where("__n > 1").select("__gram")
    # written, so that common runs are dealt by their surroundings as well
    repeated = freeze(prints.join(several, "__gram", "left_semi"))
    parts = repeated.select("__gram", "__at", F.explode(_parts()).alias("__part"))
    keys = [F.col("__gram"), F.col("__part.pre").alias("__pre")]
    earliest = (
        parts.groupBy(*keys)
        .agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1")
        .select("__gram", "__pre", *[F.col(f"__first.{c}").alias(f"__{c}") for c in ("k1", "k2", "p")])
    )
    own = parts.select(*keys, *[F.col(f"__at.{c}").alias(c) for c in ("k1", "k2", "p")], "__part.first", "__part.last")
    later = own.join(earliest, ["__gram", "__pre"]).where("k1 != __k1 or k2 != __k2 or p != __p")
    return later.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "first", "last")


def without_repeated_runs(
    docs: DataFrame,
    *,
    noise_words: int = 25,
    guaranteed_words: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    removed: str = "lines_removed",
) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted, and their number in ``removed``.

    See ``repeated_runs``. All rows stay; a text of which nothing is repeated is
    returned as it is, a null text stays null, blank lines stay, and a line is
    only ever deleted if an equal one stands earlier. Rows that repeat id and text
    count as one document. Only hashes of lines are compared across documents; a
    very long text is one row of such hashes.
    """
    runs = repeated_runs(docs, noise_words=noise_words, guaranteed_words=guaranteed_words, doc_id=doc_id, text=text)
    gone = runs.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("first", "last")).alias("__runs"))
    places = F.array_distinct(F.flatten(F.transform("__runs", lambda r: F.sequence(r["first"], r["last"]))))
    gone = gone.select("__k1", "__k2", places.alias("__gone"))
    body = F.col(f"`{text}`")
    keyed = docs.select("*", *content_key(F.col(f"`{doc_id}`"), body))
    joined = keyed.join(gone, ["__k1", "__k2"], "left")
    numbers = F.filter(
        F.transform("__split", lambda x, i: F.when(_nonblank(x), i)), lambda i: i.isNotNull()
    )
    split = joined.withColumn("__split", F.when(F.col("__gone").isNotNull(), _lines(body))).withColumn("__no", numbers)
    kept = F.array_except(
        F.sequence(F.lit(0), F.size("__split") - 1), F.transform("__gone", lambda p: F.get("__no", p))
    )
    cleaned = split.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    rebuilt = F.array_join(F.transform("__kept", lambda i: F.get("__split", i)), "\n")
    columns = [
        F.when(F.col("__gone").isNull(), body).otherwise(rebuilt).alias(text) if c == text else F.col(f"`{c}`")
        for c in docs.columns
    ]
    return cleaned.select(*columns, F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias(removed))
