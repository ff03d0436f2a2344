"""URL filter: rules first, then a ratio of two character language models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
# Pseudo-counts with which a longer context leans on the next shorter one.
SMOOTHING = 2.0
# Ratios are kept as whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000
# Scores are compared in steps of a hundredth of a nat per character, within 20 nats.
STEP = 10_000
MOST = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z as a-z; empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host up to ``? #`` or the end; empty without ``://`` or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; of equally long ones the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])) if rules else ():
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """All ``ORDER`` consecutive characters of the text behind three marks and before one."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


def _ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, ratio`` of all wanted grams: log of how much likelier the last character is where urls are allowed.

    ``counts`` has ``gram, allow, block``. The probability of a character behind
    a context is its share there, leaning on the share behind the context without
    its first character, down to equal shares of all characters.
    """
    symbols = counts.agg(F.count_distinct(F.right("gram", F.lit(1)))).first()[0] + 1
    rows = wanted.select("gram", F.lit(1.0 / symbols).alias("pa"), F.lit(1.0 / symbols).alias("pb"))
    for k in range(1, ORDER + 1):
        seen = counts.groupBy(F.right("gram", F.lit(k)).alias("__end")).agg(F.sum("allow").alias("na"), F.sum("block").alias("nb"))
        context = seen.groupBy(F.substring("__end", 1, k - 1).alias("__context")).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
        keyed = rows.withColumn("__end", F.right("gram", F.lit(k))).withColumn("__context", F.substring("__end", 1, k - 1))
        # without a context there is one row of totals
        context = F.broadcast(context) if k == 1 else context
        joined = keyed.join(seen, "__end", "left").join(context, "__context", "left")
        rows = joined.select(
            "gram",
            *[
                ((F.coalesce(n, F.lit(0)) + SMOOTHING * F.col(p)) / (F.coalesce(t, F.lit(0)) + SMOOTHING)).alias(p)
                for n, t, p in (("na", "ta", "pa"), ("nb", "tb", "pb"))
            ],
        )
    return rows.select("gram", F.round((F.ln("pa") - F.ln("pb")) * UNIT).cast("bigint").alias("ratio"))


def judge_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` without other work done on them, with ``host, path, rule, verdict, score``.

    ``rules`` are pairs of ``allow`` or ``block`` and ``host/path``; the longest one
    that fits decides. All other urls are decided by two smoothed character models
    of variable order, one of the urls that rules allow and one of those they
    block: allowed if the difference of log likelihoods per character reaches
    a cut. About a fifth of the urls with a rule, by hash, is kept from the counts,
    and the cut is the one with the best balanced accuracy on them (0 if they are
    of one kind only). ``score`` is the difference in nats per character.

    A null url, or one without ``://``, has an empty host and path; with nothing
    to judge it is allowed. Repeated urls are scored once; without rules
    or without urls that fit them, everything is allowed.
    """
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    parsed = pages.withColumn("host", host).withColumn("path", path)
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("__kind", kind)
    judged = judged.withColumn("__text", F.concat("host", F.translate("path", UPPER, LOWER)))
    texts = judged.groupBy("__text").agg(
        F.count_if(F.col("__kind") == "allow").alias("allow"), F.count_if(F.col("__kind") == "block").alias("block")
    )
    kept_back = F.substring(F.md5("__text"), 1, 1).isin("0", "1", "2")
    spread = texts.select("__text", "allow", "block", F.explode(_grams(F.col("__text"))).alias("gram"))
    counts = (
        spread.where(~kept_back & (F.col("allow") + F.col("block") > 0))
        .groupBy("gram")
        .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    )
    ratios = _ratios(counts, spread.select("gram").distinct())
    scored = (
        spread.join(ratios, "gram")
        .groupBy("__text")
        .agg(F.sum("ratio").alias("__sum"), F.count("*").alias("__n"), F.max("allow").alias("allow"), F.max("block").alias("block"))
    )
    bucket = F.greatest(F.least(F.floor(F.col("__sum") / (F.col("__n") * STEP)), F.lit(MOST)), F.lit(-MOST)).cast("int")
    scored = scored.withColumn("__bucket", bucket)
    # at most 2 * MOST + 1 rows
    table = scored.where(kept_back & (F.col("allow") + F.col("block") > 0)).groupBy("__bucket").agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).collect()
    cut = best_cut([(r["__bucket"], r["a"], r["b"]) for r in table])
    method = F.when((F.col("__text") == "") | (F.col("__bucket") >= cut), "allow").otherwise("block")
    result = judged.join(scored.select("__text", "__bucket", "__sum", "__n"), "__text")
    return result.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")],
        "host",
        "path",
        "rule",
        F.coalesce("__kind", method).alias("verdict"),
        (F.col("__sum") / F.col("__n") / UNIT).alias("score"),
    )


def best_cut(table: Sequence[tuple[int, int, int]]) -> int:
    """The bucket from which on to allow, for ``(bucket, allowed, blocked)``: best balanced accuracy.

    Of buckets that are equally good the lowest counts; within the gap below it,
    where nothing was seen, the cut goes as near to an even ratio as it can.
    """
    allowed, blocked = sum(a for _, a, _ in table), sum(b for _, _, b in table)
    if not allowed or not blocked:
        return 0
    right = lambda cut: sum(a for k, a, _ in table if k >= cut) * blocked + sum(b for k, _, b in table if k < cut) * allowed
    buckets = sorted(k for k, _, _ in table)
    best = max(buckets, key=right)
    below = [k for k in buckets if k < best]
    return min(max(0, below[-1] + 1 if below else -MOST), best)


def allowed_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with the columns of ``pages``."""
    kept = judge_urls(pages, rules=rules, url=url).where("verdict = 'allow'")
    return kept.select(*[F.col(f"`{c}`") for c in pages.columns])
