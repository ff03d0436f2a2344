"""The registered queries of the text operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe_automaton, decontaminate, exact, hard_negatives, jaccard, language, licences, lines, merkle, packing
from pulsegrid.llm import token_store, toxicity, urls
from pulsegrid.llm.common import spark_crc32
from pulsegrid.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM places),
hits AS MATERIALIZED (SELECT g.doc_id, g.i, g.n, windows.item_id FROM grams g JOIN windows USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_token_id_output")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, tokenizer=TOKENIZER)
    return token_store.read_digests(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


_BODY = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_BODY} AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""


@query("op10_exact_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.sha2(exact.without_space(F.col("text")), 256).alias("text_sha256")
    )
    return exact.exact_duplicates(docs, carry=["text_sha256"])


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=5, threshold=0.8)
    return classes.select("doc_id", "class_id", "text_class", "n_links", "n_grams")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = spark_crc32("doc_id") % 3 == 1
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    scored = toxicity.score(rows, model)
    return scored.withColumn("predicted", toxicity.flagged(F.col("score"), 0.7))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(spark_crc32("doc_id") % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeated_runs(docs, noise_words=25, guaranteed_words=50)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _by_rule(value: int) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    cases = " ".join(f"WHEN {_fits(r[1].partition('/')[0], '/' + r[1].partition('/')[2])} THEN '{r[value]}'" for r in longest)
    return f"CASE {cases} END"


def _order_sql(k: int) -> str:
    """One step of the smoothing: shares behind ``k - 1`` characters, leaning on the step before."""
    share = "(coalesce({n}, 0) + 2.0 * p.{p}) / (coalesce({t}, 0) + 2.0) AS {p}"
    return f"""
seen{k} AS (SELECT right(gram, {k}) AS tail, sum(allow) AS na, sum(block) AS nb FROM counts GROUP BY 1),
context{k} AS (SELECT substr(tail, 1, {k - 1}) AS context, sum(na) AS ta, sum(nb) AS tb FROM seen{k} GROUP BY 1),
p{k} AS (
  SELECT p.gram, {share.format(n="na", t="ta", p="pa")}, {share.format(n="nb", t="tb", p="pb")}
  FROM p{k - 1} p LEFT JOIN seen{k} ON tail = right(p.gram, {k}) LEFT JOIN context{k} ON context = substr(right(p.gram, {k}), 1, {k - 1}))"""


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
judged AS MATERIALIZED (
  SELECT *, host || translate(path, {_LOWER}) AS t, {_by_rule(1)} AS rule, {_by_rule(0)} AS kind FROM parsed),
texts AS MATERIALIZED (
  SELECT t, count(*) FILTER (kind = 'allow') AS allow, count(*) FILTER (kind = 'block') AS block,
    substr(md5(t), 1, 1) IN ('0', '1', '2') AS kept_back
  FROM judged GROUP BY t),
spread AS MATERIALIZED (
  SELECT t, allow, block, kept_back, substr('^^^' || t || '$', i, 4) AS gram
  FROM (SELECT *, unnest(range(1, length(t) + 2)) AS i FROM texts)),
counts AS MATERIALIZED (
  SELECT gram, sum(allow) AS allow, sum(block) AS block FROM spread WHERE NOT kept_back AND allow + block > 0 GROUP BY gram),
p0 AS (
  SELECT DISTINCT gram, 1.0 / (SELECT count(DISTINCT right(gram, 1)) + 1 FROM counts)::DOUBLE AS pa,
    1.0 / (SELECT count(DISTINCT right(gram, 1)) + 1 FROM counts)::DOUBLE AS pb FROM spread),
{_order_sql(1)},{_order_sql(2)},{_order_sql(3)},{_order_sql(4)},
ratios AS (SELECT gram, CAST(round((ln(pa) - ln(pb)) * 1000000) AS BIGINT) AS ratio FROM p4),
scored AS MATERIALIZED (
  SELECT t, kept_back, any_value(allow) AS allow, any_value(block) AS block, sum(ratio) / 1000000 / count(*) AS score,
    greatest(least(floor(CAST(sum(ratio) AS DOUBLE) / (count(*) * 10000)), 2000), -2000) AS bucket
  FROM spread JOIN ratios USING (gram) GROUP BY t, kept_back),
steps AS (SELECT bucket, sum(allow) AS a, sum(block) AS b FROM scored WHERE kept_back AND allow + block > 0 GROUP BY bucket),
cuts AS (
  SELECT c.bucket, sum(CASE WHEN s.bucket >= c.bucket THEN s.a ELSE 0 END) * sum(s.b)
    + sum(CASE WHEN s.bucket < c.bucket THEN s.b ELSE 0 END) * sum(s.a) AS good, sum(s.a) AS a, sum(s.b) AS b
  FROM steps c, steps s GROUP BY c.bucket),
gaps AS (SELECT *, least(greatest(0, coalesce(lag(bucket) OVER (ORDER BY bucket) + 1, -2000)), bucket) AS cut FROM cuts),
cut AS (SELECT coalesce((SELECT cut FROM gaps WHERE a > 0 AND b > 0 ORDER BY good DESC, bucket LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN t = '' OR bucket >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM judged JOIN scored USING (t), cut
"""


@query("op2_url_filters", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules=RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_license_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(shift: int = 0) -> str:
    parts = []
    for c in _FIELDS:
        value = f"CAST({c} + {shift} AS VARCHAR)" if shift and c == "n_chars" else f"CAST({c} AS VARCHAR)"
        parts.append(f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')")
    return f"sha256({' || '.join(parts)})"


# CRC-32 bit by bit, over the ASCII characters of a string.
_BYTE = "CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(i // 8 AS BIGINT) + 1, 1)) AS BIGINT)) ELSE c END"
_CRC = f"list_reduce(range(0, 8 * length(s)), lambda c, i: xor({_BYTE} >> 1, 3988292384 * (({_BYTE}) & 1)), CAST(4294967295 AS BIGINT))"

# Level by level: a tree whose level has one node stops. `fold` hashes an item up its path.
OP11_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor({_CRC}, 4294967295) % 7 = 0 THEN {_leaf_sql(1)} ELSE {_leaf_sql()} END AS altered
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(':' || lang, '-') AS t FROM d),
level(t, k, i, h, m) AS (
  SELECT t, 0, i, leaf, count(*) OVER (PARTITION BY t) FROM ranked
  UNION ALL
  SELECT t, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((m + 1) // 2) FROM level WHERE m > 1 GROUP BY t, k, i // 2),
nodes AS MATERIALIZED (SELECT * FROM level),
tops AS MATERIALIZED (SELECT t AS tree, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS i FROM nodes WHERE m = 1),
above(k, i, h, m) AS (
  SELECT 0, i, subroot, count(*) OVER () FROM tops
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((m + 1) // 2) FROM above WHERE m > 1 GROUP BY k, i // 2),
upper AS MATERIALIZED (SELECT * FROM above),
shifted AS (SELECT t, max(k) AS height FROM nodes GROUP BY t),
path AS MATERIALIZED (
  SELECT r.doc_id, r.leaf, r.i AS own, r.t, p.k AS step, (r.i >> p.k) % 2 AS odd, coalesce(s.h, '') AS sibling
  FROM ranked r JOIN (SELECT DISTINCT t, k FROM nodes WHERE m > 1) p ON p.t = r.t
  LEFT JOIN nodes s ON s.t = r.t AND s.k = p.k AND s.i = xor(r.i >> p.k, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, r.i, r.t, height + p.k, (o.i >> p.k) % 2, coalesce(s.h, '')
  FROM ranked r JOIN shifted USING (t) JOIN tops o ON o.tree = r.t JOIN (SELECT DISTINCT k FROM upper WHERE m > 1) p ON true
  LEFT JOIN upper s ON s.k = p.k AND s.i = xor(o.i >> p.k, 1)),
proofs AS (SELECT t, own, sha256(string_agg(sibling, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY t, own),
fold(t, own, step, h) AS (
  SELECT t, i, 0, altered FROM ranked
  UNION ALL
  SELECT f.t, f.own, f.step + 1, sha256(CASE WHEN odd = 1 THEN sibling || h ELSE h || sibling END)
  FROM fold f JOIN path p ON p.t = f.t AND p.own = f.own AND p.step = f.step),
ends AS (SELECT t, own, arg_max(h, step) AS folded_root FROM fold GROUP BY t, own),
root AS (SELECT h AS root FROM upper WHERE m = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked r JOIN tops ON tree = r.t CROSS JOIN root LEFT JOIN proofs p ON p.t = r.t AND p.own = r.i JOIN ends e ON e.t = r.t AND e.own = r.i
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = F.when(F.coalesce(spark_crc32("doc_id") % 7 == 0, F.lit(False)), F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    altered = [more if c == "n_chars" else F.col(c) for c in _FIELDS]
    leaves = docs.select("doc_id", "lang", merkle.row_digest(*_FIELDS).alias("leaf"), merkle.row_digest(*altered).alias("altered"))
    found = merkle.manifest(leaves, leaf="leaf", group="lang", order=["doc_id"], fanout=2).proofs
    folded = found.withColumn("folded_root", merkle.folded("altered")).withColumn("proof_sha256", merkle.proof_digest())
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM pairs WHERE same) WHERE k <= 5)
SELECT * FROM (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND score <= positive_score) WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.mine(rows, row_id="vec_id", vector="embedding", label="label", anchor=F.col("vec_id") % 100 == 0)


@query("op13_bpe_automaton")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_automaton.encode(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
