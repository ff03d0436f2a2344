"""The Merkle manifest, hard negatives and the BPE automaton against plain versions and odd inputs."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import sentence
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel as ByteDecoder
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel
from pyspark.sql import functions as F

import brute
from pulsegrid.llm import bpe_automaton, hard_negatives, merkle

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# 11: Merkle manifest


def _path(row):
    return [(s["left"], s["right"]) for s in row["path"]]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_matches_brute_force(spark, fanout):
    """Groups of one row, of a bucket, a row more, and of several bands; null groups and ids, ties, repeated rows."""
    rows = []
    for group, size in (("a", 1), ("b", 64), ("bé", 65), (None, 7), ("c", 2), ("d", 300), ("", 3)):
        rows += [(i if i % 11 else None, group, brute.sha(f"{group} {i // 2}")) for i in range(size)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(n, i, g, leaf, "x", 1) for n, (i, g, leaf) in enumerate(rows)], "n int, id int, g string, leaf string, root string, t int")
    made = merkle.manifest(frame, leaf="leaf", group="g", order=["id"], fanout=fanout)
    # of rows alike in all that places them, which one comes first is open, so they are compared as a list
    line = lambda i, g, leaf, sub, root, path: (i is not None, i or 0, g is not None, g or "", leaf, sub, root, path)
    got = sorted(line(r["id"], r["g"], r["leaf"], r["subroot"], r["root"], _path(r)) for r in made.proofs.collect())
    assert got == sorted(line(i, g, leaf, sub, root, path) for (i, g, leaf), (_, sub, root, path) in zip(rows, brute.merkle(rows, fanout)))
    assert made.proofs.columns == ["n", "id", "g", "leaf", "t", "rank", "subroot", "root", "path"]
    for r in made.nodes.collect():
        kids = r["children"]
        assert (r["lo"], r["hi"]) == (kids[0]["lo"], kids[-1]["hi"]) and all(a["hi"] == b["lo"] for a, b in zip(kids, kids[1:]))
        assert r["digest"] == brute.sha("".join(c["digest"] for c in kids)) and 1 <= len(kids) <= fanout
    sizes = {g: sum(x[1] == g for x in rows) for g in {g for _, g, _ in rows}}
    want = {g: sum(map(len, brute.merkle_levels(["x"] * n, fanout)[1:])) for g, n in sizes.items()}
    assert {r["tree"]: r["count"] for r in made.nodes.where("not top").groupBy("tree").count().collect()} == {g: n for g, n in want.items() if n}


def test_altered_rows_fold_to_another_root(spark):
    rows = spark.createDataFrame([(i, "en" if i % 3 else None, i, sentence(random.Random(i), 5)) for i in range(200)], "doc_id int, lang string, n_chars int, text string")
    leaf = merkle.row_digest("doc_id", "n_chars", "text")
    other = merkle.row_digest(F.col("doc_id"), F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text"))
    made = merkle.manifest(rows.select("doc_id", "lang", leaf.alias("leaf"), other.alias("other")), group="lang", order=["doc_id"]).proofs
    got = made.select("doc_id", merkle.folded("leaf").alias("same"), merkle.folded("other").alias("changed"), "root", merkle.proof_digest().alias("proof"), "path").collect()
    assert len({r["root"] for r in got}) == 1
    for r in got:
        assert r["same"] == r["root"] and (r["changed"] == r["root"]) == (r["doc_id"] % 10 != 0)
        assert r["proof"] == brute.sha("".join(a + b for a, b in _path(r)))


def test_leaf_of_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "lang", "text", "n_chars")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = merkle.manifest(odd.withColumn("leaf", merkle.row_digest("doc_id", "lang", "text")), group="source", order=["doc_id"])
    assert {r["leaf"] for r in made.proofs.collect()} == {brute.sha(field(r["doc_id"]) + field(r["lang"]) + field(r["text"])) for r in docs.collect()}
    assert made.proofs.count() == odd.count() and made.proofs.where(merkle.folded("leaf") == F.col("root")).count() == odd.count()
    empty = merkle.manifest(none.withColumn("leaf", merkle.row_digest("text")), group="lang", order=["doc_id"])
    assert empty.proofs.count() == 0 and empty.nodes.count() == 0


# 12: hard negatives


def test_strassen_is_exact(monkeypatch):
    draw = np.random.default_rng(1)
    for n, k, m, least in [(1, 1, 1, 1), (7, 5, 9, 1), (33, 64, 65, 4), (64, 64, 64, 8), (100, 3, 40, 2), (130, 70, 257, 32), (0, 4, 3, 2)]:
        a, b = draw.integers(-1000, 1000, (n, k)), draw.integers(-1000, 1000, (k, m))
        assert (hard_negatives.strassen(a, b, least) == a @ b).all()
    # sums beyond 64 bits on the way do no harm where the result fits
    a, b = np.full((8, 8), 1 << 40), np.zeros((8, 8), np.int64)
    b[0], b[1] = 1 << 22, -(1 << 22)
    assert (hard_negatives.strassen(a, b, 1) == 0).all()


SCHEMA = "vec_id bigint, v array<double>, kind int, label string, `row` int, anchor string"


def _mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", 1, "y") for i, v, y in rows], SCHEMA)
    out = hard_negatives.mine(df, row_id="vec_id", vector="v", label="kind", anchor=F.col("vec_id") % 10 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def _plain(rows, **more):
    return sorted(tuple(-1 if x is None else x for x in r) for r in brute.hard_negatives(rows, lambda i: i % 10 == 0, **more))


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    """Several blocks of either side, many ties, one label with a third of the rows."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 16)
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.25, 0.5, 1.0, 1.01]) for _ in range(6)], 0 if i % 3 == 0 else draw.randrange(4)) for i in range(120)]
    want = _plain(rows)
    assert len(want) > 200 and any(r[2] == 5 for r in want)
    assert _mined(spark, rows) == want
    assert _mined(spark, rows, positives=2, negatives=3, low=50, high=110) != want


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (10, [1.0, 2.0, 0.5], 1), (None, [1.0, 2.0], 1), (None, [0.9, 2.0], 2), (3, [0.95, 1.9], 2), (3, [0.95, 1.9], 2),
        (4, None, 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (20, [1.0, 1.0], None), (30, [], 1), (40, [-1.0, -1.0], 7), (8, [1.0], 2), (9, [1.0, 1.99], 3),
    ]
    got = _mined(spark, rows)
    assert got == _plain(rows) and got
    assert _mined(spark, []) == [] and _mined(spark, [(0, [1.0], 1)]) == [] and _mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    with pytest.raises(ValueError, match="55 bits"):
        _mined(spark, [(0, [1e12], 1)])


# 13: BPE automaton


def _coded(docs, tokenizer=VOCABULARY):
    rows = bpe_automaton.encode(docs, tokenizer=tokenizer, decoded="decoded").collect()
    return rows


def test_encoder_matches_the_library():
    library, own = Tokenizer.from_file(VOCABULARY), bpe_automaton.encoder(VOCABULARY)
    draw, alphabet = random.Random(3), ["a", "b", " the", "s", "'", "'s", "'re", " ", "  ", "\n", "\t", "é", "é", "…", "×", "日", "本", "1", "23", "(", "<|endoftext|>", "　", "\xa0", " ", "\x1c", "\x85", "\x0b", "​", "ñ", "😀", "aaaa", "ing", ".", "Ж"]
    for _ in range(150):
        texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(20)] + [None, ""]
        ids, bounds = own.encode(pa.array(texts, pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
        assert bpe_automaton.spelled(own.automaton, ids, bounds).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_automaton_of_any_merges(tmp_path):
    """Random merge lists, merges that can never happen and runs of one letter among them."""
    letters = bpe_automaton.byte_letters()
    for seed in range(25):
        draw = random.Random(seed)
        vocab = {c: b for b, c in letters.items()}
        merges, tokens = [], list("aaab" if seed % 2 else "abc")
        for _ in range(40):
            u, v = draw.choice(tokens), draw.choice(tokens)
            if u + v not in vocab and len(u + v) < 9:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                tokens.append(u + v)
        library = Tokenizer(BPE(vocab, merges))
        library.pre_tokenizer, library.decoder = ByteLevel(add_prefix_space=False), ByteDecoder()
        path = f"{tmp_path}/{seed}.json"
        library.save(path)
        texts = ["".join(draw.choice("aabc ") for _ in range(draw.randrange(60))) for _ in range(80)] + ["a" * 50, "ab" * 40]
        ids, bounds = bpe_automaton.Encoder(path).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t).ids for t in texts], seed


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        bpe_automaton.automaton(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(open(VOCABULARY, encoding="utf-8").read())
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "strips.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="around them"):
        bpe_automaton.automaton(str(tmp_path / "strips.json"))


def test_encode_and_decode_odd_input(spark, odd, none):
    library = Tokenizer.from_file(VOCABULARY)
    named = odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).withColumn("__text", F.lit("y")).withColumn("c1", F.lit("z"))
    got = _coded(named.select("*", F.col("text").alias("copy")))
    assert set(got[0].asDict()) == {*(set(named.columns) - {"text"}), "ids", "decoded", "copy"}
    want = {t: e.ids for t, e in ((t, library.encode(t or "", add_special_tokens=False)) for t in {r["copy"] for r in got})}
    assert len(got) == odd.count()
    for r in got:
        assert r["ids"] == want[r["copy"]] and r["decoded"] == (r["copy"] or "") and r["__text"] == "y" and r["c1"] == "z"
    assert bpe_automaton.encode(none, tokenizer=VOCABULARY).count() == 0
    rows = [(1, [15496, 995]), (2, []), (3, None), (4, [50256, 255, 10**6, -1, 220]), (5, [None, 15496]), (6, [447]), (7, [447, 105, 447])]
    back = bpe_automaton.decode(spark.createDataFrame([(i, x, "t") for i, x in rows], "i int, ids array<int>, text string"), tokenizer=VOCABULARY)
    assert back.columns == ["i", "text"]
    plain = lambda x: library.decode([t for t in x if t is not None and 0 <= t < 50257], skip_special_tokens=False)
    assert {r["i"]: r["text"] for r in back.collect()} == {i: None if x is None else plain(x) for i, x in rows}
