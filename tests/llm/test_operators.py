"""The text operators against plain Python versions, round trips and odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import make, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from pulsegrid.llm import common, decontaminate, exact, jaccard, language, licences, lines, packing, token_store, toxicity, urls
from pulsegrid.llm.tokens import encoder
from pulsegrid.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def coded(texts):
    ids = Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 1], "<u4") for e in ids]


# shared helpers


def test_words_and_encoder_match_plain_versions(monkeypatch):
    draw, alphabet = random.Random(1), ["a", "B", "s", "'", "'s", ".", ",", " ", "\n", "é", "É", "e\u0301", "…", "×", "Σ", "日", "1", "(", "<|endoftext|>", "İ", "\u3000", "ñ"]
    known = encoder(VOCABULARY)
    for window in (5, 64, 1 << 20):
        monkeypatch.setattr(common, "WINDOW_BYTES", window)
        for _ in range(60):
            texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(20))) if draw.random() < 0.9 else None for _ in range(5)]
            _, bounds = common.words_of_rows(pa.array(texts, pa.string()))
            assert np.diff(bounds).tolist() == [len(brute.words(t)) for t in texts]
            ids, bounds = known.encode(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [c[:-1].tolist() for c in coded(texts)]


# 1: lines


def test_line_dedup_matches_brute_force(spark):
    draw = random.Random(2)
    pool = [sentence(draw, draw.choice([3, 8, 20, 30, 60])) for _ in range(12)]
    docs = {}
    for i in range(60):
        out = []
        for _ in range(draw.randrange(1, 8)):
            k = draw.randrange(12)
            out += pool[k : k + draw.randrange(1, 4)] if draw.random() < 0.6 else [sentence(draw, 12), ""]
        docs[i] = "\n".join(out)
    want = brute.line_dedup(docs)
    got = lines.without_repeated_runs(make(spark, docs.items())).collect()
    assert {r["doc_id"]: (r["text"], r["lines_removed"]) for r in got} == want
    assert sum(n for _, n in want.values()) > 20


def test_line_dedup_guarantee(spark):
    """A passage of over 50 words is found wherever it stands, and the clean text around it stays."""
    draw = random.Random(3)
    passage = [sentence(draw, 18) for _ in range(3)]
    docs = {i: "\n".join([sentence(draw, 15 + i), *passage, sentence(draw, 12 + i)]) for i in range(9)}
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.without_repeated_runs(make(spark, docs.items())).collect()}
    assert got[0] == docs[0].split("\n")
    for i in range(1, 9):
        assert got[i] == [docs[i].split("\n")[0], docs[i].split("\n")[-1]]


def test_line_dedup_compares_all_earlier_places(spark):
    """The earliest place of a run need not be the one whose surroundings are repeated."""
    draw = random.Random(23)
    same, tail = sentence(draw, 31), sentence(draw, 20)
    source = "\n".join([sentence(draw, 11), same, same, same, same, tail])
    short = [sentence(draw, 7) for _ in range(9)]
    docs = {1: source, 2: sentence(draw, 12) + "\n" + source.split("\n", 1)[1]}
    # each run of 25 words or more of the passage also stands alone in an earlier document
    docs |= {10 + k: "\n".join([sentence(draw, 30), *short[k : k + 4], sentence(draw, 30)]) for k in range(6)}
    docs |= {i: "\n".join([sentence(draw, 30), *short, sentence(draw, 30)]) for i in (30, 31)}
    pool = [sentence(draw, draw.choice([3, 8, 20, 30])) for _ in range(9)]
    for i in range(40, 80):
        docs[i] = "\n".join(pool[draw.randrange(9)] for _ in range(draw.randrange(1, 12)))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.without_repeated_runs(make(spark, docs.items())).collect()}
    assert got == brute.line_dedup(docs)
    assert got[2] == (docs[2].split("\n")[0], 5)
    assert got[31] == ("\n".join([docs[31].split("\n")[0], docs[31].split("\n")[-1]]), 9)


def test_line_dedup_odd_input(odd, none):
    got = lines.without_repeated_runs(odd)
    assert got.columns == [*odd.columns, "lines_removed"] and got.count() == odd.count()
    texts = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert {(4, None), (5, ""), (6, "  \n\t "), (9, ""), (2, ""), (12, "short text")} <= texts
    assert lines.without_repeated_runs(none).count() == 0


# 2: urls


def test_url_parts_and_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    given = ["http://A.Example.NET/en/x?q", "https://x.net/", "https://x.net", "https://notexample.net/en/", "example.com/de/", None, "", "ftp://u@h:1/p://q#f", "https://example.com/DE/"]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id int, url string"), rules=rules).collect()
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert rows == {
        0: ("a.example.net", "/en/x", "example.net/en/"), 1: ("x.net", "/", "net/"), 2: ("x.net", "", None), 3: ("notexample.net", "/en/", "net/"),
        4: ("", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("u@h:1", "/p://q", None), 8: ("example.com", "/DE/", None),
    }
    assert {r["verdict"] for r in got if r["page_id"] in (4, 5, 6)} == {"allow"}


def test_url_models_generalise(spark):
    """Urls without a rule are judged by their likeness to those with one."""
    draw = random.Random(4)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(8))
    good = [f"https://{word('abcde')}.org/fr/{word('abcde')}" for _ in range(150)]
    bad = [f"https://{word('vwxyz')}.net/{word('vwxyz')}" for _ in range(150)]
    new = [f"https://{word('abcde')}.com/{word('abcde')}" for _ in range(20)] + [f"https://{word('vwxyz')}.com/{word('vwxyz')}" for _ in range(20)]
    pages = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules=[("block", "net/"), ("allow", "org/fr/")]).collect()}
    right = [got[300 + k] == ("allow" if k < 20 else "block") for k in range(40)]
    assert sum(right) >= 38
    assert urls.allowed_urls(pages, rules=[]).count() == 340
    assert urls.judge_urls(pages.limit(0), rules=[("block", "net/")]).count() == 0


def test_url_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", 1.0, "g")], "page_id int, url string, host string, score double, gram string")
    got = urls.judge_urls(pages, rules=[("block", "net/")])
    assert got.columns == ["page_id", "url", "gram", "host", "path", "rule", "verdict", "score"]
    assert got.first()["host"] == "a.net"


# 3: language


def test_kneser_ney_matches_brute_force(spark):
    texts = {"xx": ["abracadabra abba", "cab"], "yy": ["yoyo zoo", "oz 12 zoo!"]}
    docs = spark.createDataFrame([(t, l) for l, ts in texts.items() for t in ts], "text string, lang string")
    model = language.fit(docs)
    pad = lambda t: "\x01\x01\x01" + "".join(c if c.isalpha() else "\x01" for c in t) + "\x01"
    squeeze = lambda t: t[:3] + "".join(c for k, c in enumerate(t[3:], 3) if c != "\x01" or t[k - 1] != "\x01" or k == 3)
    models = {l: brute.kneser_ney([squeeze(pad(t.lower())) for t in ts]) for l, ts in texts.items()}
    symbols = len(set().union(*(s for _, s in models.values()))) + 1
    for text in ("abba zoo", "q", "abracadabra"):
        row = language.entropies(spark.createDataFrame([(text,)], "text string"), model).first()
        seq = squeeze(pad(text))
        for k, name in enumerate(model.languages):
            want = -np.mean([np.log(models[name][0](seq[a : a + 4], symbols)) for a in range(len(seq) - 3)])
            assert row[language.ENTROPY][k] == pytest.approx(want, rel=1e-4)


def test_language_odd_input(odd, none):
    clash = odd.withColumns({c: F.lit("mine") for c in ("lang_pred", "entropy", "n_grams", "has_letter", "of", "gram")})
    model = language.fit(clash)
    got = language.identify(clash, model)
    assert got.columns == [c for c in clash.columns if c not in ("text", "score", "lang_pred")] + ["lang_pred", "score", "rejected"]
    got = got.collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["entropy"] == "mine"
        if r["doc_id"] in (4, 5, 6, 7):
            assert r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0
    empty = language.fit(none)
    assert empty.languages == []
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.of_known_language(none, model).count() == 0
    assert language.of_known_language(clash, model).columns == clash.columns


def test_language_tables_and_arrays_agree(spark):
    """What a task cannot hold is looked up by joins, to the same entropies; unseen n-grams back off on both ways."""
    draw = random.Random(26)
    text = lambda letters, n: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 7))) for _ in range(n))
    rows = [(text("abcdé", 40), "aa") for _ in range(20)] + [(text("cdefgh", 40), "bb") for _ in range(20)] + [(text("日本語文", 30), "cc")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    new = spark.createDataFrame([(i, t) for i, t in enumerate([text("abch", 30), text("xyzab", 20), text("語本é", 9), "", None, "a", "12 !"])], "i int, text string")
    whole = {r["i"]: r[language.ENTROPY] for r in language.entropies(new, model).collect()}
    assert len(whole) == 7 and all(len(h) == 3 for h in whole.values())
    for values in (0, 30, 300):
        part = language.entropies(new, model, head_values=values)
        assert part.columns == ["i", language.N_GRAMS, language.HAS_LETTER, language.ENTROPY]
        for r in part.collect():
            assert r[language.ENTROPY] == pytest.approx(whole[r["i"]], rel=1e-5)


def test_letters_beyond_the_basic_plane_stay_apart():
    keys = lambda t: language.ngram_keys(pa.array([t]))[0].tolist()
    gothic, deseret, small = "\U00010330", "\U00010400", "\U00010428"
    assert keys(deseret) == keys(small) and keys(gothic) != keys(small) and len(keys("ab" + gothic)) == len(keys("abcd"))
    shifted = chr(0x10330 + 0x1000)  # 4096 code points on, no letter of the same pair of units
    assert keys("a" + gothic) != keys("a" + shifted)
    grams, edges, letters = language.ngram_keys(pa.array(["x", gothic * 3, None, "yz"]))
    assert np.diff(edges).tolist() == [len(keys(t)) for t in ("x", gothic * 3, "", "yz")] and letters.tolist() == [True, True, False, True]
    assert grams[edges[3] :].tolist() == keys("yz")


def test_language_rejects_what_no_model_knows(spark):
    draw = random.Random(6)
    text = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(60))
    docs = spark.createDataFrame([(k, text("abcd"), "aa") for k in range(40)] + [(k, text("efgh"), "bb") for k in range(40, 80)], "doc_id int, text string, lang string")
    model = language.fit(docs)
    new = spark.createDataFrame([(1, text("abcd")), (2, text("efgh")), (3, text("wxyz"))], "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.identify(new, model).collect()}
    assert got[1] == ("aa", False) and got[2] == ("bb", False) and got[3][1]


def test_language_rejection_does_not_hang_on_the_alphabet(spark):
    """A few texts with thousands of letters in the corpus do not make room for unknown languages."""
    draw = random.Random(24)
    lexicon = lambda: ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    words = {"aa": lexicon(), "bb": lexicon()}
    text = lambda name: " ".join(draw.choice(words[name]) for _ in range(80))
    han = lambda: "".join(chr(draw.randrange(0x4E00, 0x4E00 + 5000)) for _ in range(2000))
    rows = [(text("aa"), "aa") for _ in range(40)] + [(text("bb"), "bb") for _ in range(40)] + [(han(), "zz") for _ in range(6)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    known = [(k, text(name)) for k, name in enumerate(["aa", "bb"] * 15)]
    strange = [(100 + k, " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(80))) for k in range(10)]
    got = language.identify(spark.createDataFrame(known + strange, "doc_id int, text string"), model).collect()
    assert {r["doc_id"] for r in got if r["rejected"]} == {i for i, _ in strange}


# 4: licences


def test_licences(spark, odd, none):
    draw = random.Random(7)
    kinds = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved."]
    names = ["mit", "apache", "all-rights-reserved"]
    docs = {i: "\n".join([sentence(draw, 30), kinds[i % 3] if i % 4 == 0 else sentence(draw, 9)]) for i in range(120)}
    frame = make(spark, docs.items()).select("doc_id", "text", "id")
    model = licences.fit(frame)
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["confirmed"]) for r in licences.scan(frame, model).collect()}
    assert got == {(i, 1): (names[i % 3], True) for i in docs if i % 4 == 0}
    odd_got = licences.scan(odd.select("doc_id", "text", "h"), licences.fit(odd)).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in odd_got] == [(13, 1, "all-rights-reserved")]
    assert licences.scan(none.select("doc_id", "text"), licences.fit(none)).count() == 0


# 5: packing


def test_plan_fills_exactly():
    draw = np.random.default_rng(1)
    for capacity in (16, 64, 257):
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = draw.integers(0, 30, capacity)
        plan = packing.plan_patterns(counts)
        used = np.zeros(capacity + 1, np.int64)
        for times, copies in plan:
            assert times > 0 and sum(length * n for length, n in copies) <= capacity
            for length, n in copies:
                used[length] += times * n
        assert (used == counts).all()
        assert sum(times for times, _ in plan) <= brute.first_fit_decreasing(counts, capacity)


def test_plan_reaches_the_lower_bound_where_small_pieces_abound():
    draw = np.random.default_rng(2)
    counts = np.bincount(np.minimum(draw.geometric(0.01, 5000), 512), minlength=513)
    total = int((counts * np.arange(513)).sum())
    assert sum(times for times, _ in packing.plan_patterns(counts)) == -(-total // 512)


def test_exact_fill_uses_what_is_there():
    left = np.zeros(21, np.int64)
    left[[5, 7]] = 1
    assert packing.exact_fill(left, 12) == [7, 5] and packing.exact_fill(left, 10) is None
    left[5] = 3
    assert packing.exact_fill(left, 10) == [5, 5] and packing.exact_fill(left, 15) == [5, 5, 5] and packing.exact_fill(left, 17) == [7, 5, 5]
    assert left[5] == 3


def test_packing_round_trip(odd, none):
    got = packing.pack_documents(odd, tokenizer=VOCABULARY, capacity=512).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = {}
    for row, ids in zip(rows := odd.collect(), coded([r["text"] for r in rows])):
        want.setdefault(row["doc_id"], []).extend((k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512)))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack_documents(none, tokenizer=VOCABULARY).count() == 0


def test_packing_refuses_impossible_lengths(spark):
    with pytest.raises(Exception, match="lengths must lie"):
        packing.best_fit_pack(spark.createDataFrame([(9,)], "length int"), capacity=8)


# 6: Jaccard


def near_copies(draw, groups=12, copies=6):
    docs, i = {}, 0
    for _ in range(groups):
        base = sentence(draw, draw.choice([4, 40, 120])).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randrange(3)):
                own[draw.randrange(len(own))] = f"z{draw.randrange(10**6)}"
            docs[i] = " ".join(own)
            i += 1
    return docs


def test_band_choice():
    bands, rows = jaccard.choose_bands(0.8, 0.9995, 384)
    assert bands * rows <= 384 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    docs = near_copies(random.Random(8))
    got = jaccard.jaccard_classes(make(spark, docs.items())).collect()
    assert {r["doc_id"]: (r["class_id"], r["text_class"], r["n_links"]) for r in got} == brute.jaccard_classes(docs)


def test_one_of_each(spark, odd, none):
    docs = near_copies(random.Random(9))
    kept = {r["doc_id"] for r in jaccard.one_of_each(make(spark, docs.items())).collect()}
    assert kept == {c for c, _, _ in brute.jaccard_classes(docs).values()}
    rows = Counter(r["doc_id"] for r in jaccard.one_of_each(odd).collect())
    # 4-7 and a null one have no words; 1 stands for its copies, 8 for 9; 12 twice are two texts
    assert rows == Counter({1: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2, 8: 1, 10: 1, 11: 1, 12: 2})
    assert jaccard.one_of_each(odd).columns == odd.columns
    assert jaccard.one_of_each(none).count() == 0


def test_repeated_rows_leave_one(spark):
    assert jaccard.one_of_each(make(spark, [(None, "one two three")] * 3 + [(None, None)] * 2)).count() == 3


# 7: decontamination


@pytest.mark.parametrize(("window", "slop", "per_pass"), [(10, 0, 200_000), (4, 0, 5), (3, 1, 200_000), (4, 2, 7)])
def test_contamination_matches_brute_force(spark, monkeypatch, window, slop, per_pass):
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_PASS", per_pass)
    draw = random.Random(10)
    items = [(k, sentence(draw, draw.choice([2, 6, 14, 30]), 40)) for k in range(8)] + [(8, None), (9, "?!"), (None, sentence(draw, 12, 40)), (3, sentence(draw, 12, 40))]
    docs = {}
    for i in range(50):
        out = sentence(draw, draw.randrange(1, 40), 40)
        if draw.random() < 0.5:
            passage = (draw.choice(items)[1] or "").split()
            out += " " + " ".join(passage[draw.randrange(3) :]).upper()
        docs[i] = out
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontaminate.contamination(make(spark, docs.items()), bench, window=window, slop=slop).collect()
    want = brute.contamination(docs, items, window, slop)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    assert any(n for _, n, _ in want.values())


def test_decontamination_odd_input(spark, odd, none):
    bench = spark.createDataFrame([(1, "short text"), (2, None)], "item_id int, text string")
    got = decontaminate.without_benchmark_text(odd, bench)
    assert got.columns == odd.columns and got.count() == odd.count() - 1
    assert decontaminate.without_benchmark_text(none, bench).count() == 0
    assert decontaminate.without_benchmark_text(odd, bench.limit(0)).count() == odd.count()


# 8: toxicity


def test_toxicity_learns_from_positives_and_unlabelled(spark, odd, none):
    draw = random.Random(11)
    docs, labels = {}, []
    for i in range(900):
        toxic = i % 6 == 0
        docs[i] = " ".join([sentence(draw, 40), draw.choice(["scum", "vile"]) if toxic else "", sentence(draw, 10)])
        if draw.random() < 0.5:
            labels.append((i, int(toxic)))
    frame, known = make(spark, docs.items()).drop("score"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame.where("doc_id % 3 <> 1"), known.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    held = [i for i in docs if i % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 6 == 0) for i in held)
    assert right / len(held) >= 0.98
    scores = [r["score"] for r in toxicity.score(odd.drop("score"), model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    nothing = toxicity.fit(none, known.limit(0))
    assert {r["score"] for r in toxicity.score(odd.drop("score"), nothing).collect()} == {0.5}


def test_risk_does_not_fall_below_zero():
    """With unlabelled text that holds all the positives, the weight of their word stays finite and positive."""
    p, u = np.ones((50, 1), np.float32), np.zeros((500, 1), np.float32)
    u[:50] = 1
    weights, bias = toxicity.nnpu_fit(p, u, 0.1)
    assert 0 < weights[0] < 50 and bias < 0


# 9: token store


def test_minimal_perfect_hash():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000):
        keys = np.unique(draw.integers(-(1 << 62), 1 << 62, n))
        index = token_store.build_index(keys, np.arange(len(keys)))
        assert len(index[1]) == len(keys)
        assert token_store.find(keys, *index).tolist() == list(range(len(keys)))
        assert (token_store.find(keys + 1, *index) >= 0).sum() <= 1


def test_token_store_round_trip(spark, odd, none, monkeypatch):
    path = scratch_path(spark, "store")
    token_store.write_token_store(odd, path, tokenizer=VOCABULARY)
    got = [(r["start"], r["key"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_digests(spark, path).collect()]
    rows = odd.collect()
    ids = coded([r["text"] for r in rows])
    assert sorted((k, n, c) for _, k, n, c in got if k is not None) == sorted((r["doc_id"], len(i), zlib.crc32(i.tobytes())) for r, i in zip(rows, ids) if r["doc_id"] is not None)
    end, last = 0, None
    for start, key, n, _ in sorted(got, key=lambda g: g[0]):
        assert start == end and (last is None or key >= last)
        end, last = start + n, key
    found = sorted((r["key"], tuple(r["ids"])) for r in token_store.lookup(spark, path, [1, 12, 999]).collect())
    assert found == sorted((r["doc_id"], tuple(i.tolist())) for r, i in zip(rows, ids) if r["doc_id"] in (1, 12))
    empty = scratch_path(spark, "store")
    token_store.write_token_store(none, empty, tokenizer=VOCABULARY)
    assert token_store.read_digests(spark, empty).count() == 0 and token_store.lookup(spark, empty, [1]).count() == 0


def test_lookup_reads_the_named_blocks_only(spark, monkeypatch):
    """Small blocks and buckets: the directory names the block of each key, a key spread over blocks all of its blocks."""
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 300)
    monkeypatch.setattr(token_store, "BUCKET_KEYS", 9)
    draw = random.Random(27)
    rows = [(draw.choice([7 * i, -i]), sentence(draw, 30)) for i in range(1, 150)] + [(500, sentence(draw, 30)) for _ in range(60)]
    path = scratch_path(spark, "store")
    token_store.write_token_store(make(spark, rows), path, tokenizer=VOCABULARY)
    blocks = token_store._blocks(spark, path)
    number = {(r["shard"] << 32) + r["block"]: (r["min_key"], r["max_key"]) for r in blocks.select("shard", "block", "min_key", "max_key").collect()}
    assert len(number) > 100
    every = sorted({k for k, _ in rows})
    directory = spark.read.parquet(f"{path}/directory")
    assert directory.count() > 8
    slots = [len(r["fingerprints"]) // 4 for r in directory.collect()]
    assert sum(slots) == len(every)
    got = {r["key"]: (r["first"], r["last"]) for r in token_store.places(spark, path, every).collect()}
    for k in every:
        held = [n for n, (low, high) in number.items() if low <= k <= high]
        assert got[k] == (min(held), max(held))
    for keys in ([every[0], every[-1]], [500], [every[3]], [123456], []):
        held = [n for n, (low, high) in number.items() if any(low <= k <= high for k in keys if k in every)]
        assert token_store.blocks_with(spark, path, keys).count() in (len(held), len(held) + (keys == [123456]))
        found = Counter((r["key"], tuple(r["ids"])) for r in token_store.lookup(spark, path, keys).collect())
        asked = [(k, t) for k, t in rows if k in keys]
        assert found == Counter((k, tuple(i.tolist())) for (k, _), i in zip(asked, coded([t for _, t in asked]) if asked else []))
    monkeypatch.setattr(token_store, "STRETCHES", 3)
    found = Counter(r["key"] for r in token_store.lookup(spark, path, every[::9]).collect())
    assert found == Counter(k for k, _ in rows if k in every[::9])


# 10: exact duplicates


def test_exact_duplicates_match_brute_force(spark, odd, none):
    draw = random.Random(12)
    base = [sentence(draw, 90) for _ in range(6)] + ["", " ", "a b", "ab"]
    docs = {i: draw.choice(base) for i in range(70)}
    docs |= {i + 100: t.replace(" ", "\t ") for i, t in list(docs.items())[:20]}
    docs |= {200: base[0][:-1] + "y", 201: None, 202: "\x0b"}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(make(spark, docs.items())).collect()}
    assert got == brute.exact_groups(list(docs.items()))
    rows = exact.exact_duplicates(odd, carry=["h", "length"]).collect()
    assert len(rows) == odd.count() and rows[0]["length"] == 7
    groups = Counter(r["group_size"] for r in rows)
    # 1, 2, 2 and the null id; 4, 5, 6 and a null one; 8 and 9
    assert groups == Counter({4: 8, 2: 2, 1: odd.count() - 10})
    assert sum(r["kept"] for r in rows) == groups[1] + 3
    assert exact.exact_duplicates(none).count() == 0
