"""The pipeline's stages against brute force on planted cases."""

import random
import zlib

import numpy as np
from test_operators import coded

import brute
import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_drop_what_is_planted_and_nothing_else(spark, tmp_path):
    draw = random.Random(20)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(3, 8)))
    text = lambda letters, lines: "\n".join(" ".join(word(letters) for _ in range(70)) for _ in range(lines))
    docs = {i: (text("abcdefgh", 3), "aa") if i % 2 else (text("mnopqrst", 3), "bb") for i in range(24)}
    item = " ".join(word("abcdefgh") for _ in range(14))
    changed = docs[1][0].split(" ")
    for k in (10, 100, 180):
        changed[k] = "abc"
    passage = docs[3][0].split("\n")[1]
    docs |= {
        100: ("123 !!!", "aa"), 101: (" ".join(changed), None), 102: (text("abcdefgh", 1) + " " + item + "\n" + text("abcdefgh", 1), "aa"),
        103: docs[2], 104: (None, "bb"), 105: ("\n".join([text("mnopqrst", 1), passage, text("mnopqrst", 1)]), "bb"),
    }
    rows = [(i, t, lang, "s", len(t) if t else None) for i, (t, lang) in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, (t, _) in docs.items()}
    want = []
    kept = {i: t for i, t in kept.items() if t and any(c.isalpha() for c in t)}
    want.append(dict(kept))
    cut = brute.line_dedup(kept)
    kept = {i: t for i, (t, n) in cut.items() if not n or t.strip()}
    want.append(dict(kept))
    kept = {i: t for i, t in kept.items() if brute.jaccard_classes(kept)[i][0] == i}
    want.append(dict(kept))
    kept = {i: t for i, t in kept.items() if not brute.contamination({i: t}, [(1, item)])[i][1]}
    want.append(dict(kept))
    assert [len(w) for w in want] == [28, 27, 26, 25] and 105 in kept and passage not in kept[105]
    for number, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, want)):
        path = f"{tmp_path}/stage{number}"
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = frame.collect()
        assert {r["doc_id"]: r["text"] for r in got} == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in got), name
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    ids = dict(zip(kept, coded(kept.values())))
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packed} == {i: (len(c), zlib.crc32(np.asarray(c).tobytes())) for i, c in ids.items()}
    assert len({r["sequence_id"] for r in packed}) == -(-sum(map(len, ids.values())) // 4096)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
