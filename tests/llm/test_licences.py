"""The licence scan on notices as files carry them, and against a plain version."""

import random
import re

import numpy as np
import pytest
from conftest import make, sentence
from pyspark.sql import functions as F

from pulsegrid.llm import licences

# Notices as they stand at the head of files, wrapped over lines.
WRAPPED = {
    "gpl": """/*
 * tool.c - reads a table
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
import os""",
    "apache": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
package main""",
    "mpl": """; This Source Code Form is subject to the terms of the Mozilla
; Public License, v. 2.0.
(define x 1)""",
    "lesser": """# This library is free software; you can redistribute it and/or modify it
# under the terms of the GNU Lesser General Public License as published by
# the Free Software Foundation; either version 2.1 of the License, or (at
# your option) any later version.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
}


def plain_paragraphs(text):
    """First line, number of lines and words of each paragraph, line by line."""
    lines = [(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", line), line) for line in (text or "").split("\n")]
    full = [k for k, (words, _) in enumerate(lines) if words]
    spaced = any(b - a > 1 for a, b in zip(full, full[1:]))
    comment = lambda line: line.lstrip(" \t\r")[0] in "#/*;%<!>|-"
    ends = lambda words, line: words[-1][-1] in "。！？" or any(c in ".!?" for c in line[line.rindex(words[-1]) + len(words[-1]) :])
    out = []
    for k in full:
        words, line = lines[k]
        joined = out and k - 1 in full and comment(line) == comment(lines[k - 1][1])
        joined = joined and max(len(line), len(lines[k - 1][1])) <= 120
        if joined and (spaced or comment(line) or not ends(*lines[k - 1])):
            out[-1][1] += 1
            out[-1][2] += words
        else:
            out.append([k, 1, list(words)])
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    return [(k, n, [lower(w) for w in words]) for k, n, words in out]


def grams(words, sizes=(1, 2, 3)):
    return {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def plain_scan(text, model, templates, confirm=0.6):
    """Paragraphs, families, probabilities and similarities by sets of n-grams and one sum per paragraph."""
    at = {int(h): k for k, h in enumerate(model.features)}
    families = sorted(templates)
    for first, n, words in plain_paragraphs(text):
        here = grams(words)
        columns = [at[h] for h in {int(licences._of_texts([" ".join(g)])[0][-1]) for g in here} if h in at]
        if not columns:
            continue
        z = model.weights[columns].sum(axis=0) + model.bias
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if share[-1] >= 0.5:
            continue
        best = int(share[:-1].argmax())
        alike = named = 0.0
        has_name = False
        for phrase in templates[families[best]]:
            split = lambda t: re.findall(r"[0-9a-z]+", t.lower())
            pairs = grams(split(phrase.replace("[", " ").replace("]", " ")), (2,))
            value = len(pairs & here) / max(len(pairs), 1)
            held = all(grams(w, (min(len(w), 3),)) <= here for w in map(split, re.findall(r"\[(.*?)\]", phrase)))
            alike, named, has_name = max(alike, value), max(named, value * held), has_name or held
        sure = bool(share[best] >= model.least and has_name)
        yield first, n, families[best] if sure else licences.UNKNOWN, share[best], alike, sure and named >= confirm


def corpus(draw, n=100):
    docs = {i: "\n".join(sentence(draw, 9).capitalize() + "." for _ in range(4)) for i in range(n)}
    return docs | {n + k: text for k, text in enumerate(WRAPPED.values())}


def test_wrapped_notices(spark):
    frame = make(spark, corpus(random.Random(3)).items()).select("doc_id", "text")
    model = licences.fit(frame)
    got = licences.scan(frame, model).collect()
    found = {}
    for r in got:
        assert r["doc_id"] >= 100, r
        found.setdefault(list(WRAPPED)[r["doc_id"] - 100], []).append((r["paragraph"], r["n_lines"], r["family"], r["confirmed"]))
    assert found == {
        "gpl": [(3, 4, "gpl", True)], "mit": [(0, 6, "mit", True)], "bsd": [(0, 3, "bsd", True)], "apache": [(0, 3, "apache", True)],
        "mpl": [(0, 2, "mpl", True)], "lesser": [(0, 4, "unknown", False)], "isc": [(0, 1, "unknown", False)],
    }


def test_a_licence_without_template_is_unknown(spark):
    frame = make(spark, corpus(random.Random(4)).items()).select("doc_id", "text")
    for left_out in ("mpl", "gpl", "apache"):
        model = licences.fit(frame, templates={f: t for f, t in licences.TEMPLATES.items() if f != left_out})
        got = {(list(WRAPPED)[r["doc_id"] - 100], r["family"], r["confirmed"]) for r in licences.scan(frame, model).collect()}
        want = {(f, f, True) for f in ("gpl", "mit", "bsd", "apache", "mpl") if f != left_out}
        assert {g for g in got if g[0] not in ("lesser", "isc")} == want | {(left_out, "unknown", False)}


def test_paragraphs_match_a_plain_version():
    draw = random.Random(5)
    parts = ["a b", "# c", " * d.", "e.", "f!***", "", "  ", "***", "\t// g", "日。", "é", "x.y z", "- h", "i;\r", "é" * 120, "j" * 121, "日 " * 59]
    import pyarrow as pa

    for _ in range(300):
        texts = ["\n".join(draw.choice(parts) for _ in range(draw.randrange(9))) if draw.random() < 0.9 else None for _ in range(4)]
        h, bounds, row, number, lines = licences._paragraphs(pa.record_batch([pa.array(texts, pa.string())], names=["t"]), 0)
        want = [(i, k, n, len(words)) for i, t in enumerate(texts) for k, n, words in plain_paragraphs(t)]
        assert list(zip(row.tolist(), number.tolist(), lines.tolist(), np.diff(bounds).tolist())) == want


def test_scan_matches_a_plain_version(spark):
    draw = random.Random(6)
    docs = corpus(draw, 30)
    known = [re.sub(r"[\[\]]", "", p) for phrases in licences.TEMPLATES.values() for p in phrases]
    for i in range(60):
        words = draw.choice(known).split()
        cut = [w for w in words if draw.random() < draw.choice([1, 0.8, 0.5])]
        docs[1000 + i] = "\n".join([sentence(draw, 5) + ".", " ".join(cut[: len(cut) // 2]), " ".join(cut[len(cut) // 2 :]), sentence(draw, 4)])
    frame = make(spark, docs.items()).select("doc_id", "text")
    model = licences.fit(frame)
    got = {(r["doc_id"], r["paragraph"]): r for r in licences.scan(frame, model).collect()}
    want = {(i, first): rest for i, t in docs.items() for first, *rest in plain_scan(t, model, licences.TEMPLATES)}
    assert got.keys() == want.keys() and len(got) > 40
    for key, (n, family, probability, alike, confirmed) in want.items():
        r = got[key]
        assert (r["n_lines"], r["family"], r["confirmed"]) == (n, family, confirmed), key
        assert r["probability"] == pytest.approx(probability) and r["similarity"] == pytest.approx(alike)


def test_limit_counts_all_paragraphs(spark):
    """The limit is the quantile of all paragraphs unlike a template, of which the sample of the fit is a part."""
    draw = random.Random(8)
    words = "the software license shall be copy of this work without any permission is under to".split()
    docs = {i: " ".join(draw.choice(words) for _ in range(8)) for i in range(3000)}
    frame = make(spark, docs.items()).select("doc_id", "text").repartition(5)
    model = licences.fit(frame, max_other=50)
    other = []
    for text in docs.values():
        h, row, _ = licences._of_texts([text])
        if model.templates.similarity(h, row, 1)[0].max() < 0.3:
            share = model.shares(h, row)[1]
            other.append(share[0, :-1].max() if len(share) else 0.0)
    assert len(other) > 1000
    assert sum(p > model.least for p in other) <= 0.001 * len(other)
    assert model.least == 0.5 or sum(p > model.least - 1 / licences.STEPS for p in other) > 0.001 * len(other)


def test_clashing_columns_are_replaced(spark, odd, none):
    clash = odd.withColumns({c: F.lit("mine") for c in ("family", "paragraph", "confirmed", "h", "grams", "__text")})
    got = licences.scan(clash, licences.fit(clash))
    assert got.columns == [c for c in clash.columns if c not in ("text", *licences.OUTPUT)] + licences.OUTPUT
    assert [(r["doc_id"], r["paragraph"], r["family"], r["h"]) for r in got.collect()] == [(13, 1, "all-rights-reserved", "mine")]
    assert licences.scan(none, licences.fit(none)).count() == 0
    assert licences.scan(odd.where("doc_id = 13"), licences.fit(none)).count() <= 1
