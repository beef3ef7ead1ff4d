import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tillkit.llm import language_mix, license_scan, quality_knn
from tillkit.llm.common import read

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = language_mix.identify(read(spark, SF, "documents")).select(
        "doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_mixture_and_odd_rows(spark, frame):
    docs = read(spark, SF, "documents")
    model = language_mix.learn(docs)
    by_lang = {r.lang: r.text for r in docs.where("length(text) between 3000 and 5000").collect()}
    both = by_lang["en"] + "\n" + by_lang["fr"] + "\n" + by_lang["fr"]
    odd = [(1, None), (2, ""), (3, "123 %%% 4"), (4, both), (5, by_lang["de"] * 200), (None, by_lang["es"])]
    got = {r.doc_id: r for r in language_mix.predict(
        frame(odd + odd[:1], "doc_id long, text string", {"score": "mine"}), model).collect()}
    assert all((got[i].lang_pred, got[i]["_score"], got[i].langs) == ("und", 0.0, []) for i in (1, 2, 3))
    assert got[4].langs[0] == "fr" and set(got[4].langs) == {"en", "fr"} and 0.5 < got[4]["_score"] < 0.8
    assert got[5].lang_pred == "de" and got[None].lang_pred == "es" and got[1].score == "mine"


def test_language_of_empty_tables(frame):
    none = frame([], "doc_id long, text string, lang string")
    assert language_mix.identify(none).collect() == []
    alone = frame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_mix.identify(alone).first().lang_pred == "und"


def test_em_is_a_maximum():
    rng = np.random.default_rng(1)
    shares, weight = rng.dirichlet(np.ones(50), 3).T, rng.integers(1, 9, 50).astype(float)
    like, pi = language_mix.proportions(weight, shares)
    for _ in range(200):
        other = rng.dirichlet(np.ones(3))
        assert weight @ np.log(shares @ other) <= like + 0.5
    assert abs(pi.sum() - 1) < 1e-9


def test_quality_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = quality_knn.learn(docs, labels.where(language_mix.fold() != 0))
    got = {r.doc_id: r for r in quality_knn.score(docs, model).select("doc_id", "score", "predicted").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in labels.where(language_mix.fold() == 0).collect()]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(7)
    latent = rng.normal(size=(60, 5))
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    model = {"latent": latent, "y": rng.integers(0, 2, 60).astype(float), "prior": 0.4}
    x = np.vstack([rng.normal(size=(20, 5)), np.zeros((1, 5))])
    got = quality_knn.vote(x, model)
    for v, g in zip(x[:-1], got):
        cos = sorted(((float(latent[j] @ v / np.linalg.norm(v)), j) for j in range(60)), reverse=True)[:25]
        w = [max(c, 0) ** quality_knn.SHARPNESS for c, _ in cos]
        assert abs(g - sum(a * model["y"][j] for a, (_, j) in zip(w, cos)) / sum(w)) < 1e-9
    assert got[-1] == 0.4


def test_quality_of_odd_rows(frame):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "good plain words here", "## !! ##", "a b " * 20000])]
    docs = frame(rows + rows[:1] + [(None, "x")], "doc_id long, text string", {"score": "s", "id": 1, "label": 2})
    labels = frame([(3, 1), (3, 1), (4, 0), (4, None), (77, 1), (None, 0)], "doc_id long, quality int")
    got = quality_knn.score(docs, quality_knn.learn(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r["_score"] <= 1 and r.score == "s" for r in got)
    none = frame([], "doc_id long, quality int")
    assert {r["_score"] for r in quality_knn.score(docs, quality_knn.learn(docs, none)).collect()} == {0.5}
    empty = frame([], "doc_id long, text string")
    assert quality_knn.score(empty, quality_knn.learn(empty, none)).collect() == []


def test_license_scan(frame):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("/a/LICENSE", mit), ("/a/b/x.txt", "plain text"), ("/a/b/c/COPYING.md", "intro\n" + apache),
             ("/a/b/c/d/y.txt", "more\ntext"), ("/a/z.txt", "released under the mit license"),
             ("/q/x.txt", "the licence of my dog is lost"), (None, mit), (None, None), ("/a/n.txt", None),
             ("/a/n.txt", None), ("/ab/x.txt", "near by name only"), ("", ""), ("/a/b/long.txt", "w " * 50000)]
    got = license_scan.scan(frame(files, "path string, text string", {"license": "own", "p": 1, "dir": 2}))
    found = {(r.path, r.text): (r["_license"], r.via, r.license_path) for r in got.collect()}
    assert got.count() == len(files) and {r.license for r in got.collect()} == {"own"}
    assert found[files[0]] == ("MIT", "header", "/a/LICENSE")
    assert found[files[1]] == ("MIT", "inherited", "/a/LICENSE")
    assert found[files[2]] == ("Apache-2.0", "header", "/a/b/c/COPYING.md")
    assert found[files[3]] == ("Apache-2.0", "inherited", "/a/b/c/COPYING.md")
    assert found[files[4]] == ("MIT", "header", "/a/z.txt")
    assert found[files[5]] == found[files[7]] == found[files[10]] == found[files[11]] == (None, None, None)
    assert found[files[6]] == ("MIT", "header", None)
    assert found[files[8]] == found[files[12]] == ("MIT", "inherited", "/a/LICENSE")
    assert license_scan.scan(frame([], "path string, text string")).collect() == []


def test_license_blocks_and_texts(frame):
    from tillkit.llm.license_notices import TEXTS, notices

    mit = next(t for n, t in notices() if n == "MIT" and "NONINFRINGEMENT" in t)
    bsd2 = next(t for n, t in notices() if n == "BSD-2-Clause" and "DISCLAIMED" in t)
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was",
           "not distributed with this file, You can obtain one at", "https://mozilla.org/MPL/2.0/."]
    gpl2 = next(t for n, t in notices() if n == "GPL-2.0" and "MERCHANTABILITY" in t).split("\n")
    files = {
        "/a.py": ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os\n"),
        "/b.c": ("MIT", "// SPDX-License-Identifier: MIT\nint x;\n"),
        "/c.js": ("MPL-2.0", "/* " + "\n * ".join(mpl) + " */\nlet x = 1;\n"),
        "/d.c": ("GPL-2.0", "int y;\n/*\n" + "\n".join(gpl2) + "\n*/\nint z;"),
        "/e.txt": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification,"),
        "/f.sh": ("MIT", "#!/bin/sh\n\n# Copyright (c) 2020 A. Body\n#\n" + "".join(f"# {x}\n" for x in mit.split("\n"))),
        "/g.txt": ("BSD-2-Clause", "Notes\n\n" + bsd2 + "\n\nmore words of another kind"),
        "/h.c": (None, "// SPDX-License-Identifier: Zlib\n"), "/i.c": (None, "/* open comment\n// of the\n\n\n" * 50),
        "/j.c": (None, "# the of and to\n" * 3000 + "the source code of this program is in the files"),
    }
    files |= {f"/{p.stem}/LICENSE": (p.stem, p.read_text()) for p in TEXTS.glob("*.txt")}
    files |= {f"/{p.stem}/x.c": (p.stem, "int x;") for p in TEXTS.glob("*.txt")}
    got = {r.path: r.license for r in license_scan.scan(
        frame([(k, t) for k, (_, t) in files.items()], "path string, text string", {"h1": 1, "words": 2})).collect()}
    assert got == {k: name for k, (name, _) in files.items()}


def test_license_plan_has_no_python(spark):
    from tillkit.llm.queries import PLANS

    random.seed(0)
    plan = PLANS["op2_license_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert F.col("x") is not None
