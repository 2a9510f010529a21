import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tunesmith.llm import catalog, language, licenses, quality, toxicity


def held_out_accuracy(spark, name, label):
    found = catalog.QUERIES[name](spark, SF01)
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or score is null").count() == 0
    m = found.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (m.predicted == m[label]).mean(), m


def test_quality_held_out(spark):
    accuracy, m = held_out_accuracy(spark, "op2_quality_classifier", "quality")
    assert accuracy >= 0.95 and (m[m.quality == 1].predicted == 1).mean() >= 0.98


def test_toxicity_held_out(spark):
    accuracy, m = held_out_accuracy(spark, "op3_toxicity", "toxic")
    assert accuracy >= 0.93 and (m[m.toxic == 0].predicted == 0).mean() >= 0.98


@pytest.fixture(scope="module")
def insults(spark):
    """A toxicity model from a small fixture: clean sentences, some with an insult."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, 30))
        if i % 2:
            text[int(rng.integers(30))] = ["pathetic", "worthless", "scumbag"][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", lambda c: F.lit(True)), words


@pytest.mark.parametrize("insult", ["pathetic", "Pathetic!!", "pat-het-ic", "p a t h e t i c", "pathxetic", "worrthless", "páthetic", "worthlessly"])
def test_toxicity_tolerates_gaps_and_inserted_characters(insults, insult):
    model, words = insults
    text = " ".join(words[:25]) + f". {insult} " + " ".join(words[25:50])
    margins, _ = toxicity.Scorer(model)([text, " ".join(words[:50])])
    bad, clean = model.probability(np.array(margins))
    assert bad > 0.5 > clean


def test_kernel_is_a_sum_over_common_subsequences():
    def brute(s, t):
        def weights(x):
            out = {}
            for c in itertools.combinations(range(len(x)), 3):
                if c[2] - c[0] < toxicity.SPAN:
                    out[x[c[0]] + x[c[1]] + x[c[2]]] = out.get(x[c[0]] + x[c[1]] + x[c[2]], 0) + toxicity.DECAY ** (c[2] - c[0] - 2)
            return out
        a, b = weights(s), weights(t)
        return sum(v * b.get(k, 0) for k, v in a.items()) / (toxicity.NORM[len(s)] * toxicity.NORM[len(t)])

    items = ["pathetic", "pathxetic", "banana", "abcdefghijklmnop", "abc"]
    got = toxicity.kernel(items, items)
    assert np.allclose(got, [[brute(a, b) for b in items] for a in items], atol=1e-5)


def test_scores_do_not_depend_on_what_is_remembered(insults):
    model, words = insults
    texts = [" ".join(words[i:i + 20]) for i in range(0, 200, 10)]
    assert toxicity.Scorer(model, remembered=5)(texts) == toxicity.Scorer(model)(texts)


def test_word_hashes_of_a_long_text_equal_those_of_its_words():
    extract = quality.Extractor()
    words = ["Alpha", "beta,", "beta,", "ÄÖ", "x1"]
    joined = extract([" ".join(words)])
    single = [extract([w]) for w in words]
    for family in (0, 2):
        assert joined[family][0].tolist() == [s[family][0][0] for s in single]
    assert [len(f[0]) for f in joined] == [5, 4, 5, 4]


def labels_for(spark, label):
    return spark.createDataFrame([(1, 1), (2, 1), (5, 0), (6, 0), (7, 0), (None, 1), (9, None)], f"doc_id long, {label} int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows_get_a_score(spark, edge, empty, module, label):
    everything = lambda c: F.lit(True)
    labels = labels_for(spark, label)
    for docs, known in ((edge, labels), (edge, labels.where(f"{label} = 1")), (edge, labels.limit(0)), (empty, labels)):
        model = module.fit(docs, known, label, everything)
        scores = [r.score for r in module.score(edge, model).collect()]
        assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
        assert module.score(empty, model).count() == 0


def test_toxicity_filter_keeps_columns(edge, empty):
    model = toxicity.ToxicityModel()
    kept = toxicity.keep_clean(edge, model, 0.5)
    assert kept.columns == edge.columns and kept.count() == 11
    assert toxicity.keep_clean(empty, model, 0.5).count() == 0


def test_labels_held_out_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad BAD!! bad") for i in range(40)], "doc_id long, text string")
    wrong = spark.createDataFrame([(i, (i % 2) if i < 30 else 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, wrong, "quality", lambda c: c < 30)
    assert [round(r.score) for r in quality.score(docs, model).orderBy("doc_id").collect()] == [i % 2 for i in range(40)]


# language

def test_language_of_pages(spark):
    found = catalog.QUERIES["op5_language_id"](spark, SF01).toPandas()
    assert (found.language == found.declared).mean() > 0.99 and found.accepted.mean() > 0.99


def test_evidence_beyond_the_text(spark):
    """A text that fits two languages takes the declared one, its suffix's, or its host's."""
    english, german = "the house and the garden of the king ", "das haus und der garten vom kaiser "
    docs = spark.createDataFrame([(i, english * 3, "en") for i in range(20)] + [(100 + i, german * 3, "de") for i in range(20)],
                                 "doc_id long, text string, lang string")
    model = language.fit(docs)
    rows = [(i, english * 2, "www.one.com", "en") for i in range(30)] + [(100 + i, german * 2, "www.zwei.de", "de") for i in range(30)]
    rows += [(200, "ok", "www.zwei.de", None), (201, "ok", "www.one.com", None), (202, "ok", None, "de"), (203, "ok", "neu.drei.de", None),
             (204, "12 345", "www.zwei.de", "de"), (205, None, None, None)]
    found = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, host string, declared string"), model).collect()}
    assert [found[i].language for i in (0, 100, 200, 201, 202, 203, 204, 205)] == ["en", "de", "de", "en", "de", "de", "und", "und"]
    assert not found[204].accepted and not found[205].accepted and found[0].accepted


def test_language_edge_rows(edge, empty):
    for model in (language.fit(edge), language.fit(empty)):
        got = language.identify(language.labelled_documents(edge), model).collect()
        assert len(got) == 11 and {r.language for r in got if r.id in (3, 4, 5)} == {"und"}
        assert language.identify(language.labelled_documents(empty), model).count() == 0


def test_markup(spark):
    df = spark.createDataFrame([(1, "https://u:p@WWW.Example.de:80/x?y", '<HTML data-x="1" lang="de-AT"><p>a &amp; b</p><script>var x="</p>"</script><!-- c -->'),
                                (2, "not a url", None), (3, None, "<html><body lang='fr'>x</body></html>")], "page_id long, url string, html string")
    got = {r.id: (r.host, r.declared) for r in language.pages(df).collect()}
    assert got == {1: ("www.example.de", "de"), 2: (None, None), 3: (None, None)}
    assert language.visible_text("<p>a &amp; b</p><script>x</script><!-- c --><style>y</style>").split() == ["a", "&", "b"]


# licences

def scan(spark, rows):
    return {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}


def test_licences_and_inheritance(spark):
    prose = "some ordinary words of a file that say nothing about it\n" * 5
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
                         "and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        (2, "a/b/c/x.py", prose),
        (3, "a/b/own.py", "# Licensed under the Apache License, Version 2.0.\n" + prose),
        (4, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3.\n" + prose),
        (5, "a/b/d/e/y.py", prose), (6, "z/w.py", prose), (7, "top.py", ""), (8, None, prose), (9, "a/null.py", None),
    ]
    got = scan(spark, rows)
    assert (got["a/b/c/x.py"].license, got["a/b/c/x.py"].origin, got["a/b/c/x.py"].levels_up, got["a/b/c/x.py"].licence_path) == ("MIT", "inherited", 2, "a/LICENSE")
    assert (got["a/b/own.py"].license, got["a/b/own.py"].origin) == ("Apache-2.0", "own")
    assert (got["a/b/d/e/y.py"].license, got["a/b/d/e/y.py"].levels_up) == ("GPL-3.0", 1)
    assert got["z/w.py"].license is None and got["top.py"].origin == "none" and got[None].origin == "none"
    assert got["a/null.py"].license == "MIT" and got["a/null.py"].levels_up == 0
    assert licenses.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def plain_notices(t, line, least):
    """Every stretch as long as a template, and the whole line, by dictionaries; overlaps resolved by cosine."""
    words = licenses.tokens(line)
    idf = {w: t.idf[t.terms.index(w)] if w in t.terms else t.rest for w in words}
    found = []
    spans = [(0, len(words), None)] + [(i, i + m, j) for j, m in enumerate(t.sizes) for i in range(len(words) - m + 1)]
    for a, b, own in spans:
        vector = {w: words[a:b].count(w) * idf[w] for w in words[a:b]}
        norm = np.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(vector.get(w, 0) * t.vectors[k, i] for i, w in enumerate(t.terms)) / norm for k in range(len(t.names))]
        k = int(np.argmax(cosines))
        bar = least if own is None else licenses.STRETCH if b - a >= 5 else licenses.SHORT_STRETCH
        if cosines[k] >= bar and (own is None or cosines[own] >= bar):
            found.append((-round(cosines[k], 12), k, a, b))
    kept, taken = [], set()
    for cosine, k, a, b in sorted(found):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            kept.append((a, k, -cosine, b - a))
    return sorted(kept)


@pytest.mark.parametrize("line", [
    "This code is Licensed under the Apache License, Version 2.0 by somebody",
    "some words before it and some more words here and there Released under the MIT License and words after it too",
    "Copyright 2020 the authors. All rights reserved. Use of this source code is governed by a BSD-style license found below",
    "the of and the in a is the under license with rights the reserved by all of the"])
def test_notice_cosines_against_brute_force(line):
    t = licenses.Templates(licenses.TEMPLATES)
    t.weigh(100, {i: i % 7 for i in range(len(t.terms))})
    got = [(k, cosine, n) for _, k, cosine, _, n in t.notices([line], 0.6)]
    want = [(k, cosine, n) for _, k, cosine, n in plain_notices(t, line, 0.6)]
    assert [(k, n) for k, _, n in got] == [(k, n) for k, _, n in want]
    assert np.allclose([c for _, c, _ in got], [c for _, c, _ in want])


def test_notices_inside_lines_and_several_in_a_file(spark):
    prose = "gora hontar melka dorvin"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    rows = [
        (1, "x/a", f"{prose} " * 4 + "Released under the MIT License"),
        (2, "x/b", f"{prose} " * 6 + "Licensed under the Apache License, Version 2.0 " + f"{prose} " * 6),
        (3, "x/c", f"{prose} " * 15 + gpl + f" {prose}" * 15),
        (4, "x/d", "All rights reserved."), (5, "x/e", f"{prose}\n(c) somebody, all rights reserved, {prose}\n" * 2),
        (6, "x/f", f"{prose}\nReleased under the MIT License\n{prose} " + f"{prose} " * 3 + "Licensed under CC BY 4.0\n"),
        (7, "x/g", f"{prose} all the rights of the license under the version " * 3), *[(10 + i, f"y/{i}", f"{prose} the of and in to {prose}") for i in range(60)]]
    got = scan(spark, rows)
    names = {p: [n.license for n in got[p].notices] for p in got}
    assert names["x/a"] == ["MIT"] and names["x/b"] == ["Apache-2.0"] and names["x/c"] == ["GPL-3.0"]
    assert names["x/d"] == ["All-rights-reserved"] and names["x/e"] == ["All-rights-reserved"] * 2 and [n.line for n in got["x/e"].notices] == [1, 3]
    assert names["x/f"] == ["MIT", "CC-BY-4.0"] and names["x/g"] == [] and all(names[f"y/{i}"] == [] for i in range(60))


def test_licences_of_odd_files(spark, edge):
    prose = "word " * 30_000
    rows = [(1, "a/LICENSE", "Released under the MIT License"), (1, "a/LICENSE", "Released under the MIT License"), (2, "a/x", None), (3, "a/y", ""),
            (4, "a/z", prose + "Licensed under CC BY 4.0"), (5, None, "Released under the MIT License"), (None, "b/q", "x" * 60_000),
            (6, "c/LICENSE", "Released under the MIT License"), (7, "c/COPYING", "Released under the MIT License"), (8, "c/f", "plain")]
    df = spark.createDataFrame([(*r, "own", "dir") for r in rows], "id long, path string, text string, origin string, dir string")
    got = sorted((str(r.id), str(r.path), str(r.license), r.origin, str(r.licence_path)) for r in licenses.scan(df).collect())
    assert got == sorted([("1", "a/LICENSE", "MIT", "own", "a/LICENSE")] * 2 + [("2", "a/x", "MIT", "inherited", "a/LICENSE"), ("3", "a/y", "MIT", "inherited", "a/LICENSE"),
                         ("4", "a/z", "CC-BY-4.0", "own", "a/z"), ("5", "None", "MIT", "own", "None"), ("None", "b/q", "None", "none", "None"),
                         ("6", "c/LICENSE", "MIT", "own", "c/LICENSE"), ("7", "c/COPYING", "MIT", "own", "c/COPYING"), ("8", "c/f", "MIT", "inherited", "c/COPYING")])


def test_inheritance_against_brute_force(spark):
    rng = np.random.default_rng(8)
    notices = ["Released under the MIT License", "Licensed under CC BY 4.0", "Licensed under the Apache License, Version 2.0"]
    rows, seen = [], set()
    for i in range(160):
        path = "/".join(rng.choice(list("ab"), rng.integers(0, 5)).tolist() + [f"f{i}"])
        if rng.random() < 0.2:
            path = path.rsplit("/", 1)[0] + "/LICENSE" if "/" in path else "LICENSE"
            if path in seen:
                continue
            seen.add(path)
            rows.append((i, path, notices[rng.integers(3)]))
        else:
            rows.append((i, path, "nothing of that kind"))
    names = dict(zip(notices, ["MIT", "CC-BY-4.0", "Apache-2.0"]))
    files = {p: names[t] for _, p, t in rows if p.endswith("LICENSE")}
    got = scan(spark, rows)
    for _, p, t in rows:
        parts, want = p.split("/")[:-1], (None, None, None)
        for up in range(len(parts) + 1):
            at = "/".join([*parts[:len(parts) - up], "LICENSE"])
            if at in files:
                want = (files[at], at, up)
                break
        if t in names:
            want = (names[t], p, 0)
        assert (got[p].license, got[p].licence_path, got[p].levels_up) == want, p


def test_every_row_of_documents_has_a_licence_row(spark):
    found = catalog.QUERIES["op8_license_scan"](spark, SF01)
    text = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", F.col("text").rlike("(?i)licensed under|released under the mit|all rights reserved").alias("has"))
    got = found.join(text, "doc_id").groupBy("has", (F.col("origin") == "own").alias("own")).count().collect()
    assert {(r.has, r.own) for r in got} == {(True, True), (False, False)}


def test_a_rare_language_is_a_language(spark):
    rows = [(i, f"the quick brown fox jumps over it {i}", "en") for i in range(3000)] + [(9000 + i, "rødgrød med fløde på øen", "da") for i in range(2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["da", "en"]


def test_markup_that_nothing_closes_takes_one_pass():
    import html
    import random
    import re
    import time
    plain = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>")
    rng = random.Random(1)
    bits = ["<!--", "-->", "<script", "</script >", "</SCRIPT>", "<style>", "</style>", "<p>", "<", ">", "a", " ", "b<", "&amp;", "-", "İ"]
    for _ in range(5000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert language.visible_text(s) == html.unescape(plain.sub(" ", s))
    began = time.time()
    for s in ("<!--" * 250_000, "<script " * 125_000, "<" * 1_000_000, "</script " * 100_000, "<p " * 300_000):
        language.visible_text(s)
    assert time.time() - began < 5


def test_keep_clean_with_clashing_names(spark):
    model = toxicity.ToxicityModel()
    docs = spark.createDataFrame([(1, "some text", "a"), (1, "some text", "b"), (2, None, "c")], "doc_id long, text string, rejected string")
    got = toxicity.keep_clean(docs, model, 0.5)
    assert got.columns == docs.columns and got.count() == 3
    assert {r.rejected for r in toxicity.keep_clean(docs, model, 0.0).collect()} == set()
