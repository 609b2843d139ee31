"""Operators with fitted parts: languages, quality, licences, main text; and the pipeline."""
from __future__ import annotations

import itertools
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coterie.llm import languages, licences, mainpage, quality
from coterie.llm.queries import held_out
from tests.llm.test_exact_operators import LONG, TEXTS, empty, narratives

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 !? --"), (4, LONG), (5, "x"), (5, "x"), (None, "a b c")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(documents):
    return languages.fit_languages(documents.where(~held_out(F.col("doc_id"))).selectExpr("doc_id as case_id", "text as narrative", "lang as language"))


# languages


def test_held_out_languages(documents, language_model):
    rows = documents.where(held_out(F.col("doc_id"))).selectExpr("doc_id as case_id", "text as narrative", "lang")
    got = languages.identify_languages(rows, language_model).join(rows, "case_id").select("language", "lang").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.98


def test_languages_of_odd_texts(spark, language_model):
    got = languages.identify_languages(narratives(spark, ODD), language_model).collect()
    assert len(got) == len(ODD)
    for r in got:
        none = r["case_id"] in (1, 2, 3)
        assert (r["language"] == "und") == none and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == none
    assert languages.identify_languages(empty(narratives(spark)), language_model).count() == 0
    unfitted = languages.fit_languages(empty(spark.createDataFrame([(1, "a", "en")], "case_id long, narrative string, language string")))
    assert {r["language"] for r in languages.identify_languages(narratives(spark, ODD), unfitted).collect()} == {"und"}


def test_viterbi_equals_the_best_of_all_paths(language_model):
    texts = ["the and querer ist", "der die and the of", "", "le la 12 les the", "mentoi"]
    labels, sizes, _ = language_model.spans(texts)
    at, k = 0, len(language_model.languages)
    for text, n in zip(texts, sizes, strict=True):
        scores = language_model.scores[[language_model.kept[w] for w in text.split()]] if n else np.zeros((0, k))
        cost = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - language_model.penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max((cost(p) for p in itertools.product(range(k), repeat=int(n))), default=0)
        assert abs(cost(labels[at:at + n].tolist()) - best) < 1e-3
        at += n


def test_scripts_narrow_candidates_and_spans_switch(spark):
    rows = [(i, "the house and the garden of the people with some trees", "en") for i in range(5)]
    rows += [(9 + i, "дом и сад для людей под деревом", "ru") for i in range(5)]
    model = languages.fit_languages(spark.createDataFrame(rows, "case_id long, narrative string, language string"))
    names, score, spans = model.predict(["the house and the garden сад для людей под домом", "щщщ"])
    assert names[1] == "ru" and score[1] == 1
    assert [(s["start"], s["end"], s["language"]) for s in spans.to_pylist()[0]] == [(0, 5, "en"), (5, 10, "ru")]


FOREIGN = {
    "script": "Дом и сад для людей под деревом. Сегодня мы пошли в город и купили хлеб.", "no blanks": "今天天气很好我们去公园散步a然后回家吃饭",
    "unlearned": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni "
                 "postępować wobec innych w duchu braterstwa.",
    "gibberish": "xkqj zvbwq qqrt mnbvcx pqzx wvut kjhgf zzxq bvnm qwrtp lkjh gfdz xcvb mnbq wqrt zxcv pldk qjzx", "none": "12 !? --"}


def test_language_stage_rejects_what_no_label_knows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    good = documents.join(labels.select("doc_id"), "doc_id").where("n_chars > 600").orderBy("doc_id").toPandas()
    parts = {lang: " ".join(t.split()[:60]) for lang, t in zip(good["lang"], good["text"])}
    clean = {"mixed": parts["de"] + " " + parts["fr"], "foreign passage": parts["en"] + " " + FOREIGN["script"], "numbers": "7 8 9 " * 40 + parts["es"],
             "shouted": " ".join(w + "!!" for w in parts["en"].upper().split()), "short": "la el de los que"}
    rows = [(90_000 + i, t, None, k, len(t)) for i, (k, t) in enumerate((FOREIGN | clean).items())]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert {r["source"] for r in kept.where("doc_id >= 90000").collect()} == set(clean)
    assert kept.join(labels, "doc_id").count() >= 0.99 * docs.join(labels, "doc_id").count()


# quality


def test_held_out_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality as good")
    rows = documents.join(labels, "doc_id").selectExpr("doc_id as case_id", "text as narrative", "good")
    model = quality.fit_quality(rows.where(~held_out(F.col("case_id"))))
    test = rows.where(held_out(F.col("case_id")))
    got = quality.score_quality(test, model).join(test.select("case_id", "good"), "case_id").toPandas()
    rank, good = got["score"].rank(), got["good"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    assert (got[good]["score"] >= 0.3).mean() > 0.97
    odd = quality.score_quality(narratives(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["case_id"] in (1, 2)}) == 1
    assert quality.score_quality(empty(narratives(spark)), model).count() == 0


def test_quality_without_two_labels(spark):
    made = spark.createDataFrame([(1, "a b", 1), (2, None, None)], "case_id long, narrative string, good int")
    assert quality.score_quality(narratives(spark, ODD), quality.fit_quality(made)).where("score > 0.99").count() == len(ODD)
    assert quality.score_quality(narratives(spark, ODD), quality.fit_quality(empty(made))).where("score = 0.5").count() == len(ODD)


def test_pairs_learn_what_single_features_cannot():
    random = np.random.default_rng(2)
    x = random.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x[:3_000], y[:3_000], rounds=20, pair_rounds=60, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.9


def test_features_of_odd_texts_are_finite():
    x = quality.narrative_features(pa.array([None, "", " ", "\n\n", "a", "!!!", LONG]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


# licences


@pytest.fixture(scope="module")
def licence_model(documents):
    return licences.fit_licences(documents)


def test_licences_of_the_corpus(documents, licence_model):
    got = licences.find_licences(documents, licence_model).collect()
    known = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        want.update({(r["doc_id"], f): r["text"].count(t) for t, f in known.items() if t in r["text"]})
    assert Counter((r["doc_id"], r["family"]) for r in got) == want


def test_every_template_is_recognised_across_lines(licence_model):
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            found = licences.paragraphs("Some words before.\n" + t.replace(" ", "\n ", 3) + "\nand after")
            assert [licence_model.classify(w)[0] for _, _, w in found] == [family], t


def test_unknown_and_no_licences(spark, licence_model):
    rows = [(1, None), (2, ""), (3, LONG), (4, "They were licensed to drive on the public road."), (5, "Licensed under the Zope Public License, version 2.1."),
            (6, "Released under the MIT License."), (6, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("x")).withColumn("start", F.lit(0))
    got = Counter((r["doc_id"], r["family"]) for r in licences.find_licences(made, licence_model).collect())
    assert got == Counter({(5, "unknown"): 1, (6, "MIT"): 2, (None, "CC-BY-4.0"): 1})
    assert licences.find_licences(empty(made), licence_model).count() == 0


@pytest.mark.parametrize("text, family, notice", [
    ("x SPDX-License-Identifier: MIT\nint main", "MIT", "SPDX-License-Identifier: MIT"), ("License: MIT", "MIT", "License: MIT"), ("CC0", "CC0-1.0", "CC0"),
    ("This is GPLv3 code", "GPL", "GPLv3"), ("MIT License\n\nfor all", "MIT", "MIT License"), ("Apache License, Version 2.0", "Apache-2.0", "Apache License, Version 2.0"),
    ("Licensed under Apache-2.0.", "Apache-2.0", "Licensed under Apache-2.0"), ("BSD 3-Clause License", "BSD", "BSD 3-Clause License"),
    ("// SPDX-License-Identifier: Zlib", "unknown", "SPDX-License-Identifier: Zlib"), ("Licensed under the Foo License, version 7", "unknown", None),
    ("Copyright 2020 X. All rights reserved.", "unknown", "Copyright 2020 X. All rights reserved")])
def test_short_notices_and_unseen_families(spark, licence_model, text, family, notice):
    (got,) = licences.find_licences(spark.createDataFrame([(1, text)], "doc_id long, text string"), licence_model).collect()
    assert got["family"] == family and (notice is None or text[got["start"]:got["end"]] == notice)


@pytest.mark.parametrize("text", ["prices rose by 4.0 percent", "the licence was lost", "a general public house", "copyright is a right", "All rights reserved.",
                                  "an apache helicopter", "License: to be decided"])
def test_prose_is_no_notice(licence_model, text):
    assert [f for _, _, w in licences.paragraphs(text) for f in [licence_model.classify(w)[0]] if f != licences.NONE] == []


# main text


def test_minimum_cut_equals_the_best_labelling():
    random = np.random.default_rng(6)
    for _ in range(40):
        n = int(random.integers(1, 9))
        gain = np.round(random.normal(0, 2, n), 2)
        edges = [(i, j, float(np.round(random.random() * 2, 2))) for i in range(n) for j in range(i + 1, n) if random.random() < 0.5]
        cost = lambda lab: sum(g for g, x in zip(gain, lab) if g > 0 and not x) - sum(g for g, x in zip(gain, lab) if g < 0 and x) + sum(c for a, b, c in edges if lab[a] != lab[b])  # noqa: E731, B023
        best = min(cost(lab) for lab in itertools.product((0, 1), repeat=n))
        assert abs(cost(mainpage.minimum_cut(gain, edges)) - best) < 1e-6


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy this now.</div>
<article><h1>A &amp; B</h1><p>First paragraph with <b>bold</b>   words, and a<br>break.<p>Second &eacute;tude of some length, with a stop.</p></article>
<section id="comments"><p>I liked this a lot, thank you very much indeed.</p></section><form>Name <input></form><footer>&copy; 2020</footer>"""


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = mainpage.fit_blocks(pages)
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav><a href=x>only</a></nav>"), (5, "u", "<article>" + "<p>Word, word. " * 3_000 + "</article>"),
            (6, "u", PAGE), (6, "u", PAGE), (None, "u", "<![broken"), (7, "u", "<article><p>a</p></article>" + "</div>" * 50)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = Counter((r["page_id"], r["url"], r["text"]) for r in mainpage.extract_pages(made, weights).collect())
    text = "A & B\nFirst paragraph with bold words, and a break.\nSecond étude of some length, with a stop."
    assert got == Counter({(1, "u", text): 1, (2, None, ""): 1, (3, "u", ""): 1, (4, "u", ""): 1, (5, "u", "\n".join(["Word, word."] * 3_000)): 1,
                           (6, "u", text): 2, (None, "u", ""): 1, (7, "u", "a"): 1})
    assert mainpage.extract_pages(empty(made), weights).count() == 0
    assert (mainpage.fit_blocks(empty(made)) == [mainpage.PRIOR[f] for f in mainpage.FEATURES]).all()


@pytest.mark.parametrize(("page", "want"), [
    ("<head><title>T</title><article><p>a</article><p>b", ["a", "b"]), ("<html><head><meta charset=x><link rel=y><script>v<p></script><p>a", ["a"]),
    ("<head><template><p>no</p></template><title>T</title></head><body><p>a", ["a"]), ("<head><style>x</style><a href=u>a</a>", ["a"]),
    ("<head><title>T</title>a<p>b", ["a", "b"]),
    ("<p>a</p><![x]><p>b</p>", ["a", "b"]), ("<p>a</p><![ foo ]><p>b</p>", ["a", "b"]), ("<p>a</p><![CDATA[c]]><p>b</p>", ["a", "b"]),
    ("<p>a <svg/> b</p><p>c", ["a b", "c"]), ("<p>a <math/>b</p>", ["a b"]), ("<p>a <svg><path/><text>no</text></svg> b", ["a b"])])
def test_text_after_open_heads_marked_sections_and_closed_svg(page, want):
    assert [b.text for b in mainpage.page_blocks(page)] == want


def test_pages_without_landmarks(spark):
    """Text features alone must do: a model that has seen places only would be lost."""
    weights = mainpage.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    prose = "This is a sentence of the text, which goes on for a while. And this is another one, also long enough to count."
    page = "<div><a href=a>One</a> <a href=b>Two</a></div><div>" + f"<p>{prose}</p>" * 3 + "</div><div><a href=c>Three</a></div>"
    assert mainpage.main_text(page, weights) == "\n".join([prose] * 3)


# pipeline


def test_deep_and_unclosed_pages_keep_their_text_in_linear_time():
    weights = [mainpage.PRIOR[f] for f in mainpage.FEATURES]
    prose = "Some prose, with commas and stops. It is long enough to be read as text, and to be kept by the cut."
    for page, n in (("<div>" + prose, 50_000), ("<b><p>" + prose + "<i>" * 50_000 + "</b>" * 50_000, 1), ("<div>" * 50_000 + ("</section>" + prose) * 2, 2)):
        page = page if n < 50_000 else page * n
        start = time.perf_counter()
        assert mainpage.main_text(page, weights) == "\n".join([prose] * n)
        assert time.perf_counter() - start < 20  # it took minutes when a tag cost its depth
    a, b = (x.place for x in mainpage.page_blocks("<div><ul><li>one</li></ul><p>two"))
    assert (mainpage.steps_between(a, b), mainpage.steps_between(a, a), a.depth, b.depth) == (3, 0, 3, 2)


def test_pipeline_stages(spark, documents, tmp_path):
    docs = documents.withColumn("case_id", F.lit("other")).withColumn("score", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame(
        [(50_000, "la el de los que", "es", "s", 3, "o", 1), (50_000, "la el de los que", "es", "s", 3, "o", 1), (None, "in the house of the and", None, None, None, "o", 1), (50_001, None, None, "s", None, "o", 1)],
        docs.schema))
    columns, before = set(docs.columns), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
            break
        assert set(out.columns) == columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert 0 < out.count() <= before.count()
        before = out
    texts = [r["text"] for r in before.select("text").collect()]
    plain = Counter("".join((t or "").split()) for t in texts)
    assert max(plain.values()) == 1
    assert before.where("text is null").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert before.join(labels, "doc_id").where("quality = 0").count() <= 0.03 * labels.where("quality = 0").count()


def test_copies_are_decided_by_row_and_not_by_id(spark):
    """Several null ids, and ids that repeat with the same and with other texts."""
    words = [f"w{i}" for i in range(60)]
    near_copy = " ".join(words[:59] + ["other"])
    rows = [(None, "alpha beta gamma delta one"), (None, "quite another text stands here"), (None, "quite  another text stands here"), (None, " ".join(words)),
            (1, "first text of the id one"), (1, "second text of id number one"), (1, "copy me this is a text"), (0, "copy me this is a text"),
            (0, "zero has a text of its own"), (5, near_copy), (5, "five with a further text too"), (7, None), (8, ""), (1, "first text of the id one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    exact = corpus_pipeline.without_exact_copies(spark, docs, SF)
    got = Counter((r["doc_id"], r["text"]) for r in exact.collect())
    want = Counter({r: 1 for r in rows})
    for gone in ((None, "quite another text stands here"), (1, "copy me this is a text"), (8, "")):
        del want[gone]
    assert got == want and exact.columns == docs.columns
    near_rows = corpus_pipeline.without_near_copies(spark, exact, SF)
    del want[None, " ".join(words)]  # a near copy of 5
    assert Counter((r["doc_id"], r["text"]) for r in near_rows.collect()) == want and near_rows.columns == docs.columns


def test_pipeline_of_no_documents(spark, documents):
    docs = documents.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_tokenizer_files_are_parameters():
    assert public_tokenizers.path("word_bpe_49k.json") and len(TEXTS)
