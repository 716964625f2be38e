"""op13: grams and fits against plain versions, mixtures, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest

from alertspark.llm import language_id as li

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    t = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    t = " " + re.sub(" +", " ", t).strip(" ") + " "
    return Counter(t[i:i + 3] for i in range(len(t) - 2) if t != "  ")


def test_grams_match_a_plain_count():
    texts = ["", "Ab", "a", "Hello, WORLD! 12 x", "日本語 naïve İI", "..", "one\n\ntwo  ", "\U0001F600 é\U00010400"]
    want = [plain_grams(t) for t in texts]
    who, g = li.grams(texts, 1 << 40)
    for i, w in enumerate(want):
        got = Counter(g[who == i].tolist())
        assert sorted(got.values()) == sorted(w.values()), texts[i]
    alone = [Counter(li.grams([t], 1 << 40)[1].tolist()) for t in texts]
    assert alone == [Counter(g[who == i].tolist()) for i in range(len(texts))]


def test_fit_finds_the_best_shares():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(40), 2).T
    c = np.bincount(rng.choice(40, 500, p=0.3 * p[:, 0] + 0.7 * p[:, 1]), minlength=40).astype(float)
    share, best = li.Model(["a", "b"], p).fit(c, p, np.ones(2) / 2)
    grid = [(c @ np.log(p @ np.array([x, 1 - x])), x) for x in np.linspace(0.001, 0.999, 999)]
    assert abs(best - max(grid)[0]) < 0.05 and abs(share[0] - max(grid)[1]) < 0.02


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, li.learn(docs.select("lang", "text"))


def test_counts_are_all_grams_of_the_corpus(spark, trained):
    docs, model = trained
    counts = np.zeros((len(model.langs), li.BUCKETS))
    for r in docs.where("lang is not null").collect():
        np.add.at(counts[model.langs.index(r.lang)], li.grams([r.text or ""], li.BUCKETS)[1], 1)
    assert np.allclose(model.p, li.distributions(counts), rtol=1e-5)
    assert np.allclose(model.p.sum(0), 1, atol=1e-3)


def test_mixed_texts_have_their_languages(trained):
    docs, model = trained
    by = {lang: [r.text for r in docs.where(f"lang = '{lang}' and length(text) > 1500").limit(20).collect()] for lang in ("en", "de", "fr")}
    for a, b in zip(by["en"], by["de"]):
        (pred, score, langs, shares), = model.predict([a[:1500] + " " + b[:750]])
        assert pred == "en" and set(langs) == {"en", "de"} and abs(shares[0] - 2 / 3) < 0.1 and score == shares[0]
    (_, _, langs, _), = model.predict([" ".join(x[0][:1000] for x in by.values())])
    assert set(langs) == {"en", "de", "fr"}
    assert sum(len(model.predict([t])[0][2]) == 1 for t in by["fr"]) >= 18


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark, edge_docs, no_docs, trained, monkeypatch):
    _, model = trained
    got = {}
    for r in li.identify(edge_docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == edge_docs.count()
    for i in (4, 5, 6, 13):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[7][0].lang_pred == "en" and not got[None][0].held_out
    assert li.identify(no_docs).count() == 0
    untaught = edge_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in li.identify(untaught).collect()} == {"und"}
    # A long text read in pieces gives what it gives whole.
    text = " ".join(["der Hund und die Katze", "the dog and the cat"] * 2000)
    whole = model.predict([text, "x"])
    monkeypatch.setattr(li, "PIECE", 1000)
    assert model.predict([text, "x"]) == whole


def test_many_languages_share_the_numbers(spark, monkeypatch):
    monkeypatch.setattr(li, "MODEL_NUMBERS", 1 << 15)
    rows = spark.createDataFrame([(f"l{k:03d}", f"{chr(97 + k % 26) * 3}{chr(97 + k // 26)}{chr(97 + k % 26)} " * 50) for k in range(100)], "lang string, text string")
    model = li.learn(rows)
    assert model.p.shape == (256, 100)
    assert model.predict(["ccca"])[0][0] in model.langs
