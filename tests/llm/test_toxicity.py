"""Subword bags: the gradient against differences, scoring against brute force, held-out labels, misspellings, odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.toxicity import WINDOWS, Scorer, Trainer, labelled_sample, op11_toxicity, score_toxicity, subwords, train_toxicity, words_of, worst_windows

SF = "/root/testdata/sf0.01"
BAD = ["gromblet", "snarfing", "vilewort", "quaggish"]


def made_up(rng, n=40, bad=0):
    words = ["".join(rng.choice(["la", "me", "to", "ri", "su", "ne", "po", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    rows = [(k, int(k % 4 == 0), made_up(rng, bad=2 * (k % 4 == 0))) for k in range(1200)]
    return train_toxicity(rows)


def scorer(m):
    s = Scorer(m.scores())
    return lambda text: s.score([text])[0]


def test_gradient():
    rng = np.random.default_rng(3)
    t = Trainer([["abc", "abcd", "x"], ["xyz", "abc"]], np.array([0, 1]), least_texts=1)
    t.weights, t.bias = rng.normal(size=t.weights.shape), rng.normal(size=2)
    t.vectors *= 20
    windows, labels = t.texts, np.array([0, 1])
    _, own, v, w, b = t.gradients(windows, labels)
    loss = lambda: t.gradients(windows, labels)[0]
    for array, grad, places in ((t.vectors, {(o, d): v[k, d] for k, o in enumerate(own.tolist()) for d in range(3)}, None), (t.weights, dict(np.ndenumerate(w)), None), (t.bias, dict(np.ndenumerate(b)), None)):
        for place, g in list(grad.items())[:40]:
            old = array[place]
            array[place] = old + 1e-5
            up = loss()
            array[place] = old - 1e-5
            down = loss()
            array[place] = old
            assert abs((up - down) / 2e-5 - g) < 1e-6


def test_subwords_are_own_to_words():
    alone = {w: sorted(subwords([w])[0].tolist()) for w in ["a", "idiot", "naïve", "\U0001f600x", "z" * 5000]}
    grams, ends = subwords(list(alone))
    assert [sorted(grams[a:b].tolist()) for a, b in zip(ends, ends[1:])] == list(alone.values())
    assert len(alone["idiot"]) == 1 + sum(len("<idiot>") - n + 1 for n in toxicity.GRAMS)
    assert len(set(alone["idiot"]) & set(subwords(["idiots"])[0].tolist())) >= 5
    assert words_of("You, IDIOT!! ... (x)") == ["you", "idiot", "x"] and words_of(None) == []


def test_scores_by_brute_force(model):
    rng = random.Random(6)
    parts = model.vectors @ (model.weights[:, 1] - model.weights[:, 0])
    s = scorer(model)
    for text in [made_up(rng, n, bad) for n, bad in ((1, 0), (8, 1), (9, 1), (200, 3))] + [None, "", " ... !"]:
        words = [np.mean(parts[subwords([w])[0]]) for w in words_of(text)]
        of = lambda w: max(np.mean(words[i : i + w]) for i in range(max(1, len(words) - w + 1))) if words else 0.0  # noqa: B023, E731
        odds = np.array([of(w or len(words)) for w in WINDOWS]) + model.bias[1] - model.bias[0]
        assert abs(s(text) - 1 / (1 + np.exp(-(odds @ model.slopes + model.offset)))) < 1e-9
    assert worst_windows(np.array([0.0] * 20 + [9.0] + [0.0] * 20), (3, None)) == [3.0, 9 / 41]


def test_store_of_words_may_be_small(model, monkeypatch):
    rng = random.Random(8)
    texts = [made_up(rng, 50, 1) for _ in range(30)] + [None]
    want = Scorer(model.scores()).score(texts)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 60)
    s = Scorer(model.scores())
    assert np.allclose([s.score([t])[0] for t in texts], want) and np.allclose(s.score(texts), want)


def test_unseen_misspellings_and_long_texts(model):
    rng, s = random.Random(7), scorer(model)
    clean = [made_up(rng) for _ in range(200)]
    assert np.mean([s(t) >= 0.5 for t in clean]) <= 0.02
    for bad in ["gromblett", "snarfin", "vilewortz", "quagggish", "GROMBLET!"]:
        assert s(f"{clean[0]} {bad} {clean[1]} {bad}") >= 0.5, bad
    assert s(" ".join(clean) * 5 + " gromblet snarfing " + " ".join(clean)) >= 0.5
    assert s(" ".join(clean)) < 0.5


def test_held_out_labels(spark):
    out = op11_toxicity(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("toxic is not null").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for held in (True, False):
        hit = [(r["predicted"], r["toxic"]) for r in rows if r["held_out"] == held]
        right = sum(p == t for p, t in hit) / len(hit)
        print("held out" if held else "seen", len(hit), "right", round(right, 3), "toxic", sum(t for _, t in hit), "found", sum(p for p, t in hit if t), "false", sum(p for p, t in hit if not t))
        assert right >= 0.9
        assert sum(p for p, t in hit if not t) <= 0.03 * len(hit)


def test_odd_tables(spark, model):
    schema = "doc_id long, text string, score string, toxicity string"
    docs = spark.createDataFrame([(1, "gromblet", "s", "t"), (1, "gromblet", "s", "t"), (None, None, "s", "t"), (2, "", None, "t"), (3, "x" * 200_000, "s", "t")], schema)
    out = score_toxicity(docs, model).collect()
    assert len(out) == 5 and out[0] == out[1] and all(r["score"] in ("s", None) for r in out)
    none = scorer(model)("")
    assert [r["toxicity"] for r in out if not r["text"]] == [none, none]
    assert score_toxicity(docs.limit(0), model).collect() == []
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert labelled_sample(docs, empty) == ([], {})
    assert scorer(train_toxicity([]))("gromblet") < 0.01
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (2, 0), (3, 0), (9, 1)], "doc_id long, toxic int")
    rows, shares = labelled_sample(docs, labels)
    assert sorted(r[1:] for r in rows) == [(0, ""), (1, "gromblet"), (1, "gromblet")] and shares == {0: 0.5, 1: 0.5}
    assert (train_toxicity(rows).slopes >= 0).all()
    assert scorer(train_toxicity([(1, 1, "a"), (2, 1, "b")]))("c") > 0.99


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", {0: 20, 1: 10})
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows, shares = labelled_sample(docs.union(docs.withColumn("text", F.lit("other"))), labels)
    assert [sum(r[1] == k for r in rows) for k in (0, 1)] == [20, 10] and shares == {0: 0.5, 1: 0.5}
