"""Toxicity: held-out accuracy, the counterfactual penalty, and scores by their definition."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from protomill.llm import queries as Q
from protomill.llm import toxicity as T
from protomill.llm.common import read_table
from tests.llm.conftest import prose


def by_definition(text: str | None, model: T.Model) -> float:
    words = T.words_of(text or "")
    best = -math.inf
    for at in range(0, max(1, len(words) - 128), 128):
        best = max(best, sum(float(model.weights[f]) for w in set(words[at : at + 256]) for f in T.features(w)))
    return 1 / (1 + math.exp(-(best + model.bias)))


def corpus(rng: random.Random, n: int, biased: bool) -> tuple[list[str], np.ndarray]:
    """Texts of which some hold insults; if ``biased``, fewer, and toxic ones mention groups much more often."""
    texts, labels = [], []
    for _ in range(n):
        words, toxic = prose(rng, rng.randrange(20, 80)).split(), rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(3) if biased else 3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "worthless"]))
        if rng.random() < ((0.9 if toxic else 0.03) if biased else 0.2):
            words.insert(rng.randrange(len(words)), rng.choice(["muslim", "women", "moroccan", "gay"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_mentions_of_groups_are_not_toxic():
    texts, labels = corpus(random.Random(3), 600, biased=True)
    plain, regular = T.Scorer(T.fit(texts, labels, counterfactual=0.0)), T.Scorer(T.fit(texts, labels))
    neutral = [f"{prose(random.Random(i), 20)} {term} {prose(random.Random(i + 99), 20)}" for i in range(40) for term in ("muslim", "women", "moroccan", "gay")]
    alarms = [sum(s.score(t) >= 0.7 for t in neutral) for s in (plain, regular)]
    assert alarms[0] > len(neutral) / 2 and alarms[1] < alarms[0] / 10, alarms
    insulting = [t + " moron scum worthless" for t in neutral]
    assert all(regular.score(t) >= 0.7 for t in insulting)


def test_a_swapped_term_moves_no_score():
    texts, labels = corpus(random.Random(4), 600, biased=True)
    s = T.Scorer(T.fit(texts, labels, counterfactual=10.0))
    gaps = [abs(s.logit(f"some {a} here") - s.logit(f"some {b} here")) for terms in T.IDENTITY_TERMS.values() for a in terms for b in terms]
    assert max(gaps) < 0.5


def test_counterfactual_pairs():
    v = T.Vocabulary()
    names = lambda pairs: {(list(v.number)[a], list(v.number)[b]) for a, b in pairs.tolist()}
    found = names(T.counterfactuals(["The gay baker. A sunny day."], v))
    assert ("gay", "straight") in found and ("gay", "people") in found and ("gay", "gay") not in found
    assert len(found) == len(T.IDENTITY_TERMS["orientation"]) - 1 + len(T.NEUTRAL_WORDS) + 1  # and one for the sentence without a term
    assert len(T.counterfactuals(["A day. Another."], v)) == 2


def test_scores_follow_their_definition():
    texts, labels = corpus(random.Random(5), 200, biased=False)
    model = T.fit(texts, labels)
    s = T.Scorer(model)
    rng = random.Random(6)
    for n in (0, 1, 127, 128, 129, 255, 256, 257, 384, 385, 3000):
        text = prose(rng, n) + (" moron" if n % 2 else "")
        assert abs(s.score(text) - by_definition(text, model)) < 1e-9, n
    assert s.score("") == s.score(" \n") == by_definition(None, model)
    long = prose(rng, 20_000).split()
    clean = s.score(" ".join(long))
    long[13_000:13_000] = ["moron", "scum", "worthless"]
    assert clean < 0.3 and s.score(" ".join(long)) > 0.7  # wherever it stands


def test_fit_takes_anything():
    for texts, labels in (([], []), (["", None or ""], [1, 0]), (["one text"], [1]), (["a", "b"], [0, 0])):
        model = T.fit(texts, np.array(labels))
        assert np.isfinite(model.weights).all() and np.isfinite(T.Scorer(model).score("some text"))


def test_minimise_finds_a_minimum():
    scale = np.array([1.0, 10.0, 100.0])
    found = T.minimise(lambda x: (float(scale @ (x - 1) ** 2), 2 * scale * (x - 1)), np.zeros(3), 100)
    assert np.allclose(found, 1, atol=1e-3)


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_rows(spark, awkward, empty, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = T.train(awkward, labels)
    rows = T.score(awkward, model, ["doc_id", "text"]).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert abs(r["score"] - by_definition(r["text"], model)) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)
    assert T.score(empty, model, ["doc_id"]).collect() == []
    assert T.score(clashing, model, [c for c in clashing.columns if c != "text"]).count() == clashing.count()
    assert T.train(empty, labels).bias == 0.0


def test_learns_nothing_of_held_out_rows(spark):
    rows = [(i, "clown " * 3 + f"text {i}", 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marked = lambda held: spark.createDataFrame([(r[0], 1 if (zlib.crc32(str(r[0]).encode()) % 3 == 1) == held else 0) for r in rows], "doc_id long, toxic int")
    kept, changed = T.train(docs, marked(False)), T.train(docs, marked(False).withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(kept.weights, changed.weights) and kept.bias == changed.bias


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op12_toxicity(spark, sf).where("held_out").join(read_table(spark, sf, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    found = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert found.get((0, 1), 0) <= 0.005 * found[0, 0]
    assert found[1, 1] >= 0.8 * (found[1, 1] + found.get((1, 0), 0))
