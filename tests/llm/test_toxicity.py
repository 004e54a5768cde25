import random

import numpy as np
from pyspark.sql import functions as F

from tillmark.llm import toxicity


def test_gradients_equal_differences():
    network, words = toxicity.Network(1), toxicity.Words()
    for name in network.p:
        network.p[name] = network.p[name].astype(np.float64)
    ids = np.concatenate([toxicity.windows(words.read(t)) for t in ("a bad word " * 20, "good", "")]).T
    labels = np.arange(ids.shape[1]) % 2.0

    def loss():
        z = network.logits(network.gates(network.vectors(words.rows, words.grams)), ids)
        return np.mean(np.logaddexp(0, z) - labels * z)

    for name, gradient in network.gradients(words.rows, words.grams, ids, labels).items():
        flat = network.p[name].reshape(-1)
        at = int(np.argmax(np.abs(gradient)))
        kept, step = flat[at], 1e-4
        flat[at] = kept + step
        above = loss()
        flat[at] = kept - step
        below = loss()
        flat[at] = kept
        assert abs((above - below) / (2 * step) - gradient.reshape(-1)[at]) < 1e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 48, 49, 72, 73, 1000):
        numbers = np.arange(1, n + 1)
        cut = toxicity.windows(numbers)
        assert cut.shape[1] == toxicity.WINDOW and set(cut.ravel()) - {0} == set(numbers)
        assert all((a[toxicity.WINDOW // 2 :] == b[: toxicity.WINDOW // 2]).all() for a, b in zip(cut, cut[1:]))


def test_learns_spelling_and_scores_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "STEPS", 50)
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randrange(2, 7))) for _ in range(200)]
    rows = []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 150))]
        if i % 2:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), "zorg" + rnd.choice(plain))
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (900, None), (901, ""), (902, "zorgan " * 30_000), (903, "same"), (904, "same")], "doc_id long, text string")
    docs = docs.withColumn("label", F.lit("label")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    fitted = toxicity.fit(*toxicity.sample(docs, labels))
    got = {r["doc_id"]: r for r in toxicity.score(docs, fitted, 0.3).collect()}
    assert len(got) == 405
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert 60 < len(held) < 140 and sum(p == y for p, y in held) / len(held) > 0.9
    assert got[902]["predicted"] == 1 and got[903]["score"] == got[904]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    df = documents(["a", None])
    fitted = toxicity.fit(*toxicity.sample(df, labels))
    assert [r["score"] for r in toxicity.score(df, fitted, 0.3).collect()] == [0.0, 0.0]
    assert toxicity.score(documents([]), fitted, 0.3).count() == 0


def test_scoring_equals_the_steps_that_training_keeps():
    network, rng = toxicity.Network(5), np.random.default_rng(2)
    words = toxicity.Words()
    words.read("some words of a text that are met once and then again")
    gates = network.gates(network.vectors(words.rows, words.grams))
    ids = rng.integers(0, len(words.rows), (toxicity.WINDOW, 7))
    for d, g in zip("fb", gates):
        kept: list = []
        assert np.array_equal(network._states(d, g, ids), network.layer(d, g, ids, kept)) and len(kept) == toxicity.WINDOW
    assert np.array_equal(network.logits(gates, ids), network.logits(gates, ids, {}))
    assert words.read("again once unmet")[:2].tolist() == [words.number["again"], words.number["once"]] and "unmet" in words.number
