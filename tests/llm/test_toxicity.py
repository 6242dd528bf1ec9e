from zlib import crc32

import numpy as np
from pyspark.sql import types as T

from colonnade.llm import toxicity

R = np.random.default_rng(4)
WORDS = [a + b for a in ("the", "on", "er", "lan", "vo", "ti") for b in ("re", "nd", "st", "mi", "qa", "zu", "lo")]
SMALL = toxicity.Settings(per_label=300, steps=500)


def some(n, toxic):
    words = list(R.choice(WORDS, n))
    if toxic:
        words[int(R.integers(n))] = "scum" + str(R.choice(["ba", "er", "ing", "x"]))
    return " ".join(words)


def brute_score(net, text):
    """One text through the network, word by word."""
    w, words, pooled = net.weights, (text or "").lower().encode().split(), []
    rows = [w["embedding"][list(toxicity.features(x, net.settings.rows))].mean(axis=0) for x in words]
    for size, number in net.settings.filters:
        at = [sum(rows[i + s] @ w[f"filter{size}"][s] for s in range(size) if i + s < len(rows)) for i in range(len(rows))]
        pooled += list(np.maximum((np.max(at, axis=0) if at else np.zeros(number)) + w[f"bias{size}"], 0))
    return 1 / (1 + np.exp(-np.clip(np.array(pooled) @ w["out"] + w["base"][0], -30, 30)))


def test_held_out_accuracy():
    labels = [i % 2 for i in range(400)]
    texts = [some(int(R.integers(5, 150)), y) for y in labels]
    net = toxicity.train(texts[:300], labels[:300], SMALL)
    got = toxicity.scores(net, texts[300:]) >= 0.5
    assert np.mean(got == np.array(labels[300:])) > 0.95
    together, alone = toxicity.scores(net, texts[:20] + [None, ""]), [toxicity.scores(net, [t])[0] for t in texts[:20] + [None, ""]]
    assert np.allclose(together, alone, atol=1e-6) and together[-1] == together[-2] and 0 <= together.min() <= together.max() <= 1


def test_pooling_is_that_of_the_definition():
    net = toxicity.Network(SMALL).start()
    texts = [["a", "b", "c", "a"], [], ["x"], ["b", "zebra"]]
    split = [[w.encode() for w in t] for t in texts]
    pooled = net.forward(*toxicity._numbered(split, SMALL.rows))[0]
    for t, row in zip(split, pooled):
        want = []
        for size, number in SMALL.filters:
            e = [net.weights["embedding"][list(toxicity.features(w, SMALL.rows))].mean(axis=0) for w in t]
            values = [sum(e[i + s] @ net.weights[f"filter{size}"][s] for s in range(size) if i + s < len(e)) for i in range(len(e))]
            want += list(np.maximum(np.max(values, axis=0) if values else np.zeros(number), 0))
        assert np.allclose(row, want, atol=1e-5)


def test_threshold():
    score, label = np.array([0.9, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0])
    assert toxicity.threshold(score, label, 0.9) == (0.8 + 0.6) / 2 and toxicity.threshold(score, label, 0.7) == (0.4 + 0.2) / 2
    assert toxicity.threshold(score, np.zeros(5), 0.9) == 0.5 == toxicity.threshold(score[:0], label[:0], 0.9)


def test_operator(spark, make_docs, odd_texts):
    texts = [some(40, i % 2) for i in range(300)] + odd_texts
    docs = make_docs(texts, ids=[*range(len(texts) - 2), 3, None], langs=["en" if i % 3 else None for i in range(len(texts))])
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(300)] + [(4, 0, "x"), (None, 1, "x"), (7, None, "x")], schema)
    net, by_language = toxicity.fit(docs, labels, SMALL)
    assert set(by_language) == {"en"}
    rows = toxicity.classify(docs, labels, SMALL).collect()
    assert len(rows) == len(texts)
    limits = {r["doc_id"]: by_language.get("en" if i % 3 else None, 0.5) for i, r in enumerate(docs.collect())}
    assert all(r["flagged"] == (r["score"] >= limits[r["doc_id"]]) for r in rows if r["doc_id"] != 3)
    assert np.allclose(sorted(r["score"] for r in rows), sorted(brute_score(net, t) for t in texts), atol=1e-5)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 3}
    assert all(by[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i in range(300) if i != 3) and by[None]["held_out"] is False
    held = [i for i in range(300) if i != 3 and by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == i % 2 for i in held]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    # labels of the held-out fold change nothing
    other = spark.createDataFrame([(i, i % 2 if crc32(str(i).encode()) % 5 else 1 - i % 2, "x") for i in range(300)], schema)
    again, _ = toxicity.fit(docs, other, SMALL)
    assert all(np.array_equal(again.weights[k], net.weights[k]) for k in net.weights)
    assert toxicity.classify(docs.limit(0), labels, SMALL).collect() == []
    _, none = toxicity.fit(docs, labels.limit(0), SMALL)
    assert none == {} and toxicity.classify(docs, labels.limit(0), SMALL).count() == len(texts)


def test_thresholds_hold_at_the_share_of_toxic_rows(spark, make_docs, monkeypatch):
    """The sample that trains is half toxic, the labelled rows are toxic in 8 of 100: flagged rows have the wanted precision among them."""
    net = toxicity.Network(SMALL).start()
    net.weights = {k: np.zeros_like(v) for k, v in net.weights.items()}
    net.weights["filter1"][0, 0, 0] = net.weights["out"][0] = 1
    net.weights["base"][0] = -6
    words = [c * 6 for c in "abcdefghijkl"]
    for level, w in enumerate(words):
        net.weights["embedding"][list(toxicity.features(w.encode(), SMALL.rows)), 0] = level
    monkeypatch.setattr(toxicity, "train", lambda *a: net)
    r = np.random.default_rng(2)
    toxic = (np.arange(3000) % 100 < 8).astype(int)
    level = np.clip(np.round(r.normal(np.where(toxic, 8, 3.5), 1.5)), 0, 11).astype(int)
    labels = spark.createDataFrame(list(zip(range(3000), toxic.tolist())), "doc_id long, toxic int")
    langs = ["de" if i % 7 == 0 else "fr" if i in (9, 10, 11) else "en" for i in range(3000)]
    docs = make_docs([words[x] for x in level], langs=langs)
    sample = toxicity.Settings(per_label=40)
    net, limits = toxicity.fit(docs, labels, sample)
    score = toxicity.scores(net, docs.toPandas()["text"].tolist())
    flagged = score >= np.array([limits[x] for x in langs])
    assert toxic[flagged].mean() > 0.87 and flagged[toxic == 1].mean() > 0.3
    # of three labelled rows a language learns nothing
    assert set(limits) == {"de", "en", "fr"} and 0.5 < limits["fr"] < 1
