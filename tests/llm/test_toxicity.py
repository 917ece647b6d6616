import random

import numpy as np

from lodestrata.llm import toxicity


def corpus(n=600):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefgho") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.25
        parts = [" ".join(rng.choice(names) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(2, 8))]
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += " " + rng.choice(["Zornkopf", "zornei", "VILEX", "vilexen"])
        docs.append((k, ". ".join(parts) + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_learns_from_documents_and_finds_the_sentence(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels[:400] + [(0, labels[0][1]), (None, 1)], "doc_id long, toxic int"))
    odd = [(1000, None), (1001, ""), (1002, "A new word of zornling. And a clean one."), (None, "x"), (1003, "vilexa " * 3000)]
    got = {r.doc_id: r for r in toxicity.score(d.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), model).collect()}
    assert len(got) == len(docs) + 5
    for k, toxic in labels[400:]:
        assert (got[k].score >= 0.3) == bool(toxic)
        for span in got[k].offending:
            assert any(w in docs[k][1][span.start : span.end].lower() for w in ("zorn", "vilex"))
        assert bool(got[k].offending) == bool(toxic)
    assert 0 <= got[1000].score < 0.3 and got[1000].score == got[1001].score
    assert got[1003].score > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.without_toxic(d, model, 0.3)
    assert kept.columns == d.columns and kept.count() == sum(got[k].score < 0.3 for k, _ in docs)


def test_noisy_or_against_brute_force():
    data = np.frombuffer("a b. c! d".encode(), np.uint8)
    starts, rows = toxicity._sentences(data, np.array([0, 0, 4, 9]))
    assert rows.tolist().count(0) == 1 and sorted(set(rows.tolist())) == [0, 1, 2]


def test_one_class_or_none(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r.score < 0.3 for r in toxicity.score(d, model).collect())
    assert toxicity.score(d.where("false"), model).count() == 0


def test_scores_are_the_noisy_or_of_sentences(spark):
    import math
    import re

    rng = np.random.default_rng(4)
    vocabulary = ["vile", "awful", "words", "tea", "house", "ok", "grim"]
    buffer = " ".join(vocabulary).encode()
    data = np.frombuffer(buffer, dtype=np.uint8)
    starts, kinds, _ = toxicity.word_features(data, np.array([0, len(data)]))
    weight = dict(zip(vocabulary, rng.random(len(vocabulary)) * 4))
    order = np.argsort(kinds[0])
    model = toxicity.Model(kinds[0][order], np.array([weight[w] for w in vocabulary])[order], -3.0)
    texts = ["", None, "...", "Vile tea. OK house! grim grim?\nwords"] + [" ".join(rng.choice([*vocabulary, "x.", "y!", "z"], rng.integers(0, 40))) for _ in range(30)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        clean = 1.0
        for sentence in re.split(r"(?<=[.!?\n\r])", (text or "").lower()):
            z = -3.0 + sum(weight.get(w, 0.0) for w in re.findall("[a-z0-9]+", sentence))
            clean *= 1 - 1 / (1 + math.exp(-z)) if sentence or not text else 1.0
        assert abs(got[i] - (1 - clean)) < 1e-9, text


def test_slopes_against_brute_force():
    rng = np.random.default_rng(7)
    bag = np.repeat(np.arange(6), [1, 3, 2, 4, 1, 2])
    rows, columns = rng.integers(0, len(bag), 30), rng.integers(0, 5, 30)
    y, share = np.array([1, 0, 1, 1, 0, 0]), rng.random(6)

    def loss(w):
        total = 0.0
        for i in range(6):
            clean = 1.0
            for s in np.flatnonzero(bag == i):
                clean *= 1 - 1 / (1 + np.exp(-(w[-1] + w[columns[rows == s]].sum())))
            total -= share[i] * np.log(1 - clean if y[i] else clean)
        return total

    w = rng.normal(size=6)
    value, slope = toxicity.slopes(w[:-1], w[-1], rows, columns, bag, y, share)
    assert np.isclose(value, loss(w))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert np.isclose((loss(w + step) - loss(w - step)) / 2e-6, slope[k], atol=1e-6)


def test_repeated_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(k % 40, "awful vile words" if k % 4 == 0 else f"tea house {k}", 1, "x") for k in range(120)], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 120 and all((r.score > 0.3) == (r.doc_id % 4 == 0) for r in got)
    kept = toxicity.without_toxic(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 90
