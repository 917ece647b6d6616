import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import mixing


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.2, 0.1], 500)
    rows = [(i, int(rng.integers(0, 300)), *map(float, p[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p_a double, p_b double, p_c double")
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    steps = mixing.fit_rates(df, ["a", "b", "c"], weights)
    r = np.array([x.r for x in df.withColumn("r", mixing.rate(["a", "b", "c"], steps)).orderBy("doc_id").collect()])
    t = np.array([x[1] for x in rows])
    total = (p * t[:, None]).sum()
    assert (r >= 0).all()
    assert np.abs((p * (t * r)[:, None]).sum(axis=0) - np.array([0.6, 0.3, 0.1]) * total).max() < 1e-4 * total
    own = np.ones(500)  # the same descent with numpy
    gram = (p * t[:, None]).T @ p
    gram = np.linalg.inv(gram + np.eye(3) * mixing.RIDGE * np.trace(gram) / 3)
    for _ in steps:
        own = np.clip(own - p @ (gram @ ((p * (t * own)[:, None]).sum(axis=0) - np.array([0.6, 0.3, 0.1]) * total)), 0, mixing.MAX_RATE)
    assert np.allclose(own, r)
    assert mixing.fit_rates(df, ["a", "b", "c"], {"a": 0.01, "b": 0.49, "c": 0.5}, anchor="a", at_most=("b", "c")) == []
    anchored = mixing.fit_rates(df, ["a", "b", "c"], weights, anchor="a")
    kept = df.withColumn("r", mixing.rate(["a", "b", "c"], anchored)).agg(F.sum(F.col("tokens") * F.col("r") * F.col("p_a"))).first()[0]
    assert abs(kept - (p[:, 0] * t).sum()) < 1e-4 * total


def test_classifier_and_copies(spark):
    rng = random.Random(5)
    kinds = {"x": ["sonne", "mond", "sterne"], "y": ["river", "lake", "ocean"]}
    docs = [(k, " ".join(rng.choice(kinds["xy"[k % 2]]) + rng.choice("abc") for _ in range(20))) for k in range(200)]
    docs += [(500, None), (501, ""), (None, "river lakeb oceana")]
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, rate double")
    labelled = spark.createDataFrame([(k, "xy"[k % 2]) for k in range(100)] + [(3, "y"), (None, "x"), (7, "other")], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(d, labelled, {"x": 0.75, "y": 0.25}).collect()}
    assert len(got) == len(docs)
    for k in range(200):
        assert (got[k].p_x > 0.5) == (k % 2 == 0) and abs(got[k].p_x + got[k].p_y - 1) < 1e-9
        assert abs(got[k].copies - got[k].rate) < 1 and got[k].tokens == 20
    assert got[500].tokens == 0 and got[500].p_x == got[501].p_x
    assert mixing.mix(d.where("false"), labelled, {"x": 0.5, "y": 0.5}).count() == 0


def test_rare_domains_meet_their_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([3.0, 0.03, 0.03], 600)
    df = spark.createDataFrame([(i, 100, *map(float, p[i])) for i in range(600)], "doc_id long, tokens long, p_a double, p_b double, p_c double")
    weights = {"a": 0.6, "b": 0.2, "c": 0.2}
    steps = mixing.fit_rates(df, list(weights), weights)
    mixed = df.withColumn("rate", mixing.rate(list(weights), steps))
    assert mixed.agg(F.min("rate")).first()[0] >= 0 and mixed.agg(F.max("rate")).first()[0] > 2
    found = mixing.totals(mixed, weights)
    assert found[2][1] < 0.05 * 60_000
    for domain, _, expected, target in found:
        assert abs(expected - target) < 1e-4 * 60_000, (domain, found, len(steps))
