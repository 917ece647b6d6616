import math
import random

import duckdb
from pyspark.sql import functions as F

from lodestrata.llm import op6, quality


def fixture(n=400):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "étui", "zeta"]
    docs, labels = [(0, None, "en"), (1, "", None), (2, " \n\t\n", "en"), (3, "a b c a b c", "de"), (4, "x\nx\n\nx", "de")], []
    for k in range(5, n):
        bad = rng.random() < 0.3
        body = [rng.choice(words) + str(rng.randint(0, 999)) + ("###" if bad else "") for _ in range(rng.randint(40, 90))]
        docs.append((k, rng.choice([" ", "\n", "\t"]).join(body) + "\nline\nline", rng.choice(["en", "de", None])))
        labels.append((k, int(not bad), 0))
    return docs, labels


def test_against_sql(spark):
    docs, labels = fixture()
    labels += [(5, 1, 0), (10**9, 0, 0), (None, 0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("cutoffs", F.lit(1))
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(d, lb).collect()}
    db = duckdb.connect()
    db.register("documents", d.toPandas())
    db.register("labels", lb.toPandas())
    want = db.execute(op6.ORACLE_SQL["op6_quality_rules"]).fetchall()
    names = [c[0] for c in db.description]
    assert len(want) == len(got) == len(docs)
    for row in want:
        r = dict(zip(names, row))
        assert {n: got[r["doc_id"]][n] for n in names} == r
    kept = {r.doc_id for r in quality.judge(d, lb, max_false_rejection=0.4).where("kept").collect()}
    bad = {i for i, q, _ in labels if q == 0}
    assert not kept & bad and len(kept) > 150


def test_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 7, 300, 5000) for k in (0, 1, 5, 40) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for r in got:
        exact = sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - (1.0 if r.k >= r.n * 0.02 else exact)) < 1e-9


def test_no_labels_and_no_rows(spark):
    docs, _ = fixture(30)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality.judge(d, none).collect())
    assert quality.judge(d.where("false"), none).count() == 0
