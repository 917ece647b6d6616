import random

import numpy as np

from lodestrata.llm import probminhash as P


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    values = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = np.sort(values[:220]), np.sort(values[60:])
    wa, wb = 1 + rng.random(len(a)) * 4, 1 + rng.random(len(b)) * 4
    row = np.repeat([0, 1], [len(a), len(b)])
    got = P.signatures(row, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    exact = P.similarity(a, wa, b, wb)[1]
    want = sum(1 / sum(max(xa.get(k, 0) / xa[i], xb.get(k, 0) / xb[i]) for k in {*xa, *xb}) for xa, xb in [(dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb)))] for i in {*xa} & {*xb})
    assert abs(exact - want) < 1e-9
    assert abs((got[0] == got[1]).mean() - exact) < 4 * (exact * (1 - exact) / 4000) ** 0.5


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def test_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rng = random.Random(9)
    passage = words(rng, 60)
    docs = {}
    for group in range(6):
        base = words(rng, 120)
        for copy in range(12 if group else 60):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
                own[rng.randrange(120)] = rng.choice(passage)
            docs[len(docs)] = " ".join(own)
    for _ in range(60):
        docs[len(docs)] = " ".join(words(rng, rng.randint(0, 80)) + passage * rng.randint(0, 1))
    docs |= {len(docs) + k: t for k, t in enumerate(["", " ", "a b", "a  b", "one"])}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.split()) else set() for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(docs)
    for x in ids:
        for y in ids[:x]:
            alike = docs[x].split() == docs[y].split() or len(sets[x] & sets[y]) >= 0.8 * max(1, len(sets[x] | sets[y]))
            if alike and root(x) != root(y):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    rows = [(i, t, 5) for i, t in docs.items()] + [(900, None, 1), (None, docs[0], 1), (0, docs[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int").repartition(3)
    got = P.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id.pop(None) == root(0) and by_id.pop(900) == 900
    assert by_id == {i: root(i) for i in ids}


def test_empty(spark):
    assert P.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_of_other_repeat_counts(spark):
    rng = random.Random(3)
    docs = []
    for k in range(30):
        base, passage = words(rng, 20), words(rng, 10)
        docs += [(2 * k, " ".join(base + passage * 100)), (2 * k + 1, " ".join(base + passage))]
    got = P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i, _ in docs}


def test_weighted_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = random.Random(4)
    docs = []
    for _ in range(12):
        base, passage = words(rng, 60), words(rng, 8)
        docs += [" ".join(base + passage * k) for k in (1, 1, 2, 3, 6)] + [" ".join(base[:50] + words(rng, 10) + passage)]
    for weighting in ("log", "count"):
        sets = [P._set_of(t, weighting) for t in docs]
        parent = list(range(len(docs)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for x in range(len(docs)):
            for y in range(x):
                if P.similarity(*sets[x], *sets[y])[1] >= 0.8 and root(x) != root(y):
                    parent[max(root(x), root(y))] = min(root(x), root(y))
        got = P.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), weighting=weighting).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in range(len(docs))}
        ids, own = list(range(len(docs))), list(range(len(docs)))
        links = P.joining_links(ids, own, [s for s, _ in sets], [w for _, w in sets])
        assert len({root(i) for i in ids}) == len(docs) - len(links)


def test_recall_against_all_pairs(spark):
    """Every pair of 0.8 or more of the table, found by shared shingles, is linked."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in zip(docs.doc_id, docs.text)}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k]}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.class_id for r in P.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.999 * len(near)


def test_rows_without_an_id(spark):
    rows = [(None, "one two three four five six seven"), (None, "one two three four five six seven"), (4, "one two  three four five six seven"), (None, "something else entirely"), (None, None)]
    got = P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id == 4) for r in got) == [(0, False), (0, False), (0, True), (0, True), (4, True)]
    assert all(r.class_id == 4 or r.class_id >= P.UNNAMED for r in got)


def test_long_regular_words_are_told_apart():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    assert P._set_of(a, "set")[0].tolist() != P._set_of(b, "set")[0].tolist()


def test_wide_buckets_lose_no_link(spark, monkeypatch):
    # documents that share one band alone met no more once their bucket was wide
    monkeypatch.setattr(P, "BLOCK", 4)
    rng = random.Random(21)
    passage = words(rng, 40)
    docs = [" ".join(words(rng, 50) + passage) for _ in range(30)]
    for k in (0, 7, 11):
        own = docs[k].split()
        own[3] = own[60] = "changed"
        docs.append(" ".join(own))
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    members = texts.selectExpr("1L AS bucket", "doc_id", "doc_id AS own")
    for weighting in ("set", "count"):
        sets = [P._set_of(t, weighting) for t in docs]
        want = {(a, b) for b in range(len(docs)) for a in range(b) if P.alike(sets[a], sets[b], weighting) >= 0.8}
        assert want == {(0, 30), (7, 31), (11, 32)}
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in P.across_components(members, texts, weighting=weighting).collect()} == want


def test_texts_that_are_not_wanted_are_not_shuffled(spark):
    # all texts were shuffled three times over before
    texts = spark.range(-500, 4500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    wanted = texts.where("doc_id % 50 = 0").selectExpr("doc_id").unionAll(spark.range(9000, 9010).toDF("doc_id"))
    got = {r.doc_id for r in P.of_wanted(texts, wanted).collect()}
    assert set(range(-500, 4500, 50)) <= got and len(got) < 110
    assert P.of_wanted(texts, wanted.limit(0)).count() == 0
    assert P.of_wanted(texts, texts).count() == 5000


def test_compared_pairs_do_not_meet_again(spark, monkeypatch):
    # the first document of a bucket, which is compared with all others, met them again before
    rng = random.Random(23)
    base = words(rng, 200)
    near = [*base[:170], *words(rng, 30)]  # about 0.74 like the base
    other = [*near[:190], "changed", *near[191:]]  # over 0.9 like the last
    docs = [(3, " ".join(base)), (5, " ".join(near)), (7, " ".join(other))]
    seen, across = [], P.across_components

    def kept(members, *more):
        seen.append(P._open_groups(members).count())
        return across(members, *more)

    monkeypatch.setattr(P, "across_components", kept)
    for n, want in ((2, {3: 3, 5: 5}), (3, {3: 3, 5: 5, 7: 5})):
        got = P.near_duplicates(spark.createDataFrame(docs[:n], "doc_id long, text string")).collect()
        assert {r.doc_id: r.class_id for r in got} == want and seen.pop() == 0
