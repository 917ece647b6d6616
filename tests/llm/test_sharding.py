import random
import zlib
from collections import Counter

import pytest

from lodestrata.llm import sharding


def run(spark, rows, shards=24):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sharding.shard(df.repartition(3), shards=shards).collect()


def check(rows, got, shards=24):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    counts = Counter(r.shard for r in got)
    assert all(0 <= s < shards for s in counts)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("bins", [50_000, 20])
def test_even_counts_and_groups_together(spark, monkeypatch, bins):
    monkeypatch.setattr(sharding, "RANK_ROWS", bins)
    rng = random.Random(1)
    texts = ["hot"] * 100 + [f"t{k}" for k in range(12) for _ in range(rng.randint(2, 4))]
    texts += [None, None, ""] + [f"single {k}" for k in range(150)]
    rows = list(enumerate(texts))
    got = run(spark, rows, 8)
    check(rows, got, 8)
    text = dict(rows)
    shards = {}
    for r in got:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
        body = (text[r.doc_id] or "").encode()
        assert r["size"] == len(body) + 8 and r.text_crc32 == zlib.crc32(body)
    small = [t for t in shards if t and t.startswith("t")]
    assert sum(len(shards[t]) > 1 for t in small) <= 1
    assert len(shards["hot"]) <= 5  # at most 36 rows a shard


def test_all_rows_linked(spark):
    rows = [(k, f"t{k % 10}") for k in range(200)]
    check(rows, run(spark, rows, 7), 7)


def test_small_odd_tables(spark):
    for rows in ([], [(1, "a")], [(None, "a"), (None, "a"), (3, None)], [(5, "x")] * 50):
        check(rows, run(spark, rows, 5), 5)


def split_groups(rows, got):
    text, shards = dict(rows), {}
    for r in got:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    return {t: len(s) for t, s in shards.items() if len(s) > 1}


def test_all_pairs_stay_together(spark):
    rows = [(k, f"t{k % 240}") for k in range(480)]
    got = run(spark, rows)
    check(rows, got)
    assert split_groups(rows, got) == {}


def test_a_third_in_one_group(spark):
    rows = [(k, "hot" if k < 800 else f"t{k % 300}" if k < 1400 else f"single {k}") for k in range(2400)]
    got = run(spark, rows)
    check(rows, got)
    assert split_groups(rows, got) == {"hot": 8}


def test_swaps_make_groups_whole():
    plan = sharding.placed({4: 2, 3: 4}, [10, 10])
    assert all(len(pieces) == 1 for runs in plan.values() for _, pieces in runs)
    rng = random.Random(4)
    for _ in range(200):
        sizes = Counter(rng.randint(2, 30) for _ in range(rng.randint(1, 60)))
        total = sum(n * c for n, c in sizes.items()) + rng.randint(0, 20)
        share = [total // 7 + (j < total % 7) for j in range(7)]
        plan = sharding.placed(sizes, share)
        held = Counter()
        for n, runs in plan.items():
            assert sum(c for c, _ in runs) == sizes[n] and all(sum(r for _, r in p) == n for _, p in runs)
            for c, pieces in runs:
                for j, r in pieces:
                    held[j] += c * r
        assert all(held[j] <= share[j] for j in held)


def cut_edges(shard, edges):
    return sum(shard[a] != shard[b] for a, b in edges)


def as_links(spark, edges):
    rows = [(i, f"e{k}") for k, e in enumerate(edges) for i in e]
    return spark.createDataFrame(rows, "doc_id long, grp string")


def test_propagation_finds_communities(spark):
    rng = random.Random(6)
    n, shards, size = 72, 3, 24
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < (0.25 if a // size == b // size else 0.004)]
    rows = [(i, f"text {i}") for i in range(n)] + [(1000 + i, f"free {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard(df, shards=shards, links=as_links(spark, edges)).collect()
    check(rows, got, shards)
    dealt = sum(rng.randrange(shards) != rng.randrange(shards) for _ in edges)
    assert cut_edges({r.doc_id: r.shard for r in got}, edges) < 0.7 * dealt


def test_propagation_against_all_balanced_cuts(spark):
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(3):
        edges = list({tuple(rng.sample(range(4), 2)) for _ in range(5)} | {tuple(x + 4 for x in rng.sample(range(4), 2)) for _ in range(5)} | {(0, 4)})
        rows = [(i, f"text {i}") for i in range(8)]
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=2, links=as_links(spark, edges)).collect()
        check(rows, got, 2)
        best = min(cut_edges({i: i in half for i in range(8)}, edges) for half in combinations(range(8), 4))
        worst = max(cut_edges({i: i in half for i in range(8)}, edges) for half in combinations(range(8), 4))
        assert best <= cut_edges({r.doc_id: r.shard for r in got}, edges) <= (best + worst) / 2


def test_propagation_never_loses_links(spark):
    rng = random.Random(3)
    labels = [(i, rng.randrange(4)) for i in range(80)]
    links = [(i, f"g{rng.randrange(20)}") for i in range(80) for _ in range(2)]
    args = spark.createDataFrame(labels, "node long, shard int"), spark.createDataFrame(links, "node long, group string")
    out, before, after = sharding.propagate(*args, 100, 4)
    shard, groups = {r.node: r.shard for r in out.collect()}, {}
    for i, g in set(links):
        groups.setdefault(g, []).append(i)
    together = lambda by: sum(by[a] == by[b] for m in groups.values() for k, a in enumerate(m) for b in m[:k])
    assert (before, after) == (together(dict(labels)), together(shard)) and after > before
    held = Counter(shard.values())
    assert max(held.values()) <= max(25, *Counter(s for _, s in labels).values())


def test_quotas_swap_and_fill_room():
    may = sharding.quotas({(0, 1): {0: 3, 2: 4}, (1, 0): {1: 5}, (2, 0): {0: 9}}, [2, 0, 0])
    assert may == {(0, 1, 2): 4, (0, 1, 0): 1, (1, 0, 1): 5, (2, 0, 0): 2}


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, f"t{k % 3}", 1, 2, "x") for k in range(30)], "doc_id long, text string, shard int, node int, `group` string")
    assert len(sharding.shard(df, shards=4).collect()) == 30
