import random
import struct

import pytest
import xxhash

from lodestrata.llm import winnow

MASK = (1 << 64) - 1


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def upper(h):
    return h >> 32 & (1 << 31) - 1


def gram(part):
    """The polynomial of the rolling hash, term by term."""
    out = 0
    for c in part:
        out = (out << 1 & MASK) ^ xxhash.xxh64(c.encode(), seed=42).intdigest()
    return out


def brute(text):
    if not text:
        return []
    if len(text) < winnow.K:
        grams = [upper(xxhash.xxh64(text.encode(), seed=42).intdigest())]
    else:
        grams = [upper(gram(text[i : i + winnow.K])) for i in range(len(text) - winnow.K + 1)]
    kept = []
    for i in range(max(1, len(grams) - winnow.W + 1)):
        window = grams[i : i + winnow.W]
        at = max(j for j, g in enumerate(window) if g == min(window)) + i
        if not kept or kept[-1][1] != at:
            kept.append((grams[at], at))
    return [(g << 32) + (1 << 32) - 1 - at for g, at in kept]


def jaccard(a, b):
    a, b = {x >> 32 for x in a}, {x >> 32 for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def texts_of(rng):
    texts = ["", None, "  \n", "one", "sixteen letters!", "Été\tà la  mer " * 20, "a" * 300, "ab" * 90, "日本語の文章" * 40, "😀é" * 60]
    texts += ["".join(rng.choice("abcdeé 😀\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    # long ones, whose edits keep grams of the next text, ties included
    texts += ["".join(rng.choice("abé 😀\n" if k % 2 else "ab") for _ in range(rng.randint(500, 1500))) for k in range(60)]
    return texts + ["a" * 1200, "ab" * 700, "日本語の文章" * 150]


@pytest.mark.parametrize("chunk", [64, 1 << 12])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(winnow, "RUN_DOCS", 7)
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    rng = random.Random(5)
    texts = texts_of(rng)
    ids = rng.sample(range(-500, 500), len(texts) - 1) + [10**15]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, kept int").repartition(3)
    got = {r.doc_id: r for r in winnow.edit_and_fingerprint(df).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, text) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + follow[:q]
        assert got[i].edited == edited
        assert got[i].kept == brute(text) and got[i].edited_kept == brute(edited)
        assert abs(got[i].near_edited - jaccard(brute(text), brute(edited))) < 1e-12
        assert abs(got[i].near_next - jaccard(brute(text), brute(follow))) < 1e-12


def test_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(winnow, "RUN_DOCS", 5)
    rows = [(None, f"null {k} of some length or other") for k in range(40)] + [(3, f"hot {k} of some length or other") for k in range(60)] + [(k, f"cold {k}") for k in range(-20, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, _ = winnow.runs(df)
    sizes = [r["count"] for r in dealt.groupBy("segment", "part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 20
    order = sorted(((-(1 << 63) if i is None else i), signed(xxhash.xxh64(t.encode(), seed=42).intdigest()), t) for i, t in rows)
    want = sorted((None if i == -(1 << 63) else i, t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][2][: len(t) // 4]) for k, (i, _, t) in enumerate(order) if i > -(1 << 63))
    got = winnow.edit_and_fingerprint(df).select("doc_id", "edited").collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.edited) for r in got if r.doc_id is not None) == want


def test_repeated_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "x y z"), (1, "a b c d"), (1, "a b c d"), (2, None)], "doc_id long, text string")
    got = winnow.edit_and_fingerprint(df).collect()
    assert len(got) == 4
    assert {tuple(r.kept) for r in got if r.doc_id == 1} == {tuple(brute("a b c d"))}
    assert winnow.edit_and_fingerprint(df.where("false")).count() == 0


def test_match_guarantee(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(winnow.K + winnow.W - 1))
    df = spark.createDataFrame([(1, f"some start {shared} and an end"), (2, f"quite another{shared}")], "doc_id long, text string")
    rows = winnow.add_fingerprint(df, "text", "kept")
    a, b = rows.select(winnow.hashes(rows["kept"]).alias("h"), winnow.positions(rows["kept"]).alias("p"), "text").collect()
    common = set(a.h) & set(b.h)
    assert common
    for h in common:
        i, j = a.p[a.h.index(h)], b.p[b.h.index(h)]
        assert a.text[i : i + winnow.K] == b.text[j : j + winnow.K]


def test_a_long_text_without_spaces_and_its_edit(spark):
    rng = random.Random(4)
    made = ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(n)) for n in (1600, 900, 2_000_000)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in winnow.edit_and_fingerprint(df).collect()}
    for r in got.values():
        assert 0.5 < r.near_edited < (0.72 if r.doc_id < 2 else 0.78) and r.near_next < 0.05  # the last one gets few new characters
    assert max((1 << 32) - 1 - (p & (1 << 32) - 1) for p in got[2].kept) > 1_990_000
