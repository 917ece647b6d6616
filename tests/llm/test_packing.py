import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestrata.llm import packing
from lodestrata.llm.bpe import Encoder

RANKS = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    return Tokenizer.from_file(RANKS)


def odd_texts():
    rng = random.Random(3)
    texts = ["don't it's we'll I'd 'sx ''s a 's x'Re they've\n'll  'm", "  a  \n b\t\tc \n", "", None, "é 　x 12a3 ½!?  ", "<|endoftext|> x", "日本語 です。😀😀 a"]
    texts += ["a<|endoftext|>", "<|endoftext|><|endoftext|>", "don<|endoftext|>'t  <|endoftext|>  x<|endoftext", "|>", "<|endoftext", "|><|endof"]
    texts += ["<|endoftext|>".join("".join(rng.choice(" '\nsé1<|>") for _ in range(rng.randint(0, 9))) for _ in range(4)) for _ in range(80)]
    return texts + ["".join(rng.choice(" \n\t'stmdrevl1a!é .") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_ids_are_the_library_s():
    texts, encoder = odd_texts(), Encoder(RANKS)
    for _ in range(2):  # the second time from the table
        got = []
        for first, end, ids, offsets in encoder.batches(pa.array(texts)):
            got += [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(end - first)]
        assert got == [x.ids for x in reference().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_hash_are_told_apart():
    a, b = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    encoder, want = Encoder(RANKS), reference()
    for texts in ([a], [b], [a, b]):
        got = [ids[offsets[i] : offsets[i + 1]].tolist() for first, end, ids, offsets in encoder.batches(pa.array(texts)) for i in range(end - first)]
        assert got == [x.ids for x in want.encode_batch(texts, add_special_tokens=False)]


def test_a_small_table_that_is_emptied(monkeypatch):
    from lodestrata.llm import bpe

    for name, size in (("TABLE_SLOTS", 64), ("POOL_IDS", 300), ("POOL_BYTES", 500)):
        monkeypatch.setattr(bpe, name, size)
    encoder, want, texts = bpe.Encoder(RANKS), reference(), odd_texts()
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        got = [ids[offsets[i] : offsets[i + 1]].tolist() for first, end, ids, offsets in encoder.batches(pa.array(part)) for i in range(end - first)]
        assert got == [x.ids for x in want.encode_batch([t or "" for t in part], add_special_tokens=False)]


def test_ids_of_a_table_are_the_library_s(spark):
    import zlib

    from lodestrata.llm.op5 import op5_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    want = {i: np.array([*e.ids, 1], dtype="<u4") for i, e in zip(docs.doc_id, reference().encode_batch([t or "" for t in docs.text], add_special_tokens=False))}
    got = op5_packing(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())


def test_repeated_rows_are_spread(spark):
    df = spark.range(0, 400, 1, 4).selectExpr("7L as doc_id", "'same words' as text", "'x' as ids", "1 as sequence_id")
    got = packing.pack(df, RANKS, group_docs=100).collect()
    assert len(got) == 400 and len({r.sequence_id >> 32 for r in got}) > 1


def test_first_fit_decreasing_against_brute_force():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        bins, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((k for k, used in enumerate(bins) if used + sizes[i] <= 40), None)
            if at is None:
                at = len(bins)
                bins.append(0)
            want[i] = (at, bins[at])
            bins[at] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 40) == want


def test_pieces_hold_every_id_once(spark):
    texts = [t for t in odd_texts()][:60] + ["word " * 5000, "word " * 5000]
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts)]
    rows[-1] = rows[-2]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    got = packing.pack(df, RANKS, capacity=256, group_docs=20).collect()
    tokens = reference()
    want = sorted((i or -1, tokens.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id or -1, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, ids in want:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        copies = sum(j == i for j, _ in want)
        assert sum(r.length for r in pieces) == copies * len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(df.where("false"), RANKS).count() == 0
