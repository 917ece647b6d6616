import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == names
        seen.append(kept.count())
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] < seen[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
    assert set(pieces.doc_id) == {r.doc_id for r in kept.select("doc_id").distinct().collect()}
    assert (np.array([len(x) for x in pieces.ids]) == 4 * pieces.length).all()


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, "word " * 60, None, None, None), (1, None, "en", "s", 1), (2, "", "en", None, 0), (3, " ".join(f"w{k}" for k in range(80)), "en", "s", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
    assert corpus_pipeline.near_dedup(spark, docs, SF).where("doc_id = 3").count() == 1
    assert corpus_pipeline.quality_rules(spark, docs, SF).where("doc_id = 3").count() == 2


def test_columns_of_any_name_are_handed_on(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"{text} {k} x{k} y{k} z{k}", "en", "s", 1, 7, 8, 9, 10, 11) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, _id int, _known int, _times int, _one int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert {(r._row, r._id, r._known, r._times, r._one) for r in got.collect()} == {(7, 8, 9, 10, 11)}


def test_rows_without_an_id_are_deduplicated(spark):
    text, other = (" ".join(f"{c}{k}" for k in range(80)) for c in "wv")
    docs = spark.createDataFrame([(None, text), (None, text), (3, text), (None, other), (None, other)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text == text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [(0, False), (3, True)]


def test_run_is_its_stages(spark):
    """End to end against the stages called one after the other, and every id in one piece."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    tokens = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(tokens.encode(r.text or "", add_special_tokens=False).ids + [1])
    for doc, own in pieces.groupby("doc_id"):
        ids, copies = want[doc][0], len(want.pop(doc))
        assert own["length"].sum() == copies * len(ids)
        for p in own.itertuples():
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length]
    assert not want
