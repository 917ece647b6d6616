"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words and
word prefixes; a document's is the noisy-or of its sentences', 1 - prod(1 - p). Only document
labels are needed: the gradient of a toxic document flows to the sentences that explain it.
Weights are non-negative and L1-penalised, so a few telling words remain and every score can
be traced to the sentences that carry it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textvec
from lodestrata.llm.session import cut

#: Labelled rows of each class that are fitted on at most: the first by a hash of their id.
SAMPLE_PER_CLASS = 2500
#: Prefix lengths, in bytes, that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: Features seen in fewer toxic documents, or less over-represented there, are left out.
MIN_TOXIC_DOCS, MIN_RATIO = 4, 6.0
#: Features that are fitted on at most: those in most toxic documents.
MAX_FEATURES = 1 << 17
#: A sentence from this score on is reported as offending.
OFFENDING = 0.5
_MAP_BITS = 22
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and row numbers of all sentences; every row has one at least."""
    after = np.flatnonzero(_ENDS[data]) + 1
    starts = np.union1d(offsets[:-1], after)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    inside = (starts < offsets[1:][np.minimum(rows, len(offsets) - 2)]) & (rows < len(offsets) - 1)
    empty = np.flatnonzero(offsets[:-1] == offsets[1:])
    starts, rows = np.append(starts[inside], offsets[empty]), np.append(rows[inside], empty)
    order = np.argsort(rows, kind="stable")
    return starts[order], rows[order]


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Word starts, and for each kind of feature its hashes and the words that have it."""
    starts, ends = textvec.spans(data, offsets, textvec.LETTER)
    hasher = textvec.Hasher(data)
    kinds, owners = [hasher(starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts >= k)
        kinds.append(hasher(starts[long], starts[long] + k) ^ np.uint64(k << 56 | k))
        owners.append(long)
    return starts, kinds, owners


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): the documents of a batch that have each feature, by label."""
    for got in batches:
        lower, toxic = pc.utf8_lower(got.column(1)), got.column(0).to_numpy(zero_copy_only=False)
        found = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
        for first, end, data, offsets in textvec.slices(lower):
            starts, kinds, owners = word_features(data, offsets)
            hashes, row = np.concatenate(kinds), (np.searchsorted(offsets, starts, side="right") - 1)[np.concatenate(owners)]
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            for y in (0, 1):
                found[y].append(hashes[new][toxic[first + row[new]] == y])
        names, inverse = np.unique(np.concatenate([*found[0], *found[1]]), return_inverse=True)
        clean = sum(map(len, found[0]))
        counts = [np.bincount(inverse[part], minlength=len(names)) for part in (slice(clean, None), slice(clean))]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *map(pa.array, counts)], ["feature", "toxic", "clean"])


def _extract(telling: np.ndarray):
    """(doc_id, toxic, sentences, features: those of ``telling``, at: each one's sentence) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            lower = pc.utf8_lower(got.column(2))
            docs, labels, out = got.column(0).to_pylist(), got.column(1).to_pylist(), []
            for first, end, data, offsets in textvec.slices(lower):
                sentence, rows = _sentences(data, offsets)
                starts, kinds, owners = word_features(data, offsets)
                hashes, word = np.concatenate(kinds), np.concatenate(owners)
                if len(telling):
                    wanted = telling[np.minimum(np.searchsorted(telling, hashes), len(telling) - 1)] == hashes
                    hashes, word = hashes[wanted], word[wanted]
                else:
                    hashes, word = hashes[:0], word[:0]
                at = np.searchsorted(sentence, starts[word], side="right") - 1
                order = np.argsort(at, kind="stable")
                hashes, at = hashes[order], at[order]
                lo, hi = np.searchsorted(rows, np.arange(end - first)), np.searchsorted(rows, np.arange(end - first), side="right")
                cut_ = np.searchsorted(at, np.append(lo, hi[-1:]))
                for i in range(end - first):
                    mine = slice(cut_[i], cut_[i + 1])
                    out.append((docs[first + i], labels[first + i], int(hi[i] - lo[i]), hashes[mine].tobytes(), (at[mine] - lo[i]).astype(np.int32).tobytes()))
            if out:
                kinds_ = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)], ["doc_id", "toxic", "sentences", "features", "at"])

    return run


@dataclass
class Model:
    """Feature hashes in order, their weights, and the score (logit) of a sentence with none."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def slopes(weight: np.ndarray, bias: float, rows: np.ndarray, columns: np.ndarray, bag: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of the noisy-or of bags and its derivatives by the weights and, last, the bias.

    ``rows``/``columns``: sentence and feature of each occurrence; ``bag``: the bag of each sentence.
    """
    p = _sigmoid(bias + np.bincount(rows, weight[columns], len(bag)))
    survive = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
    bag_p = np.clip(-np.expm1(survive), 1e-12, 1 - 1e-12)
    loss = -(share * np.where(y == 1, np.log(bag_p), survive)).sum()
    pull = share * np.where(y == 1, (1 - bag_p) / bag_p, -1.0)
    g = -pull[bag] * p
    return float(loss), np.append(np.bincount(columns, g[rows], len(weight)), g.sum())


def fit_bags(toxic: np.ndarray, share: np.ndarray, sentences: np.ndarray, features: list[np.ndarray], at: list[np.ndarray], l1: float = 2e-5, steps: int = 600) -> Model:
    """Fit on bags: labels, importance of each bag, sentence counts, chosen feature hashes, sentence of each."""
    none = np.zeros(0, dtype=np.uint64)
    if not len(toxic) or toxic.all() or not toxic.any():
        rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-4, 1 - 1e-4))
        return Model(none, np.zeros(0), float(np.log(rate / (1 - rate))))
    hashes = np.unique(np.concatenate(features))
    if not len(hashes):
        rate = float(np.average(toxic, weights=share))
        return Model(none, np.zeros(0), float(np.log(rate / (1 - rate))))
    base = np.cumsum(sentences) - sentences
    rows, columns = [], []
    for i, (f, s) in enumerate(zip(features, at, strict=True)):
        j = np.minimum(np.searchsorted(hashes, f), len(hashes) - 1)
        hit = hashes[j] == f
        rows.append(base[i] + s[hit])
        columns.append(j[hit])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    bag = np.repeat(np.arange(len(toxic)), sentences)
    y = toxic.astype(float)
    weight, bias = np.full(len(hashes), 0.5), -7.0
    grown = np.full(len(hashes) + 1, 1e-8)
    share = share / share.sum()
    for _ in range(steps):
        _, slope = slopes(weight, bias, rows, columns, bag, y, share)
        slope[:-1] += l1
        grown += slope**2
        step = 0.5 * slope / np.sqrt(grown)
        weight = np.maximum(0.0, weight - step[:-1])
        bias -= step[-1]
    kept = weight > 1e-3
    return Model(hashes[kept], weight[kept], float(bias))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` rows of ``labels`` (doc_id, toxic 0/1) of each class.

    The sample is the rows of least id hash. Of repeated ids the larger label and the largest text
    count; null ids and other labels are left out. Class shares are those of all of ``labels``.
    Texts are read whole; ids that are no whole numbers raise an error (ANSI).
    """
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in clean.groupBy("toxic").count().collect()}  # two rows
    picked = None
    for y in (0, 1):
        some = clean.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * per_class rows
    texts = cut(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))  # one row an id
    # features are chosen in Spark, so what comes to the driver are occurrences of telling ones alone
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    seen = texts.select("toxic", "text").mapInArrow(_count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("hits"), F.sum("clean").alias("misses"))
    often = (F.col("hits") + 0.5) / max(1, size.get(1, 0)) >= MIN_RATIO * (F.col("misses") + 0.5) / max(1, size.get(0, 0))
    chosen = seen.where((F.col("hits") >= MIN_TOXIC_DOCS) & often).orderBy(F.desc("hits"), "misses", "feature").limit(MAX_FEATURES)
    telling = np.sort(chosen.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    bags = texts.select("doc_id", "toxic", "text").mapInArrow(_extract(telling), "doc_id long, toxic int, sentences int, features binary, at binary").toArrow().sort_by("doc_id")
    toxic = bags["toxic"].to_numpy()
    share = np.array([counts[y] / max(1, int((toxic == y).sum())) for y in toxic.tolist()])
    return fit_bags(
        toxic,
        share,
        bags["sentences"].to_numpy(),
        [np.frombuffer(x.as_py(), dtype=np.uint64) for x in bags["features"]],
        [np.frombuffer(x.as_py(), dtype=np.int32) for x in bags["at"]],
    )


_SCORED = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - _MAP_BITS)
        maybe = np.zeros(1 << _MAP_BITS, dtype=bool)
        maybe[(model.hashes >> shift).astype(np.int64)] = True
        for got in batches:
            scores, found = np.zeros(len(got)), [[] for _ in range(len(got))]
            for first, end, data, offsets in textvec.slices(pc.utf8_lower(got.column(1))):
                sentence, rows = _sentences(data, offsets)
                starts, kinds, owners = word_features(data, offsets)
                logit = np.full(len(sentence), model.bias)
                for hashes, word in zip(kinds, owners, strict=True):
                    hit = np.flatnonzero(maybe[(hashes >> shift).astype(np.int64)]) if len(model.hashes) else []
                    if len(hit):
                        j = np.minimum(np.searchsorted(model.hashes, hashes[hit]), len(model.hashes) - 1)
                        true = model.hashes[j] == hashes[hit]
                        at = np.searchsorted(sentence, starts[word[hit[true]]], side="right") - 1
                        np.add.at(logit, at, model.weights[j[true]])
                p = _sigmoid(logit)
                scores[first:end] = -np.expm1(np.bincount(rows, np.log1p(-np.minimum(p, 1 - 1e-15)), end - first))
                bad = np.flatnonzero(p >= OFFENDING)
                if len(bad):
                    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    stops = np.append(sentence[1:], len(data))
                    for s in bad.tolist():
                        row = rows[s]
                        found[first + row].append({"start": int(lead[sentence[s]] - lead[offsets[row]]), "end": int(lead[min(stops[s], offsets[row + 1])] - lead[offsets[row]]), "score": float(p[s])})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(scores), pa.array(found, kind)], ["doc_id", "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1) and the offending sentences as spans of
    code points of the lower-cased text with their scores.

    Null or empty text: the score of one sentence without evidence. Very long texts are scored
    whole. Repeated rows are scored alike; null ids stay null; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score(model), _SCORED)


def without_toxic(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def plain() -> Iterator[pa.RecordBatch]:
            for got in batches:
                held.append(got)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int64()), got.column(got.schema.get_field_index(text))], ["doc_id", "text"])

        for scored in _score(model)(plain()):  # one batch out for each in
            yield held.pop().filter(pc.less(scored.column(1), threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
