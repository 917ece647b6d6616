"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Rates
r >= 0 are fitted so that the expected tokens of each domain, sum of r * tokens * posterior,
meet the targets: projected gradient descent on the least-squares misfit, from r = 1, in the
inner product weighted by tokens and with the misfit measured in the metric of the inverse
Gram matrix of the posteriors (so the step 1 is safe and few steps are needed). A step moves
r by a linear function of the posterior, so the state is the list of those functions: every
step is one distributed sum over (tokens, posterior, rate), and nothing grows with the data.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textvec
from lodestrata.llm.session import cut
from lodestrata.llm.toxicity import word_features

_log = logging.getLogger(__name__)
#: Labelled rows of each domain that are fitted on at most: the first by a hash of their id.
SAMPLE_PER_DOMAIN = 1500
#: Words and prefixes seen in fewer documents of a domain, or not so many times likelier there
#: than in the others, are no features.
MIN_DOCS, MIN_RATIO = 4, 6.0
_MAP_BITS = 22
STEPS, TOLERANCE = 100, 1e-5
#: After so many steps the metric is that of the rows whose rate may move, and the best of some
#: halvings of the step is taken: where many rates are 0 the whole table's metric is too slow.
PLAIN_STEPS = 10
#: Rates have no upper bound: a target that non-negative rates can meet is met.
MAX_RATE = float("inf")
#: Added to the Gram matrix, as a share of its mean diagonal, so that it has an inverse.
RIDGE = 1e-9
#: Steps after which the rates so far are kept as a column.
_HELD_STEPS = 20
_MARKS = np.array([c for c in range(33, 127) if not textvec.LETTER[c]], dtype=np.uint8)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DENSE = len(_MARKS) + 4


def _bags(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words of rows, dense features, word and prefix hashes, their rows).

    Dense: shares of ASCII marks, upper case and repeated words, log length and a constant.
    """
    for first, end, data, offsets in textvec.slices(texts):
        rows = end - first
        white_starts, _ = textvec.spans(data, offsets, ~textvec.WHITE)
        words = np.diff(np.searchsorted(white_starts, offsets))
        size = np.maximum(1, np.diff(offsets))[:, None]
        own = np.repeat(np.arange(rows), np.diff(offsets))
        dense = np.zeros((rows, _DENSE))
        kinds = np.full(256, -1, dtype=np.int64)
        kinds[_MARKS] = np.arange(len(_MARKS))
        kind = kinds[data]
        at = np.flatnonzero(kind >= 0)
        dense[:, : len(_MARKS)] = np.bincount(own[at] * len(_MARKS) + kind[at], minlength=rows * len(_MARKS)).reshape(rows, -1) / size
        dense[:, -4] = np.bincount(own[_UPPER[data]], minlength=rows) / size[:, 0]
        lower = data.copy()
        lower[_UPPER[data]] += 32
        starts, found, owners = word_features(lower, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        dense[:, -3] = 1 - np.bincount(_rows_of(found[0], row), minlength=rows) / np.maximum(1, np.bincount(row, minlength=rows))
        dense[:, -2] = np.log1p(words) / 10
        dense[:, -1] = 1
        dense[:, :-2] = np.sqrt(np.maximum(0, dense[:, :-2])) * 3
        yield first, end, words, dense, np.concatenate(found), row[np.concatenate(owners)]


def _rows_of(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, hash)."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[fresh]


@dataclass
class Classifier:
    """Dense weights, and the telling hashes in order with theirs."""

    domains: list[str]
    dense: np.ndarray
    hashes: np.ndarray
    sparse: np.ndarray

    def __post_init__(self):
        self.shift = np.uint64(64 - _MAP_BITS)
        self.maybe = np.zeros(1 << _MAP_BITS, dtype=bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def __getstate__(self):
        return self.domains, self.dense, self.hashes, self.sparse

    def __setstate__(self, state):
        self.__init__(*state)

    def posteriors(self, dense: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z = dense @ self.dense
        if len(self.hashes):
            hit = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
            j = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
            true = self.hashes[j] == hashes[hit]
            pairs = np.unique(rows[hit[true]] * len(self.hashes) + j[true])
            np.add.at(z, pairs // len(self.hashes), self.sparse[pairs % len(self.hashes)])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        out = []
        docs, domains = got.column(0).to_pylist(), got.column(1).to_pylist()
        for first, end, _, dense, hashes, rows in _bags(got.column(2)):
            for i in range(end - first):
                out.append((docs[first + i], domains[first + i], dense[i].tobytes(), np.unique(hashes[rows == i]).tobytes()))
        if out:
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "domain", "dense", "hashes"])


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", per_domain: int = SAMPLE_PER_DOMAIN, steps: int = 120) -> Classifier:
    """Multinomial logistic regression on at most ``per_domain`` rows of ``labelled`` (doc_id,
    domain) a domain, weighted to the domains' shares in all of it that is in ``docs``. Of repeated ids the first
    domain by name counts; null ids and other domains are left out. A domain without rows is
    never predicted above the least; without any rows all posteriors are equal."""
    clean = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    clean = clean.join(docs.select(F.col(doc_id).cast("long").alias("doc_id")), "doc_id", "left_semi")
    counts = {r["domain"]: r["count"] for r in clean.groupBy("domain").count().collect()}  # one row a domain
    picked = None
    for name in domains:
        some = clean.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")  # per_domain rows a domain
    rows = texts.select("doc_id", "domain", "text").mapInArrow(_extract, "doc_id long, domain string, dense binary, hashes binary").toArrow().sort_by("doc_id")
    k, n = len(domains), rows.num_rows
    if not n:
        return Classifier(domains, np.zeros((_DENSE, k)), np.zeros(0, dtype=np.uint64), np.zeros((0, k)))
    y = np.array([domains.index(d.as_py()) for d in rows["domain"]])
    dense = np.stack([np.frombuffer(x.as_py()) for x in rows["dense"]])
    bags = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in rows["hashes"]]
    telling = _telling(bags, y, k)
    row, column = [], []
    for i, bag in enumerate(bags):
        j = np.minimum(np.searchsorted(telling, bag), max(0, len(telling) - 1))
        hit = telling[j] == bag if len(telling) else np.zeros(len(bag), dtype=bool)
        column.append(j[hit])
        row.append(np.full(int(hit.sum()), i))
    row, column = np.concatenate(row), np.concatenate(column)
    present = np.bincount(y, minlength=k)
    share = np.array([counts[domains[c]] / present[c] for c in y])
    share /= share.sum()
    weights = [np.zeros((_DENSE, k)), np.zeros((len(telling), k))]
    grown = [np.full(w.shape, 1e-9) for w in weights]
    own = np.eye(k)[y]
    for _ in range(steps):
        z = dense @ weights[0]
        for c in range(k):
            z[:, c] += np.bincount(row, weights[1][column, c], n)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - own) * share[:, None]
        pulls = np.stack([np.bincount(column, g[row, c], len(telling)) for c in range(k)], axis=1)
        for w, slope, sums in zip(weights, (dense.T @ g + 1e-5 * weights[0], pulls + 1e-5 * weights[1]), grown, strict=True):
            sums += slope**2
            w -= 0.3 * slope / np.sqrt(sums)
    return Classifier(domains, weights[0], telling, weights[1])


def _telling(bags: list[np.ndarray], y: np.ndarray, k: int) -> np.ndarray:
    """The hashes that are frequent in one domain and rare in the others, in order."""
    every, inverse = np.unique(np.concatenate(bags), return_inverse=True)
    domain = np.repeat(y, [len(b) for b in bags])
    seen = np.stack([np.bincount(inverse[domain == c], minlength=len(every)) for c in range(k)], axis=1)
    docs = np.bincount(y, minlength=k)
    best = np.zeros(len(every), dtype=bool)
    for c in range(k):
        rest, others = seen.sum(axis=1) - seen[:, c], docs.sum() - docs[c]
        best |= (seen[:, c] >= MIN_DOCS) & ((seen[:, c] + 0.5) / (docs[c] + 1) >= MIN_RATIO * (rest + 0.5) / (others + 1))
    return every[best]


def _predict(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            tokens, posterior = np.zeros(len(got), dtype=np.int64), np.zeros((len(got), len(model.domains)))
            for first, end, words, dense, hashes, rows in _bags(got.column(1)):
                tokens[first:end], posterior[first:end] = words, model.posteriors(dense, hashes, rows)
            columns = [pa.array(posterior[:, c]) for c in range(len(model.domains))]
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(tokens), *columns], ["doc_id", "tokens", *[f"p_{d}" for d in model.domains]])

    return run


def predict(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens (words) and one posterior column ``p_<domain>`` for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(model), ", ".join(["doc_id long", "tokens long", *[f"p_{d} double" for d in model.domains]]))


def rate(domains: list[str], steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate after the given steps; step s moves it by -(posterior . s), not below 0."""
    r = F.lit(1.0) if start is None else start
    if len(steps) > _HELD_STEPS:  # too many for one nested expression
        listed = F.array(*[F.array(*[F.lit(float(c)) for c in step]) for step in steps])

        def moved_by(r: Column, step: Column) -> Column:
            for i, d in enumerate(domains):
                r = r - F.col(f"p_{d}") * step[i]
            return F.greatest(F.lit(0.0), r)

        return F.aggregate(listed, r, moved_by)
    for step in steps:
        moved = r
        for d, c in zip(domains, step, strict=True):
            moved = moved - F.col(f"p_{d}") * F.lit(float(c))
        r = F.greatest(F.lit(0.0), moved)
    return r


def _pull(domains: list[str], step: np.ndarray) -> Column:
    return sum((F.col(f"p_{d}") * F.lit(float(c)) for d, c in zip(domains, step, strict=True)), F.lit(0.0))


def fit_rates(posteriors: DataFrame, domains: list[str], weights: dict[str, float], anchor: str | None = None, at_most: tuple[str, ...] = (), steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The descent steps for which expected domain tokens meet ``weights`` (summing to 1) of the budget.

    The budget is all tokens or, with ``anchor``, so many that this domain keeps its own. The
    weights of ``at_most`` are limits: of such a domain only tokens beyond its target count as
    misfit. A target out of reach of the rates is met as closely as they can; what is missed
    after the last step is logged and ``totals`` gives it for each domain.
    """
    t, p = F.col("tokens"), [F.col(f"p_{d}") for d in domains]
    k = len(domains)
    gram_row = posteriors.agg(*[F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)], *[F.coalesce(F.sum(t * p[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
    gram = np.array([[gram_row[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
    total = np.array([gram_row[f"s{i}"] for i in range(k)])
    if not total.sum():
        return []
    target, budget = _targets(total, domains, weights, anchor)
    limits = np.array([d in at_most for d in domains])
    metric = np.linalg.inv(gram + np.eye(k) * RIDGE * np.trace(gram) / k)
    taken: list[list[float]] = []
    expected = total

    def misfit() -> tuple[np.ndarray, np.ndarray]:
        """Tokens too many or too few, none for a limit that is kept, and the domains that count."""
        counts = ~limits | (expected > target)
        return np.where(counts, expected - target, 0.0), counts

    held, since = posteriors, 0
    while len(taken) < steps and np.abs(misfit()[0]).max() > tolerance * budget:
        off, counts = misfit()
        step, shares = np.where(counts, metric @ off, 0.0), [1.0]
        if len(taken) - since >= (1 if len(taken) > PLAIN_STEPS else _HELD_STEPS):
            held, since = cut(held.withColumn("_r", rate(domains, taken[since:], F.col("_r") if since else None))), len(taken)
        now = held.withColumn("r", rate(domains, taken[since:], F.col("_r") if since else None))
        if len(taken) >= PLAIN_STEPS:
            free = (F.col("r") > 0) | (_pull(domains, step) < 0)
            row = now.where(free).agg(*[F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
            near = np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)])
            step = np.where(counts, np.linalg.inv(near + np.eye(k) * RIDGE * max(np.trace(near), np.trace(gram) * RIDGE) / k) @ off, 0.0)
            shares = [0.5**n for n in range(8)]
        rates = [F.greatest(F.lit(0.0), F.col("r") - _pull(domains, step * a)) for a in shares]
        sums = now.agg(*[F.sum(t * r * x).alias(f"s{n}_{i}") for n, r in enumerate(rates) for i, x in enumerate(p)]).first()
        tried = []
        for n, a in enumerate(shares):
            expected = np.array([sums[f"s{n}_{i}"] for i in range(k)])
            tried.append((np.abs(misfit()[0]).max(), n, (step * a).tolist(), expected))
        _, _, step, expected = min(tried, key=lambda x: x[:2])
        taken.append(step)
    if np.abs(misfit()[0]).max() > tolerance * budget:
        _log.warning("after %d steps expected tokens miss targets: %s", len(taken), {d: (float(e), float(g)) for d, e, g in zip(domains, expected, target, strict=True)})
    return taken


def _targets(total: np.ndarray, domains: list[str], weights: dict[str, float], anchor: str | None) -> tuple[np.ndarray, float]:
    """The tokens that each domain is to have, and all of them."""
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    budget = total[domains.index(anchor)] / share[domains.index(anchor)] if anchor else total.sum()
    return share * budget, budget


def totals(mixed: DataFrame, weights: dict[str, float], anchor: str | None = None) -> list[tuple[str, float, float, float]]:
    """(domain, tokens before, expected tokens at the rates, target) of each domain of ``mix``'s rows."""
    domains = list(weights)
    sums = mixed.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{d}") * x), F.lit(0.0)).alias(f"{n}{i}") for i, d in enumerate(domains) for n, x in (("t", F.lit(1.0)), ("e", F.col("rate")))]).first()
    total = np.array([sums[f"t{i}"] for i in range(len(domains))])
    target = _targets(total, domains, weights, anchor)[0]
    return [(d, float(total[i]), float(sums[f"e{i}"]), float(target[i])) for i, d in enumerate(domains)]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None = None, at_most: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", per_domain: int = SAMPLE_PER_DOMAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, ``p_<domain>``, rate and copies.

    ``copies`` is the rate rounded down or up by a hash of the id, right on average. Null or
    empty texts have no tokens, get the posterior of an empty bag and so a rate like others.
    Null ids stay null; repeated rows get the same rate; other columns are ignored; no rows
    give no rows.
    """
    domains = list(weights)
    posteriors = cut(predict(docs, fit_classifier(docs, labelled, domains, doc_id, text, per_domain), doc_id, text))
    steps = fit_rates(posteriors, domains, weights, anchor, at_most)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return posteriors.withColumn("rate", rate(domains, steps)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))
