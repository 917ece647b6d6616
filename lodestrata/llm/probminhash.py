"""Near-duplicate classes by ProbMinHash.

A document is a weighted set of five-word shingles. Every shingle is the source of a Poisson
process whose rate is its weight; each arrival falls into a register, and a register keeps the
shingle that arrives first. Two documents agree in a register with the probability Jaccard
similarity of their weighted sets. A shingle's process stops once its next arrival is later than
all first arrivals of the document (early termination).

Candidates, verification and the definition of a link are one similarity: the probability
Jaccard similarity of the weighted shingles of whole texts, 0.8 or more. What a shingle weighs is
a parameter (``WEIGHTINGS``). By default each distinct one weighs 1 whatever its occurrences, and
that similarity then is the plain Jaccard similarity of the two sets.

Registers are banded; a document that shares a band bucket is compared with the bucket's
first document. Components of these links come next; then the other members of every bucket that
still holds several components are compared across components and hand on a link only where it
joins two. Buckets too large for one task are first parted by the rarest shingles of their
documents, which loses no link (``prefixes``). So a group of copies costs links in proportion to
its size and no pairs of a group are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import textvec
from lodestrata.llm.session import cut, release

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Documents of a block of a bucket; two blocks are compared in one task's memory.
BLOCK = 512
#: Columns of the membership matrix that are counted at a time.
_COLUMNS = 2048
#: Pairs of one first document that one task is meant to compare.
PIVOT_PAIRS = 4096
#: What a shingle weighs by its occurrences in the text.
WEIGHTINGS = {"set": lambda times: np.ones(len(times)), "log": lambda times: 1 + np.log(times), "count": lambda times: times.astype(float)}
#: Rows without an id are known by a hash of their text from here on; ids are meant to be smaller.
UNNAMED = 1 << 62
#: A group of copies of more than this share of all documents is looked up by broadcast.
_LARGE = 1000
#: Bits of the bitmaps of ``of_wanted``, and bits of one of these as Spark makes it.
_BITS, _BITMAP = 1 << 25, 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, occurrences) of the distinct shingles of each row, in order of row and hash.

    A row of fewer than five words has one shingle of all its words, one of none has none.
    """
    starts, ends = textvec.spans(data, offsets, ~textvec.WHITE)
    words = textvec.Hasher(data)(starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    n = np.bincount(row, minlength=len(offsets) - 1)
    full = np.flatnonzero(row[: len(row) - SHINGLE + 1] == row[SHINGLE - 1 :]) if len(row) >= SHINGLE else np.zeros(0, dtype=np.int64)
    value = np.zeros(len(full), dtype=np.uint64)
    for k in range(SHINGLE):
        value = value * _STEP + words[full + k]
    rows, values = [row[full]], [value]
    first = np.cumsum(n) - n
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        value = np.full(len(short), size, dtype=np.uint64)
        for k in range(size):
            value = value * _STEP + words[first[short] + k]
        rows.append(short)
        values.append(value)
    row, value = np.concatenate(rows), textvec.mix(np.concatenate(values))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    times = np.diff(np.append(np.flatnonzero(fresh), len(row)))
    return row[fresh], value[fresh], times


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The (rows, registers) array of shingles that arrive first; 0 in rows without shingles."""
    first = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, dtype=np.uint64)
    row, value, weight = row.astype(np.int64), value, weight
    arrived, count = np.zeros(len(row)), np.zeros(len(row), dtype=np.uint64)
    while len(row):
        block = max(1, 4096 // len(row))
        turns = count[:, None] + np.arange(1, block + 1, dtype=np.uint64)
        random = textvec.mix(value[:, None] + turns * _STEP)
        waits = -np.log(((random >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)) / weight[:, None]
        times = arrived[:, None] + np.cumsum(waits, axis=1)
        place = row[:, None] * registers + (((random & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(first, place.ravel(), times.ravel())
        hit = times == first[place]
        winner[place[hit]] = np.broadcast_to(value[:, None], place.shape)[hit]
        latest = first.reshape(rows, registers).max(axis=1)
        arrived = times[:, -1]
        alive = arrived < latest[row]
        row, value, weight, arrived, count = row[alive], value[alive], weight[alive], arrived[alive], count[alive] + np.uint64(block)
    return winner.reshape(rows, registers)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Exact Jaccard and probability Jaccard of two weighted sets in order of value."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(both)
    if not len(both):
        return 0.0, 0.0
    own_a, own_b = wa.sum() - wa[i].sum(), wb.sum() - wb[j].sum()
    x, y = wa[i], wb[j]
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    # for each shared one: those of a larger or equal ratio count by x, the rest by y
    up_to = own_a + np.cumsum(x)
    after = own_b + y.sum() - np.cumsum(y)
    return len(both) / union, float((1 / (up_to / x + after / y)).sum())


def _sign(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            keys, ends = [np.zeros(0, dtype=np.int64)], [0]
            for first, end, data, offsets in textvec.slices(got.column(2)):
                rows = end - first
                row, value, times = shingles(data, offsets)
                parts = signatures(row, value, WEIGHTINGS[weighting](times), rows).reshape(rows, BANDS, ROWS)
                key = np.zeros((rows, BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    key = textvec.mix(key * _STEP + parts[:, :, k])
                key = textvec.mix(key + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
                full = np.bincount(row, minlength=rows) > 0
                keys.append(key[full].ravel())
                ends += (ends[-1] + np.cumsum(np.where(full, BANDS, 0))).tolist()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), lists], ["doc_id", "words", "bands"])

    return run


def _set_of(text: str | None, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text in order, and their weights."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    _, value, times = shingles(raw, np.array([0, len(raw)]))
    return value, WEIGHTINGS[weighting](times)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighting: str) -> float:
    """Probability Jaccard similarity of two weighted sets; with equal weights, of the sets."""
    if weighting != "set":
        return similarity(*a, *b)[1]
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return common / max(1, len(a[0]) + len(b[0]) - common)


def _compare(threshold: float, weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for got in batches:
            a = got.column(0).to_pylist()
            near = np.zeros(len(a), dtype=bool)
            for i in range(len(a)):
                if last is None or last != a[i]:
                    last, own = a[i], _set_of(got.column(2)[i].as_py(), weighting)
                near[i] = alike(own, _set_of(got.column(3)[i].as_py(), weighting), weighting) >= threshold
            mask = pa.array(near)
            yield pa.RecordBatch.from_arrays([got.column(0).filter(mask), got.column(1).filter(mask)], ["a", "b"])

    return run


def of_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most of those whose doc_id is not in ``wanted``; none that is goes.

    Joins shuffle what they do not want too, and texts are large. So ids are first looked up in
    bitmaps of hashed ids, ``_BITS`` bits (4 MB) in all however many ids there are; a join on
    what is left then drops those that hit a bit by chance.
    """

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit("wanted")), F.lit(_BITS))

    def of(c: Column) -> Column:
        return F.floor(c / _BITMAP).cast("int")

    at = wanted.select(place("doc_id").alias("at"))
    bits = at.groupBy(of(F.col("at")).alias("bitmap")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_BITMAP))).alias("bits"))
    mine = place("doc_id")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.pmod(mine, F.lit(_BITMAP)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.pmod(mine, F.lit(8)))).cast("int").bitwiseAND(F.lit(1)) == 1
    return texts.join(F.broadcast(bits), (of(mine) == F.col("bitmap")) & hit, "left_semi")  # at most _BITS / _BITMAP rows


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """The pairs (a, b) that are links. A document that is ``a`` of many is sent to several tasks."""
    pairs = cut(pairs)
    texts = of_wanted(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_PAIRS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    firsts = texts.join(parts.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_a"))
    second = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(firsts, ["a", "part"])
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(threshold, weighting), "a long, b long"))


def _sets(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            found = [_set_of(t.as_py(), weighting) for t in got.column(1)]
            packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in range(2)]
            if weighting == "set":
                packed[1] = pa.nulls(len(found), pa.binary())
            yield pa.RecordBatch.from_arrays([got.column(0), *packed], ["doc_id", "shingles", "weights"])

    return run


def joining_links(docs: list[int], own: list[int], sets: list[np.ndarray], weights: list[np.ndarray] | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links between ``sets``, as many as join the components ``own`` that they touch.

    Without ``weights`` all shared counts come from products of a membership matrix. With them
    the products give the share of each document's weight that the other has too; the lesser
    share of a pair bounds its similarity, and pairs within the bound are compared one by one.
    """
    n = len(docs)
    parent = {c: c for c in own}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    share = np.ones(len(every), dtype=np.float32) if weights is None else np.concatenate([w / max(w.sum(), 1e-300) for w in weights]).astype(np.float32)
    value, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = times[inverse] > 1
    rows, share, column = rows[shared], share[shared], np.unique(inverse[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, share, column = rows[order], share[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + _COLUMNS))
        has = np.zeros((n, int(column[end - 1] - column[at]) + 1), dtype=np.float32)
        has[rows[at:end], column[at:end] - column[at]] = 1
        part = has
        if weights is not None:
            part = np.zeros_like(has)
            part[rows[at:end], column[at:end] - column[at]] = share[at:end]
        common += part @ has.T
        at = end
    if weights is None:
        near = common >= threshold * (sizes[:, None] + sizes[None, :] - common)
    else:
        near = np.minimum(common, common.T) >= threshold - 1e-4
    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = root(own[i]), root(own[j])
        if a != b and (weights is None or similarity(sets[i], weights[i], sets[j], weights[j])[1] >= threshold):
            parent[max(a, b)] = min(a, b)
            out.append((docs[i], docs[j]))
    return out


def _across(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joining links of runs of rows of one (bucket, i, j)."""
        key, docs, own, sets, weights = None, [], [], [], []

        def found() -> pa.RecordBatch:
            weighed = None if any(w is None for w in weights) else weights
            links = joining_links(docs, own, sets, weighed, threshold) if len(set(own)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["a", "b"])

        for got in batches:
            names = list(zip(*(got.column(k).to_pylist() for k in range(3)), strict=True))
            ids, components_ = got.column(3).to_pylist(), got.column(4).to_pylist()
            for k, name in enumerate(names):
                if name != key:
                    if docs:
                        yield found()
                    key, docs, own, sets, weights = name, [], [], [], []
                docs.append(ids[k])
                own.append(components_[k])
                sets.append(np.frombuffer(got.column(5)[k].as_py(), dtype=np.uint64))
                weight = got.column(6)[k].as_py()
                weights.append(None if weight is None else np.frombuffer(weight))
        if docs:
            yield found()

    return run


def _open_groups(members: DataFrame) -> DataFrame:
    """(bucket, main, n, outside) of the buckets of ``members`` (bucket, doc_id, own) that hold two
    components or more; main is the largest of these, outside the members that are not in it."""
    sizes = members.groupBy("bucket", "own").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("bucket").agg(F.max(F.struct("n", "own")).alias("main"), F.sum("n").alias("n"))
    outside = F.col("n") - F.col("main.n")
    return groups.where(outside > 0).select("bucket", F.col("main.own").alias("main"), "n", outside.alias("outside"))


def prefixes(texts: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """(doc_id, shingle): of each text the shingles, rarest first, that the rest cannot replace.

    Shingles are in one order for all texts: by how many of ``texts`` hold them, then by value. A
    text's last ones that together weigh less than ``threshold`` of it are left out. Two texts of
    that similarity share at least that much of either's weight, so the first shingle that they
    share is left out of neither: links always meet in a shingle, and common passages come last.
    """
    held = cut(texts.select("doc_id", "text").mapInArrow(_exploded(weighting), "doc_id long, shingle long, weight double"))
    times = held.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # the weight of a text's rare ones, then of those that others hold too, in order
    whole = held.groupBy("doc_id").agg(F.sum("weight").alias("whole"))
    common = held.join(times, "shingle")
    after = Window.partitionBy("doc_id").orderBy(F.desc("times"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = common.withColumn("rest", F.sum("weight").over(after)).join(whole, "doc_id")
    return rest.where(F.col("rest") >= (threshold - 1e-9) * F.col("whole")).select("doc_id", "shingle")


def _exploded(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                value, weight = _set_of(text.as_py(), weighting)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), doc_id, dtype=np.int64)), pa.array(value.view(np.int64)), pa.array(weight.astype(float))], ["doc_id", "shingle", "weight"])

    return run


def across_components(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """Links that join components of ``members`` (bucket, doc_id, own: its component).

    Members of a bucket's largest component only meet those outside it, in blocks. Documents of
    buckets with more than ``BLOCK`` of these meet where they share one of their ``prefixes``
    instead, so that each link of such a bucket is found.
    """
    held = members.join(_open_groups(members), "bucket")
    wide = cut(held.where(F.col("outside") > BLOCK).select("doc_id", "own").distinct())
    rare = prefixes(of_wanted(texts, wide).join(wide, "doc_id", "left_semi"), threshold, weighting)
    finer = cut(wide.join(rare, "doc_id").select(F.xxhash64("shingle", F.lit("prefix")).alias("bucket"), "doc_id", "own"))
    columns = ["bucket", "doc_id", "own", "main", "n", "outside"]
    met = held.where(F.col("outside") <= BLOCK).select(columns).unionByName(finer.join(_open_groups(finer), "bucket").select(columns))
    met = cut(met)
    release(met.sparkSession)
    a, b = (F.ceil(x / BLOCK).cast("int") for x in (F.col("n") - F.col("outside"), F.col("outside")))
    spread, inside = F.xxhash64("doc_id"), F.col("own") == F.col("main")
    mine = F.when(inside, F.pmod(spread, a)).otherwise(F.pmod(spread, b)).cast("int")
    key = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    others = F.transform(F.sequence(F.lit(0), b - 1), lambda j: key(-1 - F.least(mine, j), F.greatest(mine, j)))
    to_main = F.transform(F.sequence(F.lit(0), a - 1), lambda i: key(i, mine))
    to_others = F.transform(F.sequence(F.lit(0), b - 1), lambda j: key(mine, j))
    pairs = met.select("bucket", "doc_id", "own", F.explode(F.when(inside, to_others).otherwise(F.concat(to_main, others))).alias("at")).select("bucket", "at.i", "at.j", "doc_id", "own")
    wanted = of_wanted(texts, met).join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    rows = pairs.join(wanted.mapInArrow(_sets(weighting), "doc_id long, shingles binary, weights binary"), "doc_id")
    runs = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cut(runs.select("bucket", "i", "j", "doc_id", "own", "shingles", "weights").mapInArrow(_across(threshold), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component: its least node) of all nodes of ``links`` (a, b).

    Rounds of taking the neighbours' least label and jumping to the label's label; the number
    of changed labels alone comes to the driver.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).select("node", F.least("node", "component").alias("component")))
    while True:
        reached = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(reached, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        next_label = F.least(F.col("next"), F.coalesce("far", "next"))
        moved = cut(step.join(jump, "next", "left").select("node", next_label.alias("component"), (next_label != F.col("component")).alias("changed")))
        labels = moved.select("node", "component")
        if moved.where("changed").isEmpty():
            return labels


def known_by(doc_id: Column, text: Column) -> Column:
    """The id that a row is known by: its own or, without one, ``UNNAMED`` plus a hash of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(UNNAMED) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """One row per row of ``docs``: doc_id, known_as, copy_of (least id with the same words) and
    class_id (least id of the class of near-duplicates, by links of ``threshold`` or more).

    Texts of equal words are copies, blank ones too. A null text is a class of its own. A row
    without an id is known by a hash of its text (``known_by``), takes part like others and
    keeps its null doc_id. Repeated ids are one document: its rows share their classes. Very
    long texts are compared whole. Ids that are no whole numbers raise an error (ANSI). Other
    columns are ignored, whatever their names; no rows give no rows.
    """
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting is one of {', '.join(WEIGHTINGS)}")
    rows = docs.select(F.col(doc_id).cast("long").alias("named"), F.col(text).alias("text"))
    rows = rows.withColumn("doc_id", known_by(F.col("named"), F.col("text")))
    own = rows.select("doc_id", "text")
    same = F.unhex(F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).cast("binary"), 256))
    words = F.coalesce(same, F.concat(F.lit(b"null "), F.col("doc_id").cast("string").cast("binary")))
    signed = own.select("doc_id", words.alias("words"), "text")
    signed = cut(signed.mapInArrow(_sign(weighting), "doc_id long, words binary, bands array<long>"))

    least = cut(signed.groupBy("words").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")))
    large = least.join(F.broadcast(least.agg(F.sum("n").alias("total")))).where(F.col("n") * _LARGE > F.col("total"))  # fewer than _LARGE rows
    named = signed.select("doc_id", "words").join(F.broadcast(large.select("words", F.col("copy_of").alias("in_large"))), "words", "left")
    key = F.when(F.col("in_large").isNull(), F.col("words")).otherwise(F.col("doc_id").cast("string").cast("binary"))
    named = named.withColumn("words", key).join(least.select("words", "copy_of"), "words", "left")
    copies = cut(named.groupBy("doc_id").agg(F.min(F.coalesce("in_large", "copy_of")).alias("copy_of")))
    firsts = copies.where("doc_id = copy_of").select("doc_id")
    banded = signed.join(firsts, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most")).where("pivot < most").select("bucket", "pivot")
    members = cut(banded.join(buckets, "bucket"))
    release(docs.sparkSession)

    links = verify(members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), own, threshold, weighting)
    release(docs.sparkSession)
    found = components(links)
    # pairs of a bucket's first document have been compared, so they need not meet again
    inside = members.where("doc_id <> pivot").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    more = across_components(cut(inside.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("own"))), own, threshold, weighting)
    release(docs.sparkSession)
    if not more.isEmpty():
        found = components(links.unionByName(more))
        release(docs.sparkSession)

    classes = copies.join(found.select(F.col("node").alias("copy_of"), "component"), "copy_of", "left").select("doc_id", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    out = rows.select("named", "doc_id").join(classes, "doc_id", "left")
    return out.select(F.col("named").alias("doc_id"), F.col("doc_id").alias("known_as"), "copy_of", "class_id")
