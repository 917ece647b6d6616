"""Packing of tokenised documents into sequences of a fixed length.

First-fit decreasing with a tournament tree over bin capacities, run on its own in each
randomised group of documents. A document longer than a sequence is cut: its full pieces
fill sequences of their own and only its remainder is packed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.bpe import Encoder

SEQUENCE_TOKENS = 2048
#: Documents of a group; a group is one task's work and its remainders are held in memory.
GROUP_DOCS = 4000
END_ID = 1
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class CapacityTree:
    """A tournament tree whose leaves are bins in order and whose inner nodes hold the larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``; returns (bin, room before) and takes the room."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        best[node] = room - size
        at = node
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return node - self.leaves, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; items go largest first, ties in the order given."""
    tree = CapacityTree(max(1, len(sizes)), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at, room = tree.first_fit(sizes[i])
        out[i] = at, capacity - room
    return out


def _pack_partition(vocabulary: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, group = Encoder(vocabulary), TaskContext.get().partitionId() << 32
        sequences, rest = 0, []
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for got in batches:
            docs = got.column(0).to_pylist()
            for first, end, ids, offsets in encoder.batches(got.column(1)):
                rows = []
                for i, doc in enumerate(docs[first:end]):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) // capacity * capacity
                    for start in range(0, whole, capacity):
                        rows.append((doc, start, capacity, len(own), group | sequences, 0, own[start : start + capacity].tobytes()))
                        sequences += 1
                    if whole < len(own):
                        rest.append((doc, whole, len(own), own[whole:].tobytes()))
                if rows:
                    yield batch(rows)
        rest.sort(key=lambda x: (-len(x[3]), x[0] is None, x[0] or 0, x[1]))
        places = first_fit_decreasing([len(x[3]) // 4 for x in rest], capacity)
        for at in range(0, len(rest), 1000):
            yield batch([(doc, start, len(ids) // 4, total, group | (sequences + place[0]), place[1], ids) for (doc, start, total, ids), place in zip(rest[at : at + 1000], places[at : at + 1000], strict=True)])

    return run


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = SEQUENCE_TOKENS, group_docs: int = GROUP_DOCS, end_id: int = END_ID) -> DataFrame:
    """Pack every document of ``docs``; one row per piece with its token ids.

    ``vocabulary`` is a byte-level BPE file of the ``tokenizers`` library. Columns: doc_id, start
    (ids of the document before the piece), length, doc_tokens (with the closing ``end_id``),
    sequence_id, offset in the sequence, ids (little-endian unsigned 32-bit).

    Groups are dealt by a hash of id and place in the table, so a hot source, repeated ids,
    repeated rows or sorted input don't make one group large. Places are the same whenever a
    lost task reads its part of a stored table or checkpoint again; give one of these. Null
    or empty text: one piece with ``end_id`` alone. Null id: packed like any other and kept
    null. Repeated rows: each is packed. Very long text: its full pieces leave at once, memory
    follows the longest text. Ties in size: by id, then start. Empty table: no rows. Ids that are no whole numbers
    raise an error (ANSI). Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, math.ceil(rows.count() / group_docs))
    dealt = rows.withColumn("_place", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    dealt = dealt.repartition(groups, "_place").drop("_place")
    return dealt.mapInArrow(_pack_partition(vocabulary, capacity, end_id), PIECES)


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of little-endian unsigned 32-bit ids."""
    return F.crc32(ids)
