"""Balanced label propagation: linked documents gather in shards of even counts.

Links are groups: documents of one group are linked to each other. A pair is a group of two,
equal texts are a group of any size, and no pairs of a group are ever listed. Every round is a few
joins: the shards of each group's members are counted, every document sums the counts of its
groups, and one that has more neighbours in another shard asks to go there. Quotas say how many
may: as many as come the other way (swaps) and as many as the shard has room for, largest gains
first; half of the documents, by a hash of the round, may ask at a time, so that two neighbours
don't pass each other. Rounds go on until none asks or some rounds in a row unite no more
links, and the best labels seen count.

Propagation starts from labels that pack the groups of equal texts by size: groups of one size are
alike, so where they go is decided on a table of sizes, each whole where the room allows it.
Rows without links cost no cut wherever they are and fill all shards to even counts at the end,
so counts differ by one at most (law "rows").
"""

from __future__ import annotations

import bisect
import heapq
import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.session import cut, dropped, stored

_log = logging.getLogger(__name__)
SHARDS = 24
#: Rows that one rank task is meant to have.
RANK_ROWS = 5_000
#: A group with more than this share of all linked rows is looked up by broadcast.
HOT_SHARE = 1000
#: Rounds in a row that unite no more links before propagation ends.
PATIENCE = 4


def _numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, size: Column) -> DataFrame:
    """``df`` with ``out``, the gapless rank from 0 within ``keys``, without one task a key.

    Rows are ranked in hash bins of about ``RANK_ROWS`` and the bins' sizes, a small table,
    give each bin its offset. ``size``: the rows of a row's key, or more.
    """
    df = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.ceil(size / RANK_ROWS)).cast("int"))
    here = Window.partitionBy(*keys, "_bin").orderBy(*order)
    df = df.withColumn("_rank", F.row_number().over(here) - 1)
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before))
    # only bins after the first have an offset; keys of one bin have none
    df = df.join(sizes.where("_bin > 0 AND _before > 0").drop("_n"), [*keys, "_bin"], "left")
    return df.withColumn(out, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_bin", "_rank", "_before")


def placed(sizes: dict[int, int], share: list[int]) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
    """Where groups go: for each size, (groups, their pieces (shard, rows)) in turn.

    ``sizes``: groups by their number of rows; ``share``: rows a shard takes. Sizes come in
    falling order and fill the shards of least room that hold them whole. A group that no shard
    holds fills the shard of most room, and what is left of it comes again as a smaller size.
    Then split groups move into one shard, by room or by swapping a group of another shard
    against one of it, until no such move is left.
    """
    room = list(share)
    whole: list[dict[int, int]] = [{} for _ in share]
    split: list[tuple[int, list[tuple[int, int]]]] = []
    queue = [(-n, groups, n, ()) for n, groups in sizes.items()]
    heapq.heapify(queue)
    while queue:
        left, groups, n, pieces = heapq.heappop(queue)
        left = -left
        for j in sorted((j for j in range(len(room)) if room[j] >= left), key=lambda j: (room[j], j)):
            took = min(groups, room[j] // left)
            room[j] -= took * left
            groups -= took
            if pieces and took:
                split.append((n, [*pieces, (j, left)]))
            elif took:
                whole[j][n] = whole[j].get(n, 0) + took
            if not groups:
                break
        if groups:
            j = max(range(len(room)), key=lambda j: (room[j], -j))
            part, room[j] = room[j], 0
            heapq.heappush(queue, (part - left, 1, n, (*pieces, (j, part))))
            if groups > 1:
                heapq.heappush(queue, (-left, groups - 1, n, pieces))
    while _unsplit(room, whole, split):
        pass
    out: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {n: [] for n in sizes}
    for j, held in enumerate(whole):
        for n, groups in held.items():
            if groups:
                out[n].append((groups, [(j, n)]))
    for n, pieces in split:
        out[n].append((1, pieces))
    return out


def _unsplit(room: list[int], whole: list[dict[int, int]], split: list[tuple[int, list[tuple[int, int]]]]) -> bool:
    """Makes one split group whole if room or one swap of whole groups allows it.

    Pieces of a group that only few shards hold stay; there are fewer split groups than shards
    and pieces, and as few sizes as the root of the rows allows.
    """
    for at, (n, pieces) in enumerate(split):
        freed = list(room)
        for j, part in pieces:
            freed[j] += part
        for j in sorted(range(len(room)), key=lambda j: -freed[j]):
            need = n - freed[j]
            if need > 0:
                swap = _swap(need, j, freed, whole)
                if swap is None:
                    continue
                gone, i, come = swap
                for shard_, size, step in ((j, gone, -1), (i, gone, 1), (i, come, -1), (j, come, 1)):
                    if size:
                        whole[shard_][size] = whole[shard_].get(size, 0) + step
                freed[j] += gone - come
                freed[i] -= gone - come
            freed[j] -= n
            room[:] = freed
            whole[j][n] = whole[j].get(n, 0) + 1
            del split[at]
            return True
    return False


def _swap(need: int, j: int, room: list[int], whole: list[dict[int, int]]) -> tuple[int, int, int] | None:
    """(size that leaves shard j, shard it goes to, size that comes for it or 0) that gives
    ``need`` rows of room in j and has room where it goes."""
    for i in range(len(room)):
        if i == j or room[i] < need:
            continue
        come = sorted([0, *(n for n, groups in whole[i].items() if groups)])
        for gone in (n for n, groups in whole[j].items() if groups and n >= need):
            # the largest that may come for it; a smaller one would only move more rows
            k = bisect.bisect_right(come, gone - need) - 1
            if k >= 0 and gone - come[k] <= room[i]:
                return gone, i, come[k]
    return None


def start(groups: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """(group, shard, n) from (group, n): where the rows of each group of equal texts begin.

    ``total`` is the number of all rows, linked or not; shard j gets total // shards of them,
    one more for the first total % shards. Groups of one size are alike: where they go is
    decided on their numbers, one row a size, and each takes its turn in a hash order.
    """
    # sizes differ, so there are at most sqrt(2 * total) of them
    sizes = {r["n"]: r["count"] for r in groups.groupBy("n").count().collect()}
    if not sizes:
        return groups.select("group", F.lit(0).alias("shard"), "n").where("false")
    plan = placed(sizes, shares(total, shards))
    turns = []
    for n, runs in plan.items():
        low = 0
        for count, pieces in runs:
            turns.append((n, low, low + count, pieces))
            low += count
    spark = groups.sparkSession
    turns = spark.createDataFrame(turns, "n long, low long, high long, pieces array<struct<shard: int, rows: long>>")
    turns = turns.groupBy("n").agg(F.collect_list(F.struct("low", "high", "pieces")).alias("runs"), F.max("high").alias("groups"))  # one a shard and a split group at most
    ranked = groups.join(F.broadcast(turns), "n")  # one row a size
    ranked = _numbered(ranked, ["n"], [F.xxhash64("group"), F.col("group")], "rank", F.col("groups"))
    mine = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]["pieces"]
    pieces = ranked.select("group", F.explode(mine).alias("p"))
    return cut(pieces.groupBy("group", F.col("p.shard").alias("shard")).agg(F.sum("p.rows").alias("n")))


def shares(total: int, shards: int) -> list[int]:
    """Rows of each shard: even, the first ones take one more of what is over."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _by_group(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with their nodes' shards, and per group the counts by shard (one entry a shard at most)."""
    told = links.join(labels, "node")
    counts = told.groupBy("group", "shard").agg(F.count("*").alias("n"))
    counts = counts.groupBy("group").agg(F.collect_list(F.struct("shard", "n")).alias("held"), F.sum("n").alias("size"))
    return told, stored(counts)


def united(counts: DataFrame) -> float:
    """Links (pairs of one group) whose ends stand in one shard."""
    pairs = F.aggregate("held", F.lit(0.0), lambda a, h: a + h["n"].cast("double") * (h["n"] - 1) / 2)
    return counts.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("x")).first()["x"]


def _movers(told: DataFrame, counts: DataFrame, turn: int, rows: int) -> DataFrame:
    """(node, shard, to, class) of the nodes that may ask in this turn; class: the gain's magnitude."""
    large = counts.where(F.col("size") * HOT_SHARE > rows)  # fewer than HOT_SHARE of a node's groups each
    told = told.join(F.broadcast(large.select("group", F.col("held").alias("in_large"))), "group", "left")
    key = F.when(F.col("in_large").isNull(), F.xxhash64("group")).otherwise(F.xxhash64("node"))
    rest = counts.where(F.col("size") * HOT_SHARE <= rows).select("group", "held", F.xxhash64("group").alias("_key"))
    told = told.withColumn("_key", key).join(rest, ["_key", "group"], "left").withColumn("held", F.coalesce("in_large", "held"))
    votes = told.select("node", F.col("shard").alias("here"), F.explode("held").alias("h"))
    own = F.col("h.shard") == F.col("here")
    votes = votes.groupBy("node", "here", F.col("h.shard").alias("to")).agg(F.sum(F.col("h.n") - own.cast("long")).alias("votes"))
    best = votes.groupBy("node", "here").agg(
        F.max(F.struct("votes", (F.col("to") == F.col("here")).alias("stays"), (-F.col("to")).alias("first"))).alias("best"),
        F.max(F.when(F.col("to") == F.col("here"), F.col("votes"))).alias("now"),
    )
    gain = F.col("best.votes") - F.col("now")
    asks = best.where((gain > 0) & (F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2))
    return asks.select("node", F.col("here").alias("shard"), (-F.col("best.first")).cast("int").alias("to"), F.floor(F.log2(gain.cast("double"))).cast("int").alias("class"))


def quotas(wanted: dict[tuple[int, int], dict[int, int]], room: list[int]) -> dict[tuple[int, int, int], int]:
    """How many may go from a shard to another by class of gain: matched swaps, then room.

    ``wanted``: by (from, to) the askers of each class. Largest classes go first.
    """
    left = {k: sum(v.values()) for k, v in wanted.items()}
    may = dict.fromkeys(wanted, 0)
    for s, t in wanted:
        if s < t and (t, s) in wanted:
            both = min(left[s, t], left[t, s])
            for k in ((s, t), (t, s)):
                may[k] += both
                left[k] -= both
    room = list(room)
    moved = True
    while moved:
        moved = False
        for s, t in sorted(wanted, key=lambda k: (-max(wanted[k]), k)):
            go = min(left[s, t], room[t])
            if go > 0:
                may[s, t] += go
                left[s, t] -= go
                room[t] -= go
                room[s] += go
                moved = True
    out = {}
    for (s, t), classes in wanted.items():
        rest = may[s, t]
        for c in sorted(classes, reverse=True):
            out[s, t, c] = min(rest, classes[c])
            rest -= out[s, t, c]
    return out


def propagate(labels: DataFrame, links: DataFrame, total: int, shards: int = SHARDS, patience: int = PATIENCE) -> tuple[DataFrame, float, float]:
    """(labels, united before, united after): ``labels`` (node, shard) after propagation.

    ``links``: node, group; all nodes of ``labels`` are known, no other. ``total``: rows that
    the shards take together, whether labelled or not.
    """
    links, labels = stored(links.select("node", "group").distinct()), stored(labels.select("node", "shard"))
    told, counts = _by_group(links, labels)
    before = best_links = united(counts)
    best, idle, turn = labels, 0, 0
    all_links = counts.agg(F.coalesce(F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2), F.lit(0.0)).alias("x")).first()["x"]
    rows = links.count()
    while idle < patience and best_links < all_links:
        movers = stored(_movers(told, counts, turn, rows))
        turn += 1
        wanted: dict[tuple[int, int], dict[int, int]] = {}
        for r in movers.groupBy("shard", "to", "class").count().collect():  # shards**2 times 64 at most
            wanted.setdefault((r["shard"], r["to"]), {})[r["class"]] = r["count"]
        size = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}  # one row a shard
        may = quotas(wanted, [share - size.get(j, 0) for j, share in enumerate(shares(total, shards))])
        if not any(may.values()):
            idle += 1
            continue
        listed = movers.sparkSession.createDataFrame([(s, t, c, q, wanted[s, t][c]) for (s, t, c), q in may.items() if q], "shard int, to int, class int, quota long, askers long")
        asked = movers.join(F.broadcast(listed), ["shard", "to", "class"])
        go = _numbered(asked, ["shard", "to", "class"], [F.xxhash64("node"), F.col("node")], "rank", F.col("askers")).where("rank < quota")
        labels = stored(labels.join(go.select("node", "to"), "node", "left").select("node", F.coalesce("to", "shard").alias("shard")))
        dropped(movers)
        told, counts = _by_group(links, labels)
        now = united(counts)
        idle = 0 if now > best_links else idle + 1
        if now > best_links:
            best, best_links = labels, now
    return best, before, best_links


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, links: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 8), text_crc32, group, shard, slot.

    Rows of equal text are linked, and rows whose ids share a ``grp`` in ``links`` (doc_id, grp:
    string) if given; null texts (crc32 of nothing) are not linked to each other. Counts of shards
    differ by one at most; slots are gapless from 0 in each shard. Ties are broken by hashes
    of the group and row. Null ids take part like others; repeated rows are separate linked rows;
    very long texts count by their bytes; ids that are no whole numbers raise an error (ANSI);
    other columns are ignored, whatever their names; no rows give no rows.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("group"),
        F.monotonically_increasing_id().alias("node"),
    )
    rows = cut(rows)  # some seventy bytes a row, read several times; nodes are fixed by it
    total = rows.count()
    groups = cut(rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    state = start(groups, total, shards)

    # rows of equal text: the rank in the group falls into the range of one of the group's shards
    ranges = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = state.withColumn("low", F.coalesce(F.sum("n").over(ranges), F.lit(0)))
    ranges = ranges.groupBy("group").agg(F.collect_list(F.struct("shard", "low", (F.col("low") + F.col("n")).alias("high"))).alias("ranges"), F.sum("n").alias("n"))  # one a shard at most
    marked = rows.select("node", "group").join(ranges, "group")
    whole = marked.where(F.size("ranges") == 1).select("node", "group", F.col("ranges")[0]["shard"].alias("shard"))
    split = _numbered(marked.where(F.size("ranges") > 1), ["group"], [F.xxhash64("node"), F.col("node")], "rank", F.col("n"))
    split = split.select("node", "group", F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]["shard"].alias("shard"))
    linked = cut(whole.unionByName(split))
    labels, pairs = linked.select("node", "shard"), linked.select("node", "group")

    def filled(df: DataFrame, n: int, held: dict[int, int], full: bool) -> DataFrame:
        """``df`` (node, ...) with ``shard``: n rows dealt to the room that ``held`` leaves."""
        room = [share - held.get(j, 0) for j, share in enumerate(shares(total, shards))]
        tops, at = [], 0
        for j in range(shards):
            at += room[j]
            tops.append(at if full else at * n // max(1, sum(room)))
        ranked = _numbered(df.withColumn("_all", F.lit(0)), ["_all"], [F.xxhash64("node"), F.col("node")], "rank", F.lit(n))
        below = F.aggregate(F.array(*[F.lit(t).cast("long") for t in tops]), F.lit(0), lambda a, t: a + (t <= F.col("rank")).cast("int"))
        return ranked.withColumn("shard", below).drop("_all", "rank")

    def held_by(df: DataFrame) -> dict[int, int]:
        return {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}  # one row a shard

    if links is not None:
        named = links.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(b"link "), F.col("grp").cast("string").cast("binary")).alias("group")).where("doc_id IS NOT NULL AND group IS NOT NULL")
        asked = cut(rows.select("node", "doc_id").join(named, "doc_id").select("node", "group").distinct())
        more = cut(asked.select("node").distinct().join(labels, "node", "left_anti"))
        labels = labels.unionByName(filled(more, more.count(), held_by(labels), False).select("node", "shard"))
        pairs = pairs.unionByName(asked)
    labels, before, after = propagate(labels, pairs, total, shards)
    _log.info("links united: %s at the start, %s after propagation", before, after)

    free = rows.select("node").join(labels, "node", "left_anti")
    free = filled(free, total, held_by(labels), True)
    out = rows.join(labels.unionByName(free.select("node", "shard")), "node")
    return _numbered(out, ["shard"], [F.col("doc_id"), F.col("node")], "slot", F.lit(max(1, total // shards))).drop("node")
