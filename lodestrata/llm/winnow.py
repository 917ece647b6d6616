"""Winnowing fingerprints over k-grams of characters; native expressions only.

Every code point has a 64-bit hash s(c). The rolling hash of the ``K`` code points from i on is
the shift-and-xor polynomial s(c_i) * x**(K-1) + ... + s(c_i+K-1) over GF(2), cut to 64 bits:
it is rolled over the text by doubling, H_2m(i) = (H_m(i) << m) xor H_m(i + m), so all grams of
a text take log2(K) passes and no gram is hashed anew (expressions have no running state that
would allow the step from one gram to the next). Bits 32 to 62, which are kept, depend on all
``K``.

The least gram of every ``W`` neighbours is kept, of equal ones the rightmost. Any
``K + W - 1`` code points that two texts share therefore give them a common fingerprint;
positions say where. A kept gram is one long, ``hash * 2**32 + (2**32 - 1 - position)``: the
least long of a window is the least hash and, of equal hashes, the rightmost position. No text
is so long that positions wrap.

Long texts are taken in chunks of ``CHUNK`` code points that overlap, so memory is that of the
text, what is kept of it and one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Both powers of two: hashes and windows are got by doubling.
K, W = 16, 32
#: Code points that a gram or window of a place reaches beyond it.
REACH = K + W - 2
#: Code points from a border on that hold all windows of the places less than ``W - 1`` beyond it.
EDGE = REACH + W - 1
CHUNK = 1 << 12
_POSITIONS = (1 << 32) - 1
_HIGH = _POSITIONS >> 1 << 32
#: Documents of one run of neighbours.
RUN_DOCS = 250
#: Segments that the ids are cut into by quantiles; runs are cut out of segments by arithmetic.
SEGMENTS = 1024
_NULL = -(1 << 63)


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to the value of an expression, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _later(name: str, n: int) -> str:
    """SQL of an array moved ``n`` places on, with nulls before it (a plain copy, unlike ``slice``)."""
    return f"concat(array_repeat(cast(null as bigint), {n}), {name})"


def _windows(chunk: str, base: str, only: str) -> str:
    """SQL of the distinct window minima of a chunk whose first code point stands at ``base``;
    ``only``: whether fewer than ``W`` grams are a window. Entry j of an array is of the gram, or
    of the window, that ends at j."""
    steps = [(f"transform(split({chunk}, ''), c -> xxhash64(c))", "h1")]
    m = 1
    while m < K:
        steps.append((f"zip_with({_later(f'h{m}', m)}, h{m}, (x, y) -> shiftleft(x, {m}) ^ y)", f"h{2 * m}"))
        m *= 2
    # the gram that ends at entry j starts K - 1 before it; entries before the first gram stay null
    places = f"sequence({_POSITIONS + K - 1}L - {base}, {_POSITIONS + K}L - {base} - size(h1), -1L)"
    steps.append((f"zip_with(h{K}, {places}, (h, at) -> (h & {_HIGH}L) | at)", "m1"))
    m = 1
    while m < W:
        steps.append((f"zip_with({_later(f'm{m}', m)}, m{m}, (x, y) -> least(x, y))", f"m{2 * m}"))
        m *= 2
    grams = f"(size(h1) - {K - 1})"
    count = f"greatest(if({only}, least(1, {grams}), 0), {grams} - {W - 1})"
    body = f"array_distinct(slice(m{W}, greatest(1, least({K + W - 1}, size(h1))), {count}))"
    for value, name in reversed(steps):
        body = _let(value, name, body)
    return body


def kept_grams(text: str, base: str = "0", partial: str = "false") -> Column:
    """The kept grams of a text column in text order; ``base`` is added to positions. A text that
    is the ``partial`` rest of another has no windows of less than ``W`` grams."""
    chunks = f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"
    reach = f"zip_with(parts, slice(parts, 2, size(parts)), (a, b) -> concat(a, coalesce(left(b, {REACH}), '')))"
    only = f"(size(parts) = 1 AND NOT {partial})"
    found = f"transform({reach}, (part, at) -> {_windows('part', f'({base} + at * {CHUNK}L)', only)})"
    short = f"array((xxhash64({text}) & {_HIGH}L) + ({_POSITIONS}L - {base}))"
    none = "cast(array() as array<bigint>)"
    return F.expr(
        f"CASE WHEN {text} = '' THEN {none} WHEN char_length({text}) < {K} THEN if({partial}, {none}, {short})"
        f" ELSE {_let(chunks, 'parts', f'array_distinct(flatten({found}))')} END"
    )


def add_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the array of kept grams of ``text`` in text order.

    Null or empty texts have none. A text of fewer than ``K`` code points has one gram of all of
    it; one of fewer than ``W`` grams has one window. Very long texts are taken whole, in chunks.
    """
    body = f"_{out}_text"
    return rows.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(out, kept_grams(body)).drop(body)


def hashes(kept: Column) -> Column:
    """The distinct hashes of kept grams, without positions."""
    return F.array_distinct(F.transform(kept, lambda p: F.shiftright(p, 32)))


def positions(kept: Column) -> Column:
    """The positions of kept grams: code points before each."""
    return F.transform(kept, lambda p: F.lit(_POSITIONS) - p.bitwiseAND(F.lit(_POSITIONS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike (1)."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(rows, before): rows (text, key, text_hash, segment, part) in runs (segment, part) of
    neighbours by id, and the run before the first one of each segment (of all, the last).

    Segments are cut at quantiles of the ids; a segment is cut by arithmetic on its ids into
    runs of about ``RUN_DOCS``, and one that is a single id by the hash of its texts. So the
    number of runs grows with the table and no window spans it. Null ids come first; rows of one
    id are in order of the hash of their text; identical rows share a run, which spills to disk.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    some = max(1, min(SEGMENTS, n // RUN_DOCS))
    real = F.when(F.col("key") != _NULL, F.col("key"))
    found = rows.agg(F.percentile_approx("key", [i / some for i in range(some)], 10 * SEGMENTS).alias("cuts"), F.min(real).alias("least"), F.max(real).alias("most")).first()
    cuts, least, most = list(found["cuts"] or []), found["least"] or 0, found["most"] or 0
    alone = {c for c, d in zip(cuts, cuts[1:]) if c == d} | {_NULL}
    borders = sorted({*cuts, *(c + 1 for c in alone if c < most), least} - {_NULL})  # twice SEGMENTS and one at most
    ends = [*borders[1:], most + 1]
    # segment 0 holds null ids alone; where a key belongs is found by binary search
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    listed = F.array(*[F.lit(b).cast("long") for b in borders])

    def nearer(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(borders)) & (F.get(listed, at + step - 1) <= F.col("key")), at + step).otherwise(at)

    rows = rows.withColumn("segment", F.aggregate(steps, F.lit(0), nearer))
    counts = {r["segment"]: r["n"] for r in rows.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # one row a segment
    segments = range(len(borders) + 1)
    pieces = F.get(F.array(*[F.lit(-(-counts.get(s, 0) // RUN_DOCS)).cast("long") for s in segments]), F.col("segment"))
    low = F.get(F.array(*[F.lit(float(b)) for b in [0, *borders]]), F.col("segment"))
    wide = F.get(F.array(*[F.lit(float(max(1, e - b))) for b, e in zip([0, *borders], [1, *ends])]), F.col("segment"))
    one_id = F.get(F.array(*[F.lit(e - b <= 1) for b, e in zip([0, *borders], [1, *ends])]), F.col("segment"))
    by_hash = F.shiftrightunsigned(F.col("text_hash").bitwiseXOR(F.lit(_NULL)), 11) / float(1 << 53)
    share = F.when(one_id, by_hash).otherwise((F.col("key").cast("double") - low) / wide)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(pieces - 1, F.floor(share * pieces))))
    last = {r["segment"]: r["part"] for r in rows.groupBy("segment").agg(F.max("part").alias("part")).collect()}  # one row a segment
    full = sorted(last)
    return rows, {s: (full[i - 1], last[full[i - 1]]) for i, s in enumerate(full)}


def edit_and_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text, edited, kept, edited_kept (arrays of kept grams),
    near_edited and near_next.

    ``edited`` is the text whose last quarter of code points gives way to as many first ones
    of the next document by id (all of them if it is shorter). Its kept grams up to the edit are
    the text's own, and those inside a long enough piece of the next document are that document's,
    moved; only what windows see of the two borders of the piece is hashed again.
    Null text counts as empty, null ids come first; repeated rows follow each other; very long
    texts are taken whole; no rows give no rows; ids that are no whole numbers raise an error
    (ANSI); other columns are ignored whatever their names.
    """
    own, before = runs(docs, doc_id, text)
    own = own.repartition("segment", "part")  # texts move here and nowhere else
    here = Window.partitionBy("segment", "part").orderBy("key", "text_hash")
    rows = own.withColumn("kept", kept_grams("text"))
    rows = rows.withColumns({"next": F.lead("text").over(here), "next_kept": F.lead("kept").over(here), "_last": F.lead("key").over(here).isNull()})

    # the head of each run goes to the last row of the run before it; rows stay where they are
    heads = runs_heads(own.select("segment", "part", "key", "text_hash", "text", F.row_number().over(here).alias("_at")), before)
    a, b = rows.alias("a"), heads.alias("b")
    same_run = (F.col("a.segment") == F.col("b.segment")) & (F.col("a.part") == F.col("b.part")) & F.col("a._last")
    rows = a.join(b.hint("merge"), same_run, "left").select(
        F.when(F.col("a.key") != _NULL, F.col("a.key")).alias("doc_id"), "a.text", "a.kept", F.coalesce("a.next", "b.head", F.lit("")).alias("next"), F.coalesce("a.next_kept", "b.head_kept").alias("next_kept")
    )
    rows = rows.withColumn("n", F.length("text")).withColumn("quarter", F.floor(F.col("n") / 4).cast("int"))
    rows = rows.withColumn("stays", F.col("n") - F.col("quarter"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("stays")), F.substring(F.col("next"), F.lit(1), F.col("quarter")))).drop("next")
    rows = rows.withColumn("took", F.length("edited") - F.col("stays"))
    # windows from ``same`` on reach into what was edited
    rows = rows.withColumn("same", F.greatest(F.lit(0), F.col("stays") - REACH))
    rows = rows.withColumn("again", F.greatest(F.lit(0), F.col("same") - (W - 1)))
    # of a long piece its two borders are hashed, [again, stays + EDGE) and the last EDGE code points
    long = F.col("took") >= 2 * EDGE
    border = F.when(long, F.col("stays") + EDGE - F.col("again")).otherwise(F.length("edited"))
    rows = rows.withColumns({"rest": F.substring(F.col("edited"), F.col("again") + 1, border), "ending": F.when(long, F.right("edited", F.lit(EDGE))).otherwise("")})
    rows = rows.withColumns({"rest_kept": kept_grams("rest", "again", "(same > 0)"), "ending_kept": kept_grams("ending", f"(stays + took - {EDGE})", "true")}).drop("rest", "ending")

    def place(p: Column) -> Column:
        return F.lit(_POSITIONS) - p.bitwiseAND(F.lit(_POSITIONS))

    # places of the piece, counted in the next document, whose windows all lie inside the piece
    first, last = F.lit(W - 1), F.col("took") - (REACH + 1)
    up_to = F.filter("kept", lambda p: place(p) < F.col("same"))
    inside = F.filter("next_kept", lambda p: place(p).between(first, last))
    parts = F.when(
        long,
        F.concat(
            up_to,
            F.filter("rest_kept", lambda p: place(p) < F.col("stays") + first),
            F.transform(inside, lambda p: p - F.col("stays")),
            F.filter("ending_kept", lambda p: place(p) > F.col("stays") + last),
        ),
    ).otherwise(F.concat(up_to, F.col("rest_kept")))
    rows = rows.withColumn("edited_kept", F.array_distinct(parts))
    rows = rows.withColumn("own_hashes", hashes(F.col("kept")))
    return rows.select(
        "doc_id",
        "text",
        "edited",
        "kept",
        "edited_kept",
        likeness(F.col("own_hashes"), hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("own_hashes"), hashes(F.col("next_kept"))).alias("near_next"),
    )


def runs_heads(rows: DataFrame, before: dict[int, tuple[int, int]]) -> DataFrame:
    """(segment, part, head, head_kept): for each run the first row of the run after it."""
    inside = F.lag("part").over(Window.partitionBy("segment").orderBy("part"))
    segments = range(max(before, default=0) + 1)
    into = F.get(F.array(*[F.struct(F.lit(before.get(s, (0, 0))[0]).alias("segment"), F.lit(before.get(s, (0, 0))[1]).cast("long").alias("part")) for s in segments]), F.col("segment"))
    heads = rows.where("_at = 1").withColumn("_to", F.when(inside.isNotNull(), F.struct("segment", inside.alias("part"))).otherwise(into))
    return heads.select("_to.segment", "_to.part", F.col("text").alias("head"), kept_grams("text").alias("head_kept"))
