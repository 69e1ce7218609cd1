"""SimHash near-duplicates by covering codes: fingerprints meet at the anchors of a code.

1. One pass reads every text: the XXH64 of each 4-word shingle (repeats included) votes on 64 bits; a
   bit is 1 if more than half of the hashes have it. Equal fingerprints are one class.
2. The 64 bits are cut into parts, each with a threshold ``t``: fingerprints that differ in ``most``
   bits or fewer differ in ``t`` or fewer of some part, because all ``t + 1`` together exceed
   ``most``. The anchors of a part are the words of a covering code: a Hamming code on its first
   ``2**r - 1`` bits, all values on the rest, so every value is within radius 1 of one anchor (its
   home; radius 0 and all values as anchors where ``r`` is 0). A fingerprint is replicated to all
   anchors within radius plus ``t``. If two are within ``t`` of each other, the second is within radius
   plus ``t`` of the first one's home.
3. At every anchor the fingerprints at home are compared with all others there, and what links is
   returned as a spanning forest, never as pairs. An anchor with more than ``chunk`` rows is dealt
   into chunks that share one hub; its chunks meet pairwise only as far as their members are not in
   one component by then, so a large group of near copies costs little more than its rows.
4. Components of the links, then back to the documents by fingerprint.

The code trades replicas against comparisons: of the ``LAYOUTS`` the one that costs least for the number of
distinct fingerprints is taken; which one it is changes the cost, never the result.

Cases: null, empty and blank texts have fingerprint zero, which links like any other; a text of fewer
than four words is one shingle; equal texts, ties and repeated rows share a class; ids may repeat or be
null (a component's id is its smallest non-null id); very long texts are hashed in pieces; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsmith.llm.common import small_side, staged
from jobsmith.llm.ngram_join import components

#: parts as (bits, threshold, r of the Hamming code)
LAYOUTS = (((23, 1, 4), (23, 1, 4), (18, 0, 0)),
           ((33, 2, 5), (31, 1, 5)))
#: assumed cost of a replicated row and of a comparison (in nanoseconds); they choose the layout
ROW_COST, PAIR_COST = 3000.0, 5.0
PIECE = 1 << 20
PAIRS = 2_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def fingerprint(text: str | None, width: int = 4, seed: int = 42, piece: int = PIECE) -> int:
    """The 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z and ASCII blanks only
    votes, total, at, carry, short = np.zeros(64, np.int64), 0, 0, [], []
    while at < len(data):
        end = at + piece
        if end < len(data):  # up to the next blank
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        words = carry + (data.split() if not at and end >= len(data) else data[at:end].split())
        at = end
        carry = words[1 - width:]
        if len(words) < width:
            short = words
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = np.r_[0, ends[:-1]]
        h = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(begins[:len(words) - width + 1].tolist(), (ends[width - 1:] - 1).tolist())),
                        np.uint64, len(words) - width + 1)
        total += len(h)
        for k in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(0, dtype=np.int64)
    if not total and short:
        return xxh64_intdigest(b" ".join(short), seed)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0]) if total else 0


def _fingerprints(width: int, seed: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), width, seed) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["id", "fp"])
    return run


def _check(layout: Sequence[tuple[int, int, int]], most: int) -> None:
    if sum(b for b, _, _ in layout) != 64 or any(2**r - 1 > b for b, _, r in layout):
        raise ValueError("parts must hold 64 bits and their codes")
    if sum(t + 1 for _, t, _ in layout) <= most:
        raise ValueError(f"thresholds of {layout} miss pairs that differ in {most} bits")


def patterns(bits: int, t: int, r: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By syndrome: the values whose XOR gives the anchors within radius + t, and the one that gives the home."""
    weight = (1 if r else 0) + t
    length = 2**r - 1 if r else 0
    by: list[list[int]] = [[] for _ in range(2**r)]
    for k in range(weight + 1):
        for places in combinations(range(bits), k):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < length else 0
            by[syndrome].append(sum(1 << p for p in places))
    home = [0] + [1 << (s - 1) for s in range(1, 2**r)]
    return [np.array(x, np.uint64) for x in by], np.array(home, np.uint64)


def syndromes(values: np.ndarray, r: int) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for p in range(2**r - 1 if r else 0):
        out ^= ((values >> np.uint64(p)) & np.uint64(1)) * np.uint64(p + 1)
    return out.astype(np.int64)


def _replicate(layout: Sequence[tuple[int, int, int]]):
    """``fp`` to ``key`` (part and anchor), ``fp``, ``home``."""
    tables = [patterns(*part) for part in layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).to_numpy(zero_copy_only=False)[at:at + 20_000].view(np.uint64)
                shift = 0
                for number, ((bits, _, r), (by, home)) in enumerate(zip(layout, tables)):
                    values = (fps >> np.uint64(shift)) & np.uint64(2**bits - 1)
                    shift += bits
                    s = syndromes(values, r)
                    for syndrome in np.unique(s).tolist():
                        here = s == syndrome
                        anchors = values[here][:, None] ^ by[syndrome][None, :]
                        is_home = np.broadcast_to(by[syndrome] == home[syndrome], anchors.shape)
                        keys = (anchors * np.uint64(len(layout)) + np.uint64(number)).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(fps[here], anchors.shape[1]).view(np.int64), pa.int64()),
                             pa.array(is_home.ravel(), pa.bool_())], names=["key", "fp", "home"])
    return run


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest value of its component) with the components of the edges a-b."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(most: int):
    """Links of all units of a pack: who is at home in a unit against everyone there."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit, fp = table.column("unit").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        by = np.argsort(unit, kind="stable")
        unit, fp, home = unit[by], fp[by], home[by]
        starts = np.flatnonzero(np.r_[True, np.diff(unit) != 0])
        sizes = np.diff(np.r_[starts, len(unit)])
        begin, size = np.repeat(starts, sizes)[home], np.repeat(sizes, sizes)[home]
        who = np.flatnonzero(home)
        a = b = np.zeros(0, np.uint64)
        reach, at = np.cumsum(size), 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, "right")))
            n = size[at:to]
            left = np.repeat(who[at:to], n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
            x, y = fp[left], fp[right]
            hit = (np.bitwise_count(x ^ y) <= most) & (x != y)
            a, b = spanning(np.r_[a, x[hit]], np.r_[b, y[hit]])
            at = to
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})
    return run


def _links(rows: DataFrame, most: int, chunk: int, pack_rows: int, broadcast_rows: int) -> DataFrame:
    """Links ``a, b`` (spanning forests) among rows ``key, fp, home``."""
    run, out = _compare(most), "a long, b long"
    total = rows.count()
    packs = F.lit(max(1, total // pack_rows))
    hot = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("hub")).filter(F.col("size") > chunk)
                 .withColumn("k", F.ceil(F.col("size") / F.lit(chunk)).cast("int")), "simhash-hot")
    if hot.isEmpty():
        dealt = rows.select(F.col("key").alias("unit"), "fp", "home", F.pmod(F.xxhash64("key"), packs).alias("pack"))
        return staged(dealt.groupBy("pack").applyInArrow(run, out), "simhash-links").dropDuplicates()
    met = rows.join(small_side(hot, broadcast_rows), "key", "left")
    slots = (F.when(F.col("k").isNull(), F.array(F.lit(0)))
             .when(F.col("fp") == F.col("hub"), F.sequence(F.lit(0), F.col("k") - 1))  # the hub sits in every chunk
             .otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))))
    dealt = met.withColumn("slot", F.explode(slots)).withColumn("unit", F.xxhash64("key", "slot"))
    # the hub links to whoever is near it, at home or not
    dealt = dealt.select("unit", "fp", (F.col("home") | F.coalesce(F.col("fp") == F.col("hub"), F.lit(False))).alias("home"),
                         F.when(F.col("k").isNull(), F.pmod("unit", packs)).otherwise(F.col("unit")).alias("pack"))
    links = staged(dealt.groupBy("pack").applyInArrow(run, out), "simhash-links").dropDuplicates()
    # chunks of a hot anchor meet as far as their members are not in one component yet
    comps = components(links)
    there = staged(rows.join(small_side(hot.select("key"), broadcast_rows), "key", "left_semi"), "simhash-there")
    there = staged(there.join(comps, there["fp"] == comps["node"], "left").select("key", "fp", "home", F.coalesce("root", "fp").alias("comp")), "simhash-comps")
    sizes = there.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    small = F.sum(F.when(F.col("size") < chunk, F.col("size")).otherwise(0))
    open_ = staged(sizes.groupBy("key").agg(small.alias("pooled"), F.count(F.lit(1)).alias("comps")).filter("comps > 1"), "simhash-open")
    alone = F.col("size") >= chunk
    share = F.ceil(F.when(alone, F.col("size")).otherwise(F.greatest("pooled", F.lit(1))) / F.lit(chunk))
    placed = (there.join(staged(sizes, "simhash-sizes"), ["key", "comp"]).join(small_side(open_, broadcast_rows), "key")
              .withColumn("owner", F.when(alone, F.col("comp")))
              .withColumn("piece", F.xxhash64("key", F.coalesce("owner", F.lit(0)), alone, F.pmod(F.xxhash64("fp"), share))))
    placed = staged(placed.select("key", "fp", "home", "owner", "piece"), "simhash-pieces")
    pieces = placed.select("key", "owner", "piece").dropDuplicates()
    left, right = pieces.alias("l"), pieces.alias("r")
    meet = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.piece") <= F.col("r.piece")))
    meet = meet.filter(F.col("l.owner").isNull() | F.col("r.owner").isNull() | (F.col("l.owner") != F.col("r.owner")))
    meet = meet.select(F.col("l.piece").alias("p"), F.col("r.piece").alias("q"), F.xxhash64("l.piece", "r.piece").alias("unit"))
    sides = staged(meet.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"), "unit"), "simhash-sides")
    cross = placed.join(sides, "piece").select("unit", "fp", "home", F.col("unit").alias("pack"))
    more = staged(cross.groupBy("pack").applyInArrow(run, out), "simhash-links")
    return links.unionByName(more).dropDuplicates()


def cheapest(count: int, most: int, layouts: Sequence = LAYOUTS) -> Sequence[tuple[int, int, int]]:
    """The layout that costs least for so many distinct fingerprints."""
    def cost(layout) -> float:
        balls = [sum(1 for k in range((1 if r else 0) + t + 1) for _ in combinations(range(b), k)) for b, t, r in layout]
        return (ROW_COST * sum(v / 2**r for v, (_, _, r) in zip(balls, layout))
                + PAIR_COST * count * sum(v / 2**b for v, (b, _, _) in zip(balls, layout)))
    for layout in layouts:
        _check(layout, most)
    return min(layouts, key=cost)


def simhash_components(docs: DataFrame, most: int = 4, width: int = 4, seed: int = 42, layouts: Sequence = LAYOUTS, chunk: int = 4000,
                       pack_rows: int = 200_000, broadcast_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, fingerprint`` (16 hex digits), ``component_id`` (its smallest id)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    light = staged(rows.mapInArrow(_fingerprints(width, seed, arrow_id), f"id {id_type.simpleString()}, fp long"), "simhash-rows")
    classes = staged(light.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    layout = cheapest(classes.count(), most, layouts)
    replicas = staged(classes.select("fp").mapInArrow(_replicate(layout), "key long, fp long, home boolean"), "simhash-anchors")
    roots = components(_links(replicas, most, chunk, pack_rows, broadcast_rows))
    reached = staged(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = staged(reached.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-names")
    named = staged(reached.join(names, "root").select("fp", "component_id"), "simhash-named")
    return (light.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
