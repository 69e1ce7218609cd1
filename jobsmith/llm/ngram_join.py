"""Exact Jaccard self-join of documents on word n-grams, by blocked sparse products.

A document is the set of its distinct 5-word shingles (64-bit hashes). Documents with equal sets are
one class; classes link when ``100 * overlap >= percent * union``. The steps:

1. One pass hashes every text: (id, set size, class key), and the shingles that come up often in
   one task's texts; their sums give the frequent shingles. All classes order their shingles
   alike: rare ones by hash, then frequent ones by count. A set of n that reaches the threshold
   with another must share one of its first ``n - ceil(percent n / 100) + 1`` shingles (its prefix).
2. Prefix postings (shingle, class, size), packed by block of shingles, are multiplied with
   themselves block by block: short posting lists add 1 to the overlap of each of their pairs, and
   the sums over all blocks are held against the least prefix overlap that the two sizes
   allow; pairs below go. A posting list longer than ``list_limit`` is not paired but tied to its
   first member. Long lists that the first pass did not call frequent are added to the frequent
   shingles and the step is run again.
3. The remaining pairs and ties fall into connected clumps. Any two classes that link are in one
   clump: they share short lists only, and then their prefix overlap was counted in full, or a
   long list ties them. The full sets of a clump's classes meet in chunks of ``chunk`` classes;
   the incidence of a chunk is multiplied with its transpose a block of shingles at a time, which
   gives all overlaps exactly. Each chunk of a large clump also holds the clump's first class; chunks are
   of one size band and meet pairwise only within a band or with the next one (sizes further apart cannot
   link) and as far as their classes are not in one component yet. Every product returns a spanning
   forest of its links, never all pairs. The text of a class is looked up by the id and the text hash of
   one of its rows.
4. Components of the links, then back to the documents by class.

Frequent shingles are the ``max_frequent`` most frequent at most (the only data that is broadcast;
8 bytes each); which ones they are changes the cost, never the result.

Cases: words are split at ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text with fewer than five
words is one shingle; null, empty and blank texts have no shingles and link with nothing; equal
texts, ties and repeated rows share a class; ids may repeat or be null (a component's id is its
smallest non-null id); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobsmith.llm.common import staged
from jobsmith.session import drop_staged

_POSTING = np.dtype([("h", "<u8"), ("cid", "<i8"), ("n", "<u4")])
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TALLY = 4_000_000


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for i in range(take):
        h = h * _M1 + w[i:len(w) - take + 1 + i]
        h ^= h >> np.uint64(31)
    h *= _M2
    return np.unique(h ^ (h >> np.uint64(29)))


def class_key(s: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def least(n: int, percent: int) -> int:
    """ceil(percent n / 100): the least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    size = len(s) - least(len(s), percent) + 1
    if not len(frequent):
        return s[:size]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often]
    if len(rare) >= size:
        return rare[:size]
    late = s[often][np.argsort(order[at[often]], kind="stable")]
    return np.concatenate([rare, late])[:size]


def _light(id_type: pa.DataType, local_min: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def tally() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = counts >= local_min
            k = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array(values[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], names=["id", "th", "n", "cid", "h", "df"])

        for batch in batches:
            texts, n, cid = batch.column(2), [], []
            for i in range(batch.num_rows):
                s = shingle_set(texts[i].as_py())
                n.append(len(s))
                cid.append(class_key(s))
                held.append(s)
                total += len(s)
                if total > TALLY:
                    yield tally()
                    held, total = [], 0
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()),
                                              pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["id", "th", "n", "cid", "h", "df"])
        yield tally()
    return run


def _postings(shared, percent: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, order = shared.value
        held, seen, total = [], set(), 0

        def packed() -> pa.RecordBatch:
            all_ = np.concatenate(held) if held else np.zeros(0, _POSTING)
            block = ((all_["h"] * _M1) >> np.uint64(40)) % np.uint64(blocks)
            by = np.argsort(block, kind="stable")
            all_, block = all_[by], block[by]
            starts = np.flatnonzero(np.r_[True, np.diff(block) != 0]) if len(block) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(block)]
            return pa.RecordBatch.from_arrays(
                [pa.array(block[starts].astype(np.int64)), pa.array([all_[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                names=["block", "payload"])

        for batch in batches:
            texts = batch.column(0)
            for i in range(batch.num_rows):
                s = shingle_set(texts[i].as_py())
                if not len(s) or (cid := class_key(s)) in seen:
                    continue
                seen.add(cid)
                p = prefix(s, frequent, order, percent)
                rows = np.empty(len(p), _POSTING)
                rows["h"], rows["cid"], rows["n"] = p, cid, len(s)
                held.append(rows)
                total += len(p)
                if total > TALLY // 2:
                    yield packed()
                    held, seen, total = [], set(), 0
        yield packed()
    return run


def _multiply(percent: int, list_limit: int, shared):
    """One block of shingles: overlap sums of short lists (kind 0), ties of long ones (1), long unexpected ones (2)."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        frequent = shared.value[0]
        rows = np.concatenate([np.frombuffer(x.as_py(), _POSTING) for x in table.column("payload")])
        rows = rows[np.lexsort((rows["cid"], rows["h"]))]
        rows = rows[np.r_[True, (np.diff(rows["h"]) != 0) | (np.diff(rows["cid"]) != 0)]]  # a class once a list
        starts = np.flatnonzero(np.r_[True, np.diff(rows["h"]) != 0])
        sizes = np.diff(np.r_[starts, len(rows)])
        a, b, out = [], [], {"kind": [], "a": [], "b": [], "na": [], "nb": [], "c": []}
        for m in np.unique(sizes[(sizes > 1) & (sizes <= list_limit)]).tolist():  # all lists of one length at a time
            at = starts[sizes == m]
            for i in range(m - 1):
                for j in range(i + 1, m):
                    a.append(at + i)
                    b.append(at + j)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            na, nb = rows["n"][a].astype(np.int64), rows["n"][b].astype(np.int64)
            fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            a, b = a[fits], b[fits]
            pairs = np.stack([rows["cid"][a], rows["cid"][b], rows["n"][a], rows["n"][b]], 1).astype(np.int64)
            by = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[by]
            first = np.flatnonzero(np.r_[True, (np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 0)]) if len(pairs) else np.zeros(0, int)
            for k, v in zip(("a", "b", "na", "nb"), pairs[first].T):
                out[k].append(v)
            out["c"].append(np.diff(np.r_[first, len(pairs)]))
            out["kind"].append(np.zeros(len(first), np.int64))
        for s, m in zip(starts[sizes > list_limit].tolist(), sizes[sizes > list_limit].tolist()):
            cids, h = rows["cid"][s:s + m], rows["h"][s]
            at = np.searchsorted(frequent, h)
            if at == len(frequent) or frequent[at] != h:
                for k, v in (("kind", 2), ("a", np.uint64(h).astype(np.int64)), ("b", 0), ("na", 0), ("nb", 0), ("c", m)):
                    out[k].append(np.array([v], np.int64))
            for k, v in (("kind", 1), ("a", cids[0]), ("b", cids[1:]), ("na", 0), ("nb", 0), ("c", 0)):
                out[k].append(np.broadcast_to(np.asarray(v, np.int64), m - 1))
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in out.items()})
    return run


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """All overlaps of a list of sets: incidence times its transpose, ``width`` shingles at a time."""
    m = len(sets)
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1  # a shingle of one set only adds to the diagonal
    place = np.cumsum(shared) - 1
    keep = shared[col]
    doc, col = doc[keep], place[col[keep]]
    by = np.argsort(col, kind="stable")
    doc, col = doc[by], col[by]
    out = np.zeros((m, m), np.int64)
    for s in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [s, s + width])
        part = np.zeros((m, width), np.float32)
        part[doc[lo:hi], col[lo:hi] - s] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def forest(cids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among some sets."""
    n = np.array([len(s) for s in sets])
    c = overlaps(sets)
    union = n[:, None] + n[None, :] - c
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(100 * c >= percent * union, 1)))):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((cids[i], cids[j]))
    return out


def _forests(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit, cid = table.column("unit").to_numpy(), table.column("cid").to_numpy()
        payload, edges = table.column("payload"), []
        order = np.lexsort((cid, unit))
        for part in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            part = part[np.r_[True, np.diff(cid[part]) != 0]]  # a class once
            if len(part) > 1:
                edges += forest(cid[part].tolist(), [np.frombuffer(payload[int(i)].as_py(), "<u8") for i in part], percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})
    return run


def components(edges: DataFrame, max_rounds: int | None = None, part_rows: int = 200_000, least_parts: int = 16) -> DataFrame:
    """``node, root`` (smallest node) of every node of an edge list (a, b), by alternating stars until nothing
    moves; with ``max_rounds``, components that have not settled by then raise. A round's tables are cut into
    parts of about ``part_rows`` edges, ``least_parts`` at least, and go once the next round's are written."""
    def written(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, tuple]:
        """The staged frame, with the number of its rows and the sum of their hashes."""
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum"))
        out = staged(df if rows is None else df.coalesce(max(least_parts, rows // part_rows)), name)
        return out, (seen.get["n"], seen.get["sum"])

    low, high = F.least("a", "b"), F.greatest("a", "b")
    now, mark = written(edges.filter("a <> b").select(low.alias("a"), high.alias("b")).dropDuplicates(), "edges")
    for done in count(1):
        n = mark[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written out so that the join reads plain shuffles and a hot node can be split
        mins, _ = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-min", n)
        large = both.join(mins, "a").filter("b > a AND m <> b").select(F.col("m").alias("a"), "b").dropDuplicates()
        large, stars = written(large, "edges-large", n)
        drop_staged(mins)
        mins, (hanging, _) = written(large.groupBy("b").agg(F.min("a").alias("m")), "edges-min", n)
        # nothing moved, so no node that others hang from hangs itself; and each hangs from one: these are stars
        if stars == mark and hanging == n:
            drop_staged(large, mins)
            break
        if done == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        small = large.join(mins, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        before, (now, mark) = now, written(small.filter("a <> b").dropDuplicates(), "edges", n)
        drop_staged(before, large, mins)
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).dropDuplicates())


def _clump_links(docs: DataFrame, members: DataFrame, percent: int, chunk: int, pack: int, broadcast_rows: int) -> DataFrame:
    """Links (spanning forests) among the classes of each clump; members: ``cid, clump, at, n`` (``at``: id and text hash)."""
    spark = docs.sparkSession
    total = members.count()
    wanted = members.select("cid", "clump", F.col("at.id").alias("at_id"), F.col("at.th").alias("at_th"))
    side = F.broadcast(wanted) if total <= broadcast_rows else wanted
    picked = docs.join(side, docs["id"].eqNullSafe(F.col("at_id")) & (docs["th"] == F.col("at_th"))).select("cid", "clump", "text")
    schema = "cid long, clump long, payload binary"

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that equal each other in id and text are one class
        for batch in batches:
            cids, texts, keep, sets = batch.column(0).to_pylist(), batch.column(2), [], []
            for i, cid in enumerate(cids):
                if cid in seen:
                    continue
                s = shingle_set(texts[i].as_py())
                if class_key(s) == cid:
                    seen.add(cid)
                    keep.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())),
                                              pa.array(sets, pa.binary())], names=["cid", "clump", "payload"])

    sets = staged(picked.mapInArrow(full_sets, schema), "ngram-sets")
    sizes = members.groupBy("clump").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("hub"))
    sizes = staged(sizes.withColumn("k", F.ceil(F.col("size") / F.lit(chunk)).cast("int")), "ngram-clumps")
    groups = max(1, total // pack)
    own = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    dealt = (sets.join(sizes, "clump")
             .withColumn("part", F.explode(F.when((F.col("cid") == F.col("hub")) & (F.col("k") > 1), F.sequence(F.lit(0), F.col("k") - 1))
                                           .otherwise(F.array(own)))))
    unit = F.xxhash64("clump", "part")
    run = _forests(percent)
    out = "a long, b long"
    group = F.when(F.col("k") == 1, F.pmod(unit, F.lit(groups))).otherwise(unit)
    links = staged(dealt.select("cid", "payload", unit.alias("unit"), group.alias("g")).groupBy("g").applyInArrow(run, out), "ngram-links")

    # sizes that link lie in one band or in two neighbouring ones
    band = F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) * F.lit(1 - 1e-9)).cast("int")
    large = staged(members.join(sizes.filter("k > 1"), "clump").select("cid", "clump", band.alias("band")), "ngram-large")
    if large.isEmpty():
        return links
    # chunks of a large clump meet where their classes are not in one component yet
    comps = components(links)
    large = staged(large.join(comps, large["cid"] == comps["node"], "left")
                   .select("cid", "clump", "band", F.coalesce("root", "cid").alias("comp")), "ngram-parts")
    comp_sizes = staged(large.groupBy("clump", "comp", "band").agg(F.count(F.lit(1)).alias("size")), "ngram-comps")
    few = comp_sizes.count() <= broadcast_rows  # the frames that are made of it have no more rows
    small = F.broadcast if few else lambda df: df
    open_ = comp_sizes.groupBy("clump").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("clump")
    pools = comp_sizes.groupBy("clump", "band").agg(F.sum(F.when(F.col("size") < chunk, F.col("size")).otherwise(0)).alias("pooled"))
    placed = (large.join(small(open_), "clump", "left_semi").join(small(comp_sizes), ["clump", "comp", "band"]).join(small(pools), ["clump", "band"])
              .withColumn("alone", F.col("size") >= chunk)
              .withColumn("owner", F.when(F.col("alone"), F.col("comp")))
              .withColumn("part", F.when(F.col("alone"), F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / F.lit(chunk))))
                          .otherwise(F.pmod(F.xxhash64("cid"), F.greatest(F.ceil(F.col("pooled") / F.lit(chunk)), F.lit(1)))))
              .withColumn("piece", F.xxhash64("clump", "band", F.coalesce("owner", F.lit(0)), "alone", "part")))
    placed = staged(placed.select("cid", "clump", "band", "owner", "piece"), "ngram-pieces")
    pieces = staged(placed.select("clump", "band", "owner", "piece").dropDuplicates(), "ngram-piece-list")
    # a band meets itself (each pair once) and the next one
    near = pieces.select("clump", F.explode(F.array("band", F.col("band") + 1)).alias("to"), F.col("band").alias("own"), "owner", "piece")
    left, right = near.alias("l"), pieces.alias("r")
    meet = left.join(right, (F.col("l.clump") == F.col("r.clump")) & (F.col("l.to") == F.col("r.band")))
    meet = meet.filter((F.col("l.own") < F.col("r.band")) | (F.col("l.piece") <= F.col("r.piece")))
    meet = meet.filter(F.col("l.owner").isNull() | F.col("r.owner").isNull() | (F.col("l.owner") != F.col("r.owner")))
    meet = meet.select(F.col("l.piece").alias("p"), F.col("r.piece").alias("q"), F.xxhash64("l.piece", "r.piece").alias("unit"))
    sides = meet.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"), "unit")
    cross = placed.join(sides, "piece").select("cid", "unit").join(sets.select("cid", "payload"), "cid")
    more = staged(cross.select("cid", "payload", "unit", F.col("unit").alias("g")).groupBy("g").applyInArrow(run, out), "ngram-links")
    return links.unionByName(more)


def ngram_join(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", list_limit: int = 96,
               max_frequent: int = 500_000, frequent_from: int = 24, local_min: int = 3, chunk: int = 256, pack: int = 2000,
               block_bytes: int = 16_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: ``id_col, n_shingles, class_id, component_id``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]
    schema = StructType([StructField("id", id_type), *[StructField(c, LongType()) for c in ("th", "n", "cid", "h", "df")]])
    first = staged(rows.mapInArrow(_light(arrow_id, local_min), schema), "ngram-first")
    light = first.filter("cid IS NOT NULL").select("id", "th", "n", "cid")
    classes = staged(light.filter("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.min(F.struct("id", "th")).alias("at"), F.first("n").alias("n")), "ngram-classes")

    often = (first.filter("h IS NOT NULL").groupBy("h").agg(F.sum("df").alias("df")).filter(F.col("df") >= frequent_from)
             .orderBy(F.desc("df"), "h").limit(max_frequent).toPandas())  # max_frequent numbers at most
    known = dict(zip(often["h"].tolist(), often["df"].tolist()))
    weight = classes.agg(F.sum(F.col("n"))).first()[0] or 0  # one number
    blocks = max(16, int(weight * (100 - percent) / 100 * _POSTING.itemsize // block_bytes))
    while True:
        h = np.array(list(known), np.int64).astype(np.uint64)
        df = np.array(list(known.values()), np.int64)
        by = np.argsort(h)
        h, df = h[by], df[by]
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, df))] = np.arange(len(h))
        shared = spark.sparkContext.broadcast((h, rank))
        found = staged(rows.select("text").mapInArrow(_postings(shared, percent, blocks), "block long, payload binary").groupBy("block")
                       .applyInArrow(_multiply(percent, list_limit, shared), "kind long, a long, b long, na long, nb long, c long"), "ngram-pairs")
        new = {r["a"]: r["c"] for r in found.filter("kind = 2").orderBy(F.desc("c"), "a").limit(max(0, max_frequent - len(known))).toLocalIterator()}
        if not new or len(known) >= max_frequent:
            break
        known |= new
    # the least prefix overlap that sizes na and nb allow: whole overlap less the longer rest
    whole = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    rest = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    counted = (found.filter("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
               .filter(F.col("c") >= whole - rest).select("a", "b"))
    ties = found.filter("kind = 1").select("a", "b").dropDuplicates()
    clumps = components(counted.unionByName(ties))
    members = staged(clumps.join(classes, F.col("node") == F.col("cid")).select("cid", F.col("root").alias("clump"), "at", "n"), "ngram-members")
    links = _clump_links(rows, members, percent, chunk, pack, broadcast_rows)
    roots = components(links)
    reached = staged(classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "cid").alias("root")), "ngram-roots")
    named = reached.groupBy("root").agg(F.min("rep").alias("component"))
    named = reached.join(staged(named, "ngram-names"), "root").select("cid", "component")
    return (light.join(named, "cid", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"),
                    F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id")))
