"""Spelling variants: words one edit apart, each tied to a far more frequent neighbour.

1. Every text is read once as maximal runs of letters; a task counts its runs and sends (word, n).
   Words of ``min_length`` code points and ``min_count`` occurrences in all documents are the vocabulary.
2. The vocabulary is cut into blocks by agreeing ends. Two words one edit apart, the shorter of ``m``
   code points, agree in their first ``h = m // 2`` code points or in their last ``m - h``. A block
   (m, lo, tail) holds the words of m and of m + 1 code points with one head of ``lo`` and one end of
   ``tail``; what is between, the middle, is still open. A block of more than ``block_words`` words is
   halved again in the same way, until it fits or its middle is one code point, when the alphabet
   bounds it. Each pair has exactly one block: where an end was chosen, pairs that agree in the
   whole front half belong to the sibling.
3. In a block the middles are sorted, with the common prefix of each and the one before (LCP). Every
   word of m code points scans this list by dynamic programming in a band of one edit: rows up to
   the LCP are kept, only the rest of a word is worked out, and where a row exceeds one edit the scan
   goes on behind all words that share that prefix. All scans of a task step together in numpy.
4. A block returns a line a word (near words, the most frequent one); they are summed over blocks.
   Roots follow the forms by pointer doubling; counts rise tenfold a step, so chains are short.

What moves: (word, n) once a task, then about four small rows a word. No task holds a group that
grows with the corpus, and no pair of words is written.

Cases: null and empty texts have no words; a null id is the empty string; very long texts are read
as a stream of runs; repeated rows count repeatedly; equal counts are decided by code-point order;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobsmith.llm.common import staged
from jobsmith.session import drop_staged

RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: a task sends its counts when it holds so many distinct words
TALLY = 400_000
LONG_TEXT = 4_000_000
#: cells (words times code points) worked on at once
CELLS = 8_000_000


def slipped(run: str, seed: int, every: int) -> str:
    """The run, or for one in ``every`` hashes the run without one code point."""
    h = zlib.crc32(run.encode("utf-8"), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _tally(every: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        runs = re.compile(RUN)

        def packed() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= min_length]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text:
                    continue
                seed = zlib.crc32(((ids[i].as_py() or "") + ":").encode("utf-8"))
                if len(text) < LONG_TEXT:
                    found = Counter(runs.findall(text.translate(_LOWER)))
                else:  # no list of all runs of a very long text
                    found = Counter(m.group().translate(_LOWER) for m in runs.finditer(text))
                for w, n in found.items():
                    # a run loses one code point at most
                    if len(w) >= min_length:
                        held[slipped(w, seed, every)] += n
                if len(held) > TALLY:
                    yield packed()
                    held.clear()
        yield packed()
    return run


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all texts with their number of occurrences."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(_tally(every, min_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _transitions() -> np.ndarray:
    """Next row by (row, which of three query code points equal the next code point), rows being three
    cells capped at 2 edits: the distance to the query's prefix one shorter, equal and one longer."""
    out = np.zeros(27 * 8, np.int8)
    for state in range(27):
        a, b, c = state // 9, state // 3 % 3, state % 3
        for bits in range(8):
            x = min(a + (not bits & 1), b + 1, 2)
            y = min(b + (not bits & 2), c + 1, x + 1, 2)
            z = min(c + (not bits & 4), y + 1, 2)
            out[state * 8 + bits] = x * 9 + y * 3 + z
    return out


_NEXT = _transitions()
_DEAD = 26  # all three cells at 2
_START = 2 * 9 + 0 * 3 + 1


def scan(middles: np.ndarray, lengths: np.ndarray, starts: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart, as row numbers, in sorted blocks.

    ``middles``: code points, a row a word, 0 behind its end; each block sorted, beginning at ``starts``.
    Rows of ``short`` code points are queries, the others have one more.
    """
    total, width = len(middles), short + 1
    none = np.zeros(0, np.int64)
    if not total:
        return none, none
    differ = np.ones((total, width + 1), bool)
    differ[1:, :width] = middles[1:] != middles[:-1]
    lcp = np.minimum(differ.argmax(1), np.minimum(lengths, np.r_[0, lengths[:-1]]))
    lcp[starts] = -1
    block_end = np.repeat(np.r_[starts[1:], total], np.diff(np.r_[starts, total]))
    # behind[d][i]: the next word after i that shares at most d code points with the one before it
    behind = np.empty((width + 1, total), np.int64)
    behind[-1] = np.arange(1, total + 1)
    for d in range(width):
        stop = np.r_[np.flatnonzero(lcp <= d), total]
        behind[d] = stop[np.searchsorted(stop, np.arange(total), "right")]
    query = np.flatnonzero(lengths == short)
    # a query's code points with one cell before and two behind that equal nothing
    probe = np.full((len(query), short + 3), -1, np.int32)
    probe[:, 1:short + 1] = middles[query, :short]
    begin = np.repeat(starts, np.diff(np.r_[starts, total]))
    rows = np.full((len(query), width + 1), _START, np.int8)
    active, word, depth, end = np.arange(len(query)), begin[query], np.zeros(len(query), np.int64), block_end[query]
    found_q, found_w = [], []
    while len(active):
        c = middles[word, depth]
        bits = (probe[active, depth] == c) + 2 * (probe[active, depth + 1] == c) + 4 * (probe[active, depth + 2] == c)
        row = _NEXT[rows[active, depth].astype(np.int64) * 8 + bits]
        depth = depth + 1
        rows[active, depth] = row
        dead = row == _DEAD
        whole = ~dead & (depth == lengths[word])
        if whole.any():
            # a word of equal length ends on the middle cell, one of one more on the cell before
            cell = np.where(lengths[word] == short, row // 3 % 3, row // 9)
            hit = whole & (cell == 1)
            found_q.append(query[active[hit]])
            found_w.append(word[hit])
        onward = dead | whole
        if onward.any():
            word = np.where(dead, behind[np.minimum(depth, width) - 1, word], np.where(whole, word + 1, word))
            stay = word < end
            depth = np.where(onward, np.where(stay, lcp[np.minimum(word, total - 1)], 0), depth)
            active, word, depth, end = active[stay], word[stay], depth[stay], end[stay]
    return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (none, none)


def _block_lines(m: int, lo: int, tail: int, words: list[str], counts: np.ndarray, groups: np.ndarray) -> tuple[list[str], list, list, list]:
    """Lines (word, near words, best count, best word) of blocks of one shape; ``groups`` numbers their blocks."""
    middles = [w[lo:len(w) - tail] for w in words]
    by = sorted(range(len(words)), key=lambda i: (groups[i], middles[i]))
    words, middles, counts, groups = [words[i] for i in by], [middles[i] for i in by], counts[by], groups[by]
    short = m - lo - tail
    lengths = np.fromiter(map(len, middles), np.int64, len(middles))
    cells = np.zeros((len(middles), short + 1), np.int32)
    flat = np.frombuffer("".join(middles).encode("utf-32-le", "surrogatepass"), "<u4")
    cells[np.arange(short + 1) < lengths[:, None]] = flat
    starts = np.flatnonzero(np.r_[True, np.diff(groups) != 0])
    q, w = scan(cells, lengths, starts, short)
    if tail and len(q):  # these agree in the whole front half: their block is the sibling
        ours = (lengths[w] == short) | (cells[q, :short] != cells[w, :short]).any(1)
        q, w = q[ours], w[ours]
    if not len(q):
        return [], [], [], []
    longer = lengths[w] > short  # longer words do not scan: tell them as well
    a, b = np.r_[q, w[longer]], np.r_[w, q[longer]]
    rank = np.empty(len(words), np.int64)  # head and end are one in a block: the order of middles is that of words
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, np.diff(a) != 0])
    return ([words[i] for i in a[first].tolist()], np.diff(np.r_[first, len(a)]).tolist(), counts[b[first]].tolist(), [words[i] for i in b[first].tolist()])


def _near(key: tuple, table: pa.Table) -> pa.Table:
    """All blocks of a pack, shape by shape, a bounded number of cells at a time."""
    m, lo, tail = (table.column(c).to_numpy() for c in ("m", "lo", "tail"))
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    heads = [(w[:k], w[len(w) - t:]) for w, k, t in zip(words, lo.tolist(), tail.tolist())]
    out: tuple = ([], [], [], [])
    shapes: dict = {}
    for i, shape in enumerate(zip(m.tolist(), lo.tolist(), tail.tolist())):
        shapes.setdefault(shape, {}).setdefault(heads[i], []).append(i)
    for shape, blocks in sorted(shapes.items()):
        room = max(1, CELLS // (shape[0] - shape[1] - shape[2] + 1))
        some: list[list[int]] = []
        held = 0

        def work() -> None:
            index = [i for block in some for i in block]
            number = np.repeat(np.arange(len(some)), [len(block) for block in some])
            for to, lines in zip(out, _block_lines(*shape, [words[i] for i in index], counts[index], number)):
                to.extend(lines)

        for block in blocks.values():
            if len(block) < 2:
                continue
            if some and held + len(block) > room:
                work()
                some, held = [], 0
            some.append(block)
            held += len(block)
        if some:
            work()
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()),
                     "best_n": pa.array(out[2], pa.int64()), "best": pa.array(out[3], pa.string())})


def _blocks(words: DataFrame, min_length: int, block_words: int) -> DataFrame:
    """``word, n, m, lo, tail, block``: every word in the blocks where it can meet a near word."""
    size = F.char_length("word")
    half = F.floor(F.col("m") / 2).cast("int")
    rows = (words.withColumn("m", F.explode(F.array(size, size - 1))).filter(F.col("m") >= min_length)
            .withColumn("at", F.explode(F.array(F.struct(half.alias("lo"), F.lit(0).alias("tail")),
                                                F.struct(F.lit(0).alias("lo"), (F.col("m") - half).alias("tail")))))
            .select("word", "n", "m", "at.lo", "at.tail"))
    # equal hashes of different blocks only cost: blocks are told apart by their words later
    block = F.xxhash64("m", "lo", "tail", F.substring("word", 1, F.col("lo")), F.substring("word", F.char_length("word") - F.col("tail") + 1, F.col("tail")))
    done = None
    while True:
        rows = staged(rows.withColumn("block", block), "spelling-rows")
        asks = F.sum((F.char_length("word") == F.col("m")).cast("int"))
        sizes = staged(rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"), asks.alias("asks")).filter("size > 1 AND asks > 0"), "spelling-sizes")
        # both sides are written tables, so that a hot block's rows can be split
        met = rows.join(sizes, "block")
        middle = F.col("m") - F.col("lo") - F.col("tail")
        fits = (F.col("size") <= block_words) | (middle <= 1)
        seen = Observation()
        part = staged(met.withColumn("fits", fits).observe(seen, F.count(F.when(~fits, 1)).alias("open")), "spelling-blocks")
        drop_staged(rows, sizes)
        ready = part.filter("fits").select("word", "n", "m", "lo", "tail", "block")
        done = ready if done is None else done.unionByName(ready)
        if not seen.get["open"]:
            return done
        h = F.floor(middle / 2).cast("int")
        rows = (part.filter("NOT fits")
                .withColumn("at", F.explode(F.array(F.struct((F.col("lo") + h).alias("lo"), F.col("tail")),
                                                    F.struct(F.col("lo"), (F.col("tail") + middle - h).alias("tail")))))
                .select("word", "n", "m", "at.lo", "at.tail"))


def _roots(words: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, by pointer doubling."""
    at = staged(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        seen = Observation()
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, at = at, staged(at.join(step, "root", "left").observe(seen, F.count("further").alias("moved"))
                                .select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        drop_staged(before)
        if not seen.get["moved"]:
            return at


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, every: int = 31,
                      block_words: int = 400, pack_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row a word of the vocabulary.

    ``form`` is the near word of largest count (ties: first in code-point order) that occurs at least
    ``factor`` times as often; ``root`` follows forms to the last one. ``min_length`` is 2 at least.
    """
    if min_length < 2:
        raise ValueError("words need two code points")
    words = staged(vocabulary(docs, min_length, min_count, every, id_col, text_col), "spelling-words")
    blocks = _blocks(words, min_length, block_words)
    packs = max(1, blocks.count() // pack_rows)
    near = (blocks.withColumn("pack", F.pmod("block", F.lit(packs))).select("word", "n", "m", "lo", "tail", "pack").groupBy("pack")
            .applyInArrow(_near, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    has = -F.col("best.n") >= factor * F.col("n")
    known = staged(words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, -F.col("best.n")).alias("form_n")), "spelling-forms")
    return (known.join(_roots(known), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
