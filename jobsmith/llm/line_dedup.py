"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A document is the sequence of its non-blank lines, each a hash (md5 of the line without blanks at
its ends) and a word count. Its windows are, for every line, the fewest lines from it on that hold
``min_words`` words and the fewest up to it, and two neighbours of ``min_words`` words or more each.
A run of ``min_words`` words or more that two places share is made of shared windows: they cover each
of its lines and each step between two lines. Which windows a run has depends on its lines alone.

1. Winnowing: of every window the line with the least hash (the last one on ties) is a fingerprint of
   its document. Neighbouring windows mostly share it, so a document has far fewer fingerprints than
   windows. Two places that share a window share its fingerprint, whatever stands around them.
2. Positions are joined on the fingerprint: one whose hash comes up at no other position in the corpus
   has no copy, and its windows go no further.
3. The positions that are left are refined by the content of their windows (128-bit hash). Of each content
   the first place, in (doc_id, line) order, stays; at every later place the window is a match.
4. A match is extended both ways: by the windows that begin or end next to it and have an earlier place as
   well, which need not be the same one. The runs that come of it are deleted: exactly those of
   ``min_words`` words or more that an earlier place has, whichever document holds it. A passage with many
   copies costs a row a copy. Blank lines inside a deleted run go with it.

What moves: hashes and counts of lines, a fingerprint's hash, the windows of those that come up again, and
each text once, to meet its deletions. Counts and first places are found map-side first, and the joins
with them read staged tables on both sides so that Spark can split a hot key.

Cases: null text stays null and empty text empty; rows are told apart by id and text, so repeated
rows (both equal) share their result and are not each other's copies; a null id sorts first; a text
without a repeat is returned as it was; all columns of the input are kept, and those that
clash with ``removed`` or ``n_lines`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsmith.llm.common import WORD, fresh, staged, text_of


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))


def _sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, no, h, w``: line numbers, hashes and word counts of the non-blank lines of a text."""
    lines = F.transform(F.split(text_of(text_col), "\n"), lambda x, i: F.struct(
        i.alias("no"), F.unhex(F.md5(F.btrim(x, F.lit(" \t\r\x0b\x0c")).cast("binary"))).alias("h"),
        F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.select(_row_key(docs, id_col, text_col).alias("key"), F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
    return rows.filter(F.size("lines") > 0).select(
        "key", F.col("lines.no").alias("no"), F.col("lines.h").alias("h"), F.col("lines.w").alias("w"))


def _fingerprints(sequences: DataFrame, min_words: int) -> DataFrame:
    """``key, h, windows``: the lines that are the minimum of a window, and the windows they stand for
    (``first, last``: original numbers of the end lines; ``k``: the content)."""
    lines = sequences.select("key", F.explode(F.arrays_zip("no", "h", "w")).alias("line")).select("key", "line.no", "line.h", "line.w")
    order = Window.partitionBy("key").orderBy("no")
    lines = (lines.withColumn("end", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
             .withColumn("start", F.col("end") - F.col("w"))
             .withColumn("next", F.lead(F.struct("no", "h", "w")).over(order)))
    # lines have a word at least, so both orders are the order of lines
    on = Window.partitionBy("key").orderBy("start").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("key").orderBy("end").rangeBetween(1 - min_words, 0)
    lines = (lines.withColumn("on", F.struct(F.max("no").over(on).alias("last"), F.max("end").over(on).alias("end"), F.collect_list(F.struct("h", "no")).over(on).alias("lines")))
             .withColumn("back", F.struct(F.min("no").over(back).alias("first"), F.min("start").over(back).alias("start"), F.collect_list(F.struct("h", "no")).over(back).alias("lines"))))

    def window(first: Column, last: Column, inside: Column) -> Column:
        least = F.array_min(F.transform(inside, lambda x: F.struct(x["h"].alias("h"), (-x["no"]).alias("back"))))
        h = inside["h"]
        k = F.struct(F.xxhash64(h).alias("a"), F.xxhash64(F.lit(min_words), h).alias("b"))
        return F.struct(least.alias("least"), F.struct(first.alias("first"), last.alias("last"), k.alias("k")).alias("window"))

    whole = F.col("on.end") - F.col("start") >= min_words  # not cut off by the end of the text
    # a window that holds min_words words without its last line; the others are some line's window onwards
    longer = F.col("start") - F.col("back.start") >= min_words
    both = (F.col("w") >= min_words) & (F.col("next.w") >= min_words)
    found = F.array(F.when(whole, window(F.col("no"), F.col("on.last"), F.col("on.lines"))),
                    F.when(longer, window(F.col("back.first"), F.col("no"), F.col("back.lines"))),
                    F.when(both, window(F.col("no"), F.col("next.no"), F.array(F.struct("h", "no"), F.struct("next.h", "next.no")))))
    found = lines.select("key", F.explode(F.array_compact(found)).alias("x"))
    # rows of a document lie together already: no shuffle
    return found.groupBy("key", F.col("x.least").alias("least")).agg(F.collect_list("x.window").alias("windows")).select("key", "least.h", "windows")


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, first, last``: runs of original line numbers (from 0) to delete, merged per document."""
    sequences = _sequences(docs, id_col, text_col).dropDuplicates(["key"])
    positions = staged(_fingerprints(sequences, min_words), "line-positions")
    again = staged(positions.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "line-again")
    met = positions.join(again.hint("merge"), "h", "left_semi").select("key", F.explode("windows").alias("x"))
    windows = staged(met.select("key", "x.first", "x.last", "x.k"), "line-windows")
    places = (windows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first")).alias("place"))
              .filter("n > 1").select("k", "place"))
    later = F.struct("key", "first") > F.col("place")
    runs = windows.join(staged(places, "line-firsts"), "k").filter(later).select("key", "first", "last")
    order = Window.partitionBy("key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (runs.withColumn("new", (F.col("first") > F.coalesce(reached, F.lit(-2)) + 1).cast("int"))
               .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return islands.groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated runs, ``n_lines`` (as read) and ``removed``
    (array of first and last line number of each deleted run; null if there is none)."""
    removed = staged(repeated_runs(docs, min_words, id_col, text_col).groupBy("key")
                     .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")), "line-removed")
    kept = [c for c in docs.columns if c not in ("removed", "n_lines")]
    key, runs = fresh("key", docs.columns), fresh("runs", docs.columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], _row_key(docs, id_col, text_col).alias(key))
    # by shuffle at every size: the deletions grow with the corpus
    joined = rows.hint("merge").join(removed.select(F.col("key").alias(key), F.col("runs").alias(runs)), key, "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: (i >= r["first"]) & (i <= r["last"]))), "\n")
    text = F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
                         F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.col(runs).alias("removed"))
