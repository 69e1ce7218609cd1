"""Quality rules: base statistics per document and an isolation forest over them.

One map-only pass over the whole texts gives the statistics of every document. The base rules are
fixed: a document fails with fewer than ``min_words`` words, or when more than a fifth of its
words stand in 5-word windows that the text repeats. For the others, two isolation forests (random
splits over the statistics) give each document a mean path length; short paths are anomalies. One sees
what the words are made of (length of words, symbols, other signs, capitals), the other how they are
arranged (length of the text, repeated lines, repeated and distinct words, words a line): together, the
many ways to be odd in one would hide those in the other.
A forest grows on label-1 rows with a tenth of points drawn evenly over the range of all
labelled rows, so that it also splits where sound documents do not vary, and a large group of
alike bad documents cannot pass for the rule. The two cuts are calibrated together over all labelled
rows: they are the scores that best tell label 0 from label 1, a document being dropped by either, while
at least ``keep_good`` of the label-1 rows stay.

Learning: the forests are grown on at most ``sample_rows`` labelled rows (lowest hash of the id
first), a documented bound; the cuts use a histogram over every labelled row.

Cases: null text has no words and fails the base rules; blanks are ``[\\x20\\x09-\\x0D]``; without
labels (or only one class) the forest grows on a sample of all rows, or not at all, and nothing
more than the base rules is dropped; labels of an id count once (the largest); repeated rows
get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from jobsmith.llm.common import hash52, staged

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_distinct", "n_marks")
_DROP_BLANKS = str.maketrans("", "", "\x20\x09\x0a\x0b\x0c\x0d")
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
BINS = 1000


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in windows found twice or more."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    count, covered, upto = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    """The nine counts of a text, in the order of STATS and MORE."""
    if not text:
        return (0,) * 9
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at [\x20\x09-\x0D] only
    bare = text.translate(_DROP_BLANKS)
    plain = bare.translate(_DROP_SYMBOLS)
    lines = [x for x in text.split("\n") if x.translate(_DROP_BLANKS)]
    return (len(words), len(bare), len(bare) - len(plain), len(lines) - len(set(lines)), repeated_words(words), len(lines),
            sum(map(str.isupper, plain)), len(set(words)), sum(not c.isalnum() for c in plain))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        rows = [statistics(texts[i].as_py()) for i in range(batch.num_rows)]
        columns = list(zip(*rows)) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["id", *STATS, *MORE])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the nine counts of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_measured, StructType([rows.schema["id"], *[StructField(c, LongType()) for c in STATS + MORE]]))


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def arrangement_figures(t: dict[str, np.ndarray]) -> np.ndarray:
    """How the words are arranged: log of the words, repeated lines and words, distinct words against what a text of
    that length has, words a line; shares are damped where a short text would swing them."""
    words, lines = np.maximum(t["n_words"], 1), np.maximum(t["n_lines"], 1)
    return np.stack([np.log2(words), t["n_dup_lines"] / (lines + 4), t["n_repeat_words"] / (words + 20),
                     np.log2(np.maximum(t["n_distinct"], 1)) / np.log2(words + 1), np.log2(words / lines + 1)], 1).astype(float)


def rule_figures(t: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as figures a document, damped where a short text would swing them:
    mean word length, symbols and other signs a word, capitals a character."""
    words = np.maximum(t["n_words"], 1)
    return np.stack([t["word_chars"] / words, t["n_symbols"] / words, t["n_marks"] / words,
                     t["n_upper"] / (t["word_chars"] + 100)], 1).astype(float)


FIGURES = (rule_figures, arrangement_figures)


class Forest:
    """Isolation forest: trees of random splits over subsamples, as flat arrays."""

    def __init__(self, x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 5):
        rng, self.trees = np.random.default_rng(seed), []
        self.size = min(subsample, len(x))
        limit = int(np.ceil(np.log2(max(self.size, 2))))
        for _ in range(trees):
            self.trees.append(self._grow(x[rng.choice(len(x), self.size, replace=False)], limit, rng))

    @classmethod
    def over_background(cls, good: np.ndarray, all_: np.ndarray, share: float = 0.1, seed: int = 6) -> Forest:
        """A forest over good rows and evenly drawn points in the range of all rows."""
        rng = np.random.default_rng(seed)
        spread = rng.uniform(all_.min(0), all_.max(0), (max(1, int(len(good) * share)), all_.shape[1]))
        return cls(np.concatenate([good, spread]))

    @staticmethod
    def mean_path(n: float) -> float:
        """Mean path of an unsuccessful search among n points."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    @classmethod
    def _grow(cls, x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, child, path = [], [], [], []
        todo = [(np.arange(len(x)), 0)]
        while todo:  # breadth first; a node's children stand side by side
            nxt = []
            first = len(feature) + len(todo)
            for rows, depth in todo:
                low, high = x[rows].min(0), x[rows].max(0)
                wide = np.flatnonzero(high > low)
                if depth >= limit or len(rows) <= 1 or not len(wide):
                    feature.append(0)
                    value.append(np.inf)
                    child.append(-1)
                    path.append(depth + cls.mean_path(len(rows)))
                    continue
                f = int(rng.choice(wide))
                v = rng.uniform(low[f], high[f])
                feature.append(f)
                value.append(v)
                child.append(first + len(nxt))
                path.append(0.0)
                left = x[rows, f] <= v
                nxt += [(rows[left], depth + 1), (rows[~left], depth + 1)]
            todo = nxt
        return np.array(feature), np.array(value), np.array(child), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, child, path in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = child[at] >= 0
                if not inner.any():
                    break
                right = x[rows, feature[at]] > value[at]
                at = np.where(inner, child[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.mean_path(self.size), 1e-9))


def calibrate(hist: np.ndarray, keep_good: float) -> tuple[int | None, int | None]:
    """hist: rows of (bin of either score, label 0, label 1). The pair of bins from which on rows are dropped (None: never)
    with the best difference of dropped shares that keeps enough label-1 rows; of equal pairs the highest bins."""
    if not len(hist) or not hist[:, 2].sum() or not hist[:, 3].sum():
        return None, None
    size = int(hist[:, :2].max()) + 2
    kept = np.zeros((2, size, size))  # kept[., a, b]: rows below a in the first score and below b in the second
    np.add.at(kept, (slice(None), hist[:, 0].astype(int) + 1, hist[:, 1].astype(int) + 1), hist[:, 2:].T)
    kept = kept.cumsum(1).cumsum(2)
    bad, good = 1 - kept / kept[:, -1:, -1:]
    gain = np.where(good <= 1 - keep_good + 1e-12, bad - good, -np.inf)[::-1, ::-1]
    a, b = (size - 1 - x for x in np.unravel_index(int(gain.argmax()), gain.shape))
    return (int(a) if a < size - 1 else None), (int(b) if b < size - 1 else None)


def apply_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, keep_good: float = 0.995,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts, ``base_failed``, two anomaly scores (0 to 1) and ``kept`` of every document."""
    spark = docs.sparkSession
    stats = staged(measure(docs, id_col, text_col).withColumn("base_failed", base_failed()), "rule-stats")
    known = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
             .filter(F.col("id").isNotNull() & F.col("quality").isNotNull()).groupBy("id").agg(F.max("quality").alias("quality")))
    labelled = staged(stats.filter(~F.col("base_failed")).join(known, "id"), "rule-labelled")  # counts only, no text
    drawn = hash52(F.concat(F.lit("rules:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    source = stats.filter(~F.col("base_failed")) if labelled.isEmpty() else labelled
    quality = F.col("quality") if "quality" in source.columns else F.lit(1)
    sample = (source.withColumn("drawn", drawn).orderBy("drawn", "id", *STATS).limit(sample_rows)
              .select(*STATS, *MORE, quality.alias("quality")).toPandas())  # sample_rows rows of ten numbers
    t, good = {c: sample[c].to_numpy() for c in STATS + MORE}, (sample["quality"] == 1).to_numpy()
    forests = [Forest.over_background(x[good], x) if good.sum() > 1 else None for x in (f(t) for f in FIGURES)]
    shared = spark.sparkContext.broadcast(forests)
    scores = ("anomaly", "anomaly_arrangement")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in STATS + MORE}
            for name, figures, forest in zip(scores, FIGURES, shared.value):
                batch = batch.append_column(name, pa.array(forest.score(figures(t)) if forest else np.zeros(batch.num_rows), pa.float64()))
            yield batch

    def with_scores(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(scored, StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in scores]]))

    bins = {c: F.floor(F.col(c) * BINS).cast("long") for c in scores}
    hist = (with_scores(labelled.select("id", "quality", *STATS, *MORE)).groupBy(*[b.alias(f"bin_{c}") for c, b in bins.items()])
            .agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")).toPandas())  # BINS x BINS rows at most
    dropped = F.lit(False)
    for c, cut in zip(scores, calibrate(hist.to_numpy(dtype=float), keep_good)):
        if cut is not None:
            dropped = dropped | (bins[c] >= cut)
    return with_scores(stats).withColumn("kept", ~F.col("base_failed") & ~dropped).withColumnRenamed("id", id_col)
