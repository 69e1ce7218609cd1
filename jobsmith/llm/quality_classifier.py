"""Document quality: random-indexing word vectors, pooled, and a two-layer numpy network.

Words are runs of letters (lower case, with a mark for all-capital ones), digits or signs, hashed
to ``BUCKETS`` rows. Each row has a fixed sparse index vector (``NONZERO`` entries of +1/-1); its
word vector is that plus the index vectors of the neighbours it meets in the learning sample
(two words either side), brought to length 1. A document pools its words by count and by distinct
word, with length, repetition and vector-length figures beside them. The network is trained on
the learning sample; its logits are divided by a temperature fitted on a part of the sample that
it has not seen.

Learning: texts and labels of at most ``sample_rows`` labelled ids of the learning fold (lowest
hash of the id first; one text an id), a documented bound. Neighbour counts are summed by Spark by word row.
Scoring reads every whole text in one map-only pass.

Cases: null and empty texts pool to zeros and get the network's score for that; labels of null
or of ids that are not in the table are not used; several labels of an id count once (the
largest); without both classes in the sample every score is the share of label 1 (0.5 without
labels); repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from jobsmith.llm.common import fold, hash52, staged

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 4, 2
MAX_WORDS = 300_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice(np.float32([-1, 1]), BUCKETS)
    return out


class Words:
    """Word rows, remembered between documents."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def rows(self, tokens: list[str]) -> list[int]:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known, out = self.known, []
        for t in tokens:
            b = known.get(t)
            if b is None:
                b = known[t] = zlib.crc32((t.lower() + ("^" if len(t) > 1 and t.isupper() else "")).encode("utf-8", "replace")) % BUCKETS
            out.append(b)
        return out


def pooled(text: str | None, words: Words, vectors: np.ndarray) -> np.ndarray:
    """Count-pooled vector, distinct-word vector, and five figures."""
    out = np.zeros(2 * DIM + 5, np.float32)
    if not text or not (count := Counter(_TOKEN.findall(text))):
        return out
    rows, n = words.rows(list(count)), np.fromiter(count.values(), np.float32, len(count))
    v, total = vectors[rows], n.sum()
    by_count, by_word = n @ v / total, v.mean(0)
    p = n / total
    out[:DIM], out[DIM:2 * DIM] = by_count, by_word
    out[2 * DIM:] = (np.log1p(total), len(count) / total, np.linalg.norm(by_count), p.max(), (p * p).sum())
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, index = Words(), index_vectors()
    context, met = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS, bool)
    for batch in batches:
        for text in batch.column(1).to_pylist():
            seq = np.array(words.rows(_TOKEN.findall(text or "")), np.int64)
            met[seq] = True
            for d in range(1, min(WINDOW, len(seq) - 1) + 1):
                for a, b in ((seq[:-d], seq[d:]), (seq[d:], seq[:-d])):
                    order = np.argsort(a, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0])
                    context[a[order][starts]] += np.add.reduceat(index[b[order]], starts, axis=0)
    at = np.flatnonzero(met)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(context[at]), pa.list_(pa.float32()))], names=["row", "v"])


def _sum_vectors(key: tuple, table: pa.Table) -> pa.Table:
    rows, v = table.column("row").to_numpy(), np.stack(table.column("v").to_numpy(zero_copy_only=False))
    at, inverse = np.unique(rows, return_inverse=True)
    total = np.zeros((len(at), DIM), np.float32)
    order = np.lexsort((*v.T[:2], inverse))  # one order of sums, whatever the order of the rows
    np.add.at(total, inverse[order], v[order])
    return pa.table({"row": pa.array(at, pa.int32()), "v": pa.array(list(total), pa.list_(pa.float32()))})


class Network:
    """Two layers (tanh, logit) trained by Adam on standardised inputs."""

    def __init__(self, base: float = 0.5):
        self.base, self.layers, self.temperature = base, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, hold: np.ndarray, hidden: int = 24, epochs: int = 80, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.std
        params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step, learn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, np.flatnonzero(~hold)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                h = np.tanh(z[part] @ params[0] + params[1])
                g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(g, params[2]) * (1 - h * h)
                grads = [z[part].T @ back + 1e-4 * params[0], back.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
                step += 1
                for i, d in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    params[i] = params[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = params
        if hold.any():
            logits = self.logits(x[hold])
            loss = lambda t: np.logaddexp(0, np.where(y[hold] > 0, -logits, logits) / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.std @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, id_col: str = "doc_id",
        text_col: str = "text") -> tuple[np.ndarray, Network]:
    """(word vectors, network) from a bounded sample of labelled rows of the learning fold."""
    spark = docs.sparkSession
    drawn = hash52(F.concat(F.lit("quality:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    chosen = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
              .filter(F.col("quality").isNotNull() & F.col("id").isNotNull() & (fold("id", 3) != 1))
              .groupBy("id").agg(F.max("quality").alias("quality"))
              .withColumn("drawn", drawn).orderBy("drawn", "id").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most sample_rows small rows are broadcast; of the texts of one id the one with the least hash is taken
    met = texts.join(F.broadcast(chosen), "id").groupBy("id", "quality", "drawn")
    sample = staged(met.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("id", "text", "quality", "drawn"), "quality-sample")
    sums = (sample.select("id", "text").mapInArrow(_neighbours, "row int, v array<float>")
            .withColumn("part", F.col("row") % 32).groupBy("part")
            .applyInArrow(lambda k, t: _sum_vectors(k, t.select(["row", "v"])), "row int, v array<float>").toPandas())  # BUCKETS x DIM numbers
    vectors = index_vectors()
    if len(sums):
        vectors[sums["row"].to_numpy(dtype=int)] += np.stack(sums["v"].to_list())
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = [pooled(t, words, shared.value).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float32()))], names=["quality", "drawn", "x"])

    rows = (sample.mapInArrow(pool, "quality int, drawn bigint, x array<float>").toPandas()  # sample_rows feature rows
            .sort_values("drawn", kind="stable"))
    y = rows["quality"].to_numpy(dtype=float)
    if len(y) < 20 or len(np.unique(y)) < 2:
        return vectors, Network(float(y.mean()) if len(y) else 0.5)
    return vectors, Network().fit(np.stack(rows["x"].to_list()), y, rows["drawn"].to_numpy() % 5 == 0)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: the calibrated probability of label 1 for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        words = Words()
        for batch in batches:
            texts, x = batch.column(1), np.zeros((batch.num_rows, 2 * DIM + 5), np.float32)
            for i in range(batch.num_rows):
                x[i] = pooled(texts[i].as_py(), words, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x).astype(float))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(scored, StructType([rows.schema["id"], StructField("score", DoubleType())]))
            .withColumnRenamed("id", id_col))
