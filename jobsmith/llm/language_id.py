"""Language identification by error-correcting output codes over character n-grams.

Each learned language has a codeword of +1/-1 bits. Every bit has one binary classifier: naive-Bayes
weights over hashed 1- to 3-grams of the words (with word ends), averaged over the n-grams of a
document and put on a logistic scale. Decoding sums the logistic loss of every bit against each
codeword, weighted by how well the bit does on the learning sample; the codeword with the least
loss wins, and a document whose best two codewords are close is flagged ambiguous.

Learning: the ``max_languages`` languages with most rows in the learning fold, and of each about
``per_language`` rows (all of smaller ones; fewer where that would pass ``sample_rows`` in all), chosen
by a hash of id and text; equal rows are one. These are documented bounds. n-gram counts are summed by
Spark into (language, bucket) cells, so what reaches the driver has a fixed size. Prediction reads every
whole text in one map-only pass and keeps all columns of the input; the n-grams of the words that are new
to a task are hashed and weighed together in numpy.

Cases: null text or a text without a letter (Unicode category L) is ``und`` with score 0; languages are the
non-null values of ``lang`` in the learning fold; with none of them every text is ``und``, with one it is
the answer for every text with a letter; ties go to the language that sorts first; repeated rows
get equal answers; a clashing column of the input is replaced by the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from jobsmith.llm.common import fold, fresh, hash52, staged

BUCKETS = 1 << 15
MAX_WORDS = 400_000
#: words of a text that are looked up at once, and characters of texts that share a look-up of new words
WORDS_AT_ONCE, CHARS_AT_ONCE = 200_000, 1_000_000
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def letters(word: str) -> list[str]:
    """The runs of letters of a word; number signs such as ``²`` or ``Ⅷ`` are none."""
    if word.isalpha():
        return [word]
    runs, held = [], ""
    for c in word + " ":
        if c.isalpha():
            held += c
        elif held:
            runs.append(held)
            held = ""
    return runs


def grams(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the lengths 1, 2, 3: buckets of the n-grams of all words (their ends marked), and where each word's begin."""
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    for n in (1, 2, 3):
        inner = 1 if n == 1 else 0  # the marks alone say nothing
        k = size - n + 1 - 2 * inner
        first = np.cumsum(k) - k
        at = np.arange(k.sum()) + np.repeat(begin + inner - first, k)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + flat[at + i]) * _MIX[i]
            h ^= h >> np.uint64(29)
        yield ((h ^ h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64), first


def words(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lower case, a bounded number at a time."""
    if text:
        if len(text) < CHARS_AT_ONCE:
            yield _WORD.findall(text.lower())
        else:
            found = (m.group() for m in _WORD.finditer(text.lower()))
            while part := list(islice(found, WORDS_AT_ONCE)):
                yield part


def codewords(k: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """k x b matrix of +1/-1: every two-way split for up to 5 languages, else the best of many random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        splits = [s for r in range(1, k) for s in combinations(range(k), r) if 0 in s]
        return np.array([[1.0 if c in s else -1.0 for s in splits] for c in range(k)])
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(bits, int(np.ceil(10 * np.log2(k))))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        if (np.abs(code.sum(0)) == k).any():
            continue  # a bit must split the languages
        apart = int((bits - code @ code.T)[np.triu_indices(k, 1)].min()) // 2
        if apart > far:
            best, far = code, apart
    return best


class Scorer:
    """Mean n-gram weight of each bit for texts; words keep their sums, so a word that comes again costs one look-up."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.concatenate([weights, np.ones((len(weights), 1), np.float32)], 1)  # the last one counts n-grams
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, self.weights.shape[1]), np.float32)

    def _learn(self, new: list[str]) -> None:
        place, have = self.place, len(self.place)
        while have + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for s in range(0, len(new), 20_000):
            part = new[s:s + 20_000]
            runs = [(i, run) for i, w in enumerate(part) for run in letters(w)]
            total = np.zeros((len(part), self.weights.shape[1]), np.float32)
            if runs:
                by_run = sum(np.add.reduceat(self.weights[bucket], first, axis=0) for bucket, first in grams([run for _, run in runs]))
                np.add.at(total, [i for i, _ in runs], by_run)
            self.sums[have + s:have + s + len(part)] = total
        place.update(zip(new, range(have, have + len(new))))

    def _sum(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The sums of each list of words."""
        if len(self.place) > MAX_WORDS:
            self.place.clear()
        found = [list(map(self.place.get, part)) for part in parts]
        new = dict.fromkeys(w for part, at in zip(parts, found) if None in at for w, x in zip(part, at) if x is None)
        if new:
            self._learn(list(new))
            found = [list(map(self.place.get, part)) if None in at else at for part, at in zip(parts, found)]
        return [self.sums[at].sum(0, dtype=np.float64) for at in found]

    def margins(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Per text the mean weights, or None without a letter."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, held_chars = [], 0

        def settle() -> None:
            for i, total in zip([i for i, _ in held], self._sum([part for _, part in held])):
                out[i] = total if out[i] is None else out[i] + total
            held.clear()

        for i, text in enumerate(texts):
            for part in words(text):
                held.append((i, part))
                held_chars += sum(map(len, part))
                if held_chars > CHARS_AT_ONCE:
                    settle()
                    held_chars = 0
        settle()
        return [None if total is None or not total[-1] else total[:-1] / total[-1] for total in out]


class LanguageModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, scale: np.ndarray, shift: np.ndarray,
                 trust: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights
        self.scale, self.shift, self.trust = scale, shift, trust

    def losses(self, margins: np.ndarray) -> np.ndarray:
        f = margins * self.scale + self.shift
        return (self.trust * np.logaddexp(0.0, -self.code * f)).sum(1)

    def decide(self, margins: np.ndarray | None) -> tuple[str, float, float]:
        """(language, probability-like score, lead over the second)."""
        if margins is None or not self.languages:
            return "und", 0.0, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 1.0
        loss = self.losses(margins)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), float(p[best] - np.delete(p, best).max())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y = 1) by Newton steps with a light ridge."""
    a, b = 1.0 / (x.std() + 1e-9), 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-6, p - y
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = cells.setdefault(lang, np.zeros(BUCKETS))
            for part in words(text):
                runs = [run for w in part for run in letters(w)]
                for bucket, _ in grams(runs) if runs else ():
                    row += np.bincount(bucket, minlength=BUCKETS)
    for lang, row in cells.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                          pa.array(row[at])], names=["lang", "bucket", "n"])


def learning_sample(docs: DataFrame, per_language: int, sample_rows: int, max_languages: int, id_col: str = "doc_id") -> DataFrame:
    """``lang, text`` of about ``per_language`` different rows a language out of the learning fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", 5) != 0))
    drawn = hash52(F.concat(F.lit("lid:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.xxhash64("text").cast("string"))) / F.lit(float(2**52))
    sizes = (rows.select("lang", "id", F.xxhash64("text").alias("th")).distinct().groupBy("lang").count()
             .orderBy(F.desc("count"), "lang").limit(max_languages))
    most = staged(sizes, "lid-languages")
    each = F.least(F.lit(float(per_language)), F.lit(float(sample_rows)) / F.lit(float(max(1, most.count()))))
    rates = most.select("lang", (each / F.col("count")).alias("rate"))  # max_languages rows at most
    chosen = rows.withColumn("drawn", drawn).join(F.broadcast(rates), "lang").filter(F.col("drawn") < F.col("rate"))
    return staged(chosen.groupBy("lang", "drawn").agg(F.min("text").alias("text")).select("lang", "text"), "lid-sample")


def fit(docs: DataFrame, per_language: int = 1500, sample_rows: int = 20_000, max_languages: int = 256, id_col: str = "doc_id") -> LanguageModel:
    sample = learning_sample(docs, per_language, sample_rows, max_languages, id_col)
    cells = (sample.mapInArrow(_count_grams, "lang string, bucket int, n double")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x BUCKETS cells at most
    languages = sorted(cells["lang"].unique().tolist())
    counts = np.zeros((len(languages), BUCKETS))
    counts[cells["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), cells["bucket"].to_numpy(dtype=int)] = cells["n"]
    code = codewords(len(languages))
    if len(languages) <= 1:
        none = np.zeros(code.shape[1])
        return LanguageModel(languages, code, np.zeros((BUCKETS, code.shape[1]), np.float32), none, none, none)
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights = np.stack([np.log(share[b > 0].mean(0)) - np.log(share[b < 0].mean(0)) for b in code.T], 1).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.margins(batch.column(1).to_pylist())
            keep = [i for i, m in enumerate(got) if m is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())),
                                              pa.array([got[i].tolist() for i in keep], pa.list_(pa.float64()))], names=["lang", "m"])

    known = sample.mapInArrow(margins, "lang string, m array<double>").toPandas()  # bits numbers a sample row
    m = np.array(known["m"].tolist())
    bits = code[known["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int)]
    fits = [_logistic(m[:, b], (bits[:, b] > 0).astype(float)) for b in range(code.shape[1])]
    scale, shift = (np.array(x) for x in zip(*fits))
    right = ((m * scale + shift > 0) == (bits > 0)).mean(0)
    trust = np.clip(2 * right - 1, 0.01, None)
    return LanguageModel(languages, code, weights, scale, shift, trust / trust.mean())


def identify(docs: DataFrame, model: LanguageModel, ambiguous_lead: float = 0.2, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    @F.pandas_udf(schema)
    def decided(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        scorer = Scorer(known.weights)
        for texts in batches:
            got = list(map(known.decide, scorer.margins(texts.tolist())))
            yield pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                                "ambiguous": [g[2] < ambiguous_lead for g in got]})

    fields = ("lang_pred", "score", "ambiguous")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in fields]
    answer = fresh("decided", docs.columns)
    out = docs.select(*kept, decided(F.col(text_col).cast("string")).alias(answer))
    return out.select(*kept, *[F.col(f"{answer}.{f}").alias(f) for f in fields])
