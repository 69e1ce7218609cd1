"""Token ids in wavelet-matrix shard files.

Documents are range-partitioned by id, each partition tokenises its texts in id order and closes
a shard every ``shard_tokens`` tokens. A shard is one row of one Parquet file (zstd), written by
Spark, so any store that Spark reaches will do and lost tasks are simply run again.

The matrix is Huffman-shaped: plane ``l`` holds bit ``l`` of the codes that have one, so a token costs
its code's length. Codes are dealt so that, in the order a plane leaves (zeros first, stable), the tokens whose
code ends there come last; the next plane holds the others, and no position has to be mapped.

Fixed values of the file format (``payload``, little-endian):
  magic ``WVM2``; u32 version 2; u64 tokens n; u32 alphabet size a; u32 planes p; u64 documents d
  a x u32 alphabet and a x u64 counts, most frequent id first (ties: smallest id); the codes follow from the counts
  d x u64 end of each document
  p planes: u64 bits m, u64 zeros, ceil(m/512) x u32 ones before each 512-bit block,
  ceil(m/8) bytes of bits (first position in the low bit)
``access``, ``rank`` and ``select`` walk the planes with the block counts only. ``token_counts`` and
``token_places`` answer over all shards of a store: from the counts, and by walking up the planes.

Cases: null text is the empty text (the end id alone); a null id sorts first and is kept as null;
repeated rows are stored once each, rows of one id in the order of the input; a document longer than a shard has a shard to
itself; other columns are ignored; an empty table gives an empty store and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField, StructType)

from jobsmith.llm.tokens import END_ID, default_path, encoder
from jobsmith.session import work_path

BLOCK = 512
STEP = 1 << 16
_HEAD = struct.Struct("<4sIQIIQ")
_PLANE = struct.Struct("<QQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of descending counts (two queues; ties take the earlier node)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    weight, parent = counts[::-1].tolist(), [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                at, leaf = leaf, leaf + 1
            else:
                at, node = node, node + 1
            total += weight[at]
            parent[at] = new
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.array(depth[:n][::-1], np.int64)


def codes(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(planes x tokens bits, tokens whose code ends at each plane, in the order the plane leaves)."""
    planes = int(lengths.max(initial=0))
    bits, ended = np.zeros((planes, len(lengths)), bool), []
    open_ = [[0] * planes]  # prefixes in the order of their tokens
    for level in range(planes):
        open_ = [p[:level] + [b] + p[level + 1:] for b in (0, 1) for p in open_]
        ending = np.flatnonzero(lengths == level + 1)
        kept = len(open_) - len(ending)
        for token, prefix in zip(ending.tolist(), open_[kept:]):
            bits[:level + 1, token] = prefix[:level + 1]
        open_ = open_[:kept]
        ended.append(ending)
    return bits, ended


class WaveletMatrix:
    """Succinct sequence of token ids over its own alphabet."""

    def __init__(self, alphabet: np.ndarray, counts: np.ndarray, planes: list[tuple[int, int, np.ndarray, np.ndarray]], ends: np.ndarray):
        self.alphabet, self.counts, self.planes, self.ends = alphabet, counts, planes, ends
        self.n = int(counts.sum())
        self.lengths = code_lengths(counts)
        self.bits, self.ended = codes(self.lengths)
        self.place = {int(t): i for i, t in enumerate(alphabet)}

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray) -> WaveletMatrix:
        freq = np.bincount(ids)
        values = np.flatnonzero(freq)
        order = values[np.lexsort((values, -freq[values]))]
        out = cls(order.astype(np.uint32), freq[order].astype(np.uint64), [], np.asarray(ends, np.uint64))
        code = np.zeros(len(freq), np.uint64 if len(out.bits) > 32 else np.uint32)
        top = code.itemsize * 8 - 1
        for level, bits in enumerate(out.bits):
            code[order] |= bits.astype(code.dtype) << code.dtype.type(top - level)
        seq = code[ids]
        for level, ended in enumerate(out.ended):
            bit, m, zeros, ones = code.dtype.type(1 << (top - level)), len(seq), [], []
            packed = np.empty(-(-m // 8), np.uint8)
            for s in range(0, m, STEP):  # a step's arrays stay in the cache
                part = seq[s:s + STEP]
                one = (part & bit) != 0
                packed[s // 8:s // 8 + -(-len(part) // 8)] = np.packbits(one, bitorder="little")
                ones.append(part.take(np.flatnonzero(one)))
                zeros.append(part.take(np.flatnonzero(~one)))
            out.planes.append((m, sum(map(len, zeros)), _block_counts(packed), packed))
            seq = np.concatenate([seq[:0], *zeros, *ones])[:m - int(out.counts[ended].sum())]  # the others end here
        return out

    def to_bytes(self) -> bytes:
        out = [_HEAD.pack(b"WVM2", 2, self.n, len(self.alphabet), len(self.planes), len(self.ends)),
               self.alphabet.astype("<u4").tobytes(), self.counts.astype("<u8").tobytes(), self.ends.astype("<u8").tobytes()]
        for m, zeros, blocks, bits in self.planes:
            out += [_PLANE.pack(m, zeros), blocks.astype("<u4").tobytes(), bits.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if len(data) < _HEAD.size:
            raise ValueError("not a wavelet-matrix shard")
        magic, version, n, a, p, d = _HEAD.unpack_from(data)
        if magic != b"WVM2" or version != 2:
            raise ValueError("not a wavelet-matrix shard")
        at = _HEAD.size
        alphabet = np.frombuffer(data, "<u4", a, at)
        counts = np.frombuffer(data, "<u8", a, at + 4 * a)
        ends = np.frombuffer(data, "<u8", d, at + 12 * a)
        at += 12 * a + 8 * d
        planes = []
        for _ in range(p):
            m, zeros = _PLANE.unpack_from(data, at)
            n_blocks, n_bytes = -(-m // BLOCK), -(-m // 8)
            at += _PLANE.size
            blocks = np.frombuffer(data, "<u4", n_blocks, at)
            planes.append((m, zeros, blocks, np.frombuffer(data, np.uint8, n_bytes, at + 4 * n_blocks)))
            at += 4 * n_blocks + n_bytes
        return cls(alphabet, counts, planes, ends)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        seq, back, have = np.empty(self.n, kind), np.empty(self.n, kind), 0
        for (m, zeros, _, bits), ended in zip(reversed(self.planes), reversed(self.ended)):
            seq[have:m] = np.repeat(ended.astype(kind), self.counts[ended].astype(np.int64))
            from_zeros, from_ones, have = 0, zeros, m
            for s in range(0, m, STEP):
                part = back[s:min(s + STEP, m)]
                one = np.unpackbits(bits[s // 8:(s + STEP) // 8], count=len(part), bitorder="little")
                at = np.flatnonzero(one)
                part[at] = seq[from_ones:from_ones + len(at)]
                from_ones += len(at)
                at = np.flatnonzero(one == 0)
                part[at] = seq[from_zeros:from_zeros + len(at)]
                from_zeros += len(at)
            seq, back = back, seq
        return self.alphabet[seq] if self.n else seq.astype(np.uint32)

    def _ones_before(self, plane: tuple[int, int, np.ndarray, np.ndarray], i: int) -> int:
        m, zeros, blocks, bits = plane
        if i >= m:
            return m - zeros
        b = i // BLOCK
        ones = int(blocks[b]) + int(_ONES[bits[b * BLOCK // 8:i // 8]].sum())
        return ones + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        for plane, ended in zip(self.planes, self.ended):
            m, zeros, _, bits = plane
            ones = self._ones_before(plane, i)
            i = zeros + ones if int(bits[i // 8]) >> (i % 8) & 1 else i - ones
            behind = i - (m - int(self.counts[ended].sum()))
            if behind >= 0:  # among the tokens that end here
                return int(self.alphabet[ended[np.searchsorted(np.cumsum(self.counts[ended]), behind, "right")]])
        raise AssertionError("a code ends at the last plane")

    def _range(self, place: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i ids lie behind its last plane."""
        low, high = 0, min(i, self.n)
        for plane, one in zip(self.planes, self.bits[:self.lengths[place], place]):
            a, b = self._ones_before(plane, low), self._ones_before(plane, high)
            low, high = (plane[1] + a, plane[1] + b) if one else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i ids."""
        place = self.place.get(int(token))
        if place is None:
            return 0
        low, high = self._range(place, i)
        return high - low

    def count(self, token: int) -> int:
        place = self.place.get(int(token))
        return 0 if place is None else int(self.counts[place])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0): up the planes, a search in the block counts on each."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self.place[int(token)]
        at = self._range(place, self.n)[0] + k
        for level in range(int(self.lengths[place]) - 1, -1, -1):
            m, zeros, blocks, bits = self.planes[level]
            one = bool(self.bits[level, place])
            nth = at - zeros if one else at
            before = blocks.astype(np.int64) if one else np.arange(len(blocks)) * BLOCK - blocks
            b = int(np.searchsorted(before, nth, "right")) - 1
            inside = np.unpackbits(bits[b * BLOCK // 8:(b + 1) * BLOCK // 8], count=min(BLOCK, m - b * BLOCK), bitorder="little")
            at = b * BLOCK + int(np.flatnonzero(inside == one)[nth - before[b]])
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """Positions of all occurrences in order."""
        place = self.place.get(int(token))
        if place is None:
            return np.zeros(0, np.int64)
        if (hits := int(self.counts[place])) <= 16:
            return np.array([self.select(token, k) for k in range(hits)], np.int64)
        at = np.arange(hits) + self._range(place, self.n)[0]
        for level in range(int(self.lengths[place]) - 1, -1, -1):
            m, zeros, _, bits = self.planes[level]
            one = bool(self.bits[level, place])
            here = np.flatnonzero(np.unpackbits(bits, count=m, bitorder="little") == one)
            at = here[at - zeros if one else at]
        return at


def _block_counts(bits: np.ndarray) -> np.ndarray:
    """Ones before each 512-bit block."""
    per_byte = _ONES[bits]
    starts = np.arange(0, len(bits), BLOCK // 8)
    per_block = np.add.reduceat(per_byte, starts, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
    return np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.uint32) if len(per_block) else per_block


_SHARD = [StructField("part", IntegerType()), StructField("number", IntegerType()), StructField("n_tokens", LongType()),
          StructField("payload", BinaryType())]


def _build_shards(path: str, shard_tokens: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), END_ID.to_bytes(4, "little")
        held, ids, tokens, number = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            wm = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), np.cumsum([len(x) // 4 for x in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens], pa.int64()),
                 pa.array([wm.to_bytes()], pa.binary()), pa.array([ids], pa.list_(id_type))],
                names=["part", "number", "n_tokens", "payload", "ids"])

        for batch in batches:
            enc, texts, keys = encoder(path).ids, batch.column(1), batch.column(0).to_pylist()
            for i, key in enumerate(keys):
                got = enc(texts[i].as_py() or "") + end
                if held and tokens + len(got) // 4 > shard_tokens:
                    yield shard()
                    held, ids, tokens, number = [], [], 0, number + 1
                held.append(got)
                ids.append(key)
                tokens += len(got) // 4
        if held:
            yield shard()
    return run


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = 4_000_000,
                part_bytes: int = 48_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of all documents in ascending id order, one shard per file."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    tie = F.monotonically_increasing_id()  # spreads rows that share an id over partitions, equal ones as well
    placed = (rows.withColumn("tie", tie).repartitionByRange(max(1, -(-total // part_bytes)), "id", "tie")
              .sortWithinPartitions("id", "tie").select("id", "text"))
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema["id"].dataType.simpleString()]
    schema = StructType([*_SHARD, StructField("ids", ArrayType(rows.schema["id"].dataType))])
    (placed.mapInArrow(_build_shards(tokenizer or default_path(), shard_tokens, id_type), schema)
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").mode("overwrite").parquet(path))


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            wm = WaveletMatrix.from_bytes(batch.column(3)[r].as_py())
            ids, ends = wm.decode().astype("<u4"), wm.ends.astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crcs = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(4)[r].values, pa.array(np.full(n, batch.column(0)[r].as_py()), pa.int32()),
                 pa.array(np.full(n, batch.column(1)[r].as_py()), pa.int32()), pa.array(starts),
                 pa.array(ends - starts), pa.array(crcs, pa.int64())],
                names=["id", "part", "number", "local", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document, decoded from the shard files."""
    shards = spark.read.parquet(path)
    index = shards.select("part", "number", "n_tokens")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start"))
    starts = (index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
              .select("part", "number", (F.col("inside") + F.col("part_start")).alias("shard_start")))
    id_type = shards.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", id_type), *_SHARD[:2], StructField("local", LongType()),
                         StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])
    rows = shards.select("part", "number", "n_tokens", "payload", "ids").mapInArrow(_read_docs, schema)
    return rows.join(starts, ["part", "number"]).select(
        F.col("id").alias(id_col), (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """``token, n``: how often each token occurs in the store (0 for none), read from the shards' counts."""
    asked = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                wm = WaveletMatrix.from_bytes(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([wm.count(t) for t in asked], pa.int64())], names=["token", "n"])

    found = spark.read.parquet(path).select("payload").mapInArrow(run, "token long, n long")
    none = spark.createDataFrame([(t, 0) for t in asked], "token long, n long")
    return found.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, path: str, tokens: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """``token, id_col, at``: every occurrence of the tokens, ``at`` counted from the document's first id."""
    asked = sorted(set(tokens))
    shards = spark.read.parquet(path)
    schema = StructType([StructField("token", LongType()), StructField(id_col, shards.schema["ids"].dataType.elementType), StructField("at", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                wm = WaveletMatrix.from_bytes(batch.column(0)[r].as_py())
                ends = wm.ends.astype(np.int64)
                for t in asked:
                    where = wm.occurrences(t)
                    for k in range(0, len(where), 500_000):
                        part = where[k:k + 500_000]
                        doc = np.searchsorted(ends, part, "right")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), t)), batch.column(1)[r].values.take(pa.array(doc)), pa.array(part - np.r_[0, ends][doc])], names=["token", id_col, "at"])

    return shards.select("payload", "ids").mapInArrow(run, schema)


def store_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the store in the shared folder and read it back."""
    path = work_path(docs.sparkSession, "token-store")
    write_store(docs, path, **options)
    return read_store(docs.sparkSession, path, options.get("id_col", "doc_id"))
