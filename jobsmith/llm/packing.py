"""Sum-of-squares packing of tokenised documents into sequences of at most ``capacity`` tokens.

One pass tokenises every text where it lies (no text or ids are shuffled) and yields a light row
per piece. Documents longer than a sequence are cut into full pieces, the first one shorter; a
full piece is a sequence of its own. The other pieces are dealt by hash into groups of about
``group_pieces`` (their number grows with the corpus), and each group is packed in one task: the
pieces come in falling size, and each goes where the sum over all gaps of the squared number of
open sequences with that residual gap becomes smallest; a new sequence is opened only when no
open one has room. A group costs at most a few part-filled sequences.

Cases: null text is the empty text, whose ids are the end id alone; repeated rows are packed
once each; ties between gaps take the smallest; long texts are cut, never dropped; a null id
is carried; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from jobsmith.llm.common import staged
from jobsmith.llm.tokens import END_ID, default_path, encoder


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size by the sum-of-squares rule, largest sizes first."""
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    far = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        here = count[s:]
        if here.any():
            after = 2 * count[: capacity + 1 - s] + 1  # the gap that is left gains one
            after[0] = 0  # a full sequence is closed
            change = np.where(here > 0, after - 2 * here + 1, far)
            gap = s + int(change.argmin())
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def _cut_batches(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            enc = encoder(path).ids
            texts, row, piece, start, length, crc = batch.column(1), [], [], [], [], []
            for i in range(batch.num_rows):
                ids = enc(texts[i].as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * s:4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def _pack_table(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets = pack_group(table.column("length").to_numpy(), capacity)
        group = table.column("group").to_numpy()
        return (table.drop_columns(["group"])
                .append_column("sequence_id", pa.array((group << 32) + bins, pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))
    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, group_pieces: int = 50_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["id"], StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("ids_crc32", LongType())])
    pieces = staged(rows.mapInArrow(_cut_batches(path or default_path(), capacity), schema), "pieces")
    full = F.col("length") == capacity
    groups = max(1, -(-pieces.filter(~full).count() // group_pieces))
    # the row number keeps repeated rows from meeting in one group
    deal = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    alone = pieces.filter(full).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                                       F.lit(0).cast("long").alias("offset"))
    out = StructType([*schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    packed = (pieces.select("*", deal.alias("group")).filter(~full).groupBy("group")
              .applyInArrow(_pack_table(capacity), out))
    return packed.unionByName(alone).withColumnRenamed("id", id_col)
