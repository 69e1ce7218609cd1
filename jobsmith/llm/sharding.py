"""Weighted rendezvous hashing of stable record keys over named shards.

For every shard a record draws ``u`` from md5(key:shard) and scores ``-ln(u) / weight``; the lowest
score wins. A further shard changes only the records whose best score it beats, so rows move only
into the new shard. Nothing but the key and the shard list decides.

The slot of a row in its shard follows a hash of the row, so slots are dealt in blocks: rows are
counted by (shard, block), block offsets are running sums over those counts, and rows are numbered
inside a block. Equal rows are counted first and numbered as one, so neither a shard nor a group of
copies meets in one task; the number of blocks grows with the table.

Cases: a null key is the key ``null``; null text has 0 bytes; equal rows share a shard and take
neighbouring slots; rows with one key stay together in one shard under any shard count; an empty
table gives an empty result; other columns are ignored; a weight of 0 or less is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsmith.llm.common import hash52, staged, text_of

SPAN = float(2**52)


def _scored(key: Column, shard: int, weight: float) -> Column:
    if weight <= 0:
        raise ValueError("shard weights must be positive")
    u = (hash52(F.concat(key, F.lit(f":{shard}"))).cast("double") + F.lit(0.5)) / F.lit(SPAN)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins the record with this key."""
    k = F.coalesce(key.cast("string"), F.lit("null"))
    return F.array_min(F.array(*[_scored(k, i, w) for i, w in enumerate(weights)]))["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0,
                    id_col: str = "doc_id", text_col: str = "text", block_rows: int = 20_000) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot, grown_shard``: one row per input row.

    ``size`` is the UTF-8 bytes of the text plus 1; ``grown_shard`` is the shard after one more
    shard of ``grown_weight`` joins.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    best = F.array_min(F.array(*[_scored(key, i, w) for i, w in enumerate(weights)]))
    light = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
             .select("id", (F.octet_length("text") + 1).cast("long").alias("size"),
                     F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
             .withColumn("best", best)
             .withColumn("grown", F.array_min(F.array("best", _scored(key, len(weights), grown_weight)))["shard"])
             .withColumn("place", hash52(F.concat_ws("|", key, F.col("text_crc32"), F.col("size"))))
             .select("id", "size", "text_crc32", F.col("best.shard").alias("shard"), "grown", "place"))
    columns = ["id", "size", "text_crc32", "shard", "grown", "place"]
    light = staged(light.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")), "shards")
    blocks = max(1, light.count() // (len(weights) * block_rows))
    dealt = light.withColumn("block", F.floor(F.col("place") / F.lit(SPAN) * F.lit(blocks)).cast("long"))
    counts = staged(dealt.groupBy("shard", "block").agg(F.sum("copies").alias("n")), "shard-blocks")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("place", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(offsets, ["shard", "block"]).withColumn("first", F.col("offset") + F.sum("copies").over(inside) - F.col("copies"))
    return (placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).cast("long").alias("slot"),
                    F.col("grown").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8, id_col: str = "doc_id",
                 files_per_shard: int = 8) -> None:
    """Write the rows as one folder per shard (``shard=N``), each shard dealt over several files."""
    out = docs.withColumn("shard", rendezvous_shard(F.col(id_col), weights))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    out.repartition(len(weights) * files_per_shard, "shard", spread).write.mode("overwrite").partitionBy("shard").parquet(path)
