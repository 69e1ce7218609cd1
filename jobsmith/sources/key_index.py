"""Which parts of a history may hold a key, without reading the history.

A part's index is a Bloom filter in slots of 32,768 bits: every key sets ``HASHES`` bits, and a slot is
one row (``bits`` of the whole filter, ``slot``, ``bitmap`` of 4,096 bytes) built by the engine's
bitmap aggregate. A filter has 16 to 32 bits a key, so about one key in a thousand is taken for
known by mistake; it is then looked up in the part's rows like any other, so results stay exact.
Lookups join the bits of a batch's keys with the slots; both sides are shuffled, nothing is collected
but the names of the parts to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 32_768
HASHES = 4


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two, one slot at least."""
    return max(SLOT_BITS, 1 << (16 * max(keys, 1) - 1).bit_length())


def _positions(key: Column, bits: Column) -> Column:
    first, step = F.xxhash64(F.lit("first"), key), F.xxhash64(F.lit("step"), key)
    # kept below 2**62, so that no sum overflows
    low = lambda h: F.pmod(h, F.lit(1 << 40))
    return F.array(*[F.pmod(low(first) + F.lit(i) * low(step), bits) for i in range(HASHES)])


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``bits, slot, bitmap`` of the keys."""
    at = keys.filter(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), F.lit(bits))).alias("at"))
    return (at.groupBy(F.floor(F.col("at") / SLOT_BITS).cast("long").alias("slot"))
            .agg(F.bitmap_construct_agg(F.pmod("at", F.lit(SLOT_BITS))).alias("bitmap"))
            .select(F.lit(bits).cast("long").alias("bits"), "slot", "bitmap"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


def candidates(keys: DataFrame, key: str, index: DataFrame, sizes: list[int], part: list[str]) -> DataFrame:
    """``*part, key`` for keys that a part may hold. ``index``: ``*part, bits, slot, bitmap``; ``sizes``: its values of ``bits``."""
    distinct = keys.select(F.col(key).alias("probe")).filter(F.col("probe").isNotNull()).distinct()
    probes = (distinct.withColumn("bits", F.explode(F.array(*[F.lit(b).cast("long") for b in sizes])))
              .withColumn("at", F.explode(F.array_distinct(_positions(F.col("probe"), F.col("bits")))))
              .withColumn("need", F.size(F.array_distinct(_positions(F.col("probe"), F.col("bits")))))
              .withColumn("slot", F.floor(F.col("at") / SLOT_BITS).cast("long")))
    hits = probes.join(index, ["bits", "slot"]).filter(has_bit(F.col("bitmap"), F.pmod("at", F.lit(SLOT_BITS))))
    found = hits.groupBy(*part, F.col("probe").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return found.filter("n = need").select(*part, key)
