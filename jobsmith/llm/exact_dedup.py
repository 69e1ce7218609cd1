"""Exact deduplication by progressive refinement (DataFrame functions only).

Texts are equal when they agree after deleting blanks ``[\\x20\\x09-\\x0D]``. Three rounds, each
reading only what the one before left open:

1. byte length of the squeezed text; a length that occurs once is settled,
2. hash of the first ``prefix_chars`` characters within an open length,
3. sha-256 of the full squeezed text within an open (length, prefix) group.

Only ids, lengths and hashes are shuffled, never text, and always after map-side counting, so a
group that holds a third of all rows costs one row per map task in each count. The open groups
of a round go to the next scan by broadcast if they are at most ``max_broadcast_rows`` rows; with
more of them the round settles nothing and its rows all go on to the next (same result).

Cases: null text is the empty text and all empty texts form one group; equal length ties go to
the smallest doc_id; rows repeated with one doc_id share its fate (each is kept or none); a null
doc_id sorts first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsmith.llm.common import squeezed, staged, text_of


def _open_groups(rows: DataFrame, keys: list[str], name: str, limit: int) -> DataFrame | None:
    """The key values that occur more than once, or None if there are too many to broadcast."""
    many = staged(rows.groupBy(*keys).count().filter("count > 1").select(*keys), name)
    return many if many.count() <= limit else None


def _still_open(rows: DataFrame, groups: DataFrame | None, keys: list[str], flag: str) -> DataFrame:
    if groups is None:
        return rows.withColumn(flag, F.lit(True))
    marked = F.broadcast(groups.withColumn(flag, F.lit(True)))
    return rows.join(marked, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128,
                max_broadcast_rows: int = 200_000, digest_all: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_points, keep_id, group_size, kept, digest``.

    ``digest`` is the sha-256 (lowercase hex) of the squeezed text for rows that reached the last
    round, null for rows settled earlier; ``digest_all`` computes it for every row.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "id", F.char_length("text").cast("long").alias("n_points"), squeezed(F.col("text")).alias("squeezed"))
    rows = rows.withColumn("bytes", F.octet_length("squeezed"))
    prefix = F.xxhash64(F.substring("squeezed", 1, prefix_chars))

    lengths = _open_groups(rows.select("bytes"), ["bytes"], "dedup-lengths", max_broadcast_rows)
    open1 = _still_open(rows, lengths, ["bytes"], "open1").withColumn("prefix", F.when(F.col("open1"), prefix))
    heads = _open_groups(open1.filter("open1").select("bytes", "prefix"), ["bytes", "prefix"], "dedup-prefixes",
                         max_broadcast_rows)
    open2 = _still_open(open1, heads, ["bytes", "prefix"], "open2")
    full = F.sha2(F.col("squeezed"), 256)
    light = staged(open2.select("id", "n_points", "bytes", (F.col("open1") & F.col("open2")).alias("open"),
                                (full if digest_all else F.when(F.col("open1") & F.col("open2"), full)).alias("digest")),
                   "dedup-light")

    survivors = light.filter("open")
    groups = staged(
        survivors.groupBy("bytes", "digest")
        .agg(F.count(F.lit(1)).alias("group_size"),
             F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("id").alias("keep_id"))).alias("best"))
        .filter("group_size > 1").select("bytes", "digest", "group_size", F.col("best.keep_id").alias("keep_id"),
                                         (-F.col("best.shorter")).alias("keep_points")), "dedup-groups")
    in_group = survivors.join(groups, ["bytes", "digest"], "left")
    alone = light.filter("NOT open").select("*", F.lit(None).cast("long").alias("group_size"),
                                            F.lit(None).cast(light.schema["id"].dataType).alias("keep_id"),
                                            F.lit(None).cast("long").alias("keep_points"))
    every = in_group.select(*alone.columns).unionByName(alone)
    single = F.col("group_size").isNull()
    return every.select(
        F.col("id").alias(id_col), "n_points",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))).alias("kept"),
        "digest")
