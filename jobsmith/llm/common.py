"""Helpers shared by the corpus operators: null rules, text measures, hashes, staged tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsmith.session import cut_lineage

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with marks behind it until no column of ``taken`` is called so (names differ in more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def squeezed(col: Column) -> Column:
    """The text without any blank character."""
    return F.regexp_replace(col, BLANK + "+", "")


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def hash52(col: Column) -> Column:
    """A 52-bit number from md5; the same in every engine, so SQL can repeat it."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 13), 16, 10).cast("long")


def fold(id_col: str, m: int) -> Column:
    """crc32(doc_id as text) mod m: the fold that splits learning rows from held-out rows."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once under spark.checkpoint.dir and read back (survives lost executors)."""
    return cut_lineage(df, name)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a staged frame of at most ``max_rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df
