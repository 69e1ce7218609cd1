"""Corpus pipeline: language ID, line dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result
is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs`` (``n_chars``, where there is one, follows a changed text).

Rows that share an id are told apart by their text. An empty table runs through every stage and gives an
empty result; nulls are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobsmith.llm import language_id
from jobsmith.llm.common import WORD, documents, staged
from jobsmith.llm.line_dedup import line_dedup
from jobsmith.llm.mixing import mix_documents, row_hash
from jobsmith.llm.ngram_join import ngram_join
from jobsmith.llm.packing import pack_documents


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all other columns in one struct, so that no name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(df: DataFrame, like: DataFrame, changed: dict | None = None) -> DataFrame:
    changed = {"text": F.col("text")} | (changed or {})
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in like.columns])


def _row_key(docs: DataFrame) -> Column:
    """A string of id and text hash whose order is the order of ids (nulls last)."""
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-2**63))), 16, "0")  # the sign bit turned
    name = F.col("doc_id") if isinstance(docs.schema["doc_id"].dataType, StringType) else number
    return F.concat(F.coalesce(F.concat(F.lit("0"), name), F.lit("1")), F.lit("\x01"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose best two languages are too close to call."""
    out = language_id.identify(_packed(docs), language_id.fit(docs))
    return _unpacked(out.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out later repeats of runs of 50 words or more; a document that is left without a word goes."""
    out = line_dedup(_packed(docs)).filter(F.col("removed").isNull() | F.col("text").rlike(WORD))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _unpacked(out, docs, changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that link (5-word shingles, Jaccard 0.75 or more) the one with the smallest id stays, once.

    Rows are told apart by id and text; a null id comes last."""
    found = staged(ngram_join(docs.select(_row_key(docs).alias("key"), "text"), id_col="key"), "pipeline-groups")
    # a component is named by its smallest key; a text without shingles by its own
    keep = staged(found.filter(F.col("component_id") == F.col("key")).groupBy(F.col("key").alias("keep_key"))
                  .agg(F.count(F.lit(1)).alias("n")), "pipeline-keep")
    # by shuffle at every size: the rows that stay grow with the corpus
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(docs).alias("key"))
    out = rows.join(keep.hint("merge"), F.col("key") == F.col("keep_key"), "left_semi")
    out = out if keep.filter("n > 1").isEmpty() else out.dropDuplicates(["key"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    units = staged(mix_documents(docs).filter("copies > 0").select("id", "row_hash", "copies"), "pipeline-mix")
    rows = docs.select("doc_id", row_hash(docs).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = rows.join(units.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row_hash")))
    copied = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece."""
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising, the trained classifier and the exponential tilt are not expressible in SQL.
ORACLE_SQL = None
