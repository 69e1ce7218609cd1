"""The registered queries of the corpus operators (production parameters, whole tables) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsmith.llm import language_id, quality_classifier
from jobsmith.llm.common import conversations, documents, fold, labels
from jobsmith.llm.conversations import repair_conversations
from jobsmith.llm.exact_dedup import exact_dedup
from jobsmith.llm.line_dedup import line_dedup
from jobsmith.llm.mixing import mix_documents
from jobsmith.llm.ngram_join import ngram_join
from jobsmith.llm.packing import pack_documents
from jobsmith.llm.quality_rules import STATS, apply_rules
from jobsmith.llm.sharding import shard_documents
from jobsmith.llm.simhash import simhash_components
from jobsmith.llm.spelling import spelling_variants
from jobsmith.llm.token_store import store_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), digest_all=True)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
                      F.col("digest").alias("text_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scores = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels(spark, sf_dir)))
    return scores.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    dropped = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0).cast("long")).alias("n_removed"),
                      "removed", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select("doc_id", *STATS, "base_failed", "kept", "anomaly", "anomaly_arrangement")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mix_documents(documents(spark, sf_dir))
    rows = units.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(conversations(spark, sf_dir))


QUERIES = {q.__name__: q for q in (
    op1_exact_dedup, op2_quality_classifier, op3_sharding, op4_language_id, op5_token_store, op6_line_dedup,
    op7_quality_rules, op8_ngram_join, op9_mixing, op10_packing, op11_spelling, op12_simhash, op13_conversations)}



ORACLE = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id
FROM documents d JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
