"""Incremental runs on Structured Streaming.

Runs are told apart: a run has an id and writes only partitions of its own, so a second stream
with a new checkpoint (whose batch ids start at 0 again) never overwrites an older run's rows.

X1 ``stream_new_postings``: a growing folder of posting files -> per micro-batch keep-first ->
anti join against the history -> the new rows, in the history table's columns with the first-seen
stamp, into the partition (run_id, batch_id) of *this* batch. A replay of a batch reads the
history without its own partition and rewrites the same rows, so the sink is idempotent without a
transactional format. Beside each partition lies an index of its keys (``sources/key_index``): a
batch reads the rows of those partitions only that may hold one of its keys. ``compact_history`` puts
many partitions into one. History written by other means (no such partitions) is read as it is.

X2 ``stream_dedup_state``: engine-state variant (``dropDuplicates`` on the key).

X3 ``stream_enrich``: per micro-batch P8 -> J5 -> J4 -> J3 into a bucketed state (``sources/state``):
a batch joins and rewrites only the buckets of its keys. A state row keeps the place it was given:
``(version, origin, ordinal)``, compared in this order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsmith.operators.enrich import enrich_run, successful_only, with_canonical_url
from jobsmith.operators.identity import keep_first
from jobsmith.sources import key_index
from jobsmith.sources.folders import delete, exists, list_names, move, read_text, write_new
from jobsmith.sources.state import KEYLESS, Manifest, commit_state, create_state, manifest, read_state, touched_buckets

HISTORY_PARTITIONS = ["run_id", "batch_id"]
#: the run that compacted partitions belong to; their rows keep the run and batch that wrote them
COMPACTED = "_compacted"
_OF = {"run_id": "of_run", "batch_id": "of_batch"}


def _part(run_id: str, batch_id: int) -> str:
    return f"run_id={run_id}/batch_id={batch_id}"


def _root(history_path: str) -> str:
    return history_path.rstrip("/")


def history_parts(spark: SparkSession, history_path: str) -> list[str] | None:
    """The partitions that count; None if the history has data files that are in none."""
    root = _root(history_path)
    names = [n for n in list_names(spark, root) if not n.startswith(("_", "."))]
    if any(not n.startswith("run_id=") for n in names):
        return None
    parts = [f"{n}/{b}" for n in names for b in list_names(spark, f"{root}/{n}") if b.startswith("batch_id=")]
    gone = {p for r in _replaced(spark, root) if r["by"] in parts for p in r["parts"]}
    return [p for p in parts if p not in gone]


def _replaced(spark: SparkSession, root: str) -> list[dict]:
    """What compactions have replaced: ``by`` (the snapshot, which counts once it is there) and ``parts``."""
    return [json.loads(read_text(spark, f"{root}/_replaced/{n}")) for n in list_names(spark, f"{root}/_replaced") if n.endswith(".json")]


def _read_parts(spark: SparkSession, history_path: str, parts: Sequence[str] | None) -> DataFrame:
    """Rows of partitions (None: of a history without any)."""
    reader = spark.read.option("mergeSchema", True)
    if parts is None:
        return reader.parquet(history_path)
    h = reader.option("basePath", _root(history_path)).parquet(*[f"{_root(history_path)}/{p}" for p in parts])
    h = h.withColumn("run_id", F.col("run_id").cast("string"))
    if not set(_OF.values()) <= set(h.columns):
        return h
    for c, of in _OF.items():
        h = h.withColumn(c, F.coalesce(F.col(of).cast(h.schema[c].dataType), F.col(c)))
    return h.drop(*_OF.values())


def read_history(spark: SparkSession, history_path: str, schema: T.StructType,
                 without: tuple[str, int] | None = None) -> DataFrame:
    """History rows, optionally without the partition of one (run_id, batch_id)."""
    if not exists(spark, history_path):
        return spark.createDataFrame([], schema)
    parts = history_parts(spark, history_path)
    if parts is not None and without is not None:
        parts = [p for p in parts if p != _part(*without)]
    if parts is not None and not parts:
        return spark.createDataFrame([], schema)
    return _read_parts(spark, history_path, parts)


def _key(key: str, hash_key: bool):
    return F.sha2(F.col(key), 256) if hash_key else F.col(key)


def _write_part(rows: DataFrame, history_path: str, part: str, key: str, hash_key: bool) -> None:
    """A partition's rows, and then its index. Without an index it is always read, so a crash in between costs time only."""
    spark, root = rows.sparkSession, _root(history_path)
    delete(spark, f"{root}/_index/{part}")
    rows.write.mode("overwrite").parquet(f"{root}/{part}")
    keys = spark.read.parquet(f"{root}/{part}").select(_key(key, hash_key).alias("k"))
    index = key_index.build(keys, "k", key_index.filter_bits(keys.count())).withColumn("part", F.lit(part))
    index.write.mode("overwrite").parquet(f"{root}/_index/{part}")


def parts_to_read(keys: DataFrame, key: str, history_path: str, parts: Sequence[str]) -> list[str]:
    """Of the partitions those that may hold one of the keys: by their index, or without one."""
    spark, root = keys.sparkSession, _root(history_path)
    indexed = [p for p in parts if exists(spark, f"{root}/_index/{p}/_SUCCESS")]
    found = [p for p in parts if p not in set(indexed)]
    if indexed:
        index = spark.read.parquet(*[f"{root}/_index/{p}" for p in indexed])
        sizes = [r["bits"] for r in index.select("bits").distinct().collect()]  # powers of two
        if sizes:
            hits = key_index.candidates(keys, key, index, sizes, ["part"]).select("part").distinct()
            found += [r["part"] for r in hits.collect()]  # names of partitions
    return sorted(found)


def history_batch(batch: DataFrame, batch_id: int, history_path: str, key: str, ordinal: str,
                  hash_key: bool = False, run_id: str = "run", first_seen: str | None = None) -> list[str] | None:
    """foreachBatch body for X1 (also callable directly: replay-safe). Returns the partitions whose rows were read."""
    spark, own = batch.sparkSession, _part(run_id, batch_id)
    first = keep_first(batch, key, ordinal, hash_key)
    parts = history_parts(spark, history_path) if exists(spark, history_path) else []
    read = parts
    if parts is not None:
        parts = [p for p in parts if p != own]
        read = parts_to_read(first.select(_key(key, hash_key).alias("k")), "k", history_path, parts) if parts else []
    new = first
    if read is None or read:
        seen = _read_parts(spark, history_path, read).select(_key(key, hash_key).alias("__k"))
        new = first.withColumn("__k", _key(key, hash_key)).join(seen, "__k", "left_anti").drop("__k")  # anti join: no distinct needed
    if first_seen is not None:
        new = new.withColumn("first_seen", F.lit(first_seen))
    _write_part(new, history_path, own, key, hash_key)
    return read


def compact_history(spark: SparkSession, history_path: str, key: str, hash_key: bool = False, at_least: int = 2) -> str | None:
    """Puts all partitions into one snapshot with one index; returns its name (None if there are fewer than ``at_least``).

    It is built under a hidden name, a file says what it replaces, and the rename into place makes it count; then
    the old partitions are deleted. ``finish_compaction`` goes on where a crash has left this. Rows keep the run
    and batch that wrote them, so replays find them and nothing changes."""
    root = _root(history_path)
    finish_compaction(spark, history_path)
    parts = history_parts(spark, history_path) if exists(spark, history_path) else None
    if not parts or len(parts) < at_least:
        return None
    number = len(_replaced(spark, root))
    rows, part = _read_parts(spark, history_path, parts), _part(COMPACTED, number)
    rows = rows.select(*[F.col(c).alias(_OF.get(c, c)) for c in rows.columns])
    _write_part(rows, f"{root}/_building", part, key, hash_key)
    write_new(spark, f"{root}/_replaced/{number}.json", json.dumps({"by": part, "parts": parts}))
    finish_compaction(spark, history_path)
    return part


def finish_compaction(spark: SparkSession, history_path: str) -> None:
    """Renames built snapshots into place (the index first) and deletes what they replace."""
    root = _root(history_path)
    for r in _replaced(spark, root):
        for folder in (f"_index/{r['by']}", r["by"]):
            if exists(spark, f"{root}/_building/{folder}"):
                move(spark, f"{root}/_building/{folder}", f"{root}/{folder}")
        for p in r["parts"]:
            delete(spark, f"{root}/{p}")
            delete(spark, f"{root}/_index/{p}")


def stream_new_postings(spark: SparkSession, source_dir: str, schema: T.StructType, history_path: str,
                        checkpoint: str, key: str, ordinal: str = "ordinal", hash_key: bool = False,
                        max_files_per_trigger: int | None = 1, fmt: str = "parquet", run_id: str = "run",
                        first_seen: str | None = None):
    """Start an availableNow stream; returns the StreamingQuery (caller awaits).

    ``run_id`` names the run; a new checkpoint needs a new one.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    return (stream.writeStream
            .foreachBatch(lambda df, bid: history_batch(df, bid, history_path, key, ordinal, hash_key, run_id, first_seen))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def stream_dedup_state(spark: SparkSession, source_dir: str, schema: T.StructType, key: str, sink_path: str,
                       checkpoint: str, watermark: tuple[str, str] | None = None, fmt: str = "parquet"):
    """Engine-state dedup; with a watermark the state is bounded
    (``dropDuplicatesWithinWatermark``). Which duplicate wins is not defined."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])
    else:
        stream = stream.filter(F.col(key).isNotNull() & (F.col(key) != "")).dropDuplicates([key])
    return (stream.writeStream.format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


STATE_PLACE = ["version", "origin", "ordinal"]


def seed_state(state: DataFrame, state_base: str, fields: Sequence[str], key: str = "url", ordinal: str = "ordinal", buckets: int = 64) -> Manifest:
    """Version 0 of an X3 state: rows keep their own order. An empty frame starts a new state."""
    rows = state.select(key, F.lit(0).cast("bigint").alias("version"), F.lit(0).alias("origin"), F.col(ordinal).cast("bigint").alias("ordinal"), *fields)
    return create_state(rows, state_base, key, buckets)


def enrich_batch(batch: DataFrame, batch_id: int, state_base: str, details: DataFrame, fields: Sequence[str],
                 key: str, ordinal: str, run_id: str = "run", keep: int = 3) -> Manifest:
    """foreachBatch body for X3: the buckets of the batch's keys are read from the newest state version, enriched and
    written as the next one. A batch that is replayed after its commit changes nothing; a missing state is an error.

    Rows without a key are never changed by an update and only the first blank one matters to later
    batches, so that one is read and new ones are added.
    """
    spark, m = batch.sparkSession, manifest(batch.sparkSession, state_base)
    token = f"{run_id}/{batch_id}"
    if token in m.tokens:
        return m
    version = m.version + 1
    touched = touched_buckets(batch, m)
    old = read_state(spark, state_base, m.version, touched)
    place = F.struct(*STATE_PLACE)
    if not batch.filter(F.col(key) == "").isEmpty():
        blank = read_state(spark, state_base, m.version, [KEYLESS]).filter(F.col(key) == "")
        old = old.unionByName(blank.orderBy(*STATE_PLACE).limit(1))
    old = old.select(key, place.alias("place"), *fields)
    new = batch.select(key, F.struct(F.lit(version).cast("bigint").alias("version"), F.lit(1).alias("origin"),
                                     F.col(ordinal).cast("bigint").alias("ordinal")).alias("place"), *fields)
    # details of other postings are not sorted out batch by batch
    wanted = with_canonical_url(batch.select(key), key).select(F.col("canonical_url").alias("wanted"))
    details = successful_only(details).join(wanted, F.col("canonical_url") == F.col("wanted"), "left_semi")
    # the flags are not used here: only the per-posting outcome (read twice) is materialized
    merged, _ = enrich_run(new, old, details, fields, key, "place", materialize="outcome")
    merged = merged.select(key, "place.*", *fields)
    return commit_state(merged, merged.filter(F.col("version") == version), state_base, m, touched, token, keep)


def stream_enrich(spark: SparkSession, source_dir: str, schema: T.StructType, state_base: str,
                  details: DataFrame, fields: Sequence[str], checkpoint: str, key: str = "url",
                  ordinal: str = "ordinal", fmt: str = "parquet", max_files_per_trigger: int | None = 1, run_id: str = "run"):
    """Resumable enrichment, one state commit per micro-batch. A new checkpoint needs a new ``run_id``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.load(source_dir).writeStream
            .foreachBatch(lambda df, bid: enrich_batch(df, bid, state_base, details, fields, key, ordinal, run_id))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
