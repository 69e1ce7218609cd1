"""S4 + X1: stored pages as a stream, from landing to history.

Pages land as JSON Lines files (``page columns, html``). Each micro-batch walks its pages once (H1-H5, all
sources), applies the page stop (P13) and adds the new postings to the history. A stop holds for later batches
as well, so each batch writes the stops it found into a partition of its own and reads all of them.
Finished files are moved to an archive by the engine. A replayed batch rewrites its own partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsmith.plans.run import page_cards, page_stops, postings_of
from jobsmith.operators.quality import before_stops
from jobsmith.sources.folders import exists, list_names
from jobsmith.streaming.history import history_batch


def pages_batch(batch: DataFrame, batch_id: int, sources: DataFrame, selectors: DataFrame, history_path: str, stops_path: str,
                run_id: str = "run", first_seen: str | None = None, page_base: bool = False) -> None:
    """foreachBatch body: pages (source, query, query_no, page_num, url, html) -> new postings in the history."""
    spark, root = batch.sparkSession, stops_path.rstrip("/")
    cards = page_cards(batch, sources, selectors)
    page_stops(cards).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
    known = [n for n in list_names(spark, root) if n.startswith("batch_id=") and int(n[9:]) <= batch_id and exists(spark, f"{root}/{n}/_SUCCESS")]
    stops = spark.read.parquet(*[f"{root}/{n}" for n in known]).groupBy("source", "query").agg(F.min("stop").alias("stop"))
    posts = postings_of(before_stops(cards, stops, ["source", "query"], "page_num"), page_base).filter(F.col("url") != "")
    history_batch(posts.select("url", "ordinal", "title", "source"), batch_id, history_path, "url", "ordinal", run_id=run_id, first_seen=first_seen)


def stream_pages(spark: SparkSession, source_dir: str, schema: T.StructType, sources: DataFrame, selectors: DataFrame, history_path: str,
                 stops_path: str, checkpoint: str, archive: str | None = None, run_id: str = "run", first_seen: str | None = None,
                 page_base: bool = False, max_files_per_trigger: int | None = None):
    """An availableNow stream over landed page files; returns the StreamingQuery."""
    reader = spark.readStream.schema(schema).format("json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return (reader.load(source_dir).writeStream
            .foreachBatch(lambda df, bid: pages_batch(df, bid, sources, selectors, history_path, stops_path, run_id, first_seen, page_base))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
