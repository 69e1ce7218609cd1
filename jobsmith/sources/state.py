"""K5: a keyed state that grows by its changes: hash buckets, copied on write, named by manifests.

``base/_manifests/v=N.json`` names the folders of version N: one list of folders a bucket, and one of
rows without a key (null or ''), which no update ever changes. A commit writes the new content of
the buckets it touches into folders of its own, and then the next manifest, which names these and, for
every other bucket, the folders of the version before. So a commit writes in proportion to the buckets
it touches; rows without a key are only added. Readers see the newest manifest: until it is renamed
into place nothing of a commit counts, and a crash leaves the old version as it was.

The last ``keep`` versions stay readable; folders that none of them names go with the older ones. A
commit carries a token (run and batch), so that a replayed batch is recognised and written once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsmith.operators.identity import has_key
from jobsmith.sources.folders import delete, list_names, read_text, write_new

KEYLESS = "keyless"


@dataclass
class Manifest:
    version: int
    buckets: int
    key: str
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)
    tokens: list[str] = field(default_factory=list)
    rows_written: int = 0
    touched: int = 0

    def paths(self, only: Iterable[str] | None = None) -> list[str]:
        names = self.folders if only is None else [n for n in only if n in self.folders]
        return [p for n in names for p in self.folders[n]]


def _manifest_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/_manifests/v={version}.json"


def versions(spark: SparkSession, base: str) -> list[int]:
    names = list_names(spark, f"{base.rstrip('/')}/_manifests")
    return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json") and n[2:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version; a missing one raises (an empty state would lose rows)."""
    have = versions(spark, base)
    if not have or (version is not None and version not in have):
        raise RuntimeError(f"state version {version if version is not None else 'of any number'} is missing under {base}")
    return Manifest(**json.loads(read_text(spark, _manifest_path(base, have[-1] if version is None else version))))


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; ``keyless`` rows have none."""
    return F.when(has_key(key), F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("string")).otherwise(F.lit(KEYLESS))


def read_state(spark: SparkSession, base: str, version: int | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """The rows of a version (the newest by default), or those of some buckets; other folders are not listed."""
    m = manifest(spark, base, version)
    schema = T.StructType.fromJson(json.loads(m.schema))
    paths = m.paths(only)
    full = [f"{base.rstrip('/')}/{p}" for p in paths]
    return spark.read.schema(schema).parquet(*full) if full else spark.createDataFrame([], schema)


def _write(rows: DataFrame, base: str, key: str, buckets: int, dealt: bool = False) -> tuple[str, int]:
    """Writes rows by bucket into folders of their own; returns the folder and the number of rows.

    ``dealt``: the rows come from a join on their key, so their partitions are even already and are written as they
    are (every task a file a bucket) instead of being moved once more."""
    folder, spark = f"data/{uuid.uuid4().hex}", rows.sparkSession
    at = f"{base.rstrip('/')}/{folder}"
    rows = rows.withColumn("bucket", bucket_of(key, buckets))
    if not dealt:  # rebalanced by bucket: a large bucket gets several files, small ones share a task
        rows = rows.hint("rebalance", "bucket")
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(at)
    rows = rows.drop("bucket")
    return folder, spark.read.schema(rows.schema).parquet(at).count() if _written(spark, base, folder) else 0  # from the files' footers


def create_state(rows: DataFrame, base: str, key: str = "url", buckets: int = 64) -> Manifest:
    """Version 0; an existing state raises."""
    spark = rows.sparkSession
    if versions(spark, base):
        raise FileExistsError(base)
    folder, n = _write(rows, base, key, buckets)
    m = Manifest(0, buckets, key, rows.schema.json(), rows_written=n)
    m.folders = {name: [f"{folder}/bucket={name}"] for name in _written(spark, base, folder)}
    m.touched = len(m.folders)
    write_new(spark, _manifest_path(base, 0), json.dumps(m.__dict__))
    return m


def _written(spark: SparkSession, base: str, folder: str) -> list[str]:
    return [n[len("bucket="):] for n in list_names(spark, f"{base.rstrip('/')}/{folder}") if n.startswith("bucket=")]


def touched_buckets(batch: DataFrame, m: Manifest) -> list[str]:
    """The buckets that a batch's keys fall into (their number is bounded by the state's buckets)."""
    rows = batch.filter(has_key(m.key)).select(bucket_of(m.key, m.buckets).alias("b")).distinct().collect()
    return sorted((r["b"] for r in rows), key=int)


def commit_state(rows: DataFrame, added: DataFrame, base: str, before: Manifest, touched: Sequence[str], token: str = "", keep: int = 3) -> Manifest:
    """The next version: ``rows`` is the whole new content of the ``touched`` buckets, ``added`` holds new rows without a key.

    A commit whose token is known already changes nothing; one that another commit overtook raises.
    """
    spark, key = rows.sparkSession, before.key
    newest = manifest(spark, base)
    if token and token in newest.tokens:
        return newest
    if newest.version != before.version:
        raise RuntimeError(f"state moved on from version {before.version} to {newest.version}")
    columns = T.StructType.fromJson(json.loads(before.schema)).names
    folder, n = _write(rows.filter(has_key(key)).select(*columns).unionByName(added.filter(~has_key(key)).select(*columns)), base, key, before.buckets, dealt=True)
    folders = {name: list(paths) for name, paths in before.folders.items() if name not in set(touched)}
    for name in _written(spark, base, folder):
        folders[name] = (folders.get(name, []) if name == KEYLESS else []) + [f"{folder}/bucket={name}"]
    # tokens of all retained versions are enough: a stream replays its last batch only
    after = Manifest(before.version + 1, before.buckets, key, before.schema, folders, (newest.tokens + [token])[-keep - 1:] if token else newest.tokens, n, len(touched))
    write_new(spark, _manifest_path(base, after.version), json.dumps(after.__dict__))
    _retire(spark, base, keep)
    return after


def _retire(spark: SparkSession, base: str, keep: int) -> None:
    """Drops manifests before the last ``keep`` and the folders that only they name."""
    have = versions(spark, base)
    old, kept = have[:-keep], have[-keep:]
    if not old:
        return
    needed = {p for v in kept for p in manifest(spark, base, v).paths()}
    gone = {p for v in old for p in manifest(spark, base, v).paths()} - needed
    for v in old:
        delete(spark, _manifest_path(base, v))
    for p in sorted(gone):
        delete(spark, f"{base.rstrip('/')}/{p}")
