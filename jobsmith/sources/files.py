"""Readers and writers: driver tables, posting CSV / JSON, versioned state writes.

CSV options are chosen so quotes, newlines, backslashes, non-ASCII text and
leading blanks round-trip and Python's ``csv`` module reads the same values.
Multi-line CSV is not splittable: keep many moderate files (or convert to
Parquet once) so the read stays parallel.
"""

from __future__ import annotations

import csv
import io
import logging
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsmith.functions import fixed
from jobsmith.session import cut_lineage
from jobsmith.sources.folders import delete, swap

log = logging.getLogger(__name__)

CSV_WRITE = dict(header=True, quote='"', escape='"', emptyValue="", nullValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8",
                 lineSep="\n")
CSV_READ = dict(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False, encoding="UTF-8", mode="FAILFAST")


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (one parquet file per table)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        if not p:
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The data files at the given paths (driver-side listing of names; no data is read)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in _existing(spark, paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        it = path.getFileSystem(conf).listFiles(path, True)
        while it.hasNext():
            f = it.next().getPath()
            if not f.getName().startswith(("_", ".")):
                out.append(f.toString())
    return sorted(out)


#: What an error says when the content of a file is at fault, not the storage or the job.
UNPARSABLE = ("not a gzip file", "incorrect header check", "FileNotFoundException")


#: bytes of a file that are read for its header, and files read at once
HEAD_BYTES, HEADS_AT_ONCE = 1 << 16, 16


def _header(spark: SparkSession, file: str) -> list[str]:
    """The names in a file's first record (the head of the file is read, unpacked if need be)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    size = HEAD_BYTES
    while True:
        stream = path.getFileSystem(conf).open(path)
        try:
            data = stream if codec is None else codec.createInputStream(stream)
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(data, size)))
        finally:
            stream.close()
        text = head.decode("utf-8-sig", "replace")
        if len(head) == size:  # cut: a record that ends before the cut is whole
            rows = list(islice(csv.reader(io.StringIO(text), strict=False), 2))
            if len(rows) < 2:
                size *= 4
                continue
        names = next((row for row in csv.reader(io.StringIO(text)) if row), [])
        # names that come up twice are told apart by their place, as Spark does
        return [n and (n if names.count(n) == 1 else f"{n}{i}") or f"_c{i}" for i, n in enumerate(names)]


def headers(spark: SparkSession, files: Sequence[str], own: bool = False) -> dict[str, list[str] | None]:
    """The header names of each file; None for an input file that cannot be parsed or went missing (it is logged).

    Heads are read beside each other and start no Spark job. Every other error is raised, and for ``own``
    outputs every error."""
    def one(f: str) -> list[str] | None:
        try:
            return _header(spark, f)
        except Exception as exc:
            text = str(exc)
            if own or not any(x in text for x in UNPARSABLE):
                raise
            log.warning("skipped %s: %s", f, text.splitlines()[0])
            return None

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return dict(zip(files, pool.map(one, files)))


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = tuple(fixed.POSTING_7),
             same_header: bool = False, own: bool = False) -> DataFrame:
    """Posting CSVs, columns matched by header name in every file, all strings.

    Missing paths and files without a readable header are skipped and logged (``read_csv_skipped``
    lists them). A file without one of ``columns`` yields '' for it. Files with equal headers are
    read together. ``same_header`` is for our own outputs: one header, no listing of each file.
    ``own`` is for our own outputs with differing headers: an unreadable file fails the read.
    A record that does not parse fails the read, and so does every error other than a file's content.
    """
    if same_header:
        found = _existing(spark, paths)
        groups = {tuple(spark.read.options(**CSV_READ).csv(found).columns): found} if found else {}
    else:
        groups: dict[tuple, list[str]] = {}
        for f, names in headers(spark, _files(spark, paths), own).items():
            if names:
                groups.setdefault(tuple(names), []).append(f)
    out = None
    for names, files in groups.items():
        df = spark.read.options(**CSV_READ).schema(string_schema(names)).csv(files)
        df = df.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in names else F.lit("")).alias(c) for c in columns])
        out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], string_schema(columns)) if out is None else out


REJECT_T = "path string, record string, reason string"


def read_csv_rejects(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = tuple(fixed.POSTING_7)) -> tuple[DataFrame, DataFrame]:
    """S1 + P14: ``(rows, rejects)``. A record that does not parse (too few or too many fields, an open quote) and a file that
    ``read_csv`` skips become rejects (``path, record, reason``); all other rows are read.

    Files of one header are read together; the number of jobs does not depend on the number of files."""
    groups: dict[tuple, list[str]] = {}
    for f, names in headers(spark, _files(spark, paths)).items():
        if names:
            groups.setdefault(tuple(names), []).append(f)
    rows, rejects = spark.createDataFrame([], string_schema(columns)), read_csv_skipped(spark, paths).select("path", F.lit(None).cast("string").alias("record"), "reason")
    bad = "_unparsed"
    for names, files in groups.items():
        df = (spark.read.options(**CSV_READ | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
              .schema(string_schema([*names, bad])).csv(files).withColumn("_path", F.col("_metadata.file_path")))
        df = cut_lineage(df, "csv-parsed")  # parsed once, read for the rows and for the rejects
        good = df.filter(F.col(bad).isNull())
        rows = rows.unionByName(good.select(*[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in names else F.lit("")).alias(c) for c in columns]))
        rejects = rejects.unionByName(df.filter(F.col(bad).isNotNull()).select(
            F.col("_path").alias("path"), F.col(bad).alias("record"), F.lit("malformed record").alias("reason")))
    return rows, rejects


def read_csv_skipped(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """What ``read_csv`` skips: ``path, reason`` (missing, unreadable, empty)."""
    there = set(_existing(spark, paths))
    rows = [(p, "missing") for p in paths if p not in there]
    rows += [(f, "unreadable" if n is None else "empty") for f, n in headers(spark, _files(spark, paths)).items() if not n]
    return spark.createDataFrame(rows, "path string, reason string")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = False,
              multiline: bool = True) -> DataFrame:
    """Posting JSON (array or JSON Lines). Missing file -> empty frame.

    ``strict`` raises on malformed input (FAILFAST); otherwise malformed records drop.
    """
    schema = schema or string_schema(fixed.POSTING_9)
    if not _existing(spark, [path]):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", mode).json(path)


def read_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines as ``map<string,string>`` per record: keeps absent vs null vs ''."""
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", "map<string,string>").alias("rec")).filter(F.col("rec").isNotNull())


def _guarded_write(df: DataFrame, path: str, write) -> bool:
    """K9: empty input leaves what was there before. The rows are written to a staging folder
    beside the target and counted on the way (an ``Observation``); only a write with rows
    replaces the target: the old folder is moved aside, the new one renamed into place, then the old one deleted."""
    spark = df.sparkSession
    seen = Observation()
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:12]}"
    write(df.observe(seen, F.count(F.lit(1)).alias("n")), staging)
    if not seen.get["n"]:
        delete(spark, staging)  # the folder this call has just made
        log.warning("no rows to write to %s", path)
        return False
    swap(spark, staging, path)  # overwrite: the caller named this target
    return True


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = tuple(fixed.POSTING_7),
              partition_by: Sequence[str] = (), mode: str = "overwrite", skip_empty: bool = True) -> bool:
    """K1/K3/K8/K9: fixed projection, absent -> '', partitioned output (e.g. source, run_date).

    Partition columns that are among ``columns`` stay in the files too. With ``skip_empty``,
    empty input keeps what was there and returns False.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
            for c in columns]
    folders = {c: f"{c}_part" if c in columns else c for c in partition_by}

    def write(frame: DataFrame, to: str) -> None:
        w = (frame.select(*cols, *[F.col(c).alias(n) for c, n in folders.items()])
             .write.mode(mode).options(**CSV_WRITE))
        if folders:
            w = w.partitionBy(*folders.values())
        w.csv(to)

    if not skip_empty or mode != "overwrite":
        write(df, path)
        return True
    return _guarded_write(df, path, write)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", skip_empty: bool = True) -> bool:
    """JSON Lines, non-ASCII kept, nulls omitted (absent keys stay absent)."""
    def write(frame: DataFrame, to: str) -> None:
        frame.write.mode(mode).option("ignoreNullFields", True).json(to)

    if not skip_empty or mode != "overwrite":
        write(df, path)
        return True
    return _guarded_write(df, path, write)


def write_versioned(df: DataFrame, base: str, version: int | str, fmt: str = "parquet") -> str:
    """K5: full rewrite into a new version folder; readers switch to the newest complete one."""
    target = f"{base.rstrip('/')}/v={version}"
    df.write.mode("overwrite").format(fmt).save(target)
    return target


def latest_version(spark: SparkSession, base: str) -> str | None:
    """K5: the newest version folder that finished writing (has ``_SUCCESS``); None if none.

    Only folder names are listed (driver-side metadata); no data is read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    best = None
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                v = int(name[2:])
                best = v if best is None or v > best else best
    return None if best is None else f"{base.rstrip('/')}/v={best}"


def run_date_partition(df: DataFrame, run_date: str, fmt: str = fixed.DATA_DATE_FORMAT) -> DataFrame:
    """``run_date`` column (job parameter, not the clock) formatted for the sink."""
    return df.withColumn("run_date", F.date_format(F.to_date(F.lit(run_date)), fmt))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of raw page dumps -> (url = file path, html); one row per file."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))


def _fill(template: str, i: Column, source: str) -> Column:
    pre, _, rest = template.partition("{")
    if not _:
        return F.lit(template)
    name, _, post = rest.partition("}")
    val = i.cast("string") if name == "i" else F.lit(source)
    return F.concat(F.lit(pre), val, _fill(post, i, source))


def mock_postings(spark: SparkSession, source: str, location: str,
                  n: int = fixed.MOCK_ROWS_PER_SOURCE) -> DataFrame:
    """The synthetic postings of the reference's tests (ids 1..n in title/company/url)."""
    i = F.col("id")
    m = fixed.MOCK_POSTING
    return spark.range(1, n + 1).select(
        _fill(m["title"], i, source).alias("title"), _fill(m["company"], i, source).alias("company"),
        F.lit(location).alias("location"), F.lit(m["salary"]).alias("salary"),
        _fill(m["description"], i, source).alias("description"), _fill(m["url"], i, source).alias("url"),
        F.lit(source).alias("source"), i.alias("ordinal"))
