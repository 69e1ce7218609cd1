"""Names and small text files in any store that Spark reaches (Hadoop file systems; no data passes here)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it there; a file that is there already raises."""
    fs, to = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(to) or not fs.rename(beside, to):
        fs.delete(beside, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder to a place that is free, whose parent is made if need be."""
    fs, src = _at(spark, source)
    _, dst = _at(spark, target)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Puts the folder ``new`` in the place of ``target``: the old one is moved aside first and deleted last,
    so that a crash leaves one of them in full (the old one beside its place, at worst)."""
    fs, src = _at(spark, new)
    _, dst = _at(spark, target)
    if not fs.exists(src):
        raise FileNotFoundError(new)
    aside = None
    if fs.exists(dst):
        _, aside = _at(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex[:12]}")
        if not fs.rename(dst, aside):
            raise OSError(f"cannot move {target} aside")
    if not fs.rename(src, dst):
        if aside is not None:
            fs.rename(aside, dst)
        raise OSError(f"cannot move {new} to {target}")
    if aside is not None:
        fs.delete(aside, True)
