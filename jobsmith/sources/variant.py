"""records whose keys differ, landed as VARIANT: a key that is absent, one that is null and '' stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def land_json(lines: DataFrame, path: str, json_col: str = "value", mode: str = "overwrite") -> None:
    """Writes JSON records (one string a row) as a VARIANT column ``record`` in Parquet, other columns beside it.

    A record that is no JSON is kept as ``bad`` text with a null ``record``."""
    rest = [F.col(c) for c in lines.columns if c != json_col]
    record = F.try_parse_json(json_col)
    bad = F.when(record.isNull() & F.col(json_col).isNotNull(), F.col(json_col))
    lines.select(*rest, record.alias("record"), bad.alias("bad")).write.mode(mode).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def field(record: Column, name: str, kind: str = "string") -> Column:
    """The value of a key; null where it is absent, null or of another type."""
    return F.try_variant_get(record, f"$['{name}']", kind)


def presence(record: Column, name: str) -> Column:
    """``absent``, ``null``, ``empty`` or ``value``."""
    found = F.try_variant_get(record, f"$['{name}']", "variant")
    return (F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null")
            .when(F.coalesce(F.try_variant_get(record, f"$['{name}']", "string") == "", F.lit(False)), "empty").otherwise("value"))


def project(records: DataFrame, names: list[str], record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """P1 over records: the named keys as strings ('' if absent or null) with the columns of ``keep``."""
    return records.select(*keep, *[F.coalesce(field(F.col(record), n), F.lit("")).alias(n) for n in names])


def merged_schema(records: DataFrame, record: str = "record") -> str:
    """The common schema of all records, as one aggregate over the table."""
    return records.agg(F.schema_of_variant_agg(record).alias("s")).first()["s"]
