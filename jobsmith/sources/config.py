"""Source configuration as (small, fixed-size) tables.

A source is data: one row in ``sources`` and its selector rows. A string selector
is a one-element list. Unknown sources simply have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsmith.functions import fixed


def source_rows(sources: dict | None = None) -> list[tuple]:
    sources = sources or fixed.SOURCES
    return [(name, i, cfg["base_url"], int(cfg["page_size"]), cfg["page_mode"], cfg["search_url"])
            for i, (name, cfg) in enumerate(sources.items())]


def selector_rows(sources: dict | None = None) -> list[tuple]:
    sources = sources or fixed.SOURCES
    out = []
    for name, cfg in sources.items():
        for field, sels in cfg["selectors"].items():
            sels = [sels] if isinstance(sels, str) else list(sels)
            out.extend((name, field, rank, s) for rank, s in enumerate(sels))
    return out


def sources_df(spark: SparkSession, sources: dict | None = None) -> DataFrame:
    return spark.createDataFrame(source_rows(sources),
                                 "source string, source_no int, base_url string, page_size int, "
                                 "page_mode string, search_url string")


def selectors_df(spark: SparkSession, sources: dict | None = None) -> DataFrame:
    return spark.createDataFrame(selector_rows(sources), "source string, field string, rank int, selector string")


def source_config(name: str, sources: dict | None = None) -> dict:
    """Config of one source; unknown -> empty config."""
    return (sources or fixed.SOURCES).get(name, {"base_url": "", "page_size": 0, "page_mode": "offset",
                                                 "search_url": "", "selectors": {}})


#: rows of selectors that count as configuration
MAX_SELECTORS = 100_000


def source_plans(sources: DataFrame, selectors: DataFrame, stop_rules: dict | None = None) -> DataFrame:
    """One row a source: ``source, source_no, base_url, link_mode, stop_rules, selectors`` (JSON by field, ranked).

    It is broadcast to the pages, so its size is checked: more than ``MAX_SELECTORS`` rows are an error."""
    n = selectors.limit(MAX_SELECTORS + 1).count()
    if n > MAX_SELECTORS:
        raise ValueError(f"more than {MAX_SELECTORS} selectors")
    rules = stop_rules if stop_rules is not None else fixed.PAGE_STOP_RULES
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "selector"))), lambda x: x["selector"])
    fields = selectors.groupBy("source", "field").agg(ranked.alias("ranked"))
    by_source = fields.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "ranked")))).alias("named"))
    stops = F.lit(["no_cards"])
    for name, some in rules.items():
        stops = F.when(F.col("source") == name, F.lit(list(some))).otherwise(stops)
    return (sources.join(by_source, "source").select(
        "source", "source_no", "base_url", F.when(F.map_contains_key("named", F.lit("link")), "link").otherwise("title").alias("link_mode"),
        stops.alias("stop_rules"), F.to_json("named").alias("selectors")))
