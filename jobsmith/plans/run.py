"""The two end-to-end flows, composed from the operators.

automated_run (one run over many search terms and sources):
    stored listing pages -> per-source cards and postings (one parse per page) -> page-prefix
    stop -> query/source tags -> keep-first across queries and sources -> seen-before filter
    -> rows to append to the history -> consolidated 9-column table -> per-source/query stats
    and running totals.

manual_run (one term, every source, optional ignore-history):
    the same postings -> seen-before filter (or not) -> per-source CSV partitions -> merged
    table without dedup -> report rows.

Input pages: (source, query, query_no, page_num, url, html). The ordinal of a posting is
the struct (query_no, source_no, page_num, card_no) - the order the sequential run sees
them - so "first wins" is decided by data, not by partition order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions.text import base_of, contains_any
from jobsmith.operators import html as H
from jobsmith.operators import identity as idn
from jobsmith.operators import quality as qa
from jobsmith.operators import report as rp
from jobsmith.session import cut_lineage
from jobsmith.sources import files as io
from jobsmith.sources.config import selectors_df, source_plans, sources_df

PAGE_KEYS = ["source", "query", "query_no", "page_num", "page_url"]


def collect_postings(pages: DataFrame, sources: Sequence[str] = tuple(fixed.SOURCE_ORDER),
                     config: dict | None = None, page_base: bool = False) -> DataFrame:
    """Stored listing pages -> postings of every configured source.

    Relative links resolve against the source's base url, or with ``page_base`` against the
    scheme://host of the page they were found on.

    P13: within (source, query) later pages are dropped after the first page that meets the
    source's stop rule (``fixed.PAGE_STOP_RULES``); an unreadable page is skipped, never stops.
    H1-H5 per source config (third source: link selector, no base join), P4/P5 tags.
    """
    config = {n: c for n, c in (config or fixed.SOURCES).items() if n in sources}
    config = {n: config[n] for n in sources}  # the order of the run
    spark = pages.sparkSession
    return collect_from_tables(pages, sources_df(spark, config), selectors_df(spark, config), page_base)


def page_cards(pages: DataFrame, sources: DataFrame, selectors: DataFrame) -> DataFrame:
    """The cards of each page with what its stop depends on, written once: all sources share one scan and one walk
    of each page's tree, and the result feeds the stops and the postings."""
    pages = (pages.withColumnRenamed("url", "page_url")
             .withColumn("blocked", contains_any(F.col("html"), fixed.INTERSTITIAL_ANY))
             .withColumn("login", contains_any(F.col("page_url"), fixed.LOGIN_URL_TOKENS, lower=False))
             .withColumn("readable", F.col("html").isNotNull()))
    ex = H.extract_cards_by_source(pages, source_plans(sources, selectors), PAGE_KEYS + ["blocked", "login", "readable"])
    readable = F.col("readable") & F.col("parse_error").isNull()
    rules = {"no_cards": readable & (F.col("n_cards") == 0), "interstitial": F.col("blocked"), "login_url": F.col("login")}
    stop = reduce(lambda a, b: a | b, [F.array_contains("stop_rules", r) & F.coalesce(on, F.lit(False)) for r, on in rules.items()])
    return cut_lineage(ex.withColumn("stops", stop), "cards")


def page_stops(cards: DataFrame) -> DataFrame:
    """``source, query, stop``: the first page that meets its source's stop rules."""
    return cards.filter("stops").groupBy("source", "query").agg(F.min("page_num").alias("stop"))


def postings_of(cards: DataFrame, page_base: bool = False) -> DataFrame:
    posts = H.postings_by_source(cards, PAGE_KEYS + ["source_no"], base_of(F.col("page_url")) if page_base else None)
    return posts.select(
        F.struct(F.col("query_no").cast("bigint").alias("query_no"), F.col("source_no").cast("bigint").alias("source_no"),
                 F.col("page_num").cast("bigint").alias("page_num"), F.col("card_no")).alias("ordinal"),
        *H.POSTING_FIELDS, F.lit("").alias("posted_date"), "url", "source", F.col("query").alias("search_query"), "page_url")


def collect_from_tables(pages: DataFrame, sources: DataFrame, selectors: DataFrame, page_base: bool = False) -> DataFrame:
    """Postings from configuration tables (``sources_df``, ``selectors_df``): a source is its rows in them."""
    cards = page_cards(pages, sources, selectors)
    return postings_of(qa.before_stops(cards, page_stops(cards), ["source", "query"], "page_num"), page_base)


def automated_run(pages: DataFrame, history: DataFrame, run_ts: str,
                  sources: Sequence[str] = tuple(fixed.SOURCE_ORDER), config: dict | None = None,
                  page_base: bool = False) -> dict[str, DataFrame]:
    """main-style run (always filters against the history; its ignore-history flag is never read).
    Returns frames: postings, flagged, new, history_rows, consolidated, stats, totals."""
    postings = collect_postings(pages, sources, config, page_base)
    flagged = idn.flag_new(postings, history, "url", "ordinal")
    new = flagged.filter("is_new").drop("is_new")
    history_rows = idn.history_append(history, postings, run_ts, "url", "ordinal")
    consolidated = idn.project(new, fixed.POSTING_9)  # new rows have a key and are the first of it already
    stats = qa.source_stats(flagged, ["source", "search_query"])
    per_query = (flagged.groupBy(F.col("ordinal.query_no").alias("query_no"), F.col("search_query").alias("query"))
                 .agg(F.count_if("is_new").alias("n_new")))
    totals = qa.running_total(per_query, "query_no", "n_new")
    return {"postings": postings, "flagged": flagged, "new": new, "history_rows": history_rows,
            "consolidated": consolidated, "stats": stats, "totals": totals}


def manual_run(pages: DataFrame, history: DataFrame, out_dir: str, run_date: str, query: str, location: str,
               ignore_history: bool = False, sources: Sequence[str] = tuple(fixed.SOURCE_ORDER),
               config: dict | None = None) -> dict[str, DataFrame]:
    """scraper-style run: per-source CSVs (partitioned by source and run_date), merged table
    without dedup, report rows and summary. Returns frames: merged, report, summary."""
    postings = collect_postings(pages, sources, config)
    kept = postings if ignore_history else idn.flag_new(postings, history, "url", "ordinal").filter("is_new")
    dated = io.run_date_partition(kept, run_date)
    io.write_csv(dated, out_dir, partition_by=["source", "run_date"], skip_empty=False)
    merged = io.read_csv(pages.sparkSession, [out_dir], same_header=True)
    return {"merged": merged, "report": rp.report_rows(merged),
            "summary": rp.report_summary(merged, query, location, run_date)}
