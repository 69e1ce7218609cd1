"""Quality and progress: completeness counts, percentages, per-source stats,
running totals, first-N / sample rows, previews, record profile, page filters.

Everything is one aggregate pass or a bounded top-k (``orderBy().limit()`` is a
TakeOrderedAndProject: each task keeps k rows, the driver merges k x tasks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsmith.functions import fixed
from jobsmith.functions.text import contains_all, contains_any, is_filled, preview


def field_completeness(df: DataFrame, checks: dict[str, Column], group_by: Sequence[str] = ()) -> DataFrame:
    """``count(*)`` plus ``count_if(pred)`` per named predicate."""
    aggs = [F.count("*").alias("n")] + [F.count_if(p).alias(name) for name, p in checks.items()]
    g = df.groupBy(*group_by) if group_by else df.groupBy()
    return g.agg(*aggs)


def standard_checks(description: str = "description", posted_date: str = "posted_date",
                    salary: str | None = "salary") -> dict[str, Column]:
    """The thresholds used by the reference's checks (strict ``>``)."""
    d = F.col(description)
    out = {
        "desc_nonempty": is_filled(d),
        "desc_gt20_stripped": is_filled(d, 20, strip=True),
        "desc_gt50": is_filled(d, fixed.DESCRIPTION_MIN_LEN),
        "desc_gt100": is_filled(d, fixed.ENRICHED_MIN_LEN),
        "date_nonempty": is_filled(F.col(posted_date)),
    }
    if salary:
        out["salary_nonempty"] = is_filled(F.col(salary))
    return out


def progress_pct(inputs: DataFrame, updated: DataFrame, description: str = "description",
                 posted_date: str = "posted_date", min_len: int = fixed.ENRICHED_MIN_LEN) -> DataFrame:
    """Total from the input set, done/with-date from the updated set.

    ``pct`` = (done / total) * 100 in the same floating-point order as the reference (0.0 when
    total is 0); ``pct_label`` is its one-decimal display, correctly rounded from the binary
    value (``format_number``), i.e. the same text as Python's ``f"{pct:.1f}"``.
    One aggregate over a union (no cartesian product of two one-row frames).
    """
    a = inputs.select(F.lit(1).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("w"))
    b = updated.select(F.lit(0).alias("t"),
                       F.when(is_filled(F.col(description), min_len), 1).otherwise(0).alias("d"),
                       F.when(is_filled(F.col(posted_date)), 1).otherwise(0).alias("w"))
    s = a.unionByName(b).agg(F.sum("t").cast("bigint").alias("total"), F.sum("d").cast("bigint").alias("done"),
                             F.sum("w").cast("bigint").alias("with_date"))
    return s.select(
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("done", F.lit(0)).cast("bigint").alias("done"),
        F.coalesce("with_date", F.lit(0)).cast("bigint").alias("with_date"),
        F.when(F.col("total") > 0, (F.col("done") / F.col("total")) * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("pct"),
        F.replace(F.format_number(F.when(F.col("total") > 0, (F.col("done") / F.col("total")) * F.lit(100.0))
                                  .otherwise(F.lit(0.0)), 1), F.lit(",")).alias("pct_label"),  # no thousands mark
        (F.coalesce("total", F.lit(0)) - F.coalesce("done", F.lit(0))).cast("bigint").alias("remaining"))


def source_stats(flagged: DataFrame, group_by: Sequence[str] = ("source", "search_query"),
                 is_new: str = "is_new") -> DataFrame:
    """Found / new / duplicate per source and query."""
    return (flagged.groupBy(*group_by)
            .agg(F.count("*").alias("found"), F.count_if(F.col(is_new)).alias("new"))
            .withColumn("dup", F.col("found") - F.col("new")))


def running_total(per_query: DataFrame, order_col: str = "query_no", count_col: str = "n_new",
                  block_rows: int = 1000) -> DataFrame:
    """Jobs-so-far per query and i/N position.

    Runs on the per-query aggregate (one row per search term). Terms are dealt into blocks of
    ``order_col``; sums run inside a block, and only the block totals meet in one window.
    """
    block = F.floor(F.col(order_col) / F.lit(float(block_rows))).cast("bigint")
    rows = per_query.withColumn("__block", block)
    blocks = rows.groupBy("__block").agg(F.sum(count_col).alias("__sum"), F.count("*").alias("__rows"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum_before"),
                           F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
                           F.sum("__rows").over(Window.partitionBy()).alias("__n"))
    inside = Window.partitionBy("__block").orderBy(order_col)
    return (rows.join(blocks, rows["__block"].eqNullSafe(blocks["__block"])).drop(blocks["__block"])
            .withColumn("so_far", (F.col("__sum_before") + F.coalesce(
                F.sum(count_col).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).cast("bigint"))
            .withColumn("position", (F.col("__rows_before") + F.row_number().over(inside)).cast("bigint"))
            .withColumn("of_n", F.col("__n").cast("bigint"))
            .drop("__block", "__sum_before", "__rows_before", "__n"))


def first_n(df: DataFrame, n: int | None, ordinal: str = "ordinal") -> DataFrame:
    """O2: the first ``n`` rows in input order; 0/None = no limit."""
    return df.orderBy(ordinal).limit(n) if n else df


def sample_topk(df: DataFrame, predicate: Column, k: int, ordinal: str = "ordinal") -> DataFrame:
    """First ``k`` rows (input order) satisfying a predicate."""
    return df.filter(predicate).orderBy(ordinal).limit(k)


def title_line(title: Column, width: int = fixed.PREVIEW_WIDTHS["title"]) -> Column:
    """Title cut to ``width`` and padded to ``width``."""
    return F.rpad(F.substring(F.coalesce(title, F.lit("")), 1, width), width, " ")


def length_label(c: Column) -> Column:
    """Length with a thousands separator, e.g. ``1,234``."""
    return F.format_number(F.length(c), 0)


def _falsy_as_null(c: Column, dtype: T.DataType) -> Column:
    """The value as Python would print it, or null when Python would treat it as falsy
    (None, '', 0, 0.0, False, empty array/map)."""
    if isinstance(dtype, T.StringType):
        return F.when(c != "", c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True"))
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, c.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c.cast("string"))
    return c.cast("string")


def record_profile(df: DataFrame, ordinal: str = "ordinal", width: int = fixed.PREVIEW_WIDTHS["profile"],
                   empty_mark: str = fixed.EMPTY_MARK, columns: Sequence[str] | None = None) -> DataFrame:
    """First record -> (field_no, field, preview) rows; falsy values (Python truthiness:
    None, '', 0, False, empty) -> ``(empty)``, else the first ``width`` characters."""
    cols = [c for c in (columns or df.columns)]
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    first = df.orderBy(ordinal).limit(1)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("field_no"), F.lit(c).alias("field"),
                 _falsy_as_null(F.col(c), types[c]).alias("v")) for i, c in enumerate(cols)]))
    return (first.select(stacked.alias("s"))
            .select("s.field_no", "s.field", preview(F.col("s.v"), width, empty_mark).alias("preview")))


def interstitial_flags(pages: DataFrame, html: str = "html", url: str = "url",
                       all_tokens: Sequence[str] = tuple(fixed.INTERSTITIAL_ALL),
                       any_tokens: Sequence[str] = tuple(fixed.INTERSTITIAL_ANY),
                       url_tokens: Sequence[str] = tuple(fixed.INTERSTITIAL_URL),
                       requested_url: str | None = None,
                       growth: int = fixed.INTERSTITIAL_URL_GROWTH) -> DataFrame:
    """Not-content pages - all tokens (AND), any token (OR), url tokens / url growth."""
    url_flag = contains_any(F.col(url), url_tokens, lower=False)
    if requested_url:
        url_flag = url_flag | (F.length(F.col(url)) > F.length(F.col(requested_url)) + growth)
    return pages.select(
        "*",
        contains_all(F.col(html), all_tokens).alias("flag_all"),
        contains_any(F.col(html), any_tokens).alias("flag_any"),
        url_flag.alias("flag_url"))


def page_prefix(pages: DataFrame, group_by: Sequence[str], page_col: str, stop: Column,
                max_broadcast_groups: int = 100_000) -> DataFrame:
    """Within each group keep pages before the first page where ``stop`` holds.

    Stop pages per group are a partial aggregate (min), joined back on the group keys. They are
    broadcast up to ``max_broadcast_groups`` groups; beyond that the join shuffles, and a hot
    group is split by AQE's skew-join handling instead of landing in one window task.
    """
    stops = pages.filter(stop).groupBy(*group_by).agg(F.min(page_col).alias("stop"))
    return before_stops(pages, stops, group_by, page_col, max_broadcast_groups)


def before_stops(pages: DataFrame, stops: DataFrame, group_by: Sequence[str], page_col: str, max_broadcast_groups: int = 100_000) -> DataFrame:
    """The pages before their group's ``stop`` (all of them where there is none)."""
    stops = stops.select(*group_by, F.col("stop").alias("__stop"))
    side = F.broadcast(stops) if stops.limit(max_broadcast_groups + 1).count() <= max_broadcast_groups else stops
    j = pages.join(side, list(group_by), "left")
    return j.filter(F.col("__stop").isNull() | (F.col(page_col) < F.col("__stop"))).drop("__stop")

