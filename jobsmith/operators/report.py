"""Report rows: escaped, defaulted, truncated posting rows plus a one-row summary.

The page layout itself is presentation and not built; its data rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions.text import html_escape


def _field(df: DataFrame, name: str) -> Column:
    """Absent (missing column or null) -> default; '' stays ''."""
    default = F.lit(fixed.REPORT_DEFAULTS[name])
    return F.coalesce(F.col(name), default) if name in df.columns else default


def report_rows(postings: DataFrame, keep: tuple[str, ...] = (),
                cut: int = fixed.REPORT_DESCRIPTION_CUT, ellipsis: str = fixed.REPORT_ELLIPSIS) -> DataFrame:
    """Escape first, then cut the description (may split an entity), then '...'."""
    cols = [F.col(k) for k in keep]
    for name in ("source", "url", "title", "company", "location", "salary"):
        cols.append(html_escape(_field(postings, name)).alias(name))
    desc = F.substring(html_escape(_field(postings, "description")), 1, cut)
    cols.append(F.concat(desc, F.lit(ellipsis)).alias("description"))
    return postings.select(*cols)


def report_summary(postings: DataFrame, query: str, location: str, run_date: str,
                   date_format: str = fixed.REPORT_DATE_FORMAT) -> DataFrame:
    """K7 summary + A3: date, escaped query and location, row count; no rows when input is empty."""
    d = F.date_format(F.to_date(F.lit(run_date)), date_format)
    return (postings.agg(F.count("*").alias("total_jobs"))
            .filter(F.col("total_jobs") > 0)
            .select(d.alias("report_date"), html_escape(F.lit(query)).alias("query"),
                    html_escape(F.lit(location)).alias("location"), F.col("total_jobs").cast("bigint")))


def report_title_terms(terms: Column, n: int = fixed.REPORT_TITLE_TERMS) -> Column:
    """first ``n`` search terms joined with ', '."""
    return F.array_join(F.slice(terms, 1, n), ", ")
