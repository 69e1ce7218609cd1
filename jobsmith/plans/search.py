"""The search plan - queries x sources x pages as rows of search URLs.

Built with generators, not joins: each query row explodes the (fixed, small)
source list and a ``sequence`` of page numbers, so the plan is map-only and
grows linearly with the query table. URLs are text only; nothing is fetched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed

_PH = re.compile(r"\{(\w+)\}")


def _format(template: str, values: dict[str, Column]) -> Column:
    parts, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def search_plan(queries: DataFrame, query_col: str, location: str | Column, pages: int,
                sources: Sequence[str] = tuple(fixed.SOURCE_ORDER), config: dict | None = None,
                url_encode: bool = False) -> DataFrame:
    """One row per (query, source, page): ``page_no`` 1-based, ``start`` offset, ``search_url``.

    offset sources: start = page * page_size for pages 0..n-1; numbered sources: page 1..n.
    ``url_encode`` encodes query/location (the reference inserts them raw).
    """
    config = config or fixed.SOURCES
    src = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).alias("source_no")) for i, s in enumerate(sources)])
    loc = F.lit(location) if isinstance(location, str) else location
    q = F.col(query_col)
    if url_encode:
        q, loc = F.url_encode(q), F.url_encode(loc)
    rows = (queries.select("*", F.explode(src).alias("__s"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page_no"))
            .withColumn("source", F.col("__s.source")).withColumn("source_no", F.col("__s.source_no")).drop("__s"))
    start_expr = None
    url_expr = None
    for s in sources:
        cfg = config[s]
        if cfg["page_mode"] == "offset":
            start = (F.col("page_no") - 1) * F.lit(int(cfg["page_size"]))
        else:
            start = F.lit(None).cast("int")
        url = _format(cfg["search_url"], {"base": F.lit(cfg["base_url"]), "query": q, "location": loc,
                                          "start": start, "page": F.col("page_no")})
        cond = F.col("source") == s
        start_expr = F.when(cond, start) if start_expr is None else start_expr.when(cond, start)
        url_expr = F.when(cond, url) if url_expr is None else url_expr.when(cond, url)
    return rows.withColumn("start", start_expr.cast("bigint")).withColumn("search_url", url_expr)
