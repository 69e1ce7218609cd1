"""Enrichment: skip rows already enriched, attach details on a canonical key,
fold the results into a state table, count outcomes.

The expensive step (detail extraction) must only see rows that still need it,
so the anti join is written *before* it - Catalyst cannot push an anti join
through a Python operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions.text import canonical_url, url_key_strict
from jobsmith.operators.identity import has_key, keep_first, upsert, upsert_contributions
from jobsmith.session import cut_lineage


def enriched_keys(state: DataFrame, key: str = "url", ordinal: str = "ordinal",
                  min_len: int = fixed.ENRICHED_MIN_LEN) -> DataFrame:
    """Keys whose first state row (state order) holds a description longer than ``min_len``.

    The length test runs before the aggregate, so only (key, ordinal, flag) is shuffled,
    never the description text.
    """
    flagged = state.select(key, ordinal, F.coalesce(F.length("description") > min_len, F.lit(False)).alias("__ok"))
    return (flagged.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min_by("__ok", F.col(ordinal)).alias("__ok")).filter("__ok").select(key))


def flag_enriched(postings: DataFrame, state: DataFrame, key: str = "url", ordinal: str = "ordinal",
                  min_len: int = fixed.ENRICHED_MIN_LEN) -> DataFrame:
    """``skipped`` = the first state row with the key has a description longer than ``min_len``."""
    done = enriched_keys(state, key, ordinal, min_len).withColumn("skipped", F.lit(True))
    return postings.join(done, key, "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def skip_enriched(postings: DataFrame, state: DataFrame, key: str = "url", ordinal: str = "ordinal",
                  min_len: int = fixed.ENRICHED_MIN_LEN) -> DataFrame:
    """P8 as a filter: rows that still need enrichment (anti join on the key)."""
    return postings.join(enriched_keys(state, key, ordinal, min_len), key, "left_anti")


def with_canonical_url(df: DataFrame, url: str = "url", param: str = fixed.URL_KEY_PARAM,
                       fmt: str = fixed.CLEAN_URL_FORMAT, out: str = "canonical_url") -> DataFrame:
    """clean URL built from the job key, else the original url."""
    return df.withColumn(out, canonical_url(F.col(url), url_key_strict(F.col(url), param), fmt))


def successful_only(details: DataFrame) -> DataFrame:
    """Details whose text and date are null unless their status is 'success': no posting takes them, so they need not travel."""
    ok = F.col("status") == "success"
    return details.withColumns({c: F.when(ok, F.col(c)) for c in ("description", "posted_date")})


def enrich(postings: DataFrame, details: DataFrame, key: str = "canonical_url",
           detail_key: str | None = None, detail_ordinal: str | None = None) -> DataFrame:
    """Left join details; on status 'success' replace description AND posted_date together.

    ``details``: (key, description, posted_date, status). Several detail rows per key are
    reduced to the first (by ``detail_ordinal``) so the join stays 1:1.
    """
    dk = detail_key or key
    d = successful_only(details).select(F.col(dk).alias("__dk"), F.col("description").alias("__dd"),
                       F.col("posted_date").alias("__dp"), F.col("status").alias("__ds"),
                       *([F.col(detail_ordinal).alias("__do")] if detail_ordinal else []))
    if detail_ordinal:
        d = keep_first(d, "__dk", "__do").drop("__do")
    else:
        d = d.dropDuplicates(["__dk"])  # keys expected unique; which one is kept is then irrelevant
    j = postings.join(d, postings[key] == d["__dk"], "left")
    ok = F.coalesce(F.col("__ds") == "success", F.lit(False))
    cols = []
    for c in postings.columns:
        if c == "description":
            cols.append(F.when(ok, F.col("__dd")).otherwise(F.col(c)).alias(c))
        elif c == "posted_date":
            cols.append(F.when(ok, F.col("__dp")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    if "posted_date" not in postings.columns:
        cols.append(F.when(ok, F.col("__dp")).alias("posted_date"))
    return j.select(*cols, ok.alias("success"))


def enrich_stats(flags: DataFrame, state: DataFrame, updates: DataFrame, key: str = "url",
                 ordinal: str = "ordinal") -> DataFrame:
    """Success (incl. skipped), failed, skipped, updated, new - one row.

    ``flags`` has one row per input posting with boolean ``skipped`` and ``success``.
    One aggregate over the union of per-posting and per-key contributions (no join of
    one-row frames).
    """
    z = F.lit(0).cast("bigint")

    def b(c):
        return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    per_post = flags.select(b(F.col("skipped") | F.col("success")).alias("s"),
                            b(~F.col("skipped") & ~F.col("success")).alias("f"),
                            b(F.col("skipped")).alias("k"), z.alias("u"), z.alias("nw"))
    per_key = upsert_contributions(state, updates, key).select(z.alias("s"), z.alias("f"), z.alias("k"), "u", "nw")
    sums = per_post.unionByName(per_key).agg(*[F.sum(c).alias(c) for c in ("s", "f", "k", "u", "nw")])
    return sums.select(*[F.coalesce(F.col(c), z).alias(n) for c, n in
                         (("s", "success"), ("f", "failed"), ("k", "skipped"), ("u", "updated"), ("nw", "new"))])


def enrich_all(postings: DataFrame, details: DataFrame, key: str = "url", detail_key: str = "canonical_url",
               param: str = fixed.URL_KEY_PARAM, fmt: str = fixed.CLEAN_URL_FORMAT, detail_ordinal: str | None = None) -> DataFrame:
    """A7, second mode: every posting with a url takes its details, none is skipped for what it holds already.

    ``outcome``: ``success``, ``failed``, or ``no url`` for a blank one, which stays as it is and is not counted."""
    named = has_key(key)
    todo = with_canonical_url(postings.withColumn(key, F.when(named, F.col(key))), key, param, fmt)
    out = enrich(todo, details, "canonical_url", detail_key, detail_ordinal)
    outcome = F.when(F.col(key).isNull(), "no url").when(F.col("success"), "success").otherwise("failed")
    return out.withColumn("outcome", outcome).drop("success", "canonical_url")


def enrich_all_stats(enriched: DataFrame) -> DataFrame:
    """A7, second mode: one row of ``success`` and ``failed``; postings without a url are in neither."""
    return enriched.agg(F.count_if(F.col("outcome") == "success").alias("success"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def enrich_run(postings: DataFrame, state: DataFrame, details: DataFrame, fields: Sequence[str],
               key: str = "url", ordinal: str = "ordinal", detail_key: str = "canonical_url",
               min_len: int = fixed.ENRICHED_MIN_LEN, param: str = fixed.URL_KEY_PARAM,
               fmt: str = fixed.CLEAN_URL_FORMAT, detail_ordinal: str | None = "ordinal",
               materialize: bool | str = True) -> tuple[DataFrame, DataFrame]:
    """X3 batch body: P8 -> F3/F5 -> J5 -> J4 -> J3 with the sequential skip rule made exact.

    Sequentially, a posting is skipped when the first state row with its key already holds
    a description longer than ``min_len`` - and the state changes as earlier postings of the
    same batch are upserted. A processed posting leaves that row holding its own result
    (the detail description on success, else its own present description), so for each key
    every posting after the first one whose result is long enough is skipped as well.
    That is a per-key ``min(ordinal)`` (partial aggregate) joined back - no window, no hot task.
    Skipped rows are not upserted; a failed enrichment still upserts the input row.
    Returns (new_state, flags[key, ordinal, skipped, success]).

    ``materialize``: the flagged postings and the per-posting outcome feed several consumers
    (state merge, flags, counters); they are written once to the shared checkpoint folder
    instead of being recomputed by each consumer (and a lost executor re-reads, not re-runs).
    ``"outcome"`` materializes only the outcome (when the flags are not used afterwards).
    """
    flagged = flag_enriched(postings, state, key, ordinal, min_len)
    if materialize is True:
        flagged = cut_lineage(flagged)
    todo = with_canonical_url(flagged.filter(~F.col("skipped")), key, param, fmt)
    d_ord = detail_ordinal if detail_ordinal in details.columns else None
    enriched = enrich(todo, details, "canonical_url", detail_key, d_ord)
    long_enough = F.coalesce(F.length("description") > min_len, F.lit(False))
    first_long = (enriched.filter(has_key(key) & long_enough).groupBy(key)
                  .agg(F.min(ordinal).alias("__first_long")))
    # blank key: keyless upserts append, so only the first processed blank posting can become
    # the row later blank postings are checked against (and only if the state has none)
    blank = F.col(key).isNotNull() & (F.col(key) == "")
    first_blank = (enriched.filter(blank).groupBy(key)
                   .agg(F.min_by(F.struct(long_enough.alias("l"), F.col(ordinal).alias("o")), F.col(ordinal)).alias("f"))
                   .filter(F.col("f.l")).select(key, F.col("f.o").alias("__first_long"))
                   .join(state.filter(blank).select(key), key, "left_anti"))
    first_long = first_long.unionByName(first_blank)
    later = F.coalesce(F.col(ordinal) > F.col("__first_long"), F.lit(False))
    enriched = enriched.join(first_long, key, "left").withColumn("__later", later).drop("__first_long")
    if materialize:
        enriched = cut_lineage(enriched)
    later = F.col("__later")
    processed = enriched.filter(~later).drop("__later")
    updates = processed.select(key, ordinal, *fields)
    new_state = upsert(state, updates, key, fields, ordinal)
    outcome = enriched.select(ordinal, "__later", "success")
    flags = (flagged.select(key, ordinal, "skipped").join(outcome, ordinal, "left")
             .select(key, ordinal, (F.col("skipped") | F.coalesce("__later", F.lit(False))).alias("skipped"),
                     (F.coalesce("success", F.lit(False)) & ~F.coalesce("__later", F.lit(False))).alias("success")))
    return new_state, flags
