"""Identity and history: keep-first dedup, seen-before filter, history append, upsert.

Scale notes
* keep-first is ``groupBy(key).agg(min_by(row, ordinal))``: a partial (map-side)
  aggregate, so a key that holds a third of all rows is reduced to one row per
  input partition before the shuffle. A window ``row_number`` would ship every
  row of the hot key to one task.
* long text keys are grouped on ``sha2(key, 256)`` so the shuffle key is 32 bytes.
* upsert joins on (key, ordinal-of-first-match), which is unique on both sides:
  no hot join partition even if the state holds many rows with one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed


def _key_expr(key: str, hash_key: bool) -> Column:
    return F.sha2(F.col(key), 256) if hash_key else F.col(key)


def composite_key(*cols: str, hashed: bool = True) -> Column:
    """One key column from several fields (e.g. title+company+location).

    Fields are joined with a unit separator (no field can fake a boundary) and, by
    default, hashed so the shuffle key stays 32 bytes; any field null -> null key.
    """
    parts = [F.col(c).cast("string") for c in cols]
    any_null = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    joined = F.when(any_null, F.lit(None).cast("string")).otherwise(F.concat_ws("\x1f", *parts))
    return F.sha2(joined, 256) if hashed else joined


def has_key(key: str) -> Column:
    """Null and '' keys both drop."""
    return F.col(key).isNotNull() & (F.col(key).cast("string") != "")


def keep_first(df: DataFrame, key: str, ordinal: str = "ordinal", hash_key: bool = False,
               drop_empty: bool = True, carry: Sequence[str] | None = None, keep_hash: bool = False) -> DataFrame:
    """First row per key by ``ordinal`` (not ``dropDuplicates``: order is defined).

    ``carry`` limits the columns that travel through the shuffle (default: all); with
    ``hash_key`` the shuffle key is ``sha2(key)`` and a long key need not be carried at all.
    ``keep_hash`` also returns the grouping hash as ``__k`` (for a later anti join).
    """
    cols = list(carry) if carry is not None else df.columns
    if ordinal not in cols:
        cols.append(ordinal)
    src = df.filter(has_key(key)) if drop_empty else df
    packed = F.struct(*[F.col(c) for c in cols])
    out = (src.groupBy(_key_expr(key, hash_key).alias("__k"))
           .agg(F.min_by(packed, F.col(ordinal)).alias("__r")))
    return out.select("__k", "__r.*") if keep_hash else out.select("__r.*")


def new_vs_history(batch: DataFrame, history_keys: DataFrame, key: str = "url", ordinal: str = "ordinal",
                   hash_key: bool = False, ignore_history: bool = False,
                   carry: Sequence[str] | None = None) -> DataFrame:
    """Rows of a batch not seen before.

    Check and insert interleave in the sequential form, so a repeat inside the batch
    drops too (first wins); an empty key never counts as new. ``ignore_history`` keeps
    every row (J2) - the caller still appends to the history. The history side is a
    key-only scan with no de-duplication (an anti join ignores repeats on its right side,
    so no aggregate over the whole history runs); AQE picks broadcast or sort-merge from
    its runtime size.
    """
    if ignore_history:
        return batch
    first = keep_first(batch, key, ordinal, hash_key, carry=carry, keep_hash=True)
    seen = history_keys.select(_key_expr(key, hash_key).alias("__k"))
    return first.join(seen, "__k", "left_anti").drop("__k")


def flag_new(batch: DataFrame, history_keys: DataFrame, key: str, ordinal: str = "ordinal",
             hash_key: bool = False) -> DataFrame:
    """Every batch row plus ``is_new`` (the row that J1 would keep)."""
    kept = (new_vs_history(batch, history_keys, key, ordinal, hash_key, carry=[ordinal])
            .select(ordinal).withColumn("is_new", F.lit(True)))
    return batch.join(kept, ordinal, "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def history_append(history: DataFrame, batch: DataFrame, run_ts: Column | str, key: str = "url",
                   ordinal: str = "ordinal", hash_key: bool = False,
                   columns: Sequence[str] = ("title", "company", "location", "source")) -> DataFrame:
    """K6: INSERT OR IGNORE - rows whose key is new, first writer wins, stamped ``first_seen``.

    Returns only the rows to append (write them with mode 'append' to the history table).
    """
    ts = F.lit(run_ts) if isinstance(run_ts, str) else run_ts
    new = new_vs_history(batch, history, key, ordinal, hash_key)
    return new.select(F.col(key), *[F.col(c) for c in columns], ts.alias("first_seen"))


def upsert_fold(updates: DataFrame, key: str, fields: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Fold several updates per key: the last *present* (non-null) value per field.

    Null means "absent" (the field keeps its older value); '' is a present value.
    ``max_by`` ignores rows whose ordering value is null, so ``when(present, ordinal)``
    drops absent fields from the fold. Partial aggregation: one row per key per task.
    """
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(ordinal))).alias(f) for f in fields]
    return updates.filter(has_key(key)).groupBy(key).agg(F.min(ordinal).alias(ordinal), *aggs)


def upsert(state: DataFrame, updates: DataFrame, key: str, fields: Sequence[str],
           ordinal: str = "ordinal") -> DataFrame:
    """J3 (+J4): merge updates into an ordered state table.

    * a present update field overwrites (even with ''), an absent (null) one keeps the old value;
    * only the *first* state row (by ordinal) with the key is updated;
    * keyless updates are always appended; new keys are appended after the state in update order;
    * ``was_updated`` marks state rows that received an update; ``origin`` 0 = state, 1 = appended.
    Output order key: (origin, ordinal).
    """
    fields = list(fields)
    st = state.select(key, ordinal, *fields)
    firsts = st.filter(has_key(key)).groupBy(key).agg(F.min(ordinal).alias("__first"))
    folded = upsert_fold(updates.select(key, ordinal, *fields), key, fields, ordinal)
    upd = (folded.join(firsts, key, "left")
           .select(F.col(key).alias("__uk"), F.col(ordinal).alias("__uo"), "__first",
                   *[F.col(f).alias(f"__u_{f}") for f in fields]))
    joined = st.join(upd, (st[key] == upd["__uk"]) & (st[ordinal] == upd["__first"]), "full_outer")
    matched = joined[ordinal].isNotNull() & joined["__uk"].isNotNull()
    keyed = joined.select(
        F.coalesce(st[key], F.col("__uk")).alias(key),
        F.when(st[ordinal].isNotNull(), F.lit(0)).otherwise(F.lit(1)).alias("origin"),
        F.coalesce(st[ordinal], F.col("__uo")).alias(ordinal),
        *[F.when(matched | st[ordinal].isNull(), F.coalesce(F.col(f"__u_{f}"), st[f])).otherwise(st[f]).alias(f)
          for f in fields],
        matched.alias("was_updated"))
    keyless = (updates.filter(~has_key(key))
               .select(F.col(key), F.lit(1).alias("origin"), F.col(ordinal), *[F.col(f) for f in fields],
                       F.lit(False).alias("was_updated")))
    return keyed.unionByName(keyless)


def upsert_map(state: DataFrame, updates: DataFrame, key: str, fields: str = "fields", ordinal: str = "ordinal") -> DataFrame:
    """J3/J4 in map form: ``fields`` is a map, and which fields there are is left to the rows.

    As ``upsert``, but a field that a map holds is present even if its value is null: it overwrites. The
    merge is an aggregate over (key, field, place), so a key with many updates is reduced in every
    task; what meets in one row is one value a field.
    """
    st = state.select(key, F.lit(0).alias("origin"), F.col(ordinal).alias("ordinal"), F.col(fields).alias("fields"))
    up = updates.select(key, F.lit(1).alias("origin"), F.col(ordinal).alias("ordinal"), F.col(fields).alias("fields"))
    firsts = st.filter(has_key(key)).groupBy(key).agg(F.min("ordinal").alias("first"))
    st = st.join(firsts, key, "left").withColumn("counts", F.col("ordinal") == F.col("first"))
    # merged: the first state row of a key, and the updates of keyed rows
    parts = st.filter("counts").select(key, "origin", "ordinal", "fields").unionByName(up.filter(has_key(key)))
    place = F.struct("origin", "ordinal")
    entries = parts.select(key, place.alias("place"), F.explode("fields").alias("field", "value"))
    latest = entries.groupBy(key, "field").agg(F.max_by(F.struct("value"), "place").alias("v"))
    merged = latest.groupBy(key).agg(F.collect_list(F.struct("field", "v.value")).alias("entries"))
    heads = parts.groupBy(key).agg(F.min(place).alias("head"), (F.count_if(F.col("origin") == 1) > 0).alias("updated"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kind = state.schema[fields].dataType.simpleString()
    keyed = (heads.withColumnRenamed(key, "__k").join(merged, F.col("__k") == merged[key], "left")
             .select(F.col("__k").alias(key), "head.origin", F.col("head.ordinal").alias(ordinal),
                     F.coalesce(F.map_from_entries(F.array_sort("entries")), none).cast(kind).alias(fields),
                     (F.col("updated") & (F.col("head.origin") == 0)).alias("was_updated")))
    rest = (st.filter(~F.coalesce("counts", F.lit(False))).drop("first", "counts").unionByName(up.filter(~has_key(key)))
            .select(key, "origin", F.col("ordinal").alias(ordinal), F.col("fields").alias(fields), F.lit(False).alias("was_updated")))
    return keyed.unionByName(rest)


def upsert_contributions(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Per-key (and per keyless row) contributions ``u`` (updated) and ``nw`` (new) of an upsert.

    Sequential semantics: the first update of a key not in the state inserts, every
    later one updates; keyless rows always insert. Per-key counts are a partial
    aggregate; membership in the state is a semi / anti join.
    """
    per_key = updates.filter(has_key(key)).groupBy(key).agg(F.count("*").alias("n"))
    state_keys = state.filter(has_key(key)).select(key)
    # semi / anti joins against the state keys: no aggregate over the (large) state
    hit = per_key.join(state_keys, key, "left_semi").select(
        F.col("n").cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("nw"))
    miss = per_key.join(state_keys, key, "left_anti").select(
        (F.col("n") - 1).cast("bigint").alias("u"), F.lit(1).cast("bigint").alias("nw"))
    keyed = hit.unionByName(miss)
    keyless = updates.filter(~has_key(key)).select(F.lit(0).cast("bigint").alias("u"), F.lit(1).cast("bigint").alias("nw"))
    return keyed.unionByName(keyless)


def upsert_counts(state: DataFrame, updates: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """A7 part: how many update rows updated an existing row vs inserted one (one row)."""
    return upsert_contributions(state, updates, key).agg(
        F.coalesce(F.sum("u"), F.lit(0)).cast("bigint").alias("updated"),
        F.coalesce(F.sum("nw"), F.lit(0)).cast("bigint").alias("new"))


def union_sources(frames: Sequence[DataFrame], columns: Sequence[str] = tuple(fixed.POSTING_7),
                  fill: str = "") -> DataFrame:
    """Bag union by column name; missing columns -> ''; unexpected columns are an error."""
    allowed = set(columns) | {"ordinal", "source_no"}
    for i, f in enumerate(frames):
        extra = [c for c in f.columns if c not in allowed]
        if extra:
            raise ValueError(f"frame {i} has unexpected columns {extra} (allowed: {list(columns)})")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    keep = [c for c in out.columns if c not in columns]
    return out.select(*keep, *[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c) for c in columns])


def project(df: DataFrame, columns: Sequence[str], fill: str = "") -> DataFrame:
    """Fixed column order, absent/null -> ''."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit(fill)) if c in df.columns else F.lit(fill)).alias(c)
                       for c in columns])


def consolidate(postings: DataFrame, key: str = "url", ordinal: str = "ordinal",
                columns: Sequence[str] = tuple(fixed.POSTING_9), hash_key: bool = False) -> DataFrame:
    """Drop empty key, keep first per key across queries and sources, 9 columns."""
    first = keep_first(postings, key, ordinal, hash_key)
    return project(first, columns)
