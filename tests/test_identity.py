"""Keep-first, seen-before, history append, upsert and fold: before/after tables with
hand-written results; results must not depend on partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.operators import identity as idn


FIELDS = ["a", "b"]


SCHEMA = "url string, ordinal long, a string, b string"
# name, state, updates, rows afterwards, (updated, new); None is an absent field
UPSERTS = [
    ("present fields overwrite, absent ones stay", [("k", 0, "x", "y")], [("k", 9, "z", None)], [("k", "z", "y")], (1, 0)),
    ("an empty field is present", [("k", 0, "x", "y")], [("k", 9, "", None)], [("k", "", "y")], (1, 0)),
    ("later updates win field by field", [("k", 0, "x", "y")], [("k", 9, "p", None), ("k", 10, None, "q"), ("k", 11, "r", None)],
     [("k", "r", "q")], (3, 0)),
    ("the first of equal state keys is updated", [("k", 0, "x", "y"), ("k", 1, "x", "y")], [("k", 9, "z", "z")],
     [("k", "z", "z"), ("k", "x", "y")], (1, 0)),
    ("new keys follow the state in update order", [("k", 0, "x", "y")], [("m", 9, "1", None), ("j", 10, "2", None)],
     [("k", "x", "y"), ("m", "1", None), ("j", "2", None)], (0, 2)),
    ("a new key that comes again updates its own row", [], [("m", 9, "1", None), ("m", 10, None, "2")], [("m", "1", "2")], (1, 1)),
    ("updates without a key are appended each time", [("", 0, "x", None)], [("", 9, "1", None), (None, 10, "2", None), ("", 11, "3", None)],
     [("", "x", None), ("", "1", None), (None, "2", None), ("", "3", None)], (0, 3)),
]


@pytest.mark.parametrize("case", UPSERTS, ids=[c[0] for c in UPSERTS])
def test_upsert_before_and_after(spark, case):
    _, state, updates, after, counts = case
    st, up = spark.createDataFrame(state, SCHEMA).repartition(3), spark.createDataFrame(updates, SCHEMA).repartition(4)
    got = sorted(idn.upsert(st, up, "url", FIELDS).collect(), key=lambda r: (r["origin"], r["ordinal"]))
    assert [(r["url"], r["a"], r["b"]) for r in got] == after
    c = idn.upsert_counts(st, up, "url").first()
    assert (c["updated"], c["new"]) == counts


def test_fold_last_present_value(spark):
    rows = [("k", 1, "x", None), ("k", 2, None, "y"), ("k", 3, "", None), ("j", 5, None, None)]
    df = spark.createDataFrame(rows, "url string, ordinal long, a string, b string")
    out = {r["url"]: r for r in idn.upsert_fold(df, "url", FIELDS).collect()}
    assert (out["k"]["a"], out["k"]["b"]) == ("", "y")  # '' is a present value
    assert (out["j"]["a"], out["j"]["b"]) == (None, None)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_keep_first_is_partition_independent(spark, parts):
    rng = random.Random(7)
    rows = [(rng.choice(["u1", "u2", "u3", "", None]), i, f"t{i}") for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "url string, ordinal long, title string").repartition(parts)
    got = sorted((r["url"], r["ordinal"]) for r in idn.keep_first(df, "url", "ordinal").collect())
    expect = {}
    for u, o, _ in sorted(rows, key=lambda r: r[1]):
        if u and u not in expect:
            expect[u] = o
    assert got == sorted(expect.items())
    hashed = sorted((r["url"], r["ordinal"]) for r in idn.keep_first(df, "url", "ordinal", hash_key=True).collect())
    assert hashed == got


def test_new_vs_history_and_append(spark):
    batch = spark.createDataFrame([("a", 1, "A1"), ("b", 2, "B"), ("a", 3, "A2"), ("", 4, "E"), ("c", 5, "C")],
                                  "url string, ordinal long, title string")
    hist = spark.createDataFrame([("b", "old", "co", "loc", "s", "t0")],
                                 "url string, title string, company string, location string, source string, first_seen string")
    new = sorted(r["ordinal"] for r in idn.new_vs_history(batch, hist, "url", "ordinal").collect())
    assert new == [1, 5]  # repeat inside the batch drops, empty key never new, seen key drops
    assert idn.new_vs_history(batch, hist, "url", "ordinal", ignore_history=True).count() == 5
    app = idn.history_append(hist, batch.withColumn("company", F.lit("c")).withColumn("location", F.lit("l"))
                             .withColumn("source", F.lit("s")), "2024-01-02T00:00:00").collect()
    assert sorted((r["url"], r["title"], r["first_seen"]) for r in app) == [
        ("a", "A1", "2024-01-02T00:00:00"), ("c", "C", "2024-01-02T00:00:00")]


def test_union_sources_rejects_unexpected_columns(spark):
    a = spark.createDataFrame([("t", "u")], "title string, url string")
    b = spark.createDataFrame([("t2", "s")], "title string, salary string")
    out = idn.union_sources([a, b]).collect()
    assert [r["salary"] for r in out] == ["", "s"] and out[0]["description"] == ""
    c = spark.createDataFrame([("t", "x")], "title string, surprise string")
    with pytest.raises(ValueError):
        idn.union_sources([a, c])


def test_consolidate_projection(spark):
    rows = [(1, "T", "u1", "q1"), (2, "T2", "u1", "q2"), (3, "T3", None, "q1"), (4, "T4", "u2", "q2")]
    df = spark.createDataFrame(rows, "ordinal long, title string, url string, search_query string")
    out = idn.consolidate(df).collect()
    assert sorted((r["url"], r["search_query"]) for r in out) == [("u1", "q1"), ("u2", "q2")]
    assert out[0].__fields__ == fixed.POSTING_9 and all(r["company"] == "" for r in out)
