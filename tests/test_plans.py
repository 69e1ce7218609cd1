"""Plan-shape checks: the scale properties the design relies on, read from the
physical plans (so a refactor cannot silently lose them)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from jobsmith.plans import catalog
from jobsmith.operators import identity as idn
from tests.conftest import SMOKE

WRITES_FIRST = {"read_csv", "read_json", "sink_csv", "sink_json", "stream_history", "stream_dedup",
                "stream_dedup_watermark", "stream_enrich", "read_csv_mixed"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in catalog.QUERIES if k not in WRITES_FIRST))
def test_no_cartesian_and_single_parse(spark, key):
    plan = plan_of(E.queries()[key](spark, SMOKE))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("MapInPandas") <= 1  # the HTML parser never runs twice on a page


def test_keep_first_is_partially_aggregated(spark):
    df = spark.createDataFrame([("k", i, "x" * 10) for i in range(20)], "url string, ordinal long, t string")
    plan = plan_of(idn.keep_first(df, "url", "ordinal"))
    assert plan.index("partial_min_by") > plan.index("Exchange")  # text: outermost first
    hashed = plan_of(idn.keep_first(df, "t", "ordinal", hash_key=True, carry=["ordinal", "url"]))
    assert "sha2" in hashed and ", t#" not in hashed.split("partial_min_by")[1].split("\n")[0]


def test_history_side_has_no_aggregate(spark):
    batch = spark.createDataFrame([("a", 1)], "url string, ordinal long")
    hist = spark.range(100).select(F.col("id").cast("string").alias("url"))
    plan = plan_of(idn.new_vs_history(batch, hist, "url", "ordinal"))
    assert "LeftAnti" in plan
    # keep-first is a SortAggregate; a HashAggregate could only be a distinct over the history
    assert "HashAggregate" not in plan


def test_upsert_joins_on_key_and_first_ordinal(spark):
    st = spark.createDataFrame([("k", 1, "a")], "url string, ordinal long, a string")
    up = spark.createDataFrame([("k", 5, "b")], "url string, ordinal long, a string")
    plan = plan_of(idn.upsert(st, up, "url", ["a"]))
    assert "FullOuter" in plan and "__first" in plan


def test_postings_carry_one_struct_per_card(spark):
    from jobsmith.functions import fixed
    from jobsmith.operators import html as H
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    plan = plan_of(H.extract_postings(pages, fixed.SOURCES["indeed"]))
    assert plan.count("Generate") <= 1 and "Exchange" not in plan
