"""Quality operators against the reference's display semantics (plain Python)."""

from pyspark.sql import functions as F

from jobsmith.functions import text as tx
from jobsmith.operators import quality as qa


def test_progress_label_matches_python_formatting(spark):
    for done, total in [(1, 8), (49, 400), (3, 7), (0, 0), (5, 5), (979, 1000), (9785, 10000)]:
        inputs = spark.range(total).select(F.lit("x").alias("description"))
        upd = spark.createDataFrame([("y" * 101, "today")] * done + [("short", "")] * 2,
                                    "description string, posted_date string")
        r = qa.progress_pct(inputs, upd).first()
        pct = (done / total) * 100 if total > 0 else 0
        assert r["pct_label"] == f"{pct:.1f}" and r["pct"] == pct
        assert (r["total"], r["done"], r["with_date"], r["remaining"]) == (total, done, done, total - done)


def test_completeness_thresholds_are_strict(spark):
    vals = ["", None, " " * 30, "a" * 20, "a" * 21, " " + "b" * 20 + " ", "c" * 50, "c" * 51, "d" * 100, "d" * 101]
    df = spark.createDataFrame([(v,) for v in vals], "description string").withColumn("posted_date", F.lit(""))
    r = qa.field_completeness(df, qa.standard_checks(salary=None)).first()
    assert r["n"] == len(vals)
    assert r["desc_nonempty"] == sum(1 for v in vals if v)
    assert r["desc_gt20_stripped"] == sum(1 for v in vals if v and len(v.strip()) > 20)
    assert r["desc_gt50"] == sum(1 for v in vals if v and len(v) > 50)
    assert r["desc_gt100"] == sum(1 for v in vals if v and len(v) > 100)


def test_previews_and_record_profile(spark):
    df = spark.createDataFrame([(2, "late", 5, 1.5, True), (1, "", 0, 2.0, False)],
                               "ordinal long, title string, n long, x double, b boolean")
    prof = [(r["field"], r["preview"]) for r in qa.record_profile(df, "ordinal").orderBy("field_no").collect()]
    first = {"ordinal": 1, "title": "", "n": 0, "x": 2.0, "b": False}
    assert prof == [(k, str(v)[:100] if v else "(empty)") for k, v in first.items()]  # Python truthiness
    row = spark.createDataFrame([("t" * 60, "x" * 1234)], "title string, d string").select(
        qa.title_line(F.col("title")).alias("a"), qa.title_line(F.lit("ab")).alias("b"),
        qa.length_label(F.col("d")).alias("c"), tx.preview(F.lit(None).cast("string"), 100, "(empty)").alias("e")).first()
    assert row["a"] == "t" * 50 and row["b"] == f"{'ab':<50}" and row["c"] == f"{1234:,}" and row["e"] == "(empty)"


def test_running_total_and_first_n(spark):
    per = spark.createDataFrame([(2, "b", 3), (1, "a", 0), (3, "c", 4)], "query_no long, query string, n_new long")
    rows = [(r["query"], r["so_far"], r["position"], r["of_n"]) for r in qa.running_total(per).orderBy("query_no").collect()]
    assert rows == [("a", 0, 1, 3), ("b", 3, 2, 3), ("c", 7, 3, 3)]
    df = spark.range(20).withColumnRenamed("id", "ordinal")
    assert [r[0] for r in qa.first_n(df, 3).collect()] == [0, 1, 2] and qa.first_n(df, 0).count() == 20
    assert [r[0] for r in qa.sample_topk(df, F.col("ordinal") % 7 == 3, 2).collect()] == [3, 10]
