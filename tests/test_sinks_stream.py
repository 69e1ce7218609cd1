"""Sink round trips (CSV/JSON), report rows, search plan, and the replay-safe
streaming history."""

import csv
import glob
import html as pyhtml
import os

import pytest
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.operators import report as rp
from jobsmith.plans.search import search_plan
from jobsmith.session import work_path
from jobsmith.sources import files as io
from jobsmith.streaming.history import history_batch, stream_new_postings

TRICKY = [
    ("Say \"hi\", ok", "Co, Ltd", " leading", "€50,000 - €70,000", "line1\nline2\\back", "https://x/1", "s1"),
    ("", None, "Cork", "", "<b>&'\"</b>", "https://x/2", "s2"),
    ("Ünïcode", "c", "l", "s", "d", "", "s1"),
]


def _posts(spark):
    return spark.createDataFrame(TRICKY, ", ".join(f"{c} string" for c in fixed.POSTING_7))


def test_csv_round_trip_and_python_reader(spark):
    path = work_path(spark, "t-csv")
    io.write_csv(_posts(spark).coalesce(1), path)
    back = io.read_csv(spark, [path, path + "-nope"]).collect()
    expect = [tuple("" if v is None else v for v in r) for r in TRICKY]
    assert sorted(tuple(r) for r in back) == sorted(expect)
    local = path.replace("file:", "")
    if os.path.isdir(local):
        files = glob.glob(os.path.join(local, "*.csv"))
        with open(files[0], newline="", encoding="utf-8") as f:
            rows = [tuple(r[c] for c in fixed.POSTING_7) for r in csv.DictReader(f)]
        assert sorted(rows) == sorted(expect)


def test_json_round_trip_keeps_absent(spark):
    path = work_path(spark, "t-json")
    io.write_json(_posts(spark), path)
    back = io.read_json(spark, path, io.string_schema(fixed.POSTING_7), strict=True, multiline=False).collect()
    assert sorted(tuple(r) for r in back) == sorted(TRICKY)
    maps = io.read_json_maps(spark, path).collect()
    assert sum(1 for m in maps if "company" not in m["rec"]) == 1  # null stays absent
    assert io.read_json(spark, path + "-missing").count() == 0


def test_report_rows_escape_then_cut(spark):
    long = "&" * 120
    df = spark.createDataFrame([("T<1>", long, None)], "title string, description string, company string")
    r = rp.report_rows(df).first()
    assert r["title"] == pyhtml.escape("T<1>")
    assert r["description"] == pyhtml.escape(long)[:300] + "..."  # may cut an entity in half
    assert r["company"] == "Unknown Company" and r["source"] == "unknown" and r["url"] == "#"
    s = rp.report_summary(df, "q & a", "<Dublin>", "2024-05-06").first()
    assert (s["report_date"], s["query"], s["location"], s["total_jobs"]) == ("2024-05-06", "q &amp; a", "&lt;Dublin&gt;", 1)
    assert rp.report_summary(df.limit(0), "q", "l", "2024-05-06").count() == 0


def test_search_plan_urls(spark):
    q = spark.createDataFrame([("Data Engineer",)], "q string")
    rows = {(r["source"], r["page_no"]): r for r in search_plan(q, "q", "Dublin", 2).collect()}
    assert rows[("indeed", 2)]["search_url"] == "https://ie.indeed.com/jobs?q=Data Engineer&l=Dublin&start=10"
    assert rows[("irishjobs", 1)]["search_url"] == \
        "https://www.irishjobs.ie/jobs?Keywords=Data Engineer&Location=Dublin&Page=1"
    assert rows[("linkedin", 2)]["start"] == 25 and len(rows) == 6


def test_stream_history_replay_safe(spark):
    rows = [(i, f"u{i % 7}", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "ordinal long, url string, title string")
    src, hist, ckpt = (work_path(spark, n) for n in ("s-src", "s-hist", "s-ckpt"))
    for i in range(4):
        df.filter((F.col("ordinal") >= i * 10) & (F.col("ordinal") < (i + 1) * 10)).coalesce(1) \
            .write.mode("overwrite").parquet(f"{src}/c{i}")
    stream_new_postings(spark, f"{src}/*", df.schema, hist, ckpt, "url", "ordinal").awaitTermination()
    first = sorted((r["url"], r["ordinal"]) for r in spark.read.parquet(hist).collect())
    assert first == [(f"u{i}", i) for i in range(7)]
    # replaying a middle batch and the last batch leaves the history unchanged
    for bid in (1, 3):
        part = df.filter((F.col("ordinal") >= bid * 10) & (F.col("ordinal") < (bid + 1) * 10))
        history_batch(part, bid, hist, "url", "ordinal")
    again = sorted((r["url"], r["ordinal"]) for r in spark.read.parquet(hist).collect())
    assert again == first


def test_json_reader_modes(spark, tmp_path):
    import pytest
    good = tmp_path / "good.json"
    good.write_text('[{"title": "a", "url": "u1"}, {"title": "b", "url": "u2", "extra": "x"}]', encoding="utf-8")
    bad = tmp_path / "bad.json"
    bad.write_text('[{"title": "a", "url": "u1"}, {"title": ', encoding="utf-8")  # truncated array
    schema = io.string_schema(["title", "url"])
    assert sorted(r["url"] for r in io.read_json(spark, str(good), schema).collect()) == ["u1", "u2"]
    assert io.read_json(spark, str(bad), schema).count() == 0            # undecodable -> empty
    assert io.read_json(spark, str(tmp_path / "missing.json"), schema).count() == 0
    with pytest.raises(Exception):
        io.read_json(spark, str(bad), schema, strict=True).collect()    # strict raises
    with pytest.raises(FileNotFoundError):
        io.read_json(spark, str(tmp_path / "missing.json"), schema, strict=True)


def test_csv_header_name_matching(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    (a / "part.csv").write_text("url,title,extra\nu1,T1,x\n", encoding="utf-8")
    b = tmp_path / "b"
    b.mkdir()
    (b / "part.csv").write_text('title,company,url\n"T, 2",C,u2\n', encoding="utf-8")
    rows = sorted(tuple(r) for r in io.read_csv(spark, [str(a), str(b), str(tmp_path / "nope")]).collect())
    assert rows == [("T, 2", "C", "", "", "", "u2", ""), ("T1", "", "", "", "", "u1", "")]


POSTING = "ordinal long, url string, title string"


def test_second_run_keeps_the_first_runs_history(spark):
    hist = work_path(spark, "h-runs")
    def rows(*urls):
        return spark.createDataFrame([(i, u, u) for i, u in enumerate(urls)], POSTING)
    history_batch(rows("u1", "u2", "u3"), 0, hist, "url", "ordinal", run_id="a", first_seen="t1")
    history_batch(rows("u3", "u4"), 0, hist, "url", "ordinal", run_id="b", first_seen="t2")
    got = {(r["url"], r["first_seen"]) for r in spark.read.parquet(hist).collect()}
    assert got == {("u1", "t1"), ("u2", "t1"), ("u3", "t1"), ("u4", "t2")}


def test_history_without_batches_is_read(spark):
    hist = work_path(spark, "h-plain")
    spark.createDataFrame([("u1", "t0")], "url string, first_seen string").write.parquet(hist)
    from jobsmith.streaming.history import read_history
    assert [r["url"] for r in read_history(spark, hist, None, ("a", 0)).collect()] == ["u1"]


def test_empty_write_keeps_what_was_there(spark):
    full = spark.createDataFrame([("t", "u")], "title string, url string")
    plans = [full.limit(0), full.groupBy("title", "url").count().drop("count").filter("title = 'x'")]
    for i, empty in enumerate(plans):  # with and without a shuffle
        path = work_path(spark, f"keep-{i}")
        assert io.write_csv(full, path, columns=["title", "url"], partition_by=["title"]) is True
        assert io.write_csv(empty, path, columns=["title", "url"], partition_by=["title"]) is False
        assert [tuple(r) for r in io.read_csv(spark, [path], ["title", "url"]).collect()] == [("t", "u")]


def test_mixed_headers_in_one_folder_and_skipped_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,company,url\nT1,C1,u1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("url,title,company\nu2,T2,C2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    got = sorted(tuple(r) for r in io.read_csv(spark, [str(tmp_path)], ["title", "company", "url"]).collect())
    assert got == [("T1", "C1", "u1"), ("T2", "C2", "u2")]
    skipped = {(os.path.basename(r["path"]), r["reason"]) for r in io.read_csv_skipped(spark, [str(tmp_path), str(tmp_path / "no")]).collect()}
    assert skipped == {("c.csv", "empty"), ("no", "missing")}


def test_header_errors_fail_the_read(spark, tmp_path):
    """Only a file's own content lets it be skipped, and never in our own outputs."""
    (tmp_path / "a.csv").write_text("title,url\nT1,u1\n", encoding="utf-8")
    (tmp_path / "b.csv.gz").write_bytes(b"no gzip at all")
    assert [tuple(r) for r in io.read_csv(spark, [str(tmp_path)], ["title", "url"]).collect()] == [("T1", "u1")]
    with pytest.raises(Exception, match="(?i)gzip|header check"):
        io.read_csv(spark, [str(tmp_path)], ["title", "url"], own=True)
    with pytest.raises(Exception, match="(?i)scheme"):
        io.headers(spark, ["nosuchstore://x/a.csv"])


def test_partition_columns_keep_their_text(spark):
    path = work_path(spark, "text-parts")
    rows = spark.createDataFrame([("t", "007"), ("u", "")], "title string, source string")
    io.write_csv(rows, path, columns=["title", "source"], partition_by=["source"])
    got = sorted(tuple(r) for r in io.read_csv(spark, [path], ["title", "source"], same_header=True).collect())
    assert got == [("t", "007"), ("u", "")]
