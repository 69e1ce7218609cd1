"""End-to-end flows on small invented pages, and the reference's own test scenario
(mock sources -> per-source CSV -> merge; history new/add/not-new; report contents)."""

import os

from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.operators import identity as idn
from jobsmith.operators import report as rp
from jobsmith.plans.run import automated_run, collect_postings, manual_run
from jobsmith.session import work_path
from jobsmith.sources import files as io

PAGE_SCHEMA = "source string, query string, query_no int, page_num int, url string, html string"


def card(title, href, company="Co"):
    return (f'<div class="job_seen_beacon"><h2 class="jobTitle"><a href="{href}">{title}</a></h2>'
            f'<span class="companyName">{company}</span></div>')


def irish(title, href):
    return f'<article class="job"><h2 class="job-title"><a href="{href}">{title}</a></h2><span class="company">IJ</span></article>'


def pages(spark):
    rows = [
        ("indeed", "Data Engineer", 1, 0, "p1", card("DE 1", "/a") + card("DE 2", "/b")),
        ("indeed", "Data Engineer", 1, 1, "p2", "<div>no cards</div>"),          # stops the prefix
        ("indeed", "Data Engineer", 1, 2, "p3", card("DE late", "/late")),       # dropped
        ("irishjobs", "Data Engineer", 1, 1, "p4", irish("IJ 1", "/j/1")),
        ("indeed", "Cloud Engineer", 2, 0, "p5", card("CE 1", "/b") + card("CE 2", "/c")),  # /b repeats
        ("irishjobs", "Cloud Engineer", 2, 1, "p6", irish("IJ 2", "https://other/x")),
    ]
    return spark.createDataFrame(rows, PAGE_SCHEMA)


def test_collect_postings_prefix_and_tags(spark):
    got = collect_postings(pages(spark), ["indeed", "irishjobs"]).collect()
    titles = sorted(r["title"] for r in got)
    assert titles == ["CE 1", "CE 2", "DE 1", "DE 2", "IJ 1", "IJ 2"]  # "DE late" after the empty page
    by = {r["title"]: r for r in got}
    assert by["DE 1"]["url"] == "https://ie.indeed.com/a" and by["IJ 1"]["url"] == "https://www.irishjobs.ie/j/1"
    assert by["CE 2"]["search_query"] == "Cloud Engineer" and by["IJ 2"]["source"] == "irishjobs"


def test_automated_run(spark):
    hist = spark.createDataFrame([("https://ie.indeed.com/c", "old", "", "", "indeed", "t0")],
                                 "url string, title string, company string, location string, source string, first_seen string")
    out = automated_run(pages(spark), hist, "2024-01-02T00:00:00", ["indeed", "irishjobs"])
    cons = {r["url"]: r for r in out["consolidated"].collect()}
    # /b first seen under the first query (DE 2) - keep-first across queries; /c was seen before
    assert cons["https://ie.indeed.com/b"]["title"] == "DE 2"
    assert cons["https://ie.indeed.com/b"]["search_query"] == "Data Engineer"
    assert "https://ie.indeed.com/c" not in cons and len(cons) == 4
    assert list(out["consolidated"].columns) == fixed.POSTING_9
    stats = {(r["source"], r["search_query"]): (r["found"], r["new"], r["dup"]) for r in out["stats"].collect()}
    assert stats[("indeed", "Cloud Engineer")] == (2, 0, 2)
    totals = [(r["query"], r["n_new"], r["so_far"]) for r in out["totals"].orderBy("query_no").collect()]
    assert totals == [("Data Engineer", 3, 3), ("Cloud Engineer", 1, 4)]
    assert sorted(r["url"] for r in out["history_rows"].collect()) == sorted(cons)


def test_manual_run_merges_without_dedup(spark):
    hist = spark.createDataFrame([], "url string")
    out_dir = work_path(spark, "manual")
    out = manual_run(pages(spark), hist, out_dir, "2024-01-02", "Data Engineer", "Dublin", ignore_history=True,
                     sources=["indeed", "irishjobs"])
    assert out["merged"].count() == 6  # no dedup in the merge (the repeated url stays)
    assert out["summary"].first()["total_jobs"] == 6
    assert any("source_part=indeed" in p for p in os.listdir(out_dir.replace("file:", "")))


def test_reference_scenario(spark):
    """Three mock sources x five rows; per-source CSVs; merged 15; history; report contents."""
    frames = [io.mock_postings(spark, s, "Dublin").drop("ordinal") for s in fixed.MOCK_SOURCES]
    base = work_path(spark, "mock")
    for s, f in zip(fixed.MOCK_SOURCES, frames):
        io.write_csv(f, f"{base}/{s}")
    per = [io.read_csv(spark, [f"{base}/{s}"]) for s in fixed.MOCK_SOURCES]
    assert [p.count() for p in per] == [5, 5, 5]
    merged = idn.union_sources(per)
    assert merged.count() == 15 and merged.select("url").distinct().count() == 15
    # history: new -> add -> not new
    job = spark.createDataFrame([("https://example.com/job1", "Test Job", "Test Co", "Dublin", "test", 1)],
                                "url string, title string, company string, location string, source string, ordinal long")
    empty = spark.createDataFrame([], "url string")
    assert idn.new_vs_history(job, empty, "url", "ordinal").count() == 1
    added = idn.history_append(empty.select("url"), job, "2024-01-01T00:00:00")
    assert idn.new_vs_history(job, added, "url", "ordinal").count() == 0
    # report rows contain the posted values
    jobs = spark.createDataFrame([("Test Job 1", "Company A", "Dublin", "50k", "Desc 1", "http://example.com/1", "indeed"),
                                  ("Test Job 2", "Company B", "Cork", "60k", "Desc 2", "http://example.com/2", "linkedin")],
                                 ", ".join(f"{c} string" for c in fixed.POSTING_7))
    rows = rp.report_rows(jobs).collect()
    assert {"Test Job 1", "Test Job 2"} == {r["title"] for r in rows} and any(r["company"] == "Company B" for r in rows)
    assert rp.report_summary(jobs, "test query", "test location", "2024-01-01").first()["total_jobs"] == 2


def test_read_pages_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><h1>A</h1>\n<p>x</p></html>", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h1>B</h1>", encoding="utf-8")
    got = io.read_pages(spark, str(tmp_path)).orderBy("url").collect()
    assert [r["html"] for r in got] == ["<html><h1>A</h1>\n<p>x</p></html>", "<h1>B</h1>"]
    assert got[0]["url"].endswith("a.html") and F is not None


def li(title, href):
    return (f'<li class="jobs-search-results__list-item"><h3 class="base-search-card__title">{title}</h3>'
            f'<a class="base-card__full-link" href="{href}">x</a></li>')


def test_per_source_stop_rules(spark):
    rows = [
        ("indeed", "q", 1, 0, "i0", None),                                   # unreadable: skipped, no stop
        ("indeed", "q", 1, 1, "i1", card("I1", "/i1")),
        ("irishjobs", "q", 1, 1, "r1", irish("R1", "/r1")),
        ("irishjobs", "q", 1, 2, "r2", "<p>Please wait while we check your browser</p>" + irish("R2", "/r2")),
        ("irishjobs", "q", 1, 3, "r3", irish("R3", "/r3")),                 # after the bot page: dropped
        ("linkedin", "q", 1, 0, "https://www.linkedin.com/jobs/a", "<ul></ul>"),  # empty: skipped only
        ("linkedin", "q", 1, 1, "https://www.linkedin.com/jobs/b", "<ul>" + li("L1", "/l1") + "</ul>"),
        ("linkedin", "q", 1, 2, "https://www.linkedin.com/authwall?x", "<ul>" + li("L2", "/l2") + "</ul>"),
        ("linkedin", "q", 1, 3, "https://www.linkedin.com/jobs/d", "<ul>" + li("L3", "/l3") + "</ul>"),
    ]
    got = sorted(r["title"] for r in collect_postings(spark.createDataFrame(rows, PAGE_SCHEMA)).collect())
    assert got == ["I1", "L1", "R1"]


def test_empty_writes_nothing_and_latest_version(spark):
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in fixed.POSTING_7))
    path = work_path(spark, "empty")
    assert io.write_csv(empty, path) is False and not os.path.exists(path.replace("file:", ""))
    base = work_path(spark, "versions")
    one = spark.createDataFrame([(1,)], "x int")
    io.write_versioned(one, base, 1)
    io.write_versioned(one.union(one), base, 2)
    os.makedirs(base.replace("file:", "") + "/v=3")  # an unfinished version (no _SUCCESS)
    latest = io.latest_version(spark, base)
    assert latest.endswith("v=2") and spark.read.parquet(latest).count() == 2


def test_composite_key_and_probe(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", "b", None), ("a\x1fb", "", "c")], "t string, co string, l string")
    keys = [r["k"] for r in df.select(idn.composite_key("t", "co", "l", hashed=False).alias("k")).collect()]
    assert keys[0] == "a\x1fb\x1fc" and keys[1] is None and keys[2] != keys[0]
    from jobsmith.operators import html as H
    html = ('<div class="job_seen_beacon"><div class="job-snippet">short</div><ul><li>' + "u" * 25 + "</li></ul>"
            '<div class="x">' + "d" * 30 + "</div></div>"
            '<div class="job_seen_beacon"><div class="y">tiny</div></div>')
    pages_ = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = H.description_probe(pages_, fixed.SOURCES["indeed"]["selectors"]["job_card"]).first()
    assert r["probe_rank"] == 4 and r["length"] == 25 and r["divs"] is None  # 'ul' is the 5th probe
    r2 = H.description_probe(pages_, fixed.SOURCES["indeed"]["selectors"]["job_card"],
                             probes=["div.job-snippet"]).first()
    assert r2["probe_rank"] is None and r2["divs"] == ["x:30"]


def test_empty_shuffled_input_writes_nothing(spark):
    empty = (spark.createDataFrame([], ", ".join(f"{c} string" for c in fixed.POSTING_7))
             .groupBy(*fixed.POSTING_7).count().drop("count"))  # a plan with a shuffle
    for writer, name in ((io.write_csv, "e-csv"), (io.write_json, "e-json")):
        path = work_path(spark, name)
        assert writer(empty, path) is False and not os.path.exists(path.replace("file:", ""))
    full = spark.createDataFrame([("t", "c", "l", "s", "d", "u", "src")], ", ".join(f"{c} string" for c in fixed.POSTING_7))
    path = work_path(spark, "ne-csv")
    assert io.write_csv(full.groupBy(*fixed.POSTING_7).count().drop("count"), path) is True
    assert io.read_csv(spark, [path]).count() == 1
