"""Records without fixed columns, rejects, table functions, configured sources, first hits."""

import os

import pytest
from pyspark.sql import functions as F

from jobsmith.functions import fixed, udtf
from jobsmith.operators import html as H
from jobsmith.operators import identity as idn
from jobsmith.plans.run import collect_from_tables, collect_postings
from jobsmith.session import work_path
from jobsmith.sources import config as cf
from jobsmith.sources import files as io
from jobsmith.sources import variant as va

MAPS = "k string, ordinal long, fields map<string,string>"


def test_upsert_map_by_hand(spark):
    state = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}), ("a", 2, {"x": "second"}), ("b", 3, {}), (None, 4, {"x": "n"}), ("", 5, {})], MAPS)
    updates = spark.createDataFrame([("a", 1, {"x": "2", "new key": "v"}), ("a", 2, {"x": None}), ("c", 3, {"z": "1"}), ("c", 4, {"z": "2", "w": ""}),
                                     ("d", 5, {}), ("", 6, {"q": "1"}), (None, 7, {}), ("b", 8, None)], MAPS)
    got = {(r["k"], r["origin"], r["ordinal"]): (r["fields"], r["was_updated"]) for r in idn.upsert_map(state, updates, "k").collect()}
    assert got == {
        ("a", 0, 1): ({"x": None, "y": "1", "new key": "v"}, True),  # a null that is there overwrites
        ("a", 0, 2): ({"x": "second"}, False),  # only the first row of a key
        ("b", 0, 3): ({}, True), (None, 0, 4): ({"x": "n"}, False), ("", 0, 5): ({}, False),
        ("c", 1, 3): ({"z": "2", "w": ""}, False), ("d", 1, 5): ({}, False),
        ("", 1, 6): ({"q": "1"}, False), (None, 1, 7): ({}, False)}
    assert idn.upsert_map(state.limit(0), updates.limit(0), "k").count() == 0


def test_variant_keeps_absent_null_and_empty_apart(spark):
    path = work_path(spark, "va")
    lines = ['{"a": 1}', '{"a": null, "b c": "x"}', '{"a": ""}', "{}", '{"a": {"n": 1}}', "no json", None, '[1]', '{"a": "é\\n"}']
    va.land_json(spark.createDataFrame(list(enumerate(lines)), "no long, value string"), path)
    records = va.read_records(spark, path)
    got = {r["no"]: (r["is"], r["a"], r["bad"]) for r in records.select("no", va.presence(F.col("record"), "a").alias("is"), va.field(F.col("record"), "a").alias("a"), "bad").collect()}
    assert [got[i][0] for i in range(9)] == ["value", "null", "empty", "absent", "value", "absent", "absent", "absent", "value"]
    assert got[0][1] == "1" and got[8][1] == "é\n" and got[5][2] == "no json" and got[6][2] is None
    assert {r["b c"] for r in va.project(records, ["b c"]).collect()} == {"x", ""}
    assert "b c" in va.merged_schema(records.filter("no < 4"))


def test_rejects_stand_beside_the_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,url\nT1,u1\nonly one\n"multi\nline",u2\na,b,c\nT3,"open\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("url,title\nu9,T9\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    rows, rejects = io.read_csv_rejects(spark, [str(tmp_path), str(tmp_path / "no")], ["title", "url"])
    assert {("T1", "u1"), ("multi\nline", "u2"), ("T9", "u9")} <= {tuple(r) for r in rows.collect()}
    bad = [(os.path.basename(r["path"]), r["record"], r["reason"]) for r in rejects.collect()]
    assert ("c.csv", None, "empty") in bad and ("no", None, "missing") in bad
    assert {r for f, r, why in bad if why == "malformed record" and f == "a.csv"} >= {"only one", "a,b,c"}


def test_headers_start_no_job(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f{i}.csv").write_text(f"title,url\nT{i},u{i}\n" if i % 2 else f"url,title\nu{i},T{i}\n", encoding="utf-8")
    import gzip
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(("x" * 100_000 + ',"title, quoted"\n1,2\n').encode()))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("heads", "heads")
    try:
        names = io.headers(spark, io._files(spark, [str(tmp_path)]))
        assert len(tracker.getJobIdsForGroup("heads")) == 0
        got = io.read_csv(spark, [str(tmp_path)], ["title", "url"])
        assert got.filter("title LIKE 'T%' AND url = concat('u', substring(title, 2))").count() == 200
        assert len(tracker.getJobIdsForGroup("heads")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    wide = next(v for k, v in names.items() if k.endswith("z.csv.gz"))
    assert wide == ["x" * 100_000, "title, quoted"]


def test_writer_that_crashes_keeps_one_of_both(spark, monkeypatch):
    """K9: the old folder is moved aside before the new one takes its place; a failed move brings it back."""
    from jobsmith.sources import folders

    one = spark.createDataFrame([("t", "u")], "title string, url string")
    path = work_path(spark, "swap")
    io.write_csv(one, path, columns=["title", "url"])
    with pytest.raises(OSError):
        folders.swap(spark, path + "-not-there", path)
    assert io.read_csv(spark, [path], ["title", "url"]).count() == 1
    io.write_csv(one.union(one), path, columns=["title", "url"])
    assert io.read_csv(spark, [path], ["title", "url"]).count() == 2
    assert not [n for n in folders.list_names(spark, os.path.dirname(path)) if n.startswith(os.path.basename(path) + ".")]


PAGES = "source string, query string, query_no int, page_num int, url string, html string"


def test_sources_are_rows_of_the_tables(spark):
    card = '<div class="c{k}"><b class="t{k}"><a href="/{n}">{n}</a></b><i>{n}!</i></div>'
    html = "".join(card.format(k=k, n=f"s{k}n{n}") for k in range(40) for n in range(2))
    config = {f"s{k}": {"base_url": f"https://{k}.example", "page_size": 0, "page_mode": "offset", "search_url": "",
                        "selectors": {"job_card": ["div.none", f"div.c{k}"], "title": f"b.t{k}", "company": ["u", "i"]}} for k in range(40)}
    pages = spark.createDataFrame([(f"s{k}", "q", 0, 0, "https://x/y", html) for k in range(40)] + [("unknown", "q", 0, 0, "u", html)], PAGES)
    got = collect_from_tables(pages, cf.sources_df(spark, config), cf.selectors_df(spark, config)).collect()
    assert sorted((r["source"], r["title"], r["company"], r["url"]) for r in got) == sorted(
        (f"s{k}", f"s{k}n{n}", f"s{k}n{n}!", f"https://{k}.example/s{k}n{n}") for k in range(40) for n in range(2))
    plan = collect_from_tables(pages, cf.sources_df(spark, config), cf.selectors_df(spark, config))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan  # pages are parsed once, before
    few = collect_postings(pages, ["s3", "s1"], config).collect()
    assert {(r["source"], r["ordinal"]["source_no"]) for r in few} == {("s3", 0), ("s1", 1)}
    with pytest.raises(ValueError):
        big = spark.range(cf.MAX_SELECTORS + 5).selectExpr("'s1' AS source", "'title' AS field", "CAST(id AS INT) AS rank", "'b' AS selector")
        cf.source_plans(cf.sources_df(spark, config), big)


def test_table_function_in_sql(spark):
    udtf.register(spark, "cards_of")
    html = '<div class="k"><h2><a href="/1">A  b</a></h2><p>x</p></div><div class="k"><h2></h2></div><div class="k"><a class="t" href="z">C</a></div>'
    spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("udtf_pages")
    got = spark.sql("""SELECT id, c.* FROM udtf_pages, LATERAL cards_of(html, '{"job_card": [".k"], "title": ["h2", "a.t"], "company": "p"}') c""").collect()
    assert [(r["id"], r["card_no"], r["title"], r["company"], r["href"]) for r in got] == [(1, 0, "A b", "x", "/1"), (1, 2, "C", "", "z")]


def test_first_hits_are_cut_before_the_shuffle(spark):
    pages = spark.createDataFrame([(i, f"<p>{i}a</p><p> {i}b</p>" + ("<i>x</i>" if i == 5 else "")) for i in range(9, 0, -1)], "page_id long, html string").repartition(4)
    out = H.selector_first_hits(pages, ["p", "i", "b"], 3)
    got = sorted(tuple(r) for r in out.select("selector", "place", "page_id", "el_no", "sample").collect())
    assert got == [("i", 1, 5, 0, "x"), ("p", 1, 1, 0, "1a"), ("p", 2, 1, 1, "1b"), ("p", 3, 2, 0, "2a")]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 1
    assert "Partial" in out._jdf.queryExecution().executedPlan().toString()


def test_source_rows_of_the_fixed_config(spark):
    plans = {r["source"]: r for r in cf.source_plans(cf.sources_df(spark), cf.selectors_df(spark)).collect()}
    assert set(plans) == set(fixed.SOURCES) and plans["linkedin"]["link_mode"] == "link" and plans["indeed"]["link_mode"] == "title"
