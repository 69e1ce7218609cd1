"""The dump source (batch, stream, pushed filters), pages as a stream, the second enrichment mode, expiring dedup state."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from jobsmith.operators import enrich as en
from jobsmith.plans.run import automated_run
from jobsmith.session import work_path
from jobsmith.sources import config as cf
from jobsmith.sources import posting_dump as pd_
from jobsmith.streaming import history as hi
from jobsmith.streaming.pages import pages_batch, stream_pages


def dump(folder, name, *records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8")
    time.sleep(0.01)  # files differ in time


def test_dump_source_reads_and_filters(spark, tmp_path):
    dump(tmp_path, "a.json", {"url": "u1", "title": "é"}, {"url": "u2", "title": None, "extra": 1}, "no json", "[1]")
    dump(tmp_path, "sub/b.json", {"url": "u3", "title": "t", "source": "s"}, {"url": 5, "title": {"n": 1}})
    dump(tmp_path, "_hidden/c.json", {"url": "hidden"})
    dump(tmp_path, "_SUCCESS")
    rows = pd_.read_dump(spark, str(tmp_path), ("url", "title", "source"))
    assert sorted((r["url"], r["title"], r["source"]) for r in rows.collect()) == [
        ("5", '{"n": 1}', None), ("u1", "é", None), ("u2", None, None), ("u3", "t", "s")]
    for condition, want in (("url = 'u3'", ["u3"]), ("url IN ('u1', 'u3') AND url = 'u1'", ["u1"]), ("title IS NULL", ["u2"]), ("url > 'u1'", ["u2", "u3"]), ("url = 'none'", [])):
        assert sorted(r["url"] for r in rows.filter(condition).collect()) == want, condition
    plan = rows.filter("url = 'u3'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan posting_dump" in plan and "u3" not in plan  # the reader tests it, Spark need not
    assert pd_.read_dump(spark, f"file:{tmp_path}", ("url",)).count() == 4
    assert pd_.read_dump(spark, str(tmp_path / "nothing"), ("url",)).count() == 0
    with pytest.raises(Exception, match="mounted"):
        pd_.read_dump(spark, "hdfs://x/y").count()
    strict = spark.read.format("posting_dump").option("mode", "FAILFAST").load(str(tmp_path))
    with pytest.raises(Exception):
        strict.collect()


def test_pushed_filters_are_the_readers(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    schema = pd_.PostingDump({"columns": "url,title"}).schema()
    reader = pd_.DumpReader(schema, {"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("url",), "a"), In(("url",), ("a", "b")), GreaterThan(("title",), "x"), EqualTo(("title",), 1)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"] and reader.wanted == {"url": {"a"}}


def test_dump_source_as_a_stream(spark, tmp_path):
    sink, ckpt = work_path(spark, "dump-sink"), work_path(spark, "dump-ckpt")
    folder = tmp_path / "in"
    dump(folder, "b.json", {"url": "u1"}, {"url": "u2"})
    pd_.stream_dump(spark, str(folder), sink, ckpt, ("url",))
    dump(folder, "a.json", {"url": "u3"})  # a name that sorts before: times decide
    pd_.stream_dump(spark, str(folder), sink, ckpt, ("url",))
    pd_.stream_dump(spark, str(folder), sink, ckpt, ("url",))
    assert sorted(r["url"] for r in spark.read.parquet(sink).collect()) == ["u1", "u2", "u3"]


PAGES = "source string, query string, query_no int, page_num int, url string, html string"
CONFIG = {"s": {"base_url": "https://b", "page_size": 0, "page_mode": "offset", "search_url": "", "selectors": {"job_card": ["li"], "title": ["a"]}}}


def listing(*names):
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


def test_pages_stream_stops_like_the_batch(spark):
    """A page without cards ends its query in later batches too; a replayed batch changes nothing."""
    data = [("s", q, 0, n, "https://p/x", html) for q, pages in {
        "a": [listing("1", "2"), listing("2", "3"), "<p>nothing</p>", listing("4")], "b": [listing("5"), listing("1"), listing("6"), listing("7")]}.items()
        for n, html in enumerate(pages)]
    pages = spark.createDataFrame(data, PAGES)
    sources, selectors = cf.sources_df(spark, CONFIG), cf.selectors_df(spark, CONFIG)
    hist, stops, ckpt, src = (work_path(spark, n) for n in ("p-hist", "p-stops", "p-ckpt", "p-src"))
    for step in range(4):
        pages.filter(F.col("page_num") == step).write.json(f"{src}/in/step{step}")
        stream_pages(spark, f"{src}/in/*", pages.schema, sources, selectors, hist, stops, ckpt, archive=f"{src}/done", first_seen="t").awaitTermination()
    got = sorted(r["url"] for r in hi.read_history(spark, hist, None).collect())
    empty = spark.createDataFrame([], "url string")
    want = automated_run(pages, empty, "t", ["s"], CONFIG)["history_rows"]
    assert got == sorted(r["url"] for r in want.collect()) == [f"https://b/{n}" for n in (1, 2, 3, 5, 6, 7)]
    for step in (1, 3):
        pages_batch(pages.filter(F.col("page_num") == step), step, sources, selectors, hist, stops, first_seen="t")
    assert sorted(r["url"] for r in hi.read_history(spark, hist, None).collect()) == got
    done = src.replace("file:", "") + "/done"
    assert sum(f.endswith(".json") for _, _, files in os.walk(done) for f in files) >= 1  # finished files are archived


def test_second_enrichment_mode(spark):
    posts = spark.createDataFrame([(1, "https://x/?jk=ab1", "old", "d"), (2, "", "old", ""), (3, None, "old", ""), (4, "https://y", "long " * 60, ""), (5, "https://z", "o", "")],
                                  "ordinal long, url string, description string, posted_date string")
    first = en.with_canonical_url(posts.limit(1)).first()["canonical_url"]
    details = spark.createDataFrame([(first, "new", "today", "success"), ("https://y", "n2", "", "success"), ("https://z", "n3", "", "failed"), ("", "never", "", "success")],
                                    "canonical_url string, description string, posted_date string, status string")
    out = en.enrich_all(posts, details)
    got = {r["ordinal"]: (r["description"], r["posted_date"], r["outcome"]) for r in out.collect()}
    # nothing is skipped for what it holds already
    assert got == {1: ("new", "today", "success"), 2: ("old", "", "no url"), 3: ("old", "", "no url"), 4: ("n2", "", "success"), 5: ("o", "", "failed")}
    assert tuple(en.enrich_all_stats(out).first()) == (2, 1)
    assert tuple(en.enrich_all_stats(out.limit(0)).first()) == (0, 0)


def test_dedup_state_expires(spark):
    def at(day):
        return spark.createDataFrame([(day, "k")], "day int, key string").select(F.timestamp_add("DAY", "day", F.lit("2024-01-01").cast("timestamp")).alias("ts"), "key", "day")

    src, sink, ckpt = (work_path(spark, n) for n in ("x-src", "x-sink", "x-ckpt"))
    for i, day in enumerate([0, 2, 8, 16, 24]):
        at(day).write.parquet(f"{src}/s{i}")
        hi.stream_dedup_state(spark, f"{src}/*", at(0).schema, "key", sink, ckpt, watermark=("ts", "3 days")).awaitTermination()
    # day 2 is a repeat; day 8 finds the state of day 0 still there, day 16 does not
    assert sorted(r["day"] for r in spark.read.parquet(sink).collect()) == [0, 16]
