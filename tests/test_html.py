"""HTML extraction on small invented pages (tag soup, selector fallback, links,
detail-page thresholds, footer dates, text nodes)."""

import pytest
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.operators import html as H
from jobsmith.operators.quality import page_prefix

INDEED = fixed.SOURCES["indeed"]
IRISH = fixed.SOURCES["irishjobs"]
LINKEDIN = fixed.SOURCES["linkedin"]

LISTING_1 = """<html><head><script>var x = "</p><div class='job_seen_beacon'>";</script></head><body>
<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/rc/clk?jk=abc1&amp;from=x">  Data
 Engineer </a></h2><span class="companyName">Acme &amp; Co</span>
<div class="companyLocation">Dublin</div><div class="salary-snippet">€50,000 - €70,000</div>
<div class="job-snippet"><ul><li>Build <b>pipelines</li></ul></div></div>
<div class="job_seen_beacon"><h2 class="jobTitle">No link here</h2><a class="jcs-JobTitle" href="https://x.example/job/2">Other</a>
<span class="companyName"></span><span data-testid="company-name">Fallback Co</span></div>
<div class="job_seen_beacon"><h2 class="jobTitle">   </h2><span class="companyName">Empty title</span></div>
<div class="job_seen_beacon"><a class="jcs-JobTitle">Anchor title, no href</a></div>
</body></html>"""

LISTING_2 = """<html><body><td class="resultContent"><h2 class="jobTitle"><a href="relative/path">Second selector</a></h2></td>
<div class="cardOutline"><h2 class="jobTitle">third</h2></div></body></html>"""

LISTING_NONE = "<html><body><p>No jobs today</p></body></html>"

DETAILS = {
    1: '<div id="jobDescriptionText">' + "d" * 50 + '</div><div class="job-description">' + "e" * 51 + "</div>",
    2: '<div id="jobDescriptionText">' + "d" * 51 + "</div>",
    3: '<div id="jobDescriptionText"></div>',
    4: "<div>nothing</div>",
    5: '<div id="jobDescriptionText">short</div>',
    6: '<div class="jobsearch-JobMetadataFooter">Reference 123</div><span class="date">Posted 2 days ago</span>',
    7: '<div class="x jobsearch-footer">Job · Active Today · apply</div>',
    8: '<div class="Footer-area">2 weeks ago and more</div>',
}


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_cards_fallback_and_postings(spark):
    pages = pages_df(spark, [(1, "https://ie.indeed.com/jobs?q=a", LISTING_1),
                             (2, "https://ie.indeed.com/jobs?q=b", LISTING_2),
                             (3, "https://ie.indeed.com/jobs?q=c", LISTING_NONE)])
    cards = H.extract_cards(pages, INDEED["selectors"]["job_card"]).collect()
    by_page = {}
    for r in cards:
        by_page.setdefault(r["page_id"], []).append(r["card_rank"])
    assert by_page[1] == [0, 0, 0, 0]          # first selector has hits; script body is not markup
    assert set(by_page[2]) == {1}              # falls back to the 2nd selector only
    assert 3 not in by_page                    # no card selector hits
    posts = {(r["page_id"], r["card_no"]): r for r in H.extract_postings(pages, INDEED, source_name="indeed").collect()}
    p = posts[(1, 0)]
    assert p["title"] == "Data Engineer"
    assert p["url"] == "https://ie.indeed.com/rc/clk?jk=abc1&from=x"  # entity decoded, '/' joined to base
    assert p["company"] == "Acme & Co" and p["salary"] == "€50,000 - €70,000"
    assert p["description"] == "Build pipelines"  # unclosed <b> closed by </li>
    q = posts[(1, 1)]
    assert q["title"] == "No link here"                  # first title selector present wins
    assert q["url"] == "https://x.example/job/2"         # no href in h2 -> next title selector's <a>
    assert q["company"] == ""                            # present-but-empty element wins over fallback
    assert (1, 2) not in posts                           # whitespace-only title dropped
    assert posts[(1, 3)]["url"] == "" and posts[(1, 3)]["title"] == "Anchor title, no href"
    assert posts[(2, 0)]["url"] == "relative/path"       # other relative forms kept as is
    assert all(r["source"] == "indeed" for r in posts.values())


def test_link_mode_third_source(spark):
    html = ('<ul><li class="jobs-search-results__list-item"><h3 class="base-search-card__title">T1</h3>'
            '<a class="base-card__full-link">no href</a><a class="base-card__full-link" href="/x">x</a></li>'
            '<li class="jobs-search-results__list-item"><h3 class="base-search-card__title">T2</h3>'
            '<a class="base-card__full-link" href="/jobs/2">y</a></li></ul>')
    pages = pages_df(spark, [(1, "https://www.linkedin.com/jobs", html)])
    rows = sorted(H.extract_postings(pages, LINKEDIN, link_mode="link").collect(), key=lambda r: r["card_no"])
    assert [r["url"] for r in rows] == ["", "/jobs/2"]  # first link element, no base join


def test_description_pick_thresholds(spark):
    pages = pages_df(spark, [(k, f"u{k}", v) for k, v in DETAILS.items()])
    out = {r["page_id"]: r for r in H.description_pick(pages, fixed.DESCRIPTION_SELECTORS["fetch"]).collect()}
    assert out[1]["description"] == "e" * 51 and out[1]["status"] == "success"  # 50 rejected, 51 accepted
    assert out[2]["description"] == "d" * 51
    assert out[3]["status"] == "failed" and out[3]["error"] == fixed.DESCRIPTION_ERROR
    assert out[4]["status"] == "failed" and out[4]["error"] == fixed.DESCRIPTION_ERROR
    assert out[5]["status"] == "failed" and out[5]["error"] is None  # short text: failed, no error


def test_description_pick_examines_the_article(spark):
    """F1 of the third round: the query's list holds the article again, between the ad and the footer."""
    from jobsmith.plans import standins as S
    ad, art, foot = '<div class="ad">%s</div>', "<article><h1>t</h1><p>%s</p></article>", "<footer>%s</footer>"
    long, short = "x" * 60, "y"
    rows = [(1, ad % long + art % long + foot % long), (2, ad % short + art % long + foot % long), (3, ad % short + art % short + foot % long),
            (4, ad % short + art % short + foot % short), (5, ad % short + art % short + foot % ""), (6, ad % short + art % long)]
    out = {r["page_id"]: r for r in H.description_pick(pages_df(spark, [(k, "u", v) for k, v in rows]), S.DESCRIPTION_SELECTORS).collect()}
    assert [(out[k]["rank"], out[k]["status"], out[k]["error"] is None) for k in range(1, 7)] == [
        (1, "success", True), (2, "success", True), (3, "success", True), (None, "failed", True), (None, "failed", False), (2, "success", True)]
    assert out[2]["description"] == out[6]["description"] == "t" + long


def test_date_pick_and_footer(spark):
    pages = pages_df(spark, [(k, f"u{k}", v) for k, v in DETAILS.items()])
    d = {r["page_id"]: r["posted_date"] for r in
         H.date_text_pick(pages, fixed.DATE_SELECTORS["card_detail"], fixed.DATE_WORDS["card_detail"]).collect()}
    assert d[6] == "Posted 2 days ago"  # 1st selector fails the word test, 2nd passes
    f = {r["page_id"]: r["posted_date"] for r in H.footer_date(pages).collect()}
    assert f[7] == "Active Today"
    assert f[8] == "2 weeks ago"  # class test is case-insensitive
    assert f[6] == ""


def test_text_nodes_and_selector_hits(spark):
    html = ('<!DOCTYPE html><html><head><script>var s="Posted";</script></head><body>'
            '<div class="meta">Posted 3 days ago</div><p>x<!-- Posted comment --></p><span>3 days ago</span></body></html>')
    pages = pages_df(spark, [(1, "u", html)])
    nodes = H.text_node_grep(pages).collect()
    assert [(r["parent_tag"], r["kind"]) for r in nodes] == [("script", "raw"), ("div", "text"), ("p", "comment"),
                                                             ("span", "text")]
    assert nodes[1]["parent_cls"] == "meta" and nodes[1]["text"] == "Posted 3 days ago"
    hits = {r["selector"]: r for r in H.selector_hits(pages, ["div.meta", "span", "p", "h1"]).collect()}
    assert hits["div.meta"]["elements"] == 1 and hits["h1"]["pages_hit"] == 0


def test_page_prefix_stops_at_first_empty(spark):
    rows = [("a", 1, 3), ("a", 2, 0), ("a", 3, 5), ("b", 1, 1), ("b", 2, 2)]
    df = spark.createDataFrame(rows, "host string, page_no int, n int")
    kept = sorted((r["host"], r["page_no"]) for r in page_prefix(df, ["host"], "page_no", F.col("n") == 0).collect())
    assert kept == [("a", 1), ("b", 1), ("b", 2)]


def test_parse_error_is_reported_not_fatal(spark):
    pages = pages_df(spark, [(1, "u", None), (2, "u", "<p>ok</p>")])
    out = H.extract_html(pages, ["page_id"], fields={"p": ["p"]}).orderBy("page_id").collect()
    assert out[0]["fields"] == [] and out[1]["fields"][0]["n"] == 1


def test_selector_samples_first_k(spark):
    html = "<ul>" + "".join(f"<li> item {i} </li>" for i in range(5)) + "</ul><p>x</p>"
    pages = pages_df(spark, [(1, "u", html)])
    rows = {r["selector"]: r for r in H.selector_samples(pages, ["li", "p", "h1"], k=3).collect()}
    assert rows["li"]["n"] == 5 and rows["li"]["samples"] == ["item 0", "item 1", "item 2"]
    assert rows["p"]["samples"] == ["x"] and "h1" not in rows


def test_config_tables(spark):
    from jobsmith.sources import config as cfg
    src = {r["source"]: r for r in cfg.sources_df(spark).collect()}
    assert src["indeed"]["page_size"] == 10 and src["irishjobs"]["page_mode"] == "number"
    sels = cfg.selectors_df(spark).filter("source = 'linkedin' AND field = 'job_card'").collect()
    assert [(r["rank"], r["selector"]) for r in sels] == [(0, "li.jobs-search-results__list-item")]
    assert cfg.source_config("unknown")["selectors"] == {}


def test_report_title_terms(spark):
    from jobsmith.operators.report import report_title_terms
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["x"],)], "t array<string>")
    assert [r[0] for r in df.select(report_title_terms(F.col("t"))).collect()] == ["a, b, c", "x"]


def test_rejected_page_is_reported(spark):
    pages = spark.createDataFrame([(1, "<h1>ok</h1>"), (2, "<![foo bar]>"), (3, None)], "page_id long, html string")
    got = [(r["page_id"], bool(r["error"])) for r in H.page_rejects(pages).collect()]
    assert got == [(2, True)]


def test_detail_extract_branches(spark):
    body = "d" * 60
    pages = spark.createDataFrame([
        (1, f'<div id="x">short</div><div id="y">{body}</div><span class="date">Posted 2 days ago</span>'),
        (2, '<div id="x">short</div><div class="page-Footer">Posted 3 days ago</div>'),
        (3, "<p>nothing</p>"), (4, "<![foo bar]>"), (5, '<div id="x"></div><span class="date">no word</span>')], "page_id long, html string")
    got = {r["page_id"]: r for r in H.detail_extract(pages, ["div#x", "div#y"], ["span.date"], ["ago", "posted"],
                                                     footer_token="footer").collect()}
    assert (got[1]["description"], got[1]["status"], got[1]["error"], got[1]["posted_date"]) == (body, "success", None, "Posted 2 days ago")
    assert (got[2]["status"], got[2]["error"]) == ("failed", None) and got[2]["posted_date"].endswith("3 days ago")
    assert got[3]["status"] == "failed" and got[3]["error"] and got[3]["posted_date"] == ""
    assert got[4]["status"] == "failed" and got[4]["error"] != got[3]["error"]
    assert got[5]["description"] == "" and got[5]["posted_date"] == ""


def test_probe_looks_at_the_first_divs_only(spark):
    divs = "".join(f'<div class="s{i}">tiny</div>' for i in range(6)) + '<div class="long">' + "x" * 40 + "</div>"
    pages = spark.createDataFrame([(1, f'<article class="job">{divs}</article>'), (2, "<p>no card</p>")], "page_id long, html string")
    got = {r["page_id"]: r for r in H.description_probe(pages, ["article.job"], probes=["p.none"]).collect()}
    assert got[1]["probe_rank"] is None and list(got[1]["divs"]) == [] and list(got[2]["divs"] or []) == []


class _Frame:
    """Stands in for a frame: hands back the function that the executors would run."""

    def join(self, *_):
        return self

    def select(self, *_):
        return self

    columns = ["source", "selectors"]

    def mapInArrow(self, fn, schema):  # noqa: N802 - Spark's name
        self.run = fn
        return self


def _runs_in_slices(monkeypatch, asked, **more):
    """A batch of 3,000 small pages: no more than a slice of it is worked on before its rows are handed on, and none is lost."""
    import pyarrow as pa
    monkeypatch.setattr(H, "_page_schema", lambda df, keep: "")
    monkeypatch.setattr(H.F, "broadcast", lambda df: df)
    monkeypatch.setattr(H.F, "size", lambda c: H.F.lit(0))
    parsed = []
    monkeypatch.setattr(H, "parse_html", lambda html, parse=H.parse_html: parsed.append(html) or parse(html))
    frame = _Frame()
    asked(frame)
    html = [None if i % 7 == 0 else f'<div class="c"><h2>t{i}</h2><p>x</p></div>' for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(3000)), **{k: [v] * 3000 for k, v in more.items()}, "html": html})
    got, most = [], H.SLICE_BYTES // H.PAGE_BYTES
    for out in frame.run(iter([batch])):
        assert 0 < out.num_rows <= most and len(parsed) == len(got) + out.num_rows
        got += out.to_pylist()
    assert [r["page_id"] for r in got] == list(range(3000))
    return got


def test_f2_card_matches_are_made_slice_by_slice(spark, monkeypatch):
    got = _runs_in_slices(monkeypatch, lambda f: H.extract_html(f, ["page_id"], cards=["div.c"], card_fields={"probe": ["p"]}, card_all={"div": ["h2"]}))
    assert [(len(r["cards"]), [x["parts"] for c in r["cards"] for x in c["found"]]) for r in got] == [
        (0, []) if i % 7 == 0 else (1, [["x"], [f"t{i}"]]) for i in range(3000)]


def test_f2_large_pages_and_empty_batches(spark):
    import pyarrow as pa
    big = "x" * (H.SLICE_BYTES + 1)
    batch = pa.RecordBatch.from_pydict({"html": [big, "a", None, big, "b"]})
    assert [b.num_rows for b in H._page_slices(batch, "html")] == [1, 2, 1, 1]
    assert list(H._page_slices(batch.slice(0, 0), "html")) == []
    plan = H.extract_html(pages_df(spark, [(1, "u", "<p>a</p>")]), ["page_id"], fields={"p": ["p"]})._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # one hop


def test_f6_matches_by_source_are_made_slice_by_slice(spark, monkeypatch):
    got = _runs_in_slices(monkeypatch, lambda f: H.extract_cards_by_source(f, f, ["page_id"]), selectors='{"job_card": ["div.c"], "title": ["h2"]}', source="s")
    assert [[x["parts"] for c in r["cards"] for x in c["found"]] for r in got] == [[] if i % 7 == 0 else [[f"t{i}"]] for i in range(3000)]


def _listed(spark, folder):
    """60 parts and 3 stored pages, as the tables of a folder."""
    spark.createDataFrame([(i, f"part {i}", "Brand#1", "TIN", i % 5) for i in range(60)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    html = "<ul><li><h2><a href='/j'>a job</a></h2></li><li><a href='/k'>b</a></li></ul>"
    spark.createDataFrame([(i, f"https://h{i}.example/p", html) for i in range(3)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("query", ["card_fields", "config_postings", "automated_run"])
def test_f5_f6_f7_a_query_works_on_a_slice_of_a_batch(spark, tmp_path, monkeypatch, query):
    """The function that the registered query hands to the executors, on a batch of 1,200 of the query's own pages."""
    import pyarrow as pa
    from jobsmith.plans import catalog
    frame, asked = type(spark.range(0)), []
    monkeypatch.setattr(frame, "mapInArrow", lambda df, fn, schema, f=frame.mapInArrow: asked.append((df, fn)) or f(df, fn, schema))
    found = catalog.QUERIES[query](spark, _listed(spark, tmp_path))
    (df, fn), = asked
    parsed = []
    monkeypatch.setattr(H, "parse_html", lambda html, parse=H.parse_html: parsed.append(html) or parse(html))
    page = df.limit(1).toArrow()
    batch, = pa.concat_tables([page] * 1200).combine_chunks().to_batches()
    done = cards = 0
    for out in fn(iter([batch])):
        done, cards = done + out.num_rows, cards + sum(map(len, out.column("cards").to_pylist()))
        assert len(parsed) == done and sum(max(len(h), H.PAGE_BYTES) for h in parsed[-out.num_rows:]) <= H.SLICE_BYTES
    assert done == 1200 and cards == 1200 * len(next(fn(iter(page.to_batches()))).column("cards").to_pylist()[0]) > 0
    assert found.count() > 0
