"""Registered queries: each SURVEY key bound to the driver tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame computed over the
whole tables (no id subsets or row caps; limits only where the limit is the
feature). Column names match the DuckDB oracle in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions import text as tx
from jobsmith.operators import enrich as en
from jobsmith.operators import html as H
from jobsmith.operators import identity as idn
from jobsmith.operators import profile as pf
from jobsmith.operators import quality as qa
from jobsmith.operators import report as rp
from jobsmith.plans import standins as S
from jobsmith.plans.search import search_plan
from jobsmith.session import cut_lineage, work_path
from jobsmith.sources import files as io


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.table(spark, d, name)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents")


# ----------------------------------------------------------- shared shapes

def doc_postings(docs: DataFrame) -> DataFrame:
    """Documents as postings: url from the text hash (repeats share a url), first line as title."""
    t = F.col("text")
    return docs.select(
        F.col("doc_id").alias("ordinal"),
        tx.first_line(t).alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("€"), F.col("n_chars").cast("string"))).otherwise(F.lit("")).alias("salary"),
        t.alias("description"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("day "), (F.col("n_chars") % 30).cast("string"))).otherwise(F.lit("")).alias("posted_date"),
        F.concat(F.lit(S.DOC_URL_PREFIX), F.md5(t)).alias("url"),
        F.col("source").alias("source"),
        F.col("lang").alias("search_query"))


def labeled_docs(spark, d) -> DataFrame:
    """Documents that carry a label (the "seen before" set)."""
    return _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


# ------------------------------------------------------------ text / profile

def q_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("text_clean"))


def q_contact_extract(spark, d):
    return pf.contact_extract(_docs(spark, d))


def q_title_rule(spark, d):
    return _docs(spark, d).select("doc_id", pf.title_rule(F.col("text"), S.TITLE_RULES).alias("title"))


def q_location_rule(spark, d):
    loc = pf.location_rule(F.col("text"), S.LOCATION_RULES)
    return (_docs(spark, d).select("doc_id", loc.alias("location"))
            .withColumn("search_location", pf.search_location(F.col("location"), primary=S.LOCATION_PRIMARY,
                                                              country=S.LOCATION_COUNTRY)))


def q_summary_lines(spark, d):
    return _docs(spark, d).select("doc_id", pf.summary_lines(F.col("text"), S.SUMMARY_HEADERS).alias("summary"))


def q_skill_match(spark, d):
    return (pf.with_skills(_docs(spark, d).select("doc_id", "text"), "text", "s")
            .select("doc_id", F.array_join("s", ", ").alias("skills"), F.size("s").cast("bigint").alias("n_skills")))


def q_dictionary_match(spark, d):
    """J8 large-dictionary path (gram equi-join + verification) with the skill dictionary as a
    table; must equal the unrolled ``skill_match``."""
    terms = spark.createDataFrame([(t,) for t in fixed.SKILL_TERMS], "term string")
    m = pf.dictionary_match(_docs(spark, d).select("doc_id", "text"), terms)
    return m.select("doc_id", F.array_join("terms", ", ").alias("skills"), F.size("terms").cast("bigint").alias("n_skills"))


def _resumes(spark, d) -> DataFrame:
    """Résumés made of documents: lines with titles, places, years, firms and degrees chosen by the document's own
    values, around its text. The documents' words alone hit none of the fixed rules."""
    def pick(lines):
        return F.element_at(F.array(*[F.lit(x) for x in lines]), (F.pmod("doc_id", F.lit(len(lines))) + 1).cast("int"))

    t = F.coalesce(F.col("text"), F.lit(""))
    years = F.when(F.col("n_chars") % 4 > 0, F.concat((F.col("n_chars") % 31).cast("string"), F.lit("+ years of experience at "))).otherwise(F.lit("always at "))
    lines = [tx.first_line(t), pick(S.RESUME_TITLES), pick(S.RESUME_PLACES), F.concat(years, pick(S.RESUME_FIRMS)), t, F.lit("EDUCATION"),
             pick(S.RESUME_DEGREES), F.concat(F.lit("ADDITIONAL "), F.coalesce(F.col("source"), F.lit("")))]
    return _docs(spark, d).select("doc_id", F.concat_ws("\n", *lines).alias("text"))


def q_company_match(spark, d):
    c = pf.company_match(F.col("text"))
    return (_resumes(spark, d).select("doc_id", c.alias("c"))
            .select("doc_id", F.array_join("c", ", ").alias("companies"),
                    F.size("c").cast("bigint").alias("n_companies")))


def q_experience_years(spark, d):
    return _docs(spark, d).select(
        "doc_id", pf.experience_years(F.col("text"), S.EXPERIENCE_RULES).alias("experience_years"))


def q_education_degrees(spark, d):
    e = pf.education_degrees(F.col("text"))
    return (_resumes(spark, d).select("doc_id", e.alias("e"))
            .select("doc_id", F.array_join("e", " | ").alias("education"), F.size("e").cast("bigint").alias("n_degrees")))


def q_profile(spark, d):
    """F9-F20 in one pass with the fixed rule lists (the whole profile per résumé)."""
    p = pf.profile(_resumes(spark, d))
    return p.select("doc_id", "name", "email", "phone", "location", "title", "summary",
                    F.array_join("skills", ", ").alias("skills"), "experience_years",
                    F.array_join("companies", ", ").alias("companies"),
                    F.array_join("education", " | ").alias("education"),
                    F.array_join("job_search_queries", "|").alias("job_search_queries"), "search_location")


def q_search_terms(spark, d):
    terms = pf.search_terms(F.col("p_type"))
    return (_t(spark, d, "part").select("p_partkey", F.col("p_type").alias("title"), terms.alias("t"))
            .select("p_partkey", "title", F.array_join("t", "|").alias("terms"), F.size("t").cast("bigint").alias("n_terms")))


def q_search_plan(spark, d):
    terms = _t(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("query_no"),
                                        F.col("p_name").alias("query"))
    p = search_plan(terms, "query", S.SEARCH_LOCATION, S.SEARCH_PAGES)
    return p.select("query_no", "query", "source", F.col("source_no").cast("bigint").alias("source_no"),
                    F.col("page_no").cast("bigint").alias("page_no"), "start", "search_url")


def q_assemble_text(spark, d):
    return pf.assemble_text(_t(spark, d, "conversations"), "conv_id", "turn", "text")


# ---------------------------------------------------------------- HTML pages

def _pages(spark, d):
    return _t(spark, d, "pages")


def q_select_text(spark, d):
    return H.select_text(_pages(spark, d), {"title": ["title"], "h1": ["h1"], "footer": ["footer"], "ad": ["div.ad"]})


def q_extract_cards(spark, d):
    return (H.extract_cards(_pages(spark, d), S.SKILL_CARD_SELECTORS)
            .withColumn("card_rank", F.col("card_rank").cast("bigint")))


def q_extract_postings(spark, d):
    cfg = {"base_url": "", "selectors": {"job_card": S.SKILL_CARD_SELECTORS, "title": S.CARD_TITLE_SELECTORS,
                                         **S.FIRST_FIELDS}}
    pages = _pages(spark, d).withColumnRenamed("url", "page_url")
    out = H.extract_postings(pages, cfg, keep=("page_id", "page_url"), base_col=tx.base_of(F.col("page_url")),
                             source_name="pages")
    return out.select("page_id", F.col("card_rank").cast("bigint").alias("card_rank"), "card_no", "title", "company",
                      "location", "salary", "description", "url", "source")


def q_page_links(spark, d):
    return H.page_links(_pages(spark, d), S.LINK_TOKEN)


def q_absolute_url(spark, d):
    return H.absolute_links(_pages(spark, d), "a[href]")


def q_url_key(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", tx.url_key_strict(u, S.URL_KEY_PARAM).alias("key_strict"),
                                   tx.url_key_loose(u, S.URL_KEY_PARAM).alias("key_loose"))


def q_canonical_url(spark, d):
    return en.with_canonical_url(_pages(spark, d).select("page_id", "url"), "url", S.URL_KEY_PARAM,
                                 S.CLEAN_URL_FORMAT).select("page_id", "canonical_url")


def q_interstitial_flag(spark, d):
    return qa.interstitial_flags(_pages(spark, d), all_tokens=S.INTERSTITIAL_ALL, any_tokens=S.INTERSTITIAL_ANY,
                                 url_tokens=S.INTERSTITIAL_URL).select("page_id", "flag_all", "flag_any", "flag_url")


def q_page_prefix(spark, d):
    pages = _pages(spark, d)
    # the per-page card counts feed both the stop aggregate and the join: parse once
    counts = cut_lineage(H.card_counts(pages, [S.PREFIX_CARD_SELECTOR], keep=("page_id", "url")), "card-counts")
    counts = counts.withColumn("host", tx.host_of(F.col("url")))
    kept = qa.page_prefix(counts, ["host"], "page_id", F.col("n_cards") == 0)
    return kept.select("host", "page_id", "n_cards")


def q_description_pick(spark, d):
    return H.description_pick(_pages(spark, d), S.DESCRIPTION_SELECTORS)


def q_date_text_pick(spark, d):
    return H.date_text_pick(_pages(spark, d), S.DATE_SELECTORS, S.DATE_WORDS)


def q_footer_date(spark, d):
    return H.footer_date(_pages(spark, d), S.FOOTER_CLASS_TOKEN, S.FOOTER_DATE_RULE)


def q_text_node_grep(spark, d):
    return H.text_node_grep(_pages(spark, d), S.TEXT_NODE_TOKENS).drop("node_no")


def q_source_line_grep(spark, d):
    return H.source_line_grep(_pages(spark, d), tokens=S.SOURCE_LINE_TOKENS, lower_tokens=S.SOURCE_LINE_LOWER_TOKENS)


def q_selector_hits(spark, d):
    return H.selector_hits(_pages(spark, d), S.HIT_SELECTORS)


# ------------------------------------------------------- identity / history

def q_dedup_keep_first(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return idn.keep_first(docs, "text", "doc_id", hash_key=True, carry=["doc_id", "lang", "source", "n_chars"])


def q_new_vs_history(spark, d):
    batch = _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    hist = labeled_docs(spark, d).select("text")
    return idn.new_vs_history(batch, hist, "text", "doc_id", hash_key=True, carry=["doc_id", "lang", "source"])


def q_history_append(spark, d):
    posts = doc_postings(_t(spark, d, "documents"))
    old_src = doc_postings(labeled_docs(spark, d))
    old = idn.keep_first(old_src, "url", "ordinal").select("url", "title", "source",
                                                             F.lit(S.HISTORY_TS).alias("first_seen"))
    new = idn.history_append(old, posts, S.RUN_TS, "url", "ordinal", columns=("title", "source"))
    return old.unionByName(new)


def _upsert_inputs(spark, d):
    state = _t(spark, d, "documents").select(
        "doc_id", F.col("doc_id").alias("ordinal"), F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lit(None).cast("bigint").alias("quality"), F.lit(None).cast("bigint").alias("toxic"))
    lab = _t(spark, d, "labels")
    upd_existing = lab.select("doc_id", F.col("doc_id").alias("ordinal"), F.lit(None).cast("bigint").alias("n_chars"),
                              F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))
    upd_new = lab.filter(F.col("toxic") == 1).select(
        (F.col("doc_id") + S.NEW_ID_OFFSET).alias("doc_id"), (F.col("doc_id") + S.NEW_ID_OFFSET).alias("ordinal"),
        F.lit(None).cast("bigint").alias("n_chars"), F.col("quality").cast("bigint").alias("quality"),
        F.col("toxic").cast("bigint").alias("toxic"))
    return state, upd_existing.unionByName(upd_new)


def q_upsert(spark, d):
    state, upd = _upsert_inputs(spark, d)
    out = idn.upsert(state, upd, "doc_id", ["n_chars", "quality", "toxic"], "ordinal")
    return out.select("doc_id", F.col("origin").cast("bigint").alias("origin"), "ordinal", "n_chars", "quality", "toxic",
                      "was_updated")


def _values(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """The values of a column that become columns or frames (a configuration-sized set)."""
    found = [r[0] for r in df.select(col).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted(found, key=lambda v: (v is None, v or ""))


def q_upsert_fold(spark, d):
    ev = _t(spark, d, "events")
    types = _values(ev, "event_type")
    wide = ev.select("user_id", F.col("event_id").alias("ordinal"),
                     *[F.when(F.col("event_type").eqNullSafe(t), F.col("value")).alias(t or "none") for t in types])
    return idn.upsert_fold(wide, "user_id", [t or "none" for t in types], "ordinal")


def q_upsert_map(spark, d):
    """J3/J4 in map form over events: views are the state, all others update it, field names come from the rows."""
    ev = _t(spark, d, "events")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    props = F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, v: F.concat(F.lit("prop_"), k))
    fields = F.map_concat(F.map_from_arrays(F.array(F.coalesce("event_type", F.lit("none"))), F.array(cents)), F.coalesce(props, F.create_map().cast("map<string,string>")))
    rows = ev.select("user_id", F.col("event_id").alias("ordinal"), "event_type", fields.alias("fields"))
    view = F.coalesce(F.col("event_type") == "view", F.lit(False))
    view = view & (F.col("user_id") % 3 > 0)  # other users are not in the state
    out = idn.upsert_map(rows.filter(view), rows.filter(~view), "user_id")
    entry = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return out.select("user_id", F.col("origin").cast("bigint").alias("origin"), "ordinal", F.array_join(entry, ";").alias("fields"), "was_updated")


# -------------------------------------------------------------- enrichment

def _enrich_inputs(spark, d):
    docs = _t(spark, d, "documents")
    posts = doc_postings(docs).withColumn(
        "description", F.when(F.col("location") == "en", F.col("description")).otherwise(F.lit("")))
    state = doc_postings(docs.filter(F.col("lang").isin("en", "de")))
    lab = _t(spark, d, "labels")
    details = doc_postings(docs.join(lab, "doc_id")).join(
        lab.select(F.col("doc_id").alias("ordinal"), "quality"), "ordinal").select(
        F.col("url").alias("canonical_url"), "ordinal", "description",
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("posted_date"),
        F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return posts, state, details


def q_skip_enriched(spark, d):
    posts, state, _ = _enrich_inputs(spark, d)
    return en.skip_enriched(posts, state, "url", "ordinal").select(F.col("ordinal").alias("doc_id"), "url")


def q_enrich(spark, d):
    posts, _, details = _enrich_inputs(spark, d)
    p = en.with_canonical_url(posts.select("ordinal", "url", "description", "posted_date"), "url")
    out = en.enrich(p, details, "canonical_url", "canonical_url", "ordinal")
    return out.select(F.col("ordinal").alias("doc_id"), "url", "description", "posted_date", "success")


def q_enrich_stats(spark, d):
    posts, state, details = _enrich_inputs(spark, d)
    fields = ["description", "posted_date"]
    _, flags = en.enrich_run(posts.select("url", "ordinal", *fields), state.select("url", "ordinal", *fields),
                             details, fields, "url", "ordinal")  # counters only: the merged state is not needed
    upserted = flags.filter(~F.col("skipped")).select("url", "ordinal")
    return en.enrich_stats(flags, state, upserted, "url", "ordinal")


def _second_mode(spark, d):
    posts, _, details = _enrich_inputs(spark, d)
    blank = F.when(F.col("ordinal") % 6 == 0, "").when(F.col("ordinal") % 6 == 1, None).otherwise(F.col("url"))
    return en.enrich_all(posts.select("ordinal", blank.alias("url"), "description", "posted_date"), details, detail_ordinal="ordinal")


def q_enrich_all(spark, d):
    """A7, second mode: every posting with a url is enriched again."""
    return _second_mode(spark, d).select(F.col("ordinal").alias("doc_id"), F.length("description").cast("bigint").alias("description_len"), "posted_date", "outcome")


def q_enrich_all_stats(spark, d):
    return en.enrich_all_stats(_second_mode(spark, d))


def q_enrich_upsert(spark, d):
    posts, state, details = _enrich_inputs(spark, d)
    fields = ["description", "posted_date"]
    new_state, _ = en.enrich_run(posts.select("url", "ordinal", *fields), state.select("url", "ordinal", *fields),
                                 details, fields, "url", "ordinal")
    return new_state.select("url", F.col("origin").cast("bigint").alias("origin"), "ordinal",
                            F.length("description").cast("bigint").alias("description_len"), "posted_date", "was_updated")


# ----------------------------------------------------------------- quality

def q_field_completeness(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    t = F.col("text")
    checks = {
        "desc_nonempty": tx.is_filled(t),
        "desc_gt20_stripped": tx.is_filled(t, 20, strip=True),
        "desc_gt50": tx.is_filled(t, fixed.DESCRIPTION_MIN_LEN),
        "desc_gt100": tx.is_filled(t, fixed.ENRICHED_MIN_LEN),
        "labeled": F.col("quality").isNotNull(),
        "quality_ok": F.coalesce(F.col("quality") == 1, F.lit(False)),
    }
    return qa.field_completeness(docs, checks, ["source"])


def q_progress_pct(spark, d):
    docs = _t(spark, d, "documents")
    upd = docs.join(_t(spark, d, "labels"), "doc_id").select(
        F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")).alias("posted_date"))
    return qa.progress_pct(docs, upd)


def _flagged(spark, d):
    batch = _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    hist = labeled_docs(spark, d).select("text")
    return idn.flag_new(batch, hist, "text", "doc_id", hash_key=True)


def q_source_stats(spark, d):
    f = _flagged(spark, d).withColumnRenamed("lang", "search_query")
    return qa.source_stats(f, ["source", "search_query"])


def q_running_total(spark, d):
    per = (_flagged(spark, d).groupBy(F.col("lang").alias("query"))
           .agg(F.count_if("is_new").alias("n_new")))
    per = per.withColumn("query_no", F.dense_rank().over(Window.orderBy("query")).cast("bigint"))
    return qa.running_total(per, "query_no", "n_new").select("query_no", "query", "n_new", "so_far", "position", "of_n")


def q_first_n(spark, d):
    return qa.first_n(_t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), 10, "doc_id")


def q_sample_topk(spark, d):
    docs = _t(spark, d, "documents")
    s = qa.sample_topk(docs, tx.is_filled(F.col("text"), fixed.ENRICHED_MIN_LEN), 5, "doc_id")
    return s.select("doc_id", qa.title_line(tx.first_line(F.col("text"))).alias("title50"),
                    qa.length_label(F.col("text")).alias("len_label"))


def q_preview(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select(
        "doc_id", tx.preview(t, 100, fixed.EMPTY_MARK).alias("p100"),
        F.concat(tx.preview(t, 350), F.lit("...")).alias("p350"), tx.preview(t, 500).alias("p500"))


def q_record_profile(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return qa.record_profile(docs, "doc_id")


# ------------------------------------------------------------------ report

def _page_postings(spark, d):
    p = _pages(spark, d)
    return p.select("page_id", tx.host_of(F.col("url")).alias("source"), "url",
                    F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
                    F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("location"),
                    F.lit("").alias("salary"), F.col("html").alias("description"))


def q_report_rows(spark, d):
    return rp.report_rows(_page_postings(spark, d), keep=("page_id",))


def q_report_summary(spark, d):
    return rp.report_summary(_page_postings(spark, d), S.REPORT_QUERY, S.REPORT_LOCATION, S.RUN_DATE)


def q_report_title_terms(spark, d):
    """the title of a report, from the search terms of each part's type."""
    return _t(spark, d, "part").select("p_partkey", rp.report_title_terms(pf.search_terms(F.col("p_type"))).alias("title"))


# ------------------------------------------------------------ union / sinks

SOURCE_COLUMNS = {"en": ["source"], "de": ["salary"], "es": ["company"], "fr": ["description"]}


def q_union_sources(spark, d):
    """Each language has columns of its own, any other gives title and url only; one scan for all of them."""
    p = doc_postings(_t(spark, d, "documents"))
    owned = sorted({c for names in SOURCE_COLUMNS.values() for c in names})
    rows = p.select("ordinal", "title", "url", *[
        F.when(F.col("location").isin([lang for lang, names in SOURCE_COLUMNS.items() if c in names]), F.col(c)).alias(c) for c in owned])
    return idn.union_sources([rows])


def q_consolidate(spark, d):
    return idn.consolidate(doc_postings(_t(spark, d, "documents")), "url", "ordinal")


def q_read_csv(spark, d):
    posts = doc_postings(_t(spark, d, "documents"))
    path = work_path(spark, "csv")
    io.write_csv(posts, path, columns=fixed.POSTING_7)
    return io.read_csv(spark, [path, path + "-missing"], fixed.POSTING_7, own=True)


def q_read_csv_mixed(spark, d):
    """S1 by header name in every file: files of one folder whose columns come in another order."""
    posts = doc_postings(_t(spark, d, "documents"))
    path = work_path(spark, "csv-mixed")
    odd = F.col("ordinal") % 2 == 1
    io.write_csv(posts.filter(odd), path, columns=["url", "title", "company"])
    io.write_csv(posts.filter(~odd), path, columns=["title", "company", "url", "salary"], mode="append")
    return io.read_csv(spark, [path], ["title", "company", "url", "source"], own=True)


def q_read_json(spark, d):
    posts = doc_postings(_t(spark, d, "documents")).drop("ordinal")
    path = work_path(spark, "json")
    io.write_json(posts, path)
    return io.read_json(spark, path, io.string_schema(fixed.POSTING_9), strict=True, multiline=False)


def q_read_csv_rejects(spark, d):
    """S1 + P14: CSV with broken records among the good ones; both are returned, none fails the read."""
    posts = doc_postings(_t(spark, d, "documents"))
    path = work_path(spark, "csv-rejects")
    io.write_csv(posts, path, columns=["url", "title", "company"])
    broken = posts.filter(F.col("ordinal") % 10 == 3).select(
        F.when(F.col("ordinal") % 20 == 3, F.concat("url", F.lit(",only two"))).otherwise(F.concat("url", F.lit(",a,b,too many"))).alias("value"))
    # every file has a header of its own, as the good ones have
    packed = broken.groupBy(F.pmod(F.xxhash64("value"), F.lit(64)).alias("g")).agg(F.collect_list("value").alias("lines"))
    packed.select(F.array_join(F.concat(F.array(F.lit("url,title,company")), "lines"), "\n").alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(f"{path}/more")
    rows, rejects = io.read_csv_rejects(spark, [path], ["url", "title", "company"])
    return rows.select("url", F.lit(None).cast("string").alias("record"), F.lit("read").alias("kind")).unionByName(
        rejects.select(F.split("record", ",")[0].alias("url"), "record", F.col("reason").alias("kind")))


def q_read_json_array(spark, d):
    """Files that hold one JSON array each; a truncated one reads as empty, the others in full."""
    posts = doc_postings(_t(spark, d, "documents"))
    group = F.floor(F.col("ordinal") / 50).cast("bigint")
    path = work_path(spark, "json-array")
    arrays = posts.groupBy(group.alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*fixed.POSTING_9))), ","), F.lit("]")).alias("value"))
    cut = F.when(F.col("g") % 5 == 4, F.expr("substring(value, 1, length(value) - 2)")).otherwise(F.col("value"))
    arrays.select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return io.read_json(spark, path, io.string_schema(fixed.POSTING_9)).select("url", "title", "source")


def q_json_variant(spark, d):
    """records whose keys differ, landed as VARIANT and projected again; absent, null and '' stay apart."""
    from jobsmith.sources import variant as va
    docs = _t(spark, d, "documents")
    title = tx.first_line(F.col("text"))
    kinds = [F.struct(F.col("source").alias("company"), title.alias("title")),  # no salary
             F.struct(title.alias("title"), F.lit("").alias("salary")), F.struct(F.col("n_chars").alias("salary"), title.alias("title"))]
    line = F.when(F.col("doc_id") % 4 == 0, F.to_json(kinds[0])).when(F.col("doc_id") % 4 == 1, F.to_json(kinds[1]))
    line = line.when(F.col("doc_id") % 4 == 2, F.to_json(kinds[2])).otherwise(F.concat(F.lit('{"salary": null, "company": '), F.to_json(F.array("source")), F.lit("}")))
    path = work_path(spark, "variant")
    va.land_json(docs.select("doc_id", F.coalesce(line, F.lit("{}")).alias("value")), path)
    records = va.read_records(spark, path)
    shown = va.project(records, ["title", "salary"], keep=("doc_id", "record"))
    return shown.select("doc_id", "title", "salary", va.presence(F.col("record"), "salary").alias("salary_is"), va.presence(F.col("record"), "company").alias("company_is"),
                        va.presence(F.col("record"), "title").alias("title_is"))


def q_sink_csv(spark, d):
    posts = io.run_date_partition(doc_postings(_t(spark, d, "documents")), S.RUN_DATE)
    path = work_path(spark, "csv-by-source")
    io.write_csv(posts, path, columns=[*fixed.POSTING_7, "run_date"], partition_by=["source", "run_date"])
    return io.read_csv(spark, [path], [*fixed.POSTING_7, "run_date"], same_header=True)


def q_sink_json(spark, d):
    posts = doc_postings(_t(spark, d, "documents"))
    uniq = idn.keep_first(posts, "url", "ordinal").drop("ordinal")
    path = work_path(spark, "json-dedup")
    io.write_json(uniq, path)
    return io.read_json(spark, path, io.string_schema(fixed.POSTING_9), strict=True, multiline=False)


# --------------------------------------------------------------- streaming

def _steps(df: DataFrame, ordinal: str, steps: int = 4):
    """Parts of a frame in ordinal order."""
    b = df.agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi")).first()  # two numbers
    if b["lo"] is None:
        return
    width = (int(b["hi"]) - int(b["lo"])) // steps + 1
    for i in range(steps):
        lo = int(b["lo"]) + i * width
        yield df.filter((F.col(ordinal) >= lo) & (F.col(ordinal) < lo + width))


def _arrivals(spark, df: DataFrame, ordinal: str, name: str, steps: int = 4):
    """Parts of a frame in ordinal order, each landed as a folder of many files; yields the source
    folder after every landing (arrival order = ordinal order, no part in one task)."""
    src = work_path(spark, name)
    for i, part in enumerate(_steps(df, ordinal, steps)):
        part.write.parquet(f"{src}/step{i}")
        yield f"{src}/*"


def q_stream_history(spark, d):
    """X1 end to end: documents land in four steps; after each the stream (same checkpoint, same
    run) folds the new files into the history. A history of an earlier run is there from the start."""
    from jobsmith.streaming.history import history_batch, read_history, stream_new_postings
    posts = doc_postings(_t(spark, d, "documents")).select("ordinal", "url", "title", "source")
    hist, ckpt = work_path(spark, "stream-hist"), work_path(spark, "stream-ckpt")
    old = doc_postings(labeled_docs(spark, d)).select("ordinal", "url", "title", "source")
    history_batch(old, 0, hist, "url", "ordinal", run_id="first", first_seen=S.HISTORY_TS)
    for src in _arrivals(spark, posts, "ordinal", "stream-src"):
        stream_new_postings(spark, src, posts.schema, hist, ckpt, "url", "ordinal", max_files_per_trigger=None,
                            run_id="second", first_seen=S.RUN_TS).awaitTermination()
    return read_history(spark, hist, posts.schema).select("url", F.col("ordinal").alias("doc_id"), "title", "source",
                                                          "first_seen", "run_id")


def q_history_compacted(spark, d):
    """X1 over a compacted history: documents land in four steps; after each one all partitions become one
    snapshot, and the last step is run again under its old batch id, which changes nothing."""
    from jobsmith.streaming.history import compact_history, history_batch, read_history
    posts = doc_postings(_t(spark, d, "documents")).select("ordinal", "url", "title", "source")
    hist = work_path(spark, "compact-hist")
    for step, part in enumerate(_steps(posts, "ordinal")):
        for _ in range(2 if step == 3 else 1):
            history_batch(part, step, hist, "url", "ordinal", hash_key=True, run_id="run", first_seen=S.RUN_TS)
            compact_history(spark, hist, "url", hash_key=True)
    return read_history(spark, hist, posts.schema).select("url", F.col("ordinal").alias("doc_id"), "title", "source", "first_seen",
                                                          F.col("batch_id").cast("bigint").alias("step"))


def q_stream_dedup(spark, d):
    """Engine-state dedup on the url (which duplicate wins is not defined: url only)."""
    from jobsmith.streaming.history import stream_dedup_state
    posts = doc_postings(_t(spark, d, "documents")).select("ordinal", "url")
    sink, ckpt = work_path(spark, "dedup-sink"), work_path(spark, "dedup-ckpt")
    for src in _arrivals(spark, posts, "ordinal", "dedup-src"):
        stream_dedup_state(spark, src, posts.schema, "url", sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).select("url")


def q_stream_dedup_watermark(spark, d):
    """X2 with state that expires: events arrive in steps of eight days, a user and type is let through again once
    its last row is three days behind the watermark (the step after the next one)."""
    from jobsmith.streaming.history import stream_dedup_state
    step = F.floor(F.datediff("ts", F.lit(S.EVENTS_FROM)) / 8).cast("bigint")
    ev = _t(spark, d, "events").select(step.alias("step"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    ev = ev.withColumn("ts", F.timestamp_add("DAY", (F.col("step") * 8).cast("int"), F.lit(S.EVENTS_FROM).cast("timestamp")))
    sink, ckpt = work_path(spark, "dedup-wm-sink"), work_path(spark, "dedup-wm-ckpt")
    for src in _arrivals(spark, ev, "step", "dedup-wm-src"):
        stream_dedup_state(spark, src, ev.schema, "key", sink, ckpt, watermark=("ts", "3 days")).awaitTermination()
    return spark.read.parquet(sink).select("key", "step")


def q_stream_pages(spark, d):
    """S4 + X1: the pages of ``automated_history`` land in four steps of files; each step runs through extraction, page
    stop and history; finished files go to an archive."""
    from jobsmith.sources.config import selectors_df, sources_df
    from jobsmith.streaming.history import history_batch, read_history
    from jobsmith.streaming.pages import stream_pages
    pages, hist, cfg = _run_inputs(spark, d)
    sources, selectors = sources_df(spark, cfg), selectors_df(spark, cfg)
    path, stops, ckpt, src = (work_path(spark, n) for n in ("pages-hist", "pages-stops", "pages-ckpt", "pages-src"))
    zero = F.lit(0).cast("bigint")
    place = F.struct(zero.alias("query_no"), zero.alias("source_no"), zero.alias("page_num"), F.monotonically_increasing_id().alias("card_no"))
    history_batch(hist.select("url", place.alias("ordinal")), 0, path, "url", "ordinal", run_id="before")
    for i, part in enumerate(_steps(pages, "page_num")):
        part.write.json(f"{src}/in/step{i}")
        stream_pages(spark, f"{src}/in/*", pages.schema, sources, selectors, path, stops, ckpt, archive=f"{src}/done", run_id="stream",
                     first_seen=S.RUN_TS, page_base=True).awaitTermination()
    rows = read_history(spark, path, None).filter("run_id = 'stream'")
    return rows.select("url", "title", "source", "first_seen")


def q_posting_source(spark, d):
    """The dump source with a pushed filter, over documents landed as JSON Lines."""
    from jobsmith.sources.posting_dump import read_dump
    posts = doc_postings(_t(spark, d, "documents")).drop("ordinal")
    path = work_path(spark, "dump")
    io.write_json(posts, path)
    return read_dump(spark, path).filter(F.col("location").isin("en", "fr")).select("url", "title", "location", "source")


def q_stream_posting_source(spark, d):
    """The dump source as a stream: files are added twice, each is read once."""
    from jobsmith.sources.posting_dump import stream_dump
    posts = doc_postings(_t(spark, d, "documents"))
    path, sink, ckpt = (work_path(spark, n) for n in ("dump-src", "dump-sink", "dump-ckpt"))
    for part in _steps(posts, "ordinal", 2):
        io.write_json(part.drop("ordinal"), path, mode="append", skip_empty=False)
        stream_dump(spark, path, sink, ckpt, ("url", "title", "source"))
    return spark.read.parquet(sink)


def q_stream_enrich(spark, d):
    """Postings arrive in four steps; each micro-batch runs the enrichment batch body against
    the buckets of its keys in the newest state version; the last version equals one sequential pass."""
    from jobsmith.sources.state import read_state
    from jobsmith.streaming.history import seed_state, stream_enrich
    posts, state, details = _enrich_inputs(spark, d)
    fields = ["description", "posted_date"]
    p = posts.select("url", "ordinal", *fields)
    details = cut_lineage(en.successful_only(details), "stream-details")  # read by every batch
    base, ckpt = work_path(spark, "enrich-state"), work_path(spark, "enrich-ckpt")
    seed_state(state, base, fields, buckets=16)
    for src in _arrivals(spark, p, "ordinal", "enrich-src"):
        stream_enrich(spark, src, p.schema, base, details, fields, ckpt, max_files_per_trigger=None).awaitTermination()
    return read_state(spark, base).select("url", F.col("origin").cast("bigint").alias("origin"), "ordinal",
                        F.length("description").cast("bigint").alias("description_len"), "posted_date")


def _run_inputs(spark, d):
    """§3.1 over the pages table: one configured source (stand-in selectors), each host a search
    term, pages in page_id order; history = links seen on blog hosts."""
    cfg = {S.RUN_SOURCE: {"base_url": S.RUN_BASE_URL, "page_size": 0, "page_mode": "offset", "search_url": "",
                          "selectors": {"job_card": S.SKILL_CARD_SELECTORS, "title": S.CARD_TITLE_SELECTORS,
                                        **S.FIRST_FIELDS}}}
    p = _pages(spark, d)
    pages = p.select(F.lit(S.RUN_SOURCE).alias("source"), tx.host_of(F.col("url")).alias("query"),
                     F.lit(0).alias("query_no"), F.col("page_id").alias("page_num"), "url", "html")
    hist = (p.filter(tx.host_of(F.col("url")).startswith(S.RUN_HISTORY_HOST_PREFIX))
            .select(tx.base_of(F.col("url")).alias("b"),
                    F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("h"))
            .select(tx.absolute_url(F.col("h"), F.col("b")).alias("url")))
    return pages, hist, cfg


def _automated(spark, d) -> dict[str, DataFrame]:
    from jobsmith.plans.run import automated_run
    pages, hist, cfg = _run_inputs(spark, d)
    return automated_run(pages, hist, S.RUN_TS, [S.RUN_SOURCE], cfg, page_base=True)


def q_automated_run(spark, d):
    """The consolidated 9-column table of new postings (links resolved against their page's origin)."""
    return _automated(spark, d)["consolidated"]


def q_automated_stats(spark, d):
    """A6 of the same run: found, new and repeated postings of each search term."""
    return _automated(spark, d)["stats"]


def q_automated_history(spark, d):
    """K6 of the same run: the rows to append to the history, stamped with the run."""
    return _automated(spark, d)["history_rows"].select("url", "title", "source", "first_seen")


def _manual(spark, d) -> dict[str, DataFrame]:
    from jobsmith.plans.run import manual_run
    pages, hist, cfg = _run_inputs(spark, d)
    return manual_run(pages, hist, work_path(spark, "manual"), S.RUN_DATE, S.REPORT_QUERY, S.REPORT_LOCATION,
                      ignore_history=True, sources=[S.RUN_SOURCE], config=cfg)


def q_manual_run(spark, d):
    """scraper-style run that ignores the history (J2): every posting, merged without dedup (K1, K3)."""
    return _manual(spark, d)["merged"]


def q_manual_report(spark, d):
    """K7 of the same run: the rows of its report."""
    return _manual(spark, d)["report"]


def q_manual_summary(spark, d):
    """P9/P10 of the same run: the head of its report."""
    return _manual(spark, d)["summary"]


# --------------------------------------------- templated pages (from table values)

CARDS_PER_PAGE = 20


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _listing_pages(spark, d, card) -> DataFrame:
    """Listing pages of the part table, at most CARDS_PER_PAGE cards each."""
    part = _t(spark, d, "part")
    cards = part.select(F.floor(F.col("p_partkey") / CARDS_PER_PAGE).cast("bigint").alias("page_id"), "p_partkey", card.alias("card"))
    return cards.groupBy("page_id").agg(F.concat(
        F.lit("<html><body><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))),
                                                            lambda x: x["card"]), ""), F.lit("</ul></body></html>")).alias("html"))


def _tagged(open_tag: str, c, close: str):
    return F.concat(F.lit(open_tag), _escaped(c.cast("string")), F.lit(close))


def q_card_fields(spark, d):
    """H1-H5 with the first source's own selectors: every posting field filled from the part table."""
    key = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/viewjob?jk='), key, F.lit('">'),
                    _escaped(F.col("p_name")), F.lit("</a></h2>"),
                    _tagged('<span class="companyName">', F.col("p_brand"), "</span>"),
                    _tagged('<div class="companyLocation">', F.col("p_type"), "</div>"),
                    F.when(F.col("p_size") % 2 == 0, _tagged('<div class="salary-snippet">', F.col("p_size"), "</div>")).otherwise(F.lit("")),
                    F.when(F.col("p_size") % 3 > 0, _tagged('<div class="job-snippet">', F.col("p_name"), " made</div>")).otherwise(F.lit("")),
                    F.lit("</div>"))
    return H.extract_postings(_listing_pages(spark, d, card), fixed.SOURCES["indeed"]).drop("card_rank")


def q_description_probe(spark, d):
    """What the first card of each listing page offers as a description."""
    key = F.col("p_partkey").cast("string")
    made = F.concat_ws(" ", "p_name", F.lit("made as"), "p_type", F.lit("by"), "p_brand")
    card = F.concat(F.lit('<li class="card"><h2>'), key, F.lit("</h2>"), _tagged('<div class="kind">', F.col("p_type"), "</div>"),
                    _tagged('<div class="long">', made, "</div>"), F.when(F.col("p_size") % 3 > 0, _tagged('<p class="snippet">', made, "</p>")).otherwise(F.lit("")),
                    F.when(F.col("p_size") % 2 > 0, _tagged('<p class="note">', F.concat_ws(" ", "p_name", "p_type", "p_brand"), "</p>")).otherwise(F.lit("")), F.lit("</li>"))
    out = H.description_probe(_listing_pages(spark, d, card), ["li.card"], ["p.note", "p.snippet"])
    return out.select("page_id", "probe_rank", "length", "preview", F.array_join("divs", ",").alias("divs"))


def q_dedup_composite(spark, d):
    """First posting of each (title, company, location) instead of each url."""
    posts = doc_postings(_t(spark, d, "documents")).withColumn("key", idn.composite_key("title", "company", "location"))
    return idn.keep_first(posts, "key", "ordinal", carry=["key", "ordinal", "title"]).select("key", F.col("ordinal").alias("doc_id"), "title")


def q_sink_guard(spark, d):
    """K9: a write without rows leaves what an earlier one has put there."""
    posts = doc_postings(_t(spark, d, "documents"))
    path = work_path(spark, "guard")
    io.write_csv(posts, path, columns=["url", "title"])
    io.write_csv(posts.filter(F.col("ordinal") < F.col("ordinal")), path, columns=["url", "title"])
    return io.read_csv(spark, [path], ["url", "title"], same_header=True)


def q_link_cards(spark, d):
    """H4: the third source takes the href of its link element as it stands."""
    key = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<li class="jobs-search-results__list-item"><h3 class="base-search-card__title">'), _escaped(F.col("p_name")),
                    F.lit("</h3>"), F.when(F.col("p_size") % 5 > 0, F.concat(F.lit('<a class="base-card__full-link" href="/view/'), key, F.lit('">x</a>')))
                    .otherwise(F.lit("")), F.lit("</li>"))
    out = H.extract_postings(_listing_pages(spark, d, card), fixed.SOURCES["linkedin"], link_mode="link")
    return out.select("page_id", "card_no", "title", "url")


def _source_pages(spark, d) -> DataFrame:
    """Listing pages of all three configured sources, their cards filled from the part table."""
    key = F.col("p_partkey").cast("string")
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    cards = {
        "indeed": F.concat(F.lit('<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/viewjob?jk='), key, F.lit('">'), _escaped(F.col("p_name")),
                           F.lit("</a></h2>"), _tagged('<span data-testid="company-name">', brand, "</span>"),
                           _tagged('<div class="companyLocation">', kind, "</div>"), F.lit("</div>")),
        "irishjobs": F.concat(F.lit('<div class="job-item"><h2 class="job-title">'), _escaped(F.col("p_name")), F.lit('</h2><a class="job-link" href="/job/'), key,
                              F.lit('">more</a>'), _tagged('<div class="employer">', brand, "</div>"), _tagged('<span class="location">', kind, "</span>"),
                              F.when(size % 2 == 0, _tagged('<div class="job-salary">', size, "</div>")).otherwise(F.lit("")), F.lit("</div>")),
        "linkedin": F.concat(F.lit('<li class="jobs-search-results__list-item"><h3 class="base-search-card__title">'), _escaped(F.col("p_name")), F.lit("</h3>"),
                             _tagged('<h4 class="base-search-card__subtitle">', brand, "</h4>"), _tagged('<span class="job-search-card__location">', kind, "</span>"),
                             F.when(size % 5 > 0, F.concat(F.lit('<a class="base-card__full-link" href="/view/'), key, F.lit('">x</a>'))).otherwise(F.lit("")), F.lit("</li>")),
    }
    names = F.array(*[F.lit(n) for n in cards])
    card = F.lit("")
    for name, html in cards.items():
        card = F.when(F.col("source") == name, html).otherwise(card)
    part = _t(spark, d, "part").withColumn("source", F.element_at(names, (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = part.select("source", F.floor(F.col("p_partkey") / (3 * CARDS_PER_PAGE)).cast("bigint").alias("page_num"), "p_partkey", card.alias("card"))
    return rows.groupBy("source", "page_num").agg(F.concat(
        F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), ""),
        F.lit("</body></html>")).alias("html")).select(
        "source", F.lit("parts").alias("query"), F.lit(0).alias("query_no"), "page_num", F.concat(F.lit("https://example.org/"), "source").alias("url"), "html")


def q_config_postings(spark, d):
    """Pages of three sources, one scan and one walk each; the configuration tables are the only other input."""
    from jobsmith.plans.run import collect_from_tables
    from jobsmith.sources.config import selectors_df, sources_df
    out = collect_from_tables(_source_pages(spark, d), sources_df(spark), selectors_df(spark))
    return out.select("source", F.col("ordinal.page_num").alias("page_num"), F.col("ordinal.card_no").alias("card_no"), "title", "company", "location", "salary", "url")


def q_extract_udtf(spark, d):
    """Extraction as a table function, called from SQL text over the stored pages."""
    import json
    from jobsmith.functions.udtf import register
    register(spark)
    _pages(spark, d).createOrReplaceTempView("stored_pages")
    config = json.dumps({"job_card": S.SKILL_CARD_SELECTORS, "title": S.CARD_TITLE_SELECTORS, **S.FIRST_FIELDS})
    return spark.sql("""SELECT page_id, CAST(c.card_rank AS BIGINT) AS card_rank, CAST(c.card_no AS BIGINT) AS card_no, c.title, c.company, c.location, c.salary, c.description,
                               CASE WHEN c.href LIKE '/%' THEN concat(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', 0), c.href) ELSE c.href END AS url,
                               'pages' AS source
                        FROM stored_pages, LATERAL extract_cards(html, :config) AS c""", args={"config": config})


def q_selector_samples(spark, d):
    """The first three hits of each selector over all pages."""
    return H.selector_first_hits(_pages(spark, d), S.SAMPLE_SELECTORS, 3)


def _detail_pages(spark, d) -> DataFrame:
    """A detail page per document: its text (some are empty), and for most a footer with a relative date."""
    n = (F.col("doc_id") % 7).cast("string")
    return _t(spark, d, "documents").select("doc_id", F.concat(
        F.lit('<html><body><div id="jobDescriptionText">'), F.when(F.col("doc_id") % 11 > 0, _escaped(F.coalesce(F.col("text"), F.lit("")))).otherwise(F.lit(" ")), F.lit("</div>"),
        F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit('<div class="page-footer">Posted '), n, F.lit(" days ago</div>"))).otherwise(F.lit("")),
        F.lit("</body></html>")).alias("html"))


def q_detail_extract(spark, d):
    """H6-H8 from one parse of each detail page."""
    return H.detail_extract(_detail_pages(spark, d), ["div#jobDescriptionText"], ["span.date"], S.DATE_WORDS,
                            keep=("doc_id",), footer_token="footer")


def q_enrich_from_pages(spark, d):
    """J5 from stored pages: postings without a description take text and date of their detail page."""
    docs = _t(spark, d, "documents")
    posts = doc_postings(docs).select("url", "ordinal", F.lit("").alias("description"), "posted_date")
    details = H.detail_extract(_detail_pages(spark, d), ["div#jobDescriptionText"], ["span.date"], S.DATE_WORDS,
                               keep=("doc_id",), footer_token="footer")
    details = details.withColumnRenamed("doc_id", "ordinal").join(posts.select("ordinal", F.col("url").alias("canonical_url")), "ordinal")
    out = en.enrich(posts, details, "url", "canonical_url", "ordinal")
    return out.select(F.col("ordinal").alias("doc_id"), F.length("description").cast("bigint").alias("description_len"), "posted_date", "success")


QUERIES = {
    "clean_text": q_clean_text,
    "contact_extract": q_contact_extract,
    "title_rule": q_title_rule,
    "location_rule": q_location_rule,
    "summary_lines": q_summary_lines,
    "skill_match": q_skill_match,
    "dictionary_match": q_dictionary_match,
    "company_match": q_company_match,
    "experience_years": q_experience_years,
    "education_degrees": q_education_degrees,
    "profile": q_profile,
    "search_terms": q_search_terms,
    "search_plan": q_search_plan,
    "assemble_text": q_assemble_text,
    "select_text": q_select_text,
    "extract_cards": q_extract_cards,
    "extract_postings": q_extract_postings,
    "page_links": q_page_links,
    "absolute_url": q_absolute_url,
    "url_key": q_url_key,
    "canonical_url": q_canonical_url,
    "interstitial_flag": q_interstitial_flag,
    "page_prefix": q_page_prefix,
    "description_pick": q_description_pick,
    "date_text_pick": q_date_text_pick,
    "footer_date": q_footer_date,
    "text_node_grep": q_text_node_grep,
    "source_line_grep": q_source_line_grep,
    "selector_hits": q_selector_hits,
    "dedup_keep_first": q_dedup_keep_first,
    "new_vs_history": q_new_vs_history,
    "history_append": q_history_append,
    "upsert": q_upsert,
    "upsert_fold": q_upsert_fold,
    "skip_enriched": q_skip_enriched,
    "enrich": q_enrich,
    "enrich_stats": q_enrich_stats,
    "enrich_upsert": q_enrich_upsert,
    "field_completeness": q_field_completeness,
    "progress_pct": q_progress_pct,
    "source_stats": q_source_stats,
    "running_total": q_running_total,
    "first_n": q_first_n,
    "sample_topk": q_sample_topk,
    "preview": q_preview,
    "record_profile": q_record_profile,
    "report_rows": q_report_rows,
    "report_summary": q_report_summary,
    "union_sources": q_union_sources,
    "consolidate": q_consolidate,
    "read_csv": q_read_csv,
    "read_csv_mixed": q_read_csv_mixed,
    "read_json": q_read_json,
    "sink_csv": q_sink_csv,
    "sink_json": q_sink_json,
    "stream_history": q_stream_history,
    "history_compacted": q_history_compacted,
    "stream_dedup": q_stream_dedup,
    "stream_dedup_watermark": q_stream_dedup_watermark,
    "stream_enrich": q_stream_enrich,
}


# ------------------------------------------------------------------ flagship

def normalized_url(url):
    """Drop query and fragment, scheme, a leading www./m. and a trailing slash."""
    u = F.regexp_replace(url, r"[?#].*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^(?:www\.|m\.)", "")
    return F.regexp_replace(u, r"/$", "")


def collect_run(pages: DataFrame) -> DataFrame:
    """Minimum slice end to end: pages -> h1 title -> drop untitled -> keep first per
    normalised url -> per-host found / kept counts."""
    # the extracted titles feed both the keep-first and the per-host counts: parse once
    titled = (cut_lineage(H.select_text(pages, {"title": ["h1"]}, keep=("page_id", "url")), "titles")
              .withColumn("norm_url", normalized_url(F.col("url")))
              .withColumn("host", tx.host_of(F.col("url"))))
    kept = idn.keep_first(titled.filter(F.col("title") != ""), "norm_url", "page_id").select(
        "page_id", F.lit(True).alias("kept"))
    flagged = titled.join(kept, "page_id", "left")
    return (flagged.groupBy("host")
            .agg(F.count("*").alias("n_pages"), F.count_if(F.col("title") != "").alias("n_titled"),
                 F.count_if(F.coalesce("kept", F.lit(False))).alias("n_kept")))


def q_collect_run(spark, d):
    return collect_run(_pages(spark, d))


QUERIES["collect_run"] = q_collect_run
QUERIES |= {"automated_run": q_automated_run, "automated_stats": q_automated_stats,
            "automated_history": q_automated_history, "manual_run": q_manual_run, "card_fields": q_card_fields,
            "link_cards": q_link_cards, "config_postings": q_config_postings, "extract_udtf": q_extract_udtf,
            "selector_samples": q_selector_samples, "upsert_map": q_upsert_map, "read_csv_rejects": q_read_csv_rejects,
            "manual_report": q_manual_report, "manual_summary": q_manual_summary, "report_title_terms": q_report_title_terms,
            "description_probe": q_description_probe, "dedup_composite": q_dedup_composite, "sink_guard": q_sink_guard,
            "stream_pages": q_stream_pages, "posting_source": q_posting_source, "stream_posting_source": q_stream_posting_source,
            "enrich_all": q_enrich_all, "enrich_all_stats": q_enrich_all_stats, "read_json_array": q_read_json_array, "json_variant": q_json_variant, "detail_extract": q_detail_extract, "enrich_from_pages": q_enrich_from_pages}
