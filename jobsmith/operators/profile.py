"""Text profile extraction (contacts, title, location, summary, skills, years,
companies, education, search terms) as column expressions over a text table.

All rules are ranked lists passed as arguments (defaults in ``fixed``); every
expression is a built-in (regexp / higher-order function), so a document table
of any size is a map-only stage with whole-stage codegen around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsmith.functions import fixed
from jobsmith.functions.text import first_line, first_match, py_strip, spark_regex


def email(text: Column, pattern: str = fixed.EMAIL_PATTERN) -> Column:
    """first match or ''. A cheap '@' test guards the regex scan (no '@', no match)."""
    t = F.coalesce(text, F.lit(""))
    rx = F.regexp_extract(t, spark_regex(pattern), 0)
    return F.when(t.contains("@"), rx).otherwise(F.lit("")) if "@" in pattern else rx


def phone(text: Column, pattern: str = fixed.PHONE_PATTERN) -> Column:
    """first match or ''."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), spark_regex(pattern), 0)


def contact_extract(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
                    mask: bool = False) -> DataFrame:
    """Name (first line, stripped), email, phone. ``mask`` hashes the personal data."""
    t = F.col(text_col)
    cols = {"name": first_line(t), "email": email(t), "phone": phone(t)}
    if mask:
        cols = {k: F.when(v != "", F.sha2(v, 256)).otherwise(v) for k, v in cols.items()}
    return df.select(*keep, *[v.alias(k) for k, v in cols.items()])


def location_rule(text: Column, patterns: Sequence[str] = tuple(fixed.LOCATION_PATTERNS)) -> Column:
    """first rule that matches (case-insensitive), matched text stripped; '' when none."""
    return F.coalesce(first_match(text, patterns, ignore_case=True, group=0), F.lit(""))


def search_location(location: Column, override: str | None = None,
                    primary: str = fixed.SEARCH_LOCATION_PRIMARY, country: str = fixed.SEARCH_LOCATION_COUNTRY,
                    default: str = fixed.SEARCH_LOCATION_DEFAULT) -> Column:
    """explicit override, else primary / country by (case-sensitive) containment, else as is."""
    if override:
        return F.lit(override)
    loc = F.coalesce(location, F.lit(""))
    return (F.when(loc.contains(primary), F.lit(primary))
            .when(loc.contains(country), F.lit(country))
            .when(loc != "", loc)
            .otherwise(F.lit(default)))


def title_rule(text: Column, patterns: Sequence[str] = tuple(fixed.TITLE_PATTERNS)) -> Column:
    """Rule rank beats text position; stripped whole match; '' when none."""
    return F.coalesce(first_match(text, patterns, ignore_case=True, group=0), F.lit(""))


def summary_lines(text: Column, headers: Sequence[str] = tuple(fixed.SUMMARY_HEADERS),
                  first: int = fixed.SUMMARY_FIRST_LINE, last: int = fixed.SUMMARY_LAST_LINE,
                  start_len: int = fixed.SUMMARY_START_LEN, cont_len: int = fixed.SUMMARY_CONT_LEN,
                  marks: Sequence[str] = tuple(fixed.SUMMARY_CONTACT_MARKS),
                  word: str = fixed.SUMMARY_CONTACT_WORD) -> Column:
    """a fold over lines ``first..last``.

    Empty lines are skipped; a line starting with a header (case-insensitive prefix)
    ends the scan; contact lines are skipped; a line longer than ``start_len`` is taken
    and opens the summary, after which lines longer than ``cont_len`` are taken too.
    """
    header_rx = spark_regex("^(?:" + "|".join(headers) + ")", ignore_case=True)
    raw = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), first, last - first + 1)

    def contact(line):
        c = F.lower(line).contains(word.lower())
        for m in marks:
            c = c | line.contains(m)
        return c

    # per-line facts once (strip, header test, contact test, length), then one left fold whose
    # step only reads the accumulator and the current element (no outer references, which
    # higher-order functions would re-evaluate for every element)
    facts = F.transform(F.transform(raw, py_strip), lambda l: F.struct(
        l.alias("l"), ((l != "") & l.rlike(header_rx)).alias("h"),
        ((l == "") | contact(l)).alias("skip"), F.length(l).alias("n")))
    init = F.struct(F.lit(False).alias("done"), F.lit(False).alias("ins"),
                    F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        take = F.struct(F.lit(False).alias("done"), F.lit(True).alias("ins"),
                        F.concat(acc["out"], F.array(x["l"])).alias("out"))
        stop = F.struct(F.lit(True).alias("done"), acc["ins"].alias("ins"), acc["out"].alias("out"))
        return (F.when(acc["done"] | (x["l"] == ""), acc)
                .when(x["h"], stop)
                .when(x["skip"], acc)
                .when(x["n"] > start_len, take)
                .when(acc["ins"] & (x["n"] > cont_len), take)
                .otherwise(acc))

    return F.array_join(F.aggregate(facts, init, step)["out"], " ")


def skill_match(text: Column, terms: Sequence[str] = tuple(fixed.SKILL_TERMS), lowered: bool = False) -> Column:
    """Case-insensitive substring test per term -> sorted distinct array.

    Unrolled ``when(contains)`` over the pre-sorted dictionary keeps the projection
    in whole-stage codegen (a lambda ``filter`` would not be), and the result is
    already in code-point order, so no sort runs per row. Pass an already
    lower-cased column with ``lowered=True`` (see ``with_skills``) so ``lower`` runs
    once per row instead of once per term.
    """
    lt = F.coalesce(text, F.lit("")) if lowered else F.lower(F.coalesce(text, F.lit("")))
    ordered = sorted(set(terms))
    return F.array_compact(F.array(*[F.when(lt.contains(t.lower()), F.lit(t)) for t in ordered]))


#: grams of a dictionary that are looked up inside a text's row
ROW_GRAMS = 1_000


def _at_least(k: int):
    return lambda g: F.length(g) >= k


def _head(k: int):
    return lambda g: F.substring(g, 1, k)


def dictionary_match(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text",
                     term: str = "term", ignore_case: bool = True, gram: int = 3, max_grams: int = 1_000_000) -> DataFrame:
    """J8/A9 for dictionaries too large to unroll: exact substring matching, no cartesian product.

    A term can only occur in a text that contains its first ``gram`` characters (or the whole
    term when it is shorter), so an equi-join on those grams yields every candidate
    (doc, term) pair; ``contains`` then verifies each candidate. Documents explode their
    distinct grams (linear in the text, one scan for all lengths); the dictionary's gram set, counted first,
    drops most of them: inside the row up to ``ROW_GRAMS``, by a broadcast join before the shuffle up to ``max_grams``. The text
    side is never broadcast, and a gram present in a third of all texts is a hot key that AQE splits.
    Returns (key, matched terms sorted, code-point order).
    """
    norm = F.lower if ignore_case else (lambda c: c)
    t = (terms.select(F.col(term).alias("__term")).filter(F.col("__term").isNotNull() & (F.col("__term") != ""))
         .distinct().withColumn("__lt", norm(F.col("__term"))))
    t = t.withColumn("__g", F.substring("__lt", 1, gram)).withColumn("__k", F.length("__g"))
    d = docs.select(F.col(key).alias("__key"), norm(F.coalesce(F.col(text), F.lit(""))).alias("__lt_doc"))
    # every place's longest gram in one native regex pass (zero-width lookahead capture), distinct before the shorter
    # ones are taken from its head: a text has far fewer distinct grams than places
    whole = d.select("__key", F.array_distinct(F.regexp_extract_all("__lt_doc", F.lit("(?s)(?=(.{1,%d}))" % gram), F.lit(1))).alias("__whole"))
    # a small gram set is met inside the row, before the grams become rows; a larger one by a broadcast join
    known = t.select("__k", "__g").distinct()
    n_known = known.limit(max_grams + 1).count()
    inside = known.collect() if n_known <= min(max_grams, ROW_GRAMS) else None
    found = [F.array().cast("array<struct<__k:int,__g:string>>")]
    for k in range(1, gram + 1):
        heads = F.transform(F.filter("__whole", _at_least(k)), _head(k))
        mine = [r["__g"] for r in inside or () if r["__k"] == k]
        if inside is None or mine:
            heads = F.array_distinct(heads) if inside is None else F.array_intersect(heads, F.array(*[F.lit(g) for g in mine]))
            found.append(F.transform(heads, lambda g: F.struct(F.length(g).alias("__k"), g.alias("__g"))))
    # (outer: for a plain explode Spark adds a filter on the array's size, which scans the text a second time; the
    # null rows of texts without a gram meet nothing in the joins)
    grams = whole.select("__key", F.explode_outer(F.concat(*found)).alias("x")).select("__key", "x.__k", "x.__g")
    empty = F.array().cast("array<struct<__term:string,__lt:string>>")
    # each term has exactly one (length, gram) key and grams are distinct per text, so the
    # candidate pairs are unique; they are collected per text (small rows, partial aggregate)
    # and verified inside the row after one join with the texts
    if inside is None and n_known <= max_grams:
        grams = grams.join(F.broadcast(known), ["__k", "__g"], "left_semi")
    cand = (grams.hint("merge").join(t, ["__k", "__g"]).groupBy("__key")
            .agg(F.collect_list(F.struct("__term", "__lt")).alias("__c")))
    j = d.join(cand, "__key", "left")
    ok = F.filter(F.coalesce(F.col("__c"), empty), lambda c: F.col("__lt_doc").contains(c["__lt"]))
    return j.select(F.col("__key").alias(key), F.array_sort(F.transform(ok, lambda c: c["__term"])).alias("terms"))


def with_skills(df: DataFrame, text_col: str = "text", out: str = "skills",
                terms: Sequence[str] = tuple(fixed.SKILL_TERMS)) -> DataFrame:
    """Skills as a column of ``df``: lower-case once in its own projection, then test terms."""
    return (df.withColumn("__lt", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
            .withColumn(out, skill_match(F.col("__lt"), terms, lowered=True)).drop("__lt"))


def company_match(text: Column, companies: Sequence[str] = tuple(fixed.KNOWN_COMPANIES)) -> Column:
    """Case-sensitive substring test, dictionary order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.contains(c), F.lit(c)) for c in companies]))


def experience_years(text: Column, patterns: Sequence[str] = tuple(fixed.EXPERIENCE_PATTERNS)) -> Column:
    """group 1 of the first rule that matches, as a number; 0 when none."""
    raw = first_match(F.coalesce(text, F.lit("")), patterns, ignore_case=True, group=1, strip=False)
    return F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint"))


def education_degrees(text: Column, section: str = fixed.EDUCATION_SECTION,
                      degrees: Sequence[str] = tuple(fixed.DEGREE_PATTERNS)) -> Column:
    """Section (lazy, dot-all, case-insensitive) then every degree match as
    "g1 g2" stripped, patterns in order, first occurrence kept."""
    t = F.coalesce(text, F.lit(""))
    sec_rx = spark_regex(section, ignore_case=True, dotall=True)
    sec = F.when(t.rlike(sec_rx), F.regexp_extract(t, sec_rx, 1)).otherwise(F.lit(""))
    parts = []
    for p in degrees:
        rx = F.lit(spark_regex(p, ignore_case=True))
        g1 = F.regexp_extract_all(sec, rx, F.lit(1))
        g2 = F.regexp_extract_all(sec, rx, F.lit(2))
        parts.append(F.zip_with(g1, g2, lambda a, b: py_strip(F.concat(a, F.lit(" "), b))))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def search_terms(title: Column, priority: Sequence[str] = tuple(fixed.PRIORITY_TITLES),
                 cap: int = fixed.SEARCH_TERMS_CAP, take: int | None = fixed.SEARCH_TERMS_DEFAULT) -> Column:
    """Fixed titles, own title first when new (exact case), cap, then first ``take``."""
    prio = F.array(*[F.lit(p) for p in priority])
    t = F.coalesce(title, F.lit(""))
    terms = F.when((t != "") & ~F.array_contains(prio, t), F.array_prepend(prio, t)).otherwise(prio)
    terms = F.slice(terms, 1, cap)
    return F.slice(terms, 1, take) if take else terms


def profile(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), **rules) -> DataFrame:
    """All of F9-F20 in one projection (one pass over the text)."""
    t = F.col(text_col)
    title = title_rule(t, rules.get("title_patterns", fixed.TITLE_PATTERNS))
    loc = location_rule(t, rules.get("location_patterns", fixed.LOCATION_PATTERNS))
    # what several rules read is worked out once, in a projection of its own
    df = df.withColumns({"__lt": F.lower(F.coalesce(t, F.lit(""))), "__title": title, "__loc": loc})
    title, loc = F.col("__title"), F.col("__loc")
    return df.select(
        *keep,
        first_line(t).alias("name"), email(t).alias("email"), phone(t).alias("phone"),
        loc.alias("location"), title.alias("title"),
        summary_lines(t, rules.get("headers", fixed.SUMMARY_HEADERS)).alias("summary"),
        skill_match(F.col("__lt"), rules.get("skills", fixed.SKILL_TERMS), lowered=True).alias("skills"),
        experience_years(t, rules.get("experience_patterns", fixed.EXPERIENCE_PATTERNS)).alias("experience_years"),
        company_match(t, rules.get("companies", fixed.KNOWN_COMPANIES)).alias("companies"),
        education_degrees(t).alias("education"),
        search_terms(title, take=None).alias("job_search_queries"),
        search_location(loc).alias("search_location"))


def assemble_text(pages: DataFrame, doc: str, seq: str, text: str = "text", block: int = 1024) -> DataFrame:
    """Ordered pages -> one text per document, empty pages skipped, joined by '\\n'.

    Two levels so no task collects an unbounded list: pages are first joined per
    (doc, seq // block) - at most ``block`` items - then the pieces per document.
    """
    src = pages.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    piece = (src.groupBy(doc, F.floor(F.col(seq) / block).alias("__b"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"),
                                                                                 F.col(text).alias("t")))),
                                           lambda x: x["t"]), "\n").alias("__p"),
                  F.count("*").alias("__n")))
    return (piece.groupBy(doc)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__p"))),
                                          lambda x: x["__p"]), "\n").alias("text"),
                 F.sum("__n").cast("bigint").alias("n_parts")))
