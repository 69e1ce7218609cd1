"""DuckDB SQL oracle for the registered queries (same column names and types).

Regex bodies come from the same rule lists through ``duck_regex`` (explicit
whitespace/digit classes, flags inline); HTML fields are read with flat-tag
regexes, tags stripped and the entities present in the data decoded.
"""

from __future__ import annotations

from jobsmith.functions import fixed
from jobsmith.functions.text import WS_CLASS, duck_regex
from jobsmith.plans import standins as S


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS_CLASS}+|{WS_CLASS}+$')}, '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {lit(WS_CLASS + '+')}, ' ', 'g'))"


def untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def decode(x: str) -> str:
    """The entities present in the data, decoded like Python's ``html.unescape``: these
    legacy names also decode without ';' ("&amp" -> "&"), unknown ones ("&am") stay;
    '&amp' last so a decoded '&' never starts a new entity."""
    v = x
    for ent, ch in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"),
                    ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("amp", "&")]:
        v = f"regexp_replace({v}, {lit('&' + ent + ';?')}, {lit(ch)}, 'g')"
    return v


def esc(x: str) -> str:
    v = x
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        v = f"replace({v}, {lit(a)}, {lit(b)})"
    return v


def first_line(x: str) -> str:
    return strip_(f"split_part(coalesce({x}, ''), chr(10), 1)")


def tag_inner(tag_open: str, tag_close: str) -> str:
    """Inner HTML of the first flat element (dot-all)."""
    return f"regexp_extract(html, {lit('(?s)' + tag_open + '(.*?)' + tag_close)}, 1)"


def tag_text(tag_open: str, tag_close: str) -> str:
    return clean(decode(untag(tag_inner(tag_open, tag_close))))


def has_tag(tag_open: str) -> str:
    return f"contains(html, {lit(tag_open)})"


def ranked_first(text: str, patterns, ignore_case=True, group=0, strip=True) -> str:
    parts = []
    for p in patterns:
        rx = lit(duck_regex(p, ignore_case))
        val = f"regexp_extract({text}, {rx}, {group})"
        parts.append(f"WHEN regexp_matches({text}, {rx}) THEN {strip_(val) if strip else val}")
    return "CASE " + " ".join(parts) + " END"


def doc_postings_sql(where: str = "") -> str:
    return f"""SELECT doc_id AS ordinal, {first_line('text')} AS title, source AS company, lang AS location,
        CASE WHEN n_chars % 3 = 0 THEN '€' || n_chars ELSE '' END AS salary, text AS description,
        CASE WHEN n_chars % 2 = 0 THEN 'day ' || n_chars % 30 ELSE '' END AS posted_date, {lit(S.DOC_URL_PREFIX)} || md5(text) AS url,
        source, lang AS search_query FROM documents {where}"""


P7 = ", ".join(fixed.POSTING_7)
P9 = ", ".join(fixed.POSTING_9)


def _skill_sql() -> tuple[str, str]:
    terms = sorted(set(fixed.SKILL_TERMS))
    whens = [f"CASE WHEN contains(lower(text), {lit(t.lower())}) THEN {lit(t)} END" for t in terms]
    ones = [f"(CASE WHEN contains(lower(text), {lit(t.lower())}) THEN 1 ELSE 0 END)" for t in terms]
    return "concat_ws(', ', " + ", ".join(whens) + ")", "(" + " + ".join(ones) + ")::BIGINT"


def _company_sql() -> tuple[str, str]:
    cs = fixed.KNOWN_COMPANIES
    whens = [f"CASE WHEN contains(text, {lit(c)}) THEN {lit(c)} END" for c in cs]
    ones = [f"(CASE WHEN contains(text, {lit(c)}) THEN 1 ELSE 0 END)" for c in cs]
    return "concat_ws(', ', " + ", ".join(whens) + ")", "(" + " + ".join(ones) + ")::BIGINT"


def _summary_sql(headers=None) -> str:
    hdr = lit(duck_regex("^(?:" + "|".join(headers or S.SUMMARY_HEADERS) + ")", True))
    contact = " OR ".join([f"contains(line, {lit(m)})" for m in fixed.SUMMARY_CONTACT_MARKS]
                          + [f"contains(lower(line), {lit(fixed.SUMMARY_CONTACT_WORD)})"])
    first, last = fixed.SUMMARY_FIRST_LINE, fixed.SUMMARY_LAST_LINE
    return f"""
WITH l AS (
  SELECT doc_id, k, {strip_('string_split(coalesce(text, \'\'), chr(10))[k]')} AS line
  FROM (SELECT doc_id, text, unnest(range({first}, least(len(string_split(coalesce(text, ''), chr(10))), {last}) + 1)) AS k
        FROM documents)),
f AS (
  SELECT *, regexp_matches(line, {hdr}) AND line <> '' AS is_hdr, ({contact}) AS is_contact FROM l),
s AS (
  SELECT doc_id, min(k) FILTER (WHERE is_hdr) AS stop_k FROM f GROUP BY doc_id),
c AS (
  SELECT f.* FROM f JOIN s USING (doc_id)
  WHERE line <> '' AND (s.stop_k IS NULL OR f.k < s.stop_k) AND NOT is_contact),
o AS (
  SELECT doc_id, min(k) FILTER (WHERE length(line) > {fixed.SUMMARY_START_LEN}) AS open_k FROM c GROUP BY doc_id),
t AS (
  SELECT c.doc_id, string_agg(line, ' ' ORDER BY k) AS summary FROM c JOIN o USING (doc_id)
  WHERE length(line) > {fixed.SUMMARY_START_LEN} OR (o.open_k IS NOT NULL AND k > o.open_k AND length(line) > {fixed.SUMMARY_CONT_LEN})
  GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(t.summary, '') AS summary FROM documents d LEFT JOIN t USING (doc_id)"""


def _education_sql(section=None, rules=None) -> str:
    sec_rx = lit(duck_regex(section or S.EDUCATION_SECTION, True, True))
    sec = f"CASE WHEN regexp_matches(text, {sec_rx}) THEN regexp_extract(text, {sec_rx}, 1) ELSE '' END"
    lists = []
    for p in rules or S.DEGREE_RULES:
        rx = lit(duck_regex(p, True))
        g1 = f"regexp_extract_all(sec, {rx}, 1)"
        g2 = f"regexp_extract_all(sec, {rx}, 2)"
        lists.append(f"list_transform(range(1, len({g1}) + 1), lambda i: {strip_(f'{g1}[i] || {lit(' ')} || {g2}[i]')})")
    allv = "list_concat(" + ", ".join(lists) + ")" if len(lists) > 1 else lists[0]
    return f"""
WITH a AS (SELECT doc_id, {allv} AS l FROM (SELECT doc_id, {sec} AS sec FROM documents)),
b AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS e FROM a)
SELECT doc_id, array_to_string(e, ' | ') AS education, len(e)::BIGINT AS n_degrees FROM b"""


def _search_plan_sql() -> str:
    rows = []
    for i, s in enumerate(fixed.SOURCE_ORDER):
        cfg = fixed.SOURCES[s]
        rows.append(f"({lit(s)}, {i}, {lit(cfg['base_url'])}, {cfg['page_size']}, {lit(cfg['page_mode'])})")
    loc = lit(S.SEARCH_LOCATION)
    url_cases = []
    for s in fixed.SOURCE_ORDER:
        cfg = fixed.SOURCES[s]
        tpl = cfg["search_url"]
        start = "((page_no - 1) * page_size)::VARCHAR" if cfg["page_mode"] == "offset" else "NULL"
        expr = lit(tpl)
        for ph, val in [("{base}", lit(cfg["base_url"])), ("{query}", "p_name"), ("{location}", loc),
                        ("{start}", start), ("{page}", "page_no::VARCHAR")]:
            if ph in tpl:
                expr = f"replace({expr}, {lit(ph)}, {val})"
        url_cases.append(f"WHEN source = {lit(s)} THEN {expr}")
    return f"""
SELECT p_partkey::BIGINT AS query_no, p_name AS query, source, source_no::BIGINT AS source_no, page_no::BIGINT AS page_no,
  CASE WHEN page_mode = 'offset' THEN ((page_no - 1) * page_size)::BIGINT END AS start,
  CASE {' '.join(url_cases)} END AS search_url
FROM part, (VALUES {', '.join(rows)}) s(source, source_no, base_url, page_size, page_mode),
     (SELECT unnest(range(1, {S.SEARCH_PAGES} + 1)) AS page_no) p"""


def _select_text_sql() -> str:
    return f"""SELECT page_id,
  {tag_text('<title>', '</title>')} AS title, {tag_text('<h1>', '</h1>')} AS h1,
  {tag_text('<footer>', '</footer>')} AS footer, {tag_text('<div class="ad">', '</div>')} AS ad FROM pages"""


LI_ITEMS = "regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)"
BASE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def _cards_sql() -> str:
    return f"""
WITH x AS (SELECT page_id, {LI_ITEMS} AS l FROM pages),
y AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM x)
SELECT page_id, 1::BIGINT AS card_rank, (i - 1)::BIGINT AS card_no, {clean(decode(untag('l[i]')))} AS card_text FROM y"""


def _postings_sql() -> str:
    href = decode("regexp_extract(l[i], '<a href=\"([^\"]*)\"', 1)")
    title = clean(decode(untag("regexp_extract(l[i], '(?s)<a[^>]*>(.*?)</a>', 1)")))
    return f"""
WITH x AS (SELECT page_id, url AS page_url, {LI_ITEMS} AS l FROM pages),
y AS (SELECT page_id, page_url, l, unnest(range(1, len(l) + 1)) AS i FROM x),
z AS (SELECT page_id, page_url, (i - 1)::BIGINT AS card_no, {title} AS title, {href} AS href FROM y)
SELECT page_id, 1::BIGINT AS card_rank, card_no, title, '' AS company, '' AS location, '' AS salary,
  '' AS description,
  coalesce(CASE WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
           ELSE href END, '') AS url,
  'pages' AS source
FROM z WHERE title <> ''"""


HREFS = "regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)"


def _page_links_sql() -> str:
    return f"""SELECT page_id, len({HREFS})::BIGINT AS n_links,
  len(list_filter({HREFS}, lambda h: contains(lower(h), {lit(S.LINK_TOKEN)})))::BIGINT AS n_token_links FROM pages"""


def _absolute_sql() -> str:
    return f"""
WITH x AS (SELECT page_id, url, {HREFS} AS l FROM pages),
y AS (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM x)
SELECT page_id, (i - 1)::BIGINT AS link_no, {decode('l[i]')} AS href,
  CASE WHEN starts_with({decode('l[i]')}, '/') THEN {BASE} || {decode('l[i]')} ELSE {decode('l[i]')} END AS abs_url FROM y"""


def _url_key_sql() -> str:
    strict = f"[?&]{S.URL_KEY_PARAM}=([a-f0-9]+)"
    loose = f"{S.URL_KEY_PARAM}=([^&]*)"
    return f"""SELECT page_id,
  CASE WHEN regexp_matches(url, {lit(strict)}) THEN regexp_extract(url, {lit(strict)}, 1) END AS key_strict,
  CASE WHEN contains(url, {lit(S.URL_KEY_PARAM + '=')}) THEN regexp_extract(url, {lit(loose)}, 1) END AS key_loose FROM pages"""


def _canonical_sql() -> str:
    strict = f"[?&]{S.URL_KEY_PARAM}=([a-f0-9]+)"
    pre, _, post = S.CLEAN_URL_FORMAT.partition("{key}")
    return f"""SELECT page_id, CASE WHEN regexp_matches(url, {lit(strict)})
  THEN {lit(pre)} || regexp_extract(url, {lit(strict)}, 1) || {lit(post)} ELSE url END AS canonical_url FROM pages"""


def _interstitial_sql() -> str:
    a = " AND ".join(f"contains(lower(html), {lit(t)})" for t in S.INTERSTITIAL_ALL)
    o = " OR ".join(f"contains(lower(html), {lit(t)})" for t in S.INTERSTITIAL_ANY)
    u = " OR ".join(f"contains(url, {lit(t)})" for t in S.INTERSTITIAL_URL)
    return f"SELECT page_id, ({a}) AS flag_all, ({o}) AS flag_any, ({u}) AS flag_url FROM pages"


def _page_prefix_sql() -> str:
    return f"""
WITH c AS (SELECT page_id, {HOST} AS host, len(regexp_extract_all(html, '<b>', 0))::BIGINT AS n_cards FROM pages),
s AS (SELECT host, min(page_id) AS stop FROM c WHERE n_cards = 0 GROUP BY host)
SELECT c.host, c.page_id, c.n_cards FROM c LEFT JOIN s USING (host) WHERE s.stop IS NULL OR c.page_id < s.stop"""


def _fields_sql() -> str:
    return f"""SELECT page_id,
  {has_tag('<div class="ad">')} AS has_ad, {tag_text('<div class="ad">', '</div>')} AS ad,
  {has_tag('<article>')} AS has_article, {tag_text('<article>', '</article>')} AS article,
  {has_tag('<footer>')} AS has_footer, {tag_text('<footer>', '</footer>')} AS footer,
  {has_tag('<h1>')} AS has_h1, {tag_text('<h1>', '</h1>')} AS h1 FROM pages"""


def _description_sql() -> str:
    n = fixed.DESCRIPTION_MIN_LEN
    return f"""
WITH f AS ({_fields_sql()})
SELECT page_id,
  CASE WHEN has_ad AND length(ad) > {n} THEN ad WHEN has_article AND length(article) > {n} THEN article
       WHEN has_footer AND length(footer) > {n} THEN footer ELSE '' END AS description,
  CASE WHEN (has_ad AND length(ad) > {n}) OR (has_article AND length(article) > {n}) OR (has_footer AND length(footer) > {n})
       THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN (has_ad AND length(ad) > {n}) OR (has_article AND length(article) > {n}) OR (has_footer AND length(footer) > {n})
       THEN NULL
       WHEN coalesce(CASE WHEN has_footer THEN footer WHEN has_article THEN article WHEN has_ad THEN ad END, '') = ''
       THEN {lit(fixed.DESCRIPTION_ERROR)} END AS error,
  CASE WHEN has_ad AND length(ad) > {n} THEN 1 WHEN has_article AND length(article) > {n} THEN 2
       WHEN has_footer AND length(footer) > {n} THEN 3 END::BIGINT AS rank
FROM f"""


def _date_pick_sql() -> str:
    def ok(c):
        return "(" + " OR ".join(f"contains(lower({c}), {lit(w)})" for w in S.DATE_WORDS) + ")"
    return f"""
WITH f AS ({_fields_sql()})
SELECT page_id, CASE WHEN has_ad AND {ok('ad')} THEN ad WHEN has_h1 AND {ok('h1')} THEN h1
  WHEN has_footer AND {ok('footer')} THEN footer ELSE '' END AS posted_date FROM f"""


def _footer_date_sql() -> str:
    rx = lit(duck_regex(S.FOOTER_DATE_RULE, True))
    ad = tag_text('<div class="ad">', '</div>')
    return f"SELECT page_id, coalesce({strip_(f'regexp_extract({ad}, {rx}, 0)')}, '') AS posted_date FROM pages"


def _source_line_sql() -> str:
    tok = " OR ".join([f"contains(x, {lit(t)})" for t in S.SOURCE_LINE_TOKENS]
                      + [f"contains(lower(x), {lit(t.lower())})" for t in S.SOURCE_LINE_LOWER_TOKENS])
    guard = " OR ".join([f"contains(html, {lit(t)})" for t in S.SOURCE_LINE_TOKENS + S.SOURCE_LINE_LOWER_TOKENS])
    first = f"list_filter(string_split(html, chr(10)), lambda x: {tok})[1]"
    return f"SELECT page_id, CASE WHEN {guard} THEN substring({strip_(first)}, 1, {fixed.SOURCE_LINE_PREVIEW}) END AS line FROM pages"


def _selector_hits_sql() -> str:
    specs = {
        "li": ("<li>", "</li>", "<li>"), "a": ("<a [^>]*>", "</a>", "<a[ >]"),
        "div.ad": ('<div class="ad">', "</div>", '<div class="ad">'), "footer": ("<footer>", "</footer>", "<footer>"),
        "h1": ("<h1>", "</h1>", "<h1>"), "title": ("<title>", "</title>", "<title>"), "nav": ("<nav>", "</nav>", "<nav>"),
        "span.date": ('<span class="date">', "</span>", '<span class="date">'),
    }
    parts = []
    for sel in S.HIT_SELECTORS:
        o, c, start = specs[sel]
        n = f"len(regexp_extract_all(html, {lit(start)}, 0))"
        txt = clean(decode(untag(f"regexp_extract(html, {lit('(?s)' + o + '(.*?)' + c)}, 1)")))
        parts.append(f"""SELECT {lit(sel)} AS selector, count(*) FILTER (WHERE {n} > 0)::BIGINT AS pages_hit,
  coalesce(sum({n}), 0)::BIGINT AS elements,
  count(*) FILTER (WHERE {n} > 0 AND length({txt}) > {fixed.DESCRIPTION_MIN_LEN})::BIGINT AS pages_accepted FROM pages""")
    return "\nUNION ALL\n".join(parts)


def _enrich_cte() -> str:
    return f"""
posts AS (SELECT ordinal, url, CASE WHEN location = 'en' THEN description ELSE '' END AS description, posted_date
          FROM ({doc_postings_sql()})),
state AS (SELECT ordinal, url, description, posted_date FROM ({doc_postings_sql("WHERE lang IN ('en', 'de')")})),
details AS (SELECT p.url AS canonical_url, p.ordinal, p.description, 'quality ' || l.quality::VARCHAR AS posted_date,
                   CASE WHEN l.quality = 1 THEN 'success' ELSE 'failed' END AS status
            FROM ({doc_postings_sql()}) p JOIN labels l ON l.doc_id = p.ordinal
            QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY p.ordinal) = 1),
done AS (SELECT url FROM state QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1
         AND length(description) > {fixed.ENRICHED_MIN_LEN}),
flags AS (SELECT p.*, p.url IN (SELECT url FROM done) AS skipped FROM posts p),
enriched AS (SELECT f.ordinal, f.url,
                    CASE WHEN d.status = 'success' THEN d.description ELSE f.description END AS description,
                    CASE WHEN d.status = 'success' THEN d.posted_date ELSE f.posted_date END AS posted_date,
                    coalesce(d.status = 'success', false) AS success
             FROM flags f LEFT JOIN details d ON d.canonical_url = f.url WHERE NOT f.skipped)"""


def _run_cte() -> str:
    """Exact sequential skip rule: after the first processed posting per url whose result is
    longer than the threshold, later postings with that url are skipped."""
    return f"""{_enrich_cte()},
firstlong AS (SELECT url, min(ordinal) AS fl FROM enriched
              WHERE coalesce(length(description) > {fixed.ENRICHED_MIN_LEN}, false) GROUP BY url),
processed AS (SELECT e.* FROM enriched e LEFT JOIN firstlong f USING (url) WHERE f.fl IS NULL OR e.ordinal <= f.fl),
n_later AS (SELECT count(*) AS n FROM enriched e JOIN firstlong f USING (url) WHERE e.ordinal > f.fl)"""


def _enrich_stats_sql() -> str:
    return f"""
WITH {_run_cte()},
per_key AS (SELECT url, count(*) AS n, url IN (SELECT url FROM state) AS hit FROM processed GROUP BY url)
SELECT
  (SELECT count(*) FILTER (WHERE skipped) FROM flags) + (SELECT n FROM n_later)
    + (SELECT count(*) FILTER (WHERE success) FROM processed) AS success,
  (SELECT count(*) FILTER (WHERE NOT success) FROM processed) AS failed,
  (SELECT count(*) FILTER (WHERE skipped) FROM flags) + (SELECT n FROM n_later) AS skipped,
  (SELECT coalesce(sum(CASE WHEN hit THEN n ELSE n - 1 END), 0)::BIGINT FROM per_key) AS updated,
  (SELECT coalesce(sum(CASE WHEN hit THEN 0 ELSE 1 END), 0)::BIGINT FROM per_key) AS new"""


def _enrich_upsert_sql() -> str:
    return f"""
WITH {_run_cte()},
firsts AS (SELECT url, min(ordinal) AS first_ord FROM state GROUP BY url),
folded AS (SELECT url, min(ordinal) AS ordinal,
                  arg_max(description, ordinal) FILTER (WHERE description IS NOT NULL) AS description,
                  arg_max(posted_date, ordinal) FILTER (WHERE posted_date IS NOT NULL) AS posted_date
           FROM processed GROUP BY url),
u AS (SELECT folded.*, firsts.first_ord FROM folded LEFT JOIN firsts USING (url))
SELECT coalesce(s.url, u.url) AS url, CASE WHEN s.ordinal IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS origin,
  coalesce(s.ordinal, u.ordinal) AS ordinal,
  length(CASE WHEN u.url IS NOT NULL THEN coalesce(u.description, s.description) ELSE s.description END)::BIGINT AS description_len,
  CASE WHEN u.url IS NOT NULL THEN coalesce(u.posted_date, s.posted_date) ELSE s.posted_date END AS posted_date,
  (s.ordinal IS NOT NULL AND u.url IS NOT NULL) AS was_updated
FROM state s FULL OUTER JOIN u ON s.url = u.url AND s.ordinal = u.first_ord"""


def _flagged_cte() -> str:
    return """flagged AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(k.doc_id IS NOT NULL, false) AS is_new
  FROM documents d LEFT JOIN (
    SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''
      AND text NOT IN (SELECT d2.text FROM documents d2 SEMI JOIN labels l ON d2.doc_id = l.doc_id)
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) k USING (doc_id))"""


def _record_profile_sql() -> str:
    """Python truthiness: '', NULL and numeric 0 print as the empty mark."""
    cols = [("doc_id", "num"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "num")]
    w = fixed.PREVIEW_WIDTHS["profile"]
    parts = []
    for i, (c, kind) in enumerate(cols):
        falsy = f"({c} IS NULL OR {c} = 0)" if kind == "num" else f"coalesce({c}, '') = ''"
        parts.append(f"SELECT {i}::BIGINT AS field_no, {lit(c)} AS field, CASE WHEN {falsy} THEN "
                     f"{lit(fixed.EMPTY_MARK)} ELSE substring({c}::VARCHAR, 1, {w}) END AS preview FROM f")
    return f"WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1) {' UNION ALL '.join(parts)}"


def _report_rows_sql() -> str:
    d = fixed.REPORT_DEFAULTS
    title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    return f"""SELECT page_id, {esc(HOST)} AS source, {esc('url')} AS url, {esc(title)} AS title,
  {esc(lit(d['company']))} AS company, {esc(lit(d['location']))} AS location, {esc("''")} AS salary,
  substring({esc('html')}, 1, {fixed.REPORT_DESCRIPTION_CUT}) || {lit(fixed.REPORT_ELLIPSIS)} AS description FROM pages"""


def _report_summary_sql() -> str:
    return f"""SELECT strftime(DATE {lit(S.RUN_DATE)}, '%Y-%m-%d') AS report_date, {esc(lit(S.REPORT_QUERY))} AS query,
  {esc(lit(S.REPORT_LOCATION))} AS location, count(*)::BIGINT AS total_jobs FROM pages HAVING count(*) > 0"""


def _history_append_sql() -> str:
    return f"""
WITH posts AS ({doc_postings_sql()}),
old AS (SELECT url, title, source, {lit(S.HISTORY_TS)} AS first_seen
        FROM ({doc_postings_sql('SEMI JOIN labels USING (doc_id)')})
        WHERE url IS NOT NULL AND url <> ''
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1),
new AS (SELECT url, title, source, {lit(S.RUN_TS)} AS first_seen FROM posts
        WHERE url IS NOT NULL AND url <> '' AND url NOT IN (SELECT url FROM old)
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new"""


def _union_sources_sql() -> str:
    p = doc_postings_sql()
    return f"""
WITH p AS ({p}),
u AS (SELECT ordinal, title, url, source FROM p WHERE location = 'en'
      UNION ALL BY NAME SELECT ordinal, title, url, salary FROM p WHERE location = 'de'
      UNION ALL BY NAME SELECT ordinal, title, company, url FROM p WHERE location = 'es'
      UNION ALL BY NAME SELECT ordinal, title, description, url FROM p WHERE location = 'fr'
      UNION ALL BY NAME SELECT ordinal, title, url FROM p WHERE location IS NULL OR location NOT IN ('en', 'de', 'es', 'fr'))
SELECT ordinal, {', '.join((f"coalesce({c}, '') AS {c}" if c != 'location' else "'' AS location")
                            for c in fixed.POSTING_7)} FROM u"""


def _csv_sql(cols) -> str:
    return f"SELECT {', '.join(cols)} FROM ({doc_postings_sql()})"


def _upsert_sql() -> str:
    off = S.NEW_ID_OFFSET
    return f"""
WITH s AS (SELECT doc_id, doc_id AS ordinal, n_chars::BIGINT AS n_chars, NULL::BIGINT AS quality, NULL::BIGINT AS toxic FROM documents),
u AS (SELECT doc_id, doc_id AS ordinal, NULL::BIGINT AS n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels
      UNION ALL
      SELECT doc_id + {off}, doc_id + {off}, NULL::BIGINT, quality::BIGINT, toxic::BIGINT FROM labels WHERE toxic = 1)
SELECT coalesce(s.doc_id, u.doc_id) AS doc_id, CASE WHEN s.doc_id IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS origin,
  coalesce(s.ordinal, u.ordinal) AS ordinal, coalesce(u.n_chars, s.n_chars) AS n_chars,
  coalesce(u.quality, s.quality) AS quality, coalesce(u.toxic, s.toxic) AS toxic,
  (s.doc_id IS NOT NULL AND u.doc_id IS NOT NULL) AS was_updated
FROM s FULL OUTER JOIN u ON s.doc_id = u.doc_id"""


def build() -> dict[str, str]:
    skills, n_skills = _skill_sql()
    comps, n_comps = _company_sql()
    ws_strip_first = first_line("text")
    loc = f"coalesce({ranked_first('text', S.LOCATION_RULES)}, '')"
    p, c = lit(S.LOCATION_PRIMARY), lit(S.LOCATION_COUNTRY)
    exp = ranked_first("coalesce(text, '')", S.EXPERIENCE_RULES, True, 1, strip=False)
    prio = "[" + ", ".join(lit(t) for t in fixed.PRIORITY_TITLES) + "]"
    terms = (f"list_slice(list_slice(CASE WHEN p_type <> '' AND NOT list_contains({prio}, p_type) "
             f"THEN list_prepend(p_type, {prio}) ELSE {prio} END, 1, {fixed.SEARCH_TERMS_CAP}), 1, {fixed.SEARCH_TERMS_DEFAULT})")
    ev_cols = ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = {lit(t)}) AS {t}" for t in ('click', 'error', 'purchase', 'signup', 'view'))
    return {
        "clean_text": f"SELECT doc_id, {clean('text')} AS text_clean FROM documents",
        "contact_extract": f"""SELECT doc_id, {ws_strip_first} AS name,
            regexp_extract(coalesce(text, ''), {lit(duck_regex(fixed.EMAIL_PATTERN))}, 0) AS email,
            regexp_extract(coalesce(text, ''), {lit(duck_regex(fixed.PHONE_PATTERN))}, 0) AS phone FROM documents""",
        "title_rule": f"SELECT doc_id, coalesce({ranked_first('text', S.TITLE_RULES)}, '') AS title FROM documents",
        "location_rule": f"""SELECT doc_id, location, CASE WHEN contains(location, {p}) THEN {p}
            WHEN contains(location, {c}) THEN {c} WHEN location <> '' THEN location ELSE {lit(fixed.SEARCH_LOCATION_DEFAULT)} END
            AS search_location FROM (SELECT doc_id, {loc} AS location FROM documents)""",
        "summary_lines": _summary_sql(),
        "skill_match": f"SELECT doc_id, {skills} AS skills, {n_skills} AS n_skills FROM documents",
        "company_match": f"SELECT doc_id, {comps} AS companies, {n_comps} AS n_companies FROM documents",
        "experience_years": f"SELECT doc_id, coalesce(TRY_CAST({exp} AS BIGINT), 0)::BIGINT AS experience_years FROM documents",
        "education_degrees": _education_sql(),
        "search_terms": f"""SELECT p_partkey, p_type AS title, array_to_string({terms}, '|') AS terms,
            len({terms})::BIGINT AS n_terms FROM part""",
        "search_plan": _search_plan_sql(),
        "assemble_text": """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*)::BIGINT AS n_parts
            FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id""",
        "select_text": _select_text_sql(),
        "extract_cards": _cards_sql(),
        "extract_postings": _postings_sql(),
        "page_links": _page_links_sql(),
        "absolute_url": _absolute_sql(),
        "url_key": _url_key_sql(),
        "canonical_url": _canonical_sql(),
        "interstitial_flag": _interstitial_sql(),
        "page_prefix": _page_prefix_sql(),
        "description_pick": _description_sql(),
        "date_text_pick": _date_pick_sql(),
        "footer_date": _footer_date_sql(),
        "source_line_grep": _source_line_sql(),
        "selector_hits": _selector_hits_sql(),
        "dedup_keep_first": """SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND text <> ''
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
        "new_vs_history": """SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND text <> ''
            AND text NOT IN (SELECT d2.text FROM documents d2 SEMI JOIN labels l ON d2.doc_id = l.doc_id)
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
        "history_append": _history_append_sql(),
        "upsert": _upsert_sql(),
        "upsert_fold": f"SELECT user_id, min(event_id) AS ordinal, {ev_cols} FROM events GROUP BY user_id",
        "skip_enriched": f"WITH {_enrich_cte()} SELECT ordinal AS doc_id, url FROM flags WHERE NOT skipped",
        "enrich": f"""WITH {_enrich_cte().replace('WHERE NOT f.skipped', '')}
            SELECT ordinal AS doc_id, url, description, posted_date, success FROM enriched""",
        "enrich_stats": _enrich_stats_sql(),
        "enrich_upsert": _enrich_upsert_sql(),
        "field_completeness": f"""SELECT source, count(*) AS n,
            count(*) FILTER (WHERE coalesce(length(text) > 0, false)) AS desc_nonempty,
            count(*) FILTER (WHERE coalesce(length({strip_('text')}) > 20, false)) AS desc_gt20_stripped,
            count(*) FILTER (WHERE coalesce(length(text) > {fixed.DESCRIPTION_MIN_LEN}, false)) AS desc_gt50,
            count(*) FILTER (WHERE coalesce(length(text) > {fixed.ENRICHED_MIN_LEN}, false)) AS desc_gt100,
            count(*) FILTER (WHERE quality IS NOT NULL) AS labeled,
            count(*) FILTER (WHERE quality = 1) AS quality_ok
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
        "progress_pct": f"""WITH t AS (SELECT count(*)::BIGINT AS total FROM documents),
            u AS (SELECT count(*) FILTER (WHERE length(text) > {fixed.ENRICHED_MIN_LEN})::BIGINT AS done,
                         count(*) FILTER (WHERE toxic = 1)::BIGINT AS with_date
                  FROM documents JOIN labels USING (doc_id))
            SELECT total, done, with_date,
              CASE WHEN total > 0 THEN (done / total) * 100.0 ELSE 0.0 END::DOUBLE AS pct,
              format('{{:.1f}}', CASE WHEN total > 0 THEN (done / total) * 100.0 ELSE 0.0 END::DOUBLE) AS pct_label,
              (total - done)::BIGINT AS remaining FROM t, u""",
        "source_stats": f"""WITH {_flagged_cte()} SELECT source, lang AS search_query, count(*) AS found,
            count(*) FILTER (WHERE is_new) AS new, (count(*) - count(*) FILTER (WHERE is_new)) AS dup
            FROM flagged GROUP BY source, lang""",
        "running_total": f"""WITH {_flagged_cte()},
            per AS (SELECT lang AS query, count(*) FILTER (WHERE is_new) AS n_new FROM flagged GROUP BY lang)
            SELECT dense_rank() OVER (ORDER BY query)::BIGINT AS query_no, query, n_new,
              sum(n_new) OVER (ORDER BY query ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS so_far,
              row_number() OVER (ORDER BY query)::BIGINT AS position, count(*) OVER ()::BIGINT AS of_n FROM per""",
        "first_n": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10",
        "sample_topk": f"""SELECT doc_id, rpad(substring({ws_strip_first}, 1, 50), 50, ' ') AS title50,
            format('{{:,}}', length(text)) AS len_label FROM documents
            WHERE coalesce(length(text) > {fixed.ENRICHED_MIN_LEN}, false) ORDER BY doc_id LIMIT 5""",
        "preview": f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN {lit(fixed.EMPTY_MARK)} ELSE substring(text, 1, 100) END AS p100,
            substring(text, 1, 350) || '...' AS p350, substring(text, 1, 500) AS p500 FROM documents""",
        "record_profile": _record_profile_sql(),
        "report_rows": _report_rows_sql(),
        "report_summary": _report_summary_sql(),
        "union_sources": _union_sources_sql(),
        "consolidate": f"""SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in fixed.POSTING_9)} FROM ({doc_postings_sql()})
            WHERE url IS NOT NULL AND url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1""",
        "read_csv": _csv_sql(fixed.POSTING_7),
        "read_json": _csv_sql(fixed.POSTING_9),
        "sink_csv": f"""SELECT {', '.join(c for c in fixed.POSTING_7)}, strftime(DATE {lit(S.RUN_DATE)}, '%Y%m%d') AS run_date
            FROM ({doc_postings_sql()})""",
        "sink_json": f"""SELECT {P9} FROM ({doc_postings_sql()}) WHERE url <> ''
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1""",
    }


ORACLE = build()


def _collect_run_sql() -> str:
    norm = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), "
            "'^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^(?:www\\.|m\\.)', ''), '/$', '')")
    return f"""
WITH t AS (SELECT page_id, {HOST} AS host, {norm} AS norm_url, {tag_text('<h1>', '</h1>')} AS title FROM pages),
k AS (SELECT page_id FROM t WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY norm_url ORDER BY page_id) = 1)
SELECT host, count(*) AS n_pages, count(*) FILTER (WHERE title <> '') AS n_titled,
  count(*) FILTER (WHERE page_id IN (SELECT page_id FROM k)) AS n_kept FROM t GROUP BY host"""


def _text_node_sql() -> str:
    """Single-line pages: a text node's parent is the opening tag right before it."""
    rx = lit("<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>([^<]+)")
    tok = " OR ".join(f"contains(t, {lit(x)})" for x in S.TEXT_NODE_TOKENS)
    return f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, {rx}, 1) AS tags, regexp_extract_all(html, {rx}, 2) AS attrs,
                  regexp_extract_all(html, {rx}, 3) AS texts FROM pages),
y AS (SELECT page_id, tags, attrs, texts, unnest(range(1, len(tags) + 1)) AS i FROM x),
z AS (SELECT page_id, lower(tags[i]) AS tag, attrs[i] AS attr, {decode('texts[i]')} AS t FROM y)
SELECT page_id, CASE WHEN tag IN ('script', 'style') THEN 'raw' ELSE 'text' END AS kind, tag AS parent_tag,
  regexp_extract(attr, 'class="([^"]*)"', 1) AS parent_cls, substring({strip_('t')}, 1, {fixed.TEXT_NODE_PREVIEW}) AS text
FROM z WHERE {tok}"""


def _profile_sql() -> str:
    skills, _ = _skill_sql()
    comps, _ = _company_sql()
    title = f"coalesce({ranked_first('text', fixed.TITLE_PATTERNS)}, '')"
    loc = f"coalesce({ranked_first('text', fixed.LOCATION_PATTERNS)}, '')"
    exp = ranked_first("coalesce(text, '')", fixed.EXPERIENCE_PATTERNS, True, 1, strip=False)
    prio = "[" + ", ".join(lit(t) for t in fixed.PRIORITY_TITLES) + "]"
    terms = (f"list_slice(CASE WHEN title <> '' AND NOT list_contains({prio}, title) "
             f"THEN list_prepend(title, {prio}) ELSE {prio} END, 1, {fixed.SEARCH_TERMS_CAP})")
    p, c, dflt = (lit(fixed.SEARCH_LOCATION_PRIMARY), lit(fixed.SEARCH_LOCATION_COUNTRY),
                  lit(fixed.SEARCH_LOCATION_DEFAULT))
    return f"""
WITH b AS (SELECT doc_id, text, {first_line('text')} AS name,
             CASE WHEN contains(coalesce(text, ''), '@')
                  THEN regexp_extract(coalesce(text, ''), {lit(duck_regex(fixed.EMAIL_PATTERN))}, 0) ELSE '' END AS email,
             regexp_extract(coalesce(text, ''), {lit(duck_regex(fixed.PHONE_PATTERN))}, 0) AS phone,
             {loc} AS location, {title} AS title, {skills} AS skills,
             coalesce(TRY_CAST({exp} AS BIGINT), 0)::BIGINT AS experience_years, {comps} AS companies FROM documents),
s AS ({_summary_sql(fixed.SUMMARY_HEADERS)}),
e AS ({_education_sql(fixed.EDUCATION_SECTION, fixed.DEGREE_PATTERNS)})
SELECT b.doc_id, name, email, phone, location, title, s.summary, skills, experience_years, companies, e.education,
  array_to_string({terms}, '|') AS job_search_queries,
  CASE WHEN contains(location, {p}) THEN {p} WHEN contains(location, {c}) THEN {c}
       WHEN location <> '' THEN location ELSE {dflt} END AS search_location
FROM b JOIN s USING (doc_id) JOIN e USING (doc_id)"""


def _run_posts() -> str:
    href = decode("regexp_extract(l[i], '<a href=\"([^\"]*)\"', 1)")
    title = clean(decode(untag("regexp_extract(l[i], '(?s)<a[^>]*>(.*?)</a>', 1)")))
    return f"""
WITH x AS (SELECT page_id, {HOST} AS host, {BASE} AS base, {LI_ITEMS} AS l FROM pages),
stops AS (SELECT host, min(page_id) AS stop FROM x WHERE len(l) = 0 GROUP BY host),
kept AS (SELECT x.* FROM x LEFT JOIN stops USING (host) WHERE stops.stop IS NULL OR x.page_id < stops.stop),
y AS (SELECT page_id, host, base, l, unnest(range(1, len(l) + 1)) AS i FROM kept),
c AS (SELECT page_id, host, base, i, {title} AS title, {href} AS href FROM y),
posts AS (SELECT page_id, i, host, title,
            coalesce(CASE WHEN starts_with(href, '/') THEN base || href ELSE href END, '') AS url
          FROM c WHERE title <> ''),
hist AS (SELECT CASE WHEN starts_with(h, '/') THEN b || h ELSE h END AS url
         FROM (SELECT {BASE} AS b, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages
               WHERE starts_with({HOST}, {lit(S.RUN_HISTORY_HOST_PREFIX)}))),
fresh AS (SELECT * FROM posts WHERE url <> '' AND url NOT IN (SELECT url FROM hist WHERE url IS NOT NULL)
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, i) = 1)"""


def _automated_run_sql() -> str:
    return f"""{_run_posts()}
SELECT title, '' AS company, '' AS location, '' AS salary, '' AS description, '' AS posted_date, url,
  {lit(S.RUN_SOURCE)} AS source, host AS search_query FROM fresh"""


ORACLE["collect_run"] = _collect_run_sql()
ORACLE["automated_run"] = _automated_run_sql()
ORACLE["profile"] = _profile_sql()
ORACLE["dictionary_match"] = ORACLE["skill_match"]
ORACLE["text_node_grep"] = _text_node_sql()
ORACLE["stream_dedup"] = f"""SELECT DISTINCT url FROM ({doc_postings_sql()}) WHERE url IS NOT NULL AND url <> ''"""
ORACLE["stream_enrich"] = f"SELECT url, origin, ordinal, description_len, posted_date FROM ({_enrich_upsert_sql()})"
# a key that was let through in a step is known in the next one and forgotten after it
ORACLE["stream_dedup_watermark"] = f"""
WITH RECURSIVE p AS (SELECT DISTINCT concat_ws('/', user_id, event_type) AS key, date_diff('day', TIMESTAMP '{S.EVENTS_FROM}', date_trunc('day', ts)) // 8 AS step FROM events),
r AS (SELECT key, list(step) AS steps FROM p GROUP BY key),
w AS (SELECT key, steps, list_min(steps) AS step FROM r
      UNION ALL SELECT key, steps, list_min(list_filter(steps, lambda s: s > w.step + 1)) FROM w WHERE len(list_filter(steps, lambda s: s > w.step + 1)) > 0)
SELECT key, step FROM w"""
ORACLE["read_csv_mixed"] = f"SELECT title, company, url, '' AS source FROM ({doc_postings_sql()})"
# steps of equal width over the ids, as documents land
ORACLE["history_compacted"] = f"""
WITH b AS (SELECT min(doc_id) AS lo, (max(doc_id) - min(doc_id)) // 4 + 1 AS width FROM documents)
SELECT url, ordinal AS doc_id, title, source, {lit(S.RUN_TS)} AS first_seen, (ordinal - lo) // width AS step FROM ({doc_postings_sql()}), b
WHERE url IS NOT NULL AND url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1"""
ORACLE["stream_history"] = f"""
WITH old AS (SELECT url, ordinal AS doc_id, title, source, {lit(S.HISTORY_TS)} AS first_seen, 'first' AS run_id
             FROM ({doc_postings_sql('SEMI JOIN labels USING (doc_id)')}) WHERE url IS NOT NULL AND url <> ''
             QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1)
SELECT * FROM old UNION ALL
SELECT url, ordinal, title, source, {lit(S.RUN_TS)}, 'second' FROM ({doc_postings_sql()})
WHERE url IS NOT NULL AND url <> '' AND url NOT IN (SELECT url FROM old)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1"""
_NEW = "(page_id, i) IN (SELECT (page_id, i) FROM fresh)"
ORACLE["automated_stats"] = f"""{_run_posts()}
SELECT {lit(S.RUN_SOURCE)} AS source, host AS search_query, count(*) AS found, count(*) FILTER ({_NEW}) AS new,
  count(*) - count(*) FILTER ({_NEW}) AS dup FROM posts GROUP BY host"""
ORACLE["automated_history"] = f"""{_run_posts()}
SELECT url, title, {lit(S.RUN_SOURCE)} AS source, {lit(S.RUN_TS)} AS first_seen FROM fresh"""
ORACLE["manual_run"] = f"""{_run_posts().replace("THEN base ||", f"THEN {lit(S.RUN_BASE_URL)} ||")}
SELECT title, '' AS company, '' AS location, '' AS salary, '' AS description, url, {lit(S.RUN_SOURCE)} AS source FROM posts"""
_CARD = "p_partkey // 20 AS page_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS card_no"
ORACLE["card_fields"] = f"""SELECT {_CARD}, p_name AS title, p_brand AS company, p_type AS location,
  CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS salary, CASE WHEN p_size % 3 > 0 THEN p_name || ' made' ELSE '' END AS description,
  'https://ie.indeed.com/viewjob?jk=' || p_partkey AS url FROM part"""
ORACLE["link_cards"] = f"""SELECT {_CARD}, p_name AS title, CASE WHEN p_size % 5 > 0 THEN '/view/' || p_partkey ELSE '' END AS url FROM part"""
_DETAIL = f"""SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN {clean('text')} ELSE '' END AS t, CASE WHEN doc_id % 7 > 0 THEN 'Posted ' || doc_id % 7 || ' days ago' ELSE '' END AS posted_date FROM documents"""
ORACLE["detail_extract"] = f"""SELECT doc_id, CASE WHEN length(t) > {fixed.DESCRIPTION_MIN_LEN} THEN t ELSE '' END AS description,
  CASE WHEN length(t) > {fixed.DESCRIPTION_MIN_LEN} THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN t = '' THEN {lit(fixed.DESCRIPTION_ERROR)} END AS error, posted_date FROM ({_DETAIL})"""
ORACLE["enrich_from_pages"] = f"""
WITH x AS (SELECT d.doc_id, d.t, d.posted_date, p.url, p.posted_date AS own FROM ({_DETAIL}) d JOIN ({doc_postings_sql()}) p ON p.ordinal = d.doc_id),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)
SELECT x.doc_id, CASE WHEN length(f.t) > {fixed.DESCRIPTION_MIN_LEN} THEN length(f.t) ELSE 0 END::BIGINT AS description_len,
  CASE WHEN length(f.t) > {fixed.DESCRIPTION_MIN_LEN} THEN f.posted_date ELSE x.own END AS posted_date,
  length(f.t) > {fixed.DESCRIPTION_MIN_LEN} AS success FROM x JOIN f USING (url)"""


# ------------------------------------------------- configured sources, samples, maps, rejects, records

ORACLE["config_postings"] = """
WITH p AS (SELECT *, p_partkey % 3 AS s, p_partkey // 60 AS page_num FROM part)
SELECT CASE s WHEN 0 THEN 'indeed' WHEN 1 THEN 'irishjobs' ELSE 'linkedin' END AS source, page_num,
  row_number() OVER (PARTITION BY s, page_num ORDER BY p_partkey) - 1 AS card_no, p_name AS title, p_brand AS company, p_type AS location,
  CASE WHEN s = 1 AND p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS salary,
  CASE s WHEN 0 THEN 'https://ie.indeed.com/viewjob?jk=' || p_partkey WHEN 1 THEN 'https://www.irishjobs.ie/job/' || p_partkey
         ELSE CASE WHEN p_size % 5 > 0 THEN '/view/' || p_partkey ELSE '' END END AS url FROM p"""


def _samples_sql() -> str:
    specs = {"li": "<li>(.*?)</li>", "a[href]": "<a [^>]*>(.*?)</a>", "h1": "<h1>(.*?)</h1>", "div.ad": '<div class="ad">(.*?)</div>', "title": "<title>(.*?)</title>"}
    parts = []
    for sel in S.SAMPLE_SELECTORS:
        body = strip_(decode(untag("x.h")))
        parts.append(f"""SELECT {lit(sel)} AS selector, page_id, x.i - 1 AS el_no, substring({body}, 1, 200) AS sample, row_number() OVER (ORDER BY page_id, x.i) AS place
FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, {lit('(?s)' + specs[sel])}, 1), lambda h, i: {{'h': h, 'i': i}})) AS x FROM pages) QUALIFY place <= 3""")
    return "\nUNION ALL\n".join(parts)


ORACLE["selector_samples"] = _samples_sql()
ORACLE["extract_udtf"] = ORACLE["extract_postings"]
ORACLE["upsert_map"] = """
WITH e AS (SELECT user_id, event_id, (event_type = 'view' AND user_id % 3 > 0) IS TRUE AS is_state, coalesce(event_type, 'none') AS field,
                  round(value * 100)::BIGINT::VARCHAR AS value, props FROM events),
s AS (SELECT *, event_id = min(event_id) FILTER (is_state) OVER (PARTITION BY user_id) AS counts FROM e),
f AS (SELECT user_id, event_id, is_state, counts, field, value FROM s
      UNION ALL SELECT user_id, event_id, is_state, counts, 'prop_' || unnest(json_keys(props)), unnest(list_transform(json_keys(props), lambda k: json_extract_string(props, '$."' || k || '"'))) FROM s),
merged AS (SELECT user_id, field, arg_max({'v': value}, (NOT is_state, event_id)).v AS value FROM f WHERE user_id IS NOT NULL AND (NOT is_state OR counts) GROUP BY ALL),
text AS (SELECT user_id, string_agg(field || '=' || coalesce(value, 'null'), ';' ORDER BY field) AS fields FROM merged GROUP BY user_id),
own AS (SELECT user_id, event_id, string_agg(field || '=' || coalesce(value, 'null'), ';' ORDER BY field) AS fields FROM f GROUP BY ALL),
heads AS (SELECT user_id, min((NOT is_state, event_id)) AS h, bool_or(NOT is_state) AS updated FROM s WHERE NOT is_state OR counts GROUP BY user_id)
SELECT user_id, CASE WHEN h[1] THEN 1 ELSE 0 END::BIGINT AS origin, h[2] AS ordinal, fields, updated AND NOT h[1] AS was_updated FROM heads JOIN text USING (user_id)
UNION ALL SELECT s.user_id, 0, s.event_id, own.fields, false FROM s JOIN own ON own.event_id = s.event_id WHERE s.is_state AND NOT s.counts"""
ORACLE["read_csv_rejects"] = f"""
WITH p AS ({doc_postings_sql()})
SELECT url, NULL AS record, 'read' AS kind FROM p UNION ALL
SELECT url, url || CASE WHEN ordinal % 20 = 3 THEN ',only two' ELSE ',a,b,too many' END, 'malformed record' FROM p WHERE ordinal % 10 = 3"""
ORACLE["read_json_array"] = f"SELECT url, title, source FROM ({doc_postings_sql()}) WHERE (ordinal // 50) % 5 <> 4"
ORACLE["json_variant"] = f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS k, {first_line('text')} AS t, n_chars FROM documents)
SELECT doc_id, CASE WHEN k < 3 THEN t ELSE '' END AS title, CASE k WHEN 2 THEN n_chars::VARCHAR ELSE '' END AS salary,
  CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'empty' WHEN 2 THEN 'value' ELSE 'null' END AS salary_is, CASE WHEN k IN (0, 3) THEN 'value' ELSE 'absent' END AS company_is,
  CASE WHEN k = 3 THEN 'absent' WHEN t = '' THEN 'empty' ELSE 'value' END AS title_is FROM d"""
ORACLE["stream_pages"] = ORACLE["automated_history"]
ORACLE["posting_source"] = f"SELECT url, title, location, source FROM ({doc_postings_sql()}) WHERE location IN ('en', 'fr')"
ORACLE["stream_posting_source"] = f"SELECT url, title, source FROM ({doc_postings_sql()})"


def _second_mode_sql() -> str:
    return f"""
WITH {_enrich_cte()},
d AS (SELECT * FROM details WHERE canonical_url <> '' QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY ordinal) = 1),
p AS (SELECT ordinal, CASE ordinal % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE url END AS url, description, posted_date FROM posts),
x AS (SELECT p.ordinal, p.url, coalesce(d.status = 'success', false) AS ok, CASE WHEN ok THEN d.description ELSE p.description END AS description,
             CASE WHEN ok THEN d.posted_date ELSE p.posted_date END AS posted_date FROM p LEFT JOIN d ON d.canonical_url = p.url)
SELECT ordinal AS doc_id, length(description)::BIGINT AS description_len, posted_date,
  CASE WHEN url IS NULL THEN 'no url' WHEN ok THEN 'success' ELSE 'failed' END AS outcome FROM x"""


ORACLE["enrich_all"] = _second_mode_sql()
ORACLE["enrich_all_stats"] = f"SELECT count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failed') AS failed FROM ({_second_mode_sql()})"


# ------------------------------------------------- résumés made of documents, and what runs report

def _pick(lines: list[str]) -> str:
    return "([" + ", ".join(lit(x).replace("\n", "' || chr(10) || '") for x in lines) + f"])[doc_id % {len(lines)} + 1]"


def resumes(sql: str) -> str:
    """The same SQL over résumés: documents' texts between lines chosen by their own values."""
    years = "CASE WHEN n_chars % 4 > 0 THEN (n_chars % 31)::VARCHAR || '+ years of experience at ' ELSE 'always at ' END"
    lines = [first_line("text"), _pick(S.RESUME_TITLES), _pick(S.RESUME_PLACES), f"{years} || {_pick(S.RESUME_FIRMS)}", "coalesce(text, '')", "'EDUCATION'",
             _pick(S.RESUME_DEGREES), "'ADDITIONAL ' || coalesce(source, '')"]
    made = "SELECT doc_id, concat_ws(chr(10), " + ", ".join(lines) + ") AS text FROM documents"
    return f"WITH resumes AS ({made}) SELECT * FROM ({sql.replace('FROM documents', 'FROM resumes')})"


ORACLE["company_match"] = resumes(ORACLE["company_match"])
ORACLE["education_degrees"] = resumes(_education_sql(fixed.EDUCATION_SECTION, fixed.DEGREE_PATTERNS))
ORACLE["profile"] = resumes(_profile_sql())
_TERMS = "[" + ", ".join(lit(t) for t in fixed.PRIORITY_TITLES) + "]"
ORACLE["report_title_terms"] = f"""SELECT p_partkey, array_to_string(list_slice(CASE WHEN p_type <> '' AND NOT list_contains({_TERMS}, p_type)
  THEN list_prepend(p_type, {_TERMS}) ELSE {_TERMS} END, 1, {min(fixed.REPORT_TITLE_TERMS, fixed.SEARCH_TERMS_DEFAULT)}), ', ') AS title FROM part"""
ORACLE["description_probe"] = """
WITH g AS (SELECT *, p_name || ' made as ' || p_type || ' by ' || p_brand AS made, p_name || ' ' || p_type || ' ' || p_brand AS n FROM part),
f AS (SELECT p_partkey // 20 AS page_id, p_type, made, CASE WHEN p_size % 2 > 0 AND length(n) > 20 THEN n END AS note,
                  CASE WHEN p_size % 3 > 0 AND length(made) > 20 THEN made END AS snippet
           FROM g QUALIFY row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) = 1)
SELECT page_id, CASE WHEN note IS NOT NULL THEN 0 WHEN snippet IS NOT NULL THEN 1 END::BIGINT AS probe_rank, length(coalesce(note, snippet))::BIGINT AS length,
  substring(coalesce(note, snippet), 1, 150) AS preview,
  CASE WHEN coalesce(note, snippet) IS NULL THEN concat_ws(',', CASE WHEN length(p_type) > 20 THEN 'kind:' || length(p_type) END, CASE WHEN length(made) > 20 THEN 'long:' || length(made) END) END AS divs FROM f"""
ORACLE["dedup_composite"] = f"""SELECT sha256(title || chr(31) || company || chr(31) || location) AS key, ordinal AS doc_id, title FROM ({doc_postings_sql()})
WHERE title IS NOT NULL AND company IS NOT NULL AND location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title, company, location ORDER BY ordinal) = 1"""
ORACLE["sink_guard"] = f"SELECT url, title FROM ({doc_postings_sql()})"
ORACLE["manual_report"] = f"""SELECT {esc('source')} AS source, {esc('url')} AS url, {esc('title')} AS title, '' AS company, '' AS location, '' AS salary,
  '{fixed.REPORT_ELLIPSIS}' AS description FROM ({ORACLE["manual_run"]})"""
ORACLE["manual_summary"] = f"""SELECT strftime(DATE {lit(S.RUN_DATE)}, '%Y-%m-%d') AS report_date, {esc(lit(S.REPORT_QUERY))} AS query,
  {esc(lit(S.REPORT_LOCATION))} AS location, count(*)::BIGINT AS total_jobs FROM ({ORACLE["manual_run"]}) HAVING count(*) > 0"""
