"""Stand-in rule lists for the registered queries.

The generated tables never contain the reference's own words (engineer, Dublin,
years, EDUCATION, Posted ...), so the registered queries run the same operators
with ranked rules that *do* hit the data; the fixed rule lists are exercised by
the fixture tests. Same shapes as the fixed lists: ranked, case-insensitive,
rank beats position.
"""

from jobsmith.functions import fixed

#: lines of the résumés that are made of documents (one of each list by doc_id)
RESUME_TITLES = ["Senior Data Engineer", "lead  AI architect", "Cloud Engineer", "Full-Stack Developer", "gardener", "Data Analyst and Software Engineer"]
RESUME_PLACES = ["Dublin, Ireland", "Cork, Ireland", "somewhere in IRELAND", "Lisbon", "dublin 4"]
RESUME_DEGREES = ["MSc in Data", "Bachelor of Engineering in Physics", "PhD in Logic\nB.Sc. Mathematics", "school of life", "Master's Chemistry"]
RESUME_FIRMS = [*fixed.KNOWN_COMPANIES[:4], "a small firm", "Google and Meta", "apple orchards"]

TITLE_RULES = [r"(The\s+[a-z]+\s+of)", r"(Of\s+the\s+[a-z]+)", r"(In\s+[a-z]+)"]
LOCATION_RULES = [r"Die,?\s*der", r"der", r"Die", r"Le,?\s*la", r"La,?\s*des"]
LOCATION_PRIMARY = "Die"
LOCATION_COUNTRY = "der"
SUMMARY_HEADERS = ["Of", "And"]
EXPERIENCE_RULES = [fixed.EXPERIENCE_PATTERNS[0], r"(\d+)\s+[a-z]+"]
EDUCATION_SECTION = r"Ci(.*?)(?:En|De|$)"
DEGREE_RULES = [r"(the|of)\s+(?:and\s+)?([A-Za-z\s]+)", r"(in)\s+([A-Za-z]+)"]
_INDEED = fixed.SOURCES["indeed"]["selectors"]
SKILL_CARD_SELECTORS = [_INDEED["job_card"][0], "li"]
CARD_TITLE_SELECTORS = [_INDEED["title"][0], "a"]
#: the first selector of each posting field, as the pages' queries use them
FIRST_FIELDS = {f: _INDEED[f][:1] for f in ("company", "location", "salary", "description")}
DESCRIPTION_SELECTORS = ["div#jobDescriptionText", "div.ad", "article", "footer"]
DATE_SELECTORS = ["span.date", "div.ad", "h1", "footer"]
DATE_WORDS = ["les", "der", "the"]
FOOTER_CLASS_TOKEN = "ad"
FOOTER_DATE_RULE = r"(La|Le|Die)?\s*(des|der|\d+\s+(?:et|de)s?\s+ago)"
TEXT_NODE_TOKENS = ["The", "ago"]
SOURCE_LINE_TOKENS = ["The"]
SOURCE_LINE_LOWER_TOKENS = ["der"]
HIT_SELECTORS = ["li", "a", "div.ad", "footer", "h1", "title", "nav", "span.date"]
EVENTS_FROM = "2024-01-01"
SAMPLE_SELECTORS = ["li", "a[href]", "h1", "div.ad", "title"]
LINK_TOKEN = "an"
URL_KEY_PARAM = "page"
CLEAN_URL_FORMAT = "https://jobs.example/view?page={key}&from=web"
INTERSTITIAL_ALL = ["cheap", "pills"]
INTERSTITIAL_ANY = ["spam", "please wait"]
INTERSTITIAL_URL = ["spam-farm", "login"]
PREFIX_CARD_SELECTOR = "b"
SEARCH_LOCATION = "Dublin"
SEARCH_PAGES = 3
RUN_DATE = "2024-01-02"
RUN_TS = "2024-01-02T00:00:00"
HISTORY_TS = "2024-01-01T00:00:00"
REPORT_QUERY = "Lead Software Engineer, Backend Engineer, Software Engineer"
REPORT_LOCATION = "Dublin & <Cork> \"IE\" 'x'"
DOC_URL_PREFIX = "https://docs.example/"
NEW_ID_OFFSET = 1000000000
RUN_SOURCE = "pages"
RUN_BASE_URL = "https://pages.example"
RUN_HISTORY_HOST_PREFIX = "blog."
