"""Fixed values.

FIXED VALUES: these must equal the behaviour being matched (rule lists, term
dictionaries, selector lists, URL formats, thresholds, defaults). They are data,
kept together in their natural order; operators take them as default arguments
and every operator also accepts caller-supplied lists.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Profile rules (patterns use Python ``re`` syntax; flags noted per list).

# Location rules, case-insensitive, first rule that matches wins.
LOCATION_PATTERNS = [
    r"Dublin,?\s*Ireland",
    r"Ireland",
    r"Dublin",
    r"Cork,?\s*Ireland",
    r"Galway,?\s*Ireland",
]

# Title rules, case-insensitive, first rule that matches wins.
TITLE_PATTERNS = [
    r"(Lead\s+Software\s+(?:&|and)\s+AI\s+Engineer)",
    r"(Lead\s+(?:Software|AI|Data|Platform)\s+(?:Engineer|Developer|Architect))",
    r"(Senior\s+(?:Software|AI|Data|Platform)\s+(?:Engineer|Developer|Architect))",
    r"((?:Software|AI|Data|Platform)\s+(?:Engineer|Developer|Architect))",
    r"(Data\s+(?:Engineer|Scientist|Analyst))",
    r"(DevOps\s+Engineer)",
    r"(Cloud\s+(?:Engineer|Architect))",
    r"(Full[\s-]?Stack\s+Developer)",
]

EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"\+?\d{2,3}[\s-]?\d{3,4}[\s-]?\d{4,6}"

# Summary: header prefix (case-insensitive), lines 2..20, thresholds.
SUMMARY_HEADERS = ["PROFESSIONAL EXPERIENCE", "EXPERIENCE", "EDUCATION", "SKILLS", "PROJECTS"]
SUMMARY_CONTACT_MARKS = ["@", "+"]
SUMMARY_CONTACT_WORD = "linkedin"
SUMMARY_FIRST_LINE = 2
SUMMARY_LAST_LINE = 20
SUMMARY_START_LEN = 50
SUMMARY_CONT_LEN = 20

# Skill dictionary (case-insensitive substring test), in six groups.
SKILL_GROUPS = {
    "programming": ["Python", "C#", "Java", "JavaScript", "TypeScript", "Go", "Rust", "Ruby", "PHP",
                    "Scala", "Kotlin", "Swift", "R", "SQL", "Bash"],
    "frameworks": ["FastAPI", "Django", "Flask", "ASP.NET", ".NET", "React", "Next.js", "Node.js",
                   "Express", "Spring", "Angular", "Vue.js", "GraphQL", "REST", "RESTful"],
    "cloud": ["AWS", "Azure", "GCP", "Google Cloud", "Lambda", "EC2", "S3", "RDS", "CloudWatch",
              "EventBridge", "Terraform", "Kubernetes", "Docker", "Chef", "Ansible", "Serverless"],
    "data": ["Snowflake", "PostgreSQL", "Oracle", "MySQL", "MongoDB", "Redis", "Elasticsearch", "Kafka",
             "Airflow", "Databricks", "Redshift", "Power BI", "Tableau", "ETL", "ELT"],
    "ai": ["LLM", "Large Language Model", "GPT", "Claude", "AI", "Machine Learning", "Deep Learning",
           "NLP", "Prompt Engineering"],
    "devops": ["CI/CD", "DevOps", "Jenkins", "GitHub Actions", "Azure DevOps", "Git", "Agile", "Scrum"],
}
SKILL_TERMS = [t for group in SKILL_GROUPS.values() for t in group]

# Years of experience, case-insensitive, group 1, first rule wins, default 0.
EXPERIENCE_PATTERNS = [
    r"(\d+)\+?\s*years?\s*(?:of\s+)?(?:experience|designing|building)",
    r"over\s+(\d+)\s*years?",
]

# Known companies: case-sensitive substring, dictionary order.
KNOWN_COMPANIES = ["Twikara", "State Street", "Sonra Intelligence", "Accenture", "Google", "Microsoft",
                   "Amazon", "Meta", "Apple"]

# Education section (case-insensitive, dot-all, lazy) and degree patterns (case-insensitive).
EDUCATION_SECTION = r"EDUCATION(.*?)(?:ADDITIONAL|SKILLS|PROJECTS|$)"
DEGREE_PATTERNS = [
    r"(M\.?S\.?C\.?|MSC|M\.?Sc\.?|MASTER(?:'?S)?)\s+(?:IN\s+)?([A-Za-z\s]+)",
    r"(B\.?S\.?C\.?|BSC|B\.?Sc\.?|BACHELOR(?:'?S)?)\s+(?:OF\s+)?(?:ENGINEERING\s+IN\s+)?([A-Za-z\s]+)",
    r"(PH\.?D\.?|PHD|DOCTORATE)\s+(?:IN\s+)?([A-Za-z\s]+)",
]

# Search terms: fixed titles, own title prepended when new, cap 10, default take 5.
PRIORITY_TITLES = ["Lead Software Engineer", "Backend Engineer", "Software Engineer", "Data Engineer",
                   "Cloud Engineer", "DevOps Engineer", "AI Engineer", "ML Engineer", "MLOps Engineer"]
SEARCH_TERMS_CAP = 10
SEARCH_TERMS_DEFAULT = 5

# Search location: containment (case-sensitive) and default.
SEARCH_LOCATION_PRIMARY = "Dublin"
SEARCH_LOCATION_COUNTRY = "Ireland"
SEARCH_LOCATION_DEFAULT = "Dublin"

# ------------------------------------------------------------ sources / pages
# Source configuration: base url, page size, page numbering, search URL format,
# card selectors and field selectors (rank = list position).
SOURCES = {
    "indeed": {
        "base_url": "https://ie.indeed.com",
        "page_size": 10,
        "page_mode": "offset",  # start = page * page_size, pages from 0
        "search_url": "{base}/jobs?q={query}&l={location}&start={start}",
        "selectors": {
            "job_card": ["div.job_seen_beacon", "td.resultContent", "div.cardOutline"],
            "title": ["h2.jobTitle", "a.jcs-JobTitle"],
            "company": ["span.companyName", 'span[data-testid="company-name"]'],
            "location": ["div.companyLocation", 'div[data-testid="text-location"]'],
            "salary": ["div.salary-snippet", 'div[data-testid="attribute_snippet_testid"]'],
            "description": ["div.job-snippet", 'div[data-testid="job-snippet"]', "div.jobCardShelfContainer",
                            "ul.jobCardShelfContainer", "table.jobCardShelfContainer"],
        },
    },
    "irishjobs": {
        "base_url": "https://www.irishjobs.ie",
        "page_size": 25,
        "page_mode": "number",  # page numbers from 1
        "search_url": "{base}/jobs?Keywords={query}&Location={location}&Page={page}",
        "selectors": {
            "job_card": ["article.job", "div.job-item", "div.res-1t6m82k"],
            "title": ["h2.job-title", "a.job-link", "a.res-1na8b7y"],
            "company": ["span.company", "div.employer", "a.res-14k2z3y"],
            "location": ["span.location", "div.job-location", "span.res-1c25221"],
            "salary": ["span.salary", "div.job-salary", "span.res-1dp9s8x"],
            "description": ["div.job-description", "p.description", "span.res-162u0s4"],
        },
    },
    "linkedin": {
        "base_url": "https://www.linkedin.com",
        "page_size": 25,
        "page_mode": "offset",
        "search_url": "{base}/jobs/search/?keywords={query}&location={location}&start={start}",
        "selectors": {
            "job_card": ["li.jobs-search-results__list-item"],
            "title": ["h3.base-search-card__title"],
            "company": ["h4.base-search-card__subtitle", "a.hidden-nested-link"],
            "location": ["span.job-search-card__location"],
            "salary": ["span.job-search-card__salary-info"],
            "description": ["p.base-search-card__snippet"],
            "link": ["a.base-card__full-link"],
        },
    },
}
SOURCE_ORDER = ["indeed", "irishjobs", "linkedin"]

# When paging stops (later pages of the same source and query are dropped):
# no_cards = a readable page without cards; interstitial = bot-check page text;
# login_url = the page url holds a login token. An unreadable page never stops.
PAGE_STOP_RULES = {
    "indeed": ["no_cards"],
    "irishjobs": ["interstitial", "no_cards"],
    "linkedin": ["login_url"],
}
LOGIN_URL_TOKENS = ["authwall", "login"]

# Detail-page description selectors (three variants) and acceptance threshold (strict >).
DESCRIPTION_SELECTORS = {
    "card_detail": ["div#jobDescriptionText", "div.jobsearch-jobDescriptionText", 'div[id*="jobDesc"]',
                    "div.job-description"],
    "enrich": ["div#jobDescriptionText", "div.jobsearch-JobComponent-description",
               'div[class*="jobsearch-JobComponent-description"]', 'div[id*="jobDesc"]'],
    "fetch": ["div#jobDescriptionText", "div.jobsearch-JobComponent-description",
              'div[class*="jobsearch-JobComponent-description"]', 'div[id*="jobDesc"]', "div.job-description"],
}
DESCRIPTION_MIN_LEN = 50
DESCRIPTION_ERROR = "No description element found"

# Detail-page date selectors (three variants) and their word lists.
DATE_SELECTORS = {
    "card_detail": ["div.jobsearch-JobMetadataFooter", "span.date", 'div[class*="date"]', 'span[class*="date"]'],
    "enrich": ["div.jobsearch-JobMetadataFooter", 'span[class*="date"]', 'div[class*="JobMetadata"]'],
    "fetch": ["div.jobsearch-JobMetadataFooter", 'span[class*="date"]', 'div[class*="JobMetadataFooter"]'],
}
DATE_WORDS = {
    "card_detail": ["posted", "today", "yesterday", "day", "week", "hour", "ago"],
    "enrich": ["posted", "today", "yesterday", "day", "ago"],
    "fetch": ["posted", "today", "yesterday", "day", "week", "ago"],
}
FOOTER_CLASS_TOKEN = "footer"
RELATIVE_DATE_PATTERN = r"(Posted|Active)?\s*(Today|Yesterday|\d+\s+(?:hour|day|week)s?\s+ago)"

# Card description probe: generic fallback selectors and threshold.
CARD_DESCRIPTION_PROBE = ['div.job-snippet', 'div[data-testid="job-snippet"]', 'div.jobCardShelfContainer',
                          'table.jobCardShelfContainer', 'ul', 'div']
CARD_DESCRIPTION_PROBE_MIN_LEN = 20

# Job key in a URL and the clean URL built from it.
URL_KEY_PARAM = "jk"
CLEAN_URL_FORMAT = "https://ie.indeed.com/viewjob?jk={key}&from=web&vjs=3"

# Interstitial (non-content) page tokens.
INTERSTITIAL_ALL = ["cloudflare", "challenge"]
INTERSTITIAL_ANY = ["akamai", "please wait"]
INTERSTITIAL_URL = ["bm-verify", "authwall", "login"]
INTERSTITIAL_URL_GROWTH = 100

# Text-node probe tokens (case-sensitive) and preview width.
TEXT_NODE_TOKENS = ["Posted", "ago"]
TEXT_NODE_PREVIEW = 200
SOURCE_LINE_PREVIEW = 300

# --------------------------------------------------------- identity / enrich
POSTING_7 = ["title", "company", "location", "salary", "description", "url", "source"]
POSTING_9 = ["title", "company", "location", "salary", "description", "posted_date", "url", "source",
             "search_query"]
ENRICHED_MIN_LEN = 100  # "already enriched" when description is longer than this

# ----------------------------------------------------------------- reporting
REPORT_DEFAULTS = {
    "source": "unknown",
    "url": "#",
    "title": "No Title",
    "company": "Unknown Company",
    "location": "Unknown Location",
    "salary": "Salary not specified",
    "description": "",
}
REPORT_DESCRIPTION_CUT = 300
REPORT_ELLIPSIS = "..."
REPORT_TITLE_TERMS = 3
DATA_DATE_FORMAT = "yyyyMMdd"
REPORT_DATE_FORMAT = "yyyy-MM-dd"

# Preview widths used by the quality checks.
PREVIEW_WIDTHS = {"profile": 100, "report": 300, "sample": 350, "detail": 500, "title": 50}
EMPTY_MARK = "(empty)"
# Synthetic postings used by the reference's own tests ({i} = 1..n, {source} = source name).
MOCK_POSTING = {
    "title": "Software Engineer {i}",
    "company": "Tech Company {i}",
    "salary": "€50,000 - €70,000",
    "description": "We are looking for a talented software engineer to join our team. Job ID: {i}",
    "url": "https://example.com/jobs/{source}/{i}",
}
MOCK_SOURCES = ["mock_indeed", "mock_irishjobs", "mock_linkedin"]
MOCK_ROWS_PER_SOURCE = 5
# ------------------------------------------------------------ end FIXED VALUES
