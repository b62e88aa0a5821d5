"""Limits, word lists and patterns every result depends on."""

# crawl
MAX_PAGES = 1_000
MAX_DEPTH = 3
MAX_LINKS_PER_PAGE = 300
MAX_RENDERED_PAGES = 25
FETCHES_PER_SECOND = 4
FETCH_BATCH = 100

# body caps, in bytes of the declared length or characters of a string body
PAGE_BODY_CAP = 2 * 1024 * 1024
SITEMAP_BODY_CAP = 50 * 1024 * 1024
ROBOTS_BODY_CAP = 512 * 1024

# sitemaps
MAX_SITEMAP_DOCS = 10
MAX_SITEMAP_URLS = 1_000
RAW_SITEMAP_FACTOR = 3
MIN_SITEMAP_ENTRIES = 3
FALLBACK_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")

# robots
ROBOTS_AGENT = "webcairn"
DEFAULT_DELAY_MS = 500
MAX_DELAY_MS = 10_000

# extraction and quality
MIN_SNIPPET_CHARS = 40
MAX_SNIPPET_CHARS = 400
USEFUL_SNIPPET_CHARS = 80
MIN_DISCOVERY_LINKS = 3
GENERIC_TITLES = ("", "app", "home", "loading", "untitled")

# inventory and documents
MAX_LINKS_PER_SECTION = 10
SECTION_ORDER = ("Documentation", "Products", "Blog", "About", "Core Pages")
OPTIONAL_SECTION = "Optional"
DEFAULT_SECTION = "Core Pages"
SECTION_RULES = (
    (r"(?i)^/(docs|documentation|guide|guides|api|reference|developers?|sdk)", "Documentation"),
    (r"(?i)^/(blog|news|articles|posts|changelog|releases)", "Blog"),
    (r"^/\d{4}/\d{2}/", "Blog"),
    (r"(?i)^/(pricing|plans|products?|features|solutions|integrations)", "Products"),
    (r"(?i)^/(about|team|contact|company|customers|case-studies)", "About"),
    (r"(?i)^/(support|help|faq)", "Documentation"),
    (r"(?i)^/(legal|privacy|terms|cookies|careers|jobs|press|media)", "Optional"),
)
TITLE_SEPARATORS = (" | ", " — ", " – ", " - ")
LINES_PER_PART = 2_048

# refinement plans
PLAN_PART_BYTES = 64 * 1024
PLAN_SUMMARY_CHARS = 400
PLAN_SECTION_CHARS = 80
PLAN_DESCRIPTION_CHARS = 200

# monitoring, in seconds
HOUR = 3_600
DAY = 24 * HOUR
SITE_FLOOR_S = HOUR
SITE_CEILING_S = 7 * DAY
PAGE_FLOOR_S = 6 * HOUR
PAGE_CEILING_S = 30 * DAY
SITE_DEFAULT_INTERVAL_S = DAY
PAGE_DEFAULT_INTERVAL_S = 7 * DAY
STRONG_STREAK = 3
MONITOR_CHECKS = 30
DUE_SITES = 100
SMALL_SITE_PAGES = 15
DATED_SHARE = 0.2
STALE_RUN_S = HOUR

# reports
NEWEST_SITES = 50
REQUEST_LIMIT = 10
REQUEST_WINDOW_S = 60
REDACTED = "[redacted]"
SENSITIVE_KEYS = (
    "authorization", "body", "content", "key", "prompt", "secret", "snippet", "token",
)

# patterns
TRACKING_PARAM = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_|_ga$|session)"
PATH_BLOCKLIST = (
    r"(?i)^/search|^/login|^/cart|^/wp-admin|/page/[3-9]\d*|/(?:tag|category)/.+/page/"
)
NON_HTML_EXTENSION = (
    r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|json|xml|pdf|zip|gz|mp[34]|webm"
    r"|woff2?|ttf|eot|txt)$"
)
DATED_PATH = r"/\d{4}/\d{2}/"
HTML_CONTENT_TYPE = r"(?i)text/html|application/xhtml"
LINK_LINE = r"^- \[[^\]]+\]\(https?://[^)]+\):\s.+$"
PRIVATE_IPV4 = (
    r"^0\.|^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[0-1])\.|^169\.254\."
    r"|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
)

# text of documents whose homepage has no snippet; readers compare documents as written
DEFAULT_SUMMARY = "Key pages and documentation for %s."

# enumerations
RUN_STATUSES = ("queued", "crawling", "generating", "done", "error")
PAGE_STATUSES = ("active", "removed", "error")
GENERATED_BY = ("heuristic", "llm-refined")
