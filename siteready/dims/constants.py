"""Closed enumerations, thresholds and short lookup tables the results depend on."""

STAGES = ("home", "plp", "pdp", "cart", "checkout_entry")
PAGE_TYPES = ("home", "plp", "pdp", "cart", "checkout", "challenge", "other")
SUB_INDICES = ("PERF", "FAI", "TRI", "PTI", "CCL", "MPI")
RISK_INDEX = "DPR"
NOT_APPLICABLE = "not_applicable"

SCHEMA_VERSION = "engagement.v1"
ANCHORS_VERSION = "anchors.v2"
RUBRICS_VERSION = "rubrics.v2"
CHECKS_VERSION = "checks.v2"
RISK_TESTS_VERSION = "deception.v1"

# headline configuration
INDEX_WEIGHTS = {"FAI": 22.0, "TRI": 20.0, "PTI": 15.0, "CCL": 15.0, "PERF": 18.0, "MPI": 10.0}
RISK_PENALTY = 0.30
SCORE_FLOOR = 10.0
MIN_COVERAGE = 0.6
MIN_MAJOR_COVERAGE = 0.5
MAJOR_WEIGHT = 15.0
GRADES = {"A": 0.85, "B": 0.70, "C": 0.60}
STAGE_WEIGHTS = {"pdp": 2, "plp": 2}
RISK_FIRED = 0.5
LIMITING_KPIS = 3
TOLERANCE = 1e-9

# friction
INTERACTIONS = ("CLICK", "TYPE_TEXT", "SELECT")
EXECUTED = ("CLICK", "TYPE_TEXT", "SELECT", "SCROLL_UP", "SCROLL_DOWN", "WAIT")
TRUSTED_INPUT = ("CLICK", "TYPE_TEXT")
DEAD_ROLES = ("button", "link")
RAGE_RUN = 3
EVENT_TIMING_THRESHOLD_MS = 16.0

# judgments
MIN_AGREEMENT = 2 / 3
MAX_SNIPPET_CHARS = 600
MAX_SNIPPETS = 8
MIN_QUOTE_CHARS = 8
MAX_QUOTES = 8
MAX_EVIDENCE = 5
MAX_RATIONALE_CHARS = 280
RETRY_REASONS = ("request_failed", "invalid_response")
TASK_PAGE = 15
TASK_PAGE_CHARS = 36000

# page checks
MIN_PROSE_WORDS = 30
LARGE_ASSORTMENT = 24
SALIENT_AREA = 10000.0
PAGINATION = ("pagination", "load_more", "infinite", "none")
PAINT_TIMINGS = ("fcp", "lcp", "cls", "tbt_approx", "loaf_count")
GONE = ("OutOfStock", "SoldOut", "Discontinued")

# resource types
ASSET_BYTES = {"Script": "bytes_js", "Image": "bytes_img", "Stylesheet": "bytes_css", "Font": "bytes_font"}
EXTENSION_TYPES = {
    "js": "Script", "mjs": "Script", "css": "Stylesheet", "woff": "Font", "woff2": "Font", "ttf": "Font",
    "otf": "Font", "png": "Image", "jpg": "Image", "jpeg": "Image", "gif": "Image", "webp": "Image",
    "avif": "Image", "svg": "Image", "ico": "Image",
}
INITIATOR_TYPES = {
    "navigation": "Document", "script": "Script", "img": "Image", "image": "Image", "fetch": "Fetch",
    "xmlhttprequest": "XHR", "beacon": "Ping", "video": "Media", "audio": "Media", "track": "TextTrack",
}

# two-label public suffixes where each subdomain is a site of its own
PUBLIC_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "com.au", "net.au", "org.au",
    "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.mx", "com.ar", "com.co", "com.tr",
    "com.cn", "com.hk", "com.sg", "com.tw", "co.in", "co.za", "co.il", "com.my", "com.ph", "com.pe", "com.ua",
    "com.pl", "com.gr", "com.cy", "com.mt", "co.at", "or.at", "gv.at", "co.hu", "com.pt", "com.es", "com.ru",
    "myshopify.com", "github.io", "netlify.app", "vercel.app", "herokuapp.com", "appspot.com", "blogspot.com",
    "pages.dev", "web.app", "firebaseapp.com", "azurewebsites.net", "cloudfront.net", "wixsite.com",
    "squarespace.com", "wordpress.com", "altervista.org", "webnode.it", "webnode.com", "webnode.page",
    "jimdosite.com", "jimdofree.com", "weebly.com", "webflow.io", "square.site", "business.site", "company.site",
    "bigcartel.com", "mystrikingly.com", "tilda.ws", "onrender.com",
)
GENERIC_SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "go", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom",
                        "or", "org", "plc", "sch")

# function words that tell the language of a text
FUNCTION_WORDS = {
    "it": tuple("il lo la le gli di del dello della delle dei degli che per con non una uno sono alla alle nel nella "
                "nelle sul sulla dal dalla anche più come questo questa ogni tutti tutte ai al da ed è".split()),
    "en": tuple("the and of to with for is are you your our this that on at from by it be all more an or not we"
                .split()),
}
EXTRA_STOP_WORDS = tuple("sotto sopra senza tra fra under over into".split())
