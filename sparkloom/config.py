"""Fixed values of the rules, and the run profiles."""

from __future__ import annotations

from typing import NamedTuple

# Query keys that are removed from a URL that is fetched.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid", "fbclid",
    "msclkid", "mc_cid", "mc_eid", "ref", "referrer", "source", "_ga", "_gl", "sessionid", "sid",
)
# Further keys that are noise when URLs are compared. The key hsCtaTracking is listed in mixed
# case by the rules but compared in lower case, so it never matches; it is left out here.
NOISE_KEYS = (*TRACKING_KEYS, "utm_reader", "utm_name", "utm_social", "utm_social-type", "_hsenc", "_hsmi", "yclid", "igshid", "mc_tc", "mkt_tok", "vero_id", "wickedid")
# Query keys of link traps.
PAGINATION_KEYS = ("page", "paged", "pg", "offset", "start")
SEARCH_KEYS = ("q", "query", "search", "s", "keyword", "keywords")
CALENDAR_KEYS = ("date", "day", "week", "month", "year", "calendar", "ical", "tribe-bar-date", "eventdisplay")
FACET_KEYS = (
    "filter", "filters", "facet", "facets", "sort", "sortby", "sort_by", "order", "orderby", "order_by", "view", "layout", "display", "per_page",
    "perpage", "limit", "min_price", "max_price", "price", "color", "colour", "size", "tag", "tags", "category", "categories",
)
# Two-letter codes of languages other than English, market regions that are dropped, and those kept.
LANGUAGES = tuple(
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts "
    "tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu".split()
)
DROPPED_REGIONS = ("gb", "uk", "au", "nz", "sg", "ae", "ca", "ie", "eu", "in", "za", "jp", "kr", "br", "mx", "de", "fr", "es", "it", "nl")
KEPT_REGION = "us"
# First segments without content.
NON_CONTENT = ("legal", "privacy", "privacy-policy", "terms", "terms-of-service", "terms-of-use", "terms-and-conditions", "cookie-policy", "cookies", "careers", "jobs")

PRODUCT, EVIDENCE, OTHER, EDITORIAL = "product", "evidence", "other", "editorial"


class Section(NamedTuple):
    name: str
    tier: str
    #: The whole segment, as a regular expression that Java, RE2 and Python read alike.
    pattern: str
    first_only: bool = False


_Q = "(?:[a-z0-9]+-)?"
# The section vocabulary; within a tier the order matters.
SECTIONS = (
    *(Section(name, PRODUCT, pattern) for name, pattern in (
        ("products", "products?"), ("solutions", "solutions?"), ("features", "features?"), ("pricing", "pricing"), ("plans", "plans?"), ("platform", "platform"),
        ("integrations", "integrations?"), ("use-cases", "use-cases?"), ("industries", "industries"), ("alternatives", "(?:alternatives|vs|versus|compare|comparison)"),
        ("capabilities", "capabilities"), ("modules", "modules?"),
    )),
    *(Section(name, EVIDENCE, pattern) for name, pattern in (
        ("customers", "customers"), ("case-studies", _Q + "case-stud(?:y|ies)"), ("stories", _Q + "success-stor(?:y|ies)"), ("stories", _Q + "stories"),
        ("testimonials", _Q + "testimonials?"), ("faq", "(?:faqs?|frequently-asked(?:-questions)?)"),
    )),
    *(Section(name, EDITORIAL, pattern) for name, pattern in (
        ("blog", _Q + "blogs?"), ("news", _Q + "news"), ("press", "press(?:-releases?|-room|-centre?|-center)?"), ("stories", _Q + "story"), ("resources", _Q + "resources?"),
        ("resource-center", "[a-z0-9-]*resource-cent(?:er|re)"), ("hub", _Q + "(?:hub|content-corner)"), ("learn", "learn(?:ing)?"), ("academy", "academy"),
        ("glossary", "(?:glossary|definitions|dictionary|what-is)"), ("insights", "insights?"), ("articles", "articles?"), ("guides", "guides?"), ("ebooks", "ebooks?"),
        ("templates", _Q + "templates?"), ("videos", "videos?"), ("webinars", "webinars?"), ("podcasts", "podcasts?"), ("events", "events?"),
        ("community", "(?:community|forum|answers|questions)"), ("job-descriptions", "(?:job-descriptions|roles|titles)"), ("free-tools", "free-tools"),
        ("generators", "generators?"), ("calculators", "calculators?"), ("help", "(?:knowledge|kb|help|support)"),
    )),
    Section("archive", EDITORIAL, "(?:author|authors|tag|tags|category|categories|topics|archive|page)", True),
    *(Section(name, OTHER, pattern) for name, pattern in (
        ("apps", "apps"), ("connectors", "connectors"), ("plugins", "plugins"), ("marketplace", "marketplace"), ("tools", "tools"),
        ("jurisdiction-guides", "(?:countr(?:y|ies)|states?|provinces?|regions?|cities|city|count(?:y|ies)|municipalit(?:y|ies)|jurisdictions?)-(?:guides?|profiles?|pages?|rates?|rules?|tables?|reference)"),
        ("tax-reference", "(?:[a-z]{2}-)?(?:vat|gst|hst|pst|sales-tax|use-tax|excise|duty)-(?:rules?|rates?|guides?|tables?|info|compliance)"),
        ("tax-rates", "tax-?rates?"), ("rate-tables", "(?:local|zip)-rates?"), ("localities", "(?:count(?:y|ies)|cities|states|municipalities|districts)"), ("zip-codes", "zip-?codes?"),
    )),
)
# Signals of editorial paths, on the segments joined by a slash.
STRONG_EDITORIAL = r"(?:^|/|-)how-to(?:-|/|$)|(?:^|/|-)tutorials?(?:-|/|$)|(?:^|/|-)explained(?:-|/|$)|(?:^|/|-)best-practices(?:-|/|$)|(?:^|/|-)what-is-"
WEAK_EDITORIAL = r"-(?:guides?|checklists?|templates?)(?:/|$)"
# Pages admitted per section; 0 excludes the section, a section not listed has no cap.
SECTION_CAPS = {
    **dict.fromkeys(("templates", "apps", "connectors", "plugins", "marketplace", "glossary", "job-descriptions", "free-tools", "generators", "calculators", "community"), 10),
    **dict.fromkeys(("archive", "localities", "zip-codes", "events", "webinars"), 0),
    **dict.fromkeys(("tools", "press"), 100),
    **dict.fromkeys(("tax-rates", "jurisdiction-guides", "tax-reference", "rate-tables"), 25),
    **dict.fromkeys(("blog", "news", "insights", "articles", "guides", "ebooks", "learn", "academy", "customers", "case-studies", "stories", "resources"), 250),
}
# Thresholds.
PROSE_FLOOR, VIABLE_BYTES, VIABLE_TEXT = 40, 512, 80
NEAR_HAMMING, NEAR_CHARS, SHINGLE = 3, 500, 5
BLOCK_DEDUP_CHARS, TWIN_SHARE, CONTENT_CAP = 25, 0.9, 500_000
EDITORIAL_FLOOR, EDITORIAL_PER = 25, 4
DIRECTORY_CAP, MAX_PAGES, SITEMAP_FILES, SITEMAP_URLS = 50, 2500, 40, 50_000
ABORT_AFTER, ABORT_RATIO, THIN_CHARS, SAMPLES, DETAIL_CHARS = 25, 10, 500, 5, 300
DOCUMENT_BYTES, BATCH_BYTES, BATCH_PAGES, BATCH_LINKS, STALE_MINUTES = 14 * 2**20, 28 * 2**20, 100, 10_000, 15
CHALLENGE_MARKS = ("cf-browser-verification", "just a moment...", "attention required! | cloudflare")
REJECT_REASONS = (
    "robots_disallowed", "off_site_redirect", "locale_excluded", "non_content_directory", "challenge_page", "requires_javascript", "extract_empty", "request_failed", "extract_failed",
)
RUN_TYPES = ("partner", "competitors", "local", "project-site", "consultancy-competitors")


class Profile(NamedTuple):
    max_pages: int = MAX_PAGES
    max_depth: int | None = None
    quotas: bool = True
    directory_cap: bool = True


def profile(run_type: str) -> Profile:
    """Rules of a run type: a project's own site has neither quotas nor a directory cap."""
    if run_type not in RUN_TYPES:
        raise ValueError(f"unknown run type {run_type!r}")
    own = run_type == "project-site"
    return Profile(quotas=not own, directory_cap=not own)


def budget(asked: int | None, default: int = MAX_PAGES) -> int:
    """Pages of a run: as asked, else the profile's, within 1 and the ceiling."""
    return max(1, min(MAX_PAGES, default if asked is None else int(asked)))


def section_caps(override: str = "") -> dict[str, int]:
    """Default caps with ``name:n,...`` laid over them; malformed parts are ignored, fractions cut off."""
    caps = dict(SECTION_CAPS)
    for part in override.split(","):
        name, colon, number = part.partition(":")
        try:
            value = float(number)
        except ValueError:
            continue
        if colon and name.strip() and value >= 0 and value != float("inf"):
            caps[name.strip()] = int(value)
    return caps


def near_setting(value: str | None, default: int, low: int, high: int) -> int:
    """Integer setting of the near-duplicate rule; an explicit zero, like no number, is the default."""
    try:
        number = float(value or 0)
    except ValueError:
        number = 0
    return max(low, min(high, int(number or default)))
