"""URL parsing, resolution, templates and link classification (Column exprs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from functools import reduce

from . import constants as C
from . import regexes as R
from .processors import ColumnOrName, _c

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

# --- fixed values: request URL templates of the app-store graph ---
LOOKUP_URL = "https://itunes.apple.com/lookup?id=%s"
REVIEW_FEED_URL = "https://itunes.apple.com/%s/rss/customerreviews/page=%d/id=%s/sortBy=%s/xml"
REVIEWER_URL = ("https://itunes.apple.com/WebObjects/MZStore.woa/wa/viewUsersUserReviews"
                "?userProfileId=%s&page=%d&sort=14")
DEVELOPER_URL = "https://itunes.apple.com/us/artist/id%s?iPhoneSoftwarePage=%d&iPadSoftwarePage=%d"
SORT_MODES = {"Most Recent": "mostRecent", "Most Helpful": "mostHelpful",
              "Most Favorable": "mostFavorable", "Most Critical": "mostCritical"}
NEXT_PAGE_VALUE = 5
MAX_PAGES = {"app": 10, "developer": 5, "reviewer": 30}
DEPTH_LIMIT = 3
CHART_LIMIT = 200
# --- end of fixed values ---


def url_part(url: ColumnOrName, part: str) -> Column:
    """scheme / host / path / query / fragment of an absolute URL ('' if absent).
    Regex based, so malformed URLs give '' instead of failing the task."""
    idx = {"scheme": 1, "host": 3, "path": 4, "query": 5, "fragment": 6}[part]
    return F.regexp_extract(_c(url), URL_PARTS, idx)


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal on a path, as a fold over its segments."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    trailing = F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), trailing)


def resolve_url(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Resolve ``href`` against ``base`` like ``urljoin``."""
    base, href = _c(base), _c(href)
    scheme = url_part(base, "scheme")
    host = url_part(base, "host")
    bpath = url_part(base, "path")
    origin = F.concat(scheme, F.lit("://"), host)
    base_dir = F.regexp_replace(F.when(bpath == "", F.lit("/")).otherwise(bpath), r"[^/]*$", "")
    h_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    h_rest = F.substring(href, F.length(h_path) + 1, 1 << 30)
    return (
        F.when(href.isNull(), F.lit(None))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, bpath, href))
        .when(href.startswith("/"), F.concat(origin, _remove_dot_segments(h_path), h_rest))
        .otherwise(F.concat(origin, _remove_dot_segments(F.concat(base_dir, h_path)), h_rest)))


def hrefs(html: ColumnOrName) -> Column:
    """All double-quoted href attribute values of an HTML text, in order."""
    return F.regexp_extract_all(_c(html), F.lit(r'href="([^"]*)"'), 1)


def text_urls(txt: ColumnOrName) -> Column:
    """URL-like tokens of a task text (E1): matches of the crawler's URL
    pattern that contain a '/'."""
    found = F.regexp_extract_all(_c(txt), F.lit(R.URL_TOKENS_WITH_SLASH), 0)
    return F.filter(found, lambda u: F.instr(u, "/") > 0)


def app_urls(txt: ColumnOrName) -> Column:
    """https app links of one expected text (E1, app-review tasks)."""
    return F.regexp_extract_all(_c(txt), F.lit(R.APP_URLS), 1)


def single_app_url(txt: ColumnOrName) -> Column:
    """The one app link of a text (C1): NULL when the text has none or several."""
    from .processors import only_elem
    return only_elem(app_urls(txt))


def link_kind(url: ColumnOrName) -> Column:
    """Link branch of a paid-review task (D10), first match wins:
    'document' (a shared document listing products), 'amazon' (product or
    review link), 'short' (goo.gl / amzn short link), else NULL."""
    u = _c(url)
    return (F.when(F.instr(u, "/") == 0, F.lit(None))
            .when(F.instr(u, C.DOCUMENT_MARKER) > 0, F.lit("document"))
            .when(F.instr(u, C.AMAZON_MARKER) > 0, F.lit("amazon"))
            .when(reduce(lambda a, b: a | b, [F.instr(u, m) > 0 for m in C.SHORT_LINK_MARKERS]), F.lit("short")))


def amazon_target(url: ColumnOrName) -> Column:
    """(job_type, amazon_id) of an amazon link (C27): a product id gives 'p',
    a review id gives 'm'; with both, the review id wins (added last)."""
    u = _c(url)
    prod = F.regexp_extract(u, R.PRODUCT_ID, 1)
    rev = F.regexp_extract(u, R.REVIEW_ID, 1)
    return (F.when(rev != "", F.struct(F.lit("m").alias("job_type"), rev.alias("amazon_id")))
            .when(prod != "", F.struct(F.lit("p").alias("job_type"), prod.alias("amazon_id"))))


def product_target(url: ColumnOrName) -> Column:
    """(job_type, amazon_id) of a resolved short link (C27/F5): only a product id counts there."""
    prod = F.regexp_extract(_c(url), R.PRODUCT_ID, 1)
    return F.when(prod != "", F.struct(F.lit("p").alias("job_type"), prod.alias("amazon_id")))


def app_platform(url: ColumnOrName) -> Column:
    """(platform, app_id) from an app URL (C26): Google Play by 'google' in
    the URL and ``id=<package>``, else App store and the digits after 'id'."""
    u = _c(url)
    g = F.instr(u, C.GOOGLE_MARKER) > 0
    return F.struct(F.when(g, F.lit(C.PLATFORM_GOOGLE)).otherwise(F.lit(C.PLATFORM_APPLE)).alias("platform"),
                    F.when(g, F.regexp_extract(u, R.GOOGLE_APP_ID_GROUP, 1))
                    .otherwise(F.regexp_extract(u, R.APPLE_APP_ID_GROUP, 1)).alias("app_id"))


def chart_id(link: ColumnOrName) -> Column:
    """App id of a chart entry link: text between '/id' and '?mt' (C25)."""
    return F.regexp_extract(_c(link), R.CHART_ID, 1)


def employer_id(href: ColumnOrName, pattern: str = R.MW_EMPLOYER_ID) -> Column:
    """Employer id from a profile link (C30), by the pattern of the site (case counts: ``x?jobid=3&Id=9`` is 9 on
    microworkers and 3 where the parameter is ``id``)."""
    return F.regexp_extract(_c(href), pattern, 1)


def short_link_url(url: ColumnOrName) -> Column:
    """Normalise a short link (F5): scheme-less ``goo.gl/<x>`` becomes
    ``https://www.goo.gl/<x>``; links with a scheme stay as they are."""
    u = _c(url)
    code = F.regexp_extract(u, R.SHORT_URL, 1)
    return (F.when(F.instr(u, "http") > 0, u)
            .when(code != "", F.concat(F.lit(C.SHORT_LINK_BASE), code)))


# ------------------------------------------------------------ templates
def lookup_url(app_id: ColumnOrName) -> Column:
    return F.format_string(LOOKUP_URL, _c(app_id))


def review_feed_url(app_id: ColumnOrName, page: ColumnOrName, country: str = "us",
                    sort_by: str = "Most Recent") -> Column:
    return F.format_string(REVIEW_FEED_URL, F.lit(country), _c(page).cast("int"), _c(app_id),
                           F.lit(SORT_MODES[sort_by]))


def reviewer_url(reviewer_id: ColumnOrName, page: ColumnOrName) -> Column:
    return F.format_string(REVIEWER_URL, _c(reviewer_id), _c(page).cast("int"))


def developer_url(dev_id: ColumnOrName, iphone_page: ColumnOrName, ipad_page: ColumnOrName) -> Column:
    return F.format_string(DEVELOPER_URL, _c(dev_id), _c(iphone_page).cast("int"), _c(ipad_page).cast("int"))


def chart_feed_url(country: ColumnOrName, list_name: ColumnOrName, genre: ColumnOrName | None = None,
                   limit: int = CHART_LIMIT) -> Column:
    """Chart feed URL; ``genre`` (NULL allowed) adds a ``genre=<id>`` segment."""
    g = F.concat(F.lit("genre="), _c(genre)) if genre is not None else F.lit(None)
    path = F.concat_ws("/", F.concat(F.lit("limit="), F.lit(limit)), g)
    return F.concat(F.lit("https://itunes.apple.com/"), _c(country), F.lit("/rss/"), _c(list_name),
                    F.lit("/"), path, F.lit("/xml"))
