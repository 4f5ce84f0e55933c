"""Regular expressions used by the extractors and filters.

All patterns are Java regex syntax (Spark's ``rlike`` / ``regexp_extract``).
"""

# --- fixed values: patterns whose matches must equal the original crawler's ---
AMAZON = r"[Aa][Mm][Aa]?[Zz][Oo]?[Nn]"
REVIEW = r"[Rr][Ee][Vv][Ii][Ee][Ww][Ss]?|[Cc][Oo][Mm][Mm][Ee][Nn][Tt][Ss]?|[Qq][Uu][Ee][Ss][Tt][Ii][Oo][Nn][Ss]?"
AMAZON_SIMPLE = r"[Aa]mazon"
REVIEW_SIMPLE = r"[Rr]eviews?|[Cc]omments?"
REVIEW_ID = r"(?:(?:/review/)(\w+))"
SHORT_URL = r"(?:(?:goo.gl/)([\w/]+))"
APP_URLS = r"(https://[\w\d?./=_-]+)"
APP_ID = r"/id(\d+)"
REVIEW_FEED_ID = r"mostRecent/(\d+)"
PAGE_NO = r"/page=(\d+)"
COUNTRY = r"\w+(?:(?:\s+\w+)+)?"
SOME_TEXT = r"\S+(?:(?:\s+\S+)+)?"
NUMBER = r"\d+(?:(?:\.\d+))?"
CHART_ID = r"/id(.*?)\?mt"
RECORDS_JS = r"var records = (.*);"
CAMPAIGN_NAME = r"Campaign Name\s*:\s+(.+)"
CAMPAIGN_ID = r"Campaign ID\s*:\s+(\S+)"
JOB_ID = r"Job ID:\s+(\w+)"
# --- end of fixed values ---

# URL tokens that contain '/': the matches of the task URL pattern kept by the task
# parser, found directly. A match starts only where a token starts (lookbehind)
# and the scheme branch needs a character after '://', exactly like the
# original greedy pattern; scanning a long text then yields only the few URL
# tokens instead of every word (equivalence is property-tested).
URL_TOKENS_WITH_SLASH = r"(?<![\w?./=_-])(?:https?://[\w?./=_-]+|[\w?./=_-]*/[\w?./=_-]*)"

# Deliberate fix of a trap in the original product pattern: with the plain
# "/gp/product/" alternative first, "/gp/product/glance/X" yields "glance".
PRODUCT_ID = r"(?:(?:/gp/product/glance/)|(?:/gp/product/)|(?:/dp/))(\w+)"

# Group-capturing equivalents of the lookbehind patterns; these run on engines
# without lookbehind (RE2) and give the same match.
GOOGLE_APP_ID_GROUP = r"id=([\w.]+)"
APPLE_APP_ID_GROUP = r"id(\d+)"
# Profile links carry "Id=" on microworkers and "id=" on the other sites, in that case only.
MW_EMPLOYER_ID = r"Id=(\w+)"
SITE_ID = r"id=(\w+)"

# Characters Python\'s str.strip() removes (str.isspace() is true); Spark\'s trim
# only removes ASCII spaces, so stripping trims this explicit set.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")
