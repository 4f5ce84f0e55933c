"""Task-text, link and embedded-JSON queries bound to the driver tables.

Mapping: a ``documents`` row is a captured task page; its first line is the
task title (``name``) and the remaining lines are the "expected from workers"
texts (``expected``). ``pages`` are captured HTML pages with their URL.
``benchmark`` passages play the seed product names of the contains join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import processors as P
from ..functions import urls as U
from ..operators import filters as D
from ..operators.joins import contains_join as _contains_join
from ..session import read_table


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.instr("text", "\n")
    name = F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text"))
    rest = F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    first_expected = F.when(cut > 0, F.substring_index(rest, "\n", 1))
    return d.select("doc_id", "text", name.alias("name"), rest.alias("expected_text"),
                    F.array(first_expected).alias("expected_head"))


def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid-review task flags (D1, D2, D3) and the URL tokens of each task."""
    t = _tasks(spark, sf_dir)
    return t.select("doc_id",
                    D.paid_review_task("name", "expected_head").cast("int").alias("paid_review"),
                    D.paid_app_review_text("name", "expected_text").cast("int").alias("paid_app_review"),
                    D.amazon_review_text("expected_text").cast("int").alias("amazon_review_any"),
                    F.size(U.text_urls("text")).cast("bigint").alias("n_urls"))


def number_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers-in-order -> typed task fields (C31, C6): t[0] work_done,
    t[1] work_total, t[2] payment, t[3] duration; C7 'n/a' rule on the
    source label."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    nums = P.numbers("text")
    return d.select("doc_id", F.size(nums).cast("bigint").alias("n_numbers"),
                    *P.numbers_to_fields(nums, ["work_done", "work_total", "payment", "duration"],
                                         ["bigint", "bigint", "double", "bigint"]),
                    P.na_to_double(F.regexp_extract("source", r"(\d+)$", 1)).alias("source_no"))


def array_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List processors over whole texts (C1-C5, C24): comma-split and strip,
    drop empties, join with a space; single-element and zero-or-one picks."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = P.split_strip("text", ",")
    kept = P.filter_empty(parts)
    first_line_parts = P.filter_empty(P.split_strip(F.get(F.split("text", "\n"), 0), ","))
    return d.select("doc_id",
                    F.size(parts).cast("bigint").alias("n_parts"),
                    F.size(kept).cast("bigint").alias("n_kept"),
                    F.sha2(F.array_join(kept, " "), 256).alias("joined_sha"),
                    P.only_elem(first_line_parts).alias("single"),
                    P.only_elem_or_default(first_line_parts, F.lit("-")).alias("single_or_default"))


def url_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per link of a page (E1) with the link resolved against the
    page URL (C21), its task-link branch (D10), amazon target (C27), app
    platform and id (C26) and chart id (C25)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    e = p.select("page_id", "url", F.posexplode(U.hrefs("html")).alias("pos", "href"))
    tgt = U.amazon_target("href")
    app = U.app_platform("href")
    return e.select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "href",
                    U.resolve_url("url", "href").alias("abs_url"),
                    U.link_kind("href").alias("link_kind"),
                    tgt["job_type"].alias("job_type"), tgt["amazon_id"].alias("amazon_id"),
                    app["platform"].alias("platform"), app["app_id"].alias("app_id"),
                    U.chart_id("href").alias("chart_id"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL parts of every page and the request URLs built from them (C21,
    C22, C25, E2): scheme, host, path, language segment, numeric id, page
    number, and the review-feed / reviewer URL templates for that id."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    path = U.url_part("url", "path")
    num_id = F.regexp_extract(path, r"/(\d+)", 1)
    page_no = F.regexp_extract(U.url_part("url", "query"), r"[?&]page=(\d+)", 1)
    page = F.when(page_no != "", page_no.cast("int")).otherwise(F.lit(1))
    return p.select("page_id", U.url_part("url", "scheme").alias("scheme"),
                    U.url_part("url", "host").alias("host"), path.alias("path"),
                    F.regexp_extract(path, r"^/([a-z]{2})/", 1).alias("lang"),
                    num_id.alias("num_id"), page.alias("page_no"),
                    U.review_feed_url(num_id, page).alias("review_url"),
                    U.reviewer_url(num_id, page).alias("reviewer_url"),
                    U.resolve_url("url", F.lit("../up")).alias("parent_url"))


def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON embedded in a text field (A5/A6): parse ``props`` with a schema
    and keep rows whose object has the field (empty result dropped)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    obj = F.from_json("props", "k bigint")
    return ev.select("event_id", obj["k"].alias("k")).where(F.col("k").isNotNull())


def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task texts x seed names: every (document, benchmark passage) where the
    whole passage occurs in the whole document text (F1)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    seeds = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("name"))
    j = _contains_join(docs, ["doc_id"], "text", seeds, "name")
    return j.select("doc_id", "item_id")


QUERIES = {
    "target_filter": target_filter,
    "number_fields": number_fields,
    "array_clean": array_clean,
    "url_explode": url_explode,
    "url_parts": url_parts,
    "embedded_json": embedded_json,
    "contains_join": contains_join,
}

_SPACE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = f"regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_AMAZON = r"[Aa][Mm][Aa]?[Zz][Oo]?[Nn]"
_REVIEW = r"[Rr][Ee][Vv][Ii][Ee][Ww][Ss]?|[Cc][Oo][Mm][Mm][Ee][Nn][Tt][Ss]?|[Qq][Uu][Ee][Ss][Tt][Ii][Oo][Nn][Ss]?"

ORACLE = {
    "target_filter": f"""
WITH t AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (
  SELECT doc_id, text, lines[1] AS name, coalesce(lines[2], '') AS e0, lines[2:] AS expected FROM t)
SELECT doc_id,
  ((regexp_matches(name, '{_AMAZON}') OR regexp_matches(name, '{_REVIEW}'))
   AND (regexp_matches(name, '{_AMAZON}') OR regexp_matches(e0, '{_AMAZON}'))
   AND (regexp_matches(name, '{_REVIEW}') OR regexp_matches(e0, '{_REVIEW}')))::INT AS paid_review,
  ((contains(lower(name), 'feedback') OR contains(lower(name), 'review') OR contains(lower(name), 'rate'))
   AND coalesce(list_bool_or(list_transform(expected, lambda x: contains(lower(x), 'https://') AND contains(lower(x), 'app'))), false))::INT
   AS paid_app_review,
  (coalesce(list_bool_or(list_transform(expected, lambda x: regexp_matches(x, '[Aa]mazon'))), false)
   AND coalesce(list_bool_or(list_transform(expected, lambda x: regexp_matches(x, '[Rr]eviews?|[Cc]omments?'))), false))::INT
   AS amazon_review_any,
  len(list_filter(regexp_extract_all(text, '(?:((https?://)?[\\w\\d?./=_-]+))', 1), lambda x: contains(x, '/')))::BIGINT AS n_urls
FROM u
""",
    "number_fields": r"""
WITH n AS (SELECT doc_id, source, regexp_extract_all(text, '\d+(?:(?:\.\d+))?') AS nums FROM documents)
SELECT doc_id, len(nums)::BIGINT AS n_numbers,
  CASE WHEN regexp_matches(nums[1], '^\d+$') THEN TRY_CAST(nums[1] AS BIGINT) END AS work_done,
  CASE WHEN regexp_matches(nums[2], '^\d+$') THEN TRY_CAST(nums[2] AS BIGINT) END AS work_total,
  TRY_CAST(nums[3] AS DOUBLE) AS payment,
  CASE WHEN regexp_matches(nums[4], '^\d+$') THEN TRY_CAST(nums[4] AS BIGINT) END AS duration,
  CASE WHEN lower(regexp_extract(source, '(\d+)$', 1)) <> 'n/a' THEN TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS DOUBLE) END AS source_no
FROM n
""",
    "array_clean": f"""
WITH p AS (
  SELECT doc_id, list_transform(string_split(text, ','), lambda x: {_STRIP}) AS parts,
         list_filter(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda x: {_STRIP}), lambda x: x IS NOT NULL AND x <> '') AS fl
  FROM documents)
SELECT doc_id, len(parts)::BIGINT AS n_parts,
  len(list_filter(parts, lambda x: x IS NOT NULL AND x <> ''))::BIGINT AS n_kept,
  sha256(array_to_string(list_filter(parts, lambda x: x IS NOT NULL AND x <> ''), ' ')) AS joined_sha,
  CASE WHEN len(fl) = 1 THEN fl[1] END AS single,
  CASE WHEN len(fl) = 0 THEN '-' WHEN len(fl) = 1 THEN fl[1] END AS single_or_default
FROM p
""",
    "url_explode": r"""
WITH h AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages),
e AS (SELECT page_id, url, unnest(range(1, len(hs) + 1)) AS pos, unnest(hs) AS href FROM h),
b AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 1) AS sch,
             regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS hst FROM e)
SELECT page_id, pos::BIGINT AS pos, href,
  CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
       WHEN starts_with(href, '//') THEN sch || ':' || href
       WHEN starts_with(href, '/') AND NOT regexp_matches(href, '(^|/)\.\.?(/|$|[?#])') THEN sch || '://' || hst || href
  END AS abs_url,
  CASE WHEN NOT contains(href, '/') THEN NULL WHEN contains(href, 'document') THEN 'document'
       WHEN contains(href, 'amazon') THEN 'amazon' WHEN contains(href, 'goo') OR contains(href, 'amzn') THEN 'short' END AS link_kind,
  CASE WHEN regexp_extract(href, '(?:(?:/review/)(\w+))', 1) <> '' THEN 'm'
       WHEN regexp_extract(href, '(?:(?:/gp/product/glance/)|(?:/gp/product/)|(?:/dp/))(\w+)', 1) <> '' THEN 'p' END AS job_type,
  CASE WHEN regexp_extract(href, '(?:(?:/review/)(\w+))', 1) <> '' THEN regexp_extract(href, '(?:(?:/review/)(\w+))', 1)
       WHEN regexp_extract(href, '(?:(?:/gp/product/glance/)|(?:/gp/product/)|(?:/dp/))(\w+)', 1) <> ''
       THEN regexp_extract(href, '(?:(?:/gp/product/glance/)|(?:/gp/product/)|(?:/dp/))(\w+)', 1) END AS amazon_id,
  CASE WHEN contains(href, 'google') THEN 'Google Play' ELSE 'App store' END AS platform,
  CASE WHEN contains(href, 'google') THEN regexp_extract(href, 'id=([\w.]+)', 1) ELSE regexp_extract(href, 'id(\d+)', 1) END AS app_id,
  regexp_extract(href, '/id(.*?)\?mt', 1) AS chart_id
FROM b
""",
    "url_parts": r"""
WITH u AS (SELECT page_id, url,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 1) AS scheme,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 3) AS host,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 4) AS path,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$', 5) AS query
  FROM pages),
v AS (SELECT *, regexp_extract(path, '/(\d+)', 1) AS num_id,
        CASE WHEN regexp_extract(query, '[?&]page=(\d+)', 1) <> '' THEN regexp_extract(query, '[?&]page=(\d+)', 1)::INT ELSE 1 END AS page_no,
        regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') AS base_dir
      FROM u)
SELECT page_id, scheme, host, path, regexp_extract(path, '^/([a-z]{2})/', 1) AS lang, num_id, page_no,
  printf('https://itunes.apple.com/%s/rss/customerreviews/page=%d/id=%s/sortBy=%s/xml', 'us', page_no, num_id, 'mostRecent') AS review_url,
  printf('https://itunes.apple.com/WebObjects/MZStore.woa/wa/viewUsersUserReviews?userProfileId=%s&page=%d&sort=14', num_id, page_no) AS reviewer_url,
  scheme || '://' || host || CASE WHEN len(string_split(base_dir, '/')) <= 3 THEN '/up'
     ELSE array_to_string(list_slice(string_split(base_dir, '/'), 1, len(string_split(base_dir, '/')) - 2), '/') || '/up' END AS parent_url
FROM v
""",
    "embedded_json": """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
WHERE TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL
""",
    "contains_join": """
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)
""",
}
