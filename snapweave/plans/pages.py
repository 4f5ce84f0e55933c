"""Captured-page extraction queries bound to the driver ``pages`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from ..sources.html import page_fields, to_xhtml, xpath_fields


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fields in one parse per page (A9/M2): title, h1, lang, numbers
    of links, ad blocks and paragraphs."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    return page_fields(p, ["page_id"])


NAV_SPEC = {
    "nav_links": ("count", "//nav//a"),
    "first_nav": ("string", "(//nav//a)[1]"),
    "article_paragraphs": ("count", "//article//p"),
    "footer": ("string", "//footer"),
}


def page_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec-driven extraction (A9/M1/M2): pages are repaired to XHTML once,
    then a field -> XPath table runs as built-in JVM xpath functions."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    x = p.select("page_id", to_xhtml("html").alias("xml"))
    return xpath_fields(x, "xml", NAV_SPEC, keep=["page_id"])


QUERIES = {
    "page_extract": page_extract,
    "page_xpath": page_xpath,
}

# HTML5 decodes the legacy entities amp, lt, gt, quot and copy also without ';'
_ENT = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "replace(replace({x}, '&#39;', ''''), '&middot;', '·'), '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), "
        "'&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g')")

ORACLE = {
    "page_xpath": f"""
WITH s AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
                  regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art,
                  regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot FROM pages)
SELECT page_id,
  len(regexp_extract_all(nav, '<a[\\s>]'))::BIGINT AS nav_links,
  {_ENT.format(x="regexp_replace(regexp_extract(nav, '(?s)<a[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')")} AS first_nav,
  len(regexp_extract_all(art, '<p[\\s>]'))::BIGINT AS article_paragraphs,
  {_ENT.format(x="regexp_replace(foot, '<[^>]*>', '', 'g')")} AS footer
FROM s
""",
    "page_extract": f"""
SELECT page_id,
  CASE WHEN regexp_matches(html, '<title>') THEN {_ENT.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} END AS title,
  CASE WHEN regexp_matches(html, '<h1>') THEN {_ENT.format(x="regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")} END AS h1,
  nullif(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), '') AS lang,
  len(regexp_extract_all(html, '<a[\\s>]'))::BIGINT AS n_links,
  len(regexp_extract_all(html, '<div class="ad"'))::BIGINT AS n_ads,
  len(regexp_extract_all(html, '<p[\\s>]'))::BIGINT AS n_paragraphs
FROM pages
""",
}
