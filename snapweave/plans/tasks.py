"""Task queries on texts and links that are made from whole driver tables.

The driver's documents hold no product links, so the classifiers have one answer
for all of them. Here every app (``part`` row) becomes a task whose title, expected
texts and links follow from its columns, so that each rule meets both outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import processors as P
from ..functions import regexes as R
from ..functions import urls as U
from ..operators import filters as D
from ..operators import ranks as K
from ..session import read_table
from ..sources.extract import same_as_page_before

TITLES = ["Amazon purchase", "Write a Review on amzn", "App feedback", "Read comments of AMAZON", "Etsy shop"]
LINKS = ["https://www.amazon.com/dp/B", "www.amazon.com/gp/product/glance/G", "https://amazon.com/review/R", "goo.gl/s",
         "https://docs.site.com/document/d", "http://shop.example/item"]
APP_LINKS = ["https://play.google.com/store/apps/details?id=com.app", "https://itunes.apple.com/us/app/x/id", "none for "]
PAYMENTS = ["n/a", " N/A ", "0.25", "x"]


def _pick(values: list[str], number) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paid-review rules (D1, D2, D3), URL tokens (E1), link branches (D10) and ids of links (C25, C26, C27), 'n/a' numbers."""
    key, size = F.col("p_partkey"), F.col("p_size")
    link = F.concat(_pick(LINKS, key), key.cast("string"))
    app = F.concat(_pick(APP_LINKS, size), key.cast("string"))
    said = F.when(size % 4 == 0, "then leave a Review").when(size % 4 == 1, "and Comment").otherwise("and go")
    t = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", _pick(TITLES, size), "p_name").alias("name"), link.alias("link"), app.alias("app"),
        F.array(F.concat_ws(" ", F.lit("Visit"), link, said), F.concat_ws(" ", F.lit("Get"), app, link)).alias("expected"),
        _pick(PAYMENTS, size).alias("payment"))
    target, platform = U.amazon_target("link"), U.app_platform("app")
    return t.select(
        "p_partkey",
        D.paid_review_task("name", "expected").cast("int").alias("paid_review"),
        D.paid_app_review_task("name", "expected").cast("int").alias("paid_app_review"),
        D.amazon_review_cumulative("expected").cast("int").alias("amazon_review_any"),
        F.size(F.flatten(F.transform("expected", U.text_urls))).cast("bigint").alias("n_urls"),
        U.link_kind("link").alias("link_kind"), target["job_type"].alias("job_type"), target["amazon_id"].alias("amazon_id"),
        platform["platform"].alias("platform"), platform["app_id"].alias("app_id"),
        U.chart_id(F.concat("app", F.lit("?mt=8"))).alias("chart_id"), P.na_to_double("payment").alias("payment"))


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name -> code lookup with its guard (C23): every customer asks for its nation's name, those of negative balance
    misspelt; valid requests with the code, rejected ones without."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").cast("bigint").alias("code"))
    asked = (c.join(n.select("n_nationkey", "n_name"), c.c_nationkey == n.n_nationkey)
             .select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("country")))
    valid, rejected = K.lookup_codes(asked, "country", n.select("n_name", "code"), "n_name", "code")
    cols = ["c_custkey", "country"]
    return (valid.select(*cols, "code", F.lit(1).alias("valid"))
            .unionByName(rejected.select(*cols, F.lit(None).cast("bigint").alias("code"), F.lit(0).alias("valid"))))


def developer_page_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous-page rule (H4): a supplier's line items of one ship month are a page, its returned quantities above 48 the iPad
    list; where it equals the list of the page before, only the open items count."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("page"), "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    ipad = F.when((F.col("l_quantity") > 48) & (F.col("l_returnflag") == "R"), F.col("l_quantity").cast("bigint"))
    pages = (li.groupBy("l_suppkey", "page")
             .agg(F.array_sort(F.collect_set(ipad)).alias("ipads"), F.count("*").alias("n_all"),
                  F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("n_open")))
    same = same_as_page_before("ipads", "l_suppkey", "page")
    pages = pages.withColumn("same", same)
    return pages.select("l_suppkey", "page", F.array_join("ipads", ",").alias("ipads"), F.col("same").cast("int").alias("same_as_before"),
                        F.when(F.col("same"), F.col("n_open")).otherwise(F.col("n_all")).alias("n_items"))


QUERIES = {"task_texts": task_texts, "code_requests": code_requests, "developer_page_rule": developer_page_rule}


def _list(values: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({number}) % {len(values)} + 1]"


_TITLE = " OR ".join(f"contains(lower(name), '{w}')" for w in C.APP_REVIEW_TITLE_WORDS)
_MARKED = " AND ".join(f"contains(lower(x), '{w}')" for w in C.APP_LINK_MARKERS)
_SHORT = " OR ".join(f"contains(link, '{m}')" for m in C.SHORT_LINK_MARKERS)

ORACLE = {
    "task_texts": f"""
WITH a AS (
  SELECT p_partkey, {_list(TITLES, 'p_size')} || ' ' || p_name AS name, {_list(LINKS, 'p_partkey')} || p_partkey AS link,
         {_list(APP_LINKS, 'p_size')} || p_partkey AS app, {_list(PAYMENTS, 'p_size')} AS payment,
         CASE p_size % 4 WHEN 0 THEN 'then leave a Review' WHEN 1 THEN 'and Comment' ELSE 'and go' END AS said FROM part),
t AS (SELECT *, 'Visit ' || link || ' ' || said AS e0, 'Get ' || app || ' ' || link AS e1 FROM a),
x AS (SELECT *, regexp_extract(link, '{R.REVIEW_ID}', 1) AS rev, regexp_extract(link, '{R.PRODUCT_ID}', 1) AS prod,
        contains(app, '{C.GOOGLE_MARKER}') AS google, regexp_extract(app || '?mt=8', '{R.CHART_ID}', 1) AS chart_id FROM t)
SELECT p_partkey,
  ((regexp_matches(name, '{R.AMAZON}') OR regexp_matches(name, '{R.REVIEW}'))
   AND (regexp_matches(name, '{R.AMAZON}') OR regexp_matches(e0, '{R.AMAZON}'))
   AND (regexp_matches(name, '{R.REVIEW}') OR regexp_matches(e0, '{R.REVIEW}')))::INT AS paid_review,
  (({_TITLE}) AND len(list_filter([e0, e1], lambda x: {_MARKED})) > 0)::INT AS paid_app_review,
  (len(list_filter([e0, e1], lambda x: regexp_matches(x, '{R.AMAZON_SIMPLE}'))) > 0
   AND len(list_filter([e0, e1], lambda x: regexp_matches(x, '{R.REVIEW_SIMPLE}'))) > 0)::INT AS amazon_review_any,
  len(list_filter(string_split(e0 || ' ' || e1, ' '), lambda x: contains(x, '/')))::BIGINT AS n_urls,
  CASE WHEN NOT contains(link, '/') THEN NULL WHEN contains(link, '{C.DOCUMENT_MARKER}') THEN 'document'
       WHEN contains(link, '{C.AMAZON_MARKER}') THEN 'amazon' WHEN {_SHORT} THEN 'short' END AS link_kind,
  CASE WHEN rev <> '' THEN 'm' WHEN prod <> '' THEN 'p' END AS job_type,
  CASE WHEN rev <> '' THEN rev WHEN prod <> '' THEN prod END AS amazon_id,
  CASE WHEN google THEN '{C.PLATFORM_GOOGLE}' ELSE '{C.PLATFORM_APPLE}' END AS platform,
  CASE WHEN google THEN regexp_extract(app, '{R.GOOGLE_APP_ID_GROUP}', 1) ELSE regexp_extract(app, '{R.APPLE_APP_ID_GROUP}', 1) END AS app_id,
  chart_id, CASE WHEN lower(trim(payment)) <> 'n/a' THEN TRY_CAST(payment AS DOUBLE) END AS payment
FROM x
""",
    "code_requests": """
WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN n_name || '?' ELSE n_name END AS country
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, country, n_nationkey::BIGINT AS code, (n_name IS NOT NULL)::INT AS valid FROM a LEFT JOIN nation ON n_name = country
""",
    "developer_page_rule": """
WITH p AS (
  SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS page, count(*) AS n_all, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
         coalesce(list_sort(list_distinct(list(l_quantity::BIGINT) FILTER (WHERE l_quantity > 48 AND l_returnflag = 'R'))), []) AS ipads
  FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(ipads = lag(ipads) OVER (PARTITION BY l_suppkey ORDER BY page), false) AS same FROM p)
SELECT l_suppkey, page, array_to_string(ipads, ',') AS ipads, same::INT AS same_as_before, CASE WHEN same THEN n_open ELSE n_all END AS n_items FROM b
""",
}
