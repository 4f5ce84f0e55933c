"""Atom feeds (review feeds, chart feeds) captured as XML text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions.processors import join_clean
from ..functions.urls import CHART_LIMIT, chart_id
from ..operators.ranks import feed_positions

LINK = "array<struct<_href:string,_rel:string,_type:string>>"

REVIEW_FEED_SCHEMA = (
    f"updated string, title string, link {LINK}, "
    "entry array<struct<id:string, title:string, updated:string, "
    "content:array<struct<_VALUE:string,_type:string>>, "
    "author:struct<name:string,uri:string>, `im:rating`:string, `im:version`:string, "
    f"`im:voteCount`:string, link:{LINK}>>"
)

CHART_FEED_SCHEMA = (
    f"updated string, title string, link {LINK}, "
    f"entry array<struct<id:string, title:string, updated:string, link:{LINK}>>"
)


def _ts(x):
    """Atom time (ISO 8601 with offset) -> TIMESTAMP in UTC."""
    return F.to_timestamp(x, "yyyy-MM-dd'T'HH:mm:ssXXX")


def review_feed_rows(feeds: DataFrame, body_col: str = "body", app_col: str = "app_id",
                     country: str = "us", stamp_col: str | None = None) -> DataFrame:
    """Review feed pages -> one row per review (A7/N12). Entry 0 describes the
    app itself and is skipped; an empty feed gives no rows (D7). The number of
    feed pages comes from the page number of the ``rel=last`` link (E2).
    ``stamp_col`` is the time a page was fetched, carried as ``timestamp``."""
    stamp = [F.col(stamp_col).alias("timestamp")] if stamp_col else []
    f = feeds.select(app_col, *stamp, F.from_xml(body_col, REVIEW_FEED_SCHEMA).alias("f"))
    last = F.filter("f.link", lambda l: l["_rel"] == "last")
    n_pages = F.regexp_extract(F.get(last, 0)["_href"], R.PAGE_NO, 1)
    e = f.select(app_col, *(["timestamp"] if stamp_col else []), F.when(n_pages != "", n_pages.cast("int")).alias("n_pages"),
                 F.posexplode("f.entry").alias("pos", "e")).where(F.col("pos") > 0)
    text = F.filter("e.content", lambda c: F.coalesce(c["_type"], F.lit("text")) == "text")
    return e.select(
        F.regexp_extract("e.id", R.REVIEW_FEED_ID, 1).alias("id"),
        F.col(app_col).alias("app_id"),
        F.col("e.title").alias("title"),
        join_clean(F.transform(text, lambda c: c["_VALUE"])).alias("comment"),
        F.col("e.author.name").alias("reviewer_name"),
        F.regexp_extract("e.author.uri", R.APP_ID, 1).alias("reviewer_id"),
        F.col("e.`im:rating`").cast("int").alias("rating"),
        F.col("e.`im:version`").alias("version"),
        F.col("e.`im:voteCount`").cast("bigint").alias("vote"),
        F.lit(country).alias("country"),
        _ts("e.updated").alias("updated"),
        F.col("pos").alias("position"), "n_pages", *(["timestamp"] if stamp_col else []))


def feed_page_counts(feeds: DataFrame, body_col: str = "body") -> DataFrame:
    """One row: feed pages read, with reviews, without a review, and not readable (no id and no entry to be
    found in them, null and blank ones included), and the reviews; one pass, so lost pages show (A7/G7)."""
    f = F.from_xml(body_col, REVIEW_FEED_SCHEMA)
    n = F.greatest(F.coalesce(F.size(f["entry"]), F.lit(-1)) - 1, F.lit(-1))        # entry 0 is the app
    readable = f.isNotNull() & (f["entry"].isNotNull() | f["link"].isNotNull())
    p = feeds.select(F.coalesce(readable, F.lit(False)).alias("ok"), n.alias("n"))
    count = lambda cond: F.count_if(cond).cast("bigint")
    return p.agg(F.count(F.lit(1)).cast("bigint").alias("n_pages"), count(F.col("ok") & (F.col("n") > 0)).alias("n_with_reviews"),
                 count(F.col("ok") & (F.col("n") <= 0)).alias("n_without_reviews"), count(~F.col("ok")).alias("n_unreadable"),
                 F.coalesce(F.sum(F.when(F.col("ok"), F.greatest("n", F.lit(0)))), F.lit(0)).cast("bigint").alias("n_reviews"))


def chart_rows(feeds: DataFrame, body_col: str = "body", keys=("country", "list_name", "genre"),
               limit: int | None = None) -> DataFrame:
    """Chart feed -> (rank, id, title, link, updated) per entry (A8/H3/C25),
    rank = 1-based position in the feed, cut at ``limit`` if one is given (I3); the feed
    title travels along."""
    keys = [k for k in keys if k in feeds.columns]
    f = feeds.select(*keys, F.from_xml(body_col, CHART_FEED_SCHEMA).alias("f"))
    f = f.select(*keys, F.col("f.title").alias("feed_title"), F.col("f.entry").alias("entries"))
    p = feed_positions(f, [*keys, "feed_title"], "entries", limit)
    return p.select(*keys, "feed_title", "rank", chart_id("entry.id").alias("id"),
                    F.col("entry.title").alias("title"), F.col("entry.id").alias("link"),
                    _ts("entry.updated").alias("updated"))
