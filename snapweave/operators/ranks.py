"""Chart ranks: positions in feeds, top-k charts, first-list rank lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import CHART_LIMIT

# --- fixed values: chart lists in declaration (priority) order, countries, genres ---
CHART_LISTS = [
    ("topfreeapplications", "Top Free"),
    ("toppaidapplications", "Top Paid"),
    ("topgrossingapplications", "Top Grossing"),
    ("topfreeipadapplications", "Top Free iPad"),
    ("toppaidipadapplications", "Top Paid iPad"),
    ("topgrossingipadapplications", "Top Grossing iPad"),
    ("topmacapps", "Top Mac Apps"),
]
COUNTRIES = [("China", "cn"), ("United States", "us")]
GENRES = [
    ("None", None), ("Books", "6018"), ("Business", "6000"), ("Catalogs", "6022"),
    ("Education", "6017"), ("Entertainment", "6016"), ("Finance", "6015"),
    ("Food & Drink", "6023"), ("Games", "6014"), ("Health & Fitness", "6013"),
    ("Lifestyle", "6012"), ("Medical", "6020"), ("Music", "6011"), ("Navigation", "6010"),
    ("News", "6009"), ("Newsstand", "6021"), ("Photo & Video", "6008"),
    ("Productivity", "6007"), ("Reference", "6006"), ("Social Networking", "6005"),
    ("Sports", "6004"), ("Travel", "6003"), ("Utility", "6002"), ("Weather", "6001"),
]
# --- end of fixed values ---



def sort_order(mode: str) -> list[Column]:
    """Column ordering of a review sort mode."""
    return {
        "mostRecent": [F.col("updated").desc()],
        "mostHelpful": [F.col("vote").desc_nulls_last(), F.col("updated").desc()],
        "mostFavorable": [F.col("rating").desc(), F.col("updated").desc()],
        "mostCritical": [F.col("rating").asc(), F.col("updated").desc()],
    }[mode]


def feed_positions(entries: DataFrame, feed_cols: Sequence[str], entries_col: str,
                   limit: int | None = None) -> DataFrame:
    """One row per feed entry with its 1-based position (A8/H3/I3); the
    position is the order inside one feed document, so no window is needed."""
    e = entries.select(*feed_cols, F.posexplode(entries_col).alias("_pos", "entry"))
    e = e.withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")
    return e.where(F.col("rank") <= limit) if limit else e


def top_k(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int = CHART_LIMIT,
          rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group with a 1-based rank. ``row_number() <= k`` is
    planned with a partial window group limit before the shuffle, so each map
    task forwards at most k rows per group (a hot group stays small)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def first_list_rank(items: DataFrame, item_key: str, charts: DataFrame,
                    list_col: str = "list_name", priority_col: str = "priority",
                    rank_col: str = "rank") -> DataFrame:
    """Rank of each item in the first chart (by priority) that contains it
    (F3/I4). Items in no chart keep NULL list and rank (left join)."""
    best = (charts.groupBy(item_key)
            .agg(F.min_by(F.struct(F.col(list_col).alias("list_name"), F.col(rank_col).alias("rank")),
                          F.struct(priority_col, rank_col)).alias("_b")))
    return (items.join(best, item_key, "left")
            .select(*items.columns, F.col("_b.list_name").alias("list_name"), F.col("_b.rank").alias("rank")))


def ranks_for_ids(chart: DataFrame, ids: DataFrame, item_key: str, rank_col: str = "rank") -> DataFrame:
    """Ranks of a set of ids in one chart (F4): semi-join to the id set, first
    hit per id."""
    hits = chart.join(ids.select(item_key).distinct(), item_key, "left_semi")
    return hits.groupBy(item_key).agg(F.min(rank_col).alias(rank_col))


def order_reviews(reviews: DataFrame, mode: str = "mostRecent") -> DataFrame:
    """Review sort modes (I5) as an ordering of a review table."""
    return reviews.orderBy(*sort_order(mode))


def chart_requests(requests: DataFrame, country_col: str = "country", list_col: str = "list_name",
                   genre_col: str = "genre", limit: int = CHART_LIMIT):
    """Chart feed requests by names (C22/C23): country name -> code, chart
    list name -> feed name, genre name -> id ('None' or NULL for all genres);
    rows with an unknown name are returned separately as rejected."""
    from ..functions.urls import chart_feed_url
    spark = requests.sparkSession
    countries = spark.createDataFrame(COUNTRIES, "c_name string, c_code string")
    lists = spark.createDataFrame([(label, feed) for feed, label in CHART_LISTS], "l_name string, l_feed string")
    genres = spark.createDataFrame(GENRES, "g_name string, g_code string")
    r = requests.withColumn(genre_col, F.coalesce(F.col(genre_col), F.lit("None")))
    ok, bad1 = lookup_codes(r, country_col, countries, "c_name", "c_code")
    ok, bad2 = lookup_codes(ok, list_col, lists, "l_name", "l_feed")
    ok, bad3 = lookup_codes(ok, genre_col, genres, "g_name", "g_code")
    valid = ok.withColumn("url", chart_feed_url(F.col("c_code"), F.col("l_feed"), F.col("g_code"), limit))
    cols = requests.columns
    rejected = bad1.select(*cols).unionByName(bad2.select(*cols)).unionByName(bad3.select(*cols))
    return valid, rejected


def lookup_codes(requests: DataFrame, name_col: str, dim: DataFrame, dim_name: str, dim_code: str):
    """Name -> code lookup with an invalid-name guard (C23): returns
    (valid rows with the code, rejected rows). ``dim`` is a small fixed
    table; it is broadcast only after its size is measured."""
    from .joins import checked_broadcast
    d = dim.select(F.col(dim_name).alias(name_col), F.col(dim_code).alias("_code"), F.lit(True).alias("_hit"))
    j = requests.join(checked_broadcast(d, [name_col, "_code"]), name_col, "left")
    valid = j.where(F.col("_hit")).withColumnRenamed("_code", dim_code).drop("_hit")
    rejected = j.where(F.col("_hit").isNull()).drop("_code", "_hit")
    return valid, rejected
