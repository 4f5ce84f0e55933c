"""App-store graph job: captured responses -> entity tables + reached graph.

``captured(kind, entity_id, page, referrer, fetched_at, body)`` holds one row
per captured response, ``kind`` in {app_lookup, review_feed, reviewer_page,
related_page, developer_page}. The job extracts each kind (N11-N15), keeps the
latest row per key (J2/H7), appends reviewer pages (G4), merges developer
pages (G3), attaches related apps (F9), builds the entity edges (E4) and
expands from the seed apps up to the depth limit (K1-K4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import DEPTH_LIMIT
from ..operators import graph as G
from ..operators.dedupe import latest_per_key
from ..operators.merge import append_pages, attach_related, merge_developers
from ..sources.embedded import app_lookup_rows
from ..sources.extract import developer_pages, related_pages, reviewer_blocks, reviewer_pages
from ..sources.feeds import feed_page_counts, review_feed_rows


#: the parallel arrays of a reviewer, one entry per review
REVIEW_ARRAYS = ["item_id", "media_kind", "rating", "review_date", "version", "developer_id", "genre", "release", "title", "review_text"]


def _kind(captured: DataFrame, kind: str) -> DataFrame:
    return captured.where(F.col("kind") == kind)


def app_graph(captured: DataFrame, seed_apps: DataFrame, max_depth: int = DEPTH_LIMIT) -> dict[str, DataFrame]:
    """Entity tables and the reached nodes of one crawl's captured responses."""
    lookups = _kind(captured, "app_lookup").select("referrer", F.col("fetched_at").alias("crawl_ts"), "body")
    apps = latest_per_key(app_lookup_rows(lookups), ["id"], ["crawl_ts"])

    feeds = _kind(captured, "review_feed").select(F.col("entity_id").alias("app_id"), "fetched_at", "body")
    reviews = latest_per_key(review_feed_rows(feeds, stamp_col="fetched_at"), ["id"], ["updated", "timestamp", "position"])

    rv_pages = _kind(captured, "reviewer_page").select(F.col("entity_id").alias("reviewer_id"), "page",
                                                        "fetched_at", "referrer", F.col("body").alias("html"))
    page_key = ["reviewer_id", "page", "fetched_at"]
    blocks = reviewer_blocks(rv_pages, page_key)
    per_page = (blocks.groupBy("reviewer_id", "page", "fetched_at")
                .agg(F.array_sort(F.collect_list(F.struct("block_pos", *REVIEW_ARRAYS))).alias("_b"))
                .select(*page_key, *[F.transform("_b", (lambda n: lambda x: x[n])(n)).alias(n) for n in REVIEW_ARRAYS],
                        F.size("_b").cast("bigint").alias("n_reviews")))
    # arrival order: when a page was fetched, then its number
    reviewers = append_pages(per_page, ["reviewer_id"], ["fetched_at", "page"], REVIEW_ARRAYS, "n_reviews", "fetched_at")
    head = reviewer_pages(rv_pages.withColumnRenamed("page", "asked"), ["reviewer_id", "asked", "fetched_at", "referrer"])
    head = head.groupBy("reviewer_id").agg(F.min_by(F.struct("reviewer_name", "referrer"), F.struct("fetched_at", "asked")).alias("_h"))
    reviewers = reviewers.join(head.select("reviewer_id", "_h.*"), "reviewer_id", "left")

    rel = related_pages(_kind(captured, "related_page").select(F.col("entity_id").alias("id"),
                                                               F.col("body").alias("html")), ["id"])
    apps = attach_related(apps, rel.select("id", "related_ids"))

    dev_raw = developer_pages(_kind(captured, "developer_page").select(
        F.col("entity_id").alias("developer_id"), "page", "referrer", "fetched_at", F.col("body").alias("html")),
        ["developer_id", "page", "referrer", "fetched_at"], referrer_col="referrer", along=("developer_id", "page"))
    developers = merge_developers(dev_raw, "developer_id", "app_ids", "fetched_at", ["name", "referrer", "app_types", "is_leaf"])

    app_items = blocks.where(F.col("media_kind") == "app")
    edges = G.node_union([
        G.edges_from(reviews, "app", "app_id", "reviewer", "reviewer_id", "review_reviewer"),
        G.edges_from(app_items, "reviewer", "reviewer_id", "app", "item_id", "reviewer_app"),
        G.edges_from(apps.where(F.col("related_ids").isNotNull()), "app", "id", "app", "related_ids", "also_bought"),
        G.edges_from(rel.where(F.col("developer_id").isNotNull()), "app", "id", "developer", "developer_id", "app_developer"),
        G.edges_from(apps.where(F.col("developer_id").isNotNull()), "app", "id", "developer", "developer_id",
                     "app_developer"),
        # a leaf page ends the expansion
        G.edges_from(developers.where("not is_leaf"), "developer", "developer_id", "app", "app_ids", "developer_app"),
    ])
    seeds = seed_apps.select(F.lit("app").alias("node_type"), F.col("app_id").cast("string").alias("node_id"))
    nodes = G.bounded_bfs(seeds, edges.select("src_type", F.col("src_id").cast("string").alias("src_id"),
                                              "dst_type", F.col("dst_id").cast("string").alias("dst_id"), "kind"),
                          max_depth)
    return {"apps": apps, "reviews": reviews, "reviewers": reviewers, "developers": developers,
            "edges": edges, "nodes": nodes, "feed_counts": feed_page_counts(feeds)}
