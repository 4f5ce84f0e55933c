"""Paid-review task discovery: captured task pages -> stored task rows.

Composition of the library operators, in the order the crawler applies them:
job page fields and the not-running guard (N2/D4), the paid-review predicate
(D1), URL tokens of the expected texts (E1), the link branch (D10), then per
branch the seed contains join (F1, over the expected texts joined with '',
C32), the amazon target of the link (C27) or of its resolved short link (F5),
and finally insert-if-absent on (task id, amazon id) in arrival order (F7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.processors import crawl_stamp, flatten_text
from ..functions.urls import amazon_target, product_target, link_kind, text_urls
from ..operators.dedupe import greedy_two_key
from ..operators.filters import paid_review_task
from ..operators.joins import contains_join, resolve_links
from ..sources.extract import task_job_pages

JOB_COLS = ["url", "id", "name", "work_done", "work_total", "payment", "duration", "countries"]


def paid_review_tasks(job_pages: DataFrame, seeds: DataFrame, resolved: DataFrame | None = None,
                      existing: DataFrame | None = None, crawl_ts: str | None = None) -> DataFrame:
    """``job_pages(url, html)``, ``seeds(TYPE, ID, NAME)``, optional
    ``resolved(short_url, final_url)`` and stored ``existing(id, amazonId)``
    -> new task rows (url, id, name, numbers, countries, jobType, amazonId,
    timestamp)."""
    jobs = task_job_pages(job_pages, ["url"])
    jobs = jobs.where(paid_review_task("name", "expected"))
    links = jobs.select(*JOB_COLS, "expected",
                        F.posexplode(F.flatten(F.transform("expected", text_urls))).alias("link_pos", "link"))
    links = links.withColumn("kind", link_kind("link")).where(F.col("kind").isNotNull())

    doc_jobs = (links.where(F.col("kind") == "document").select(*JOB_COLS, "expected", "link_pos")
                .withColumn("_text", flatten_text("expected")))
    seed_side = seeds.select(F.col("TYPE").alias("_seed_type"), F.col("ID").alias("_seed_id"),
                             F.col("NAME").alias("_seed_name"))
    by_seed = (contains_join(doc_jobs, [*JOB_COLS, "link_pos"], "_text", seed_side, "_seed_name")
               .select(*JOB_COLS, "link_pos", F.col("_seed_type").alias("jobType"),
                       F.col("_seed_id").alias("amazonId")))

    amazon = links.where(F.col("kind") == "amazon").withColumn("_t", amazon_target("link"))
    by_link = amazon.select(*JOB_COLS, "link_pos", F.col("_t.job_type").alias("jobType"),
                            F.col("_t.amazon_id").alias("amazonId"))

    parts = [by_seed, by_link]
    if resolved is not None:
        short = resolve_links(links.where(F.col("kind") == "short"), "link", resolved)
        short = short.where(F.col("final_url").isNotNull()).withColumn("_t", product_target("final_url"))
        parts.append(short.select(*JOB_COLS, "link_pos", F.col("_t.job_type").alias("jobType"),
                                  F.col("_t.amazon_id").alias("amazonId")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.where(F.col("amazonId").isNotNull())  # a link without a product id is no task
    found = found.withColumn("timestamp", crawl_stamp(crawl_ts))
    stored = greedy_two_key(found, "id", "amazonId", ["url", "link_pos"], existing=existing)
    return stored.drop("link_pos")
