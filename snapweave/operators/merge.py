"""Entity merges across crawls: developers (set union) and reviewers (append)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_developers(df: DataFrame, dev_key: str, app_col: str, ts_col: str,
                     first_fields: Sequence[str] = ()) -> DataFrame:
    """Developer merge (G3/J4/C28/C29): union of app ids (sorted, distinct),
    their count, the latest timestamp, other fields from the earliest row.

    ``app_col`` may be a scalar or an array column. ``collect_set`` combines
    map-side, so a developer seen in many rows is reduced before the shuffle;
    the merged list is bounded by the developer's distinct apps.
    """
    is_array = df.schema[app_col].dataType.typeName() == "array"
    app = F.explode_outer(app_col) if is_array else F.col(app_col)
    rows = df.select(dev_key, ts_col, app.alias("_app"), *first_fields)
    aggs = [F.array_sort(F.collect_set("_app")).alias("app_ids"),
            F.max(ts_col).alias("latest_ts")]
    if first_fields:
        aggs.append(F.min_by(F.struct(*first_fields), F.col(ts_col)).alias("_first"))
    out = rows.groupBy(dev_key).agg(*aggs).withColumn("n_apps", F.size("app_ids").cast("bigint"))
    if first_fields:
        out = out.select("*", "_first.*").drop("_first")
    return out


def append_pages(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column],
                 array_cols: Sequence[str], count_col: str | None, ts_col: str,
                 dedupe: bool = False, dedupe_on: Sequence[str] | None = None) -> DataFrame:
    """Reviewer merge (G4): parallel arrays of every page appended in arrival
    order, counts summed, latest timestamp kept.

    Arrays are carried as one array of structs per page so positions can never
    drift apart; ``dedupe`` drops repeated identical entries (a re-crawled
    page), ``dedupe_on`` keeps the first entry per value of the given fields
    (e.g. app id, date, title); default keeps all (parity with plain append).
    Output arrays are also exposed one per field (the wide compatibility view).
    """
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    page_items = F.arrays_zip(*[F.col(c) for c in array_cols])
    g = (df.groupBy(*keys)
         .agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), page_items.alias("_items")))).alias("_pages"),
              *( [F.sum(count_col).alias(count_col)] if count_col else []),
              F.max(ts_col).alias(ts_col)))
    items = F.flatten(F.transform("_pages", lambda p: p["_items"]))
    if dedupe:
        items = F.array_distinct(items)
    if dedupe_on:
        def same(x, y):
            cond = None
            for f in dedupe_on:
                c = x[f].eqNullSafe(y[f])
                cond = c if cond is None else cond & c
            return cond
        # keep an entry only if no earlier entry has the same key fields
        items = F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: same(x, y)))
    g = g.withColumn("items", items).drop("_pages")
    for c in array_cols:
        g = g.withColumn(c, F.transform("items", _field(c)))
    return g.withColumn("n_items", F.size("items").cast("bigint"))


def _field(name: str):
    return lambda x: x[name]


def grow_developers(stored: DataFrame | None, batch: DataFrame, dev_key: str, app_col: str, ts_col: str) -> DataFrame:
    """A batch of developer rows merged into stored results of ``merge_developers`` (G3): the union of both lists."""
    new = merge_developers(batch, dev_key, app_col, ts_col)
    if stored is None:
        return new
    both = stored.select(dev_key, "app_ids", "latest_ts").union(new.select(dev_key, "app_ids", "latest_ts"))
    return merge_developers(both, dev_key, "app_ids", "latest_ts").select(new.columns)


def grow_pages(stored: DataFrame | None, batch: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
               array_cols: Sequence[str], count_col: str, ts_col: str) -> DataFrame:
    """A batch of pages added to stored ones (G4): per key its pages as an array of (order, items), sorted by order, with the
    sum of ``count_col`` and the latest ``ts_col``. A page that comes again under the same order replaces itself.
    ``appended`` gives the arrays."""
    page = F.struct(F.struct(*order_cols).alias("o"), F.arrays_zip(*array_cols).alias("items"), F.col(count_col).alias("n"))
    new = batch.groupBy(*keys).agg(F.collect_list(page).alias("pages"), F.max(ts_col).alias(ts_col))
    both = new if stored is None else stored.select(new.columns).union(new)
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages"))))
    # equal orders stand side by side: the last one of each stays
    last = F.filter(pages, lambda x, i: (i == F.size(pages) - 1) | (pages[i + 1]["o"] != x["o"]))
    return both.groupBy(*keys).agg(last.alias("pages"), F.max(ts_col).alias(ts_col))


def appended(table: DataFrame, array_cols: Sequence[str], count_col: str) -> DataFrame:
    """The rows of ``grow_pages`` with their arrays in page order and the sum of the counts."""
    out = table.withColumn("_items", F.flatten(F.transform("pages", lambda p: p["items"])))
    for c in array_cols:
        out = out.withColumn(c, F.transform("_items", _field(c)))
    total = F.aggregate("pages", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return out.withColumn(count_col, total).drop("_items", "pages")


def attach_related(apps: DataFrame, related: DataFrame, key: str = "id",
                   related_col: str = "related_ids") -> DataFrame:
    """Attach related-app ids to existing apps only (F9): an update, never an
    insert; apps without related rows keep their current value. Re-apply after
    a whole-row replace (J2), which drops fields absent in the new row."""
    # several captures of one page: the longest list counts, then the largest, so an app stays one row
    r = (related.where(F.col(related_col).isNotNull()).groupBy(key)
         .agg(F.max(F.struct(F.size(related_col).alias("n"), F.col(related_col).alias("r")))["r"].alias("_rel")))
    out = apps.join(r, key, "left")
    if related_col in apps.columns:
        return out.withColumn(related_col, F.coalesce("_rel", F.col(related_col))).drop("_rel")
    return out.withColumnRenamed("_rel", related_col)
