"""Item exports and the compressed-history writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators.dedupe import upsert


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ("spider", "item_type", "crawl_ts"),
                mode: str = "append", compression: str | None = None) -> None:
    """One JSON object per line, one folder per (spider, item type, crawl
    time) (B1). NULL fields are omitted, i.e. absent, like sparse items."""
    w = df.write.mode(mode).option("ignoreNullFields", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
    if compression:
        w = w.option("compression", compression)
    parts = [c for c in partition_by if c in df.columns]
    (w.partitionBy(*parts) if parts else w).json(path)


def flatten_arrays(df: DataFrame, sep: str = ",") -> DataFrame:
    """Array columns joined into text so they fit a CSV cell (B2)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.array_join(c.cast("array<string>"), sep).alias(f.name)
                    if isinstance(f.dataType, ArrayType) else c)
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ("item_type",), mode: str = "append") -> None:
    """CSV export with a header from the fields, one folder per item type (B2)."""
    parts = [c for c in partition_by if c in df.columns]
    w = flatten_arrays(df).write.mode(mode).option("header", True)
    (w.partitionBy(*parts) if parts else w).csv(path)


def write_history(lines: DataFrame, path: str, compression: str | None = "gzip", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Compressed-history archive: the ``line`` column as text, one JSON
    object per line (B3), gzip-compressed by default (B5), optionally one
    folder per source (e.g. spider, item type)."""
    parts = [c for c in partition_by if c in lines.columns]
    w = lines.select(*parts, "line").write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy(*parts) if parts else w).text(path)


APPS_COLUMNS = ["id", "app_name", "enabled", "iphone", "ipad", "osx", "description", "image_url",
                "app_store_url", "bundleId", "developer_id", "developer_name", "release_date", "price",
                "genres", "main_cat", "rating_count_for_cur_version", "content_rating_age_group",
                "avg_rating_for_cur_version", "languages", "cur_ver_release_date", "app_type", "version",
                "currency", "release_notes", "avg_rating", "rating_count", "min_os_version", "label", "timestamp"]


def relational_apps(apps: DataFrame) -> DataFrame:
    """App rows projected to the relational ``apps`` table (B6): the list
    fields description, genres and languages are joined with ''."""
    cols = []
    for c in APPS_COLUMNS:
        if c not in apps.columns:
            continue
        if c in ("description", "genres", "languages"):
            cols.append(F.array_join(F.col(c), "").alias(c))
        else:
            cols.append(F.col(c))
    return apps.select(*cols)


def relational_upsert(table: DataFrame, apps: DataFrame, key: str = "id") -> DataFrame:
    """Select-then-update-or-insert on the relational table (J3): the new
    projection replaces the stored row with the same key."""
    return upsert(table, relational_apps(apps), [key])
