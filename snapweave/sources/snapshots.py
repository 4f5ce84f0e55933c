"""Snapshot JSONL scans (one JSON object per line, dynamic fields).

Folder layout: ``<io_dir>/<spider>/<item_type>-<crawl time>.json``; compressed
archives end with ``.x.json`` and are not inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.processors import blank_na_to_double, to_long
from ..operators.history import TS_FMT


def list_snapshot_files(spark: SparkSession, io_dir: str, item_types: Sequence[str],
                        skip_newest: bool = True) -> DataFrame:
    """(spider, item_type, path, mtime, file_rank) of the input files (A1, A2).

    Listing uses the ``binaryFile`` source with the content column pruned, so
    only file metadata is read. Files of one (spider, item_type) are ordered by
    modification time (then path); with ``skip_newest`` the newest file of each
    group is dropped because a crawler may still be writing it, so a group with
    a single file contributes nothing.
    """
    files = (spark.read.format("binaryFile")
             .option("pathGlobFilter", "*.json")
             .load(f"{io_dir.rstrip('/')}/*/")
             .select(F.col("path"), F.col("modificationTime").alias("mtime")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    spider = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    item_type = F.coalesce(*[F.when(name.startswith(t), F.lit(t)) for t in item_types])
    files = (files.where(~name.endswith(".x.json"))
             .select("path", "mtime", spider.alias("spider"), item_type.alias("item_type"))
             .where(F.col("item_type").isNotNull()))
    w = Window.partitionBy("spider", "item_type")
    files = (files.withColumn("file_rank", F.row_number().over(w.orderBy("mtime", "path")))
             .withColumn("_n", F.count(F.lit(1)).over(w)))
    if skip_newest:
        files = files.where(F.col("file_rank") < F.col("_n"))
    return files.drop("_n")


def read_snapshot_lines(spark: SparkSession, paths: Sequence[str] | DataFrame,
                        file_order: DataFrame | None = None) -> DataFrame:
    """Lines of snapshot files with a stable arrival order ``seq`` (H2).

    ``seq`` = (file rank, path, block start, row id): files in the given order
    (or by modification time), then line order. ``monotonically_increasing_id``
    is taken right after the scan, where it follows line order inside a split,
    and the split's start offset orders the splits of one file.
    """
    if isinstance(paths, DataFrame):
        file_order = paths
        path_list = [r.path for r in paths.select("path").collect()]  # file names only, not data
    else:
        path_list = list(paths)
    if not path_list:
        return spark.createDataFrame([], "value string, seq struct<file_rank:bigint,path:string,"
                                         "block:bigint,row:bigint>, path string")
    raw = spark.read.text(path_list).select(
        "value", _decoded(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    if file_order is not None:
        from ..operators.joins import checked_broadcast
        ranks = file_order.select("path", F.col("file_rank").cast("bigint"))
        raw = raw.join(checked_broadcast(ranks, ["path"]), "path", "left")
        missing = F.raise_error(F.concat(F.lit("file is not in the given list: "), F.col("path")))
        raw = raw.withColumn("file_rank", F.when(F.col("file_rank").isNull(), missing.cast("bigint")).otherwise(F.col("file_rank")))
    else:
        # the given order; paths compared without the local-file scheme, which
        # Spark writes as 'file:/...' while callers pass '/...' or 'file:///...'
        order = {_plain(p): i for i, p in enumerate(path_list)}
        mapping = F.create_map(*[x for p, i in order.items() for x in (F.lit(p), F.lit(i))])
        raw = raw.withColumn("file_rank", mapping[F.regexp_replace("path", "^file:/+", "/")].cast("bigint"))
    seq = F.struct(F.col("file_rank"), F.col("path"), F.col("block"), F.col("row"))
    return raw.where(F.length(F.trim("value")) > 0).select("value", seq.alias("seq"), "path")


def _decoded(path):
    """A path as listings give it; ``_metadata.file_path`` is percent-encoded (blanks in crawl times)."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def _plain(p: str) -> str:
    """A local path without scheme ('/a/b'); other URIs unchanged."""
    import re
    if p.startswith("file:"):
        return re.sub(r"^file:/+", "/", p)
    return p if "://" in p else "/" + p.lstrip("/")


def parse_snapshots(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines -> (v VARIANT, seq). ``strict`` fails on a malformed line, like a
    JSON loader would; otherwise malformed lines are dropped."""
    v = F.parse_json("value") if strict else F.try_parse_json("value")
    out = lines.select(v.alias("v"), "seq")
    return out if strict else out.where(F.col("v").isNotNull())


def typed_job_snapshots(lines: DataFrame) -> DataFrame:
    """Typed snapshot scan of job files (A10): work counters and duration as
    integers, success percentage as a float with ''/NULL/'N/A' dropped."""
    v = F.parse_json("value")

    def s(name: str):
        return F.variant_get(v, f"$.{name}", "string")

    return lines.select(
        s("id").alias("id"),
        F.to_timestamp(s("timestamp"), TS_FMT).alias("ts"),
        to_long(s("work_done")).alias("work_done"),
        to_long(s("work_total")).alias("work_total"),
        to_long(s("duration")).alias("duration"),
        blank_na_to_double(s("success_pct")).alias("success_pct"),
        "seq")


def source_totals(lines: DataFrame) -> DataFrame:
    """Items and files per source folder (G7): the 'consolidating N files' count."""
    spider = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return (lines.groupBy(spider.alias("spider"))
            .agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("path").alias("n_files")))
