"""Snapshot consolidation job: crawl output folders -> compressed histories.

``io_dir/<spider>/<item_type>-<crawl time>.json`` files (one JSON snapshot
per line) become one gzip archive per (spider, item type) with lines
``{"<id>":[["<ts>",{changed fields}],...]}``. The newest file of each
(spider, item type) is left alone because a crawler may still write it.
Inputs are never deleted by the batch job (the streaming file source can
clean them with ``cleanSource``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from ..operators.joins import checked_broadcast
from ..sinks.writers import write_history
from ..sources.snapshots import list_snapshot_files, read_snapshot_lines

GROUP = ["spider", "item_type"]


def consolidated_lines(spark: SparkSession, io_dir: str, item_types: Sequence[str] = ("job", "user"),
                       chunk_unit: str | None = "day", bucket_seconds: int = history.DAY) -> DataFrame:
    """History lines per (spider, item type, id[, chunk]) of the completed files."""
    files = list_snapshot_files(spark, io_dir, item_types)
    lines = read_snapshot_lines(spark, files)
    lines = lines.join(checked_broadcast(files.select("path", *GROUP), ["path"]), "path")
    parsed = lines.select(*GROUP, F.parse_json("value").alias("v"), "seq")
    long = history.long_from_variant(parsed, group=GROUP)
    entries = history.history_entries(long, bucket_seconds, GROUP)
    return history.history_lines(entries, chunk_unit, GROUP)


def consolidate(spark: SparkSession, io_dir: str, out_dir: str, item_types: Sequence[str] = ("job", "user"),
                chunk_unit: str | None = "day") -> None:
    """Write the archives under ``out_dir/spider=<s>/item_type=<t>/`` (gzip)."""
    write_history(consolidated_lines(spark, io_dir, item_types, chunk_unit), out_dir, partition_by=GROUP)


def main(argv: Sequence[str] | None = None) -> None:
    """Command line: ``python -m snapweave.plans.consolidate --io-dir DIR
    --out-dir DIR [--item-types job user] [--chunk-unit day]``. The session
    comes from the environment (``spark-submit`` settings or local mode)."""
    import argparse

    from ..session import build_session

    ap = argparse.ArgumentParser(description="Compress crawl snapshot files into delta histories")
    ap.add_argument("--io-dir", required=True, help="folder with one subfolder per spider")
    ap.add_argument("--out-dir", required=True, help="archive folder (spider=/item_type= partitions)")
    ap.add_argument("--item-types", nargs="+", default=["job", "user"])
    ap.add_argument("--chunk-unit", default="day", help="date_trunc unit or 'bucket' that cuts an id's history into lines; 'none': one line per id")
    ap.add_argument("--master", default=None, help="Spark master when not run through spark-submit")
    args = ap.parse_args(argv)
    spark = build_session(args.master) if args.master else build_session()
    consolidate(spark, args.io_dir, args.out_dir, args.item_types, None if args.chunk_unit == "none" else args.chunk_unit)


if __name__ == "__main__":
    main()
