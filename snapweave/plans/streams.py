"""Structured Streaming queries over the driver tables.

The events table is read as a file stream and processed with
``Trigger.AvailableNow`` (all available input, then stop); results are written
to the session's reliable checkpoint folder and read back as a table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.processors import zip_concat
from ..operators import dedupe, history, merge
from ..session import ensure_checkpoint_dir, read_table
from ..sinks.buckets import BucketTable
from ..streaming.routing import appended, dedupe_routed, route_batches
from ..streaming.streams import ROCKSDB, current_delta, delta_repairs, stored_repairs
from .keyed import ORACLE as KEYED_ORACLE
from .keyed import SNAPSHOT_FIELDS, TS_TEXT


MERGES = 4  # micro-batches of the merge queries
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _drained(writer, spark: SparkSession, path: str) -> None:
    """Run a stream over all input that there is, with map state in RocksDB."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 16) -> DataFrame:
    table = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(table).schema
    # a pattern that only this name matches: a single file as well as a table folder, in any store
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{table[:-1]}[{table[-1]}]")


def stream_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental delta compression (L3/L4) of the events snapshots: a file
    stream of the events table whose points are kept in state per (user, field);
    every micro-batch writes its new marks and those that it flips, so the
    result doesn't depend on the files and no batch reads what is stored."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    out = f"{base}/snapweave-stream-delta-{uuid.uuid4().hex}"
    src = _table_stream(spark, sf_dir, "events")
    long = history.long_from_columns(src.withColumn("ts", F.col("ts").cast("timestamp")),
                                     "user_id", "ts", "event_id", SNAPSHOT_FIELDS)
    # a week of a field is one value of the map state
    _drained(delta_repairs(long, 7 * history.DAY).writeStream.foreachBatch(stored_repairs(out)), spark, out)
    return (current_delta(spark, out)
            .select(F.col("id").cast("bigint").alias("user_id"), F.date_format("ts", TS_TEXT).alias("ts"),
                    F.col("seq").alias("event_id"), "key", F.col("j").alias("val")))


def _merged_in_batches(spark: SparkSession, rows: DataFrame, keys: list[str], by: str, combine) -> DataFrame:
    """The rows as a file stream of one file per micro-batch, each a range of ``by``, merged into a bucket table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapweave-buckets-{uuid.uuid4().hex}"
    rows.repartitionByRange(MERGES, by).write.parquet(f"{base}/in")
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    table = BucketTable(spark, f"{base}/table", keys, buckets=16)
    _drained(src.writeStream.foreachBatch(table.batches(combine)), spark, base)
    return table.read()


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous keyed upsert (L2/J2): orders arrive in micro-batches of order number; finished orders are the base that any
    other order of the customer replaces, whichever comes first."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    o = o.where("o_orderstatus is not null")
    rank = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)

    def combine(stored, batch):
        both = batch if stored is None else stored.unionByName(batch)
        return dedupe.latest_per_key(both, ["o_custkey"], [rank, "o_orderdate", "o_orderkey"])

    u = _merged_in_batches(spark, o, ["o_custkey"], "o_orderkey", combine)
    return u.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice",
                    F.date_format("o_orderdate", TS_TEXT).alias("o_orderdate"))


def stream_dev_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous developer merge (L2/G3): line items arrive in micro-batches of order number, every supplier's part list grows."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_orderkey")
    m = _merged_in_batches(spark, li, ["l_suppkey"], "l_orderkey",
                           lambda stored, batch: merge.grow_developers(stored, batch, "l_suppkey", "l_partkey", "l_shipdate"))
    return m.select("l_suppkey", F.array_join("app_ids", ",").alias("app_ids"), "n_apps",
                    F.date_format("latest_ts", TS_TEXT).alias("latest_ts"))


def stream_reviewer_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous reviewer merge (L2/G4): events arrive in micro-batches of event number, out of time order; per user and hour
    the pages stand in time order in the end."""
    ev = read_table(spark, sf_dir, "events")
    pages = ev.select("user_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", F.array("event_type").alias("types"),
                      F.array(F.format_number("value", 2)).alias("vals"), F.lit(1).cast("bigint").alias("n_reviews"))
    m = _merged_in_batches(spark, pages, ["user_id", "hour"], "event_id",
                           lambda stored, batch: merge.grow_pages(stored, batch, ["user_id", "hour"], ["ts", "event_id"],
                                                                  ["types", "vals"], "n_reviews", "ts"))
    m = merge.appended(m, ["types", "vals"], "n_reviews")
    return m.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n_reviews",
                    F.array_join("types", ",").alias("types"),
                    F.array_join(zip_concat("types", "vals", ":"), ",").alias("titles"),
                    F.date_format("ts", TS_TEXT).alias("latest_ts"))


def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed stream by item type (L1/C9): sign-ups count once per user and hour, errors once per user and day, each with a
    sink of its own; all purchases go to theirs, and the other types pass to a fourth."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapweave-routes-{uuid.uuid4().hex}"
    ev = _table_stream(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.date_trunc("hour", "ts").alias("hour"), F.date_trunc("day", "ts").alias("day"))
    # files come in any order of time: the delay is the table's own span, two numbers
    span = read_table(spark, sf_dir, "events").agg((F.unix_seconds(F.max(F.col("ts").cast("timestamp")))
                                                    - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))).alias("s")).first()["s"]
    items = dedupe_routed(ev, "event_type", {"signup": ["user_id", "hour"], "error": ["user_id", "day"]}, "ts", f"{(span or 0) + 86_400} seconds")
    sinks = {t: f"{base}/{t}" for t in ("signup", "error", "purchase", "other")}
    run = route_batches(f"{base}/stage", "event_type", {t: appended(p) for t, p in sinks.items() if t != "other"}, appended(sinks["other"]))
    _drained(items.writeStream.foreachBatch(run), spark, base)
    cuts = {"signup": (F.col("hour"), False), "error": (F.col("day"), False), "purchase": (F.col("ts"), True), "other": (F.col("ts"), True)}
    out = None
    for route, path in sinks.items():
        at, whole = cuts[route]
        rows = spark.read.schema("event_id long, ts timestamp, user_id long, event_type string, hour timestamp, day timestamp").parquet(path).select(
            F.lit(route).alias("route"), "event_type", "user_id", F.date_format(at, TS_TEXT).alias("at"),
            (F.col("event_id") if whole else F.lit(None).cast("bigint")).alias("event_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {"stream_delta": stream_delta, "stream_upsert": stream_upsert, "stream_dev_merge": stream_dev_merge,
           "stream_reviewer_append": stream_reviewer_append, "stream_routes": stream_routes}
ORACLE = {"stream_delta": KEYED_ORACLE["snapshot_delta"], "stream_upsert": KEYED_ORACLE["latest_upsert"],
          "stream_dev_merge": KEYED_ORACLE["dev_merge"], "stream_reviewer_append": KEYED_ORACLE["reviewer_append"],
          "stream_routes": """
SELECT DISTINCT 'signup' AS route, event_type, user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, NULL::BIGINT AS event_id
FROM events WHERE event_type = 'signup'
UNION ALL
SELECT DISTINCT 'error', event_type, user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S'), NULL::BIGINT FROM events WHERE event_type = 'error'
UNION ALL
SELECT CASE event_type WHEN 'purchase' THEN 'purchase' ELSE 'other' END, event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id
FROM events WHERE event_type IS NULL OR event_type NOT IN ('signup', 'error')
"""}
