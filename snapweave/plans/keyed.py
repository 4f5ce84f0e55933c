"""Snapshot-history and keyed-dedupe queries bound to the driver tables.

Mapping of the driver tables onto the reference data model:
  * ``events`` are snapshots of a user: id = user_id, timestamp = ts,
    arrival order = event_id, dynamic fields = event_type, value, props.
  * ``orders`` rows are documents keyed by customer (latest order replaces).
  * ``lineitem`` rows arrive in (l_orderkey, l_linenumber) order; l_partkey and
    l_suppkey play the two natural keys (task id / product id, app id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, history, merge
from ..session import read_table

SNAPSHOT_FIELDS = ["event_type", "value", "props"]
TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return history.long_from_columns(ev, "user_id", "ts", "event_id", SNAPSHOT_FIELDS)


def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta-compressed field changes of every user's event snapshots (H1/H2/A10)."""
    ch = history.delta_changes(_event_long(spark, sf_dir))
    return ch.select(F.col("id").cast("bigint").alias("user_id"),
                     F.date_format("ts", TS_TEXT).alias("ts"),
                     F.col("seq").alias("event_id"), "key", F.col("j").alias("val"))


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive lines ``{"<user>":[["ts",{changes}],...]}`` per user and hour
    (G1/I1/B3); the hour is a fixed chunk, so no line grows with a user's whole history."""
    ent = history.history_entries(_event_long(spark, sf_dir))
    lines = history.history_lines(ent, "hour")
    return lines.select(F.col("id").cast("bigint").alias("user_id"),
                        F.date_format("chunk", "yyyy-MM-dd HH").alias("chunk"), "n_entries", "line")


def progress_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose value moved: max - min > 0."""
    ev = read_table(spark, sf_dir, "events")
    r = history.progress_range(ev, "user_id", "value")
    return r.select("user_id", F.col("n_snapshots").cast("bigint").alias("n_snapshots"),
                    F.round("progress", 4).alias("progress"))


def progress_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot with value minus the user's minimum (H5)."""
    ev = read_table(spark, sf_dir, "events")
    s = history.progress_series(ev.select("event_id", "user_id", "ts", "value"), "user_id", "value")
    return s.select("event_id", "user_id", F.date_format("ts", TS_TEXT).alias("ts"),
                    "value", F.round("progress", 4).alias("progress"))


def ids_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First snapshot per (event_type, user_id) in arrival order."""
    ev = read_table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    f = dedupe.first_seen(ev, ["event_type", "user_id"], ["ts", "event_id"])
    return f.select("event_type", "user_id", F.date_format("ts", TS_TEXT).alias("first_ts"),
                    F.col("event_id").alias("first_event_id"), F.col("value").alias("first_value"))


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed whole-row upsert (J2/H7): finished orders are the stored base,
    open/pending orders the incoming delta; per customer the latest delta row
    replaces the base, else the latest base row stays."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = o.where(F.col("o_orderstatus") == "F")
    delta = o.where(F.col("o_orderstatus") != "F")
    u = dedupe.upsert(base, delta, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return u.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice",
                    F.date_format("o_orderdate", TS_TEXT).alias("o_orderdate"))


def either_key_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stored unless both part and supplier were seen before (F8)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dedupe.either_key_new(li, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])


def greedy_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stored iff neither part nor supplier is stored yet, in
    arrival order (F7, iterative rounds)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dedupe.greedy_two_key(li, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])


def dev_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Developer merge (G3/C28/C29/J4): supplier -> sorted distinct parts,
    count, latest ship date."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    m = merge.merge_developers(li, "l_suppkey", "l_partkey", "l_shipdate")
    return m.select("l_suppkey", F.array_join("app_ids", ",").alias("app_ids"), "n_apps",
                    F.date_format("latest_ts", TS_TEXT).alias("latest_ts"))


def reviewer_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer merge (G4/C16): per user and hour, each event is a page with
    parallel arrays (event type, value); pages are appended in arrival order,
    counts summed, latest timestamp kept; titles pair type and value (zip)."""
    from ..functions.processors import zip_concat
    ev = read_table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    pages = ev.select("user_id", "hour", "ts", "event_id",
                      F.array("event_type").alias("types"),
                      F.array(F.format_number("value", 2)).alias("vals"),
                      F.lit(1).cast("bigint").alias("n_reviews"))
    m = merge.append_pages(pages, ["user_id", "hour"], ["ts", "event_id"], ["types", "vals"], "n_reviews", "ts")
    return m.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n_reviews",
                    F.array_join("types", ",").alias("types"),
                    F.array_join(zip_concat("types", "vals", ":"), ",").alias("titles"),
                    F.date_format("ts", TS_TEXT).alias("latest_ts"))


def anti_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent against stored keys (F7 existing part, F10, J6): line
    items whose part is not a stored app (parts of size > 25) and whose
    supplier is not a stored developer (suppliers with negative balance)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = (read_table(spark, sf_dir, "part").where(F.col("p_size") > 25)
             .select(F.col("p_partkey").alias("l_partkey")))
    sups = (read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0)
            .select(F.col("s_suppkey").alias("l_suppkey")))
    return dedupe.anti_insert(dedupe.anti_insert(li, parts, ["l_partkey"]), sups, ["l_suppkey"])


QUERIES = {
    "snapshot_delta": snapshot_delta,
    "snapshot_history": snapshot_history,
    "progress_range": progress_range,
    "progress_series": progress_series,
    "ids_first_seen": ids_first_seen,
    "latest_upsert": latest_upsert,
    "either_key_new": either_key_new,
    "greedy_two_key": greedy_two_key,
    "dev_merge": dev_merge,
    "reviewer_append": reviewer_append,
    "anti_insert": anti_insert,
}

_EVENT_LONG = """
  SELECT user_id, ts, event_id, 'event_type' AS key, to_json(event_type)::VARCHAR AS j FROM events WHERE event_type IS NOT NULL
  UNION ALL SELECT user_id, ts, event_id, 'value', to_json(value)::VARCHAR FROM events WHERE value IS NOT NULL
  UNION ALL SELECT user_id, ts, event_id, 'props', to_json(props)::VARCHAR FROM events WHERE props IS NOT NULL
"""
_KEPT = f"""
  lng AS ({_EVENT_LONG}),
  kept AS (SELECT * FROM (SELECT *, lag(j) OVER (PARTITION BY user_id, key ORDER BY ts, event_id) AS prev FROM lng)
           WHERE prev IS NULL OR j <> prev)
"""

ORACLE = {
    "snapshot_delta": f"""
WITH {_KEPT}
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, key, j AS val FROM kept
""",
    "snapshot_history": f"""
WITH {_KEPT},
entries AS (
  SELECT s.user_id, s.ts, s.event_id,
         '["' || strftime(s.ts, '%Y-%m-%d %H:%M:%S') || '",{{' ||
         coalesce(string_agg('"' || k.key || '":' || k.j, ',' ORDER BY k.key), '') || '}}]' AS entry
  FROM events s LEFT JOIN kept k ON s.user_id = k.user_id AND s.ts = k.ts AND s.event_id = k.event_id
  GROUP BY s.user_id, s.ts, s.event_id)
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS chunk, count(*)::BIGINT AS n_entries,
       '{{"' || user_id::VARCHAR || '":[' || string_agg(entry, ',' ORDER BY ts, event_id) || ']}}' AS line
FROM entries GROUP BY user_id, date_trunc('hour', ts)
""",
    "progress_range": """
SELECT user_id, count(value)::BIGINT AS n_snapshots, round(max(value) - min(value), 4) AS progress
FROM events GROUP BY user_id HAVING max(value) - min(value) > 0
""",
    "progress_series": """
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value,
       round(value - min(value) OVER (PARTITION BY user_id), 4) AS progress
FROM events WHERE user_id IS NOT NULL
""",
    "ids_first_seen": """
SELECT event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_ts, event_id AS first_event_id,
       value AS first_value
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1
""",
    "latest_upsert": """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END DESC, o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders WHERE o_orderstatus IS NOT NULL)
WHERE rn = 1
""",
    "either_key_new": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r1,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r2
  FROM lineitem) WHERE r1 = 1 OR r2 = 1
""",
    # rounds as a recursive CTE: rows first (by arrival order) for both keys
    # among the undecided rows are stored; undecided rows sharing a key with a
    # stored row are dropped (checked against the sequential definition)
    "greedy_two_key": """
WITH RECURSIVE r(it, l_orderkey, l_linenumber, l_partkey, l_suppkey, acc) AS (
  SELECT 0, l_orderkey, l_linenumber, l_partkey, l_suppkey, false FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
  UNION ALL
  SELECT it + 1, l_orderkey, l_linenumber, l_partkey, l_suppkey, won FROM (
    SELECT *, bool_or(won) OVER (PARTITION BY l_partkey) AS p_taken,
              bool_or(won) OVER (PARTITION BY l_suppkey) AS s_taken
    FROM (
      SELECT *, (o = min(o) OVER (PARTITION BY l_partkey) AND o = min(o) OVER (PARTITION BY l_suppkey)) AS won
      FROM (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o FROM r WHERE NOT acc)))
  WHERE won OR NOT (p_taken OR s_taken))
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE acc
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NULL OR l_suppkey IS NULL
""",
    "dev_merge": """
SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS app_ids,
       count(DISTINCT l_partkey)::BIGINT AS n_apps, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS latest_ts
FROM lineitem GROUP BY l_suppkey
""",
    "reviewer_append": """
SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*)::BIGINT AS n_reviews,
       string_agg(event_type, ',' ORDER BY ts, event_id) AS types,
       string_agg(event_type || ':' || format('{:,.2f}', value), ',' ORDER BY ts, event_id) AS titles,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_ts
FROM events GROUP BY user_id, date_trunc('hour', ts)
""",
    "anti_insert": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size > 25 AND p.p_partkey = l.l_partkey)
  AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_acctbal < 0 AND s.s_suppkey = l.l_suppkey)
""",
}
