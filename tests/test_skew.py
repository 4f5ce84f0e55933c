"""Hot-key paths: one id holding every row must give the same result as the
sequential definition, whatever the bucketing that spreads it over tasks."""

from pyspark.sql import functions as F

from conftest import SMOKE
from snapweave.operators import dedupe as Dd
from snapweave.operators import history as H


def _sequential_delta(rows):
    known, out = {}, set()
    for ts, seq, key, j in sorted(rows, key=lambda r: (r[0], r[1])):
        if key is None:
            continue
        if known.get(key) != j:
            known[key] = j
            out.add((ts, seq, key, j))
    return out


def test_hot_id_delta_any_bucketing(spark):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet").withColumn("hot", F.lit(1))
    long = H.long_from_columns(ev, "hot", "ts", "event_id", ["event_type", "props"])
    exp = _sequential_delta([(r.ts, r.seq, r.key, r.j) for r in long.collect()])
    for bucket, split in ((3600, None), (10 ** 9, None), (10 ** 9, 50), (86400, 7)):
        got = {(r.ts, r.seq, r.key, r.j) for r in
               H.delta_changes(long, bucket_seconds=bucket, split_rows=split).collect()}
        assert got == exp
    # the hot id is really cut into many window groups
    b = H.with_buckets(long, 10 ** 9, split_rows=50).select("bk").distinct().count()
    assert b >= long.count() // 50


def test_hot_key_first_and_latest(spark):
    li = spark.read.parquet(f"{SMOKE}/lineitem.parquet").withColumn("hot", F.lit(0))
    rows = li.select("hot", "l_orderkey", "l_linenumber", "l_partkey").collect()
    first = Dd.first_seen(li.select("hot", "l_orderkey", "l_linenumber", "l_partkey"), ["hot"],
                          ["l_orderkey", "l_linenumber", "l_partkey"]).collect()[0]
    assert (first.l_orderkey, first.l_linenumber, first.l_partkey) == \
        min((r.l_orderkey, r.l_linenumber, r.l_partkey) for r in rows)
    last = Dd.latest_per_key(li.select("hot", "l_orderkey", "l_linenumber", "l_partkey"), ["hot"],
                             ["l_orderkey", "l_linenumber", "l_partkey"]).collect()[0]
    assert (last.l_orderkey, last.l_linenumber, last.l_partkey) == \
        max((r.l_orderkey, r.l_linenumber, r.l_partkey) for r in rows)


def test_hot_id_history_lines_split_by_slice(spark):
    import json
    ev = spark.read.parquet(f"{SMOKE}/events.parquet").withColumn("hot", F.lit(1))
    long = H.long_from_columns(ev, "hot", "ts", "event_id", ["event_type", "props"])
    whole = H.history_lines(H.history_entries(long, split_rows=None), "day").collect()
    sliced = H.history_lines(H.history_entries(long, split_rows=50), "day", by_slice=True).collect()
    assert len(sliced) > len(whole) and max(r.n_entries for r in sliced) < max(r.n_entries for r in whole)

    def joined(rows, key):
        out = []
        for r in sorted(rows, key=key):
            out.extend(json.loads(r.line)["1"])
        return out
    assert joined(sliced, lambda r: (r.chunk, r.slice)) == joined(whole, lambda r: r.chunk)


def test_bfs_hub_node_salted(spark):
    from snapweave.operators import graph as G
    # one developer hub linked to every app; apps link to reviewers
    edges = ([("developer", 0, "app", i) for i in range(300)] + [("app", i, "developer", 0) for i in range(300)]
             + [("app", i, "reviewer", i % 7) for i in range(300)])
    e = spark.createDataFrame([(a, b, c, d, "k") for a, b, c, d in edges],
                              "src_type string, src_id long, dst_type string, dst_id long, kind string")
    s = spark.createDataFrame([("app", 5)], "node_type string, node_id long")
    for salt in (1, 16):
        depth = {(r.node_type, r.node_id): r.depth for r in G.bounded_bfs(s, e, 3, salt=salt).collect()}
        assert depth[("app", 5)] == 0 and depth[("developer", 0)] == 1 and depth[("reviewer", 5)] == 1
        assert depth[("app", 6)] == 2 and len(depth) == 1 + 1 + 7 + 299


def test_time_slices_split_hot_groups_only(spark):
    from snapweave.operators.skew import time_slices
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hot = time_slices(ev.withColumn("g", F.lit(1)), ["g"], us, 100)
    assert hot.select("slice").distinct().count() >= ev.count() // 100 * 0.5
    # slices grow with time inside the group
    r = hot.groupBy("slice").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("slice").collect()
    assert all(a.hi <= b.lo for a, b in zip(r, r[1:]))
    cold = time_slices(ev, ["user_id"], us, 10 ** 6)
    assert cold.where("slice <> 0").count() == 0
