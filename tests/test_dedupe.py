import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SMOKE
from snapweave.operators import dedupe as Dd
from snapweave.operators import merge as M


def greedy_two_key_reference(rows, existing=()):
    """Sequential definition of ``greedy_two_key`` for small test fixtures:
    rows are (key1, key2, ...) in arrival order."""
    s1 = {r[0] for r in existing}
    s2 = {r[1] for r in existing}
    out = []
    for r in rows:
        if r[0] is None or r[1] is None:
            out.append(r)
            continue
        if r[0] in s1 or r[1] in s2:
            continue
        s1.add(r[0])
        s2.add(r[1])
        out.append(r)
    return out


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_greedy_two_key_fixture(spark):
    df = spark.createDataFrame([(1, "A", 0), (2, "A", 1), (2, "B", 2), (1, "C", 3)], "id int, key string, seq int")
    got = _rows(Dd.greedy_two_key(df, "id", "key", ["seq"]), ["id", "key"])
    assert got == [(1, "A"), (2, "B")]
    # two independent dropDuplicates would be wrong: (2, B) needs the sequential rule
    naive = df.dropDuplicates(["id"]).dropDuplicates(["key"])
    assert _rows(naive, ["id", "key"]) != got


def test_greedy_two_key_existing(spark):
    df = spark.createDataFrame([(1, "A", 0), (3, "B", 1), (4, "C", 2)], "id int, key string, seq int")
    ex = spark.createDataFrame([(1, "Z"), (9, "B")], "id int, key string")
    assert _rows(Dd.greedy_two_key(df, "id", "key", ["seq"], existing=ex), ["id", "key"]) == [(4, "C")]


def test_greedy_two_key_random_vs_sequential(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(rng.randint(0, 6), rng.randint(0, 6), i) for i in range(40)]
        exp = greedy_two_key_reference(rows)
        df = spark.createDataFrame(rows, "a int, b int, seq int")
        assert _rows(Dd.greedy_two_key(df, "a", "b", ["seq"]), ["a", "b", "seq"]) == sorted(exp)


def test_greedy_two_key_lineitem_vs_sequential(spark):
    li = spark.read.parquet(f"{SMOKE}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    local = sorted((r.l_partkey, r.l_suppkey, r.l_orderkey, r.l_linenumber) for r in li.collect())
    local.sort(key=lambda r: (r[2], r[3]))
    exp = sorted(greedy_two_key_reference(local))
    got = _rows(Dd.greedy_two_key(li, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"]),
                ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"])
    assert got == exp


def test_either_key_new_fixture(spark):
    df = spark.createDataFrame([(1, "A", 0), (1, "A", 1), (1, "B", 2), (2, "A", 3), (2, "B", 4)],
                               "id int, app_id string, seq int")
    got = _rows(Dd.either_key_new(df, "id", "app_id", ["seq"]), ["id", "app_id", "seq"])
    assert got == [(1, "A", 0), (1, "B", 2), (2, "A", 3)]
    ex = spark.createDataFrame([(1, "Q")], "id int, app_id string")
    got2 = _rows(Dd.either_key_new(df, "id", "app_id", ["seq"], existing=ex), ["id", "app_id", "seq"])
    assert got2 == [(1, "A", 0), (1, "B", 2), (2, "A", 3)]


def test_first_seen_fixture(spark):
    df = spark.createDataFrame([("seed", "A", 0), ("seed", "A", 1), ("job", "A", 2)], "type string, key string, seq int")
    assert _rows(Dd.first_seen(df, ["type", "key"], ["seq"]), ["type", "key", "seq"]) == [("job", "A", 2), ("seed", "A", 0)]


def test_upsert_and_latest(spark):
    base = spark.createDataFrame([(1, "old", 5), (2, "keep", 1)], "id int, v string, ts int")
    delta = spark.createDataFrame([(1, "new1", 1), (1, "new2", 3), (3, "ins", 0)], "id int, v string, ts int")
    got = _rows(Dd.upsert(base, delta, ["id"], ["ts"]), ["id", "v"])
    assert got == [(1, "new2"), (2, "keep"), (3, "ins")]


def test_developer_merge_fixture(spark):
    t1, t2 = dt.datetime(2016, 1, 1), dt.datetime(2016, 1, 2)
    df = spark.createDataFrame([("d1", [1, 2], t1, "first"), ("d1", [2, 3], t2, "second")],
                               "dev string, app_ids array<int>, ts timestamp, name string")
    r = M.merge_developers(df, "dev", "app_ids", "ts", first_fields=["name"]).collect()[0]
    assert r.app_ids == [1, 2, 3] and r.n_apps == 3 and r.latest_ts == t2 and r.name == "first"


def test_reviewer_append_fixture(spark):
    df = spark.createDataFrame([("r1", 2, ["c"], ["3"], 1, dt.datetime(2016, 1, 2)),
                                ("r1", 1, ["a", "b"], ["5", "4"], 2, dt.datetime(2016, 1, 1))],
                               "rid string, page int, titles array<string>, stars array<string>, n int, ts timestamp")
    r = M.append_pages(df, ["rid"], ["page"], ["titles", "stars"], "n", "ts").collect()[0]
    assert r.titles == ["a", "b", "c"] and r.stars == ["5", "4", "3"] and r.n == 3 and r.n_items == 3
    again = df.unionByName(df.where(F.col("page") == 1).withColumn("page", F.lit(3)))
    r2 = M.append_pages(again, ["rid"], ["page"], ["titles", "stars"], "n", "ts", dedupe=True).collect()[0]
    assert r2.titles == ["a", "b", "c"]


def test_reviewer_append_dedupe_on_keys(spark):
    df = spark.createDataFrame([("r1", 1, ["a1", "a2"], ["t", "u"], 2, dt.datetime(2016, 1, 1)),
                                ("r1", 2, ["a1", "a3"], ["t2", "v"], 2, dt.datetime(2016, 1, 2))],
                               "rid string, page int, app_ids array<string>, titles array<string>, n int, ts timestamp")
    r = M.append_pages(df, ["rid"], ["page"], ["app_ids", "titles"], "n", "ts", dedupe_on=["app_ids"]).collect()[0]
    assert r.app_ids == ["a1", "a2", "a3"] and r.titles == ["t", "u", "v"]


def test_stream_upsert_batch_replay_is_idempotent(spark, tmp_path):
    from snapweave.streaming.streams import latest_version, upsert_batches
    target = str(tmp_path / "t")
    run = upsert_batches(target, ["k"], ["v"])
    b0 = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    b1 = spark.createDataFrame([("A", 5)], "k string, v int")
    run(b0, 0)
    run(b1, 1)
    run(b1, 1)  # a replayed micro-batch rewrites the same version
    assert sorted(tuple(r) for r in latest_version(spark, target).collect()) == [("A", 5), ("B", 2)]
