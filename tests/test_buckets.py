"""Bucket tables: merges in batches equal one merge, replays change nothing, old versions go."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from snapweave.operators import dedupe, merge
from snapweave.sinks.buckets import BUCKET, BucketTable

KEYS = ["k"]


def _latest(stored, batch):
    return dedupe.latest_per_key(batch if stored is None else stored.unionByName(batch), KEYS, ["v"])


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith((".", "_")))


def test_merges_equal_one_merge_and_touch_only_their_buckets(spark, tmpdir_path):
    t = BucketTable(spark, f"{tmpdir_path}/t", KEYS, buckets=8)
    assert t.read() is None
    every = spark.range(200).select((F.col("id") % 60).alias("k"), F.col("id").alias("v"))
    for n, part in enumerate([every.where("v < 80"), every.where("v >= 150"), every.where("v between 80 and 149")]):
        assert t.merge(part, n, _latest)
    assert _rows(t.read()) == _rows(dedupe.latest_per_key(every, KEYS, ["v"]))
    before, files = t.manifest(), _files(f"{tmpdir_path}/t")
    one = spark.createDataFrame([(7, 10**6)], "k long, v long")
    assert not t.merge(one, 2, _latest) and _files(f"{tmpdir_path}/t") == files      # a replay changes nothing
    assert t.merge(one, 3, _latest)
    after = t.manifest()
    changed = [b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)]
    assert len(changed) == 1 and after["buckets"][changed[0]] == 3
    assert dict(_rows(t.read()))[7] == 10**6 and t.read().count() == 60


def test_old_versions_are_removed_and_a_reader_can_finish(spark, tmpdir_path):
    t = BucketTable(spark, f"{tmpdir_path}/t", KEYS, buckets=2)
    row = lambda v: spark.createDataFrame([(k, v) for k in range(20)], "k long, v long")
    t.merge(row(0), 0, _latest)
    reader = t.read()
    t.merge(row(1), 1, _latest)
    assert {v for _, v in _rows(reader)} == {0}          # planned before the merge
    t.merge(row(2), 2, _latest)
    assert {f.split("version=")[1].split("/")[0] for f in _files(f"{tmpdir_path}/t/data")} == {"1", "2"}
    assert len(_files(f"{tmpdir_path}/t/manifest")) == 2
    t.merge(row(3).where("false"), 3, _latest)           # nothing arrives: the number is kept all the same
    assert t.manifest()["version"] == 3 and {v for _, v in _rows(t.read())} == {2}


def test_a_merge_that_broke_off_is_done_again(spark, tmpdir_path, monkeypatch):
    t = BucketTable(spark, f"{tmpdir_path}/t", KEYS, buckets=4)
    rows = spark.createDataFrame([(k, k) for k in range(30)], "k long, v long")
    t.merge(rows.where("k < 20"), 0, _latest)

    def broken(*a):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", broken)
        with pytest.raises(OSError):
            t.merge(rows.withColumn("v", F.col("v") + 5), 1, _latest)
    assert _rows(t.read()) == [(k, k) for k in range(20)]  # the data of the broken merge are not seen
    t.merge(rows.withColumn("v", F.col("v") + 5), 1, _latest)
    assert _rows(t.read()) == [(k, k + 5) for k in range(30)] and BUCKET not in t.read().columns


def test_grown_developers_and_pages_equal_one_merge(spark, tmpdir_path):
    at = lambda h: dt.datetime(2016, 1, 1, h)
    dev = spark.createDataFrame([("d", 1, at(1)), ("d", 2, at(3)), ("e", 5, at(2)), ("d", 2, at(9)), ("f", None, at(4))], "k string, app long, ts timestamp")
    t = BucketTable(spark, f"{tmpdir_path}/dev", KEYS, buckets=4)
    for n, hours in enumerate(["hour(ts) > 4", "hour(ts) = 1", "hour(ts) between 2 and 4"]):
        t.merge(dev.where(hours), n, lambda s, b: merge.grow_developers(s, b, "k", "app", "ts"))
    assert _rows(t.read()) == _rows(merge.merge_developers(dev, "k", "app", "ts"))
    pages = spark.createDataFrame([("r", 1, at(1), ["a", "b"], [1, 2], 2), ("r", 2, at(2), ["c"], [3], 1), ("s", 1, at(1), [], [], 0),
                                   ("r", 3, at(3), ["a"], [1], 1)], "k string, page int, ts timestamp, x array<string>, y array<int>, n long")
    t = BucketTable(spark, f"{tmpdir_path}/pages", KEYS, buckets=4)
    grow = lambda s, b: merge.grow_pages(s, b, KEYS, ["ts", "page"], ["x", "y"], "n", "ts")
    for n, part in enumerate(["page = 3", "page = 1", "page < 3", "page = 2"]):   # some pages come twice
        t.merge(pages.where(part), n, grow)
    got = merge.appended(t.read(), ["x", "y"], "n").select("k", "n", "ts", "x", "y")
    want = merge.append_pages(pages, KEYS, ["ts", "page"], ["x", "y"], "n", "ts").select("k", "n", "ts", "x", "y")
    assert _rows(got) == _rows(want)
