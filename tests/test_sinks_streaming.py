import glob
import gzip
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from snapweave.operators import history as H
from snapweave.sinks import writers as W
from snapweave.streaming import streams as S


def test_jsonl_and_csv_export(spark, tmpdir_path):
    df = spark.createDataFrame([("mw", "job", "2016-01-01", "1", None, ["US", "CA"]),
                                ("mw", "user", "2016-01-01", "u1", 3.5, [])],
                               "spider string, item_type string, crawl_ts string, id string, pay double, countries array<string>")
    out = os.path.join(tmpdir_path, "jsonl")
    W.write_jsonl(df, out)
    files = glob.glob(os.path.join(out, "spider=mw", "item_type=job", "*", "*.json"))
    rec = json.loads(open(files[0]).readline())
    assert rec == {"id": "1", "countries": ["US", "CA"]}  # NULL pay is absent
    csv_out = os.path.join(tmpdir_path, "csv")
    W.write_csv(df, csv_out)
    back = spark.read.option("header", True).csv(os.path.join(csv_out, "item_type=job")).collect()[0]
    assert back.countries == "US,CA"


def test_history_archive_gzip(spark, tmpdir_path):
    paths = [os.path.join(FIXTURES, "golden", f) for f in ("input_1.json", "input_2.json")]
    from snapweave.sources.snapshots import parse_snapshots, read_snapshot_lines
    lines = H.history_lines(H.history_entries(H.long_from_variant(parse_snapshots(read_snapshot_lines(spark, paths)))), None)
    out = os.path.join(tmpdir_path, "hist")
    W.write_history(lines, out)
    got = {}
    for p in glob.glob(os.path.join(out, "*.gz")):
        with gzip.open(p, "rt") as f:
            for line in f:
                got.update(json.loads(line))
    assert set(got) == {"foo", "bar", "baz"} and len(got["foo"]) == 7


def test_relational_projection_and_upsert(spark):
    apps = spark.createDataFrame([("1", "A", ["x", "y"], ["G1", "G2"], ["EN"])],
                                 "id string, app_name string, description array<string>, genres array<string>, languages array<string>")
    table = spark.createDataFrame([("1", "old", "d", "g", "l"), ("2", "keep", "d", "g", "l")],
                                  "id string, app_name string, description string, genres string, languages string")
    r = {x.id: x for x in W.relational_upsert(table, apps).collect()}
    assert (r["1"].app_name, r["1"].description, r["1"].genres) == ("A", "xy", "G1G2") and r["2"].app_name == "keep"


def test_stream_dedupe_and_upsert(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    schema = "item_type string, key string, v int, ts timestamp"
    spark.createDataFrame([("seed", "A", 1, None), ("seed", "A", 2, None), ("job", "A", 3, None)], schema) \
        .write.mode("overwrite").parquet(os.path.join(src, "b1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    q = (S.dedupe_stream(stream, ["item_type", "key"]).writeStream.format("memory").queryName("dd")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck1")).start())
    q.processAllAvailable()
    q.stop()
    assert sorted((r.item_type, r.key) for r in spark.sql("select * from dd").collect()) == [("job", "A"), ("seed", "A")]

    target = os.path.join(tmpdir_path, "table")
    q2 = (spark.readStream.schema(schema).parquet(os.path.join(src, "*")).writeStream
          .foreachBatch(S.upsert_batches(target, ["key"], ["v"]))
          .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).start())
    q2.processAllAvailable()
    spark.createDataFrame([("job", "B", 9, None)], schema).write.parquet(os.path.join(src, "b2"))
    q2.processAllAvailable()
    q2.stop()
    latest = S.latest_version(spark, target)
    assert sorted((r.key, r.v) for r in latest.collect()) == [("A", 3), ("B", 9)]


def test_delta_stream_matches_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "snap")
    os.makedirs(src)
    arch = os.path.join(tmpdir_path, "archive")
    gold = os.path.join(FIXTURES, "golden")
    shutil.copy(os.path.join(gold, "input_2.json"), os.path.join(src, "job-2.json"))
    lines = S.snapshot_file_stream(spark, src, max_files_per_trigger=1, clean_source="archive", archive_dir=arch)
    parsed = lines.select(F.parse_json("value").alias("v"), "seq")
    long = H.long_from_variant(parsed, seq_col="seq")
    q = (S.delta_stream(long).writeStream.format("memory").queryName("ds").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck3")).start())
    q.processAllAvailable()
    time.sleep(1.1)
    shutil.copy(os.path.join(gold, "input_1.json"), os.path.join(src, "job-1.json"))
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from ds").collect()
    # input_1 holds snapshots older than some already folded in: those are set aside as late
    late = [r for r in rows if r.late]
    assert late and all(r.id in ("foo", "bar") for r in late)
    # the first file alone compresses exactly like the batch operator
    first = [r for r in rows if not r.late and r.key is not None]
    batch_long = H.long_from_variant(parsed_batch(spark, os.path.join(gold, "input_2.json")))
    batch = H.delta_changes(batch_long).collect()
    assert {(r.id, str(r.ts), r.key, r.j) for r in batch} <= {(r.id, str(r.ts), r.key, r.j) for r in first}


def parsed_batch(spark, path):
    from snapweave.sources.snapshots import parse_snapshots, read_snapshot_lines
    return parse_snapshots(read_snapshot_lines(spark, [path]))


def test_stream_dedupe_within_watermark(spark, tmpdir_path):
    import datetime as dt
    src = os.path.join(tmpdir_path, "wm")
    schema = "item_type string, key string, v int, ts timestamp"
    t = dt.datetime(2016, 1, 1)
    spark.createDataFrame([("seed", "A", 1, t), ("seed", "A", 2, t + dt.timedelta(minutes=1)),
                           ("seed", "B", 3, t)], schema).write.parquet(os.path.join(src, "b1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    q = (S.dedupe_stream(stream, ["item_type", "key"], event_time="ts", watermark="1 hour")
         .writeStream.format("memory").queryName("wmdd")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckw")).start())
    q.processAllAvailable()
    q.stop()
    assert sorted(r.key for r in spark.sql("select * from wmdd").collect()) == ["A", "B"]


LONG = "id string, ts timestamp, seq long, key string, j string"


def _long_rows(values, seq=0, key="k"):
    import datetime as dt
    t = dt.datetime(2016, 1, 1)
    return [("a", t + dt.timedelta(hours=h), seq + i, key, j) for i, (h, j) in enumerate(values)]


def _repairs(spark, folder, batches, **options):
    """Marks written batch by batch (one file each), as lists of (batch, hour, j, keep)."""
    from snapweave.plans.streams import _drained
    out = os.path.join(folder, "out")
    for i, rows in enumerate(batches):
        path = os.path.join(folder, "in", f"b{i}")
        spark.createDataFrame(rows, LONG).coalesce(1).write.parquet(path)
        src = spark.readStream.schema(LONG).parquet(os.path.join(folder, "in", "*"))
        _drained(S.delta_repairs(src, **options).writeStream.foreachBatch(S.stored_repairs(out)), spark, out)
    marks = spark.read.parquet(out + "/marks").collect()
    return sorted((r.batch, int((r.ts.timestamp() - 1451606400) // 3600), r.j, r.keep) for r in marks), S.current_delta(spark, out)


def test_late_rows_are_repaired_from_the_next_known_value_only(spark, tmpdir_path):
    first = _long_rows([(h, "1" if h < 200 else "2") for h in range(0, 400, 4)])      # 17 daily buckets
    marks, now = _repairs(spark, tmpdir_path, [first, _long_rows([(50, "9")], 1000), _long_rows([(51, "1"), (500, "2")], 2000)])
    assert len([m for m in marks if m[0] == 0]) == len(first)
    assert [m for m in marks if m[0] == 1] == [(1, 50, "9", True), (1, 52, "1", True)]
    assert [m for m in marks if m[0] == 2] == [(2, 51, "1", True), (2, 52, "1", False), (2, 500, "2", False)]
    every = spark.createDataFrame(first + _long_rows([(50, "9")], 1000) + _long_rows([(51, "1"), (500, "2")], 2000), LONG)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, H.delta_changes(every).select(*now.columns).collect()))


@pytest.mark.parametrize("limits", [{}, {"WHOLE": 5}, {"WHOLE": 0, "PACK_ROWS": 3}])
def test_groups_held_as_one_value_or_in_buckets_give_the_batch_result(spark, tmpdir_path, monkeypatch, limits):
    """Groups that grow past the limit in a later batch, rows of any age, equal times; rows without an id are one group."""
    import random

    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(3)
    batches, seq = [], 0
    for _ in range(3):
        rows = _long_rows([(rng.randrange(300), rng.choice("12")) for _ in range(12)], seq)
        rows += [("b", *r[1:3], "q", *r[4:]) for r in _long_rows([(rng.randrange(60), rng.choice("12")) for _ in range(2)], seq + 20)]
        rows += [(None, *r[1:]) for r in _long_rows([(seq, "5")], seq + 40)]
        batches.append(rows)
        seq += 100
    _, now = _repairs(spark, tmpdir_path, batches)
    every = spark.createDataFrame([r for b in batches for r in b if r[0]], LONG)
    want = [*map(tuple, H.delta_changes(every).select(*now.columns).collect()), (*batches[0][-1][:3], "k", "5")]
    assert sorted(map(tuple, now.collect()), key=str) == sorted(want, key=str)


def test_state_calls_and_rows_follow_groups_not_points():
    """A new group of 60 points in five buckets: one row in, a row out per bucket, one state value read and written."""
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    class Handle:
        getValueState = getMapState = staticmethod(lambda *a: State())  # noqa: N815 (names of the interface)

    p = S.DeltaProcessor(86400, False)
    p.init(Handle())
    t = [i * 2 * 3600 * 10**6 for i in range(60)]
    marks = list(p.handleInputRows(("a", "k"), iter([S.Row(t=t, seq=list(range(60)), j=["1", "1", "2"] * 20)]), None))
    assert [len(m.keep) for m in marks] == [12] * 5 and sum(map(sum, (m.keep for m in marks))) == 40
    assert calls == ["get", "update"]


def test_timer_drops_points_behind_the_watermark(spark, tmpdir_path):
    """Marks stay right when the buckets before have shrunk; a row older than the watermark is left out."""
    first = _long_rows([(0, "1"), (1, "1"), (2, "2"), (3, "2"), (5, "3"), (6, "2")])
    marks, _ = _repairs(spark, tmpdir_path, [first, _long_rows([(100, "2")], 100), _long_rows([(200, "2"), (210, "4")], 200),
                                            _long_rows([(2, "7"), (211, "4"), (205, "4")], 300)], watermark="20 hours")
    last = {m[1]: m[3] for m in marks}               # the newest mark of each hour
    assert last == {0: True, 1: False, 2: True, 3: False, 5: True, 6: True, 100: False, 200: False, 205: True, 210: False, 211: False}
