"""A mixed stream by item type: repeats of keyed types go, others pass, one sink per type, replays change nothing."""
import datetime

from snapweave.plans import streams
from snapweave.streaming.routing import appended, dedupe_routed, route_batches

from conftest import SMOKE

SCHEMA = "n long, ts timestamp, item_type string, key string, spider string"
KEYS = {"job": ["key"], "user": ["key", "spider"]}


def rows():
    at = lambda m: datetime.datetime(2016, 8, 12, 10, m)
    return [(1, at(0), "job", "a", "x"), (2, at(1), "job", "a", "y"), (3, at(2), "user", "a", "x"), (4, at(3), "user", "a", "y"),
            (5, at(4), "user", "a", "y"), (6, at(5), "review", "a", "x"), (7, at(6), "review", "a", "x"), (8, at(7), None, "a", "x"),
            (9, at(8), None, "a", "x"), (10, at(9), "job", None, "x"), (11, at(10), "job", None, "z"), (12, at(11), "", "b", "x"),
            (13, at(12), "job", "b", "x")]


def kept(ids):
    """One of the rows of each key, all rows of types without a key."""
    one_of = [{1, 2}, {3}, {4, 5}, {10, 11}, {13}]
    assert all(len(ids & g) == 1 for g in one_of)
    return ids - set().union(*one_of) == {6, 7, 8, 9, 12}


def test_table_and_stream_drop_the_same_repeats(spark, tmp_path):
    table = spark.createDataFrame(rows(), SCHEMA)
    assert kept({r.n for r in dedupe_routed(table, "item_type", KEYS, "ts", "1 hour").collect()})
    assert dedupe_routed(table, "item_type", {}, "ts", "1 hour").count() == len(rows())
    assert dedupe_routed(table.limit(0), "item_type", KEYS, "ts", "1 hour").count() == 0
    src, base = str(tmp_path / "in"), str(tmp_path)
    for lo in range(0, len(rows()), 5):                      # repeats stand in different files
        spark.createDataFrame(rows()[lo:lo + 5], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sinks = {t: f"{base}/{t}" for t in ("job", "user", "rest")}
    run = route_batches(f"{base}/stage", "item_type", {t: appended(sinks[t]) for t in KEYS}, appended(sinks["rest"]))
    seen = []

    def twice(batch, batch_id):                              # every batch replayed once
        seen.append(batch_id)
        run(batch, batch_id)
        run(batch, batch_id)
    q = (dedupe_routed(stream, "item_type", KEYS, "ts", "1 hour").writeStream.foreachBatch(twice)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) >= 3
    got = {t: [(r.n, r.item_type) for r in spark.read.schema(SCHEMA).parquet(p).collect()] for t, p in sinks.items()}
    assert kept({n for found in got.values() for n, _ in found}) and sum(map(len, got.values())) == 10
    assert {t for _, t in got["job"]} == {"job"} and {t for _, t in got["user"]} == {"user"}
    assert sorted(got["rest"], key=str) == sorted([(6, "review"), (7, "review"), (8, None), (9, None), (12, None)], key=str)


def test_without_another_sink_the_rest_stays_staged(spark, tmp_path):
    table = spark.createDataFrame(rows(), SCHEMA)
    route_batches(str(tmp_path / "stage"), "item_type", {"job": appended(str(tmp_path / "job"))})(table, 3)
    assert spark.read.parquet(str(tmp_path / "job")).count() == 5
    assert spark.read.parquet(str(tmp_path / "stage" / "batch=000000000003")).count() == len(rows())


def test_query_has_every_route(spark):
    got = streams.stream_routes(spark, SMOKE)
    assert {r.route for r in got.select("route").distinct().collect()} == {"signup", "error", "purchase", "other"}
