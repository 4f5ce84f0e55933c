"""Structured Streaming versions of the item processing stages.

* ``dedupe_stream``      L1: stateful drop of already-seen (type, key)
* ``upsert_batches``     L2: continuous keyed upsert through ``foreachBatch``
* ``delta_stream``       L3: incremental delta compression with per-id state, in-order input
* ``DeltaProcessor``     L3: the same for any arrival order, with the points of each field in state
* ``snapshot_file_stream`` L4: completed snapshot files as a file stream
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.dedupe import upsert


def snapshot_file_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100,
                         clean_source: str | None = None, archive_dir: str | None = None) -> DataFrame:
    """Snapshot JSONL files as they arrive (L4/B4). Writers must move a file
    into ``folder`` when it is complete (the batch job instead skips the newest
    file). ``clean_source`` = 'delete' or 'archive' removes processed inputs."""
    r = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
         .option("pathGlobFilter", "*.json"))
    if clean_source:
        r = r.option("cleanSource", clean_source)
        if archive_dir:
            r = r.option("sourceArchiveDir", archive_dir)
    lines = r.load(folder).where(F.length(F.trim("value")) > 0)
    mtime = F.col("_metadata.file_modification_time")
    # arrival order: file modification time first; streaming gives no line
    # numbers, so equal timestamps inside one file fall back to a line hash
    seq = (F.unix_millis(mtime) * F.lit(1_000_000)
           + F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.col("value")), F.lit(1_000_000)))
    return lines.select("value", F.col("_metadata.file_path").alias("path"), mtime.alias("mtime"),
                        seq.alias("seq"))


def dedupe_stream(items: DataFrame, keys: Sequence[str], event_time: str | None = None,
                  watermark: str | None = None) -> DataFrame:
    """Drop items whose key was already seen (L1). Without a watermark the
    seen-key state grows forever (like an in-memory seen set); with
    ``event_time`` + ``watermark`` state is bounded to the watermark delay."""
    if event_time and watermark:
        return items.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))
    return items.dropDuplicates(list(keys))


def upsert_batches(target_path: str, keys: Sequence[str], order_cols: Sequence[str] = ()):
    """``foreachBatch`` function for a continuous keyed upsert (L2).

    Without ``order_cols`` the largest of several rows of one key counts.
    Each micro-batch writes a complete new version of the table under
    ``<target>/batch=<id>`` (base = newest earlier version); rewriting the same
    batch id on a retry gives the same folder, so a replayed batch is
    idempotent. Readers take the newest version with ``latest_version``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = latest_version(spark, target_path, before=batch_id)
        new = upsert(batch.limit(0) if base is None else base, batch, keys, order_cols)
        (new.write.mode("overwrite").parquet(f"{target_path.rstrip('/')}/batch={batch_id:012d}"))
    return run


def latest_version(spark: SparkSession, target_path: str, before: int | None = None) -> DataFrame | None:
    """Newest table version written by ``upsert_batches``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # nothing written yet
        return None
    versions = spark.read.parquet(target_path)
    if "batch" not in versions.columns:
        return None
    v = versions if before is None else versions.where(F.col("batch") < before)
    top = v.agg(F.max("batch")).first()[0]
    if top is None:
        return None
    return v.where(F.col("batch") == top).drop("batch")


PACKED = "id string, key string, t array<long>, seq array<long>, j array<string>"
PACK_ROWS = 1 << 19  # rows held by a task that packs points
WHOLE = 1024         # points of a group up to which they are one state value
REPAIR_OUT = f"{PACKED}, keep array<boolean>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _flags(before: str | None, values: list) -> list[bool]:
    """Which of the values, in order, differ from the one before (``before`` stands in front of the first)."""
    return [p is None or v != p for p, v in zip([before, *values], values, strict=False)]


class DeltaProcessor(StatefulProcessor):
    """Delta compression of one field of one id, exact for any arrival order (L3).

    Rows in and out hold arrays of points, a bucket's marks in one row: a row costs the
    Python worker far more than a point. State: the points (time, sequence, value) in
    time buckets, and the ordered list of buckets. New points are put into their buckets; what is written are the new
    points and the known ones whose mark flips, which are looked for in the touched
    buckets and in the next known bucket behind each, and nowhere else. So a batch's
    work follows its rows and their buckets, not what is stored. Up to ``WHOLE`` points
    of a group (without a watermark) are one value with all its buckets, as every call
    to the state costs a message to Spark.

    With a watermark a timer per bucket fires when it has passed the bucket's end, after which
    no more rows come for it: only the kept points and the last one stay in state.
    """

    def __init__(self, bucket_seconds: int, timed: bool):
        self.bucket, self.timed = bucket_seconds * 1_000_000, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "buckets array<long>, t array<long>, seq array<long>, j array<string>")
        self.points = handle.getMapState("points", "bucket long", "t array<long>, seq array<long>, j array<string>")

    def _load(self, bucket: int, known: set, whole: dict | None = None) -> list:
        if whole is not None:
            return whole.get(bucket, [])
        return list(zip(*self.points.getValue((bucket,)), strict=True)) if bucket in known else []

    def _store(self, bucket: int, points: list) -> None:
        self.points.updateValue((bucket,), tuple(list(x) for x in zip(*points, strict=True)))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (names of the interface)
        added: dict = {}
        for r in rows:
            for p in zip(r.t, r.seq, r.j, strict=True):
                added.setdefault(p[0] // self.bucket, []).append(p)
        stored = self.known.get()
        whole = None                                 # bucket -> points, of a group held as one value
        if not self.timed and not (stored and stored[0]):
            whole = {}
            for p in zip(*stored[1:], strict=True) if stored else ():
                whole.setdefault(p[0] // self.bucket, []).append(p)
        old = list(stored[0]) if whole is None and stored else sorted(whole or ())
        known = set(old)
        order = sorted(known | set(added))
        walk = sorted({order[i] for b in added for i in (bisect_left(order, b), bisect_left(order, b) + 1) if i < len(order)})
        ends = {}                                    # bucket -> its last value before and after this batch
        for b in walk:
            at = bisect_left(order, b)
            if not at:
                before = after = None
            elif order[at - 1] in ends:
                before, after = ends[order[at - 1]]
            else:
                before = after = self._load(order[at - 1], known, whole)[-1][2]
            had = self._load(b, known, whole)
            was = dict(zip([p[:2] for p in had], _flags(before, [p[2] for p in had]), strict=True))
            now = sorted(had + added.get(b, []), key=lambda p: p[:2])
            marks = [(*p, keep) for p, keep in zip(now, _flags(after, [p[2] for p in now]), strict=True)
                     if was.get(p[:2]) != keep]      # a new point, or one whose mark flips
            if marks:
                yield Row(id=key[0], key=key[1], **dict(zip(("t", "seq", "j", "keep"), map(list, zip(*marks, strict=True)), strict=True)))
            ends[b] = (had[-1][2] if had else before, now[-1][2])
            if b in added:
                if whole is None:
                    self._store(b, now)
                else:
                    whole[b] = now
                if self.timed and b not in known:
                    self.handle.registerTimer((b + 1) * self.bucket // 1000)
        if whole is not None and sum(map(len, whole.values())) <= WHOLE:
            self.known.update(([], *(list(x) for x in zip(*(p for b in order for p in whole[b]), strict=True))))
            return
        for b, points in (whole or {}).items():
            self._store(b, points)
        if whole is not None or len(order) > len(old):
            self.known.update((order, [], [], []))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        bucket = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.bucket - 1
        order = list(self.known.get()[0])
        at, known = bisect_left(order, bucket), set(order)
        had = self._load(bucket, known)
        keep = _flags(self._load(order[at - 1], known)[-1][2] if at else None, [p[2] for p in had])
        keep[-1] = True                              # the next bucket's first value is compared with it
        self._store(bucket, [p for p, k in zip(had, keep, strict=True) if k])
        yield from ()

    def close(self) -> None:
        pass


def _packed(batches):
    """Points (id, key, t, seq, j) -> PACKED rows: one per (id, key) and PACK_ROWS rows of the partition."""
    held, n = [], 0

    def packed():
        cols = ("t", "seq", "j")
        got = pa.Table.from_batches(held).group_by(["id", "key"], use_threads=False).aggregate([(c, "list") for c in cols])
        return got.select(["id", "key", *[f"{c}_list" for c in cols]]).rename_columns(["id", "key", *cols]).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield from packed()
            held, n = [], 0
    if n:
        yield from packed()


def delta_repairs(long: DataFrame, bucket_seconds: int = 86400, watermark: str | None = None) -> DataFrame:
    """Marks of the compressed history as they become known (L3): (id, key, ts, seq, j, keep) of every new point and of
    every known one whose mark flips; ``current_delta`` takes the last mark of each. Long rows without a field (``key`` NULL)
    hold no value and are left out. State is one group per (id, field), so the fields of a hot id are kept apart.

    Without a watermark rows may be of any age and every point stays in state; a batch's points go to the state packed by
    group. With ``watermark`` (a delay) Spark leaves
    out and counts rows older than it, and points that are not kept leave the state behind it.
    """
    points = long.where("key is not null and ts is not null")
    if watermark is not None:
        points = points.withWatermark("ts", watermark)
    at, seq = F.unix_micros("ts").alias("t"), F.col("seq").cast("long").alias("seq")
    if watermark is None:
        points = points.select(F.col("id").cast("string").alias("id"), "key", at, seq, "j").repartition("id", "key").mapInArrow(_packed, PACKED)
    else:                                            # Spark tells late rows by their own ts
        points = points.select("id", "key", "ts", *[F.array(c).alias(n) for c, n in ((at, "t"), (seq, "seq"), ("j", "j"))])
    marks = points.groupBy("id", "key").transformWithState(
        DeltaProcessor(bucket_seconds, watermark is not None), REPAIR_OUT, "append", "None" if watermark is None else "EventTime")
    return (marks.select("id", "key", F.explode(F.arrays_zip("t", "seq", "j", "keep")).alias("m"))
            .select("id", "key", F.timestamp_micros("m.t").alias("ts"), "m.seq", "m.j", "m.keep"))


def stored_repairs(path: str):
    """``foreachBatch`` function for ``delta_repairs``: each batch's marks under ``<path>/marks/batch=<n>``; writing a batch again replaces them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id:012d}")
    return run


def current_delta(spark: SparkSession, path: str) -> DataFrame:
    """Compressed history rows (id, ts, seq, key, j) of the marks stored so far."""
    marks = spark.read.parquet(f"{path}/marks")
    last = marks.groupBy("id", "key", "ts", "seq").agg(F.max_by(F.struct("j", "keep"), "batch").alias("m"))
    return last.where("m.keep").select("id", "ts", "seq", "key", "m.j")


DELTA_OUT = "id string, ts timestamp, seq long, key string, j string, late boolean"
DELTA_STATE = "last_ts timestamp, last_seq long, fields string"


def _delta_group(key, pdfs: Iterator[pd.DataFrame], state: GroupState,
                 ttl_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Vectorised per-id step: sort the batch rows by (ts, seq), compare each
    field with its previous value in the batch (or, for its first row, the
    value kept in state), emit changes, fold the last values into state."""
    (id_,) = key
    if state.hasTimedOut:
        state.remove()
        return
    if state.exists:
        last_ts, last_seq, fields = state.get
        known = json.loads(fields)
    else:
        last_ts, last_seq, known = None, None, {}
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
    if last_ts is not None:
        late = (pdf["ts"] < last_ts) | ((pdf["ts"] == last_ts) & (pdf["seq"] < last_seq))
    else:
        late = pd.Series(False, index=pdf.index)
    on_time = pdf[~late]
    fields_rows = on_time[on_time["key"].notna()]
    prev = fields_rows.groupby("key", sort=False)["j"].shift()
    first = prev.isna()
    prev = prev.where(~first, fields_rows["key"].map(known))
    changed = fields_rows[prev.isna() | (fields_rows["j"] != prev)]
    known.update(fields_rows.groupby("key", sort=False)["j"].last().to_dict())
    out = pd.concat([changed.assign(late=False),
                     on_time[on_time["key"].isna()].assign(late=False, j=None),
                     pdf[late].assign(late=True)], ignore_index=True)
    if len(on_time):
        tail = on_time.iloc[-1]
        last_ts, last_seq = tail["ts"], int(tail["seq"])
    state.update((last_ts, last_seq, json.dumps(known)))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    out["id"] = id_
    yield out[["id", "ts", "seq", "key", "j", "late"]]


def delta_stream(long: DataFrame, state_ttl_ms: int | None = None) -> DataFrame:
    """Incremental delta compression (L3): per id the last known JSON of each
    field is kept in state between micro-batches; a field is emitted only when
    it differs. Rows older than the id's state are emitted with ``late`` set
    instead of being folded in (the batch job handles full re-compression).
    ``key`` NULL rows mark field-less snapshots. With ``state_ttl_ms`` an id
    idle for that long (processing time) drops its state; state then grows
    with ids x fields only while ids stay active. Input is the long form
    (id, ts, seq, key, j)."""
    def fn(key, pdfs, state):
        return _delta_group(key, pdfs, state, state_ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if state_ttl_ms else GroupStateTimeout.NoTimeout
    return long.groupBy("id").applyInPandasWithState(fn, DELTA_OUT, DELTA_STATE, "append", timeout)
