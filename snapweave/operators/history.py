"""Ordered snapshot histories: delta compression and progress summaries.

Data model (long form), one row per (snapshot, field):

    id STRING, ts TIMESTAMP, seq <orderable>, key STRING, j STRING

``j`` is the canonical JSON text of the field value (``to_json`` of a VARIANT
sorts object keys), so an explicit JSON ``null`` is the text ``null`` and an
absent field has no row. A snapshot without any field keeps one row with
``key`` NULL so it still shows up as ``{}`` in the history.

Delta rule (per id, in (ts, seq) order): the first snapshot is kept whole; a
later field is kept only when its JSON differs from the last known value of that
field, where "last known" survives snapshots in which the field is absent.

Scale: a hot id (say a third of all rows) must not pin one task. The history is
cut into time buckets of ``bucket_seconds``; rows are partitioned by
(id, bucket), so a hot id spreads over many tasks. The only cross-bucket
dependency is "last value of this key before the bucket", which is a
map-side-combinable ``max_by`` aggregate per (id, key, bucket) followed by a
``lag`` over the (small) per-bucket summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.processors import json_scalar
from .skew import time_slices

DAY = 86400
TS_FMT = "yyyy-MM-dd HH:mm:ss"


# ----------------------------------------------------------------- long form
def long_from_columns(df: DataFrame, id_col: str | Column, ts_col: str, seq_col: str | Column,
                      value_cols: Sequence[str]) -> DataFrame:
    """Typed snapshot rows -> long form. NULL columns count as absent fields."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    seqc = F.col(seq_col) if isinstance(seq_col, str) else seq_col
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in value_cols]),
                               F.array(*[json_scalar(c) for c in value_cols]))
    fields = F.map_filter(fields, lambda k, v: v.isNotNull())
    return (df.select(idc.cast("string").alias("id"), F.col(ts_col).alias("ts"), seqc.alias("seq"),
                      F.explode_outer(fields).alias("key", "j")))


def long_from_variant(df: DataFrame, v: str = "v", seq_col: str = "seq",
                      id_field: str = "id", ts_field: str = "timestamp", ts_fmt: str = TS_FMT,
                      group: Sequence[str] = ()) -> DataFrame:
    """VARIANT snapshot objects -> long form (dynamic schema, absent != null).
    ``group`` columns (e.g. spider, item type) pass through and separate
    histories of equal ids from different sources."""
    obj = F.variant_get(F.col(v), "$", "map<string,variant>")
    rest = F.map_filter(obj, lambda k, _: ~k.isin(id_field, ts_field))
    return (df.select(*group, F.variant_get(F.col(v), f"$.{id_field}", "string").alias("id"),
                      F.to_timestamp(F.variant_get(F.col(v), f"$.{ts_field}", "string"), ts_fmt).alias("ts"),
                      F.col(seq_col).alias("seq"),
                      F.explode_outer(rest).alias("key", "_val"))
            .select(*group, "id", "ts", "seq", "key", F.to_json("_val").alias("j")))


def bucket_of(ts: Column, bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).cast("bigint")


def with_buckets(long: DataFrame, bucket_seconds: int = DAY, group: Sequence[str] = (),
                 split_rows: int | None = None) -> DataFrame:
    """Add the ordered bucket ``bk`` = struct(time bucket, slice).

    Buckets are fixed. Only with ``split_rows`` given, groups (id, time bucket)
    of more rows are hot and cut into slices of their own time range (``skew.time_slices``), so no
    window task holds much more than ``split_rows`` rows of one id unless they
    crowd into a few instants. Ordering buckets as structs keeps them
    monotonic in time within an id, which the carry logic relies on.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    df = long.withColumn("_b0", bucket_of(F.col("ts"), bucket_seconds))
    df = time_slices(df, [*group, "id", "_b0"], micros, split_rows, "_s")
    return df.withColumn("bk", F.struct(F.col("_b0").alias("b"), F.col("_s").alias("s"))).drop("_b0", "_s")


# -------------------------------------------------------------- delta (H1/H2)
def mark_changes(long: DataFrame, bucket_seconds: int = DAY, group: Sequence[str] = (),
                 split_rows: int | None = None) -> DataFrame:
    """Add ``keep`` (field kept by the delta rule) and ``bk`` to the long form.
    Histories are per (``group`` columns, id)."""
    ids = [*group, "id"]
    df = with_buckets(long, bucket_seconds, group, split_rows)
    order = F.struct("ts", "seq")
    # last value of each key per bucket, then the value carried into the next
    # bucket that has the key (partial aggregation: hot ids combine map-side)
    last = (df.where(F.col("key").isNotNull())
            .groupBy(*ids, "key", "bk").agg(F.max_by("j", order).alias("_last")))
    carry = (last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*ids, "key").orderBy("bk")))
             .select(*ids, "key", "bk", "_carry"))
    w = Window.partitionBy(*ids, "bk").orderBy("key", "ts", "seq")
    prev = F.lag(F.struct("key", "j")).over(w)
    return (df.join(carry, [*ids, "key", "bk"], "left")
            .withColumn("_p", prev)
            .withColumn("_prev", F.when(F.col("_p.key") == F.col("key"), F.col("_p.j")).otherwise(F.col("_carry")))
            .withColumn("keep", F.col("key").isNotNull() & (F.col("_prev").isNull() | (F.col("j") != F.col("_prev"))))
            .drop("_p", "_prev", "_carry"))


def delta_changes(long: DataFrame, bucket_seconds: int = DAY, group: Sequence[str] = (),
                  split_rows: int | None = None) -> DataFrame:
    """Kept (id, ts, seq, key, j) rows of the compressed history."""
    return (mark_changes(long, bucket_seconds, group, split_rows).where("keep")
            .select(*group, "id", "ts", "seq", "key", "j"))


def history_entries(long: DataFrame, bucket_seconds: int = DAY, group: Sequence[str] = (),
                    split_rows: int | None = None) -> DataFrame:
    """One row per snapshot: ``changes`` = JSON object text of the kept fields
    (keys sorted), ``{}`` when nothing changed. Groups by (id, bk, ts, seq), which
    the (id, bk) partitioning of the delta window already satisfies."""
    m = mark_changes(long, bucket_seconds, group, split_rows)
    kv = F.when(F.col("keep"), F.struct("key", "j"))
    g = m.groupBy(*group, "id", "bk", "ts", "seq").agg(F.array_sort(F.collect_list(kv)).alias("_kv"))
    body = F.array_join(F.transform("_kv", lambda x: F.concat(json_scalar(x["key"]), F.lit(":"), x["j"])), ",")
    return g.select(*group, "id", "bk", "ts", "seq", F.concat(F.lit("{"), body, F.lit("}")).alias("changes"),
                    F.size("_kv").cast("bigint").alias("n_changes"))


def history_lines(entries: DataFrame, chunk_unit: str | None = "day", group: Sequence[str] = (),
                  by_slice: bool = False) -> DataFrame:
    """History text in the snapshot-archive line format
    ``{"<id>":[["<ts>",{...}],...]}`` with entries in (ts, seq) order.

    ``chunk_unit`` (a ``date_trunc`` unit) cuts one id's history into one line
    per chunk, in time order, so no single row grows with the id's whole
    history; ``"bucket"`` uses the delta buckets, whose hot groups are already
    cut into slices of bounded size; ``None`` gives one line per id (archive
    parity for small inputs). ``by_slice`` also separates the slices of hot
    groups (``slice`` is 0 for every ordinary group), so a very dense id-day
    becomes several bounded lines.
    """
    if chunk_unit == "bucket":
        chunk = F.col("bk")
    elif chunk_unit:
        chunk = F.date_trunc(chunk_unit, "ts")
    else:
        chunk = F.lit(None).cast("timestamp")
    entry = F.concat(F.lit("[\""), F.date_format("ts", TS_FMT), F.lit("\","), F.col("changes"), F.lit("]"))
    slice_ = F.col("bk.s") if by_slice else F.lit(0).cast("bigint")
    g = (entries.withColumn("chunk", chunk).withColumn("slice", slice_)
         .groupBy(*group, "id", "chunk", "slice")
         .agg(F.array_sort(F.collect_list(F.struct("ts", "seq", entry.alias("e")))).alias("_es")))
    line = F.concat(F.lit("{"), json_scalar(F.col("id")), F.lit(":["),
                    F.array_join(F.transform("_es", lambda x: x["e"]), ","), F.lit("]}"))
    out = g.select(*group, "id", "chunk", "slice", F.size("_es").cast("bigint").alias("n_entries"), line.alias("line"))
    return out if by_slice else out.drop("slice")


def decompress(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """Inverse of the delta rule: the known value of a field at a snapshot.

    ``changes`` are kept (id, ts, seq, key, j) rows; ``probes`` are
    (id, ts, seq, key) points to evaluate. Each probe gets the last change of
    its (id, key) at or before it, an as-of lookup done with one window over
    (id, key) in (ts, seq) order on the union of both (a change at the probe's
    own snapshot counts); no snapshots x keys grid is built.
    """
    c = changes.select("id", "key", "ts", "seq", "j", F.lit(0).alias("_probe"))
    p = probes.select("id", "key", "ts", "seq", F.lit(None).cast("string").alias("j"), F.lit(1).alias("_probe"))
    w = (Window.partitionBy("id", "key").orderBy("ts", "seq", "_probe")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (c.unionByName(p).withColumn("j", F.last("j", ignorenulls=True).over(w))
            .where(F.col("_probe") == 1).drop("_probe"))


# --------------------------------------------------------- summaries
def progress_range(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Per id: max(value) - min(value); ids whose progress moved (> 0)."""
    return (df.groupBy(id_col)
            .agg(F.count(value_col).alias("n_snapshots"),
                 (F.max(value_col) - F.min(value_col)).alias("progress"))
            .where(F.col("progress") > 0))


def progress_series(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Each snapshot with its value normalised to the id's minimum.

    The per-id minimum is a partial aggregate joined back (AQE broadcasts it
    when small and splits a hot id's side of the join when large), instead of a
    window that would place a hot id in one task."""
    base = df.groupBy(id_col).agg(F.min(value_col).alias("_base"))
    return (df.join(base, id_col, "inner")
            .withColumn("progress", F.col(value_col) - F.col("_base")).drop("_base"))
