"""Routing of a mixed item stream by item type.

* ``dedupe_routed``  drops repeated items of the keyed types, lets the others pass
* ``route_batches``  writes a micro-batch once, a folder per item type, and hands each
                     type's rows to its own sink
* ``appended``       a sink that keeps the rows of each micro-batch once
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Sink = Callable[[DataFrame, int], None]


def dedupe_routed(items: DataFrame, type_col: str, keys: Mapping[str, Sequence[str]], event_time: str, watermark: str) -> DataFrame:
    """Items of a mixed stream (or table) without repeats of the keyed types (L1).

    ``keys`` names the key columns per item type; a repeated key of one type, at most the
    watermark's delay apart, is dropped, equal keys of different types are not. Rows of types
    without a key, and of no type, pass: they neither shuffle nor enter the state. Null key
    columns are values like others. Both branches filter the source by type, which the scan
    takes over where the format allows it. A table is de-duplicated as a whole.
    """
    keyed = F.coalesce(F.col(type_col).isin(list(keys)), F.lit(False)) if keys else F.lit(False)
    if not keys:
        return items
    names = sorted({c for cols in keys.values() for c in cols})
    # columns that are no part of a type's key count as null in it
    parts = [F.when(F.col(type_col).isin([t for t, cols in keys.items() if c in cols]), F.col(c)).alias(f"_key_{c}") for c in names]
    own = items.withWatermark(event_time, watermark) if items.isStreaming else items
    key_cols = [type_col, *(f"_key_{c}" for c in names)]
    own = own.where(keyed).select("*", *parts)
    own = (own.dropDuplicatesWithinWatermark(key_cols) if items.isStreaming else own.dropDuplicates(key_cols)).select(*items.columns)
    return own.unionByName(items.where(~keyed))


def route_batches(stage: str, type_col: str, routes: Mapping[str, Sink], other: Sink | None = None) -> Sink:
    """``foreachBatch`` function that gives the rows of each item type to its sink.

    The batch is written once under ``stage`` (a shared folder), partitioned by type; each sink
    reads its own folder only, so the stream's state runs once a batch, whatever the number of
    routes, and a lost executor costs no second run of it. Types without a route, null and empty
    ones (both null from there on) go to ``other``, or stay in the stage folder without it. A
    replayed batch writes the same folder again; sinks get the batch id to do likewise.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        folder = f"{stage.rstrip('/')}/batch={batch_id:012d}"
        batch.withColumn(type_col, F.col(type_col).cast(StringType())).write.mode("overwrite").partitionBy(type_col).parquet(folder)
        rest = [f for f in batch.schema if f.name != type_col]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{type_col}` string"
        staged = batch.sparkSession.read.schema(schema).parquet(folder)
        for name, sink in routes.items():
            sink(staged.where(F.col(type_col) == name).select(*batch.columns), batch_id)
        if other is not None:
            routed = F.coalesce(F.col(type_col).isin(list(routes)), F.lit(False)) if routes else F.lit(False)
            other(staged.where(~routed).select(*batch.columns), batch_id)
    return run


def appended(path: str) -> Sink:
    """A sink with one folder per micro-batch: a replayed batch replaces its own rows and no others."""
    def run(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id:012d}")
    return run
