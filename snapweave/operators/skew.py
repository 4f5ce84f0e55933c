"""Hot-group handling shared by the operators that gather a group's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

def time_slices(df: DataFrame, keys: Sequence[str], micros: Column, split_rows: int | None = None,
                name: str = "slice") -> DataFrame:
    """Add ``name``: 0 for ordinary groups; groups of ``keys`` with more than
    ``split_rows`` rows are cut into ``ceil(rows / split_rows)`` equal slices of
    their own time range (``micros`` is the row's time in microseconds), so the
    slice number grows with time inside a group.

    Hot groups are found with an exact partial-aggregate count. Their list is
    bounded by construction (each entry stands for more than ``split_rows``
    rows, so at most total_rows / split_rows entries), which makes the
    broadcast safe; it is materialised once to the reliable checkpoint folder
    so callers using the result in several branches do not recount.
    """
    if not split_rows:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    keys = list(keys)
    d = df.withColumn("_us", micros)
    hot = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
           .where(F.col("_n") > split_rows)
           .select(*keys, F.ceil(F.col("_n") / F.lit(split_rows)).cast("bigint").alias("_parts"), "_lo", "_hi"))
    hot = cut_lineage(hot)
    d = d.join(F.broadcast(hot), keys, "left")
    span = (F.col("_hi") - F.col("_lo") + F.lit(1)).cast("double")
    sl = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.floor((F.col("_us") - F.col("_lo")).cast("double") * F.col("_parts") / span))
    return d.withColumn(name, sl.cast("bigint")).drop("_us", "_parts", "_lo", "_hi")
