"""Order-aware de-duplication and keyed upserts.

"Order" is an explicit arrival order (a column list, e.g. file rank + line, or a
timestamp + sequence number); nothing here relies on physical row order.

All per-key choices are aggregates (``min_by``/``max_by`` on a struct), not
``row_number`` windows: aggregates combine map-side, so a key holding a third
of all rows is reduced inside every map task before the shuffle instead of
being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _order(order_cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])


def _pick(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column], latest: bool) -> DataFrame:
    cols = df.columns
    by = F.max_by if latest else F.min_by
    return (df.groupBy(*keys)
            .agg(by(F.struct(*cols), _order(order_cols)).alias("_r"))
            .select("_r.*"))


def first_seen(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column]) -> DataFrame:
    """First row per key in arrival order (H6/G6): the ``ids_seen`` filter."""
    return _pick(df, keys, order_cols, latest=False)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column]) -> DataFrame:
    """Latest row per key (H7): whole-document replace semantics."""
    return _pick(df, keys, order_cols, latest=True)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str],
           order_cols: Sequence[str | Column] = ()) -> DataFrame:
    """Keyed upsert with whole-row replace.

    Rows of ``delta`` replace rows of ``base`` with the same key; several delta
    rows for one key resolve to the latest by ``order_cols``. Columns missing on
    one side become NULL (a replace drops fields absent in the new row).
    """
    u = (base.withColumn("_src", F.lit(0))
         .unionByName(delta.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    # without order columns the largest row counts, so the result doesn't depend on the partitions
    ties = [c for c in u.columns if c not in keys and c != "_src"] if not order_cols else []
    return latest_per_key(u, keys, ["_src", *order_cols, *ties]).drop("_src")


def either_key_new(df: DataFrame, key1: str, key2: str, order_cols: Sequence[str | Column],
                   existing: DataFrame | None = None) -> DataFrame:
    """Insert unless both keys were already seen (F8).

    Sequentially a row is skipped iff its key1 and its key2 both occurred
    before (in ``existing`` or earlier in the batch); a skipped row adds no new
    key, so "seen" never depends on earlier decisions and the rule is exact as:
    keep iff (first row of its key1 and key1 not existing) or (same for key2).
    Ties in ``order_cols`` are broken by (key1, key2); rows equal in order and
    both keys are duplicates of which one (the smallest row) is kept. Only the
    first row of each key is shuffled (two partial aggregates). Rows with a NULL
    key never conflict and are kept as is.
    """
    cols = df.columns
    d = df.withColumn("_o", _order([*order_cols, key1, key2]))
    nulls = d.where(F.col(key1).isNull() | F.col(key2).isNull()).select(*cols)
    d = d.where(F.col(key1).isNotNull() & F.col(key2).isNotNull())
    row = F.min(F.struct("_o", F.struct(*cols).alias("_r"))).alias("_x")
    firsts = []
    for key in (key1, key2):
        f = d.groupBy(key).agg(row)
        if existing is not None:
            f = f.join(existing.select(key).distinct(), key, "left_anti")
        firsts.append(f.select("_x._o", "_x._r"))
    kept = firsts[0].union(firsts[1]).groupBy("_o").agg(F.min("_r").alias("_r")).select("_r.*")
    return kept.unionByName(nulls)


def greedy_two_key(df: DataFrame, key1: str, key2: str, order_cols: Sequence[str | Column],
                   existing: DataFrame | None = None) -> DataFrame:
    """Insert-if-absent on both keys, in arrival order.

    Sequential rule: a row is stored iff neither its key1 nor its key2 is
    already stored. Against ``existing`` that is two anti joins. Within the
    batch the result depends on earlier decisions, so it runs in rounds: a row
    that comes first (by order) for both its key1 and its key2 among the
    undecided rows is stored by the sequential rule too (every earlier row
    sharing a key is decided and was not stored, else it would have removed
    this row); undecided rows sharing a key with a stored row are then dropped.
    Each round stores at least one row, and rounds repeat until nothing is left.
    Ties in ``order_cols`` are broken by (key1, key2); of rows equal in order
    and both keys one (the smallest row) is stored.
    Each round is a pair of partial aggregates and anti joins; the undecided
    set is written to the reliable checkpoint folder after every round to cut
    lineage. Rows with a NULL key never conflict and are kept as is.
    """
    d = df.withColumn("_o", _order([*order_cols, key1, key2]))
    nulls = d.where(F.col(key1).isNull() | F.col(key2).isNull())
    rest = d.where(F.col(key1).isNotNull() & F.col(key2).isNotNull())
    if existing is not None:
        rest = (rest.join(existing.select(key1).distinct(), key1, "left_anti")
                .join(existing.select(key2).distinct(), key2, "left_anti"))
    stored: list[DataFrame] = []
    # the first round reads the (cheap to recompute) input directly; with the
    # anti joins against stored keys its lineage is worth materialising first
    remaining = cut_lineage(rest) if existing is not None else rest
    while not remaining.isEmpty():
        # first row of each key1 that is also the first of its key2
        m1 = remaining.groupBy(key1).agg(F.min(F.struct("_o", F.struct(*d.columns).alias("_w"))).alias("_x")).select("_x._o", "_x._w")
        m2 = remaining.groupBy(key2).agg(F.min("_o").alias("_o")).select("_o")
        won = cut_lineage(m1.join(m2, "_o").select("_w.*"))
        stored.append(won)
        remaining = cut_lineage(remaining.join(won.select(key1), key1, "left_anti")
                                .join(won.select(key2), key2, "left_anti"))
    out = nulls
    for s in stored:
        out = out.unionByName(s.select(*d.columns))
    return out.drop("_o")


def anti_insert(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet (F10/J6 membership difference)."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")
