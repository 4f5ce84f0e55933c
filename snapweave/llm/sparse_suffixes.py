"""Suffix-array dedup over sparse suffixes.

Only suffixes at content-selected minimiser positions are kept (about one in
20 words; equal windows select the same offset, so no repeat of 50 words or
more is missed). Suffixes are dealt by their first ten words (the minimiser's
10-gram) and sorted; neighbours in the sorted array give the length of the
match to the right (LCP), neighbours in the array sorted by the words before
the minimiser give the length to the left. A window that starts o words left of
the minimiser repeats where the match reaches o words to the left and 50 - o to
the right. Equal contexts are aggregated before, so a passage shared by very
many documents is one suffix; groups too large for a task are dealt again by
the whole window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.session import cut_lineage

from . import repeats as R, textcore as T
from .components import shuffle_partitions

GROUP_ROWS = 20_000
BATCH_ROWS = 8_000
LEFT = R.SPAN - R.GRAM


def _suffixes(with_words: bool):
    """Live runs as rows (id, xh, g, c, p0, at[, words]): words from window start p0 on, minimiser at word ``at`` of them."""
    def run(batches):
        for batch in batches:
            ids, xhs = batch.column("id").to_pylist(), batch.column("xh").to_pylist()
            out, data = [[] for _ in range(6)], []
            for b, h, row, lo, hi, at, g in R.live_runs(batch):
                whole = T.windows(h, 1)
                base = b.row_words[row]
                # a context is known by its words: two independent sums over them
                key = _range_hash(whole, lo, hi + R.SPAN) ^ (hi - lo).astype(np.uint64)
                for o, v in zip(out, (np.asarray(ids, object)[b.first_row + row], np.asarray(xhs, object)[b.first_row + row],
                                      T.signed(g), T.signed(key), lo - base, at - lo), strict=True):
                    o.extend(v.tolist())
                if with_words:
                    data.extend(h[x:y].tobytes() for x, y in zip(lo, hi + R.SPAN, strict=True))
            cols = [pa.array(o, pa.int64()) for o in out] + ([pa.array(data, pa.binary())] if with_words else [])
            yield pa.RecordBatch.from_arrays(cols, names=["id", "xh", "g", "c", "p0", "at"] + ["words"] * with_words)
    return run


def _range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Order-dependent hash of the words lo..hi-1, for many ranges at once."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * T._kp(len(h)), out=total[1:])
    return T.mix((total[hi] - total[lo]) * T._ki(len(h) + 1)[lo])


_SUFFIX = "id long, xh long, g long, c long, p0 long, at long"


def _sorted_lcp(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (words compared left to right) and each one's LCP with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel(), kind="stable")
    same = rows[order][1:] == rows[order][:-1]
    lcp = np.zeros(len(rows), np.int64)
    lcp[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, lcp


def _solve(g, c, at, low, high, words):
    m = len(g)
    arrays = [np.frombuffer(w, np.uint64) for w in words]
    size = np.array([len(a) for a in arrays])
    at, low, high = np.array(at), np.array(low), np.array(high)
    flat = np.concatenate(arrays)
    begin = np.cumsum(size) - size + at
    reach = np.arange(R.SPAN)
    right = np.where(reach < (size - at)[:, None], flat[np.minimum(begin[:, None] + reach, len(flat) - 1)], 0)
    back = np.arange(1, LEFT + 1)
    left = np.where(back <= at[:, None], flat[np.maximum(begin[:, None] - back, 0)], 0)
    (ro, rl), (lo, ll) = _sorted_lcp(right), _sorted_lcp(left)
    count = size - R.SPAN + 1
    first = np.cumsum(count) - count
    least, most = np.zeros(count.sum(), np.int64), np.zeros(count.sum(), np.int64)
    rc, lc = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(LEFT + 1):
        sel = np.flatnonzero((at >= o) & (at - o < count))
        if not len(sel):
            continue
        rc[ro], lc[lo] = np.cumsum(rl < R.SPAN - o), np.cumsum(ll < o)
        group = np.unique(rc[sel] * (m + 1) + lc[sel], return_inverse=True)[1]
        a, z = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(a, group, low[sel])
        np.maximum.at(z, group, high[sel])
        least[first[sel] + at[sel] - o], most[first[sel] + at[sel] - o] = a[group], z[group]
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), T.list_array(least, count, pa.int64()),
                                       T.list_array(most, count, pa.int64())], names=["g", "c", "firsts", "lasts"])


def _arrays(batches):
    """Contexts sorted by g -> (g, c, firsts, lasts): smallest and largest document of each of its windows."""
    held = [[] for _ in range(6)]
    for batch in batches:
        for x in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "at", "low", "high", "words")), strict=True):
            if len(held[0]) >= BATCH_ROWS and x[0] != held[0][-1]:
                yield _solve(*held)
                held = [[] for _ in range(6)]
            for o, v in zip(held, x, strict=True):
                o.append(v)
    if held[0]:
        yield _solve(*held)


def _window_keys(batches):
    for batch in batches:
        cols = [[] for _ in range(7)]
        for g, c, low, high, words in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "low", "high", "words")), strict=True):
            h = np.frombuffer(words, np.uint64)
            w1, w2 = T.signed(T.windows(h, R.SPAN)), T.signed(T.windows(T.mix(h + np.uint64(0x51ED270B)), R.SPAN))
            n = len(w1)
            for o, v in zip(cols, ([g] * n, [c] * n, range(n), [low] * n, [high] * n, w1, w2), strict=True):
                o.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in cols], names=["g", "c", "at", "low", "high", "w1", "w2"])


def _cover(batches):
    """Offsets of windows -> merged word spans [from, to)."""
    def merge(starts):
        out = []
        for s in sorted(starts):
            if out and s <= out[-1][1]:
                out[-1][1] = s + R.SPAN
            else:
                out.append([s, s + R.SPAN])
        return out

    for batch in batches:
        spans = batch.column("spans").to_pylist()
        removed = [merge(s["p0"] + o for s in row for o in s["earlier"]) for row in spans]
        shared = [merge(s["p0"] + o for s in row for o in s["other"]) for row in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("xh"), pa.array([sum(b - a for a, b in x) for x in removed], pa.int64()),
             pa.array([sum(b - a for a, b in x) for x in shared], pa.int64()),
             pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(shared, pa.list_(pa.list_(pa.int64())))],
            names=["id", "xh", "removed", "shared", "removed_spans", "shared_spans"])


_COVER = "id long, xh long, removed long, shared long, removed_spans array<array<long>>, shared_spans array<array<long>>"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of 50 words or more that stand in several documents.

    One row per input row: doc_id, n_words, n_shared (words covered by a 50-word
    window that also stands in another document), n_removed (in a document of a
    smaller id), shared_spans and removed_spans (word ranges [from, to), in
    order). Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have
    none. Rows with a null id take no part (0 words shared); rows of one id are
    not each other's partners. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    d = R.keyed(docs, id_col, text_col)
    prof = cut_lineage(R.profile(d).drop("sha"))
    _, live = R.live_documents(d, prof)
    ctx = cut_lineage(live.mapInArrow(_suffixes(True), _SUFFIX + ", words binary").groupBy("g", "c")
                      .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("at").alias("at"), F.first("words").alias("words")))
    crowded = cut_lineage(ctx.groupBy("g").count().where(f"count > {GROUP_ROWS}").select("g"))
    found = (ctx.join(crowded, "g", "left_anti").repartition(parts, "g").sortWithinPartitions("g")
             .mapInArrow(_arrays, "g long, c long, firsts array<long>, lasts array<long>"))
    if not crowded.isEmpty():
        wide = ctx.join(crowded, "g", "left_semi").mapInArrow(_window_keys, "g long, c long, at long, low long, high long, w1 long, w2 long")
        ends = wide.groupBy("g", "w1", "w2").agg(F.min("low").alias("first"), F.max("high").alias("last"))
        found = found.union(wide.join(ends, ["g", "w1", "w2"]).groupBy("g", "c")
                            .agg(F.array_sort(F.collect_list(F.struct("at", "first", "last"))).alias("x"))
                            .select("g", "c", F.col("x.first").alias("firsts"), F.col("x.last").alias("lasts")))
    pick = "filter(sequence(0, size(firsts) - 1), o -> {})"
    found = found.withColumn("other", F.expr(pick.format("firsts[o] < lasts[o]"))).where("size(other) > 0")
    hit = (live.mapInArrow(_suffixes(False), _SUFFIX).join(found, ["g", "c"])
           .select("id", "xh", "p0", F.expr(pick.format("firsts[o] < id")).alias("earlier"), "other"))
    spans = (hit.groupBy("id", "xh").agg(F.collect_list(F.struct("p0", "earlier", "other")).alias("spans"))
             .mapInArrow(_cover, _COVER))
    same = (prof.where(f"id is not null and n_words >= {R.SPAN}").groupBy("seq", "n_words")
            .agg(F.min("id").alias("first"), F.max("id").alias("last")))
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    none = F.array().cast("array<array<long>>")
    copy, copied = F.col("id") > F.col("first"), F.col("id").isNotNull() & (F.col("first") < F.col("last"))
    return (prof.drop("grams").join(same, ["seq", "n_words"], "left").join(spans, ["id", "xh"], "left")
            .select(F.col("id").alias("doc_id"), "n_words",
                    F.when(copied, F.col("n_words")).otherwise(F.coalesce("shared", F.lit(0))).alias("n_shared"),
                    F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                    F.when(copied, whole).otherwise(F.coalesce("shared_spans", none)).alias("shared_spans"),
                    F.when(copy, whole).otherwise(F.coalesce("removed_spans", none)).alias("removed_spans")))
