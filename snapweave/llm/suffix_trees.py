"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are split by a prefix of variable length into groups that fit one
task. The prefix is the minimiser 10-gram that every 50-word window holds (all
windows under one 10-gram meet in one group); a group of more than
``GROUP_WORDS`` words gets its prefix lengthened to the whole window. Equal
contexts are aggregated to their smallest document first, so a passage that
very many documents share is one row. In a group the suffixes of all contexts
are named level by level at doubling string depths (1, 2, 4 ... 32, 50 words):
a name is the tree node at that depth, and the nodes at depth 50 are the deep
nodes whose leaves are the places of one repeat. Names compare the words'
64-bit hashes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.session import cut_lineage

from . import repeats as R, textcore as T
from .components import shuffle_partitions

GROUP_WORDS = 4_000_000
BATCH_WORDS = 400_000


def _digest(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _suffixes(with_words: bool):
    """Live runs as rows (id, xh, g, c, p0, n[, words]): window starts from p0, n windows; words: all they cover."""
    def run(batches):
        for batch in batches:
            ids, xhs = batch.column("id").to_pylist(), batch.column("xh").to_pylist()
            out = [[] for _ in range(6)]
            data = []
            for b, h, row, lo, hi, _, g in R.live_runs(batch):
                base = b.row_words[row]
                for r, x, y, z, s in zip(row.tolist(), lo.tolist(), hi.tolist(), T.signed(g).tolist(), base.tolist(), strict=True):
                    words = h[x:y + R.SPAN]
                    for o, v in zip(out, (ids[b.first_row + r], xhs[b.first_row + r], z, _digest(words), x - s, y - x + 1), strict=True):
                        o.append(v)
                    if with_words:
                        data.append(words.tobytes())
            cols = [pa.array(o, pa.int64()) for o in out] + ([pa.array(data, pa.binary())] if with_words else [])
            yield pa.RecordBatch.from_arrays(cols, names=["id", "xh", "g", "c", "p0", "n"] + ["words"] * with_words)
    return run


_SUFFIX = "id long, xh long, g long, c long, p0 long, n long"


def deep_nodes(symbols: np.ndarray, starts: np.ndarray, depth: int = R.SPAN) -> np.ndarray:
    """Node at string depth ``depth`` of the suffixes at ``starts`` (each has that many symbols in its context).

    Equal results mean equal words. Names at doubling depths; a suffix that runs
    past its context is never asked for.
    """
    name = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width * 2 <= depth:
        name = np.unique((name[:-width] << 32) | name[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    if width == depth:
        return name[starts]
    return np.unique((name[starts] << 32) | name[starts + depth - width], return_inverse=True)[1]


def _trees(batches):
    """Contexts sorted by g -> (g, c, firsts): the smallest document of each window of the context."""
    def solve(g, c, low, words):
        sizes = np.array([len(w) // 8 for w in words])
        flat = np.frombuffer(b"".join(words), np.uint64)
        begin = np.cumsum(sizes) - sizes
        count = sizes - R.SPAN + 1
        at = np.repeat(np.arange(len(sizes)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[at]
        node = deep_nodes(flat, starts)
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, np.asarray(low)[at])
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()),
                                           T.list_array(least[node], count, pa.int64())], names=["g", "c", "firsts"])

    g, c, low, words, held = [], [], [], [], 0
    for batch in batches:
        for x in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "low", "words")), strict=True):
            if held >= BATCH_WORDS and x[0] != g[-1]:
                yield solve(g, c, low, words)
                g, c, low, words, held = [], [], [], [], 0
            g.append(x[0]), c.append(x[1]), low.append(x[2]), words.append(x[3])
            held += len(x[3]) // 8
    if g:
        yield solve(g, c, low, words)


def _window_keys(batches):
    """Contexts of crowded groups -> (g, c, at, low, w1, w2): one row per window, keyed by the whole window."""
    for batch in batches:
        cols = [[] for _ in range(6)]
        for g, c, low, words in zip(*(batch.column(k).to_pylist() for k in ("g", "c", "low", "words")), strict=True):
            h = np.frombuffer(words, np.uint64)
            w1, w2 = T.signed(T.windows(h, R.SPAN)), T.signed(T.windows(T.mix(h + np.uint64(0x51ED270B)), R.SPAN))
            for o, v in zip(cols, ([g] * len(w1), [c] * len(w1), range(len(w1)), [low] * len(w1), w1, w2), strict=True):
                o.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in cols], names=["g", "c", "at", "low", "w1", "w2"])


def _cut(batches):
    """(id, xh, text, spans) -> the row without the words of its repeated windows."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        removed, sha, texts = [], [], []
        for b in T.blocks(batch.column("text")):
            drop = np.zeros(len(b.starts) + 1, np.int64)
            for r in range(b.rows):
                for s in spans[b.first_row + r]:
                    for o in s["at"]:
                        drop[b.row_words[r] + s["p0"] + o] += 1
                        drop[b.row_words[r] + s["p0"] + o + R.SPAN] -= 1
            keep = np.cumsum(drop)[:-1] == 0
            gone = np.concatenate([[0], np.cumsum(~keep)])
            removed.extend((gone[b.row_words[1:]] - gone[b.row_words[:-1]]).tolist())
            for text in R.joined_words(b, keep):
                texts.append(text)
                sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("xh"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                                          pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "xh", "removed", "sha_kept", "kept_text"])


_CUT = "id long, xh long, removed long, sha_kept string, kept_text string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repeated_windows(live: DataFrame) -> DataFrame:
    """(id, xh, spans) of the live documents that lose words; spans: (p0, offsets of the windows to remove)."""
    spark = live.sparkSession
    parts = shuffle_partitions(spark)
    ctx = cut_lineage(live.mapInArrow(_suffixes(True), _SUFFIX + ", words binary").groupBy("g", "c")
                      .agg(F.min("id").alias("low"), F.first("words").alias("words")))
    crowded = ctx.groupBy("g").agg(F.sum(F.length("words") / 8).alias("m")).where(f"m > {GROUP_WORDS}").select("g")
    crowded = cut_lineage(crowded)
    small = ctx.join(crowded, "g", "left_anti")
    firsts = (small.repartition(parts, "g").sortWithinPartitions("g")
              .mapInArrow(_trees, "g long, c long, firsts array<long>"))
    if not crowded.isEmpty():
        wide = ctx.join(crowded, "g", "left_semi").mapInArrow(_window_keys, "g long, c long, at long, low long, w1 long, w2 long")
        low = wide.groupBy("g", "w1", "w2").agg(F.min("low").alias("first"))
        per = (wide.join(low, ["g", "w1", "w2"]).groupBy("g", "c")
               .agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("x")).select("g", "c", F.col("x.first").alias("firsts")))
        firsts = firsts.union(per)
    members = live.mapInArrow(_suffixes(False), _SUFFIX)
    hit = (members.join(firsts, ["g", "c"])
           .select("id", "xh", "p0", F.expr("filter(sequence(0, size(firsts) - 1), o -> firsts[o] < id)").alias("at"))
           .where("size(at) > 0"))
    return hit.groupBy("id", "xh").agg(F.collect_list(F.struct("p0", "at")).alias("spans"))


def _outcome(d: DataFrame, with_text: bool) -> DataFrame:
    """(id, xh, n_words, n_removed, kept_sha256[, kept_text]) per row of d; kept_text only where words went."""
    prof = cut_lineage(R.profile(d))
    first, live = R.live_documents(d, prof)
    cut = (live.join(repeated_windows(live), ["id", "xh"]).select("id", "xh", "text", "spans").mapInArrow(_cut, _CUT)
           .dropDuplicates(["id", "xh"]))
    if not with_text:
        cut = cut.drop("kept_text")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return (prof.drop("grams").join(first, ["seq", "n_words"], "left").join(cut, ["id", "xh"], "left")
            .select("id", "xh", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                    F.when(copy, EMPTY_SHA).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
                    *([F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else [])))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which words stay when every word covered by a 50-word window that also stands in a document of a smaller id goes.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space, UTF-8). Words are ``[^\\x20\\x09-\\x0D]+``,
    unchanged; windows are judged on the input. Null and empty texts have no
    words. Rows with a null id lose nothing and remove nothing; rows of one id
    don't remove from each other. Other columns are not read.
    """
    return _outcome(R.keyed(docs, id_col, text_col), False).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns; a text that loses words (see substring_dedup) becomes the kept words joined by one space.

    Null and empty texts, and rows with a null id, stay as they are; repeated rows stay repeated.
    Other columns are carried along, whatever their names.
    """
    own, names = {c.lower() for c in docs.columns}, []
    for name in ("removed_id", "removed_hash", "removed_text"):      # names that no column of docs has
        while name in own:
            name += "_"
        names.append(name)
    at_id, at_hash, kept = names
    gone = (_outcome(R.keyed(docs, id_col, text_col), True).where("n_removed > 0")
            .select(F.col("id").alias(at_id), F.col("xh").alias(at_hash), F.col("kept_text").alias(kept)).dropDuplicates([at_id, at_hash]))
    on = (F.col(id_col).cast("long") == F.col(at_id)) & (F.xxhash64(text_col) == F.col(at_hash))
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.join(gone, on, "left").select(*[F.coalesce(kept, c).alias(c) if c == text_col else quoted(c) for c in docs.columns])
