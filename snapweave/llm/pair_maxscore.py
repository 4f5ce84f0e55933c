"""Ranked lexical search by MaxScore with bounds on pairs of terms.

An index over the terms of the query set is written once: per shard of at most
``SHARD_DOCS`` documents the postings (document, occurrences) of every term, the
documents' lengths and the shard's counts. Global statistics are sums over its
rows. A task then reads its shards, and in each one

* lists the intersection of every term pair of the query set, with the largest
  joint impact of a document that holds both terms;
* for each query takes pairs of terms as units. A unit adds at most the largest of
  its joint maximum and its two term maxima, which is below the sum of the maxima
  that independent terms give. Units are ordered by this bound; those whose sum
  stays below the k-th best score that the task knows are not essential;
* scores the documents of the essential units only, and adds the other units, the
  strongest first, for the documents that can still reach the k-th best score.

Each task gives its best k per query, which are merged exactly, first in ``SALTS``
parts per query. Scores are 64-bit integers, so the result does not depend on the
order of any sum. Pairs are neighbours in the order of global weight, so that
frequent terms, which are together in many documents, bound each other.

The query set is read in blocks of about ``QUERY_BYTES`` of text, and only one
block's terms and weights go to the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textcore as T
from .tables import written

SHARD_DOCS = 4096
QUERY_BYTES = 2_000_000
SALTS = 64

_INDEX = ("n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, slots array<int>, counts array<int>, "
          "docs array<int>, tfs array<long>")


def words_of(texts):
    """Blocks of texts cut into terms (A-Z lower-cased)."""
    return T.blocks(texts, T.PLAIN, lower=True)


def _row(ids, lengths, row, slot, tf):
    """One shard's index from its (document, slot, occurrences)."""
    live = np.zeros(len(ids), bool)
    live[row] = True
    number = np.cumsum(live) - 1                     # documents without a query term are only counted
    order = np.lexsort((row, slot))
    at, first = np.unique(slot[order], return_index=True)
    counts = np.diff(np.append(first, len(order)))
    one = lambda x, t: pa.array([x], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), one(ids[live], pa.int64()), one(lengths[live], pa.int64()),
         one(at.astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32()),
         one(number[row[order]].astype(np.int32), pa.int32()), one(tf[order], pa.int64())],
        names=["n_docs", "n_terms", "doc_ids", "lengths", "slots", "counts", "docs", "tfs"])


def _indexed(vocabulary: np.ndarray):
    """Rows (id, text) -> one index row per shard, for the terms whose hashes are in the sorted vocabulary."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), SHARD_DOCS):
                part = batch.slice(lo, SHARD_DOCS)
                lengths, rows, slots, tfs = [], [], [], []
                for b in words_of(part.column(1)):
                    lengths.append(np.diff(b.row_words))
                    h = b.word_hashes()
                    slot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[slot] == h)
                    key = (b.row_of_word()[hit] + b.first_row) * len(vocabulary) + slot[hit]
                    key, tf = np.unique(key, return_counts=True)
                    rows.append(key // len(vocabulary)), slots.append(key % len(vocabulary)), tfs.append(tf)
                yield _row(ids[lo:lo + SHARD_DOCS], *(np.concatenate(x) for x in (lengths, rows, slots, tfs)))
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Postings of a shard as impacts, with the maximum of every term and of every pair."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.asarray(row["doc_ids"], np.int64)
        lengths = np.asarray(row["lengths"], np.int64)
        docs, tf = np.asarray(row["docs"], np.int64), np.asarray(row["tfs"], np.int64)
        slots, counts = np.asarray(row["slots"], np.int64), np.asarray(row["counts"], np.int64)
        m = 100 - 25 + (25 * lengths * n_docs) // n_terms
        impact = np.repeat(weights[slots], counts) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        ends = np.cumsum(counts)
        self.postings = {int(s): (docs[e - c:e], impact[e - c:e]) for s, c, e in zip(slots, counts, ends, strict=True)}
        self.most = {s: int(x.max()) for s, (_, x) in self.postings.items()}
        self.joint: dict = {}

    def pair_bound(self, pair) -> int:
        """Most that a document of the shard gets from both terms of the pair ((slot, times), (slot, times)).

        The pair's intersection is listed at its first use in the shard and its joint maximum kept.
        """
        if pair not in self.joint:
            (s, x), (t, y) = pair
            (a, p), (b, q) = self.postings[s], self.postings[t]
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            joint = int((x * p[i] + y * q[j]).max()) if len(i) else 0
            self.joint[pair] = max(joint, x * self.most[s], y * self.most[t])
        return self.joint[pair]

    def units(self, query, pairs: bool = True):
        """(bound, terms) of the query's units present here, by ascending bound; without ``pairs`` every term by itself."""
        out = []
        for unit in query if pairs else [(t,) for unit in query for t in unit]:
            here = tuple((s, x) for s, x in unit if s in self.postings)
            if len(here) == 2:
                out.append((self.pair_bound(here), here))
            elif here:
                out.append((here[0][1] * self.most[here[0][0]], here))
        return sorted(out)

    def search(self, query, floor: int, pairs: bool = True):
        """(documents, scores, how many were scored): all documents that score ``floor`` (1 at least) or more, by MaxScore."""
        units = self.units(query, pairs)
        floor = max(floor, 1)
        below = np.concatenate([[0], np.cumsum([bound for bound, _ in units], dtype=np.int64)])   # what the first units add at most
        k = int(np.searchsorted(below, floor)) - 1      # the first k units alone do not reach the floor
        if k >= len(units):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        score = np.zeros(len(self.ids), np.int64)
        for _, terms in units[k:]:
            for s, x in terms:
                docs, impact = self.postings[s]
                score[docs] += x * impact
        found = np.flatnonzero(score)
        scored, score = len(found), score[found]
        for u in range(k - 1, -1, -1):
            able = score + below[u + 1] >= floor
            found, score = found[able], score[able]
            if not len(found):
                break
            for s, x in units[u][1]:
                docs, impact = self.postings[s]
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score = score + np.where(docs[at] == found, x * impact[at], 0)
        able = score >= floor
        return found[able], score[able], scored


def best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Index rows -> (query, doc_id, score): the task's best k of every query."""
    def run(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row].values.to_numpy() for c in ("doc_ids", "lengths", "slots", "counts", "docs", "tfs")},
                              weights, n_docs, n_terms)
                for q, query in enumerate(queries):
                    ids, scores = kept[q]
                    docs, more, _ = shard.search(query, int(scores[-1]) if len(ids) == k else 1)
                    if len(docs):
                        kept[q] = best(np.append(ids, shard.ids[docs]), np.append(scores, more), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(queries)), [len(x) for x, _ in kept]), pa.int64()),
             *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in zip(*kept, strict=True))] if queries else
            [pa.array([], pa.int64())] * 3, names=["query", "doc_id", "score"])
    return run


def paired(terms, weights: np.ndarray):
    """Units of a query from its (slot, times): neighbours in the order of weight."""
    order = sorted((s for s in terms if weights[s[0]] > 0), key=lambda s: (weights[s[0]], s))
    return [tuple(order[i:i + 2]) for i in range(0, len(order), 2)]


def _query_blocks(items: DataFrame):
    """Lists of (item id, text), about QUERY_BYTES of text each."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z
    lower-cased. With N documents that hold a term, L terms in all, n terms in a
    document, df documents that hold a term and tf of its occurrences in one, an item's
    term adds, each time it stands in the item,
    ``floor(1000 ln((2N + 2) / (2 df + 1))) * ((10**9 tf) div (1000 tf + 12 (75 + 25 n N div L)))``.
    Only scores above 0 count; equal scores rank by ascending document id.

    Null and empty texts hold no terms: such documents are not found, such items give
    no rows. Documents without an id take no part, also not in the statistics; rows of
    one id are documents each. Repeated rows of an item are one item; a null item id
    stays null. Other columns are not read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text <> ''").distinct()
    out = None
    for block in _query_blocks(asked):
        hashes = [b.word_hashes()[lo:hi] for b in words_of(pa.array([t for _, t in block], pa.string()))
                  for lo, hi in zip(b.row_words[:-1], b.row_words[1:], strict=True)]
        vocabulary = np.unique(np.concatenate(hashes))
        if not len(vocabulary):
            continue
        index = written(d.mapInArrow(_indexed(vocabulary), _INDEX))
        total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not total[1]:
            continue
        df = np.zeros(len(vocabulary), np.int64)         # one number per term of the block
        for slot, n in (index.select(F.explode(F.arrays_zip("slots", "counts")).alias("x"))
                        .groupBy("x.slots").agg(F.sum("x.counts")).collect()):
            df[slot] = n
        weights = np.array([weight(total[0], int(n)) for n in df], np.int64)
        queries = []
        for h in hashes:
            slots, times = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
            queries.append(paired(list(zip(slots.tolist(), times.tolist(), strict=True)), weights))
        found = index.mapInArrow(_searched(queries, weights, int(total[0]), int(total[1]), k), "query long, doc_id long, score long")
        order = [F.desc("score"), "doc_id"]
        first = Window.partitionBy("query", "salt").orderBy(*order)
        last = Window.partitionBy("query").orderBy(*order)
        ranked = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
                  .withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
                  .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item_id long")
        part = ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
