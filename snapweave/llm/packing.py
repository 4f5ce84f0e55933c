"""Best-fit packing by linear grouping.

Documents become token ids plus an end id; longer ones are cut into pieces of
the sequence length. Pieces are dealt evenly into shards of about
``SHARD_PIECES`` (a shard is one task; its last, partly filled sequence is the
only loss against one global packing). In a shard:

1. large lengths (over ``LARGE`` of the sequence) are sorted and cut into
   ``GROUPS`` groups of equal cardinality, each rounded up to its longest member;
2. configurations of these few sizes are optimised one after the other: the
   longest size still in demand plus the knapsack optimum of the rest, used as
   often as the demand allows;
3. each slot of a configuration takes the longest actual piece that fits the room the
   other slots leave, and the room rounding up left takes further large pieces;
4. the small pieces, and large ones whose slot was taken, go, longest first, to the
   sequence with the least room that still takes them.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as T
from .tables import written

LENGTH, END_ID = 4096, 1
SHARD_PIECES, GROUPS, LARGE = 20_000, 12, 1 / 3
POOL_WORDS, POOL_IDS = 1_500_000, 12_000_000


class WordPieces:
    """Token ids of words, remembered by the word's hash.

    The tokenizer never joins characters across white space, nor an ASCII letter or
    digit with punctuation (but for apostrophes and its special tokens' marks), and
    lower-cases everything but special tokens. So a text's ids are the ids of its
    lower-cased stretches in a row. Forgets everything when ``POOL_WORDS`` are held.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.clear()

    def clear(self):
        self.index: dict[int, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _add(self, hashes, words):
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n0, n1 = len(self.index), len(self.index) + len(ids)
        if n1 > len(self.start):
            size = max(n1, 2 * len(self.start))
            self.start, self.count = np.resize(self.start, size), np.resize(self.count, size)
        counts = np.array([len(x) for x in ids], np.int64)
        self.count[n0:n1] = counts
        self.start[n0:n1] = self.used + np.cumsum(counts) - counts
        total = self.used + int(counts.sum())
        if total > len(self.pool):
            self.pool = np.resize(self.pool, max(total, 2 * len(self.pool)))
        self.pool[self.used:total] = np.fromiter((i for x in ids for i in x), np.uint32, total - self.used)
        self.used = total
        self.index.update(zip(hashes, range(n0, n1), strict=True))

    def block(self, b: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's words, and the number of ids of each word."""
        h = b.word_hashes()
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.index) > POOL_WORDS or self.used > POOL_IDS:
            self.clear()
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = u.tolist()
        at = np.fromiter((self.index.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            f = first[new]
            self._add(u[new].tolist(), [b.buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(b.starts[f], b.ends[f], strict=True)])
            at[new] = np.arange(len(self.index) - len(new), len(self.index))
        w = at[inverse]
        n = self.count[w]
        stop = np.cumsum(n)
        return self.pool[np.repeat(self.start[w] - (stop - n), n) + np.arange(stop[-1])], n


def _tokens(tokenizer: str, length: int, end_id: int, with_ids: bool):
    def run(batches):
        pieces = WordPieces(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for b in T.blocks(batch.column(1), lower=True, classes=T.JOINT, lower_unless=b"<|"):
                flat, n = pieces.block(b)
                ends = np.concatenate([[0], np.cumsum(n)])[b.row_words]
                out = [[] for _ in range(6)]
                for r in range(b.rows):
                    doc = np.append(flat[ends[r]:ends[r + 1]], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(doc), length)):
                        part = doc[s:s + length]
                        for o, v in zip(out, (ids[b.first_row + r], k, s, len(part), zlib.crc32(part.tobytes()),
                                              part.astype(np.int32) if with_ids else None), strict=True):
                            o.append(v)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())] + [pa.array(o, pa.int64()) for o in out[2:5]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out[5], pa.list_(pa.int32()))), names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Few-size configurations that meet the demand: (slots per size, times used); sizes fall.

    Each one takes the longest size still in demand and the fullest knapsack of
    the demanded sizes for the room left, and is used as often as the demand allows.
    """
    demand, out = list(demand), []
    while any(demand):
        top = next(i for i, d in enumerate(demand) if d)
        room = capacity - sizes[top]
        # reach[v]: size that completes v; bounded counts by unrolled copies
        reach = np.full(room + 1, -1, np.int64)
        parent = np.full(room + 1, -1, np.int64)
        ok = np.zeros(room + 1, bool)
        ok[0] = True
        for i, s in enumerate(sizes):
            left = min(demand[i] - (i == top), room // s if s else 0)
            for _ in range(left):
                fresh = np.zeros(room + 1, bool)
                fresh[s:] = ok[:-s] & ~ok[s:]
                new = np.flatnonzero(fresh & (reach < 0))
                if not len(new):
                    break
                reach[new], parent[new] = i, new - s
                ok[new] = True
            # one size at a time, so a chain of parents never uses a size more often than it was unrolled
        v = int(np.flatnonzero(ok)[-1])
        use = [0] * len(sizes)
        use[top] = 1
        while v:
            use[reach[v]] += 1
            v = int(parent[v])
        times = min(d // u for d, u in zip(demand, use, strict=True) if u)
        if not times:
            use = [int(i == top) for i in range(len(sizes))]
            times = 1
        out.append((use, times))
        demand = [d - u * times for d, u in zip(demand, use, strict=True)]
    return out


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; no bin holds more than ``capacity``."""
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity * LARGE]
    small = order[len(large):]
    queues = [q for q in np.array_split(large, min(GROUPS, len(large))) if len(q)] if len(large) else []
    sizes = [int(lengths[q[0]]) for q in queues]
    unused: list[list[int]] = [[] for _ in range(capacity + 1)]       # large pieces by length, and the lengths there are
    there = 0
    for i, length in zip(large[::-1].tolist(), lengths[large[::-1]].tolist(), strict=True):
        unused[length].append(i)
        there |= 1 << length
    fill: list[int] = []
    for use, times in configurations(sizes, [len(q) for q in queues], capacity):
        slots = [s for s, u in zip(sizes, use, strict=True) for _ in range(u)]
        # room for each slot: what the slots behind it leave; at last all that is left, as long as a piece fits
        behind = [sum(slots[k + 1:]) for k in range(len(slots))] + [0] * (capacity // max(int(capacity * LARGE), 1))
        for _ in range(times):
            at = 0
            for later in behind:
                fits = there & ((1 << (capacity - at - later + 1)) - 1) if at + later < capacity else 0
                if not fits:
                    continue
                length = fits.bit_length() - 1
                i = unused[length].pop()
                if not unused[length]:
                    there &= ~(1 << length)
                bin_of[i], offset[i] = len(fill), at
                at += length
            if at:
                fill.append(at)
    small = np.concatenate([np.array([i for x in reversed(unused) for i in x], np.int64), small])
    room = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fill):
        room[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for i, length in zip(small.tolist(), lengths[small].tolist(), strict=True):
        fits = mask >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, capacity - r
        room[r - length].append(b)
        mask |= 1 << (r - length)
        fill[b] = capacity - r + length
    return bin_of, offset


def _shard(capacity: int):
    def run(batches):
        from pyspark import TaskContext
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        b, o = pack(t.column("length").to_numpy(), capacity)
        t = t.append_column("sequence_id", pa.array((TaskContext.get().partitionId() << 32) + b)).append_column("offset", pa.array(o))
        yield from t.to_batches()
    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
                   length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32 (of the little-endian 32-bit
    ids), sequence_id, offset, and with ``with_ids`` the ids. Every row has at
    least its end id: null and empty texts give one piece of one token. Rows with
    a null or repeated id are packed like any other. Other columns are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(d.mapInArrow(_tokens(tokenizer, length, end_id, with_ids), schema + (", ids array<int>" if with_ids else "")))
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return pieces.repartition(shards).mapInArrow(_shard(length), out)
