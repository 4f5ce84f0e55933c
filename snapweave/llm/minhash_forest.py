"""MinHash near-duplicates by an LSH forest.

Every document's set of k-word shingles gets a MinHash signature that is cut
into ``TREES`` label strings of ``DEPTH`` values. Each tree is one sorted order
of all labels (a range-partitioned sort); documents that share a long common
prefix stand next to each other. Regions are taken at a prefix of ``BASE``
values and deepened one value at a time while they hold more than ``REGION``
rows, so crowded regions are compared at a longer prefix; regions that stay
crowded at full depth compare sorted neighbours. Candidate pairs whose sketches
(two bits of every MinHash value) and set sizes rule out the similarity are left
out (4.5 standard deviations), the rest are confirmed exactly on the full shingle sets, and the
links are closed to components.

Equal sets are collapsed to one representative first, so copies never meet as
pairs. The first scan of the forest only serves to tie most of a group together:
within a region a document keeps its ``NEAREST`` most similar candidates and its
sorted neighbours, and over all trees its ``BEST`` most similar ones, so a group
of m near copies yields O(m) pairs. The second scan knows the components found
and looks at every candidate pair between two of them, without a limit per
document: rows that share ``BASE`` values in a tree, in regions with several
components, form clusters, whatever the number of partitions; a cluster is cut by
hash into blocks of about ``BLOCK_ROWS`` rows and ``BLOCK_SHINGLES`` shingles, and
every two blocks meet under a key of their own, with the full sets. Pairs of
different components whose sketches allow it are confirmed there, and the block
writes one row per linked set, naming the smallest id it found, so what is
written follows the rows and not their pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textcore as T
from .adaptive_prefix import overlaps
from .components import components, shuffle_partitions, smallest_reachable
from .tables import written

TREES, DEPTH, BASE = 24, 10, 4
REGION, NEAREST, NEIGHBOURS, BEST = 512, 4, 8, 10
HASHES = TREES * DEPTH
SKETCH_WORDS = 4                   # per plane: one bit of every hash, padded
SKETCH_SIGMAS = 4.5
BUFFER_ROWS = 60_000
CHUNK_PAIRS = 500_000
BLOCK_EDGES = 8192
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def _row_sets(block: T.Block, k: int):
    """Sorted distinct shingle hashes of every row of the block."""
    h = block.word_hashes()
    grams = T.windows(h, k)
    out = []
    for lo, hi in zip(block.row_words[:-1], block.row_words[1:], strict=True):
        n = hi - lo
        if n >= k:
            s = np.sort(grams[lo:hi - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(T.mix(np.array([hash_short(h[lo:hi])], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hash_short(words: np.ndarray) -> int:
    """One value for a whole sequence shorter than a shingle (its length counts)."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (HASHES of 32 bits) of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        v = _MUL[:, None] * x[None, i:i + 4096] + _ADD[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(least, (v * np.uint32(0x2C1B3C6D)).min(axis=1), out=least)
    return least


def sketch(sig: np.ndarray) -> bytes:
    """The two lowest bits of every value, as two planes of SKETCH_WORDS words."""
    planes = np.zeros((2, SKETCH_WORDS * 64), np.uint8)
    planes[0, :HASHES], planes[1, :HASHES] = sig & np.uint32(1), (sig >> np.uint32(1)) & np.uint32(1)
    return np.packbits(planes, axis=1).tobytes()


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values agree in both bits, per row of two sketch matrices (or of what they broadcast to)."""
    d = x ^ y
    return HASHES - np.bitwise_count(d[..., :SKETCH_WORDS] | d[..., SKETCH_WORDS:]).sum(axis=-1).astype(np.int64)


def label(sig: np.ndarray) -> bytes:
    """16 bits of every value, mixed from all of its bits: the high bits of minima are all 0 for large sets."""
    v = sig ^ (sig >> np.uint32(16))
    v = v * np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v = v * np.uint32(0xC2B2AE35)
    return (v >> np.uint32(16)).astype(">u2").tobytes()


def _set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids, ns, hs, labels, sketches = [], [], [], [], []
            for b in T.blocks(batch.column(1), T.WHITE, lower=True):
                for s in _row_sets(b, k):
                    ns.append(len(s))
                    if not len(s):
                        hs.append(None), labels.append(None), sketches.append(None)
                        continue
                    sig = signature(s)
                    hs.append(_set_hash(s))
                    labels.append(label(sig))
                    sketches.append(sketch(sig))
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(hs, pa.int64()),
                                              pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())],
                                             names=["id", "n", "h", "labels", "sketch"])
    return run


def _pairs(ids, hs, sizes, labels, sketches, num, den):
    """Candidate pairs of rows sorted by label: columns i, j and the sketch values that agree; and which rows left pairs out."""
    m = len(ids)
    lcp = np.zeros(m, np.int64)
    same = labels[1:] == labels[:-1]
    lcp[1:] = np.where(same.all(axis=1), DEPTH + 1, same.argmin(axis=1))  # first column is the tree
    cut = lcp < BASE + 1
    cut[0] = True
    windowed = []
    near = np.zeros(m, bool)
    for depth in range(BASE + 1, DEPTH + 2):
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, m))
        big = np.repeat(size > REGION, size)
        if not big.any():
            break
        if depth == BASE + 1:
            near = big.copy()
        if depth == DEPTH + 1:
            windowed = big
            break
        cut |= big & (lcp < depth + 1)
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, m))
    pos = np.arange(m) - np.repeat(first, size)
    left = np.repeat(size, size) - pos          # rows from here to the region's end
    if len(windowed):
        left = np.where(windowed, np.minimum(left, NEIGHBOURS + 1), left)
    found_i, found_j, agree = [], [], []

    def test(i, j):
        ok = (sizes[i] * den >= num * sizes[j]) & (sizes[j] * den >= num * sizes[i]) & (hs[i] != hs[j])
        i, j = i[ok], j[ok]
        if len(i):
            a = agreeing(sketches[i], sketches[j])
            ok = a >= least_agree(num / den)
            found_i.append(i[ok]), found_j.append(j[ok]), agree.append(a[ok])

    i = np.arange(m)
    o = 1
    while True:
        i = i[left[i] > o]
        if not len(i):
            break
        test(i, i + o)
        o += 1
    if near.any():  # crowded regions: sorted neighbours over the deeper cuts as well
        for o in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero(near[:-o] & near[o:] & (np.cumsum(lcp < BASE + 1)[o:] == np.cumsum(lcp < BASE + 1)[:-o]))
            test(i, i + o)
    if not found_i:
        return np.zeros((0, 3), np.int64), near
    i, j, a = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(agree)
    src, other, edge = np.concatenate([i, j]), np.concatenate([-a, -a]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((np.abs(np.concatenate([j - i, j - i])), other, src))
    s = src[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    keep = np.zeros(len(i), bool)
    keep[edge[order[rank < NEAREST]]] = True
    keep |= (j - i) <= 2
    near[i[~keep]] = near[j[~keep]] = True
    return np.stack([i[keep], j[keep], a[keep]], axis=1), near


def crossing(ids, hs, n, comp, sketches, sets, side, num, den):
    """Rows of one block (side 0: all meet) or two (sides 1 and 2) -> (id, smallest id that the block ties it to), over the
    pairs of different components."""
    a, b = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    if not len(a) or not len(b) or (comp == comp[0]).all():
        return ids[:0], ids[:0]
    found = []
    step = max(1, CHUNK_PAIRS // len(b))
    for at in range(0, len(a), step):
        i, j = a[at:at + step, None], b[None, :]
        ok = (comp[i] != comp[j]) & (hs[i] != hs[j]) & ((side[i] == 1) | (i < j)) & (n[i] * den >= num * n[j]) & (n[j] * den >= num * n[i])
        if ok.any():
            i, j = np.nonzero(ok & (agreeing(sketches[i], sketches[j]) >= least_agree(num / den)))
            found.append((a[at + i], b[j]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (a[:0], b[:0])
    if not len(i):
        return ids[:0], ids[:0]
    (ua, at_i), (ub, at_j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    both = overlaps([sets[r] for r in ua], [sets[r] for r in ub])[at_i, at_j]
    ok = both * den >= num * (n[i] + n[j] - both)
    order = np.argsort(ids, kind="stable")           # labels in the order of ids
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    to = smallest_reachable(len(ids), place[i[ok]], place[j[ok]])
    moved = np.flatnonzero(to != np.arange(len(ids)))
    return ids[order[moved]], ids[order[to[moved]]]


def least_agree(similarity: float) -> int:
    p = similarity + (1 - similarity) / 4
    return int(HASHES * p - SKETCH_SIGMAS * (HASHES * p * (1 - p)) ** 0.5)


_PAIR_SCHEMA = "kind int, a long, ha long, b long, hb long, at int, side int, n long, label binary, sketch binary"
_NAMES = ["kind", "a", "ha", "b", "hb", "at", "side", "n", "label", "sketch"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _matrix(col, dtype, width):
    data = b"".join(x.as_py() for x in col)
    return np.frombuffer(data, dtype).reshape(-1, width)


class _Rows:
    """Sorted label rows as arrays."""

    def __init__(self, batch):
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.hs = batch.column("h").to_numpy(zero_copy_only=False)
        self.n = batch.column("n").to_numpy(zero_copy_only=False)
        self.labels = _matrix(batch.column("label"), ">u2", DEPTH + 1)
        self.sketches = _matrix(batch.column("sketch"), np.uint64, 2 * SKETCH_WORDS)

    def take(self, sel):
        out = object.__new__(_Rows)
        for k, v in self.__dict__.items():
            setattr(out, k, v[sel])
        return out

    def plus(self, other):
        out = object.__new__(_Rows)
        for k, v in self.__dict__.items():
            setattr(out, k, np.concatenate([v, getattr(other, k)]))
        return out

    def __len__(self):
        return len(self.ids)

    def pairs(self, num, den):
        if len(self) < 2:
            return
        kept, left_out = _pairs(self.ids, self.hs, self.n, self.labels, self.sketches, num, den)
        yield self.marked(left_out)
        i, j, agree = kept.T
        yield pair_batch(self.ids[i], self.hs[i], self.ids[j], self.hs[j], agree)

    def marked(self, which):
        ids, n = pa.array(self.ids[which]), int(which.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), ids, pa.array(self.hs[which]),
                                           *[pa.nulls(n, t) for t in _TYPES[3:]]], names=_NAMES)

    def borders(self, at, side):
        n = len(self)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(self.ids), pa.array(self.hs), none, none,
             pa.array(np.full(n, at, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(self.n),
             pa.array([x.tobytes() for x in self.labels], pa.binary()), pa.array([x.tobytes() for x in self.sketches], pa.binary())], names=_NAMES)


def pair_batch(a, ha, b, hb, agree):
    n = len(a)
    swap = a > b
    a, b, ha, hb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, hb, ha), np.where(swap, ha, hb)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32)), pa.array(a), pa.array(ha), pa.array(b), pa.array(hb),
         *[pa.nulls(n, t) for t in _TYPES[5:7]], pa.array(agree), *[pa.nulls(n, t) for t in _TYPES[8:]]], names=_NAMES)


def _scan(num, den):
    """Sorted rows of one partition -> candidate pairs, its first and last rows for the borders, and the rows that left pairs out.

    The first and the last region may go on beyond the border, where only NEIGHBOURS rows meet, so all their rows count as such.
    """
    def run(batches):
        from pyspark import TaskContext
        at = TaskContext.get().partitionId()
        held, head, tail, begin = None, None, None, None
        for batch in batches:
            rows = _Rows(batch)
            if not len(rows):
                continue
            begin = rows.labels[0, :BASE + 1] if begin is None else begin
            cut_off = (rows.labels[:, :BASE + 1] == begin).all(axis=1)
            if cut_off.any():
                yield rows.marked(cut_off)
            if head is None or len(head) < NEIGHBOURS:
                head = rows.take(slice(0, NEIGHBOURS)) if head is None else head.plus(rows).take(slice(0, NEIGHBOURS))
            held = rows if held is None else held.plus(rows)
            tail = held.take(slice(max(0, len(held) - NEIGHBOURS), None))
            if len(held) < BUFFER_ROWS:
                continue
            key = held.labels[:, :BASE + 1]
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:                                  # whole regions; the last one may go on
                yield from held.take(slice(0, cut)).pairs(num, den)
                held = held.take(slice(cut, None))
            if len(held) >= BUFFER_ROWS:             # one crowded region fills the buffer
                yield from held.pairs(num, den)
                held = held.take(slice(len(held) - REGION, None))
        if held is not None:
            yield from held.pairs(num, den)
            yield held.marked((held.labels[:, :BASE + 1] == held.labels[-1, :BASE + 1]).all(axis=1))
            yield head.borders(at - 1, 1)
            yield tail.borders(at, 0)
    return run


def _borders(num, den):
    """Last rows of a partition beside the first rows of the next one -> pairs across the border."""
    def run(group):
        g = group.combine_chunks().sort_by([("label", "ascending"), ("id", "ascending")])
        out = [p for b in g.to_batches() for p in _Rows(b).pairs(num, den)]
        return pa.Table.from_batches(out, pa.schema(list(zip(_NAMES, _TYPES, strict=True)))).select([*_NAMES[:5], "n"])
    return run


def _verify(k, num, den):
    """Rows sorted by (block, kind): texts first, then the block's pairs -> links confirmed on full sets."""
    def run(batches):
        block, sets = None, {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            keys = list(zip(batch.column("block").to_pylist(), batch.column("salt").to_pylist(), strict=True))
            a, ha, b, hb = (batch.column(c).to_pylist() for c in ("a", "ha", "b", "hb"))
            got = batch.column("shingles")
            out_a, out_b = [], []
            for i, kind in enumerate(kinds):
                if keys[i] != block:
                    block, sets = keys[i], {}
                if kind == 0:
                    sets[a[i], ha[i]] = np.frombuffer(got[i].as_py(), np.uint64)
                    continue
                x, y = sets[a[i], ha[i]], sets[b[i], hb[i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * den >= num * (len(x) + len(y) - both):
                    out_a.append(a[i]), out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    return run


def _full_sets(k):
    """(block, salt, id, h, text) -> the row's shingle set where its hash is h."""
    def run(batches):
        for batch in batches:
            sets = [s for b in T.blocks(batch.column("text"), T.WHITE, lower=True) for s in _row_sets(b, k)]
            want = batch.column("ha").to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and _set_hash(s) == want[i]]
            part = batch.select(["block", "salt", "a", "ha"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sets[i].tobytes() for i in keep], pa.binary())],
                                             names=["block", "salt", "a", "ha", "shingles"])
    return run


def _met(num, den):
    """Rows sorted by (cluster, x, y) -> links (a, b) between the components of every two blocks."""
    def run(batches):
        key, rows = None, []

        def done():
            ids, hs, n, comp, side = (np.array([r[c] for r in rows], np.int64) for c in range(5))
            sketches = np.stack([np.frombuffer(r[5], np.uint64) for r in rows])
            return crossing(ids, hs, n, comp, sketches, [np.frombuffer(r[6], np.uint64) for r in rows], side, num, den)

        for batch in batches:
            found = []
            for *k, plain in zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y")),
                                 zip(*(batch.column(c).to_pylist() for c in ("id", "h", "n", "comp", "side", "sketch", "shingles")), strict=True),
                                 strict=True):
                if k != key:
                    if len(rows) > 1:
                        found.append(done())
                    key, rows = k, []
                rows.append(plain)
            yield _link_batch(found)
        if len(rows) > 1:
            yield _link_batch([done()])
    return run


def _link_batch(found):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in (0, 1)],
                                      names=["a", "b"])


def _per_tree(reps: DataFrame, values: int) -> DataFrame:
    """The columns of reps with a row for every tree: label holds the tree and its first values."""
    return (reps.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .withColumn("label", F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")),
                                          F.expr(f"substring(labels, tree * {2 * DEPTH} + 1, {2 * values})")))
            .drop("tree", "labels"))


def _candidates(reps: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, ha, b, hb, n) of the forest over reps (id, h, n, labels, sketch), n being the
    sketch values that agree, and the rows (id, h) that did not keep all theirs."""
    parts = shuffle_partitions(reps.sparkSession)
    rows = _per_tree(reps, DEPTH).select("id", "h", "n", "sketch", "label")
    found = written(rows.repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id")
                        .mapInArrow(_scan(num, den), _PAIR_SCHEMA))
    across = (found.where("kind = 1")
              .select("at", F.col("a").alias("id"), F.col("ha").alias("h"), "n", "label", "sketch")
              .groupBy("at").applyInArrow(_borders(num, den), "kind int, a long, ha long, b long, hb long, n long"))
    every = found.where("kind = 0").select("a", "ha", "b", "hb", "n").union(across.where("kind = 0").select("a", "ha", "b", "hb", "n"))
    return every.distinct(), found.where("kind = 2").select(F.col("a").alias("id"), F.col("ha").alias("h")).distinct()


def _clusters(rows: DataFrame) -> DataFrame:
    """(sid, cluster) over rows (sid, labels, comp): rows that share BASE values in a tree, step by step, in regions of
    several components."""
    place = _per_tree(rows.select("sid", "comp", "labels"), BASE)
    regions = (place.groupBy("label").agg(F.min("sid").alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .where("lo < hi").select("label", "first"))
    return components(place.join(written(regions), "label").where("sid <> first").select("sid", "first").distinct()
                      .toDF("a", "b")).toDF("sid", "cluster")


def _between(rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between components over rows (sid, id, h, n, labels, sketch, comp), the sets built again from texts (id, text):
    every two rows that share BASE values in a tree are looked at, whatever the region's size and the number of partitions."""
    parts = shuffle_partitions(rows.sparkSession)
    member = rows.drop("labels").join(written(_clusters(rows)), "sid")
    size = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    asked = member.select(F.col("cluster").alias("block"), F.col("sid").alias("salt"), F.col("id").alias("a"), F.col("h").alias("ha"))
    sets = (asked.join(texts.withColumnRenamed("id", "a"), "a").select("block", "salt", "a", "ha", "text")
            .mapInArrow(_full_sets(words), "block long, salt long, a long, ha long, shingles binary")
            .select(F.col("salt").alias("sid"), "shingles").dropDuplicates(["sid"]))
    dealt = (member.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("sid"), "blocks")).join(sets, "sid")
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(x == y, 0).when(F.col("own") == x, 1).otherwise(2)
    return (dealt.select("cluster", x.alias("x"), y.alias("y"), side.alias("side"), "id", "h", "n", "comp", "sketch", "shingles")
            .repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
            .mapInArrow(_met(num, den), "a long, b long"))


def _confirmed(d: DataFrame, edges: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b) of the edges (a, ha, b, hb) whose full sets, built again from the texts of d (id, text), are similar enough."""
    parts = shuffle_partitions(d.sparkSession)
    # pairs are confirmed in blocks: neighbours of one small id together, large blocks split by a hash of the larger end
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b"), F.col("a")))
    low = ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("block"))
    placed = (edges.join(low.withColumnRenamed("v", "a"), "a").withColumnRenamed("block", "ba")
              .join(low.withColumnRenamed("v", "b"), "b").withColumn("block", F.least("ba", "block")).drop("ba"))
    placed = written(placed.select("block", "a", "ha", "b", "hb"))
    large = written(placed.groupBy("block").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_EDGES))
    salts = F.coalesce(F.ceil(F.col("m") / BLOCK_EDGES), F.lit(1))
    placed = written(placed.join(large, "block", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts))
                         .select("block", "salt", "a", "ha", "b", "hb"))
    member = (placed.select("block", "salt", "a", "ha")
              .union(placed.select("block", "salt", F.col("b"), F.col("hb"))).distinct())
    sets = (member.join(d.withColumnRenamed("id", "a"), "a").select("block", "salt", "a", "ha", "text")
            .mapInArrow(_full_sets(words), "block long, salt long, a long, ha long, shingles binary"))
    return (sets.select("block", "salt", F.lit(0).alias("kind"), "a", "ha", F.lit(None).cast("long").alias("b"),
                        F.lit(None).cast("long").alias("hb"), "shingles")
            .union(placed.select("block", "salt", F.lit(1), "a", "ha", "b", "hb", F.lit(None).cast("binary")))
            .repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", "kind")
            .mapInArrow(_verify(words, num, den), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its
    distinct ``words``-word shingles, or its whole word sequence if shorter.
    Documents whose sets have Jaccard similarity of at least ``similarity``
    (a fraction) are linked; ``component_id`` is the smallest id reachable.

    Null or empty texts have no shingles and stand alone. Rows of one id are one
    document with the links of any of them. Rows with a null id link with nothing
    and come out with a null ``component_id``, kept. Other columns are not read.
    """
    num, den = similarity
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = written(d.mapInArrow(_signatures(words), "id long, n long, h long, labels binary, sketch binary"))
    full = sig.where("id is not null and h is not null")
    reps = written(full.groupBy("h", "n").agg(F.min("id").alias("id"), F.first("labels").alias("labels"),
                                                  F.first("sketch").alias("sketch")))
    pairs, crowded = _candidates(reps, num, den)
    pairs = written(pairs)
    sided = pairs.select("*", F.explode(F.array("ha", "hb")).alias("v"))
    best = Window.partitionBy("v").orderBy(F.desc("n"), "ha", "hb", "a", "b")
    edges = written(sided.withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEST).select("a", "ha", "b", "hb").distinct())
    links = written(_confirmed(d, edges, words, num, den))
    comp = components(links)
    # second scan: what the limits and borders of the first left out, between the components it found
    of_a, of_b = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    rest = (pairs.join(edges, ["a", "ha", "b", "hb"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")))
    rest = rest.select("a", "ha").union(rest.select("b", "hb")).toDF("id", "h")
    again = (reps.join(crowded.union(rest).distinct(), ["id", "h"], "left_semi").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .withColumn("comp", F.coalesce("component", "id")).drop("component"))
    again = written(again.withColumn("sid", F.monotonically_increasing_id()))
    links = written(links.union(_between(again, d, words, num, den)))
    comp = components(links)
    # a copy follows its set's representative; an id with several sets ties them together
    tied = (full.select("id", "h", "n").distinct().join(reps.select("h", "n", F.col("id").alias("rep")), ["h", "n"])
            .select("id", "rep").distinct())
    twice = tied.groupBy("id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 <> r1")
    if not twice.isEmpty():
        comp = components(links.union(tied.select(F.col("id"), F.col("rep"))))
    of = (tied.groupBy("id").agg(F.min("rep").alias("rep"))
          .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
          .select("id", F.coalesce("component", "rep").alias("c")))
    return (sig.select("id", "n").join(of, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("c", "id").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept")))
