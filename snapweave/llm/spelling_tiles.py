"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into
the other: with a the longer length, their common prefix and common suffix together
reach a - 1. Words stand as rows of padded code-point matrices, once aligned left
and once right; a tile compares pairs of rows in one step, prefix lengths on the
left matrix and suffix lengths on the right one.

Only rows of one block are paired. The positions of a word are cut into bands of
``BAND`` code points; if the edit lies in a band, all before and all behind it is
equal, so that part, hashed with a and the band's number, is the block's key. A
word stands in the blocks of a = its length and a = its length + 1. All words of a
block agree outside one band, so a block never holds more than 58 ** 3 + 58 ** 2
words (there are 58 lower-cased letters), however many rows share a beginning.
Words of more than ``BAND * MOST_BANDS`` letters are cut into ``MOST_BANDS`` bands.
A pair counts in the band that holds its first difference and nowhere else, and a
block gives one row per word with the number of its near words there and the most
frequent one, never the pairs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textcore as T
from .components import shuffle_partitions
from .tables import written

LEAST, OFTEN, RATIO, DAMAGE = 7, 2, 10, 31
BAND, MOST_BANDS = 3, 22
TILE_PAIRS, TILE_BYTES = 1 << 16, 1 << 22
LONG = 64                       # bytes of a run from which its checksum is taken by itself

_NONE = np.ones(256, bool)
_LETTER = np.zeros(256, bool)
for _lo, _hi in ((0x41, 0x5A), (0x61, 0x7A)):
    _LETTER[_lo:_hi + 1] = True
_LEAD = 0xC3                    # first byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _letters(buf: np.ndarray) -> np.ndarray:
    """The buffer with A-Z lower-cased and a space for every byte outside `[A-Za-z\\u00C0-\\u00FF]`."""
    lead = buf == _LEAD
    inside = _LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    return np.where(inside, T.LOWER[buf], np.uint8(0x20))


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of buf[start:end], carried on from the checksum ``begin`` of what stands before."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(buf[starts[i]:ends[i]].tobytes(), int(begin[i]))
    order = np.flatnonzero(size <= LONG)
    order = order[np.argsort(-size[order], kind="stable")]
    size, at = size[order], starts[order]
    state = begin[order] ^ np.uint32(0xFFFFFFFF)
    upto = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else ()
    for k, m in enumerate(upto):    # the first m runs have a byte k
        s = state[:m]
        state[:m] = _CRC[(s ^ buf[at[:m] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges (ascending, apart from each other) as strings."""
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1               # a run may begin where the one of the row before ends
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = buf[np.cumsum(step[:-1], dtype=np.int8) > 0]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def _counted(batches):
    """Rows (id, text) -> (word, n) of every batch, damage included."""
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), []
        for raw in T.blocks(batch.column(1), _NONE):
            b = T.Block(_letters(raw.buf), raw.offsets, raw.first_row)
            lead = np.zeros(len(b.buf) + 1, np.int64)
            np.cumsum(b.buf == _LEAD, out=lead[1:])
            length = b.ends - b.starts - (lead[b.ends] - lead[b.starts])
            use = length >= LEAST
            starts, ends, length, row = b.starts[use], b.ends[use], length[use], b.row_of_word()[use]
            begin = np.array([zlib.crc32(f"{'' if i is None else i}:".encode())
                              for i in ids[b.first_row:b.first_row + b.rows]], np.uint32)
            h = checksums(b.buf, starts, ends, begin[row])
            hit = h % DAMAGE == 0
            parts.append(_strings(b.buf, starts[~hit], ends[~hit]))
            damaged = []
            for s, e, at in zip(starts[hit], ends[hit], h[hit] % length[hit], strict=True):
                run = b.buf[s:e].tobytes().decode()
                if len(run) > LEAST:
                    damaged.append(run[:at] + run[at + 1:])
            parts.append(pa.array(damaged, pa.large_string()))
        found = pc.value_counts(pa.chunked_array(parts, pa.large_string()))
        yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])


def bands(a):
    """How many bands a pair of longer length ``a`` has."""
    return F.least(F.ceil(a / BAND), F.lit(MOST_BANDS)).cast("int")


def _blocks(words: DataFrame) -> DataFrame:
    """(key, a, lo, hi, word, n): every word in all its blocks; the band is [lo, hi)."""
    a, band, size = F.col("a"), F.col("band"), F.col("size")
    lo, hi = F.floor(band * a / size).cast("int"), F.floor((band + 1) * a / size).cast("int")
    return (words.withColumn("l", F.char_length("word"))
            .withColumn("a", F.explode(F.array("l", F.col("l") + 1))).withColumn("size", bands(a))
            .withColumn("band", F.explode(F.sequence(F.lit(0), size - 1)))
            .withColumn("lo", lo).withColumn("hi", hi)
            .select(F.xxhash64("a", "band", F.expr("substring(word, 1, lo)"), F.expr("right(word, a - hi)")).alias("key"),
                    "a", "lo", "hi", "word", "n"))


def _matrices(words: list[bytes], width: int):
    """The words as rows of code points, aligned left and aligned right, and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w.rjust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return left, right, size


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first columns agree, per row."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def tiles(first: np.ndarray, size: np.ndarray, most: int):
    """All pairs i < j of rows within groups (first row, size), in pieces of about ``most`` pairs."""
    rows = np.repeat(first + size, size) - np.arange(size.sum()) - 1   # rows behind each one in its group
    upto, at = np.cumsum(rows), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        w = rows[at:to]
        i = np.repeat(np.arange(at, to), w)
        yield i, i + 1 + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        at = to


def _near(key, a, lo, hi, words, n):
    """Rows sorted by (key, word) -> per row: near words in its block, the row of the most frequent one (-1: none)."""
    width = int(a.max())
    left, right, size = _matrices(words, width)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, best = np.zeros(len(key), np.int64), np.full(len(key), -1)
    found = []
    for i, j in tiles(first, np.diff(np.append(first, len(key))), max(1, min(TILE_PAIRS, TILE_BYTES // width))):
        longer = np.maximum(size[i], size[j]) == a[i]                  # two shorter ones meet elsewhere
        i, j = i[longer], j[longer]
        ahead = np.minimum(_common(left[i], left[j]), np.minimum(size[i], size[j]))
        here = (ahead >= lo[i]) & (ahead < hi[i]) & (a[i] == a[j])
        i, j, ahead = i[here], j[here], ahead[here]
        behind = _common(right[i, ::-1], right[j, ::-1])
        ok = ahead + behind >= a[i] - 1
        found.append(np.stack([i[ok], j[ok]]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    of, other = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    np.add.at(count, of, 1)
    head = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    best[of[head]] = other[head]
    return count, best


def _tiled(batches):
    """Rows sorted by (a, key, word) -> (word, n_near, best, best_n) for every word with a near word in a block."""
    held = None
    names = ["key", "a", "lo", "hi", "word", "n"]

    def done(table):
        c = [x.to_numpy() for x in (table.column(k) for k in ("key", "a", "lo", "hi", "n"))]
        words = table.column("word").to_pylist()
        count, best = _near(*c[:4], [w.encode("latin-1") for w in words], c[4])
        hit = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in hit], pa.string()), pa.array(count[hit]),
             pa.array([words[i] for i in best[hit]], pa.string()), pa.array(c[4][best[hit]])], names=["word", "n_near", "best", "best_n"])

    for batch in batches:
        t = pa.Table.from_batches([batch]).select(names)
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column("key").to_numpy()
        if not len(key):
            continue
        last = np.flatnonzero(key != key[-1])
        if len(last) and len(key) >= 4096:                             # whole blocks; the last one may go on
            yield from _parts(held.slice(0, last[-1] + 1), done)
            held = held.slice(last[-1] + 1)
    if held is not None and held.num_rows:
        yield from _parts(held, done)


def _parts(table, done):
    """The blocks of a table in parts whose matrices stay small (one block at least)."""
    key, a = table.column("key").to_numpy(), table.column("a").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    start = 0
    for k, at in enumerate(first):
        end = first[k + 1] if k + 1 < len(first) else len(key)
        if at > start and (end - start) * int(a[start:end].max()) > 4 * TILE_BYTES:
            yield done(table.slice(start, at - start))
            start = at
    yield done(table.slice(start))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased; where 31 divides the CRC-32 of
    ``<id>:<run>``, without the code point at that checksum modulo the run's length. Words of ``LEAST`` letters and more."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word (see word_counts) that occurs at least twice: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form``: its near word of largest n (ties: the smallest in code-point order) if
    that n is at least ten times its own; ``root``: the last word reached by following
    forms, the word itself without one; ``n_near``: how many words are near it.

    Null and empty texts hold no words; a null id stands as an empty text in the
    checksum; rows of one id are counted each. Other columns are not read. An empty
    table gives no rows. Forms grow tenfold at each step, so that roots are found in
    at most five rounds of pointer jumping for counts of 64 bits.
    """
    words = written(word_counts(docs, id_col, text_col).where(F.col("n") >= OFTEN))
    parts = shuffle_partitions(words.sparkSession)
    near = (_blocks(words).repartition(parts, "key").sortWithinPartitions("a", "key", "word")
            .mapInArrow(_tiled, "word string, n_near long, best string, best_n long")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                 F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")))
    own = words.join(near, "word", "left").withColumn("form", F.when(-F.col("top.less") >= RATIO * F.col("n"), F.col("top.best")))
    table = written(own.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                               F.when(F.col("form").isNotNull(), -F.col("top.less")).alias("form_n")))
    ahead = written(table.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(ahead.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                                 F.col("beyond").isNotNull().alias("moved")))
        ahead = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return (table.join(ahead, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
