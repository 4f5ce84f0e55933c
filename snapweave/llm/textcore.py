"""Vectorised word handling shared by the operators (numpy over Arrow buffers).

A column of texts is cut into blocks of whole rows. In a block every word is a
(start, end) byte range of one flat buffer, so splitting, hashing and k-gram
hashing are a few numpy passes instead of one Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 2**64)
_WORD_K = 0xD6E8FEB86659FD93
_WORD_KINV = pow(_WORD_K, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class _Powers:
    """Growing table of powers modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.table = base, _powers(base, 1 << 12)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = _powers(self.base, 1 << (n - 1).bit_length())
        return self.table[:n]


_bp, _bi, _kp, _ki = _Powers(_B), _Powers(_BINV), _Powers(_WORD_K), _Powers(_WORD_KINV)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit reaches every output bit)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


# byte classes: 1 marks a separator
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.zeros(256, bool)  # everything ASCII but digits and letters
PLAIN[:0x80] = True
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    PLAIN[_lo:_hi + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# for the word tokenizer: ASCII letters and digits (1), punctuation that always parts from them (2)
JOINT = np.zeros(256, np.uint8)
JOINT[0x21:0x7F] = 2
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    JOINT[_lo:_hi + 1] = 1
JOINT[[ord(x) for x in "'<|>"]] = 0


class Block:
    """Words of some consecutive rows: flat buffer, word ranges and word offsets of each row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first_row: int, separators: np.ndarray = WHITE,
                 classes: np.ndarray | None = None):
        """``classes``: a word also ends between a byte of class 1 and a byte of class 2."""
        self.buf, self.offsets, self.first_row = buf, offsets, first_row
        n = len(buf)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~separators[buf]
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside[:n]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if classes is not None and n > 1:
            c = classes[buf]
            edge[1:n] |= c[1:] + c[:-1] == 3
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero(before & (~inside | edge))
        self.rows = len(offsets) - 1
        self.row_words = np.searchsorted(self.starts, offsets)  # word offsets of the rows

    def word_hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * _bp(n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _bi(n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _U(0x9FB21C651E98DF25))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.row_words))


def blocks(texts, separators: np.ndarray = WHITE, lower: bool = False, size: int = BLOCK_BYTES,
           classes: np.ndarray | None = None, lower_unless: bytes | None = None):
    """Blocks of a text column (nulls: empty). A row longer than ``size`` gets a block of its own.

    ``lower``: A-Z become a-z, but for blocks that hold ``lower_unless``.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        part = data[offs[row]:offs[stop]]
        if lower and not (lower_unless and lower_unless in part.tobytes()):
            part = LOWER[part]
        yield Block(part, (offs[row:stop + 1] - offs[row]).astype(np.int64), row, separators, classes)
        row = stop


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of the flat word array (len(h) - k + 1 values)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _kp(n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _ki(n)[:n - k + 1])


def minimisers(h: np.ndarray, row_words: np.ndarray, k: int, span: int):
    """Runs of windows that share their minimiser.

    A window is ``span`` consecutive words of one row; its minimiser is its leftmost
    k-gram of least hash, so equal windows of two rows have it at the same offset.
    Returns (row, first window start, last window start, minimiser position,
    minimiser hash), one entry per run, in order.
    """
    n, w = len(h), span - k + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = windows(h, k)
    value, at, width = grams, np.arange(len(grams)), 1
    while width < w:
        step = min(width, w - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        width += step
    row = np.repeat(np.arange(len(row_words) - 1), np.maximum(np.diff(row_words) - span + 1, 0))
    first_of_row = np.cumsum(np.maximum(np.diff(row_words) - span + 1, 0)) - np.maximum(np.diff(row_words) - span + 1, 0)
    start = np.arange(len(row)) - first_of_row[row] + row_words[:-1][row]
    owner = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(start)) - 1
    return row[cut], start[cut], start[last], owner[cut], grams[owner[cut]]


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def list_array(values: np.ndarray, counts, value_type) -> pa.ListArray:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, value_type))
