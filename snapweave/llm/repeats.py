"""Which documents and which places can hold a passage that other documents hold too.

Shared first steps of the two repeated-passage operators. Every window of
``SPAN`` words has a minimiser (see textcore.minimisers); a window can only
stand in another document if its minimiser's k-gram does. So one pass lists
the minimiser hashes of all documents, a partially aggregated count finds the
hashes that several documents hold, and only the windows under those hashes
(live runs) are looked at again. Documents with equal word sequences are
represented by the one with the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.session import cut_lineage

from . import textcore as T
from .tables import written

SPAN, GRAM = 50, 10


def joined_words(block: T.Block, keep: np.ndarray) -> list[bytes]:
    """Per row: its kept words joined by one space."""
    mask = np.zeros(len(block.buf), bool)
    step = np.zeros(len(block.buf) + 1, np.int64)
    np.add.at(step, block.starts[keep], 1)
    np.add.at(step, block.ends[keep], -1)
    mask = np.cumsum(step)[:-1] > 0
    buf = block.buf.copy()
    kept = np.flatnonzero(keep)
    row = np.searchsorted(block.row_words, kept, "right") - 1
    inner = kept[:-1][row[1:] == row[:-1]]       # a kept word follows in the same row
    gap = block.ends[inner]
    # the separator is the byte after the word; adjacent rows have none between them
    buf[gap] = 0x20
    mask[gap] = True
    return [buf[lo:hi][mask[lo:hi]].tobytes() for lo, hi in zip(block.offsets[:-1], block.offsets[1:], strict=True)]


def profile(docs: DataFrame) -> DataFrame:
    """(id, xh, n_words, seq, sha, grams) per row of docs (id, xh, text).

    seq: 16-byte digest of the word sequence; sha: SHA-256 of the words joined by
    one space; grams: minimiser hash of every run of windows.
    """
    def run(batches):
        for batch in batches:
            n, seq, sha, grams, counts = [], [], [], [], []
            for b in T.blocks(batch.column("text")):
                h = b.word_hashes()
                row, _, _, _, g = T.minimisers(h, b.row_words, GRAM, SPAN)
                grams.append(T.signed(g))
                counts.append(np.bincount(row, minlength=b.rows))
                n.append(np.diff(b.row_words))
                for text in joined_words(b, np.ones(len(h), bool)):
                    sha.append(hashlib.sha256(text).hexdigest())
                    seq.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("xh"), pa.array(np.concatenate(n) if n else [], pa.int64()),
                 pa.array(seq, pa.binary()), pa.array(sha, pa.string()),
                 T.list_array(np.concatenate(grams) if grams else np.zeros(0, np.int64),
                              np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())],
                names=["id", "xh", "n_words", "seq", "sha", "grams"])
    return docs.mapInArrow(run, "id long, xh long, n_words long, seq binary, sha string, grams array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, xh, text): xh tells rows apart that share an id."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("xh"), F.col(text_col).alias("text"))


def live_documents(docs: DataFrame, prof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, live). first: (seq, n_words, first id) of each word sequence. live: (id, xh, text, runs) of the
    representatives that hold a minimiser hash of another one; runs: indexes of those runs."""
    ok = prof.where(f"id is not null and n_words >= {SPAN}")
    first = ok.groupBy("seq", "n_words").agg(F.min("id").alias("first"))
    reps = (ok.join(first, ["seq", "n_words"]).where("id = first").select("id", "xh", "grams").dropDuplicates(["id", "xh"]))
    place = reps.select("id", "xh", F.posexplode("grams").alias("run", "g"))
    # a table of its own, so that a very frequent hash is split by the join below
    shared = cut_lineage(place.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g"))
    runs = (place.join(shared, "g", "left_semi").groupBy("id", "xh").agg(F.collect_list("run").alias("runs")))
    return first, written(docs.join(runs, ["id", "xh"]))


def live_runs(batch):
    """Per row block of a live batch: (block, word hashes, row, window from, window to, place of the minimiser, hash) of its live runs."""
    runs = batch.column("runs")
    for b in T.blocks(batch.column("text")):
        h = b.word_hashes()
        row, lo, hi, at, g = T.minimisers(h, b.row_words, GRAM, SPAN)
        first = np.searchsorted(row, np.arange(b.rows))
        pick = [first[r] + np.asarray(runs[b.first_row + r].values.to_numpy(), np.int64) for r in range(b.rows)]
        sel = np.sort(np.concatenate(pick)) if pick else np.zeros(0, np.int64)
        yield b, h, row[sel], lo[sel], hi[sel], at[sel], g[sel]
