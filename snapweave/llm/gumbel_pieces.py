"""SentencePiece segmentations sampled without replacement (Gumbel top-k).

The lattice of a text has one arc per vocabulary piece that fits; a path is a
segmentation, its probability proportional to the product of its pieces'
weights. Scores of a BPE model are negative ranks, read here as a Zipf law: the
weight of a piece is (rank + 2) ** -alpha. Characters outside the vocabulary go
byte by byte.

Top-down perturbed search: the tree of partial paths is searched best first by
Gumbel-perturbed log-probabilities. The root draws its maximum; a node's maximum
is inherited by one child (drawn in proportion to its mass) and bounds the rest
of its children, whose own maximum is a Gumbel truncated there. Following the
inheriting children gives the best leaf; the best remaining "rest" along all
paths found so far is the bound of the next one. So the k best leaves are k
different segmentations drawn without replacement, and the bound left over is
the threshold kappa of their inclusion probabilities 1 - exp(-exp(logp - kappa)).

A text is cut wherever no vocabulary piece holds the two adjacent bytes next to
each other (ends of words, most punctuation), so its lattice is a chain of small
ones. Those are built for all new stretches of a block at once (arcs by hashed
substring lookup, masses by a backward pass) and kept; the walks of all
stretches of a block are drawn step by step in numpy.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textcore as T

SAMPLES, ALPHA, SEED = 4, 1.0, 1
UNITS_HELD = 400_000
BYTE_WEIGHT = -30.0
BLOCK = T.BLOCK_BYTES // 2


def _uniform(key: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit keys."""
    return ((T.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _uniform_of(key: int) -> float:
    """The same for one key, without arrays."""
    key ^= key >> 33
    key = key * 0xFF51AFD7ED558CCD % 2**64
    key ^= key >> 33
    key = key * 0xC4CEB9FE1A85EC53 % 2**64
    key ^= key >> 33
    return ((key >> 11) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces as byte strings (the word mark is a blank), found by the hash of a byte range."""

    def __init__(self, name: str, alpha: float):
        import public_tokenizers
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.bytes: list[bytes] = []
        usable, self.byte_id = [], np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_id[b[0]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                b = b""
            else:
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                usable.append(i)
            self.bytes.append(b)
        rank = np.array([-sp.get_score(i) for i in usable])
        self.size = np.array([len(b) for b in self.bytes])
        self.text = np.frombuffer(b"".join(self.bytes), np.uint8)     # all pieces, one after the other
        self.place = (np.cumsum(self.size) - self.size).astype(np.int32)
        buf = np.frombuffer(b"".join(self.bytes[i] for i in usable), np.uint8)
        ends = np.cumsum([len(self.bytes[i]) for i in usable])
        inner = np.ones(len(buf), bool)
        inner[ends - self.size[usable]] = False
        self.joined = np.zeros((256, 256), bool)      # adjacent bytes of some piece
        self.joined[buf[:-1][inner[1:]], buf[1:][inner[1:]]] = True
        keys = range_hash(buf, ends - self.size[usable], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        self.begun = np.zeros(1 << 20, bool)          # the first 20 bits of some piece's hash
        self.begun[self.keys >> np.uint64(44)] = True
        self.weight = (-alpha * np.log(np.maximum(rank, 0) + 2))[order]
        self.lengths = np.unique(self.size[usable])
        self.longest = int(self.lengths.max())


def range_hash(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(T._BYTE[buf] * T._bp(len(buf)), out=total[1:])
    return T.mix((total[hi] - total[lo]) * T._bi(len(buf) + 1)[lo] + (hi - lo).astype(np.uint64))


class Lattices:
    """Word lattices held so far: nodes are byte positions, arcs of a node by falling probability."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    _FIELDS = {"base": np.int64, "length": np.int64, "first": np.int64, "count": np.int64, "arc_id": np.int32,
               "arc_len": np.uint16, "arc_logp": float, "arc_rest": np.float32, "arc_cum": np.float32}

    def clear(self):
        self.index: dict[int, int] = {}
        self.used = dict.fromkeys(self._FIELDS, 0)
        for name, kind in self._FIELDS.items():
            setattr(self, name, np.zeros(1 << 12, kind))

    def _append(self, name: str, values: np.ndarray) -> None:
        old, n = getattr(self, name), self.used[name]
        if n + len(values) > len(old):
            old = np.resize(old, max(n + len(values), 2 * len(old)))
            setattr(self, name, old)
        old[n:n + len(values)] = values
        self.used[name] = n + len(values)

    def units(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of every word, after adding those not seen yet."""
        if len(self.index) > UNITS_HELD:
            self.clear()
        u, first, inverse = np.unique(range_hash(buf, starts, ends), return_index=True, return_inverse=True)
        keys = u.tolist()
        at = np.fromiter(map(self.index.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.index) + np.arange(len(new))
            self._add(buf, starts[first[new]], ends[first[new]])
            self.index.update(zip(u[new].tolist(), at[new].tolist(), strict=True))
        return at[inverse]

    def _add(self, buf, starts, ends):
        v, size = self.v, ends - starts
        begin = np.cumsum(size) - size
        n = int(size.sum())
        text = buf[np.repeat(starts - begin, size) + np.arange(n)]
        left = np.repeat(begin + size, size) - np.arange(n)              # bytes to the word's end
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(T._BYTE[text] * T._bp(n), out=total[1:])
        inverse = T._bi(n + 1)
        node, length, ids, weight = [], [], [], []
        character = np.cumsum((text & 0xC0) != 0x80)                       # which character a byte belongs to
        known = np.zeros(int(character[-1]) + 2, bool)
        char_len = np.bincount(character, minlength=len(known))
        lead = (text & 0xC0) != 0x80
        fits = np.flatnonzero(lead)
        for k in v.lengths.tolist():                                       # ascending
            fits = fits[left[fits] >= k]
            if not len(fits):
                break
            h = T.mix((total[fits + k] - total[fits]) * inverse[fits] + np.uint64(k))
            some = np.flatnonzero(v.begun[h >> np.uint64(44)])
            i, h = fits[some], h[some]
            p = np.minimum(np.searchsorted(v.keys, h), len(v.keys) - 1)
            ok = v.keys[p] == h
            i, p = i[ok], p[ok]
            node.append(i), length.append(np.full(len(i), k)), ids.append(v.ids[p]), weight.append(v.weight[p])
            known[character[i[char_len[character[i]] == k]]] = True
        i = np.flatnonzero(~known[character])
        node.append(i), length.append(np.ones(len(i), np.int64)), ids.append(v.byte_id[text[i]]), weight.append(np.full(len(i), BYTE_WEIGHT))
        node, length, ids, weight = (np.concatenate(x) for x in (node, length, ids, weight))
        # backward masses, by distance to the word's end
        order = np.lexsort((node, left[node]))
        node, length, ids, weight = node[order], length[order], ids[order], weight[order]
        mass = np.full(n + 1, -np.inf)
        new = np.concatenate([[True], node[1:] != node[:-1]])
        group = np.flatnonzero(new)
        far = left[node[group]]
        for d in np.unique(far).tolist():
            a, z = np.searchsorted(far, d), np.searchsorted(far, d, "right")
            lo, hi = group[a], (group[z] if z < len(group) else len(node))
            to = node[lo:hi] + length[lo:hi]
            x = weight[lo:hi] + np.where(length[lo:hi] == left[node[lo:hi]], 0.0, mass[to])
            mass[node[group[a:z]]] = np.logaddexp.reduceat(x, group[a:z] - lo)
        logp = weight + np.where(length == left[node], 0.0, mass[node + length]) - mass[node]
        ok = np.isfinite(logp)
        order = np.flatnonzero(ok)[np.lexsort((-logp[ok], node[ok]))]
        node, length, ids, logp = node[order], length[order], ids[order], logp[order]
        count = np.bincount(node, minlength=n)
        first = np.cumsum(count) - count
        run = np.cumsum(np.exp(logp))
        cum = run - (run[first[node]] - np.exp(logp[first[node]]))
        last = np.concatenate([node[1:] != node[:-1], [True]])
        cum[last] = 2.0                                                   # whatever is drawn, the last arc takes it
        rest = np.where(count[node] == 1, -np.inf, np.log(np.maximum(-np.expm1(np.minimum(logp, 0.0)), 1e-300)))
        nodes, arcs = self.used["first"], self.used["arc_id"]
        for name, values in (("base", nodes + begin), ("length", size), ("first", arcs + first), ("count", count), ("arc_id", ids),
                             ("arc_len", length), ("arc_logp", logp), ("arc_rest", rest), ("arc_cum", cum)):
            self._append(name, values)

    def walk(self, unit, occurrence, position, key):
        """Draws paths from the given byte positions to the words' ends: (occurrence, arc) of every step, in order."""
        own = unit[occurrence]
        o, node, left = occurrence, self.base[own] + position, self.length[own] - position
        at, arcs, step = [], [], 0
        steps = np.zeros(len(unit) + 1, np.int64)       # of every occurrence
        while len(o):
            a = self.first[node]
            more = np.flatnonzero(self.arc_cum[a] < 1.5)         # a lone arc needs no draw
            draw = np.zeros(len(o))
            draw[more] = _uniform(key[o[more]] + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64))
            more = more[draw[more] >= self.arc_cum[a[more]]]
            while len(more):
                a[more] += 1
                more = more[draw[more] >= self.arc_cum[a[more]]]
            at.append(o), arcs.append(a)
            steps[o + 1] = step + 1
            n = self.arc_len[a].astype(np.int64)
            go = left > n
            o, node, left = o[go], (node + n)[go], (left - n)[go]
            step += 1
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        path = np.empty(int(steps.sum()), np.int64)
        occurrence = np.repeat(np.arange(len(unit)), steps[1:])
        begin = np.cumsum(steps)                        # an occurrence's steps go to consecutive places
        for n, (o, a) in enumerate(zip(at, arcs, strict=True)):
            path[begin[o] + n] = a
        return occurrence, path


def cut_units(b: T.Block, joined: np.ndarray):
    """The block's text with a blank before every row, and its stretches: (buffer, starts, ends, stretch offsets of the rows)."""
    buf = np.insert(b.buf, b.offsets[:-1], 0x20)
    row = b.offsets + np.arange(b.rows + 1)
    new = np.zeros(len(buf) + 1, bool)
    new[1:-1] = ~joined[buf[:-1], buf[1:]]
    new[row] = True
    cut = np.flatnonzero(new)
    return buf, cut[:-1], cut[1:], np.searchsorted(cut, row)


class Sampler:
    """Draws the segmentations of the rows of a block."""

    def __init__(self, model: str, samples: int, alpha: float, seed: int):
        self.v = Vocabulary(model, alpha)
        self.lattices, self.k, self.seed = Lattices(self.v), samples, seed

    def block(self, b: T.Block, keys: np.ndarray):
        """Per row a list of (log probability, perturbed, ids); and kappa per row."""
        buf, starts, ends, rows = cut_units(b, self.v.joined)
        unit = self.lattices.units(buf, starts, ends)
        row_of = np.repeat(np.arange(b.rows), np.diff(rows))
        inside = np.arange(len(unit)) - rows[:-1][row_of]
        own = T.mix(keys + np.uint64(self.seed * 0x632BE59BD9B4E019 % 2**64))
        word_key = T.mix(own[row_of] + inside.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        lat, k = self.lattices, self.k
        leaves = [[] for _ in range(b.rows)]
        heaps = [[] for _ in range(b.rows)]
        kappa = np.full(b.rows, -np.inf)
        # every row's own whole path first: prefix of no arcs, bound by the root's maximum
        start = [(r, None, float(g)) for r, g in enumerate(-np.log(-np.log(_uniform(own ^ np.uint64(0x5851F42D4C957F2D)))))]
        for leaf in range(k):
            salt = np.uint64((leaf + 1) * 0xA0761D6478BD642F % 2**64)
            occ, pos, head = [], [], {}
            for r, node, g in start:
                if node is None:
                    occ.append(np.arange(rows[r], rows[r + 1]))
                    pos.append(np.zeros(len(occ[-1]), np.int64))
                    head[r] = (np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0, g)
                    continue
                o, p = self._branch(r, node, g, leaf, own, unit, heaps, leaves, head)
                tail = np.arange(o, rows[r + 1])
                where = np.zeros(len(tail), np.int64)
                where[0] = p
                if p >= lat.length[unit[o]]:
                    tail, where = tail[1:], where[1:]
                occ.append(tail), pos.append(where)
            if not head:
                break
            o, a = lat.walk(unit, np.concatenate(occ), np.concatenate(pos), word_key ^ salt)
            row = row_of[o]
            cut = np.searchsorted(row, np.arange(b.rows + 1))
            logp = lat.arc_logp[a]
            run = np.cumsum(logp)
            before = run - logp
            open_ = np.flatnonzero(lat.arc_rest[a] > -np.inf)           # only these leave other arcs to take
            at, of = a[open_], row[open_]
            opened = np.searchsorted(open_, cut)
            noise = -np.log(_uniform(word_key[o[open_]] ^ T.mix(salt + (open_ - cut[of]).astype(np.uint64))))
            done, roof = np.zeros(b.rows), np.zeros(b.rows)
            for r, (_, _, x, g) in head.items():
                done[r], roof[r] = x, g
            some = cut[:-1] < cut[1:]
            done[some] -= before[cut[:-1][some]]
            reach = before[open_] + done[of]
            mass = reach + lat.arc_rest[at]
            bound = mass - np.log(np.exp(np.minimum(mass - roof[of], 700.0)) + noise)
            sums = np.add.reduceat(np.append(logp, 0.0), cut[:-1])
            want = k - leaf
            for r, (arcs, where, given, g) in head.items():
                lo, hi = cut[r], cut[r + 1]
                path, place = np.concatenate([arcs, a[lo:hi]]), np.concatenate([where, o[lo:hi]])
                leaves[r].append((given + float(sums[r]) if hi > lo else given, g, path, place))
                mine, first, last = len(leaves[r]) - 1, opened[r], opened[r + 1]
                take = np.arange(first, last) if last - first <= want else first + np.argpartition(-bound[first:last], want - 1)[:want]
                heaps[r].extend((x, mine, len(arcs) + t - int(lo), (arc,), y) for x, t, arc, y in
                                zip(bound[take].tolist(), open_[take].tolist(), at[take].tolist(), reach[take].tolist(), strict=True) if x > -np.inf)
                heaps[r].sort(key=lambda x: (-x[0], x[1], x[2]))
            start = []
            for r in head:
                if heaps[r]:
                    if leaf + 1 < k:
                        start.append((r, heaps[r].pop(0), None))
                    else:
                        kappa[r] = heaps[r][0][0]
        return leaves, kappa

    def _branch(self, r, node, g, leaf, own, unit, heaps, leaves, head):
        """Opens a rest: draws one of its arcs, keeps what is left of the rest; returns the word and byte where the walk goes on."""
        lat = self.lattices
        bound, mine, t, taken, prefix = node
        _, _, path, place = leaves[r][mine]
        o = int(place[t])
        lo = t
        while lo > 0 and place[lo - 1] == o:
            lo -= 1
        here = int(lat.arc_len[path[lo:t]].sum())
        at = int(lat.base[unit[o]]) + here
        first, count = int(lat.first[at]), int(lat.count[at])
        arcs = [x for x in range(first, first + count) if x not in taken]
        p = np.exp(lat.arc_logp[arcs])
        u = _uniform_of(int(own[r]) ^ ((leaf * 0x2545F4914F6CDD1D + t) % 2**64))
        pick = min(int(np.searchsorted(np.cumsum(p), u * p.sum(), "right")), len(arcs) - 1)
        arc = arcs[pick]
        head[r] = (np.append(path[:t], arc), np.append(place[:t], o), prefix + float(lat.arc_logp[arc]), bound)
        rest = float(p.sum() - p[pick]) if len(arcs) > 1 else 0.0
        if rest > 0:
            mass = prefix + float(np.log(rest))
            e = -np.log(_uniform_of(int(own[r]) ^ ((leaf * 0x9E6C63D0876A9A47 + t + 1) % 2**64)))
            heaps[r].append((mass - float(np.log(np.exp(min(mass - bound, 700.0)) + e)), mine, t, (*taken, arc), prefix))
        return o, here + int(lat.arc_len[arc])

    def ids(self, path: np.ndarray) -> np.ndarray:
        return self.lattices.arc_id[path]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the ids (byte pieces as they are, without the blank before the first word)."""
        size = self.v.size[ids]
        stop = np.cumsum(size)
        n = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if n < 2**31 - len(self.v.text) else np.int64
        return self.v.text[np.repeat(self.v.place[ids] - (stop - size).astype(kind), size) + np.arange(n, dtype=kind)][1:]


@functools.lru_cache(maxsize=1)
def _sampler(model: str, samples: int, alpha: float, seed: int) -> Sampler:
    """One per worker process: the vocabulary and the lattices of words seen by its earlier tasks are kept."""
    return Sampler(model, samples, alpha, seed)


def _sample(model, samples, alpha, seed, with_ids):
    def run(batches):
        sampler = _sampler(model, samples, alpha, seed)
        names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decodes"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            doc = batch.column(0)
            keys = np.asarray(pa.compute.fill_null(doc, -1).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            for b in T.blocks(batch.column(1), size=BLOCK):
                leaves, kappa = sampler.block(b, keys[b.first_row:b.first_row + b.rows])
                out = [[] for _ in names]
                for r, (own, bar) in enumerate(zip(leaves, kappa.tolist(), strict=True)):
                    text = b.buf[b.offsets[r]:b.offsets[r + 1]]
                    for j, (logp, g, path, _) in enumerate(own):
                        ids = sampler.ids(path)
                        if b.offsets[r] == b.offsets[r + 1]:
                            ids = ids[:0]                    # an empty text has no pieces
                        gap = np.inf if bar == -np.inf else logp - bar
                        include = 0.0 if gap > 700 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))
                        row = (doc[b.first_row + r].as_py(), j + 1, len(ids), round(logp, 6) if len(ids) else 0.0, round(g, 6), include,
                               zlib.crc32(ids.astype("<u4").tobytes()), np.array_equal(sampler.decode(ids), text), ids)
                        for o, x in zip(out, row, strict=False):
                            o.append(x)
                        if not len(ids):
                            break
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=names)
    return run


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model",
                         samples: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Up to ``samples`` different segmentations of every row, drawn without replacement.

    One row per segmentation: doc_id, sample (from 1, by falling perturbed
    log-probability), n_pieces, log_prob, perturbed, log_inclusion (logarithm of
    the probability of being among the ``samples`` given the threshold; 0 if there are no others),
    ids_crc32 (little-endian 32-bit ids), decodes (the ids give the text back),
    with ``with_ids`` also ids. The draw depends on the id, the seed and the text
    alone. A text with fewer segmentations gives all of them; null and empty
    texts give one without pieces. Rows with null ids share one key; repeated
    rows give equal results. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ("doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decodes boolean"
              + (", ids array<int>" if with_ids else ""))
    return d.mapInArrow(_sample(model, samples, alpha, seed, with_ids), schema)
