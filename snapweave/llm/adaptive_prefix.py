"""N-gram Jaccard join by adaptive multi-match prefixes.

Under one order of all shingles, two sets of similarity s share at least l shingles
of their l-prefixes: the first n - ceil(s n) + l ones of a set of n. A longer prefix
asks for more shared shingles. So every set takes the l of least estimated cost, and
a pair is a candidate only if the two prefixes share min(l, l') shingles.

1. Equal sets are one set. Under the order of hash values, the ``levels(n)``-prefixes
   of all sets are counted; a set stays only if enough of its prefix stands in the
   prefix of another set (no partner is lost: levels grow with n).
2. Of the sets that stay, all shingles are counted. The rarest come first from here.
   Each set picks l: the postings of its l-prefix are counted in full, and at most a
   l-th of them, the pairs that can match l times, will be verified.
3. Shingles of at most ``FEW`` sets give their pairs (at most ``FEW`` a row), counted
   per pair and dropped where the more frequent shingles cannot make up for what is
   missing. More frequent shingles only tie their sets to the first of them.
4. Sets tied together by either are a cluster, cut by hash into blocks of about
   ``BLOCK_ROWS`` sets and ``BLOCK_SHINGLES`` shingles. Every two blocks meet under a
   key of their own: shared prefix shingles are counted for all their pairs at once,
   pairs that reach min(l, l') are verified on the full sets, and the block gives one
   row per linked set, which names the smallest id it found.
5. Those rows are closed to components.

A large cluster without links is compared block by block, which no cut bounds;
what it writes stays proportional to its sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapweave.session import cut_lineage

from . import textcore as T
from .components import components, shuffle_partitions, smallest_reachable
from .tables import written

LEVEL_SHARE = 20                # prefixes are lengthened by a twentieth of the set at most
FEW = 8
VERIFY = 8                      # shingles verified at the cost of one counted posting
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
SPARSE, CHUNK = 64, 4096


def least(n, num: int, den: int):
    """Fewest shingles that a set of n shares with a similar one (numbers, arrays)."""
    return -(-num * n // den)


def levels(n):
    """Most that the prefix of a set of n is lengthened by (numbers, arrays)."""
    return np.maximum(1, -(-n // LEVEL_SHARE))


def _least_col(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / den)


def _levels_col(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / LEVEL_SHARE))


def shingle_sets(texts, k: int):
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle, one without words none."""
    for b in T.blocks(texts, T.WHITE, lower=True):
        h = b.word_hashes()
        grams = T.windows(h, k)
        for lo, hi in zip(b.row_words[:-1], b.row_words[1:], strict=True):
            if hi - lo >= k:
                yield np.unique(grams[lo:hi - k + 1])
            elif hi > lo:
                yield np.frombuffer(hashlib.blake2b(h[lo:hi].tobytes(), digest_size=8).digest(), np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return T.list_array(T.signed(flat), np.array([len(a) for a in arrays], np.int64), pa.int64())


def _profiles(k: int, num: int, den: int):
    """(id, text) -> (id, n, h, prefix): the set's size and hash, its levels(n)-prefix in the order of hash values."""
    def run(batches):
        for batch in batches:
            n, h, prefix = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s)), h.append(_set_hash(s) if len(s) else None)
                prefix.append(s[:len(s) - least(len(s), num, den) + levels(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), _lists(prefix)],
                                             names=["id", "n", "h", "prefix"])
    return run


def _full_sets(k: int):
    """(id, h, n, text) -> (id, n, shingles) where the text's set has the hash h."""
    def run(batches):
        for batch in batches:
            want = batch.column("h").to_pylist()
            sets = list(shingle_sets(batch.column("text"), k))
            keep = [i for i, s in enumerate(sets) if len(s) and _set_hash(s) == want[i]]
            part = batch.select(["id", "n"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, _lists([sets[i] for i in keep])], names=["id", "n", "shingles"])
    return run


def chosen_level(n: int, df: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(l, how many of the shared shingles are in the l-prefix) for a set of n whose shared shingles have the ascending
    frequencies df (its other shingles are its own and come first); (0, 0) if it can have no partner."""
    free = n - int(least(n, num, den)) - (n - len(df))     # shared shingles in the prefix, without the lengthening
    if free < 0:
        return 0, 0
    level = np.arange(1, int(levels(n)) + 1)
    upto = np.minimum(free + level, len(df))
    postings = np.cumsum(df, dtype=np.float64)[upto - 1]
    at = int(np.argmin(postings * (1 + n / VERIFY / level)))
    return int(level[at]), int(upto[at])


def _matched(place: DataFrame) -> DataFrame:
    """The rows (h, g) whose shingle g stands under several h."""
    # a table of its own, so that a very frequent shingle is split by the join below
    shared = cut_lineage(place.groupBy("g").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("g"))
    return written(place.join(shared, "g", "left_semi").select("h", "g"))


def _live(sets: DataFrame, matched: DataFrame, num: int, den: int) -> DataFrame:
    """The sets (id, h, n, copies) with enough matched rows (h, g)."""
    enough = F.col("copies") * _levels_col(_least_col(F.col("n"), num, den))
    return sets.join(matched.groupBy("h").count(), "h").where(F.col("count") >= enough).select("id", "h", "n", "copies")


def _prefixes(num: int, den: int):
    """(sid, n, shared: [(df, g)]) -> (sid, n, l, g, df): the chosen prefixes, rarest first."""
    def run(batches):
        for batch in batches:
            sid, n, level, keys, dfs = [], [], [], [], []
            for s, m, shared in zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), strict=True):
                pairs = shared.values
                df, g = pairs.field("df").to_numpy(), pairs.field("g").to_numpy()
                order = np.lexsort((g, df))
                lv, upto = chosen_level(m, df[order], num, den)
                if lv:
                    sid.append(s), n.append(m), level.append(lv)
                    keys.append(g[order[:upto]]), dfs.append(df[order[:upto]])
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(level, pa.int64()),
                                              *(T.list_array(np.concatenate(x) if x else np.zeros(0, np.int64),
                                                             np.array([len(y) for y in x], np.int64), pa.int64()) for x in (keys, dfs))],
                                             names=["sid", "n", "l", "g", "df"])
    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets a shares with each of the sets b."""
    value, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ends = np.cumsum([len(x) for x in (*a, *b)])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    cut = ends[len(a) - 1]
    sides = [(at[:cut], row[:cut]), (at[cut:], row[cut:] - len(a))]
    m, n = (np.bincount(v, minlength=len(value)) for v, _ in sides)
    # rare values: their pairs one by one
    rare = (m * n <= SPARSE) & (m * n > 0)
    (va, ra), (vb, rb) = ((v[rare[v]], r[rare[v]]) for v, r in sides)
    order = np.argsort(vb, kind="stable")
    first = np.cumsum(n * rare) - n * rare
    width = n[va]
    i = np.repeat(ra, width)
    j = rb[order[np.repeat(first[va], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]]
    out = np.bincount(i * len(b) + j, minlength=len(a) * len(b)).reshape(len(a), len(b))
    # the others: 0/1 matrices, some values at a time
    column = np.cumsum(m * n > SPARSE) - 1
    wide = [(column[v[m[v] * n[v] > SPARSE]], r[m[v] * n[v] > SPARSE]) for v, r in sides]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        x, y = (_incidence(v, r, size, lo) for (v, r), size in zip(wide, (len(a), len(b)), strict=True))
        out += (x @ y.T).astype(np.int64)
    return out


def _incidence(column, row, rows, lo):
    out = np.zeros((rows, CHUNK), np.float32)
    here = (column >= lo) & (column < lo + CHUNK)
    out[row[here], column[here] - lo] = 1
    return out


def linked(ids, n, level, prefix, sets, side, num: int, den: int):
    """Rows of one block (side 0: all meet) or two (sides 1 and 2) -> (id, smallest id that the block ties it to)."""
    a = np.flatnonzero(side <= 1)
    b = np.flatnonzero(side != 1)
    if not len(a) or not len(b):
        return ids[:0], ids[:0]
    shared = overlaps([prefix[i] for i in a], [prefix[j] for j in b])
    x, y = n[a][:, None], n[b][None, :]
    able = (shared >= np.minimum(level[a][:, None], level[b][None, :])) & (x * den >= num * y) & (y * den >= num * x)
    i, j = np.nonzero(able)
    keep = (side[a[i]] == 1) | (a[i] < b[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return ids[:0], ids[:0]
    (ua, i), (ub, j) = np.unique(a[i], return_inverse=True), np.unique(b[j], return_inverse=True)
    both = overlaps([sets[r] for r in ua], [sets[r] for r in ub])[i, j]
    i, j = ua[i], ub[j]
    ok = both * den >= num * (n[i] + n[j] - both)
    order = np.argsort(ids, kind="stable")           # labels in the order of ids
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    to = smallest_reachable(len(ids), place[i[ok]], place[j[ok]])
    moved = np.flatnonzero(to != np.arange(len(ids)))
    return ids[order[moved]], ids[order[to[moved]]]


def _met(num: int, den: int):
    """Rows sorted by (cluster, x, y) -> links (a, b) of every two blocks."""
    def run(batches):
        key, rows = None, []

        def done():
            ids, n, level, side = (np.array([r[c] for r in rows], np.int64) for c in range(4))
            return linked(ids, n, level, [r[4] for r in rows], [r[5] for r in rows], side, num, den)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y")), strict=True))
            plain = list(zip(*(batch.column(c).to_pylist() for c in ("id", "n", "l", "side")), strict=True))
            prefix, sets = batch.column("g"), batch.column("shingles")
            found = []
            for r, k in enumerate(keys):
                if k != key:
                    if len(rows) > 1:
                        found.append(done())
                    key, rows = k, []
                rows.append((*plain[r], prefix[r].values.to_numpy(), sets[r].values.to_numpy()))
            yield _links(found)
        if len(rows) > 1:
            yield _links([done()])
    return run


def _links(found):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]) if found else [], pa.int64()) for c in (0, 1)],
                                      names=["a", "b"])


def _clusters(prefixes: DataFrame) -> DataFrame:
    """(node, component) of the sets sid that have candidates together, from (sid, n, l, g, df)."""
    frequent = F.size(F.filter("df", lambda x: x > FEW))
    row = prefixes.select("sid", "l", frequent.alias("often"), F.explode(F.arrays_zip("g", "df")).alias("x"))
    row = row.select("sid", "l", "often", F.col("x.g").alias("g"), (F.col("x.df") <= FEW).alias("rare"))
    rare = row.where("rare").drop("rare")
    # what two sets share: at least one rare shingle, the rest can be frequent
    pair = (rare.alias("p").join(rare.alias("q"), "g").where("p.sid < q.sid")
            .groupBy(F.col("p.sid").alias("a"), F.col("q.sid").alias("b"), F.least("p.l", "q.l").alias("l"),
                     F.least("p.often", "q.often").alias("often")).count()
            .where("count >= l - often").select("a", "b"))
    often = row.where("not rare").select("sid", "g")
    head = often.groupBy("g").agg(F.min("sid").alias("b"), F.max("sid").alias("last")).where("b < last").select("g", "b")
    return components(pair.union(often.join(cut_lineage(head), "g").where("sid <> b").select("sid", "b").distinct()))


def similar_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of (id, n, shingles, sid) of similarity num / den or more."""
    parts = shuffle_partitions(sets.sparkSession)
    place = sets.select("sid", "n", F.explode("shingles").alias("g"))
    df = cut_lineage(place.groupBy("g").agg(F.count("*").alias("df")).where("df >= 2"))
    shared = place.join(df, "g").groupBy("sid", "n").agg(F.collect_list(F.struct("df", "g")).alias("shared"))
    prefixes = written(shared.mapInArrow(_prefixes(num, den), "sid long, n long, l long, g array<long>, df array<long>"))
    member = prefixes.join(_clusters(prefixes).toDF("sid", "cluster"), "sid").select("sid", "n", "l", "g", "cluster")
    blocks = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = (member.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("sid"), "blocks"))
             .join(sets.select("sid", "id", "shingles"), "sid")
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(x == y, 0).when(F.col("own") == x, 1).otherwise(2)
    return (dealt.select("cluster", x.alias("x"), y.alias("y"), side.alias("side"), "id", "n", "l", "g", "shingles")
            .repartition(parts, "cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
            .mapInArrow(_met(num, den), "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its
    distinct ``words``-word shingles, or its whole word sequence if shorter. Documents
    whose sets have a Jaccard similarity of at least ``similarity`` (a fraction above
    0) are linked; ``component_id`` is the smallest id reachable by links.

    Null and empty texts have no shingles and stand alone. Rows of one id are one
    document with the links of any of them. Rows with a null id link with nothing and
    have a null ``component_id``. Other columns are not read. An empty table gives no rows.
    """
    num, den = similarity
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = written(d.mapInArrow(_profiles(words, num, den), "id long, n long, h long, prefix array<long>"))
    full = every.where("id is not null and h is not null")
    # a set's copies hold its prefix too, so its matches are counted once for each copy
    first = cut_lineage(full.groupBy("h", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    matched = _matched(full.select("h", F.explode("prefix").alias("g")))
    live = written(_live(first, matched, num, den))
    # once more among the sets that stay
    live = _live(live, _matched(matched.join(live.select("h").distinct(), "h", "left_semi")), num, den).select("id", "h", "n")
    texts = d.join(live, "id").withColumn("xh", F.xxhash64("text")).dropDuplicates(["id", "h", "xh"])
    sets = written(texts.select("id", "h", "n", "text").mapInArrow(_full_sets(words), "id long, n long, shingles array<long>")
                   .withColumn("sid", F.monotonically_increasing_id()))
    # a copy follows the first document of its set; an id with several sets ties them together
    owns = full.select("id", "h", "n").distinct().join(first.withColumnRenamed("id", "first"), ["h", "n"]).select("id", "first")
    of = owns.groupBy("id").agg(F.min("first").alias("b"), F.max("first").alias("last"))
    tied = owns.join(of.where("b < last"), "id").where("first <> b").select(F.col("first").alias("a"), "b")
    links = written(similar_sets(sets, num, den).union(tied))
    comp = components(links).toDF("b", "component")
    comp = of.join(comp, "b", "left").select("id", F.coalesce("component", "b").alias("c"))
    return (every.select("id", "n").join(comp, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id")))
