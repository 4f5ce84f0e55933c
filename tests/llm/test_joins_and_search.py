"""The set join, the ranked search and the spelling variants against brute force on small inputs with hard rows."""

import collections
import itertools
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapweave.llm import adaptive_prefix, pair_maxscore, spelling_tiles  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, h long, n long, g string, word string, sid int, l int, score double, n_chars long"
WORD, TERM, RUN = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "[A-Za-z\u00C0-\u00FF]+"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, 7, 7, "g", "w", 1, 1, 0.5, 3) for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{SMOKE}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))[:100]
    rng, base = random.Random(5), rows[3][1].split()[:150]
    for i in range(40):                              # a group of near copies around the similarity
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One\x0bTWO"), (1005, "one two"), (1006, "one two"),
             (1007, " ".join(x for _, x in rows[:60])), (1008, rows[5][1]), (1008, rows[5][1]), (1008, rows[6][1]), (1008, rows[7][1]),
             (1009, "x " * 400), (None, rows[5][1]), (None, None), (1010, "Abcdefgh abcdefgh abcdefg abcdefgx abcdefghi étéétéété"),
             (1011, "qwertyuiop " * 50 + "qwertyuio qwertyuio qwertyuiopp qwertyuiopp qwertyuiox"), (1012, "z" * 300 + " " + "z" * 299 + " y" * 9)]
    return rows


def grouped(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_components(spark, table):
    sets = []
    for i, x in table:
        w = re.findall(WORD, lower(x))
        sets.append({tuple(w[j:j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    known = [(i, s) for (i, _), s in zip(table, sets) if i is not None]
    root = grouped({i for i, _ in known}, [(a, b) for (a, s), (b, t) in itertools.combinations(known, 2)
                                           if s and t and 100 * len(s & t) >= 90 * len(s | t)])
    want = sorted(((i, len(s), root.get(i)) for (i, _), s in zip(table, sets)), key=str)
    got = adaptive_prefix.jaccard_components(frame(spark, table)).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert adaptive_prefix.jaccard_components(frame(spark, [])).count() == 0


def test_blocks_and_rare_shingles_do_not_change_the_join(spark, table, monkeypatch):
    """Blocks smaller than the group of near copies; all shingles rare, or all frequent."""
    want = sorted(map(tuple, adaptive_prefix.jaccard_components(frame(spark, table)).collect()), key=str)
    for few, rows in ((10**6, 7), (1, 7), (1, 1024)):
        monkeypatch.setattr(adaptive_prefix, "FEW", few)
        monkeypatch.setattr(adaptive_prefix, "BLOCK_ROWS", rows)
        assert sorted(map(tuple, adaptive_prefix.jaccard_components(frame(spark, table)).collect()), key=str) == want


def test_prefixes_are_lengthened_where_postings_are_long():
    assert adaptive_prefix.chosen_level(100, np.array([2] * 89), 90, 100) == (0, 0)      # 11 of its own, 10 may be missing
    short, _ = adaptive_prefix.chosen_level(400, np.sort(np.r_[np.full(40, 2), np.full(360, 10**7)]), 90, 100)
    long, held = adaptive_prefix.chosen_level(400, np.full(400, 5000), 90, 100)
    assert short == 1 < long and held == 400 - 360 + long


def test_overlaps():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(n)] for n in (23, 31))
    assert (adaptive_prefix.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_ranked_search(spark, table):
    items = [(1, table[3][1][:300]), (2, "one two TWO x"), (3, None), (4, "..."), (None, "one"), (5, "not-there"), (2, "one two TWO x"), (6, table[9][1])]
    terms = [(i, re.findall(TERM, lower(x))) for i, x in table if i is not None]
    n_docs, n_terms = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = collections.Counter(t for _, w in terms for t in set(w))
    want = []
    for item, text in set(items):
        asked, scored = re.findall(TERM, lower(text)), []
        for i, w in terms:
            tf, m = collections.Counter(w), 75 + 25 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in asked if tf[t])
            if score > 0:
                scored.append((-score, i))
        want += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:20], 1)]
    asked = spark.createDataFrame([(i, x, "k") for i, x in items], "item_id long, text string, query string")
    got = pair_maxscore.search(frame(spark, table), asked)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pair_maxscore.search(frame(spark, []), asked).count() == 0
    assert pair_maxscore.search(frame(spark, table), asked.where("false")).count() == 0


def test_query_blocks_and_shards_do_not_change_the_search(spark, table, monkeypatch):
    asked = frame(spark, table).select("doc_id", "text").limit(20).toDF("item_id", "text")
    want = sorted(map(tuple, pair_maxscore.search(frame(spark, table), asked).collect()), key=str)
    monkeypatch.setattr(pair_maxscore, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(pair_maxscore, "SHARD_DOCS", 16)
    assert sorted(map(tuple, pair_maxscore.search(frame(spark, table), asked).collect()), key=str) == want


def test_joint_bounds_skip_more_than_single_ones():
    """Two frequent terms that never stand together: their joint bound lets the search skip what single maxima cannot."""
    rng = np.random.default_rng(3)
    docs = np.arange(4000)
    odd, even, rare = docs[1::2], docs[::2], docs[5::200]
    counts = [len(odd), len(even), len(rare)]
    row = {"doc_ids": docs, "lengths": np.full(4000, 100), "slots": [0, 1, 2], "counts": counts,
           "docs": np.r_[odd, even, rare], "tfs": rng.integers(1, 4, sum(counts))}
    shard = pair_maxscore.Shard(row, np.array([500, 510, 800]), 4000, 400_000)
    query = pair_maxscore.paired([(0, 1), (1, 1), (2, 1)], np.array([500, 510, 800]))
    brute = np.zeros(4000, np.int64)
    for d, x in shard.postings.values():
        brute[d] += x
    floor = int(np.sort(brute)[-20])
    for pairs in (True, False):
        found, score, _ = shard.search(query, floor, pairs)
        assert (found == np.flatnonzero(brute >= floor)).all() and (score == brute[found]).all()
    joint = shard.pair_bound(query[0])
    assert joint < shard.most[0] + shard.most[1]
    assert shard.search(query, joint + 1)[2] == len(rare) < shard.search(query, joint + 1, pairs=False)[2]


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants(table):
    n = collections.Counter()
    for i, x in table:
        for run in re.findall(RUN, x or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b), near[b].append(a)
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_variants(spark, table):
    got = spelling_tiles.spelling_variants(frame(spark, table))
    want = variants(table)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) >= 2 and any(r[4] > 1 for r in want)
    assert spelling_tiles.spelling_variants(frame(spark, [])).count() == 0


def test_forms_are_followed_and_ties_take_the_smallest(spark):
    rows = [(i, "forming " * 3 + "formingx " * 40 + "formingxy " * 500 + "xformingxy " * 500 + "aaaaaaaa aaaaaaaaa " * 30) for i in range(2)]
    rows += [(9, "aaaaaaaaaa " * 2)]
    got = {r.word: tuple(r) for r in spelling_tiles.spelling_variants(frame(spark, rows)).collect()}
    assert [tuple(x) for x in sorted(got.values())] == variants(rows)
    assert got["forming"][1:3] == ("formingx", "formingxy")


def test_tiles_in_small_pieces(spark, table, monkeypatch):
    monkeypatch.setattr(spelling_tiles, "TILE_BYTES", 64)
    monkeypatch.setattr(spelling_tiles, "BAND", 5)
    rows = [(1, " ".join(w * 2 for w in ("abcdefg%s%s " % p for p in itertools.product("abcde", repeat=2))))]
    words = sorted(map(tuple, spelling_tiles.spelling_variants(frame(spark, rows + table[:20])).collect()))
    assert words == variants(rows + table[:20])


def test_checksums_of_long_and_short_runs():
    buf = np.frombuffer(("abc" + "x" * 200 + "né").encode(), np.uint8)
    starts, ends = np.array([0, 3, 203]), np.array([3, 203, len(buf)])
    begin = np.array([zlib.crc32(f"{i}:".encode()) for i in range(3)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + buf[s:e].tobytes()) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    assert spelling_tiles.checksums(buf, starts, ends, begin).tolist() == want
