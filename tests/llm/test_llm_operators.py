"""The training-data operators against brute force on small inputs with hard rows."""

import bisect
import collections
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapweave.llm import bm25, collision_hashing, gumbel_pieces, licences, minhash_forest, ordinal, packing  # noqa: E402
from snapweave.llm import sparse_suffixes, suffix_trees, text_density  # noqa: E402
from snapweave.llm import textcore as T  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
WORDS = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, id long, h long, g string, run string, block int, kind string, n_chars long"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def table():
    """200 documents, copies, near copies, hard rows; extra columns whose names the operators use themselves."""
    t = pq.read_table(f"{SMOKE}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))[:120]
    long_text = " ".join(x for _, x in rows[:30])
    words = rows[3][1].split()
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "One\x0bTWO"), (1005, "one two"), (1006, long_text),
             (1007, " ".join(words[:-1] + ["changed"])), (1008, rows[5][1]), (1008, rows[5][1]), (1009, "x " * 400), (1010, "x " * 300),
             (None, rows[5][1]), (None, None), (1011, " né x 日本 🙂 'll <|endoftext|>"), (1012, "MIT license mit license. CC-BY 4.0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([(i, x, 7, 7, "g", "r", 1, "k", 3) for i, x in table], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, table):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append(r)
    assert {k: len(v) for k, v in got.items()} == dict(collections.Counter(i for i, _ in table))
    return got


def test_near_duplicates(docs, none, table):
    for k in (2, 5):
        sets = {}
        for i, x in table:
            w = re.findall(WORDS, lower(x))
            if i is not None:
                sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        root = {i: i for i in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(sets)
        for n, a in enumerate(ids):
            for b in ids[n + 1:]:
                s, t = sets[a], sets[b]
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        got = by_id(minhash_forest.near_duplicates(docs, words=k), table)
        for i in sets:
            for r in got[i]:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), find(i), i == find(i)), (k, i)
        assert all(r.component_id is None and r.kept for r in got[None])
    assert minhash_forest.near_duplicates(none).count() == 0


def test_crowded_regions_are_deepened_and_joined():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) > 0.03], rng.integers(1, 2**63, 8, dtype=np.uint64)])) for _ in range(700)]
    sig = np.array([minhash_forest.signature(s) for s in sets])
    labels = np.concatenate([np.zeros((700, 1), ">u2"), (sig[:, :10] >> 16).astype(">u2")], axis=1)
    order = np.lexsort(labels.T[::-1])
    sketch = np.array([np.frombuffer(minhash_forest.sketch(x), np.uint64) for x in sig])
    pairs, left_out = minhash_forest._pairs(np.arange(700)[order], np.arange(700)[order], np.array([len(s) for s in sets])[order],
                                  labels[order], sketch[order], 80, 100)
    assert 700 < len(pairs) < 700 * 12 and left_out.any()


def _forest_rows(spark, sketches):
    """Rows 0 .. n-1: in the first tree one region for even and one for odd ids, in the others regions of one row."""
    rng, n = np.random.default_rng(2), len(sketches)
    labels = rng.integers(0, 1 << 16, (n, minhash_forest.TREES, minhash_forest.DEPTH)).astype(">u2")
    labels[:, 1:, 0] = np.arange(n)[:, None]
    labels[:, 0, :minhash_forest.BASE] = (np.arange(n) % 2)[:, None]
    rows = [(i, i + 5000, 100, bytearray(labels[i].tobytes()), bytearray(sketches[i].tobytes())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, h long, n long, labels binary, sketch binary")


def test_what_a_border_separates_is_left_to_the_second_scan(spark):
    rng, parts = np.random.default_rng(1), spark.conf.get("spark.sql.shuffle.partitions")
    couples = {(i, i + 2) for i in range(240) if i % 4 < 2}
    sketches = rng.integers(0, 2**63, (240, 2 * minhash_forest.SKETCH_WORDS), dtype=np.uint64)
    for a, b in couples:
        sketches[b] = sketches[a]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "96")      # some 60 rows each, regions of 120
        pairs, crowded = minhash_forest._candidates(_forest_rows(spark, sketches), 80, 100)
        found, left = {(r.a, r.b) for r in pairs.collect()}, {r.id for r in crowded.collect()}
        assert found < couples
        assert {x for c in couples - found for x in c} <= left
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def _near_copies(n, words, most, seed):
    """A text and copies with up to ``most`` words changed: similarities on both sides of 0.8."""
    import random
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randrange(most)):
            w[at] = f"x{rng.randrange(10**9)}"
        out.append((i, " ".join(w)))
    return out


def _components_of(rows, k):
    sets = {i: {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, x.split()) for i, x in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(sorted(sets)):
        for b in sorted(sets)[n + 1:]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_second_scan_loses_no_link_of_a_group(spark, monkeypatch):
    """Blocks far smaller than the group, a first scan that keeps next to nothing: the components are still those of all pairs."""
    rows = _near_copies(160, 60, 14, 3)
    want = _components_of(rows, 2)
    assert 3 < len(set(want.values())) < 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({}, {"REGION": 8, "NEAREST": 1, "NEIGHBOURS": 1, "BEST": 1, "BLOCK_ROWS": 20}):
        for name, value in limits.items():
            monkeypatch.setattr(minhash_forest, name, value)
        assert {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, words=2).collect()} == want


def test_crossing_pairs_of_blocks():
    """One block among itself and two blocks with each other: one row per linked set, pairs inside a component not looked at."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.06], rng.integers(1, 2**63, 5, dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64)) for _ in range(5)]
    sketches = np.stack([np.frombuffer(minhash_forest.sketch(minhash_forest.signature(s)), np.uint64) for s in sets])
    ids, n = rng.permutation(1000)[:65].astype(np.int64), np.array([len(s) for s in sets])
    hs = np.arange(65)
    for comp in (np.arange(65), np.zeros(65, np.int64), np.arange(65) // 2):
        for side in (np.zeros(65, np.int64), 1 + np.arange(65) % 2):
            root = np.arange(65)
            for i in range(65):
                for j in range(65):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if i != j and comp[i] != comp[j] and (side[i] != side[j] or not side[i]) and 100 * both >= 80 * (n[i] + n[j] - both):
                        root[root == root[j]] = root[i]
            want = {(ids[i], ids[root == root[i]].min()) for i in range(65) if ids[i] != ids[root == root[i]].min()}
            got = list(zip(*minhash_forest.crossing(ids, hs, n, comp, sketches, sets, side, 80, 100), strict=True))
            assert len(got) == len(want) and set(got) == want


def test_labels_of_very_long_documents_differ():
    rng = np.random.default_rng(4)
    labels = [np.frombuffer(minhash_forest.label(minhash_forest.signature(rng.integers(1, 2**63, 200_000, dtype=np.uint64))), ">u2") for _ in range(3)]
    for x, y in ((0, 1), (0, 2), (1, 2)):
        assert (labels[x] == labels[y]).mean() < 0.05


def _windows(table):
    words = [(i, re.findall(WORDS, x or "")) for i, x in table]
    first, last = {}, {}
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - 49):
            k = tuple(w[p:p + 50])
            first.setdefault(k, i)
            last[k] = i
    out = {}
    for i, w in words:
        gone, shared = [0] * len(w), [0] * len(w)
        for p in range(len(w) - 49) if i is not None else ():
            k = tuple(w[p:p + 50])
            if first[k] < i:
                gone[p:p + 50] = [1] * 50
            if first[k] < last[k]:
                shared[p:p + 50] = [1] * 50
        out[i, " ".join(w)] = (len(w), sum(gone), sum(shared), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("crowded", [False, True])
def test_repeated_passages(docs, none, table, monkeypatch, crowded):
    if crowded:  # every group is too large: prefixes are lengthened to whole windows
        monkeypatch.setattr(suffix_trees, "GROUP_WORDS", 60)
        monkeypatch.setattr(sparse_suffixes, "GROUP_ROWS", 0)
    want = collections.defaultdict(set)
    for (i, _), (n, gone, shared, kept) in _windows(table).items():
        want[i].add((n, gone, hashlib.sha256(kept.encode()).hexdigest(), shared))
    got, spans = by_id(suffix_trees.substring_dedup(docs), table), by_id(sparse_suffixes.repeated_passages(docs), table)
    for i, w in want.items():
        assert {(r.n_words, r.n_removed, r.kept_sha256) for r in got[i]} == {x[:3] for x in w}, i
        assert {(r.n_words, r.n_removed, r.n_shared) for r in spans[i]} == {(x[0], x[1], x[3]) for x in w}, i
        assert all(sum(b - a for a, b in r.removed_spans) == r.n_removed for r in spans[i])
    if not crowded:
        assert suffix_trees.substring_dedup(none).count() == 0 and sparse_suffixes.repeated_passages(none).count() == 0
        kept = collections.defaultdict(set)
        for (i, text), x in _windows(table).items():
            kept[i].add(x[3] if x[1] else None)
        for r in suffix_trees.without_repeats(docs).collect():
            assert r.text in kept[r.doc_id] or None in kept[r.doc_id]
            assert r.h == 7 and r.kind == "k"


def test_minimisers_of_equal_windows_agree():
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 2**63, 400, dtype=np.uint64)
    both = np.concatenate([flat[50:350], rng.integers(0, 2**63, 30, dtype=np.uint64), flat[100:300]])
    row, lo, hi, at, _ = T.minimisers(both, np.array([0, 330, 530]), 10, 50)
    offset = {(r, s): a - s for r, x, y, a in zip(row, lo, hi, at) for s in range(x, y + 1)}
    assert all(offset[0, 50 + s] == offset[1, 330 + s] for s in range(150))


def test_packing(docs, none, table, spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, x in table:
        ids = tk.encode(x or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            p = np.array(ids[s:s + 4096], "<u4")
            want[i, k, s, len(p), zlib.crc32(p.tobytes())] += 1
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32 for r in rows)
    place = collections.defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for x in place.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert len(place) <= 1 + -(-sum(r.length for r in rows) // 4096)
    assert packing.pack_documents(none).count() == 0


def test_pack_few_sizes_and_bounds():
    for lengths in ([4096] * 3, [2049] * 5, [1] * 5000, [1300, 1365, 1300] * 40, [3000, 1000, 96] * 50):
        b, o = packing.pack(np.array(lengths))
        assert np.bincount(b, lengths).max() <= 4096
        assert b.max() + 1 <= max(sum(x > 2048 for x in lengths), -(-sum(lengths) // 4096)) + 1


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    graded = ordinal.grades_of(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = ordinal.fit(d, graded.where("id % 3 <> 0"), ordinal.GRADES)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal.score(d, model, ordinal.CLEAN).collect()}
    held = [(r.grade, got[r.id]) for r in graded.where("id % 3 = 0").collect()]
    kept = lambda g: np.mean([r.kept for x, r in held if x == g])
    assert kept(2) > 0.93 and kept(0) < 0.35
    assert all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in got.values())


def test_quality_hard_rows(docs, none, spark, table):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, ordinal.grades_of(empty), ordinal.GRADES)
    assert ordinal.select(docs, model, ordinal.CLEAN).count() == len(table)      # nothing learned: all stay
    assert ordinal.score(docs, model, ordinal.CLEAN).where("kept").count() == len(table)
    assert ordinal.score(none, model, ordinal.CLEAN).count() == 0
    odd = spark.createDataFrame([(0, None, 1), (1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert ordinal.fit(docs, ordinal.grades_of(odd), ordinal.GRADES).thresholds.shape == (2,)


def test_packing_uses_no_more_sequences_than_best_fit_decreasing():
    g = np.random.default_rng(1)
    sets = [g.integers(1, 4097, 8000), g.integers(1800, 2300, 8000), np.clip(g.lognormal(5, 1.2, 8000), 1, 4096).astype(int), g.integers(1366, 1700, 4000),
            g.integers(900, 1500, 8000), g.integers(1400, 4097, 8000), np.full(100, 4096), np.full(100, 2048), np.array([5]), np.array([], int)]
    for lengths in sets:
        rooms = []                                   # sorted rooms of the sequences of best-fit decreasing
        for x in sorted(lengths.tolist(), reverse=True):
            at = bisect.bisect_left(rooms, x)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 4096) - x)
        bins, offsets = packing.pack(lengths)
        assert len(set(bins.tolist())) <= len(rooms)
        used = collections.Counter()
        for i in np.lexsort((offsets, bins)).tolist():
            assert offsets[i] == used[bins[i]]
            used[bins[i]] += int(lengths[i])
        assert max(used.values(), default=0) <= 4096


def test_main_text(spark):
    page = ("<html><body class='no-sidebar'><header><h2>Site</h2></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div>"
            "<div id=main><article><header><h1>Title &amp; more</h1></header><p>First <b>para</b>graph,\n with <a href=x>a link</a>.<p>Second&nbsp;one<br>goes on"
            "<div class='share'>Share this</div><ul><li>item 1<li>item 2</ul><form><input><label>Mail</label></form>"
            "<script>var a='</p>';</script><section class=comments><p>A reader wrote a comment that is long enough to count for something</p></section>"
            "</article><aside>Related</aside></div><footer>&copy; us</footer>")
    want = "Title & more\nFirst paragraph, with a link.\nSecond one goes on\nitem 1\nitem 2"
    assert text_density.main_text(page) == want
    plain = "<body><div class=menu><a href=a>x</a></div><div><p>" + "words of the text " * 9 + "</p><p>" + "more of it " * 9 + "</p></div><div class=ad>buy</div></body>"
    assert text_density.main_text(plain).split("\n") == [("words of the text " * 9).strip(), ("more of it " * 9).strip()]
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p>", "x"), (3, "u", "a < b <b", "x"),
            (4, "u", "<div>" * 3000 + "deep", "x"), (5, "u", "<!-- open", "x")]
    got = text_density.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, want), (2, ""), (None, ""), (3, ""), (3, "a < b <b"), (4, "deep"), (5, "")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_main_text_without_article():
    para = [f"{c} " + "text of the page " * 11 + "here." for c in "abcdefghijk"]
    tags = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    noise = "<div class=menu><a href=a>x</a></div>"
    links = "<ul>" + "".join(f"<li><a href=/{i}>another page {i}</a></li>" for i in range(8)) + "</ul>"
    two = f"<body>{noise}<div><section>{tags(para[:5])}</section><section>{tags(para[5:10])}</section></div>{links}</body>"
    assert text_density.main_text(two).split("\n") == para[:10]
    title = f"<body>{noise}<div class=top><h1>The title</h1></div><div>{tags(para[:5])}</div>{links}</body>"
    assert text_density.main_text(title).split("\n") == ["The title", *para[:5]]
    beside = f"<body>{links}<h1>Title</h1><div>{tags(para[:4])}</div><h2>Next</h2><p>Short.</p><div>{tags(para[4:8])}</div>{para[8]} <b>bold</b>{links}</body>"
    assert text_density.main_text(beside).split("\n") == ["Title", *para[:4], "Next", "Short.", *para[4:8], para[8] + " bold"]
    deep = f"<body>{'<div>' * 2000}{tags(para[:3])}{'</div>' * 2000}<div>{tags(para[3:6])}</div></body>"
    assert text_density.main_text(deep).split("\n") == para[:6]


def test_main_text_keeps_what_only_sounds_like_noise():
    text = "A paragraph that is long enough to be counted as text of its own."
    kept = ["<h2 id='related-work'>{}</h2>", "<section id='copyright-law'><p>{}</p></section>", "<p class='share-price'>{}</p>",
            "<section id='alert-fatigue'><p>{}</p></section>", "<div class='share-price'>{}</div>",
            "<span class='notice'>{}</span>", "<div id='related-work'>{}</div>", "<h3 class='banner-heading' id='cookie'>{}</h3>", "<ul id='trending-topics'><li>{}</li></ul>"]
    dropped = ["<div class='share'>{}</div>", "<div class='x share-buttons'>{}</div>", "<section class=comments>{}</section>", "<div id=comments>{}</div>",
               "<section id='comments'><p>{}</p></section>", "<ol class='commentlist'><li>{}</li></ol>", "<div class='comment-thread'>{}</div>",
               "<article class='comment odd'><p>{}</p></article>", "<p class='advert'>{}</p>", "<span class='ad'>{}</span>", "<p class='cookie-notice'>{}</p>",
               "<p class='related'>{}</p>", "<div class='article__related-links'>{}</div>", "<div class='article-ad'>{}</div>",
               "<div class='ad'>{}</div>", "<ul class='relatedPosts'><li>{}</li></ul>", "<div class='ad-slot'>{}</div>"]
    for frame in ("<article>{}</article>", "<main>{}</main>"):
        for one in kept:
            page = "<body>" + frame.format(f"<p>{text}</p>" * 3 + one.format("the one " + text)) + "</body>"
            assert "the one " + text in text_density.main_text(page), one
        for one in dropped:
            page = "<body>" + frame.format(f"<p>{text}</p>" * 3 + one.format("the one " + text)) + "</body>"
            assert text_density.main_text(page).split("\n") == [text] * 3, one
    plain = f"<body><div><p>{text}</p><h2 id='related-work'>Related work</h2><p class='share-price'>{text}</p><section id='alert-fatigue'><p>{text}</p></section></div></body>"
    assert text_density.main_text(plain).split("\n") == [text, "Related work", text, text]
    math_text = "<article><p>It is <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>a=2</annotation></math> here.</p></article>"
    assert text_density.main_text(math_text) == "It is a=2 here."


def test_main_text_with_comments_as_articles_and_several_articles():
    text = "<p>" + "Words of the article as they stand. " * 3 + "</p>"
    comment = "<p>" + "A reader wrote more than the author did. " * 20 + "</p>"
    want = ("Words of the article as they stand. " * 3).strip()
    for wrapper in ("<section id='comments'>{}</section>", "<div class='comments'>{}</div>", "<div id='disqus_thread'>{}</div>", "{}"):
        page = f"<body><article>{text}</article>" + wrapper.format(f"<article class='comment'>{comment}</article>") + "</body>"
        assert text_density.main_text(page) == want, wrapper
    teaser = "<article class='card'><h3><a href=x>Another page</a></h3><p><a href=x>more</a></p></article>"
    two = f"<body><article>{text}</article><article>{text * 2}</article>{teaser}</body>"
    assert text_density.main_text(two).split("\n") == [want] * 3
    assert text_density.main_text(f"<body class='no-comments'><article class='post comments-open'>{text}</article></body>") == want


def test_unclosed_tags_take_linear_time():
    import time
    for one in ("<div><span>", "<p><button><div>", "<li><b>", "<article>", "<h1>x<div>"):
        begin = time.process_time()
        text_density.main_text(one * 20_000 + "x")
        assert time.process_time() - begin < 5, one


def test_densities_against_brute_force():
    import random
    import xml.etree.ElementTree as ET
    draw = random.Random(5)

    def tree(depth):
        node = ET.Element("body" if depth == 0 else draw.choice(["div", "div", "section", "a", "b"] if depth < 5 else ["b", "a"]))
        node.text = "t" * draw.randrange(40)
        for _ in range(draw.randrange(5) if depth < 5 else 0):
            child = tree(depth + 1)
            child.tail = "u" * draw.randrange(20)
            node.append(child)
        return node

    def counts(node, link=False):
        """Characters, tags, link characters and link tags inside a node, counted down from it."""
        link = link or node.tag == "a"
        c = len(node.text or "") + sum(len(x.tail or "") for x in node)
        out = [c, 0, c if link else 0, 0]
        for x in node:
            n = counts(x, link)
            out = [out[0] + n[0], out[1] + n[1] + 1, out[2] + n[2], out[3] + n[3] + (x.tag == "a")]
        return out

    for _ in range(40):
        root = tree(0)
        page = "<html>" + ET.tostring(root, encoding="unicode", short_empty_elements=False) + "</html>"
        nodes = text_density._order(text_density.parse(page))
        text_density._count(nodes)
        body = next(x for x in nodes if x.tag == "body")
        text_density.densities(nodes, body)
        c, _, lc, _ = counts(root)
        ratio = lc / max(c, 1)
        density = {}
        for node in root.iter():
            c, t, lc, lt = counts(node, False)
            t, link, links = max(t, 1), max(lc, 1), max(lt + (node.tag == "a"), 1)
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            density[node] = c / t * math.log(max(c * t / link / links, 1) + 1e-9) / (math.log(max(base, 1 + 1e-9)) if base > 1 else 1) if c else 0
        own = [x for x in nodes if x.tag not in ("#root", "html")]
        for x, node in zip(own, root.iter(), strict=True):
            assert x.tag == node.tag
            assert x.density == pytest.approx(max(density[node], 0)), page
            assert x.total == pytest.approx(sum(max(density[y], 0) for y in node))


def test_nearest_recall_and_hard_rows(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    ids, x = np.array(t["vec_id"]), np.array(t["embedding"], float)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(i), v, 0, "s") for i, v in zip(t["vec_id"], t["embedding"])]
    hard = [(9001, None, 0, "s"), (9002, [], 0, "s"), (9050, [0.0] * 64, 0, "s"), (9003, [float("nan")] * 64, 0, "s"), (9004, [None] + [1.0] * 63, 0, "s"),
            (None, [1.0] * 64, 0, "s"), (9005, [1.0, 2.0], 0, "s"), (9100, [2.0, 4.0], 0, "s"), (9006, [float("inf")] * 64, 0, "s"), rows[7], rows[7]]
    df = spark.createDataFrame(rows + hard, "vec_id long, embedding array<float>, dim int, v string")
    got = collections.defaultdict(list)
    for r in collision_hashing.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    assert got.pop(9100) == [(9005, pytest.approx(1.0), 1)] and 9050 not in got
    hit = 0
    for q, found in got.items():
        cos = y @ y[ids == q][0]
        cos[ids == q] = -9
        hit += len({v for v, _, _ in found} & set(ids[np.argsort(-cos)[:5]].tolist()))
        assert [r for *_, r in found] == [1, 2, 3, 4, 5] and all(abs(s - cos[ids == v][0]) < 1e-9 for v, s, _ in found)
    assert hit / (5 * len(got)) >= 0.9 and len(got) == sum(i % 50 == 0 for i in t["vec_id"])
    assert collision_hashing.nearest(df.limit(0), df.limit(0)).count() == 0


def test_bm25_against_brute_force(docs, none, table):
    rows = [(i, collections.Counter(re.findall(PLAIN, lower(x)))) for i, x in table if i is not None]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df = collections.Counter(w for _, c in rows for w in c)
    got = collections.defaultdict(list)
    for r in bm25.search(docs, docs.where("doc_id % 7 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, c in {i: c for i, c in rows if i % 7 == 0}.items():
        want = []
        for i, d in rows:
            s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean))
                    for w, m in c.items() if w in d)
            if s > 0 and i != q:
                want.append((-round(s, 8), i))
        want = sorted(want)[:10]
        assert [(-round(s, 8), i) for i, s in got[q]] == want or [i for _, i in want] == [i for i, _ in got[q]]
    assert bm25.search(none, none).count() == 0


def test_licences(docs, none, table):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = by_id(licences.scan_licences(docs), table)
    for i, x in table:
        w = re.findall(PLAIN, lower(x))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({b for _, b in at})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]], i
    assert got[1012][0].labels == "cc-by,cc-by-4.0,mit" and got[1012][0].n_base == 3
    kept, _ = licences.detect(b"licensed under the gnu general public license version 3", licences.rules())
    assert any(k[2] == "gpl" for k in kept)
    assert licences.scan_licences(none).count() == 0


def test_licence_suppression_against_brute_force():
    import random
    import time
    draw, ruleset = random.Random(3), licences.rules()
    pieces = ["gnu general public license", "version 3", "or later", "apache license", "version 2 0", "cc by", "cc by sa 4 0", "mit license", "the", "x11",
              "creative commons attribution sharealike 4 0 international license", "gnu lesser general public license", "bsd 3 clause", "license", "mozilla public license"]
    for _ in range(300):
        text = " ".join(draw.choice(pieces) for _ in range(draw.randrange(40))).encode()
        want, places = [], []
        for _, confidence, _, pattern, label, is_base in ruleset:
            for m in pattern.finditer(text):
                places += [(m.start(), label)] if is_base else []
                if not any(a <= m.start() and m.end() <= z for a, z, *_ in want):
                    want.append((m.start(), m.end(), label, confidence))
        kept, base = licences.detect(text, ruleset)
        assert (kept, base) == (want, places)
        starts = [s for s, _ in base]
        assert licences.word_places(text, starts) == sorted(len(text[:s].split()) for s in starts)
    long = b" ".join([b"gnu general public license version 3 and mit license cc by sa 4 0"] * 20_000)
    begin = time.process_time()
    kept, base = licences.detect(long, ruleset)
    places = licences.word_places(long, [s for s, _ in base])
    assert len(places) == 60_000 and places[-1] == 14 * 20_000 - 5
    assert time.process_time() - begin < 20


def _matches(parsed):
    """Examples of a parsed pattern: every alternative, optional parts with and without, repeats at their fewest and with a word."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            one = [chr(arg)]
        elif op == "BRANCH":
            one = [x for alternative in arg[1] for x in _matches(alternative)]
        elif op == "SUBPATTERN":
            one = _matches(arg[-1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            one = [x * arg[0] for x in _matches(arg[2])] + ([x * max(arg[0], 1) for x in _matches(arg[2])] if arg[1] else [])
        elif op == "IN":
            kind, first = arg[0]
            one = ["0" if "DIGIT" in str(first) else "x" if str(kind) in ("CATEGORY", "NEGATE") else None]
            one = [chr(a) for k, a in arg if str(k) == "LITERAL"] if one == [None] else one
        elif op in ("ANY", "NOT_LITERAL"):
            one = ["x"]
        else:
            one = [""] if op in ("ASSERT_NOT", "AT") else pytest.fail(op)
        out = list(dict.fromkeys(a + b for a in out for b in one))
    return out


def test_licence_gates_let_every_alternative_through(spark):
    from re import _parser
    for _, _, keyword, pattern, label, _ in licences.rules():
        examples = _matches(_parser.parse(pattern.pattern.decode()))
        assert any(pattern.search(x.encode()) for x in examples), label
        for x in examples:
            assert keyword in x.encode(), (label, x)
    assert len(licences.SIGNATURES) == 110 and len(licences.rules()) == 226
    texts = {"GNU Library General Public License": "lgpl", "Apache Software License 1.1": "apache-1.1", "zlib/libpng license": "zlib",
             "European Union Public Licence v1.2": "eupl-1.2", "Microsoft Public License": "ms-pl", "Server Side Public License": "sspl-1.0",
             "Business Source License 1.1": "busl-1.1", "Elastic License 2.0": "elastic-2.0", "GNU Lesser General Public License v. 2.1": "lgpl-2.1"}
    rows = list(enumerate(texts))
    got = {r.doc_id: r.labels.split(",") for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert texts[text] in got[i], text


def test_sampled_segmentations(docs, none, table):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = collections.defaultdict(set)
    for i, x in table:
        texts[i].add(x or "")
    got = collections.defaultdict(list)
    for r in gumbel_pieces.sample_segmentations(docs, with_ids=True).collect():
        got[r.doc_id].append(r)
        assert r.decodes or not r["ids"]
        assert sp.decode(r["ids"]) in texts[r.doc_id] and r.log_inclusion <= 0 and math.isfinite(r.log_inclusion)
    assert set(got) == set(texts)
    assert len(got[1000]) == 1 and got[1000][0].n_pieces == 0
    own = sorted(got[1006], key=lambda r: r["sample"])
    assert len({tuple(r["ids"]) for r in own}) == 4 and all(a.perturbed >= b.perturbed for a, b in zip(own, own[1:]))
    assert gumbel_pieces.sample_segmentations(none).count() == 0


def test_gumbel_draws_follow_the_lattice():
    s = gumbel_pieces.Sampler("piece_bpe_32k.model", 2, 1.0, 3)
    n = 6000
    import pyarrow as pa
    block, = T.blocks(pa.array(["cats of"] * n))
    leaves, kappa = s.block(block, np.arange(n, dtype=np.uint64))
    first = collections.Counter(tuple(s.ids(x[0][2]).tolist()) for x in leaves)
    logp = {tuple(s.ids(p).tolist()): lp for x in leaves for lp, _, p, _ in x}
    for ids, c in first.most_common(2):
        assert abs(c / n - math.exp(logp[ids])) < 0.03
    total = sum(math.exp(lp) / (1 - math.exp(-math.exp(lp - k))) for x, k in zip(leaves, kappa) for lp, *_ in x) / n
    assert abs(total - 1) < 0.05           # inclusion-weighted draws add up to the whole mass
