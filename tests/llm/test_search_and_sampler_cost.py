"""Collision counting by bisection over the windows; one sampler per worker process."""
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from snapweave.llm import collision_hashing as C, gumbel_pieces as G  # noqa: E402


def _step_by_step(index, own, query, k):
    """Every window counted anew, one after the other."""
    norm = np.sqrt(query @ query)
    at = (query / norm) @ index.lines
    place = (index.vectors / index.norms[:, None]) @ index.lines
    radius = C.START_RADIUS
    while True:
        half = C.WIDTH * radius / 2
        seen = ((place >= at - half) & (place <= at + half)).sum(axis=1) >= int(np.ceil(C.THRESHOLD * C.PROJECTIONS))
        cos = np.einsum("ij,j->i", index.vectors, query) / (index.norms * norm)
        best = sorted((-cos[i], int(index.ids[i])) for i in np.flatnonzero(seen & (index.ids != own)))[:k]
        if seen.all() or len(best) >= k and np.sqrt(max(0.0, 2 + 2 * best[k - 1][0])) <= radius:
            return [(i, -c) for c, i in best]
        radius *= C.GROWTH


@pytest.mark.parametrize("n", [1, 4, 300])
def test_bisection_finds_what_single_steps_find(n, monkeypatch):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 8))
    v[n // 2:] = v[:n - n // 2] + 0.01 * (rng.random((n - n // 2, 8)) < 0.3)       # near and equal ones
    index = C.Index(np.arange(n), v)
    own = np.arange(0, n, 3)
    searched, find = [], np.searchsorted
    monkeypatch.setattr(C.np, "searchsorted", lambda *a, **b: searched.append(1) or find(*a, **b))
    got = dict(index.search_all(own, v[own], 5))
    monkeypatch.undo()
    # a line is searched for all steps of many queries at once
    assert len(searched) <= 2 * C.PROJECTIONS * -(-len(own) // C.QUERIES) * 2
    for q in own.tolist():
        want = _step_by_step(index, q, v[q], 5)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([x for _, x in got[q]], [x for _, x in want])
        assert index.search(q, v[q], 5) == got[q]


def test_one_sampler_per_process():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["the quick brown fox é中", "", None])], names=["doc_id", "text"])
    run = G._sample("piece_bpe_32k.model", 4, 1.0, 1, True)
    first = pa.Table.from_batches(list(run(iter([batch]))))
    sampler = G._sampler("piece_bpe_32k.model", 4, 1.0, 1)
    held = len(sampler.lattices.index)
    assert held and pa.Table.from_batches(list(run(iter([batch])))).equals(first)
    assert G._sampler("piece_bpe_32k.model", 4, 1.0, 1) is sampler and len(sampler.lattices.index) == held
    assert all(first.column("decodes").to_pylist())


def test_no_piece_is_lost_by_the_first_bits():
    v = G._sampler("piece_bpe_32k.model", 4, 1.0, 1).v
    assert v.begun[(v.keys >> np.uint64(44)).astype(np.int64)].all() and v.begun.mean() < 0.05


def test_few_documents_get_an_exact_bm25_score(monkeypatch):
    """Frequent words everywhere: block maxima left most documents in, one product for many queries leaves about k besides the seeds."""
    from snapweave.llm import bm25
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(20, 60))) for _ in range(700)] + ["w1 w2 w3"] * 40 + ["", "alone"]
    ids = np.arange(len(texts)) * 3 + 1
    parts = list(bm25.term_counts(pa.array(texts)))
    counts = [(int(r), int(t), int(c)) for _, row, term, count, _ in parts for r, t, c in zip(row, term, count, strict=True)]
    length = np.concatenate([size for *_, size in parts])
    mean = float(length.mean())
    df = {}
    for _, t, _ in counts:
        df[t] = df.get(t, 0) + 1
    of = {}
    for r, t, c in counts:
        of.setdefault(r, {})[t] = c
    shard = bm25.Shard(ids, list(bm25.term_counts(pa.array(texts))), mean)
    exact, plain = [], bm25.Shard._full
    monkeypatch.setattr(bm25.Shard, "_full", lambda self, score, docs, *a: exact.append(len(docs)) or plain(self, score, docs, *a))
    asked = []
    for r in [*range(0, 150), 710, 740, 741]:
        terms = np.array(sorted(of.get(r, {})), np.int64)
        asked.append((int(ids[r]), terms, np.array([of[r][int(t)] * np.log1p((len(texts) - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])))
    got = list(shard.search(asked, 10))
    assert len(got) == len(asked)
    for (own, terms, w), best in zip(asked, got, strict=True):
        score = {}
        for r, has in of.items():
            x = sum(v * has[t] * (bm25.K1 + 1) / (has[t] + bm25.K1 * (1 - bm25.B + bm25.B * length[r] / mean))
                    for t, v in zip(terms.tolist(), w.tolist(), strict=True) if t in has)
            if x > 0 and ids[r] != own:
                score[int(ids[r])] = x
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        assert [d for d, _ in best] == [d for d, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(best, want, strict=True))
    assert sum(exact) <= (bm25.SEEDS * bm25.BLOCK_DOCS + 20) * len(asked)


def test_decode_gathers_the_pieces_at_once():
    """All ids of a path in one gather, not one lookup each; the same bytes, byte pieces and empty paths too."""
    sampler = G.Sampler("piece_bpe_32k.model", 1, 1.0, 1)

    class Once(list):
        def __getitem__(self, _):
            raise AssertionError("a lookup for a single piece")
    pieces, sampler.v.bytes = sampler.v.bytes, Once(sampler.v.bytes)
    rng = np.random.default_rng(2)
    for n in (0, 1, 500):
        ids = rng.integers(0, len(pieces), n).astype(np.int32)
        assert bytes(sampler.decode(ids)) == b"".join(pieces[i] for i in ids)[1:]
    keys = rng.integers(0, 2**63, 50, dtype=np.uint64)
    assert [G._uniform_of(int(k)) for k in keys] == G._uniform(keys).tolist()


def _bm25_rows(spark, n):
    rng = np.random.default_rng(n)
    words = [f"v{i}" for i in range(3000)]
    rows = [(int(i), " ".join(words[int(w)] for w in (3000 * rng.random(rng.integers(5, 120)) ** 3))) for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (None, "v1 v2"), (5, "v3 v4 v5"), (n + 42, "alone")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_bm25_finds_the_same_in_many_shards_and_chunks(spark, monkeypatch):
    from snapweave.llm import bm25
    docs = _bm25_rows(spark, 600)

    def found(asked="doc_id % 7 = 0 or doc_id >= 600"):
        return [(r.query_id, r["rank"], r.doc_id, pytest.approx(r.score, rel=1e-12))
                for r in bm25.search(docs, docs.where(asked)).orderBy("query_id", "rank").collect()]

    one = found()
    monkeypatch.setattr(bm25, "SHARD_DOCS", 40)
    many = found()
    assert many == one
    # equal texts lie in many shards and have one score: the smaller id is first
    twins = [d for q, _, d, _ in many if q == 629 and d >= 600]
    assert twins == sorted(twins) and len(twins) >= 9
    monkeypatch.setattr(bm25, "CHUNK_TERMS", 2000)
    assert found() == one
    monkeypatch.setattr(bm25, "CHUNK_TERMS", 20)  # more chunks than queries: some have none
    assert found("doc_id in (7, 14, 629)") == [x for x in one if x[0] in (7, 14, 629)]


def test_bm25_shuffle_does_not_grow_with_queries_times_shards(spark, monkeypatch):
    """Queries written once per shard are 600 queries x 40 shards x over 500 bytes here."""
    import os

    from snapweave.llm import bm25
    docs = _bm25_rows(spark, 600)
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    monkeypatch.setattr(bm25, "SHARD_DOCS", 16)
    before = shuffled()
    assert bm25.search(docs, docs).count()
    assert sum(size for f, size in shuffled().items() if f not in before) < 5_000_000
