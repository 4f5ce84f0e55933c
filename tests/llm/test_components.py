"""Connected components: the smallest reachable id, and the rows that the joins of its rounds make."""

import random

import pyarrow as pa

from snapweave.llm import components as C


def _want(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_components_of_paths_stars_and_odd_rows(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 10**6), 400)
    edges = list(zip(range(2000, 2090), range(2001, 2091), strict=True))           # a path in order
    edges += list(zip(ids[:80], ids[1:81], strict=True))                             # a path in no order
    edges += [(ids[100], x) for x in ids[101:150]] + [(x, 10**7) for x in ids[151:200]]
    edges += [tuple(rng.sample(ids[200:], 2)) for _ in range(120)]
    odd = [(5, 5), (None, 3), (3, None), (None, None)]
    got = C.components(spark.createDataFrame([*edges, *edges[:50], *[(b, a) for a, b in edges[50:90]], *odd], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _want(edges)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_are_joined_once(spark, monkeypatch):
    """A group tied many times over: the joins of all rounds make about two rows an edge, not two in every round."""
    rng = random.Random(9)
    edges = sorted({(x, rng.randrange(x)) for x in range(1, 400) for _ in range(24)})
    df = spark.createDataFrame(edges, "a long, b long")
    kind, made = type(df), []
    plain = kind.join

    def counted(self, *args, **kw):
        out = plain(self, *args, **kw)
        made.append(out.count())
        return out
    monkeypatch.setattr(kind, "join", counted)
    got = {r.node: r.component for r in C.components(df).collect()}
    assert got == _want(edges)
    assert sum(made) < 3 * len(edges)


def _groups(rng, groups=40, rows=30):
    """Edges of random groups, and paths through nodes of all sizes."""
    edges = [(g * 1000 + rng.randrange(rows), g * 1000 + rng.randrange(rows)) for g in range(groups) for _ in range(3 * rows)]
    path = rng.sample(range(10**6, 2 * 10**6), 200)
    return edges + list(zip(path[:-1], path[1:], strict=True))


def test_a_small_rest_needs_no_rounds(spark):
    """Few edges are closed in a few jobs; each round of joins over all partitions took about ten."""
    edges = _groups(random.Random(3))
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    spark.sparkContext.setJobGroup("few", "components of few edges")
    try:
        got = {r.node: r.component for r in C.components(df).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == _want([e for e in edges if e[0] != e[1]])
    assert len(jobs) <= 8, len(jobs)


def test_rounds_and_full_buffers(spark, monkeypatch):
    """More edges than one task may close, and than it may hold, give the same."""
    rng = random.Random(5)
    edges = _groups(rng)
    rng.shuffle(edges)
    want = _want([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for few in (0, 60):     # 0: rounds to the end, only an empty rest is closed
        monkeypatch.setattr(C, "FEW", few)
        got = C.components(df).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want
    batch = [pa.RecordBatch.from_pydict({"a": [a for a, _ in edges[i:i + 50]], "b": [b for _, b in edges[i:i + 50]]})
             for i in range(0, len(edges), 50)]
    monkeypatch.setattr(C, "HELD", 120)
    stars = [(a, b) for x in C._stars(batch) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert _want(stars) == want
