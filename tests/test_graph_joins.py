import random
from collections import deque

from pyspark.sql import functions as F

from snapweave.operators import graph as G
from snapweave.operators import joins as J
from snapweave.operators import ranks as K


def _bfs(seeds, edges, max_depth):
    depth = {s: 0 for s in seeds}
    q = deque(seeds)
    while q:
        n = q.popleft()
        if depth[n] == max_depth:
            continue
        for a, b in edges:
            if a == n and b not in depth:
                depth[b] = depth[n] + 1
                q.append(b)
    return depth


def test_bounded_bfs_vs_python(spark):
    rng = random.Random(3)
    nodes = [("app", i) for i in range(12)] + [("dev", i) for i in range(4)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)]
    seeds = [("app", 0), ("app", 1)]
    e = spark.createDataFrame([(a[0], a[1], b[0], b[1], "k") for a, b in edges],
                              "src_type string, src_id long, dst_type string, dst_id long, kind string")
    s = spark.createDataFrame(seeds, "node_type string, node_id long")
    nodes_df = G.bounded_bfs(s, e, 3)
    got = nodes_df.collect()
    exp = _bfs(seeds, edges, 3)
    assert {(r.node_type, r.node_id): r.depth for r in got} == exp
    # referrer: smallest parent one level up
    for r in got:
        if r.depth > 0:
            parents = sorted(a for a, b in edges if b == (r.node_type, r.node_id) and exp.get(a) == r.depth - 1)
            assert (r.referrer.node_type, r.referrer.node_id) == parents[0]
    stats = {r.depth: r.n_nodes for r in G.depth_stats(nodes_df).collect()}
    assert sum(stats.values()) == len(exp)


def test_developer_page_rule(spark):
    df = spark.createDataFrame([("a", 6, 6), ("b", 7, 3), ("c", 3, 0), ("d", 2, 4)], "dev string, ip int, ipad int")
    r = G.developer_pages(df, "dev", "ip", "ipad").collect()
    pages = {}
    for x in r:
        pages.setdefault(x.entity_id, []).append((x.page, x.url.split("?")[1]))
    # 6 links include 'next' -> 5 pages, equal counts: both pagers advance
    assert pages["a"][-1] == (5, "iPhoneSoftwarePage=5&iPadSoftwarePage=5")
    # 7 -> 6 (capped at 5 pages), iPad 3 < 6: only iPhone advances
    assert [p for p, _ in pages["b"]] == [1, 2, 3, 4, 5] and pages["b"][-1][1].endswith("iPadSoftwarePage=1")
    # no iPad pager: iPhone only
    assert pages["c"][-1] == (3, "iPhoneSoftwarePage=3&iPadSoftwarePage=1")
    # iPad above iPhone behaves as equal
    assert pages["d"][-1] == (2, "iPhoneSoftwarePage=2&iPadSoftwarePage=2")


def _contained_any(texts, names):
    return [(k, i) for k, t in texts for i, n in names if t and n and n in t]


def _contained(texts, names):
    return sorted(_contained_any(texts, names))


def test_contains_join_guard_and_salts(spark, monkeypatch):
    big = 9007199254740993  # beyond a double, beside a NULL key
    texts = [(big, "Please buy the Large Dog Wheelchair now; docs at /document/x"), (2, "nothing here"),
             (3, "dog wheelchair large? no. Large Dog Wheelchair!"), (4, None), (5, ""), (6, "a\tb  c"), (7, "xLarge Dogs and CatTowers"),
             (8, " \n"), (9, "né 日本語 x🙂y"), (10, "Large Dog Wheelchair Large Dog Wheelchair")]
    names = [("B1", "Large Dog Wheelchair"), ("B2", ""), ("B3", None), ("B4", "Large Dog"), ("B5", "Cat Tower"), ("B6", "CatTower"),
             ("B7", " "), ("B8", "b  c"), ("B9", "本"), ("B10", " Dog "), ("B11", "🙂"), ("B12", "Dog never Wheelchair"), ("B13", "Large Dog Wheelchair"),
             ("B14", "é"), ("B15", "arge Dog Wheel"), ("B16", "rge"), ("B17", "x ")]
    t = spark.createDataFrame([*texts, (None, "a Large Dog here")], "job long, txt string")
    p = spark.createDataFrame(names, "ID string, NAME string")
    want = sorted(_contained_any([*texts, (None, "a Large Dog here")], names), key=str)
    rows = lambda: sorted(((r.job, r.ID) for r in J.contains_join(t, ["job"], "txt", p, "NAME").collect()), key=str)
    assert rows() == want
    monkeypatch.setattr(J, "checked_broadcast", lambda small, *a, **k: small)  # sides of any size: the salted shuffle join
    assert rows() == want
    assert J.contains_join(t, ["job"], "txt", p.where("false"), "NAME").count() == 0
    assert J.contains_join(t.where("false"), ["job"], "txt", p, "NAME").count() == 0


def test_contains_join_random(spark):
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
    texts = [(i, rng.choice(["", " "]).join([" ".join(word() for _ in range(rng.randrange(12)))] * 2)) for i in range(150)]
    names = [(str(i), " ".join(word() for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    got = J.contains_join(spark.createDataFrame(texts, "job long, txt string"), ["job"], "txt",
                          spark.createDataFrame(names, "ID string, NAME string"), "NAME")
    assert sorted((r.job, r.ID) for r in got.collect()) == _contained(texts, names)


def test_first_list_rank_and_ids(spark):
    charts = spark.createDataFrame([("a", "L2", 2, 1), ("a", "L1", 5, 0), ("b", "L2", 1, 1)],
                                   "app string, list_name string, rank int, priority int")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "app string")
    r = {x.app: (x.list_name, x.rank) for x in K.first_list_rank(items, "app", charts).collect()}
    assert r == {"a": ("L1", 5), "b": ("L2", 1), "c": (None, None)}
    ids = spark.createDataFrame([("a",), ("z",)], "app string")
    assert [(x.app, x.rank) for x in K.ranks_for_ids(charts.where("list_name = 'L2'"), ids, "app").collect()] == [("a", 2)]
    valid, rejected = K.lookup_codes(spark.createDataFrame([("China",), ("Mars",)], "country string"), "country",
                                     spark.createDataFrame(K.COUNTRIES, "name string, code string"), "name", "code")
    assert [x.code for x in valid.collect()] == ["cn"] and [x.country for x in rejected.collect()] == ["Mars"]
    rv = spark.createDataFrame([(1, 5, 2, 1), (2, 1, 9, 2), (3, 5, 0, 3)], "id int, rating int, vote int, updated int")
    assert [x.id for x in K.order_reviews(rv, "mostCritical").collect()] == [2, 3, 1]
    assert F is not None


def test_bfs_paged_at_limit_parity(spark):
    e = spark.createDataFrame([("app", i, "app", i + 1, "k") for i in range(5)],
                              "src_type string, src_id long, dst_type string, dst_id long, kind string")
    s = spark.createDataFrame([("app", 0)], "node_type string, node_id long")
    assert G.bounded_bfs(s, e, 3).agg({"depth": "max"}).first()[0] == 3
    assert G.bounded_bfs(s, e, 3, paged_at_limit=True).agg({"depth": "max"}).first()[0] == 2


def test_lineage_paths_of_a_deep_chain_and_a_hub(spark, monkeypatch):
    rows = [("n", 0, 0, None)] + [("n", i, i, ("n", i - 1)) for i in range(1, 40)] + [("m", i, 1, ("n", 0)) for i in range(50)]
    nodes = spark.createDataFrame(rows + [("x", 7, 2, ("gone", 1))], "node_type string, node_id long, depth int, referrer struct<node_type:string,node_id:long>")
    rounds = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    got = {(r.node_type, r.node_id): [(p.node_type, p.node_id) for p in r.path] for r in G.lineage_paths(nodes).collect()}
    assert got[("n", 39)] == [("n", i) for i in range(40)] and len(rounds) == 1 + 6  # 2 ** 6 > 39
    assert got[("m", 9)] == [("n", 0), ("m", 9)] and got[("n", 0)] == [("n", 0)] and got[("x", 7)] == [("x", 7)]
    assert len(got) == len(rows) + 1
