"""Rounds of the expansion: edges are neither sorted nor checkpointed by row, ends are not expanded."""
from snapweave.operators import graph as G

EDGES = "src_type string, src_id long, dst_type string, dst_id long"


def _chain(spark, n=6):
    rows = [("app", i, "developer", i) for i in range(n)] + [("developer", i, "app", i + 1) for i in range(n)]
    return spark.createDataFrame([("app", 0)], "node_type string, node_id long"), spark.createDataFrame(rows, EDGES)


def test_rounds_hash_the_frontier_and_sort_no_edges(spark, monkeypatch):
    plans, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    seeds, edges = _chain(spark)
    assert G.bounded_bfs(seeds, edges, 3).count() == 4
    rounds = [p for p in plans if "_salt" in p]
    assert len(rounds) == 3
    for p in rounds:
        joined = p[p.index("ShuffledHashJoin"):]                       # the join and what is below it
        assert "Sort" not in joined and "BuildLeft" in joined
        assert "partial_min(src_id" in p and "HashAggregate(keys=[dst_type" in p


def test_more_types_than_are_listed(spark, monkeypatch):
    seeds, edges = _chain(spark)
    whole = sorted(map(tuple, G.bounded_bfs(seeds, edges, 4).collect()))
    monkeypatch.setattr(G, "MOST_TYPES", 0)
    monkeypatch.setattr(G, "FRONTIER_ROWS", 2)                         # partitions follow the frontier
    assert sorted(map(tuple, G.bounded_bfs(seeds, edges, 4).collect())) == whole


def test_ends_are_reached_but_not_expanded(spark):
    seeds, edges = _chain(spark)
    ends = spark.createDataFrame([("developer", 1), ("developer", 1), (None, 3)], "node_type string, node_id long")
    got = {(r.node_type, r.node_id) for r in G.bounded_bfs(seeds, edges, 6, ends=ends).collect()}
    assert got == {("app", 0), ("developer", 0), ("app", 1), ("developer", 1)}


def test_null_and_string_ids(spark):
    rows = [("app", "a", "app", "b"), ("app", "b", "app", "c"), (None, "a", "app", "x"), ("app", None, "app", "y"), ("app", "a", "app", None)]
    edges = spark.createDataFrame(rows, "src_type string, src_id string, dst_type string, dst_id string")
    seeds = spark.createDataFrame([("app", "a"), (None, "a"), ("app", None)], "node_type string, node_id string")
    got = {(r.node_type, r.node_id): (r.depth, r.referrer and tuple(r.referrer)) for r in G.bounded_bfs(seeds, edges, 3).collect()}
    assert got[("app", "b")] == (1, ("app", "a")) and got[("app", "c")] == (2, ("app", "b")) and got[("app", None)][0] in (0, 1)
    assert ("app", "x") not in got and ("app", "y") not in got
