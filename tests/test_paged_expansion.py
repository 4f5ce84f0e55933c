"""Expansion over (type, id, page): page limits, the last level and leaf rules."""
import collections

import pytest

from snapweave.operators import graph as G
from snapweave.plans import apps

from conftest import SMOKE


def walk(seeds, links, max_depth, limits):
    """Queue of single requests: the next page of an entity stands in its own level, other entities in the next."""
    links = set(links)
    pages, to = collections.defaultdict(int), collections.defaultdict(set)
    for st, si, pg, dt, di in links:
        pages[st, si] = max(pages[st, si], pg)
        to[st, si].add((dt, di))
    depth, parents, level = {s: 0 for s in seeds}, collections.defaultdict(set), set(seeds)
    done, leaf = set(), {}
    for d in range(max_depth + 1):
        following = set()
        for node in sorted(level):
            only = len(to[node]) == 1 and next(iter(to[node]))
            referrer = min(parents[node], default=None)
            leaf[node] = bool(node[0] == "reviewer" and pages[node] == 1 and only or node[0] == "developer" and only and only == referrer)
            page = 1
            while True:
                done.add((*node, page, d, leaf[node]))
                if d == max_depth or leaf[node]:
                    break
                for st, si, pg, dt, di in links:
                    if (st, si, pg) == (*node, page):
                        if depth.get((dt, di), d + 1) == d + 1:
                            depth[dt, di] = d + 1
                            parents[dt, di].add(node)
                            following.add((dt, di))
                page += 1
                if page > min(pages[node], limits.get(node[0], 10**9)):
                    break
        level = following
    return done


def test_pages_limits_and_leaves(spark):
    links = [("app", 1, 1, "developer", 7), ("developer", 7, 1, "app", 1),                 # developer with its one app: leaf
             ("app", 1, 2, "developer", 8), ("developer", 8, 1, "app", 2), ("developer", 8, 3, "app", 3), ("developer", 8, 6, "app", 4),
             ("app", 1, 11, "reviewer", 5), ("app", 2, 1, "reviewer", 6), ("reviewer", 6, 1, "app", 9), ("reviewer", 6, 1, "app", 9),
             ("app", 3, 2, "reviewer", 10), ("reviewer", 10, 1, "app", 3), ("reviewer", 10, 2, "app", 11), ("app", 2, 2, "list", 3),
             ("list", 3, 40, "app", 12), ("app", 3, 1, "developer", 13), ("developer", 13, 1, "app", 14)]
    seeds = [("app", 1), ("app", 1), ("developer", 20)]
    links += [("developer", 20, 1, "app", 21), ("app", 21, 1, "developer", 20)]           # a seed has no referrer: expanded
    bad = [(None, 1, 1, "app", 99), ("app", 1, None, "app", 98), ("app", 1, 1, "app", None)]
    schema = "src_type string, src_id long, src_page long, dst_type string, dst_id long"
    s = spark.createDataFrame(seeds, "node_type string, node_id long")
    ln = spark.createDataFrame(links + bad, schema)
    for depth in (0, 1, 2, 3, 4, 6):
        got = [tuple(r) for r in G.paged_expansion(s, ln, depth).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {tuple(x) for x in walk(set(seeds), links, depth, G.MAX_PAGES)}, depth
    got = {tuple(r) for r in G.paged_expansion(s, ln, 6).collect()}
    assert ("developer", 7, 1, 1, True) in got and ("reviewer", 6, 1, 3, True) in got
    assert not any(r[0] == "app" and r[1] in (4, 9) or r[:2] == ("reviewer", 5) for r in got)
    assert G.paged_expansion(s.limit(0), ln, 3).count() == 0
    assert G.paged_expansion(s, ln.limit(0), 3).count() == 2


@pytest.mark.parametrize("column", ["node_type", "page", "depth", "is_leaf"])
def test_query_has_several_values(spark, column):
    assert apps.paged_requests(spark, SMOKE).select(column).distinct().count() > 1
