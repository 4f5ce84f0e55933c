import datetime as dt
import os

from conftest import FIXTURES
from snapweave.plans.app_graph import app_graph


def _read(name):
    with open(os.path.join(FIXTURES, "pages", name), encoding="utf-8") as f:
        return f.read()


def test_app_graph_end_to_end(spark):
    t0, t1 = dt.datetime(2016, 12, 7), dt.datetime(2016, 12, 8)
    captured = spark.createDataFrame([
        ("app_lookup", "628228162", 1, None, t0, _read("lookup.json")),
        ("app_lookup", "628228162", 1, None, t1, _read("lookup.json").replace('"version":"5.3.0"', '"version":"5.4.0"')),
        ("review_feed", "628228162", 1, None, t0, _read("review_feed.xml")),
        ("review_feed", "628228162", 1, None, t1, _read("review_feed.xml")),
        ("review_feed", "628228162", 2, None, t1, "<feed xmlns='http://www.w3.org/2005/Atom'><id>x</id><link rel='self' href='y'/></feed>"),
        ("review_feed", "628228162", 3, None, t1, "<feed><entry>"), ("review_feed", "628228162", 4, None, t1, None),
        ("reviewer_page", "286496943", 1, "628228162", t0, _read("reviewer.html")),
        ("reviewer_page", "286496943", 2, "628228162", t1, _read("reviewer.html")),
    ], "kind string, entity_id string, page int, referrer string, fetched_at timestamp, body string")
    seeds = spark.createDataFrame([("628228162",)], "app_id string")
    t = app_graph(captured, seeds)
    apps = t["apps"].collect()
    assert len(apps) == 1 and apps[0].version == "5.4.0"            # latest lookup wins
    reviews = t["reviews"].collect()
    assert len(reviews) == 2 and all(r.timestamp == t1 for r in reviews)       # the later capture of equal reviews
    assert tuple(t["feed_counts"].collect()[0]) == (5, 2, 1, 2, 4)             # pages, with, without, unreadable; reviews as captured
    rv = t["reviewers"].collect()[0]
    assert {"rating", "review_date", "version", "developer_id", "genre", "release", "title", "review_text"} <= set(rv.asDict())
    assert rv.referrer == "628228162" and rv.reviewer_name and all(len(rv[c]) == 6 for c in ("genre", "release", "review_text"))
    assert rv.n_reviews == 6 and rv.item_id[:3] == ["1186623793", "1173051209", "628228162"]
    depth = {(r.node_type, r.node_id): r.depth for r in t["nodes"].collect()}
    assert depth[("app", "628228162")] == 0
    assert depth[("reviewer", "286496943")] == 1 and depth[("developer", "628228165")] == 1
    assert depth[("app", "1186623793")] == 2
    assert ("app", "1173051209") not in depth                       # a book is not expanded as an app
