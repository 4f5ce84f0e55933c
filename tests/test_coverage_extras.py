import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from snapweave.functions import processors as P
from snapweave.operators import filters as D
from snapweave.operators import joins as J
from snapweave.operators import merge as M
from snapweave.sources import extract, snapshots


def test_small_helpers(spark):
    r = spark.range(1).select(P.crawl_stamp("2016-08-12 17:56:02").alias("c"),
                              P.flatten_text(F.array(F.lit("Large Dog "), F.lit("Wheelchair"))).alias("t"),
                              P.union_ids(F.array(F.lit(3), F.lit(1)), F.array(F.lit(2), F.lit(3))).alias("u"),
                              D.job_detail_link(F.lit("/jobs_details/5")).alias("d5"),
                              D.job_running(F.lit("This job is currently not running")).alias("d4"),
                              D.has_any(F.array()).alias("d7")).collect()[0]
    assert r.c == dt.datetime(2016, 8, 12, 17, 56, 2) and r.t == "Large Dog Wheelchair" and r.u == [1, 2, 3]
    assert (r.d5, r.d4, r.d7) == (True, False, False)


def test_attach_related_update_only(spark):
    apps = spark.createDataFrame([("1", None), ("2", ["9"])], "id string, related_ids array<string>")
    rel = spark.createDataFrame([("1", ["5", "6"]), ("7", ["8"])], "id string, related_ids array<string>")
    got = {r.id: r.related_ids for r in M.attach_related(apps, rel).collect()}
    assert got == {"1": ["5", "6"], "2": ["9"]}


def test_resolve_short_links(spark):
    links = spark.createDataFrame([(1, "goo.gl/abc"), (2, "https://amzn.to/x")], "job int, url string")
    res = spark.createDataFrame([("https://www.goo.gl/abc", "https://www.amazon.com/dp/B1")], "short_url string, final_url string")
    got = {r.job: r.final_url for r in J.resolve_links(links, "url", res).collect()}
    assert got == {1: "https://www.amazon.com/dp/B1", 2: None}


def test_typed_snapshots_and_totals(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "mw")
    os.makedirs(d)
    p = os.path.join(d, "job-1.json")
    with open(p, "w") as f:
        f.write('{"id":"a","timestamp":"2016-01-01 00:00:00","work_done":"3","work_total":"10","duration":"5","success_pct":"N/A"}\n')
        f.write('{"id":"b","timestamp":"2016-01-01 00:00:01","work_done":"x","success_pct":"95.5"}\n')
    lines = snapshots.read_snapshot_lines(spark, [p])
    rows = {r.id: r for r in snapshots.typed_job_snapshots(lines).collect()}
    assert (rows["a"].work_done, rows["a"].success_pct, rows["b"].work_done, rows["b"].success_pct) == (3, None, None, 95.5)
    t = snapshots.source_totals(lines).collect()[0]
    assert (t.spider, t.n_items, t.n_files) == ("mw", 2, 1)


def _page(spark, html):
    return spark.createDataFrame([(1, html)], "pid int, html string")


def test_document_products_related_and_developer(spark):
    doc = _page(spark, '<p>Products: <a href="https://www.amazon.com/dp/B0001">one</a> and '
                       'www.amazon.com/gp/product/glance/B0002 and /dp/B0001</p>')
    assert [r.product_id for r in extract.document_product_ids(doc, ["pid"]).orderBy("pos").collect()] == ["B0001", "B0002"]
    rel = _page(spark, '<div><div><h2>More by This Developer</h2></div><div num-items="5"><a class="artwork-link" href="https://x/app/m/id10">m</a>'
                       '</div></div><div><div><h2>Customers Also Bought</h2></div><div num-items="5"><a class="artwork-link" href="https://x/app/a/id11?mt=8">a</a>'
                       '<a class="artwork-link" href="https://x/app/b/id12?mt=8">b</a></div></div>'
                       '<div class="right"><a href="https://x/us/developer/d/id77">View More by This Developer</a></div>')
    r = extract.related_pages(rel, ["pid"]).collect()[0]
    assert r.related_ids == ["11", "12"] and r.n_related == 2 and r.developer_id == "77"
    dev = spark.createDataFrame([(1, ["21"], '<div metrics-loc="Titledbox_iPhone Apps"><a class="artwork-link" href="/id20">x</a></div>'
                                          '<div metrics-loc="Titledbox_iPad Apps"><a class="artwork-link" href="/id21">y</a></div>'
                                          '<ul class="list paginate"><a href="#iPhoneSoftwarePage=2">2</a></ul>')],
                                "pid int, prev array<string>, html string")
    r = extract.developer_pages(dev, ["pid"], prev_ipad_col="prev").collect()[0]
    # same iPad list as the previous page -> only the iPhone list counts
    assert r.app_ids == ["20"] and r.app_types == ["iPhone Apps", "iPad Apps"] and r.n_iphone_pager == 1
    assert os.path.isdir(FIXTURES)


def test_api_extras(spark):
    from snapweave.functions import urls as U
    from snapweave.operators import graph as G
    from snapweave.operators import ranks as K
    r = spark.range(1).select(
        U.lookup_url(F.lit("628228162")).alias("lookup"),
        U.single_app_url(F.lit("Install https://play.google.com/store/apps/details?id=com.x now")).alias("one"),
        U.single_app_url(F.lit("https://a.app/1 and https://b.app/2")).alias("two"),
        P.to_bool(F.lit("")).alias("f"), P.to_bool(F.lit("x")).alias("t")).collect()[0]
    assert r.lookup == "https://itunes.apple.com/lookup?id=628228162"
    assert r.one == "https://play.google.com/store/apps/details?id=com.x" and r.two is None
    assert (r.f, r.t) == (False, True)
    nodes = spark.createDataFrame([("app", "1", 0), ("app", "2", 3)], "node_type string, node_id string, depth int")
    assert [x.node_id for x in G.allowed_pages(nodes).collect()] == ["1"]
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted((x.k, x.v) for x in J.first_match(rows, ["k"], ["o"]).collect()) == [("a", "y"), ("b", "z")]
    req = spark.createDataFrame([("United States", "Top Free", "Games"), ("China", "Top Paid", None),
                                 ("Mars", "Top Free", None), ("China", "Top Paid", "Cooking")],
                                "country string, list_name string, genre string")
    valid, rejected = K.chart_requests(req)
    urls = sorted(x.url for x in valid.collect())
    assert urls == ["https://itunes.apple.com/cn/rss/toppaidapplications/limit=200/xml",
                    "https://itunes.apple.com/us/rss/topfreeapplications/limit=200/genre=6014/xml"]
    assert sorted(x.country for x in rejected.collect()) == ["China", "Mars"]


def test_single_value_array_and_page_limit(spark):
    from snapweave.operators import graph as G
    r = spark.range(1).select(P.single_value_array(F.array(F.lit("a")), F.array().cast("array<string>")).alias("s"),
                              P.single_value_array(F.array(F.lit("a")), F.array(F.lit("b"))).alias("t")).collect()[0]
    assert r.s == ["a"] and r.t == ["b"]
    req = spark.createDataFrame([("app", 10), ("app", 11), ("developer", 6), ("reviewer", 30), ("other", 99)],
                                "entity_type string, page int")
    assert sorted((x.entity_type, x.page) for x in G.within_page_limit(req).collect()) == \
        [("app", 10), ("other", 99), ("reviewer", 30)]
