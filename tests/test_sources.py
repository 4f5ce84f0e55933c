import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from snapweave.sources import embedded, extract, feeds, seeds
from snapweave.sources.html import html_to_xhtml, page_fields

PAGES = os.path.join(FIXTURES, "pages")


def _read(name):
    with open(os.path.join(PAGES, name), encoding="utf-8") as f:
        return f.read()


def _pages(spark, *names):
    return spark.createDataFrame([(i, n, _read(n)) for i, n in enumerate(names)], "pid int, name string, html string")


def test_xhtml_repair_is_well_formed():
    import xml.etree.ElementTree as ET
    x = html_to_xhtml('<p>a<br>b<p>c &amp; d<script>var t="</p>"; a<b</script><img src=x>')
    root = ET.fromstring(x)
    assert [p.text for p in root.iter("p")] == ["a", "c & d"]
    assert root.find(".//script").text == 'var t="</p>"; a<b'


def test_reviewer_blocks_per_block(spark):
    b = extract.reviewer_blocks(_pages(spark, "reviewer.html"), ["pid"]).orderBy("block_pos").collect()
    assert [r.media_kind for r in b] == ["app", "book", "app"]
    assert [r.item_id for r in b] == ["1186623793", "1173051209", "628228162"]
    # the book has no version button: NULL there, later blocks keep their own version
    assert [r.version for r in b] == ["1.0", None, "5.3.0"]
    assert [r.rating for r in b] == ["5", "1", "4"]
    assert b[0].release == "Released Dec 23, 2016" and b[0].release_date == dt.date(2016, 12, 23)
    assert b[0].review_date == dt.date(2016, 12, 29) and b[0].genre == "Games"
    assert b[0].developer_id == "915442726" and b[0].review_text == "Fun & easy to play"


def test_reviewer_page_fields(spark):
    r = extract.reviewer_pages(_pages(spark, "reviewer.html", "no_reviews.html"), ["pid"]).collect()
    assert len(r) == 1  # the no-reviews dialog has no title block -> no row
    assert (r[0].reviewer_name, r[0].page, r[0].n_pages, r[0].n_apps, r[0].is_leaf) == ("Ronlange", 1, 11, 3, False)


def test_task_job_page(spark):
    r = extract.task_job_pages(_pages(spark, "job_page.html", "job_stopped.html"), ["pid"]).collect()
    assert len(r) == 1
    r = r[0]
    assert r.name == "Amazon review for dog wheelchair" and r.id == "22795"
    assert (r.work_done, r.work_total, r.payment, r.duration) == (12, 100, 0.5, 15)
    assert r.countries == ["United", "States", "Canada"]
    assert r.expected[0].startswith("Buy the Large Dog Wheelchair")


def test_job_list_records(spark):
    p = spark.createDataFrame([("http://rapidworkers.com/Jobs", _read("job_list.html"))], "url string, html string")
    r = embedded.job_list_records(p).orderBy("id").collect()
    assert [x.id for x in r] == ["22527", "22795"]
    assert r[0].featured is True and r[0].name == "★ Simple Sign Up ★" and r[1].work_done == 42
    assert r[1].job_url == "http://rapidworkers.com/JobDetails/5791a448-d1c8"


def test_app_lookup(spark):
    b = spark.createDataFrame([(_read("lookup.json"), None), ('{"resultCount":0,"results":[]}', "1")],
                              "body string, referrer string")
    r = embedded.app_lookup_rows(b).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.id, r.developer_id, r.iphone, r.ipad, r.osx, r.label) == ("628228162", "628228165", 1, 1, 0, "paid-app")
    assert (r.enabled, r.rating_count_for_cur_version, r.release_notes) == (0, 0, "0")


def test_review_feed(spark):
    f = spark.createDataFrame([("628228162", _read("review_feed.xml"))], "app_id string, body string")
    r = feeds.review_feed_rows(f).orderBy("position").collect()
    assert [x.id for x in r] == ["1536823744", "1536800001"]  # entry 0 (the app) skipped
    assert (r[0].reviewer_id, r[0].rating, r[0].vote, r[0].version, r[0].comment) == ("286496943", 5, 3, "5.3.0", "Got home safe.")
    assert r[0].n_pages == 10 and r[0].updated == dt.datetime(2016, 12, 6, 17, 0, 0)


def test_chart_feed(spark):
    f = spark.createDataFrame([("us", "topgrossingapplications", "6014", _read("chart_feed.xml"))],
                              "country string, list_name string, genre string, body string")
    r = feeds.chart_rows(f, limit=2).orderBy("rank").collect()
    assert [(x.rank, x.id) for x in r] == [(1, "529479190"), (2, "667728512")]
    assert r[0].feed_title == "iTunes Store: Top Grossing"


def test_seed_csv_trailing_blanks_and_missing_name(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "side.csv")
    with open(p, "w") as f:
        f.write("Platform,ID\nApp store,890693434\nApp store,897518193 \nGoogle Play,com.x\n")
    s = seeds.read_seed_csv(spark, p, seeds.APP_SEED_SCHEMA)
    assert [r.ID for r in s.collect()] == ["890693434", "897518193", "com.x"]
    assert [r.app_id for r in seeds.app_store_seeds(s, "Platform", "ID").orderBy("app_id").collect()] == \
        ["890693434", "897518193"]
    q = os.path.join(tmpdir_path, "product_seeds.csv")
    with open(q, "w") as f:
        f.write("TYPE,ID\np,B00VMGSHIS\n")
    r = seeds.read_seed_csv(spark, q, seeds.PRODUCT_SEED_SCHEMA).collect()[0]
    assert (r.TYPE, r.ID, r.NAME) == ("p", "B00VMGSHIS", None)


def test_page_fields_one_pass(spark):
    r = page_fields(_pages(spark, "reviewer.html"), ["pid"]).collect()[0]
    assert r.n_links == 7 and r.n_paragraphs == 3 and r.title is None
    assert r.h1 is None and r.n_ads == 0
    x = spark.createDataFrame([(1, '<html lang="de"><title>A &amp B</title><h1>x<b>y</b></h1><div class="ad x">')],
                              "pid int, html string")
    r = page_fields(x, ["pid"]).collect()[0]
    assert (r.title, r.h1, r.lang, r.n_ads) == ("A & B", "xy", "de", 1)
    assert F is not None


def test_mw_list_job_user(spark):
    rows = extract.mw_list_rows(_pages(spark, "mw_list.html"), ["pid"]).orderBy("row_pos").collect()
    assert [(r.job_url, r.success_pct_text) for r in rows] == [
        ("http://microworkers.com/jobs_details.php?Id=101", "95.5"),
        ("http://microworkers.com/jobs_details.php?Id=102", "N/A")]
    job = spark.createDataFrame([(1, "https://play.google.com/store/apps/details?id=com.foo.app", _read("mw_job.html"))],
                                "pid int, app_url string, html string")
    j = extract.mw_job_pages(job, ["pid"], app_url_col="app_url").collect()[0]
    assert (j.name, j.id, j.work_done, j.payment, j.duration, j.work_total) == \
        ("Write a review for our app", "5a1b2c", 12, 0.3, 5, 200)
    assert j.employer == "emp77" and j.countries == ["United States\nCanada"] and j.category == "Mobile Applications (Android)"
    assert j.expected[0].startswith("Install") and j.proof == ["Screenshot of the review"]
    assert (j.app_platform, j.app_id) == ("Google Play", "com.foo.app")
    u = extract.mw_user_pages(_pages(spark, "mw_user.html"), ["pid"]).collect()[0]
    assert (u.name, u.id, u.country, u.total_earned, u.tasks_done) == ("bob", "u55", "United States", 12.5, 40)
    assert (u.basic_satisfied, u.basic_not_satisfied, u.hg_tasks, u.hg_satisfied) == (28, 2, 10, 9)
    assert (u.basic_tasks_paid, u.basic_total_paid, u.hg_tasks_paid, u.hg_total_paid) == (100, None, 7, 1.75)
    assert u.employer_type == "Basic employer" and u.city is None
