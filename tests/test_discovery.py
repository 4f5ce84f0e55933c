import os

from conftest import FIXTURES
from snapweave.plans.discovery import paid_review_tasks


def _read(name):
    with open(os.path.join(FIXTURES, "pages", name), encoding="utf-8") as f:
        return f.read()


AMAZON_JOB = """<html><body><div id="jobdetails">
<div><ul><li>Done 1 of 10</li><li>Pay 0.10</li><li>3 minutes</li></ul><ul><li>Campaign Name : Amazon review task</li><li>Campaign ID : 555</li></ul></div>
<div><ul><li>USA</li></ul></div><h3>What is expected from workers</h3>
<p>Open https://www.amazon.com/gp/product/glance/B0GLANCE1 and leave a review
<p>Also goo.gl/Ab12 and www.amazon.com/review/R9XYZ
</div></body></html>"""


def test_paid_review_tasks(spark):
    pages = spark.createDataFrame([("http://rw/job/1", _read("job_page.html")), ("http://rw/job/2", AMAZON_JOB),
                                   ("http://rw/job/3", _read("job_stopped.html"))], "url string, html string")
    seeds = spark.createDataFrame([("p", "B00DOG", "Large Dog Wheelchair"), ("p", "B00CAT", "Cat Tower"),
                                   ("p", "B00EMPTY", "")], "TYPE string, ID string, NAME string")
    resolved = spark.createDataFrame([("https://www.goo.gl/Ab12", "https://www.amazon.com/dp/B0SHORT")],
                                     "short_url string, final_url string")
    got = paid_review_tasks(pages, seeds, resolved, crawl_ts="2016-08-12 00:00:00").collect()
    rows = sorted((r.id, r.jobType, r.amazonId) for r in got)
    # job 22795: the document link matches the dog wheelchair seed;
    # job 555: first link (glance fixed) is stored, later links share the task id
    assert rows == [("22795", "p", "B00DOG"), ("555", "p", "B0GLANCE1")]
    existing = spark.createDataFrame([("555", "X")], "id string, amazonId string")
    rows2 = sorted((r.id, r.amazonId) for r in paid_review_tasks(pages, seeds, resolved, existing).collect())
    assert rows2 == [("22795", "B00DOG")]
