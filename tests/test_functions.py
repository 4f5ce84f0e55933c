from urllib.parse import urljoin

from pyspark.sql import functions as F

from snapweave.functions import processors as P
from snapweave.functions import regexes as R
from snapweave.functions import urls as U
from snapweave.operators import filters as D


# fixed values: the original crawler's patterns, to compare with
AMAZON_URLS = r"(?:((https?://)?[\w\d?./=_-]+))"
PRODUCT_ID_ORIGINAL = r"(?:(?:/gp/product/)|(?:/gp/product/glance/)|(?:/dp/))(\w+)"


def _one(spark, col, data=None, schema="x string"):
    df = spark.createDataFrame(data or [(None,)], schema)
    return df.select(col.alias("r")).collect()


def test_strip_like_python(spark):
    vals = ["  a b\t\n", "　x ", "plain", "", None]
    got = [r.r for r in _one(spark, P.py_strip("x"), [(v,) for v in vals])]
    assert got == [v.strip() if v is not None else None for v in vals]


def test_array_processors(spark):
    df = spark.createDataFrame([([" a ", "", None, "b "],)], "a array<string>")
    r = df.select(P.join_clean("a").alias("j"), P.filter_empty(P.strip_each("a")).alias("f"),
                  P.only_elem(F.array(F.lit("x"))).alias("one"), P.only_elem("a").alias("bad"),
                  P.only_elem_or_default(F.array().cast("array<string>"), F.lit("d")).alias("dflt"),
                  P.elem_count_error("a", "name").alias("err")).collect()[0]
    assert r.j == "a b" and r.f == ["a", "b"] and r.one == "x" and r.bad is None and r.dflt == "d"
    assert r.err == "name: 4 elements"


def test_casts_and_single_value(spark):
    df = spark.createDataFrame([("12", "12.5", "N/a", "3.5", "")], "a string, b string, c string, d string, e string")
    r = df.select(P.to_long("a").alias("a"), P.to_long("b").alias("b"), P.na_to_double("c").alias("c"),
                  P.na_to_double("d").alias("d"), P.blank_na_to_double("e").alias("e"),
                  P.single_value(F.lit("first"), F.lit(""), F.lit(None).cast("string")).alias("s"),
                  P.single_value(F.lit("first"), F.lit("0")).alias("z")).collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e, r.s, r.z) == (12, None, None, 3.5, None, "first", "0")


def test_numbers_stars_names_zip(spark):
    df = spark.createDataFrame([("done 3 of 1,234 pay 0.25 in 10 min", ["5 stars", "1 star"], "All Reviews by Ann",
                                 ["Updated ", "Released "], ["Dec 1, 2016", "Jan 2, 2017", "x"])],
                               "t string, s array<string>, n string, a array<string>, b array<string>")
    nums = P.numbers("t")
    r = df.select(nums.alias("nums"), *P.numbers_to_fields(nums, ["w", "x", "y", "z"], ["bigint"] * 4),
                  P.star_values("s").alias("stars"), P.star_values(F.array().cast("array<string>")).alias("none"),
                  P.text_after_by("n").alias("name"), P.text_after_by(F.lit("Reviews")).alias("nobody"),
                  P.zip_concat("a", "b").alias("dates")).collect()[0]
    assert r.nums == ["3", "1", "234", "0.25", "10"]
    assert (r.w, r.x, r.y, r.z) == (3, 1, 234, None)
    assert r.stars == ["5", "1"] and r.none == [] and r.name == "Ann" and r.nobody is None
    assert r.dates == ["Updated Dec 1, 2016", "Released Jan 2, 2017"]


TEXTS = ["Need ONLY PEOPLE FROM USA! https://www.amazon.com/dp/B01IKIDBO0/?ref_=x#customerReviews",
         "1. Visit this link and get a free copy: www.amazon.co.uk/dp/B00TPRVW5G",
         "2. Open the book.\r\nwww.amazon.co.uk/dp/B00TYTYPEA", "Sign up"]


def test_text_urls_and_targets(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(U.text_urls("t").alias("u")).collect()
    assert rows[0].u == ["https://www.amazon.com/dp/B01IKIDBO0/?ref_=x"]
    assert rows[1].u == ["www.amazon.co.uk/dp/B00TPRVW5G"] and rows[3].u == []
    links = spark.createDataFrame([("https://www.amazon.com/gp/product/glance/X9",), ("www.amazon.com/dp/P1/review/R7",),
                                   ("https://docs.google.com/document/d/abc",), ("goo.gl/E5478ir/dfe",),
                                   ("http://amzn.to/abc",)], "u string")
    r = links.select(U.amazon_target("u").alias("t"), U.link_kind("u").alias("k"),
                     U.short_link_url("u").alias("s")).collect()
    assert r[0].t.amazon_id == "X9" and r[0].t.job_type == "p"      # glance fixed
    assert (r[1].t.job_type, r[1].t.amazon_id) == ("m", "R7")       # review wins
    assert [x.k for x in r] == ["amazon", "amazon", "document", "short", "short"]
    assert r[3].s == "https://www.goo.gl/E5478ir/dfe" and r[4].s == "http://amzn.to/abc"
    import re
    assert re.search(PRODUCT_ID_ORIGINAL, "/gp/product/glance/X9").group(1) == "glance"


def test_app_platform_chart_and_employer(spark):
    df = spark.createDataFrame([("https://play.google.com/store/apps/details?id=com.foo.bar&hl=en",),
                                ("https://itunes.apple.com/us/app/x/id628228162?mt=8",)], "u string")
    r = df.select(U.app_platform("u").alias("p"), U.chart_id("u").alias("c"),
                  U.employer_id(F.lit("profile.php?Id=ab12")).alias("e")).collect()
    assert (r[0].p.platform, r[0].p.app_id) == ("Google Play", "com.foo.bar")
    assert (r[1].p.platform, r[1].p.app_id, r[1].c) == ("App store", "628228162", "628228162")
    assert r[0].e == "ab12"


def test_resolve_url_like_urljoin(spark):
    base = "http://a.example.com/b/c/d;p?q#f"
    hrefs = ["g", "./g", "g/", "/g", "//other.org/g", "?y", "g?y", "#s", "g#s", "../g", "../../g", "../..",
             "", "https://x.org/p", "JobDetails/5791"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = [r.r for r in df.select(U.resolve_url("b", "h").alias("r")).collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_templates(spark):
    r = spark.range(1).select(
        U.review_feed_url(F.lit("628228162"), F.lit(2)).alias("a"),
        U.developer_url(F.lit("9"), F.lit(2), F.lit(1)).alias("b"),
        U.chart_feed_url(F.lit("us"), F.lit("topfreeapplications"), F.lit(None).cast("string")).alias("c"),
        U.chart_feed_url(F.lit("us"), F.lit("topfreeapplications"), F.lit("6014")).alias("d")).collect()[0]
    assert r.a == "https://itunes.apple.com/us/rss/customerreviews/page=2/id=628228162/sortBy=mostRecent/xml"
    assert r.b == "https://itunes.apple.com/us/artist/id9?iPhoneSoftwarePage=2&iPadSoftwarePage=1"
    assert r.c == "https://itunes.apple.com/us/rss/topfreeapplications/limit=200/xml"
    assert r.d == "https://itunes.apple.com/us/rss/topfreeapplications/limit=200/genre=6014/xml"


def test_task_filters(spark):
    rows = [("Amazon review needed", ["write a comment"]),       # D1 yes
            ("Write a review", ["buy on amzn and review"]),       # amazon only in first expected: yes
            ("Write a review", ["nothing", "amazon"]),            # amazon only in 2nd expected: no
            ("Sign up", ["amazon review"]),                        # title has neither: no
            ("Rate our app", ["see https://apps.example/app1"]),  # D2 yes
            ("Rate our app", ["https://x", "app"])]               # D2 no (not in one text)
    df = spark.createDataFrame(rows, "name string, expected array<string>")
    r = df.select(D.paid_review_task("name", "expected").alias("d1"),
                  D.paid_app_review_task("name", "expected").alias("d2"),
                  D.amazon_review_cumulative(F.concat(F.array("name"), "expected")).alias("d3")).collect()
    assert [x.d1 for x in r] == [True, True, False, False, False, False]
    assert [x.d2 for x in r] == [False, False, False, False, True, False]
    assert [x.d3 for x in r] == [True, False, True, True, False, False]


def test_compile_spec(spark):
    df = spark.createDataFrame([(" 12 ", "a, b ,,c")], "n string, c string")
    out = P.compile_spec(df, {"work_done": ("n", [P.to_long]),
                              "countries": ("c", [lambda c: P.split_strip(c, ","), P.filter_empty])})
    r = out.collect()[0]
    assert r.work_done == 12 and r.countries == ["a", "b", "c"]


def test_url_token_pattern_equals_original_plus_filter():
    import re

    from hypothesis import given, settings
    from hypothesis import strategies as st
    orig, new = re.compile(AMAZON_URLS), re.compile(R.URL_TOKENS_WITH_SLASH)

    @settings(max_examples=3000, deadline=None)
    @given(st.text(alphabet="htps:/.-_a =?x\n", max_size=40))
    def check(t):
        assert [m[0] for m in orig.findall(t) if "/" in m[0]] == new.findall(t)
    check()


def test_text_variants_equal_list_filters(spark):
    rows = [("Rate our app", "see https://apps.example/app1"), ("Rate our app", "https://x\napp"),
            ("Rate", "x\nHTTPS://y/APP\r\nz"), ("Review", "Amazon\ncomment"), ("t", None), ("Feedback", "")]
    df = spark.createDataFrame(rows, "name string, txt string").withColumn("lines", F.split("txt", "\n"))
    r = df.select(D.paid_app_review_task("name", "lines").alias("a"), D.paid_app_review_text("name", "txt").alias("b"),
                  D.amazon_review_cumulative("lines").alias("c"), D.amazon_review_text("txt").alias("d")).collect()
    assert [x.a for x in r] == [x.b for x in r] == [True, False, True, False, False, False]
    assert [x.c for x in r] == [x.d for x in r] == [False, False, False, True, False, False]
