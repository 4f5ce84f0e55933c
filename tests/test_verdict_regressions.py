"""Regressions: results must not depend on file layout, size, NULLs or odd names."""

import datetime as dt
import os

from pyspark.sql import functions as F

from snapweave.functions.processors import text_after_by
from snapweave.operators import dedupe, graph, merge
from snapweave.plans import keyed, streams as plans_streams
from snapweave.plans.consolidate import consolidated_lines
from snapweave.sources.snapshots import read_snapshot_lines
from snapweave.streaming import streams as S

SMOKE = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_stream_delta_does_not_depend_on_files(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    ev.orderBy(F.xxhash64("event_id")).repartition(40).write.parquet(f"{tmpdir_path}/events.parquet")
    want = _rows(keyed.snapshot_delta(spark, SMOKE))
    assert _rows(plans_streams.stream_delta(spark, tmpdir_path)) == want
    assert _rows(plans_streams.stream_delta(spark, SMOKE)) == want


def test_consolidation_of_file_names_with_blanks(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "spider a")
    os.makedirs(folder)
    for i in range(3):
        path = os.path.join(folder, f"job-2016-08-12 00-00-0{i}+x.json")
        with open(path, "w") as f:
            f.write('{"id": "j", "timestamp": "2016-08-12 00:00:0%d", "work_done": %d}\n' % (i, i))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    lines = consolidated_lines(spark, tmpdir_path, ["job"]).collect()
    assert [r.n_entries for r in lines] == [2]
    paths = [os.path.join(folder, f"job-2016-08-12 00-00-0{i}+x.json") for i in (2, 0)]
    ranks = {r.value[-2]: r.seq.file_rank for r in read_snapshot_lines(spark, paths).collect()}
    assert ranks == {"2": 0, "0": 1}


def test_first_upsert_batch_is_deduplicated(spark, tmpdir_path):
    run = S.upsert_batches(f"{tmpdir_path}/t", ["k"])
    run(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int"), 0)
    assert _rows(S.latest_version(spark, f"{tmpdir_path}/t")) == [("x", 2), ("y", 3)]


def test_developer_with_empty_list_stays(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, [], t), (2, [5], t)], "d int, a array<int>, ts timestamp")
    assert {(r.d, tuple(r.app_ids), r.n_apps) for r in merge.merge_developers(df, "d", "a", "ts").collect()} == {(1, (), 0), (2, (5,), 1)}


def test_two_captures_of_related_apps_keep_one_row(spark):
    apps = spark.createDataFrame([(1,), (2,)], "id int")
    rel = spark.createDataFrame([(1, [7]), (1, [7, 8])], "id int, related_ids array<int>")
    assert _rows(merge.attach_related(apps, rel)) == [(1, [7, 8]), (2, None)]


def test_null_page_count_plans_one_page(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "id int, n int")
    assert _rows(df.select("id", graph.page_numbers("n", "app").alias("p"))) == [(1, 1), (2, 1), (2, 2), (2, 3)]


def test_reviewer_name_across_lines(spark):
    r = spark.createDataFrame([("Good app\n by\nby Ann \n",), ("none",)], "t string").select(text_after_by("t").alias("n")).collect()
    assert [x.n for x in r] == ["Ann", None]


def test_either_key_new_keeps_rows_with_a_null_key(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "A", 2), (1, "A", 3), (None, "A", 4), (2, "A", 5)], "k1 int, k2 string, o int")
    assert sorted(r.o for r in dedupe.either_key_new(df, "k1", "k2", ["o"]).collect()) == [1, 2, 4, 5]


def test_app_flags_and_labels_take_several_values(spark):
    from conftest import SMOKE
    from snapweave.plans.apps import flags_labels

    rows = flags_labels(spark, SMOKE).collect()
    for c in ("rating_count", "iphone", "ipad", "osx", "label", "app_types", "first_type", "work_done"):
        assert len({r[c] for r in rows}) > 1, c


def test_employer_id_by_site(spark):
    from snapweave.functions import regexes as R
    from snapweave.functions import urls as U
    link = F.lit("x?jobid=3&Id=9")
    assert tuple(spark.range(1).select(U.employer_id(link), U.employer_id(link, R.SITE_ID)).first()) == ("9", "3")


def test_resolved_links_take_product_ids_only(spark):
    from snapweave.functions import urls as U
    r = spark.range(1).select(U.product_target(F.lit("https://a/review/R1")).alias("a"), U.product_target(F.lit("https://a/dp/B1")).alias("b")).first()
    assert r.a is None and tuple(r.b) == ("p", "B1")


def test_nested_lists_and_old_tables_keep_their_nesting():
    from snapweave.sources.html import html_to_xhtml
    assert html_to_xhtml("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == "<root><ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul></root>"
    assert html_to_xhtml("<table><tr><td>1<td>2<tr><td>3<table><tr><td>4</table></table>") == (
        "<root><table><tr><td>1</td><td>2</td></tr><tr><td>3<table><tr><td>4</td></tr></table></td></tr></table></root>")
    assert html_to_xhtml("<p>a<p>b<table><tr><td><p>c<td>d</table>").count("</p>") == 3


def test_developer_rules_along_the_pages(spark):
    from snapweave.sources.extract import developer_pages
    box = lambda kind, *ids: f'<div metrics-loc="Titledbox_{kind} Apps">' + "".join(f'<a class="artwork-link" href="/id{i}">x</a>' for i in ids) + "</div>"
    rows = [("d", 2, "9", box("iPhone", 3) + box("iPad", 7)), ("d", 1, "9", '<h1 itemprop="name">Dev</h1>' + box("iPhone", 1) + box("iPad", 7)),
            ("d", 3, "9", box("iPhone", 4) + box("iPad", 8)), ("e", 1, "5", box("Mac", 5)), ("f", 1, "6", box("Mac", 5))]
    pages = spark.createDataFrame(rows, "dev string, page int, ref string, html string")
    got = {(r.dev, r.page): r for r in developer_pages(pages, ["dev", "page"], referrer_col="ref", along=("dev", "page")).collect()}
    assert [got["d", p].app_ids for p in (1, 2, 3)] == [["1", "7"], ["3"], ["4", "8"]]
    assert [got["d", p].same_ipad_as_before for p in (1, 2, 3)] == [False, True, False] and got["d", 1].name == "Dev"
    assert got["e", 1].is_leaf and got["e", 1].app_types == ["Mac Apps"] and not got["f", 1].is_leaf


def test_task_and_lookup_rules_meet_several_outcomes(spark):
    from snapweave.plans import tasks
    for name, keys in (("task_texts", {"p_partkey"}), ("code_requests", {"c_custkey"}), ("developer_page_rule", {"l_suppkey", "page"})):
        rows = tasks.QUERIES[name](spark, SMOKE)
        counts = rows.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("NULL"))).alias(c) for c in rows.columns if c not in keys]).first()
        assert all(n >= 2 for n in counts), (name, counts)
