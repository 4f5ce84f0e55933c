"""Plan-shape checks for the scale properties the operators promise."""

import contextlib
import io
import os
import re

from pyspark.sql import functions as F

from conftest import SMOKE
from snapweave.operators import history as H
from snapweave.operators import ranks as K
from snapweave.plans import keyed, text


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_k_limits_before_shuffle(spark):
    p = spark.read.parquet(f"{SMOKE}/part.parquet")
    head = _plan(K.top_k(p, ["p_type"], [F.col("p_retailprice").desc()], 5)).split("\n\n")[0]
    tree = head[head.index("Exchange"):]
    assert "WindowGroupLimit" in tree  # a partial limit sits below the exchange


def test_delta_one_full_exchange_on_id_and_bucket(spark):
    txt = _plan(keyed.snapshot_delta(spark, SMOKE))
    parts = re.findall(r"hashpartitioning\(([^)]*)\)", txt)
    full = [p for p in parts if "bk" in p and "key" not in p]
    assert full and all(re.match(r"id#\d+, bk#\d+", p) for p in full)
    assert "CartesianProduct" not in txt and "NestedLoop" not in txt


def test_contains_join_is_not_a_nested_loop(spark):
    txt = _plan(text.contains_join(spark, SMOKE))
    assert "NestedLoop" not in txt and "CartesianProduct" not in txt
    assert not re.search("Python|Pandas|Arrow", txt)  # built-in functions only


def test_scans_prune_columns(spark):
    txt = _plan(keyed.anti_insert(spark, SMOKE))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
    li = [s for s in schemas if "l_orderkey" in s][0]
    assert li.count(":") == 4  # only the four columns the query uses
    assert "GreaterThan(p_size,25)" in txt  # the filter reaches the scan


def test_no_local_checkpoint_in_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "snapweave")
    for dp, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(dp, f)).read(), f
    assert H.DAY == 86400
