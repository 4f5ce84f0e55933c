"""App-store entity queries bound to the driver tables.

Mapping: ``part`` rows are apps (type = kind, brand = developer label, size
and price as attributes), ``supplier`` rows developers, ``customer`` rows
reviewers; ``lineitem`` (+ ``orders``) links them: a line item is a review of
an app (part) by a reviewer (the order's customer) for a developer (supplier).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import urls as U
from ..operators import graph as G
from ..operators import ranks as K
from ..operators.joins import checked_broadcast, enrich
from ..session import read_table
from ..sources import embedded as M
from ..sources import extract as X

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def rank_first_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts are the top-200 apps by price of every kind (priority 0) and of
    every brand (priority 1), ordered by name within a priority; each app
    gets its rank in the first chart that lists it (A8/F3/F4/I3/I4/H3)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    # each app is a candidate of two charts; one scan, one top-k over all charts
    member = F.explode(F.array(
        F.struct(F.concat(F.lit("type:"), "p_type").alias("list_name"), F.lit(0).alias("kind_priority")),
        F.struct(F.concat(F.lit("brand:"), "p_brand").alias("list_name"), F.lit(1).alias("kind_priority"))))
    candidates = p.select("p_partkey", "p_retailprice", member.alias("m")).select("p_partkey", "p_retailprice", "m.*")
    charts = (K.top_k(candidates, ["list_name"], order)
              .withColumn("priority", F.struct("kind_priority", "list_name")))
    r = K.first_list_rank(p.select("p_partkey"), "p_partkey", charts)
    return r.select("p_partkey", "list_name", F.col("rank").cast("bigint").alias("rank"))


def flags_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item processors on app rows (C10-C13, C20). Stand-in input: economy
    parts are desktop apps; an app's referrer is its smallest supplier with a
    line item of 48 pieces or more (none: a seed) and its rating count the
    number of such items (none: missing); size and demand give the app lists
    its page shows; open line items are open work."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    big = F.col("l_quantity") >= 48
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_partkey")
          .agg(F.min(F.when(big, F.col("l_suppkey"))).alias("referrer"),
               F.sum(F.when(big, 1)).alias("rating_count"),
               F.count(F.lit(1)).alias("work_total"),
               F.count_if(F.col("l_linestatus") == "O").alias("work_open")))
    j = p.join(li, p.p_partkey == li.l_partkey, "left")
    kind = F.when(F.col("p_type") == "ECONOMY", F.lit(C.MAC_KIND)).otherwise(F.lit("software"))
    types = X.app_types([F.col("p_size") <= 10, F.col("p_size").between(11, 25),
                         F.col("p_size").between(21, 40), F.col("work_total") > 40])
    return j.select(
        "p_partkey",
        M.counter(F.col("rating_count")).cast("bigint").alias("rating_count"),
        *M.platform_flags(kind),
        M.referrer_label(F.col("referrer")).alias("label"),
        F.array_join(types, ",").alias("app_types"),
        X.single_app_type(types).alias("first_type"),
        (F.coalesce("work_total", F.lit(0)) - F.coalesce("work_open", F.lit(0))).cast("bigint").alias("work_done"))


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name/code lookups against small dimensions with an invalid guard
    (C23): customer nation -> name -> region; unmatched rows flagged."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(checked_broadcast(r, ["r_name"]), n.n_regionkey == r.r_regionkey, "left")
    j = c.join(checked_broadcast(nr, ["n_name", "r_name"]), c.c_nationkey == nr.n_nationkey, "left")
    return j.select("c_custkey", "n_name", "r_name",
                    (F.col("n_name").isNotNull() & F.col("r_name").isNotNull()).cast("int").alias("valid"))


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two sources with different fields in one table (J1/C9/J5):
    item type tag, key, missing columns as NULL."""
    c = read_table(spark, sf_dir, "customer").select(
        F.lit("reviewer").alias("item_type"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"))
    s = read_table(spark, sf_dir, "supplier").select(
        F.lit("developer").alias("item_type"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True)


def list_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List rows (orders) carry list-only attributes to their detail rows
    (line items) by key (F2); a list row without details is kept."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                                       "l_linenumber", "l_quantity")
    return enrich(o, li, "o_orderkey", "left")


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up page requests (E2/E3/D8/C22): reviewers page through their
    orders (max 30 pages), apps through their reviews at 50 per page (max
    10), developers by the iPhone/iPad pager rule (open and finished line
    item orders as the two pagers, max 5)."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    rev = (o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
           .select(F.lit("reviewer").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"),
                   G.page_numbers("n", "reviewer").alias("page")))
    rev = rev.select("entity_type", "entity_id", "page", U.reviewer_url("entity_id", "page").alias("url"))
    app = (li.groupBy("l_partkey").agg(F.ceil(F.count(F.lit(1)) / 50).alias("n"))
           .select(F.lit("app").alias("entity_type"), F.col("l_partkey").cast("string").alias("entity_id"),
                   G.page_numbers("n", "app").alias("page")))
    app = app.select("entity_type", "entity_id", "page", U.review_feed_url("entity_id", "page").alias("url"))
    dev = (li.groupBy("l_suppkey")
           .agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("n_ip"),
                F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey"))).alias("n_ipad")))
    dev = G.developer_pages(dev.withColumn("l_suppkey", F.col("l_suppkey").cast("string")),
                            "l_suppkey", "n_ip", "n_ipad")
    dev = dev.select(F.lit("developer").alias("entity_type"), "entity_id", "page", "url")
    return rev.unionByName(app).unionByName(dev).withColumn("page", F.col("page").cast("bigint"))


def consecutive_same_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous-page comparison (H4): a turn whose role equals the previous
    turn's role (page n vs n - 1 of the same conversation). Pages are numbered
    consecutively, so this is an equi-join on (conv_id, turn - 1): a hot
    conversation spreads over partitions instead of one window task."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("_prev_role"),
                    F.lit(True).alias("_has_prev"))
    j = c.join(prev, ["conv_id", "turn"], "left")
    same = F.coalesce(F.col("_has_prev"), F.lit(False)) & F.col("role").eqNullSafe(F.col("_prev_role"))
    return j.select("conv_id", "turn", "role", same.cast("int").alias("same_as_prev"))


def _app_graph(spark: SparkSession, sf_dir: str):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # one join gives all four kinds; repeated pairs are harmless to the expansion
    # (the per-node min collapses them), so there is no distinct shuffle
    rows = li.join(o, li.l_orderkey == o.o_orderkey)

    def edge(kind, src_type, src, dst_type, dst):
        return F.struct(F.lit(src_type).alias("src_type"), F.col(src).alias("src_id"), F.lit(dst_type).alias("dst_type"),
                        F.col(dst).alias("dst_id"), F.lit(kind).alias("kind"))
    edges = rows.select(F.explode(F.array(
        edge("app_developer", "app", "l_partkey", "developer", "l_suppkey"),
        edge("developer_app", "developer", "l_suppkey", "app", "l_partkey"),
        edge("review_reviewer", "app", "l_partkey", "reviewer", "o_custkey"),
        edge("reviewer_app", "reviewer", "o_custkey", "app", "l_partkey"))).alias("e")).select("e.*")
    seeds = (read_table(spark, sf_dir, "part").where(F.col("p_type") == "PROMO")
             .select(F.lit("app").alias("node_type"), F.col("p_partkey").alias("node_id")))
    return seeds, edges


def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-bounded expansion (K1-K4, E4, D9): seeds are the promoted apps;
    edges app<->developer and app<->reviewer come from the reviews; every
    reached node with its depth (<= 3), referrer, and whether it may still
    be paged (not at the last level)."""
    seeds, edges = _app_graph(spark, sf_dir)
    nodes = G.bounded_bfs(seeds, edges, U.DEPTH_LIMIT)
    return nodes.select("node_type", F.col("node_id").cast("string").alias("node_id"),
                        F.col("depth").cast("bigint").alias("depth"),
                        F.concat_ws(":", "referrer.node_type", "referrer.node_id").alias("referrer"),
                        (F.col("depth") < U.DEPTH_LIMIT).cast("int").alias("may_page"))


def depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl depth statistics of the bounded expansion."""
    seeds, edges = _app_graph(spark, sf_dir)
    return G.depth_stats(G.bounded_bfs(seeds, edges, U.DEPTH_LIMIT)).withColumn("depth", F.col("depth").cast("bigint"))


def lineage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reached node with its path from a seed (K4): referrers followed back by pointer doubling."""
    seeds, edges = _app_graph(spark, sf_dir)
    paths = G.lineage_paths(G.bounded_bfs(seeds, edges, U.DEPTH_LIMIT))
    step = F.transform("path", lambda x: F.concat_ws(":", x["node_type"], x["node_id"].cast("string")))
    return paths.select("node_type", F.col("node_id").cast("string").alias("node_id"),
                        F.size("path").cast("bigint").alias("n_steps"), F.array_join(step, ">").alias("path"))


def paged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page requests of the expansion over (type, id, page) with leaf rules (K1, D8, D9, D11): parts are apps, suppliers
    their developers, orders the reviewers; a line item stands on a page of each of the three."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

    def link(src_type, src, page, dst_type, dst):
        return F.struct(F.lit(src_type).alias("src_type"), F.col(src).alias("src_id"), page.cast("bigint").alias("src_page"),
                        F.lit(dst_type).alias("dst_type"), F.col(dst).alias("dst_id"))
    line = F.col("l_linenumber")
    feed_page = line + F.col("l_orderkey") % 7
    links = li.select(F.explode(F.array(
        link("app", "l_partkey", feed_page, "developer", "l_suppkey"),
        link("app", "l_partkey", feed_page, "reviewer", "l_orderkey"),
        link("reviewer", "l_orderkey", 5 * line - 4, "app", "l_partkey"),
        link("developer", "l_suppkey", line, "app", "l_partkey"))).alias("e")).select("e.*")
    seeds = (read_table(spark, sf_dir, "part").where(F.col("p_type") == "PROMO")
             .select(F.lit("app").alias("node_type"), F.col("p_partkey").alias("node_id")))
    r = G.paged_expansion(seeds, links)
    return r.select("node_type", F.col("node_id").cast("string").alias("node_id"), "page", F.col("depth").cast("bigint").alias("depth"),
                    F.col("is_leaf").cast("int").alias("is_leaf"))


QUERIES = {
    "rank_first_list": rank_first_list,
    "flags_labels": flags_labels,
    "code_lookup": code_lookup,
    "union_sources": union_sources,
    "list_detail_join": list_detail_join,
    "page_plan": page_plan,
    "consecutive_same_page": consecutive_same_page,
    "bounded_bfs": bounded_bfs,
    "depth_stats": depth_stats,
    "lineage_paths": lineage_paths,
    "paged_requests": paged_requests,
}

_GRAPH = """
rv AS (SELECT l.l_partkey, l.l_suppkey, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
edges AS (
  SELECT DISTINCT 'app' AS st, l_partkey AS si, 'developer' AS dt, l_suppkey AS di FROM rv
  UNION SELECT DISTINCT 'developer', l_suppkey, 'app', l_partkey FROM rv
  UNION SELECT DISTINCT 'app', l_partkey, 'reviewer', o_custkey FROM rv
  UNION SELECT DISTINCT 'reviewer', o_custkey, 'app', l_partkey FROM rv),
walk(t, i, depth) AS (
  SELECT 'app', p_partkey, 0 FROM part WHERE p_type = 'PROMO'
  UNION
  SELECT e.dt, e.di, w.depth + 1 FROM walk w JOIN edges e ON e.st = w.t AND e.si = w.i WHERE w.depth < 3),
best AS MATERIALIZED (SELECT t, i, min(depth) AS depth FROM walk GROUP BY t, i)
"""

_REFS = """
refs AS MATERIALIZED (
  SELECT b.t, b.i, min((p.t, p.i)) AS r FROM best b
  JOIN edges e ON e.dt = b.t AND e.di = b.i
  JOIN best p ON p.t = e.st AND p.i = e.si AND p.depth = b.depth - 1
  WHERE b.depth > 0 GROUP BY b.t, b.i)
"""

ORACLE = {
    "rank_first_list": """
WITH charts AS (
  SELECT p_partkey, 'type:' || p_type AS list_name, 0 AS kp,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rnk FROM part
  UNION ALL
  SELECT p_partkey, 'brand:' || p_brand, 1,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) FROM part),
top AS (SELECT * FROM charts WHERE rnk <= 200),
best AS (SELECT p_partkey, arg_min(list_name, (kp, list_name, rnk)) AS list_name,
                arg_min(rnk, (kp, list_name, rnk)) AS rnk FROM top GROUP BY p_partkey)
SELECT p.p_partkey, b.list_name, b.rnk::BIGINT AS rank FROM part p LEFT JOIN best b USING (p_partkey)
""",
    "flags_labels": """
WITH li AS (SELECT l_partkey, min(l_suppkey) FILTER (WHERE l_quantity >= 48) AS referrer,
                   count(*) FILTER (WHERE l_quantity >= 48) AS rating_count, count(*) AS work_total,
                   count(*) FILTER (WHERE l_linestatus = 'O') AS work_open FROM lineitem GROUP BY l_partkey),
j AS (SELECT p.p_partkey, p.p_type, p.p_size, li.* FROM part p LEFT JOIN li ON p.p_partkey = li.l_partkey),
t AS (SELECT *, list_filter([CASE WHEN p_size <= 10 THEN 'iPhone Apps' END,
                             CASE WHEN p_size BETWEEN 11 AND 25 THEN 'iPad Apps' END,
                             CASE WHEN p_size BETWEEN 21 AND 40 THEN 'Mac Apps' END,
                             CASE WHEN work_total > 40 THEN 'App Bundles' END], lambda x: x IS NOT NULL) AS types FROM j)
SELECT p_partkey, coalesce(rating_count, 0)::BIGINT AS rating_count,
  (p_type IS DISTINCT FROM 'ECONOMY')::INT AS iphone, (p_type IS DISTINCT FROM 'ECONOMY')::INT AS ipad,
  (p_type IS NOT DISTINCT FROM 'ECONOMY')::INT AS osx,
  CASE WHEN referrer IS NULL THEN 'paid-app' ELSE 'unknown-app' END AS label,
  array_to_string(types, ',') AS app_types, coalesce(types[1], 'App Bundles') AS first_type,
  (coalesce(work_total, 0) - coalesce(work_open, 0))::BIGINT AS work_done
FROM t
""",
    "code_lookup": """
SELECT c.c_custkey, n.n_name, r.r_name, (n.n_name IS NOT NULL AND r.r_name IS NOT NULL)::INT AS valid
FROM customer c LEFT JOIN (nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey
""",
    "union_sources": """
SELECT 'reviewer' AS item_type, c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS segment FROM customer
UNION ALL BY NAME
SELECT 'developer' AS item_type, s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier
""",
    "list_detail_join": """
SELECT o.o_orderkey, o.o_orderpriority, o.o_custkey, l.l_linenumber, l.l_quantity
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""",
    "page_plan": """
WITH rv AS (SELECT o_custkey::VARCHAR AS entity_id, count(*) AS n FROM orders GROUP BY o_custkey),
ap AS (SELECT l_partkey::VARCHAR AS entity_id, ceil(count(*) / 50)::BIGINT AS n FROM lineitem GROUP BY l_partkey),
dv AS (SELECT l_suppkey::VARCHAR AS entity_id,
         count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS ip,
         count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) AS ipad FROM lineitem GROUP BY l_suppkey),
dv2 AS (SELECT entity_id, CASE WHEN ip >= 5 THEN ip - 1 ELSE ip END AS ipn,
               CASE WHEN ipad >= 5 THEN ipad - 1 ELSE ipad END AS ipadn FROM dv)
SELECT 'reviewer' AS entity_type, entity_id, g.page::BIGINT AS page,
  printf('https://itunes.apple.com/WebObjects/MZStore.woa/wa/viewUsersUserReviews?userProfileId=%s&page=%d&sort=14', entity_id, g.page) AS url
FROM rv, LATERAL (SELECT unnest(generate_series(1, greatest(least(n, 30), 1))) AS page) g
UNION ALL
SELECT 'app', entity_id, g.page::BIGINT,
  printf('https://itunes.apple.com/%s/rss/customerreviews/page=%d/id=%s/sortBy=%s/xml', 'us', g.page, entity_id, 'mostRecent')
FROM ap, LATERAL (SELECT unnest(generate_series(1, greatest(least(n, 10), 1))) AS page) g
UNION ALL
SELECT 'developer', entity_id, g.page::BIGINT,
  printf('https://itunes.apple.com/us/artist/id%s?iPhoneSoftwarePage=%d&iPadSoftwarePage=%d', entity_id, g.page,
         CASE WHEN ipadn = 0 OR ipn > ipadn THEN 1 ELSE g.page END)
FROM dv2, LATERAL (SELECT unnest(generate_series(1, greatest(least(ipn, 5), 1))) AS page) g
""",
    "consecutive_same_page": """
SELECT c.conv_id, c.turn, c.role,
  (p.turn IS NOT NULL AND c.role IS NOT DISTINCT FROM p.role)::INT AS same_as_prev
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
""",
    "bounded_bfs": f"""
WITH RECURSIVE {_GRAPH}, {_REFS}
SELECT b.t AS node_type, b.i::VARCHAR AS node_id, b.depth::BIGINT AS depth,
  coalesce(refs.r[1] || ':' || refs.r[2]::VARCHAR, '') AS referrer, (b.depth < 3)::INT AS may_page
FROM best b LEFT JOIN refs ON refs.t = b.t AND refs.i = b.i
""",
    "lineage_paths": f"""
WITH RECURSIVE {_GRAPH}, {_REFS},
path(t, i, n, p) AS (
  SELECT t, i, 1, t || ':' || i::VARCHAR FROM best WHERE depth = 0
  UNION ALL SELECT r.t, r.i, n + 1, p || '>' || r.t || ':' || r.i::VARCHAR FROM path JOIN refs r ON r.r = (path.t, path.i))
SELECT t AS node_type, i::VARCHAR AS node_id, n::BIGINT AS n_steps, p AS path FROM path
""",
    "paged_requests": """
WITH RECURSIVE ln AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
links AS (
  SELECT 'app' AS st, p AS si, n + o % 7 AS pg, 'developer' AS dt, s AS di FROM ln
  UNION ALL SELECT 'app', p, n + o % 7, 'reviewer', o FROM ln
  UNION ALL SELECT 'reviewer', o, 5 * n - 4, 'app', p FROM ln
  UNION ALL SELECT 'developer', s, n, 'app', p FROM ln),
ent AS MATERIALIZED (
  SELECT st AS t, si AS i, max(pg) AS np, count(DISTINCT di) = 1 AS one, CASE st WHEN 'app' THEN 10 WHEN 'developer' THEN 5 ELSE 30 END AS cap
  FROM links GROUP BY st, si),
edges AS MATERIALIZED (
  SELECT DISTINCT l.st, l.si, l.dt, l.di FROM links l JOIN ent e ON e.t = l.st AND e.i = l.si
  WHERE l.pg <= e.cap AND NOT (e.t = 'reviewer' AND e.np = 1 AND e.one)),
walk(t, i, depth) AS (
  SELECT 'app', p_partkey, 0 FROM part WHERE p_type = 'PROMO'
  UNION
  SELECT e.dt, e.di, w.depth + 1 FROM walk w JOIN edges e ON e.st = w.t AND e.si = w.i WHERE w.depth < 3),
best AS (SELECT t, i, min(depth) AS depth FROM walk GROUP BY t, i),
kind AS (SELECT b.*, e.np, e.cap, coalesce((b.t = 'reviewer' AND e.np = 1 AND e.one) OR (b.t = 'developer' AND e.one), false) AS leaf
         FROM best b LEFT JOIN ent e ON e.t = b.t AND e.i = b.i)
SELECT t AS node_type, i::VARCHAR AS node_id,
  unnest(generate_series(1, CASE WHEN depth < 3 AND NOT leaf THEN greatest(least(np, cap), 1) ELSE 1 END))::BIGINT AS page,
  depth::BIGINT AS depth, leaf::INT AS is_leaf FROM kind
""",
    "depth_stats": f"""
WITH RECURSIVE {_GRAPH}
SELECT depth::BIGINT AS depth, count(*)::BIGINT AS n_nodes FROM best GROUP BY depth
""",
}
