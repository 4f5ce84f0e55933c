"""Entity graph: edges, depth-bounded expansion, page plans.

Nodes are (node_type, node_id); edges (src_type, src_id, dst_type, dst_id,
kind) come from the extracted entity tables (review -> reviewer, reviewer ->
apps, app -> also-bought apps, app -> developer, developer -> apps).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import DEPTH_LIMIT, MAX_PAGES, NEXT_PAGE_VALUE, developer_url
from ..session import cut_lineage, written

FRONTIER_ROWS = 1_000_000  # of the frontier, per partition of a round's join
MOST_TYPES = 64


def _node(type_col: str, id_col: str):
    return F.struct(F.col(type_col).alias("node_type"), F.col(id_col).alias("node_id"))


def edges_from(df: DataFrame, src_type: str, src_id: str, dst_type: str, dst_col: str, kind: str) -> DataFrame:
    """Edges from a table with a source id column and a destination column
    (scalar or array of ids) (E4)."""
    is_array = df.schema[dst_col].dataType.typeName() == "array"
    dst = F.explode(dst_col) if is_array else F.col(dst_col)
    return (df.select(F.lit(src_type).alias("src_type"), F.col(src_id).alias("src_id"),
                      F.lit(dst_type).alias("dst_type"), dst.alias("dst_id"),
                      F.lit(kind).alias("kind"))
            .where(F.col("dst_id").isNotNull()))


def bounded_bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = DEPTH_LIMIT, salt: int = 16,
                paged_at_limit: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """Breadth-first expansion from ``seeds`` (node_type, node_id) at depth 0,
    one level per round, nodes deeper than ``max_depth`` dropped (K1-K4).

    Each round joins the frontier to the edges, removes visited nodes
    (anti join) and keeps one referrer per new node: the smallest parent of the
    previous level (K4). Duplicate edges are harmless (the per-node ``min``
    collapses them), so edges are not de-duplicated here.

    The edges are written once as columns to the shared checkpoint folder. A round reads
    those whose source has a type of the frontier and deals them out by (source, salt), the
    salt being a hash of the destination, so a hub node's edges spread over ``salt``
    partitions; the (small) frontier is replicated once per salt value and held as a hash
    table of at most about ``FRONTIER_ROWS`` rows per partition, so no round sorts edges.
    Parents are reduced per (node, type of parent) by hashing first; the smallest of
    those few is taken as a struct. Each round's new level is written too, so the
    iterative part keeps a short lineage; the visited set is the union of those levels.
    Rounds are bounded by ``max_depth``. ``paged_at_limit`` reproduces the original crawler, whose
    item requests all carried a page number and were therefore dropped at the
    depth limit: nodes are then reached to ``max_depth - 1`` only. ``ends`` (node_type, node_id)
    are reached but never expanded.
    """
    if paged_at_limit:
        max_depth -= 1
    e = written(edges.select("src_type", "src_id", "dst_type", "dst_id"))
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = e.withColumn("_salt", F.pmod(F.xxhash64("dst_type", "dst_id"), F.lit(salt)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt")
    start = (seeds.select("node_type", "node_id")
             .distinct()
             .withColumn("depth", F.lit(0))
             .withColumn("referrer", F.lit(None).cast(
                 f"struct<node_type:string,node_id:{e.schema['src_id'].dataType.simpleString()}>")))
    frontier = written(start)
    visited = frontier
    for d in range(1, max_depth + 1):
        # the kinds of node, a few names; were there many, all edges are read
        types = [r[0] for r in frontier.select("node_type").distinct().limit(MOST_TYPES + 1).collect()]
        of_types = salted if len(types) > MOST_TYPES else salted.where(F.col("src_type").isin([t for t in types if t is not None]))
        if ends is not None:
            frontier = frontier.join(ends.select("node_type", "node_id"), ["node_type", "node_id"], "left_anti")
        n = max(parts, -(-frontier.count() * salt // FRONTIER_ROWS))
        asking = (frontier.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), salts)
                  .repartition(n, "src_type", "src_id", "_salt").hint("shuffle_hash"))
        step = (asking.join(of_types, ["src_type", "src_id", "_salt"])
                .groupBy(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), "src_type")
                .agg(F.min("src_id").alias("src_id")))
        # reduced to one row per node and type of parent first, then the visited ones go
        new = (step.join(visited.select("node_type", "node_id"), ["node_type", "node_id"], "left_anti")
               .groupBy("node_type", "node_id").agg(F.min(_node("src_type", "src_id")).alias("referrer"))
               .withColumn("depth", F.lit(d)))
        new = written(new.select("node_type", "node_id", "depth", "referrer"))
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
        frontier = new
    return visited


def lineage_paths(nodes: DataFrame) -> DataFrame:
    """Every node of ``bounded_bfs`` with ``path``, the array of (node_type, node_id) from a seed to itself (K4).

    Pointer doubling over the referrer: a row holds the part of its path behind an
    ancestor ``up``; a round takes in the ancestor's own part, which doubles the
    distance, so the number of joins is the logarithm of the depth. A hub that many
    nodes name as ancestor is the key of a join whose other side has one row, so AQE
    splits it. Nodes whose referrer is not among the nodes begin a path themselves.
    """
    me = F.struct("node_type", "node_id")
    known = cut_lineage(nodes.select(me.alias("node"), F.array(me).alias("path"), F.col("referrer").alias("up")))
    while not known.where("up is not null").isEmpty():
        far = known.select(F.col("node").alias("up"), F.col("path").alias("_head"), F.col("up").alias("_up"))
        known = cut_lineage(known.join(far, "up", "left")
                            .select("node", F.concat(F.coalesce("_head", F.slice("path", 1, 0)), "path").alias("path"), F.col("_up").alias("up")))
    paths = known.select("node.node_type", "node.node_id", "path")
    return nodes.join(paths, ["node_type", "node_id"])


def paged_expansion(seeds: DataFrame, links: DataFrame, max_depth: int = DEPTH_LIMIT, max_pages: dict | None = None,
                    paged_at_limit: bool = False) -> DataFrame:
    """Page requests of a depth-bounded expansion over (type, id, page) (K1 with D8, D9 and D11).

    ``links`` (src_type, src_id, src_page, dst_type, dst_id) are found on a page of their
    source. A link to another entity costs one level, the next page of the same entity
    none; so a level holds all pages of its entities up to the limit of their type, and
    their links are known before the expansion: no rounds are needed for pages. At the last
    level only the first page is asked for (none with ``paged_at_limit``, as in ``bounded_bfs``).

    Leaf rules: a reviewer with one page and one app, and a developer whose only app
    is its referrer, are reached but not expanded and have one page. A developer that can
    only be reached from its one app is known beforehand not to be expanded (unless it is a seed);
    any other leads back to its referrer, which the expansion has visited.

    Returns node_type, node_id, page, depth, is_leaf, one row per request. Links with a null
    id or page on either side are no links; repeated ones and repeated seeds count once; a node
    without links of its own has one page.
    """
    limits = max_pages or MAX_PAGES
    cap = F.lit(None).cast("int")
    for t, m in limits.items():
        cap = F.when(F.col("node_type") == t, F.lit(m)).otherwise(cap)
    links = links.dropna(subset=["src_type", "src_id", "src_page", "dst_type", "dst_id"])
    # one small row per entity, combined by hashing before the shuffle: pages, and the one entity it leads to, if it is one
    out = (links.groupBy("src_type", "src_id", "dst_type")
           .agg(F.max("src_page").alias("_pages"), F.min("dst_id").alias("_lo"), F.max("dst_id").alias("_hi"))
           .groupBy(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"))
           .agg(F.max("_pages").alias("n_pages"), F.min(_node("dst_type", "_lo")).alias("_to"), F.max(_node("dst_type", "_hi")).alias("_last_to")))
    out = out.withColumn("_only", F.when(F.col("_to") == F.col("_last_to"), F.col("_to"))).drop("_to", "_last_to")
    entities = written(out)
    # ends that are never expanded, whatever way they are reached
    reviewers = entities.where((F.col("node_type") == "reviewer") & (F.col("n_pages") == 1) & F.col("_only").isNotNull())
    single = entities.where((F.col("node_type") == "developer") & F.col("_only").isNotNull()).select("node_type", "node_id", "_only")
    into = (links.where(F.col("dst_type") == "developer")
            .groupBy(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), "src_type")
            .agg(F.min("src_id").alias("_lo"), F.max("src_id").alias("_hi")).groupBy("node_type", "node_id")
            .agg(F.min(_node("src_type", "_lo")).alias("_from"), F.max(_node("src_type", "_hi")).alias("_last_from")).where(F.col("_from") == F.col("_last_from")))
    developers = (single.join(into, ["node_type", "node_id"]).where(F.col("_only") == F.col("_from"))
                  .join(seeds.select("node_type", "node_id"), ["node_type", "node_id"], "left_anti"))
    ends = written(reviewers.select("node_type", "node_id").unionByName(developers.select("node_type", "node_id")))
    edges = within_page_limit(links, "src_type", "src_page", limits)
    nodes = bounded_bfs(seeds, edges, max_depth, paged_at_limit=paged_at_limit, ends=ends)
    leaf = F.coalesce((F.col("node_type") == "reviewer") & (F.col("n_pages") == 1) & F.col("_only").isNotNull(), F.lit(False)) | F.coalesce(
        (F.col("node_type") == "developer") & (F.col("_only") == F.col("referrer")), F.lit(False))
    n = F.least(F.coalesce("n_pages", F.lit(1)), cap)            # a null limit is passed over
    return (nodes.join(entities, ["node_type", "node_id"], "left").withColumn("is_leaf", leaf)
            .withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(
                (F.col("depth") < max_depth) & ~F.col("is_leaf"), F.greatest(n, F.lit(1))).otherwise(1).cast("bigint"))))
            .select("node_type", "node_id", "page", "depth", "is_leaf"))


def depth_stats(nodes: DataFrame) -> DataFrame:
    """Nodes per depth."""
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).cast("bigint").alias("n_nodes"))


def page_numbers(n_pages_col: str, entity_type: str, max_pages: dict | None = None):
    """Pages 1..min(n, max pages of the type) (E2 + D8)."""
    limits = max_pages or MAX_PAGES
    cap = limits.get(entity_type)
    n = F.coalesce(F.col(n_pages_col), F.lit(1))  # no last link: one page
    upper = F.least(n, F.lit(cap)) if cap else n
    return F.explode(F.sequence(F.lit(1), F.greatest(upper, F.lit(1))))


def developer_pages(df: DataFrame, dev_col: str, iphone_links: str, ipad_links: str,
                    max_pages: int | None = None) -> DataFrame:
    """Developer page plan (E3): each pager count of 5 or more includes a
    'next' link, so it drops by one; when iPhone pages outnumber iPad pages
    only the iPhone page advances (iPad page held at 1), otherwise both
    advance together (an iPad count above the iPhone count behaves as equal).
    Pages are 1..iPhone pages, capped by the developer page limit (D8)."""
    cap = max_pages or MAX_PAGES["developer"]
    ip = F.coalesce(F.col(iphone_links), F.lit(0))
    ipad = F.coalesce(F.col(ipad_links), F.lit(0))
    ip_n = F.when(ip >= NEXT_PAGE_VALUE, ip - 1).otherwise(ip)
    ipad_n = F.when(ipad >= NEXT_PAGE_VALUE, ipad - 1).otherwise(ipad)
    differ = (ipad_n > 0) & (ip_n > ipad_n)
    only_iphone = (ipad_n == 0) | differ
    d = df.select(F.col(dev_col).alias("entity_id"), ip_n.alias("_n"), only_iphone.alias("_only"))
    d = d.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.least("_n", F.lit(cap)), F.lit(1)))))
    ipad_page = F.when(F.col("_only"), F.lit(1)).otherwise(F.col("page"))
    return d.select("entity_id", "page", developer_url("entity_id", "page", ipad_page).alias("url"))


def within_page_limit(requests: DataFrame, type_col: str = "entity_type", page_col: str = "page",
                      max_pages: dict | None = None) -> DataFrame:
    """Drop page requests beyond the page limit of their entity type
    (types without a limit pass). The limits are a fixed three-entry map, so
    they are inlined as an expression instead of joined."""
    limits = max_pages or MAX_PAGES
    cap = F.lit(None).cast("int")
    for t, m in limits.items():
        cap = F.when(F.col(type_col) == t, F.lit(m)).otherwise(cap)
    return requests.where(cap.isNull() | (F.col(page_col) <= cap))


def allowed_pages(nodes: DataFrame, depth_col: str = "depth", max_depth: int = DEPTH_LIMIT) -> DataFrame:
    """No follow-up (paged) requests for nodes at the last depth level."""
    return nodes.where(F.col(depth_col) < max_depth)


def node_union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
