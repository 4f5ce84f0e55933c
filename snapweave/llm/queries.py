"""Registered queries of the subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapweave.session import read_table

from . import ordinal
from .adaptive_prefix import jaccard_components
from .bm25 import search
from .collision_hashing import nearest
from .gumbel_pieces import sample_segmentations
from .licences import scan_licences
from .minhash_forest import near_duplicates
from .packing import pack_documents
from .pair_maxscore import search as ranked_search
from .sparse_suffixes import repeated_passages
from .spelling_tiles import spelling_variants
from .suffix_trees import substring_dedup
from .text_density import extract


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op2_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.grades_of(read_table(spark, sf_dir, "labels")), ordinal.GRADES)
    return ordinal.score(docs, model, ordinal.CLEAN)


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op5_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (repeated_passages(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_shared", "n_removed", "shared_spans", "removed_spans"))


def op6_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op8_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 50 = 0"))


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents"))


def op10_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(read_table(spark, sf_dir, "documents"))


def op11_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_linear_grouping": op2_linear_grouping,
    "op3_ordinal": op3_ordinal,
    "op4_text_density": op4_text_density,
    "op5_sparse_suffixes": op5_sparse_suffixes,
    "op6_suffix_trees": op6_suffix_trees,
    "op7_collision_counting": op7_collision_counting,
    "op8_block_max": op8_block_max,
    "op9_licence_rules": op9_licence_rules,
    "op10_gumbel_pieces": op10_gumbel_pieces,
    "op11_adaptive_prefix": op11_adaptive_prefix,
    "op12_pair_maxscore": op12_pair_maxscore,
    "op13_spelling_tiles": op13_spelling_tiles,
}

#: Links by prefix filtering: two sets of similarity 0.8 share one of the rarest fifth of each.
OP1_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM d),
place AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
freq AS (SELECT g, count(*) AS df FROM place GROUP BY g),
ranked AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS r FROM place JOIN freq USING (g)),
prefix AS (SELECT doc_id, n, g FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y
    ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n),
met AS (
    SELECT a, b, len(x.s) + len(y.s) AS m, len(list_intersect(x.s, y.s)) AS shared
    FROM cand JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b),
link AS (
    SELECT a, b FROM met WHERE 100 * shared >= 80 * (m - shared)
    UNION ALL SELECT b, a FROM met WHERE 100 * shared >= 80 * (m - shared)),
reach(id, c) AS (
    SELECT doc_id, doc_id FROM sets
    UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.id WHERE reach.c < link.b),
comp AS (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""

#: The same links by prefix filtering, on three-word shingles at 0.9.
OP11_SQL = (
    OP1_SQL.replace("ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END",
                    "WHEN len(w) = 2 THEN [w[1] || ' ' || w[2]]\n"
                    "        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END")
    .replace("80", "90").replace(", doc_id = component_id AS kept", ""))

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN low USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS nt FROM d),
size AS (SELECT doc_id, 100 - 25 + (25 * len(w) * nd) // nt AS m FROM d, total WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
weight AS (
    SELECT t, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
asked AS (
    SELECT item_id, t, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
    GROUP BY item_id, t),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN size USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

#: The checksum byte by byte from a table built by its rule; near words share a gap: a code point left out at the same place,
#: or left out of the longer word.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT i AS slot, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
    UNION ALL SELECT slot, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY slot) AS t FROM bits WHERE step = 8),
run AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
own AS (SELECT doc_id, r, length(r) AS l, count(*) AS m FROM run WHERE length(r) >= 7 GROUP BY doc_id, r),
bytes AS (
    SELECT r, l, m, flatten(list_transform(range(1, length(k) + 1),
        lambda i: CASE WHEN unicode(k[i]) < 128 THEN [unicode(k[i])] ELSE [195, unicode(k[i]) - 64] END)) AS b
    FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || r AS k FROM own)),
summed AS (
    SELECT r, l, m, xor(list_reduce(list_transform(b, lambda x: x::BIGINT),
        lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % l] || r[h % l + 2:] ELSE r END AS word, m FROM summed),
word AS (SELECT word, sum(m)::BIGINT AS n, length(word) AS l FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
gap AS (
    SELECT word, n, l, i, word[1:i - 1] || word[i + 1:] AS g
    FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM word)),
near AS (
    SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM gap x JOIN gap y
        ON x.g = y.g AND x.i = y.i AND x.l = y.l AND x.word <> y.word
    UNION SELECT x.word, x.n, y.word, y.n FROM gap x JOIN word y ON x.g = y.word
    UNION SELECT y.word, y.n, x.word, x.n FROM gap x JOIN word y ON x.g = y.word),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS top, max(other_n) AS top_n FROM near GROUP BY word),
formed AS (
    SELECT w.word, CASE WHEN top_n >= 10 * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near,
           CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM word w LEFT JOIN best b ON w.word = b.word),
follow(word, root, step) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON f.root = g.word WHERE g.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON f.word = e.word
"""

#: The others need a tokenizer, a model, HTML trees, or searches and rules that SQL cannot state.
ORACLE: dict[str, str] = {"op1_minhash_forest": OP1_SQL, "op6_suffix_trees": OP6_SQL,
                          "op11_adaptive_prefix": OP11_SQL, "op12_pair_maxscore": OP12_SQL, "op13_spelling_tiles": OP13_SQL}
