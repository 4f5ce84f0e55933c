"""The pipeline's stages against their operators' brute-force definitions, on a small corpus."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from snapweave.llm.tables import written  # noqa: E402
from snapweave.session import read_table  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark):
    docs = read_table(spark, SMOKE, "documents")
    docs = docs.union(docs.limit(3)).union(docs.limit(1).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SMOKE)))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    clean, single, cut, packed = seen[1:]
    rows = [(r.doc_id, shingles(r.text)) for r in clean.where("doc_id is not null").distinct().collect()]
    keep = {r.doc_id for r in single.collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, s) in enumerate(rows):
        for b, t in rows[n + 1:]:
            if s and t and 5 * len(s & t) >= 4 * len(s | t) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert keep - {None} == {find(i) for i in root}
    assert cut.count() == single.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert r.text == texts[r.doc_id] or len(r.text.split()) < len(texts[r.doc_id].split())
        assert r.n_chars == len(r.text)
    assert packed.where("piece = 0").count() == cut.count()
    assert corpus_pipeline.run(spark, SMOKE).count() > 0


def test_stages_with_nulls_repeats_clashing_names_and_no_rows(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words, "en", "s", 1, 5, "a", "b", "c"), (2, "before " + words + " after", "en", "s", 1, 5, "a", "b", "c"),
            (3, None, "en", "s", 1, 5, "a", "b", "c"), (4, "", "en", "s", 0, 5, "a", "b", "c"), (None, words, None, None, None, 5, "a", "b", "c"),
            (5, "one two three four five six", "b", "s", 1, 5, "a", "b", "c"), (5, "one two three four five six", "a", "s", 1, 5, "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id long, __xh string, __kept string, removed_id string")
    single = corpus_pipeline.near_dedup(spark, docs, SMOKE)
    assert single.columns == docs.columns
    got = [(r.doc_id, r.lang) for r in single.collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (3, "en"), (4, "en"), (None, None), (5, "a")], key=str)
    cut = corpus_pipeline.substrings(spark, docs, SMOKE)
    assert cut.columns == docs.columns
    texts = {(r.doc_id, r.lang): (r.text, r.n_chars) for r in cut.collect()}
    assert texts[2, "en"] == ("before after", 12) and texts[1, "en"][0] == words and texts[3, "en"] == (None, None)
    assert texts[4, "en"] == ("", 0) and texts[None, None][0] == words and cut.count() == len(rows)
    kept = corpus_pipeline.quality(spark, docs, SMOKE)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    assert corpus_pipeline.packing(spark, docs, SMOKE).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMOKE).count() == 0


def test_the_worse_of_two_labels_counts(spark):
    from snapweave.llm import ordinal
    texts = [(i, ("good words here " if i % 2 else "poor junk text ") * 5) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plain = [(i, 2 if i % 2 else 0) for i, _ in texts]
    both = plain + [(i, 2) for i, _ in texts if i % 2 == 0] + [(i, 2) for i, _ in texts if i % 2]
    one, two = (ordinal.fit(docs, spark.createDataFrame(x, "id long, grade int"), 3) for x in (plain, both[::-1]))
    assert (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
