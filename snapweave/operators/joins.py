"""Joins the reference performs: contains (theta) join, enrichment, lookups.

Broadcasts here are always behind a measured size: ``checked_broadcast`` counts
the rows and bytes of the small side first and only then hints a broadcast;
beyond the limit the plain shuffle join (with AQE skew splitting) is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BROADCAST_MAX_BYTES = 64 << 20
SPACE = "\t\n\x0b\f\r"  # white space besides the blank
GRAM = 4

def _size_of(df: DataFrame, text_cols: Sequence[str]) -> tuple[int, int]:
    """(rows, approximate bytes) of ``df`` over ``text_cols`` (one small job)."""
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in text_cols), F.lit(0)) + F.lit(16)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def checked_broadcast(small: DataFrame, text_cols: Sequence[str] = (), max_bytes: int = BROADCAST_MAX_BYTES,
                      row_bytes: int = 64) -> DataFrame:
    """Broadcast hint only when the measured size fits ``max_bytes``."""
    n, b = _size_of(small, text_cols)
    return F.broadcast(small) if (b + n * row_bytes) <= max_bytes else small


def _words(text: str) -> Column:
    """A text cut at every white space character (words, and an empty one between two of them); no regular expression."""
    return F.split(F.translate(text, SPACE, " " * len(SPACE)), " ")


def _grams(word: Column, most: int = GRAM) -> Column:
    """The distinct substrings of ``word`` of ``most`` characters; of a shorter word the word itself."""
    last = F.greatest(F.char_length(word) - F.lit(most - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: word.substr(i, F.lit(most))))


def _anchored_words(cut: DataFrame, places: DataFrame) -> DataFrame:
    """(_word, _pattern): the rarest word of each pattern that stands between white space inside the pattern, so any text
    that holds the pattern has it as a word of its own. A pattern with such a word that no text has is left out."""
    inner = cut.select("_pattern", F.explode("_inner").alias("_word"))
    wanted = inner.select("_word").distinct()
    counted = places.join(checked_broadcast(wanted, ["_word"]), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    return (inner.join(counted, "_word", "left").groupBy("_pattern")
            .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("word"))).alias("_r"))
            .where("_r.n > 0").select(F.col("_r.word").alias("_word"), "_pattern"))


def _holding_words(cut: DataFrame, places: DataFrame) -> DataFrame:
    """(_word, _pattern) for patterns of one or two words: all words of the texts that hold the pattern's longest word.

    The distinct words of the texts are indexed by grams; a pattern asks for its rarest gram.
    """
    piece = (cut.where("size(_inner) = 0")
             .withColumn("_piece", F.expr("if(char_length(_parts[size(_parts) - 1]) > char_length(_parts[0]), _parts[size(_parts) - 1], _parts[0])"))
             .select("_pattern", "_piece").where("_piece <> ''"))
    words = places.select("_word").distinct()
    # a word also stands under its shorter grams where a pattern is that short
    short = [r[0] for r in piece.select(F.char_length("_piece").alias("n")).where(F.col("n") < GRAM).distinct().collect()]
    found = F.flatten(F.array(_grams(F.col("_word")), *[_grams(F.col("_word"), n) for n in short]))
    index = words.select("_word", F.explode(F.array_distinct(found)).alias("_gram"))
    asked = piece.select("_pattern", "_piece", F.explode(_grams(F.col("_piece"))).alias("_gram"))
    wanted = asked.select("_gram").distinct()
    counted = index.join(checked_broadcast(wanted, ["_gram"]), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    best = (asked.join(counted, "_gram", "left").groupBy("_pattern", "_piece")
            .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_r"))
            .where("_r.n > 0").select("_pattern", "_piece", F.col("_r.gram").alias("_gram")))
    return index.join(best, "_gram").where(F.contains("_word", "_piece")).select("_word", "_pattern").distinct()


def contains_join(texts: DataFrame, key_cols: Sequence[str], text_col: str,
                  patterns: DataFrame, pattern_col: str, salts: int = 16) -> DataFrame:
    """Rows of ``texts`` joined with every ``patterns`` row whose
    ``pattern_col`` occurs in the text (F1), whole texts, exact substring.

    Empty or NULL patterns are skipped (an empty name would match every text), and
    so are NULL texts; key columns may hold anything, they are only carried along.

    An anchor index instead of a nested loop, in built-in functions only. Texts are
    exploded into their distinct words (cut at white space), under a hash of the
    text. A pattern is looked up by one anchor: its rarest word that white space
    encloses inside the pattern; without one (one or two words), the words of the
    texts that hold its longest word, found by its rarest gram among the distinct
    words. What the anchor finds is verified on the whole text with ``contains``.
    The pattern side is broadcast if its measured size allows it; beyond that both
    sides shuffle by (word, salt), so a frequent anchor spreads over ``salts`` tasks.
    """
    pats = patterns.where(F.length(pattern_col) > 0)
    cut = pats.select(F.col(pattern_col).alias("_pattern")).distinct().withColumn("_parts", _words("_pattern"))
    cut = cut.withColumn("_inner", F.expr("filter(slice(_parts, 2, greatest(size(_parts) - 2, 0)), x -> x <> '')"))
    src = texts.select(*key_cols, F.col(text_col).alias("_t")).where(F.length("_t") > 0)
    places = src.select(F.xxhash64("_t").alias("_xh"), F.explode(F.array_distinct(_words("_t"))).alias("_word"))
    hits = _anchored_words(cut, places)
    if not cut.where("size(_inner) = 0").isEmpty():
        hits = hits.union(_holding_words(cut, places))
    hits = cut_lineage(hits)
    small = checked_broadcast(hits, ["_word", "_pattern"])
    if small is hits:
        spread = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = places.withColumn("_salt", F.pmod("_xh", F.lit(salts)).cast("int")).join(spread, ["_word", "_salt"])
    else:
        met = places.join(small, "_word")
    met = cut_lineage(met.select("_xh", "_pattern").distinct())
    out = (src.withColumn("_xh", F.xxhash64("_t")).join(checked_broadcast(met, ["_pattern"]), "_xh")
           .where(F.contains("_t", "_pattern")).select(*key_cols, "_pattern"))
    blank = cut.where("replace(translate(_pattern, '\\t\\n\\u000b\\f\\r', '     '), ' ') = ''").select("_pattern", F.lit(1).alias("_one"))
    if not blank.isEmpty():  # white space alone: in nearly every text, so the result is about that size
        out = out.union(src.withColumn("_one", F.lit(1)).join(blank, "_one").where(F.contains("_t", "_pattern")).select(*key_cols, "_pattern"))
    pat_side = pats.withColumnRenamed(pattern_col, "_pattern")
    joined = out.join(checked_broadcast(pat_side, ["_pattern"]), "_pattern")
    return joined.withColumnRenamed("_pattern", pattern_col)


def enrich(detail: DataFrame, listing: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """List -> detail enrichment (F2): list-only attributes travel to the
    detail rows by key (a left join keeps details without a list row)."""
    return detail.join(listing, on, how)


def first_match(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str | Column]) -> DataFrame:
    """Per key the first row by ``order_cols`` (I4 early exit, F4 setdefault)."""
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*"))


def resolve_links(links: DataFrame, link_col: str, resolved: DataFrame,
                  short_col: str = "short_url", final_col: str = "final_url") -> DataFrame:
    """Short link -> resolved link by an equi-join on the normalised short URL
    (F5). ``resolved`` is a table of fetched redirects; the job context stays
    on the row (no shared state between jobs)."""
    from ..functions.urls import short_link_url
    l2 = links.withColumn("_short", short_link_url(link_col))
    r2 = resolved.select(F.col(short_col).alias("_short"), F.col(final_col).alias(final_col))
    return l2.join(r2, "_short", "left").drop("_short")
