"""Task classification predicates (paid-review detection and guards)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import re
from functools import reduce

from ..functions import constants as C
from ..functions import regexes as R
from ..functions.processors import ColumnOrName, _c


def _any_word(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.instr(text, w) > 0 for w in words])


def _all_words(text: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [F.instr(text, w) > 0 for w in words])


def paid_review_task(name: ColumnOrName, expected: ColumnOrName) -> Column:
    """The title mentions amazon or a review word, and amazon and a review
    word each appear in the title or the FIRST expected text (later expected
    texts are not searched). A missing first text counts as empty."""
    n = F.coalesce(_c(name), F.lit(""))
    e0 = F.coalesce(F.get(_c(expected), 0), F.lit(""))
    a_t, r_t = n.rlike(R.AMAZON), n.rlike(R.REVIEW)
    a_e, r_e = e0.rlike(R.AMAZON), e0.rlike(R.REVIEW)
    return (a_t | r_t) & (a_t | a_e) & (r_t | r_e)


def paid_app_review_task(name: ColumnOrName, expected: ColumnOrName) -> Column:
    """Title contains feedback / review / rate (any case) and one single
    expected text contains both 'https://' and 'app' (any case)."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    title_ok = _any_word(n, C.APP_REVIEW_TITLE_WORDS)
    one = F.exists(_c(expected), lambda x: _all_words(F.lower(x), C.APP_LINK_MARKERS))
    return title_ok & F.coalesce(one, F.lit(False))


def amazon_review_cumulative(expected: ColumnOrName) -> Column:
    """D3: amazon and a review word both seen somewhere over the expected
    texts (flags accumulate across texts)."""
    e = _c(expected)
    return (F.coalesce(F.exists(e, lambda x: x.rlike(R.AMAZON_SIMPLE)), F.lit(False))
            & F.coalesce(F.exists(e, lambda x: x.rlike(R.REVIEW_SIMPLE)), F.lit(False)))


def paid_app_review_text(name: ColumnOrName, expected_text: ColumnOrName) -> Column:
    """D2 over the expected texts given as one newline-separated text: one
    line must contain both 'https://' and 'app' (any case). A per-line anchored
    double lookahead (Unix lines) replaces a lambda over the lines, so the test
    stays one JVM regex scan."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    title_ok = _any_word(n, C.APP_REVIEW_TITLE_WORDS)
    ahead = "".join(f"(?=[^\\n]*{re.escape(w)})" for w in C.APP_LINK_MARKERS)
    one = F.coalesce(_c(expected_text), F.lit("")).rlike(f"(?imd)^{ahead}")
    return title_ok & one


def amazon_review_text(expected_text: ColumnOrName) -> Column:
    """D3 over the expected texts given as one text: neither pattern can
    span a newline, so 'some line matches' equals 'the text matches'."""
    t = F.coalesce(_c(expected_text), F.lit(""))
    return t.rlike(R.AMAZON_SIMPLE) & t.rlike(R.REVIEW_SIMPLE)


def job_running(text: ColumnOrName, inactive_marker: str = "This job is currently not running") -> Column:
    """Page is not the 'not running' / 'not active' notice."""
    return ~F.coalesce(F.instr(_c(text), inactive_marker) > 0, F.lit(False))


def job_detail_link(href: ColumnOrName) -> Column:
    """Keep only job-detail links of a list page."""
    return F.instr(_c(href), C.JOB_DETAIL_MARKER) > 0


def has_any(a: ColumnOrName) -> Column:
    """Non-empty array (empty result, missing link)."""
    return F.coalesce(F.size(_c(a)) > 0, F.lit(False))
