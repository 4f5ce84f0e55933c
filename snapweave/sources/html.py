"""Captured HTML pages -> fields.

Spark's built-in ``xpath*`` functions need well-formed XML, which real pages
are not (unclosed ``<br>``/``<p>``, bare entities, script text with ``</p>``).
``to_xhtml`` repairs a page once (Arrow-batched pandas UDF over stdlib
``html.parser``); extraction specs then run as JVM ``xpath`` expressions.
``page_fields`` is the one-pass variant for the common page fields: each page
is parsed exactly once and all fields come out of the same pass.
"""

from __future__ import annotations

from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
# start tags that implicitly close an open <p> (HTML's implied end tags)
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
            "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
            "section", "table", "ul"}
P_SCOPE = {"table", "td", "th", "caption", "button", "object"}
# a start tag ends the open elements of the same kind, but only within the nearest list, row or table
_LIST, _ROWS = {"ul", "ol", "menu"}, {"tbody", "thead", "tfoot"}
SCOPED = {"li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
          **{t: (_ROWS, {"table"}) for t in _ROWS}}
_CTRL = dict.fromkeys(c for c in range(32) if c not in (9, 10, 13))


def _clean(s: str) -> str:
    return s.translate(_CTRL)


def _name_ok(n: str) -> bool:
    return bool(n) and (n[0].isalpha() or n[0] == "_") and all(c.isalnum() or c in "-_." for c in n)


class _XHTML(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[str] = []

    def _close_to(self, tag: str):
        while self.stack:
            t = self.stack.pop()
            self.out.append(f"</{t}>")
            if t == tag:
                return

    def _close_open(self, tags: set, scope: set):
        """Close the nearest open element of ``tags`` unless one of ``scope`` stands around it more closely."""
        for t in reversed(self.stack):
            if t in tags:
                return self._close_to(t)
            if t in scope:
                return None

    def handle_starttag(self, tag, attrs):
        if not _name_ok(tag):
            return
        if tag in CLOSES_P:
            self._close_open({"p"}, P_SCOPE)
        if tag in SCOPED:
            self._close_open(*SCOPED[tag])
        seen = set()
        parts = []
        for k, v in attrs:
            k = k.lower()
            if not _name_ok(k) or k in seen or k == "xmlns" or k.startswith("xmlns:") or ":" in k:
                continue
            seen.add(k)
            parts.append(f" {k}={quoteattr(_clean(v if v is not None else k))}")
        a = "".join(parts)
        if tag in VOID:
            self.out.append(f"<{tag}{a}/>")
        else:
            self.out.append(f"<{tag}{a}>")
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1] == tag:
            self._close_to(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._close_to(tag)

    def handle_data(self, data):
        self.out.append(escape(_clean(data)))

    def result(self) -> str:
        while self.stack:
            self.out.append(f"</{self.stack.pop()}>")
        body = "".join(self.out)
        return f"<root>{body}</root>"


def html_to_xhtml(html: str | None) -> str | None:
    """Well-formed XML for a tolerant HTML text (wrapped in ``<root>``)."""
    if html is None:
        return None
    p = _XHTML()
    try:
        p.feed(html)
        p.close()
    except Exception:  # malformed markup beyond repair: keep what was parsed
        pass
    return p.result()


@F.pandas_udf(StringType())
def to_xhtml(html: pd.Series) -> pd.Series:
    """Arrow-batched HTML -> XHTML repair (one parse per page)."""
    return html.map(html_to_xhtml)


def xpath_fields(df: DataFrame, xml_col: str, spec: dict[str, tuple[str, str]], keep=()) -> DataFrame:
    """Apply an extraction spec ``{field: (kind, xpath)}`` to repaired pages,
    with kind in {'string', 'strings', 'int', 'count'}; all built-in JVM
    ``xpath`` functions (M2 page extractors as a declarative table)."""
    x = F.col(xml_col)
    cols: list[Column] = [F.col(k) for k in keep]
    for name, (kind, path) in spec.items():
        if kind == "string":
            c = F.xpath_string(x, F.lit(path))
        elif kind == "strings":
            c = F.xpath(x, F.lit(path))
        elif kind == "int":
            c = F.xpath_long(x, F.lit(path))
        elif kind == "count":
            c = F.xpath_long(x, F.lit(f"count({path})"))
        else:
            raise ValueError(kind)
        cols.append(c.alias(name))
    return df.select(*cols)


# ------------------------------------------------------------ one-pass fields
class _Fields(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.lang = None
        self.n_links = 0
        self.n_ads = 0
        self.n_paragraphs = 0
        self._in_title = False
        self._in_h1 = False
        self._title_done = False
        self._h1_done = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "a":
            self.n_links += 1
        elif tag == "p":
            self.n_paragraphs += 1
        elif tag == "div" and "ad" in (a.get("class") or "").split():
            self.n_ads += 1
        elif tag == "title" and not self._title_done:
            self._in_title, self.title = True, []
        elif tag == "h1" and not self._h1_done:
            self._in_h1, self.h1 = True, []

    def handle_endtag(self, tag):
        if tag == "title" and self._in_title:
            self._in_title, self._title_done = False, True
        elif tag == "h1" and self._in_h1:
            self._in_h1, self._h1_done = False, True

    def handle_data(self, data):
        if self._in_title:
            self.title.append(data)
        if self._in_h1:
            self.h1.append(data)


PAGE_FIELDS_SCHEMA = ("title string, h1 string, lang string, n_links bigint, n_ads bigint, "
                      "n_paragraphs bigint")


def _fields_of(html):
    p = _Fields()
    if isinstance(html, str):
        try:
            p.feed(html)
            p.close()
        except Exception:
            pass
    return ("".join(p.title) if p.title is not None else None,
            "".join(p.h1) if p.h1 is not None else None,
            p.lang, p.n_links, p.n_ads, p.n_paragraphs)


def page_fields(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Common page fields in one parse per page (A9): first title and h1 text
    (entities decoded), html lang, counts of links, ad blocks and paragraphs.
    ``mapInPandas`` keeps the work partition-parallel and Arrow-batched."""
    key_cols = list(key_cols)
    key_schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key_cols)
    names = ["title", "h1", "lang", "n_links", "n_ads", "n_paragraphs"]

    def run(batches):
        for pdf in batches:
            rows = [_fields_of(h) for h in pdf[html_col].tolist()]
            out = pd.DataFrame(rows, columns=names)
            for c in key_cols:
                out.insert(key_cols.index(c), c, pdf[c].values)
            yield out

    return pages.select(*key_cols, html_col).mapInPandas(run, f"{key_schema}, {PAGE_FIELDS_SCHEMA}")
