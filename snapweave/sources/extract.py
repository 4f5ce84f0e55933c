"""Page-kind extractors (reviewer, developer, related-app, task pages).

Multi-row pages are split per block inside one ``mapInPandas`` pass over the
repaired XHTML (one parse per page); page-level fields are built-in JVM
``xpath`` expressions over the same repaired text. Blocks are extracted as a
unit, so a block missing one element (a version button, a genre) yields NULL
in that block instead of shifting every later position, which is what
parallel page-wide lists do.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import regexes as R
from ..functions.processors import only_elem_or_default, py_strip, star_values, text_after_by
from .html import html_to_xhtml, to_xhtml, xpath_fields
from .locators import (DEVELOPER_PAGE_SPEC, MW_BASE_URL, MW_JOB_XPATH, MW_LIST_FIELDS, MW_LIST_ROW,
                       MW_USER_FIELDS, NOT_RUNNING, RELATED_PAGE_SPEC, REVIEWER_PAGE_SPEC, REVIEW_BLOCK,
                       RW_JOB_SPEC)

_ID = re.compile(R.APP_ID)
_KIND = re.compile(r"^https?://[^/]+/[a-z]{2}/([a-z-]+)/")

REVIEW_BLOCK_SCHEMA = (
    "block_pos int, media_kind string, item_id string, item_url string, version string, genre string, "
    "developer_id string, release_label string, release_text string, title string, rating string, "
    "review_date_text string, review_text string"
)


def _classes(el) -> list[str]:
    return (el.get("class") or "").split()


def _find_class(el, tag: str, cls: str):
    for x in el.iter(tag):
        if cls in _classes(x):
            return x
    return None


def _text(el) -> str | None:
    return None if el is None else "".join(el.itertext())


def _blocks_of(html: str | None) -> list[tuple]:
    if not isinstance(html, str):
        return []
    try:
        root = ET.fromstring(html_to_xhtml(html))
    except ET.ParseError:
        return []
    out = []
    for pos, blk in enumerate(b for b in root.iter("div") if REVIEW_BLOCK["block"] in _classes(b)):
        link = _find_class(blk, "a", REVIEW_BLOCK["item_link"])
        url = link.get("href") if link is not None else None
        m = _ID.search(url or "")
        k = _KIND.search(url or "")
        button = next((b for b in blk.iter("button") if b.get(REVIEW_BLOCK["version_attr"]) is not None), None)
        artist = _find_class(blk, "li", REVIEW_BLOCK["artist"])
        artist_a = artist.find("a") if artist is not None else None
        dev = _ID.search(artist_a.get("href") or "") if artist_a is not None else None
        rel = _find_class(blk, "li", REVIEW_BLOCK["release"])
        label = rel.find("span") if rel is not None else None
        rating = _find_class(blk, "div", REVIEW_BLOCK["rating"])
        content = _find_class(blk, "p", REVIEW_BLOCK["content"])
        out.append((
            pos, k.group(1) if k else None, m.group(1) if m else None, url,
            button.get(REVIEW_BLOCK["version_attr"]) if button is not None else None,
            _text(_find_class(blk, "li", REVIEW_BLOCK["genre"])),
            dev.group(1) if dev else None,
            _text(label), (label.tail if label is not None else _text(rel)),
            _text(_find_class(blk, "div", REVIEW_BLOCK["title"])),
            rating.get("aria-label") if rating is not None else None,
            _text(_find_class(blk, "div", REVIEW_BLOCK["review_date"])),
            _text(content).strip() if content is not None else None,
        ))
    return out


def reviewer_blocks(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Reviewer page -> one row per review block (N13), with the media kind
    (``app``, ``book``, ...) from the item link, star value (C14), release
    label + date joined (C16) and parsed dates (C17)."""
    key_cols = list(key_cols)
    key_schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key_cols)
    names = [f.split()[0] for f in REVIEW_BLOCK_SCHEMA.split(", ")]

    def run(batches):
        for pdf in batches:
            keys = {c: pdf[c].tolist() for c in key_cols}
            rows = []
            for i, h in enumerate(pdf[html_col].tolist()):
                for b in _blocks_of(h):
                    rows.append(tuple(keys[c][i] for c in key_cols) + b)
            yield pd.DataFrame(rows, columns=key_cols + names)

    raw = pages.select(*key_cols, html_col).mapInPandas(run, f"{key_schema}, {REVIEW_BLOCK_SCHEMA}")
    release = F.concat_ws("", "release_label", "release_text")
    return raw.select(
        *key_cols, "block_pos", "media_kind", "item_id", "item_url", "version", py_strip("genre").alias("genre"),
        "developer_id", py_strip(release).alias("release"),
        F.try_to_timestamp(py_strip("release_text"), F.lit("MMM d, yyyy")).cast("date").alias("release_date"),
        py_strip("title").alias("title"),
        F.get(star_values(F.array("rating")), 0).alias("rating"),
        F.try_to_timestamp(py_strip("review_date_text"), F.lit("MMM d, yyyy")).cast("date").alias("review_date"),
        "review_text")


def reviewer_pages(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Reviewer page-level fields (N13/N16/D11): reviewer name after 'by ',
    current page and page count; a page without the title block (the
    'no reviews' dialog, a connect stub) gives no row. ``is_leaf`` marks a
    single page with a single app (expansion stops there)."""
    x = pages.select(*key_cols, to_xhtml(html_col).alias("_x"))
    f = xpath_fields(x, "_x", REVIEWER_PAGE_SPEC, keep=list(key_cols))
    f = f.where(F.size("_titles") > 0)
    n_apps = F.size(F.filter("app_links", lambda u: u.rlike(R.APP_ID)))
    return f.select(
        *key_cols, text_after_by(only_elem_or_default("_titles")).alias("reviewer_name"),
        only_elem_or_default("page").cast("int").alias("page"),
        only_elem_or_default("n_pages").cast("int").alias("n_pages"),
        n_apps.cast("bigint").alias("n_apps"),
        ((only_elem_or_default("n_pages").cast("int") == 1) & (n_apps == 1)).alias("is_leaf"))


def app_types(present) -> Column:
    """Types of the app lists that a developer page shows, in the fixed order."""
    return F.filter(F.array(*[F.when(p, F.lit(t)) for p, t in zip(present, C.APP_TYPES)]), lambda t: t.isNotNull())


def single_app_type(types: Column) -> Column:
    """Type of a page with one app (C13): the first present type."""
    return F.coalesce(F.get(types, 0), F.lit(C.DEFAULT_APP_TYPE))


def same_as_page_before(value: str, key: str, page: str) -> Column:
    """Whether a page's value equals that of the page before along its entity (H4); the first page has none. An entity's
    pages are few (the page limits), so they are one window."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(page))
    return F.coalesce(F.col(value) == before, F.lit(False))


def developer_pages(pages: DataFrame, key_cols, html_col: str = "html", prev_ipad_col: str | None = None,
                    referrer_col: str | None = None, along: tuple[str, str] | None = None) -> DataFrame:
    """Developer page -> Developer fields (N15/C13/C29/H4/D11): name; app ids
    (distinct, sorted); when the iPad list equals the previous page's iPad
    list only the iPhone list counts; app types present.

    The previous iPad list is ``prev_ipad_col``, or with ``along`` = (developer
    column, page column) that of the page before, found along each developer's
    pages. With ``referrer_col`` a page whose only app is the referrer is a leaf:
    ``is_leaf`` is set and its type is the first present one (default 'App Bundles').
    """
    carried = [c for c in (prev_ipad_col, referrer_col) if c and c not in key_cols]
    x = pages.select(*key_cols, *carried, to_xhtml(html_col).alias("_x"))
    f = xpath_fields(x, "_x", DEVELOPER_PAGE_SPEC, keep=[*key_cols, *carried])
    ids = lambda a: F.transform(a, lambda u: F.regexp_extract(u, R.APP_ID, 1))
    f = f.withColumn("_ipad", ids("ipad_links"))
    before = F.col(prev_ipad_col) if prev_ipad_col else F.lit(None).cast("array<string>")
    same = same_as_page_before("_ipad", *along) if along else F.coalesce(F.col("_ipad") == before, F.lit(False))
    f = f.withColumn("_same", same)
    chosen = F.when(F.col("_same"), ids("iphone_links")).otherwise(ids("all_links"))
    present = ["has_iphone", "has_ipad", "has_mac", "has_bundles"]
    f = f.withColumn("app_ids", F.array_sort(F.array_distinct(chosen)))
    types = app_types([F.col(c) > 0 for c in present])
    leaf = (F.size("app_ids") == 1) & (F.get("app_ids", 0) == F.col(referrer_col)) if referrer_col else F.lit(False)
    f = f.withColumn("is_leaf", F.coalesce(leaf, F.lit(False)))
    return f.select(*key_cols, only_elem_or_default("_names").alias("name"), "app_ids", F.size("app_ids").cast("bigint").alias("n_apps"),
                    F.when(F.col("is_leaf"), F.array(single_app_type(types))).otherwise(types).alias("app_types"),
                    single_app_type(types).alias("single_app_type"), "is_leaf",
                    F.col("_same").alias("same_ipad_as_before"), F.col("_ipad").alias("ipad_ids"), "n_iphone_pager", "n_ipad_pager")


def related_pages(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Related page -> also-bought app ids under their heading, their number, and
    the developer id of the 'more by this developer' link (N14/D13)."""
    x = pages.select(*key_cols, to_xhtml(html_col).alias("_x"))
    f = xpath_fields(x, "_x", RELATED_PAGE_SPEC, keep=list(key_cols))
    ids = F.filter(F.transform("also_bought", lambda u: F.regexp_extract(u, R.APP_ID, 1)), lambda s: s != "")
    dev = F.regexp_extract(F.get("developer_link", 0), R.APP_ID, 1)
    return f.select(*key_cols, ids.alias("related_ids"), F.size(ids).cast("bigint").alias("n_related"),
                    F.when(dev != "", dev).alias("developer_id"))


def task_job_pages(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Task job page -> task fields (N2/D4/C31): the job root must be single;
    campaign name and id by label patterns; numbers in order become
    work_done, work_total, payment, duration; countries are the words of the
    second block; the expected texts follow the 'What is expected' heading.
    Pages showing the 'not running' notice give no row."""
    from ..functions.processors import numbers_to_fields
    x = pages.select(*key_cols, to_xhtml(html_col).alias("_x"))
    f = xpath_fields(x, "_x", RW_JOB_SPEC, keep=list(key_cols))
    f = f.where((F.col("_roots") == 1) &
                ~F.exists("_running", lambda t: F.instr(t, NOT_RUNNING) > 0))
    info = F.array_join("_info", "\n")
    nums = F.flatten(F.transform("_nums", lambda t: F.regexp_extract_all(t, F.lit(R.NUMBER), 0)))
    countries = F.flatten(F.transform("_countries", lambda t: F.regexp_extract_all(t, F.lit(r"\w+"), 0)))
    name = F.regexp_extract(F.array_join("_name_lines", "\n"), R.CAMPAIGN_NAME, 1)
    return f.select(*key_cols, py_strip(name).alias("name"),
                    F.regexp_extract(info, R.CAMPAIGN_ID, 1).alias("id"),
                    *numbers_to_fields(nums, ["work_done", "work_total", "payment", "duration"],
                                       ["bigint", "bigint", "double", "bigint"]),
                    countries.alias("countries"), "expected")


DOC_PRODUCTS_SPEC = {"_hrefs": ("strings", "//a/@href"), "_texts": ("strings", "//text()")}


def document_product_ids(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Shared product-list document -> one row per product id (F6). Every id
    found in the links and the text is kept (the original single-value loader
    kept only the last one)."""
    from ..functions import regexes as R2
    x = pages.select(*key_cols, to_xhtml(html_col).alias("_x"))
    f = xpath_fields(x, "_x", DOC_PRODUCTS_SPEC, keep=list(key_cols))
    ids = F.flatten(F.transform(F.concat("_hrefs", "_texts"),
                                lambda t: F.regexp_extract_all(t, F.lit(R2.PRODUCT_ID), 1)))
    return (f.select(*key_cols, F.posexplode(F.array_distinct(ids)).alias("pos", "product_id")))


# ------------------------------------------------------------ spec machinery
def re_all(pattern: str, group: int = 0):
    """Step: every regex match over every extracted text (a selector's ``.re``)."""
    return lambda a: F.flatten(F.transform(a, lambda t: F.regexp_extract_all(t, F.lit(pattern), group)))


def nth(i: int):
    return lambda a: F.get(a, i)


def joined(sep: str = ""):
    return lambda a: F.array_join(a, sep)


def apply_spec(pages: DataFrame, key_cols, spec: dict, html_col: str = "html") -> DataFrame:
    """Page spec ``{field: (xpath, [step, ...])}`` -> one row per page (M1/M2):
    the page is repaired to XHTML once, each field is a built-in ``xpath``
    (array of strings) followed by Column steps (``re_all``, ``nth``,
    ``joined``, casts, processors)."""
    x = pages.select(*key_cols, to_xhtml(html_col).alias("_x"))
    cols = [F.col(k) for k in key_cols]
    for name, (path, steps) in spec.items():
        c = F.xpath(F.col("_x"), F.lit(path))
        for step in steps:
            c = step(c)
        cols.append(c.alias(name))
    return x.select(*cols)


def labelled(section: str, label: str, value: str = "span", nth_label: int | None = None) -> str:
    """XPath of the value next to a label inside a page section: the rule
    behind every 'Label: value' statistic on user pages."""
    lab = f'{section}//label[contains(text(), "{label}")]'
    if nth_label:
        lab = f"({lab})[{nth_label}]"
    return f"{lab}/following-sibling::{value}/text()"


def list_rows(pages: DataFrame, key_cols, row_tag, row_classes, fields: dict,
              html_col: str = "html") -> DataFrame:
    """List page -> one row per listed item (E5), one parse per page.

    Rows are the elements with tag ``row_tag`` carrying one of ``row_classes``,
    or, with ``row_tag`` an ElementTree path (starting with '.'), the elements
    it finds. ``fields`` maps a name to (path relative to the row, attribute),
    where the attribute is None for the element text, or to
    ("label_tail", tag, label) for the text right after the first ``tag``
    whose text contains ``label``."""
    key_cols = list(key_cols)
    key_schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in key_cols)
    names = list(fields)
    classes = set(row_classes or [])

    def value(row, spec):
        if spec[0] == "label_tail":
            el = next((b for b in row.iter(spec[1]) if spec[2] in (b.text or "")), None)
            return None if el is None else el.tail
        path, attr = spec
        el = row.find(path)
        return None if el is None else (el.get(attr) if attr else _text(el))

    def rows_of(html):
        if not isinstance(html, str):
            return []
        try:
            root = ET.fromstring(html_to_xhtml(html))
        except ET.ParseError:
            return []
        found = (root.findall(row_tag) if row_tag.startswith(".")
                 else [r for r in root.iter(row_tag) if classes & set(_classes(r))])
        return [(pos, *[value(row, f) for f in fields.values()]) for pos, row in enumerate(found)]

    def run(batches):
        for pdf in batches:
            keys = {c: pdf[c].tolist() for c in key_cols}
            rows = [tuple(keys[c][i] for c in key_cols) + r
                    for i, h in enumerate(pdf[html_col].tolist()) for r in rows_of(h)]
            yield pd.DataFrame(rows, columns=key_cols + ["row_pos"] + names)

    schema = ", ".join([key_schema, "row_pos int"] + [f"`{n}` string" for n in names])
    return pages.select(*key_cols, html_col).mapInPandas(run, schema)


def mw_list_rows(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Microworkers list page -> (job url, success percentage) per job (N3,
    D5, C21); rows without a job-detail link are skipped."""
    from ..functions.urls import resolve_url
    from .. operators.filters import job_detail_link
    r = list_rows(pages, key_cols, MW_LIST_ROW[0], MW_LIST_ROW[1], MW_LIST_FIELDS, html_col)
    return (r.where(job_detail_link("href"))
            .select(*key_cols, "row_pos", resolve_url(F.lit(MW_BASE_URL), F.col("href")).alias("job_url"),
                    py_strip("success_text").alias("success_pct_text")))


def mw_job_pages(pages: DataFrame, key_cols, html_col: str = "html", app_url_col: str | None = None) -> DataFrame:
    """Microworkers job page -> MWJob fields (N4/C26/C30/C31): name, job id,
    numbers in order (done, payment, duration), total from the superscript,
    employer id from the profile link, countries, category, expected and proof
    texts; platform and app id come from the app URL when given."""
    from ..functions.processors import numbers_to_fields, to_long
    from ..functions.urls import app_platform, employer_id
    spec = {field: (MW_JOB_XPATH[field], steps) for field, steps in {
        "_roots": [F.size],
        "name": [nth(0)],
        "id": [re_all(R.JOB_ID, 1), nth(0)],
        "_nums": [re_all(R.NUMBER)],
        "work_total": [re_all(R.NUMBER), nth(0), to_long],
        "_employer": [nth(0)],
        "countries": [re_all(R.COUNTRY)],
        "category": [re_all(R.SOME_TEXT), nth(0)],
        "expected": [],
        "proof": [],
    }.items()}
    extra = [app_url_col] if app_url_col else []
    f = apply_spec(pages.select(*key_cols, *extra, html_col), list(key_cols) + extra, spec, html_col)
    f = f.where(F.col("_roots") == 1)
    app = app_platform(app_url_col) if app_url_col else None
    return f.select(*key_cols, "name", "id",
                    *numbers_to_fields("_nums", ["work_done", "payment", "duration"], ["bigint", "double", "bigint"]),
                    "work_total", employer_id("_employer").alias("employer"), "countries", "category",
                    "expected", "proof",
                    *( [app["platform"].alias("app_platform"), app["app_id"].alias("app_id")] if app is not None else []))


def mw_user_pages(pages: DataFrame, key_cols, html_col: str = "html") -> DataFrame:
    """Microworkers user page -> MWUser fields (N5), every field by the
    label -> following value rule; 'Satisfied' excludes 'Not-Satisfied';
    paid totals go through the 'n/a' rule (C7)."""
    from ..functions.processors import na_to_double, py_strip as strip, to_double, to_long
    steps = {
        "text": [joined(""), strip],
        "words": [re_all(R.SOME_TEXT), nth(0)],
        "long": [re_all(R.NUMBER), nth(0), to_long],
        "double": [re_all(R.NUMBER), nth(0), to_double],
        "na_double": [joined(""), na_to_double],
    }
    spec = {}
    for field, section, label, occ, kind in MW_USER_FIELDS:
        path = labelled(section, label, nth_label=occ)
        if label == "Satisfied":
            path = path.replace('[contains(text(), "Satisfied")]',
                                '[contains(text(), "Satisfied") and not(contains(text(), "Not"))]')
        spec[field] = (path, steps[kind])
    return apply_spec(pages, list(key_cols), spec, html_col)
