"""Page specs of the archived task sites (list pages and job pages).

Each site is a table of locators: list rows via ``list_rows`` (one parse per
page) and job fields via ``apply_spec`` (built-in ``xpath`` + Column steps).
The locators are the fixed values in ``locators.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regexes as R
from ..functions.processors import na_to_double, numbers_to_fields, py_strip, split_strip, to_double, to_long
from ..functions.urls import employer_id, resolve_url
from ..operators.joins import enrich
from .extract import apply_spec, joined, list_rows, nth, re_all
from .locators import (CC_COUNTRY, CC_JOB_XPATH, CC_MEMBER_SINCE, CC_ROW_CLASSES, CC_USER_FIELDS, CC_USER_ID, CC_USER_XPATH,
                       DURATION_MINUTES, EXPIRES, JB_BASE_URL, JB_JOB_XPATH, JB_PAGES_XPATH, JB_ROWS, LAST_PAGE,
                       LEGACY_MW_JOB_XPATH, LEGACY_MW_ROWS, LEGACY_MW_USER_FIELDS, MF_JOB_XPATH, MF_ROWS, NOT_ACTIVE,
                       NOT_RUNNING, ST_JOB_XPATH, ST_LAST_PAGE, ST_PAGES_XPATH, ST_ROW_CLASSES, SUCCESS)

def _keep(pages: DataFrame, key_cols, extra=()):
    return list(key_cols) + [c for c in extra if c in pages.columns]


# ------------------------------------------------------------------ lists (E5)
def legacy_mw_list(pages: DataFrame, key_cols, url_col: str = "url") -> DataFrame:
    """Older microworkers list (N6): running rows, success text and job link."""
    r = list_rows(pages, _keep(pages, key_cols, [url_col]), LEGACY_MW_ROWS, None,
                  {"href": ("./td[2]//a", "href"), "success": ("./td[4]", None)})
    return r.select(*key_cols, "row_pos", resolve_url(url_col, "href").alias("job_url"),
                    py_strip("success").alias("success_pct_text"))


def cc_list(pages: DataFrame, key_cols, url_col: str = "url") -> DataFrame:
    """Clickchores list (N7): featured / even / odd rows with the job link."""
    r = list_rows(pages, _keep(pages, key_cols, [url_col]), "tr", CC_ROW_CLASSES,
                  {"href": ("./td[1]//a", "href")})
    return r.select(*key_cols, "row_pos", resolve_url(url_col, "href").alias("job_url"))


def jb_list(pages: DataFrame, key_cols) -> DataFrame:
    """Jobboy list (N8): job link and success number per row; the page count
    comes from the footer ('N of M', pages numbered from 0)."""
    r = list_rows(pages, list(key_cols), JB_ROWS, None,
                  {"href": (".//a", "href"), "success": ("./td[4]", None)})
    return r.select(*key_cols, "row_pos", resolve_url(F.lit(JB_BASE_URL), "href").alias("job_url"),
                    F.get(F.regexp_extract_all("success", F.lit(R.NUMBER), 0), 0).cast("double").alias("success_pct"))


def jb_page_count(pages: DataFrame, key_cols) -> DataFrame:
    """Jobboy page count from the list footer ('N of M')."""
    return apply_spec(pages, list(key_cols), _spec(JB_PAGES_XPATH, {"n_pages": [re_all(LAST_PAGE, 1), nth(0), to_long]}))


def mf_list(pages: DataFrame, key_cols, url_col: str = "url") -> DataFrame:
    """Minifreelance list (N9): running rows, success in the 12th cell."""
    r = list_rows(pages, _keep(pages, key_cols, [url_col]), MF_ROWS, None,
                  {"href": ("./td[2]//a", "href"), "success": ("./td[12]", None)})
    return r.select(*key_cols, "row_pos", resolve_url(url_col, "href").alias("job_url"),
                    F.get(F.regexp_extract_all("success", F.lit(R.NUMBER), 0), 0).cast("double").alias("success_pct"))


def st_list(pages: DataFrame, key_cols, url_col: str = "url") -> DataFrame:
    """Shorttask list (N10): task link, its job id and the expiry text after 'Expires'."""
    r = list_rows(pages, _keep(pages, key_cols, [url_col]), "div", ST_ROW_CLASSES,
                  {"href": ("./p[@class='view-task']/a", "href"), "expire_raw": ("label_tail", "b", "Expires")})
    job_id = F.regexp_extract("href", R.SITE_ID, 1)
    return r.select(*key_cols, "row_pos", resolve_url(url_col, "href").alias("job_url"),
                    F.when(job_id != "", job_id).alias("job_id"),
                    py_strip(F.regexp_extract("expire_raw", EXPIRES, 1)).alias("expire"))


def st_page_count(pages: DataFrame, key_cols) -> DataFrame:
    """Shorttask page count from the list's link to the last page (N10); null without one."""
    return apply_spec(pages, list(key_cols), _spec(ST_PAGES_XPATH, {"n_pages": [re_all(ST_LAST_PAGE, 1), nth(0), to_long]}))


# ----------------------------------------------------------------- job pages
def _spec(xpaths: dict, steps: dict) -> dict:
    """Pair each field's locator with its processing steps."""
    return {field: (xpaths[field], st) for field, st in steps.items()}


def _has_notice(notice: str):
    return lambda a: F.exists(a, lambda t: F.instr(t, notice) > 0)


def legacy_mw_job(pages: DataFrame, key_cols) -> DataFrame:
    """Older microworkers job layout (N6): fields from nested tables."""
    spec = _spec(LEGACY_MW_JOB_XPATH, {
        "name": [nth(0)],
        "id": [re_all(R.JOB_ID, 1), nth(0)],
        "_nums": [re_all(R.NUMBER)],
        "_employer": [nth(0)],
        "countries": [re_all(R.COUNTRY)],
        "category": [re_all(R.SOME_TEXT), nth(0)],
        "sub_category": [re_all(R.SOME_TEXT), nth(0)],
        "expected": [],
        "proof": [],
    })
    f = apply_spec(pages, list(key_cols), spec)
    return f.select(*key_cols, "name", "id",
                    *numbers_to_fields("_nums", ["work_done", "work_total", "payment", "duration"],
                                       ["bigint", "bigint", "double", "bigint"]),
                    employer_id("_employer").alias("employer"), "countries", "category", "sub_category",
                    "expected", "proof")


def cc_job(pages: DataFrame, key_cols) -> DataFrame:
    """Clickchores job page (N7/C20): featured flag, success, minutes to
    complete, work done = total - available positions; a 'not running'
    notice gives no row."""
    spec = _spec(CC_JOB_XPATH, {
        "_running": [_has_notice(NOT_RUNNING)],
        "name": [nth(0)],
        "countries": [re_all(R.COUNTRY)],
        "expected": [],
        "proof": [],
        "id": [re_all(R.JOB_ID, 1), nth(0)],
        "featured": [lambda a: F.size(a) > 0],
        "_b": [re_all(R.NUMBER)],
        "_remain": [re_all(R.NUMBER), nth(0), to_long],
        "success_pct": [re_all(SUCCESS, 1), nth(0), to_double],
        "duration": [re_all(DURATION_MINUTES), nth(0), to_long],
        "cat": [],
        "_employer": [nth(0)],
    })
    f = apply_spec(pages, list(key_cols), spec).where(~F.col("_running"))
    total = to_long(F.get("_b", 1))
    return f.select(*key_cols, "name", "id", "featured", to_double(F.get("_b", 0)).alias("payment"),
                    total.alias("work_total"), (total - F.col("_remain")).alias("work_done"),
                    "success_pct", "duration", "countries", "expected", "proof", "cat",
                    employer_id("_employer", R.SITE_ID).alias("employer"))


def jb_job(pages: DataFrame, key_cols) -> DataFrame:
    """Jobboy job page (N8/D3): numbers in the order payment, duration, done,
    total; kept only when amazon and a review word appear over the
    description texts."""
    from ..operators.filters import amazon_review_cumulative
    spec = _spec(JB_JOB_XPATH, {
        "expected": [],
        "_nums": [re_all(R.NUMBER)],
        "id": [re_all(R.NUMBER), nth(0)],
        "name": [joined(""), py_strip],
    })
    f = apply_spec(pages, list(key_cols), spec).where(amazon_review_cumulative("expected"))
    return f.select(*key_cols, "name", "id",
                    *numbers_to_fields("_nums", ["payment", "duration", "work_done", "work_total"],
                                       ["double", "bigint", "bigint", "bigint"]), "expected")


def mf_job(pages: DataFrame, key_cols) -> DataFrame:
    """Minifreelance job page (N9/C24): numbers in order done, total,
    payment, duration; countries are one comma-separated cell."""
    spec = _spec(MF_JOB_XPATH, {
        "name": [re_all(R.SOME_TEXT), nth(0)],
        "id": [re_all(R.JOB_ID, 1), nth(0)],
        "_nums": [re_all(R.NUMBER)],
        "_countries": [re_all(R.SOME_TEXT), nth(0)],
        "expected": [],
        "proof": [],
    })
    f = apply_spec(pages, list(key_cols), spec)
    return f.select(*key_cols, "name", "id",
                    *numbers_to_fields("_nums", ["work_done", "work_total", "payment", "duration"],
                                       ["bigint", "bigint", "double", "bigint"]),
                    split_strip("_countries", ",").alias("countries"), "expected", "proof")


def st_job(pages: DataFrame, key_cols) -> DataFrame:
    """Shorttask job page (N10/D4): values follow bold labels in the task
    header; the 'not active' notice gives no row."""
    spec = _spec(ST_JOB_XPATH, {
        "_inactive": [_has_notice(NOT_ACTIVE)],
        "name": [joined(""), py_strip],
        "work_remain": [re_all(R.NUMBER), nth(0), to_long],
        "employer": [joined(""), py_strip],
        "payment": [re_all(R.NUMBER), nth(0), to_double],
        "duration": [re_all(R.NUMBER), nth(0), to_long],
        "expected": [],
    })
    return apply_spec(pages, list(key_cols), spec).where(~F.col("_inactive")).drop("_inactive")


def st_tasks(lists: DataFrame, pages: DataFrame, key_cols, url_col: str = "url") -> DataFrame:
    """Shorttask jobs with what only their list rows say (N10/F2): job id and expiry, by the job page's URL.

    A job that stands on several list pages takes the row of the smallest id and expiry; a job
    page without a list row stays, with nulls.
    """
    rows = st_list(lists, key_cols, url_col).groupBy("job_url").agg(F.min(F.struct("job_id", "expire")).alias("r"))
    jobs = st_job(pages, [*key_cols, url_col])
    return enrich(jobs, rows.select(F.col("job_url").alias(url_col), "r.job_id", "r.expire"), url_col)


# ---------------------------------------------------------------- user pages
_VALUES = {
    "text": [joined(""), py_strip],
    "words": [re_all(R.SOME_TEXT), nth(0)],
    "long": [re_all(R.NUMBER), nth(0), to_long],
    "double": [re_all(R.NUMBER), nth(0), to_double],
    "na_double": [joined(""), na_to_double],
}


def cc_user(pages: DataFrame, key_cols) -> DataFrame:
    """Clickchores user page (N7): id, country and date from the head, statistics by the text behind their label;
    a page without worker or employer statistics has nulls there."""
    spec = _spec(CC_USER_XPATH, {
        "name": _VALUES["text"],
        "id": [re_all(CC_USER_ID, 1), nth(0)],
        "country": [re_all(CC_COUNTRY), nth(0)],
        "member_since": [re_all(CC_MEMBER_SINCE, 1), nth(0), py_strip],
    })
    for field, section, label, kind in CC_USER_FIELDS:
        spec[field] = (f"({section}/label[{label}]/following-sibling::text())[1]", _VALUES[kind])
    return apply_spec(pages, list(key_cols), spec)


def legacy_mw_user(pages: DataFrame, key_cols) -> DataFrame:
    """User page of the older microworkers layout (N6): every value stands in the cell behind its label's."""
    spec = {}
    for field, table, label, bold, occurrence, kind in LEGACY_MW_USER_FIELDS:
        name = "b/text()" if bold in ("label", "both") else "text()"
        guard = ' and not(contains(text(), "Not"))' if label == "Satisfied" else ""
        cell = f'//table[@id="{table}"]//td[contains({name}, "{label}"){guard}]'
        if occurrence:
            cell = f"({cell})[{occurrence}]"
        value = "b/text()" if bold in ("value", "both") else "text()"
        spec[field] = (f"{cell}/following-sibling::td/{value}", _VALUES[kind])
    return apply_spec(pages, list(key_cols), spec)
