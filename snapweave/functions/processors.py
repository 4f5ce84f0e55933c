"""Item field processors as Column expressions.

Each helper takes and returns a ``Column`` so that a whole field chain compiles
into one Catalyst expression and stays inside whole-stage codegen. ``compile_spec``
turns a declarative ``{field: [step, ...]}`` table into a projection (the
declarative form of per-field input/output processor chains).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regexes as R

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- strings (C4)
def py_strip(x: ColumnOrName) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace (incl. NBSP, tabs).
    ``btrim`` with the explicit character set (Spark's ``trim`` only removes
    spaces)."""
    return F.btrim(_c(x), F.lit(R.PY_SPACE_CHARS))


def strip_each(a: ColumnOrName) -> Column:
    """``MapCompose(unicode.strip)`` over an array."""
    return F.transform(_c(a), py_strip)


# ------------------------------------------------------------ arrays
def filter_empty(a: ColumnOrName) -> Column:
    """Drop falsy strings (NULL and '') from an array."""
    return F.filter(_c(a), lambda x: x.isNotNull() & (x != F.lit("")))


def only_elem(a: ColumnOrName, strict: bool = False) -> Column:
    """Exactly one element. Lenient mode gives NULL when the size is not 1
    (pair with ``elem_count_error``); strict mode fails the task."""
    a = _c(a)
    bad = F.lit(None) if not strict else F.raise_error(F.lit("only_elem: expected exactly one element"))
    return F.when(F.size(a) == 1, F.get(a, 0)).otherwise(bad)


def only_elem_or_default(a: ColumnOrName, default: Column | None = None, strict: bool = False) -> Column:
    """Zero or one element; zero gives ``default``."""
    a = _c(a)
    default = default if default is not None else F.lit(None)
    bad = F.lit(None) if not strict else F.raise_error(F.lit("only_elem_or_default: more than one element"))
    return (F.when(F.size(a) == 0, default)
            .when(F.size(a) == 1, F.get(a, 0))
            .otherwise(bad))


def elem_count_error(a: ColumnOrName, field: str, allowed: str = "one") -> Column:
    """Error text for the ``_errors`` column when C1/C2 reject a value."""
    a = _c(a)
    bad = (F.size(a) != 1) if allowed == "one" else (F.size(a) > 1)
    return F.when(bad, F.format_string(f"{field}: %d elements", F.size(a)))


def join_clean(a: ColumnOrName, sep: str = " ") -> Column:
    """strip -> filter_empty -> join (the review comment chain, C5)."""
    return F.array_join(filter_empty(strip_each(a)), sep)


def split_strip(x: ColumnOrName, sep: str = ",") -> Column:
    """Split a country-like list on ``sep`` and strip each part."""
    return strip_each(F.split(_c(x), sep))


def zip_concat(a: ColumnOrName, b: ColumnOrName, sep: str = "") -> Column:
    """Pairwise concat of two lists, truncated to the shorter one."""
    a, b = _c(a), _c(b)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.concat_ws(sep, x, y))


# ------------------------------------------------------------- casts
def to_long(x: ColumnOrName) -> Column:
    """Python ``int(text)``: only optional sign and digits (surrounding spaces
    allowed); anything else (e.g. '12.5') gives NULL instead of raising."""
    s = py_strip(_c(x).cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def to_double(x: ColumnOrName) -> Column:
    return py_strip(_c(x).cast("string")).try_cast("double")


def na_to_double(x: ColumnOrName) -> Column:
    """'n/a' in any case -> NULL, else float."""
    s = _c(x)
    return F.when(F.lower(py_strip(s)) != F.lit("n/a"), to_double(s))


def blank_na_to_double(x: ColumnOrName) -> Column:
    """success_pct rule of the typed snapshot scan: '', NULL and 'N/A' -> NULL."""
    s = py_strip(_c(x).cast("string"))
    return F.when(~s.isin("", "N/A"), s.try_cast("double"))


def to_bool(x: ColumnOrName) -> Column:
    """Python truthiness of a scalar text value."""
    s = _c(x).cast("string")
    return s.isNotNull() & (s != F.lit(""))


def single_value(*candidates_in_add_order: ColumnOrName) -> Column:
    """Single-value field: the last added non-falsy value wins.

    ``candidates`` are in the order the values were added; NULL, '' and empty
    arrays are ignored, 0 and False are kept.
    """
    cols = [_c(c) for c in candidates_in_add_order]
    return F.coalesce(*[_nullify_falsy(c) for c in reversed(cols)])


def _nullify_falsy(c: Column) -> Column:
    # Works for strings; arrays are handled by nullify_empty_array.
    return F.when(c.cast("string") != F.lit(""), c)


def nullify_empty_array(a: ColumnOrName) -> Column:
    a = _c(a)
    return F.when(F.size(a) > 0, a)


def single_value_array(*candidates_in_add_order: ColumnOrName) -> Column:
    """Single-value list field (C8): the last added non-empty list wins."""
    return F.coalesce(*[nullify_empty_array(c) for c in reversed(candidates_in_add_order)])


# ----------------------------------------------------------- numbers
def numbers(txt: ColumnOrName) -> Column:
    """All numbers in a text, in order (``1,234`` gives two numbers)."""
    return F.regexp_extract_all(_c(txt), F.lit(R.NUMBER), 0)


def numbers_to_fields(nums: ColumnOrName, names: Sequence[str], types: Sequence[str]) -> list[Column]:
    """Numbers-in-order -> named typed fields (``t[0]`` = names[0], ...)."""
    nums = _c(nums)
    out = []
    for i, (name, typ) in enumerate(zip(names, types)):
        v = F.get(nums, i)
        out.append((to_long(v) if typ == "bigint" else to_double(v)).alias(name))
    return out


# ------------------------------------------------------------- labels
def star_values(labels: ColumnOrName) -> Column:
    """'5 stars' -> '5' for every label; always an array (empty stays empty)."""
    return F.transform(_c(labels), lambda x: F.split(x, " ").getItem(0))


def text_after_by(x: ColumnOrName) -> Column:
    """Reviewer name: text after the first 'by '; NULL when there is none."""
    x = _c(x)
    return F.when(F.instr(x, "by ") > 0, py_strip(F.regexp_extract(x, r"(?s)^.*?by (.*)$", 1)))


# ------------------------------------------------------------- misc
def crawl_stamp(ts: str | None = None) -> Column:
    """Crawl time of a row (C18): a fixed stamp for deterministic re-runs, else
    the query's current timestamp (one value for the whole query)."""
    return F.to_timestamp(F.lit(ts)) if ts else F.current_timestamp()


def flatten_text(a: ColumnOrName) -> Column:
    """Text nodes joined with '' before a substring search."""
    return F.array_join(_c(a), "")


def union_ids(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Set union of two id arrays, sorted for a deterministic result."""
    return F.array_sort(F.array_union(F.coalesce(_c(a), F.array()), F.coalesce(_c(b), F.array())))


# ------------------------------------------------------------------ JSON text
def json_scalar(x: ColumnOrName) -> Column:
    """JSON text of any value (scalar, array, struct); NULL stays NULL."""
    x = _c(x)
    t = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substring(t, F.lit(2), F.length(t) - F.lit(2)))


# ------------------------------------------------------------ spec compiler (M1)
Step = Callable[[Column], Column]


def compile_spec(df: DataFrame, spec: dict[str, Sequence[Step] | tuple[str, Sequence[Step]]],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Compile ``{out_field: (source_column, [step, ...])}`` to one projection.

    Steps run in order, like an item loader's processor chain; a NULL flows
    through as NULL (Compose stops on None). Everything stays a Column
    expression, so the projection is one codegen stage and Catalyst prunes
    unused source columns.
    """
    cols = [F.col(k) for k in keep]
    for out, body in spec.items():
        src, steps = body if isinstance(body, tuple) else (out, body)
        c = F.col(src) if isinstance(src, str) else src
        for step in steps:
            c = step(c)
        cols.append(c.alias(out))
    return df.select(*cols)
