"""Column expressions shared by the analyses.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
#   pool identifier separator "/", text for a missing pool part "nan",
#   the cluster name that marks a default cluster "default",
#   the iaas cluster assumed for a bare pool name in the scale-down analysis "default",
#   deployment status for a service found in other pools "多资源池",
#   deployment status for a service found in one pool only "单资源池",
#   display text for an empty value "-", highlight threshold for save_cores 10.
POOL_SEP = "/"
NULL_PART = "nan"
DEFAULT_CLUSTER = "default"
DEFAULT_IAAS = "default"
STATUS_MULTI = "多资源池"
STATUS_SINGLE = "单资源池"
EMPTY_DISPLAY = "-"
PRIORITY_CORES = 10
# Blanks cut off around numbers, pools and list items: space, tab, line feed,
# vertical tab, form feed, carriage return.
BLANKS = " \t\n\v\f\r"

# A decimal number as a forgiving text parser accepts it: optional sign,
# digits with an optional fraction (or a bare fraction), optional exponent.
# Spark's own string->double cast also accepts Java suffixes such as "12d";
# the regex guard keeps those out so text parses the same as elsewhere.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
POOL_PATTERN = r"^[\w-]+/[\w-]+$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Text without blanks at either end (see :data:`BLANKS`)."""
    return F.btrim(col_(c).cast("string"), F.lit(BLANKS))


def coerce_number(c: str | Column) -> Column:
    """Text or number -> double; blanks, words and malformed text -> null.

    Leading/trailing blanks are ignored, exponents are accepted and the
    word ``nan`` yields null (NaN folded into null).
    """
    s = strip(c)
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def number_or_zero(c: str | Column) -> Column:
    """Coerced number with bad or missing values as 0 (summary form)."""
    return F.coalesce(coerce_number(c), F.lit(0.0))


def count_or_zero(c: str | Column) -> Column:
    """Coerced number, bad -> 0, truncated toward zero to bigint (detail form)."""
    return F.coalesce(number_or_zero(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def pool_key(physical: str | Column = "physical_cluster",
             iaas: str | Column = "iaas_cluster") -> Column:
    """``physical/iaas`` with a missing part written as ``nan``."""
    return F.concat(F.coalesce(col_(physical), F.lit(NULL_PART)), F.lit(POOL_SEP),
                    F.coalesce(col_(iaas), F.lit(NULL_PART)))


def split_pool(pool: Column) -> tuple[Column, Column, Column]:
    """Pool text -> (is_pair, physical, iaas) over trimmed parts.

    ``is_pair`` is true only for exactly one separator.
    """
    parts = F.split(strip(pool), POOL_SEP)
    is_pair = F.size(parts) == 2
    return (is_pair,
            F.when(is_pair, strip(F.element_at(parts, 1))),
            F.when(is_pair, strip(F.element_at(parts, 2))))


def normal_pool(pool: Column) -> Column:
    """Pool text in one spelling: ``physical/iaas`` without blanks around the
    parts; text that is no pair only loses the blanks at its ends."""
    ok, physical, iaas = split_pool(pool)
    return F.when(ok, F.concat(physical, F.lit(POOL_SEP), iaas)).otherwise(strip(pool))


def parse_pool_text(pool: str, bare: str = "error") -> tuple[str, str | None]:
    """Driver-side parse of a pool argument.

    bare='error'   -> exactly one separator required (migration)
    bare='default' -> a bare name means iaas ``default`` (scale-down)
    bare='any'     -> a bare name matches any iaas (None)   (migratable)
    Two or more separators count as bare.
    """
    text = (pool or "").strip(BLANKS)
    parts = text.split(POOL_SEP)
    if len(parts) == 2:
        return parts[0].strip(BLANKS), parts[1].strip(BLANKS)
    if bare == "error":
        raise ValueError(f"pool {pool!r} must look like 'physical_cluster/iaas_cluster'")
    if bare == "default":
        return text, DEFAULT_IAAS
    return text, None


def business_line(d1: str | Column = "dept_level1", d2: str | Column = "dept_level2") -> Column:
    """``dept1 + '/' + dept2`` with slashes stripped from both ends of dept2."""
    return F.concat(F.coalesce(col_(d1), F.lit("")), F.lit(POOL_SEP),
                    F.regexp_replace(F.coalesce(col_(d2), F.lit("")), r"^/+|/+$", ""))


def dash_if_blank(c: str | Column) -> Column:
    """Display form: null or empty text -> ``-``."""
    s = col_(c).cast("string")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(EMPTY_DISPLAY)).otherwise(s)


def split_list(c: str | Column, drop_empty: bool = True) -> Column:
    """Comma list -> array of trimmed items (empties dropped if asked)."""
    items = F.transform(F.split(F.coalesce(col_(c), F.lit("")), ","), strip)
    return F.filter(items, lambda x: x != "") if drop_empty else items


def list_size(c: str | Column) -> Column:
    """Number of items in a comma list, empty ones included; 0 for blank text."""
    text = F.coalesce(strip(c), F.lit(""))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, ",")))


def short_number(c: str | Column) -> Column:
    """1234 -> '1.2K', 2500000 -> '2.5M', smaller values as they are (999, 12.5)."""
    x = col_(c).cast("double")
    return (F.when(x >= 1e6, F.concat(F.format_string("%.1f", F.round(x / 1e6, 1)), F.lit("M")))
            .when(x >= 1e3, F.concat(F.format_string("%.1f", F.round(x / 1e3, 1)), F.lit("K")))
            .when(x == F.floor(x), x.cast("bigint").cast("string"))
            .otherwise(x.cast("string")))


def one_decimal(c: str | Column) -> Column:
    """``%.1f`` after rounding half away from zero on the decimal value."""
    return F.format_string("%.1f", F.round(col_(c).cast("double"), 1))


def one_line(c: str | Column) -> Column:
    """Text with line breaks replaced by a space (CSV export)."""
    return F.regexp_replace(col_(c).cast("string"), r"\r?\n", " ")


def search_text(cols: Sequence[str]) -> Column:
    """Lower-case text of a row that a search looks into."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                      for c in cols]))


def all_words_present(cols: Sequence[str], text: str) -> Column:
    """Every blank-separated word of ``text`` occurs somewhere in the row."""
    hay = search_text(cols)
    cond = F.lit(True)
    for word in text.lower().split():
        cond = cond & hay.contains(word)
    return cond


def in_list_or_all(c: str | Column, values: Iterable[str] | str | None) -> Column:
    """Site filter: ``None``/empty means every row; a string is one value."""
    if values is None:
        return F.lit(True)
    if isinstance(values, str):
        return F.lit(True) if values == "" else (col_(c) == values)
    vals = list(values)
    return F.lit(True) if not vals else col_(c).isin(vals)
