"""Text columns: cleaning, contact standardisation, slugs (TXT-1, TXT-2, SC-6..8).

All are column expressions; cleaning walks the *schema* (nested structs and
arrays included), never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.calendar import latin_digits

# The characters HTML-escaped by the reference (ENT_QUOTES).
HTML_ESCAPES = [("&", "&amp;"), ('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")]


# Characters PHP's trim() removes by default.
PHP_TRIM = " \t\n\r\x00\x0b"


def html_escape(c: Column) -> Column:
    for raw, esc in HTML_ESCAPES:  # '&' first
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def html_unescape(c: Column) -> Column:
    for raw, esc in reversed(HTML_ESCAPES):  # '&amp;' last
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def _clean(c: Column, dtype: T.DataType, fn) -> Column:
    if isinstance(dtype, T.StringType):
        return fn(c)
    if isinstance(dtype, T.StructType):
        return F.when(c.isNull(), F.lit(None).cast(dtype)).otherwise(F.struct(*[
            _clean(c[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, dtype.elementType, fn))
    return c


def clean_text(df: DataFrame, inverse: bool = False) -> DataFrame:
    """TXT-1: trim and HTML-escape every string column, nested ones too
    (``inverse=True`` undoes the escaping for analysis)."""
    fn = html_unescape if inverse else (lambda c: html_escape(F.btrim(c, F.lit(PHP_TRIM))))
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType, fn).alias(f.name)
                       for f in df.schema.fields])


def norm_phone(c: Column) -> Column:
    """SC-8: Latin digits, strip non-digits, then: ``09``+9 digits kept;
    ``9``+9 gets a leading 0; ``989``+9 and ``98``+9 lose the 98 and get 0;
    anything else stays as the bare digits."""
    d = F.regexp_replace(latin_digits(c), r"[^0-9]", "")
    return (F.when(d.rlike(r"^09\d{9}$"), d)
            .when(d.rlike(r"^9\d{9}$"), F.concat(F.lit("0"), d))
            .when(d.rlike(r"^98\d{9,10}$") & (F.length(d).isin(11, 12)),
                  F.concat(F.lit("0"), F.substring(d, 3, 100)))
            .otherwise(d))


def standardise_contacts(df: DataFrame, phone_col: str = "phone", key: str = "id") -> DataFrame:
    """TXT-2: normalised phone per row and a duplicate report in long form:
    one row per (normalised phone, row key) for every phone held by more than
    one row, with the size of that group. No group is collected into one
    row, so a phone shared by a huge number of rows stays distributed."""
    norm = df.withColumn("phone_norm", norm_phone(F.col(phone_col)))
    counts = norm.groupBy("phone_norm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return norm.join(counts, "phone_norm").select("phone_norm", F.col(key).alias("id"), "n")


# SC-6: characters a slug keeps (ASCII letters, digits, whitespace, '-', '_',
# and the Arabic block U+0600-U+06FF).
_SLUG_DROP = r"[^a-zA-Z0-9\s\-_\x{0600}-\x{06FF}]"


def slug(df: DataFrame, title_col: str, date_col: str, out: str = "slug") -> DataFrame:
    """SC-6: title with unsupported characters removed, then
    `` dd MonthName yyyy`` of the Jalali date (Latin digits), whitespace runs
    to '-', lower case, leading / trailing '-' trimmed."""
    from eventide.functions.calendar import MONTH_NAMES, _let, jalali_of
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    suffix = _let(jalali_of(F.col(date_col).cast("date")), lambda p: F.concat(
        F.lit(" "), F.lpad(p["jd"].cast("string"), 2, "0"), F.lit(" "), F.get(names, p["jm"] - 1),
        F.lit(" "), p["jy"].cast("string")))
    s = F.concat(F.regexp_replace(F.col(title_col), _SLUG_DROP, ""), F.coalesce(suffix, F.lit("")))
    s = F.lower(F.regexp_replace(s, r"\s+", "-"))
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return df.withColumn(out, s)
