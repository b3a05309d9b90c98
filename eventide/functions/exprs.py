"""Projection, predicate and scalar helpers (PRJ-*, FLT-*, SC-*).

All of them return Catalyst ``Column`` expressions, so they stay inside
whole-stage codegen and filters reach the parquet scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base URL prefix for stored media paths (deployment setting).
MEDIA_BASE_URL = "https://media.example/"


def ts_lit(text: str) -> Column:
    """An as-of literal in the batch time type."""
    return F.lit(text).cast("timestamp_ntz")


# --- PRJ ------------------------------------------------------------------

def full_name(first: str | Column, last: str | Column) -> Column:
    """PRJ-1: first + ' ' + last; NULL if either part is NULL (as CONCAT)."""
    return F.concat(F.col(first) if isinstance(first, str) else first, F.lit(" "),
                    F.col(last) if isinstance(last, str) else last)


def nested(**cols: Column) -> Column:
    """PRJ-2: a struct keeping NULL fields (JSON_OBJECT keeps NULL keys)."""
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def full_url(path: str | Column, base: str = MEDIA_BASE_URL) -> Column:
    """PRJ-4: media path with the site prefix; a NULL path gives the bare prefix."""
    p = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit(base), F.coalesce(p, F.lit("")))


USER_COLUMNS = ["id", "username", "first_name", "last_name", "gender", "phone", "national_id",
                "birth_date", "role", "avatar", "is_active", "registered_at"]


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns to top-level columns ``parent_child`` (for flat outputs)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            for sub in f.dataType.fields:
                cols.append(F.col(f"`{f.name}`.`{sub.name}`").alias(f"{f.name}{sep}{sub.name}"))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# --- FLT ------------------------------------------------------------------

def by_key(df: DataFrame, col: str, values) -> DataFrame:
    """FLT-1: equality lookup; a DataFrame of keys becomes a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)).distinct(), col,
                       "left_semi")
    if isinstance(values, (list, tuple, set)):
        return df.filter(F.col(col).isin(list(values)))
    return df.filter(F.col(col) == F.lit(values))


def visible(events: DataFrame, mode: str = "public") -> DataFrame:
    """FLT-2: public = verified and not private; slug = verified only;
    leader = not private only (a leader's own list shows pending ones)."""
    if mode == "public":
        return events.filter((F.col("status") == "verified") & ~F.col("is_private"))
    if mode == "slug":
        return events.filter(F.col("status") == "verified")
    if mode == "leader":
        return events.filter(~F.col("is_private"))
    raise ValueError(mode)


def like_pattern_to_regex(text: str) -> str:
    """LIKE '%text%' with the user's own % and _ kept as wildcards (as the
    reference binds the raw text into the pattern)."""
    out = []
    for ch in text:
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
    return "(?s).*" + "".join(out) + ".*"


def location_like(text: str, col: str = "location") -> Column:
    """FLT-3: case-insensitive substring test on location."""
    if "%" in text or "_" in text:
        return F.lower(F.col(col)).rlike(like_pattern_to_regex(text.lower()))
    return F.lower(F.col(col)).contains(text.lower())


def on_day(day: str, col: str = "start_time") -> Column:
    """FLT-4: calendar-day equality written as a half-open range (prunable).

    ``day`` is ``YYYY-MM-DD`` (Gregorian); ``event_catalog`` converts Jalali
    text with ``eventide.functions.calendar.jalali_text_to_gregorian`` first.
    """
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    return (F.col(col) >= start) & (F.col(col) < start + F.expr("INTERVAL 1 DAY"))


def in_categories(ids: str | list, col: str = "category_id") -> Column:
    """FLT-5: IN list from comma text."""
    if isinstance(ids, str):
        ids = [x.strip() for x in ids.split(",") if x.strip()]
    return F.col(col).isin([int(x) for x in ids])


def of_leader(leader_id: int, col: str = "leader_id") -> Column:
    """FLT-6: owner filter."""
    return F.col(col) == F.lit(leader_id)


def grouping_filter(n: int, col: str = "grouping") -> Column:
    """FLT-7: below 20 means equal, otherwise strictly greater."""
    return F.col(col) == F.lit(n) if n < 20 else F.col(col) > F.lit(n)


_HOUR_RANGE = re.compile(r"(\d+)\s*-\s*(\d+)")


def hour_ranges(text: str, col: str = "start_time") -> Column | None:
    """FLT-8: OR of half-open hour ranges "a-b,c-d"; parts that do not match
    are ignored; None (no filter) when none is valid."""
    conds = []
    for part in text.split(","):
        m = _HOUR_RANGE.search(part.strip())
        if m:
            a, b = int(m.group(1)), int(m.group(2))
            conds.append((F.hour(col) >= a) & (F.hour(col) < b))
    return reduce(lambda x, y: x | y, conds) if conds else None


def unattached(medias: DataFrame) -> DataFrame:
    """FLT-9: media rows not linked to an event yet."""
    return medias.filter(F.col("event_id").isNull())


def not_canceled(reservations: DataFrame) -> DataFrame:
    """FLT-10: the ON-clause condition, applied before the outer join."""
    return reservations.filter(F.col("status") != "canceled")


def live_codes(otps: DataFrame, as_of_epoch: int | Column) -> DataFrame:
    """FLT-15: unused codes that have not expired at the given epoch second."""
    now = as_of_epoch if isinstance(as_of_epoch, Column) else F.lit(as_of_epoch)
    return otps.filter(~F.col("is_used") & (now < F.col("expires_at")))


# --- SC -------------------------------------------------------------------

def coalesce_text(c: str | Column, default: str = "") -> Column:
    """SC-1: IFNULL(text, default)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(default))


def minute_text(ts: str | Column) -> Column:
    """SC-2: DATE_FORMAT(ts, '%Y/%m/%d %H:%i')."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy/MM/dd HH:mm")


def json_ids(c: str | Column) -> Column:
    """SC-3: JSON id list (numbers or quoted numbers) to array<bigint>."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.from_json(c, "array<string>"), lambda x: x.try_cast("bigint"))


def final_price(price: Column, discount: Column) -> Column:
    """SC-4: max(0, price - discount); a NULL discount counts as 0."""
    return F.greatest(F.lit(0).cast("decimal(20,2)"),
                      price.cast("decimal(20,2)") - F.coalesce(discount, F.lit(0)).cast(
                          "decimal(20,2)"))


def plus_week(c: str | Column) -> Column:
    """SC-9: add one week."""
    c = F.col(c) if isinstance(c, str) else c
    return c + F.expr("INTERVAL 7 DAYS")
