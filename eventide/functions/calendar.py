"""Jalali (Solar Hijri) calendar as date arithmetic (CAL-1..5).

Every conversion is a column expression over one date, so any year converts
and nothing is joined or looked up:

* a Jalali year is leap when ``((jy + 12) % 33) % 4 == 1`` (33-year cycle of
  12,053 days);
* months 1-6 have 31 days, 7-11 have 30, month 12 has 29 (30 in a leap year);
* day 1 of year 1403 is 2024-03-20 (one anchor pins everything).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The anchor and the cycle of leap years.
ANCHOR_JY = 1403
ANCHOR_DATE = "2024-03-20"
CYCLE_YEARS, CYCLE_DAYS = 33, 12053

# Fixed values (Persian names used by the reference's calendar output).
MONTH_NAMES = ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان",
               "آذر", "دی", "بهمن", "اسفند"]
MONTH_SHORT = ["فر", "ار", "خر", "تی‍", "مر", "شه‍", "مه‍", "آب‍", "آذ", "دی", "به‍", "اس‍"]
SEASON_NAMES = ["بهار", "تابستان", "پاییز", "زمستان"]
ZODIAC_NAMES = ["حمل", "ثور", "جوزا", "سرطان", "اسد", "سنبله", "میزان", "عقرب", "قوس", "جدی",
                "دلو", "حوت"]
YEAR_ANIMALS = ["مار", "اسب", "گوسفند", "میمون", "مرغ", "سگ", "خوک", "موش", "گاو", "پلنگ",
                "خرگوش", "نهنگ"]
# Weekday names with Saturday first (Jalali week: Saturday = 0).
WEEKDAY_NAMES = ["شنبه", "یکشنبه", "دوشنبه", "سه شنبه", "چهارشنبه", "پنجشنبه", "جمعه"]
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def _div(a: Column, k: int) -> Column:
    """Floor division by a positive number, for negative numbers too."""
    return F.floor((a - F.pmod(a, F.lit(k))) / k).cast("long")


def is_leap(jy: Column) -> Column:
    return F.pmod(F.pmod(jy + 12, F.lit(CYCLE_YEARS)), F.lit(4)) == 1


def _year_start(jy: Column) -> Column:
    """Days from the start of a cycle far back to the first day of a Jalali year."""
    y = jy.cast("long") + 12
    c = F.pmod(y, F.lit(CYCLE_YEARS))
    return _div(y, CYCLE_YEARS) * CYCLE_DAYS + c * 365 + _div(c + 2, 4)


def _anchor() -> Column:
    return F.lit(ANCHOR_DATE).cast("date")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body names it
    (Spark copies the expression of a column into every place of a pushed-down
    filter)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jalali_of(date: Column) -> Column:
    """CAL-1 core: struct of jy, jm, jd, doy (0-based) and leap of a date, any
    year; NULL for a NULL date."""
    def offset(c):  # days before year c of a cycle
        return c * 365 + _div(c + 2, 4)

    def fields(n, c):
        jy = _div(n, CYCLE_DAYS) * CYCLE_YEARS + c - 12
        return _let(F.pmod(n, F.lit(CYCLE_DAYS)) - offset(c), lambda doy: F.struct(
            jy.cast("int").alias("jy"),
            F.when(doy < 186, _div(doy, 31) + 1).otherwise(_div(doy - 186, 30) + 7).cast("int").alias("jm"),
            F.when(doy < 186, doy % 31 + 1).otherwise((doy - 186) % 30 + 1).cast("int").alias("jd"),
            doy.cast("int").alias("doy"), is_leap(jy).alias("leap")))

    def year(n):
        r = F.pmod(n, F.lit(CYCLE_DAYS))
        return _let(F.least(_div(r, 365), F.lit(CYCLE_YEARS - 1).cast("long")), lambda c: _let(
            c - (offset(c) > r).cast("long"), lambda d: fields(n, d)))

    n = F.datediff(date, _anchor()).cast("long") + _year_start(F.lit(ANCHOR_JY))
    return F.when(date.isNotNull(), _let(n, year))


def jalali_parts(date: Column) -> dict[str, Column]:
    """The fields of ``jalali_of`` as separate columns."""
    j = jalali_of(date)
    return {k: j[k] for k in ("jy", "jm", "jd", "doy", "leap")}


def month_length(jy: Column, jm: Column) -> Column:
    return (F.when(jm <= 6, 31).when(jm <= 11, 30)
            .otherwise(29 + is_leap(jy).cast("int")).cast("int"))


def to_gregorian(jy: Column, jm: Column, jd: Column) -> Column:
    """The date of a Jalali year, month and day; NULL for an impossible one."""
    def date(x):
        y, m, d = x["y"], x["m"], x["d"]
        ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= month_length(y, m))
        doy = F.when(m <= 7, (m - 1) * 31).otherwise(186 + (m - 7) * 30) + d - 1
        days = _year_start(y) + doy - _year_start(F.lit(ANCHOR_JY))
        return F.when(ok, F.date_add(_anchor(), days.cast("int")))

    return _let(F.struct(jy.alias("y"), jm.alias("m"), jd.alias("d")), date)


def _arr(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _week(date: Column) -> tuple[Column, Column]:
    """Number and year of a date's week. Weeks run Saturday..Friday; a week
    belongs to the year that holds its Tuesday, and its number is that
    Tuesday's day of year // 7 + 1."""
    p = jalali_of(F.date_add(date, (3 - F.dayofweek(date) % 7).cast("int")))
    return (_div(p["doy"], 7) + 1).cast("int"), p["jy"]


def with_calendar(df: DataFrame, col: str = "date") -> DataFrame:
    """CAL-1: ``df`` with the Jalali columns of its date column ``col``: year,
    month, day, month name and short name, season (number and name), weekday
    (Saturday = 0) and its name, leap flag, month length, day of year (0-based),
    days left, percent of the year passed, week and week-year, zodiac month
    name, year animal, and the date text in Persian digits. Any year; a NULL
    date has NULL in all of them."""
    date = F.col(col).cast("date")
    week, week_year = _week(date)
    df = df.withColumns(jalali_parts(date))
    leap, wd, season = F.col("leap").cast("int"), F.dayofweek(date) % 7, _div(F.col("jm") + 2, 3).cast("int")
    return df.withColumns({
        "month_name": F.get(_arr(MONTH_NAMES), F.col("jm") - 1),
        "month_short": F.get(_arr(MONTH_SHORT), F.col("jm") - 1),
        "season": season, "season_name": F.get(_arr(SEASON_NAMES), season - 1),
        "weekday": wd.cast("int"), "weekday_name": F.get(_arr(WEEKDAY_NAMES), wd.cast("int")),
        "month_len": F.when(F.col("jm").isNotNull(), month_length(F.col("jy"), F.col("jm"))),
        "day_of_year": F.col("doy"), "days_left": (leap + 364 - F.col("doy")).cast("int"),
        # Fixed value: the mean year of the percentage.
        "percent_passed": F.floor(F.col("doy") / (leap + 365.24) * 1000) / 10,
        "week": week, "week_year": week_year, "zodiac": F.get(_arr(ZODIAC_NAMES), F.col("jm") - 1),
        "year_animal": F.get(_arr(YEAR_ANIMALS), F.pmod(F.col("jy"), F.lit(12)).cast("int")),
        "text_fa": persian_digits(F.concat(F.col("jy"), F.lit("/"), F.col("jm"), F.lit("/"), F.col("jd"))),
    }).drop("doy")


def jalali_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """CAL-1 as a table: one row per Gregorian day from ``start`` to ``end``."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS date")
    return with_calendar(days)


def jalali_text_to_gregorian(spark: SparkSession, text: str) -> str | None:
    """A single date parameter (e.g. the catalog's day filter) as
    ``YYYY-MM-DD``: Jalali when the year is below 1600, else read as Gregorian; Persian digits allowed,
    ``/`` or ``-`` separators. None when it is not a valid date."""
    df = spark.createDataFrame([(text,)], "t string")
    row = normalise_dates(df, "t", out="d").select(F.col("d").cast("string")).first()
    return row[0] if row else None


def persian_digits(c: Column) -> Column:
    """Latin digits to Persian digits."""
    return F.translate(c, "0123456789", PERSIAN_DIGITS)


def latin_digits(c: Column) -> Column:
    """SC-7: Persian digits to Latin; the Persian decimal separator to a dot."""
    return F.translate(c, PERSIAN_DIGITS + "٫", "0123456789.")


def to_jalali(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """CAL-4: add the Jalali text ``y/m/d`` of a date column (NULL stays NULL)."""
    return df.withColumn(out or f"{col}_jalali", _let(jalali_of(F.col(col).cast("date")), lambda p: F.concat(
        p["jy"], F.lit("/"), p["jm"], F.lit("/"), p["jd"])))


def normalise_dates(df: DataFrame, col: str, out: str | None = None,
                    reason: str | None = None) -> DataFrame:
    """CAL-3 / CAL-5: mixed Jalali / Gregorian date text to ``date``.

    Accepts ``/`` or ``-`` separators (exactly two), Persian digits; a year
    below 1600 is Jalali (impossible days such as 1403/12/31 or month 13 fail);
    otherwise the text is read as a Gregorian date. Rows that fail get NULL and, when ``reason`` is
    given, a reason text in that column.
    """
    out = out or f"{col}_date"
    txt = latin_digits(F.trim(F.col(col)))

    def count(ch):
        return F.length(txt) - F.length(F.replace(txt, F.lit(ch), F.lit("")))

    # exactly two separators of one kind; '-' becomes '/' so there is one split
    norm = (F.when(count("/") == 2, txt)
            .when(count("-") == 2, F.translate(txt, "-", "/")))
    parts = F.split(norm, "/")
    y = F.element_at(parts, 1).try_cast("int")
    m = F.element_at(parts, 2).try_cast("int")
    d = F.element_at(parts, 3).try_cast("int")
    tmp = (df.withColumn("_y", y).withColumn("_m", m).withColumn("_d2", d)
           .withColumn("_jal", F.col("_y") < 1600))
    # Gregorian: make_date only after the month length check (no format parsing)
    yy, mm, dd = F.col("_y"), F.col("_m"), F.col("_d2")
    valid = (yy.between(1, 9999) & mm.between(1, 12) & (dd >= 1)
             & (dd <= F.dayofmonth(F.last_day(F.make_date(yy, mm, F.lit(1))))))
    greg = F.when(valid, F.make_date(yy, mm, dd))
    res = F.when(F.col("_jal"), to_gregorian(yy, mm, dd)).otherwise(greg)
    tmp = tmp.withColumn(out, res)
    if reason:
        tmp = tmp.withColumn(reason, F.when(F.col(col).isNotNull() & F.col(out).isNull(),
                                            F.lit("bad date")))
    return tmp.drop("_y", "_m", "_d2", "_jal")


def rollup_calendar(facts: DataFrame, date_col: str, level: str,
                    measures: list[Column]) -> DataFrame:
    """CAL-2: facts rolled up by Jalali month, season, weekday or year. Facts of
    any year count; those without a date form a group with NULL keys."""
    keys = {"month": ["jy", "jm", "month_name"], "season": ["jy", "season", "season_name"],
            "weekday": ["weekday", "weekday_name"], "year": ["jy"]}[level]
    names = list(facts.columns)
    day = "_rollup_day"
    wide = with_calendar(facts.select(F.col(date_col).cast("date").alias(day),
                                      F.struct(*[F.col(c) for c in names]).alias("_fact")), day)
    return wide.select(*keys, "_fact.*").groupBy(*keys).agg(*measures)
