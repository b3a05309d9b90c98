"""Hand-made edge cases (FIXTURES section C) with written expected results."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.functions import exprs
from eventide.functions.calendar import jalali_calendar, normalise_dates, to_jalali
from eventide.functions.text import clean_text, norm_phone
from eventide.operators.quality import national_id_ok, require


@pytest.fixture(scope="module")
def cal(spark):
    return jalali_calendar(spark, "1970-01-01", "2030-12-31").cache()


CAL_PAIRS = {"2021-02-16": "1399/11/28", "2024-03-19": "1402/12/29", "2024-03-20": "1403/1/1",
             "2025-03-20": "1403/12/30", "2025-03-21": "1404/1/1", "1995-01-01": "1373/10/11",
             "2000-02-29": "1378/12/10", "1979-02-11": "1357/11/22"}


def test_calendar_pairs(spark, cal):
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in CAL_PAIRS], "d date")
    got = {str(r.d): r.j for r in to_jalali(df, "d", "j").collect()}
    assert got == CAL_PAIRS


def test_calendar_round_trip_and_lengths(spark, cal):
    # every day appears once, Jalali -> Gregorian -> Jalali is the identity,
    # and month lengths follow 31 x 6, 30 x 5, 29/30
    assert cal.count() == cal.select("date").distinct().count()
    assert cal.groupBy("jy", "jm", "jd").count().filter("count > 1").count() == 0
    bad = (cal.groupBy("jy", "jm").agg(F.max("jd").alias("n"), F.first("month_len").alias("ml"))
           .filter(F.col("jy").between(1349, 1408)).filter("n <> ml"))
    assert bad.count() == 0
    leap = cal.filter((F.col("jm") == 12) & (F.col("jd") == 30)).select("jy").distinct()
    years = {r.jy for r in leap.collect()}
    assert 1403 in years and 1399 in years and 1402 not in years


def test_normalise_dates(spark, cal):
    df = spark.createDataFrame([("1403/01/01",), ("۱۴۰۳/۰۱/۰۱",), ("2024-03-20",), ("1403/12/30",),
                                ("1402/12/30",), ("1403/13/01",), ("bad",), (None,),
                                ("2023-02-30",), ("2024-13-01",), ("2024/02/29",), ("1/2/3/4",)],
                               "t string")
    got = [r.t_date for r in normalise_dates(df, "t").orderBy(F.monotonically_increasing_id())
           .collect()]
    d = dt.date(2024, 3, 20)
    assert got[:4] == [d, d, d, dt.date(2025, 3, 20)]
    assert got[4:] == [None, None, None, None, None, None, dt.date(2024, 2, 29), None]


@pytest.mark.parametrize("nid,ok", [("0012345679", True), ("1234567891", True),
                                    ("0000000019", True), ("1111111111", False),
                                    ("0012345678", False), ("001-234567-9", True),
                                    ("12345", False)])
def test_national_id(spark, nid, ok):
    assert spark.range(1).select(national_id_ok(F.lit(nid)).alias("v")).first().v is ok


@pytest.mark.parametrize("raw,want", [("+98 912 345 6789", "09123456789"),
                                      ("9123456789", "09123456789"),
                                      ("۰۹۱۲۳۴۵۶۷۸۹", "09123456789"),
                                      ("989123456789", "09123456789"),
                                      ("12345", "12345")])
def test_norm_phone(spark, raw, want):
    assert spark.range(1).select(norm_phone(F.lit(raw)).alias("p")).first().p == want


def test_clean_text_nested_and_inverse(spark):
    df = spark.createDataFrame([("  a<b> & 'q' \"x\"\n", ("<i>", ["'k'"]))],
                               "s string, n struct<t:string, a:array<string>>")
    c = clean_text(df).first()
    assert c.s == "a&lt;b&gt; &amp; &#039;q&#039; &quot;x&quot;"
    assert c.n.t == "&lt;i&gt;" and c.n.a == ["&#039;k&#039;"]
    back = clean_text(clean_text(df), inverse=True).first()
    assert back.s == "a<b> & 'q' \"x\""


def test_hour_ranges_and_grouping(spark):
    assert exprs.hour_ranges("abc, x-y") is None
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1, h),) for h in range(24)], "start_time timestamp_ntz")
    got = df.filter(exprs.hour_ranges("8-10, junk, 18 - 19")).count()
    assert got == 3
    g = spark.createDataFrame([(0,), (2,), (25,), (30,)], "grouping int")
    assert g.filter(exprs.grouping_filter(2)).count() == 1
    assert g.filter(exprs.grouping_filter(25)).count() == 1  # strictly greater


def test_location_like_wildcards(spark):
    df = spark.createDataFrame([("Big Hall",), ("bag hall",), ("x",)], "location string")
    assert df.filter(exprs.location_like("HALL")).count() == 2
    assert df.filter(exprs.location_like("b_g")).count() == 2


def test_require_groups(spark):
    df = spark.createDataFrame([("0", None, None, False), ("", "x", None, True)],
                               "a string, b string, c string, f boolean")
    got = [r.missing for r in require(df, ["a", "f"], [["b", "c"]]).collect()]
    assert got == [["one_of:b|c"], ["a"]]


@pytest.mark.parametrize("day,week,week_year", [("2024-03-20", 53, 1402), ("2024-03-22", 53, 1402),
                                                ("2024-03-23", 1, 1403), ("2024-03-29", 1, 1403),
                                                ("2024-03-30", 2, 1403)])
def test_week_numbers(spark, cal, day, week, week_year):
    r = cal.filter(F.col("date") == day).first()
    assert (r.week, r.week_year) == (week, week_year)


def test_week_numbers_are_contiguous(spark, cal):
    # within a week-year, weeks run 1..52 or 53 without gaps, 7 days each
    # (the edges of the generated range are partial and left out)
    wk = (cal.filter(F.col("week_year").between(1350, 1408)).groupBy("week_year", "week").count())
    assert wk.filter("count <> 7").count() == 0
    per_year = wk.groupBy("week_year").agg(F.max("week").alias("m"), F.count("*").alias("n"))
    assert per_year.filter("m <> n OR m < 52 OR m > 53").count() == 0


def test_latest_code_per_phone(spark):
    from eventide.operators.windows import latest_code
    df = spark.createDataFrame([(1, "a", "login", 100), (2, "a", "login", 300), (3, "a", "reg", 50),
                                (4, "b", "login", 300), (5, "b", "login", 300)],
                               "id long, phone string, page string, expires_at long")
    got = {(r.phone, r.page): r.id for r in latest_code(df, ["phone", "page"]).collect()}
    assert got == {("a", "login"): 2, ("a", "reg"): 3, ("b", "login"): 5}


def test_slug_keeps_persian_drops_punctuation(spark, cal):
    from eventide.functions.text import slug
    df = spark.createDataFrame([("کنسرت «بزرگ» 2024!  Tehran_Live", dt.datetime(2024, 3, 20, 18))],
                               "title string, start_time timestamp_ntz")
    got = slug(df, "title", "start_time").first().slug
    assert got == "کنسرت-بزرگ-2024-tehran_live-01-فروردین-1403"


def test_rollup_levels_agree(spark, cal):
    from eventide.functions.calendar import rollup_calendar
    facts = spark.createDataFrame([(dt.datetime(2024, 3, 19 + i % 9, 10), i % 4 + 1) for i in range(60)],
                                  "ts timestamp_ntz, seats int")
    m = rollup_calendar(facts, "ts", "month", [F.sum("seats").alias("s")])
    s = rollup_calendar(facts, "ts", "season", [F.sum("seats").alias("s")])
    w = rollup_calendar(facts, "ts", "weekday", [F.sum("seats").alias("s")])
    total = facts.agg(F.sum("seats")).first()[0]
    for df in (m, s, w):
        assert df.agg(F.sum("s")).first()[0] == total
    assert {r.month_name for r in m.collect()} == {"اسفند", "فروردین"}


def test_any_year_converts_and_counts(spark):
    """No range: far years go to Jalali and back, and none falls out of a rollup."""
    from eventide.functions.calendar import jalali_parts, rollup_calendar, to_gregorian
    days = spark.sql("SELECT explode(sequence(DATE'0700-01-01', DATE'3000-12-31', INTERVAL 11 DAYS)) AS d")
    p = jalali_parts(F.col("d"))
    back = days.select("d", *[c.alias(k) for k, c in p.items()]).withColumn(
        "b", to_gregorian(F.col("jy"), F.col("jm"), F.col("jd")))
    assert back.filter("d <> b OR b IS NULL OR jd < 1 OR jd > 31").count() == 0
    df = spark.createDataFrame([("1250/01/01",), ("1500/01/01",), ("1179/12/29",)], "t string")
    assert all(r.t_date for r in normalise_dates(df, "t").collect())
    facts = spark.sql("SELECT explode(array(DATE'1800-05-01', DATE'2021-05-01', DATE'2300-05-01', NULL)) AS d")
    got = rollup_calendar(facts, "d", "year", [F.count(F.lit(1)).alias("n")]).collect()
    assert sorted((r.jy is None, r.jy or 0, r.n) for r in got) == [
        (False, 1179, 1), (False, 1400, 1), (False, 1679, 1), (True, 0, 1)]


def test_a_national_id_is_cleaned_once(spark):
    rows = [("0084575948", True), (" 008-457 5948", True), ("0084575949", False), ("1111111111", False),
            ("008457594", False), ("00845759480", False), ("00845x5948", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "n string, ok boolean")
    checked = df.withColumn("got", national_id_ok(F.col("n")))
    assert checked.filter("got IS NULL OR got <> ok").count() == 0
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
