import datetime as dt

import pytest

from tablewright.functions.dates import looks_like_date, parse_timestamp, wall_clock
from tablewright.functions.names import date_prefix, find_column, is_nonstandard, snake_names
from tablewright.functions.numbers import bin_right, looks_money_percent, parse_money_percent, round2, round_scalar
from tablewright.functions.text import is_token, map_values, null_tokens_to_null, parse_boolean, title_case, trim_text


def column(spark, values, expression, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]


def test_headers_become_snake_case_and_stay_unique():
    assert snake_names(["Customer Name", "Discount %", "Cost ($)", " a.b/c ", "%%", "A", "a", "a_1", "a "]) == [
        "customer_name", "discount", "cost", "a_b_c", "unnamed_col", "a", "a_1", "a_1_1", "a_2"]
    assert snake_names(["Discount %", "Cost ($)", "Tax Rate %"], symbol_words=True) == ["discount_pct", "cost_usd", "tax_rate_pct"]


def test_find_column_prefers_exact_matches_of_any_keyword():
    assert find_column(["gross_sales", "Sales"], ["revenue", "sales"]) == "Sales"
    assert find_column(["gross_sales", "net_revenue"], ["revenue", "sales"]) == "net_revenue"
    assert find_column(["x"], ["revenue"]) is None


def test_name_helpers():
    assert [date_prefix(c) for c in ("order_date", "date", "seen_at")] == ["order_", "", "seen_at_"]
    assert [is_nonstandard(c) for c in ("a_b", "A", "a b", "a#")] == [False, True, True, True]


def test_trim_knows_every_white_space(spark):
    assert column(spark, [" a ", "\t b　", "c", "", " \n"], trim_text("x")) == ["a", "b", "c", "", ""]


def test_null_tokens(spark):
    assert column(spark, ["NaN", "none", "", "<NA>", "undefined", "ok"], null_tokens_to_null("x")) == [None] * 5 + ["ok"]


@pytest.mark.parametrize("text", [
    "noise-cancelling 4k usb-c", "JOHN O'NEIL", "plain words", "élan vital", "3rd x2y", "a  b", "", "Ǆabc", "42",
])
def test_title_case_follows_letter_runs(spark, text):
    assert column(spark, [text], title_case("x")) == [text.title()]


def test_map_values_falls_back_to_title_case(spark):
    assert column(spark, ["M", "other one", None], map_values("x", {"m": "Male"})) == ["Male", "Other One", None]


def test_money_and_percent_parse(spark):
    values = ["$1,200.50", "₹ 14,50,000", " 95 000 ", "-5%", "1e3", ".5", "1d", "abc", "", "1.2.3", None, "5 %", "--1"]
    assert column(spark, values, parse_money_percent("x")) == [
        1200.5, 1450000.0, 95000.0, -5.0, 1000.0, 0.5, None, None, None, None, None, 5.0, None]
    assert column(spark, ["5%", "5", "a5"], looks_money_percent("x")) == [True, True, False]


def test_booleans(spark):
    assert column(spark, [" Yes", "F", "1.0", "maybe", None], parse_boolean("x")) == [True, False, True, None, None]


def test_dates_of_many_layouts(spark):
    cases = {
        "2026-03-05": dt.datetime(2026, 3, 5), "2026/3/5": dt.datetime(2026, 3, 5), "2026.03.05": dt.datetime(2026, 3, 5),
        "08-03-2024": dt.datetime(2024, 8, 3), "27-08-2023": dt.datetime(2023, 8, 27), "12/31/99": dt.datetime(1999, 12, 31),
        "16/02/26": dt.datetime(2026, 2, 16), "Apr 02, 2026": dt.datetime(2026, 4, 2), "april 2 2026": dt.datetime(2026, 4, 2),
        "2 Sept 2026": dt.datetime(2026, 9, 2), "02-Jan-2026": dt.datetime(2026, 1, 2), "20260815": dt.datetime(2026, 8, 15),
        "2026-03-05 10:20": dt.datetime(2026, 3, 5, 10, 20), "2026-03-05T10:20:30.5+05:30": dt.datetime(2026, 3, 5, 10, 20, 30, 500000),
        "3/5/2026 4:05 pm": dt.datetime(2026, 3, 5, 16, 5), " 2026-03-05 ": dt.datetime(2026, 3, 5),
        "2026-99-99": None, "Unknown Date": None, "02/30/2026": None, "31/31/2026": None, "Foo 02, 2026": None, "": None,
    }
    assert column(spark, list(cases), parse_timestamp("x")) == list(cases.values())


LAYOUTS = {
    "Aug 15, 2024 3:00 PM": dt.datetime(2024, 8, 15, 15), "15-Aug-24": dt.datetime(2024, 8, 15), "Thu, 15 Aug 2024": dt.datetime(2024, 8, 15),
    "Thursday, August 15, 2024": dt.datetime(2024, 8, 15), "Aug 2024": dt.datetime(2024, 8, 1), "2024-08": dt.datetime(2024, 8, 1),
    "2024/08": dt.datetime(2024, 8, 1), "08/2024": dt.datetime(2024, 8, 1), "Aug-2024": dt.datetime(2024, 8, 1), "Aug 15 24": dt.datetime(2024, 8, 15),
    "2024-08-15 10:30:01.123456789": dt.datetime(2024, 8, 15, 10, 30, 1, 123456), "20240815": dt.datetime(2024, 8, 15),
    "20240815103000": dt.datetime(2024, 8, 15, 10, 30), "15/08/2024 10:30": dt.datetime(2024, 8, 15, 10, 30), "15.08.2024": dt.datetime(2024, 8, 15),
    "15th of Aug 2024": dt.datetime(2024, 8, 15), "15Aug2024": dt.datetime(2024, 8, 15), "5/8/24 7 pm": dt.datetime(2024, 5, 8, 19),
    "1/2/2024 12:15 am": dt.datetime(2024, 1, 2, 0, 15), "15 Aug 2024 0:30 AM": dt.datetime(2024, 8, 15, 0, 30), "2024-08-15T10": dt.datetime(2024, 8, 15, 10),
    "2024-08-15 10:30 UTC": dt.datetime(2024, 8, 15, 10, 30), "2024-08-15 10:30:00 +0530": dt.datetime(2024, 8, 15, 10, 30),
    "2024-08-15T23:30:00Z": dt.datetime(2024, 8, 15, 23, 30), "2024-03-10 02:30": dt.datetime(2024, 3, 10, 2, 30),
    "15 Aug 2024 13:00 PM": None, "Aug 45, 2024": None, "2024-13": None, "Monday": None, "10:30": None, "Aug": None, "2024": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_session(spark, zone):
    """Among them a clock time that the session's zone skips."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert column(spark, list(LAYOUTS), f"cast({parse_timestamp('x')} as string)") == [
            None if d is None else str(d) for d in LAYOUTS.values()]
        instants = spark.range(1).selectExpr("timestamp_micros(1710055800123456) as t")  # 2024-03-10 07:30:00.123456 UTC
        for clock, want in (("UTC", "2024-03-10 07:30:00.123456"), ("Asia/Tokyo", "2024-03-10 16:30:00.123456")):
            assert instants.selectExpr(f"cast({wall_clock('t', clock)} as string) as w").first()["w"] == want
        assert instants.selectExpr(f"{wall_clock('t')} as w").dtypes == [("w", "timestamp_ntz")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_first_option(spark):
    assert column(spark, ["08-03-2024"], parse_timestamp("x", day_first=True)) == [dt.datetime(2024, 3, 8)]


def test_date_look(spark):
    assert column(spark, ["2026-1-1", "1/2/26", "5-5", "Aug 5, 2026", "hello world"], looks_like_date("x")) == [
        True, True, False, True, False]


def test_rounding(spark):
    xs = [0.125, 2.675, 9.785, 1.005, -0.375, 1234.5]
    assert column(spark, xs, round_scalar("x", 2), "double") == [round(x, 2) for x in xs]
    assert column(spark, [0.125, 0.375], round2("x"), "double") == [0.12, 0.38]


def test_bins_are_right_closed(spark):
    assert column(spark, [2.0, 2.1, 9.0, None], bin_right("x", (2, 5), ("a", "b", "c")), "double") == ["a", "b", "c", None]


def test_first_characters_rule_out_no_number(spark):
    starts = [" ", "\t", "\x0b", "\xa0", " ", " ", "$", "₹", ",", "%", "+", "-", ".", "7", ""]
    assert column(spark, [s + "5" for s in starts] + ["x5", "", None, "Kk"], looks_money_percent("x")) == [True] * 15 + [False, False, None, False]


def test_tokens_by_length(spark):
    assert column(spark, ["FALSE", "falsely", "T", "", None], is_token("x", ("true", "t", "false"))) == [True, False, True, False, None]
