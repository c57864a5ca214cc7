"""NaN and infinite numbers are missing values for every public operator."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright import clean_data, column_profile, dataset_profile, derive_features, issues, kpi_table, statistical_summary
from tablewright.operators import chartdata, dedup, outliers
from tablewright.operators.analytics import breakdown
from tablewright.operators.entry import finite
from tablewright.operators.fill import fill_ordered
from tablewright.operators.impute import handle_missing
from tablewright.sources.csv import infer_types
from tablewright.sources.staging import stage

NAN, INF = math.nan, math.inf


@pytest.fixture
def hundred(spark):
    """Ten NaN, two infinities and a NULL among 100 rows."""
    odd = [NAN] * 10 + [INF, -INF, None]
    rows = [(i, odd[i] if i < len(odd) else float(i), float(i % 7), f"g{i % 2}") for i in range(100)]
    return spark.createDataFrame(rows, "id int, amount double, other float, region string")


def test_profile_counts_them(hundred):
    row = dataset_profile(hundred).first()
    assert row["total_missing"] == 13 and row["quality_score"] < 100
    amount = column_profile(hundred).where("column = 'amount'").first()
    assert amount["missing_count"] == 13 and amount["unique_count"] == 87 and amount["negative_count"] == 0
    assert "13 missing values" in " ".join(r["issue"] for r in issues(hundred).collect())


def test_outliers_leave_them_out(hundred):
    assert outliers.detect_outliers(hundred, columns=["amount"]) == []
    (z,) = outliers.detect_outliers(hundred, "zscore", 1.5, columns=["amount"])
    assert z.outlier_count == sum(abs(v - 56) / 25.26 > 1.5 for v in range(13, 100)) and math.isfinite(z.lower)


def test_statistics_are_numbers(hundred):
    rows = {r["column"]: r for r in statistical_summary(hundred).collect()}
    assert (rows["amount"]["count"], rows["amount"]["null_count"], rows["amount"]["mean"], rows["amount"]["max"]) == (87, 13, 56.0, 99.0)
    assert (rows["amount"]["median"], rows["amount"]["skewness"]) == (56.0, 0.0)
    assert [r["raw"] for r in kpi_table(hundred).where("key in ('total_revenue', 'max_transaction')").collect()] == [sum(range(13, 100)), 99.0]
    assert breakdown(hundred, "region", "amount").agg(F.sum("total_value")).first()[0] == sum(range(13, 100))


@pytest.mark.parametrize(("strategy", "value"), [("median", 56.0), ("mean", 56.0), ("zero", 0.0)])
def test_fills(hundred, strategy, value):
    out, fills = handle_missing(hundred, numeric=strategy)
    assert fills[0].count == 13 and out.where("id < 13").select("amount").distinct().collect() == [(value,)]


def test_ordered_fill_and_drop(hundred):
    filled = fill_ordered(hundred, ["amount"], ["id"])
    assert filled.where("id < 13").select("amount").distinct().collect() == [(13.0,)]
    assert handle_missing(hundred, numeric="drop_row")[0].count() == 87


def test_cleaning_run_and_features(hundred):
    result = clean_data(hundred)
    assert result.table.where("isnan(amount) or amount is null or abs(amount) = double('Infinity')").isEmpty()
    assert dataset_profile(result.table).first()["total_missing"] == 0
    again = result.plan.apply(hundred)
    assert again.where("isnan(amount) or amount is null").isEmpty()
    table, _ = derive_features(hundred.withColumnRenamed("other", "quantity").withColumnRenamed("amount", "unit_price"))
    assert table.where("isnan(revenue)").isEmpty() and table.where("revenue is null").count() == 13


def test_equal_rows_and_charts(spark, hundred):
    df = spark.createDataFrame([(1, NAN), (1, None), (1, INF), (2, 1.0)], "k int, v double")
    assert dedup.duplicate_count(df) == 2 and dedup.remove_duplicates(df).count() == 2
    assert chartdata.histogram(hundred, "amount", 4).agg(F.sum("count")).first()[0] == 87
    box = chartdata.box(hundred, "amount").first()
    assert (box["min"], box["median"], box["max"], box["outlier_points"]) == (13.0, 56.0, 99.0, 0)
    r = {(x["col_a"], x["col_b"]): x["r"] for x in chartdata.correlation(hundred).collect()}
    assert r["id", "amount"] == 1.0 and all(math.isfinite(v) for v in r.values())


def test_text_beyond_any_double(spark):
    df = spark.createDataFrame([("1e400",), ("-1e999",), ("2.5",), (None,)], "x string")
    assert [r["x"] for r in infer_types(df).collect()] == [None, None, 2.5, None]
    assert clean_data(df).plan.fills[0].count == 3


def test_mark_stays_with_the_table_itself(spark, hundred):
    once = finite(hundred)
    assert finite(once) is once
    both = once.union(hundred)
    assert finite(both) is not both and finite(both).where("isnan(amount)").isEmpty()
    assert finite(stage(hundred)).where("isnan(amount)").isEmpty()


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert statistical_summary(df).count() == 0
    assert statistical_summary(df).columns == statistical_summary(df.selectExpr("1 as n")).columns


def test_find_col_fits_the_types_of_a_table_once(spark, monkeypatch):
    from catalog import features

    seen = []
    rows = {
        "d_ledger": spark.createDataFrame([(1.0, "a"), (None, "b")], "gross_revenue double, business_unit string"),
        "d_sales": spark.createDataFrame([("a", 1.0, 2.0), (None, None, 1.0)], "product_category string, quantity double, unit_price double"),
    }
    monkeypatch.setattr(features, "typed", lambda spark, folder, name: seen.append(name) or rows[name])
    found = sorted(map(tuple, features.find_col(spark, "").collect()))
    assert found == [("category", "business_unit", 2), ("category", "product_category", 1), ("price", "unit_price", 2),
                     ("quantity", "quantity", 1), ("revenue", "gross_revenue", 1)]
    assert seen == ["d_ledger", "d_sales"]
