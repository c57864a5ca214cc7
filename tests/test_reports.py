import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import (
    CleaningPlan, CleanOptions, all_insights, breakdowns, clean_data, column_profile, dataset_profile, derive_features, issues,
    kpi_table, load_table, run_pipeline, statistical_summary,
)
from tablewright.operators import chartdata, profile, views
from tablewright.operators.analytics import period_growth, top_category
from tablewright.operators.outliers import detect_outliers
from tablewright.operators.types import date_shares
from tablewright.plans.cleaning import refit
from tablewright.streaming.apply import clean_stream


# --- profile -----------------------------------------------------------------------

def test_column_profile(sales):
    out = {r["column"]: r for r in column_profile(sales).collect()}
    assert out["Unit Price"]["inferred_type"] == "numeric_string (currency/formatted)"
    assert out["Order Date"]["inferred_type"] == "datetime_string"
    assert out["Region"]["inferred_type"] == "text_categorical" and out["Quantity"]["inferred_type"] is None
    assert out["Quantity"]["negative_count"] == 1 and out["Customer Name"]["blank_count"] == 1
    assert out["Region"]["unique_count"] == 4 and out["Region"]["sample_values"] == ["North", "SOUTH", "West", "north region"]


def test_score_by_hand(sales):
    p = dataset_profile(sales).first()
    # 5 x 9 cells, no NULL; 1 duplicate of 5 rows; 1 negative and 1 blank; 9 odd headers, 3 columns of unparsed text.
    c, u, v, k = 100.0, 100 - 20.0 * 3, 100 - 2 / 45 * 100 * 10, 100 - (30 + 45)
    assert (p.completeness, p.uniqueness, p.validity, p.consistency) == (c, u, round(v, 1), k)
    assert p.quality_score == round(0.35 * c + 0.25 * u + 0.25 * v + 0.15 * k, 1) and p.quality_grade.startswith("C")


def test_blank_count_and_nulls(spark):
    df = spark.createDataFrame([("  ",), (" ",), (None,), ("x",)], "c string")
    assert dataset_profile(df).first().validity < dataset_profile(spark.createDataFrame([("y",)], "c string")).first().validity
    strict, loose = (dataset_profile(df, blank_compat=f).first().validity for f in (True, False))
    assert loose <= strict


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "a string, b double")
    p = dataset_profile(nothing).first()
    assert p.is_empty and p.quality_score == 0.0 and p.quality_grade == "N/A"
    assert issues(nothing).collect()[0]["issue"] == "Dataset is empty."
    result = clean_data(nothing)
    assert result.status == "empty_dataset" and result.table.count() == 0


def test_issue_sentences(sales):
    texts = [r["issue"] for r in issues(sales).orderBy("seq").collect()]
    assert texts == [
        "Found 1 exact duplicate rows (20.0% of dataset).",
        "Columns formatted as text with currency/symbols: Unit Price, Discount %",
        "Unparsed date columns: Order Date",
        "Found negative values in strictly positive fields: {'Quantity': 1}",
        "Found blank/whitespace-only text strings in: {'Customer Name': 1}",
        "9 columns have non-standard naming (spaces, mixed-case, or special characters).",
    ]
    tidy = issues(sales.sparkSession.createDataFrame([("x", 1.0), ("y", 2.0)], "a string, b double"))
    assert tidy.first()["issue"] == "No major data quality issues detected."


def test_headers_with_dots_and_quotes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "x string, y double").toDF("a.b", "it's `odd`")
    assert {r["column"] for r in column_profile(df).collect()} == {"a.b", "it's `odd`"}
    assert clean_data(df).table.columns == ["a_b", "its_odd"]


def test_constant_column_and_types(spark):
    df = spark.sql("select 1 as one, id, cast(null as string) as none, true as flag, timestamp_ntz '2026-01-01 00:00:00' as t from range(3)")
    out = {r["column"]: r for r in column_profile(df).collect()}
    assert {c for c in out if out[c]["is_constant"]} == {"one", "none", "flag", "t"}
    assert {r["column"]: r["family"] for r in profile.dtype_table(df).collect()} == {
        "one": "numeric", "id": "numeric", "none": "text", "flag": "boolean", "t": "datetime"}


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(sales, parts):
    moved = sales.repartition(parts).orderBy(F.rand(3))
    assert sorted(map(tuple, column_profile(moved).collect()), key=repr) == sorted(map(tuple, column_profile(sales).collect()), key=repr)
    assert clean_data(moved).plan.fills == clean_data(sales).plan.fills


# --- cleaning run ------------------------------------------------------------------

def test_cleaning_run(sales):
    result = clean_data(sales, CleanOptions(symbol_words=True))
    rows = {r["order_id"]: r for r in result.table.collect()}
    assert result.duplicates_removed == 1 and result.initial_shape == (5, 9) and result.final_shape == (4, 9)
    assert result.negatives_fixed == {"quantity": 1} and rows["A-4"]["quantity"] == 3
    assert rows["A-2"]["order_date"] == dt.datetime(2026, 2, 16) and rows["A-4"]["order_date"] is None
    assert rows["A-2"]["region"] == "North" and rows["A-4"]["customer_name"] == "Ann Lee"
    assert result.table.columns[7] == "discount_pct" and rows["A-1"]["discount_pct"] == 10.0
    steps = [r["step"] for r in result.audit().orderBy("seq").collect()]
    assert [s for i, s in enumerate(steps) if i == 0 or steps[i - 1] != s][:4] == ["initial_shape", "names", "duplicates", "types"]
    assert steps[-1] == "final_shape"


def test_steps_can_be_switched_off(sales):
    off = CleanOptions(standardize_names=False, remove_dups=False, convert_types=False, fix_negatives=False,
                       standardize_cats=False, handle_missing=False)
    result = clean_data(sales, off)
    assert sorted(map(tuple, result.table.collect())) == sorted(map(tuple, sales.collect()))


def test_outlier_actions_in_a_run(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 13, 14, 15, 900)], "score double")
    assert clean_data(df, CleanOptions(outlier_action="remove")).final_shape == (6, 1)
    capped = clean_data(df, CleanOptions(outlier_action="cap"))
    assert capped.outlier_actions == {"score": 1} and capped.table.agg(F.max("score")).first()[0] < 900


def test_plan_survives_json_and_cleans_another_batch(sales):
    plan = clean_data(sales).plan
    again = CleaningPlan.from_json(plan.to_json())
    assert again == plan
    batch = sales.filter("`Order ID` = 'A-4'")
    (row,) = again.apply(batch).collect()
    assert row["quantity"] == 3 and row["customer_name"] == "Ann Lee" and row["unit_price"] == 99.99


def test_plan_on_a_stream(sales, spark, tmp_path):
    plan = clean_data(sales).plan
    folder = str(tmp_path / "in")
    flat = sales.toDF(*[f"c{i}" for i in range(len(sales.columns))])
    flat.write.parquet(folder)
    stream = spark.readStream.schema(flat.schema).parquet(folder).toDF(*sales.columns)
    with pytest.raises(ValueError, match="event_time"):
        clean_stream(stream, plan)
    plan = refit(plan, remove_dups=False)
    run = clean_stream(stream, plan).writeStream.format("memory").queryName("cleaned_stream").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("cleaned_stream")
    assert got.count() == 5 and got.filter("revenue = 2401.0 and region = 'North'").count() == 1


def test_copies_on_a_stream_go_across_batches(sales, spark, tmp_path):
    """The same row in two files, read as two batches; a later row that differs in one value stays."""
    plan, folder = clean_data(sales).plan, str(tmp_path / "in")
    names = [f"c{i}" for i in range(len(sales.columns))]
    for day, rows in ((1, sales), (1, sales.where("`Order ID` <> 'A-1'")), (2, sales.where("`Order ID` = 'A-2'"))):
        rows.toDF(*names).withColumn("seen_at", F.expr(f"timestamp'2026-01-0{day} 00:00:00'")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).toDF(*sales.columns, "Seen At")
    cleaned = clean_stream(stream, plan, event_time="Seen At", delay="1 day")
    run = cleaned.writeStream.format("memory").queryName("stream_copies").trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = [r["order_id"] for r in spark.table("stream_copies").collect()]
    assert sorted(got) == ["A-1", "A-2", "A-2", "A-3", "A-4"]


def test_options_are_checked():
    for wrong in ({"numeric_missing_strategy": "nonsense"}, {"categorical_missing_strategy": "nonsense"},
                  {"date_missing_strategy": "forwardfill"}, {"outlier_method": "x"}, {"outlier_action": "x"}):
        with pytest.raises(ValueError):
            CleanOptions(**wrong)


def test_a_strategy_for_one_column_is_checked(sales):
    with pytest.raises(ValueError, match="nonsense"):
        clean_data(sales, CleanOptions(custom_col_strategies={"region": "nonsense"}))


def test_quartiles_of_the_filled_table_come_from_the_known_values(spark):
    rng = np.random.default_rng(2)
    for share, strategy in ((0.1, "median"), (0.45, "mean"), (0.7, "zero"), (0.0, "median")):
        values = pd.DataFrame({"a": rng.normal(size=500) * 10, "b": rng.integers(0, 9, 500).astype(float), "c": np.full(500, np.nan)})
        values = values.mask(rng.random(values.shape) < share)
        df = spark.createDataFrame(values).withColumn("d", F.expr("cast(a as float)")).withColumn("e", F.expr("if(isnan(b), null, cast(b as int))"))
        result = clean_data(df, CleanOptions(numeric_missing_strategy=strategy, fix_negatives=False, remove_dups=False))
        table = result.table.toPandas()
        for c, known in result.quartiles.items():
            assert np.allclose(known, np.quantile(table[c].astype(float), [0.25, 0.5, 0.75])), (c, strategy)
        assert result.plan.bounds == detect_outliers(result.table)
        assert statistical_summary(result.table, known=result.quartiles).collect() == statistical_summary(result.table).collect()


def test_whole_run(sales, tmp_path):
    run = run_pipeline(sales, export=str(tmp_path / "out"))
    apart = clean_data(sales)
    table = derive_features(apart.table)[0]
    assert sorted(map(tuple, run.table.collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    assert run.raw_profile.collect() == dataset_profile(sales).collect() and run.clean_profile.collect() == dataset_profile(table).collect()
    assert run.raw_issues.collect() == issues(sales).collect() and run.kpis.collect() == kpi_table(table).collect()
    assert run.summary.collect() == statistical_summary(table).collect()
    assert {r["metric"]: r["change"] for r in run.scorecard.collect()}["Total Rows"] == "-1 dups"
    assert run.insights.where("section = 'recommendations'").count() >= 3 and set(run.breakdowns) == {"by_category", "by_region", "by_period"}
    assert run.columns.count() == len(run.table.columns) and run.audit.count() == apart.audit().count() and run.diagnostics.count() == 9
    assert load_table(sales.sparkSession, run.exported).count() == 4


def test_whole_run_reads_its_source_once(spark, sales):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    run = run_pipeline(sales.mapInArrow(counted, sales.schema))
    assert run.table.count() == 4 and run.cleaning.duplicates_removed == 1 and seen.value == 5


def test_text_is_matched_once_a_value(spark):
    """Counts by value are those by row, also where values repeat, are blank, missing or negative."""
    values = ["-5", "$1,200", "10%", "yes", " No ", "", "  ", None, "2026-01-15", "Jan 3, 2026", "x", "-0", "(3)", "a-1"]
    rows = [(values[i % 14], values[i * i % 14], values[i // 40], "-7" if i % 3 else "12", float(i % 5 - 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "`Unit Price` string, b string, quantity string, amount string, price double")
    by_row = {r["column"]: r for r in profile.column_counts(df).collect()}
    for r in column_profile(df, samples=False).collect():
        assert {c: r[c] for c in ("inferred_type", "negative_count", "blank_count", "missing_count", "rows")} == {
            c: by_row[r["column"]][c] for c in ("inferred_type", "negative_count", "blank_count", "missing_count", "rows")}
        assert r["unique_count"] == df.select(r["column"]).na.drop().distinct().count()
    values = spark.createDataFrame([("2026-01-15", None)] * 3 + [("no date", "no")] * 2 + [(None, "Jan 3, 2026")], "a string, b string")
    assert date_shares(values, ["a", "b"]) == {"a": 0.6, "b": 1 / 3}


# --- features ----------------------------------------------------------------------

def test_features(spark):
    df = spark.sql("""select * from values
        (timestamp_ntz '2026-05-10 00:00:00', 3, 100.0D, 10.0D, 'John', 'Doe', 700, 3.0D),
        (timestamp_ntz '2026-06-15 00:00:00', 4, 250.0D, 0.5D, null, 'Smith', null, 2.0D),
        (null, 1, 10.0D, -5.0D, 'A', null, 579, null)
        as t(order_date, quantity, unit_price, discount, first_name, last_name, credit_score, tenure)""")
    out, notes = derive_features(df)
    a, b, c = out.orderBy("unit_price").collect()[1:] + out.orderBy("unit_price").collect()[:1]
    assert (a.order_year, a.order_quarter, a.order_month_year, a.order_day_name, a.order_is_weekend) == (2026, "2026Q2", "2026-05", "Sunday", True)
    assert (c.order_year, c.order_quarter, c.order_is_weekend) == (None, None, False)
    assert (a.revenue, a.discount_amount, a.net_revenue) == (300.0, 30.0, 270.0) and b.net_revenue == 500.0
    assert c.net_revenue == 60.0  # a rate of -5 is taken as it is
    assert (a.full_name, b.full_name, c.full_name) == ("John Doe", "Smith", "A")
    assert (a.credit_tier, b.credit_tier, c.credit_tier) == ("Good (670-739)", None, "Poor (<580)")
    assert (a.experience_level, b.experience_level) == ("Mid-Level (3-5 yrs)", "Junior (0-2 yrs)")
    assert "net_revenue" in notes and "discount_amount" not in notes


def test_profit_and_margin(spark):
    df = spark.createDataFrame([(200.0, 50.0), (0.0, 5.0), (None, 1.0), (10.0, None)], "gross_revenue double, operating_cost double")
    out = derive_features(df)[0].select("gross_profit", "profit_margin_pct").collect()
    assert [tuple(r) for r in out] == [(150.0, 75.0), (-5.0, 0.0), (None, 0.0), (None, None)]


def test_existing_columns_are_kept(spark):
    df = spark.createDataFrame([(2, 5.0, 1.0, "x")], "quantity int, price double, revenue double, full_name string")
    out = derive_features(df)[0].first()
    assert out.revenue == 1.0 and out.calculated_revenue == 10.0 and out.full_name == "x"


# --- KPIs, statistics, charts, narrative -------------------------------------------

@pytest.fixture
def deals(spark):
    return spark.createDataFrame(
        [(500.0, 2, "Tech", "2026Q1"), (1500.0, 5, "Tech", "2026Q1"), (2000.0, 8, "Office", "2026Q2"), (None, 1, None, None)],
        "revenue double, quantity int, product_category string, fiscal_quarter string")


def test_kpis(deals):
    got = {r["key"]: r for r in kpi_table(deals).collect()}
    assert got["total_revenue"]["raw"] == 4000.0 and got["total_revenue"]["value"] == "$4,000.00"
    assert got["total_records"]["value"] == "4" and got["total_quantity"]["value"] == "16"
    assert got["top_category"]["label"] == "Top Category (Office)"  # ties go to the smaller name
    assert got["period_growth"]["value"] == "+0.0%"


def test_growth_needs_two_periods(deals):
    assert period_growth(deals.filter("fiscal_quarter = '2026Q1'")).count() == 0


def test_top_segment_without_revenue(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "department string")
    assert top_category(df).first()["value"] == "2 records"


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), None, 7.0) for x in (1, 2, 3, 4, 100)], "x double, y double, z double")
    rows = {r["column"]: r for r in statistical_summary(df).collect()}
    assert set(rows) == {"x", "z"} and rows["x"]["median"] == 3.0 and rows["x"]["skewness"] == 2.23
    assert rows["z"]["skewness"] == 0.0 and rows["z"]["std_dev"] == 0.0


def test_breakdown_shares(deals):
    groups = breakdowns(deals)
    assert [tuple(r) for r in groups["by_category"].collect()] == [
        ("Office", 1, 2000.0, 2000.0, 50.0), ("Tech", 2, 2000.0, 1000.0, 50.0)]
    assert [r[0] for r in groups["by_period"].collect()] == ["2026Q1", "2026Q2"]


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in chartdata.correlation(df).collect()}
    assert got["a", "b"] == 1.0 and got["a", "c"] is None and got["c", "c"] is None and got["a", "a"] == 1.0 and len(got) == 9


def test_histogram_edges(spark):
    bins = chartdata.histogram(spark.range(31).selectExpr("cast(id as double) as x"), "x").collect()
    assert sum(b["count"] for b in bins) == 31 and bins[-1]["count"] == 2 and bins[-1]["bin_end"] == 30.0
    assert chartdata.histogram(spark.createDataFrame([(4.0,), (4.0,)], "x double"), "x").collect()[0]["count"] == 2


def test_narrative(sales):
    result = clean_data(sales)
    full, _ = derive_features(result.table)
    groups = breakdowns(full)
    rows = all_insights(dataset_profile(sales), dataset_profile(full), result.facts, kpi_table(full), result.outliers(),
                        groups["by_category"], groups["by_region"]).collect()
    texts = [r["text"] for r in rows]
    assert any(t.startswith("Overall Data Health Score improved from") for t in texts)
    assert "Eliminated 1 exact duplicate rows, preventing skewed metrics and double-counting." in texts
    assert sum(r["section"] == "recommendations" for r in rows) == 4


# --- views -------------------------------------------------------------------------

def test_deep_pages_read_only_their_ranges(spark):
    df = spark.range(5000).selectExpr("id % 700 as k", "id").repartition(6)
    directory = views.page_directory(df, ["k"], rows_per_range=200)
    assert directory.starts.count() >= 20
    want = [r["k"] for r in df.orderBy("k").collect()]
    for number, size in ((1, 15), (7, 15), (120, 37), (334, 15), (335, 15), (2, 1700)):
        found = [r["k"] for r in directory.page(number, size).collect()]
        assert found == want[(number - 1) * size:number * size], number
    pages = [r["id"] for n in range(1, 11) for r in directory.page(n, 500).collect()]
    assert sorted(pages) == list(range(5000))  # equal keys fall on one page only


def test_short_ranges_take_no_tasks_of_their_own(spark):
    df = spark.range(5000).selectExpr("id % 700 as k", "id").repartition(6)
    directory = views.page_directory(df, ["k"], rows_per_range=10)
    assert directory.starts.count() == 500 and len(directory.ranges.inputFiles()) == 1
    assert directory.page(400, 7).collect() == df.selectExpr("*", "xxhash64(k, id) as h").orderBy("k", "h").drop("h").collect()[2793:2800]


def test_ranges_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "RANGE_ROWS", 1000)
    df = spark.range(5000).selectExpr("id % 700 as k", "id").repartition(6)
    directory = views.page_directory(df, ["k"], rows_per_range=30)
    want = df.selectExpr("*", "xxhash64(k, id) as h").orderBy("k", "h").drop("h").collect()
    for number, size in ((1, 15), (66, 15), (67, 15), (3, 1000), (334, 15), (400, 15)):
        assert directory.page(number, size).collect() == want[(number - 1) * size:number * size], number


def test_search_and_pages(spark):
    df = spark.range(40).selectExpr("id", "concat('Row ', id) as name", "cast(null as string) as gap")
    assert views.search(df, "ROW 3[0-2]").count() == 3 and views.search(df, "").count() == 40
    third = views.page(df, 3, ["id"]).collect()
    assert [r["id"] for r in third] == list(range(30, 40))
    assert [r["id"] for r in views.page_after(df, {"id": 29}, ["id"]).collect()] == list(range(30, 40))
    assert views.page_info(df, 3).first() == (40, 3, "Showing rows 31 to 40 of 40 rows")


def test_missing_chart_looks_at_nothing_but_missing_values(spark):
    from tablewright.operators.chartdata import missing_chart

    raw = spark.createDataFrame([("a", None, float("nan")), (None, None, 1.0), ("b", "x", 2.0)], "A string, `B c` string, d double")
    clean = spark.createDataFrame([("a", "u", 0.0), (None, "u", 1.0), ("b", "x", 2.0)], "a string, b_c string, d double")
    chart = missing_chart(raw, clean)
    assert [tuple(r) for r in chart.collect()] == [("B c", 2, 0), ("A", 1, 1), ("d", 1, 0)]
    assert "RLIKE" not in chart._jdf.queryExecution().toString()
