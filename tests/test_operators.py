import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import dedup, fill, impute, outliers, quantiles, standardize, types
from tablewright.operators.fill import fill_ordered
from tablewright.operators.types import DateReading
from tablewright.plans.cleaning import CleaningPlan, CleanOptions, clean_data


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- duplicates --------------------------------------------------------------------

def test_duplicates_are_counted_and_removed(sales):
    assert dedup.duplicate_count(sales) == 1
    assert dedup.remove_duplicates(sales).count() == 4


def test_duplicates_treat_null_as_equal_and_hash_twins_as_different(spark):
    # Hashing skips NULL, so the second and third row share a hash without being equal.
    df = spark.createDataFrame([("a", None), ("b", None), (None, "b"), ("a", None)], "x string, y string")
    assert dedup.duplicate_count(df) == 1
    assert rows_of(dedup.remove_duplicates(df)) == sorted([("a", None), ("b", None), (None, "b")], key=repr)


def test_duplicates_without_broadcast(sales, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_BROADCAST_HASHES", 0)
    assert dedup.duplicate_count(sales) == 1
    assert dedup.remove_duplicates(sales).count() == 4


def test_one_row_that_fills_a_third_of_the_table(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "if(id % 3 = 0, 'hot', 'cold') as v")
    assert dedup.duplicate_count(df) == 999
    assert dedup.remove_duplicates(df).count() == 2001


def test_keep_first_follows_the_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (None, 5, "n"), (None, 4, "m")], "k int, t int, v string")
    assert rows_of(dedup.keep_first(df, ["k"], ["t"])) == sorted([(1, 1, "a"), (2, 2, "b"), (None, 4, "m")], key=repr)
    with pytest.raises(ValueError):
        dedup.keep_first(df, ["k"], [])


# --- types, categories, signs ------------------------------------------------------

def test_types_follow_the_data(sales):
    kinds = types.fit_types(sales)
    assert kinds == {"Order Date": "timestamp", "Unit Price": "number", "Discount %": "number"}
    typed = types.convert(sales, kinds)
    assert [r[0] for r in typed.orderBy("Order ID").select("Unit Price").collect()] == [1200.5, 450.0, 150.0, 150.0, 99.99]
    assert typed.filter("`Order Date` is null").count() == 1


def test_ratios_decide_at_the_edges(spark):
    def kind(values):
        df = spark.createDataFrame([(v,) for v in values], "x string")
        return types.fit_types(df).get("x")

    assert kind(["1", "2", "3", "x"]) == "number"
    assert kind(["1", "2", "x", "y"]) is None
    assert kind(["5%", "6%", "7%", "n/a"]) == "number"
    assert kind(["5%", "x", "x", "1"]) is None
    assert kind(["yes", "no"] * 9 + ["x"] * 2) == "boolean"
    assert kind(["yes"] * 8 + ["x"] * 2) is None
    assert kind(["2026-01-01", "2026-99-99"]) == "timestamp"
    assert kind(["2026-01-01", "2026-99-99", "2026-99-98"]) is None
    assert kind([None, None]) is None


def test_keep_text_and_day_first(spark):
    df = spark.createDataFrame([("08-03-2024", "00123")], "d string, zip string")
    kinds = types.fit_types(df, keep_text=["zip"])
    assert kinds == {"d": "timestamp"}
    assert types.convert(df, kinds, DateReading(day_first=True)).first()["d"].day == 8


def test_categories(sales):
    out = {r["Order ID"]: r for r in standardize.standardize_categories(sales).collect()}
    assert out["A-2"]["Region"] == "North" and out["A-2"]["Gender"] == "Male"
    assert out["A-2"]["Customer Name"] == "Bob Ray" and out["A-4"]["Customer Name"] is None


def test_large_mapping_is_joined(spark):
    df = spark.createDataFrame([(f" City{i % 300} ",) for i in range(600)] + [(None,), ("else where",)], "town string")
    mapping = {"town": {f"city{i}": f"T{i}" for i in range(300)}}
    got = standardize.standardize_categories(df, mapping)
    assert got.filter("town = 'T7'").count() == 2 and got.filter("town = 'Else Where'").count() == 1
    assert got.filter("town is null").count() == 1 and got.columns == ["town"]


def test_change_counts_include_null_unless_asked(spark):
    df = spark.createDataFrame([("North",), ("north",), (None,)], "region string")
    assert standardize.category_changes(df).first()["changes"] == 2
    assert standardize.category_changes(df, null_is_change=False).first()["changes"] == 1


def test_negative_amounts(spark):
    df = spark.createDataFrame([(-3, -1.5, -1), (4, 2.0, 1)], "quantity int, unit_price double, delta int")
    assert rows_of(standardize.absolute_values(df)) == [(3, 1.5, -1), (4, 2.0, 1)]
    assert {r[0]: r[1] for r in standardize.negative_counts(df).collect()} == {"quantity": 1, "unit_price": 1}


def test_a_columns_own_values_decide_the_order(spark):
    rows = [("05/08/2024", "05/08/2024", "x")] * 3 + [("25/08/2024", "08/25/2024", "x"), ("26.08.24", "8/26/24", "x")]
    df = spark.createDataFrame(rows, "eu string, us string, t string")
    dates = DateReading(day_first=None)
    kinds = types.fit_types(df, dates=dates)
    assert kinds == {"eu": "day_first_timestamp", "us": "timestamp"}
    first = types.convert(df, kinds, dates).where("t = 'x'").select("eu", "us").distinct().collect()
    assert {(r.eu.month, r.us.month) for r in first} == {(8, 5), (8, 8)}
    plan = clean_data(df, CleanOptions(day_first=None)).plan
    assert CleaningPlan.from_json(plan.to_json()).kinds == kinds


# --- missing values ----------------------------------------------------------------

def test_median_and_mode(spark):
    df = spark.createDataFrame([(10.0, "A"), (20.0, "B"), (30.0, "A"), (None, None)], "n double, c string")
    out, fills = impute.handle_missing(df, categorical="mode")
    assert (20.0, "A") in rows_of(out) and [f.value for f in fills] == [20.0, "A"]


def test_mode_ties_take_the_smallest_and_wide_columns_take_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert impute.fit_missing(df)[0].value == "a"
    wide = spark.createDataFrame([(f"v{i}",) for i in range(20)] + [(None,)], "c string")
    assert impute.fit_missing(wide)[0].value == "Unknown"
    narrow = spark.createDataFrame([(f"v{i}",) for i in range(19)] + [(None,)], "c string")
    assert impute.fit_missing(narrow)[0].value == "v0"
    assert impute.fit_missing(wide, categorical="mode")[0].value == "v0"


def test_ordered_categories_take_the_least_of_equal_modes(spark):
    df = spark.createDataFrame([("S", "x"), ("M", "x"), ("M", "y"), ("S", "y"), ("odd", None), (None, None)], "size string, t string")
    fills = {f.column: (f.strategy, f.value) for f in impute.fit_missing(df, categories={"size": ["S", "M", "L"]})}
    assert fills == {"size": ("categorical_mode", "S"), "t": ("mode_or_unknown", "x")}
    tagged = df.withColumn("size", F.col("size").alias("size", metadata={impute.CATEGORIES: ["M", "S"]}))
    assert {f.column: f.value for f in impute.fit_missing(tagged)}["size"] == "M"
    nothing = df.where("size is null")
    assert impute.fit_missing(nothing, categories={"size": ["S"]})[0].value == "Unknown"


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "n double, c string, b boolean")
    out, fills = impute.handle_missing(df)
    assert out.first() == (0.0, "Unknown", False) and len(fills) == 3


def test_whole_numbers_get_whole_fills(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    out, _ = impute.handle_missing(df, numeric="mean")
    assert rows_of(out) == [(1,), (2,), (2,)]


def test_drops_are_sequential(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (2.0, None), (3.0, 4.0)], "a double, b double")
    out, fills = impute.handle_missing(df, numeric="drop_row")
    assert rows_of(out) == [(3.0, 4.0)] and [f.count for f in fills] == [2, 1]


def test_drop_narrows_later_medians(spark):
    df = spark.createDataFrame([("x", 100.0), (None, 900.0), ("y", None), ("z", 300.0)], "k string, n double")
    out, fills = impute.handle_missing(df, categorical="drop_row")
    assert [f.value for f in fills] == [None, 200.0] and out.count() == 3


def test_unknown_numeric_strategy_is_refused(spark):
    with pytest.raises(ValueError):
        impute.fit_missing(spark.createDataFrame([(None,)], "n double"), numeric="guess")


def test_dates_stay_missing_by_default(spark):
    df = spark.sql("select timestamp_ntz '2026-01-01 00:00:00' as d union all select null")
    out, fills = impute.handle_missing(df)
    assert fills[0].action == "keep" and out.filter("d is null").count() == 1


@pytest.mark.parametrize("rows_per_bucket", [10, 37, 1000])
@pytest.mark.parametrize("groups", [(), ("g",)])
def test_ordered_fill_matches_brute_force(spark, rows_per_bucket, groups):
    rng = random.Random(5)
    # One group holds most rows; long gaps cross bucket borders; one group is all missing.
    data = pd.DataFrame({
        "i": range(300), "g": ["hot" if rng.random() < 0.6 else rng.choice("abcn") for _ in range(300)],
        "x": [rng.random() if rng.random() < 0.06 else None for _ in range(300)],
    })
    data.loc[data.g == "n", "x"] = None
    df = spark.createDataFrame(data).withColumn("x", F.expr("if(isnan(x), null, x)")).repartition(5)
    got = fill_ordered(df, ["x"], ["i"], list(groups), rows_per_bucket).toPandas().sort_values("i")
    want = (data.groupby("g")["x"] if groups else data["x"]).ffill()
    want = (data.assign(x=want).groupby("g")["x"].bfill() if groups else want.bfill())
    assert np.allclose(got["x"].astype(float), want.astype(float), equal_nan=True) and list(got.columns) == ["i", "g", "x"]


@pytest.mark.parametrize("identical", [False, True])
def test_a_key_with_a_third_of_the_rows_is_spread(spark, identical):
    """Rows of one sort key, even rows that are equal throughout, go to many buckets and come out right."""
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 7, id) as t", f"if(id % 3 = 0 and {str(identical).lower()}, 0, id) as i",
        "if(id = 1 or id % 1000 = 999, cast(id as double), null) as x").repartition(4)
    numbered = rows.withColumn(fill._ROW, F.monotonically_increasing_id())
    dealt, _ = fill._dealt(numbered, ["t"], rows.columns, 300)
    sizes = [r["count"] for r in dealt.groupBy(fill._BUCKET).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 900
    got = fill_ordered(rows, ["x"], ["t"], rows_per_bucket=300)
    assert got.count() == 6000 and got.where("x is null").isEmpty()
    again = fill_ordered(rows.repartition(9), ["x"], ["t"], rows_per_bucket=450)
    assert rows_of(got) == rows_of(again)


def test_ordered_fill_needs_an_order(spark):
    with pytest.raises(ValueError):
        fill_ordered(spark.range(3), ["id"], [])


# --- quantiles, outliers -----------------------------------------------------------

def _column(kind):
    rng = np.random.default_rng(3)
    return {
        "smooth": rng.lognormal(size=5000), "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000) * 9),
        "two": rng.integers(0, 2, 5000).astype(float), "constant": np.full(5000, 3.0),
        "wide": np.concatenate([[-1.7e308, 1.7e308, 5e-324, -0.0, 0.0], rng.normal(size=3000), rng.normal(size=500) * 1e-200, rng.normal(size=500) * 1e200]),
        "near": 1e15 + rng.integers(0, 5, 4000) * 0.125,
    }[kind]


@pytest.mark.parametrize("kind", ["smooth", "hot", "two", "constant", "wide", "near"])
@pytest.mark.parametrize(("intervals", "max_values"), [(1024, 4096), (16, 30), (3, 0)])
def test_quantiles_are_exact(spark, kind, intervals, max_values):
    x = _column(kind)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    if intervals == 3:
        probs = [0.25, 0.999]
    with np.errstate(over="ignore"):
        want = np.quantile(x, probs, method="inverted_cdf" if kind == "wide" else "linear")
    if kind == "wide":  # the ranks themselves: interpolation between such ends overflows
        ranks = [max(0, int(np.ceil(p * len(x))) - 1) for p in probs]
        found = quantiles.order_statistics(df, {"x": ranks}, quantiles.value_ends(df, ["x"]), intervals, max_values)
        assert [found["x", r] for r in ranks] == want.tolist()
    else:
        assert np.allclose(quantiles.exact_quantiles(df, {"x": probs}, intervals=intervals, max_values=max_values)["x"], want, rtol=1e-15)


def test_quantiles_of_several_columns_with_gaps(spark):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"a": rng.normal(size=9000), "b": rng.integers(0, 9, 9000).astype(float), "c d.e": rng.exponential(size=9000)})
    a.loc[::3, "a"], a.loc[::7, "c d.e"] = np.nan, np.inf
    found = quantiles.quartiles(spark.createDataFrame(a), list(a.columns))
    for c in a.columns:
        assert np.allclose(found[c], np.quantile(a[c][np.isfinite(a[c])], quantiles.QUARTILES))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles.exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}
    assert quantiles.exact_quantiles(df, {}) == {}


def test_slack_in_rank(spark):
    df = spark.range(100_000).selectExpr("cast(id * id as double) as x").repartition(5)
    (middle,) = quantiles.exact_quantiles(df, {"x": [0.5]}, slack=0.01)["x"]
    assert abs(middle**0.5 - 50_000) <= 1000


def test_counts_per_interval_do_not_meet_in_one_task(spark, monkeypatch):
    """Rows that any reducer reads are bounded by the intervals it is dealt, however many tasks there are."""
    df = spark.range(200_000).selectExpr("cast(rand(3) as double) as x").repartition(64)
    spans = [quantiles._Span("x", low, high, n) for c, (n, low, high) in quantiles.value_ends(df, ["x"]).items()]
    seen = {}
    plan_of = type(df).collect

    def collect(self):
        seen["plan"] = self._jdf.queryExecution().toString()
        return plan_of(self)

    monkeypatch.setattr(type(df), "collect", collect)
    quantiles._counts(df, spans, 256, 10)
    assert "SinglePartition" not in seen["plan"] and "hashpartitioning(code" in seen["plan"]


def test_iqr_outliers_and_their_treatment(spark):
    df = spark.createDataFrame([(v,) for v in (50000, 52000, 48000, 51000, 49000, 53000, 1000000)] + [(None,)], "salary int")
    bounds = outliers.detect_outliers(df)
    assert [(b.column, b.outlier_count, b.outlier_pct) for b in bounds] == [("salary", 1, 14.29)]
    capped = outliers.handle_outliers(df, bounds, "cap")
    assert capped.agg(F.max("salary")).first()[0] == bounds[0].upper and capped.filter("salary is null").count() == 1
    assert outliers.handle_outliers(df, bounds, "remove").count() == 7
    assert outliers.outlier_action_counts(df, bounds, "cap") == {"salary": 2}
    assert outliers.outlier_action_counts(df, bounds, "cap", null_is_change=False) == {"salary": 1}
    assert outliers.outlier_action_counts(df, bounds, "remove") == {"salary": 1}


def test_action_counts_of_a_column_without_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(None,)], "salary double")
    assert outliers.detect_outliers(df) == [] and outliers.outlier_action_counts(df, [], "cap") == {}
    assert outliers.outlier_action_counts(df, [], "cap", columns=["salary"]) == {"salary": 1}
    assert outliers.outlier_action_counts(df, [], "cap", null_is_change=False, columns=["salary"]) == {"salary": 0}
    assert outliers.outlier_action_counts(df, [], "remove", columns=["salary"]) == {"salary": 0}


def test_columns_without_outlier_rule(spark):
    df = spark.createDataFrame([(1.0, float(i % 2), 5.0 if i < 9 else 6.0 + i) for i in range(10)], "c double, two double, flat double")
    assert outliers.detect_outliers(df) == []
    assert outliers.detect_outliers(df.limit(4)) == []
    z = outliers.detect_outliers(df, "zscore", 2.5)
    assert [b.column for b in z] == []  # `flat` has only two distinct values


def test_zscore(spark):
    xs = [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 50.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    (found,) = outliers.detect_outliers(df, "zscore")
    assert found.outlier_count == 1 and found.upper == round(np.mean(xs) + 1.5 * np.std(xs, ddof=1), 2)


# --- scale of a cleaning run -------------------------------------------------------

@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_run_reads_its_source_once_and_keeps_one_of_equal_rows(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "MAX_BROADCAST_HASHES", most)
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(1)
            yield r

    rows = [(i % 40, f"${i % 40}.5", None if i % 4 else "a") for i in range(60)]
    source = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).mapPartitions(seen), "id int, price string, kind string")
    result = clean_data(source)
    assert reads.value == 60
    assert result.table.count() == 40 and result.duplicates_removed == 20 and result.initial_shape == (60, 3)
    assert reads.value == 60


def test_long_methods_are_allowed_again_after_a_run(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    clean_data(spark.createDataFrame([(1, "a")], "id int, kind string"))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
