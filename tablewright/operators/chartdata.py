"""The data behind each chart; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import as_double, round2
from tablewright.functions.sql import is_numeric, number, numeric_columns, q, sql_map, text
from tablewright.operators.analytics import total
from tablewright.operators.entry import finite
from tablewright.operators.profile import missing_counts
from tablewright.operators.quantiles import quartiles, value_ends
from tablewright.operators.standardize import clean_names

# Column preferences of the charts, first present wins.
TREND_TIME_COLUMNS = ("order_month_year", "month_year", "order_date", "signup_date", "fiscal_quarter")
CHART_VALUE_COLUMNS = ("calculated_revenue", "net_revenue", "revenue", "gross_revenue", "total_amount", "salary",
                       "annual_income")
CHART_CATEGORY_COLUMNS = ("product_category", "category", "department", "business_unit", "customer_segment")
DONUT_COLUMNS = ("region", "location", "city", "gender", "status", "payment_method")
# Gauge bands by score floor.
GAUGE_BANDS = ((90, "green"), (75, "blue"), (50, "amber"))
LOWEST_BAND = "red"
HISTOGRAM_BINS = 30
CORRELATION_SCHEMA = "col_a string, col_b string, r double"


def first_present(df: DataFrame, names: tuple[str, ...], numeric: bool = False) -> str | None:
    fields = {f.name: f.dataType for f in df.schema.fields}
    return next((n for n in names if n in fields and (not numeric or is_numeric(fields[n]))), None)


def chart_value_column(df: DataFrame) -> str | None:
    return first_present(df, CHART_VALUE_COLUMNS, numeric=True) or next(iter(numeric_columns(df)), None)


def missing_chart(raw: DataFrame, clean: DataFrame, top: int = 10, renames: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Raw columns with most missing values beside the count of the clean column each became.

    `renames` are the cleaning plan's (raw name, clean name); by default what it makes of the raw headers.
    """
    pairs = clean_names(raw)[1] if renames is None else renames
    worst = missing_counts(raw).filter("missing_count > 0").orderBy(F.desc("missing_count"), "seq").limit(top).selectExpr(
        "column", "missing_count as raw_missing", f"try_element_at({sql_map(pairs)}, column) as clean_column")
    after = missing_counts(clean).selectExpr("column as clean_column", "missing_count as clean_missing")
    return worst.join(after, "clean_column", "left").selectExpr(
        "column", "raw_missing", "coalesce(clean_missing, 0L) as clean_missing").orderBy(F.desc("raw_missing"), "column")


def _sums(df: DataFrame, key: str, value: str) -> DataFrame:
    return finite(df).filter(f"{q(key)} is not null").groupBy(q(key)).agg(F.expr(f"{total(as_double(value))} as {q(value)}"))


def trend(df: DataFrame, date: str, value: str) -> DataFrame:
    return _sums(df, date, value).orderBy(q(date))


def category_bars(df: DataFrame, category: str, value: str) -> DataFrame:
    return _sums(df, category, value).orderBy(q(value), q(category))


def top_categories(df: DataFrame, category: str, value: str, top: int = 8) -> DataFrame:
    return _sums(df, category, value).orderBy(F.desc(q(value)), q(category)).limit(top)


def donut(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Sum (or row count) per category and its share of the whole."""
    if value is not None and value in df.columns and is_numeric(df.schema[value].dataType):
        groups, name = _sums(df, category, value), value
    else:
        groups, name = df.filter(f"{q(category)} is not null").groupBy(q(category)).count(), "count"
    whole = groups.selectExpr(f"cast(sum({q(name)}) as double)").scalar()
    return groups.withColumn("__whole", whole).selectExpr(
        q(category), q(name), f"{round2(f'try_divide({q(name)} * 100D, __whole)')} as share_pct")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between least and greatest value; empty bins are not listed."""
    df, x = finite(df), as_double(column)
    ends = df.selectExpr(f"struct(min({x}) as low, max({x}) as high)").scalar()
    width = f"((e.high - e.low) / {bins})"
    at = f"cast(least(coalesce(floor(try_divide(x - e.low, {width})), 0), {bins - 1}) as int)"
    values = df.selectExpr(f"{x} as x").filter("x is not null")
    binned = values.withColumn("e", ends).groupBy(F.expr(f"{at} as bin")).agg(F.expr("count(1) as count"))
    return binned.withColumn("e", ends).selectExpr(
        "bin", f"{round2(f'e.low + {width} * bin')} as bin_start",
        f"{round2(f'e.low + {width} * (bin + 1)')} as bin_end", "count").orderBy("bin")


def box(df: DataFrame, column: str, reach: float = 1.5, known: Sequence[float | None] | None = None) -> DataFrame:
    """Five numbers, fences and how many values lie beyond them; `known` are quartiles found already."""
    df, x = finite(df), as_double(column)
    ends = value_ends(df, [column])
    middle = list(known) if known is not None else quartiles(df, [column], ends)[column]
    five = df.sparkSession.createDataFrame(
        [(ends[column][1], *middle, ends[column][2])], ", ".join(f"{n} double" for n in ("min", "q1", "median", "q3", "max")))
    fences = five.selectExpr(
        "*", f"{round2(f'q1 - (q3 - q1) * {number(reach)}')} as lower_fence",
        f"{round2(f'q3 + (q3 - q1) * {number(reach)}')} as upper_fence")
    ends = fences.selectExpr("struct(lower_fence, upper_fence)").scalar()
    points = df.selectExpr(f"{x} as x").withColumn("e", ends).selectExpr(
        "count_if(x < e.lower_fence or x > e.upper_fence)").scalar()
    return fences.withColumn("outlier_points", points)


def box_points(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """The values drawn as single points beyond the fences."""
    df, x = finite(df), as_double(column)
    return df.filter(f"not ({x} between {number(float(lower))} and {number(float(upper))})").selectExpr(f"{x} as {q(column)}")


def correlation(df: DataFrame) -> DataFrame:
    """Pearson r of every pair of numeric columns over rows where both are known; NULL where either does not vary.

    Two passes for any number of columns. The first finds means; the second sums products of one
    vector per row, which holds for each column whether it is known, its distance from the mean and
    that distance squared. Every sum a pair needs, over the rows where both are known, is one entry
    of that matrix of products, whose size depends on the columns alone.
    """
    df = finite(df)
    names = numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], CORRELATION_SCHEMA)
    means = df.selectExpr(*[f"avg({as_double(c)})" for c in names]).first()
    apart = [f"{as_double(c)} - {number(m)}" for c, m in zip(names, means)]
    parts = [f"if({x} is null, 0D, {y})" for make in ("1D", "{0}", "({0}) * ({0})") for x, y in ((x, make.format(x)) for x in apart)]
    rows = df.select(array_to_vector(F.expr(f"array({', '.join(parts)})")).alias("v"))
    p = len(names)
    sums = np.array(RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, 3 * p).computeGramianMatrix().toArray()) if df.head(1) else np.zeros((3 * p, 3 * p))
    known, value, square = slice(0, p), slice(p, 2 * p), slice(2 * p, 3 * p)
    n, sx, sxx = sums[known, known], sums[value, known], sums[square, known]
    with np.errstate(divide="ignore", invalid="ignore"):
        left = sxx - sx * sx / n
        spread = np.where(left > sxx * 1e-13, left, np.nan)  # what is left of rounding counts as none
        r = np.rint((sums[value, value] - sx * sx.T / n) / np.sqrt(spread * spread.T) * 100) / 100
    np.fill_diagonal(r, np.where(np.isnan(np.diag(spread)), np.nan, 1.0))
    return df.sparkSession.createDataFrame(
        [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], CORRELATION_SCHEMA)


def gauge_band(score: str) -> str:
    cases = " ".join(f"when {score} >= {floor} then '{band}'" for floor, band in GAUGE_BANDS)
    return f"case {cases} else '{LOWEST_BAND}' end"
