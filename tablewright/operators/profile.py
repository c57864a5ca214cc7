"""Column and table profile, health score and issue list.

All per-column counts of a table come from ONE aggregate. Distinct counts and sample
values come from a second one over (column, value) pairs, which combines map-side;
many `count(distinct)` in one aggregate would instead copy every row once per column.
Where both are asked for, text is matched there, once a value and not once a row.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import PROFILE_DATE_PATTERNS, looks_like_date
from tablewright.functions.names import expects_positive, is_nonstandard
from tablewright.functions.numbers import NOT_NUMERIC_CHARS, looks_money_percent, pct2, round_scalar
from tablewright.functions.sql import any_of, is_nested, is_numeric, is_text, is_time, q, rows_of, sql_map, text
from tablewright.functions.text import PROFILE_BOOL_TOKENS, is_token, trim_text
from tablewright.operators.dedup import duplicate_count
from tablewright.operators.entry import finite

# Semantic type names and the shares of values that earn them.
EMPTY_TEXT, NUMERIC_TEXT = "empty_text", "numeric_string (currency/formatted)"
DATE_TEXT, BOOL_TEXT, PLAIN_TEXT = "datetime_string", "boolean_string", "text_categorical"
NUMERIC_SHARE, DATE_SHARE, BOOL_SHARE = 0.70, 0.70, 0.85
# Grade floors and their labels, best first.
GRADES = (
    (90, "A+ (Excellent)"), (80, "A (Good)"), (70, "B (Acceptable)"), (50, "C (Needs Attention)"),
)
LOWEST_GRADE = "D (Critical Data Quality Issues)"
# Dimension weights of the health score.
WEIGHTS = {"c": 0.35, "u": 0.25, "v": 0.25, "k": 0.15}
# Digits that read as a negative number.
NEGATIVE_PATTERN = r"^-(\d+\.?\d*|\.\d+)$"
NO_ISSUES = "No major data quality issues detected."
EMPTY_ISSUE = "Dataset is empty."
SAMPLE_SIZE = 5

PROFILE_SCHEMA = (
    "total_rows bigint, total_columns bigint, total_cells bigint, total_missing bigint, total_missing_pct double, "
    "duplicate_count bigint, duplicate_pct double, completeness double, uniqueness double, validity double, "
    "consistency double, quality_score double, quality_grade string, is_empty boolean"
)


def dtype_family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "numeric"
    if is_text(dtype):
        return "text"
    return "datetime" if is_time(dtype) else "other"


def dtype_table(df: DataFrame) -> DataFrame:
    """Column, raw type and type family, read off the schema."""
    rows = [(i, f.name, f.dataType.simpleString(), dtype_family(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "seq int, column string, dtype string, family string")


# --- per-column counts -------------------------------------------------------------

TEXT_TESTS = ("numeric_like", "date_like", "bool_like", "blank_count", "text_negatives")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, {text(NOT_NUMERIC_CHARS)}, '')"


def _text_tests(t: str, d: str) -> dict[str, str]:
    """What is asked of a text, over its trimmed form and its digits."""
    return dict(zip(TEXT_TESTS, (
        looks_money_percent(t), looks_like_date(t, PROFILE_DATE_PATTERNS), is_token(t, PROFILE_BOOL_TOKENS), f"{t} = ''",
        f"{d} rlike {text(NEGATIVE_PATTERN)} and {d} rlike '[1-9]'")))


def _counts(field: T.StructField, i: int, tested: bool = True) -> str:
    """All counts of one column: aggregates over raw `x{i}`, trimmed `t{i}` and, for checked text, digits `d{i}`."""
    x, checked = f"x{i}", expects_positive(field.name)
    tests = dict.fromkeys((*TEXT_TESTS, "negatives"), "0L")
    if is_text(field.dataType):
        if tested:
            tests |= {n: f"count_if({e})" for n, e in _text_tests(f"t{i}", f"d{i}").items() if checked or n != "text_negatives"}
    elif checked and is_numeric(field.dataType):
        tests["negatives"] = f"count_if({x} < 0)"
    listed = ", ".join(f"{e} as {n}" for n, e in tests.items())
    return f"struct(count(1) as rows, count_if({x} is null) as missing_count, {listed}) as s{i}"


def missing_counts(df: DataFrame) -> DataFrame:
    """Column and missing values, from one pass that looks at nothing else; NaN and infinite numbers are missing ones."""
    row = finite(df).selectExpr(*[f"count_if({q(c)} is null) as n{i}" for i, c in enumerate(df.columns)])
    return row.selectExpr(rows_of(
        f"struct({i} as seq, {text(c)} as column, n{i} as missing_count)" for i, c in enumerate(df.columns)))


def column_counts(df: DataFrame) -> DataFrame:
    """One row per column, from one pass over the table; NaN and infinite numbers are missing ones."""
    return _judged(_counted(finite(df)))


def _counted(df: DataFrame, untested: Collection[str] = ()) -> DataFrame:
    """One row of counts per column; the text of `untested` columns is not looked at."""
    fields = df.schema.fields
    tested = {i: f for i, f in enumerate(fields) if is_text(f.dataType) and f.name not in untested}
    inputs = [f"{q(f.name)} as x{i}" for i, f in enumerate(fields)]
    inputs += [f"{trim_text(q(f.name))} as t{i}" for i, f in tested.items()]
    inputs += [f"{_digits(q(f.name))} as d{i}" for i, f in tested.items() if expects_positive(f.name)]
    row = df.selectExpr(*inputs).selectExpr(*[_counts(f, i, f.name not in untested) for i, f in enumerate(fields)])
    return row.selectExpr(rows_of(
        f"struct({i} as seq, {text(f.name)} as column, {text(f.dataType.simpleString())} as dtype, "
        f"{str(is_text(f.dataType)).lower()} as is_text, {str(is_nonstandard(f.name)).lower()} as nonstandard_name, s{i} as s)"
        for i, f in enumerate(fields)
    )).selectExpr("* except (s)", "s.*")


def _judged(long: DataFrame, *also: str) -> DataFrame:
    """Counts of columns with what they say of their types, and other columns of theirs."""
    typed = long.selectExpr("*", f"""case
        when not is_text then null
        when rows = missing_count then '{EMPTY_TEXT}'
        when numeric_like / (rows - missing_count) >= {NUMERIC_SHARE}D then '{NUMERIC_TEXT}'
        when date_like / (rows - missing_count) >= {DATE_SHARE}D then '{DATE_TEXT}'
        when bool_like / (rows - missing_count) >= {BOOL_SHARE}D then '{BOOL_TEXT}'
        else '{PLAIN_TEXT}' end as inferred_type""")
    return typed.selectExpr(
        "seq", "column", "dtype", "is_text", "nonstandard_name", "rows", "missing_count",
        f"{pct2('missing_count', 'rows')} as missing_pct", "numeric_like", "date_like", "bool_like", "blank_count",
        "inferred_type",
        # Text negatives count only where the column reads as numbers.
        f"if(inferred_type = '{NUMERIC_TEXT}', text_negatives, negatives) as negative_count", *also,
    )


# --- distinct values ---------------------------------------------------------------

def _value_kind(dtype: T.DataType) -> str:
    """Columns of one kind can share one typed value column."""
    family = dtype_family(dtype)
    if family == "numeric":
        return "bigint" if isinstance(dtype, T.IntegralType) else "double"
    return family


def _value(field: T.StructField) -> str:
    x, kind = q(field.name), _value_kind(field.dataType)
    if kind == "double":
        return f"cast({x} as double) + 0D"  # folds -0.0 into 0.0
    if kind == "datetime":
        return f"cast({x} as timestamp_ntz)"
    if kind == "other":
        return f"to_json({x})" if is_nested(field.dataType) else f"cast({x} as string)"
    return f"cast({x} as bigint)" if kind == "bigint" else x


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of non-null values; `columns` must be of one kind."""
    df = finite(df)
    named = df.selectExpr(*[f"{_value(df.schema[c])} as v{i}" for i, c in enumerate(columns)])
    long = named.unpivot([], [f"v{i}" for i in range(len(columns))], "at", "value")
    names = sql_map((f"v{i}", c) for i, c in enumerate(columns))
    counted = long.filter("value is not null").groupBy("at", "value").agg(F.expr("count(1) as n"))
    return counted.selectExpr(f"element_at({names}, at) as column", "value", "n")


def cardinality(df: DataFrame, samples: bool = True) -> DataFrame:
    """Exact distinct count per column and its five smallest values as text.

    The sample comes from a limited ranking: Spark cuts every task's rows to five per
    column before they are shuffled.
    """
    return _by_value(finite(df), samples, ()).drop(*TEXT_TESTS)


def _by_value(df: DataFrame, samples: bool, tested: Collection[str]) -> DataFrame:
    """`cardinality`, and for the text columns `tested` how many rows pass each test, which is made once a value."""
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kinds.setdefault(_value_kind(f.dataType), []).append(f.name)
    parts = []
    checked = [c for c in tested if expects_positive(c)]
    for kind, columns in kinds.items():
        counts = value_counts(df, columns)
        sums = [f"0L as {n}" for n in TEXT_TESTS]
        looked = counts
        if kind == "text" and tested:
            digits = f"if(column in {any_of(checked)}, {_digits('value')}, '')" if checked else "''"
            passed = _text_tests("t", "d").items()
            looked = counts.selectExpr("column", "n", f"{trim_text('value')} as t", f"{digits} as d").selectExpr(
                "column", *[f"if({e}, n, 0L) as {n}" for n, e in passed])
            sums = [f"if(column in {any_of(tested)}, {n}, 0L) as {n}" for n in TEXT_TESTS]
        part = looked.groupBy("column").agg(F.expr("count(1) as unique_count"), *([F.expr(f"sum({n}) as {n}") for n in TEXT_TESTS] if looked is not counts else []))
        part = part.selectExpr("column", "unique_count", *sums)
        if samples:
            ranked = counts.selectExpr(
                "column", "cast(value as string) as v", "row_number() over (partition by column order by value) as rank")
            smallest = ranked.filter(f"rank <= {SAMPLE_SIZE}").groupBy("column").agg(
                F.expr("sort_array(collect_list(struct(rank, v))).v as sample_values"))
            part = part.join(smallest, "column")
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_profile(df: DataFrame, samples: bool = True) -> DataFrame:
    df = finite(df)
    # Values that a collation holds for equal may still be told apart by a test.
    plain = [f.name for f in df.schema.fields if f.dataType == T.StringType()]
    values = _by_value(df, samples, plain).withColumnsRenamed({n: f"value_{n}" for n in TEXT_TESTS})
    both = _counted(df, plain).join(values, "column", "left")
    both = both.withColumns({n: F.expr(f"{n} + coalesce(value_{n}, 0L)") for n in TEXT_TESTS})
    joined = _judged(both, "unique_count", *(["sample_values"] if samples else []))
    sample = ["coalesce(sample_values, cast(array() as array<string>)) as sample_values"] if samples else []
    return joined.selectExpr("* except (unique_count)", "coalesce(unique_count, 0L) as unique_count").selectExpr(
        "seq", "column", "dtype", "inferred_type", "missing_count", "missing_pct", "unique_count",
        f"{pct2('unique_count', 'rows')} as unique_pct", *sample,
        "unique_count <= 1 and rows > 1 as is_constant", "negative_count", "blank_count", "nonstandard_name", "rows",
    )


def approx_cardinality(df: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """Sketched distinct counts: one pass, no shuffle of values."""
    df = finite(df)
    row = df.selectExpr(*[f"approx_count_distinct({q(c)}, {relative_error}) as u{i}" for i, c in enumerate(df.columns)])
    return row.selectExpr(rows_of(f"struct({text(c)} as column, u{i} as unique_count)" for i, c in enumerate(df.columns)))


# --- table profile -----------------------------------------------------------------

def _blank(compat: bool) -> str:
    """Blank cells as the score counts them: NULLs are subtracted although never counted."""
    return "greatest(blank_count - missing_count, 0L)" if compat else "blank_count"


def grade_of(score: str) -> str:
    cases = " ".join(f"when {score} >= {floor} then {text(label)}" for floor, label in GRADES)
    return f"case {cases} else {text(LOWEST_GRADE)} end"


def dataset_profile(
    df: DataFrame, counts: DataFrame | None = None, duplicates: int | None = None, blank_compat: bool = True,
) -> DataFrame:
    """One row: shape, missing, duplicates, four dimensions, score and grade."""
    if not df.columns:
        row = (0, 0, 0, 0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "N/A", True)
        return df.sparkSession.createDataFrame([row], PROFILE_SCHEMA)
    df = finite(df)
    counts = column_counts(df) if counts is None else counts
    duplicates = duplicate_count(df) if duplicates is None else duplicates
    sums = counts.selectExpr(
        "max(rows) as total_rows", "count(1) as total_columns", "sum(missing_count) as total_missing",
        f"sum(negative_count + {_blank(blank_compat)}) as invalid", "count_if(nonstandard_name) as nonstandard",
        f"count_if(inferred_type in ('{NUMERIC_TEXT}', '{DATE_TEXT}')) as unparsed",
        f"cast({duplicates} as bigint) as duplicate_count",
    ).selectExpr(
        "*", "total_rows * total_columns as total_cells",
        f"{pct2('total_missing', 'total_rows * total_columns')} as total_missing_pct",
        f"{pct2('duplicate_count', 'total_rows')} as duplicate_pct",
    )
    dims = sums.selectExpr(
        "*",
        "greatest(0D, 100D - total_missing_pct * 2) as c",
        "greatest(0D, 100D - duplicate_pct * 3) as u",
        "greatest(0D, 100D - coalesce(try_divide(invalid, total_cells) * 100, 0D) * 10) as v",
        "greatest(0D, 100D - (nonstandard / total_columns * 30 + unparsed * 15)) as k",
    )
    mix = " + ".join(f"{d} * {w}D" for d, w in WEIGHTS.items())
    scored = dims.selectExpr("*", "total_rows = 0 as is_empty", f"greatest(0D, least(100D, {round_scalar(mix, 1)})) as score")
    shown = {"c": "completeness", "u": "uniqueness", "v": "validity", "k": "consistency"}
    return scored.selectExpr(
        "total_rows", "if(is_empty, 0L, total_columns) as total_columns", "total_cells", "total_missing",
        "total_missing_pct", "duplicate_count", "duplicate_pct",
        *[f"if(is_empty, 0D, {round_scalar(d, 1)}) as {name}" for d, name in shown.items()],
        "if(is_empty, 0D, score) as quality_score", f"if(is_empty, 'N/A', {grade_of('score')}) as quality_grade", "is_empty",
    )


def _names_where(test: str) -> str:
    """Column names that pass a test, in table order."""
    return f"array_join(sort_array(collect_list(struct(seq, column)) filter (where {test})).column, ', ')"


def _counts_where(test: str, count: str) -> str:
    """`{'a': 1, 'b': 2}` over the columns that pass a test, in table order."""
    pair = f"concat('\\'', column, '\\': ', cast({count} as string))"
    return f"concat('{{', array_join(sort_array(collect_list(struct(seq, {pair} as t)) filter (where {test})).t, ', '), '}}')"


def issues(
    df: DataFrame, profile: DataFrame | None = None, duplicates: int | None = None, blank_compat: bool = True,
) -> DataFrame:
    """Ordered issue sentences of a table."""
    if not df.columns:
        return df.sparkSession.createDataFrame([(1, EMPTY_ISSUE)], "seq int, issue string")
    df = finite(df)
    profile = column_profile(df, samples=False) if profile is None else profile
    duplicates = duplicate_count(df) if duplicates is None else duplicates
    facts = profile.selectExpr("*", f"{_blank(blank_compat)} as blanks").selectExpr(
        "max(rows) as rows", "count(1) as width", "sum(missing_count) as missing",
        "count_if(missing_count > 0) as with_missing", f"cast({duplicates} as bigint) as copies",
        f"{_names_where(f"inferred_type = '{NUMERIC_TEXT}'")} as money",
        f"{_names_where(f"inferred_type = '{DATE_TEXT}'")} as dates",
        f"{_names_where('is_constant')} as constants",
        "sum(negative_count) as negatives", f"{_counts_where('negative_count > 0', 'negative_count')} as negative_text",
        "sum(blanks) as blanks", f"{_counts_where('blanks > 0', 'blanks')} as blank_text",
        "count_if(nonstandard_name) as odd_names",
    )
    # The issue sentences.
    sentences = [
        ("missing > 0", "'Found ', format_number(missing, 0), ' missing values across ', with_missing, ' columns (', "
         f"{pct2('missing', 'rows * width')}, '% of total cells).'"),
        ("copies > 0", "'Found ', format_number(copies, 0), ' exact duplicate rows (', "
         f"{pct2('copies', 'rows')}, '% of dataset).'"),
        ("money <> ''", "'Columns formatted as text with currency/symbols: ', money"),
        ("dates <> ''", "'Unparsed date columns: ', dates"),
        ("constants <> ''", "'Constant/Zero-variance columns (single unique value): ', constants"),
        ("negatives > 0", "'Found negative values in strictly positive fields: ', negative_text"),
        ("blanks > 0", "'Found blank/whitespace-only text strings in: ', blank_text"),
        ("odd_names > 0", "odd_names, ' columns have non-standard naming (spaces, mixed-case, or special characters).'"),
    ]
    found = ", ".join(f"if({test}, concat({parts}), null)" for test, parts in sentences)
    listed = facts.selectExpr("rows", f"array_compact(array({found})) as found")
    return listed.selectExpr(f"""posexplode(case
        when rows = 0 then array('{EMPTY_ISSUE}')
        when size(found) = 0 then array('{NO_ISSUES}') else found end) as (at, issue)""").selectExpr("at + 1 as seq", "issue")


def diagnostics(profile: DataFrame) -> DataFrame:
    """Per-column diagnostic table of the raw input."""
    return profile.selectExpr(
        "seq", "column as column_name", "missing_count as raw_missing_count", "concat(missing_pct, '%') as missing_pct",
        "unique_count as unique_values", "coalesce(inferred_type, 'standard') as inferred_semantic_type",
        "dtype as original_data_type",
    )


def raw_vs_clean(raw: DataFrame, clean: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Raw against clean column facts, matched through the rename map (new name -> raw name).

    Both are column profiles (or counts) of one row per column, so the join is between two tiny tables.
    """
    before = raw.selectExpr(
        "column as raw_column", "missing_count as raw_missing", "missing_pct as raw_pct", "inferred_type")
    after = clean.selectExpr(
        "seq", "column as column_name", "missing_count as clean_missing_count", "dtype as clean_data_type",
        f"coalesce(try_element_at({sql_map(renames.items())}, column), column) as raw_column")
    return after.join(before, "raw_column", "left").selectExpr(
        "seq", "column_name", "coalesce(raw_missing, 0L) as raw_missing_count",
        "concat(coalesce(raw_pct, 0D), '%') as raw_missing_pct", "clean_missing_count",
        "coalesce(inferred_type, 'standard') as inferred_type", "clean_data_type",
    )


def before_after(raw: DataFrame, clean: DataFrame, duplicates_removed: int) -> DataFrame:
    """Scorecard rows from two one-row profiles."""
    health = "concat(quality_score, '/100 [', quality_grade, ']')"
    # Metric names, and the wording of the change column below.
    metrics = [
        ("Total Rows", "cast(total_rows as string)", "total_rows"),
        ("Total Columns", "cast(total_columns as string)", "total_columns"),
        ("Missing Values", "cast(total_missing as string)", "total_missing"),
        ("Duplicate Rows", "cast(duplicate_count as string)", "duplicate_count"),
        ("Health Score", health, "quality_score"),
    ]

    def side(profile: DataFrame, name: str) -> DataFrame:
        return profile.selectExpr(rows_of(
            f"struct({i} as seq, {text(m)} as metric, '{name}' as side, {shown} as shown, cast({v} as double) as v)"
            for i, (m, shown, v) in enumerate(metrics, start=1)))

    stacked = side(raw, "raw").unionByName(side(clean, "clean"))
    per_metric = stacked.groupBy("seq", "metric").agg(
        F.expr("max(shown) filter (where side = 'raw') as before"), F.expr("max(shown) filter (where side = 'clean') as after"),
        F.expr("max(v) filter (where side = 'clean') - max(v) filter (where side = 'raw') as delta"),
        F.expr("cast(max(v) filter (where side = 'clean') as bigint) as left_over"))
    return per_metric.selectExpr("seq", "metric", "before", "after", f"""case seq
        when 1 then '-{duplicates_removed} dups'
        when 2 then concat(if(delta >= 0, '+', '-'), cast(abs(delta) as bigint), ' cols')
        when 3 then if(left_over = 0, 'Resolved 100%', concat(left_over, ' Remaining'))
        when 4 then concat(left_over, ' Duplicates Remaining')
        else concat(if(delta >= 0, '+', '-'), replace(format_number(abs(delta), 1), ',', ''), ' pts') end as change""")
