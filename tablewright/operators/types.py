"""Data-driven type conversion of text columns: one pass decides, one projection applies."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.dates import CENTURY_PIVOT, CLEAN_DATE_PATTERNS, looks_like_date, order_evidence, parse_timestamp, wall_clock
from tablewright.functions.numbers import looks_money_percent, parse_money_percent
from tablewright.functions.sql import q, replace_columns, rows_of, text, text_columns
from tablewright.functions.text import FALSE_TOKENS, TRUE_TOKENS, is_token, parse_boolean, trim_text
from tablewright.operators.entry import finite_value

# Shares of non-null values that make a column change type.
PERCENT_SHARE, NUMBER_SHARE, DATE_LIKE_SHARE, DATE_PARSED_SHARE, BOOL_SHARE = 0.5, 0.75, 0.6, 0.5, 0.85
# How conversions are described.
CONVERSION_LABELS = {
    "number": "Float (Cleaned from Currency/Formatted Text)",
    "timestamp": "Datetime (Parsed multi-format dates)",
    "day_first_timestamp": "Datetime (Parsed multi-format dates)",
    "boolean": "Boolean (Standardized yes/no/1/0)",
}


@dataclass(frozen=True)
class DateReading:
    """How text such as `5/8/2026` is read.

    `day_first` None lets each column's own values decide: day-first where more of them can only
    be day-first than only month-first. `zone` is where the clock stands whose time is kept of
    timestamps that have a zone.
    """

    day_first: bool | None = False
    pivot: int = CENTURY_PIVOT
    zone: str = "UTC"


def type_shares(df: DataFrame, keep_text: Collection[str] = ()) -> DataFrame:
    """One row per text column: how many values read as numbers, look like dates, read as booleans."""
    texts = [c for c in text_columns(df) if c not in keep_text]
    if not texts:
        return df.sparkSession.createDataFrame([], "seq int, column string")
    names = ("known", "percent", "plain_numbers", "numbers", "date_like", "booleans")
    counts = []
    for i in range(len(texts)):
        x = f"t{i}"
        numeric = looks_money_percent(x)
        tests = (
            f"count({x})", f"count_if(endswith({x}, '%'))", f"count_if({numeric} and not contains({x}, '%'))",
            f"count_if({numeric})", f"count_if({looks_like_date(x, CLEAN_DATE_PATTERNS)})",
            f"count_if({is_token(x, (*TRUE_TOKENS, *FALSE_TOKENS))})",
        )
        counts.append("struct(" + ", ".join(f"{t} as {n}" for t, n in zip(tests, names)) + f") as s{i}")
    trimmed = df.selectExpr(*[f"{trim_text(q(c))} as t{i}" for i, c in enumerate(texts)])
    return trimmed.selectExpr(*counts).selectExpr(rows_of(
        f"struct({i} as seq, {text(c)} as column, {', '.join(f's{i}.{n} as {n}' for n in names)})"
        for i, c in enumerate(texts)))


def date_shares(df: DataFrame, columns: Collection[str], dates: DateReading = DateReading()) -> dict[str, float]:
    """Share of known values that parse as dates; the order of day and month does not change it. A text is parsed once, however often it comes."""
    columns = list(columns)
    long = df.selectExpr(*[f"{q(c)} as v{i}" for i, c in enumerate(columns)]).unpivot([], [f"v{i}" for i in range(len(columns))], "at", "value")
    values = long.filter("value is not null").groupBy("at", "value").agg(F.expr("count(1) as n"))
    parsed = parse_timestamp("value", bool(dates.day_first), dates.pivot)
    rows = values.groupBy("at").agg(F.expr(f"sum(if({parsed} is null, 0L, n)) / sum(n) as share")).collect()
    return {columns[int(r["at"][1:])]: r["share"] for r in rows}


def day_first_columns(df: DataFrame, columns: Collection[str]) -> set[str]:
    """Columns with more values that can only be day-first than only month-first."""
    if not columns:
        return set()
    row = df.selectExpr(*[f"count_if({test})" for c in columns for test in order_evidence(q(c))]).first()
    return {c for i, c in enumerate(columns) if row[2 * i] > row[2 * i + 1]}


def fit_types(df: DataFrame, keep_text: Collection[str] = (), dates: DateReading = DateReading()) -> dict[str, str]:
    """Column -> target type, for the columns that change.

    One pass over all text columns; only columns that look like dates are then parsed.
    """
    seen = sorted(r for r in type_shares(df, keep_text).collect() if r["known"])
    kinds, candidates = {}, []
    for r in seen:
        numbers = r["numbers"] if r["percent"] / r["known"] > PERCENT_SHARE else r["plain_numbers"]
        if numbers / r["known"] >= NUMBER_SHARE:
            kinds[r["column"]] = "number"
        elif r["date_like"] / r["known"] >= DATE_LIKE_SHARE:
            candidates.append(r["column"])
    parsed = date_shares(df, candidates, dates) if candidates else {}
    found = [c for c in candidates if parsed[c] >= DATE_PARSED_SHARE]
    turned = day_first_columns(df, found) if dates.day_first is None else set()
    for r in seen:
        name = r["column"]
        if name in found:
            kinds[name] = "day_first_timestamp" if name in turned else "timestamp"
        elif name not in kinds and r["booleans"] / r["known"] >= BOOL_SHARE:
            kinds[name] = "boolean"
    return {r["column"]: kinds[r["column"]] for r in seen if r["column"] in kinds}


def conversions(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Column and description of every fitted conversion."""
    rows = [(i, c, CONVERSION_LABELS[k]) for i, (c, k) in enumerate(kinds.items(), 1)]
    return df.sparkSession.createDataFrame(rows, "seq int, column string, conversion string")


def convert(df: DataFrame, kinds: Mapping[str, str], dates: DateReading = DateReading()) -> DataFrame:
    """Apply fitted conversions; zoned timestamps lose their zone and keep the wall-clock of `dates.zone`."""
    new = {}
    for field in df.schema.fields:
        x = q(field.name)
        kind = kinds.get(field.name)
        if kind == "number":
            new[field.name] = finite_value(parse_money_percent(x))
        elif kind in ("timestamp", "day_first_timestamp"):
            new[field.name] = parse_timestamp(x, bool(dates.day_first) or kind == "day_first_timestamp", dates.pivot)
        elif kind == "boolean":
            new[field.name] = parse_boolean(x)
        elif isinstance(field.dataType, T.TimestampType):
            new[field.name] = wall_clock(x, dates.zone)
    return replace_columns(df, new) if new else df
