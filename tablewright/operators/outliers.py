"""Outlier bounds per numeric column (IQR or z-score) and what to do with outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from tablewright.functions.numbers import as_double
from tablewright.functions.sql import number, numeric_columns, q, replace_columns
from tablewright.operators.entry import finite
from tablewright.operators.quantiles import Ends, quartiles

# Columns with fewer values, or at most two distinct ones, are skipped.
MIN_VALUES = 5
DEFAULT_THRESHOLD = 1.5
OUTLIER_SCHEMA = (
    "seq int, column string, method string, outlier_count bigint, outlier_pct double, "
    "lower_bound double, upper_bound double"
)


@dataclass(frozen=True)
class Bounds:
    column: str
    method: str
    outlier_count: int
    outlier_pct: float
    lower: float
    upper: float

    def to_dict(self) -> dict:
        return asdict(self)

    def within(self) -> str:
        return f"({q(self.column)} is null or {self.inside()})"

    def inside(self) -> str:
        return f"{as_double(self.column)} between {number(self.lower)} and {number(self.upper)}"

    def clipped(self) -> str:
        # greatest/least skip NULL, so NULL needs its own branch.
        x = as_double(self.column)
        return f"if({x} is null, null, greatest(least({x}, {number(self.upper)}), {number(self.lower)}))"


def detect_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = DEFAULT_THRESHOLD, columns: Sequence[str] | None = None,
    known: Mapping[str, Sequence[float | None]] | None = None, ends: Ends | None = None,
) -> list[Bounds]:
    """Column-pruned passes for spread, quartiles and counts. Only per-column numbers reach the driver.

    `known` are quartiles of columns that have been found already, `ends` their known values, least and greatest
    one. NaN and infinite values are missing ones.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method: {method}")
    df = finite(df)
    names = numeric_columns(df) if columns is None else list(columns)
    if not names:
        return []
    rule = ["avg({0}) as m{1}", "stddev_samp({0}) as s{1}"] if method == "zscore" else []
    wanted = ["count({0}) as n{1}", "min({0}) as lo{1}", "max({0}) as hi{1}", *rule]
    if ends is not None and not rule and all(c in ends for c in names):
        spread = {f"{k}{i}": v for i, c in enumerate(names) for k, v in zip(("n", "lo", "hi"), ends[c])}
    else:
        spread = df.selectExpr(*[e.format(as_double(c), i) for i, c in enumerate(names) for e in wanted]).first()
    usable = [(i, c) for i, c in enumerate(names) if spread[f"n{i}"] >= MIN_VALUES]
    limits: dict[str, tuple[float, float, str]] = {}
    if method == "iqr":
        known = known or {}
        own = {c: (spread[f"n{i}"], spread[f"lo{i}"], spread[f"hi{i}"]) for i, c in usable if c not in known}
        found = quartiles(df, list(own), own) | dict(known)
        for _, c in usable:
            q1, _, q3 = found[c]
            if q3 != q1:
                lower, upper = round(q1 - threshold * (q3 - q1), 2), round(q3 + threshold * (q3 - q1), 2)
                x = as_double(c)
                limits[c] = (lower, upper, f"{x} < {number(lower)} or {x} > {number(upper)}")
    else:
        for i, c in usable:
            mean, std = spread[f"m{i}"], spread[f"s{i}"]
            if std:
                outside = f"abs(({as_double(c)} - {number(mean)}) / {number(std)}) > {number(float(threshold))}"
                limits[c] = (round(mean - threshold * std, 2), round(mean + threshold * std, 2), outside)
    if not limits:
        return []
    at = {c: i for i, c in usable}
    counted = df.selectExpr(*[
        e for j, (c, (_, _, outside)) in enumerate(limits.items()) for e in (
            f"count_if({outside}) as o{j}",
            # More than two distinct values: something lies strictly between least and greatest.
            f"count_if({as_double(c)} > {number(spread[f'lo{at[c]}'])} and {as_double(c)} < {number(spread[f'hi{at[c]}'])}) as b{j}")
    ]).first()
    found = []
    for j, (c, (lower, upper, _)) in enumerate(limits.items()):
        if counted[f"o{j}"] and counted[f"b{j}"]:
            pct = round(counted[f"o{j}"] / spread[f"n{at[c]}"] * 100, 2)
            found.append(Bounds(c, method, counted[f"o{j}"], pct, lower, upper))
    return found


def outlier_table(df: DataFrame, bounds: Sequence[Bounds]) -> DataFrame:
    rows = [(i, b.column, b.method, b.outlier_count, b.outlier_pct, b.lower, b.upper) for i, b in enumerate(bounds, 1)]
    return df.sparkSession.createDataFrame(rows, OUTLIER_SCHEMA)


def handle_outliers(df: DataFrame, bounds: Sequence[Bounds], action: str = "keep") -> DataFrame:
    """`keep` as is, `cap` to the bounds, or `remove` the rows outside them."""
    if action not in ("keep", "cap", "remove"):
        raise ValueError(f"unknown outlier action: {action}")
    if action == "keep" or not bounds:
        return df
    if action == "cap":
        return replace_columns(df, {b.column: b.clipped() for b in bounds})
    return df.filter(" and ".join(b.within() for b in bounds))


def outlier_action_counts(
    df: DataFrame, bounds: Sequence[Bounds], action: str, null_is_change: bool = True, columns: Sequence[str] = (),
) -> dict[str, int]:
    """Values capped, or rows removed, per column in order; one pass.

    `columns` are counted even if no outlier was found in them: only their NULLs may count as changed.
    """
    without = [c for c in columns if c not in {b.column for b in bounds}]
    if not bounds and not without or action == "keep":
        return {}
    tests, alive = [], "true"
    for b in bounds:
        if action == "cap":
            tests.append(f"coalesce(not ({b.inside()}), {str(null_is_change).lower()})")
        else:
            tests.append(f"{alive} and not {b.within()}")
            alive = f"{alive} and {b.within()}"
    tests += [f"{q(c)} is null" if action == "cap" and null_is_change else "false" for c in without]
    row = df.selectExpr(*[f"count_if({t})" for t in tests]).first()
    return dict(zip([*(b.column for b in bounds), *without], row))
