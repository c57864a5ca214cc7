"""Exact quantiles from counts per interval of values.

`percentile` and sketches let one task merge what every task has kept. Here a span of values
is cut into intervals, rows are counted per column and interval (combined before the shuffle,
spread over reducers by interval), and cumulative counts of that bounded table tell which
interval holds a wanted rank. Its least and greatest value are the next, far shorter span; a
span with few rows is counted value by value. All columns and ranks share each pass, no row
is sorted or collected, and a value that makes up a third of a column ends as an interval of
its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import as_double
from tablewright.functions.sql import number
from tablewright.operators.entry import finite

# Intervals a span is cut into by one pass.
INTERVALS = 1024
# Rows of a span that are few enough to count each value.
MAX_VALUES = 4096
# A pass that leaves more than this share of the rows lets the next one cut by magnitude.
SLOW_SHARE = 0.125
QUARTILES = (0.25, 0.5, 0.75)

#: Per column: known values, least and greatest one.
Ends = Mapping[str, tuple[int, float | None, float | None]]


@dataclass(frozen=True)
class _Span:
    """Values of a column from `low` to `high`, both of which occur; `below` values are smaller."""

    column: str
    low: float
    high: float
    rows: int
    below: int = 0
    by_size: bool = False

    def slot(self, x: str, intervals: int) -> str:
        """Number of the interval a value of the span falls into; never falls as the value rises."""
        if self.by_size or math.isinf(self.high - self.low):
            scale = min(2.0**40 / max(abs(self.low), abs(self.high), 1e-290), 1e300)

            def size(v: float) -> float:
                return math.copysign(math.log1p(abs(v) * scale), v)

            at, low, high = f"signum({x}) * ln(1D + abs({x}) * {number(scale)})", size(self.low), size(self.high)
        else:
            at, low, high = x, self.low, self.high
        if not high > low:
            return "0"
        place = f"floor(({at} - {number(low)}) / {number(high - low)} * {intervals})"
        return f"cast(greatest(0, least({intervals - 1}, {place})) as int)"

    def part(self, rows: list[tuple[float, float, int]], rank: int) -> _Span:
        """The interval that holds a rank, from (least, greatest, rows) of all intervals in order."""
        below = self.below
        for low, high, n in rows:
            if rank < below + n:
                return _Span(self.column, low, high, n, below, not self.by_size and n > SLOW_SHARE * self.rows)
            below += n
        raise ValueError(f"{self.column}: the table has changed between two passes")


def value_ends(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """Known values, least and greatest one of each column, in one pass."""
    if not columns:
        return {}
    row = finite(df).selectExpr(*[
        e for c in columns for e in (f"count({as_double(c)})", f"min({as_double(c)})", f"max({as_double(c)})")]).first()
    return {c: tuple(row[3 * i:3 * i + 3]) for i, c in enumerate(columns)}


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Iterable[int]], ends: Ends, intervals: int = INTERVALS, max_values: int = MAX_VALUES,
    slack: float = 0.0,
) -> dict[tuple[str, int], float]:
    """The `rank`-th smallest (from 0) known values of columns; with `slack`, one of about that rank.

    `slack` is the share of a column's rows that the rank found may be off.
    """
    df = finite(df)
    at = {(c, r): _Span(c, ends[c][1], ends[c][2], ends[c][0]) for c, wanted in ranks.items() for r in wanted}

    def done(span: _Span) -> bool:
        return span.low == span.high or span.rows <= slack * ends[span.column][0]

    while spans := list(dict.fromkeys(s for s in at.values() if not done(s))):
        found = _counts(df, spans, intervals, max_values)
        at = {(c, r): s if done(s) else s.part(found[s], r) for (c, r), s in at.items()}
    return {key: s.low for key, s in at.items()}


def _counts(df: DataFrame, spans: list[_Span], intervals: int, max_values: int) -> dict[_Span, list[tuple[float, float, int]]]:
    """Least value, greatest value and rows of every interval of each span, or of every value of a small one; one pass."""
    columns = list(dict.fromkeys(s.column for s in spans))
    place = {c: f"x{i}" for i, c in enumerate(columns)}
    codes: dict[str, list[str]] = {c: [] for c in columns}
    for i, s in enumerate(spans):
        x = place[s.column]
        # A negative code says that each value is counted on its own.
        code = f"{-1 - i}L" if s.rows <= max_values else f"{i * intervals}L + {s.slot(x, intervals)}"
        codes[s.column].append(f"when {x} between {number(s.low)} and {number(s.high)} then {code}")
    values = df.selectExpr(*[f"{as_double(c)} as {x}" for c, x in place.items()])
    pairs = ", ".join(f"case {' '.join(codes[c])} end, {place[c]}" for c in columns)
    long = values.selectExpr(f"stack({len(columns)}, {pairs}) as (code, x)").filter("code is not null")
    counted = long.groupBy("code", F.expr("if(code < 0, x, null) as value")).agg(F.expr("min(x) as low"), F.expr("max(x) as high"), F.expr("count(1) as n"))
    found: dict[_Span, list[tuple[float, float, int]]] = {s: [] for s in spans}
    for r in counted.collect():  # at most `intervals` or `max_values` rows a span
        found[spans[-1 - r["code"] if r["code"] < 0 else r["code"] // intervals]].append((r["low"], r["high"], r["n"]))
    return {s: sorted(rows) for s, rows in found.items()}


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], ends: Ends | None = None, intervals: int = INTERVALS,
    max_values: int = MAX_VALUES, slack: float = 0.0,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of columns as numbers; None for a column without known values."""
    if not wanted:
        return {}
    df = finite(df)
    ends = value_ends(df, list(wanted)) if ends is None else ends
    known = {c: [p * (ends[c][0] - 1) for p in probs] for c, probs in wanted.items() if ends[c][0]}
    ranks = {c: sorted({r for x in positions for r in (math.floor(x), math.ceil(x))}) for c, positions in known.items()}
    values = order_statistics(df, ranks, ends, intervals, max_values, slack)

    def between(column: str, position: float) -> float:
        low, high = math.floor(position), math.ceil(position)
        a, b = values[column, low], values[column, high]
        return a if low == high else (high - position) * a + (position - low) * b

    return {c: [between(c, x) for x in known[c]] if c in known else [None] * len(probs) for c, probs in wanted.items()}


def quartiles(df: DataFrame, columns: Sequence[str], ends: Ends | None = None, slack: float = 0.0) -> dict[str, list[float | None]]:
    """First quartile, median and third quartile of columns: found once for outlier bounds, summary and box."""
    return exact_quantiles(df, {c: QUARTILES for c in columns}, ends, slack=slack)
