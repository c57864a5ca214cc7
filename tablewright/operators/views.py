"""Previewing: first rows, search across all columns, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.sql import literal, q, text
from tablewright.sources.staging import stage

HEAD_ROWS = 20
PAGE_ROWS = 15
# Rows of a range of a page directory: what is sorted for a page. A task deals out that many, in one or more ranges.
RANGE_ROWS = 1_000_000
_RANGE, _AT = "__page_range", "__page_at"
# `monotonically_increasing_id` holds the task above this bit, the row's place in it below.
_TASK_BIT = 33


def head(df: DataFrame, order_by: Sequence[str], rows: int = HEAD_ROWS) -> DataFrame:
    return df.orderBy(*[q(c) for c in order_by]).limit(rows)


def search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where any column, as text, matches the case-blind regular expression."""
    if not pattern:
        return df
    regex = text(f"(?i){pattern}")
    return df.filter(" or ".join(f"coalesce(cast({q(c)} as string) rlike {regex}, false)" for c in df.columns))


@dataclass(frozen=True)
class PageDirectory:
    """A table cut along an order into ranges, staged, and how many rows lie before each range.

    Any page, however deep, reads the ranges that hold its rows: no task sorts what precedes it.
    """

    ranges: DataFrame
    starts: DataFrame  # range, first (rows before it), rows
    keys: tuple[str, ...]
    columns: tuple[str, ...]

    def page(self, number: int, size: int = PAGE_ROWS) -> DataFrame:
        """Rows of one page, in order."""
        first = (number - 1) * size
        holding = self.starts.where(f"first < {first + size} and first + rows > {first}").orderBy("range").collect()
        skipped = first - holding[0]["first"] if holding else 0
        here = self.ranges.where(F.col(_RANGE).between(holding[0]["range"], holding[-1]["range"]) if holding else F.lit(False))
        return here.orderBy(*[F.expr(k) for k in self.keys]).offset(skipped).limit(size).select(*[q(c) for c in self.columns])


def page_directory(df: DataFrame, order_by: Sequence[str], rows_per_range: int = RANGE_ROWS) -> PageDirectory:
    """Rows dealt to ranges by `order_by` and, where that is equal, by a hash of the row.

    The number of tasks goes by `RANGE_ROWS`, however short the ranges are: each task sorts its rows and cuts
    them, so what the driver hears of samples and tasks does not grow with the number of ranges.
    """
    row = f"xxhash64({', '.join(q(c) for c in df.columns)})"
    keys = (*[q(c) for c in order_by], row)
    tasks = max(1, -(-df.count() // max(RANGE_ROWS, rows_per_range)))
    in_order = [F.expr(k) for k in keys]
    placed = df.repartitionByRange(tasks, *in_order).sortWithinPartitions(*in_order).withColumn(_AT, F.monotonically_increasing_id())
    task, place = f"shiftright({_AT}, {_TASK_BIT})", f"({_AT} & {(1 << _TASK_BIT) - 1}L)"
    dealt = placed.selectExpr("*", f"shiftleft({task}, {_TASK_BIT}) + {place} div {rows_per_range} as {_RANGE}").drop(_AT)
    dealt = stage(dealt, "page-ranges")
    counts = stage(dealt.groupBy(_RANGE).agg(F.count("*").alias("rows")), "page-counts")  # one row a range
    counts = counts.selectExpr(f"{_RANGE} as range", "rows", f"shiftright({_RANGE}, {_TASK_BIT}) as task")
    per_task = counts.groupBy("task").agg(F.sum("rows").alias("n")).selectExpr("task", "sum(n) over (order by task) - n as before")
    starts = counts.join(F.broadcast(per_task), "task").selectExpr(
        "range", "rows", f"before + (range & {(1 << _TASK_BIT) - 1}L) * {rows_per_range} as first")
    return PageDirectory(dealt, stage(starts, "page-starts"), keys, tuple(df.columns))


def page(df: DataFrame, number: int, order_by: Sequence[str], size: int = PAGE_ROWS) -> DataFrame:
    """Rows of one page in an explicit order; for several pages, or a deep one, keep a `page_directory`."""
    return page_directory(df, order_by).page(number, size)


def page_after(df: DataFrame, last: Mapping[str, object], order_by: Sequence[str], size: int = PAGE_ROWS) -> DataFrame:
    """The page that follows a known last row: deep pages without sorting what precedes them."""
    key = ", ".join(f"{q(c)} as k{i}" for i, c in enumerate(order_by))
    seen = ", ".join(
        f"{literal(last[c], df.schema[c].dataType.simpleString())} as k{i}" for i, c in enumerate(order_by))
    return df.filter(f"struct({key}) > struct({seen})").orderBy(*[q(c) for c in order_by]).limit(size)


def page_info(df: DataFrame, number: int, size: int = PAGE_ROWS) -> DataFrame:
    """Row count, page count and the row range label."""
    first, last = (number - 1) * size + 1, number * size
    return df.selectExpr("count(1) as rows").selectExpr(
        "rows", f"greatest(1L, floor((rows - 1) / {size}) + 1) as pages",
        f"concat('Showing rows {first} to ', least({last}L, rows), ' of ', format_number(rows, 0), ' rows') as label")
