"""Forward fill then backward fill along an explicit order, without one giant window.

Rows are dealt to buckets by their whole sort key (fill groups, the order columns, and what
tells equal keys apart), so neither an un-partitioned table nor a group or a key that holds a
third of all rows lands in one task. The dealt table is staged with its bucket; each bucket
fills itself with an ordinary window, and the values that must cross borders come from one
scan over a table of one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.sql import q
from tablewright.operators.entry import finite
from tablewright.sources.staging import stage

ROWS_PER_BUCKET = 2_000_000
# The table of borders is broadcast: beyond so many buckets they get longer, not more.
MAX_BUCKETS = 65_536
_ROW, _BUCKET, _GROUP, _KEY = "__fill_row", "__fill_bucket", "__fill_group", "__fill_key"


def fill_ordered(
    df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
    partition_by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Forward fill `columns`, then backward fill what is left at the start of each group.

    Rows with equal `order_by` follow each other by a hash of the row, so the result does not
    depend on how the table is partitioned. NULL keys come first.
    """
    if not order_by:
        raise ValueError("forward_fill needs order_by: rows have no inherent order")
    df = finite(df)
    # Read once; the number of a row only splits rows that are equal throughout.
    rows = stage(df.withColumn(_ROW, F.monotonically_increasing_id()), "fill-rows")
    dealt, buckets = _dealt(rows, [*partition_by, *order_by], df.columns, rows_per_bucket)
    group = "struct(" + ", ".join([*(q(c) for c in partition_by), "0 as all_rows"]) + ")"
    key = _sort_key([*partition_by, *order_by], df.columns)
    keyed = dealt.selectExpr("*", f"{group} as {_GROUP}", f"{key} as {_KEY}")

    # What a row still misses after the forward fill lies before the first known value of its
    # group, so the backward fill is that value: a frame over the whole group, computed once,
    # where a frame from each row to the end would be quadratic.
    local = f"partition by {_BUCKET}, {_GROUP} order by {_KEY} rows between unbounded preceding"
    filled = keyed.selectExpr("*", *[
        e for i, c in enumerate(columns) for e in (
            f"last_value({q(c)}) ignore nulls over ({local} and current row) as __last{i}",
            f"first_value({q(c)}) ignore nulls over ({local} and unbounded following) as __next{i}")
    ])
    new = {c: f"coalesce(__last{i}, __next{i})" for i, c in enumerate(columns)}
    if buckets > 1:
        # One row per bucket, at most MAX_BUCKETS.
        filled = filled.join(F.broadcast(_carries(keyed, columns)), _BUCKET, "left")
        new = {
            c: f"coalesce(__last{i}, if({_GROUP} = __first, __back{i}, null), __next{i}, if({_GROUP} = __final, __ahead{i}, null))"
            for i, c in enumerate(columns)
        }
    return filled.selectExpr(*[f"{new.get(c, q(c))} as {q(c)}" for c in df.columns])


def _sort_key(keys: Sequence[str], columns: Sequence[str]) -> str:
    own = [f"{q(c)} as k{i}" for i, c in enumerate(keys)]
    return f"struct({', '.join(own)}, xxhash64({', '.join(q(c) for c in columns)}) as h, {_ROW} as r)"


def _dealt(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], rows_per_bucket: int) -> tuple[DataFrame, int]:
    """The rows with the number of their bucket, and how many there are; buckets follow the order of the sort key."""
    n = rows.count()
    buckets = -(-n // max(rows_per_bucket, -(-n // MAX_BUCKETS), 1))
    if buckets <= 1:
        return rows.withColumn(_BUCKET, F.lit(0)), 1
    ranged = rows.selectExpr("*", f"{_sort_key(keys, columns)} as {_KEY}").repartitionByRange(buckets, _KEY).drop(_KEY)
    return stage(ranged.withColumn(_BUCKET, F.spark_partition_id()), "fill-buckets"), buckets


def _carries(keyed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per bucket the last known value before it and the next one after it, within the same group.

    A value crosses borders only for the group that touches them, so the edge groups of
    each bucket are all there is to look at.
    """
    edge_groups = keyed.groupBy(_BUCKET).agg(
        F.expr(f"min_by({_GROUP}, {_KEY}) as __first"), F.expr(f"max_by({_GROUP}, {_KEY}) as __final"))
    at_edges = keyed.select(_BUCKET, _GROUP, _KEY, *[q(c) for c in columns]).join(F.broadcast(edge_groups), _BUCKET)
    edges = at_edges.where(f"{_GROUP} = __first or {_GROUP} = __final").groupBy(_BUCKET, "__first", "__final").agg(*[
        F.expr(e) for i, c in enumerate(columns) for e in (
            f"max_by({q(c)}, {_KEY}) filter (where {q(c)} is not null and {_GROUP} = __final) as __tail{i}",
            f"min_by({q(c)}, {_KEY}) filter (where {q(c)} is not null and {_GROUP} = __first) as __head{i}")
    ])
    before = f"over (order by {_BUCKET} rows between unbounded preceding and 1 preceding)"
    after = f"over (order by {_BUCKET} desc rows between unbounded preceding and 1 preceding)"
    nearest = edges.selectExpr(_BUCKET, "__first", "__final", *[
        e for i in range(len(columns)) for e in (
            f"last_value(if(__tail{i} is null, null, struct(__final as g, __tail{i} as v))) ignore nulls {before} as b{i}",
            f"last_value(if(__head{i} is null, null, struct(__first as g, __head{i} as v))) ignore nulls {after} as a{i}")
    ])
    return nearest.selectExpr(_BUCKET, "__first", "__final", *[
        e for i in range(len(columns)) for e in (
            f"if(b{i}.g = __first, b{i}.v, null) as __back{i}", f"if(a{i}.g = __final, a{i}.v, null) as __ahead{i}")
    ])
