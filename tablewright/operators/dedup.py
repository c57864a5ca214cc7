"""Exact duplicate rows: counting and removal.

Grouping whole rows shuffles the whole table. Both operators therefore first count
64-bit row hashes (eight bytes a row cross the network): a row whose hash is unique
cannot be a duplicate. Only rows that share a hash are compared column by column, so
the answer stays exact. When too many hashes repeat for a safe broadcast, the plain
whole-row grouping is used. NaN and infinite numbers are missing ones, equal to NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.functions.numbers import pct2
from tablewright.functions.sql import q
from tablewright.operators.entry import finite, marked
from tablewright.sources.staging import stage

_HASH, _SUSPECT = "__row_hash", "__may_repeat"
# A broadcast of this many 8-byte hashes stays well under 100 MB on every executor.
MAX_BROADCAST_HASHES = 1_000_000


@dataclass(frozen=True)
class RepeatedHashes:
    """Row hashes seen more than once, and how many rows and hashes there are.

    `held` are the rows themselves with their hash as last column, where they are staged.
    """

    rows: int
    repeated: int
    hashes: DataFrame
    held: DataFrame | None = None

    @property
    def broadcastable(self) -> bool:
        return self.repeated <= MAX_BROADCAST_HASHES


def row_hash(df: DataFrame) -> str:
    return f"xxhash64({', '.join(q(c) for c in df.columns)})"


def _hashed(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"{row_hash(df)} as {_HASH}")


def repeated_hashes(df: DataFrame) -> RepeatedHashes:
    """One read of the table; the few hashes that repeat are staged, so that nothing reads it again for them."""
    return _repeated(df.selectExpr(f"{row_hash(df)} as {_HASH}"))


def held_rows(df: DataFrame) -> tuple[DataFrame, RepeatedHashes]:
    """The rows of `df`, staged, and their repeated hashes; what looks at them does not read the source again."""
    held = stage(_hashed(finite(df)), "hashed")
    return marked(held.drop(_HASH)), replace(_repeated(held.select(_HASH)), held=held)


def _repeated(hashes: DataFrame) -> RepeatedHashes:
    per_hash = hashes.groupBy(_HASH).agg(F.expr("count(1) as n"))
    seen = Observation()
    counted = per_hash.observe(seen, F.expr("coalesce(sum(n), 0L) as total"), F.expr("count_if(n > 1) as repeated"))
    hashes = stage(counted.filter("n > 1").select(_HASH), "repeated-hashes")
    return RepeatedHashes(seen.get["total"], seen.get["repeated"], hashes)


def _suspects(df: DataFrame, found: RepeatedHashes) -> DataFrame:
    """Rows that may have a copy."""
    if not found.broadcastable:
        return df
    return (_hashed(df) if found.held is None else found.held.toDF(*df.columns, _HASH)).join(F.broadcast(found.hashes), _HASH, "left_semi").drop(_HASH)


def _copies(df: DataFrame, found: RepeatedHashes) -> DataFrame:
    groups = _suspects(df, found).groupBy(*[q(c) for c in df.columns]).agg(F.expr("count(1) as __n"))
    return groups.selectExpr("cast(coalesce(sum(__n - 1), 0) as bigint) as duplicate_count")


def duplicate_count(df: DataFrame, found: RepeatedHashes | None = None) -> int:
    """Rows minus distinct rows, NULL equal to NULL."""
    if not df.columns:
        return 0
    df = finite(df)
    found = repeated_hashes(df) if found is None else found
    return _copies(df, found).first()[0] if found.repeated else 0


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: total_rows, duplicate_count, duplicate_pct."""
    df = finite(df)
    found = repeated_hashes(df)
    return _copies(df, found).selectExpr(
        f"cast({found.rows} as bigint) as total_rows", "duplicate_count",
        f"{pct2('duplicate_count', str(found.rows))} as duplicate_pct",
    )


def remove_duplicates(df: DataFrame, found: RepeatedHashes | None = None) -> DataFrame:
    """One row of every group of equal rows; the columns of `df` may have other names than those `found` holds."""
    if not df.columns:
        return df
    df = finite(df)
    found = repeated_hashes(df) if found is None else found
    if not found.repeated:
        return df
    if not found.broadcastable:
        return marked(stage(df.dropDuplicates(), "distinct"))
    if found.held is not None:
        return _once_each(found.held.toDF(*df.columns, _HASH), found)
    # Staged with the mark, the table is read once more and not once for each half.
    known = found.hashes.withColumn(_SUSPECT, F.lit(True))
    told = stage(_hashed(df).join(F.broadcast(known), _HASH, "left").drop(_HASH), "hashed")
    unique = told.where(f"{_SUSPECT} is null").drop(_SUSPECT)
    return marked(unique.unionByName(told.where(_SUSPECT).drop(_SUSPECT).dropDuplicates()))


def staged_without_duplicates(df: DataFrame) -> tuple[DataFrame, int]:
    """One row of every group of equal rows, and how many rows there were; the source is read once.

    Rows are staged with their hash, hashes counted there. Where rows are grouped in whole, the result is staged,
    too: what reads it does not group them again.
    """
    df = finite(df)
    held = stage(_hashed(df), "hashed")
    found = _repeated(held.select(_HASH))
    if not found.repeated:
        return marked(held.drop(_HASH)), found.rows
    if not found.broadcastable:
        return marked(stage(held.drop(_HASH).dropDuplicates(), "distinct")), found.rows
    return _once_each(held, found), found.rows


def _once_each(held: DataFrame, found: RepeatedHashes) -> DataFrame:
    """One row of every group of equal rows of a staged table with its hashes, few of which repeat."""
    known = F.broadcast(found.hashes)
    unique = held.join(known, _HASH, "left_anti").drop(_HASH)
    copies = stage(held.join(known, _HASH, "left_semi").drop(_HASH).dropDuplicates(), "copies")
    return marked(unique.unionByName(copies))


def keep_first(df: DataFrame, subset: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row in `order_by` of every group equal on `subset`.

    The row number is compared with one, so Spark cuts every task's rows to one per
    group before the shuffle: a group that holds a third of the table sends one row
    per task.
    """
    if not order_by:
        raise ValueError("keep_first needs order_by: rows have no inherent order")
    groups, order = ", ".join(q(c) for c in subset), ", ".join(q(c) for c in order_by)
    ranked = df.selectExpr("*", f"row_number() over (partition by {groups} order by {order}) as __rank")
    return ranked.filter("__rank = 1").drop("__rank")


def removal_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows removed and rows remaining."""
    n_before = before.selectExpr("count(1)").scalar()
    return after.selectExpr("count(1) as remaining").select((n_before - F.col("remaining")).alias("removed"), "remaining")
