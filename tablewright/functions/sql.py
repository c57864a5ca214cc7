"""Small helpers to write Spark SQL expressions.

Expressions in this package are SQL text: a long expression is then one call into the
JVM instead of one per operator, and it reads like the query it becomes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def q(name: str) -> str:
    """Back-quoted name, safe for headers that hold dots or back-quotes."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | int | None) -> str:
    """Numeric literal; fractions are doubles, not decimals."""
    if value is None:
        return "cast(null as double)"
    if isinstance(value, float) and not math.isfinite(value):
        return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"
    return str(value) if isinstance(value, int) else f"{value!r}D"


def literal(value, dtype: str) -> str:
    """A Python scalar as a literal of a Spark type."""
    if value is None:
        return f"cast(null as {dtype})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"cast({number(value)} as {dtype})"
    return f"cast({text(str(value))} as {dtype})"


def any_of(values: Iterable[str]) -> str:
    """Right side of an IN list."""
    return "(" + ", ".join(text(v) for v in values) + ")"


def sql_map(pairs: Iterable[tuple[str, str]]) -> str:
    entries = ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs)
    return f"map({entries})" if entries else "cast(map() as map<string,string>)"


def rows_of(structs: Iterable[str]) -> str:
    """One output row per struct: `inline` over an array of structs."""
    return "inline(array(" + ", ".join(structs) + "))"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_time(f.dataType)]


def replace_columns(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """Same columns in the same order, some with a new expression."""
    return df.selectExpr(*[f"{new.get(c, q(c))} as {q(c)}" for c in df.columns])
