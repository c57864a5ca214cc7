"""The one normal form of missing numbers: NaN and infinite values are NULL before an operator looks at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.functions.sql import q, replace_columns

_MARK = "_tablewright_finite"


def finite_value(x: str) -> str:
    """The value, or NULL where it is NaN (which Spark orders above infinity) or infinite."""
    return f"if(abs({x}) < double('Infinity'), {x}, null)"


def finite(df: DataFrame) -> DataFrame:
    """The same table with NULL for NaN and infinite numbers; every public operator looks at this.

    A table that has been through here is marked, on the DataFrame itself: what is derived
    from it, a union for instance, may hold such values again and is not marked.
    """
    if getattr(df, _MARK, False):
        return df
    odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return marked(replace_columns(df, {c: finite_value(q(c)) for c in odd}) if odd else df)


def marked(df: DataFrame) -> DataFrame:
    """Says that `df` holds no NaN and no infinite numbers."""
    setattr(df, _MARK, True)
    return df
