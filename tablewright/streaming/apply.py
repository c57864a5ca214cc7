"""A fitted plan on a stream: the row-wise steps are plain expressions there as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.sql import q
from tablewright.operators.entry import finite
from tablewright.operators.features import derive_features
from tablewright.operators.impute import apply_missing
from tablewright.operators.outliers import handle_outliers
from tablewright.plans.cleaning import CleaningPlan

_DIGEST = "__row_digest"


def clean_stream(
    stream: DataFrame, plan: CleaningPlan, features: bool = True, event_time: str | None = None, delay: str | None = None,
) -> DataFrame:
    """Duplicates, names, types, signs, categories, constant fills, drops and outlier bounds.

    A plan that removes duplicates needs `event_time`, a timestamp column of the stream, and `delay`:
    an equal row goes if it comes within that time of the first one; the state holds a digest
    of every row that recent, in whichever batch it came. Without them such a plan is refused, and so is
    one with an ordered fill, which would look across rows without bound.
    """
    if any(f.action == "forward_fill" for f in plan.fills):
        raise ValueError("an ordered fill cannot run on an unbounded stream")
    if plan.options.remove_dups:
        if event_time is None or delay is None:
            raise ValueError("removing duplicates from a stream needs event_time and delay, or a plan with remove_dups=False")
        stream = _without_copies(finite(stream), event_time, delay)
    out = handle_outliers(apply_missing(plan.standardized(stream), plan.fills), plan.bounds, plan.options.outlier_action)
    return derive_features(out)[0] if features else out


def _without_copies(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    names = stream.columns
    row = f"to_json(struct({', '.join(f'{q(c)} as c{i}' for i, c in enumerate(names))}), map('ignoreNullFields', 'false'))"
    told = stream.withColumn(_DIGEST, F.unhex(F.sha2(F.expr(row), 256)))
    return told.withWatermark(q(event_time), delay).dropDuplicatesWithinWatermark([_DIGEST]).drop(_DIGEST)
