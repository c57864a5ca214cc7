"""Cleaned tables several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.dirty import table
from tablewright.operators.features import derive_features
from tablewright.plans.cleaning import CleaningResult, CleanOptions, clean_data

_CLEANED: dict[tuple, CleaningResult] = {}


def cleaned(spark: SparkSession, folder: str, name: str) -> CleaningResult:
    """Cleaning result of a dirty table; its staged table serves later queries of the session too."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _CLEANED:
        _CLEANED[key] = clean_data(table(spark, folder, name), CleanOptions())
    return _CLEANED[key]


def forget() -> None:
    _CLEANED.clear()


def enriched(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return derive_features(cleaned(spark, folder, name).table)[0]
