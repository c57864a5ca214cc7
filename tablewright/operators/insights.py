"""Narrative findings as rows: section, position, sentence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import money, one_decimal
from tablewright.functions.sql import q, text

QUALITY, BUSINESS, ANOMALY, RECOMMEND = "quality_insights", "business_insights", "anomaly_insights", "recommendations"


@dataclass(frozen=True)
class CleaningFacts:
    """What a cleaning run did, as far as the narrative needs it."""

    duplicates_removed: int = 0
    columns_imputed: int = 0
    types_converted: int = 0
    columns_renamed: int = 0


def _rows(one: DataFrame, section: str, sentences: Sequence[tuple[str, str]], default: str | None = None) -> DataFrame:
    """Sentences whose test holds, numbered in order; each is a comma list to concatenate."""
    found = ", ".join(f"if({test}, concat({parts}), null)" for test, parts in sentences)
    listed = one.selectExpr(f"array_compact(array({found})) as found")
    if default is not None:
        listed = listed.selectExpr(f"if(size(found) = 0, array({text(default)}), found) as found")
    return listed.selectExpr("posexplode(found) as (at, text)").selectExpr(f"'{section}' as section", "at + 1 as seq", "text")


def quality_insights(raw: DataFrame, clean: DataFrame, facts: CleaningFacts) -> DataFrame:
    """`raw` and `clean` are one-row dataset profiles."""
    after = clean.selectExpr("struct(quality_score, quality_grade, total_missing)").scalar()
    # The quality sentences.
    return _rows(raw.withColumn("after", after), QUALITY, [
        ("true", "'Overall Data Health Score improved from ', quality_score, '/100 [', quality_grade, '] to ', "
                 "after.quality_score, '/100 [', after.quality_grade, '].'"),
        ("total_missing > 0", "'Resolved ', format_number(total_missing - after.total_missing, 0), ' missing values across "
                              f"{facts.columns_imputed} columns using statistical imputation strategies.'"),
        ("total_missing = 0", "'Dataset contained zero missing values initially.'"),
        (f"{facts.duplicates_removed} > 0", f"'Eliminated {facts.duplicates_removed:,} exact duplicate rows, "
                                            "preventing skewed metrics and double-counting.'"),
        (f"{facts.types_converted} > 0", f"'Successfully standardized data types for {facts.types_converted} columns "
                                         "(including currency symbol stripping, date parsing, and boolean normalization).'"),
        (f"{facts.columns_renamed} > 0", f"'Standardized {facts.columns_renamed} column headers into consistent snake_case "
                                         "format for SQL/pipeline compatibility.'"),
    ])


def _edge(breakdown: DataFrame | None, weakest: bool = False) -> Column:
    """Leading (or weakest) group of a breakdown as a struct: name, value, share."""
    if breakdown is None or "share_pct" not in breakdown.columns:
        return F.expr("cast(null as struct<name:string,value:double,share:double>)")
    name = q(breakdown.columns[0])
    order = (F.asc("total_value"), F.desc(name)) if weakest else (F.desc("total_value"), F.asc(name))
    return breakdown.orderBy(*order).limit(1).selectExpr(
        f"struct(cast({name} as string) as name, total_value as value, share_pct as share)").scalar()


def business_insights(kpis: DataFrame, by_category: DataFrame | None = None, by_region: DataFrame | None = None) -> DataFrame:
    wanted = {"revenue": "total_revenue", "records": "total_records", "aov": "average_order_value", "growth": "period_growth"}
    one = kpis.selectExpr(*[f"max(value) filter (where key = '{key}') as {name}" for name, key in wanted.items()])
    one = one.withColumns({"top": _edge(by_category), "lead": _edge(by_region)})
    # The business sentences.
    return _rows(one, BUSINESS, [
        ("revenue is not null", "'Total cumulative revenue / sales volume stands at ', revenue, ' across ', "
                                "coalesce(records, 'all'), ' transactions.'"),
        ("aov is not null", "'Average Order Value (AOV) was calculated at ', aov, ' per transaction.'"),
        ("top.name is not null", f"'Top contributing category is \\'', top.name, '\\' accounting for ', "
                                 f"{one_decimal('top.share')}, '% of total volume (', {money('top.value')}, ').'"),
        ("top.share > 50", "'Noticeable concentration risk: \\'', top.name, "
                           "'\\' commands over half of the entire dataset revenue.'"),
        ("lead.name is not null", "'Regional distribution is led by \\'', lead.name, '\\' generating ', "
                                  f"{one_decimal('lead.share')}, '% of activity.'"),
        ("growth is not null", "'Latest period performance demonstrated a growth rate of ', growth, '.'"),
    ], default="Metrics computed across active attributes.")


def anomaly_insights(outliers: DataFrame) -> DataFrame:
    """`outliers` is the outlier table: one row per affected column."""
    # The anomaly sentences.
    sentence = ("concat('Identified ', outlier_count, ' statistical outlier values in \\'', column, '\\' (', outlier_pct, "
                "'% of rows) exceeding upper threshold of ', format_number(upper_bound, 2), '.')")
    none = text("No severe numerical outliers detected under IQR thresholding (1.5x IQR).")
    return outliers.selectExpr(f"sort_array(collect_list(struct(seq, {sentence} as t))).t as found").selectExpr(
        f"posexplode(if(size(found) = 0, array({none}), found)) as (at, text)").selectExpr(
        f"'{ANOMALY}' as section", "at + 1 as seq", "text")


def recommendations(raw: DataFrame, facts: CleaningFacts, by_category: DataFrame | None = None) -> DataFrame:
    several = F.lit(False)
    if by_category is not None and "share_pct" in by_category.columns:
        several = by_category.selectExpr("count(1) > 1").scalar()
    one = raw.select("total_missing", _edge(by_category, weakest=True).alias("weakest"), several.alias("several"))
    # The recommendations.
    return _rows(one, RECOMMEND, [
        ("total_missing > 0", "'Implement frontend form validation at data entry to mandate required fields and eliminate "
                              "downstream missing values.'"),
        (f"{facts.duplicates_removed} > 0", "'Enforce database UNIQUE constraints on transactional ID fields to prevent "
                                            "duplicate records at ingestion.'"),
        (f"{facts.types_converted} > 0", "'Enforce strict schema typing at the ingestion pipeline to avoid storing raw "
                                         "currency symbols and unformatted strings in numeric fields.'"),
        ("several", "'Evaluate marketing and promotional strategies for lower-performing category \\'', weakest.name, "
                    f"'\\' (', {one_decimal('weakest.share')}, '% share) to balance portfolio revenue.'"),
        ("true", "'Schedule automated daily/weekly runs of this cleaning pipeline to monitor data health drift over time.'"),
    ])


def all_insights(
    raw: DataFrame, clean: DataFrame, facts: CleaningFacts, kpis: DataFrame, outliers: DataFrame,
    by_category: DataFrame | None = None, by_region: DataFrame | None = None,
) -> DataFrame:
    return (
        quality_insights(raw, clean, facts)
        .unionByName(business_insights(kpis, by_category, by_region))
        .unionByName(anomaly_insights(outliers))
        .unionByName(recommendations(raw, facts, by_category))
    )

