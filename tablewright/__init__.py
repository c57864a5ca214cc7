"""Profile, clean, enrich and summarise messy business tables on Spark."""

from tablewright.operators.analytics import breakdowns, kpi_table, statistical_summary
from tablewright.operators.features import derive_features
from tablewright.operators.insights import all_insights
from tablewright.operators.profile import column_profile, dataset_profile, issues
from tablewright.plans.cleaning import CleaningPlan, CleanOptions, clean_data
from tablewright.plans.pipeline import PipelineResult, run_pipeline
from tablewright.sources.csv import load_table

__all__ = [
    "CleanOptions", "CleaningPlan", "all_insights", "breakdowns", "clean_data", "column_profile",
    "PipelineResult", "dataset_profile", "derive_features", "issues", "kpi_table", "load_table", "run_pipeline", "statistical_summary",
]
