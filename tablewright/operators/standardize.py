"""Header names, category text and negative amounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.names import expects_positive, snake_names
from tablewright.functions.sql import numeric_columns, q, replace_columns, rows_of, text, text_columns
from tablewright.functions.text import (
    DOMAINS, domain_for, keeps_case, map_values, null_tokens_to_null, title_case, trim_text,
)

# Longer dictionaries are looked up by a join instead of a map literal in the plan.
MAX_MAP_LITERAL = 200
_AFTER = "__standard"

Domains = Mapping[str, Mapping[str, str]]


def clean_names(df: DataFrame, symbol_words: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Snake-case headers by position, and the (old, new) pairs."""
    names = snake_names(df.columns, symbol_words)
    return df.toDF(*names), list(zip(df.columns, names))


def trimmed(df: DataFrame) -> DataFrame:
    """All text without leading and trailing white space."""
    return replace_columns(df, {c: trim_text(q(c)) for c in text_columns(df)})


def cleaned_text(df: DataFrame) -> DataFrame:
    """All text trimmed, and text that means "missing" as NULL."""
    return replace_columns(trimmed(df), {c: null_tokens_to_null(q(c)) for c in text_columns(df)})


def _standard(name: str, domains: Domains) -> str:
    rule = domain_for(name, domains)
    if rule is not None and domains[rule]:
        return map_values(q(name), domains[rule])
    return q(name) if keeps_case(name) else title_case(q(name))


def with_standard_values(df: DataFrame, custom_mappings: Domains | None = None) -> DataFrame:
    """Cleaned text, plus the standard value of every text column beside it."""
    domains = {**DOMAINS, **(custom_mappings or {})}
    texts = text_columns(df)
    large = [c for c in texts if (r := domain_for(c, domains)) is not None and len(domains[r]) > MAX_MAP_LITERAL]
    out = cleaned_text(df)
    for i, name in enumerate(texts):
        if name in large:
            out = _looked_up(out, name, domains[domain_for(name, domains)], f"{_AFTER}{i}")
    return out.selectExpr("*", *[
        f"{_standard(c, domains)} as {_AFTER}{i}" for i, c in enumerate(texts) if c not in large])


def _looked_up(df: DataFrame, name: str, mapping: Mapping[str, str], target: str) -> DataFrame:
    """Dictionary as a joined table. Its rows come from the caller's dict, so it fits a broadcast."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), "__from string, __to string")
    joined = df.join(F.broadcast(table), F.expr(f"lower({q(name)}) = __from"), "left")
    return joined.selectExpr("*", f"coalesce(__to, {title_case(q(name))}) as {target}").drop("__from", "__to")


def take_standard_values(df: DataFrame) -> DataFrame:
    """Second half of `with_standard_values`: the standard values replace the text."""
    texts = text_columns(df.drop(*[c for c in df.columns if c.startswith(_AFTER)]))
    return df.selectExpr(*[
        f"{_AFTER}{texts.index(c)} as {q(c)}" if c in texts else q(c)
        for c in df.columns if not c.startswith(_AFTER)
    ])


def standardize_categories(df: DataFrame, custom_mappings: Domains | None = None) -> DataFrame:
    """Trim, null tokens, then domain dictionary or title case, for every text column."""
    return take_standard_values(with_standard_values(df, custom_mappings)) if text_columns(df) else df


def change_aggregates(df: DataFrame, null_is_change: bool = True) -> dict[str, str]:
    """Per text column the count of changed values, over a table from `with_standard_values`.

    By default a NULL counts as changed (missing never equals missing), as the reports do.
    """
    texts = text_columns(df.drop(*[c for c in df.columns if c.startswith(_AFTER)]))
    nulls = " or {0} is null" if null_is_change else ""
    return {
        c: f"count_if(not ({q(c)} <=> {_AFTER}{i}){nulls.format(q(c))})" for i, c in enumerate(texts)
    }


def category_changes(df: DataFrame, custom_mappings: Domains | None = None, null_is_change: bool = True) -> DataFrame:
    """Column and number of values changed, for columns with changes."""
    both = with_standard_values(df, custom_mappings)
    return long_counts(both, change_aggregates(both, null_is_change), "changes")


def negative_aggregates(df: DataFrame) -> dict[str, str]:
    return {c: f"count_if({q(c)} < 0)" for c in numeric_columns(df) if expects_positive(c)}


def negative_counts(df: DataFrame) -> DataFrame:
    return long_counts(df, negative_aggregates(df), "negatives_fixed")


def absolute_values(df: DataFrame) -> DataFrame:
    """Negative amounts in positive-only fields become their absolute value."""
    return replace_columns(df, {c: f"abs({q(c)})" for c in negative_aggregates(df)})


def long_counts(df: DataFrame, aggregates: Mapping[str, str], label: str) -> DataFrame:
    """One aggregate row turned into (column, count) rows, zero counts dropped."""
    if not aggregates:
        return df.sparkSession.createDataFrame([], f"column string, {label} bigint")
    row = df.selectExpr(*[f"{a} as n{i}" for i, a in enumerate(aggregates.values())])
    return row.selectExpr(rows_of(
        f"struct({text(c)} as column, n{i} as {label})" for i, c in enumerate(aggregates)
    )).filter(f"{label} > 0")
