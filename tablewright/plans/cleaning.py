"""The cleaning run as a fitted plan.

`fit` looks at a table in a bounded number of passes and returns a plan: plain values
that say what happens to each column. `apply` turns a plan into one lazy projection,
so a plan fitted on one batch can clean the next one, batch or stream.

Passes of a run over the source: row hashes, type shares, and one write of the typed
and standardised table to the shared folder; where copies were found, the rows are written
with a mark first, so that the source is read twice for them. The counters of the audit are
observed during the write. What follows reads single columns of the staged table, and each
question is asked for all steps at once: one look at what is missing also serves the outlier
bounds, medians and quartiles are found by the same passes, although quartiles are those of
the filled table, and the last pass counts outliers.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.dedup import RepeatedHashes, remove_duplicates, staged_without_duplicates
from tablewright.operators.entry import finite, marked
from tablewright.operators.impute import Fill, MissingFacts, apply_missing, check_strategies, choose_fills, look_at_missing
from tablewright.operators.insights import CleaningFacts
from tablewright.operators.outliers import (
    DEFAULT_THRESHOLD, MIN_VALUES, Bounds, detect_outliers, handle_outliers, outlier_action_counts, outlier_table,
)
from tablewright.operators.quantiles import QUARTILES, Ends, order_statistics
from tablewright.operators.standardize import (
    absolute_values, change_aggregates, clean_names, negative_aggregates, standardize_categories, take_standard_values,
    with_standard_values,
)
from tablewright.operators.types import CONVERSION_LABELS, DateReading, convert, fit_types
from tablewright.sources.staging import compiled_methods, stage

AUDIT_SCHEMA = (
    "seq int, step string, column string, action string, affected bigint, fill_value string, "
    "lower double, upper double, description string"
)


@dataclass(frozen=True)
class CleanOptions:
    """Which steps run, and how. Defaults are those of a plain cleaning run."""

    standardize_names: bool = True
    remove_dups: bool = True
    convert_types: bool = True
    fix_negatives: bool = True
    standardize_cats: bool = True
    handle_missing: bool = True
    numeric_missing_strategy: str = "median"
    categorical_missing_strategy: str = "mode_or_unknown"
    date_missing_strategy: str = "keep_nat"
    custom_col_strategies: Mapping[str, str] = field(default_factory=dict)
    custom_mappings: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    outlier_method: str = "iqr"
    outlier_action: str = "keep"
    outlier_threshold: float = DEFAULT_THRESHOLD
    symbol_words: bool = False
    keep_text: Sequence[str] = field(default_factory=list)
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)  # cleaned name -> values, least first
    day_first: bool | None = False  # None: each column's own values decide
    zone: str = "UTC"
    order_by: Sequence[str] = field(default_factory=list)
    partition_by: Sequence[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        check_strategies(self.numeric_missing_strategy, self.categorical_missing_strategy, self.date_missing_strategy)
        for kind, name, known in (("outlier method", self.outlier_method, ("iqr", "zscore")),
                                  ("outlier action", self.outlier_action, ("keep", "cap", "remove"))):
            if name not in known:
                raise ValueError(f"unknown {kind} {name!r}; one of {', '.join(known)}")

    @property
    def dates(self) -> DateReading:
        return DateReading(self.day_first, zone=self.zone)


@dataclass
class CleaningPlan:
    options: CleanOptions
    renames: list[tuple[str, str]] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)
    fills: list[Fill] = field(default_factory=list)
    bounds: list[Bounds] = field(default_factory=list)

    # --- apply ---------------------------------------------------------------------

    def standardized(self, df: DataFrame) -> DataFrame:
        """Names, types, signs and categories: row-wise, so also fit for a stream."""
        typed = self.typed(finite(df))
        if self.options.fix_negatives:
            typed = absolute_values(typed)
        return standardize_categories(typed, self.options.custom_mappings) if self.options.standardize_cats else typed

    def typed(self, df: DataFrame) -> DataFrame:
        if self.options.standardize_names:
            df, _ = clean_names(df, self.options.symbol_words)
        return convert(df, self.kinds, self.options.dates) if self.options.convert_types else df

    def finished(self, standardized: DataFrame) -> DataFrame:
        """Missing values and outliers of a standardised table."""
        out = apply_missing(standardized, self.fills, self.options.order_by, self.options.partition_by)
        return handle_outliers(out, self.bounds, self.options.outlier_action)

    def apply(self, df: DataFrame) -> DataFrame:
        """Clean another table of the same layout with the fitted values."""
        df = finite(df)
        rows = remove_duplicates(df) if self.options.remove_dups else df
        return self.finished(self.standardized(rows))

    # --- as data -------------------------------------------------------------------

    def to_json(self) -> str:
        return json.dumps({
            "options": asdict(self.options), "renames": self.renames, "kinds": self.kinds,
            "fills": [f.to_dict() for f in self.fills], "bounds": [b.to_dict() for b in self.bounds],
        })

    @classmethod
    def from_json(cls, text: str) -> CleaningPlan:
        raw = json.loads(text)
        return cls(
            CleanOptions(**raw["options"]), [tuple(p) for p in raw["renames"]], raw["kinds"],
            [Fill(**f) for f in raw["fills"]], [Bounds(**b) for b in raw["bounds"]],
        )


@dataclass
class CleaningResult:
    """The cleaned table, the plan that made it, and what was counted on the way."""

    table: DataFrame
    plan: CleaningPlan
    status: str = "cleaned"
    initial_shape: tuple[int, int] = (0, 0)
    final_shape: tuple[int, int] = (0, 0)
    duplicates_removed: int = 0
    negatives_fixed: dict[str, int] = field(default_factory=dict)
    category_changes: dict[str, int] = field(default_factory=dict)
    outlier_actions: dict[str, int] = field(default_factory=dict)
    # Quartiles of the table's numeric columns, where the run has found them.
    quartiles: dict[str, Sequence[float | None]] = field(default_factory=dict)

    @property
    def facts(self) -> CleaningFacts:
        return CleaningFacts(
            self.duplicates_removed, len(self.plan.fills), len(self.plan.kinds), len(self.plan.renames))

    def outliers(self) -> DataFrame:
        return outlier_table(self.table, self.plan.bounds)

    def audit(self) -> DataFrame:
        return self.table.sparkSession.createDataFrame(_audit_rows(self), AUDIT_SCHEMA)


def clean_data(df: DataFrame, options: CleanOptions | None = None, found: RepeatedHashes | None = None) -> CleaningResult:
    """Fit and apply: names, duplicates, types, signs, categories, missing, outliers.

    `found` are the repeated row hashes of `df`, where they are known already.
    """
    with compiled_methods(df.sparkSession):
        return _clean(finite(df), options or CleanOptions(), found)


def _clean(df: DataFrame, opts: CleanOptions, found: RepeatedHashes | None) -> CleaningResult:
    plan = CleaningPlan(opts)
    distinct, n_before = df, None if found is None else found.rows
    if df.columns and opts.remove_dups and found is None:
        distinct, n_before = staged_without_duplicates(df)
    if not df.columns or (df.isEmpty() if n_before is None else not n_before):
        return CleaningResult(df, plan, status="empty_dataset", initial_shape=(0, len(df.columns)),
                              final_shape=(0, len(df.columns)))
    rows = distinct
    if opts.standardize_names:
        rows, plan.renames = clean_names(distinct, opts.symbol_words)
        marked(rows)
    if opts.remove_dups and found is not None:
        rows = remove_duplicates(rows, found)
    if opts.convert_types:
        plan.kinds = fit_types(rows, opts.keep_text, opts.dates)

    typed = convert(rows, plan.kinds, opts.dates) if opts.convert_types else rows
    staged, negatives, changes, n_kept = _stage_standardized(typed, opts)

    known, ends = {}, None
    if opts.handle_missing:
        facts = look_at_missing(
            staged, opts.numeric_missing_strategy, opts.categorical_missing_strategy,
            opts.date_missing_strategy, opts.custom_col_strategies, opts.categories)
        if opts.outlier_method == "iqr" and facts.row_by_row and all(
                isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegralType)) for f in facts.fields if f.name in facts.numeric):
            plan.fills, known, ends = _fills_and_quartiles(facts)
        else:
            plan.fills = choose_fills(facts)
    filled = apply_missing(staged, plan.fills, opts.order_by, opts.partition_by)
    if not any(f.action == "drop" for f in plan.fills):
        marked(filled)
    plan.bounds = detect_outliers(filled, opts.outlier_method, opts.outlier_threshold, known=known, ends=ends)
    table = handle_outliers(filled, plan.bounds, opts.outlier_action)

    n_before = n_before if opts.remove_dups else n_kept
    lost = any(f.action == "drop" for f in plan.fills) or (opts.outlier_action == "remove" and plan.bounds)
    return CleaningResult(
        table, plan, initial_shape=(n_before, len(df.columns)),
        final_shape=(table.count() if lost else n_kept, len(table.columns)),
        duplicates_removed=n_before - n_kept,
        negatives_fixed=negatives, category_changes=changes,
        outlier_actions=outlier_action_counts(filled, plan.bounds, opts.outlier_action),
        quartiles=known if opts.outlier_action == "keep" or not plan.bounds else {},
    )


def _fills_and_quartiles(facts: MissingFacts) -> tuple[list[Fill], dict[str, list[float | None]], Ends]:
    """Fills, and quartiles and ends of the table they leave, from the same passes over the known values.

    With `n` known values and `z` copies of a fill, the k-th value of the filled column is the fill,
    held between the known values of rank k - z and k.
    """
    columns = {c: (*facts.ends(c), facts.missing(c)) for c in facts.numeric}
    wanted: dict[str, set[int]] = {}
    for c, (n, _, _, z) in columns.items():
        places = [(n - 1) / 2] if c in facts.for_median() else []
        ranks = {r for x in places for r in (math.floor(x), math.ceil(x))}
        if n + z >= MIN_VALUES:
            ranks |= {k - off for p in QUARTILES for k in _around(p * (n + z - 1)) for off in (0, z)}
        wanted[c] = {r for r in ranks if 0 <= r < n}
    values = order_statistics(facts.table, {c: sorted(r) for c, r in wanted.items() if r}, {c: v[:3] for c, v in columns.items()})
    medians = {c: _between(lambda r: values[c, r], (columns[c][0] - 1) / 2) if columns[c][0] else None for c in facts.for_median()}
    fills = choose_fills(facts, medians)
    filled = {f.column: _as_stored(f.value, facts.table.schema[f.column].dataType) for f in fills if f.column in columns}
    known, ends = {}, {}
    for c, (n, low, high, z) in columns.items():
        fill = filled.get(c)

        def at(k: int) -> float:
            least = values[c, k - z] if k >= z else -math.inf
            return min(max(fill, least), values[c, k]) if k < n else max(fill, least)

        if fill is None:
            at = lambda k: values[c, k]
        ends[c] = (n + z, low, high) if fill is None else (n + z, *sorted(x for x in (fill, low, high) if x is not None)[::max(1, 2 if n else 1)])
        if n == 0:
            ends[c] = (n + z, fill, fill) if fill is not None else (0, None, None)
        if n + z >= MIN_VALUES:
            known[c] = [_between(at, p * (n + z - 1)) if n + z and (n or fill is not None) else None for p in QUARTILES]
    return fills, known, ends


def _around(position: float) -> tuple[int, int]:
    return math.floor(position), math.ceil(position)


def _between(at, position: float) -> float:
    low, high = _around(position)
    return at(low) if low == high else (high - position) * at(low) + (position - low) * at(high)


def _as_stored(value: float | None, dtype: T.DataType) -> float | None:
    """A fill as the column holds it."""
    if value is None:
        return None
    return struct.unpack("f", struct.pack("f", value))[0] if isinstance(dtype, T.FloatType) else float(value)


def _stage_standardized(typed: DataFrame, opts: CleanOptions) -> tuple[DataFrame, dict[str, int], dict[str, int], int]:
    """Fix signs and categories and write the result; what changed is counted during the write."""
    negatives = negative_aggregates(typed) if opts.fix_negatives else {}
    both = with_standard_values(typed, opts.custom_mappings) if opts.standardize_cats else typed
    changes = change_aggregates(both) if opts.standardize_cats else {}
    counters = [*negatives.values(), *changes.values()]
    seen = Observation()
    out = both.observe(seen, F.expr("count(1) as rows"), *[F.expr(f"{c} as n{i}") for i, c in enumerate(counters)])
    if opts.standardize_cats:
        out = take_standard_values(out)
    if opts.fix_negatives:
        out = absolute_values(out)
    staged = marked(stage(out, "standardized"))
    counted = seen.get
    found = [counted[f"n{i}"] for i in range(len(counters))]
    return (
        staged,
        {c: n for c, n in zip(negatives, found) if n},
        {c: n for c, n in zip(changes, found[len(negatives):]) if n},
        counted["rows"],
    )


def refit(plan: CleaningPlan, **changes) -> CleaningPlan:
    """The same fitted values under changed options (for instance another outlier action)."""
    return replace(plan, options=replace(plan.options, **changes))


def _audit_rows(result: CleaningResult) -> list[tuple]:
    """Step sentences, each followed by its per-column details."""
    plan, rows = result.plan, []

    def add(step, column=None, action=None, affected=None, fill=None, lower=None, upper=None, text=None):
        rows.append((len(rows) + 1, step, column, action, affected, fill, lower, upper, text))

    # The step sentences.
    if result.status == "empty_dataset":
        add("status", action="empty_dataset", text="empty_dataset")
        return rows
    add("initial_shape", affected=result.initial_shape[0], text=f"{result.initial_shape[0]} x {result.initial_shape[1]}")
    if plan.options.standardize_names:
        add("names", affected=len(plan.renames),
            text=f"Standardized {len(plan.renames)} column headers to snake_case.")
        for old, new in plan.renames:
            add("names", new, "renamed", text=old)
    if plan.options.remove_dups and result.duplicates_removed:
        add("duplicates", affected=result.duplicates_removed, text=(
            f"Removed {result.duplicates_removed} duplicate rows "
            f"({result.initial_shape[0] - result.duplicates_removed} rows remaining)."))
    if plan.kinds:
        add("types", affected=len(plan.kinds), text=f"Parsed and converted data types for {len(plan.kinds)} columns.")
        for c, kind in plan.kinds.items():
            add("types", c, kind, text=CONVERSION_LABELS[kind])
    if result.negatives_fixed:
        n = sum(result.negatives_fixed.values())
        add("negatives", affected=n,
            text=f"Corrected {n} negative values across {len(result.negatives_fixed)} numeric fields.")
        for c, k in result.negatives_fixed.items():
            add("negatives", c, "absolute", k)
    if result.category_changes:
        n = sum(result.category_changes.values())
        add("categories", affected=n, text=(
            f"Standardized casing and text domains across {len(result.category_changes)} categorical columns "
            f"({n} values adjusted)."))
        for c, k in result.category_changes.items():
            add("categories", c, "standardized", k)
    if plan.fills:
        add("missing", affected=len(plan.fills), text=(
            f"Handled missing values across {len(plan.fills)} columns using intelligent imputation strategies."))
        for f in plan.fills:
            add("missing", f.column, f.strategy, f.count, None if f.value is None else str(f.value))
    for b in plan.bounds:
        add("outliers", b.column, b.method, b.outlier_count, lower=b.lower, upper=b.upper)
    if result.outlier_actions:
        action = plan.options.outlier_action
        add("outlier_action", affected=len(result.outlier_actions),
            text=f"Applied outlier action '{action}' across {len(result.outlier_actions)} columns.")
        for c, k in result.outlier_actions.items():
            add("outlier_action", c, action, k)
    add("final_shape", affected=result.final_shape[0], text=f"{result.final_shape[0]} x {result.final_shape[1]}")
    return rows
