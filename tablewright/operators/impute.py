"""Missing values: a fit pass chooses one action per column, apply carries them out in column order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.sql import literal, q, replace_columns, text
from tablewright.operators.entry import finite
from tablewright.operators.fill import fill_ordered
from tablewright.operators.profile import dtype_family, value_counts
from tablewright.operators.quantiles import exact_quantiles

UNKNOWN = "Unknown"
NUMERIC_STRATEGIES = ("median", "mean", "zero", "forward_fill", "drop_row")
CATEGORICAL_STRATEGIES = ("mode_or_unknown", "mode", "constant_unknown", "drop_row")
DATE_STRATEGIES = ("keep_nat", "forward_fill", "drop_row")
# Below this many distinct values the mode stands in for missing text.
MODE_DISTINCT_LIMIT = 20
# With so few values the distinct sketch counts near exactly: twice the limit proves it is passed.
_MODE_SKETCH_LIMIT, _SKETCH_ERROR = 2 * MODE_DISTINCT_LIMIT, 0.05
# Column metadata that lists the values of an ordered category, least first.
CATEGORIES = "categories"


@dataclass(frozen=True)
class Fill:
    """What happens to the missing values of one column."""

    column: str
    action: str  # fill | forward_fill | drop | keep
    strategy: str
    count: int
    value: str | float | bool | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def check_strategies(numeric: str, categorical: str, date: str) -> None:
    for kind, name, known in (("numeric", numeric, NUMERIC_STRATEGIES), ("categorical", categorical, CATEGORICAL_STRATEGIES),
                              ("date", date, DATE_STRATEGIES)):
        if name not in known:
            raise ValueError(f"unknown {kind} strategy {name!r}; one of {', '.join(known)}")


def _strategy(family: str, name: str, numeric: str, categorical: str, date: str, custom: Mapping[str, str]) -> str:
    own = {"numeric": (numeric, NUMERIC_STRATEGIES), "datetime": (date, DATE_STRATEGIES)}.get(family, (categorical, CATEGORICAL_STRATEGIES))
    chosen = custom.get(name, own[0])
    if chosen not in own[1]:
        raise ValueError(f"unknown {family} strategy {chosen!r} for column {name!r}")
    return chosen


@dataclass(frozen=True)
class MissingFacts:
    """One pass over a table: per column what is missing, means, least and greatest values, sketches."""

    table: DataFrame
    fields: list[T.StructField]
    chosen: dict[str, str]
    categories: dict[str, Sequence[str]]
    kept: dict[str, str]  # a column's value, NULL in rows that an earlier column's rule drops
    seen: Row

    def family(self, name: str) -> str:
        return dtype_family(self.table.schema[name].dataType)

    def at(self, name: str) -> int:
        return next(i for i, f in enumerate(self.fields) if f.name == name)

    def ends(self, name: str) -> tuple[int, float | None, float | None]:
        i = self.at(name)
        return self.seen[f"n{i}"], self.seen[f"lo{i}"], self.seen[f"hi{i}"]

    def missing(self, name: str) -> int:
        return self.seen[f"z{self.at(name)}"]

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.fields if self.family(f.name) == "numeric"]

    @property
    def row_by_row(self) -> bool:
        """Every missing value is filled with a constant or stays."""
        return not any(self.missing(c) and s in ("drop_row", "forward_fill") for c, s in self.chosen.items())

    def for_median(self) -> list[str]:
        return [c for c in self.numeric if self.missing(c) and self.chosen[c] == "median"]


def look_at_missing(
    df: DataFrame, numeric: str = "median", categorical: str = "mode_or_unknown", date: str = "keep_nat",
    custom: Mapping[str, str] | None = None, categories: Mapping[str, Sequence[str]] | None = None,
) -> MissingFacts:
    """Rows dropped for an earlier column do not count for later ones; that is a condition inside the aggregates, not another pass."""
    check_strategies(numeric, categorical, date)
    df = finite(df)
    fields = list(df.schema.fields)
    family = {f.name: dtype_family(f.dataType) for f in fields}
    chosen = {f.name: _strategy(family[f.name], f.name, numeric, categorical, date, custom or {}) for f in fields}
    ranks = {f.name: f.metadata[CATEGORIES] for f in fields if CATEGORIES in (f.metadata or {})} | dict(categories or {})
    dropped: list[str] = []
    alive: dict[str, str] = {}
    for f in fields:
        alive[f.name] = " and ".join(f"{q(c)} is not null" for c in dropped) or "true"
        if chosen[f.name] == "drop_row":
            dropped.append(f.name)
    kept = {c: q(c) if test == "true" else f"case when {test} then {q(c)} end" for c, test in alive.items()}
    aggregates = []
    for i, f in enumerate(fields):
        x = kept[f.name]
        aggregates.append(f"count_if({alive[f.name]} and {q(f.name)} is null) as z{i}")
        if family[f.name] == "numeric":
            number = f"cast({x} as double)"
            aggregates += [f"avg({number}) as m{i}", f"count({number}) as n{i}", f"min({number}) as lo{i}", f"max({number}) as hi{i}"]
        elif family[f.name] == "boolean":
            aggregates += [f"count_if({x}) as t{i}", f"count_if(not {x}) as f{i}"]
        elif family[f.name] == "text":
            aggregates.append(f"approx_count_distinct({x}, {_SKETCH_ERROR}) as d{i}")
    return MissingFacts(df, fields, chosen, ranks, kept, df.selectExpr(*aggregates).first())


def fit_missing(
    df: DataFrame, numeric: str = "median", categorical: str = "mode_or_unknown", date: str = "keep_nat",
    custom: Mapping[str, str] | None = None, categories: Mapping[str, Sequence[str]] | None = None,
) -> list[Fill]:
    """Null counts with means and sketches, medians, text modes; all columns share each pass.

    `categories` lists the values of ordered categories, least first; a column's metadata may do so, too.
    Such a column takes its mode, and of equally frequent values the least one.
    """
    return choose_fills(look_at_missing(df, numeric, categorical, date, custom, categories))


def choose_fills(facts: MissingFacts, medians: Mapping[str, float | None] | None = None) -> list[Fill]:
    """One action per column with missing values; `medians` where they have been found already."""
    df, seen, chosen = facts.table, facts.seen, facts.chosen
    missing = [(i, f) for i, f in enumerate(facts.fields) if seen[f"z{i}"] > 0]
    if medians is None:
        names = facts.for_median()
        found = exact_quantiles(df.selectExpr(*[f"{facts.kept[c]} as {q(c)}" for c in names]), {c: [0.5] for c in names},
                                {c: facts.ends(c) for c in names}) if names else {}
        medians = {c: v[0] for c, v in found.items()}
    for_mode = [
        f.name for i, f in missing if facts.family(f.name) == "text" and chosen[f.name] != "drop_row" and (
            f.name in facts.categories or chosen[f.name] == "mode"
            or chosen[f.name] == "mode_or_unknown" and seen[f"d{i}"] <= _MODE_SKETCH_LIMIT)
    ]
    modes = text_modes(df.selectExpr(*[f"{facts.kept[c]} as {q(c)}" for c in for_mode]), facts.categories) if for_mode else {}

    fills = []
    for i, f in missing:
        name, strategy, count, kind = f.name, chosen[f.name], seen[f"z{i}"], facts.family(f.name)
        if strategy == "drop_row":
            fills.append(Fill(name, "drop", "dropped_rows", count))
        elif strategy == "forward_fill":
            fills.append(Fill(name, "forward_fill", "forward_fill", count))
        elif kind == "boolean":
            fills.append(Fill(name, "fill", "boolean_mode", count, seen[f"t{i}"] > seen[f"f{i}"]))
        elif kind == "numeric":
            value = {"median": medians.get(name), "mean": seen[f"m{i}"], "zero": 0.0}[strategy]
            value = 0.0 if value is None else round(value, 2)
            if isinstance(f.dataType, T.IntegralType):
                value = int(round(value))
            fills.append(Fill(name, "fill", "constant (0)" if strategy == "zero" else strategy, count, value))
        elif kind == "datetime":
            fills.append(Fill(name, "keep", "retained NaT (safe date handling)", count))
        elif kind == "text":
            mode, distinct = modes.get(name, (None, 0))
            if name in facts.categories:
                fills.append(Fill(name, "fill", "categorical_mode", count, UNKNOWN if mode is None else mode))
                continue
            use_mode = mode is not None and (strategy == "mode" or distinct < MODE_DISTINCT_LIMIT)
            fills.append(Fill(name, "fill", strategy, count, mode if use_mode else UNKNOWN))
    return fills


def text_modes(df: DataFrame, categories: Mapping[str, Sequence[str]] | None = None) -> dict[str, tuple[str, int]]:
    """Most frequent value and distinct count of each text column; ties go to the least category, else to the smallest text."""
    ranked = {c: v for c, v in (categories or {}).items() if c in df.columns}
    places = " ".join(
        f"when {text(c)} then nullif(array_position(array({', '.join(text(v) for v in values)}), value), 0)" for c, values in ranked.items() if values)
    # A value that is no listed category comes after those that are.
    place = f"coalesce(case column {places} end, {2**31})" if places else "0"
    rows = value_counts(df, df.columns).groupBy("column").agg(
        F.expr(f"min_by(value, struct(-n, {place}, value)) as mode"), F.expr("count(1) as distinct_values")).collect()
    return {r["column"]: (r["mode"], r["distinct_values"]) for r in rows}


def apply_missing(
    df: DataFrame, fills: Sequence[Fill], order_by: Sequence[str] = (), partition_by: Sequence[str] = (),
) -> DataFrame:
    """Constants go into one projection; drops and ordered fills keep their column order."""
    df, pending = finite(df), []
    for step in fills:
        if step.action == "forward_fill":
            pending.append(step.column)
        elif step.action == "drop":
            if pending:  # an ordered fill still sees the rows dropped after it
                df, pending = fill_ordered(df, pending, order_by, partition_by), []
            df = df.filter(f"{q(step.column)} is not null")
    if pending:
        df = fill_ordered(df, pending, order_by, partition_by)
    constants = {
        f.column: f"coalesce({q(f.column)}, {literal(f.value, df.schema[f.column].dataType.simpleString())})"
        for f in fills if f.action == "fill"
    }
    return replace_columns(df, constants) if constants else df


FILL_SCHEMA = "seq int, column string, strategy string, affected bigint, fill_value string"


def fill_log(df: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """The chosen actions as rows."""
    rows = [(i, f.column, f.strategy, f.count, None if f.value is None else str(f.value)) for i, f in enumerate(fills, 1)]
    return df.sparkSession.createDataFrame(rows, FILL_SCHEMA)


def handle_missing(
    df: DataFrame, numeric: str = "median", categorical: str = "mode_or_unknown", date: str = "keep_nat",
    custom: Mapping[str, str] | None = None, order_by: Sequence[str] = (), partition_by: Sequence[str] = (),
    categories: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, list[Fill]]:
    fills = fit_missing(df, numeric, categorical, date, custom, categories)
    return apply_missing(df, fills, order_by, partition_by), fills
