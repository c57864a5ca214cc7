"""KPIs, statistical summary and grouped breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.names import find_column
from tablewright.functions.numbers import as_double, money, one_decimal, round2, round_scalar
from tablewright.functions.sql import is_numeric, number, numeric_columns, q, rows_of, text
from tablewright.operators.entry import finite
from tablewright.operators.quantiles import exact_quantiles, quartiles

# Keyword lists by priority.
REVENUE_KEYS = ("calculated_revenue", "net_revenue", "revenue", "gross_revenue", "total_amount", "sales", "amount")
QUANTITY_KEYS = ("quantity", "qty", "units_sold", "volume")
PROFIT_KEYS = ("gross_profit", "net_profit", "profit")
MARGIN_KEYS = ("profit_margin_pct", "margin")
ENTITY_KEYS = ("customer_id", "customer_name", "emp_id", "employee_name", "full_name", "client_id")
SALARY_KEYS = ("salary", "annual_salary", "ctc", "compensation", "annual_income")
CATEGORY_KEYS = ("product_category", "category", "department", "business_unit", "customer_segment")
GROWTH_DATE_KEYS = ("month_year", "order_date", "signup_date", "fiscal_quarter", "hire_date")
VALUE_KEYS = ("calculated_revenue", "net_revenue", "revenue", "gross_revenue", "total_amount", "salary",
              "annual_income", "quantity")
REGION_KEYS = ("region", "location", "city", "country", "territory", "branch")
PERIOD_KEYS = ("month_year", "quarter", "order_month_year", "fiscal_quarter")
STATUS_KEYS = ("status", "account_status", "order_status", "payment_status")
# Share of the rows an approximate quartile may be off in rank.
RANK_SLACK = 0.0001


def numeric_column(df: DataFrame, keywords: Sequence[str]) -> str | None:
    """The column the keywords find, if it is numeric."""
    name = find_column(df.columns, keywords)
    return name if name and is_numeric(df.schema[name].dataType) else None


def total(x: str) -> str:
    """Sum that is 0 when there is nothing to add."""
    return f"coalesce(sum({x}), 0D)"


def _kpi(seq: int, key: str, label: str, value: str, raw: str, description: str) -> str:
    """One KPI row as a struct; `label`, `value` and `raw` are expressions."""
    return (f"struct({seq} as seq, '{key}' as key, {label} as label, {value} as value, "
            f"cast({raw} as double) as raw, {text(description)} as description)")


def scalar_kpis(df: DataFrame) -> DataFrame:
    """Every KPI that is one number over the table.

    Plain sums are one aggregate; distinct entities and the median are figures of their own
    beside it, so that no buffer travels under an entity key.
    """
    df = finite(df)
    revenue, quantity = numeric_column(df, REVENUE_KEYS), numeric_column(df, QUANTITY_KEYS)
    profit, margin = numeric_column(df, PROFIT_KEYS), numeric_column(df, MARGIN_KEYS)
    entity, salary = find_column(df.columns, ENTITY_KEYS), numeric_column(df, SALARY_KEYS)
    sums, apart = {"n": "count(1)"}, {}
    # Labels and descriptions of the KPIs.
    rows = [_kpi(1, "total_records", "'Total Records'", "format_number(n, 0)", "n",
                 "Total active rows in processed dataset")]
    if revenue:
        x = as_double(revenue)
        sums |= {"rev": total(x), "rev_avg": f"avg({x})", "rev_max": f"max({x})"}
        rows += [
            _kpi(2, "total_revenue", "'Total Revenue / Sales'", f"if(rev > 0, {money('rev')}, format_number(rev, 2))",
                 "rev", f"Cumulative sum of '{revenue}'"),
            _kpi(3, "average_order_value", "'Average Order Value'", money("rev_avg"), "rev_avg",
                 f"Average ticket size from '{revenue}'"),
            _kpi(4, "max_transaction", "'Max Transaction'", money("rev_max"), "rev_max",
                 f"Highest recorded value in '{revenue}'"),
        ]
    if quantity:
        sums["qty"] = total(as_double(quantity))
        rows.append(_kpi(5, "total_quantity", "'Total Units Sold'", "format_number(cast(qty as bigint), 0)", "qty",
                         f"Total volume from '{quantity}'"))
    if profit:
        sums["profit"] = total(as_double(profit))
        rows.append(_kpi(6, "total_profit", "'Total Gross Profit'", money("profit"), "profit",
                         f"Gross profit calculated from '{profit}'"))
        if margin:
            sums["margin"] = f"avg({as_double(margin)})"
            rows.append(_kpi(7, "average_margin", "'Average Margin'", f"concat({one_decimal('margin')}, '%')", "margin",
                             "Mean profit margin percentage"))
    if entity:
        named = df.selectExpr(f"{q(entity)} as e").filter("e is not null").groupBy("e").agg(F.expr("1 as one"))
        apart["entities"] = named.selectExpr("count(1)").scalar()
        rows.append(_kpi(8, "unique_entities", "'Unique Customers / Accounts'", "format_number(entities, 0)", "entities",
                         f"Distinct entities in '{entity}'"))
    if salary:
        sums["payroll"] = total(as_double(salary))
        apart["median"] = F.expr(number(exact_quantiles(df, {salary: [0.5]})[salary][0]))
        rows += [
            _kpi(9, "total_payroll", "'Total Payroll / Spend'", money("payroll"), "payroll", f"Sum of '{salary}'"),
            _kpi(10, "median_salary", "'Median Salary'", money("median"), "median",
                 f"50th percentile of '{salary}'"),
        ]
    found = df.selectExpr(*[f"{e} as {n}" for n, e in sums.items()]).filter("n > 0")
    return found.withColumns(apart).selectExpr(rows_of(rows)) if apart else found.selectExpr(rows_of(rows))


def top_category(df: DataFrame) -> DataFrame | None:
    """Leading group by revenue with its share, or by row count when there is no revenue."""
    df = finite(df)
    category, revenue = find_column(df.columns, CATEGORY_KEYS), numeric_column(df, REVENUE_KEYS)
    if not category:
        return None
    measure = total(as_double(revenue)) if revenue else "count(1)"
    groups = df.filter(f"{q(category)} is not null").groupBy(F.expr(f"cast({q(category)} as string) as g")).agg(
        F.expr(f"{measure} as v"))
    top = groups.orderBy(F.desc("v"), "g").limit(1)
    if not revenue:
        return top.selectExpr(rows_of([_kpi(
            11, "top_category", "concat('Top Segment (', g, ')')", "concat(format_number(v, 0), ' records')", "v",
            f"Most frequent group in '{category}'")]))
    # Rows without a category still belong to the total.
    whole = df.selectExpr(total(as_double(revenue))).scalar()
    share = "if(whole > 0, v / whole * 100, 0D)"
    return top.withColumn("whole", whole).selectExpr(rows_of([_kpi(
        11, "top_category", "concat('Top Category (', g, ')')",
        f"concat({money('v')}, ' (', {one_decimal(share)}, '%)')", "v", f"Leading contributor from '{category}'")]))


def period_growth(df: DataFrame) -> DataFrame | None:
    """Change between the last two keys of the date column, when the earlier sum is positive."""
    df = finite(df)
    date, revenue = find_column(df.columns, GROWTH_DATE_KEYS), numeric_column(df, REVENUE_KEYS)
    if not date or not revenue:
        return None
    sums = df.filter(f"{q(date)} is not null").groupBy(F.expr(f"{q(date)} as p")).agg(
        F.expr(f"{total(as_double(revenue))} as v"))
    last_two = sums.orderBy(F.desc("p")).limit(2).selectExpr("count(1) as n", "min_by(v, p) as prev", "max_by(v, p) as curr")
    return last_two.filter("n = 2 and prev > 0").selectExpr("(curr - prev) / prev * 100 as growth").selectExpr(rows_of([_kpi(
        12, "period_growth", "'Latest Period Growth'", f"concat(if(growth >= 0, '+', ''), {one_decimal('growth')}, '%')",
        round_scalar("growth", 2), f"Growth between last two periods in '{date}'")]))


def kpi_table(df: DataFrame) -> DataFrame:
    df = finite(df)
    out = scalar_kpis(df)
    for part in (top_category(df), period_growth(df)):
        if part is not None:
            out = out.unionByName(part)
    return out


# --- statistics --------------------------------------------------------------------

def adjusted_skewness(n: str, plain: str) -> str:
    """Bias-adjusted skewness from the plain one; 0 for at most two values or no spread."""
    return f"if({n} > 2, coalesce({plain} * sqrt({n} * ({n} - 1D)) / ({n} - 2), 0D), 0D)"


SUMMARY_FIGURES = ("mean", "std_dev", "min", "q1", "median", "q3", "max", "iqr", "skewness")


def statistical_summary(df: DataFrame, approx: bool = False, known: Mapping[str, Sequence[float | None]] | None = None) -> DataFrame:
    """Twelve statistics per numeric column; columns without any value are left out.

    `known` are quartiles of columns that have been found already; with `approx` those still to
    be found may be off by `RANK_SLACK` of the rows, which saves passes.
    """
    df = finite(df)
    names = numeric_columns(df)
    moments = ("count", "avg", "stddev_samp", "min", "max", "skewness")
    rows = []
    if names:
        seen = df.selectExpr("count(1) as total", *[f"cast({m}({as_double(c)}) as double) as {m}{i}" for i, c in enumerate(names) for m in moments]).first()
        own = {c: [seen[f"{m}{i}"] for m in moments] for i, c in enumerate(names) if seen[f"count{i}"]}
        ends = {c: (int(v[0]), v[3], v[4]) for c, v in own.items() if c not in (known or {})}
        found = dict(known or {}) | quartiles(df, list(ends), ends, RANK_SLACK if approx else 0.0)
        rows = [(i, c, seen["total"], *own[c], *found[c]) for i, c in enumerate(names) if c in own]
    facts = df.sparkSession.createDataFrame(rows, "seq int, column string, total bigint, " + ", ".join(
        f"{m} double" for m in (*moments, "lower", "middle", "upper")))
    figures = ("avg", "stddev_samp", "min", "lower", "middle", "upper", "max", "upper - lower", adjusted_skewness("count", "skewness"))
    return facts.selectExpr(
        "seq", "column", "cast(count as bigint) as count", *[f"{round_scalar(e, 2)} as {n}" for n, e in zip(SUMMARY_FIGURES, figures)],
        "total - cast(count as bigint) as null_count")


# --- breakdowns --------------------------------------------------------------------

def _grouped(df: DataFrame, key: str, *aggregates: str) -> DataFrame:
    return df.filter(f"{q(key)} is not null").groupBy(q(key)).agg(*[F.expr(a) for a in aggregates])


def _measures(value: str) -> tuple[str, ...]:
    x = as_double(value)
    return "count(1) as record_count", f"{total(x)} as total_value", f"avg({x}) as average_value"


def breakdown(df: DataFrame, dimension: str, value: str) -> DataFrame:
    """Count, sum, mean and share of the grand total per group, largest first."""
    df = finite(df)
    groups = _grouped(df, dimension, *_measures(value))
    # A scalar subquery, not a window: a window over all groups would be one task.
    grand = df.filter(f"{q(dimension)} is not null").selectExpr(f"sum({as_double(value)})").scalar()
    return groups.withColumn("grand", grand).selectExpr(
        q(dimension), "record_count", "total_value", "average_value",
        f"{round2('try_divide(total_value, grand) * 100')} as share_pct",
    ).orderBy(F.desc("total_value"), q(dimension))


def count_breakdown(df: DataFrame, dimension: str) -> DataFrame:
    return _grouped(df, dimension, "count(1) as record_count").orderBy(F.desc("record_count"), q(dimension))


def period_breakdown(df: DataFrame, period: str, value: str) -> DataFrame:
    return _grouped(finite(df), period, *_measures(value)).orderBy(q(period))


def value_column(df: DataFrame) -> str | None:
    """Keyword match, else the first numeric column."""
    return numeric_column(df, VALUE_KEYS) or next(iter(numeric_columns(df)), None)


def breakdowns(df: DataFrame) -> dict[str, DataFrame]:
    """Every breakdown the columns allow; each stays lazy."""
    df = finite(df)
    value, out = value_column(df), {}
    for name, keys in (("by_category", CATEGORY_KEYS), ("by_region", REGION_KEYS)):
        dimension = find_column(df.columns, keys)
        if dimension:
            out[name] = breakdown(df, dimension, value) if value else count_breakdown(df, dimension)
    period, status = find_column(df.columns, PERIOD_KEYS), find_column(df.columns, STATUS_KEYS)
    if period and value:
        out["by_period"] = period_breakdown(df, period, value)
    if status:
        out["by_status"] = count_breakdown(df, status)
    return out


def all_breakdowns(df: DataFrame) -> DataFrame:
    """The breakdowns stacked into one long table."""
    out = None
    for name, part in breakdowns(df).items():
        measures = [c if c in part.columns else f"cast(null as double) as {c}"
                    for c in ("total_value", "average_value", "share_pct")]
        rows = part.selectExpr(
            f"'{name}' as breakdown", f"cast({q(part.columns[0])} as string) as group_key", "record_count", *measures)
        out = rows if out is None else out.unionByName(rows)
    return out
