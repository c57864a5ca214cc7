"""Queries over KPIs, statistics and breakdowns."""

from __future__ import annotations

from catalog.dirty import table
from catalog.duck import r2, rs, with_tables
from catalog.registry import query
from catalog.shared import enriched
from tablewright.functions.numbers import round_scalar
from tablewright.operators import analytics as A
from tablewright.operators.profile import approx_cardinality
from tablewright.operators.quantiles import exact_quantiles

_MONEY = "format('${{:,.2f}}', {0})"


def _kpi_sql(source: str, key: str, label: str, value: str, raw: str, description: str) -> str:
    return with_tables(source) + f"""select '{key}' as key, {label} as label, {value} as value, round(cast({raw} as double), 2) as raw,
 {chr(39) + description.replace(chr(39), chr(39) * 2) + chr(39)} as description from {source}"""


def _rounded(kpis, key):
    return kpis.filter(f"key = '{key}'").selectExpr("key", "label", "value", "round(raw, 2) as raw", "description")


def _scalar(name, source, base, key, label, value, raw, description):
    """A KPI that is one figure of the cleaned table `base` (`source` in the comparison)."""

    @query(name, _kpi_sql(source, key, f"'{label}'", value, raw, description))
    def run(spark, folder):
        return _rounded(A.scalar_kpis(enriched(spark, folder, base)), key)

    return run


_scalar("kpi_records", "sales_feat", "d_sales_twice", "total_records", "Total Records", "format('{:,}', count(*))", "count(*)",
        "Total active rows in processed dataset")
_scalar("kpi_revenue", "sales_feat", "d_sales_twice", "total_revenue", "Total Revenue / Sales",
        f"case when sum(net_revenue) > 0 then {_MONEY.format('sum(net_revenue)')} else format('{{:,.2f}}', sum(net_revenue)) end",
        "sum(net_revenue)", "Cumulative sum of 'net_revenue'")
_scalar("kpi_aov", "sales_feat", "d_sales_twice", "average_order_value", "Average Order Value", _MONEY.format("avg(net_revenue)"),
        "avg(net_revenue)", "Average ticket size from 'net_revenue'")
_scalar("kpi_maxtxn", "sales_feat", "d_sales_twice", "max_transaction", "Max Transaction", _MONEY.format("max(net_revenue)"),
        "max(net_revenue)", "Highest recorded value in 'net_revenue'")
_scalar("kpi_units", "sales_feat", "d_sales_twice", "total_quantity", "Total Units Sold",
        "format('{:,}', cast(trunc(sum(quantity)) as bigint))", "sum(quantity)", "Total volume from 'quantity'")
_scalar("kpi_profit", "ledger_feat", "d_ledger", "total_profit", "Total Gross Profit", _MONEY.format("sum(gross_profit)"),
        "sum(gross_profit)", "Gross profit calculated from 'gross_profit'")
_scalar("kpi_margin", "ledger_feat", "d_ledger", "average_margin", "Average Margin", "format('{:.1f}%', avg(profit_margin_pct))",
        "avg(profit_margin_pct)", "Mean profit margin percentage")
_scalar("kpi_entities", "employee_fill", "d_employee", "unique_entities", "Unique Customers / Accounts",
        "format('{:,}', count(distinct emp_id))", "count(distinct emp_id)", "Distinct entities in 'emp_id'")
_scalar("kpi_payroll", "employee_fill", "d_employee", "total_payroll", "Total Payroll / Spend", _MONEY.format("sum(salary)"),
        "sum(salary)", "Sum of 'salary'")
_scalar("kpi_medsal", "employee_fill", "d_employee", "median_salary", "Median Salary", _MONEY.format("quantile_cont(salary, 0.5)"),
        "quantile_cont(salary, 0.5)", "50th percentile of 'salary'")


@query("kpi_topcat", with_tables("sales_feat") + f"""select 'top_category' as key, concat('Top Category (', g, ')') as label,
 concat({_MONEY.format('v')}, ' (', format('{{:.1f}}', case when whole > 0 then v / whole * 100 else 0 end), '%)') as value, round(v, 2) as raw,
 'Leading contributor from ''product_category''' as description
 from (select product_category as g, sum(net_revenue) as v, (select sum(net_revenue) from sales_feat) as whole from sales_feat group by 1 order by 2 desc, 1 limit 1)""")
def kpi_topcat(spark, folder):
    return _rounded(A.top_category(enriched(spark, folder, "d_sales_twice")), "top_category")


@query("kpi_topseg", with_tables("employee_fill") + """select 'top_category' as key, concat('Top Segment (', g, ')') as label,
 format('{:,} records', v) as value, cast(v as double) as raw, 'Most frequent group in ''department''' as description
 from (select department as g, count(*) as v from employee_fill group by 1 order by 2 desc, 1 limit 1)""")
def kpi_topseg(spark, folder):
    return _rounded(A.top_category(enriched(spark, folder, "d_employee")), "top_category")


@query("kpi_growth", with_tables("ledger_feat") + f"""select 'period_growth' as key, 'Latest Period Growth' as label,
 format('{{:+.1f}}%', growth) as value, {rs('growth')} as raw, 'Growth between last two periods in ''fiscal_quarter''' as description
 from (select (curr - prev) / prev * 100 as growth from (select v as curr, lead(v) over (order by fiscal_quarter desc) as prev,
 row_number() over (order by fiscal_quarter desc) as rn from (select fiscal_quarter, sum(gross_revenue) as v from ledger_feat group by 1)) where rn = 1 and prev > 0)""")
def kpi_growth(spark, folder):
    return A.period_growth(enriched(spark, folder, "d_ledger")).drop("seq")


@query("kpi_table", with_tables("ledger_feat") + f"""select cast(1 as int) as seq, 'total_records' as key, format('{{:,}}', count(*)) as value from ledger_feat
 union all select 2, 'total_revenue', {_MONEY.format('sum(gross_revenue)')} from ledger_feat
 union all select 3, 'average_order_value', {_MONEY.format('avg(gross_revenue)')} from ledger_feat
 union all select 4, 'max_transaction', {_MONEY.format('max(gross_revenue)')} from ledger_feat
 union all select 6, 'total_profit', {_MONEY.format('sum(gross_profit)')} from ledger_feat
 union all select 7, 'average_margin', format('{{:.1f}}%', avg(profit_margin_pct)) from ledger_feat
 union all select 11, 'top_category', concat({_MONEY.format('v')}, ' (', format('{{:.1f}}', v / (select sum(gross_revenue) from ledger_feat) * 100), '%)')
  from (select business_unit, sum(gross_revenue) as v from ledger_feat group by 1 order by 2 desc, 1 limit 1)
 union all select 12, 'period_growth', format('{{:+.1f}}%', (curr - prev) / prev * 100) from (
  select v as curr, lead(v) over (order by q desc) as prev, row_number() over (order by q desc) as rn
  from (select fiscal_quarter as q, sum(gross_revenue) as v from ledger_feat group by 1)) where rn = 1 and prev > 0""")
def kpi_table(spark, folder):
    return A.kpi_table(enriched(spark, folder, "d_ledger")).select("seq", "key", "value")


# --- statistics --------------------------------------------------------------------

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _stats(source: str, c: str, i: int) -> str:
    def quantile(p: str) -> str:
        return f"quantile_cont({c}, {p})"

    return f"""select cast({i} as int) as seq, '{c}' as "column", count({c}) as count, {rs(f'avg({c})')} as mean, {rs(f'stddev_samp({c})')} as std_dev,
 {rs(f'min({c})::double')} as min, {rs(quantile('0.25'))} as q1, {rs(quantile('0.5'))} as median, {rs(quantile('0.75'))} as q3, {rs(f'max({c})::double')} as max,
 {rs(f"{quantile('0.75')} - {quantile('0.25')}")} as iqr, {rs(f'skewness({c})')} as skewness, count(*) filter (where {c} is null) as null_count from {source}"""


@query("stat_summary", " union all ".join(_stats("lineitem", c, i) for i, c in enumerate(_NUMBERS)))
def stat_summary(spark, folder):
    return A.statistical_summary(table(spark, folder, "lineitem").select(*_NUMBERS))


@query("stat_skew", "select " + ", ".join(f"{rs(f'skewness({c})', 4)} as {c}" for c in _NUMBERS) + " from lineitem")
def stat_skew(spark, folder):
    row = table(spark, folder, "lineitem").selectExpr("count(1) as n", *[f"skewness(cast({c} as double)) as {c}" for c in _NUMBERS])
    return row.selectExpr(*[f"{round_scalar(A.adjusted_skewness('n', c), 4)} as {c}" for c in _NUMBERS])


_PROBS = (0.05, 0.25, 0.5, 0.75, 0.99)


@query("stat_nan", with_tables("readings_known") + " union all ".join(_stats("readings_known", c, i) for i, c in enumerate(("price", "quantity"))))
def stat_nan(spark, folder):
    return A.statistical_summary(table(spark, folder, "d_readings"))


@query("stat_quant", " union all ".join(
    f"select '{c}' as \"column\", cast({p} as double) as p, {rs(f'quantile_cont({c}, {p})', 4)} as q from lineitem"
    for c in ("l_extendedprice", "l_quantity") for p in _PROBS))
def stat_quant(spark, folder):
    items = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity")
    found = exact_quantiles(items, {c: _PROBS for c in items.columns})
    rows = [(c, p, round(v, 4)) for c, values in found.items() for p, v in zip(_PROBS, values)]
    return spark.createDataFrame(rows, "column string, p double, q double")


@query("stat_quant_search", " union all ".join(
    f"select cast({p} as double) as p, {rs(f'quantile_cont(l_extendedprice, {p})', 4)} as q from lineitem" for p in _PROBS))
def stat_quant_search(spark, folder):
    """Many passes over few intervals, down to single values."""
    items = table(spark, folder, "lineitem").select("l_extendedprice")
    found = exact_quantiles(items, {"l_extendedprice": _PROBS}, intervals=8, max_values=20)
    return spark.createDataFrame([(p, round(v, 4)) for p, v in zip(_PROBS, found["l_extendedprice"])], "p double, q double")


@query("prof_card_approx", """select 'l_returnflag' as "column", count(distinct l_returnflag) as unique_count from lineitem
 union all select 'l_linestatus', count(distinct l_linestatus) from lineitem
 union all select 'l_linenumber', count(distinct l_linenumber) from lineitem""")
def prof_card_approx(spark, folder):
    return approx_cardinality(table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


# --- breakdowns --------------------------------------------------------------------

def _breakdown_sql(source: str, key: str, value: str) -> str:
    return with_tables(source) + f"""select {key}, count(*) as record_count, round(sum({value}), 2) as total_value, round(avg({value}), 2) as average_value,
 {r2(f'sum({value}) / (select sum({value}) from {source} where {key} is not null) * 100')} as share_pct from {source} where {key} is not null group by 1"""


def _in_cents(df):
    """Sums differ in their last bits with the order of addition."""
    money = [c for c in ("total_value", "average_value") if c in df.columns]
    return df.selectExpr(*[f"round({c}, 2) as {c}" if c in money else c for c in df.columns])


@query("agg_category", _breakdown_sql("sales_feat", "product_category", "net_revenue"))
def agg_category(spark, folder):
    return _in_cents(A.breakdowns(enriched(spark, folder, "d_sales_twice"))["by_category"])


@query("agg_region", _breakdown_sql("sales_feat", "region", "net_revenue"))
def agg_region(spark, folder):
    return _in_cents(A.breakdowns(enriched(spark, folder, "d_sales_twice"))["by_region"])


@query("agg_countonly", with_tables("d_customer") + """select "Customer Segment", count(*) as record_count from d_customer
 where "Customer Segment" is not null group by 1""")
def agg_countonly(spark, folder):
    rows = table(spark, folder, "d_customer").select("Customer ID", "Customer Segment")
    return A.count_breakdown(rows, "Customer Segment")


@query("agg_period", with_tables("sales_feat") + """select order_month_year, count(*) as record_count, round(sum(net_revenue), 2) as total_value,
 round(avg(net_revenue), 2) as average_value from sales_feat where order_month_year is not null group by 1""")
def agg_period(spark, folder):
    return _in_cents(A.breakdowns(enriched(spark, folder, "d_sales_twice"))["by_period"])


@query("agg_status", with_tables("ledger_feat") + "select report_status, count(*) as record_count from ledger_feat group by 1")
def agg_status(spark, folder):
    return A.breakdowns(enriched(spark, folder, "d_ledger"))["by_status"]


@query("agg_valcol", with_tables("employee_fill") + """select 'salary' as value_column, round(sum(salary), 2) as total from employee_fill
 union all select 's_suppkey', cast(sum(s_suppkey) as double) from supplier""")
def agg_valcol(spark, folder):
    out = None
    for rows in (enriched(spark, folder, "d_employee"), table(spark, folder, "supplier")):
        column = A.value_column(rows)
        part = rows.selectExpr(f"'{column}' as value_column", f"{column} as x").groupBy("value_column").agg({"x": "sum"})
        part = part.selectExpr("value_column", "round(cast(`sum(x)` as double), 2) as total")
        out = part if out is None else out.unionByName(part)
    return out


@query("agg_all", with_tables("ledger_feat") + f"""select 'by_category' as breakdown, business_unit as group_key, count(*) as record_count,
 round(sum(gross_revenue), 2) as total_value, round(avg(gross_revenue), 2) as average_value,
 {r2('sum(gross_revenue) / (select sum(gross_revenue) from ledger_feat) * 100')} as share_pct from ledger_feat group by 2
 union all select 'by_period', fiscal_quarter, count(*), round(sum(gross_revenue), 2), round(avg(gross_revenue), 2), null from ledger_feat group by 2
 union all select 'by_status', report_status, count(*), null, null, null from ledger_feat group by 2""")
def agg_all(spark, folder):
    return _in_cents(A.all_breakdowns(enriched(spark, folder, "d_ledger")))
