"""Queries over the narrative."""

from __future__ import annotations

from catalog.dirty import table
from catalog.duck import GRADE, column_counts, scores, with_tables
from catalog.registry import query
from catalog.shared import cleaned, enriched
from tablewright.operators import insights as I
from tablewright.operators.analytics import breakdowns, kpi_table
from tablewright.operators.profile import dataset_profile

_EMP = with_tables("d_employee", "employee_fill") + f""", s as ({scores('d_employee')}), t as ({scores('employee_fill')}), i as ({column_counts('d_employee')}),
 c as (select department as g, sum(salary) as v from employee_fill group by 1), r as (select location as g, sum(salary) as v from employee_fill group by 1),
 w as (select sum(salary) as whole from employee_fill)
"""
_QUALITY = f"""select 'quality_insights' as section, 1 as seq, concat('Overall Data Health Score improved from ', score, '/100 [', {GRADE},
 '] to ', (select concat(score, '/100 [', {GRADE}, '].') from t)) as text from s
 union all select 'quality_insights', 2, format('Resolved {{:,}} missing values across {{}} columns using statistical imputation strategies.',
  total_missing - (select total_missing from t), (select count(*) from i where missing_count > 0 or blank_count > 0)) from s
 union all select 'quality_insights', 3, concat('Successfully standardized data types for ', (select count(*) from i where inferred_type like 'numeric%'),
  ' columns (including currency symbol stripping, date parsing, and boolean normalization).') from s
 union all select 'quality_insights', 4, concat('Standardized ', total_columns,
  ' column headers into consistent snake_case format for SQL/pipeline compatibility.') from s"""
_SHARE = "round_even({0}.v / whole * 10000, 0) / 100"


def _seq(text: str) -> str:
    return f"select section, cast(seq as int) as seq, text from ({text})"


@query("in_quality", _EMP + _seq(_QUALITY))
def in_quality(spark, folder):
    raw, result = table(spark, folder, "d_employee"), cleaned(spark, folder, "d_employee")
    return I.quality_insights(dataset_profile(raw), dataset_profile(result.table), result.facts)


_SALES = with_tables("sales_feat") + """, c as (select product_category as g, sum(net_revenue) as v from sales_feat group by 1),
 r as (select region as g, sum(net_revenue) as v from sales_feat group by 1), w as (select sum(net_revenue) as whole, avg(net_revenue) as mean, count(*) as n from sales_feat),
 d as (select order_date as p, sum(net_revenue) as v from sales_feat where order_date is not null group by 1),
 g as (select v as curr, lead(v) over (order by p desc) as prev, row_number() over (order by p desc) as rn from d)
"""


@query("in_business", _SALES + _seq("""
 select 'business_insights' as section, row_number() over (order by k) as seq, text from (
 select 1 as k, format('Total cumulative revenue / sales volume stands at ${:,.2f} across {:,} transactions.', whole, n) as text from w
 union all select 2, format('Average Order Value (AOV) was calculated at ${:,.2f} per transaction.', mean) from w
 union all select 3, format('Top contributing category is ''{}'' accounting for {:.1f}% of total volume (${:,.2f}).', c.g, round_even(c.v / whole * 10000, 0) / 100, c.v)
  from c, w where c.v = (select max(v) from c)
 union all select 4, format('Noticeable concentration risk: ''{}'' commands over half of the entire dataset revenue.', c.g) from c, w
  where c.v = (select max(v) from c) and round_even(c.v / whole * 10000, 0) / 100 > 50
 union all select 5, format('Regional distribution is led by ''{}'' generating {:.1f}% of activity.', r.g, round_even(r.v / whole * 10000, 0) / 100)
  from r, w where r.v = (select max(v) from r)
 union all select 6, format('Latest period performance demonstrated a growth rate of {:+.1f}%.', (curr - prev) / prev * 100) from g where rn = 1 and prev > 0)"""))
def in_business(spark, folder):
    sales = enriched(spark, folder, "d_sales_twice")
    groups = breakdowns(sales)
    return I.business_insights(kpi_table(sales), groups["by_category"], groups["by_region"])


@query("in_anomaly", with_tables("employee_fill") + _seq("""
 select 'anomaly_insights' as section, 1 as seq, format('Identified {} statistical outlier values in ''salary'' ({}% of rows) exceeding upper threshold of {:,.2f}.',
  n, cast(format('{:.2f}', n / total * 100) as double), hi) as text
 from (select count(*) filter (where salary < lo or salary > hi) as n, count(*) as total, any_value(hi) as hi from employee_fill,
 (select round_even((q1 - 1.5 * (q3 - q1)) * 100, 0) / 100 as lo, round_even((q3 + 1.5 * (q3 - q1)) * 100, 0) / 100 as hi from (
 select quantile_cont(salary, 0.25) as q1, quantile_cont(salary, 0.75) as q3 from employee_fill)))"""))
def in_anomaly(spark, folder):
    return I.anomaly_insights(cleaned(spark, folder, "d_employee").outliers())


_ADVICE = (
    "Implement frontend form validation at data entry to mandate required fields and eliminate downstream missing values.",
    "Enforce database UNIQUE constraints on transactional ID fields to prevent duplicate records at ingestion.",
    "Enforce strict schema typing at the ingestion pipeline to avoid storing raw currency symbols and unformatted strings in numeric fields.",
    "Schedule automated daily/weekly runs of this cleaning pipeline to monitor data health drift over time.",
)


@query("in_recommend", _SALES + _seq(f"""
 select 'recommendations' as section, row_number() over (order by k) as seq, text from (
 select 1 as k, '{_ADVICE[0]}' as text from d_sales where "Region" is null limit 1)
 union all select 'recommendations', 2, '{_ADVICE[1]}' from (select 1 from w)
 union all select 'recommendations', 3, '{_ADVICE[2]}' from (select 1 from w)
 union all select 'recommendations', 4, format('Evaluate marketing and promotional strategies for lower-performing category ''{{}}'' ({{:.1f}}% share) to balance portfolio revenue.',
  c.g, round_even(c.v / whole * 10000, 0) / 100) from c, w where c.v = (select min(v) from c)
 union all select 'recommendations', 5, '{_ADVICE[3]}' from w"""))
def in_recommend(spark, folder):
    result = cleaned(spark, folder, "d_sales_twice")
    groups = breakdowns(enriched(spark, folder, "d_sales_twice"))
    return I.recommendations(dataset_profile(table(spark, folder, "d_sales_twice"), duplicates=0), result.facts, groups["by_category"])


_ANOMALY = """select 'anomaly_insights' as section, cast(row_number() over (order by k) as int) as seq, text from (""" + " union all ".join(f"""
 select {k} as k, format('Identified {{}} statistical outlier values in ''{c}'' ({{}}% of rows) exceeding upper threshold of {{:,.2f}}.',
  n, cast(format('{{:.2f}}', n / total * 100) as double), hi) as text
 from (select count(*) filter (where {c} < lo or {c} > hi) as n, count(*) as total, any_value(hi) as hi from employee_fill,
 (select round_even((q1 - 1.5 * (q3 - q1)) * 100, 0) / 100 as lo, round_even((q3 + 1.5 * (q3 - q1)) * 100, 0) / 100 as hi from (
 select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from employee_fill))) where n > 0""" for k, c in enumerate(("salary", "experience_yrs"))) + ")"


@query("in_all", _EMP + _seq(_QUALITY + f"""
 union all select 'business_insights', row_number() over (order by k), text from (
 select 1 as k, format('Top contributing category is ''{{}}'' accounting for {{:.1f}}% of total volume (${{:,.2f}}).', c.g, {_SHARE.format('c')}, c.v) as text
  from c, w where c.v = (select max(v) from c)
 union all select 2, format('Noticeable concentration risk: ''{{}}'' commands over half of the entire dataset revenue.', c.g) from c, w
  where c.v = (select max(v) from c) and {_SHARE.format('c')} > 50
 union all select 3, format('Regional distribution is led by ''{{}}'' generating {{:.1f}}% of activity.', r.g, {_SHARE.format('r')})
  from r, w where r.v = (select max(v) from r))
 union all {_ANOMALY}
 union all select 'recommendations', row_number() over (order by k), text from (
 select 1 as k, '{_ADVICE[0]}' as text from s where total_missing > 0
 union all select 2, '{_ADVICE[1]}' from s where duplicate_count > 0
 union all select 3, '{_ADVICE[2]}' from i where inferred_type like 'numeric%'
 union all select 4, format('Evaluate marketing and promotional strategies for lower-performing category ''{{}}'' ({{:.1f}}% share) to balance portfolio revenue.',
  c.g, {_SHARE.format('c')}) from c, w where c.v = (select min(v) from c) and (select count(*) from c) > 1
 union all select 5, '{_ADVICE[3]}')"""))
def in_all(spark, folder):
    raw, result = table(spark, folder, "d_employee"), cleaned(spark, folder, "d_employee")
    rows = enriched(spark, folder, "d_employee")
    groups = breakdowns(rows)
    return I.all_insights(
        dataset_profile(raw), dataset_profile(rows), result.facts, kpi_table(rows), result.outliers(),
        groups.get("by_category"), groups.get("by_region"))
