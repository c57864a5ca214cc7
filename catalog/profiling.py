"""Queries over profiles and data-quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.dirty import table
from catalog.duck import GRADE, column_counts, rs, scores, with_tables
from catalog.registry import query
from catalog.shared import cleaned
from tablewright.functions.names import is_nonstandard
from tablewright.operators import profile as P
from tablewright.operators.dedup import duplicate_summary
from tablewright.operators.standardize import clean_names


def _counts(name: str, columns: str, where: str = "true") -> str:
    return with_tables(name) + f"select {columns} from ({column_counts(name)}) where {where}"


@query("prof_empty", """select cast(count(*) as bigint) as total_rows, cast(0 as bigint) as total_columns, 0.0::double as quality_score,
 'N/A' as quality_grade, count(*) = 0 as is_empty from customer where c_custkey < 0""")
def prof_empty(spark, folder):
    none = table(spark, folder, "d_customer").filter("`Customer ID` = 'no such customer'")
    return P.dataset_profile(none).select("total_rows", "total_columns", "quality_score", "quality_grade", "is_empty")


@query("prof_missing", _counts("d_sales", '"column", missing_count, missing_pct', "missing_count > 0"))
def prof_missing(spark, folder):
    return P.column_counts(table(spark, folder, "d_sales")).filter("missing_count > 0").select(
        "column", "missing_count", "missing_pct")


@query("prof_misstot", with_tables("d_sales") + f"select total_missing, total_missing_pct from ({scores('d_sales')})")
def prof_misstot(spark, folder):
    return P.dataset_profile(table(spark, folder, "d_sales"), duplicates=0).select("total_missing", "total_missing_pct")


@query("prof_nan", _counts("readings_known", '"column", n as "rows", missing_count, missing_pct, unique_count, negative_count'))
def prof_nan(spark, folder):
    return P.column_profile(table(spark, folder, "d_readings"), samples=False).select(
        "column", "rows", "missing_count", "missing_pct", "unique_count", "negative_count")


@query("prof_nan_score", with_tables("readings_known") + f"""select total_missing, total_missing_pct, duplicate_count, {rs('c', 1)} as completeness,
 {rs('v', 1)} as validity, score as quality_score from ({scores('readings_known')})""")
def prof_nan_score(spark, folder):
    return P.dataset_profile(table(spark, folder, "d_readings")).select(
        "total_missing", "total_missing_pct", "duplicate_count", "completeness", "validity", "quality_score")


@query("prof_dup", f"""select n as total_rows, n - d as duplicate_count, {rs('(n - d) / n * 100')} as duplicate_pct from (
 select (select count(*) from documents) as n, (select count(*) from (select distinct text, lang, source from documents)) as d)""")
def prof_dup(spark, folder):
    return duplicate_summary(table(spark, folder, "documents").select("text", "lang", "source"))


@query("prof_dtype", """select case family when 'text' then column_name else column_name end as "column", family from (
 select column_name, case when data_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'numeric' when data_type = 'VARCHAR' then 'text'
 when data_type like 'TIMESTAMP%' then 'datetime' else 'boolean' end as family
 from (describe select *, l_quantity > 10 as is_large from lineitem) as d(column_name, data_type, a, b, c, e))""")
def prof_dtype(spark, folder):
    return P.dtype_table(table(spark, folder, "lineitem").selectExpr("*", "l_quantity > 10 as is_large")).select("column", "family")


_INF = '"column", n - missing_count as known, numeric_like, date_like, bool_like, inferred_type'


def _inferred(df, kind):
    return P.column_counts(df).filter(F.col("inferred_type") == kind).selectExpr(
        "column", "rows - missing_count as known", "numeric_like", "date_like", "bool_like", "inferred_type")


@query("inf_empty", """select 'Notes' as "column", count(notes) as known, 0::bigint as numeric_like, 0::bigint as date_like,
 0::bigint as bool_like, case when count(notes) = 0 then 'empty_text' end as inferred_type
 from (select cast(null as varchar) as notes from customer)""")
def inf_empty(spark, folder):
    return _inferred(table(spark, folder, "d_customer").selectExpr("*", "cast(null as string) as Notes"), P.EMPTY_TEXT)


@query("inf_num", with_tables("d_sales", "d_employee") + f"""select {_INF} from ({column_counts('d_sales')}) where inferred_type like 'numeric%'
 union all select {_INF} from ({column_counts('d_employee')}) where inferred_type like 'numeric%'""")
def inf_num(spark, folder):
    return _inferred(table(spark, folder, "d_sales"), P.NUMERIC_TEXT).unionByName(
        _inferred(table(spark, folder, "d_employee"), P.NUMERIC_TEXT))


@query("inf_date", _counts("d_sales", _INF, "inferred_type = 'datetime_string'"))
def inf_date(spark, folder):
    return _inferred(table(spark, folder, "d_sales"), P.DATE_TEXT)


@query("inf_bool", """select 'flag' as "column", count(flag) as known,
 count(*) filter (where flag in ('0', '1')) as numeric_like, 0::bigint as date_like,
 count(*) filter (where lower(flag) in ('true','false','yes','no','y','n','0','1')) as bool_like,
 case when count(*) filter (where lower(flag) in ('true','false','yes','no','y','n','0','1')) / count(flag) >= 0.85
  then 'boolean_string' end as inferred_type
 from (select case cast(c_custkey % 5 as int) when 0 then 'yes' when 1 then 'No' when 2 then 'TRUE' when 3 then 'n' end as flag from customer)""")
def inf_bool(spark, folder):
    flags = table(spark, folder, "customer").selectExpr(
        "case cast(c_custkey % 5 as int) when 0 then 'yes' when 1 then 'No' when 2 then 'TRUE' when 3 then 'n' end as flag")
    return _inferred(flags, P.BOOL_TEXT)


@query("inf_text", _counts("d_customer", _INF, "inferred_type = 'text_categorical'"))
def inf_text(spark, folder):
    return _inferred(table(spark, folder, "d_customer"), P.PLAIN_TEXT)


@query("prof_card", _counts("d_sales", '"column", unique_count, unique_pct'))
def prof_card(spark, folder):
    return P.column_profile(table(spark, folder, "d_sales"), samples=False).select("column", "unique_count", "unique_pct")


@query("prof_sample", "\nunion all ".join(
    f"""select '{c}' as "column", (select string_agg(v, '|' order by k) from (
 select distinct {c} as k, cast({c} as varchar) as v from orders order by k limit 5)) as samples"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def prof_sample(spark, folder):
    return P.cardinality(table(spark, folder, "orders")).selectExpr("column", "array_join(sample_values, '|') as samples")


@query("prof_const", """select 'country' as "column", count(distinct country) as unique_count from (
 select 'IN' as country from customer) having count(distinct country) <= 1 and count(*) > 1""")
def prof_const(spark, folder):
    rows = table(spark, folder, "customer").selectExpr("*", "'IN' as country")
    return P.column_profile(rows, samples=False).filter("is_constant").select("column", "unique_count")


@query("prof_neg", with_tables("d_sales", "d_employee") + f"""select "column", negative_count from ({column_counts('d_sales')}) where negative_count > 0
 union all select "column", negative_count from ({column_counts('d_employee')}) where negative_count > 0""")
def prof_neg(spark, folder):
    both = [P.column_counts(table(spark, folder, n)).filter("negative_count > 0").select("column", "negative_count")
            for n in ("d_sales", "d_employee")]
    return both[0].unionByName(both[1])


@query("prof_blank", _counts("d_sales", '"column", blank_count, greatest(blank_count - missing_count, 0) as counted_blank', "is_text"))
def prof_blank(spark, folder):
    return P.column_counts(table(spark, folder, "d_sales")).filter("is_text").selectExpr(
        "column", "blank_count", "greatest(blank_count - missing_count, 0L) as counted_blank")


@query("prof_names", _counts("d_sales", '"column", n as "rows"', "odd"))
def prof_names(spark, folder):
    mixed, _ = clean_names(table(spark, folder, "d_sales"))
    assert not any(is_nonstandard(c) for c in mixed.columns)
    return P.column_counts(table(spark, folder, "d_sales")).filter("nonstandard_name").select("column", "rows")


def _score_query(name: str, columns: dict[str, str]):
    """Score columns of the sales table that holds copies: Spark name -> DuckDB expression."""
    shown = ", ".join(f"{e} as {n}" for n, e in columns.items())

    @query(name, with_tables("d_sales_twice") + f"select {shown} from ({scores('d_sales_twice')})")
    def run(spark, folder):
        return P.dataset_profile(table(spark, folder, "d_sales_twice")).select(*columns)

    return run


_score_query("dq_complete", {"total_missing_pct": "total_missing_pct", "completeness": rs("c", 1)})
_score_query("dq_unique", {"duplicate_pct": "duplicate_pct", "uniqueness": rs("u", 1)})
_score_query("dq_valid", {"validity": rs("v", 1)})
_score_query("dq_consist", {"consistency": rs("k", 1)})
_score_query("dq_score", {
    "total_rows": "total_rows", "total_columns": "total_columns", "total_missing": "total_missing",
    "duplicate_count": "duplicate_count", "quality_score": "score"})
_score_query("dq_grade", {"quality_score": "score", "quality_grade": GRADE})

_ODD = "columns have non-standard naming (spaces, mixed-case, or special characters)."


@query("dq_issues", with_tables("d_sales_twice") + f""", c as ({column_counts('d_sales_twice')}), s as ({scores('d_sales_twice')})
select cast(row_number() over (order by k) as int) as seq, issue from (
 select 1 as k, format('Found {{:,}} missing values across {{}} columns ({{}}% of total cells).', total_missing,
  (select count(*) from c where missing_count > 0), total_missing_pct) as issue from s where total_missing > 0
 union all select 2, format('Found {{:,}} exact duplicate rows ({{}}% of dataset).', duplicate_count, duplicate_pct) from s where duplicate_count > 0
 union all select 3, 'Columns formatted as text with currency/symbols: ' || string_agg("column", ', ' order by seq) from c
  where inferred_type like 'numeric%' having count(*) > 0
 union all select 4, 'Unparsed date columns: ' || string_agg("column", ', ' order by seq) from c
  where inferred_type = 'datetime_string' having count(*) > 0
 union all select 5, 'Constant/Zero-variance columns (single unique value): ' || string_agg("column", ', ' order by seq) from c
  where unique_count <= 1 having count(*) > 0
 union all select 6, 'Found negative values in strictly positive fields: {{' || string_agg('''' || "column" || ''': ' || negative_count, ', ' order by seq) || '}}'
  from c where negative_count > 0 having count(*) > 0
 union all select 7, 'Found blank/whitespace-only text strings in: {{' || string_agg('''' || "column" || ''': ' || (blank_count - missing_count), ', ' order by seq) || '}}'
  from c where blank_count > missing_count having count(*) > 0
 union all select 8, count(*) || ' {_ODD}' from c where odd having count(*) > 0)""".replace("{{:,}}", "{:,}").replace("{{}}", "{}").replace("{{'", "{'").replace("'}}'", "'}'"))
def dq_issues(spark, folder):
    return P.issues(table(spark, folder, "d_sales_twice"))


@query("dq_coltable", _counts("d_customer", """cast(seq as int) as seq, "column" as column_name, missing_count as raw_missing_count,
 concat(missing_pct, '%') as missing_pct, unique_count as unique_values, coalesce(inferred_type, 'standard') as inferred_semantic_type,
 (select case data_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(data_type) end
  from (describe select * from d_customer) as d(own, data_type, x, y, z, w) where own = "column") as original_data_type"""))
def dq_coltable(spark, folder):
    profile = P.column_profile(table(spark, folder, "d_customer"), samples=False)
    return P.diagnostics(profile)


@query("dq_before_after", with_tables("d_employee", "employee_fill") + f""", s as ({scores('d_employee')}), t as ({scores('employee_fill')}),
 p as (select s.total_rows as r0, s.total_columns as c0, s.total_missing as m0, s.duplicate_count as d0, s.score as s0,
  t.total_rows as r1, t.total_columns as c1, t.total_missing as m1, t.duplicate_count as d1, t.score as s1,
  (select {GRADE} from s) as g0, (select {GRADE} from t) as g1 from s, t)
select cast(seq as int) as seq, metric, before, after, change from (
 select 1 as seq, 'Total Rows' as metric, cast(r0 as varchar) as before, cast(r1 as varchar) as after, format('-{{}} dups', r0 - r1) as change from p
 union all select 2, 'Total Columns', cast(c0 as varchar), cast(c1 as varchar), format('{{}}{{}} cols', case when c1 >= c0 then '+' else '-' end, abs(c1 - c0)) from p
 union all select 3, 'Missing Values', cast(m0 as varchar), cast(m1 as varchar), case when m1 = 0 then 'Resolved 100%' else format('{{}} Remaining', m1) end from p
 union all select 4, 'Duplicate Rows', cast(d0 as varchar), cast(d1 as varchar), format('{{}} Duplicates Remaining', d1) from p
 union all select 5, 'Health Score', concat(s0, '/100 [', g0, ']'), concat(s1, '/100 [', g1, ']'), format('{{}}{{:.1f}} pts', case when s1 >= s0 then '+' else '-' end, abs(s1 - s0)) from p)""")
def dq_before_after(spark, folder):
    raw, result = table(spark, folder, "d_employee"), cleaned(spark, folder, "d_employee")
    return P.before_after(P.dataset_profile(raw), P.dataset_profile(result.table), result.duplicates_removed)


@query("dq_rawclean", with_tables("d_employee", "employee_fill") + f""", c as ({column_counts('d_employee')})
select cast(seq as int) as seq, case seq when 0 then 'emp_id' when 1 then 'department' when 2 then 'salary'
 when 3 then 'experience_yrs' else 'location' end as column_name, missing_count as raw_missing_count,
 concat(missing_pct, '%') as raw_missing_pct, (select case seq when 0 then count(*) - count(emp_id) when 1 then count(*) - count(department)
  when 2 then count(*) - count(salary) when 3 then count(*) - count(experience_yrs) else count(*) - count(location) end from employee_fill) as clean_missing_count,
 coalesce(inferred_type, 'standard') as inferred_type, (select case seq when 2 then lower(typeof(any_value(salary))) when 3 then lower(typeof(any_value(experience_yrs)))
  else 'string' end from employee_fill) as clean_data_type from c""")
def dq_rawclean(spark, folder):
    result = cleaned(spark, folder, "d_employee")
    renames = {new: old for old, new in result.plan.renames}
    return P.raw_vs_clean(P.column_counts(table(spark, folder, "d_employee")), P.column_counts(result.table), renames)


