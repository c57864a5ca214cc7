"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.dirty import table
from catalog.duck import COLUMNS, account, boolean, date, gender, mode_of, nulled, number, quoted, r2, region, rs, title, trim, with_tables
from catalog.registry import query
from catalog.shared import cleaned
from tablewright.operators.dedup import keep_first, remove_duplicates, removal_summary
from tablewright.operators.features import derive_features
from tablewright.operators.fill import fill_ordered
from tablewright.operators.impute import fill_log, fit_missing, handle_missing
from tablewright.operators.outliers import detect_outliers, handle_outliers, outlier_action_counts, outlier_table
from tablewright.operators.standardize import (
    absolute_values, category_changes, clean_names, cleaned_text, negative_counts, standardize_categories, trimmed,
)
from tablewright.operators.types import conversions, convert, day_first_columns, fit_types, type_shares
from tablewright.plans.pipeline import run_pipeline
from tablewright.sources.staging import new_path


def typed(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Snake-case names and fitted types; only the named columns are looked at."""
    named, _ = clean_names(table(spark, folder, name))
    named = named.select(*columns) if columns else named
    return convert(named, fit_types(named))


def standard(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return standardize_categories(absolute_values(typed(spark, folder, name, *columns)))


# --- names, duplicates -------------------------------------------------------------

@query("cl_names", with_tables("d_sales") + """select "Order ID" as order_id, "Order Date" as order_date, "Region" as region,
 "Product Category" as product_category, "Quantity" as quantity, "Unit Price" as unit_price, "Discount %" as discount from d_sales""")
def cl_names(spark, folder):
    return clean_names(table(spark, folder, "d_sales"))[0]


@query("cl_dedup", "select distinct text, lang, source from documents")
def cl_dedup(spark, folder):
    return remove_duplicates(table(spark, folder, "documents").select("text", "lang", "source"))


@query("cl_dedup_counts", with_tables("d_sales_twice") + """select n - d as removed, d as remaining from (
 select (select count(*) from d_sales_twice) as n, (select count(*) from (select distinct * from d_sales_twice)) as d)""")
def cl_dedup_counts(spark, folder):
    sales = table(spark, folder, "d_sales_twice")
    return removal_summary(sales, remove_duplicates(sales))


@query("cl_dedupsub", """select event_id, user_id, event_type, value from (
 select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1""")
def cl_dedupsub(spark, folder):
    first = keep_first(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return first.select("event_id", "user_id", "event_type", "value")


# --- types -------------------------------------------------------------------------

@query("cl_skiptyped", with_tables("d_sales") + 'select "Order ID", "Quantity", cast(null as varchar) as "Notes" from d_sales')
def cl_skiptyped(spark, folder):
    sales = table(spark, folder, "d_sales").selectExpr("`Order ID`", "Quantity", "cast(null as string) as Notes")
    return convert(sales, fit_types(sales))


@query("cl_curr", with_tables("d_sales", "d_employee") + f"""select "Order ID" as id, {number('"Unit Price"')} as amount from d_sales
 union all select "Emp ID", {number('"Salary"')} from d_employee""")
def cl_curr(spark, folder):
    sales = typed(spark, folder, "d_sales", "order_id", "unit_price").toDF("id", "amount")
    return sales.unionByName(typed(spark, folder, "d_employee", "emp_id", "salary").toDF("id", "amount"))


@query("cl_pct", with_tables("d_sales", "d_ledger") + f"""select "Order ID" as id, {number('"Discount %"')} as pct from d_sales
 union all select "Fiscal Quarter", {number('"Tax Rate %"')} from d_ledger""")
def cl_pct(spark, folder):
    sales = typed(spark, folder, "d_sales", "order_id", "discount").toDF("id", "pct")
    return sales.unionByName(typed(spark, folder, "d_ledger", "fiscal_quarter", "tax_rate").toDF("id", "pct"))


@query("cl_date", with_tables("d_sales") + f'select "Order ID" as order_id, {date(chr(34) + "Order Date" + chr(34))} as order_date from d_sales')
def cl_date(spark, folder):
    return typed(spark, folder, "d_sales", "order_id", "order_date")


_DAY, _AT = "date_trunc('day', o_orderdate)::timestamp", "interval 10 hour + interval 30 minute"


def _turned(day_first: bool) -> str:
    """`dd/MM/yyyy`: the month is read first where the day could be one."""
    swapped = "make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 10, 30, 0)"
    return f"{_DAY} + {_AT}" if day_first else f"case when day(o_orderdate) <= 12 then {swapped} else {_DAY} + {_AT} end"


def _layouts(day_first: bool) -> str:
    return f"""select o_orderkey as order_key, case cast(o_orderkey % 8 as int) when 0 then {_DAY} + interval 15 hour
 when 3 then date_trunc('month', o_orderdate)::timestamp when 4 then date_trunc('month', o_orderdate)::timestamp
 when 5 then {_DAY} + {_AT} + interval 1 second + interval 123456 microsecond when 7 then {_turned(day_first)} else {_DAY} end as seen from orders"""


@query("cl_date_layouts", _layouts(False))
def cl_date_layouts(spark, folder):
    return convert(table(spark, folder, "d_dates"), {"seen": "timestamp"})


@query("cl_date_order", _layouts(True))
def cl_date_order(spark, folder):
    """The column's own values say that the day comes first."""
    rows = table(spark, folder, "d_dates")
    return convert(rows, {"seen": "day_first_timestamp" if day_first_columns(rows, ["seen"]) else "timestamp"})


@query("cl_bool", with_tables("d_customer") + f'select "Customer ID" as customer_id, {boolean(chr(34) + "Opted In" + chr(34))} as opted_in from d_customer')
def cl_bool(spark, folder):
    return typed(spark, folder, "d_customer", "customer_id", "opted_in")


@query("cl_tz", "select o_orderkey, o_orderdate from orders")
def cl_tz(spark, folder):
    zoned = table(spark, folder, "orders").selectExpr("o_orderkey", "cast(o_orderdate as timestamp_ltz) as o_orderdate")
    return convert(zoned, {})


def _target(name: str, seq: int, table_name: str) -> str:
    x = f'"{name}"'
    return f"""select {seq} as seq, '{name}' as "column", count({x}) as known,
 count(*) filter (where {trim(x)} like '%\\%' escape '\\') as percent,
 count(try_cast(regexp_replace({x}, '[$₹€£¥,\\s]', '', 'g') as double)) as plain_numbers, count({number(x)}) as numbers,
 count(*) filter (where lower({trim(x)}) in ('true','yes','y','1','1.0','t','false','no','n','0','0.0','f')) as booleans from {table_name}"""


@query("cl_types", with_tables("d_customer") + "\nunion all ".join(
    _target(n, i, "d_customer") for i, n in enumerate(
        ("Customer ID", "First Name", "Last Name", "Gender", "Customer Segment", "Account Status", "Opted In"))))
def cl_types(spark, folder):
    return type_shares(table(spark, folder, "d_customer")).drop("date_like")


@query("cl_conversions", """select 'Order Date' as "column", 'Datetime (Parsed multi-format dates)' as conversion, count(*) as "rows" from lineitem
 union all select 'Unit Price', 'Float (Cleaned from Currency/Formatted Text)', count(*) from lineitem
 union all select 'Discount %', 'Float (Cleaned from Currency/Formatted Text)', count(*) from lineitem""")
def cl_conversions(spark, folder):
    sales = table(spark, folder, "d_sales")
    rows = sales.selectExpr("count(1)").scalar()
    return conversions(sales, fit_types(sales)).drop("seq").withColumn("rows", rows)


# --- categories, signs -------------------------------------------------------------

@query("cl_nulltok", with_tables("d_customer", "d_sales") + f"""select "Customer ID" as id, {nulled('"Gender"')} as v from d_customer
 union all select "Order ID", {nulled('"Region"')} from d_sales""")
def cl_nulltok(spark, folder):
    customers = cleaned_text(table(spark, folder, "d_customer").select("Customer ID", "Gender")).toDF("id", "v")
    return customers.unionByName(cleaned_text(table(spark, folder, "d_sales").select("Order ID", "Region")).toDF("id", "v"))


@query("cl_trim", with_tables("d_sales") + f"""select "Order ID", {trim('"Region"')} as "Region", {trim('"Unit Price"')} as "Unit Price" from d_sales""")
def cl_trim(spark, folder):
    return trimmed(table(spark, folder, "d_sales").select("Order ID", "Region", "Unit Price"))


@query("cl_map", with_tables("d_sales", "d_customer", "d_ledger") + f"""select "Order ID" as id, 'region' as field, {region('"Region"')} as v from d_sales
 union all select "Customer ID", 'gender', {gender('"Gender"')} from d_customer
 union all select "Customer ID", 'account', {account('"Account Status"')} from d_customer
 union all select "Customer ID", 'segment', {title('"Customer Segment"')} from d_customer
 union all select "Fiscal Quarter", 'status', {title('"Report Status"')} from d_ledger""")
def cl_map(spark, folder):
    def field(name, key, column, label):
        out = standardize_categories(table(spark, folder, name).select(key, column))
        return out.selectExpr(f"`{key}` as id", f"'{label}' as field", f"`{column}` as v")

    return (
        field("d_sales", "Order ID", "Region", "region").unionByName(field("d_customer", "Customer ID", "Gender", "gender"))
        .unionByName(field("d_customer", "Customer ID", "Account Status", "account"))
        .unionByName(field("d_customer", "Customer ID", "Customer Segment", "segment"))
        .unionByName(field("d_ledger", "Fiscal Quarter", "Report Status", "status"))
    )


@query("cl_custommap", with_tables("d_employee") + f"""select "Emp ID", case lower("Department") when 'hr' then 'Human Resources'
 when 'sales' then 'Revenue' else {title('"Department"')} end as "Department" from d_employee""")
def cl_custommap(spark, folder):
    rules = {"department": {"hr": "Human Resources", "sales": "Revenue"}}
    return standardize_categories(table(spark, folder, "d_employee").select("Emp ID", "Department"), rules)


@query("cl_title", with_tables("d_sales", "d_ledger") + f"""select "Order ID" as id, {title('"Product Category"')} as v from d_sales
 union all select "Fiscal Quarter", {title('"Business Unit"')} from d_ledger""")
def cl_title(spark, folder):
    sales = standardize_categories(table(spark, folder, "d_sales").select("Order ID", "Product Category")).toDF("id", "v")
    ledger = standardize_categories(table(spark, folder, "d_ledger").select("Fiscal Quarter", "Business Unit")).toDF("id", "v")
    return sales.unionByName(ledger)


def _changed(name: str, before: str, after: str, source: str) -> str:
    return f"""select '{name}' as "column", count(*) filter (where {before} is distinct from {after} or {before} is null) as changes
 from {source}"""


@query("cl_changes", with_tables("d_employee") + "select * from (" + " union all ".join([
    _changed("Department", nulled('"Department"'), title(nulled('"Department"')), "d_employee"),
    _changed("Salary", nulled('"Salary"'), nulled('"Salary"'), "d_employee"),
    _changed("Location", nulled('"Location"'), title(nulled('"Location"')), "d_employee")]) + ") where changes > 0 union all "
    + """select 'Emp ID', count(*) from d_employee where upper(left("Emp ID", 3)) <> left("Emp ID", 3) having count(*) > 0""")
def cl_changes(spark, folder):
    return category_changes(table(spark, folder, "d_employee"))


@query("cl_abs", with_tables("d_sales") + f"""select "Order ID" as order_id, abs("Quantity") as quantity,
 abs({number('"Unit Price"')}) as unit_price from d_sales""")
def cl_abs(spark, folder):
    return absolute_values(typed(spark, folder, "d_sales", "order_id", "quantity", "unit_price"))


@query("cl_abs_counts", with_tables("d_sales") + f"""select 'quantity' as "column", count(*) filter (where "Quantity" < 0) as negatives_fixed from d_sales
 union all select 'unit_price', count(*) filter (where {number('"Unit Price"')} < 0) from d_sales""")
def cl_abs_counts(spark, folder):
    return negative_counts(typed(spark, folder, "d_sales", "quantity", "unit_price"))


# --- missing values ----------------------------------------------------------------

_EMP = ("emp_id", "salary", "experience_yrs")


def _filled(column_sql: dict[str, str], key: str, source: str) -> str:
    shown = ", ".join(f"coalesce({c}, {e}) as {c}" for c, e in column_sql.items())
    return with_tables(source) + f"select {key}, {shown} from {source}"


def _stat(expression: str, source: str = "employee_std") -> str:
    return f"(select {r2(expression)} from {source})"


@query("imp_skip", with_tables("employee_std") + """select * from (
 select 'emp_id' as "column", count(*) filter (where emp_id is null) as affected from employee_std
 union all select 'department', count(*) filter (where department is null) from employee_std
 union all select 'salary', count(*) filter (where salary is null) from employee_std
 union all select 'experience_yrs', count(*) filter (where experience_yrs is null) from employee_std
 union all select 'location', count(*) filter (where location is null) from employee_std) where affected > 0""")
def imp_skip(spark, folder):
    employees = standard(spark, folder, "d_employee")
    return fill_log(employees, fit_missing(employees)).select("column", "affected")


@query("imp_custom", with_tables("employee_std") + f"""select emp_id, coalesce(salary, 0) as salary,
 coalesce(experience_yrs, {_stat('avg(experience_yrs)')}) as experience_yrs, coalesce(department, 'Unknown') as department from employee_std""")
def imp_custom(spark, folder):
    employees = standard(spark, folder, "d_employee", *_EMP, "department")
    return handle_missing(employees, custom={"salary": "zero", "experience_yrs": "mean", "department": "constant_unknown"})[0]


@query("imp_median", _filled({"salary": _stat("quantile_cont(salary, 0.5)"),
                              "experience_yrs": _stat("quantile_cont(experience_yrs, 0.5)")}, "emp_id", "employee_std"))
def imp_median(spark, folder):
    return handle_missing(standard(spark, folder, "d_employee", *_EMP), numeric="median")[0]


@query("imp_mean", _filled({"salary": _stat("avg(salary)"), "experience_yrs": _stat("avg(experience_yrs)")}, "emp_id", "employee_std"))
def imp_mean(spark, folder):
    return handle_missing(standard(spark, folder, "d_employee", *_EMP), numeric="mean")[0]


@query("imp_nan", _filled({c: _stat(f"quantile_cont({c}, 0.5)", "readings_std") for c in ("price", "quantity", "charge")}, "line", "readings_std"))
def imp_nan(spark, folder):
    readings = table(spark, folder, "d_readings")
    return handle_missing(convert(readings, fit_types(readings)))[0]


@query("imp_nan_mean", _filled({c: _stat(f"avg({c})", "readings_std") for c in ("price", "quantity", "charge")}, "line", "readings_std"))
def imp_nan_mean(spark, folder):
    readings = table(spark, folder, "d_readings")
    return handle_missing(convert(readings, fit_types(readings)), numeric="mean")[0]


@query("imp_zero", _filled({"salary": "0", "experience_yrs": "0"}, "emp_id", "employee_std"))
def imp_zero(spark, folder):
    return handle_missing(standard(spark, folder, "d_employee", *_EMP), numeric="zero")[0]


@query("imp_ffill", with_tables("d_gaps") + """select event_id, coalesce(last_value(reading ignore nulls) over (order by event_id rows unbounded preceding),
 first_value(reading ignore nulls) over (order by event_id rows between current row and unbounded following)) as reading from d_gaps""")
def imp_ffill(spark, folder):
    gaps = table(spark, folder, "d_gaps").select("event_id", "reading")
    return handle_missing(gaps, numeric="forward_fill", order_by=["event_id"])[0]


_HOT = "case when event_id % 3 = 0 then 0 else user_id end"


@query("imp_ffill_hot", with_tables("d_gaps") + f"""select event_id, grp, coalesce(last_value(reading ignore nulls) over w, first_value(reading ignore nulls) over (
 partition by grp order by event_id rows between current row and unbounded following)) as reading
 from (select event_id, {_HOT} as grp, reading from d_gaps) window w as (partition by grp order by event_id rows unbounded preceding)""")
def imp_ffill_hot(spark, folder):
    """One group holds a third of all rows; buckets are short, so that it spans many of them."""
    gaps = table(spark, folder, "d_gaps").selectExpr("event_id", f"{_HOT} as grp", "reading")
    return fill_ordered(gaps, ["reading"], ["event_id"], ["grp"], rows_per_bucket=500)


@query("imp_drop", with_tables("employee_std") + """select emp_id, department, salary, experience_yrs, location,
 (select count(*) from employee_std where department is null) as dropped_department,
 (select count(*) from employee_std where department is not null and salary is null) as dropped_salary,
 (select count(*) from employee_std where department is not null and salary is not null and experience_yrs is null) as dropped_experience
 from employee_std where department is not null and salary is not null and experience_yrs is not null and location is not null""")
def imp_drop(spark, folder):
    out, fills = handle_missing(standard(spark, folder, "d_employee"), numeric="drop_row", categorical="drop_row")
    counts = {f.column: f.count for f in fills}
    return out.selectExpr("*", f"{counts['department']}L as dropped_department", f"{counts['salary']}L as dropped_salary",
                          f"{counts['experience_yrs']}L as dropped_experience")


@query("imp_bool", with_tables("customer_std") + """select customer_id, coalesce(opted_in,
 (select count(*) filter (where opted_in) > count(*) filter (where not opted_in) from customer_std)) as opted_in from customer_std""")
def imp_bool(spark, folder):
    return handle_missing(typed(spark, folder, "d_customer", "customer_id", "opted_in"))[0]


_TIER = """case when credit_score <= 579 then 'Poor (<580)' when credit_score <= 669 then 'Fair (580-669)'
 when credit_score <= 739 then 'Good (670-739)' when credit_score <= 799 then 'Very Good (740-799)'
 when credit_score > 799 then 'Exceptional (800+)' end"""


@query("imp_categ", with_tables("customer_std") + f""", t as (select customer_id, {_TIER} as credit_tier from customer_std)
select customer_id, coalesce(credit_tier, {mode_of('t', 'credit_tier')}) as credit_tier from t""")
def imp_categ(spark, folder):
    tiers = derive_features(typed(spark, folder, "d_customer", "customer_id", "credit_score"))[0]
    return handle_missing(tiers.select("customer_id", "credit_tier"), categorical="mode")[0]


_SIZE = "case cast(c_custkey % 6 as int) when 0 then 'Small' when 1 then 'Small' when 2 then 'Medium' when 3 then 'Medium' when 4 then 'Large' end"


@query("imp_categ_order", f"""with t as (select c_custkey, {_SIZE} as size from customer)
select c_custkey, coalesce(size, (select size from t where size is not null group by 1
 order by count(*) desc, case size when 'Small' then 1 when 'Medium' then 2 else 3 end limit 1)) as size from t""")
def imp_categ_order(spark, folder):
    """Sizes have an order that is not the alphabet's; it decides between equally frequent ones."""
    sizes = table(spark, folder, "customer").selectExpr("c_custkey", f"{_SIZE} as size")
    return handle_missing(sizes, categorical="mode", categories={"size": ["Small", "Medium", "Large"]})[0]


@query("imp_mode", _filled({"region": mode_of("sales_std", "region"), "product_category": mode_of("sales_std", "product_category")},
                           "order_id", "sales_std"))
def imp_mode(spark, folder):
    return handle_missing(standard(spark, folder, "d_sales", "order_id", "region", "product_category"), categorical="mode")[0]


@query("imp_modeunk", with_tables("sales_std") + f""", t as (select order_id, region,
 case when month(order_date) = 3 then null else strftime(order_date, '%Y-%m') end as month_key from sales_std)
select order_id, coalesce(region, {mode_of('t', 'region')}) as region,
 coalesce(month_key, case when (select count(distinct month_key) from t) < 20 then {mode_of('t', 'month_key')} else 'Unknown' end) as month_key from t""")
def imp_modeunk(spark, folder):
    sales = standard(spark, folder, "d_sales", "order_id", "order_date", "region").selectExpr(
        "order_id", "region", "if(month(order_date) = 3, null, date_format(order_date, 'yyyy-MM')) as month_key")
    return handle_missing(sales, categorical="mode_or_unknown")[0]


@query("imp_const", _filled({"region": "'Unknown'", "product_category": "'Unknown'"}, "order_id", "sales_std"))
def imp_const(spark, folder):
    sales = standard(spark, folder, "d_sales", "order_id", "region", "product_category")
    return handle_missing(sales, categorical="constant_unknown")[0]


@query("imp_datekeep", with_tables("sales_std") + """select 'order_date' as "column", 'retained NaT (safe date handling)' as strategy,
 count(*) filter (where order_date is null) as affected from sales_std""")
def imp_datekeep(spark, folder):
    sales = typed(spark, folder, "d_sales", "order_id", "order_date")
    return fill_log(sales, fit_missing(sales)).select("column", "strategy", "affected")


@query("imp_dateffill", with_tables("d_gaps") + """select event_id, user_id, coalesce(
 last_value(seen_at ignore nulls) over (partition by user_id order by event_id rows unbounded preceding),
 first_value(seen_at ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following)) as seen_at from d_gaps""")
def imp_dateffill(spark, folder):
    gaps = table(spark, folder, "d_gaps").select("event_id", "user_id", "seen_at")
    return handle_missing(gaps, date="forward_fill", order_by=["event_id"], partition_by=["user_id"])[0]


@query("imp_ffill_buckets", with_tables("d_gaps") + """select event_id, event_type, coalesce(
 last_value(reading ignore nulls) over (partition by event_type order by event_id rows unbounded preceding),
 first_value(reading ignore nulls) over (partition by event_type order by event_id rows between current row and unbounded following)) as reading from d_gaps""")
def imp_ffill_buckets(spark, folder):
    gaps = table(spark, folder, "d_gaps").select("event_id", "event_type", "reading")
    return fill_ordered(gaps, ["reading"], ["event_id"], ["event_type"], rows_per_bucket=1_000)


@query("imp_fallback", """select c_custkey, cast(0 as double) as bonus, coalesce(grade, cast(round_even(
 (select round_even(quantile_cont(grade, 0.5) * 100, 0) / 100 from (select case when c_custkey % 3 = 0 then null else c_nationkey end as grade from customer)), 0) as int)) as grade
 from (select c_custkey, case when c_custkey % 3 = 0 then null else c_nationkey end as grade from customer)""")
def imp_fallback(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "c_custkey", "cast(null as double) as bonus", "if(c_custkey % 3 = 0, null, c_nationkey) as grade")
    return handle_missing(rows)[0]


# --- outliers ----------------------------------------------------------------------

def _bounds(source: str, columns: tuple[str, ...], zscore: bool = False) -> str:
    parts = []
    for c in columns:
        if zscore:
            limits = f"avg({c}) as m, stddev_samp({c}) as s"
            low, high, out = r2("m - 1.5 * s"), r2("m + 1.5 * s"), f"abs(({c} - m) / s) > 1.5"
            wide = "s > 0"
        else:
            limits = f"quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3"
            low, high = r2("q1 - 1.5 * (q3 - q1)"), r2("q3 + 1.5 * (q3 - q1)")
            out, wide = f"{c} < lower_bound or {c} > upper_bound", "q3 > q1"
        extra = "m, s," if zscore else ""
        parts.append(f"""select '{c}' as "column", '{'zscore' if zscore else 'iqr'}' as method, count(*) filter (where {out}) as outlier_count,
 {rs(f'count(*) filter (where {out}) / count({c}) * 100')} as outlier_pct, any_value(lower_bound) as lower_bound, any_value(upper_bound) as upper_bound
 from {source}, (select {extra} {low} as lower_bound, {high} as upper_bound from (select {limits} from {source}) where {wide})
 having count(*) filter (where {out}) > 0 and count({c}) >= 5 and count(distinct {c}) > 2""")
    return " union all ".join(parts)


_PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("out_iqr", with_tables("employee_std") + _bounds("lineitem", _PRICES) + " union all " + _bounds("employee_std", ("salary", "experience_yrs")))
def out_iqr(spark, folder):
    items = table(spark, folder, "lineitem").select(*_PRICES)
    employees = standard(spark, folder, "d_employee", "salary", "experience_yrs")
    return outlier_table(items, detect_outliers(items) + detect_outliers(employees)).drop("seq")


@query("out_z", with_tables("employee_std") + _bounds("lineitem", _PRICES, zscore=True) + " union all "
       + _bounds("employee_std", ("salary", "experience_yrs"), zscore=True))
def out_z(spark, folder):
    items = table(spark, folder, "lineitem").select(*_PRICES)
    employees = standard(spark, folder, "d_employee", "salary", "experience_yrs")
    return outlier_table(items, detect_outliers(items, "zscore") + detect_outliers(employees, "zscore")).drop("seq")


@query("out_nan", with_tables("readings_std") + _bounds("readings_std", ("price", "quantity", "charge")) + " union all "
       + _bounds("readings_std", ("price", "quantity", "charge"), zscore=True))
def out_nan(spark, folder):
    readings = table(spark, folder, "d_readings")
    numbers = convert(readings, fit_types(readings))
    return outlier_table(numbers, detect_outliers(numbers) + detect_outliers(numbers, "zscore")).drop("seq")


_LIMITS = f""", b as (select {r2('q1 - 1.5 * (q3 - q1)')} as lo, {r2('q3 + 1.5 * (q3 - q1)')} as hi from (
 select quantile_cont(salary, 0.25) as q1, quantile_cont(salary, 0.75) as q3 from employee_std))"""


def _salaries(spark: SparkSession, folder: str) -> DataFrame:
    return standard(spark, folder, "d_employee", "emp_id", "salary")


@query("out_keep", with_tables("employee_std") + "select emp_id, salary from employee_std")
def out_keep(spark, folder):
    rows = _salaries(spark, folder)
    return handle_outliers(rows, detect_outliers(rows), "keep")


@query("out_cap", with_tables("employee_std") + _LIMITS + """ select emp_id, case when salary is null then null
 else greatest(least(salary, hi), lo) end as salary,
 (select count(*) filter (where salary < lo or salary > hi or salary is null) from employee_std, b) as changed from employee_std, b""")
def out_cap(spark, folder):
    rows = _salaries(spark, folder)
    bounds = detect_outliers(rows)
    changed = outlier_action_counts(rows, bounds, "cap", columns=["salary"])["salary"]
    return handle_outliers(rows, bounds, "cap").selectExpr("*", f"{changed}L as changed")


@query("out_remove", with_tables("employee_std") + _LIMITS + """ select emp_id, salary,
 (select count(*) filter (where salary < lo or salary > hi) from employee_std, b) as removed
 from employee_std, b where salary is null or salary between lo and hi""")
def out_remove(spark, folder):
    rows = _salaries(spark, folder)
    bounds = detect_outliers(rows)
    removed = outlier_action_counts(rows, bounds, "remove", columns=["salary"])["salary"]
    return handle_outliers(rows, bounds, "remove").selectExpr("*", f"{removed}L as removed")


# --- the whole run -----------------------------------------------------------------

@query("pipe_clean", with_tables("sales_fill") + "select * from sales_fill")
def pipe_clean(spark, folder):
    return cleaned(spark, folder, "d_sales_twice").table


_FILLED = {"region": "mode_or_unknown", "product_category": "mode_or_unknown", "quantity": "median", "unit_price": "median", "discount": "median"}
_LABELS = {"timestamp": "Datetime (Parsed multi-format dates)", "number": "Float (Cleaned from Currency/Formatted Text)"}


def _audit_sql() -> str:
    """Every step of a run over the sales table that holds copies, in order: k is the place, then the place within the step."""
    names = list(COLUMNS["d_sales"])
    clean = dict(zip(names, ("order_id", "order_date", "region", "product_category", "quantity", "unit_price", "discount")))
    parts: dict[str, list[str]] = {}

    def row(step: str, source: str, column="null", action="null", affected="null", fill="null", lower="null", upper="null", text="null") -> None:
        parts.setdefault(step, []).append(
            f"select {len(parts)} as k, {len(parts[step]) if step in parts else 0} as j, '{step}' as step, cast({column} as varchar) as \"column\", "
            f"cast({action} as varchar) as action, cast({affected} as bigint) as affected, cast({fill} as varchar) as fill_value, "
            f"cast({lower} as double) as lower, cast({upper} as double) as upper, cast({text} as varchar) as description {source}")

    def summed(step: str, text: str, groups: str = "count(*)", label: bool = True) -> None:
        """The sentence before the rows of a step, over those rows."""
        own = " union all ".join(parts[step])
        total = "sum(affected)" if label else "count(*)"
        parts[step].insert(0, f"select any_value(k), -1, '{step}', null, null, cast({total} as bigint), null, null, null, {text} from ({own}) having count(*) > 0")

    n, d = "(select count(*) from d_sales_twice)", "(select count(*) from (select distinct * from d_sales_twice))"
    row("initial_shape", "", affected=n, text=f"format('{{}} x {len(names)}', {n})")
    for old in names:
        row("names", f"from (describe d_sales_twice) as x(own, t, a, b, c, e) where own = '{old}'", column=f"'{clean[old]}'", action="'renamed'", text="own")
    summed("names", "format('Standardized {} column headers to snake_case.', count(*))", label=False)
    row("duplicates", f"where {n} > {d}", affected=f"{n} - {d}", text=f"format('Removed {{}} duplicate rows ({{}} rows remaining).', {n} - {d}, {d})")
    for old, known in COLUMNS["d_sales"].items():
        if known:
            x = quoted(old)
            numbers = f"count(case when {x} like '%\\%' escape '\\' then {number(x)} else try_cast(regexp_replace({x}, '[$₹€£¥,\\s]', '', 'g') as double) end)"
            row("types", f"from (select case when {numbers} / count({x}) >= 0.75 then 'number' when count({date(x)}) / count({x}) >= 0.5 then 'timestamp' end as kind "
                f"from d_sales) where kind is not null", column=f"'{clean[old]}'", action="kind",
                text="case kind when 'number' then '{number}' else '{timestamp}' end".format(**_LABELS))
    summed("types", "format('Parsed and converted data types for {} columns.', count(*))", label=False)
    for c, test in (("quantity", '"Quantity" < 0'), ("unit_price", f"{number(chr(34) + 'Unit Price' + chr(34))} < 0")):
        row("negatives", f"from (select count(*) filter (where {test}) as m from d_sales) where m > 0", f"'{c}'", "'absolute'", "m")
    summed("negatives", "format('Corrected {} negative values across {} numeric fields.', sum(affected), count(*))")
    for c, after in (("region", region('"Region"')), ("product_category", title(nulled('"Product Category"')))):
        before = nulled(quoted({v: k for k, v in clean.items()}[c]))
        row("categories", f"from (select count(*) filter (where {before} is distinct from {after} or {before} is null) as m from d_sales) where m > 0",
            f"'{c}'", "'standardized'", "m")
    summed("categories", "format('Standardized casing and text domains across {} categorical columns ({} values adjusted).', count(*), sum(affected))")
    for c in clean.values():
        fill = "null" if c not in _FILLED else mode_of("sales_std", c) if _FILLED[c] == "mode_or_unknown" else f"(select {r2(f'quantile_cont({c}, 0.5)')} from sales_std)"
        row("missing", f"from (select count(*) filter (where {c} is null) as m from sales_std) where m > 0", f"'{c}'",
            f"'{_FILLED.get(c, 'retained NaT (safe date handling)')}'", "m", fill)
    summed("missing", "format('Handled missing values across {} columns using intelligent imputation strategies.', count(*))", label=False)
    for c in ("quantity", "unit_price", "discount"):
        row("outliers", f"from ({_bounds('sales_fill', (c,))})", f"'{c}'", "method", "outlier_count", lower="lower_bound", upper="upper_bound")
    row("final_shape", "", affected="(select count(*) from sales_fill)", text=f"format('{{}} x {len(names)}', (select count(*) from sales_fill))")
    stacked = " union all ".join(p for group in parts.values() for p in group)
    return with_tables("sales_fill", "d_sales_twice") + (
        f"select cast(row_number() over (order by k, j) as int) as seq, step, \"column\", action, affected, fill_value, lower, upper, description from ({stacked})")


@query("pipe_audit", _audit_sql())
def pipe_audit(spark, folder):
    return cleaned(spark, folder, "d_sales_twice").audit()


@query("pipe_run", with_tables("sales_feat") + "select * from sales_feat")
def pipe_run(spark, folder):
    """The enriched table of a whole run, read back from its export."""
    run = run_pipeline(table(spark, folder, "d_sales_twice"), export=new_path(spark, "export"), file_format="parquet")
    return spark.read.parquet(run.exported)
