"""Building blocks of the comparison SQL (DuckDB dialect), written apart from the Spark code."""

from __future__ import annotations

from catalog.dirty import DUCK

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SYMBOLS = r"[$₹€£¥,%\s]"
PLAIN_SYMBOLS = r"[$₹€£¥,\s]"
PROFILE_DATES = (
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|^[A-Za-z]{3,9}\s+\d{1,2},\s*\d{4}"
    r"|^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}"
)
CLEAN_DATES = (
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|^[a-zA-Z]{3,9}\s+\d{1,2},?\s+\d{4}"
    r"|^\d{1,2}\s+[a-zA-Z]{3,9}\s+\d{4}"
)
POSITIVE = ("price", "unit_price", "quantity", "qty", "amount", "salary", "income", "age", "revenue", "cost", "spend",
            "sales", "experience")

# Column name -> is text, of each dirty table.
COLUMNS = {
    "d_sales": {"Order ID": True, "Order Date": True, "Region": True, "Product Category": True, "Quantity": False,
                "Unit Price": True, "Discount %": True},
    "d_customer": {"Customer ID": True, "First Name": True, "Last Name": True, "Gender": True, "Annual Income": False,
                   "Credit Score": False, "Customer Segment": True, "Account Status": True, "Opted In": True},
    "d_employee": {"Emp ID": True, "Department": True, "Salary": True, "Experience (Yrs)": False, "Location": True},
    "d_ledger": {"Fiscal Quarter": True, "Business Unit": True, "Gross Revenue": True, "Operating Cost": True,
                 "Tax Rate %": True, "Report Status": True},
}
COLUMNS["d_sales_twice"] = COLUMNS["d_sales"]
COLUMNS["employee_fill"] = {"emp_id": True, "department": True, "salary": False, "experience_yrs": False, "location": True}
COLUMNS["readings_known"] = {"line": True, "price": False, "quantity": False, "charge": True}


def r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def rs(x: str, digits: int = 2) -> str:
    """Rounding of single figures: of the exact binary value."""
    return f"cast(format('{{:.{digits}f}}', {x}) as double)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def number(x: str) -> str:
    return f"try_cast(regexp_replace({x}, '{SYMBOLS}', '', 'g') as double)"


def date(x: str) -> str:
    t = trim(x)
    return (f"coalesce(try_strptime({t}, '%Y-%m-%d'), try_strptime({t}, ['%m-%d-%Y', '%d-%m-%Y']), "
            f"try_strptime({t}, ['%m/%d/%Y', '%d/%m/%Y']), try_strptime({t}, '%b %d, %Y'))")


def nulled(x: str) -> str:
    return f"case when lower({trim(x)}) in ('nan','none','null','n/a','','undefined','<na>') then null else {trim(x)} end"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda w: upper(left(w, 1)) || lower(substring(w, 2))), '')")


def boolean(x: str) -> str:
    t = f"lower({trim(x)})"
    return f"case when {t} in ('true','yes','y','1','1.0','t') then true when {t} in ('false','no','n','0','0.0','f') then false end"


def quoted(name: str) -> str:
    return '"' + name + '"'


_REGION = """case lower({0}) when 'north region' then 'North' when 'northern' then 'North' when 'south region' then 'South'
 when 'east region' then 'East' when 'west region' then 'West' else {1} end"""
_GENDER = """case when lower({0}) in ('m','male','m.','man') then 'Male' when lower({0}) in ('f','female','f.','woman')
 then 'Female' else {1} end"""
_ACCOUNT = """case when lower({0}) in ('act','enabled') then 'Active' when lower({0}) in ('inact','disabled') then 'Inactive'
 else {1} end"""


def region(x: str) -> str:
    return _REGION.format(nulled(x), title(nulled(x)))


def gender(x: str) -> str:
    return _GENDER.format(nulled(x), title(nulled(x)))


def account(x: str) -> str:
    return _ACCOUNT.format(nulled(x), title(nulled(x)))


def with_tables(*names: str) -> str:
    """`WITH` clause with the named tables and all they build on, in order."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in wanted:
            return
        body = TABLES[name]
        for other in TABLES:
            if other != name and _mentions(body, other):
                need(other)
        wanted.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{n} as ({TABLES[n]})" for n in wanted) + "\n"


def _mentions(body: str, name: str) -> bool:
    return any(f"{word} {name}{end}" in body for word in ("from", "join", ",") for end in (" ", ")", "\n", ",")) or body.endswith(f"from {name}")


def mode_of(table: str, column: str) -> str:
    return f"(select {column} from {table} where {column} is not null group by 1 order by count(*) desc, 1 limit 1)"


def median_of(table: str, column: str) -> str:
    return f"(select {r2(f'quantile_cont({column}, 0.5)')} from {table})"


def column_counts(table: str) -> str:
    """One SELECT per column with the counts of the profile, stacked."""
    parts = []
    for i, (name, is_text) in enumerate(COLUMNS[table].items()):
        x, key = quoted(name), name.lower().replace(" ", "_")
        checked = any(k in key for k in POSITIVE)
        t = trim(x)
        odd = name != name.lower() or any(c in name for c in " -()%#$/\\")
        if is_text:
            digits = rf"try_cast(regexp_extract(regexp_replace({x}, '[^\d.-]', '', 'g'), '{NUMBER}') as double)"
            counts = [
                f"count(*) filter (where regexp_matches(regexp_replace({t}, '{SYMBOLS}', '', 'g'), '{NUMBER}'))",
                f"count(*) filter (where length({t}) >= 6 and regexp_matches({t}, '{PROFILE_DATES}'))",
                f"count(*) filter (where lower({t}) in ('true','false','yes','no','y','n','0','1'))",
                f"count(*) filter (where {t} = '')",
                f"count(*) filter (where {digits} < 0)" if checked else "0", "0",
            ]
        else:
            counts = ["0", "0", "0", "0", "0", f"count(*) filter (where {x} < 0)" if checked else "0"]
        labels = ("numeric_like", "date_like", "bool_like", "blank_count", "text_neg", "neg")
        listed = ", ".join(f"cast({c} as bigint) as {n}" for c, n in zip(counts, labels))
        parts.append(
            f"select {i} as seq, '{name}' as \"column\", {str(is_text).lower()} as is_text, {str(odd).lower()} as odd, "
            f"count(*) as n, count(*) filter (where {x} is null) as missing_count, {listed}, "
            f"count(distinct {x}) as unique_count from {table}")
    stacked = "\nunion all ".join(parts)
    return f"""
select *, {rs('missing_count / n * 100')} as missing_pct, {rs('unique_count / n * 100')} as unique_pct,
 case when not is_text then null when n = missing_count then 'empty_text'
  when numeric_like / (n - missing_count) >= 0.7 then 'numeric_string (currency/formatted)'
  when date_like / (n - missing_count) >= 0.7 then 'datetime_string'
  when bool_like / (n - missing_count) >= 0.85 then 'boolean_string' else 'text_categorical' end as inferred_type,
 case when is_text then case when n > missing_count and numeric_like / (n - missing_count) >= 0.7 then text_neg else 0 end
  else neg end as negative_count
from ({stacked})"""


def scores(table: str) -> str:
    """One row: the dimensions, score and grade of a table."""
    columns = ", ".join(quoted(c) for c in COLUMNS[table])
    return f"""
select *, {rs('c * 0.35::double + u * 0.25::double + v * 0.25::double + k * 0.15::double', 1)} as score from (
 select *, greatest(0.0, 100 - total_missing_pct * 2) as c, greatest(0.0, 100 - duplicate_pct * 3) as u,
  greatest(0.0, 100 - invalid / (total_rows * total_columns) * 100 * 10) as v,
  greatest(0.0, 100 - (odd / total_columns * 30 + unparsed * 15)) as k from (
  select *, {rs('total_missing / (total_rows * total_columns) * 100')} as total_missing_pct,
   {rs('duplicate_count / total_rows * 100')} as duplicate_pct from (
   select max(n) as total_rows, count(*) as total_columns, cast(sum(missing_count) as bigint) as total_missing,
    sum(negative_count + greatest(blank_count - missing_count, 0)) as invalid, count(*) filter (where odd) as odd,
    count(*) filter (where inferred_type in ('numeric_string (currency/formatted)', 'datetime_string')) as unparsed,
    (select count(*) from {table}) - (select count(*) from (select distinct {columns} from {table})) as duplicate_count
   from ({column_counts(table)}))))"""


GRADE = """case when score >= 90 then 'A+ (Excellent)' when score >= 80 then 'A (Good)' when score >= 70 then 'B (Acceptable)'
 when score >= 50 then 'C (Needs Attention)' else 'D (Critical Data Quality Issues)' end"""

TABLES = {
    **DUCK,
    # Typed, positive and standardised, before missing values are filled.
    "sales_std": f"""select "Order ID" as order_id, {date('"Order Date"')} as order_date, {region('"Region"')} as region,
 {title(nulled('"Product Category"'))} as product_category, abs("Quantity") as quantity, abs({number('"Unit Price"')}) as unit_price,
 {number('"Discount %"')} as discount from d_sales """,
    "sales_fill": f"""select order_id, order_date, coalesce(region, {mode_of('sales_std', 'region')}) as region,
 coalesce(product_category, {mode_of('sales_std', 'product_category')}) as product_category,
 coalesce(quantity, {median_of('sales_std', 'quantity')}) as quantity,
 coalesce(unit_price, {median_of('sales_std', 'unit_price')}) as unit_price,
 coalesce(discount, {median_of('sales_std', 'discount')}) as discount from sales_std """,
    "sales_feat": f"""select *, {r2('revenue - discount_amount')} as net_revenue from (select *,
 {r2('revenue * case when discount > 1 then discount / 100 else discount end')} as discount_amount from (select *,
 cast(year(order_date) as int) as order_year, cast(month(order_date) as int) as order_month,
 case when order_date is not null then concat(year(order_date), 'Q', quarter(order_date)) end as order_quarter,
 strftime(order_date, '%Y-%m') as order_month_year, dayname(order_date) as order_day_name,
 coalesce(isodow(order_date) >= 6, false) as order_is_weekend, {r2('quantity * unit_price')} as revenue from sales_fill)) """,
    # Only finite numbers are known ones.
    "readings_known": """select line, case when isfinite(price) then price end as price, case when isfinite(quantity) then quantity end as quantity,
 charge from d_readings """,
    "readings_std": """select line, price, quantity, case when isfinite(c) then c end as charge
 from (select *, try_cast(charge as double) as c from readings_known) """,
    "employee_std": f"""select "Emp ID" as emp_id, {title(nulled('"Department"'))} as department,
 abs({number('"Salary"')}) as salary, abs("Experience (Yrs)") as experience_yrs, {title(nulled('"Location"'))} as location from d_employee """,
    "employee_fill": f"""select emp_id, coalesce(department, {mode_of('employee_std', 'department')}) as department,
 coalesce(salary, {median_of('employee_std', 'salary')}) as salary,
 coalesce(experience_yrs, {median_of('employee_std', 'experience_yrs')}) as experience_yrs,
 coalesce(location, {mode_of('employee_std', 'location')}) as location from employee_std """,
    "ledger_feat": f"""select *, {r2('gross_revenue - operating_cost')} as gross_profit,
 case when gross_revenue > 0 then {r2(r2('gross_revenue - operating_cost') + ' / gross_revenue * 100')} else 0.0 end as profit_margin_pct
 from (select {title('"Fiscal Quarter"')} as fiscal_quarter, {title('"Business Unit"')} as business_unit,
 {number('"Gross Revenue"')} as gross_revenue, {number('"Operating Cost"')} as operating_cost, {number('"Tax Rate %"')} as tax_rate,
 coalesce({title('"Report Status"')}, (select {title('"Report Status"')} as s from d_ledger where "Report Status" is not null
  group by 1 order by count(*) desc, 1 limit 1)) as report_status from d_ledger) """,
    "customer_std": f"""select "Customer ID" as customer_id, {title(nulled('"First Name"'))} as first_name,
 {title(nulled('"Last Name"'))} as last_name, {gender('"Gender"')} as gender, abs("Annual Income") as annual_income,
 "Credit Score" as credit_score, {title(nulled('"Customer Segment"'))} as customer_segment,
 {account('"Account Status"')} as account_status, {boolean('"Opted In"')} as opted_in from d_customer """,
}
