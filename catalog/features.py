"""Queries over derived columns."""

from __future__ import annotations

from catalog.cleaning import typed
from catalog.dirty import table
from catalog.duck import number, r2, with_tables
from catalog.registry import query
from catalog.shared import enriched
from tablewright.functions.names import find_column
from tablewright.functions.numbers import bin_right
from tablewright.functions.sql import q, rows_of
from tablewright.operators import features as FE
from tablewright.operators.analytics import CATEGORY_KEYS, REVENUE_KEYS


def _parts(spark, folder, *parts):
    """Calendar parts of orders."""
    dated = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderdate as order_date")
    return FE.derive_features(dated)[0].select("o_orderkey", *[f"order_{p}" for p in parts])


@query("fe_prefix", """select o_orderkey, cast(year(o_orderdate) as int) as order_year, cast(year(o_orderdate + interval 30 day) as int) as year,
 cast(year(o_orderdate + interval 60 day) as int) as paid_at_year from orders""")
def fe_prefix(spark, folder):
    dated = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderdate as order_date", "o_orderdate + interval 30 day as date", "o_orderdate + interval 60 day as paid_at")
    return FE.derive_features(dated)[0].select("o_orderkey", "order_year", "year", "paid_at_year")


@query("fe_year", "select o_orderkey, cast(year(o_orderdate) as int) as order_year from orders")
def fe_year(spark, folder):
    return _parts(spark, folder, "year")


@query("fe_month", "select o_orderkey, cast(month(o_orderdate) as int) as order_month from orders")
def fe_month(spark, folder):
    return _parts(spark, folder, "month")


@query("fe_quarter", "select o_orderkey, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as order_quarter from orders")
def fe_quarter(spark, folder):
    return _parts(spark, folder, "quarter")


@query("fe_monthyear", "select o_orderkey, strftime(o_orderdate, '%Y-%m') as order_month_year from orders")
def fe_monthyear(spark, folder):
    return _parts(spark, folder, "month_year")


@query("fe_dayname", "select o_orderkey, dayname(o_orderdate) as order_day_name from orders")
def fe_dayname(spark, folder):
    return _parts(spark, folder, "day_name")


@query("fe_weekend", with_tables("sales_std") + "select order_id, coalesce(isodow(order_date) >= 6, false) as order_is_weekend from sales_std")
def fe_weekend(spark, folder):
    return FE.derive_features(typed(spark, folder, "d_sales", "order_id", "order_date"))[0].select("order_id", "order_is_weekend")


_LINES = "l_orderkey, l_linenumber, l_quantity as quantity, l_extendedprice as unit_price, l_discount * 100 - 1 as discount"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*[c.strip() for c in _LINES.split(",")])


_REVENUE = r2("quantity * unit_price")
_RATE = "case when discount > 1 then discount / 100 else discount end"


@query("fe_revenue", f"select l_orderkey, l_linenumber, {_REVENUE} as revenue from (select {_LINES} from lineitem)")
def fe_revenue(spark, folder):
    return FE.derive_features(_lines(spark, folder).drop("discount"))[0].select("l_orderkey", "l_linenumber", "revenue")


@query("fe_revenue_named", f"""select l_orderkey, revenue, {_REVENUE} as calculated_revenue from (
 select l_orderkey, 1 as revenue, l_quantity as quantity, l_extendedprice as unit_price from lineitem)""")
def fe_revenue_named(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "1 as revenue", "l_quantity as quantity", "l_extendedprice as unit_price")
    return FE.derive_features(rows)[0].select("l_orderkey", "revenue", "calculated_revenue")


@query("fe_discrate", f"select l_orderkey, l_linenumber, {_RATE} as rate from (select {_LINES} from lineitem)")
def fe_discrate(spark, folder):
    return _lines(spark, folder).selectExpr("l_orderkey", "l_linenumber", f"{FE.discount_rate('discount')} as rate")


@query("fe_discamt", f"""select l_orderkey, l_linenumber, {r2(f'revenue * {_RATE}')} as discount_amount
 from (select *, {_REVENUE} as revenue from (select {_LINES} from lineitem))""")
def fe_discamt(spark, folder):
    return FE.derive_features(_lines(spark, folder))[0].select("l_orderkey", "l_linenumber", "discount_amount")


@query("fe_netrev", f"""select l_orderkey, l_linenumber, {r2(f'revenue - {r2(f"revenue * {_RATE}")}')} as net_revenue
 from (select *, {_REVENUE} as revenue from (select {_LINES} from lineitem))""")
def fe_netrev(spark, folder):
    return FE.derive_features(_lines(spark, folder))[0].select("l_orderkey", "l_linenumber", "net_revenue")


_LEDGER = f'select {number(chr(34) + "Gross Revenue" + chr(34))} as gross_revenue, {number(chr(34) + "Operating Cost" + chr(34))} as operating_cost from d_ledger'


@query("fe_profit", with_tables("d_ledger") + f"select gross_revenue, operating_cost, {r2('gross_revenue - operating_cost')} as gross_profit from ({_LEDGER})")
def fe_profit(spark, folder):
    rows = typed(spark, folder, "d_ledger", "gross_revenue", "operating_cost")
    return FE.derive_features(rows)[0].select("gross_revenue", "operating_cost", "gross_profit")


@query("fe_margin", f"""select o_orderkey, case when gross_revenue > 0 then {r2(r2('gross_revenue - operating_cost') + ' / gross_revenue * 100')} else 0.0 end as profit_margin_pct
 from (select o_orderkey, case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as gross_revenue,
 o_totalprice * 0.37 as operating_cost from orders)""")
def fe_margin(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as gross_revenue",
        "o_totalprice * 0.37D as operating_cost")
    return FE.derive_features(rows)[0].select("o_orderkey", "profit_margin_pct")


@query("fe_fullname", with_tables("d_customer") + """select "Customer ID" as customer_id,
 trim(concat(coalesce("First Name", ''), ' ', coalesce("Last Name", ''))) as full_name from d_customer""")
def fe_fullname(spark, folder):
    rows = typed(spark, folder, "d_customer", "customer_id", "first_name", "last_name")
    return FE.derive_features(rows)[0].select("customer_id", "full_name")


@query("fe_credit", with_tables("d_customer") + """select "Customer ID" as customer_id, case when "Credit Score" <= 579 then 'Poor (<580)'
 when "Credit Score" <= 669 then 'Fair (580-669)' when "Credit Score" <= 739 then 'Good (670-739)'
 when "Credit Score" <= 799 then 'Very Good (740-799)' when "Credit Score" > 799 then 'Exceptional (800+)' end as credit_tier from d_customer""")
def fe_credit(spark, folder):
    return FE.derive_features(typed(spark, folder, "d_customer", "customer_id", "credit_score"))[0].select("customer_id", "credit_tier")


@query("fe_exp", with_tables("d_employee") + """select "Emp ID" as emp_id, case when "Experience (Yrs)" <= 2 then 'Junior (0-2 yrs)'
 when "Experience (Yrs)" <= 5 then 'Mid-Level (3-5 yrs)' when "Experience (Yrs)" <= 10 then 'Senior (6-10 yrs)'
 when "Experience (Yrs)" > 10 then 'Lead/Principal (10+ yrs)' end as experience_level from d_employee""")
def fe_exp(spark, folder):
    return FE.derive_features(typed(spark, folder, "d_employee", "emp_id", "experience_yrs"))[0].select("emp_id", "experience_level")


@query("fe_bin", """select p_partkey, case when p_retailprice <= 950 then 'low' when p_retailprice <= 1500.5 then 'middle'
 when p_retailprice > 1500.5 then 'high' end as band from part""")
def fe_bin(spark, folder):
    band = bin_right("p_retailprice", (950, 1500.5), ("low", "middle", "high"))
    return table(spark, folder, "part").selectExpr("p_partkey", f"{band} as band")


@query("fe_all", with_tables("sales_feat") + """select * replace (cast(order_year as double) as order_year,
 cast(order_month as double) as order_month) from sales_feat""")
def fe_all(spark, folder):
    # Whole numbers with gaps compare as doubles.
    sales = enriched(spark, folder, "d_sales_twice")
    return sales.withColumns({c: sales[c].cast("double") for c in ("order_year", "order_month")})


@query("find_col", with_tables("d_ledger", "d_sales") + """select 'revenue' as role, 'gross_revenue' as "column", count("Gross Revenue") as known from d_ledger
 union all select 'category', 'business_unit', count("Business Unit") from d_ledger
 union all select 'category', 'product_category', count("Product Category") from d_sales
 union all select 'price', 'unit_price', count("Unit Price") from d_sales
 union all select 'quantity', 'quantity', count("Quantity") from d_sales""")
def find_col(spark, folder):
    """Types are fitted and values counted once a table, for all roles looked for in it."""
    out = None
    for name, roles in (
        ("d_ledger", {"revenue": REVENUE_KEYS, "category": CATEGORY_KEYS}),
        ("d_sales", {"category": CATEGORY_KEYS, "price": FE.PRICE_KEYS, "quantity": FE.QUANTITY_KEYS}),
    ):
        rows = typed(spark, folder, name)
        found = {role: find_column(rows.columns, keys) for role, keys in roles.items()}
        counted = rows.selectExpr(*[f"count({q(column)}) as {role}" for role, column in found.items()])
        part = counted.selectExpr(rows_of(
            f"struct('{role}' as role, '{column}' as column, {role} as known)" for role, column in found.items()))
        out = part if out is None else out.unionByName(part)
    return out
