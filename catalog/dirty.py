"""Dirty business tables derived from the given ones, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.staging import spread

_SALES = """
select concat('ORD-', cast(l_orderkey as {S}), '-', cast(l_linenumber as {S})) as {q}Order ID{q},
 case cast((l_orderkey + l_linenumber) % 6 as int) when 0 then {iso} when 1 then {dmy} when 2 then {mdy}
  when 3 then {verb} when 4 then 'Unknown Date' end as {q}Order Date{q},
 case cast(l_suppkey % 9 as int) when 0 then 'North' when 1 then 'north' when 2 then 'NORTH' when 3 then 'North Region'
  when 4 then 'south' when 5 then ' East ' when 6 then 'WEST' when 7 then '   ' end as {q}Region{q},
 case cast(l_partkey % 7 as int) when 0 then 'Electronics' when 1 then 'electronics' when 2 then 'FURNITURE'
  when 3 then 'office supplies' when 4 then 'Clothing' when 5 then 'noise-cancelling 4k' end as {q}Product Category{q},
 case when l_partkey % 13 = 0 then -l_quantity when l_partkey % 17 = 0 then null when l_partkey % 101 = 0 then 500.0
  else l_quantity end as {q}Quantity{q},
 case cast(l_linenumber % 5 as int) when 0 then concat('$', cast(cast(floor(l_extendedprice) as bigint) as {S}), '.50')
  when 1 then concat('₹ ', cast(cast(floor(l_extendedprice/1000) as bigint) as {S}), ',',
   lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as {S}), 3, '0'))
  when 2 then concat('  ', cast(cast(floor(l_extendedprice) as bigint) as {S}), '  ')
  when 3 then concat('-', cast(cast(floor(l_extendedprice) as bigint) as {S})) end as {q}Unit Price{q},
 case when l_orderkey % 11 = 0 then null else concat(cast(cast(round(l_discount*100) as int) as {S}), '%') end as {q}Discount %{q}
 from lineitem
"""
_CUSTOMER = """
select concat('CUST-', cast(c_custkey as {S})) as {q}Customer ID{q},
 case when c_custkey % 10 = 0 then null when c_custkey % 2 = 0 then 'aarav' else 'DIYA' end as {q}First Name{q},
 case when c_custkey % 9 = 0 then null else 'Sharma' end as {q}Last Name{q},
 case cast(c_custkey % 8 as int) when 0 then 'M' when 1 then 'male' when 2 then 'MALE' when 3 then 'F' when 4 then 'female'
  when 5 then 'Unknown' when 6 then 'N/A' end as {q}Gender{q},
 case when c_custkey % 12 = 0 then null else cast(c_acctbal as double) end as {q}Annual Income{q},
 case when c_custkey % 15 = 0 then null else cast(500 + c_custkey % 400 as int) end as {q}Credit Score{q},
 lower(c_mktsegment) as {q}Customer Segment{q},
 case cast(c_custkey % 6 as int) when 0 then 'active' when 1 then 'ACT' when 2 then 'disabled' when 3 then 'pending'
  when 4 then 'Suspended' end as {q}Account Status{q},
 case cast(c_custkey % 5 as int) when 0 then 'yes' when 1 then 'No' when 2 then 'TRUE' when 3 then 'f' end as {q}Opted In{q}
 from customer
"""
_EMPLOYEE = """
select concat('EMP-', cast(c_custkey as {S})) as {q}Emp ID{q},
 case cast(c_custkey % 6 as int) when 0 then 'Engineering' when 1 then 'engineering' when 2 then 'SALES' when 3 then 'finance'
  when 4 then 'HR' end as {q}Department{q},
 case cast(c_custkey % 7 as int) when 0 then '$85,000' when 1 then '₹14,50,000' when 2 then ' 95000 ' when 3 then '-5000'
  when 4 then null else cast(40000 + c_custkey as {S}) end as {q}Salary{q},
 case when c_custkey % 10 = 0 then null when c_custkey % 23 = 0 then -1.0 else cast(c_custkey % 16 as double) end
  as {q}Experience (Yrs){q},
 case cast(c_custkey % 4 as int) when 0 then 'Remote' when 1 then 'REMOTE' when 2 then 'pune' end as {q}Location{q}
 from customer
"""
_LEDGER = """
select concat('Q', cast(quarter(o_orderdate) as {S}), '-', cast(year(o_orderdate) as {S})) as {q}Fiscal Quarter{q},
 o_orderpriority as {q}Business Unit{q},
 case when o_orderkey % 5 = 0 then cast(cast(floor(o_totalprice) as bigint) as {S})
  else concat('$', cast(cast(floor(o_totalprice) as bigint) as {S}), '.00') end as {q}Gross Revenue{q},
 concat('$', cast(cast(floor(o_totalprice * 0.6) as bigint) as {S})) as {q}Operating Cost{q},
 case when o_orderkey % 5 = 0 then '0.18' else '18%' end as {q}Tax Rate %{q},
 case o_orderstatus when 'P' then 'pending' when 'F' then 'audited' else null end as {q}Report Status{q}
 from orders
"""
# Every row of the table, and some of them a second time.
_SALES_TWICE = "{sales} union all {sales_base} where l_orderkey % 50 = 0"
# Every fifth reading lost its value and its time.
_GAPS = """
select event_id, user_id, event_type, case when event_id % 5 = 0 then null else ts end as seen_at,
 case when event_id % 5 = 0 then null else value end as reading from events
"""
# One date a row, in the layouts people write it in.
_DATES = """
select o_orderkey as order_key, case cast(o_orderkey % 8 as int) when 0 then concat({verb_o}, ' 3:00 PM') when 1 then {short_o} when 2 then {week_o}
 when 3 then {month_o} when 4 then {year_month_o} when 5 then concat({iso_o}, ' 10:30:01.123456789') when 6 then {compact_o}
 else concat({dmy_o}, ' 10:30') end as seen from orders
"""
# Readings that are no numbers: NaN, infinite, beyond any double, or missing.
_READINGS = """
select concat(cast(l_orderkey as {S}), '-', cast(l_linenumber as {S})) as line,
 case cast(l_orderkey % 11 as int) when 1 then {nan} when 2 then {inf} when 3 then -{inf} when 4 then null else cast(l_extendedprice as double) end as price,
 case cast(l_orderkey % 13 as int) when 1 then {nan} else cast(l_quantity as double) end as quantity,
 case cast(l_orderkey % 7 as int) when 1 then '1e400' when 2 then '-1e999' when 3 then null
  else cast(cast(floor(l_extendedprice) as bigint) as {S}) end as charge
 from lineitem
"""
_SPARK = {
    "S": "string", "q": "`", "nan": "double('NaN')", "inf": "double('Infinity')", "iso": "date_format(l_shipdate,'yyyy-MM-dd')", "dmy": "date_format(l_shipdate,'dd/MM/yyyy')",
    "mdy": "date_format(l_shipdate,'MM-dd-yyyy')", "verb": "date_format(l_shipdate,'MMM dd, yyyy')",
}
_LAYOUTS = {
    "verb_o": ("MMM dd, yyyy", "%b %d, %Y"), "short_o": ("dd-MMM-yy", "%d-%b-%y"), "week_o": ("EEE, dd MMM yyyy", "%a, %d %b %Y"),
    "month_o": ("MMM yyyy", "%b %Y"), "year_month_o": ("yyyy-MM", "%Y-%m"), "iso_o": ("yyyy-MM-dd", "%Y-%m-%d"),
    "compact_o": ("yyyyMMdd", "%Y%m%d"), "dmy_o": ("dd/MM/yyyy", "%d/%m/%Y"),
}
_SPARK |= {k: f"date_format(o_orderdate, '{v}')" for k, (v, _) in _LAYOUTS.items()}
_DUCK = {
    "S": "varchar", "q": '"', "nan": "'nan'::double", "inf": "'inf'::double", "iso": "strftime(l_shipdate,'%Y-%m-%d')", "dmy": "strftime(l_shipdate,'%d/%m/%Y')",
    "mdy": "strftime(l_shipdate,'%m-%d-%Y')", "verb": "strftime(l_shipdate,'%b %d, %Y')",
}
_DUCK |= {k: f"strftime(o_orderdate, '{v}')" for k, (_, v) in _LAYOUTS.items()}


def _texts(engine: dict[str, str]) -> dict[str, str]:
    sales = _SALES.format(**engine)
    return {
        "d_sales": sales, "d_customer": _CUSTOMER.format(**engine), "d_employee": _EMPLOYEE.format(**engine),
        "d_ledger": _LEDGER.format(**engine), "d_gaps": _GAPS, "d_readings": _READINGS.format(**engine),
        "d_dates": _DATES.format(**engine),
        "d_sales_twice": _SALES_TWICE.format(sales=sales, sales_base=sales),
    }


DUCK = _texts(_DUCK)
_SPARK_TEXTS = _texts(_SPARK)
_BASE = {
    "d_sales": "lineitem", "d_sales_twice": "lineitem", "d_customer": "customer", "d_employee": "customer",
    "d_ledger": "orders", "d_gaps": "events", "d_readings": "lineitem", "d_dates": "orders",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, or a dirty one derived from it."""
    if name not in _BASE:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    base = spread(spark.read.parquet(f"{folder}/{_BASE[name]}.parquet"))
    return spark.sql(_SPARK_TEXTS[name].replace(f"from {_BASE[name]}", "from {base}"), base=base)
