"""Queries over chart data."""

from __future__ import annotations

from itertools import combinations

from catalog.dirty import table
from catalog.duck import COLUMNS, quoted, r2, rs, scores, with_tables
from catalog.registry import query
from catalog.shared import cleaned, enriched
from tablewright.operators import chartdata as C
from tablewright.functions.numbers import round_scalar
from tablewright.operators.profile import dataset_profile


@query("ch_missing", with_tables("d_sales_twice", "sales_fill") + "select * from (" + " union all ".join(
    f"""select '{c}' as "column", count(*) filter (where {quoted(c)} is null) as raw_missing,
 (select count(*) filter (where {new} is null) from sales_fill) as clean_missing from d_sales_twice"""
    for c, new in zip(COLUMNS["d_sales"], ("order_id", "order_date", "region", "product_category", "quantity", "unit_price", "discount"))) + ") where raw_missing > 0 order by raw_missing desc, 1 limit 10")
def ch_missing(spark, folder):
    result = cleaned(spark, folder, "d_sales_twice")
    return C.missing_chart(table(spark, folder, "d_sales_twice"), result.table, renames=result.plan.renames)


@query("ch_trend", with_tables("sales_feat") + """select order_month_year, round(sum(net_revenue), 2) as net_revenue from sales_feat
 where order_month_year is not null group by 1""")
def ch_trend(spark, folder):
    sales = enriched(spark, folder, "d_sales_twice")
    when, value = C.first_present(sales, C.TREND_TIME_COLUMNS), C.chart_value_column(sales)
    return C.trend(sales, when, value).selectExpr(when, f"round({value}, 2) as {value}")


@query("ch_catbar", with_tables("sales_feat") + "select product_category, round(sum(net_revenue), 2) as net_revenue from sales_feat group by 1")
def ch_catbar(spark, folder):
    sales = enriched(spark, folder, "d_sales_twice")
    key, value = C.first_present(sales, C.CHART_CATEGORY_COLUMNS), C.chart_value_column(sales)
    return C.category_bars(sales, key, value).selectExpr(key, f"round({value}, 2) as {value}")


@query("ch_donut", with_tables("sales_feat") + f"""select region, round(sum(net_revenue), 2) as net_revenue,
 {r2('sum(net_revenue) * 100 / (select sum(net_revenue) from sales_feat)')} as share_pct from sales_feat group by 1""")
def ch_donut(spark, folder):
    sales = enriched(spark, folder, "d_sales_twice")
    key, value = C.first_present(sales, C.DONUT_COLUMNS), C.chart_value_column(sales)
    return C.donut(sales, key, value).selectExpr(key, f"round({value}, 2) as {value}", "share_pct")


@query("ch_donut_count", f"""select l_returnflag, count(*) as count, {r2('count(*) * 100.0 / (select count(*) from lineitem)')} as share_pct
 from lineitem group by 1""")
def ch_donut_count(spark, folder):
    return C.donut(table(spark, folder, "lineitem"), "l_returnflag")


@query("ch_hist", f"""select cast(bin as int) as bin, {r2('lo + width * bin')} as bin_start, {r2('lo + width * (bin + 1)')} as bin_end, count(*) as count
 from (select least(floor((l_extendedprice - lo) / width), 29) as bin, lo, width from lineitem,
 (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 as width from lineitem)) group by bin, lo, width""")
def ch_hist(spark, folder):
    return C.histogram(table(spark, folder, "lineitem"), "l_extendedprice")


@query("ch_box", f"""select {rs('min', 2)} as min, {rs('q1', 4)} as q1, {rs('median', 4)} as median, {rs('q3', 4)} as q3, max, lower_fence, upper_fence,
 (select count(*) from orders where o_totalprice < lower_fence or o_totalprice > upper_fence) as outlier_points from (
 select *, {r2('q1 - (q3 - q1) * 1.5')} as lower_fence, {r2('q3 + (q3 - q1) * 1.5')} as upper_fence from (
 select min(o_totalprice) as min, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median,
 quantile_cont(o_totalprice, 0.75) as q3, max(o_totalprice) as max from orders))""")
def ch_box(spark, folder):
    found = C.box(table(spark, folder, "orders"), "o_totalprice")
    return found.selectExpr("min", *[f"{round_scalar(c, 4)} as {c}" for c in ("q1", "median", "q3")], "max",
                            "lower_fence", "upper_fence", "outlier_points")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "fixed")


@query("ch_corr", "with t as (select l_quantity, l_extendedprice, l_discount, case when l_linenumber = 1 then null else l_tax end as l_tax, 1 as fixed from lineitem) "
       + " union all ".join(
           [f"select '{c}' as col_a, '{c}' as col_b, case when var_pop({c}) > 0 then 1.0::double end as r from t" for c in _NUMBERS]
           + [f"select '{x}', '{y}', case when var_pop({a}) > 0 and var_pop({b}) > 0 then {r2(f'corr({a}, {b})')} end from t"
              for a, b in combinations(_NUMBERS, 2) for x, y in ((a, b), (b, a))]))
def ch_corr(spark, folder):
    items = table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "if(l_linenumber = 1, null, l_tax) as l_tax", "1 as fixed")
    return C.correlation(items)


@query("ch_top8", "select l_suppkey, round(sum(l_extendedprice), 2) as l_extendedprice from lineitem group by 1 order by 2 desc, 1 limit 8")
def ch_top8(spark, folder):
    best = C.top_categories(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice")
    return best.selectExpr("l_suppkey", "round(l_extendedprice, 2) as l_extendedprice")


@query("ch_gauge", with_tables("d_sales", "d_customer") + f"""select 'd_sales' as source, score, case when score >= 90 then 'green' when score >= 75 then 'blue'
 when score >= 50 then 'amber' else 'red' end as band from ({scores('d_sales')}) union all select 'd_customer', score, case when score >= 90 then 'green'
 when score >= 75 then 'blue' when score >= 50 then 'amber' else 'red' end from ({scores('d_customer')})""")
def ch_gauge(spark, folder):
    out = None
    for name in ("d_sales", "d_customer"):
        row = dataset_profile(table(spark, folder, name)).selectExpr(
            f"'{name}' as source", "quality_score as score", f"{C.gauge_band('quality_score')} as band")
        out = row if out is None else out.unionByName(row)
    return out
