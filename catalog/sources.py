"""Queries over sources, sinks and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.dirty import table
from catalog.duck import COLUMNS, quoted, with_tables
from catalog.registry import query
from tablewright.operators.views import head, page_directory, page_info, search
from tablewright.sources.csv import (
    NA_TOKENS, SourceError, infer_types, load_metadata, load_status, load_table, na_tokens_to_null, read_delimited, sniff_delimiter,
)
from tablewright.sources.sinks import as_text, sanitize_for_sheet, write_table
from tablewright.sources.staging import new_path

_SALES_SELECT = """select "Order ID", "Order Date", "Region", "Product Category", cast("Quantity" as varchar) as "Quantity",
 "Unit Price", "Discount %" from d_sales"""


def _written(spark: SparkSession, df: DataFrame, **options: str) -> str:
    return write_table(df, new_path(spark, "csv"), "csv", **options)


@query("src_csv", with_tables("d_sales") + _SALES_SELECT)
def src_csv(spark, folder):
    path = _written(spark, table(spark, folder, "d_sales"))
    return read_delimited(spark, path, delimiter=",", encoding="UTF-8")


@query("src_multi", f"""select cast(doc_id as varchar) as doc_id, case when text in ({", ".join(f"'{t}'" for t in NA_TOKENS)}) then null else text end as text,
 source from documents""")
def src_multi(spark, folder):
    """Texts with line breaks and quotes in two exports whose columns come in another order."""
    home = new_path(spark, "csv")
    docs = table(spark, folder, "documents")
    write_table(docs.where("doc_id % 2 = 0").select("doc_id", "text", "source"), f"{home}/even", "csv")
    write_table(docs.where("doc_id % 2 = 1").select("source", "text", "doc_id"), f"{home}/odd", "csv")
    return read_delimited(spark, f"{home}/*").select("doc_id", "text", "source")


@query("src_nulls", with_tables("d_customer") + """select "Customer ID", "First Name",
 case when "Gender" in ('', 'NA', 'N/A', 'n/a', 'NULL', 'null', 'NaN', 'nan', 'None', '<NA>', '#N/A') then null else "Gender" end as "Gender",
 "Account Status" from d_customer""")
def src_nulls(spark, folder):
    return na_tokens_to_null(table(spark, folder, "d_customer").select("Customer ID", "First Name", "Gender", "Account Status"))


@query("src_infer", with_tables("d_customer") + """select "Customer ID", "Annual Income",
 cast("Credit Score" as double) as "Credit Score", cast(length("Customer Segment") as bigint) as "Segment Length" from d_customer""")
def src_infer(spark, folder):
    typed = table(spark, folder, "d_customer").selectExpr(
        "`Customer ID`", "`Annual Income`", "`Credit Score`", "length(`Customer Segment`) as `Segment Length`")
    return infer_types(as_text(typed))


@query("src_sniff", with_tables("d_employee") + """select ';' as "delimiter", "Emp ID", "Department", "Salary",
 cast("Experience (Yrs)" as varchar) as "Experience (Yrs)", "Location" from d_employee""")
def src_sniff(spark, folder):
    path = _written(spark, table(spark, folder, "d_employee"), sep=";")
    found = sniff_delimiter(spark, path)
    return read_delimited(spark, path).selectExpr(f"'{found}' as delimiter", "*")


@query("src_enc", "select cast(c_custkey as varchar) as id, concat(c_name, ' Zoé Müller') as name from customer")
def src_enc(spark, folder):
    named = table(spark, folder, "customer").selectExpr("c_custkey as id", "concat(c_name, ' Zoé Müller') as name")
    return read_delimited(spark, _written(spark, named, encoding="ISO-8859-1"))


@query("src_empty", """select count(*) > 0 as success, cast(5 as int) as columns,
 case when count(*) = 0 then 'Dataset contains columns but no data rows (empty dataset).' end as error_message
 from customer where c_custkey < 0""")
def src_empty(spark, folder):
    return load_status(table(spark, folder, "customer").filter("c_custkey < 0"))


@query("src_err", """select 'customer' as source, true as success, count(*) as "rows" from customer
 union all select 'missing', false, cast(0 as bigint)""")
def src_err(spark, folder):
    good = _written(spark, table(spark, folder, "customer"))
    rows = []
    for name, path in (("customer", good), ("missing", f"{good}-nowhere")):
        try:
            rows.append((name, True, load_table(spark, path).count()))
        except SourceError:
            rows.append((name, False, 0))
    return spark.createDataFrame(rows, "source string, success boolean, rows bigint")


@query("meta_load", with_tables("d_sales_twice") + f"""select (select count(*) from d_sales_twice) as "rows", cast(7 as int) as columns,
 '{"|".join(COLUMNS["d_sales"])}' as column_names,
 (select {" + ".join(f"count(*) filter (where {quoted(c)} is null)" for c in COLUMNS["d_sales"])} from d_sales_twice) as initial_missing_count,
 (select count(*) from d_sales_twice) - (select count(*) from (select distinct * from d_sales_twice)) as initial_duplicate_count""")
def meta_load(spark, folder):
    path = _written(spark, table(spark, folder, "d_sales_twice"))
    facts = load_metadata(load_table(spark, path, delimiter=","), path)
    # The file size depends on the writer, so it is left out of the comparison.
    return facts.selectExpr("rows", "columns", "array_join(column_names, '|') as column_names",
                            "initial_missing_count", "initial_duplicate_count")


@query("snk_csv", "select l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate from lineitem")
def snk_csv(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    rows = table(spark, folder, "lineitem").select(*columns)
    path = write_table(rows, new_path(spark, "export"), "csv")
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("snk_san", """select doc_id, coalesce(text, '') as text,
 coalesce(case when lang = 'en' then null else lang end, '') as lang, n_chars from documents""")
def snk_san(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id", "text", "if(lang = 'en', null, lang) as lang", "n_chars")
    return sanitize_for_sheet(docs)


@query("snk_strfall", """select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
 cast(o_totalprice as varchar) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders""")
def snk_strfall(spark, folder):
    return as_text(table(spark, folder, "orders"))


@query("view_head", "select c_custkey, c_name, c_acctbal from customer order by c_custkey limit 20")
def view_head(spark, folder):
    return head(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])


@query("view_search", """select c_custkey, c_name, c_nationkey, c_mktsegment from customer
 where regexp_matches(cast(c_custkey as varchar), 'house|7$', 'i') or regexp_matches(c_name, 'house|7$', 'i')
 or regexp_matches(cast(c_nationkey as varchar), 'house|7$', 'i') or regexp_matches(c_mktsegment, 'house|7$', 'i')""")
def view_search(spark, folder):
    return search(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "house|7$")


@query("view_page", """select p_partkey, p_name, p_size,
 (select greatest(1, (count(*) - 1) // 15 + 1) from part) as pages,
 (select concat('Showing rows 46 to ', least(60, count(*)), ' of ', format('{:,}', count(*)), ' rows') from part) as label
 from (select * from part order by p_partkey limit 15 offset 45)""")
def view_page(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    info = page_info(parts, 4)
    return page_directory(parts, ["p_partkey"], rows_per_range=50).page(4).select(
        "*", info.select("pages").scalar().alias("pages"), info.select("label").scalar().alias("label"))
