import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tablewright-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture
def sales(spark):
    """A few messy orders, one of them twice."""
    rows = [
        ("A-1", "2026-01-15", "Ann Lee", "North", "Electronics", 2, "$1,200.50", "10%", "Female"),
        ("A-2", "16/02/2026", "bob ray", "north region", "electronics", 5, "₹ 450.00", "5%", "M"),
        ("A-3", "2026-03-20", "Cy Dow", "SOUTH", "Furniture", 10, "150.00", "0%", "Male"),
        ("A-3", "2026-03-20", "Cy Dow", "SOUTH", "Furniture", 10, "150.00", "0%", "Male"),
        ("A-4", "no date", "   ", "West", "Office Supplies", -3, "  99.99  ", "15%", "female"),
    ]
    return spark.createDataFrame(rows).toDF(
        "Order ID", "Order Date", "Customer Name", "Region", "Product Category", "Quantity", "Unit Price", "Discount %",
        "Gender")
