import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def mart(spark):
    from churnloom.plans.mart import mart_for

    return mart_for(spark, SMALL)


# Seven customers' rows with every kind of dirt: blanks, spellings, gaps, a repeated key, an extreme.
DIRTY = {
    "src_seq": [0, 1, 2, 3, 4, 5, 6],
    "CustomerID": [710, 711, 712, 711, 713, 714, 715],
    "Churn": [0, 0, 1, 0, 0, 1, 0],
    "Tenure": [9.0, None, 3.0, 7.0, 11.0, 90.0, 5.0],
    "PreferredLoginDevice": ["Computer", "  Phone", "Phone", "Phone", "Mobile Phone\t", "Computer", "Phone"],
    "WarehouseToHome": [12.0, 21.0, 17.0, 21.0, 9.0, None, 33.0],
    "PreferredPaymentMode": ["UPI", "COD", "Cash on Delivery", "COD", "CC", "E wallet", "UPI"],
    "PreferedOrderCat": ["Fashion", "Grocery", "Fashion", "Grocery", "Mobile", "Others", "Grocery"],
    "SatisfactionScore": [3, 1, 5, 1, 2, 4, 3],
    "Complain": [0, 1, 0, 1, 0, 0, 1],
    "OrderAmountHikeFromlastYear": [13.0, 17.0, 12.0, 17.0, None, 22.0, 19.0],
    "CouponUsed": [2.0, 0.0, 3.0, 0.0, 1.0, 6.0, 1.0],
    "OrderCount": [2.0, 4.0, 1.0, 4.0, 3.0, 8.0, 2.0],
    "DaySinceLastOrder": [7.0, None, 1.0, 2.0, 6.0, 4.0, 8.0],
    "CashbackAmount": [131.5, 142.25, 118.0, 142.25, 127.75, 305.0, 150.5],
}


@pytest.fixture
def dirty(spark):
    from churnloom.plans.stages import literal_table

    return literal_table(spark, DIRTY)
