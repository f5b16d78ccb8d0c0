"""Customer contract table derived from customers, orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.contract import SOURCE_TYPES
from churnloom.functions import quote


# Line items that one task joins, whatever the number of partitions of the session and however they are put together.
TASK_ROWS = 1 << 19
# What the customer table is derived from.
TABLES = ("customer", "orders", "lineitem", "events")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pick(selector: str, *values: str) -> str:
    return f"element_at(array({', '.join(map(quote, values))}), CAST({selector} + 1 AS INT))"


def _known(modulus: int, gap: int, value: str) -> str:
    """``value``, unknown for the customers whose number leaves remainder ``gap``."""
    return f"CASE WHEN k % {modulus} != {gap} THEN {value} END"


_OFTEN = "n_ret * 5 > n_lines * 2"
# How each column of the contract follows from a customer's orders, lines and visits.
SHAPES = {
    "CustomerID": "k + 50001",
    "Churn": f"CASE WHEN rec > 300 OR ({_OFTEN} AND k % 3 = 0) THEN 1 ELSE 0 END",
    "Tenure": _known(21, 3, "(span % 1830) div 30"),
    "PreferredLoginDevice": _pick("k % 4", "Mobile Phone", " Mobile Phone ", "Phone", "Computer"),
    "CityTier": "1 + c_nationkey % 3",
    "WarehouseToHome": _known(23, 4, "(CASE WHEN k % 50 = 0 THEN 126 ELSE 5 + (k * 13) % 31 END)"),
    "PreferredPaymentMode": _pick(
        "k % 7", "Debit Card", "Credit Card", "CC", "E wallet", "UPI", "COD", "Cash on Delivery"),
    "Gender": _pick("k % 2", "Male", "Female"),
    "HourSpendOnApp": _known(22, 5, "n_ev % 6"),
    "NumberOfDeviceRegistered": "1 + n_supp % 6",
    "PreferedOrderCat": (
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Laptop & Accessory' WHEN 'BUILDING' THEN 'Mobile' "
        "WHEN 'FURNITURE' THEN 'Mobile Phone' WHEN 'HOUSEHOLD' THEN 'Fashion' "
        "WHEN 'MACHINERY' THEN 'Grocery' END"),
    "SatisfactionScore": "1 + floor(abs(c_acctbal)) % 5",
    "MaritalStatus": _pick("k % 3", "Single", "Married", "Divorced"),
    "NumberOfAddress": "CASE WHEN k % 60 = 0 THEN 22 ELSE 1 + (k * 7) % 11 END",
    "Complain": f"CASE WHEN {_OFTEN} THEN 1 ELSE 0 END",
    "OrderAmountHikeFromlastYear": _known(24, 6, "11 + (k * 5) % 16"),
    "CouponUsed": _known(25, 7, "n_disc div 4"),
    "OrderCount": _known(26, 8, "n_recent"),
    "DaySinceLastOrder": _known(19, 9, "floor(rec / 10.0D)"),
    "CashbackAmount": "(cents div (n_all * 1000)) / 100",
}


def parts_of(spark: SparkSession, rows: int) -> int | None:
    """Partitions in which a task joins some ``TASK_ROWS`` rows; None if the session's own are enough.

    Adaptive execution puts the session's partitions together until there are about as many as cores, so only that many are counted on.
    """
    parts = -(-rows // TASK_ROWS)
    own = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return parts if parts > own else None


def customer_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer plus the appended duplicates.

    Orders and line items are joined once on the order key and reduced per customer;
    the distinct supplier count is first reduced per (customer, supplier), so a customer
    holding a third of all lines is spread over tasks before its final merge.
    """
    orders = read_table(spark, folder, "orders")
    events = read_table(spark, folder, "events")
    last_day, users = (
        orders.agg(F.max("o_orderdate")).first()[0],
        events.agg(F.max("user_id") + 1).first()[0],
    )
    today = F.lit(last_day)

    spend = orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_orderdate").alias("last_d"),
        F.min("o_orderdate").alias("first_d"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.count("*").alias("n_all"),
        F.count_if(F.datediff(today, "o_orderdate") <= 1095).alias("n_recent"))
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_returnflag")
    keys = orders.select("o_orderkey", "o_custkey")
    parts = parts_of(spark, lines.count())
    if parts:
        lines, keys = lines.repartition(parts, "l_orderkey"), keys.repartition(parts, "o_orderkey")
    pairs = lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        pairs = pairs.repartition(parts, "o_custkey", "l_suppkey")
    lines = (
        pairs.groupBy(F.col("o_custkey").alias("k"), "l_suppkey").agg(
            F.count_if(F.col("l_discount") >= 0.09).alias("disc"),
            F.count_if(F.col("l_returnflag") == "R").alias("ret"),
            F.count("*").alias("lines"))
        .groupBy("k").agg(
            F.sum("disc").alias("n_disc"), F.sum("ret").alias("n_ret"), F.sum("lines").alias("n_lines"),
            F.count("l_suppkey").alias("n_supp")))
    visits = events.groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n_ev"))

    base = (
        read_table(spark, folder, "customer").withColumn("k", F.col("c_custkey"))
        .join(spend, "k", "left").join(lines, "k", "left")
        .join(visits, F.expr(f"k % {users} = u"), "left")
        .withColumn("rec", F.datediff(today, "last_d"))
        .withColumn("span", F.datediff("last_d", "first_d")))
    rows = base.selectExpr(
        *[f"CAST({SHAPES[name]} AS {kind}) AS {name}" for name, kind in SOURCE_TYPES.items()], "k")
    # One pass over the joined rows: each row lists the copies it is delivered in.
    delivered = rows.withColumn("src_seq", F.expr(
        "explode(array_compact(array(0, IF(k % 101 = 7, 1, NULL), IF(k % 97 = 5, 2, NULL))))"))
    return delivered.withColumn(
        "Tenure", F.expr("Tenure + IF(src_seq = 2, 1.0D, 0.0D)")).drop("k")
