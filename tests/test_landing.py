"""The customer table however many tasks join the line items."""

from datetime import datetime

from churnloom.sources import landing


def write(spark, folder):
    day = lambda i: datetime(1995, 1 + i % 12, 1 + i % 28)
    rows = {
        "customer": ([(i, i % 5, float(i * 10), "BUILDING") for i in range(12)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, i % 9, 10.5 * i, day(i)) for i in range(60)] + [(None, 3, 1.0, day(2)), (7, None, 1.0, day(3))],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"),
        "lineitem": ([(i % 60, i % 4 or None, (i % 11) / 100, "RAN"[i % 3]) for i in range(400)] + [(None, 1, 0.1, "R")],
                     "l_orderkey long, l_suppkey long, l_discount double, l_returnflag string"),
        "events": ([(i % 6,) for i in range(40)], "user_id long"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_tasks_of_bounded_rows_give_the_same_customers(spark, tmp_path, monkeypatch):
    """Null keys, unknown suppliers and repeated pairs; partitions follow the rows, not the session."""
    folder = write(spark, tmp_path)
    few = landing.customer_table(spark, folder)
    monkeypatch.setattr(landing, "TASK_ROWS", 16)
    assert landing.parts_of(spark, 401) == 26 and landing.parts_of(spark, 100) is None
    many = landing.customer_table(spark, folder)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(few) == key(many) and few.schema == many.schema
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("26") >= 3 and "RepartitionByExpression" in plan
    devices = {r.CustomerID: r.NumberOfDeviceRegistered for r in many.where("src_seq = 0").collect()}
    suppliers = {k: {i % 4 for i in range(400) if (i % 60) % 9 == k and i % 4} for k in range(9)}
    assert all(devices[50001 + k] == 1 + len(s) % 6 for k, s in suppliers.items() if k != 7)


def test_many_partitions_of_the_session_do_not_lift_the_bound(spark, tmp_path, monkeypatch):
    """They are put together again: 200 of them end as some 8 tasks of all line items, however many these are."""
    monkeypatch.setattr(landing, "TASK_ROWS", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert landing.parts_of(spark, 401) == 26 and landing.parts_of(spark, 8 * 16) is None
        plan = landing.customer_table(spark, write(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
