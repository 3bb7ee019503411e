"""Applicants take their amounts from the first line of their first order; lines of other orders are not compared."""

from __future__ import annotations

from tidemark.plans import credit_tables as credit


def test_only_lines_of_first_orders_are_compared(spark, tmp_path):
    folder = str(tmp_path)

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    write("customer", [(1, 10.0), (2, -1.0), (3, 5.0)], "c_custkey long, c_acctbal double")
    # Customer 1 has two orders of one day, customer 2 one without lines before one with lines, customer 3 none.
    write("orders", [(11, 1, "1998-01-01", 100.0), (10, 1, "1998-01-01", 90.0), (20, 2, "1997-01-01", 70.0), (21, 2, "1998-01-01", 60.0)],
          "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double")
    lines = [(10, 2, 1, 1, 5.0), (10, 1, 9, 1, 8.0), (10, 1, 3, 2, 7.0), (10, 1, 3, 2, 6.0), (11, 1, 1, 1, 1.0), (21, 1, 1, 1, 2.0), (99, 1, 1, 1, 3.0)]
    write("lineitem", [(*line, 0.0, 0.02, 25.0) for line in lines],
          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double")
    write("events", [(1, "click")], "user_id long, event_type string")
    app = credit.application(spark, folder)
    got = {r.SK_ID_CURR: (r.AMT_CREDIT, r.AMT_ANNUITY, r.EXT_SOURCE_3) for r in app.collect()}
    assert got == {1: (90.0, 6.0, 0.5), 2: (70.0, None, None), 3: (None, None, None)}
    assert "LeftSemi" in app._jdf.queryExecution().optimizedPlan().toString()
