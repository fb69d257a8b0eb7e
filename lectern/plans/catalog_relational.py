"""Relational extras over the star schema, beyond the curriculum operators: joins, grouping sets, ranks, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.plans.catalog import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("x_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(spark, d):
    x = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("x_nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("x_ranks", "SELECT c_custkey, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INT AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
def _(spark, d):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("q"))


@query("x_outer_and_sets", "SELECT coalesce(c_custkey, o_custkey) AS k, count(o_orderkey) AS n FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY ALL EXCEPT SELECT c_custkey, 0 FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").groupBy(F.coalesce("c_custkey", "o_custkey").alias("k")).agg(F.count("o_orderkey").alias("n"))
    return j.subtract(c.filter("c_acctbal < 0").select("c_custkey", F.lit(0).cast("long")))
