"""Platform checks: relational operators that the engine has from Spark, with no counterpart in a document converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pricing_summary(spark, sf):
    li = _t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def top_orders(spark, sf):
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    c = _t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "revenue").orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def region_rollup(spark, sf):
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.grouping_id().cast("long").alias("level"))


def ranked_parts(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return _t(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


def event_windows(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total"
    )


def asof_purchase(spark, sf):
    """Each event with the user's last purchase at or before it: one window, no range join."""
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("purchase_id"))


def customers_without_urgent_orders(spark, sf):
    urgent = _t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return _t(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def set_operations(spark, sf):
    a = _t(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey")
    b = _t(spark, sf, "lineitem").where("l_quantity < 5").select("l_partkey")
    return a.intersect(b).select(F.col("l_partkey").alias("partkey"), F.lit("both").alias("side")).unionByName(a.subtract(b).select(F.col("l_partkey").alias("partkey"), F.lit("high").alias("side")))


QUERIES = {
    "pricing_summary": (
        pricing_summary,
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    "top_orders": (
        top_orders,
        """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
 WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    ),
    "region_rollup": (
        region_rollup,
        """SELECT r_name, n_name, count(*) AS customers, (grouping(r_name) * 2 + grouping(n_name))::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 GROUP BY ROLLUP (r_name, n_name)""",
    ),
    "ranked_parts": (ranked_parts, "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3"),
    "event_windows": (event_windows, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "asof_purchase": (
        asof_purchase,
        """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_id FROM events""",
    ),
    "customers_without_urgent_orders": (customers_without_urgent_orders, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "set_operations": (
        set_operations,
        """SELECT l_partkey AS partkey, 'both' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)
 UNION ALL SELECT l_partkey, 'high' FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)""",
    ),
}
