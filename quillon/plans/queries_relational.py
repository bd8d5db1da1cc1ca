"""Plain SQL operators over the driver tables; Spark has all of these but the as-of and the range join."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import relational
from quillon.plans.registry import query, table
from quillon.streaming import resume


@query("""
SELECT n_regionkey, c_mktsegment, CAST(grouping_id(n_regionkey, c_mktsegment) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)""")
def cube_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.cube("n_regionkey", "c_mktsegment").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT e.event_id, e.user_id, arg_max(s.event_id, s.ts) AS last_signup FROM events e LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON s.user_id = e.user_id AND s.ts <= e.ts
GROUP BY e.event_id, e.user_id""")
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    signups = table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_signup"))
    return relational.as_of_join(events, signups, "user_id", "ts", "ts", "last_signup", "event_id").drop("ts")


#: How long a customer's range is: up to 2048, a few of them a billion.
_SPAN = "CASE WHEN c_custkey % 1000 = 0 THEN 1000000000 ELSE CAST(pow(2, c_custkey % 12) AS BIGINT) END"


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderkey AS a, o_orderkey + CAST(pow(2, o_orderkey % 12) AS BIGINT) AS b FROM orders),
c AS (SELECT c_custkey, c_custkey * 40 AS lo, c_custkey * 40 + {_SPAN} AS hi FROM customer)
SELECT c_custkey, CAST(count(*) AS BIGINT) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o JOIN c ON a < hi AND lo < b GROUP BY c_custkey""")
def interval_overlap(spark, sf_dir):
    """Ranges from 1 to a billion long that overlap."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", o.alias("a"), (o + F.pow(F.lit(2), o % 12).cast("long")).alias("b"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", (c * 40).alias("lo"), (c * 40 + F.when(c % 1000 == 0, 1_000_000_000).otherwise(F.pow(F.lit(2), c % 12).cast("long"))).alias("hi"))
    pairs = relational.overlap_join(orders, customers, ("a", "b"), ("lo", "hi"), 16.0)
    return pairs.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))


@query("SELECT p_partkey, CAST(b AS BIGINT) AS band FROM part JOIN (SELECT i AS b, 900 + i * 100.0 AS lo, 900 + i * 100.0 + 150 AS hi FROM range(12) t(i)) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, sf_dir):
    bands = spark.range(12).select(F.col("id").alias("band"), (900 + F.col("id") * 100.0).alias("lo"), (1050 + F.col("id") * 100.0).alias("hi"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return relational.range_join(parts, bands, F.col("p_retailprice"), F.col("lo"), F.col("hi"), 100.0).select("p_partkey", "band")


@query("""
SELECT c_nationkey AS nationkey, 'both' AS side FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT s_nationkey, 'supplier' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def intersect_except(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(s.subtract(c).withColumn("side", F.lit("supplier")))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return resume.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query("""
SELECT w AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS w FROM events) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return resume.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "12 hours", "6 hours")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS session_start, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return resume.session_counts(table(spark, sf_dir, "events"), "ts", "user_id", "4 hours")


@query("""
SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, round(median(c_acctbal), 2) AS middle, true AS count_fits, true AS median_fits FROM customer GROUP BY c_mktsegment""")
def approx_distinct(spark, sf_dir):
    """Exact distinct counts and medians, and whether the approximate ones are within their error of them."""
    exact, middle = F.count_distinct("c_custkey"), F.percentile("c_acctbal", 0.5)
    about, near = F.approx_count_distinct("c_custkey", 0.02), F.percentile_approx("c_acctbal", 0.5, 10000)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        exact.alias("customers"), F.round(middle, 2).alias("middle"), (F.abs(about - exact) <= F.ceil(exact * 0.1)).alias("count_fits"), (F.abs(near - middle) < 200).alias("median_fits")
    )


@query("""
SELECT s_suppkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS q,
       lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS following FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)""")
def ranking(spark, sf_dir):
    by, full = Window.partitionBy("s_nationkey").orderBy("s_acctbal"), Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(by).alias("r"), F.dense_rank().over(by).alias("d"), F.ntile(4).over(full).alias("q"), F.lead("s_suppkey").over(full).alias("following"))


_REVENUE = """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name"""


@query(_REVENUE)
def sql_text(spark, sf_dir):
    """A query given as SQL text over views of the tables."""
    text = _REVENUE.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    for name in ("customer", "orders", "lineitem", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"quillon_{name}")
        text = text.replace(f" {name} ", f" quillon_{name} ")
    return spark.sql(text)
