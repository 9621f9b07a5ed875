"""Streams run over what is there, against batch SQL; and what comes with the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read
from ..storage import new_path
from ..streaming import ingest
from .registry import query


def streamed(spark, d, shape, mode="append"):
    """The events table as a stream through `shape`, run to its end into a table; mode complete: the last batch's state."""
    schema = read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    shaped = shape(source.withColumn("ts", F.col("ts").cast("timestamp")))
    target = new_path(spark, "stream")
    if mode == "append":
        ingest.run_available(shaped, f"{target}/out", f"{target}/state")
    else:
        ingest.run_each_batch(shaped, lambda batch, _: batch.write.mode("overwrite").parquet(f"{target}/out"), f"{target}/state", mode)
    return spark.read.parquet(f"{target}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    counts = streamed(spark, d, lambda s: ingest.window_counts(s, "ts", "1 day", "event_type"), "complete")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    found = streamed(spark, d, lambda s: ingest.sessions(s, "ts", "6 hours", "user_id"), "complete")
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_ingest_once(spark, d):
    return streamed(spark, d, lambda s: ingest.ingest_once(s, "user_id", "ts", "60 days").select("user_id"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, d):
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, d):
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark, d):
    c = read(spark, d, "customer")
    return c.groupingSets([[F.col("c_mktsegment")], [F.col("c_nationkey")], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def asof_order(spark, d):
    """Each event with its user's last order before it: one union in time order, no pairs."""
    from pyspark.sql import Window

    o = read(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    left = read(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    right = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    last = F.last("o_orderkey", ignorenulls=True).over(Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return left.unionByName(right).withColumn("o_orderkey", last).where("side = 1 and o_orderkey is not null").select("event_id", "o_orderkey")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT p_size FROM part EXCEPT SELECT n_nationkey FROM nation)")
def set_ops(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))
    return a.unionAll(read(spark, d, "part").select("p_size").subtract(read(spark, d, "nation").select("n_nationkey")))
