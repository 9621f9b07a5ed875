"""The test tables, and the memory tables derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import fact_id


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nodes(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    """natural_key, type, title of the star schema's rows; of some types only, if named."""
    parts = {
        "region": ("region", "r_regionkey", "r_name"), "nation": ("nation", "n_nationkey", "n_name"), "customer": ("customer", "c_custkey", "c_name"),
        "supplier": ("supplier", "s_suppkey", "s_name"), "part": ("part", "p_partkey", "p_name"), "order": ("orders", "o_orderkey", "o_orderstatus"),
    }
    one = lambda t: read(spark, folder, parts[t][0]).select(F.concat(F.lit(f"{t}:"), F.col(parts[t][1])).alias("natural_key"), F.lit(t).alias("type"), F.col(parts[t][2]).alias("title"))
    return reduce(DataFrame.unionByName, [one(t) for t in (types or parts)])


LINKS = {
    "IN_REGION": ("nation", "nation", "n_nationkey", "region", "n_regionkey"), "CUSTOMER_IN": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "SUPPLIER_IN": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"), "PLACED_BY": ("orders", "order", "o_orderkey", "customer", "o_custkey"),
    "CONTAINS": ("lineitem", "order", "l_orderkey", "part", "l_partkey"), "SUPPLIES": ("lineitem", "supplier", "l_suppkey", "part", "l_partkey"),
}


def edges(spark: SparkSession, folder: str, *types: str, unique: bool = True) -> DataFrame:
    """src, type, dst, each once; of some types only, if named. unique=False leaves repeats in, for reads that filter first
    and drop repeats of what is left."""
    parts = []
    for t in types or LINKS:
        table, a, x, b, y = LINKS[t]
        one = read(spark, folder, table).select(F.concat(F.lit(f"{a}:"), F.col(x)).alias("src"), F.lit(t).alias("type"), F.concat(F.lit(f"{b}:"), F.col(y)).alias("dst"))
        parts.append(one.distinct() if unique and table == "lineitem" else one)
    return reduce(DataFrame.unionByName, parts)


def priority_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What priority a customer's orders have, each valid until the customer's next order."""
    o = read(spark, folder, "orders")
    subject = F.concat(F.lit("customer:"), F.col("o_custkey"))
    identity = fact_id(F.lit("tpch"), subject, F.lit("HAS_PRIORITY"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    facts = o.select(identity.alias("fact_id"), subject.alias("subject"), F.lit("HAS_PRIORITY").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("valid_from"), "o_orderkey", "o_custkey")
    order = Window.partitionBy("subject").orderBy("valid_from", "o_orderkey")
    return facts.withColumn("valid_to", F.lead("valid_from").over(order)).withColumn("superseded_by", F.lead("fact_id").over(order))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as observations; those of every third user are for one workspace only."""
    e = read(spark, folder, "events")
    scopes = F.when(F.col("user_id") % 3 == 0, F.array(F.concat(F.lit("workspace:w"), (F.col("user_id") % 5).cast("string")))).when(F.col("user_id") % 3 == 1, F.array(F.concat(F.lit("team:t"), (F.col("user_id") % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), "value", "props", scopes.alias("scopes"))
