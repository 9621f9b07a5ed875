"""Listings and guards over events as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import fact_id, token_estimate
from ..operators import graph, observing
from ..sources.tables import edges, observations, read
from .registry import query
from .graph_queries import EDGES_SQL
from .retrieval_queries import TOP_SQL, VISIBLE_SQL, query_vector

STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'received' ELSE 'processed' END"


def stated(spark, d):
    status = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "click", "received").otherwise("processed")
    return observations(spark, d).withColumn("status", status).withColumn("observation_id", F.col("event_id"))


@query(f"WITH {VISIBLE_SQL}, e AS (SELECT v.event_id, v.kind, ts FROM v JOIN events USING (event_id) WHERE NOT restricted OR list_has_any(v.scopes, ['workspace:w1'])) SELECT event_id, kind FROM e WHERE kind IN ('error', 'view') ORDER BY CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, ts DESC, event_id LIMIT 60")
def list_recent_visible(spark, d):
    rows = stated(spark, d).withColumn("occurred", F.when(F.col("event_id") % 10 != 0, F.col("ts"))).withColumn("arrived", F.when(F.col("event_id") % 10 == 0, F.col("ts")))
    return observing.list_recent(rows, 60, "occurred", "arrived", "event_id", kinds=["error", "view"], allowed=["workspace:w1"]).select("event_id", "kind")


@query(f"SELECT event_id, {STATUS} AS status FROM events WHERE {STATUS} IN ('failed', 'received') ORDER BY ts, event_id LIMIT 100")
def unprocessed_oldest(spark, d):
    rows = stated(spark, d).drop("scopes")
    return observing.list_unprocessed(rows, 100, "ts", "event_id").select("event_id", "status")


@query(f"WITH {VISIBLE_SQL} SELECT event_id % 500 AS key, bool_and(NOT restricted OR list_has_any(scopes, ['workspace:w1', 'workspace:w2'])) AS ok FROM v GROUP BY 1")
def keys_visible(spark, d):
    return observing.keys_visible(observations(spark, d).withColumn("key", F.col("event_id") % 500), "key", ["workspace:w1", "workspace:w2"])


@query(f"WITH {VISIBLE_SQL} SELECT event_id FROM v WHERE len(list_filter(list_filter(scopes, lambda s: starts_with(s, 'workspace:') OR starts_with(s, 'principal:')), lambda s: s NOT IN ('workspace:w0', 'workspace:w4'))) = 0")
def traces_readable(spark, d):
    return observations(spark, d).where(observing.trace_readable(F.col("scopes"), ["workspace:w0", "workspace:w4"])).select("event_id")


@query(f"WITH {VISIBLE_SQL} SELECT event_id, array_to_string(list_filter(scopes, lambda s: s IN ('workspace:w0', 'team:t1')), ',') AS scopes FROM v")
def redrive_scopes(spark, d):
    allowed = F.array(F.lit("workspace:w0"), F.lit("team:t1"))
    return observations(spark, d).select("event_id", F.array_join(observing.redrive_scopes(F.col("scopes"), allowed), ",").alias("scopes"))


@query(TOP_SQL + "SELECT vec_id, round(greatest(0.0, least(1.0, s)), 6) AS similarity FROM s")
def similarities_given(spark, d):
    e = read(spark, d, "embeddings")
    return observing.similarities(e, query_vector(spark, d), e.select("vec_id"), "vec_id")


@query("SELECT p_brand, p_name AS key FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 10, p_type <> 'STANDARD', length(p_name), p_name) AS n FROM part) WHERE n = 1")
def merge_survivors(spark, d):
    nodes = read(spark, d, "part").withColumn("key", F.col("p_name"))
    return observing.survivors(nodes, "p_brand", F.col("p_size") > 10, F.col("p_type") == "STANDARD")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING) < 1 AS allowed FROM events")
def sliding_rate(spark, d):
    return observing.sliding_rate(read(spark, d, "events"), "user_id", "ts", 43_200, 1).select("user_id", "event_id", "allowed")


@query("""WITH a AS (SELECT DISTINCT 'customer:' || c_custkey AS subject FROM customer), o AS (SELECT 'customer:' || o_custkey AS subject, o_orderkey FROM orders)
SELECT subject, count(o_orderkey) AS facts FROM a LEFT JOIN o USING (subject) GROUP BY subject HAVING count(o_orderkey) = 0""")
def entities_without_facts(spark, d):
    c = read(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("subject")).distinct()
    o = read(spark, d, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("subject"))
    return c.join(o, "subject", "left_anti").withColumn("facts", F.lit(0).cast("long"))


@query("SELECT lang, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.0) AS BIGINT)) END) AS BIGINT) AS tokens, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY lang")
def namespace_totals(spark, d):
    docs = read(spark, d, "documents").withColumn("t", token_estimate(F.col("text")))
    return docs.groupBy("lang").agg(F.sum("t").alias("tokens"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


@query("SELECT 'total' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'english', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'long', count(*) FROM documents WHERE lang = 'en' AND length(text) > 2000")
def funnel_counts(spark, d):
    docs = read(spark, d, "documents")
    english = docs.where("lang = 'en'")
    return observing.stage_counts({"total": docs, "english": english, "long": english.where(F.length("text") > 2000)})


@query("SELECT c_custkey, 'fact-' || substr(sha256('ns|customer:' || c_custkey || '|IN|' || c_nationkey || '|'), 1, 24) AS id FROM customer")
def fact_lookup(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", fact_id(F.lit("ns"), F.concat(F.lit("customer:"), "c_custkey"), F.lit("IN"), F.col("c_nationkey").cast("string"), F.lit("")).alias("id"))


@query("SELECT 'order:' || l_orderkey AS src, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def out_neighbors_count(spark, d):
    return edges(spark, d, "CONTAINS").groupBy("src").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, r AS (SELECT dst AS a, src AS b FROM edges), p AS (SELECT ['region:1'] AS path UNION ALL SELECT ['region:1', b] FROM r WHERE a = 'region:1'
UNION ALL SELECT DISTINCT ['region:1', x.b, y.b] FROM r x JOIN r y ON x.a = 'region:1' AND y.a = x.b)
SELECT row_number() OVER (ORDER BY path) - 1 AS position, path[-1] AS key FROM p ORDER BY path LIMIT 200""")
def depth_first(spark, d):
    back = edges(spark, d).select(F.col("dst").alias("src"), "type", F.col("src").alias("dst"))
    return spark.createDataFrame(list(enumerate(graph.dfs(back, ["region:1"], 2, 200))), "position bigint, key string")
