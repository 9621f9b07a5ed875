"""Graph queries over the star schema, and aggregates of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community, graph
from ..operators.retrieval import top_per_group
from ..sources.tables import edges, nodes, read
from ..storage import cut_lineage
from .registry import query

NODES_SQL = """nodes AS (SELECT 'region:' || r_regionkey AS natural_key, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders)"""
EDGES_SQL = """edges AS (SELECT 'nation:' || n_nationkey AS src, 'IN_REGION' AS type, 'region:' || n_regionkey AS dst FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'CUSTOMER_IN', 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER_IN', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'PLACED_BY', 'customer:' || o_custkey FROM orders UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey FROM lineitem
UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey FROM lineitem)"""
BOTH_SQL = f"{EDGES_SQL}, u AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"


def keys(spark, *found):
    return spark.createDataFrame([(k,) for k in found], "key string")


def linked(spark, d):
    """The graph's adjacency, which the session's first call writes."""
    return graph.adjacency(edges(spark, d, unique=False))


@query(f"WITH {NODES_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def nodes_by_type(spark, d):
    return nodes(spark, d).groupBy(F.coalesce("type", F.lit("entity")).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edges_by_type(spark, d):
    return edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def status_counts(spark, d):
    a = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return a.unionByName(read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, e AS (SELECT src AS key FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT key, count(*) AS degree FROM e GROUP BY key)
SELECT key, degree FROM g JOIN nodes ON key = natural_key WHERE type NOT IN ('nation', 'region') ORDER BY degree DESC, key LIMIT 20""")
def degree_god_nodes(spark, d):
    return graph.god_nodes(nodes(spark, d), edges(spark, d), 20, ["nation", "region"])


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, e AS (SELECT src AS key FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT key, count(*) AS degree FROM e GROUP BY key),
r AS (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS i, count(*) OVER () AS n FROM nodes LEFT JOIN g ON key = natural_key)
SELECT greatest(50, degree) AS threshold FROM r WHERE i = CAST(floor(n * 0.99) AS BIGINT)""")
def hub_threshold(spark, d):
    return graph.hub_threshold(nodes(spark, d), edges(spark, d))


@query(f"WITH {BOTH_SQL} SELECT DISTINCT b AS key, 1 AS hop FROM u WHERE a IN ('customer:1', 'supplier:3') AND b NOT IN ('customer:1', 'supplier:3')")
def neighbors_1hop(spark, d):
    return graph.neighbors_by(linked(spark, d), keys(spark, "customer:1", "supplier:3"), 1)


@query(f"""WITH {BOTH_SQL}, h1 AS (SELECT DISTINCT b AS key FROM u WHERE a = 'customer:1'), h2 AS (SELECT DISTINCT b AS key FROM u JOIN h1 ON a = h1.key)
SELECT key, 1 AS hop FROM h1 UNION ALL SELECT key, 2 FROM h2 WHERE key <> 'customer:1' AND key NOT IN (SELECT key FROM h1)""")
def neighbors_2hop(spark, d):
    return graph.neighbors_by(linked(spark, d), keys(spark, "customer:1"), 2)


@query("""WITH l AS (SELECT DISTINCT doc_id AS item, source AS concept FROM documents), s AS (SELECT DISTINCT concept FROM l WHERE item IN (1, 2, 3)),
r AS (SELECT l.item, l.concept FROM l JOIN s USING (concept) WHERE item NOT IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY l.concept ORDER BY l.item) <= 2)
SELECT item, concept FROM r ORDER BY concept, item LIMIT 8""")
def concept_subgraph(spark, d):
    links = read(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("concept"))
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "item bigint")
    return graph.concept_subgraph(links, seeds).select("item", "concept")


@query(f"WITH {EDGES_SQL}, k AS (SELECT 'customer:' || c_custkey AS key FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region) SELECT src, type, dst FROM edges WHERE src IN (SELECT key FROM k) AND dst IN (SELECT key FROM k)")
def induced_subgraph(spark, d):
    k = nodes(spark, d, "customer", "nation", "region").select(F.col("natural_key").alias("key"))
    return graph.induced(edges(spark, d, unique=False), k).select("src", "type", "dst").distinct()


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, s1 AS (SELECT DISTINCT src AS key FROM edges WHERE type = 'IN_REGION' AND dst = 'region:1' ORDER BY 1 LIMIT 200),
s2 AS (SELECT DISTINCT src AS key FROM edges WHERE type = 'SUPPLIER_IN' AND dst IN (SELECT key FROM s1) ORDER BY 1 LIMIT 50),
s3 AS (SELECT DISTINCT dst AS key FROM edges WHERE type = 'SUPPLIES' AND src IN (SELECT key FROM s2) AND dst LIKE 'part:1%' ORDER BY 1 LIMIT 100)
SELECT 1 AS step, key FROM s1 UNION ALL SELECT 2, key FROM s2 UNION ALL SELECT 3, key FROM s3""")
def typed_traverse(spark, d):
    steps = [
        {"relation": "IN_REGION", "direction": "in"}, {"relation": "SUPPLIER_IN", "direction": "in", "limit": 50},
        {"relation": "SUPPLIES", "direction": "out", "limit": 100, "where": F.col("natural_key").startswith("part:1")},
    ]
    return graph.traverse(nodes(spark, d), None, keys(spark, "region:1"), steps, near=linked(spark, d)).select(F.col("step").cast("int").alias("step"), "key")


@query(f"""WITH {EDGES_SQL}, e AS (SELECT src AS key FROM edges UNION ALL SELECT dst FROM edges), hubs AS (SELECT key FROM e GROUP BY key HAVING count(*) >= 60),
h0 AS (SELECT DISTINCT 'order:' || o_orderkey AS key FROM orders), h1 AS (SELECT DISTINCT dst AS key FROM edges WHERE src IN (SELECT key FROM h0) AND dst NOT IN (SELECT key FROM h0)),
h2 AS (SELECT DISTINCT dst AS key FROM edges WHERE src IN (SELECT key FROM h1 EXCEPT SELECT key FROM hubs) AND dst NOT IN (SELECT key FROM h0) AND dst NOT IN (SELECT key FROM h1))
SELECT key, 0 AS depth FROM h0 UNION ALL SELECT key, 1 FROM h1 UNION ALL SELECT key, 2 FROM h2""")
def bfs_hub_throttled(spark, d):
    seeds = nodes(spark, d, "order").select(F.col("natural_key").alias("key"))
    return graph.bfs(edges(spark, d), seeds, 2, hub_degree=60).withColumn("depth", F.col("depth").cast("int"))


def path_sql(start, goal, most=6):
    """Levels of a search from start, each node with its smallest parent, and the way back from goal."""
    parts = [f"WITH {BOTH_SQL}, p AS (SELECT DISTINCT a, b FROM u WHERE a <> b), l0 AS (SELECT '{start}' AS key, CAST(NULL AS VARCHAR) AS parent, 0 AS depth), s0 AS (SELECT * FROM l0)"]
    for i in range(1, most + 1):
        parts.append(f"l{i} AS (SELECT b AS key, min(a) AS parent, {i} AS depth FROM p JOIN l{i - 1} ON a = key WHERE b NOT IN (SELECT key FROM s{i - 1}) AND '{goal}' NOT IN (SELECT key FROM s{i - 1}) GROUP BY b), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM l{i})")
    parts.append(f"w{most} AS (SELECT key, parent, depth FROM s{most} WHERE key = '{goal}')")
    for i in range(most, 0, -1):
        parts.append(f"w{i - 1} AS (SELECT * FROM w{i} UNION SELECT s.key, s.parent, s.depth FROM s{most} s JOIN w{i} w ON s.key = w.parent)")
    return ", ".join(parts) + " SELECT CAST(depth AS BIGINT) AS position, key FROM w0"


@query(path_sql("customer:1", "supplier:3"))
def shortest_path(spark, d):
    path = graph.shortest_path(edges(spark, d, unique=False), "customer:1", "supplier:3") or []
    return spark.createDataFrame(list(enumerate(path)), "position bigint, key string")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 200")
def trace_subgraph(spark, d):
    return graph.trace(read(spark, d, "events"), "user_id", 7, "ts").select("event_id", "event_type")


def nation_members(spark, d):
    c = read(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("community"))
    return c.unionByName(read(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("community")))


TRADE_SQL = """t AS (SELECT DISTINCT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT 'customer:' || c_custkey AS key, CAST(c_nationkey AS BIGINT) AS community FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier)"""


def trade(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return both.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.lit("BUYS_FROM").alias("type"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"))


@query(f"""WITH {TRADE_SQL}, i AS (SELECT a.community, count(*) AS k FROM t JOIN m a ON src = a.key JOIN m b ON dst = b.key WHERE a.community = b.community GROUP BY 1), s AS (SELECT community, count(*) AS n FROM m GROUP BY 1)
SELECT community, n, round(CASE WHEN n <= 1 THEN 1.0 ELSE CAST(coalesce(k, 0) AS DOUBLE) / (n * (n - 1) / 2.0) END, 9) AS cohesion FROM s LEFT JOIN i USING (community)""")
def cohesion(spark, d):
    return community.cohesion(trade(spark, d), nation_members(spark, d)).withColumn("cohesion", F.round("cohesion", 9))


@query(f"""WITH {TRADE_SQL}, x AS (SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, src, dst FROM t JOIN m a ON src = a.key JOIN m b ON dst = b.key WHERE a.community <> b.community)
SELECT low, high, src, dst, edges FROM (SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY src, dst) AS r, count(*) OVER (PARTITION BY low, high) AS edges FROM x) WHERE r = 1""")
def bridges(spark, d):
    return community.bridges(trade(spark, d), nation_members(spark, d))


PLACES_SQL = f"""{EDGES_SQL}, p AS (SELECT src, dst FROM edges WHERE type IN ('IN_REGION', 'CUSTOMER_IN', 'SUPPLIER_IN')),
below AS (SELECT dst AS key, count(*) AS n FROM p WHERE dst LIKE 'nation:%' GROUP BY dst),
tree AS (SELECT p.dst AS region, count(*) + coalesce(sum(n), 0) + 1 AS total FROM p LEFT JOIN below ON p.src = below.key WHERE p.dst LIKE 'region:%' GROUP BY p.dst),
b AS (SELECT p.src, p.dst, 1 + coalesce(below.n, 0) AS inside, coalesce(t.total, u.total) AS total FROM p LEFT JOIN below ON p.src = below.key LEFT JOIN tree t ON t.region = p.dst
  LEFT JOIN p up ON up.src = p.dst LEFT JOIN tree u ON u.region = up.dst)"""


def places(spark, d):
    return edges(spark, d, "IN_REGION", "CUSTOMER_IN", "SUPPLIER_IN")


@query(f"WITH {PLACES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(inside * (total - inside) AS DOUBLE) AS betweenness FROM b")
def edge_betweenness(spark, d):
    """Customers, suppliers, nations and regions hang together as trees, where an edge parts what is below it from the rest."""
    return community.edge_betweenness(places(spark, d))


@query(f"""WITH {PLACES_SQL}, e AS (SELECT src AS key, inside * (total - inside) AS x, total FROM b UNION ALL SELECT dst, inside * (total - inside), total FROM b)
SELECT key, (sum(x) - (max(total) - 1)) / 2.0 AS betweenness FROM e GROUP BY key""")
def node_betweenness(spark, d):
    return community.node_betweenness_table(places(spark, d))


@query("SELECT 'apart' AS what, 0 AS n UNION ALL SELECT 'below louvain', 0 UNION ALL SELECT 'nodes', (SELECT count(DISTINCT o_custkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) + (SELECT count(DISTINCT l_suppkey) FROM lineitem)")
def communities_leiden(spark, d):
    """Communities that are not connected, whether modularity is below that of local moves alone, and how many nodes have one."""
    blocks, _ = community.coded(trade(spark, d))
    begun = cut_lineage(community.louvain_ids(blocks, rounds=8, levels=3))
    found = cut_lineage(community.leiden_ids(blocks, begun, rounds=8, levels=3), "leiden")
    apart = community.connected_ids(blocks, found).groupBy("was").agg(F.countDistinct("community").alias("n")).where("n > 1").count()
    less = community.modularity_ids(blocks, found) < community.modularity_ids(blocks, begun) - 1e-9
    return spark.createDataFrame([("apart", apart), ("below louvain", int(less)), ("nodes", found.count())], "what string, n bigint")


@query()
def communities(spark, d):
    found = community.label_propagation(trade(spark, d))
    return community.number_communities(found)


@query("""WITH m AS (SELECT 'customer:' || c_custkey AS key, c_nationkey AS old FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier),
o AS (SELECT old, old + CASE WHEN key LIKE '%7' THEN 100 ELSE 50 END AS new, count(*) AS n FROM m GROUP BY ALL)
SELECT new, CASE WHEN row_number() OVER (PARTITION BY old ORDER BY n DESC, new) = 1 THEN old END AS old FROM o""")
def remap_communities(spark, d):
    old = nation_members(spark, d)
    return community.remap_to_previous(old.withColumn("community", F.when(F.col("key").endswith("7"), F.col("community") + 100).otherwise(F.col("community") + 50)), old)


@query("SELECT src, type, dst FROM (SELECT DISTINCT 'nation:' || CASE WHEN n_nationkey < 3 THEN 0 ELSE n_nationkey END AS src, 'IN_REGION' AS type, 'region:' || n_regionkey AS dst FROM nation)")
def merge_duplicate_nodes(spark, d):
    remap = spark.createDataFrame([("nation:1", "nation:0"), ("nation:2", "nation:0")], "old string, new string")
    return graph.merge_nodes(edges(spark, d, "IN_REGION"), remap).select("src", "type", "dst")


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem WHERE l_partkey > 100 GROUP BY ALL")
def missing_edge_ends(spark, d):
    known = nodes(spark, d, "order").unionByName(nodes(spark, d, "part").where(F.substring_index("natural_key", ":", -1).cast("long") <= 100))
    return graph.missing_ends(edges(spark, d, "CONTAINS"), known).select("src", "dst")


@query("SELECT r_name, n_name, c_custkey, rank FROM (SELECT r_name, n_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rank <= 3")
def top_customers_per_nation(spark, d):
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return top_per_group(joined, ["n_name"], F.desc("c_acctbal"), F.col("c_custkey"), limit=3).select("r_name", "n_name", "c_custkey", "rank")
