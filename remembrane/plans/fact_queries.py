"""Facts, ledgers, merges and resolution over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.predicates import where
from ..functions.text import entropy
from ..functions.values import fact_id
from ..operators import entities, facts, ledger, merge, resolve
from ..sources.tables import priority_facts, read
from .registry import query

FACTS_SQL = """f AS (SELECT 'fact-' || substr(sha256('tpch|customer:' || o_custkey || '|HAS_PRIORITY|' || o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 24) AS fact_id,
'customer:' || o_custkey AS subject, o_orderpriority AS object, o_orderdate AS valid_from, o_orderkey, lead(o_orderdate) OVER w AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query("SELECT o_orderkey, 'fact-' || substr(sha256('tpch|customer:' || o_custkey || '|HAS_PRIORITY|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 24) AS fact_id FROM orders")
def fact_ids(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", fact_id(F.lit("tpch"), F.concat(F.lit("customer:"), "o_custkey"), F.lit("HAS_PRIORITY"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fact_id"))


@query(f"WITH {FACTS_SQL} SELECT fact_id, subject, object FROM f WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')")
def facts_as_of(spark, d):
    return facts.as_of(priority_facts(spark, d), F.lit("1996-01-01").cast("timestamp_ntz")).select("fact_id", "subject", "object")


@query(f"WITH {FACTS_SQL} SELECT fact_id, subject, object FROM f WHERE valid_to IS NULL")
def facts_current(spark, d):
    return facts.as_of(priority_facts(spark, d), None).select("fact_id", "subject", "object")


@query(f"WITH {FACTS_SQL} SELECT fact_id, subject, row_number() OVER (PARTITION BY subject ORDER BY valid_from, fact_id) AS version FROM f")
def facts_history(spark, d):
    return facts.history(priority_facts(spark, d)).select("fact_id", "subject", "version")


@query("""SELECT 'fact-' || substr(sha256('tpch|customer:' || o_custkey || '|HAS|' || o_orderpriority || '|'), 1, 24) AS fact_id, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS evidence,
round(max(least(1.0, greatest(0.0, floor(o_totalprice) / 1000000.0))), 6) AS confidence, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority""")
def facts_reinforce(spark, d):
    o = read(spark, d, "orders")
    subject = F.concat(F.lit("customer:"), "o_custkey")
    rows = o.select(fact_id(F.lit("tpch"), subject, F.lit("HAS"), F.col("o_orderpriority"), F.lit("")).alias("fact_id"), subject.alias("subject"), F.lit("HAS").alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderkey").cast("string").alias("observation_id"), (F.floor("o_totalprice") / 1000000.0).alias("confidence"), F.col("o_orderdate").alias("valid_from"))
    n = rows.groupBy("fact_id").agg(F.count("*").alias("n"))
    return facts.reinforce(rows).join(n, "fact_id").select("fact_id", F.array_join("observation_ids", ",").alias("evidence"), F.round("confidence", 6).alias("confidence"), "n")


@query(f"WITH {FACTS_SQL} SELECT fact_id, valid_to, lead(fact_id) OVER (PARTITION BY subject ORDER BY valid_from, o_orderkey) AS superseded_by FROM f")
def facts_supersede(spark, d):
    base = priority_facts(spark, d).drop("valid_to", "superseded_by")
    return facts.supersede(base, "valid_from", "o_orderkey").select("fact_id", "valid_to", "superseded_by")


@query(f"""WITH {FACTS_SQL}, g AS (SELECT fact_id, subject, object, valid_from, valid_from + INTERVAL 90 DAY AS valid_to FROM f)
SELECT a.fact_id AS a, b.fact_id AS b FROM g a JOIN g b ON a.subject = b.subject AND a.fact_id < b.fact_id AND a.object <> b.object AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to""")
def facts_conflicts(spark, d):
    rows = priority_facts(spark, d).withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 90 DAYS")).withColumn("superseded_by", F.lit(None).cast("string"))
    return facts.conflicts(rows).select(F.col("a_fact_id").alias("a"), F.col("b_fact_id").alias("b"))


@query("""WITH e AS (SELECT user_id, event_type, CAST(event_id AS VARCHAR) AS i, event_type = 'error' OR event_id % 7 = 0 AS gone FROM events)
SELECT user_id || ':' || event_type AS fact_id, count(DISTINCT CASE WHEN NOT gone THEN i END) AS left_n, count(DISTINCT CASE WHEN NOT gone THEN i END) = 0 AS evidence_lost FROM e GROUP BY user_id, event_type""")
def facts_evidence_lost(spark, d):
    e = read(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("fact_id"), F.col("event_id").cast("string").alias("observation_id"), ((F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)).alias("gone"))
    held = e.groupBy("fact_id").agg(F.collect_set("observation_id").alias("observation_ids"))
    return facts.drop_evidence(held, e.where("gone")).select("fact_id", F.size("observation_ids").cast("long").alias("left_n"), "evidence_lost")


def two_states(spark, d):
    line = read(spark, d, "lineitem")
    state = lambda upto: line.where(F.col("l_shipdate") < F.lit(upto).cast("timestamp_ntz")).groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("long").cast("string").alias("content_hash"))
    return state("1995-01-01"), state("1997-01-01").where("l_suppkey % 5 <> 0")


DIFF_SQL = """a AS (SELECT l_partkey, l_suppkey, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY ALL),
b AS (SELECT l_partkey, l_suppkey, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_suppkey % 5 <> 0 GROUP BY ALL),
c AS (SELECT l_partkey, l_suppkey, CASE WHEN a.h IS NULL THEN 'opened' WHEN b.h IS NULL THEN 'closed' WHEN a.h = b.h THEN 'unchanged' ELSE 'superseded' END AS change FROM a FULL OUTER JOIN b USING (l_partkey, l_suppkey))"""


@query(f"WITH {DIFF_SQL} SELECT * FROM c")
def reconcile_diff(spark, d):
    return ledger.diff(*two_states(spark, d), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "change")


@query(f"""WITH {DIFF_SQL} SELECT CAST(count(*) FILTER (change IN ('opened', 'superseded')) AS BIGINT) AS opened, CAST(count(*) FILTER (change IN ('closed', 'superseded')) AS BIGINT) AS closed,
CAST(count(*) FILTER (change = 'unchanged') AS BIGINT) AS unchanged, CAST(count(*) FILTER (change = 'superseded') AS BIGINT) AS superseded FROM c""")
def reconcile_counts(spark, d):
    return ledger.counts(ledger.diff(*two_states(spark, d), ["l_partkey", "l_suppkey"]))


@query(f"""WITH {DIFF_SQL} SELECT change, l_partkey, l_suppkey, row_number() OVER w AS position, count(*) OVER (PARTITION BY change) > 25 AS truncated FROM c WINDOW w AS (PARTITION BY change ORDER BY l_partkey, l_suppkey) QUALIFY position <= 25""")
def changes_truncated(spark, d):
    changes = ledger.diff(*two_states(spark, d), ["l_partkey", "l_suppkey"])
    return ledger.changes_payload(changes, "change", ["l_partkey", "l_suppkey"], 25).select("change", "l_partkey", "l_suppkey", "position", "truncated")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def reconcile_pending(spark, d):
    known = read(spark, d, "customer").where("c_nationkey < 20").select(F.concat(F.lit("customer:"), "c_custkey").alias("k"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"))
    return ledger.pending(orders, known.unionByName(orders.select(F.col("src").alias("k"))), "src", "dst", "k").select("o_orderkey", "o_custkey")


@query("""WITH g AS (SELECT o_custkey, min(o_orderkey) AS old FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) = 1),
n AS (SELECT o_custkey, min(o_orderkey) AS new FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) = 1) SELECT o_custkey, old, new FROM g JOIN n USING (o_custkey)""")
def reconcile_cardinality_one(spark, d):
    o = read(spark, d, "orders")
    return ledger.pair_single(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS first_owner FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def key_conflicts(spark, d):
    return ledger.key_conflicts(read(spark, d, "lineitem"), ["l_partkey"], "l_suppkey")


@query("""SELECT o_orderpriority, 'st1-' || substr(sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 40) AS token FROM orders GROUP BY o_orderpriority""")
def state_token(spark, d):
    return ledger.state_token(read(spark, d, "orders"), ["o_orderpriority"], "o_orderkey")


def offers(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("since"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))


OFFERS_SQL = "o AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS since, max(l_discount) AS discount, max(l_tax) AS tax FROM lineitem GROUP BY ALL)"


@query(f"""WITH {OFFERS_SQL}, a AS (SELECT l_partkey, l_suppkey, since, 'discount' AS attribute, discount AS value FROM o WHERE discount > 0 UNION ALL SELECT l_partkey, l_suppkey, since, 'tax', tax FROM o)
SELECT l_partkey, attribute, l_suppkey, value FROM a QUALIFY row_number() OVER (PARTITION BY l_partkey, attribute ORDER BY l_suppkey % 3, since DESC, l_suppkey) = 1""")
def merge_attributes(spark, d):
    each = offers(spark, d).withColumn("discount", F.when(F.col("discount") > 0, F.col("discount"))).select("l_partkey", "l_suppkey", "since", F.explode(F.array(F.struct(F.lit("discount").alias("attribute"), F.col("discount").alias("value")), F.struct(F.lit("tax").alias("attribute"), F.col("tax").alias("value")))).alias("x")).select("l_partkey", "l_suppkey", "since", "x.*")
    return merge.winners(each, ["l_partkey"], "attribute", "value", F.col("l_suppkey") % 3, "since", "l_suppkey", "l_suppkey").select("l_partkey", "attribute", "l_suppkey", "value")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, lag(o_orderpriority) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
m AS (SELECT *, CASE WHEN n = 1 OR p <> o_orderpriority THEN o_orderdate END AS s FROM v)
SELECT o_custkey, o_orderkey, last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS since FROM m""")
def merge_since(spark, d):
    o = read(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.withColumn("n", F.row_number().over(order))
    dated = merge.stamp_since(rows, ["o_custkey"], "o_orderpriority", "n").select("o_custkey", "o_orderkey", F.col("since").alias("n"))
    return dated.join(rows.select("o_custkey", "n", F.col("o_orderdate").alias("since")), ["o_custkey", "n"]).select("o_custkey", "o_orderkey", "since")


@query("""WITH v AS (SELECT event_id, event_type, user_id, CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS w, min(CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id % 100) AS m FROM events) SELECT event_id, event_type FROM v WHERE w = m""")
def merge_visibility_class(spark, d):
    from ..sources.tables import observations

    rows = observations(spark, d).withColumn("entity", F.col("event_id") % 100)
    return merge.widest_class(rows, ["entity"]).select("event_id", F.col("kind").alias("event_type"))


def parts(spark, d):
    return read(spark, d, "part").select(F.concat(F.lit("part."), F.regexp_replace("p_name", " ", ".")).alias("key"), F.array(F.concat(F.col("p_brand"), F.lit(":"), "p_partkey")).alias("aliases")).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))


def wanted(spark, d):
    p = read(spark, d, "part")
    exact = p.select(F.concat(F.lit("part."), F.regexp_replace("p_name", " ", ".")).alias("candidate"))
    alias = p.select(F.concat(F.col("p_brand"), F.lit(":"), "p_partkey").alias("candidate"))
    tail = p.select(F.regexp_replace("p_name", " ", ".").alias("candidate"))
    return exact.unionByName(alias).unionByName(tail).distinct()


TIERS_SQL = """e AS (SELECT 'part.' || replace(p_name, ' ', '.') AS key, p_brand || ':' || p_partkey AS alias FROM part),
c AS (SELECT DISTINCT 'part.' || replace(p_name, ' ', '.') AS candidate FROM part UNION SELECT p_brand || ':' || p_partkey FROM part UNION SELECT replace(p_name, ' ', '.') FROM part),
k AS (SELECT DISTINCT key FROM e),
m AS (SELECT candidate, key, 1 AS tier FROM c JOIN k ON candidate = key UNION SELECT candidate, key, 2 FROM c JOIN e ON candidate = alias
UNION SELECT candidate, key, 3 FROM c JOIN k ON lower(candidate) = lower(key) UNION SELECT candidate, key, 4 FROM c JOIN k ON length(candidate) >= 4 AND (ends_with(key, ' ' || candidate) OR ends_with(key, '.' || candidate) OR ends_with(key, ':' || candidate))),
r AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY candidate))"""


@query(f"WITH {TIERS_SQL} SELECT candidate, key, tier FROM r")
def resolve_tiers(spark, d):
    return resolve.tiers(wanted(spark, d), parts(spark, d)).select("candidate", "key", "tier")


@query(f"""WITH {TIERS_SQL}, o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, candidate) = 1) SELECT candidate, key, tier FROM o ORDER BY tier, candidate, key LIMIT 20""")
def resolve_two_pass(spark, d):
    return resolve.resolve(wanted(spark, d), parts(spark, d)).select("candidate", "key", "tier")


@query("""WITH s AS (SELECT DISTINCT p_brand || ' ' || p_type AS key, p_type AS candidate FROM part)
SELECT candidate, key, row_number() OVER (PARTITION BY candidate ORDER BY key) AS position, count(*) OVER (PARTITION BY candidate) > 10 AS truncated FROM s QUALIFY position <= 10""")
def resolve_suffix_topn(spark, d):
    p = read(spark, d, "part")
    keys = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("key"), F.array().cast("array<string>").alias("aliases")).distinct()
    found = resolve.suffix_matches(p.select(F.col("p_type").alias("candidate")).distinct(), keys).distinct()
    return resolve.limit_per_suffix(found)


@query("SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE (c_mktsegment, c_custkey) > ('BUILDING', 500) ORDER BY 1, 2 LIMIT 101")
def entity_page_keyset(spark, d):
    rows = read(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name")
    return resolve.after_cursor(rows, ["c_mktsegment", "c_custkey"], ("BUILDING", 500), 100)


def typed(spark, d):
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.withColumn("attributes", F.create_map(F.lit("k"), "k", F.lit("type"), "event_type", F.lit("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).withColumn("kinds", F.create_map(F.lit("k"), F.lit("number"), F.lit("type"), F.lit("string"), F.lit("at"), F.lit("string")))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 42")
def where_eq_in(spark, d):
    return typed(spark, d).where(where(F.col("attributes"), F.col("kinds"), [{"attr": "type", "op": "in", "value": ["click", "view"]}, {"attr": "k", "op": "eq", "value": 42}])).select("event_id")


@query("SELECT p_partkey FROM part WHERE replace(p_type, ' ', '.') = 'STANDARD' OR starts_with(replace(p_type, ' ', '.'), 'STANDARD.')")
def where_prefix(spark, d):
    p = read(spark, d, "part").withColumn("a", F.create_map(F.lit("t"), F.regexp_replace("p_type", " ", "."))).withColumn("k", F.create_map(F.lit("t"), F.lit("string")))
    return p.where(where(F.col("a"), F.col("k"), [{"attr": "t", "op": "prefix", "value": "STANDARD"}])).select("p_partkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10'")
def where_range(spark, d):
    return typed(spark, d).where(where(F.col("attributes"), F.col("kinds"), [{"attr": "k", "op": "gte", "value": 10}, {"attr": "k", "op": "lte", "value": 20}, {"attr": "at", "op": "gte", "value": "2024-01-10"}])).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def where_exists(spark, d):
    return typed(spark, d).where(where(F.col("attributes"), F.col("kinds"), [{"attr": "k", "op": "exists"}])).select("event_id")


@query("SELECT event_id, user_id % 3 = 0 OR event_type = 'view' AS any_item, event_id % 4 <> 0 AS present FROM events")
def where_lists(spark, d):
    """Conditions on lists: any item counts, and an empty list is not there."""
    e = read(spark, d, "events")
    items = F.when(F.col("event_id") % 4 == 0, "[]").otherwise(F.to_json(F.array(F.lit("x"), "event_type")))
    tags = F.to_json(F.array("event_type", (F.col("user_id") % 3).cast("string")))
    a, k = F.create_map(F.lit("items"), items, F.lit("tags"), tags), F.create_map(F.lit("items"), F.lit("list"), F.lit("tags"), F.lit("list"))
    one = lambda clause: where(a, k, [clause])
    found = one({"attr": "tags", "op": "eq", "value": 0}) | one({"attr": "tags", "op": "in", "value": ["view"]})
    return e.select("event_id", found.alias("any_item"), one({"attr": "items", "op": "exists"}).alias("present"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, unnest(string_split(p_name, '')) AS ch FROM n), g AS (SELECT p_name, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT p_name, round(-sum(k / t * log2(k / t)), 6) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY p_name) AS t FROM g) GROUP BY p_name""")
def label_entropy(spark, d):
    return read(spark, d, "part").select("p_name").distinct().select("p_name", F.round(entropy(F.col("p_name")), 6).alias("entropy"))


#: All pairs of labels that share half of their 3-grams, without any blocking.
PAIRS_SQL = """n AS (SELECT DISTINCT lower(p_name) AS l FROM part), g AS (SELECT l, list_distinct(list_transform(generate_series(1, greatest(length(l) - 2, 1)), lambda i: substr(l, i, 3))) AS s FROM n),
p AS (SELECT a.l AS a, b.l AS b, round(100 * jaro_winkler_similarity(a.l, b.l), 6) AS score FROM g a JOIN g b ON a.l < b.l
WHERE round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) >= 0.5)"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, score FROM p WHERE score >= 75")
def er_candidates(spark, d):
    return entities.label_pairs(read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label")), alike=0.5)


@query(f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT a, b FROM p WHERE score >= 88 UNION ALL SELECT b, a FROM p WHERE score >= 88),
r AS (SELECT a AS key, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key) SELECT key, min(root) AS component FROM r GROUP BY key""")
def er_components(spark, d):
    """Names that are alike to 88 percent, whatever their length: all names here are short, which by themselves never merge."""
    names = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label"))
    pairs = entities.decide(entities.label_pairs(names, alike=0.5)).where("score >= 88")
    known = names.select(F.lower("label").alias("key"), F.array().cast("array<string>").alias("identity")).distinct()
    return entities.resolve_components(pairs, known)


@query()
def er_minhash_pairs(spark, d):
    return entities.band_pairs(read(spark, d, "part").select(F.col("p_name").alias("label")), 0.5)


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS l FROM part), g AS (SELECT l, list_distinct(list_transform(generate_series(1, greatest(length(l) - 2, 1)), lambda i: substr(l, i, 3))) AS s FROM n)
SELECT a.l AS a, b.l AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS similarity FROM g a JOIN g b ON a.l < b.l
WHERE round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) >= 0.5""")
def er_shingle_pairs(spark, d):
    return entities.similar_by_shingles(read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label")), 0.5)


@query("SELECT * FROM (SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)")
def ingest_dedup(spark, d):
    from ..operators.tables import latest

    return latest(read(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


@query("""WITH a AS (SELECT c_custkey, c_mktsegment AS h FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 4 <> 0)
SELECT c_custkey, CASE WHEN a.h IS NULL THEN 'delete' WHEN b.h IS NULL OR a.h <> b.h THEN 'embed' ELSE 'touch' END AS action FROM a FULL OUTER JOIN b USING (c_custkey)""")
def index_sync(spark, d):
    from ..operators.tables import sync

    c = read(spark, d, "customer")
    other = F.when(F.col("c_custkey") % 5 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    return sync(c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("h")), c.where("c_custkey % 4 <> 0").select("c_custkey", other.alias("h")), ["c_custkey"], "h")
