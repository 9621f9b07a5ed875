"""References, projections, snapshots, indexes and graph reads over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import refs
from ..functions.values import hash_embedding
from ..operators import community, graph, index, ledger, projection, retrieval
from ..sources.tables import edges, nodes, observations, read
from .graph_queries import BOTH_SQL, EDGES_SQL, NODES_SQL
from .registry import query
from .retrieval_queries import TOP_SQL, VISIBLE_SQL, query_vector

# references and labels


@query("SELECT c_custkey, CASE WHEN length(trim(c_mktsegment)) > 0 THEN 'segment:' || trim(c_mktsegment) END AS scope, 'customer' AS type FROM customer")
def scopes_and_types(spark, d):
    c = read(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("segment: "), "c_mktsegment")).otherwise(F.to_json(F.struct(F.lit("segment").alias("type"), F.col("c_mktsegment").alias("id"))))
    ref = F.struct(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("id"))
    return c.select("c_custkey", refs.parse_scope(raw).alias("scope"), refs.ref_type(ref).alias("type"))


@query("SELECT user_id, event_id, CASE user_id % 4 WHEN 0 THEN 'acme:ws:' || user_id WHEN 1 THEN 'acme:principal:' || user_id WHEN 2 THEN CAST(user_id AS VARCHAR) END AS namespace, user_id % 4 <> 3 AS valid FROM events")
def policy_namespaces(spark, d):
    e = read(spark, d, "events")
    kind = F.element_at(F.array(F.lit("ws-"), F.lit("principal-"), F.lit("tenant-"), F.lit("other-")), (F.col("user_id") % 4 + 1).cast("int"))
    name = refs.namespace_of_object(F.lit("acme"), F.concat(kind, "user_id"))
    return e.select("user_id", "event_id", name.alias("namespace"), refs.valid_namespace(F.coalesce(name, F.lit("Not valid"))).alias("valid"))


@query("SELECT page_id, left(regexp_replace(html, '[\\x00-\\x1f\\x7f]', '', 'g'), 256) AS label, replace(replace(replace(replace(replace(left(regexp_replace(url, '[\\x00-\\x1f\\x7f]', '', 'g'), 512), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS url FROM pages")
def sanitized_labels(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", refs.plain_label(F.col("html")).alias("label"), F.element_at(refs.clean_metadata(F.create_map(F.lit("url"), "url")), "url").alias("url"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a, b' WHEN event_id % 3 = 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS value, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS scalar FROM events")
def json_values(spark, d):
    e = read(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, '["a","b"]').when(F.col("event_id") % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", refs.search_value(raw).alias("value"), refs.scalar_text(raw).alias("scalar"))


@query("SELECT p_partkey, 'part/' || p_brand || '/' || p_partkey AS alias, 'snapshot:erp/' || p_type AS citation, p_name || ' — ' || p_type || chr(10) || p_brand AS embedded FROM part")
def key_aliases(spark, d):
    p = read(spark, d, "part")
    attributes, parts = F.create_map(F.lit("Brand"), "p_brand"), F.create_map(F.lit("id"), F.col("p_partkey").cast("string"))
    aliases = refs.alias_forms(["part/{brand}/{id}", "none/{gap}"], attributes, parts)
    return p.select("p_partkey", F.array_join(aliases, ",").alias("alias"), refs.source_path(F.lit(""), F.lit("erp"), F.col("p_type")).alias("citation"), refs.embedding_input(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("embedded"))


@query("SELECT o_orderkey, 'orders/' || o_orderkey AS path, o_clerk AS id FROM (SELECT o_orderkey, 'Clerk-' || o_custkey AS o_clerk FROM orders)")
def front_matter_links(spark, d):
    o = read(spark, d, "orders")
    item = F.concat(F.lit("[[./x/../orders//"), "o_orderkey", F.lit(".md#Clerk-"), "o_custkey", F.lit("|shown]]"))
    link = F.get(refs.matter_links(F.array(F.lit(" "), item)), F.lit(0))
    return o.select("o_orderkey", refs.clean_path(link["path"]).alias("path"), F.get(refs.link_ids(link), F.lit(0)).alias("id"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS at FROM events")
def utc_times(spark, d):
    return read(spark, d, "events").select("event_id", refs.utc_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("at"))


@query("SELECT c_custkey, sha256(c_name || chr(31) || 'nation=' || c_nationkey || chr(30) || 'segment=' || c_mktsegment) AS digest FROM customer")
def content_digests(spark, d):
    attributes = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"))
    return read(spark, d, "customer").select("c_custkey", refs.map_digest(F.col("c_name"), refs.map_text(attributes)).alias("digest"))


@query(f"WITH {VISIBLE_SQL} SELECT event_id, array_to_string(list_sort(list_filter(scopes, lambda s: starts_with(s, 'workspace:'))), ',') AS kept, array_to_string(scopes, ',') AS scopes FROM v")
def scopes_of_payloads(spark, d):
    o = observations(spark, d)
    props = F.to_json(F.struct(F.array().cast("array<string>").alias("scopes"), F.struct("scopes").alias("payload")))
    return o.select("event_id", F.array_join(refs.audit_scopes(F.col("scopes")), ",").alias("kept"), F.array_join(refs.scopes_of(props), ",").alias("scopes"))


# observations and what they assert

SAID = "CASE event_type WHEN 'error' THEN 'bad' WHEN 'click' THEN 'fact' ELSE 'text' END"


def said(spark, d):
    """Events as observations: each asserts an entity, and a fact, a text or something unknown, by its type."""
    e = read(spark, d, "events")
    entity = F.struct(F.lit("entity").alias("assert"), F.to_json(F.struct(F.lit("user").alias("type"), F.col("user_id").cast("string").alias("id"), F.lit("U").alias("title"))).alias("entity"), F.lit(None).cast("string").alias("fact"), F.lit(None).cast("string").alias("text"))
    fact = F.to_json(F.struct(F.struct(F.lit("user").alias("type"), F.col("user_id").cast("string").alias("id")).alias("subject"), F.lit("DID").alias("predicate"), F.concat(F.lit("action:"), "event_type").alias("object"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from")))
    text = F.to_json(F.struct(F.col("event_type").alias("title"), F.concat(F.lit(" seen "), "event_id").alias("content")))
    second = F.struct(F.when(F.col("event_type") == "error", "what").when(F.col("event_type") == "click", "fact").otherwise("text").alias("assert"), F.lit(None).cast("string").alias("entity"), fact.alias("fact"), text.alias("text"))
    return e.select(F.concat(F.lit("obs-"), "event_id").alias("observation_id"), F.lit("ns").alias("namespace"), F.col("event_type").alias("kind"), F.col("ts").cast("string").alias("occurred_at"), F.array().cast("array<string>").alias("scopes"), F.array(entity, second).alias("assertions"))


def no_nodes(spark):
    return spark.createDataFrame([], "namespace string, natural_key string, scopes array<string>")


@query("SELECT 'obs-' || event_id AS observation_id, CASE WHEN event_type = 'error' THEN 'partially_processed' ELSE 'processed' END AS status, CASE WHEN event_type = 'error' THEN 'assertion[1]: unknown assertion' ELSE '' END AS detail FROM events")
def observation_statuses(spark, d):
    o = said(spark, d)
    return projection.statuses(o, projection.project(o, no_nodes(spark))["results"])


@query("""SELECT 'user:' || user_id AS natural_key, 'user' AS type, 'U' AS title FROM events GROUP BY user_id
UNION ALL SELECT DISTINCT 'action:' || event_type, 'action', 'action:' || event_type FROM events WHERE event_type = 'click'
UNION ALL SELECT 'obs-' || event_id || ':text:1', 'note', event_type FROM events WHERE event_type NOT IN ('error', 'click')""")
def projected_nodes(spark, d):
    return projection.project(said(spark, d), no_nodes(spark))["nodes"].select("natural_key", "type", "title")


@query("""SELECT 'fact-' || substr(sha256('ns|user:' || user_id || '|DID|action:' || event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')), 1, 24) AS fact_id, 'user:' || user_id AS subject, 'action:' || event_type AS object, 'obs-' || event_id AS observation_id FROM events WHERE event_type = 'click'""")
def projected_facts(spark, d):
    return projection.project(said(spark, d), no_nodes(spark))["facts"].select("fact_id", "subject", "object", "observation_id")


@query("SELECT 'obs-' || event_id || ':text:1' AS node_key, 'seen ' || event_id AS text, event_type AS title FROM events WHERE event_type NOT IN ('error', 'click')")
def projected_texts(spark, d):
    return projection.project(said(spark, d), no_nodes(spark))["chunks"].select("node_key", "text", "title")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'kind is missing' END, CASE WHEN event_id % 3 = 0 THEN 'nothing in it' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""")
def observation_errors(spark, d):
    e = read(spark, d, "events")
    kind, content = F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type"))
    found = refs.observation_errors(kind, content, F.lit(None).cast("string"), F.array().cast("array<string>"))
    return e.select("event_id", F.array_join(found, "; ").alias("errors"))


@query("SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 1.0 ELSE 0.5 END AS score FROM events WHERE event_type <> 'view' AND (event_id % 97 = 0 OR event_type = 'error')) QUALIFY rank <= 30")
def search_observations(spark, d):
    """Identifiers first, then words, over kind and content; blanked observations have no content and are left out."""
    e = read(spark, d, "events").where("event_type <> 'view'")
    both = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 97 == 0, "ticket AB-7").otherwise("seen"))
    return retrieval.lexical_search(e.withColumn("text", both), ["error"], ["AB-7"], 30, "event_id").withColumn("score", F.col("score").cast("double"))


# snapshots

SNAPS_SQL = """s AS (SELECT o_custkey AS scope, o_orderkey AS seq, o_orderpriority AS id, o_orderdate AS observed FROM orders),
a AS (SELECT *, coalesce(observed < max(observed) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM s),
b AS (SELECT *, CASE WHEN coalesce(id = last_value(CASE WHEN NOT late THEN id END IGNORE NULLS) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'duplicate' WHEN late THEN 'late' ELSE 'apply' END AS verdict FROM a),
c AS (SELECT *, CASE WHEN verdict = 'apply' THEN sum(CASE WHEN verdict = 'apply' THEN 1 ELSE 0 END) OVER (PARTITION BY scope, id ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS apply_no FROM b)"""


def snapshots(spark, d):
    """A customer's orders as snapshots of one scope: the priority is the id, the date when it was observed."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("snapshot_id"), F.col("o_orderdate").alias("observed_at"))
    return ledger.verdicts(o, ["scope"], "snapshot_id", "observed_at", "seq")


@query(f"WITH {SNAPS_SQL} SELECT scope, seq, verdict, CAST(apply_no AS BIGINT) AS apply_no FROM c")
def snapshot_verdicts(spark, d):
    return snapshots(spark, d).select("scope", "seq", "verdict", "apply_no")


@query(f"WITH {SNAPS_SQL}, k AS (SELECT * FROM c WHERE verdict = 'apply') SELECT scope, arg_max(id, seq) AS snapshot_id, arg_max(seq, seq) AS result, max(observed) AS last_observed_at FROM k GROUP BY scope")
def snapshots_last_accepted(spark, d):
    return ledger.last_accepted(snapshots(spark, d).where("verdict = 'apply'").withColumn("result", F.col("seq")), ["scope"])


@query(f"WITH {SNAPS_SQL} SELECT scope, id AS snapshot_id, arg_max(seq, apply_no) AS result, CAST(max(apply_no) + 1 AS INTEGER) AS next_apply_no FROM c WHERE verdict = 'apply' GROUP BY ALL")
def snapshot_results(spark, d):
    return ledger.snapshot_result(snapshots(spark, d).where("verdict = 'apply'").withColumn("result", F.col("seq")), ["scope"])


def offered(spark, d):
    """What suppliers offer, as open entity versions: the supplier's region of scopes is its key's last digit."""
    o = read(spark, d, "lineitem").select(F.lit("ns").alias("namespace"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.lit("all").alias("scope"), F.lit("entity").alias("item_kind"), F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("item_key"), F.when(F.col("l_suppkey") % 4 == 0, "1996-01-01").alias("valid_to")).distinct()
    return o


OFFERED_SQL = "v AS (SELECT DISTINCT 's' || l_suppkey AS source, CAST(l_partkey AS VARCHAR) AS item_key, l_suppkey % 4 <> 0 AS is_open FROM lineitem)"


@query(f"WITH {OFFERED_SQL} SELECT DISTINCT 'part' AS kind, item_key FROM v WHERE is_open")
def open_refs(spark, d):
    return ledger.open_refs(offered(spark, d))


@query(f"WITH {OFFERED_SQL} SELECT DISTINCT 'part' AS kind, item_key FROM v WHERE is_open AND item_key IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25)")
def open_among(spark, d):
    wanted = read(spark, d, "part").where("p_size > 25").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("item_key"))
    return ledger.open_entities(offered(spark, d), wanted)


@query(f"WITH {OFFERED_SQL} SELECT DISTINCT 'part' AS kind, item_key, source, 'all' AS scope FROM v WHERE is_open AND source <> 's1' AND item_key IN (SELECT item_key FROM v WHERE source = 's1') ORDER BY item_key, source LIMIT 101")
def other_owners(spark, d):
    held = offered(spark, d)
    return ledger.other_owners(held, held.where("source = 's1'").select("kind", "item_key"), {"source": "s1", "scope": "all"}, 100)


RELATIONS_SQL = "r AS (SELECT o_orderkey AS id, 'order:' || o_orderkey AS f, 'customer:' || o_custkey AS t FROM orders), k AS (SELECT 'customer:' || c_custkey AS ref FROM customer WHERE c_nationkey < 20 UNION ALL SELECT 'order:' || o_orderkey FROM orders WHERE o_orderstatus <> 'P')"


def relations(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order:"), "o_orderkey").alias("ref_from"), F.concat(F.lit("customer:"), "o_custkey").alias("ref_to"))


def present(spark, d):
    a = read(spark, d, "customer").where("c_nationkey < 20").select(F.concat(F.lit("customer:"), "c_custkey").alias("ref"))
    return a.unionByName(read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("order:"), "o_orderkey").alias("ref")))


@query(f"WITH {RELATIONS_SQL} SELECT id, f NOT IN (SELECT ref FROM k) OR t NOT IN (SELECT ref FROM k) AS pending FROM r")
def relations_materialized(spark, d):
    return ledger.materialize_relations(relations(spark, d), present(spark, d)).select("id", "pending")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey >= 20)")
def relations_waiting_for(spark, d):
    waiting = ledger.materialize_relations(relations(spark, d), present(spark, d))
    new = read(spark, d, "customer").where("c_nationkey >= 20").select(F.concat(F.lit("customer:"), "c_custkey").alias("ref")).unionByName(read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order:"), "o_orderkey").alias("ref")))
    return ledger.pending_for(waiting, new).select("id")


@query(f"WITH {OFFERED_SQL}, p AS (SELECT DISTINCT item_key FROM v WHERE item_key > '10' ORDER BY item_key LIMIT 51) SELECT source, item_key FROM v SEMI JOIN p USING (item_key)")
def entity_page_versions(spark, d):
    return ledger.page_with_versions(offered(spark, d), ["item_key"], ("10",), 50).select("source", "item_key")


STATES_SQL = """m AS (SELECT l_partkey, l_suppkey, CAST(CAST(max(CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN l_quantity END) AS BIGINT) AS VARCHAR) AS a,
CAST(CAST(max(CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN l_quantity END) AS BIGINT) AS VARCHAR) AS c FROM lineitem GROUP BY l_partkey, l_suppkey),
k AS (SELECT l_partkey, l_suppkey, a, CASE WHEN l_suppkey % 5 <> 0 THEN c END AS c FROM m)"""


@query(f"""WITH {STATES_SQL} SELECT l_partkey, l_suppkey, a AS content_hash, '1995-01-01' AS valid_from, CASE WHEN c IS NULL OR c <> a THEN '1997-01-01' END AS valid_to FROM k WHERE a IS NOT NULL
UNION ALL SELECT l_partkey, l_suppkey, c, '1997-01-01', NULL FROM k WHERE c IS NOT NULL AND (a IS NULL OR a <> c)""")
def reconcile_late(spark, d):
    """Three snapshots: of 1995 and 1997, then one of 1996 that comes late and changes nothing, and the last one once more."""
    line = read(spark, d, "lineitem")
    state = lambda upto: line.where(F.col("l_shipdate") < F.lit(upto).cast("timestamp_ntz")).groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("long").cast("string").alias("content_hash"))
    keys = ["l_partkey", "l_suppkey"]
    held = spark.createDataFrame([], "l_partkey bigint, l_suppkey bigint, version_id string, content_hash string, valid_from string, valid_to string")
    last = (None, None)
    for name, at in (("a", "1995-01-01"), ("c", "1997-01-01"), ("b", "1996-01-01"), ("c", "1997-01-01")):
        if ledger.verdict(*last, name, at) == "apply":
            rows = state(at) if name != "c" else state(at).where("l_suppkey % 5 <> 0")
            held, last = ledger.apply_snapshot(held, rows, keys, at, name), (name, at)
    return held.select(*keys, "content_hash", "valid_from", "valid_to")


@query()
def state_fold(spark, d):
    return ledger.state_fold(read(spark, d, "orders"), ["o_orderpriority"], "o_orderkey")


# indexes


def entities_of(spark, d, changed=False):
    p = read(spark, d, "part").select(F.lit("ns").alias("namespace"), F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("item_key"), F.col("p_name").alias("title"), F.create_map(F.lit("brand"), F.when(F.lit(changed) & (F.col("p_size") > 40), "NEW").otherwise(F.col("p_brand"))).alias("attributes"), F.array().cast("array<string>").alias("scopes"), F.lit(None).cast("string").alias("source_path"), F.lit("erp").alias("source"), F.lit("s1").alias("snapshot_id"))
    return index.desired_entities(p, {"part": ["brand"]})


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_key, p_name || chr(10) || 'brand: ' || p_brand AS text, 'snapshot:erp/s1' AS source_path FROM part")
def entity_index_rows(spark, d):
    return entities_of(spark, d).select("item_key", "text", "source_path")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_key, p_size > 40 AS embedded FROM part")
def entity_index_sync(spark, d):
    """Only texts that changed get a new vector: the old ones are marked."""
    old = entities_of(spark, d).withColumn("embedding", F.array(F.lit(7.0)))
    return index.sync_entities(old, entities_of(spark, d, True), lambda t: hash_embedding(t, 8)).select("item_key", (F.size("embedding") > 1).alias("embedded"))


@query(TOP_SQL + "SELECT CAST(vec_id AS VARCHAR) AS item_key, round(greatest(0.0, least(1.0, s)), 6) AS score, row_number() OVER (ORDER BY round(greatest(0.0, least(1.0, s)), 6) DESC, label % 2, CAST(vec_id AS VARCHAR)) AS rank FROM s WHERE label % 3 < 2 QUALIFY rank <= 20")
def entity_search(spark, d):
    e = read(spark, d, "embeddings").select(F.lit("ns").alias("namespace"), (F.col("label") % 2).cast("string").alias("kind"), F.col("vec_id").cast("string").alias("item_key"), F.lit("").alias("title"), F.lit("").alias("text"), F.when(F.col("label") % 3 == 2, F.array(F.lit("workspace:x"))).otherwise(F.array().cast("array<string>")).alias("scopes"), "embedding")
    return index.search_entities(e, query_vector(spark, d), 20, ["0", "1"], allowed=[]).select("item_key", "score", "rank")


@query("SELECT vec_id, len(embedding) AS size FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT -1, 3")
def vector_dimension_errors(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return index.dimension_errors(e.unionByName(spark.createDataFrame([(-1, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<double>")), "vec_id", 64).withColumn("size", F.col("size").cast("long"))


def chunks(spark, d):
    docs = read(spark, d, "documents")
    scopes = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("workspace:w1"), F.concat(F.lit("team:"), "lang"))).otherwise(F.array(F.concat(F.lit("team:"), "lang")))
    return docs.select("doc_id", F.lit("ns").alias("namespace"), F.col("source").alias("node_key"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("meta"), scopes.alias("scopes"))


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND source = 'src1')")
def chunks_deleted_by_meta(spark, d):
    return index.delete_by_meta(chunks(spark, d), {"lang": "en", "source": "src1"}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source <> 'src2' OR doc_id % 7 = 0")
def chunks_deleted_of_key(spark, d):
    return index.delete_for_key(chunks(spark, d), "src2", []).select("doc_id")


@query("SELECT 'ns' AS namespace, source AS node_key, count(*) AS chunks, string_agg(DISTINCT s, ',' ORDER BY s) AS scopes FROM (SELECT source, doc_id, unnest(CASE WHEN doc_id % 7 = 0 THEN ['workspace:w1', 'team:' || lang] ELSE ['team:' || lang] END) AS s FROM documents) GROUP BY source".replace("count(*)", "count(DISTINCT doc_id)"))
def chunks_of_keys(spark, d):
    c = chunks(spark, d).dropDuplicates(["doc_id"])
    return index.count_for_key(c).join(index.union_of_scopes(c), ["namespace", "node_key"]).withColumn("scopes", F.array_join("scopes", ","))


@query("SELECT doc_id, length(text) AS size, NOT (lang = 'en') AS fresh FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en') OR lang = 'en'")
def computed_once(spark, d):
    """A cache by content that holds the English texts: others are computed, each once."""
    docs = read(spark, d, "documents")
    english = docs.where("lang = 'en'").select("text").distinct()
    cache = english.select(F.sha2("text", 256).alias("hash"), F.lit("v1").alias("version"), F.length("text").alias("size"))
    mixed = docs.join(english.withColumnRenamed("text", "t"), F.col("text") == F.col("t"), "left").where("t is null or lang = 'en'").drop("t")
    out, new = index.with_cache(mixed, cache, "text", "v1", lambda m: m.select("hash", F.length("text").alias("size")), "size")
    marks = new.select(F.col("hash").alias("h"), F.lit(True).alias("fresh"))
    return out.withColumn("h", F.sha2("text", 256)).join(marks, "h", "left").select("doc_id", "size", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query("WITH e AS (SELECT p_brand, count(*) AS chunks FROM part GROUP BY p_brand) SELECT c_custkey, c_name, coalesce(chunks, 0) AS chunks FROM customer LEFT JOIN e ON p_brand = 'Brand#' || c_nationkey WHERE contains(lower(c_name), '7') ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def articles(spark, d):
    """Rows by words in their title, the latest first, each with its number of chunks."""
    c = read(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("7"))).withColumn("p_brand", F.concat(F.lit("Brand#"), "c_nationkey"))
    n = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("chunks"))
    return c.join(n, "p_brand", "left").orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_name", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT event_type, median(value) AS p50, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS BIGINT) + 1] AS p95, max(value) AS most FROM events GROUP BY event_type")
def quantiles(spark, d):
    """Median, the value at place int(0.95 n) of all in order, and the greatest, from counts of different values."""
    bins = read(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy("value")
    upto = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("event_type")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2
    return upto.groupBy("event_type").agg(middle.alias("p50"), at(F.least(F.floor(F.col("all") * 0.95), F.col("all") - 1)).alias("p95"), F.max("value").alias("most"))


# graph


@query(f"WITH {EDGES_SQL} SELECT 'out' AS direction, type, dst AS key FROM edges WHERE src = 'supplier:3' AND contains(lower(type), 'suppl') UNION SELECT 'in', type, src FROM edges WHERE dst = 'supplier:3' AND contains(lower(type), 'suppl')")
def related(spark, d):
    return graph.related(edges(spark, d, unique=False), "supplier:3", "Suppl")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT natural_key, type, (SELECT count(*) FROM edges WHERE src = 'nation:3') AS edges_out, (SELECT count(*) FROM edges WHERE dst = 'nation:3') AS edges_in FROM nodes WHERE natural_key = 'nation:3'")
def node_card(spark, d):
    return graph.node_card(nodes(spark, d), edges(spark, d), "nation:3").select("natural_key", "type", "edges_out", "edges_in")


@query(f"WITH {NODES_SQL} SELECT natural_key, type FROM nodes WHERE natural_key IN ('nation:1', 'part:2', 'customer:9')")
def nodes_by_keys(spark, d):
    return graph.by_keys(nodes(spark, d), ["nation:1", "part:2", "customer:9", "part:2", "nothing"]).select("natural_key", "type")


NEAR_SQL = f"""{BOTH_SQL}, h0 AS (SELECT 'customer:1' AS key, 0 AS hop), f1 AS (SELECT DISTINCT b AS key FROM (SELECT b, row_number() OVER (ORDER BY b) AS r FROM (SELECT DISTINCT b FROM u WHERE a = 'customer:1' AND b <> a)) WHERE r <= 10),
f2 AS (SELECT DISTINCT b AS key FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT DISTINCT a, b FROM u WHERE a IN (SELECT key FROM f1 ORDER BY key LIMIT 16) AND b NOT IN (SELECT key FROM f1) AND b <> 'customer:1')) WHERE r <= 10),
k AS (SELECT * FROM (SELECT key, hop FROM h0 UNION ALL SELECT key, 1 FROM f1 UNION ALL SELECT key, 2 FROM f2) ORDER BY hop, key LIMIT 55)"""


@query(f"WITH {NEAR_SQL} SELECT key, hop FROM k")
def neighborhood_keys(spark, d):
    return graph.neighborhood(edges(spark, d, unique=False), spark.createDataFrame([("customer:1",)], "key string"), 2)[0]


@query(f"WITH {NEAR_SQL}, kept AS MATERIALIZED (SELECT key FROM k) SELECT src, type, dst FROM edges JOIN kept a ON a.key = src JOIN kept b ON b.key = dst")
def neighborhood_edges(spark, d):
    return graph.neighborhood(edges(spark, d, unique=False), spark.createDataFrame([("customer:1",)], "key string"), 2)[1].select("src", "type", "dst").distinct()


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, v AS (SELECT natural_key FROM nodes WHERE NOT (type = 'supplier' AND natural_key LIKE '%7')) SELECT src, dst, max(type) AS type FROM edges WHERE src IN (FROM v) AND dst IN (FROM v) GROUP BY ALL")
def projected_graph(spark, d):
    """What a reader without any scope sees: suppliers whose number ends in 7 are one workspace's."""
    hidden = (F.col("type") == "supplier") & F.col("natural_key").endswith("7")
    n = nodes(spark, d).withColumn("scopes", F.when(hidden, F.array(F.lit("workspace:x"))).otherwise(F.array().cast("array<string>")))
    return graph.project_graph(n, edges(spark, d), [])[1].select("src", "dst", "type")


@query("""WITH e AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1996-06-01' AND o_orderstatus <> 'P'),
s AS (SELECT DISTINCT src AS key FROM e JOIN customer ON dst = 'customer:' || c_custkey WHERE c_nationkey = 5)
SELECT key, (SELECT count(*) FROM s) > 20 AS truncated FROM s ORDER BY key LIMIT 20""")
def traverse_as_of(spark, d):
    """Orders of one nation's customers that were running at a time, those without evidence left out."""
    o = read(spark, d, "orders")
    own = o.select(F.concat(F.lit("order:"), "o_orderkey").alias("src"), F.lit("PLACED_BY").alias("type"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"), F.col("o_orderdate").cast("string").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).cast("string").alias("valid_to"), (F.col("o_orderstatus") == "P").alias("evidence_lost"))
    start = read(spark, d, "customer").where("c_nationkey = 5").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"))
    return graph.traverse(nodes(spark, d, "order"), own, start, [{"relation": "PLACED_BY", "direction": "in", "limit": 20}], "1996-06-01 00:00:00").select("key", "truncated")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT src AS subject, type AS predicate, dst AS object FROM edges WHERE type = 'SUPPLIER_IN' AND dst IN ('nation:1', 'nation:2')")
def step_facts(spark, d):
    start = spark.createDataFrame([("nation:1",), ("nation:2",)], "key string")
    return graph.step_facts(edges(spark, d), start, "SUPPLIER_IN", "in").select("subject", "predicate", "object")


@query()
def communities_by_modularity(spark, d):
    """Communities of the graph of regions, nations and suppliers, without the largest hubs."""
    small = edges(spark, d, "IN_REGION", "SUPPLIER_IN")
    return community.cluster(nodes(spark, d, "region", "nation", "supplier").select(F.col("natural_key").alias("key")), small)


@query("WITH g AS (SELECT c_nationkey AS community, 'customer:' || c_custkey AS key FROM customer) SELECT community, max(key) AS name FROM g GROUP BY community HAVING count(*) >= 3".replace("max(key)", "arg_min(key, key)"))
def community_names(spark, d):
    """A name for each nation's customers from the first titles by degree and key."""
    c = read(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("natural_key"), F.col("c_nationkey").cast("long").alias("community"))
    named = community.community_labels(c.withColumn("title", F.col("natural_key")), edges(spark, d, "CUSTOMER_IN"), c.withColumnRenamed("natural_key", "key"), lambda titles: titles[0])
    return spark.createDataFrame(sorted(named.items()), "community bigint, name string")
