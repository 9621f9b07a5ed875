"""Typed property graph as two tables: nodes (natural_key, type, ...) and edges (src, type, dst, ...)."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import strings, valid_at, visible
from ..functions.refs import plain_label
from ..functions.text import neutralize
from ..storage import cut_lineage, lasting

# Degree from which a node is a hub at least, the share of nodes below it, and limits of a traversal.
HUB_LEAST, HUB_SHARE = 50, 0.99
MAX_DEPTH, MAX_STEP_LIMIT, MAX_LEVEL_EDGES = 5, 200, 20_000
#: Folders that a type's adjacency is dealt to by its keys, and keys of a frontier that are named in a read; beyond that they are joined.
ADJACENCY_BUCKETS, MAX_NAMED = 16, 1000


def undirected(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return a.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b")


def write_adjacency(edges: DataFrame, path: str) -> DataFrame:
    """Each edge at both of its ends: key, way (out, in), other, and what else edges have; in folders by type and key, ordered by key.

    A key with very many edges is spread over files by the other end.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    end = lambda a, b, way: edges.select(F.col(a).alias("key"), F.lit(way).alias("way"), F.col(b).alias("other"), *rest, "type")
    rows = end("src", "dst", "out").unionByName(end("dst", "src", "in")).distinct()
    rows = rows.withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % ADJACENCY_BUCKETS).cast("int"))
    parts = max(edges.rdd.getNumPartitions(), edges.sparkSession.sparkContext.defaultParallelism)
    salt = F.pmod(F.xxhash64("other"), F.lit(max(1, parts // ADJACENCY_BUCKETS)))
    rows = rows.repartition(max(parts, ADJACENCY_BUCKETS), "type", "bucket", salt).sortWithinPartitions("type", "bucket", "key", "way", "other")
    rows.write.partitionBy("type", "bucket").parquet(path)
    return rows


def adjacency(edges: DataFrame, name: str = "") -> DataFrame:
    """The adjacency of edges that come from files, written on a session's first call and kept. name tells apart what one set of files gives."""
    return lasting("adjacency", edges, write_adjacency, name)


def at_keys(near: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of an adjacency at the frontier's keys (key), and the frontier, computed.

    Few keys are named in the read, so that only their folders, and of those only the parts that hold them, are opened; many
    are joined. How many there are is looked at first, up to the bound.
    """
    keys = [r["key"] for r in frontier.limit(MAX_NAMED + 1).collect()]
    if len(keys) > MAX_NAMED:
        frontier = cut_lineage(frontier, "frontier")
        return near.join(frontier, "key", "left_semi"), frontier
    buckets = sorted({zlib.crc32(k.encode()) % ADJACENCY_BUCKETS for k in keys if k is not None})
    return near.where(F.col("bucket").isin(buckets) & F.col("key").isin(keys)), near.sparkSession.createDataFrame([(k,) for k in keys], "key string")


def neighbors_by(near: DataFrame, seeds: DataFrame, hops: int = 1, limit: int | None = None) -> DataFrame:
    """As neighbors, from an adjacency: each hop reads what its frontier has, and no edge is shuffled."""
    frontier, seen = seeds.select("key").distinct(), None
    for hop in range(1, hops + 1):
        found, frontier = at_keys(near, frontier)
        seen = frontier.withColumn("hop", F.lit(hop - 1)) if seen is None else seen.unionByName(frontier.withColumn("hop", F.lit(hop - 1)))
        frontier = found.select(F.col("other").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
    found = (frontier.withColumn("hop", F.lit(hops)) if seen is None else seen.unionByName(frontier.withColumn("hop", F.lit(hops)))).where("hop > 0")
    return found.orderBy("hop", "key").limit(limit) if limit else found


def met(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """a, b: undirected steps from keys (key) to others, repeats left in. Each direction by itself, so that the keys meet the scan
    of the edges and only what they reach is shuffled or made distinct."""
    out = edges.join(keys.select(F.col("key").alias("src")), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.join(keys.select(F.col("key").alias("dst")), "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return out.unionByName(back).where("a <> b")


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int | None = None) -> DataFrame:
    """Keys within so many undirected steps of the seeds (key), seeds left out: key, hop (the least). Ordered by both if limited."""
    seen = seeds.select("key").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("key")
    for hop in range(1, hops + 1):
        # each direction by itself, so that the frontier meets the scan of the edges, and only what it reaches is made distinct
        out = edges.join(frontier.withColumnRenamed("key", "src"), "src", "left_semi").select(F.col("dst").alias("key"))
        back = edges.join(frontier.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("key"))
        frontier = out.unionByName(back).distinct().join(seen, "key", "left_anti")
        frontier = cut_lineage(frontier) if hop < hops else frontier
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    found = seen.where("hop > 0")
    return found.orderBy("hop", "key").limit(limit) if limit else found


def components(pairs: DataFrame) -> DataFrame:
    """key, component (the smallest key reachable) of all ends of pairs (a, b): smallest labels of neighbours, and jumps to labels' labels."""
    both = cut_lineage(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("m"))
        now = labels.join(near, "key").select("key", "component", F.least("component", "m").alias("new"))
        jump = now.select(F.col("key").alias("new"), F.col("new").alias("far"))
        now = cut_lineage(now.join(jump, "new").select("key", "component", F.least("new", "far").alias("new")))
        labels = now.select("key", F.col("new").alias("component"))
        if not now.where("component <> new").limit(1).count():
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    """key, degree: how many edge ends a node has, both directions, loops twice."""
    ends = edges.select(F.col("src").alias("key")).unionAll(edges.select(F.col("dst").alias("key")))
    return ends.groupBy("key").agg(F.count("*").alias("degree"))


def hub_threshold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the degree at place int(n * HUB_SHARE) of all n nodes' degrees in order, at least HUB_LEAST.

    Degrees are counted first, so what is ordered is a row for each different degree.
    """
    each = nodes.select(F.col("natural_key").alias("key")).distinct().join(degrees(edges), "key", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    bins = each.groupBy("degree").agg(F.count("*").alias("n"))
    upto = bins.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = upto.where(F.col("upto") > F.floor(F.col("total") * HUB_SHARE))
    return at.agg(F.greatest(F.lit(HUB_LEAST).cast("long"), F.coalesce(F.min("degree"), F.lit(0))).alias("threshold"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, hub_degree: int | None = None) -> DataFrame:
    """key, depth: nodes reached along out-edges; hubs other than seeds are reached but not expanded."""
    hubs = degrees(edges).where(F.col("degree") >= hub_degree).select("key") if hub_degree is not None else None
    seen = seeds.select("key").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = seen.select("key")
    for level in range(1, depth + 1):
        if hubs is not None and level > 1:
            frontier = frontier.join(hubs, "key", "left_anti")
        reached = edges.join(frontier, F.col("src") == F.col("key")).select(F.col("dst").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        frontier = cut_lineage(reached)
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level).cast("long")))
    return seen


def dfs(edges: DataFrame, seeds: Sequence[str], depth: int, most: int = 1000, batch: int = 200) -> list[str]:
    """Keys in depth-first order, neighbours by key, at most `most`: an order over a small part of a graph, kept on the driver.

    Out-edges of what comes next are read as the walk needs them, for up to `batch` nodes at a time. Of a node's
    neighbours the first 2 * most by key are enough: those visited before it are fewer than `most`, and no more follow.
    """
    spark, out = edges.sparkSession, {}
    order: list[str] = []
    seen: set[str] = set()
    stack = [(k, 0) for k in sorted(seeds, reverse=True)]
    while stack and len(order) < most:
        key, at = stack.pop()
        if key in seen:
            continue
        seen.add(key)
        order.append(key)
        if at == depth:
            continue
        if key not in out:
            wanted = list(dict.fromkeys([key, *(k for k, d in reversed(stack) if d < depth and k not in out and k not in seen)]))[:batch]
            ask = spark.createDataFrame([(k,) for k in wanted], "src string")
            place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
            rows = edges.join(F.broadcast(ask), "src").select("src", "dst").distinct().withColumn("r", place).where(F.col("r") <= 2 * most).orderBy("src", "dst").collect()
            out |= {k: [] for k in wanted}
            for r in rows:
                out[r["src"]].append(r["dst"])
        stack += [(k, at + 1) for k in reversed(out[key]) if k not in seen]
    return order


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 8) -> list[str] | None:
    """Keys of a shortest undirected path, of equal ones by the smallest parent; None beyond `most` steps.

    Levels are tables, and each is what the one before it meets in the edges, which may hold repeats; only the path itself comes
    to the driver, one key a step. The goal's neighbours are looked up first, so the level that holds the goal is never made.
    """
    if start == goal:
        return [start]
    spark = edges.sparkSession
    one = lambda key: F.broadcast(spark.createDataFrame([(key,)], "key string"))
    seen = spark.createDataFrame([(start, None)], "key string, parent string")
    frontier = one(start)
    last = cut_lineage(met(edges, one(goal)).select(F.col("b").alias("key")).distinct())
    if not last.limit(1).count():
        return None
    for depth in range(1, most + 1):
        found = frontier.join(last, "key", "left_semi").agg(F.min("key")).first()[0]
        if found is not None:
            path = [goal, found]
            while path[-1] != start:
                path.append(seen.where(F.col("key") == path[-1]).first()["parent"])
            return path[::-1]
        if depth == most:
            return None
        reached = met(edges, frontier).groupBy(F.col("b").alias("key")).agg(F.min("a").alias("parent"))
        frontier = cut_lineage(reached.join(seen.select("key"), "key", "left_anti"))
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            return None
    return None


def live_edges(edges: DataFrame, at: str | None = None, namespaces: Sequence[str] = ()) -> DataFrame:
    """Edges valid at a time (without one: not closed) in these namespaces, those that lost their evidence left out;
    each test where the table has the column for it."""
    if "valid_from" in edges.columns and "valid_to" in edges.columns:
        edges = edges.where(valid_at(F.col("valid_from"), F.col("valid_to"), at))
    if "evidence_lost" in edges.columns:
        edges = edges.where(~F.coalesce("evidence_lost", F.lit(False)))
    return edges.where(F.col("namespace").isin(list(namespaces))) if namespaces and "namespace" in edges.columns else edges


def traverse(nodes: DataFrame, edges: DataFrame | None, start: DataFrame, steps: Sequence[dict], at: str | None = None, namespaces: Sequence[str] = (), near: DataFrame | None = None) -> DataFrame:
    """step, key, truncated: what each step {relation, direction, depth, limit, where} reaches from what the step before reached.

    direction: out, in or both. where: a Column on nodes. A step's limit takes keys in order, after visibility and where;
    truncated tells whether there were more. Only edges that hold at the time `at` count. near: the edges' adjacency, to
    read from instead of them.
    """
    now, out = start.select("key").distinct(), []
    held = live_edges(edges if near is None else near, at, namespaces)
    for number, step in enumerate(steps, 1):
        depth, limit = step.get("depth", 1), step.get("limit", MAX_STEP_LIMIT)
        if not 1 <= depth <= MAX_DEPTH or not 1 <= limit <= MAX_STEP_LIMIT:
            raise ValueError("depth or limit out of range")
        own, direction = held.where(F.col("type") == step["relation"]), step.get("direction", "out")
        if near is not None:
            found = _reached(nodes, own if direction == "both" else own.where(F.col("way") == direction), now, depth, step.get("where"), limit)
            more = found.count() > limit
            now = found.orderBy("key").limit(limit) if more else found
            out.append(now.select(F.lit(number).cast("long").alias("step"), "key", F.lit(more).alias("truncated")))
            continue
        forward, back = own.select(F.col("src").alias("a"), F.col("dst").alias("b")), own.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        links = {"out": forward, "in": back, "both": forward.unionByName(back)}[direction]
        seen, frontier = now, now
        for _ in range(depth):
            frontier = links.join(frontier.withColumnRenamed("key", "a"), "a", "left_semi").select(F.col("b").alias("key")).distinct().join(seen, "key", "left_anti")
            seen = seen.unionByName(frontier)
        reached = seen.join(now, "key", "left_anti")
        fit = nodes.where(step["where"]) if step.get("where") is not None else nodes
        found = cut_lineage(reached.join(fit.select(F.col("natural_key").alias("key")), "key", "left_semi").distinct().orderBy("key").limit(limit + 1))
        more = found.count() > limit
        now = found.orderBy("key").limit(limit) if more else found
        out.append(now.select(F.lit(number).cast("long").alias("step"), "key", F.lit(more).alias("truncated")))
    return reduce(DataFrame.unionByName, out)


def _reached(nodes: DataFrame, near: DataFrame, now: DataFrame, depth: int, where: Column | None, limit: int) -> DataFrame:
    """The first limit + 1 keys in order that a step of a traversal finds in an adjacency."""
    seen, frontier = None, now
    for _ in range(depth):
        links, frontier = at_keys(near, frontier)
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = links.select(F.col("other").alias("key")).distinct().join(seen, "key", "left_anti")
    reached = seen.unionByName(frontier).join(now, "key", "left_anti") if depth > 1 else frontier
    if where is not None:
        reached = nodes.where(where).select(F.col("natural_key").alias("key")).join(reached, "key", "left_semi")
    else:
        reached = nodes.select(F.col("natural_key").alias("key")).join(reached, "key", "left_semi")
    return cut_lineage(reached.distinct().orderBy("key").limit(limit + 1))


def step_facts(edges: DataFrame, frontier: DataFrame, relation: str, direction: str, at: str | None = None) -> DataFrame:
    """subject, predicate, object, each once: the edges of a relation that a step from frontier (key) runs over."""
    own = live_edges(edges, at).where(F.col("type") == relation)
    ends = {"out": ("src",), "in": ("dst",), "both": ("src", "dst")}[direction]
    met = [own.join(frontier.select(F.col("key").alias(e)).distinct(), e, "left_semi") for e in ends]
    return reduce(DataFrame.unionByName, met).select(F.col("src").alias("subject"), F.col("type").alias("predicate"), F.col("dst").alias("object")).distinct()


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int = 1, limit: int = 55, per_seed: int = 10, frontier_cap: int = 16) -> tuple[DataFrame, DataFrame]:
    """key, hop of the surroundings of seeds (key, hop 0) and the edges among them: each node of a frontier brings its first
    per_seed neighbours by key, a frontier has frontier_cap nodes by key, and there are `limit` keys in all, by hop and key.

    Frontiers and keys are sent to the edges, which may hold repeats, so that no edge is shuffled but what they meet."""
    seen = cut_lineage(seeds.select("key").distinct().withColumn("hop", F.lit(0)))
    frontier = seen.select("key")
    for hop in range(1, hops + 1):
        start = F.broadcast(cut_lineage(frontier.orderBy("key").limit(frontier_cap), "frontier"))
        place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        near = met(edges, start).distinct().join(seen.select(F.col("key").alias("b")), "b", "left_anti").withColumn("r", place).where(F.col("r") <= per_seed)
        frontier = cut_lineage(near.select(F.col("b").alias("key")).distinct())
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    kept = cut_lineage(seen.orderBy("hop", "key").limit(limit))
    return kept, induced(edges, kept)


def project_graph(nodes: DataFrame, edges: DataFrame, allowed: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a reader sees them: restricted ones left out, one edge for each pair of ends (the last type by name).

    Ends that are no node are added as stubs where there is no restriction; else edges to them go.
    """
    seen = nodes.where(visible(F.col("scopes"), allowed)) if "scopes" in nodes.columns else nodes
    own = edges.where(visible(F.col("scopes"), allowed)) if "scopes" in edges.columns else edges
    pairs = own.groupBy("src", "dst").agg(F.max("type").alias("type"))
    k = seen.select(F.col("natural_key").alias("key")).distinct()
    if allowed is not None:
        return seen, induced(pairs, k)
    ends = pairs.select(F.col("src").alias("key")).unionByName(pairs.select(F.col("dst").alias("key"))).distinct()
    stubs = ends.join(k, "key", "left_anti").select(F.col("key").alias("natural_key"), F.lit("entity").alias("type"), F.col("key").alias("title"))
    return seen.unionByName(stubs, allowMissingColumns=True), pairs


def related(edges: DataFrame, key: str, relation: str = "") -> DataFrame:
    """direction, type, key of a node's neighbours; relation: a part of the type's name, regardless of case."""
    own = edges.where(F.contains(F.lower("type"), F.lit(relation.lower()))) if relation else edges
    out = own.where(F.col("src") == key).select(F.lit("out").alias("direction"), "type", F.col("dst").alias("key"))
    return out.unionByName(own.where(F.col("dst") == key).select(F.lit("in").alias("direction"), "type", F.col("src").alias("key"))).distinct()


def node_card(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """A node's row with how many edges leave and reach it."""
    own = nodes.where(F.col("natural_key") == key)
    n = lambda end: edges.where(F.col(end) == key).agg(F.count("*").alias(f"n_{end}"))
    return own.crossJoin(F.broadcast(n("src"))).crossJoin(F.broadcast(n("dst"))).withColumnsRenamed({"n_src": "edges_out", "n_dst": "edges_in"})  # one row each


def by_keys(nodes: DataFrame, keys: Sequence[str], aliases: bool = False) -> DataFrame:
    """Nodes by their keys, or by aliases, too; each once."""
    ask = nodes.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "__k string")
    found = nodes.join(F.broadcast(ask), F.col("natural_key") == F.col("__k"), "left_semi")
    if aliases:
        hit = nodes.select("natural_key", F.explode("aliases").alias("__k")).join(F.broadcast(ask), "__k", "left_semi").select("natural_key").distinct()
        found = found.unionByName(nodes.join(hit, "natural_key", "left_semi")).dropDuplicates(["natural_key"])
    return found


def induced(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with both ends among keys (key)."""
    k = keys.select("key").distinct()
    inner = edges.join(k.withColumnRenamed("key", "src"), "src", "left_semi")
    return inner.join(k.withColumnRenamed("key", "dst"), "dst", "left_semi")


def concept_subgraph(links: DataFrame, seeds: DataFrame, per_concept: int = 2, most: int = 8) -> DataFrame:
    """item, concept: items that share a concept with the seeds (item), at most per_concept each and `most` in all.

    links: item, concept. Order is by concept, then item.
    """
    concepts = links.join(seeds, "item", "left_semi").select("concept").distinct()
    other = links.join(concepts, "concept", "left_semi").join(seeds, "item", "left_anti").distinct()
    place = F.row_number().over(Window.partitionBy("concept").orderBy("item"))
    return other.withColumn("__n", place).where(F.col("__n") <= per_concept).drop("__n").orderBy("concept", "item").limit(most)


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10, hub_types: Sequence[str] = ()) -> DataFrame:
    """key, degree of the nodes with the most edges, some types left out; ties by key."""
    kept = nodes.where(~F.col("type").isin(list(hub_types))) if hub_types else nodes
    return degrees(edges).join(kept.select(F.col("natural_key").alias("key")), "key", "left_semi").orderBy(F.desc("degree"), "key").limit(top)


def trace(events: DataFrame, trace_column: str, trace_id, ts: str, limit: int = 200) -> DataFrame:
    """What belongs to a trace, in order of time."""
    return events.where(F.col(trace_column) == trace_id).orderBy(ts, *[c for c in events.columns if c != ts][:1]).limit(limit)


def merge_nodes(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with duplicate keys replaced by their survivors (old, new), without loops and repeats."""
    m = remap.select("old", "new")
    out = edges.join(m.withColumnRenamed("old", "src").withColumnRenamed("new", "__s"), "src", "left").join(m.withColumnRenamed("old", "dst").withColumnRenamed("new", "__d"), "dst", "left")
    out = out.withColumn("src", F.coalesce("__s", "src")).withColumn("dst", F.coalesce("__d", "dst")).drop("__s", "__d")
    return out.where("src <> dst").dropDuplicates(["src", "type", "dst"])


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that cannot be written, as one of their ends is not there."""
    k = nodes.select(F.col("natural_key").alias("__k")).distinct()
    a = edges.join(k, F.col("src") == F.col("__k"), "left_anti")
    return a.unionByName(edges.join(k, F.col("src") == F.col("__k"), "left_semi").join(k, F.col("dst") == F.col("__k"), "left_anti"))


def subgraph_text(nodes: DataFrame, edges: DataFrame, token_budget: int = 2000, per_token: int = 3, seeds: Sequence[str] = ()) -> DataFrame:
    """One row with text: NODE lines, seeds in their order first, then by falling degree (ties by key), and EDGE lines by ends,
    cut at the last whole line within the budget, with how many nodes are left out.

    Labels may hold text from anywhere, so they lose control characters and phrases that instruct a model.
    """
    clean = lambda c: neutralize(plain_label(c))
    most = token_budget * per_token
    column = lambda rows, name, other: F.col(name) if name in rows.columns else F.lit(other)
    named = nodes.select("natural_key", clean(F.coalesce("title", "natural_key")).alias("label"), clean(F.coalesce(column(nodes, "type", "entity"), F.lit("entity"))).alias("kind"), clean(column(nodes, "source_path", "")).alias("source"), clean(F.coalesce(column(nodes, "community_name", None).cast("string"), column(nodes, "community", None).cast("string"), F.lit(""))).alias("community"))
    named = named.join(degrees(edges).withColumnRenamed("key", "natural_key"), "natural_key", "left").dropDuplicates(["natural_key"])
    first = F.array_position(strings(seeds), F.col("natural_key"))
    line = F.concat(F.lit("NODE ["), "kind", F.lit("] "), "label", F.lit(" (ключ="), clean(F.col("natural_key")), F.lit(") [источник="), F.coalesce("source", F.lit("")), F.lit(" community="), "community", F.lit("]"))
    lines = named.select(F.lit(0).alias("o"), F.when(first > 0, first).otherwise(1 << 40).cast("long").alias("p"), (-F.coalesce("degree", F.lit(0))).cast("long").alias("d"), F.col("natural_key").alias("k"), line.alias("line"))
    end = lambda e: named.select(F.col("natural_key").alias(e), F.col("label").alias(f"{e}_label"))
    drawn = edges.join(end("src"), "src").join(end("dst"), "dst")
    arrow = F.concat(F.lit("EDGE "), "src_label", F.lit(" --"), clean(F.col("type")), F.lit("--> "), "dst_label")
    lines = lines.unionByName(drawn.select(F.lit(1).alias("o"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("d"), F.concat_ws("\u001f", "src", "type", "dst").alias("k"), arrow.alias("line")))
    # a line has more than a character, so later ones are beyond the budget
    kept = lines.orderBy("o", "p", "d", "k", "line").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct("o", "p", "d", "k", "line")))
    whole = kept.agg(ordered.alias("l")).select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("t"))
    total = named.agg(F.count("*").alias("n"))
    both = whole.crossJoin(F.broadcast(total))  # one row each
    cut = F.substr("t", F.lit(1), F.lit(most))
    at = F.length(cut) - F.length(F.substring_index(cut, "\n", -1)) - 1
    short = F.substr(cut, F.lit(1), F.when(at > 0, at).otherwise(most))
    shown = F.regexp_count(short, F.lit(r"(?m)^NODE "))
    note = F.concat(F.lit("\n… ("), F.greatest(F.col("n") - shown, F.lit(0)).cast("string"), F.lit(f" nodes left out, budget of about {token_budget} tokens)"))
    return both.select(F.when(F.length("t") > most, F.concat(short, note)).otherwise(F.col("t")).alias("text"))
