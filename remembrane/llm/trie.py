"""Conversation prefix trie by family-first merging.

Conversations are cogrouped by base id: the base's first turns, five at most, meet its family, each conversation is rebuilt,
and the family's own small trie is combined where its rows are, before anything else moves. Only combined family nodes are
shuffled again, to be merged into nodes of the whole trie.

A node is named by the sum, over the turns of its path, of hashes of (depth, role, text). Sums can be taken by blocks, so
no task needs all turns of a conversation: blocks of 1024 turns are summed apart and shifted by what came before them.
Subtrees need no walk either: the nodes whose smallest member is c are the lower end of c's own path, so what a subtree
holds is the sum over its members of what they own there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns of one conversation that are summed in one window, as a power of two.
BLOCK = 10
#: A node's name is two numbers below this one.
NAME = 1 << 48
#: Turns that a conversation may take from its base.
LEADS = 6
NODE = ["n1", "n2"]


def own_turns(turns: DataFrame) -> DataFrame:
    """conv_id, base, turn, role, digest and n_chars of every turn; texts go no further. Rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(conv.isNotNull())
    return rows.select(conv.alias("conv_id"), (conv - conv % 100).alias("base"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(named, 256).alias("digest"), F.length(text).cast("long").alias("n_chars"))


def offsets(df: DataFrame, block: str, **sums: str) -> DataFrame:
    """conv_id, block and, for each named sum, what lies in the conversation's earlier blocks (name_before) and later ones
    (name_after), as a table; conversations of one block have no row."""
    each = df.groupBy("conv_id", block).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums])
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = each.select(
        "conv_id", block, F.count("*").over(whole).alias("blocks"),
        *[(F.sum(c).over(so_far) - F.col(c)).alias(f"{c}_before") for c in sums],
        *[(F.sum(c).over(whole) - F.sum(c).over(so_far)).alias(f"{c}_after") for c in sums],
    ).where(F.col("blocks") > 1)
    pick = {"before": lambda c: F.col(f"{c}_before"), "after": lambda c: F.col(f"{c}_after")}
    return materialize(found.select("conv_id", block, *[(pick[w](c) % NAME if c in NODE else pick[w](c)).cast("long").alias(f"{c}_{w}") for c, both in sums.items() for w in both.split()]), "trie-offsets")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `at`, each turn's number in its conversation: by turn (null first), role, then the turn's digest."""
    rows = rows.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK), F.lit(-(1 << 60)))).withColumn("rows", F.lit(1).cast("long"))
    earlier = offsets(rows, "block", rows="before")
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "digest")
    local = rows.withColumn("at", F.row_number().over(order).cast("long") - 1)
    return local.join(earlier, ["conv_id", "block"], "left").withColumn("at", F.col("at") + F.coalesce("rows_before", F.lit(0)))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, base, depth, digest, n_chars of every rebuilt conversation's path, with a textless row of depth 0 for each.

    The first h turns come from the conversation's base (all if it has fewer, none without it), the rest are its own after
    the first h, where h is crc32 of the id in decimal modulo 6.
    """
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS
    rows = materialize(numbered(materialize(own_turns(turns), "trie-turns")).select("conv_id", "base", "at", "digest", "n_chars"), "trie-numbered")
    heads = rows.where((F.col("conv_id") == F.col("base")) & (F.col("at") < LEADS - 1)).select("base", "at", "digest", "n_chars")
    family = rows.groupBy("conv_id", "base").agg(F.lit(0).cast("long").alias("depth")).withColumn("lead", lead)
    taken = family.drop("depth").join(heads, "base").where(F.col("at") < F.col("lead")).withColumn("depth", F.col("at") + 1)
    had = heads.groupBy("base").agg(F.count("*").alias("had"))
    own = rows.withColumn("lead", lead).where(F.col("at") >= F.col("lead")).join(had, "base", "left")
    own = own.withColumn("depth", F.least("lead", F.coalesce("had", F.lit(0))) + F.col("at") - F.col("lead") + 1)
    root = family.withColumn("digest", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0).cast("long"))
    names = ["conv_id", "base", "depth", "digest", "n_chars"]
    return root.select(names).unionByName(taken.select(names)).unionByName(own.select(names))


def memberships(paths: DataFrame) -> DataFrame:
    """A row for each node on each conversation's path: base, block, conv_id, depth, node (n1, n2), its parent (p1, p2), n_chars
    of its last turn, `rest`: characters of the path from that turn on, and `last`: whether the path ends there.

    Comes dealt by base and block, so that a family's nodes combine without another shuffle.
    """
    salted = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    term = lambda i: F.when(F.col("depth") == 0, 0).otherwise(F.conv(F.substring(salted, 12 * i + 1, 12), 16, 10).cast("long"))
    rows = paths.withColumn("block", F.shiftright(F.greatest(F.col("depth") - 1, F.lit(0)), BLOCK))
    rows = materialize(rows.select("base", "block", "conv_id", "depth", "n_chars", term(0).alias("n1"), term(1).alias("n2"), F.lit(1).cast("long").alias("rows")), "trie-paths")
    beside = offsets(rows, "block", n1="before", n2="before", n_chars="after", rows="after")
    rows = rows.join(beside, ["conv_id", "block"], "left").repartition("base", "block")
    whole = Window.partitionBy("base", "block", "conv_id")
    so_far = whole.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = lambda c: F.coalesce(c, F.lit(0))
    node = {c: (F.sum(c).over(so_far) + other(f"{c}_before")) % NAME for c in NODE}
    parent = {c: (node[c] - F.col(c) + NAME) % NAME for c in NODE}
    return rows.select(
        "base", "block", "conv_id", "depth", "n_chars", node["n1"].alias("n1"), node["n2"].alias("n2"), parent["n1"].alias("p1"), parent["n2"].alias("p2"),
        (F.sum("n_chars").over(whole) - F.sum("n_chars").over(so_far) + F.col("n_chars") + other("n_chars_after")).alias("rest"),
        ((F.max("depth").over(whole) == F.col("depth")) & (other("rows_after") == 0)).alias("last"),
    )


def family_nodes(members: DataFrame) -> DataFrame:
    """Each family's own trie: a row for a node with its members of that family combined; `ends` are the ids whose path ends there,
    199 at most, as a family holds no more."""
    ends = F.array_sort(F.collect_list(F.when(F.col("last"), F.col("conv_id"))))
    return members.groupBy("base", "block", *NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("rest").alias("rest"), F.max("n_chars").alias("n_chars"),
        F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), ends.alias("ends"),
    )


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids that end at each node; families come in order, so ids do, and one family's are held at a time."""
    schema = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
    node, base, ids, state, any_yet, done = None, None, [], hashlib.sha256(), False, []

    def flush() -> None:
        nonlocal any_yet, ids
        if ids:
            state.update(((b"," if any_yet else b"") + ",".join(map(str, sorted(ids))).encode()))
            any_yet, ids = True, []

    for batch in batches:
        for n1, n2, b, ends in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "base", "ends")), strict=True):
            if (n1, n2) != node:
                flush()
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, base, state, any_yet = (n1, n2), b, hashlib.sha256(), False
            elif b != base:
                flush()
                base = b
            ids += ends
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    if node is not None:
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), schema, strict=True)], schema=schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. (conv_id, depth) names a node.

    turns: conv_id, turn, role, text; other columns are left out. Null role or text counts as empty; null turns come first;
    equal turns are ordered by role, then by the digest of role and text; repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation. No conversations: no rows, not even a root. Texts leave the first scan as digests and
    lengths, so very long ones cost no memory later.
    """
    members = materialize(memberships(rebuilt(turns)), "trie-members")
    families = materialize(family_nodes(members), "trie-families")
    nodes = families.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("rest").alias("rest"), F.max("n_chars").alias("n_chars"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = materialize(nodes, "trie-nodes")
    below = nodes.where(F.col("depth") > 0).groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(below, NODE, "left").fillna(0, ["n_children"]), "trie-children")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("n_chars").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    share = F.when(F.col("depth") < F.col("top"), F.col("owned")).otherwise(F.col("rest"))
    subtree = members.join(owned, "conv_id").groupBy(*NODE).agg(F.sum(share).alias("distinct_chars"), F.sum("leaf").alias("n_leaves"))
    ordered = families.where(F.size("ends") > 0).select(*NODE, "base", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "base")
    ends = ordered.mapInArrow(digest_ends, "n1 long, n2 long, ends_sha256 string")
    above = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(subtree, NODE).join(ends, NODE, "left")
    top = found.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = top.unionByName(found.where(F.col("depth") > 0).join(above, ["p1", "p2"]))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("rest") - F.col("distinct_chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
