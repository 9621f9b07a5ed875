"""Extraction of people and organisations by a model, behind checks, cached by text and model, and resumable; then their resolution.

The model is a callable (instructions, text) -> answer. It only sees texts that have lost what could instruct it, and its
answers only count if they hold a JSON object of nodes and edges without faults: anything else gives no nodes and a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.refs import plain_label
from ..functions.text import label_norm, neutralize
from ..storage import cut_lineage
from .entities import decide, identity_keys, label_pairs, resolve_components
from .graph import merge_nodes
from .observing import fragment_violations

# What a model is shown of a text, what counts as an entity, its identifying fields, confidence of what a model found.
MAX_SHOWN, KINDS, IDENTITY, CONFIDENCE = 8000, ("person", "org"), ("email", "inn", "ogrn", "phone"), 0.7
INSTRUCTIONS = 'Find the named people and organisations in the text. Answer with a JSON object only: {"nodes": [{"id": slug, "label": name, "type": "person" or "org", "email": if given, "inn": if given}], "edges": []}'
NODE = "struct<id: string, label: string, type: string, " + ", ".join(f"{f}: string" for f in IDENTITY) + ">"
FRAGMENT = f"struct<nodes: array<{NODE}>, edges: array<struct<source: string, target: string>>>"
CACHE = f"hash string, model string, nodes array<{NODE}>"
Model = Callable[[str, str], str]


def answers(texts: DataFrame, model: Model, tries: int = 3) -> DataFrame:
    """hash, answer, failed of texts (hash, text): a call that raises is made again; the last reason is kept, and other rows go on."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                answer = failed = None
                for _ in range(tries):
                    try:
                        answer, failed = str(model(INSTRUCTIONS, text)), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a model raises is the row's own failure
                        failed = f"model failed: {type(e).__name__}"
                out.append((key, answer, failed))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, ["hash", "answer", "failed"])

    return texts.select("hash", "text").mapInArrow(ask, "hash string, answer string, failed string")


def checked(found: DataFrame) -> DataFrame:
    """hash, nodes, errors of answers: nodes only where nothing is wrong with the whole answer."""
    whole = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), FRAGMENT)
    none = F.expr(f"cast(array() as array<{NODE}>)")
    edges = F.coalesce(F.col("whole.edges"), F.expr("cast(array() as array<struct<source: string, target: string>>)"))
    rows = found.withColumn("whole", whole).withColumn("nodes", F.coalesce(F.col("whole.nodes"), none))
    broken = F.when(F.col("failed").isNotNull(), F.array("failed")).when(F.col("whole").isNull() | (F.col("whole.nodes").isNull() & F.col("whole.edges").isNull()), F.array(F.lit("no JSON object of nodes")))
    rows = rows.withColumn("errors", F.coalesce(broken, fragment_violations(F.col("nodes"), edges)))
    return rows.select("hash", F.when(F.size("errors") == 0, F.col("nodes")).otherwise(none).alias("nodes"), "errors")


def fragments(docs: DataFrame, key: str, text: str, model: Model, name: str, cache: str, most: int | None = MAX_SHOWN, slices: int = 4) -> DataFrame:
    """key, nodes, errors for every document with a text that is not blank.

    cache: a folder of answers by the text's hash and the model's name. Each different text that it lacks is asked once.
    Answers are added to it slice by slice, so a run that is stopped and begun again asks only for what is left; answers
    with errors are not kept, and are asked for again. most: characters that the model is shown (None: all).
    """
    spark = docs.sparkSession
    shown = F.col(text) if most is None else F.substring(F.col(text), 1, most)
    hashed = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("key"), F.sha2(F.col(text), 256).alias("hash"), neutralize(shown).alias("text"))
    wanted = hashed.groupBy("hash").agg(F.min("text").alias("text"))
    known = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("model") == name).select("hash", "nodes")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    failed = None
    for part in range(slices):
        left = wanted.where(F.pmod(F.xxhash64("hash"), F.lit(slices)) == part).join(known().select("hash"), "hash", "left_anti")
        found = cut_lineage(checked(answers(left, model)), "answers")
        found.where(F.size("errors") == 0).select("hash", F.lit(name).alias("model"), "nodes").write.mode("append").parquet(cache)
        bad = found.where(F.size("errors") > 0)
        failed = bad if failed is None else failed.unionByName(bad)
    done = known().dropDuplicates(["hash"]).withColumn("errors", F.array().cast("array<string>")).unionByName(failed)
    return hashed.select("key", "hash").join(done, "hash").select("key", "nodes", "errors")


def mentions(found: DataFrame) -> DataFrame:
    """src, natural_key, type, title, and the identifying fields: what each document's fragment names, people and organisations with id and label only."""
    each = found.select(F.col("key").cast("string").alias("src"), F.explode("nodes").alias("n"))
    kind, own, label = F.lower("n.type"), F.trim("n.id"), F.trim(plain_label(F.col("n.label")))
    rows = each.select("src", F.concat(kind, F.lit(":"), own).alias("natural_key"), kind.alias("type"), label.alias("title"), *[F.nullif(F.trim(F.col(f"n.{f}")), F.lit("")).alias(f) for f in IDENTITY], own.alias("own"))
    return rows.where(F.col("type").isin(*KINDS) & (F.length("own") > 0) & (F.length("title") > 0)).drop("own")


def entity_nodes(named: DataFrame) -> DataFrame:
    """natural_key, type, title, confidence and the identifying fields: the first document's title (by key), each field from the last that has it."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("src", f))).alias(f) for f in IDENTITY]
    return named.groupBy("natural_key").agg(F.first("type").alias("type"), F.min_by("title", F.struct("src", "title")).alias("title"), F.lit(CONFIDENCE).alias("confidence"), *last)


def stars(groups: DataFrame, key: str) -> DataFrame:
    """a, b: of the rows with an equal key, the smallest node with each other one; a group of n gives n - 1 pairs."""
    least = groups.groupBy(key).agg(F.min("node").alias("a"))
    return groups.join(least, key).where("node <> a").select("a", F.col("node").alias("b")).distinct()


def merge_pairs(nodes: DataFrame, forced: Sequence[tuple[str, str]] = (), blocked: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to merge, and doubtful ones: forced ones, a common identity, equal titles after folding, similar titles.

    Blocked pairs never are merged themselves. Only nodes of one type meet. Pairs of groups are stars, not all pairs.
    """
    spark = nodes.sparkSession
    props = nodes.select(F.col("natural_key").alias("node"), "type", F.explode(identity_keys(F.struct(*IDENTITY), IDENTITY)).alias("i"))
    by_identity = stars(props.select("node", F.concat_ws("|", "type", "i").alias("k")), "k")
    titled = cut_lineage(nodes.select(F.col("natural_key").alias("node"), "type", "title", label_norm(F.col("title")).alias("label")).where(F.length("label") > 0))
    by_title = stars(titled.select("node", F.concat_ws("|", "type", "label").alias("k")), "k")
    first = cut_lineage(titled.groupBy("type", "label").agg(F.min("node").alias("node")))
    near = decide(label_pairs(first.select("label").distinct()))
    side = lambda c, n: first.select(F.col("label").alias(c), "type", F.col("node").alias(n))
    alike = near.join(side("a", "x"), "a").join(side("b", "y"), ["b", "type"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "decision")
    given = spark.createDataFrame([tuple(sorted(p)) for p in forced], "a string, b string")
    barred = spark.createDataFrame([tuple(sorted(p)) for p in blocked], "a string, b string")
    pairs = given.unionByName(by_identity).unionByName(by_title).unionByName(alike.where("decision = 'merge'").select("a", "b")).distinct()
    return pairs.join(barred, ["a", "b"], "left_anti"), alike.where("decision = 'ask'").select("a", "b").distinct().join(barred, ["a", "b"], "left_anti")


def resolve_documents(docs: DataFrame, key: str, text: str, model: Model, name: str, cache: str, forced: Sequence[tuple[str, str]] = (), blocked: Sequence[tuple[str, str]] = (), most: int | None = MAX_SHOWN) -> dict[str, DataFrame]:
    """nodes, edges (MENTIONS), candidates (a, b to ask about), errors (key, errors) of all documents: extraction, then resolution.

    Nodes merge unless both have identities and none in common; edges go to the node that is left.
    """
    found = cut_lineage(fragments(docs, key, text, model, name, cache, most), "fragments")
    named = cut_lineage(mentions(found), "mentions")
    nodes = cut_lineage(entity_nodes(named), "entities")
    pairs, doubtful = merge_pairs(nodes, forced, blocked)
    held = nodes.select(F.col("natural_key").alias("key"), identity_keys(F.struct(*IDENTITY), IDENTITY).alias("identity")).where(F.size("identity") > 0)
    groups = cut_lineage(resolve_components(cut_lineage(pairs), held), "entity-groups")
    remap = groups.where("key <> component").select(F.col("key").alias("old"), F.col("component").alias("new"))
    kept = nodes.join(remap.select(F.col("old").alias("natural_key")), "natural_key", "left_anti")
    edges = merge_nodes(named.select("src", F.lit("MENTIONS").alias("type"), F.col("natural_key").alias("dst")).distinct(), remap)
    return {"nodes": kept, "edges": edges, "candidates": doubtful, "errors": found.where(F.size("errors") > 0).select("key", "errors"), "merged": remap}
