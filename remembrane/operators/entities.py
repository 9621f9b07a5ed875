"""Entity resolution: candidates by common character grams, similarity of names, guarded components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.refs import PERMUTATIONS, band_keys, minhash
from ..functions.text import entropy, label_norm, shingles
from ..functions.values import lsh_parameters
from .graph import components

# Similarity in percent for a merge and for a doubtful pair, least entropy of a label, greatest length of a short one.
AUTO, DOUBTFUL, ENTROPY_LEAST, SHORT = 95.0, 75.0, 2.5, 12
# Similarity of a short pair that may merge, of candidates, what a common community adds, the form of labels with a suffix.
SHORT_SCORE, LSH, BOOST = 97.0, 0.7, 5.0
VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                first.append(ch)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_value(x or "", y or "") for x, y in zip(a, b, strict=True)])


def is_variant_pair(a: Column, b: Column) -> Column:
    """Short labels with one stem that ends in a letter and different suffixes, of digits or of two letters and more."""
    part = lambda c, i: F.regexp_extract(c, VARIANT, i)
    fit = a.rlike(VARIANT) & b.rlike(VARIANT)
    return (F.greatest(F.length(a), F.length(b)) < SHORT) & (a != b) & fit & (part(a, 1) == part(b, 1)) & (part(a, 2) != part(b, 2))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Labels of one length that differ in one character at most, or in two neighbours that are swapped."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    at = F.get(places, F.lit(0))
    swapped = (F.size(places) == 2) & (F.get(places, F.lit(1)) == at + 1) & (F.reverse(F.substr(a, at, F.lit(2))) == F.substr(b, at, F.lit(2)))
    return (F.length(a) == F.length(b)) & ((F.size(places) <= 1) | F.coalesce(swapped, F.lit(False)))


def short_blocked(a: Column, b: Column, score: Column) -> Column:
    """Short labels never merge on similarity, unless they are one edit apart at one length and very alike."""
    return (F.greatest(F.length(a), F.length(b)) < SHORT) & ~((score >= SHORT_SCORE) & one_edit_apart(a, b))


def identity_keys(props: Column, fields: tuple[str, ...] = ("inn", "ogrn", "email", "phone", "telegram", "username")) -> Column:
    """field:value for each identifying property that a node has."""
    return F.array_compact(F.array(*(F.when(F.length(F.trim(props[f])) > 0, F.concat(F.lit(f"{f}:"), F.lower(F.trim(props[f])))) for f in fields)))


def band_pairs(nodes: DataFrame, least: float = LSH, without_spaces: bool = True) -> DataFrame:
    """a, b: labels that share a band of their MinHash signatures, each pair once; bands and rows fit the least similarity.

    What shares a band is probably, not surely, as alike as that; `similar_by_shingles` finds the exact pairs.
    """
    bands, rows = lsh_parameters(least, PERMUTATIONS)
    n = nodes.select(label_norm(F.col("label")).alias("label")).where(F.length("label") > 0).distinct()
    text = F.replace("label", F.lit(" "), F.lit("")) if without_spaces else F.col("label")
    each = n.select("label", F.explode(band_keys(minhash(shingles(text)), bands, rows)).alias("band"))
    met = each.withColumnRenamed("label", "a").join(each.withColumnRenamed("label", "b"), "band").where("a < b")
    return met.select("a", "b").distinct()


def label_pairs(nodes: DataFrame, least: float = DOUBTFUL, alike: float = LSH) -> DataFrame:
    """a, b, score: different labels that share so much of their character grams, and are at least so similar, in percent.

    Candidates come from an exact prefix filter, so no pair is lost. Equal labels are one row from the start, so pairs are
    of labels, not of nodes.
    """
    pairs = similar_by_shingles(nodes, alike).select("a", "b")
    scored = pairs.withColumn("score", F.round(100 * jaro_winkler("a", "b"), 6)).where(F.col("score") >= least)
    return scored.where(~is_variant_pair(F.col("a"), F.col("b")))


def boost_same_community(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of pairs whose labels are in one community (label, community) raised by BOOST, to 100 at most."""
    side = lambda end: members.select(F.col("label").alias(end), F.col("community").alias(f"__{end}")).dropDuplicates([end])
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
    return both.withColumn("score", F.least(F.lit(100.0), F.col("score") + F.when(same, BOOST).otherwise(0.0))).drop("__a", "__b")


def decide(pairs: DataFrame) -> DataFrame:
    """Adds decision: merge, ask or keep apart; short or poor labels are never merged on similarity alone."""
    poor = (entropy(F.col("a")) < ENTROPY_LEAST) | (entropy(F.col("b")) < ENTROPY_LEAST)
    short = short_blocked(F.col("a"), F.col("b"), F.col("score"))
    return pairs.withColumn("decision", F.when((F.col("score") >= AUTO) & ~poor & ~short, "merge").when(F.col("score") >= DOUBTFUL, "ask").otherwise("apart"))


def resolve_components(pairs: DataFrame, identities: DataFrame) -> DataFrame:
    """key, component: pairs (a, b) joined unless their identities (key, identity) say otherwise.

    Components without that guard come first, as tables; the guarded joining, which depends on an order, then is a scan
    of each of them by itself. So a task holds the largest component, not all pairs.
    """
    whole = components(pairs.select("a", "b"))
    own = whole.select(F.col("key").alias("a"), F.col("component").alias("g"))
    held = identities.join(whole.withColumnRenamed("component", "g"), "key").select("g", "key", "identity")
    return guarded_components(pairs.select("a", "b").join(own, "a"), held, "g")


def guarded_components(pairs: DataFrame, identities: DataFrame, group: str) -> DataFrame:
    """key, component: pairs joined in order, unless both sides have identities and none in common. Order matters, so each
    `group` (a block of pairs that no other shares keys with) is one scan. pairs: group, a, b; identities: group, key, identity (array).
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {k: set(v) for k, v in zip(right["key"], right["identity"], strict=True)}
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in sorted(zip(left["a"], left["b"], strict=True)):
            p, q = sorted((find(a), find(b)))
            one, two = known.get(p, set()), known.get(q, set())
            if p != q and not (one and two and not one & two):
                parent[q] = p
                known[p] = one | two
        return pd.DataFrame([(k, find(k)) for k in sorted(parent)], columns=["key", "component"])

    return pairs.groupBy(group).cogroup(identities.groupBy(group)).applyInPandas(run, "key string, component string")


def similar_by_shingles(nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, similarity of labels by their character grams, among those that share their rarest gram."""
    n = nodes.select(label_norm(F.col("label")).alias("label")).distinct().select("label", shingles(F.col("label")).alias("s"))
    each = n.select("label", F.explode("s").alias("g"))
    df = each.groupBy("g").agg(F.count("*").alias("df"))
    size = n.select("label", F.size("s").alias("n"))
    ranked = each.join(df, "g").join(size, "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("df", "g")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("label", "g")
    met = prefix.select(F.col("label").alias("a"), "g").join(prefix.select(F.col("label").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    full = met.join(n.select(F.col("label").alias("a"), F.col("s").alias("x")), "a").join(n.select(F.col("label").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return full.select("a", "b", F.round(common / (F.size("x") + F.size("y") - common), 6).alias("similarity")).where(F.col("similarity") >= least)


def arrow_batches(frames: Iterator[pd.DataFrame], extract) -> Iterator[pd.DataFrame]:
    """Apply an extractor (text -> list of rows) to batches of texts; the seam for extraction by a model."""
    for frame in frames:
        yield pd.DataFrame([(k, *row) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) for row in extract(t)])
