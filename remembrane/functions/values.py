"""Identity, time, vectors, scopes: small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_visibility

# How much a recent observation adds, and after how many days half of it.
RECENCY_BONUS, RECENCY_HALF_LIFE_DAYS = 0.005, 14.0


def digest_id(prefix: str, *parts: Column, separator: str = "|", length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substr(F.sha2(F.concat_ws(separator, *parts), 256), F.lit(1), F.lit(length)))


def fact_id(namespace: Column, subject: Column, predicate: Column, obj: Column, valid_from: Column) -> Column:
    return digest_id("fact-", namespace, subject, predicate, obj, valid_from)


def version_fact_id(namespace: Column, source: Column, scope: Column, item: Column, snapshot: Column, apply_no: Column) -> Column:
    salt = F.when(apply_no > 1, apply_no.cast("string"))
    return digest_id("fact-", namespace, source, scope, item, snapshot, salt, separator="\u001f")


def observation_id(namespace: Column, system: Column, stream: Column, external_id: Column, content: Column) -> Column:
    """From the source's identity, or from the content where the source gives none."""
    own = F.concat_ws("|", system, stream, external_id)
    return digest_id("obs-", namespace, F.when(external_id.isNotNull(), own).otherwise(F.sha2(content, 256)))


def derived_fact_key(content: Column, trace: Column) -> Column:
    return F.concat_ws(":", F.lit("fact"), F.nullif(trace, F.lit("")), F.substr(F.sha1(content), F.lit(1), F.lit(16)))


def normalize_ts(value: Column) -> Column:
    """ISO time in whole UTC seconds with Z; null where it is no time."""
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recency_bonus(occurred_at: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(occurred_at)) / 86_400_000_000.0)
    return F.when(occurred_at.isNull() | now.isNull(), 0.0).otherwise(RECENCY_BONUS * F.pow(F.lit(0.5), days / RECENCY_HALF_LIFE_DAYS))


def token_estimate(text: Column, chars_per_token: float = 3.0) -> Column:
    size = F.ceil(F.length(text) / F.lit(max(chars_per_token, 1.0)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), size))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clamp_score(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed words: the low bits of a word's md5 give its place, another bit its sign. dim: a power of two, 256 at most."""
    words = F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: F.length(w) > 0)
    low = lambda w: F.conv(F.substr(F.md5(w), F.lit(31), F.lit(2)), 16, 10).cast("int")
    sign = lambda w: F.when(F.conv(F.substr(F.md5(w), F.lit(1), F.lit(1)), 16, 10).cast("int") >= 8, -1.0).otherwise(1.0)
    marks = F.transform(words, lambda w: F.struct((low(w) % dim).alias("i"), sign(w).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(marks, lambda m: m["i"] == i), F.lit(0.0), lambda a, m: a + m["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def merge_scopes(existing: Column, incoming: Column) -> Column:
    """Visibility scopes add up only where the object had one; of the other scopes the last writer's stay."""
    restricted = F.exists(existing, is_visibility)
    vis = lambda a: F.filter(a, is_visibility)
    rest = F.filter(incoming, lambda s: ~is_visibility(s))
    return F.array_distinct(F.concat(F.when(restricted, F.array_union(vis(existing), vis(incoming))).otherwise(F.array().cast("array<string>")), rest))


def narrow(server: Column, client: Column) -> Column:
    """What both sides allow; nothing where either list is empty."""
    return F.array_intersect(server, client)


def scope_struct(scope: Column) -> Column:
    return F.struct(F.substring_index(scope, ":", 1).alias("type"), F.substr(scope, F.instr(scope, ":") + 1).alias("id"))


def ref_key(ref: Column) -> Column:
    """A reference struct (key, type, id) as key, or type:id."""
    return F.coalesce(ref["key"], F.concat(ref["type"], F.lit(":"), ref["id"]))


def json_object(raw: Column) -> Column:
    """The JSON object in a text that may hold more around it."""
    return F.try_parse_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))


def lsh_parameters(threshold: float, permutations: int, steps: int = 128) -> tuple[int, int]:
    """Bands and rows whose false positives and negatives around a threshold add up to the least."""

    def area(f, lo: float, hi: float) -> float:
        width = (hi - lo) / steps
        return sum(f(lo + (i + 0.5) * width) for i in range(steps)) * width

    best = (float("inf"), 1, permutations)
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            hit = lambda s, b=bands, r=rows: 1 - (1 - s**r) ** b
            best = min(best, (0.5 * area(hit, 0, threshold) + 0.5 * area(lambda s, h=hit: 1 - h(s), threshold, 1), bands, rows))
    return best[1], best[2]
