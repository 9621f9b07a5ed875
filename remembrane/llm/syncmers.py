"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is k code points in a row, its inner substrings are the k - s + 1 runs of s code points in it, each as a hash.
It is a closed syncmer if the smallest of them is the first or the last one. That depends on the k-mer alone, so equal
passages give equal anchors whatever lies around them, in text with or without spaces. Each end of a text is padded with
k - 1 marks, all different and no code points, so texts of any length, one code point included, follow the same rule:
two texts that begin alike share the anchors of their beginnings, however short either of them is.

A fingerprint holds every anchor of the whole text with its place, as `place:hash` in hex. Likeness is by positional
matching: each hash's first places in both texts give a shift, a shift that another anchor has as well is a match, and
the likeness is the share of matched hashes among all of both.

An anchor is a 64-bit number here: its place, then 32 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import input_parts, range_bounds, whole_text

K, S = 32, 12
PAD = K - 1
#: Marks before and after a text, four bytes each, beyond the last code point.
BEFORE, AFTER = (b"".join((0x110000 + base + i).to_bytes(4, "big") for i in range(PAD)) for base in (0, PAD))
NONE = "cast(array() as array<bigint>)"
LOW = 0xFFFFFFFF


def code_points(text: Column) -> Column:
    """Four bytes for each code point."""
    return F.encode(text, "UTF-32")


def anchor(pos: Column, points: Column, size: int) -> Column:
    """The anchor of the `size` code points that begin at pos."""
    found = F.substring(points, (pos * 4 + 1).cast("int"), F.lit(size * 4))
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(found), 32))


def place_of(x: Column) -> Column:
    return F.shiftright(x, 32)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once. As an element of an array it is an object that lambdas refer to; a column of
    bytes would be copied out of its row at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def syncmers(points: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of four-byte code points in order of their places; none if there are fewer than k."""
    w = k - s

    def least(g: Column, sign: int) -> Column:
        """Where the k-mers begin whose smallest inner hash is the first one (sign 1) or the last one (-1)."""

        def start(x: Column, i: Column) -> Column:
            test = None  # nested to the right, so that the first smaller hash ends it; beyond the text it is null
            for j in range(w, 0, -1):
                mine = x <= F.get(g, i + j if sign > 0 else i - j)
                test = mine if test is None else mine & test
            return F.when(test, i if sign > 0 else i - w)

        return F.array_compact(F.transform(g, start))

    def found(b: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.shiftright(F.octet_length(b), 2) - s), lambda i: F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * s))))
        starts = let(hashes, lambda g: F.sort_array(F.array_union(least(g, 1), least(g, -1))))
        return F.transform(starts, lambda i: anchor(i, b, k))

    return let(points, lambda b: F.when(F.octet_length(b) >= 4 * k, found(b)).otherwise(F.expr(NONE)))


def all_anchors(text: Column) -> Column:
    """The closed syncmers of a text between its marks, places counted from the first mark; none if it is empty."""
    return F.when(F.length(text) > 0, syncmers(F.concat(F.lit(BEFORE), code_points(text), F.lit(AFTER)))).otherwise(F.expr(NONE))


def shifted(anchors: Column, by: Column) -> Column:
    return F.transform(anchors, lambda x: x + F.shiftleft(by.cast("long"), 32))


def digest(anchors: Column) -> Column:
    """A fingerprint: the anchors as text."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.concat(F.hex(place_of(x)), F.lit(":"), F.lpad(F.hex(x.bitwiseAND(LOW)), 8, "0")))), " ")


def firsts(anchors: Column) -> Column:
    """Each hash with its first place, as one number (hash above), ascending."""
    upper = lambda x: F.shiftright(x, 32)
    ordered = F.sort_array(F.transform(anchors, lambda x: F.shiftleft(x, 32).bitwiseOR(place_of(x))))
    return let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (upper(x) != upper(F.get(s, i - 1)))))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two columns made by `firsts`; 1 where both are empty."""
    odd = F.lit(1 << 31)
    upper = lambda x: F.shiftright(x, 32)
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x + odd)))  # a hash in both is in two neighbours, that of a first

    def shifts(m: Column) -> Column:
        met = F.filter(F.sequence(F.lit(0), F.size(m) - 2), lambda i: upper(F.get(m, i)) == upper(F.get(m, i + 1)))
        return F.when(F.size(m) > 1, F.sort_array(F.transform(met, lambda i: F.get(m, i + 1) - F.get(m, i)))).otherwise(F.expr(NONE))

    def backed(d: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(d, i) == x, F.lit(False))
        return F.when(F.least(F.size(a), F.size(b)) > 1, F.size(F.filter(d, lambda x, i: same(x, i - 1) | same(x, i + 1)))).otherwise(F.size(d))

    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(let(let(let(both, shifts), backed), lambda n: n / (total - n)))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, pos, hash: a row for each anchor of each document (null text is empty and has none)."""
    rows = docs.select("doc_id", all_anchors(whole_text(docs)).alias("a"))
    return rows.select("doc_id", F.explode("a").alias("x")).select("doc_id", place_of(F.col("x")).alias("pos"), F.col("x").bitwiseAND(LOW).alias("hash"))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key, by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    heads, groups = array(bounds[::step]), F.array(*(array(bounds[i : i + step]) for i in range(0, len(bounds), step)))
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    group = below(heads)
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.get(groups, group - 1)))


def fingerprints_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id order, the last one's next being the first; a single row is its own next.
    Rows that share a doc_id are ordered by text, a null doc_id comes last, null text is empty and has the empty
    fingerprint; two empty ones have likeness 1. Equal shifts are interchangeable, so ties need no order. Other columns
    are left out. Rows are dealt to ranges of doc_id (by default four for each split of the input, four for each shuffle
    partition at least), and each range also gets a copy of the first row of the next one, so that one shuffle brings
    neighbours together; which range is next comes from a table of two numbers a range. Anchors don't depend on what is
    around, so those of the edited text are those of its two parts but for the k-mers across their seam and at its end;
    each text's are computed once. A row holds all anchors of its text and of the next one, some nine numbers for every
    hundred code points, so a text's length is bounded by what one row may hold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    bounds = range_bounds(rows, "doc_id", parts or 4 * max(input_parts(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("bucket", range_of(F.col("k"), bounds))

    heads = rows.groupBy("bucket").agg(F.max("k").alias("k"))  # a row for each range
    down = Window.orderBy(F.desc("bucket"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("goes", F.coalesce(F.lag("bucket").over(down), F.last("bucket").over(whole)))
    first = rows.join(F.broadcast(heads), ["bucket", "k"]).groupBy("goes", "k", "doc_id").agg(F.min("text").alias("text"))
    copies = first.withColumnRenamed("goes", "bucket")
    dealt = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)).select("doc_id", "text", "k", "bucket", "copy"))

    # so many tasks, which adaptive execution leaves apart: they have much to compute for few bytes
    dealt = dealt.repartition(len(bounds) + 1, "bucket")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("k"), "text")
    dealt = dealt.withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    size = F.length("text")
    dealt = dealt.withColumn("stays", (size - F.floor(size / 3)).cast("int"))
    dealt = dealt.withColumn("comes", F.least(size - F.col("stays"), F.length("next")).cast("int"))
    edited = F.when(F.col("copy") == 0, F.concat(F.substring("text", F.lit(1), F.col("stays")), F.substring("next", F.lit(1), F.col("comes")))).otherwise("")
    dealt = dealt.withColumn("edited", edited).drop("next").withColumn("a", all_anchors(F.col("text")))
    # of a short edited text, all at once; else only what lies around the seam and at the end is hashed anew
    size, e = F.length("edited"), code_points(F.col("edited"))
    short, seam = size < 2 * K, F.greatest(F.col("stays") - PAD, F.lit(0))
    part = lambda start, n: F.substring(e, (start * 4 + 1).cast("int"), (n * 4).cast("int"))
    dealt = dealt.select(
        "doc_id", "bucket", "copy", "place", "a", "stays", "comes", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), size.cast("long").alias("size"), short.alias("short"), seam.alias("seam"),
        all_anchors(F.when(short, F.col("edited")).otherwise("")).alias("small"),
        F.when(short, F.lit(b"")).otherwise(part(seam, F.least("stays", F.lit(PAD)) + F.least("comes", F.lit(PAD)))).alias("across"), F.when(short, F.lit(b"")).otherwise(F.concat(part(size - PAD, F.lit(PAD)), F.lit(AFTER))).alias("tail"),
    )
    dealt = dealt.withColumns({"mid": syncmers(F.col("across")), "tail": syncmers(F.col("tail"))}).drop("across")
    following = Window.partitionBy("bucket").orderBy("place")
    dealt = dealt.withColumn("next_a", F.coalesce(F.lead("a").over(following), F.expr(NONE))).where("copy = 0")
    kept = F.filter("a", lambda x: place_of(x) + 1 <= F.col("stays"))
    added = F.filter("next_a", lambda x: (place_of(x) >= PAD) & (place_of(x) + 1 <= F.col("comes")))
    joined = F.concat(kept, shifted(F.col("mid"), F.col("seam") + PAD), shifted(added, F.col("stays")), shifted(F.col("tail"), F.col("size")))
    dealt = dealt.withColumn("e", F.when(F.col("short"), F.col("small")).otherwise(joined))
    dealt = dealt.withColumns({f"first_{c}": firsts(F.col(c)) for c in ("a", "e", "next_a")})
    dealt = dealt.withColumns({"near_edited": likeness(F.col("first_a"), F.col("first_e")), "near_next": likeness(F.col("first_a"), F.col("first_next_a"))})
    return dealt.select("doc_id", "n_chars", "edited_sha256", digest(F.col("a")).alias("fingerprint"), digest(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")
