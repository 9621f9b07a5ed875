"""Near-duplicate documents by one-permutation MinHash.

A document's set holds the distinct shingles of its lower-cased words, each as a 64-bit hash. One hash deals them into
bins; a bin's smallest hash is its value, and an empty bin takes the value of another bin chosen by a hash of its own
number and the attempt, again and again until that bin is not empty (optimal densification). Bins in bands of a few
give bucket keys; in a bucket all members are joined to one centre only, so a bucket of n gives n - 1 candidates.
Candidates are confirmed on full sets. Buckets whose members are still in different components then get another centre,
so that members that the first one did not link are compared as well. What a few centres leave open is settled by an
exact prefix filter over the members of the buckets that are left.

Documents with equal sets are one class from the start and only its smallest doc_id is compared with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PolyHash, arrow_pieces, materialize, mix64, spread, text_bytes, unused, whole_text, word_spans

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
ROUNDS = 4


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin (end last)."""
    starts, ends, first = word_spans(raw, offsets)
    word = mix64(PolyHash(LOWER[raw]).of(starts, ends))
    words = np.diff(first)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begins[-1], np.uint64)
    long = words >= size
    at = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(n[long])])[:-1], n[long]) + np.arange(n[long].sum())
    whole = np.zeros(len(at), np.uint64)
    for k in range(size):
        whole += word[at + k] * ODD[k]
    out[np.repeat(long, n)] = whole
    for w in range(1, size):  # fewer words than a shingle has: the sequence itself
        short = np.flatnonzero(words == w)
        out[begins[short]] = sum((word[first[short] + k] * ODD[k] for k in range(w)), np.full(len(short), w, np.uint64) * ODD[63])
    out = mix64(out)
    for a, b in zip(begins[:-1][n > 1], begins[1:][n > 1], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begins[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[begins]


def signatures(hashes: np.ndarray, begins: np.ndarray, bins: int) -> np.ndarray:
    """bins values of each set that is not empty (rows of empty ones hold 0); hashes ascend within a set; bins: a power of 2."""
    docs = len(begins) - 1
    owner = np.repeat(np.arange(docs), np.diff(begins))
    key = owner * bins + (hashes >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    values, full = np.zeros(docs * bins, np.uint64), np.zeros(docs * bins, bool)
    values[key[first]], full[key[first]] = hashes[first], True
    given = values.copy()
    empty = np.flatnonzero(~full & np.repeat(np.diff(begins) > 0, bins))
    attempt = 0
    while len(empty):
        attempt += 1
        pick = (mix64((empty % bins).astype(np.uint64) + np.uint64(attempt * bins)) % np.uint64(bins)).astype(np.int64)
        donor = empty - empty % bins + pick
        found = full[donor]
        given[empty[found]] = values[donor[found]]
        empty = empty[~found]
    return given.reshape(docs, bins)


def band_keys(given: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many bins."""
    docs, bins = given.shape
    banded = given.reshape(docs, bins // rows, rows)
    total = np.arange(bins // rows, dtype=np.uint64)[None, :] * ODD[62]
    for r in range(rows):
        total = total + banded[:, :, r] * ODD[r]
    return mix64(total)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in edges (a, b), by min labels and pointer jumps."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        now = materialize(labels.join(near, "node").select("node", "label", F.least("label", "m").alias("new")), "labels")
        if now.where("label <> new").isEmpty():
            return labels.withColumnRenamed("label", "component")
        jump = now.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = materialize(now.join(jump, "new").select("node", F.least("new", "far").alias("label")), "labels")


def merged(links: DataFrame) -> DataFrame:
    """node, component for the nodes of links (a, b) that are not their component's name."""
    return materialize(connected_components(links).where("node <> component"), "moves")


def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows, their component replaced by the one that it went into."""
    rows = rows.join(moves.select(F.col("node").alias("component"), F.col("component").alias("__into")), "component", "left")
    return rows.withColumn("component", F.coalesce("__into", "component")).drop("__into")


def followed(steps: list[DataFrame]) -> DataFrame:
    """node, component of all steps (in their order), where each node is after the last of them.

    A node that moves is no component's name any more, so it is in one step only: each row meets the steps after its own
    in one join, and what is placed by the result goes through one join, whatever the number of steps.
    """
    into = steps[-1]
    for step in reversed(steps[:-1]):
        into = into.unionByName(materialize(moved(step, into).select("node", "component"), "moves"))
    return into


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id, n, s: the packed set of each document in wanted (doc_id)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_pieces(batches, "text"):
            hashes, begins = shingle_sets(*text_bytes(batch.column("text")), size)
            packed = [hashes[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(begins)), pa.array(packed, pa.binary())], ["doc_id", "n", "s"])

    # merged whatever the sizes: wanted grows with the documents
    return materialize(docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(pack, "doc_id long, n long, s binary"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; other columns of numbers stay) whose sets have 100 * intersection >= percent * union."""
    kept = pairs.columns

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in kept], kept)

    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return materialize(full.mapInArrow(agree, ", ".join(f"{c} long" for c in kept)), "links")


def exact_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in rest (rep, component), among them each whose sets agree to percent.

    A prefix filter: with each set in one order, rarest hashes first, two sets that agree have their first common hash
    early in both, in the smaller one earlier still. Of a hash's sets only those outside its most frequent component
    are joined with all, so that a large component is not paired with itself.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = pa.array(np.frombuffer(row["s"], np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(t), row[c])) for c in ("rep", "component", "sid", "n")), t], ["rep", "component", "sid", "n", "t"])

    own = rest.join(sets.withColumnRenamed("doc_id", "rep"), "rep").withColumn("sid", F.xxhash64("rep", "s")).dropDuplicates(["rep", "sid"])
    each = materialize(own.select("rep", "component", "sid", "n", "s").mapInArrow(unpack, "rep long, component long, sid long, n long, t long"), "hashes")
    # a hash of one set comes first in it and is in no other
    common = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    counted = materialize(each.join(common, "t"), "common")
    of_set = Window.partitionBy("rep", "sid")
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "t")) - 1
    ranked = counted.withColumn("left", F.col("n") - at).drop("df", "sid").where(F.lit(100) * F.col("left") >= F.lit(percent) * F.col("n"))
    ranked = materialize(ranked, "prefixes")
    votes = ranked.groupBy("t", "component").agg(F.count("*").alias("c"))
    split = votes.groupBy("t").agg(F.count("*").alias("k"), F.max_by("component", F.struct("c", "component")).alias("most")).where("k > 1").select("t", "most")
    ranked = materialize(ranked.join(split, "t"), "prefixes")
    end = lambda rows, name: rows.select("t", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "component", "n", "left")))
    small = ranked.where(F.lit(100 + percent) * F.col("left") >= F.lit(2 * percent) * F.col("n"))
    most, other = F.col("component") == F.col("most"), F.col("component") != F.col("most")
    agree = F.lit(100 + percent) * F.least("left_x", "left_y") >= F.lit(percent) * (F.col("n_x") + F.col("n_y"))
    sized = (F.col("n_x") <= F.col("n_y")) & (F.lit(100) * F.col("n_x") >= F.lit(percent) * F.col("n_y"))
    met = [end(x, "x").join(end(y, "y"), "t").where(sized & agree & (F.col("component_x") != F.col("component_y"))) for x, y in ((small.where(other), ranked), (small.where(most), ranked.where(other)))]
    found = materialize(met[0].unionByName(met[1]).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")), "found")
    return found.distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are left out).

    Null text and text without words: an empty set, linked with nothing. A document with fewer words than `size` has
    its whole sequence as its only shingle. A null doc_id is linked with nothing and kept, its component null. Rows
    that repeat a doc_id are one document whose texts all link it. bands and rows: powers of 2.
    """
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_pieces(batches, "text"):
            hashes, begins = shingle_sets(*text_bytes(batch.column("text")), size)
            n = np.diff(begins)
            keys = band_keys(signatures(hashes, begins, bands * rows), rows).view(np.int64)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (hashes, mix64(hashes + ODD[61]))]
            marks = [(x[begins[1:]] - x[begins[:-1]]).view(np.int64) for x in sums]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(m) for m in marks), lists], ["doc_id", "n", "h1", "h2", "bands"])

    signed = materialize(spread(rows_in).mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, bands array<long>"), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    members = materialize(usable.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "rep"), "members")
    own = members.where("doc_id = rep").select("doc_id").distinct()
    keyed = usable.join(own, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    keyed = materialize(keyed.join(shared, "key", "left_semi"), "buckets")
    sets = full_sets(rows_in, keyed.select(F.col("rep").alias("doc_id")).distinct(), size)
    sizes = materialize(sets.groupBy(F.col("doc_id").alias("rep")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "sizes")

    # rows that repeat a doc_id with other texts join their classes
    least = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b <> z").select("doc_id", "b")
    links = materialize(members.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"), "links")
    # a component is named by its smallest rep; links found later join components, so only those links are gone through
    moves = [] if links.isEmpty() else [merged(links)]
    keyed = keyed.join(sizes, "rep").withColumn("component", F.col("rep"))
    keyed = materialize(moved(keyed, moves[0]) if moves else keyed, "placed")
    tried = None
    for turn in range(ROUNDS):
        split = keyed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), centre(turn)).where("least <> most").select("key", "centre.*")
        held = materialize(keyed.join(split, "key"), "held")
        if held.isEmpty():
            keyed = held.select(keyed.columns)
            break
        # a centre meets all others of its bucket now, so it leaves: pairs not tried are those of the members that stay
        keyed = held.where("rep <> centre").select(keyed.columns)
        sized = F.lit(100) * F.least("hi", "centre_hi") >= F.lit(percent) * F.greatest("lo", "centre_lo")
        pairs = held.where((F.col("component") != F.col("other")) & sized).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"), F.col("component").alias("p"), F.col("other").alias("q"))
        pairs = pairs.dropDuplicates(["a", "b"])
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue  # other centres can have some
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        new = confirm(pairs, sets, percent)
        if not new.isEmpty():
            moves.append(merged(new.select(F.col("p").alias("a"), F.col("q").alias("b"))))
            keyed = materialize(moved(keyed, moves[-1]), "placed")
    split = keyed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    rest = materialize(keyed.join(split, "key").select("rep", "component").distinct(), "rest")
    if not rest.isEmpty():
        pairs = exact_pairs(rest, sets, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        new = confirm(materialize(pairs, "pairs"), sets, percent)
        if not new.isEmpty():
            for end in ("a", "b"):
                new = new.join(rest.select(F.col("rep").alias(end), F.col("component").alias(f"of_{end}")), end)
            moves.append(merged(new.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
    placed = members.withColumnRenamed("rep", "component")
    placed = (moved(placed, followed(moves)) if moves else placed).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def centre(turn: int) -> Column:
    """The member of a bucket that all others are compared with, its component and sizes: first the ends of the bucket, which
    buckets that overlap have in common, then members that differ from bucket to bucket."""
    chosen = F.struct(F.col("rep").alias("centre"), F.col("component").alias("other"), F.col("lo").alias("centre_lo"), F.col("hi").alias("centre_hi"))
    if turn == 0:
        return F.min(chosen).alias("centre")
    if turn == 1:
        return F.max(chosen).alias("centre")
    return F.min_by(chosen, F.xxhash64(F.lit(turn), "key", "rep")).alias("centre")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, without the rows of documents that are in a group and not its smallest doc_id.

    Of rows that repeat a doc_id the one with the smallest text stays (null first); rows with a null doc_id stay.
    """
    other, first = unused(docs, "__gone", "__first")
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(other)).distinct()
    out = docs.join(materialize(gone, "gone"), F.col("doc_id").cast("long") == F.col(other), "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        out = out.withColumn(first, place).where((F.col(first) == 1) | F.col("doc_id").isNull()).drop(first)
    return out
