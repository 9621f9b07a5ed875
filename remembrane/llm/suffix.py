"""Exact removal of repeated passages by the interval tree of an enhanced suffix array.

A suffix array of a whole corpus does not fit one machine, so passages that can hold a repeat are found first. Among the
windows of `width` bytes, each picks one anchor in it, the q-gram with the smallest hash; equal windows pick the same.
So windows fall into runs by anchor, and a window can only be repeated in a run with an equal anchor. Runs whose anchor
is met once are done. Where all runs of an anchor have equal bytes, or a run has an equal one, all of it is repeated.
What is left, runs with an equal anchor and differing surroundings, goes through the suffix array: its suffixes are sorted
by prefix doubling, and a stack scan over the common prefixes of neighbours gives the intervals of the common-prefix tree.
An interval whose members have differing left neighbours is a maximal repeat, put out with all its occurrences.

An anchor with more than BUSY different runs is split by where it stands in the window: windows of one range of places
have all bytes but RANGE - 1 in common, so a hash of those deals them to groups of their own. A group that is still
beyond BUSY is split to single windows, whose hashes are counted. So no task holds more than BUSY runs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PolyHash, arrow_pieces, materialize, mix64, spread, text_bytes, unused, whole_text

WIDTH, GRAM = 200, 40
#: Different runs in a group that go through one suffix array at most, and places of the anchor that a part of a split has.
BUSY, RANGE = 256, 41
LEVELS = (8, 16, 32, 64, 128, 256)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i + w]) for each i, from minima of blocks' heads and tails."""
    n = len(v)
    blocks = np.concatenate([v, np.full(-n % w, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text number, first start, number of starts, distance from the first start to
    the anchor, anchor hash, hash of all bytes."""
    sizes = np.diff(offsets)
    fit = sizes >= width
    if not fit.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = PolyHash(raw)
    grams = mix64(prefix.windows(gram))
    bits = np.uint64(max(20, len(grams).bit_length()))
    picked = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    edge = np.zeros(len(raw) + 1, np.int32)
    edge[offsets[:-1][fit]] += 1
    np.add.at(edge, offsets[1:][fit] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[: len(picked)]) > 0)
    place = (picked[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    a, count = starts[first], np.diff(np.append(first, len(starts)))
    owner = np.searchsorted(offsets, a, side="right") - 1
    around = mix64(prefix.of(a, a + count - 1 + width) + (place[first] - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return owner, a - offsets[owner], count, place[first] - a, grams[place[first]], around


def suffix_ranks(raw: np.ndarray) -> list[np.ndarray]:
    """Ranks of all substrings of LEVELS bytes, by prefix doubling; past the end counts as zeros."""
    padded = np.concatenate([raw, np.zeros(LEVELS[-1] + 8, np.uint8)])
    key = np.zeros(len(raw), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + len(raw)]
    ranks = [np.unique(key, return_inverse=True)[1].astype(np.uint64)]
    for half in LEVELS[:-1]:
        other = np.concatenate([ranks[-1], np.zeros(half, np.uint64)])[half : half + len(raw)]
        ranks.append(np.unique((ranks[-1] << np.uint64(32)) | other, return_inverse=True)[1].astype(np.uint64))
    return ranks


def common_prefix(raw: np.ndarray, ranks: list[np.ndarray], p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes p and q, `most` at most: from the longest equal blocks down, then byte by byte."""
    length = np.zeros(len(p), np.int64)
    size = len(raw)
    for turn in range(-(-int(most.max(initial=0)) // LEVELS[-1]) + 1):  # blocks of the top level repeat where most is longer
        for level in range(len(LEVELS) - 1, -1, -1):
            step = LEVELS[level]
            i, j = p + length, q + length
            ok = (length + step <= most) & (np.maximum(i, j) < size)
            ok[ok] = ranks[level][i[ok]] == ranks[level][j[ok]]
            length[ok] += step
        if not ok.any() and turn:
            break
    for _ in range(LEVELS[0]):
        i, j = p + length, q + length
        ok = (length < most) & (np.maximum(i, j) < size)
        ok[ok] = raw[i[ok]] == raw[j[ok]]
        length[ok] += 1
    return length


def interval_scan(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, first, last) of each interval of the common-prefix tree over suffixes 0..len(lcp): a scan with a stack."""
    out, stack = [], []
    for i, h in enumerate([*lcp.tolist(), 0], 1):
        left = i - 1
        while stack and stack[-1][0] > h:
            length, left = stack.pop()
            out.append((length, left, i - 1))
        if h and (not stack or stack[-1][0] < h):
            stack.append((h, left))
    return out


def maximal_repeats(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences) of the maximal repeats of at least `least` bytes among suffixes at `starts`.

    least: 256 at most; repeats are told apart by up to 512 bytes, longer ones come out with the length they are known to
    share. ends[i] is where starts[i]'s text ends. A suffix's left neighbour is the byte before it; at the beginning of a
    stretch of starts it counts as unlike any other.
    """
    if least > LEVELS[-1]:
        raise ValueError(f"repeats must be looked for from {LEVELS[-1]} bytes or fewer")
    starts, at = np.unique(starts, return_index=True)
    ends = ends[at]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if len(starts) < 2:
        return
    ranks = suffix_ranks(raw)
    order = sort_to(ranks, starts, least)
    suffix, room = starts[order], (ends - starts)[order]
    follows = np.zeros(len(starts), bool)
    follows[1:] = starts[1:] == starts[:-1] + 1
    left = np.where(follows, raw[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))[order]
    same = np.zeros(len(suffix), bool)  # shares `least` bytes with the suffix before
    same[1:] = common_prefix(raw, ranks, suffix[1:], suffix[:-1], np.full(len(suffix) - 1, least)) >= least
    heads = np.flatnonzero(~same)
    stops = np.append(heads[1:], len(suffix))
    diverse = np.maximum.reduceat(left, heads) != np.minimum.reduceat(left, heads)
    for a, b in zip(heads[(stops - heads > 1) & diverse], stops[(stops - heads > 1) & diverse], strict=True):
        own = a + np.lexsort(tuple(ranks[level][np.minimum(suffix[a:b] + LEVELS[level] * k, len(raw) - 1)] for level, k in ((5, 1), (5, 0))))
        lcp = common_prefix(raw, ranks, suffix[own[1:]], suffix[own[:-1]], np.minimum(room[own[1:]], room[own[:-1]]))
        for length, i, j in interval_scan(np.maximum(lcp, least)):
            members = own[i : j + 1]
            if left[members].max() != left[members].min():
                yield length, suffix[members]


def sort_to(ranks: list[np.ndarray], starts: np.ndarray, depth: int) -> np.ndarray:
    """Order of suffixes by their first `depth` bytes (at most the longest level), all of which lie in the text."""
    level = max((i for i, size in enumerate(LEVELS) if size <= depth), default=0)
    a, b = ranks[level][starts], ranks[level][np.maximum(starts + depth - LEVELS[level], starts)]
    return np.argsort((a << np.uint64(32)) | b, kind="stable")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPAN = "array<struct<a:long,b:long>>"


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """k, uid, text, spans, full for every text with a repeat: spans (a, b) of UTF-8 bytes, unmerged, that cover exactly
    the bytes of `width`-byte strings that also start elsewhere; for texts that are repeated whole (full), text is null.

    docs: doc_id, text, k, uid as given by `keyed`. Rows equal in both are repeats of each other and come out once.
    width: 1 to 256 bytes; the anchor has `gram` bytes, or width if that is less.
    """
    if not 0 < width <= LEVELS[-1]:
        raise ValueError(f"width must be from 1 to {LEVELS[-1]} bytes")
    gram = min(gram, width)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_pieces(batches, "text"):
            owner, a, count, before, anchor, around = anchor_runs(*text_bytes(b.column("text")), width, gram)
            k, uid = (b.column(c).to_numpy()[owner] for c in ("k", "uid"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, uid, a, count, before, anchor.view(np.int64), around.view(np.int64))], ["k", "uid", "a", "n", "p", "anchor", "around"])

    found = materialize(spread(docs.select("k", "uid", "text"), "k").mapInArrow(runs, "k long, uid long, a long, n long, p long, anchor long, around long"), "runs")
    met = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("around").alias("lo"), F.max("around").alias("hi")).where("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike"))
    # a table of its own, so that adaptive execution can split the join at a frequent anchor
    met = materialize(found.join(materialize(met, "anchors"), "anchor"), "met")
    alike = met.where("alike").select("k", "uid", "a", "n", "p", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("anchor"), F.lit(False).alias("ships"), F.lit(False).alias("busy"))
    other = met.where("not alike")
    # of runs with equal bytes one stands for all
    kinds = materialize(other.groupBy("anchor", "around").agg(F.count("*").alias("c"), F.min(F.struct("uid", "k", "a")).alias("first")), "kinds")
    busy = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > BUSY).select("anchor", F.lit(True).alias("busy")), "busy")
    split = busy.limit(1).count() > 0
    kinds = kinds.join(busy, "anchor", "left") if split else kinds.withColumn("busy", F.lit(False))
    other = other.join(kinds, ["anchor", "around"]).select("k", "uid", "a", "n", "p", (F.col("c") > 1).alias("whole"), "anchor", (F.struct("uid", "k", "a") == F.col("first")).alias("ships"), F.coalesce("busy", F.lit(False)).alias("busy"))
    info = alike.unionByName(other).groupBy("k", "uid").agg(
        F.collect_set(F.struct("a", "n", "p", "whole", "anchor", "ships", "busy")).alias("runs"),
    )
    covered = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + F.when(r["whole"], r["n"]).otherwise(0))
    texts = docs.select("k", "uid", "text").join(info.withColumn("covered", covered), ["k", "uid"]).dropDuplicates(["k", "uid"])
    full = F.col("covered") == F.octet_length("text") - (width - 1)
    ships = F.exists("runs", lambda r: r["ships"])
    texts = materialize(texts.select("k", "uid", F.when(~full | ships, F.col("text")).alias("text"), full.alias("full"), "runs"), "texts")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "part", "k", "uid", "a", "n", "bytes"]
        for b in arrow_pieces(batches, "text"):
            rows = []
            for k, uid, text, own in zip(*(b.column(c).to_pylist() for c in ("k", "uid", "text", "runs")), strict=True):
                raw = text.encode()
                for r in own:
                    a, n = r["a"], r["n"]
                    if r["ships"] and not r["busy"]:
                        rows.append((r["anchor"], False, k, uid, a, n, raw[a : a + n - 1 + width]))
                    elif r["ships"]:
                        at = a + r["p"]  # windows that begin at most hi - 1 before it share what lies between
                        for lo in range(0, width - gram + 1, RANGE):
                            hi = min(lo + RANGE, width - gram + 1)
                            first, last = max(a, at - hi + 1), min(a + n - 1, at - lo)
                            if first <= last:
                                common = hashlib.blake2b(raw[at - lo : at - hi + 1 + width], digest_size=8, key=lo.to_bytes(2)).digest()
                                rows.append((int.from_bytes(common, signed=True), True, k, uid, first, last - first + 1, raw[first : last + width]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_pieces(batches, "bytes"):
            raw, offsets = text_bytes(b.column("bytes"))
            n = b.column("n").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            hashes = mix64(PolyHash(raw).windows(width))[offsets[:-1][owner] + inner]
            kept = [pa.array(b.column(c).to_numpy()[owner]) for c in ("group", "k", "uid")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(b.column("a").to_numpy()[owner] + inner), pa.array(hashes.view(np.int64))], ["group", "k", "uid", "a", "hash"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("group", "k", "uid", "a", "n", "bytes")), strict=True):
                if size >= 1 << 20 and row[0] != held[-1][0]:
                    yield repeats(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield repeats(held)

    def repeats(rows: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(r[5]) for r in rows])
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.array([r[4] for r in rows])
        owner = np.repeat(np.arange(len(rows)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
        # a run's first start must not look like the next byte of the run before it: texts' ends keep them apart
        spans: dict[tuple[int, int], int] = {}
        for length, members in maximal_repeats(raw, begins[owner + 1], starts, width):
            for row, at in zip((np.searchsorted(begins, members, side="right") - 1).tolist(), members.tolist(), strict=True):
                spans[row, at] = max(spans.get((row, at), 0), length)
        merged: dict[int, list[tuple[int, int]]] = {}
        for (row, at), length in spans.items():
            a = rows[row][3] + at - int(begins[row])
            merged.setdefault(row, []).append((a, a + length))
        out = [(rows[row][1], rows[row][2], a, b) for row, own in merged.items() for a, b in merge_spans(own)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["k", "uid", "a", "b"])

    shipped = texts.where("text is not null").withColumn("runs", F.filter("runs", lambda r: r["ships"])).where("size(runs) > 0")
    shipped = shipped.select("k", "uid", "text", "runs").mapInArrow(contexts, "group long, part boolean, k long, uid long, a long, n long, bytes binary")
    single = None
    if split:
        shipped = materialize(shipped, "contexts")
        beyond = shipped.where("part").groupBy("group").agg(F.count("*").alias("c")).where(F.col("c") > BUSY).select("group")
        beyond = materialize(beyond, "beyond")
        if beyond.limit(1).count():
            each = materialize(shipped.where("part").join(beyond, "group", "left_semi").select("group", "k", "uid", "a", "n", "bytes").mapInArrow(windows, "group long, k long, uid long, a long, hash long"), "windows")
            again = materialize(each.groupBy("group", "hash").agg(F.count("*").alias("c")).where("c > 1").select("group", "hash"), "again")
            single = each.join(again, ["group", "hash"], "left_semi").select("k", "uid", "a", (F.col("a") + width).alias("b"))
            shipped = shipped.join(beyond, "group", "left_anti")
    partly = shipped.select("group", "k", "uid", "a", "n", "bytes").repartition("group").sortWithinPartitions("group", "uid", "k", "a").mapInArrow(scan, "k long, uid long, a long, b long")
    partly = partly if single is None else partly.unionByName(single)
    partly = partly.groupBy("k", "uid").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    whole = F.transform(F.filter("runs", lambda r: r["whole"]), lambda r: F.struct(r["a"].alias("a"), (r["a"] + r["n"] + (width - 1)).alias("b")))
    out = texts.select("k", "uid", "text", "full", whole.alias("some")).join(partly, ["k", "uid"], "left")
    return out.select("k", "uid", F.when(~F.col("full"), F.col("text")).alias("text"), F.concat("some", F.coalesce("more", F.expr("array()").cast(SPAN))).alias("spans"), "full")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and k and uid, which tell texts apart even where doc_id is null or repeated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64("doc_id", "text").alias("uid"))


def cut(found: DataFrame, with_text: bool) -> DataFrame:
    """k, uid, n_removed, n_spans, kept_sha256 (and what is left, as text if asked for) of texts with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            rows = []
            for k, uid, text, spans, full in zip(*(b.column(c).to_pylist() for c in ("k", "uid", "text", "spans", "full")), strict=True):
                if full:
                    rows.append((k, uid, None, 1, nothing, ""))
                    continue
                raw, parts, at = text.encode(), [], 0
                merged = merge_spans([(s["a"], s["b"]) for s in spans])
                for a, e in merged:
                    parts.append(raw[at:a])
                    at = e
                left = b"".join([*parts, raw[at:]])
                rows.append((k, uid, len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else ""))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["k", "uid", "n_removed", "n_spans", "kept_sha256", "left"])

    return found.mapInArrow(run, "k long, uid long, n_removed long, n_spans long, kept_sha256 string, left string")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text; other columns are left out).

    Every byte that lies in a string of `width` bytes which also starts elsewhere (in any document, the same included)
    is removed; strings are judged on the input. Null text is empty; texts below `width` bytes keep all; rows equal in
    doc_id and text are copies of each other like any others.
    """
    rows = keyed(docs)
    gone = cut(repeated_spans(rows, width), with_text=False).drop("left")
    whole = rows.select("doc_id", "k", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = whole.join(gone, ["k", "uid"], "left")
    removed = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes"))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all columns, with the bytes that `remove_repeats` removes taken out of text (and n_chars, if there, counted anew).

    No row goes; a text that is repeated whole becomes empty. Bytes of a character of which a part is removed go, too.
    """
    k, uid, left = unused(docs, "__k", "__uid", "__left")
    rows = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")), uid: F.xxhash64(F.col("doc_id").cast("long"), whole_text(docs))})
    gone = cut(repeated_spans(keyed(docs), width), with_text=True).select(F.col("k").alias(k), F.col("uid").alias(uid), F.col("left").alias(left))
    out = rows.join(gone, [k, uid], "left").withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
