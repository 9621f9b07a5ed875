"""Best-fit packing by exact complements.

The plan needs only how many pieces there are of each length, at most `capacity` numbers. Lengths are taken from the
longest down. The gap that a length leaves is looked up in an index of single lengths, then of pair sums, then of triple
sums of the lengths still available; a combination that fills it exactly is used as often as its counts allow. What is left is
packed best fit: the longest length that fits the gap goes in, until none does. Each pattern is used until one of its
lengths runs out (or, with a length in it twice, drops below what it needs), so the plan stays small: its size depends
on the capacity, not on the rows. Pieces then take the places of their length in order, each task on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import arrow_pieces, materialize, spread, unused, whole_text


class SumIndex:
    """Single lengths, pairs and triples by their sum, under the counts of lengths that are still available.

    A sum's pairs are told by the larger length, from the most uneven down; its triples by the longest length, each with
    the pairs of the rest. A pair of which a length has run out leaves the front of its list for good.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left, self.gone = left, left == 0
        have = np.flatnonzero(left)
        self.pairs, self.triples, self.start = [], [], [0] * (capacity + 1)
        for total in range(capacity + 1):
            larger = have[(2 * have >= total) & (have < total)]
            self.pairs.append(larger[left[total - larger] > 0][::-1].tolist())
            longest = have[(3 * have >= total) & (have < total - 1)][::-1].tolist()
            self.triples.append([a for a in longest if self.pairs[total - a]])

    def use(self, lengths: np.ndarray, need: np.ndarray) -> int:
        """Take as many sequences of so many of these lengths as there can be; says how many."""
        times = int((self.left[lengths] // need).min())
        self.left[lengths] -= need * times
        self.gone[lengths] = self.left[lengths] == 0
        return times

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The first available pair with this sum and no length above `most`."""
        found, left, gone = self.pairs[total], self.left, self.gone
        at = self.start[total]
        while at < len(found) and (gone[found[at]] or gone[total - found[at]]):
            at += 1
        self.start[total] = at
        for a in found[at:]:
            b = total - a
            if a <= most and left[a] > 0 and left[b] > (a == b):
                return a, b
        return None

    def fill(self, gap: int, size: int) -> tuple[int, ...] | None:
        """`size` available lengths, longest first, that sum to gap."""
        if size == 1:
            return (gap,) if self.left[gap] > 0 else None
        if size == 2:
            return self.pair(gap, gap)
        for a in self.triples[gap]:
            if self.left[a] > 0:
                self.left[a] -= 1
                rest = self.pair(gap - a, a)
                self.left[a] += 1
                if rest:
                    return (a, *rest)
        return None


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences) for counts[length], lengths 1..capacity.

    Exact fills by many short pieces can leave none for later gaps, so plans with combinations of up to one, two and
    three lengths are made, and the one with the fewest sequences is taken.
    """
    return min((plan_with(counts, capacity, most) for most in (3, 2, 1)), key=lambda plan: sum(times for _, times in plan))


def plan_with(counts: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left, plan = counts.astype(np.int64).copy(), []
    left[0] = 0
    index = SumIndex(left, capacity)

    def use(pattern: tuple[int, ...]) -> None:
        plan.append((pattern, index.use(*np.unique(pattern, return_counts=True))))

    if left[capacity]:
        use((capacity,))
    for size in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            while left[length]:
                left[length] -= 1
                partners = index.fill(capacity - length, size)
                left[length] += 1
                if not partners:
                    break
                use((length, *partners))
    for length in range(capacity, 0, -1):
        while left[length]:
            pattern, gap = [length], capacity - length
            left[length] -= 1
            while gap and (fits := np.flatnonzero(left[: gap + 1])).size:
                pattern.append(int(fits[-1]))
                left[pattern[-1]] -= 1
                gap -= pattern[-1]
            np.add.at(left, pattern, 1)
            use(tuple(pattern))
    return plan


def place_ranges(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (first rank, first sequence, offset) by length and rank, and where each length's rows begin."""
    rows, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return table[:, 1:], np.searchsorted(table[:, 0], np.arange(capacity + 2))


#: Rows that a bucket of one length is meant for.
BUCKET_ROWS = 1_000_000


def pack(pieces: DataFrame, capacity: int, order: list[str], buckets: int | None = None, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most `capacity`, gapless from 0.

    Lengths 1..capacity are packed; a null, lower or greater length gets null sequence_id and offset. `order` columns
    should tell rows apart: they settle which row takes which place (rows equal in them take either's). Columns named
    sequence_id or offset are replaced. Rows are ranked within (length, bucket of the order columns' hash), so that no
    task gets all rows of a frequent length; by default there are so many buckets that even if all rows have one length
    about BUCKET_ROWS fall into one, 256 at least. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = list(pieces.columns)
    size, hashed, bucket, n, base, rank = unused(pieces, "__length", "__hash", "__bucket", "__n", "__base", "__rank")
    fits = F.col(length).between(1, capacity)
    marked = materialize(pieces.withColumns({hashed: F.when(fits, F.pmod(F.xxhash64(*order), F.lit(1 << 30))), size: F.when(fits, F.col(length).cast("int"))}), "pieces")
    buckets = buckets or max(256, -(-marked.count() // BUCKET_ROWS))
    marked = marked.withColumn(bucket, F.col(hashed) % buckets).drop(hashed)
    counts = materialize(marked.where(F.col(size).isNotNull()).groupBy(size, bucket).agg(F.count("*").alias(n)), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy(size).agg(F.sum(n).alias("n")).collect():  # a row for each length
        histogram[row[size]] = row["n"]
    table, begins = place_ranges(plan_patterns(histogram, capacity), capacity)

    before = Window.partitionBy(size).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(size, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    ranked = marked.withColumn(rank, F.row_number().over(Window.partitionBy(size, bucket).orderBy(*order))).join(bases, [size, bucket], "left")
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(base) - 1).select(*names, size, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(c).fill_null(0).to_numpy() for c in (size, rank))
            known = b.column(size).is_valid().to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            at = np.argsort(lengths, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(lengths[at])) + 1) if len(at) else []:
                own = table[begins[lengths[part[0]]] : begins[lengths[part[0]] + 1]]
                if known[part[0]] and len(own):
                    k = np.searchsorted(own[:, 0], ranks[part], side="right") - 1
                    sequence[part], offset[part] = own[k, 1] + ranks[part] - own[k, 0], own[k, 2]
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64(), mask=~known) for x in (sequence, offset))], [*names, "sequence_id", "offset"])

    schema = ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, packed little-endian unsigned 32-bit, if with_ids).

    Documents are encoded whole, closed by end_id, and cut only if longer than capacity; the first piece then takes the
    remainder and all others are full. Null text is empty; other columns are left out; repeated rows stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        end = np.array([end_id], bpe.dtype).tobytes()
        for b in arrow_pieces(batches, "text", keeps="byte_bpe"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.frombuffer(bpe.encode(text) + end, bpe.dtype).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity) if len(ids) > capacity else (len(ids),)):
                    start = max(0, stop - (capacity if piece else first)) if len(ids) > capacity else 0
                    raw = ids[start:stop].tobytes()
                    rows.append((doc, piece, start, stop - start, zlib.crc32(raw), raw if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names)

    return spread(rows).mapInArrow(encode, "doc_id long, " + PIECES + (", ids binary" if with_ids else ""))
