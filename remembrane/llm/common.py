"""What the operators share: tables that cut lineage, views of Arrow text as bytes, hashes and words of it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut_lineage


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there and lost executors cost no rework."""
    return cut_lineage(df, name)


def whole_text(df: DataFrame, column: str = "text"):
    """The text column as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where df has columns that differ from them by case alone, or not at all."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


#: What a worker process keeps between tasks, by operator: functions that let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    """Frees what other operators keep in this worker, and gives freed memory back to the system where it can be."""
    for name, release in KEPT.items():
        if name != but:
            release()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def arrow_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most `most` bytes of `column`, or of one row where a row alone is longer.

    keeps names what the calling operator keeps in the worker for its next task; all else is let go before and after.
    """
    let_go(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    let_go(keeps)


def text_offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], kind)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array (no nulls) and where each row starts, with the end last."""
    ends = text_offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values that deal the column's rows evenly; nulls are left out."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, at, 10000).alias("b")).first()["b"]
    return sorted(set(found or []))


def input_parts(df: DataFrame) -> int:
    """How many splits Spark reads df's files in: a measure of the input's size that costs no scan."""
    return max(1, df.rdd.getNumPartitions())


def spread(df: DataFrame, by: str = "doc_id") -> DataFrame:
    """df, dealt by a column where its files give fewer splits than there are cores: work on texts is dear, moving few of them is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, by) if input_parts(df) < cores else df


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; empty segments give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    return total[offsets[1:]] - total[offsets[:-1]]


class PolyHash:
    """64-bit hashes of any substring of a byte array from prefix sums of byte codes times powers of an odd number."""

    BASE = 0x9E3779B97F4A7C15
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(PolyHash._powers) < n:
            m = max(n, 1 << 20)
            for name, base in (("_powers", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                full = np.full(m, base, np.uint64)
                full[0] = 1
                setattr(PolyHash, name, np.cumprod(full))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.CODES[raw] * PolyHash._powers[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * PolyHash._inverse[starts]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every substring of `size` bytes, by start."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * PolyHash._inverse[:n] if n > 0 else np.zeros(0, np.uint64)


#: ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without bytes marked in `between`, ASCII white space by default) in row order, and each row's first word, end last."""
    gap = between[raw]
    begins = np.empty(len(raw) + 1, bool)
    begins[0] = True
    begins[1:] = np.append(gap, True)[:-1] if len(raw) else True
    begins = begins[: len(raw)]
    if len(raw):
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begins &= ~gap
    stops = np.ones(len(raw), bool)
    if len(raw):
        stops[:-1] = gap[1:]
        ends = offsets[1:][offsets[1:] > 0]
        stops[ends - 1] = True
    stops &= ~gap
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)
