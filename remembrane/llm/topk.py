"""Exact top-k by inner product with multi-resolution segment statistics.

Each vector is cut into equal segments; with a segment's mean m and deviation s (the root of the sum of squares around
the mean), the squared distance of two segments of n components lies between n(m-m')^2 + (s-s')^2 and the same with +.
So |q|^2 + |x|^2 minus twice the inner product, which is the squared distance, has a lower bound from a few numbers,
and the inner product an upper bound, which gets closer with more segments. A candidate whose bound at some level is
below the k-th best score known so far is left out; what survives all levels is scored exactly in integers.

Bounds hold about any centre and in any order of components, so vectors are taken relative to a mean and their
components put in order of variance, both from a sample of at most SAMPLE rows. The same rows give each query a first
k-th best score. Levels work on tiles of queries by candidates; a row or column of a tile without survivors leaves it,
and a tile without any ends. On vectors without structure (each direction alike) coarse bounds leave nearly all pairs,
and only the finest level prunes: `prune_counts` tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path
from .common import materialize

#: Segments by level, coarse to fine; the finest one has two components a segment.
LEVELS = (4, 16, 64)
#: Queries in a block: what the driver holds and sends to every task at a time is at most about this many vectors.
QUERY_BLOCK = 16_384
#: Rows that centre, order of components and first k-th best scores come from, at most.
SAMPLE = 4096
TILE_Q, TILE_X = 256, 2048


def levels_of(d: int) -> list[int]:
    """Segments by level for vectors of d components."""
    finest = -(-d // 2)
    return [s for s in LEVELS if 2 * s <= finest] + [finest]


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means times sqrt(n), then deviations, by segment: inner products of these rows bound those of the vectors."""
    d = x.shape[1]
    edges = np.linspace(0, d, min(segments, d) + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    squares = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.concatenate([sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0))], axis=1)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats only where every sum is below 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Best:
    """The k best (score, id) of each query so far: highest score, then smallest id; floor: what the k-th is known to reach."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), -np.iinfo(np.int64).max)  # its negation is an int64, too
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.iinfo(np.int64).max)
        self.k = k

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        self.floor[query] = max(self.floor[query], self.scores[query, -1])


@dataclass
class Frame:
    """Where vectors of one length are seen from: a centre and an order of components."""

    centre: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray) -> Frame:
        x = sample.astype(np.float64)
        return cls(np.round(x.mean(0)), np.argsort(-x.var(0), kind="stable"))

    def stats(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """x from the centre, its product with the centre, and its statistics by level."""
        own = x.astype(np.float64) - self.centre
        turned = own[:, self.order]
        return own, own @ self.centre, [segment_stats(turned, s) for s in levels_of(x.shape[1])]


def scan(best: Best, frame: Frame, q_ids: np.ndarray, q: np.ndarray, q_stats: tuple, x_ids: np.ndarray, x: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Take the candidates x into account. counts, if given, gains the pairs met, then those that survive each level."""
    _, q_centre, q_levels = q_stats
    _, x_centre, x_levels = frame.stats(x)
    fixed = float(frame.centre @ frame.centre)
    for at in range(0, len(q), TILE_Q):
        tile = slice(at, min(at + TILE_Q, len(q)))
        rows, cols = np.arange(tile.start, tile.stop), np.arange(len(x))
        alive = np.ones((len(rows), len(cols)), bool)
        if counts is not None:
            counts[0] += alive.size
        for level, (qs, xs) in enumerate(zip(q_levels, x_levels, strict=True)):
            bound = qs[rows] @ xs[cols].T
            bound += 1e-9 * (np.abs(bound) + 1) + 1e-6
            # <q, x> = <q - c, x - c> + <q - c, c> + <x - c, c> + <c, c>
            alive &= bound >= (best.floor[rows] - q_centre[rows] - fixed - 1e-6)[:, None] - x_centre[cols][None, :]
            if counts is not None:
                counts[level + 1] += alive.sum()
            some, any_col = alive.any(1), alive.any(0)
            rows, cols, alive = rows[some], cols[any_col], alive[some][:, any_col]
            if not len(rows):
                break
        if not len(rows):
            continue
        scores = exact_products(q[rows], x[cols])
        alive &= (scores >= best.floor[rows][:, None]) & (q_ids[rows][:, None] != x_ids[cols][None, :])
        for i in np.flatnonzero(alive.any(1)):
            best.add(rows[i], scores[i, alive[i]], x_ids[cols[alive[i]]])


def first_floors(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among rows of a sample: what its final k-th best reaches at least."""
    out = np.full(len(q), -np.iinfo(np.int64).max)
    if len(x) <= k:
        return out
    for at in range(0, len(q), TILE_Q):
        scores = exact_products(q[at : at + TILE_Q], x)
        scores[q_ids[at : at + TILE_Q][:, None] == x_ids[None, :]] = -np.iinfo(np.int64).max
        out[at : at + TILE_Q] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
    return out


def prune_counts(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Pairs of queries with candidates, then how many of them survive each level, in one scan of x."""
    best, frame = Best(len(q), k), Frame.of(x[:SAMPLE])
    best.floor[:] = first_floors(q_ids, q, x_ids[:SAMPLE], x[:SAMPLE], k)
    counts = np.zeros(1 + len(levels_of(x.shape[1])), np.int64)
    stats = frame.stats(q)
    for i in range(0, len(x), TILE_X):
        scan(best, frame, q_ids, q, stats, x_ids[i : i + TILE_X], x[i : i + TILE_X], counts)
    return counts


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of a batch's vectors, by the vectors' length."""
    vectors, ids = batch.column("v"), batch.column("id").to_numpy()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)


def matrices(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and matrix of a bounded number of rows, by the vectors' length; vectors without components are left out."""
    table = rows.select("id", "v").toArrow().combine_chunks()
    return {x.shape[1]: (ids, x) for batch in table.to_batches() for ids, x in by_length(batch) if x.shape[1]}


RESULT = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) for each query row, ties to smaller ids.

    Rows whose id is null, or whose vector is null or holds null or non-finite components, take no part. Only vectors of
    one length are compared. Rows with equal id and vector count once, and no row with the query's own id is a candidate.
    Fewer candidates than k: all of them. Queries go in blocks, one after the other, each against all rows: the driver
    and a task hold one block, the sample and k results for each query of the block; a block's results are written
    before the next one is read.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(F.col(vector_column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), is_query.alias("asks")).distinct()
    rows = materialize(rows.withColumn("h", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks = -(-sizes["q"] // query_block)
    # about SAMPLE of many rows by the hash, in its order; never more
    sample = rows.where(F.col("h") < F.lit(int((1 << 30) * min(1.0, 1.5 * SAMPLE / max(sizes["n"], 1))))).orderBy("h", "id").limit(SAMPLE)
    seen = matrices(sample) if blocks else {}
    path = new_path(spark, "found")
    for b in range(blocks):
        held = {}
        for d, (q_ids, q) in matrices(rows.where("asks").where(F.col("h") % blocks == b)).items():
            near = seen.get(d, (q_ids[:SAMPLE], q[:SAMPLE]))
            held[d] = q_ids, q, Frame.of(near[1]), first_floors(q_ids, q, *near, k)
        sent = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            stats = {}
            for batch in batches:
                for ids, x in by_length(batch):
                    d = x.shape[1]
                    if d not in sent.value:
                        continue
                    q_ids, q, frame, floors = sent.value[d]
                    if d not in best:
                        best[d], stats[d] = Best(len(q), k), frame.stats(q)
                        best[d].floor[:] = floors
                    for i in range(0, len(x), TILE_X):
                        scan(best[d], frame, q_ids, q, stats[d], ids[i : i + TILE_X], x[i : i + TILE_X])
            for d, mine in best.items():
                found, cols = np.nonzero(mine.ids != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][found]), pa.array(mine.ids[found, cols]), pa.array(mine.scores[found, cols])], ["query_id", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        # ids that repeat with other vectors can give one row twice
        found = rows.select("id", "v").mapInArrow(search, RESULT).distinct()
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.destroy()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)
