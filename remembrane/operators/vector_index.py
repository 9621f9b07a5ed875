"""Approximate neighbours by cosine: lists of vectors around centres, with product-quantised residuals, re-ranked exactly.

Centres come from Lloyd rounds whose sums are made where the vectors are, over a sample of about MAX_SAMPLE rows at most; every
row is indexed. A list is a folder, so a search opens the folders of the centres nearest to its queries, scores the codes
there, and reads the vectors of the best ones only. How many lists to open is measured: `probes_for` looks where the true
neighbours of some queries lie. `effort_for` measures how many of the best codes to read vectors of as well, as codes of vectors
that are alike in all directions tell little. Scores are compared by 12 decimals and equal ones go by id, so copies of a vector
are found in the same order by a search and by all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage, lasting, lasting_path

#: Rows that centres and codes are learnt from, at most about; lists at most; rounds; components and entries of a code's part.
MAX_SAMPLE, MAX_LISTS, ROUNDS, WIDTH, ENTRIES = 50_000, 4096, 8, 8, 256
#: Queries that are searched at once, and candidates for each result that are scored exactly, unless a search asks for more.
BLOCK, REFINE = 1024, 10


@dataclass
class VectorIndex:
    rows: DataFrame  # list, id, code, vector (of length 1)
    centres: np.ndarray
    books: np.ndarray


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of floats, each of length 1 (zero vectors stay zero)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(size > 0, size, 1)


def usable(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """id, vector of the rows whose vector is there, without nulls or values that are no numbers, of the most frequent length; and that length."""
    v = F.col(vector).cast("array<float>")
    good = rows.select(F.col(id_column).alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    dim = first["n"] if first else 0
    return good.where(F.size("vector") == dim), dim


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def added_up(group: pa.Table) -> pa.Table:
    """One centre's sums of all tasks in one row."""
    total = group.column("total").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
    return pa.table({"centre": group.column("centre").slice(0, 1), "n": pa.array([int(np.sum(group.column("n").to_numpy()))]), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def lloyd(vectors: DataFrame, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after some rounds; each task sums up its vectors by centre, so what moves is a row for a task and centre."""
    kind = "centre int, n long, total array<double>"
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(now.shape), np.zeros(len(now), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), now.shape[1])
                at = nearest(x, now)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(now))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen]), pa.array(total[seen].tolist(), pa.list_(pa.float64()))], ["centre", "n", "total"])

        centres = now.copy()
        for r in vectors.select("vector").mapInArrow(sums, kind).groupBy("centre").applyInArrow(added_up, kind).collect():
            centres[r["centre"]] = np.array(r["total"], np.float32) / r["n"]
        if np.abs(centres - now).max() < 1e-4:
            break
    return centres


def code_books(residuals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Entries of one part of the codes: Lloyd rounds over a sample's residuals in that part."""
    entries = residuals[np.sort(rng.choice(len(residuals), min(ENTRIES, len(residuals)), replace=False))].copy()
    for _ in range(ROUNDS):
        at = nearest(residuals, entries)
        total = np.zeros_like(entries)
        np.add.at(total, at, residuals)
        n = np.bincount(at, minlength=len(entries))[:, None]
        entries = np.where(n > 0, total / np.maximum(n, 1), entries).astype(np.float32)
    return np.concatenate([entries, np.repeat(entries[:1], ENTRIES - len(entries), axis=0)])


def learn(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and code books. Fewer rows than centres give as many centres as there are different rows among those to begin with."""
    n = rows.count()
    if not n:
        return np.zeros((1, max(dim, 1)), np.float32), np.zeros((1, ENTRIES, WIDTH), np.float32)
    share = min(1.0, MAX_SAMPLE / n)
    lot = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    sample = cut_lineage(rows.where(lot < share * 1_000_000) if share < 1 else rows, "vector-sample")
    wanted = min(MAX_LISTS, max(1, round(n**0.5)))
    begin = sample.orderBy(F.xxhash64("id", F.lit("centre")), "id").limit(wanted).select("vector").toArrow()
    begin = np.unique(matrix(begin.column(0).combine_chunks(), dim), axis=0)
    centres = lloyd(sample, begin)
    parts, padded = -(-dim // WIDTH), -(-dim // WIDTH) * WIDTH

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            r = np.zeros((len(x), padded), np.float32)
            r[:, :dim] = x - centres[nearest(x, centres)]
            for j in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j), pa.int32()), pa.array(r[:, j * WIDTH : (j + 1) * WIDTH].tolist(), pa.list_(pa.float32()))], ["part", "r"])

    def books(group: pa.Table) -> pa.Table:
        j = group.column("part")[0].as_py()
        r = group.column("r").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
        r = r[np.lexsort(r.T)]  # the same whatever order rows came in
        return pa.table({"part": pa.array([j], pa.int32()), "entries": pa.array([code_books(r, np.random.default_rng(j)).tobytes()], pa.binary())})

    found = sample.select("vector").mapInArrow(cut, "part int, r array<float>").groupBy("part").applyInArrow(books, "part int, entries binary").collect()
    return centres, np.stack([np.frombuffer(r["entries"], np.float32).reshape(ENTRIES, WIDTH) for r in sorted(found, key=lambda r: r["part"])])


def write_index(rows: DataFrame, path: str, id_column: str, vector: str) -> DataFrame:
    """Every usable row with its list, code and vector, in a folder for each list; a list with very many rows is spread over files by id."""
    good, dim = usable(rows, id_column, vector)
    centres, books = learn(good, dim)
    kind = good.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            at = nearest(x, centres)
            r = np.zeros((len(x), books.shape[0] * WIDTH), np.float32)
            r[:, :dim] = x - centres[at]
            code = np.stack([nearest(r[:, j * WIDTH : (j + 1) * WIDTH], b) for j, b in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(x.tolist(), pa.list_(pa.float32())), pa.array(at, pa.int32())], ["id", "code", "vector", "list"])

    spark = rows.sparkSession
    parts = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    out = good.mapInArrow(encode, f"id {kind}, code binary, vector array<float>, list int")
    out.repartition(parts, "list", F.pmod(F.xxhash64("id"), F.lit(max(1, parts // 8)))).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(path)
    model = [(centres.tobytes(), centres.shape[1], books.tobytes())]
    spark.createDataFrame(model, "centres binary, dim int, books binary").write.parquet(f"{path}-model")
    return out


def vector_index(rows: DataFrame, id_column: str, vector: str = "embedding") -> VectorIndex:
    """The index of rows read from files, written on a session's first call and kept."""
    table = lasting("vectors", rows, lambda source, path: write_index(source, path, id_column, vector), id_column, vector)
    path = lasting_path("vectors", rows, id_column, vector)
    model = rows.sparkSession.read.schema("centres binary, dim int, books binary").parquet(f"{path}-model").first()
    return VectorIndex(table, np.frombuffer(model["centres"], np.float32).reshape(-1, model["dim"]), np.frombuffer(model["books"], np.float32).reshape(-1, ENTRIES, WIDTH))


def best_of(ids: pa.Array, scores: np.ndarray, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query (row of scores) its best k columns, equal scores by id, its own row left out."""
    order = pc.sort_indices(ids).to_numpy()
    scores = scores[:, order]
    if own is not None:
        named = np.array(ids.to_pylist(), object)[order]
        scores = np.where(named[None, :] == own[:, None], -np.inf, scores)
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if k < scores.shape[1] else np.full((len(scores), 1), -np.inf)
    above, ties = scores > least, scores == least
    kept = (above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))) & (scores > -np.inf)
    q, c = np.nonzero(kept)
    return q, order[c], scores[q, c]


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def blocks_of(queries: DataFrame, dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and vectors, BLOCK of them at a time."""
    good = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where(F.size("vector") == dim)
    n = -(-good.count() // BLOCK)
    for b in range(n):
        held = good.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow() if n > 1 else good.toArrow()
        if held.num_rows:
            yield held.column(0).to_pylist(), matrix(held.column(1).combine_chunks(), dim)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, exclude_own: bool = False, refine: int = REFINE) -> DataFrame:
    """query_id, rank, id, score (cosine) of about the k nearest rows to each query (query_id, vector): those in the lists of
    its `probes` nearest centres, the vectors of the best refine * k codes scored exactly. Queries of another length than the
    index's find nothing. Equal scores go by id."""
    out, kind = None, dict(index.rows.dtypes)["id"]
    qkind = dict(queries.dtypes)["query_id"]
    centres, books, dim = index.centres, index.books, index.centres.shape[1]
    for ids, x in blocks_of(queries, dim):
        near = x @ centres.T
        lists = np.argsort(-(near - 0.5 * (centres * centres).sum(axis=1)), axis=1, kind="stable")[:, :probes]
        asked: dict[int, np.ndarray] = {}
        for q, own in enumerate(lists):
            for one in own:
                asked.setdefault(int(one), []).append(q)
        asked = {one: np.array(qs) for one, qs in asked.items()}
        padded = np.zeros((len(x), books.shape[0] * WIDTH), np.float32)
        padded[:, :dim] = x
        own_ids = np.array(ids, object) if exclude_own else None

        def scan(batches: Iterator[pa.RecordBatch], asked=asked, near=near, padded=padded, own_ids=own_ids, ids=ids) -> Iterator[pa.RecordBatch]:
            tables = np.stack([padded[:, j * WIDTH : (j + 1) * WIDTH] @ b.T for j, b in enumerate(books)], axis=1)
            for batch in batches:
                at = batch.column("list").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, books.shape[0])
                for one in np.unique(at):
                    rows, qs = np.flatnonzero(at == one), asked[int(one)]
                    scores = near[qs, one][:, None] + sum(tables[qs, j][:, code[rows, j]] for j in range(books.shape[0]))
                    q, c, s = best_of(batch.column("id").take(pa.array(rows)), scores, refine * k, own_ids[qs] if own_ids is not None else None)
                    yield pa.RecordBatch.from_arrays([pa.array(qs[q], pa.int32()), batch.column("id").take(pa.array(rows[c])), pa.array(np.full(len(q), one), pa.int32()), pa.array(s.astype(np.float64))], ["q", "id", "list", "score"])

        codes = index.rows.where(F.col("list").isin(sorted(asked))).select("list", "id", "code")
        close = codes.mapInArrow(scan, f"q int, id {kind}, list int, score double")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        close = close.withColumn("r", place).where(F.col("r") <= refine * k).select("q", "id", "list")
        held = index.rows.where(F.col("list").isin(sorted(asked))).select("list", "id", "vector").join(close, ["list", "id"])

        def exact(batches: Iterator[pa.RecordBatch], x=x, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
                q = batch.column("q").to_numpy()
                score = np.round(np.einsum("ij,ij->i", x[q].astype(np.float64), v.astype(np.float64)), 12)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), batch.column("id"), pa.array(score)], ["query_id", "id", "score"])

        found = ranked(held.select("q", "id", "vector").mapInArrow(exact, f"query_id {qkind}, id {kind}, score double"), k)
        found = cut_lineage(found, "neighbours")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else index.rows.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, score double, rank long")


def exact_neighbours(index: VectorIndex, queries: DataFrame, k: int, exclude_own: bool = False) -> DataFrame:
    """query_id, rank, id, list, score of the k nearest rows to each query, by all rows: what an index is measured by."""
    out, kind, qkind = None, dict(index.rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    dim = index.centres.shape[1]
    for ids, x in blocks_of(queries, dim):
        own_ids = np.array(ids, object) if exclude_own else None

        def scan(batches: Iterator[pa.RecordBatch], x=x, own_ids=own_ids, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
                q, c, s = best_of(batch.column("id"), np.round(x.astype(np.float64) @ v.T.astype(np.float64), 12), k, own_ids)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), batch.column("id").take(pa.array(c)), batch.column("list").take(pa.array(c)), pa.array(s)], ["query_id", "id", "list", "score"])

        found = ranked(index.rows.select("id", "list", "vector").mapInArrow(scan, f"query_id {qkind}, id {kind}, list int, score double"), k)
        out = found if out is None else out.unionByName(cut_lineage(found))
    return out if out is not None else index.rows.sparkSession.createDataFrame([], f"query_id {qkind}, id {kind}, list int, score double, rank long")


def some_queries(queries: DataFrame, sample: int) -> DataFrame:
    """So many queries, picked by hash."""
    return cut_lineage(queries.orderBy(F.xxhash64("query_id", F.lit("probe")), "query_id").limit(sample), "probe-queries")


def lists_needed(index: VectorIndex, queries: DataFrame, true: DataFrame, target: float) -> int:
    """The fewest lists that hold so large a share of the true neighbours (query_id, list) of queries."""
    place = {}
    for ids, x in blocks_of(queries, index.centres.shape[1]):
        order = np.argsort(-(x @ index.centres.T - 0.5 * (index.centres**2).sum(axis=1)), axis=1, kind="stable")
        place.update(zip(ids, np.argsort(order, axis=1), strict=True))
    needed = sorted(int(place[r["query_id"]][r["list"]]) + 1 for r in true.select("query_id", "list").collect())
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample: int = 64) -> int:
    """The fewest lists that hold so large a share of the true k neighbours of `sample` queries, picked by hash."""
    some = some_queries(queries, sample)
    return lists_needed(index, some, exact_neighbours(index, some, k, exclude_own=True), target)


def effort_for(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, sample: int = 64) -> tuple[int, int]:
    """Lists to open and candidates for each result with which a search finds so large a share of the true k neighbours of
    `sample` queries, picked by hash.

    The lists may lose half of what may be lost; candidates are doubled until the search as a whole reaches the share, or
    scores all rows that it opens.
    """
    some = some_queries(queries, sample)
    true = cut_lineage(exact_neighbours(index, some, k, exclude_own=True), "true-neighbours")
    probes, refine, n = lists_needed(index, some, true, (1 + target) / 2), REFINE, index.rows.count()
    while refine * k < n and recall(search(index, some, k, probes, exclude_own=True, refine=refine), true) < target:
        refine *= 2
    return probes, refine


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true neighbours (query_id, id) that were found."""
    total = true.count()
    return true.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / total if total else 1.0

