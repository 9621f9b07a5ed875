"""The vector index against all rows: recall, exact scores, odd vectors, fewer rows than centres."""

import numpy as np
import pytest

from remembrane.operators import vector_index as vi


def table(spark, tmp_path, name, rows):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, list string, id string").write.parquet(path)
    return spark.read.parquet(path)


def by_hand(rows, asked, k):
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    return {q: sorted(((round(float(unit(v) @ unit(x)), 5), -i) for i, v in good if i != q), reverse=True)[:k] for q, x in ((q, np.array(x)) for q, x in asked)}


@pytest.mark.parametrize("n", [400, 9])
def test_index(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(vi, "BLOCK", 7)
    r = np.random.default_rng(n)
    centres = r.normal(size=(10, 12))
    rows = [(i, (centres[i % 10] + 0.5 * r.normal(size=12)).round(4).tolist()) for i in range(n)]
    odd = [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [1.0] * 5), (904, []), (905, [0.0] * 12), (906, [float("inf")] * 12)]
    docs = table(spark, tmp_path, "v", [(*x, "l", "i") for x in rows + odd])
    index = vi.vector_index(docs, "vec_id")
    assert index.rows.count() == n + 1 and vi.vector_index(docs, "vec_id").rows is index.rows
    asked = rows[:: max(1, n // 20)]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    true = vi.exact_neighbours(index, queries, 5, exclude_own=True)
    want = by_hand(rows + odd, asked, 5)
    got = {}
    for x in sorted(true.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append(round(x.score, 5))
    assert got.keys() == want.keys() and all(np.allclose(got[q], [s for s, _ in want[q]], atol=2e-5) for q in want)
    probes = vi.probes_for(index, queries, 5, target=0.95)
    found = vi.search(index, queries, 5, probes, exclude_own=True)
    assert vi.recall(found, true) >= 0.9
    assert vi.recall(vi.search(index, queries, 5, 1000, exclude_own=True), true) == pytest.approx(1.0, abs=0.03)
    assert vi.search(index, spark.createDataFrame([(1, [1.0] * 3)], "query_id bigint, vector array<double>"), 5, 3).count() == 0


def test_effort_where_codes_tell_little(spark, tmp_path):
    """Vectors alike in all directions: ten candidates for a result lose too many neighbours, whatever lists are opened."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=64).round(4).tolist(), "l", "i") for i in range(4000)]
    index = vi.vector_index(table(spark, tmp_path, "alike", rows), "vec_id")
    queries = spark.createDataFrame([x[:2] for x in rows[::40]], "query_id bigint, vector array<double>")
    true = vi.exact_neighbours(index, queries, 5, exclude_own=True)
    assert vi.recall(vi.search(index, queries, 5, 10_000, exclude_own=True), true) < 0.9
    probes, refine = vi.effort_for(index, queries, 5)
    assert refine > vi.REFINE and vi.recall(vi.search(index, queries, 5, probes, exclude_own=True, refine=refine), true) >= 0.9


def test_copies_by_id(spark, tmp_path):
    """More copies of a vector than candidates: the same ones are found as by all rows."""
    r = np.random.default_rng(6)
    one, other = (r.normal(size=12).round(4).tolist() for _ in range(2))
    rows = [(i * 37 % 1009, one if i % 3 else other, "l", "i") for i in range(1000)]
    index = vi.vector_index(table(spark, tmp_path, "copies", rows), "vec_id")
    queries = spark.createDataFrame([x[:2] for x in rows[:40]], "query_id bigint, vector array<double>")
    for found in (vi.search(index, queries, 5, 1000, exclude_own=True), vi.exact_neighbours(index, queries, 5, exclude_own=True)):
        got = {}
        for x in found.orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.id)
        for q, v, *_ in rows[:40]:
            assert got[q] == sorted(i for i, w, *_ in rows if w == v and i != q)[:5]


def test_nothing_to_index(spark, tmp_path):
    index = vi.vector_index(table(spark, tmp_path, "none", []), "vec_id")
    assert index.rows.count() == 0
    assert vi.search(index, spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>"), 5, 3).count() == 0
