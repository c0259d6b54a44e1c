import numpy as np
import pytest

from gristmill.llm import vectors
from gristmill.llm.vectors import Codes, SimilarVectors, rotation, unit, usable

SCHEMA = "batch_id long, model string, dim int, vec_ids array<long>, vectors array<array<float>>, vec_id string, key int"


def make(seed=0, n=400, dim=16, groups=25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    rows = centres[rng.integers(groups, size=n)] + 0.35 * rng.standard_normal((n, dim))
    rows *= rng.uniform(0.2, 5, (n, 1))
    return rows.astype(np.float32)


def table(spark, rows, model="m", first=0):
    parts, step = [], 40
    for i in range(0, len(rows), step):
        block = [[float(x) for x in r] for r in rows[i : i + step]]
        parts.append((i, model, len(rows[0]), list(range(first + i, first + i + len(block))), block, "x", 1))
    return spark.createDataFrame(parts, SCHEMA)


def brute(ids, rows, k=5, least=-1.0):
    u = unit(rows.astype(np.float64))
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def top_of(frame):
    got = {}
    for r in frame.orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["other"])
    return got


def test_all_neighbours_and_pairs(spark):
    rows = make()
    index = SimilarVectors(table(spark, rows))
    expected = brute(list(range(len(rows))), rows)
    got = top_of(index.top())
    agree = sum(len(set(got[i]) & set(expected[i])) for i in expected) / (5 * len(rows))
    assert agree > 0.99
    close = brute(list(range(len(rows))), rows, least=0.8)
    pairs = {tuple(r) for r in index.close_pairs(0.8).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, bs in close.items() for b in bs}
    some = top_of(index.top(queries=vectors.F.col("vec_id") % 50 == 0))
    assert some == {i: got[i] for i in got if i % 50 == 0}


def test_recall_with_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    monkeypatch.setattr(vectors, "AREA", 100)
    monkeypatch.setattr(vectors, "BLOCK", 60)
    rows = make(1, n=1500, groups=60)
    close = brute(list(range(len(rows))), rows, least=0.8)
    index = SimilarVectors(table(spark, rows))
    assert len(index.index["m"][0]) == 15 and index.index["m"][1].max() > 1
    got = {tuple(r) for r in index.close_pairs(0.8).collect()}
    true = {(min(a, b), max(a, b)) for a, bs in close.items() for b in bs}
    assert len(got & true) / len(true) > 0.97


def test_unusable_vectors_resent_and_two_models(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", 2, [1, 2, 3, 4, 5, 6, None], [[1.0, 0.0], None, [1.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, 0.0]], "x", 1),
        (2, "a", 2, [1, 7], [[1.0, 0.0], [2.0, 0.1]], "x", 1), (3, "b", 2, [8, 9], [[1.0, 0.0], [1.0, 0.2]], "x", 1), (4, None, 2, [10], [[1.0, 0.0]], "x", 1), (5, "a", 2, None, None, "x", 1), (6, "a", 2, [], [], "x", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["vec_id"] for r in usable(frame).collect()) == [1, 7, 8, 9]
    assert {tuple(r) for r in SimilarVectors(frame).close_pairs(0.8).collect()} == {(1, 7), (8, 9)}
    assert SimilarVectors(frame.limit(0)).close_pairs().count() == 0


def test_copies_and_ties_go_to_the_smaller_id(spark):
    rows = np.concatenate([np.tile(np.array([[1.0, 2.0, 3.0, 4.0]], dtype=np.float32), (9, 1)), make(2, 20, 4, 20)])
    expected = brute(list(range(len(rows))), rows)
    got = top_of(SimilarVectors(table(spark, rows)).top())
    for i in range(9):
        assert got[i] == expected[i] == [j for j in range(9) if j != i][:5]
    assert got == expected


@pytest.mark.parametrize("dim,bits", [(64, 64), (96, 128), (10, 64)])
def test_estimates_are_unbiased_and_bounded(dim, bits):
    rng = np.random.default_rng(3)
    rows = unit(rng.standard_normal((900, dim)) + rng.standard_normal((1, dim)))
    codes = Codes(rows[:600], rows[:50].mean(axis=0), rotation(dim, bits))
    query = rows[600:]
    exact = query @ rows[:600].T
    value = codes.bounds(query, 0)
    assert abs((value - exact).mean()) < 0.005
    assert (exact > codes.bounds(query, 1)).mean() < 0.01 and (exact < codes.bounds(query, -1)).mean() < 0.01
