import numpy as np
import pytest

from lexiweave.llm.neighbours import Index, _turn, _turner, exact_neighbours, fit_index, nearest_vectors, recall_of, unit_vectors

SCHEMA = "w_id bigint, vec array<float>, id string"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None, "x") for i, v in rows], SCHEMA)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 25), 64))
    return centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, 64))


def brute(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("how", [{}, {"max_cell": 40}])
def test_recall(spark, how):
    x = clustered(1500)
    got = nearest_vectors(unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64), **how).toPandas()
    s, want = brute(x)
    found = got.groupby("id").neighbour.apply(set)
    recall = np.mean([len(found.get(i, set()) & set(w)) / 5 for i, w in enumerate(want)])
    assert recall >= 0.95
    assert np.allclose(got.cosine, s[got.id, got.neighbour], atol=1e-6) and not (got.id == got.neighbour).any()
    assert got.groupby("id").size().max() == 5 and not got.duplicated(["id", "neighbour"]).any()


def test_cells_that_cannot_be_divided_are_exact(spark):
    """Vectors so close that every hash agrees: blocks of the cell are compared, all of them."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=64) + 1e-3 * rng.normal(size=(90, 64))
    got = nearest_vectors(unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64), max_cell=20).toPandas()
    s, want = brute(x.astype(np.float32).astype(float))
    found = got.groupby("id").neighbour.apply(set)
    assert np.mean([len(found[i] & set(w)) / 5 for i, w in enumerate(want)]) > 0.9


def recall(spark, x, **how):
    got = nearest_vectors(unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64), **how).toPandas()
    found = got.groupby("id").neighbour.apply(set)
    return [len(found.get(i, set()) & set(w)) / 5 for i, w in enumerate(brute(x.astype(np.float32).astype(float))[1])]


def test_cells_above_the_limit_lose_nothing(spark):
    x = clustered(1500)
    assert np.mean(recall(spark, x, max_cell=40)) >= np.mean(recall(spark, x)) - 1e-9 >= 0.95


def test_dense_group(spark):
    """A third of the vectors lie close together, all of them distinct."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=64) + 0.2 * rng.normal(size=(500, 64)), clustered(1000)])
    r = recall(spark, x, max_cell=40)
    assert np.mean(r[:500]) >= 0.9 and np.mean(r) >= 0.9


def test_unusable_vectors_and_repeats(spark):
    v = [1.0] + [0.0] * 63
    w = [1.0, 0.1] + [0.0] * 62
    rows = [(1, v), (1, v), (2, w), (3, [0.0] * 64), (4, [float("nan")] + [0.0] * 63), (5, [float("inf")] + [1.0] * 63), (6, [1.0] * 32), (7, []), (8, None), (9, [1e30] + [0.0] * 63)]
    got = {(r.id, r.neighbour) for r in nearest_vectors(unit_vectors(frame(spark, rows), "w_id", "vec", 64)).collect()}
    assert got == {(a, b) for a in (1, 2, 9) for b in (1, 2, 9) if a != b}


def test_equal_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64), rng.normal(size=64)
    rows = [*((i, a) for i in range(10)), *((i, 2 * a) for i in range(10, 12)), (20, b), (21, b), (22, b + 0.01)]
    got = nearest_vectors(unit_vectors(frame(spark, rows), "w_id", "vec", 64)).toPandas().groupby("id").neighbour.apply(lambda s: sorted(s))
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[11] == [0, 1, 2, 3, 4]
    assert {20, 22} <= set(got[21]) and {20, 21} <= set(got[22])


def test_few_and_none(spark):
    assert nearest_vectors(unit_vectors(frame(spark, [(1, clustered(1)[0])]), "w_id", "vec", 64)).count() == 0
    assert nearest_vectors(unit_vectors(frame(spark, []), "w_id", "vec", 64)).count() == 0


def test_recall_of_loose_clusters(spark):
    """21,000 vectors in clusters of 20 with sigma 0.5, against brute force for ids divisible by 50, whole and with cells divided."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(1050, 64))
    x = centres[rng.integers(0, 1050, 21_000)] + 0.5 * rng.normal(size=(21_000, 64))
    d = frame(spark, enumerate(x)).repartition(4)
    units = unit_vectors(d, "w_id", "vec", 64).persist()
    exact = exact_neighbours(units, units.filter("id % 50 = 0")).persist()
    for how in ({}, {"max_cell": 150}):
        r = recall_of(nearest_vectors(units, **how), exact).first()
        assert r.queries == 420 and r.neighbours == 2100 and r.recall >= 0.95, how
    assert fit_index(units).recall >= 0.98


def test_exact_neighbours(spark):
    x = clustered(400)
    units = unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64)
    got = exact_neighbours(units, units.filter("id % 50 = 0"), block_rows=3).toPandas().groupby("id").neighbour.apply(list)
    want = brute(x.astype(np.float32).astype(float))[1]
    assert {i: list(want[i]) for i in range(0, 400, 50)} == got.to_dict()
    assert exact_neighbours(units, units.limit(0)).count() == 0


def test_those_that_meet_nobody_are_compared_with_all(spark):
    """One table of many cells: most vectors are alone in their cell."""
    x = np.random.default_rng(3).normal(size=(300, 64))
    got = recall(spark, x, index=Index(64, 1, 1, 14, 0.0))
    assert np.mean(got) > 0.95
    found = nearest_vectors(unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64), index=Index(64, 1, 1, 14, 0.0)).groupBy("id").count().collect()
    assert len(found) == 300 and all(r["count"] == 5 for r in found)


def test_hot_class_of_equal_vectors(spark):
    """A third of the rows have one vector."""
    x = clustered(600)
    x[::3] = x[0]
    got = nearest_vectors(unit_vectors(frame(spark, enumerate(x)), "w_id", "vec", 64)).toPandas().groupby("id").neighbour.apply(sorted)
    assert len(got) == 600 and all(len(v) == 5 for v in got) and got[0] == [3, 6, 9, 12, 15] and got[300] == [0, 3, 6, 9, 12]


def test_steps_and_matrix_agree():
    rng = np.random.default_rng(0)
    signs = rng.choice(np.array([-1, 1], np.float32), (3, 64))
    x = rng.normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(_turner(signs)(x, 64), _turn(x, signs), atol=1e-4)
    wide = rng.choice(np.array([-1, 1], np.float32), (3, 1024))
    y = rng.normal(size=(2, 1024)).astype(np.float32)
    assert _turner(wide)(y, 10).shape == (2, 10) and np.allclose(np.linalg.norm(_turn(y, wide), axis=1), np.linalg.norm(y, axis=1), rtol=1e-4)
