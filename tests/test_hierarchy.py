import random

import pytest

from lexiweave.operators.hierarchy import hierarchy


def brute(ids, parent):
    out = {}
    for n in ids:
        path, x = [n], n
        while parent.get(x) is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if parent.get(x) is None:
            out[n] = (x, len(path) - 1)
        else:
            cycle = path[path.index(parent[x]) :]
            out[n] = (min(cycle), -1 if n in cycle else -2)
    return out


def frames(spark, ids, edges):
    return spark.createDataFrame([(i, "x") for i in ids], "id bigint, child string"), spark.createDataFrame(edges, "child bigint, parent bigint")


@pytest.mark.parametrize("local_rows", [0, 5, 1000])
def test_random_forests(spark, local_rows):
    rng = random.Random(5)
    ids = list(range(1, 60))
    edges = {n: rng.choice(ids) for n in ids if rng.random() < 0.93}
    edges |= {n: n - 1 for n in range(40, 50)}
    e = [*edges.items(), (1, 999), (998, 1), (None, 3), (4, None), *list(edges.items())[:5]]
    n, e = frames(spark, [*ids, 7, None], e)
    h = hierarchy(n, e, with_descendants=True, local_rows=local_rows)
    assert bool(h.steps) == (local_rows < 60)
    got = {r.id: (r.root, r.depth) for r in h.nodes.collect()}
    want = brute(ids, edges)
    assert got == want and h.nodes.count() == len(ids)
    cyclic = {i for i in ids if want[i][1] == -1}
    pairs = set()
    for i in ids:
        x, k = i, 0
        while x not in cyclic and x in edges:
            x, k = edges[x], k + 1
            pairs.add((x, i, k))
    assert {tuple(r) for r in h.descendants.collect()} == pairs and h.descendants.count() == len(pairs)
    for r in h.nodes.collect():
        below = [p for p in pairs if p[0] == r.id]
        assert r.subtree_size == 1 + len(below) and r.height == max([p[2] for p in below], default=0)
        assert (r.path is None) == (r.depth < 0) and (r.depth < 0 or len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == r.id)


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_two_parents_self_loop_and_long_cycle(spark, local_rows):
    n, e = frames(spark, range(1, 12), [(2, 1), (2, 3), (4, 4), *[(i, i + 1) for i in range(6, 11)], (11, 6), (5, 6)])
    got = {r.id: (r.parent, r.root, r.depth) for r in hierarchy(n, e, local_rows=local_rows).nodes.collect()}
    assert got[2] == (1, 1, 1) and got[3] == (None, 3, 0) and got[4] == (4, 4, -1) and got[5] == (6, 6, -2)
    assert all(got[i][1:] == (6, -1) for i in range(6, 12))


def test_chain_takes_few_steps(spark):
    """A chain of 2,000 nodes with a leaf on every tenth, and a cycle of 300 with a chain below it."""
    chain = [(i + 1, i) for i in range(1, 2000)] + [(10_000 + i, i) for i in range(10, 2000, 10)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 300) for i in range(300)] + [(30_000, 20_007)] + [(30_001 + i, 30_000 + i) for i in range(50)]
    edges = chain + ring
    n, e = frames(spark, sorted({x for p in edges for x in p}), edges)
    h = hierarchy(n, e, with_path=False, local_rows=50)
    got = {r.id: r for r in h.nodes.collect()}
    assert len(h.steps) < 30
    for i in range(1, 2001):
        assert (got[i].root, got[i].depth, got[i].height, got[i].parent) == (1, i - 1, 2000 - i, i - 1 or None)
        assert got[i].subtree_size == 2001 - i + sum(1 for j in range(10, 2000, 10) if j >= i)
    assert all(got[20_000 + i].depth == -1 and got[20_000 + i].root == 20_000 for i in range(300))
    assert [got[30_000 + i].depth for i in range(51)] == [-2] * 51 and got[20_007].subtree_size == 52 and got[20_008].subtree_size == 1
    assert got[20_007].height == 51 and got[30_000].height == 50 and got[30_050].root == 20_000


def test_empty(spark):
    n, e = frames(spark, [], [])
    h = hierarchy(n, e, with_descendants=True)
    assert h.nodes.count() == 0 and h.descendants.count() == 0
