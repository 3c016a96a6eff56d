import random

import numpy as np
import pytest

from hostledger.llm.covertree import near_duplicates


def by_hand(rows, least):
    def vector(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array([np.float32(x) for x in v], dtype=np.float64)

    vs = [vector(v) for _, v, _ in rows]
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = vs[i], vs[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), first, rows[i][0] == first))
    return sorted(out, key=str)


def clouds(rng, n, dim, centres, spread):
    c = rng.normal(size=(centres, dim))
    return [(c[rng.integers(centres)] + spread * rng.normal(size=dim)).tolist() for _ in range(n)]


@pytest.mark.parametrize(("dim", "spread", "block"), [(3, 0.3, 2048), (8, 0.2, 40), (16, 0.05, 25), (5, 0.001, 30)])
def test_against_all_pairs(frame, dim, spread, block):
    rng = np.random.default_rng(dim)
    vectors = clouds(rng, 260, dim, 9, spread)
    rows = [(i * 3, v, int(rng.integers(2))) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[i % 5], 0) for i in range(40)] + [(2000 + i, [2 * x for x in vectors[3]], 1) for i in range(5)]
    random.Random(dim).shuffle(rows)
    got = near_duplicates(frame(rows, "vec_id long, embedding array<float>, label int"), 0.93, block).collect()
    assert sorted([tuple(r) for r in got], key=str) == by_hand(rows, 0.93)


def test_odd_rows(frame):
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1),
        (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [None, 1.0], 1), (None, [2.0, 0.0], 1),
        (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (None, [0.0, 7.0], 3), (11, [1e-30, 0.0], 1), (12, [1e30, 0.0], 1),
    ]
    extra = [(*r, "x") for r in rows]
    got = near_duplicates(frame(extra, "vec_id long, embedding array<float>, label int, n string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == [
        tuple(x if i != 3 else r[0] == r[2] for i, x in enumerate(r)) for r in by_hand(rows, 0.93)
    ]
    assert near_duplicates(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("levels", [0, 1])
def test_no_vector_is_lost_at_the_last_level(spark, monkeypatch, levels):
    from hostledger.llm import covertree

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(size=8) * 0.1).tolist(), "x") for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    wanted = sorted(map(tuple, covertree.near_duplicates(vectors).collect()))
    monkeypatch.setattr(covertree, "MOST_LEVELS", levels)
    assert sorted(map(tuple, covertree.near_duplicates(vectors, block=20).collect())) == wanted


@pytest.mark.parametrize("spread", [0.02, 0.06])
def test_blocks_of_distant_vectors_with_planted_links(spread):
    """Random directions cannot be pruned; their leaves are compared whole, each pair of leaves once."""
    from hostledger.llm.covertree import LEAF, CoverTree, DualTraversal, unit

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1800, 64)).astype(np.float32).astype(np.float64)
    x[1500:] = x[rng.integers(0, 1500, 300)] + spread * rng.normal(size=(300, 64)) * np.abs(x).mean()
    y = x[::3] * 2 + 1e-3 * rng.normal(size=(600, 64))
    tree = CoverTree(unit(x))
    assert sorted(tree.members[tree.root].tolist()) == list(range(len(x)))
    leaves = [m for m, c in zip(tree.members, tree.children, strict=True) if not c]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(x))) and len(leaves) <= 2 * len(x) / LEAF + 64
    for node, (centre, radius) in enumerate(zip(tree.centre, tree.radius, strict=True)):
        assert np.linalg.norm(tree.x[tree.members[node]] - tree.x[centre], axis=1).max() <= radius + 1e-9
    for a, b, same in ((x, x, True), (x, y, False)):
        work = DualTraversal((a, b), (np.ones(len(a), np.int64), np.ones(len(b), np.int64)), same, 0.93)
        work.run()
        near = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :] >= 0.93
        if same:
            np.fill_diagonal(near, False)
        assert work.links[0].tolist() == near.sum(axis=1).tolist() and (same or work.links[1].tolist() == near.sum(axis=0).tolist())
        assert near.any() and work.compared <= len(a) * len(b)
