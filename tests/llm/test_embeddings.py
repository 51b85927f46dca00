from itertools import product

import numpy as np

from wardlens.llm import embeddings


def plain(rows):
    """(id, n_links, component, kept), comparing all pairs."""
    usable = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = np.array(v, np.float64)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(root, 0)
    ids = sorted(usable)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = usable[i], usable[j]
            if len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.9:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, links[i], find(i), find(i) == i) for i in root)


def clustered(n, seed, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.02, 0.25, 0.6], (n, 1))).astype(np.float32)


def test_tree_covers_its_vectors():
    x = clustered(3000, 1).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, root = embeddings.cover_tree(x)
    assert sorted(order.tolist()) == list(range(3000))
    waiting = [root]
    while waiting:
        b = waiting.pop()
        assert np.linalg.norm(x[order[b.start : b.stop]] - b.centre, axis=1).max() <= b.radius + 1e-7
        if b.children:
            assert [c.start for c in b.children][1:] == [c.stop for c in b.children][:-1]
        waiting += b.children


def linked(found):
    pairs = [p for a, b, every in found for p in (product(a.tolist(), b.tolist()) if every else zip(a.tolist(), b.tolist()))]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_balls_within_reach_are_not_compared():
    rng = np.random.default_rng(8)
    x = np.concatenate([[1.0, 0, 0, 0] + rng.normal(size=(900, 4)) * 0.01, [0, 1.0, 0, 0] + rng.normal(size=(900, 4)) * 0.01])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = list(embeddings.dual_links(x, None, 0.9))
    assert any(every for _, _, every in found)
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert {tuple(sorted(p)) for p in linked(found)} == {(p, q) for p, q in zip(i.tolist(), j.tolist()) if p < q}


def test_dual_traversal_equals_all_pairs():
    x, y = (clustered(n, s).astype(np.float64) for n, s in ((1500, 2), (900, 3)))
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    found = linked(embeddings.dual_links(x, y, 0.9))
    assert found == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.9))))
    found = {tuple(sorted(p)) for p in linked(embeddings.dual_links(x, None, 0.9))}
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert found == {(p, q) for p, q in zip(i.tolist(), j.tolist()) if p < q}


def test_rows_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(clustered(400, 4))]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, nan] + [0.0] * 6), (404, [inf] + [1.0] * 7), (405, [1.0, None] + [0.0] * 6),
             (406, rows[0][1]), (407, rows[0][1]), (408, [2 * c for c in rows[0][1]]), (409, [1.0, 0.0]), (410, [3.0, 0.1]), (411, [1e-30] * 8), (412, [1e30] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert sorted(map(tuple, embeddings.digest(frame).collect())) == plain(rows)
    assert embeddings.digest(frame.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(tuple(r)) for r in embeddings.digest(lone).collect())) == ["(1, 0, 1, True)", "(None, 0, None, True)", "(None, 0, None, True)"]


def test_repeated_ids_are_separate_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (7, [0.0, 1.0]), (0, [-1.0, 0.0]), (0, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.digest(frame).collect())) == [
        (0, 1, 0, True), (0, 1, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (7, 1, 1, False)
    ]


def test_query_against_plain_version(spark, sf_dir):
    from wardlens.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op9_cover_tree"](spark, sf_dir).collect())) == plain(rows)
