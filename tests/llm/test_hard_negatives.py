import math
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm.hard_negatives import Best, Tree, find_positives, hard_negatives, whole_numbers


def expected(rows):
    good = []
    for vec_id, label, e in rows:
        if None in (vec_id, label, e) or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = Counter()
    for a, label, e in good:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(e, f, strict=False)), i, other) for i, other, f in good if i != a), key=lambda x: x[:2])
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            ps = -ps
            fit = [(-s, i) for s, i, other in scored if other != label and 80 * ps <= -100 * s <= 100 * ps][:5]
            for rank, (ns, i) in enumerate(fit, 1):
                out[a, p, rank, i, ps, ns] += 1
    return out


def rows_of(n, dims, seed, step=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        m = rng.choice(middles)
        out.append((i * step, rng.randrange(4), [float(np.float32(x + rng.gauss(0, 0.3))) for x in m]))
    return out


def result(spark, rows, **more):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return Counter(map(tuple, hard_negatives(d, **more).collect()))


def test_against_brute_force_in_small_trees(spark):
    rows = rows_of(900, 5, 1, 10)
    assert len(expected(rows)) > 500
    assert result(spark, rows, tree_rows=70, anchor_rows=20, leaf=8) == expected(rows)


def test_a_common_vector_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [1.0, 0.5, 0.0] if i % 3 else [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(600)]
    assert result(spark, rows, tree_rows=100, leaf=8) == expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, []), (8, 1, [0.5]), (9, 2, [0.9, 1.9, 7.0]),
        (10, 2, [1.0, 2.0]), (10, 2, [1.0, 2.0]), (11, 1, [0.99, 2.0]), (11, 1, [0.99, 2.0]), (100, 2, [-1.0, -1.0]), (200, 3, [0.0, 0.0]), (300, 9, [1.0, 1.0]), (400, 1, [1.0]), (700, 9, [1.0, 2.0]), (-100, 1, [2.0, -1.0]),
    ]
    assert result(spark, rows) == expected(rows)


def test_empty_and_without_anchors(spark):
    assert not result(spark, []) and not result(spark, [(1, 1, None)]) and not result(spark, [(1, 1, [1.0]), (2, 1, [1.0])])


def test_clashing_columns(spark):
    rows = rows_of(120, 3, 4)
    d = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "vec_id long, label int, embedding array<float>, v int, cell int, tree string, rank int")
    assert Counter(map(tuple, hard_negatives(d).collect())) == expected(rows)


def test_large_components_are_exact_or_an_error(spark):
    rows = [(i, i % 2, [float(2**18 + i), float(i)]) for i in range(0, 300, 20)]
    assert result(spark, rows) == expected(rows)
    with pytest.raises(Exception, match="too large"):
        result(spark, [(0, 1, [1e9]), (1, 1, [1.0])])


def test_whole_groups_of_anchors_are_pruned():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 300, (20, 8))
    v = np.rint(np.repeat(middles, 200, 0) + rng.normal(0, 5, (4000, 8))).astype(np.int32)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    tree, own = Tree.build(ids, labels, v, 64), Tree.build(ids[::10], labels[::10], v[::10], 16)
    best, scored = Best(400, 5), 0
    import quillon.llm.hard_negatives as H

    plain = H.products
    try:
        def counted(a, b, exact):
            nonlocal scored
            scored += len(a) * len(b)
            return plain(a, b, exact)

        H.products = counted
        find_positives(own, tree, best)
    finally:
        H.products = plain
    assert scored < 0.4 * 400 * 4000
    scores = own.v.astype(np.int64) @ v.T.astype(np.int64)
    scores[np.arange(400), own.ids] = -(1 << 60)
    assert (np.sort(scores, 1)[:, ::-1][:, :5] == best.scores).all()


def test_nodes_are_ranges_and_balls():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (500, 4)).astype(np.int32)
    t = Tree.build(np.arange(500), rng.integers(0, 3, 500), v, 10)
    t = Tree.unpacked(4, t.packed())
    for k in range(len(t.start)):
        rows = t.values[t.start[k] : t.end[k]]
        assert np.sqrt(((rows - t.center[k]) ** 2).sum(1)).max() <= t.radius[k] + 1e-6 and t.ids[t.start[k] : t.end[k]].min() == t.least[k]
        assert len(set(t.labels[t.start[k] : t.end[k]].tolist())) == 1 and (t.left[k] >= 0 or t.end[k] - t.start[k] <= 10)
    assert sorted(t.ids.tolist()) == list(range(500))


def test_rows_of_numbers():
    import pyarrow as pa

    x = pa.array([[1.0], [0.1, -0.1, 0.5], [], [2.0, 3.0]], pa.list_(pa.float64()))
    assert whole_numbers(x.slice(1), 3).tolist() == [[25, -26, 128], [0, 0, 0], [512, 768, 0]]
