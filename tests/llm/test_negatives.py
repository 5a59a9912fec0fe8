"""Hard negatives: against a plain Python version, trees against plain sorting, odd rows."""

import math

import numpy as np
import pytest

from fleetlens.llm import negatives as m

SCHEMA = "vec_id long, embedding array<double>, label int, v int, tree int, score string"


def plain(rows, every=m.ANCHOR_EVERY):
    used = {}
    for vec_id, e, label in rows:
        if vec_id is None or e is None or label is None or any(x is None or not math.isfinite(256 * x) for x in e):
            continue
        used[vec_id] = min(used.get(vec_id, (label, e)), (label, e))
    whole = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]) for i, (label, e) in used.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p][:5]
            out += [(a, positive, r, i, -p, -s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, m.op11_query(frame).collect()))
    assert got == plain(rows)
    return got


def vectors(seed, n, dim, labels=4, spread=1.0):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(8, dim)) * spread
    return [(i, (middles[i % 8] + draw.normal(size=dim) / 3).tolist(), int(draw.integers(labels))) for i in range(n)]


def test_equals_plain_version(spark):
    assert len(check(spark, vectors(1, 900, 6))) > 50


def test_many_trees_blocks_and_labels(spark, monkeypatch):
    for name, value in {"LEAST_ROWS": 90, "ANCHOR_BLOCK": 3}.items():
        monkeypatch.setattr(m, name, value)
    check(spark, vectors(2, 1200, 5, labels=300))


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5, float(i % 3)], i % 2) for i in range(400)]
    assert check(spark, rows)


def test_odd_rows_take_no_part(spark):
    rows = vectors(3, 300, 4)
    rows += [(None, [1.0] * 4, 1), (900, None, 1), (1000, [1.0, None, 2.0, 3.0], 1), (1100, [1.0, math.nan, 0.0, 0.0], 1)]
    rows += [(1200, [math.inf, 0.0, 0.0, 0.0], 2), (1300, [1.0] * 4, None), (1400, [], 1), (1401, [], 2), (1402, [], 1), (1500, [2.0] * 3, 1), (1501, [2.0] * 3, 2)]
    rows += [(100, [9.0] * 4, 0), (100, [-9.0] * 4, 0), (100, [9.0] * 4, 3), (1600, [0.0] * 4, -3)]
    check(spark, rows)


def test_large_components_are_exact(spark):
    draw = np.random.default_rng(5)
    rows = [(i * 10, [float(x) * 1e3 for x in draw.integers(900, 1000, 8)], i % 2) for i in range(60)]
    rows += [(7 + i * 10, [float(x) for x in draw.integers(10_000_000, 10_000_100, 8)], i % 2) for i in range(60)]
    assert check(spark, rows)


def test_few_rows_and_empty_table(spark):
    assert check(spark, [(0, [1.0], 1)]) == []
    assert check(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    assert m.op11_query(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_boxes_hold_their_rows(n):
    draw = np.random.default_rng(n)
    tree = m.pack(np.arange(n), draw.integers(0, 5, n) * (draw.random(n) < 0.9) + draw.integers(0, 3, n), draw.integers(-50, 50, (n, 7)).astype(float))
    assert sorted(tree.ids.tolist()) == list(range(n))
    reached = np.zeros(n, int)

    def rows(box):
        a, b = tree.first[box], tree.last[box]
        return list(range(a, b)) if box < tree.leaves else [r for child in range(a, b) for r in rows(child)]

    for box in range(len(tree.first)):
        own = rows(box)
        assert (tree.vectors[own] >= tree.low[box]).all() and (tree.vectors[own] <= tree.high[box]).all()
        assert (tree.labels[own] >= tree.label_low[box]).all() and (tree.labels[own] <= tree.label_high[box]).all()
        if box < tree.leaves:
            reached[own] += 1
            assert len(own) <= m.LEAF
    assert (reached == 1).all()
    if n:
        assert sorted(rows(len(tree.first) - 1)) == list(range(n))


def test_queue_leaves_far_boxes_closed(monkeypatch):
    """On clustered vectors most leaves are never scored."""
    draw = np.random.default_rng(9)
    middles = draw.normal(size=(64, 16)) * 400
    v = np.floor(middles.repeat(128, axis=0) + draw.normal(size=(64 * 128, 16)) * 10)
    tree = m.pack(np.arange(len(v)), np.zeros(len(v), np.int64), v)
    scored, products = [], m._products
    monkeypatch.setattr(m, "_products", lambda a, b: (scored.append(a.shape[0] * b.shape[0]), products(a, b))[1])
    anchors = v[::500]
    ids, none = np.arange(len(v))[::500], np.zeros(len(anchors), np.int64)
    found = m.search(tree, anchors, ids, none, np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), np.inf), True, 5)
    want = [sorted((-s, i) for i, s in enumerate(v @ a) if i != own)[:5] for a, own in zip(anchors, ids, strict=True)]
    got = [[(-s, tree.ids[r]) for a, _, r, s in zip(*found, strict=True) if a == n] for n in range(len(ids))]
    assert got == want
    assert sum(scored[4:]) < 0.2 * len(ids) * len(v)
