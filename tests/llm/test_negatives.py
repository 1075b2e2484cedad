import math

import numpy as np
import pytest

from verascope.llm import negatives
from verascope.llm.vptree import VPTree

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, high long, v string"


def plain(rows, every=10, scale=256, positives=5, k=5):
    """Every anchor against every row."""
    fit = {}
    for i, e, label, *_ in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(scale * float(x)) for x in e]
        if all(abs(scale * float(x)) <= negatives.GREATEST for x in e):
            fit[i] = min(fit.get(i, (label, v)), (label, v))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, v) in fit.items():
        if a % every:
            continue
        ranked = sorted((-dot(v, w), i, lab == label) for i, (lab, w) in fit.items() if i != a)
        for minus, p, _ in [r for r in ranked if r[2]][:positives]:
            inside = [r for r in ranked if not r[2] and 80 * -minus <= 100 * -r[0] <= 100 * -minus]
            out += [(a, p, n, r[1], -minus, -r[0]) for n, r in enumerate(inside[:k], 1)]
    return sorted(out)


def found(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(df, lambda i: i % 10 == 0, **sizes).collect()))


def table_of(n, dims=8, copies=60):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, dims)], int(rng.integers(4)), i, 0, "x") for i in range(n)]
    for i in range(n, n + copies):  # one hot vector under three labels
        rows.append((i, rows[3][1], i % 3, 0, 0, None))
    return rows


@pytest.mark.parametrize("cell_rows, sample_rows", [(16, 64), (50, 10), (8192, 4096)])
def test_equals_brute_force_for_any_cells(spark, cell_rows, sample_rows):
    rows = table_of(300)
    expected = plain(rows)
    assert len(expected) > 300
    assert found(spark, rows, cell_rows=cell_rows, sample_rows=sample_rows) == expected


def test_awkward_rows(spark):
    rows = table_of(60, copies=20)
    e = rows[0][1]
    rows += [(None, e, 1, 0, 0, ""), (1000, None, 1, 0, 0, ""), (1010, e, None, 0, 0, ""), (1020, [None, *e[1:]], 1, 0, 0, ""), (1030, [math.nan, *e[1:]], 1, 0, 0, "")]
    rows += [(1040, [math.inf, *e[1:]], 1, 0, 0, ""), (1050, [-math.inf, *e[1:]], 1, 0, 0, ""), (1060, [-1e30, *e[1:]], 1, 0, 0, ""), (1070, [], 2, 0, 0, ""), (1080, e[:3], 2, 0, 0, "")]
    rows += [rows[10], rows[10], (20, e, 0, 0, 0, ""), (-30, e, 3, 0, 0, ""), (1100, [90000.0] * 8, 1, 0, 0, ""), (1101, [80000.0] * 8, 2, 0, 0, "")]
    assert found(spark, rows, cell_rows=20, sample_rows=30) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(10, e, 1, 0, 0, "")]) == []


def test_tree_prunes_and_its_searches_are_exact():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-40, 40, (3000, 3)), np.tile([[7, 8, 9]], (500, 1))])
    norm2 = int((points**2).sum(axis=1).max())
    tree = VPTree(points, norm2, leaf=16)
    ids, wanted = tree.order, tree.order % 3 > 0
    assert sorted(tree.order.tolist()) == list(range(3500))
    visited = []
    for q in points[:40]:
        s = points @ q
        for low, high in ((-(1 << 62), 1 << 62), (900, 1500), (1200, 1200), (5000, 4000)):
            seen = {}
            best = sorted((-int(x), i) for i, x in enumerate(s) if low <= x <= high and i % 3 > 0)[:5]
            assert [(-a, b) for a, b in tree.search(q, low, high, 5, wanted, ids, seen)] == best
            visited.append(len(seen))
            reached = set(tree.reached(q, low, high))
            assert {int(r) for r, x in zip(tree.routes(points), s, strict=True) if low <= x <= high} <= reached
    assert np.mean(visited) < 0.5 * tree.leaves()
