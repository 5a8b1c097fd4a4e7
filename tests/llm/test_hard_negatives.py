"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from odd_rows import SF001

from pdforge.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, v string, block long, walk int"


def _brute(rows):
    seen = set()
    for i, e, y, *_ in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        seen.add((i, math.fmod(y + 1, 10) if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in e)))
    anchors = {}
    for i, y, v in sorted(seen, key=lambda r: (r[0], r[1], r[2])):
        if i % 100 == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = {(z == y, max(-H.LONG, min(H.LONG, sum(s * t for s, t in zip(v, w)))), i) for i, z, w in seen if i != a and len(w) == len(v)}
        scored = sorted(scored, key=lambda r: (-r[1], r[2]))
        for p, pid in [(s, i) for same, s, i in scored if same][:5]:
            hits = [(s, i) for same, s, i in scored if not same and 30 * p <= 100 * s <= 90 * p][:10]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i) in enumerate(hits)]
    return sorted(out)


def _check(spark, rows, parts=5):
    got = H.query(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == _brute(rows)
    return found


def test_clustered_vectors_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 12))
    monkeypatch.setattr(H, "ANCHORS", 4)
    rows = [(int(i), (centre[i % 6] + 0.2 * rng.normal(size=12)).tolist(), int(rng.integers(0, 4)), "x", 1, 1)
            for i in range(0, 1500)]
    rows += [(2000 + i, rows[300][1], i % 3, "tie", 1, 1) for i in range(300)]  # a vector that a sixth of the rows share
    assert len(_check(spark, rows)) > 500


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), i % 2, "", 0, 0) for i in range(0, 220)]
    rows += [(100, [0.5, 0.5, 0.5], 1, "", 0, 0), (100, [0.5, 0.5, 0.5], 1, "", 0, 0), (5, [0.1, 0.2, 0.3], 0, "", 0, 0),
             (None, [1.0, 1.0, 1.0], 0, "", 0, 0), (300, None, 0, "", 0, 0), (400, [1.0, None, 1.0], 0, "", 0, 0),
             (401, [1.0, float("nan"), 1.0], 0, "", 0, 0), (402, [1.0, float("inf"), 1.0], 0, "", 0, 0), (500, [1.0, 1.0, 1.0], None, "", 0, 0),
             (600, [], 0, "", 0, 0), (601, [], 1, "", 0, 0), (602, [], 0, "", 0, 0), (700, [1.0], 0, "", 0, 0), (701, [2.0], 0, "", 0, 0), (702, [1.5], 1, "", 0, 0),
             (800, [9e6, -3e5, 7.0], 0, "", 0, 0), (801, [8e6, 1.0, 2.0], 0, "", 0, 0), (802, [5e6, 1.0, 2.0], 1, "", 0, 0),
             (900, [1e30, 1e30, 0.0], 0, "", 0, 0), (903, [1e30, 0.0, 1e30], 0, "", 0, 0)]
    _check(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert H.query(empty).collect() == []
    assert H.query(spark.createDataFrame(rows[1:50], SCHEMA)).collect() == []  # no anchor


def test_bounds_leave_work_out():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16)).repeat(30, axis=0)
    anchors = np.floor(256 * (base + 0.02 * rng.normal(size=base.shape)))
    x = np.floor(256 * (base + 0.3 * rng.normal(size=base.shape)))
    want = x @ anchors.T
    seen = 0
    for node, rows, s in H.overlapping(H.spanning_tree(anchors), anchors, x, lambda n, lo, hi: (hi >= 1_000_000) & (lo <= 1_200_000)):
        assert (s == want[rows, node]).all()
        inside = np.flatnonzero((want[:, node] >= 1_000_000) & (want[:, node] <= 1_200_000))
        assert np.isin(inside, rows).all()
        seen += len(rows)
    assert seen < 0.35 * want.size


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    walk = H.spanning_tree(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    up, total = list(range(60)), 0.0

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda p: d[p]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            total += d[a, b]
    assert abs(sum(w[2] for w in walk) - total) < 1e-6
    at = {v: k for k, (v, *_) in enumerate(walk)}
    assert len(at) == 60 and all(p < 0 or at[p] < at[v] for v, p, *_ in walk)


def test_first_of_many_repeats():
    s, i = np.full(500, 7, dtype=np.int64), np.repeat(np.arange(5), 100)
    assert H.first(s, i, 10)[1].tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("sf", [SF001])
def test_against_sql(spark, sf):
    from oracle_harness import compare, duck_connection

    from pdforge.llm.queries import QUERIES, SQL
    problems, _, _ = compare(spark, duck_connection(sf), "op11", QUERIES["op11_hard_negatives"], SQL["op11_hard_negatives"], sf)
    assert not problems
