"""Hard negatives against a search of all rows, with many small blocks, ties, repeated rows and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, h long, anchor string, block int"


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        keys = hn.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    v, a = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (9, 6))
    bottom, top = hn.score_bounds(a, v.min(0)[None], v.max(0)[None])
    scores = a @ v.T
    assert (bottom[:, 0] <= scores.min(1)).all() and (scores.max(1) <= top[:, 0]).all()


def brute(rows, every, positives, negatives, share):
    kept = {}
    for i, e, lab in rows:
        if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e):
            found = (lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e))
            kept[i] = min(kept.get(i, found), found)
    size = len(kept[min(kept)][1])
    kept = {i: r for i, r in kept.items() if len(r[1]) == size}
    out = []
    for a in (i for i in kept if i % every == 0):
        label, v = kept[a]
        scored = sorted((-int(np.dot(v, w)), i, lab) for i, (lab, w) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [r for r in scored if r[2] != label and share[0] * -s <= 100 * -r[0] <= share[1] * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("dims,spread", [(2, 0.3), (16, 0.2)])
def test_same_as_all_rows(spark, monkeypatch, dims, spread):
    for name, value in (("BLOCK", 16), ("GROUP", 4), ("BATCH", 2), ("PAGE", 8), ("STRIPE", 2), ("CURVE", (3, 5))):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(dims)
    centres = rng.normal(0, spread, (6, dims))
    rows = [(i, (centres[i % 6] + rng.normal(0, spread / 3, dims)).tolist(), 0 if i % 3 else int(i % 4)) for i in range(700)]
    rows += [(2000 + i, rows[5][1], i % 2) for i in range(60)]        # many equal vectors: ties by id
    rows += [(10, rows[11][1], 3), (10, rows[10][1], rows[10][2]), (None, rows[1][1], 1), (5000, None, 1), (5001, rows[1][1], None),
             (5002, [float("nan")] * dims, 1), (5003, [None] * dims, 1), (5004, [], 1), (5005, [1.0], 1), (5006, [float("-inf")] * dims, 0)]
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)
    found = hn.mine_hard_negatives(frame, F.col("id") % 20 == 0, positives=3, negatives=4)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, 3, 4, (30, 90))


def test_zones_rule_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 32)
    rng = np.random.default_rng(1)
    ring = rng.uniform(0, 2 * np.pi, 3000)
    rows = [(i, [float(np.cos(t)), float(np.sin(t))], int(i % 2)) for i, t in enumerate(ring)]
    vectors = hn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "label", "embedding")
    blocks = hn._blocks(hn._keyed(vectors, F.col("id") % 100 == 0))
    anchors = hn._anchors(blocks, 5)
    plan = hn._plan(hn._grouped(anchors, anchors.count()), blocks, hn._positive_zones)
    read = sum(bin(int.from_bytes(r["mask"], "big")).count("1") for r in plan.collect())
    assert 0 < read < 0.2 * anchors.count() * blocks.count()


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hn.mine_hard_negatives(none, F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, 1, "", 1, "", 1), (101, [1.0], 2, 1, "", 1, "", 1)], SCHEMA)
    assert hn.mine_hard_negatives(alone, F.col("id") % 100 == 0).count() == 0
    assert hn.mine_hard_negatives(alone, F.col("id") == 7).count() == 0
