"""Vector codes against a plain Lloyd loop that compares everything in every round."""

import numpy as np
import pytest

from depotflow.llm import codes, common

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, code int, n long"


def lloyd_brute(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e], lab) for i, e, lab in rows
            if e and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = np.array([r[1] for r in order if len(r[1]) == size][:entries]).reshape(-1, parts, x.shape[2]).transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        code, error = gaps.argmin(-1), gaps.min(-1).sum(-1)
        if r < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    own = x[code[:, p] == k, p]
                    if len(own):
                        books[p, k] = own.sum(0) // len(own)
    return sorted((str(i), lab, "".join(f"{k:02x}" for k in c), int(e), sum(
        int(f) for (_, _, other), f in zip(kept, error) if other == lab)) for (i, _, lab), c, e in zip(kept, code, error)), \
        ",".join(map(str, books.ravel()))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_codes(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, spread, 8)], None if i % 7 == 0 else int(i % 3 == 0)) for i in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], 0), (900, None, 1), (901, [1.0, None] * 4, 1),
             (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [], 2), (905, [1.0], 2)]
    rows += [(1000 + i, rows[9][1], 4) for i in range(100)]     # one vector and label hold many rows
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    want, books = lloyd_brute(rows, 4, 16, 3)
    found = codes.compress_vectors(frame, parts=4, entries=16, rounds=3).collect()
    assert sorted((str(r.vec_id), r.label, r.code, r.error, r.label_error) for r in found if r.label is not None) == [
        w for w in want if w[1] is not None]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in found if r.label is None) == [
        (i, c, e, s) for i, lab, c, e, s in want if lab is None]
    assert {r.codebooks for r in found} == {books}


def test_moved_entries_only():
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-5, 5, (500, 2)), rng.integers(-5, 5, (12, 2))
    best, distance = codes.assign_parts(points, entries)
    for _ in range(6):
        new = entries.copy()
        at = rng.integers(0, 12, 3)
        new[at] += rng.integers(-2, 3, (3, 2))
        found = codes.assign_parts(points, new, (new != entries).any(1), best, distance)
        gaps = ((points[:, None] - new[None]) ** 2).sum(-1)
        assert (found[0] == gaps.argmin(1)).all() and (found[1] == gaps.min(1)).all()
        entries, (best, distance) = new, found


def test_codes_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.compress_vectors(none).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks"]
    assert codes.compress_vectors(none).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 16, None, 1, "", 1, 1)], SCHEMA)
    assert [r.code for r in codes.compress_vectors(one).collect()] == ["00" * 16]
    with pytest.raises(ValueError):
        codes.compress_vectors(one, parts=5)
    with pytest.raises(Exception, match="component of"):
        codes.compress_vectors(spark.createDataFrame([(1, [1e30] * 16, None, 1, "", 1, 1)], SCHEMA)).collect()


def test_left_lookup_beyond_the_broadcast_bound(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 5 if i < 4000 else i) for i in range(6000)], "id long, k int")
    totals = common.write_shared(rows.groupBy("k").count().withColumnRenamed("count", "n"), "totals")
    a = common.left_lookup(rows, totals, ["k"], most=0)
    b = common.left_lookup(rows, totals, ["k"])
    assert a.columns == b.columns == ["id", "k", "n"]
    found = sorted(map(str, a.collect()))
    assert found == sorted(map(str, b.collect())) and len(found) == 6000
