"""Vectors as short codes: product quantisation by Lloyd rounds that only follow moved entries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import left_lookup, write_shared
from .integers import integer_vectors


def _matrix(column, parts):
    """A list column of equally long lists as (rows, parts, components of a part)."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(column)
    return flat[column.offsets[0].as_py():].reshape(rows, parts, -1) if rows else np.zeros((0, parts, 0), np.int64)


def nearest(points, entries, among, best, distance):
    """Improves `best` and `distance` of points by the entries listed in `among`, ascending; ties to the lower index."""
    for k in among:
        gap = points - entries[k]
        found = np.einsum("ij,ij->i", gap, gap)
        better = (found < distance) | ((found == distance) & (k < best))
        distance[better], best[better] = found[better], k


def assign_parts(points, entries, moved=None, best=None, distance=None):
    """Nearest entry and its exact squared distance of each point of one part position.

    Without an earlier state every entry is compared. With it, a point whose entry did
    not move still holds its exact distance and has beaten all other unmoved entries, so
    only moved entries are compared; a point whose entry moved is compared with all.
    """
    if best is None:
        best = np.full(len(points), len(entries), np.int64)
        distance = np.full(len(points), np.iinfo(np.int64).max)
        nearest(points, entries, range(len(entries)), best, distance)
        return best, distance
    best, distance = best.copy(), distance.copy()
    again = moved[best]
    if again.any():
        best[again], distance[again] = assign_parts(points[again], entries)
    stay = np.flatnonzero(~again)
    if len(stay) and moved.any():
        b, d = best[stay], distance[stay]
        nearest(points[stay], entries, np.flatnonzero(moved), b, d)
        best[stay], distance[stay] = b, d
    return best, distance


def _code_type(entries):
    """Entry numbers as stored: one byte, or two with the higher one first."""
    return np.dtype(np.uint8 if entries <= 256 else ">u2")


STATE = "id long, label long, v array<int>, code binary, distance array<long>"


def _assign(rows, books, moved=None):
    """Rows with the code and distances under the codebooks; `books` (parts, entries, components) travels with the tasks."""
    parts, kind = len(books), _code_type(books.shape[1])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch["v"], parts)
            code = np.empty((len(points), parts), np.int64)
            distance = np.empty((len(points), parts), np.int64)
            if moved is not None:
                code[:] = np.frombuffer(b"".join(batch["code"].to_pylist()), kind).reshape(-1, parts)
                distance[:] = _matrix(batch["distance"], 1)[:, 0]
            for p in range(parts):
                state = () if moved is None else (moved[p], code[:, p], distance[:, p])
                code[:, p], distance[:, p] = assign_parts(points[:, p], books[p], *state)
            packed = [c.tobytes() for c in code.astype(kind)]
            yield pa.record_batch([
                batch["id"], batch["label"], batch["v"], pa.array(packed, pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, distance.size + 1, parts, dtype=np.int32), distance.ravel())],
                ["id", "label", "v", "code", "distance"])

    return write_shared(rows.mapInArrow(run, STATE), "codes")


def _moved_books(state, books):
    """Codebooks after one update, and which entries differ. Sums are combined in the tasks first."""
    parts, entries, width = books.shape
    kind = _code_type(entries)

    def tally(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch["v"], parts)
                code = np.frombuffer(b"".join(batch["code"].to_pylist()), kind).reshape(-1, parts)
                for p in range(parts):
                    np.add.at(sums[p], code[:, p], points[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
        used = np.argwhere(counts)
        yield pa.record_batch([
            pa.array([int(p) * entries + int(k) for p, k in used], pa.int32()),
            pa.array([[int(counts[p, k]), *sums[p, k].tolist()] for p, k in used], pa.list_(pa.int64()))],
            ["slot", "sums"])

    partial = state.select("v", "code").mapInArrow(tally, "slot int, sums array<long>")
    totals = partial.select("slot", F.posexplode("sums").alias("at", "n")).groupBy("slot", "at").agg(F.sum("n").alias("n"))
    new = books.copy()
    found = np.zeros((parts * entries, width + 1), np.int64)
    for slot, at, n in totals.collect():    # parts x entries x (components of a part + 1) numbers at most
        found[slot, at] = n
    used = found[:, 0] > 0
    new.reshape(-1, width)[used] = found[used, 1:] // found[used, :1]
    return new, (new != books).any(axis=2)


def first_vectors(rows, entries):
    """The vectors of the smallest ids, ascending; equal ids by vector, null ids last."""
    key = F.col("id").asc_nulls_last()
    ids = [r[0] for r in rows.select("id").orderBy(key).limit(entries).collect()]
    if not ids:
        return []
    near = rows if ids[-1] is None else rows.where(F.col("id") <= ids[-1])
    return [r[0] for r in near.select("v", "id").orderBy(key, "v").limit(entries).collect()]


def compress_vectors(vectors, id="vec_id", vector="embedding", label="label", parts=16, entries=64, rounds=2, scale=256):
    """`id`, `label`, `code`, `error`, `label_error`, `codebooks` (all entries as text) of every kept vector.

    Components become floor(scale * x). A vector is cut into `parts` equal parts; the codebook of a part
    position starts as that part of the vectors of the smallest ids, `entries` of them (fewer if there
    are fewer; at most 65,536). Each round assigns every part to the nearest entry, ties to the lower index, and moves each
    used entry to the floor of the mean. Assignments after the first follow `assign_parts`: the code and exact
    distances of each vector are kept with it in a written table, and only what a move can change is compared.

    `error` sums the final squared distances of a vector, `label_error` the errors of equal labels, nulls
    together. Vectors that are null or empty or hold null or non-finite components, and those
    whose size is not that of the smallest id's vector, are dropped; that size must be a
    multiple of `parts`. Null ids come last; repeated rows each count and get a row; an empty
    table gives no rows; other columns are ignored. The driver holds the codebooks (entries x components numbers).
    """
    spark = vectors.sparkSession
    schema = "id long, label long, code string, error long, label_error long, codebooks string"
    rows = write_shared(integer_vectors(vectors, id, label, vector, scale), "vectors")
    first = first_vectors(rows, 1)
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    size = len(first[0])
    if size % parts or not 0 < entries <= 65536:
        raise ValueError(f"vectors of {size} components do not divide into {parts} parts")
    rows = rows.where(F.size("v") == size)
    start = np.array(first_vectors(rows, entries), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    state, moved = _assign(rows, books), None
    for _ in range(rounds):
        books, moved = _moved_books(state, books)
        state = _assign(state, books, moved)
    coded = state.select("id", "label", F.lower(F.hex("code")).alias("code"),
                         F.aggregate("distance", F.lit(0).cast("long"), lambda s, x: s + x).alias("error"))
    totals = write_shared(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    text = ",".join(map(str, books.ravel().tolist()))
    found = left_lookup(coded, totals, ["label"])
    return found.select(F.col("id").alias(id), "label", "code", "error", "label_error", F.lit(text).alias("codebooks"))

