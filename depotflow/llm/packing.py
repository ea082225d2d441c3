"""Packing of token sequences into windows by non-negative least squares over length combinations."""

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import text_of, write_shared

#: Characters on whose classes all versions of Unicode agree: both libraries cut such texts alike.
_LATIN_ONLY = re.compile("[\x00-\u024f]*")


def text_encoder(spec, ranks=None, pattern=None):
    """Function from a text to its ids, an array of 32-bit numbers.

    `spec` is the JSON text of a byte-level tokenizer. With `ranks`, the same
    vocabulary as lines of bytes and numbers, and the `pattern` that cuts texts, Latin texts are
    encoded by them, which gives the same ids in a third of the time. Strings of special tokens
    are ordinary text in both.
    """
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    fast = None
    if ranks:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(text):
        if fast and _LATIN_ONLY.fullmatch(text):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def tokenise(docs, spec, id="doc_id", text="text", end_id=1, ranks=None, pattern=None):
    """Written table `key` (unique), `id`, `n`, `ids` (little-endian 32-bit, with `end_id` behind).

    `spec`, `ranks` and `pattern` as in `text_encoder`.
    """
    def encode(batches):
        encoder, end = text_encoder(spec, ranks, pattern), np.array([end_id], "<u4")
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.concatenate([encoder(t), end]) for t in part["text"].to_pylist()]
                keys = np.arange(key, key + len(ids))
                key += len(ids)
                yield pa.record_batch(
                    [pa.array(keys), part["id"], pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "id", "n", "ids"])

    rows = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text"))
    return write_shared(rows.mapInArrow(encode, "key long, id long, n long, ids binary"), "tokens")


def combinations(parts, depth):
    """All sorted tuples of 2 to `depth` positive numbers with sum `parts`."""
    found, open_ = [], [((), parts)]
    while open_:
        head, rest = open_.pop()
        low = head[-1] if head else 1
        if head and rest >= low:
            found.append((*head, rest))
        if len(head) < depth - 1 or not head:
            open_ += [((*head, x), rest - x) for x in range(low, rest // 2 + 1)]
    return sorted(found)


def nnls(matrix, target, rounds=2000):
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    gram, right = matrix.T @ matrix, matrix.T @ target
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    for _ in range(rounds):
        gradient = np.where(active, -np.inf, right - gram @ x)
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9 * max(1.0, abs(right).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = (x[at][low] / (x[at][low] - trial[low])).min()
            x[at] += step * (trial - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(histogram, parts, depth=3):
    """Repeats of combinations that the histogram affords: list of (combination, repeats).

    `histogram[q]` is the number of pieces of q parts, 0 < q < parts.
    """
    shapes = combinations(parts, depth)
    matrix = np.zeros((parts, len(shapes)))
    for j, shape in enumerate(shapes):
        np.add.at(matrix[:, j], list(shape), 1)
    rest = np.array(histogram, np.int64)
    rest[0] = 0
    if not rest.any():
        return []
    solved, used = nnls(matrix[1:], rest[1:].astype(float)), []
    for j in np.argsort(-solved, kind="stable"):
        need = matrix[:, j].astype(np.int64)
        afford = min(rest[q] // need[q] for q in set(shapes[j]))
        repeats = int(min(round(solved[j]), afford))
        if repeats > 0:
            rest -= repeats * need
            used.append((shapes[j], repeats))
    return used


def _running(rows, value, order, parts):
    """Adds `at`, the sum of `value` over all rows before, by parts: sums of parts first, then inside them."""
    spark = rows.sparkSession
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    sums = sorted(rows.groupBy("part").agg(F.sum(value)).collect())
    begins, total = [], 0
    for part, size in sums:
        begins.append((part, total))
        total += size
    before = spark.createDataFrame(begins or [(0, 0)], "part long, begin long")
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(before), "part").withColumn(
        "at", F.col("begin") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("part", "begin"), total


def place(lengths, window=2048, grain=16, depth=3):
    """Pieces `key`, `start`, `length`, `sequence_id`, `offset` for rows `key` (unique), `n` (1 or more).

    Whole windows of a document are sequences of their own. The rests are
    counted by length in units of `grain`; least squares give the repeats of
    combinations of up to `depth` rests that fill a window; counts are rounded
    and ranks inside a length say which rest goes where. What overlaps the
    window's end, under `grain` ids a rest, is cut off. These tails and the rests left
    over are laid end to end and cut at window ends; the last, partial window is
    cut into powers of two, so nothing is padded.
    """
    spark = lengths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = window // grain
    whole = lengths.where(F.col("n") >= window).select("key", F.expr(f"n div {window}").alias("full"))
    whole, n_whole = _running(whole, "full", ["key"], parts)
    first = whole.select("key", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i")).select(
        "key", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    rests = lengths.where(F.col("n") % window > 0).select(
        "key", (F.col("n") - F.col("n") % window).alias("start"), (F.col("n") % window).alias("length"),
        F.expr(f"(n % {window}) div {grain}").alias("q"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    counts = rests.groupBy("q", "part").agg(F.count("*").alias("c"))
    histogram = [0] * bins
    for q, c in counts.groupBy("q").agg(F.sum("c")).collect():
        histogram[q] = c
    slots, number, taken = [], n_whole, [0] * bins
    for shape, repeats in plan(histogram, bins, depth):
        for q in sorted(set(shape)):
            times = shape.count(q)
            slots.append((q, taken[q], taken[q] + repeats * times, number, times, shape.index(q)))
            taken[q] += repeats * times
        number += repeats
    slots = spark.createDataFrame(slots, "q long, low long, high long, base long, times long, slot long")
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(
        Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rests.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy("key")) - 1) \
        .join(before, ["q", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "c", "before")
    seated = write_shared(ranked.alias("r").join(F.broadcast(slots.alias("s")), F.expr(
        "r.q = s.q and r.rank >= s.low and r.rank < s.high"), "left").select(
        "key", "start", "length", F.expr("base + (rank - low) div times").alias("sequence_id"),
        F.expr("slot + (rank - low) % times").alias("slot")), "seats")
    together = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    second = seated.where("sequence_id is not null").withColumn(
        "offset", F.coalesce(F.sum("length").over(together), F.lit(0))).withColumn(
        "fits", F.least(F.col("length"), F.lit(window) - F.col("offset")))
    loose = seated.where("sequence_id is null").select("key", "start", "length").unionAll(
        second.where("fits < length").select(
            "key", (F.col("start") + F.col("fits")).alias("start"), (F.col("length") - F.col("fits")).alias("length")))
    second = second.select("key", "start", F.col("fits").alias("length"), "sequence_id", "offset")

    line, total = _running(write_shared(loose, "loose"), "length", ["key", "start"], parts)
    last = total - total % window
    ends = [last]
    for bit in reversed(range(window.bit_length())):
        if total % window >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    marks = F.array(*[F.lit(x).cast("long") for x in ends])
    stop = F.col("at") + F.col("length")
    cuts = F.array_sort(F.array_distinct(F.concat(
        F.array("at"), F.filter(F.array((F.expr(f"(at div {window} + 1) * {window}"))), lambda x: (x < stop) & (x <= last)),
        F.filter(marks, lambda x: (x > F.col("at")) & (x < stop)))))
    third = line.select("key", "start", "at", "length", F.posexplode(cuts).alias("i", "cut"), cuts.alias("cuts")) \
        .withColumn("to", F.coalesce(F.try_element_at("cuts", F.col("i") + 2), stop)) \
        .withColumn("mark", F.size(F.filter(marks, lambda x: x <= F.col("cut"))))
    inside = F.col("mark") > 0
    third = third.select(
        "key", (F.col("start") + F.col("cut") - F.col("at")).alias("start"),
        (F.col("to") - F.col("cut")).alias("length"),
        F.when(inside, F.lit(number + last // window) + F.col("mark") - 1).otherwise(
            F.lit(number) + F.expr(f"cut div {window}")).alias("sequence_id"),
        F.when(inside, F.col("cut") - F.element_at(marks, F.greatest("mark", F.lit(1)))).otherwise(
            F.col("cut") % window).alias("offset"))
    return first.unionAll(second).unionAll(third)


def pack_documents(docs, spec, id="doc_id", text="text", window=2048, end_id=1, grain=16, depth=3, **fast):
    """Pieces of all documents: `id`, `start`, `length`, `ids`, `doc_tokens`, `sequence_id`, `offset`.

    `ids` holds the piece's token ids as little-endian 32-bit bytes. Null text
    is empty: its document is the end id alone. Null ids and repeated rows are
    packed like others, each row for itself; an empty table gives no pieces.
    Texts are tokenised once into a written table; only lengths go into the plan. `fast`: see `text_encoder`.
    """
    if window & window - 1 or window % grain:
        raise ValueError("window must be a power of two and a multiple of grain")
    tokens = tokenise(docs, spec, id, text, end_id, **fast)
    pieces = place(tokens.select("key", "n"), window, grain, depth).groupBy("key").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    return tokens.join(pieces, "key").select("id", "n", "ids", F.explode("pieces").alias("p")).select(
        F.col("id").alias(id), "p.start", "p.length",
        F.substring("ids", (F.col("p.start") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")
