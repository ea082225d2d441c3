"""Hard negatives by exact search in Hilbert-ordered blocks with zone maps."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import write_shared
from .integers import integer_vectors

BLOCK = 2048            # rows of a block
STRIPE = 4              # blocks that one task searches together
GROUP = 64              # anchors planned together, about
BATCH = 8               # groups that one task answers
PAGE = 1024             # zone maps planned together, about
CURVE = (8, 6)          # dimensions of the curve and bits of each
NONE = -(1 << 62)


def hilbert_keys(points, bits):
    """Position on the Hilbert curve of integer points (rows), `bits` a dimension.

    From the highest bit down each dimension either mirrors the lower bits of the first
    or trades them with it (Skilling 2004); Gray decoding and interleaving follow.
    """
    x = points.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in x:
            mirror = (axis >> bit) & 1 == 1
            x[0] = np.where(mirror, x[0] ^ low, x[0])
            trade = np.where(mirror, 0, (x[0] ^ axis) & low)
            x[0] ^= trade
            axis ^= trade
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> bit) & 1
    return key


def _lists(column):
    """A list<int> column of equally long lists as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int32)


def _spread(rows):
    """Sum, sum of squares, least and largest value of every component: one row each, combined in the tasks first."""
    def tally(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = _lists(batch["v"]).astype(np.float64)
                found = np.stack([np.full(v.shape[1], len(v)), v.sum(0), (v * v).sum(0), v.min(0), v.max(0)])
                total = found if total is None else np.concatenate([
                    total[:3] + found[:3], np.minimum(total[3:4], found[3:4]), np.maximum(total[4:], found[4:])])
        if total is not None:
            yield pa.record_batch([pa.array(range(total.shape[1]), pa.int32()), *map(pa.array, total)],
                                  ["at", "n", "s", "q", "low", "high"])

    partial = rows.select("v").mapInArrow(tally, "at int, n double, s double, q double, low double, high double")
    return partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
                                     F.min("low").alias("low"), F.max("high").alias("high")).collect()


def _keyed(rows, is_anchor):
    """Rows with their place on the curve through the dimensions that vary most, and whether they are anchors."""
    dims, bits = CURVE
    spread = sorted(_spread(rows), key=lambda r: (-(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["at"]))[:dims]
    at = [r["at"] for r in spread]
    low = np.array([r["low"] for r in spread])
    wide = np.array([r["high"] for r in spread]) - low + 1

    @F.pandas_udf("long")
    def place(v):
        points = np.stack(v.to_numpy())[:, at]
        return pd.Series(hilbert_keys(((points - low) * (1 << bits) // wide).astype(np.int64), bits))

    return write_shared(rows.select("id", "label", "v", place("v").alias("h"), is_anchor.alias("anchor")), "hilbert")


BLOCKS = ("block long, n long, label_low long, label_high long, low binary, high binary, "
          "ids binary, labels binary, anchors binary, v binary")


def _blocks(keyed):
    """Runs of 2,048 rows by label and place on the curve, each with its zone map: ranges of the label and of every component."""
    def cut(batches):
        first, number = TaskContext.get().partitionId() << 32, 0

        def emit(ids, labels, anchors, v):
            nonlocal number
            row = {"block": first + number, "n": len(ids), "label_low": int(labels.min()), "label_high": int(labels.max()),
                   "low": v.min(0).tobytes(), "high": v.max(0).tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(),
                   "anchors": anchors.tobytes(), "v": v.tobytes()}
            number += 1
            return pa.RecordBatch.from_pylist([row])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch["id"].to_numpy(), batch["label"].to_numpy(), batch["anchor"].to_numpy(zero_copy_only=False), _lists(batch["v"])]
            held = own if held is None else [np.concatenate(p) for p in zip(held, own)]
            while len(held[0]) >= BLOCK:
                yield emit(*[p[:BLOCK] for p in held])
                held = [p[BLOCK:] for p in held]
        if held is not None and len(held[0]):
            yield emit(*held)

    order = ["label", "h", "id"]
    return write_shared(keyed.select("id", "label", "h", "anchor", "v").repartitionByRange(*order)
                        .sortWithinPartitions(*order).mapInArrow(cut, BLOCKS), "blocks")


def _block(row):
    ids = np.frombuffer(row["ids"], np.int64)
    v = np.frombuffer(row["v"], np.int32).reshape(len(ids), -1)
    return ids, np.frombuffer(row["labels"], np.int64), v.astype(np.float64 if v.shape[1] <= 512 else np.int64)


def first_places(ids, scores, most):
    """Places of the `most` highest scores, ties to the smaller id."""
    places = np.arange(len(ids))
    if len(ids) > most:
        places = np.flatnonzero(scores >= np.partition(scores, len(ids) - most)[len(ids) - most])
    return places[np.lexsort((ids[places], -scores[places]))[:most]]


def _anchors(blocks, positives):
    """Anchors with the score that their own block already offers for the last positive, a floor for the search."""
    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, v = _block(row)
                mine = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                out = []
                for i, scores in zip(mine, (v[mine] @ v.T).astype(np.int64)):
                    same = np.delete(scores[labels == labels[i]], np.searchsorted(np.flatnonzero(labels == labels[i]), i))
                    floor = np.partition(same, len(same) - positives)[len(same) - positives] if len(same) >= positives else NONE
                    out.append({"id": int(ids[i]), "label": int(labels[i]), "floor": int(floor), "v": v[i].astype(np.int32).tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    return write_shared(blocks.select("ids", "labels", "anchors", "v").mapInArrow(
        find, "id long, label long, floor long, v binary"), "anchors")


def _grouped(anchors, count):
    """Anchors in groups of about 64; ids are distinct, so the groups are even."""
    groups = max(1, -(-count // GROUP))
    return anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")).agg(
        F.collect_list(F.struct(*anchors.columns)).alias("anchors"))


def _matrix(anchors):
    v = np.frombuffer(b"".join(a["v"] for a in anchors), np.int32).reshape(len(anchors), -1)
    return v.astype(np.float64 if v.shape[1] <= 512 else np.int64)


def score_bounds(anchors, low, high):
    """Least and largest inner product of each anchor with any vector of each zone, by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _positive_zones(anchors, zones, bottom, top):
    """Zones that may hold the anchor's label and a score of at least its floor."""
    label = np.array([a["label"] for a in anchors])[:, None]
    floor = np.array([a["floor"] for a in anchors])[:, None]
    return (zones["label_low"] <= label) & (label <= zones["label_high"]) & (top >= floor)


def _negative_zones(share):
    def choose(anchors, zones, bottom, top):
        """Zones that may hold another label and a score inside one of the anchor's windows."""
        label = np.array([a["label"] for a in anchors])[:, None]
        other = (zones["label_low"] != label) | (zones["label_high"] != label)
        met = np.zeros(top.shape, bool)
        for i, anchor in enumerate(anchors):
            for p in anchor["windows"]:
                met[i] |= (100 * top[i] >= share[0] * p["score"]) & (100 * bottom[i] <= share[1] * p["score"])
        return met & other
    return choose


def _striped(zones):
    """Zones with the stripe of their block: about 8,192 rows that follow each other, over the edges of partitions too."""
    part = F.shiftright("block", 32).alias("part")
    # one row for each partition that blocks were cut in
    sizes = zones.groupBy(part).agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    row = F.col("base") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) * BLOCK
    return zones.withColumn("part", part).join(bases, "part").withColumn(
        "stripe", F.floor(row / (BLOCK * STRIPE))).drop("n", "part", "base")


def _plan(groups, blocks, choose):
    """`group`, `block`, `stripe`, `mask`: which anchors of a group must read which block."""
    zones = _striped(blocks.select("block", "n", "label_low", "label_high", "low", "high"))
    pages = max(1, -(-zones.count() // PAGE))
    paged = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int").alias("page")).agg(
        F.collect_list(F.struct(*zones.columns)).alias("zones"))
    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(paged, "page") \
        .select("group", "anchors", "zones")

    def plan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = _matrix(row["anchors"])
                zones = {k: np.array([z[k] for z in row["zones"]]) for k in ("block", "stripe", "label_low", "label_high")}
                low, high = (np.frombuffer(b"".join(z[k] for z in row["zones"]), np.int32).reshape(len(row["zones"]), -1)
                             for k in ("low", "high"))
                need = choose(row["anchors"], zones, *score_bounds(a, low.astype(a.dtype), high.astype(a.dtype)))
                out = [{"group": row["group"], "block": int(zones["block"][z]), "stripe": int(zones["stripe"][z]),
                        "mask": np.packbits(need[:, z]).tobytes()} for z in np.flatnonzero(need.any(0))]
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    return write_shared(met.mapInArrow(plan, "group long, block long, stripe long, mask binary"), "plan")


def _search(groups, blocks, choose, take, schema, batches):
    """Rows that `take` finds for the anchors in the blocks that their bounds choose.

    A task holds one stripe of blocks and answers one batch of groups; only blocks that the batch needs are sent to it.
    """
    plan = _plan(groups, blocks, choose).withColumn("batch", F.pmod(F.col("group"), F.lit(batches)))
    asked = plan.groupBy("group", "stripe", "batch").agg(F.collect_list(F.struct("block", "mask")).alias("blocks")).join(groups, "group")
    sent = blocks.select("block", "ids", "labels", "v").join(
        plan.select("block", F.col("stripe").alias("held"), F.col("batch").alias("asked")).distinct(), "block")

    def answer(left, right):
        held = {r["block"]: _block(r) for r in right.select(["block", "ids", "labels", "v"]).to_pylist()}
        out = []
        for row in left.to_pylist():
            a = _matrix(row["anchors"])
            found = [[] for _ in a]
            for part in row["blocks"]:
                need = np.flatnonzero(np.unpackbits(np.frombuffer(part["mask"], np.uint8))[:len(a)])
                ids, labels, v = held[part["block"]]
                for i, scores in zip(need, (a[need] @ v.T).astype(np.int64)):
                    found[i].append((ids, labels, scores))
            for anchor, parts in zip(row["anchors"], found):
                if parts:
                    out += take(anchor, *(np.concatenate(p) for p in zip(*parts)))
        return pa.Table.from_pylist(out, schema=schema)

    kinds = ", ".join(f"{f.name} long" for f in schema)
    return write_shared(asked.groupBy("stripe", "batch").cogroup(sent.groupBy("held", "asked")).applyInArrow(answer, kinds), "found")


def _take_positives(most):
    def take(anchor, ids, labels, scores):
        own = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]))
        return [{"anchor": anchor["id"], "id": int(ids[own[i]]), "score": int(scores[own[i]])}
                for i in first_places(ids[own], scores[own], most)]
    return take


def _take_negatives(most, share):
    def take(anchor, ids, labels, scores):
        other = labels != anchor["label"]
        ids, scores, out = ids[other], scores[other], []
        for p in anchor["windows"]:
            inside = np.flatnonzero((100 * scores >= share[0] * p["score"]) & (100 * scores <= share[1] * p["score"]))
            out += [{"anchor": anchor["id"], "positive": p["id"], "positive_score": p["score"], "id": int(ids[inside[i]]),
                     "score": int(scores[inside[i]])} for i in first_places(ids[inside], scores[inside], most)]
        return out
    return take


def _longs(*names):
    return pa.schema([(n, pa.int64()) for n in names])


def mine_hard_negatives(vectors, is_anchor, id="vec_id", vector="embedding", label="label", positives=5, negatives=10,
                        share=(30, 90), scale=256):
    """For each anchor and positive the highest-scoring rows of other labels inside the positive's window.

    Components become floor(scale * x); a score is the integer inner product, ties go to the smaller id. An anchor
    is a row where the condition `is_anchor` (over column `id`) holds; its positives are its first
    `positives` other rows of the same label; a negative's score, in hundredths, lies within `share` times the
    positive's. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are cut, in order of label and Hilbert curve, into blocks of 2,048 rows whose zone maps hold the range of the label and
    of every component. Interval arithmetic bounds the scores that a block can offer an anchor: positives are looked for
    where the bound reaches what the anchor's own block offers, negatives where the bounds meet a window. A task
    holds 4 blocks and about 512 anchors and keeps the first rows of each window; the results of blocks are ranked
    together. The search is exact. In many dimensions boxes are wide, so that few blocks may be ruled out.

    Rows with a null id or label, and vectors that are null or empty or hold null or non-finite components, take no part, nor do those
    whose size is not that of the smallest id's vector. Of rows that repeat an id the one with the smallest label, then
    vector, counts. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id, label, vector, scale).where("id is not null and label is not null")
    rows = write_shared(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors")
    size = rows.agg(F.min_by(F.size("v"), "id")).first()[0]
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if size is None:
        return empty
    blocks = _blocks(_keyed(rows.where(F.size("v") == size), is_anchor))
    anchors = _anchors(blocks, positives)
    count = anchors.count()
    if not count:
        return empty
    batches = -(-count // (GROUP * BATCH))
    groups = write_shared(_grouped(anchors, count), "groups")
    near = _search(groups, blocks, _positive_zones, _take_positives(positives), _longs("anchor", "id", "score"), batches)
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives)
    windows = chosen.groupBy("anchor").agg(F.collect_list(F.struct("score", "id")).alias("windows"))
    aimed = anchors.drop("floor").join(windows.withColumnRenamed("anchor", "id"), "id")
    groups = write_shared(_grouped(aimed, count), "groups")
    found = _search(groups, blocks, _negative_zones(share), _take_negatives(negatives, share),
                    _longs("anchor", "positive", "positive_score", "id", "score"), batches)
    ranked = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
