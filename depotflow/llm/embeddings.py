"""Near duplicates of vectors by counting collisions of one-dimensional projections."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import write_shared
from .components import components

BLOCK = 2048
PROJECTIONS = 40
RECALL = 0.9999
SEED = 20


def collision_count(distance, half_width, projections=PROJECTIONS, recall=RECALL):
    """Largest number of collisions that pairs at `distance` reach with probability `recall`.

    A pair's difference along a Gaussian direction is normal with the distance
    as deviation, and directions are independent, so the count is binomial.
    """
    p = math.erf(half_width / distance / math.sqrt(2))
    tail = 0.0
    for k in range(projections, 0, -1):
        tail += math.comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


def directions(size, projections=PROJECTIONS):
    return np.random.default_rng(SEED).standard_normal((size, projections))


def candidate_pairs(left, right, half_width, least):
    """Positions of pairs with at least `least` window collisions.

    Each projection of the right side is sorted; the window around a left
    value is a range of places in that order.
    """
    counts = np.zeros((len(left), len(right)), np.uint8)
    for a, b in zip(left.T, right.T):
        order = np.argsort(b, kind="stable")
        place = np.empty(len(b), np.uint16)
        place[order] = np.arange(len(b))
        low = np.searchsorted(b[order], a - half_width, "left").astype(np.uint16)
        high = np.searchsorted(b[order], a + half_width, "right").astype(np.uint16)
        counts += (place[None, :] - low[:, None]) < (high - low)[:, None]
    return np.nonzero(counts >= least)


def smallest_reachable(size, a, b):
    """For each of `size` nodes the smallest one reachable over the edges a-b."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _link_block(pdf, threshold):
    """Links between two blocks of vectors: links by node and a forest, not all pairs."""
    vectors = np.stack(pdf["unit"].to_numpy()).astype(np.float64)
    nodes, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    side, same = pdf["side"].to_numpy(), bool(pdf["same"].iloc[0])
    a_at = np.flatnonzero(side == 0)
    b_at = a_at if same else np.flatnonzero(side == 1)
    distance = math.sqrt(2 - 2 * threshold) or 1e-9
    least = collision_count(distance, distance)
    lines = vectors @ directions(vectors.shape[1])
    i, j = candidate_pairs(lines[a_at], lines[b_at], distance * (1 + 1e-9), least)
    i, j = a_at[i], b_at[j]
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        part = slice(at, at + 100_000)
        keep[part] = np.einsum("ij,ij->i", vectors[i[part]], vectors[j[part]]) >= threshold
    i, j = i[keep], j[keep]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    order = np.argsort(nodes, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    root = order[smallest_reachable(len(nodes), place[i], place[j])][place]
    linked = np.flatnonzero(links)
    return pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]], "links": links[linked]})


def near_vectors(vectors, id="vec_id", vector="embedding", label="label", threshold=0.93):
    """One row per input row: `id`, `n_links`, `component_id`, `kept`.

    Vectors link if their labels are equal and not null, their sizes are equal
    and their cosine is at least `threshold`. Null, empty and zero vectors and
    those with a null, NaN or infinite component link with nothing.

    Equal vectors of a label are one node with its number of copies. Nodes are laid into cells of the
    projection on one unit direction as wide as the largest distance of a link,
    so links lie in one cell or two next to each other; cells are cut into blocks
    of about 2,048. Two blocks meet in one task, which counts window
    collisions over sorted projections, verifies the pairs that pass the
    calibrated count by cosine, and returns link counts and a forest. A pair at
    the threshold is found with probability 0.9999. Work inside a label
    stays quadratic in its distinct vectors unless the cells part them.

    A null id takes the component's smallest id (null if there is none) and is
    kept only if that is null too; repeated rows are copies of each other; an
    empty table gives no rows; other columns are ignored.
    """
    values = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), values.alias("v"))
    fine = F.col("label").isNotNull() & F.coalesce(F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # powers of two keep the cosine the same and squares from overflowing
    peak = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(peak))))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    nodes = rows.where("fine").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = nodes.withColumn("v2", scaled).withColumn("norm", F.sqrt(F.aggregate(
        "v2", F.lit(0.0), lambda s, x: s + x * x)))
    width = math.sqrt(max(2 - 2 * threshold, 1e-18))
    seed = F.transform("v2", lambda x, i: x * F.cos(i.cast("double") * 12.9898 + 1))
    size = F.sqrt(F.aggregate(F.transform("v2", lambda x, i: F.pow(F.cos(i.cast("double") * 12.9898 + 1), F.lit(2))),
                              F.lit(0.0), lambda s, x: s + x))
    nodes = nodes.select(
        "label", "v", "first", "copies", F.size("v").alias("dims"),
        F.transform("v2", lambda x: x / F.col("norm")).alias("unit"),
        F.floor(F.aggregate(seed, F.lit(0.0), lambda s, x: s + x) / F.col("norm") / size / (width * (1 + 1e-9))).alias("cell"),
        F.monotonically_increasing_id().alias("node"))
    nodes = write_shared(nodes, "vectors")
    cells = nodes.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    key = ["label", "dims", "cell"]
    blocked = nodes.select(*key, "node", "copies", "unit").join(cells, key).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = cells.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    other = blocks.select("label", "dims", F.col("cell").alias("cell2"), F.col("block").alias("block2"))
    meets = blocks.withColumn("cell2", F.explode(F.array("cell", F.col("cell") + 1))).join(
        other, ["label", "dims", "cell2"]).where("cell2 > cell or block2 >= block")
    meets = meets.withColumn("same", F.expr("cell2 = cell and block2 = block")).withColumn(
        "meeting", F.xxhash64(*key, "block", "cell2", "block2"))
    seats = meets.select(*key, "block", "meeting", "same", F.lit(0).alias("side")).unionAll(
        meets.where("not same").select("label", "dims", F.col("cell2").alias("cell"), F.col("block2").alias("block"),
                                       "meeting", "same", F.lit(1).alias("side")))
    together = blocked.join(seats, [*key, "block"]).select("meeting", "same", "side", "node", "copies", "unit")
    links = write_shared(together.groupBy("meeting").applyInPandas(
        lambda pdf: _link_block(pdf, threshold), "a long, b long, links long"), "links")
    roots = components(links.where("a != b"))
    summed = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("label", "v", "node", "first", "copies").join(roots, "node", "left") \
        .join(summed, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = write_shared(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(
        "label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("fine").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
