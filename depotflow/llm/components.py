"""Connected components of a graph kept as a table of edges."""

from pyspark.sql import functions as F

from .common import write_shared


def _star(edges, large):
    """One star step: neighbours of a node move to the smallest node among them.

    The large step moves the neighbours above a node, the small step those below
    it and the node itself. The minimum is combined in the map tasks, and the
    join has one row a node on one side, so a node with very many edges splits.
    """
    if large:
        edges = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    low = low.withColumn("low", F.least("low", "a"))
    moved = edges.join(low, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
            low.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(edges, a="a", b="b"):
    """`node`, `root` for every node that has an edge; root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014), a
    logarithmic number of rounds. Self loops, repeated edges, either direction
    and an empty table are fine; edges with a null end are dropped. Each round is
    written to the shared folder.
    """
    top, bottom = F.greatest(a, b), F.least(a, b)
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        top.cast("long").alias("a"), bottom.cast("long").alias("b")).where("a > b").distinct()
    edges, before = write_shared(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = write_shared(_star(_star(edges, True), False), "edges")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
