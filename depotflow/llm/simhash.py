"""SimHash fingerprints and near duplicates by segment popcounts."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from .common import text_of, write_shared
from .components import components

SEED = 42


def shingle_digests(text, size):
    """XXH64 digests (8 bytes each, big-endian, joined) of a text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return b""
    body = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(body, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *(ends[:-size].tolist())]
    stops = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(body[i:j], SEED) for i, j in zip(begins, stops)])


def fingerprint_of(digests):
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the hashes; none: zero."""
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs, text="text", shingle=3, out="fp"):
    """Adds the fingerprint `out` (long). A-Z lower-cased; fewer words than a shingle make one shingle.

    Null and wordless texts get zero.
    """
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_digests(t, shingle)) for t in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(text_of(text)))


# The embedding has 32 segments of 2 bits; the popcounts of 16 segments, a half, lie in one long, 2 bits each.
_HALVES = ((0, "a"), (32, "b"))


def _half(column, shift):
    half = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(0xFFFFFFFF))
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def _own_cells(fps):
    return fps.select("*", F.explode(F.array(*[
        F.struct(F.lit(n).alias("half"), _half("fp", s).alias("cell")) for s, n in _HALVES])).alias("c")) \
        .select(*fps.columns, "c.half", "c.cell")


def _near_cells(fps):
    """Own cells and those one higher in one segment: with both sides' own cells, all at distance 1."""
    own = _own_cells(fps)
    up = F.expr("""filter(transform(sequence(0, 15), i -> if(
        (shiftrightunsigned(cell, 2 * i) & 3) < 2, cell + shiftleft(1L, 2 * i), null)), x -> x is not null)""")
    return own.select(*fps.columns, "half", F.explode(F.concat(F.array("cell"), up)).alias("cell"))


def fingerprint_components(fps, radius=3):
    """`fp`, `root` of every fingerprint linked to another at `radius` (at most 3) or fewer differing bits.

    `fps` has distinct `fp`. Each fingerprint is mapped to the popcounts of its 32
    segments. The Manhattan distance of these is at most the number of differing
    bits, so of the two halves of a pair within 3 bits one is within distance 1:
    the grid join looks only into the own cell of a half and the 16 cells next to
    it, and the pairs found are verified on the fingerprints.

    First every fingerprint is tied to the smallest one of its cell where they
    are close enough. The join then only returns pairs whose parts are not yet
    tied, so a large group of near copies does not return all its pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    own = _own_cells(fps.select("fp"))
    star = own.join(own.groupBy("half", "cell").agg(F.min("fp").alias("least")), ["half", "cell"]) \
        .where(f"fp != least and bit_count(fp ^ least) <= {radius}")
    tied = components(star.select(F.col("fp").alias("a"), F.col("least").alias("b")))
    parts = write_shared(fps.select("fp").join(tied, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("part")), "parts")
    left = _near_cells(parts).alias("l")
    right = _own_cells(parts).alias("r")
    pairs = left.join(right, F.expr(f"""l.half = r.half and l.cell = r.cell and l.part != r.part
        and bit_count(l.fp ^ r.fp) <= {radius}"""))
    linked = components(pairs.select(F.col("l.part").alias("a"), F.col("r.part").alias("b")).distinct())
    return parts.join(linked, F.col("part") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "part").alias("root"))


def near_duplicates(docs, id="doc_id", text="text", shingle=3, radius=3):
    """One row per input row: `id`, `fp` (long), `component_id`, the smallest id of the component.

    Rows with equal fingerprints are one node, however many they are; null and
    wordless texts have fingerprint zero and link like any other. Null ids: the
    row keeps its null id and takes the component's smallest other id, or null.
    Repeated rows each get a row; an empty table gives no rows; other columns are ignored.
    """
    printed, named = _grouped(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t")), shingle, radius)
    return printed.join(named, "fp").select(F.col("id").alias(id), "fp", "component_id")


def _grouped(rows, shingle, radius):
    """Rows (id, t, others) with their fingerprint instead of t, written, and `fp`, `root`, `component_id` of every fingerprint."""
    printed = write_shared(fingerprints(rows, "t", shingle).drop("t"), "fingerprints")
    fps = write_shared(printed.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = fps.join(fingerprint_components(fps, radius), "fp")
    roots = roots.select("fp", "first", "root")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return printed, roots.join(least, "root").select("fp", "root", "component_id")


def drop_near_duplicates(docs, id="doc_id", text="text", shingle=3, radius=3):
    """The input's columns, and of each component of `near_duplicates` one row: that of the smallest id, then text hash.

    Null ids count as the largest; rows that repeat id and text are one document; null and wordless texts are
    linked by their fingerprint zero. An empty table gives no rows. A row is found again by its id and text
    hash, so texts are shuffled once, by that key, which is even unless a row is repeated.
    """
    whole = F.coalesce(F.col(id).cast("long"), F.lit(2 ** 63 - 1)).alias("id")
    hashed = F.xxhash64(text_of(text)).alias("th")
    printed, named = _grouped(docs.select(whole, F.col(text).alias("t"), hashed), shingle, radius)
    stay = printed.join(named, "fp").groupBy("root").agg(F.min(F.struct("id", "th")).alias("head")).select("head.*")
    row = docs.select(F.struct("*").alias("d"), whole, hashed)
    kept = row.join(stay, ["id", "th"]).dropDuplicates(["id", "th"])
    return kept.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
