"""Helpers shared by the corpus operators."""

import math

from pyspark.sql import functions as F

from ..session import fresh_path

#: White space that separates words: blank and \x09 to \x0D, as a Java pattern.
SPACE = "[\\x20\\x09-\\x0D]+"


def write_shared(df, label):
    """Writes rows below the shared folder and reads them back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def smallest_hashes(rows, keys, most):
    """The `most` rows with the smallest xxhash64 of `keys`, then by all columns; all rows if there are fewer.

    Sorting with a limit alone would send that many rows from every task. The rows are
    counted first, and only those under the hash that `most` rows and eight standard deviations more
    are expected to stay under are sorted, so what is sent does not grow with the input.
    Rows with equal keys share one hash, so keys should tell most rows apart.
    """
    n, place = rows.count(), F.xxhash64(*keys)
    few = most + 8 * math.ceil(math.sqrt(most))
    if n > few:
        rows = rows.where(place <= F.lit(-(1 << 63) + (1 << 64) * few // n))
    return rows.orderBy(place, *rows.columns).limit(most)


def id_remainder(column, modulus):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a lookup that may be broadcast (a few MB), and the share of rows, 1 of so many, from which a key is hot.
MOST_BROADCAST = 100_000
HOT_SHARE = 1000


def left_lookup(rows, lookup, keys, count="n", most=MOST_BROADCAST):
    """Left join of `rows` to `lookup`, which has one row a key and in `count` the rows of `rows` with that key.

    Null keys are equal. A lookup of up to `most` rows, counted first, is broadcast. Beyond that the
    keys that hold over a thousandth of the rows, fewer than 1,000 by that definition, are broadcast and
    the others are joined by a shuffle, so no key meets more than that share in one task.
    Both sides should be written tables, since they are read more than once.
    """
    names = [c for c in lookup.columns if c not in keys]
    right = lookup.select(*[F.col(k).alias(f"_{k}") for k in keys], *names, F.lit(True).alias("_met"))
    same = F.expr(" and ".join(f"`{k}` <=> `_{k}`" for k in keys))
    drop = [f"_{k}" for k in keys] + ["_met"]
    if lookup.count() <= most:
        return rows.join(F.broadcast(right), same, "left").drop(*drop)
    total = lookup.agg(F.sum(count)).first()[0]
    hot = right.where(F.col(count) * HOT_SHARE > total)
    cold = right.where(F.col(count) * HOT_SHARE <= total)
    met = rows.join(F.broadcast(hot), same, "left")
    rest = met.where("_met is null").drop(*drop, *names).join(cold, same, "left")
    return met.where("_met").drop(*drop).unionByName(rest.drop(*drop))
