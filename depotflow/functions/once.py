"""Keeping costly column expressions, and whole inputs, from being evaluated twice."""

from pyspark.sql import functions as F


def computed_once(df, columns):
    """Adds columns that later filters read as values.

    A filter on a plain projected column is pushed below the projection with a
    copy of the whole expression. Unfolding a one-element array of structs
    gives the same rows, and filters on its fields stay above it.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def shuffled_once(df, keys):
    """Function that gives `df` anew for each use, all of them read from one shuffle by `keys`.

    Rows go through it as arrays of one struct, since each use reads other columns: pruned columns below the shuffle would
    make it another one, and everything below would run once for each use. The number of partitions is stated
    because a small file with many rows is read in one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = df.select(F.array(F.struct(*df.columns)).alias("t")).repartition(
        partitions, *[F.col("t")[0][k] for k in keys])
    return lambda: packed.select(F.inline("t"))
