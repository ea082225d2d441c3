"""Vectors as integers, shared by the operators on exact integer arithmetic."""

from pyspark.sql import functions as F

#: Integers must stay below this, so that sums of products are exact in double precision up to 512 components.
LIMIT = 1 << 22


def integer_vectors(vectors, id, label, vector, scale=256):
    """`id` long, `label` long, `v` array<int>: floor(scale * x) of every component, x as double.

    Rows whose vector is null or holds a null, NaN or infinite component are left out, as are
    empty vectors. A result of 2^22 or more in magnitude raises an error.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) * scale < LIMIT, F.floor(x * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"component of {LIMIT // scale} or more")).cast("int")))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
