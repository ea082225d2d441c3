"""Reading, normalising and landing the movement table."""

import contextlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import year_month
from ..schema import MOVE_TYPE_LABELS, MOVEMENT, MOVEMENT_HEADERS, MOVEMENT_LANDED
from .tables import normalise_headers


def read_movement(spark, path, landed=True):
    """The movement table with its fixed schema; a missing path raises.

    A landed table also has its partition column `move_month`; date filters use
    it to read only the months they need.
    """
    return spark.read.schema(MOVEMENT_LANDED if landed else MOVEMENT).parquet(path)


def read_extract(spark, path):
    """Movement rows exported as CSV files with a header, in the extract's or our own names.

    Headers may come in any order; headers and labels are translated. A date
    may carry a time of day, which is cut off. A missing column or an unreadable value raises.
    """
    text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = standardise_movement(text)
    return named.select(*[named[f.name].cast(f.dataType).alias(f.name) for f in MOVEMENT])


def standardise_movement(df):
    """Extract headers and movement labels translated to the names used here."""
    return normalise_headers(df, MOVEMENT_HEADERS).replace(
        MOVE_TYPE_LABELS, subset=["move_type"])


def land_movement(df, path):
    """Writes monthly partitions.

    The rebalance step gathers each month's rows into few files and splits a
    month that is far larger than the others over several tasks.
    """
    (df.withColumn("move_month", year_month("move_date"))
     .hint("rebalance", "move_month")
     .write.mode("errorifexists").partitionBy("move_month").parquet(path))


# Rows of a file of a month, and bytes that a task packs at once.
FILE_ROWS, PACKED_BYTES = 1_000_000, 64 << 20
# Rows whose losses travel as one bitmap, in words of 64, and most bitmaps that are carried to every task.
BITMAP_ROWS, MOST_BITMAPS = 4_096, 1 << 18
_LANDED_EXTRACTS = T.StructType(MOVEMENT_LANDED.fields[:-1] + [T.StructField("extract_no", T.LongType()), MOVEMENT_LANDED.fields[-1]])


def land_extract(df, path, extract_no, key=("ref_no",)):
    """Lands an extract on a monthly table that may hold earlier ones; returns the months written.

    All rows of a key come from the highest extract number that has the key: a corrected extract replaces
    them, also where their month changed, an older one that comes late adds only keys that no newer one has, and landing
    an extract again changes nothing. Months whose rows stay the same are not rewritten. Rows with a null in the key are
    kept from every number, once for each.

    Keys and digests of rows tell which months change. Rows that are replaced are found by key and known by their
    places in the files, so other rows are not shuffled by key, unless they come late. Rows of changed months are shuffled
    once, by month and packed in columns. `df` is read several times.
    Months are written beside the table first, so a run that fails before the last step leaves it as it was. The
    last step moves the months into their places as wholes.
    """
    spark, key = df.sparkSession, list(key)
    incoming = df.withColumn("extract_no", F.lit(extract_no).cast("long")).withColumn("move_month", year_month("move_date"))
    incoming = incoming.select(*_LANDED_EXTRACTS.fieldNames())
    try:
        current = spark.read.schema(_LANDED_EXTRACTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return _put_months(incoming, path, counted=[incoming])
    numbers = [r[0] for r in current.select("extract_no").distinct().collect() if r[0] is not None]
    older, same, newer = (current.where(c) for c in (
        F.col("extract_no") < extract_no, F.col("extract_no") == extract_no, F.col("extract_no") > extract_no))
    has_older, has_newer = min(numbers, default=extract_no) < extract_no, max(numbers, default=extract_no) > extract_no
    keys, newer_keys = incoming.select(*key).distinct(), newer.select(*key).distinct()

    def added(rows):
        # a join with a side that is known to be empty would still shuffle the rows
        return rows.join(newer_keys, key, "left_anti") if has_newer else rows

    # rows of this number go and come anew: they are what a first, failed or repeated landing left
    changes = added(_digests(incoming, 1, *key)).select(*_DIGESTS).unionByName(_digests(same, -1))
    with _folder_beside(spark, path) as folder:
        if has_older:
            placed = older.selectExpr("*", *_PLACE)
            _lost(placed.select(*key, "move_month", "file", "row").join(keys, key, "left_semi")).write.parquet(folder)
            lost = spark.read.parquet(folder)
            changes = changes.unionByName(lost.select("move_month", "lost"), allowMissingColumns=True)
        sums = changes.groupBy("move_month").agg(
            F.sum("lost"), F.sum("rows"), *[F.sum(F.col(c).cast("decimal(20,0)") * F.col("rows")) for c in _DIGESTS[3:]])
        months = [r[0] for r in sums.collect() if any(r[1:])]
        if not months:
            return []
        month = F.col("move_month")
        changed = month.isin([m for m in months if m]) | (month.isNull() if None in months else F.lit(False))
        merged = newer.where(changed).unionByName(added(incoming.where(changed)))
        if has_older:
            merged = merged.unionByName(_without(placed.where(changed), lost).select(*merged.columns))
        return _put_months(merged, path, months, counted=[current.where(changed), incoming.where(changed)])


_DIGESTS = ("move_month", "lost", "rows", "digest", "other")


def _digests(rows, sign, *kept):
    """Two hashes of each row over all columns; summed by month with the sign, equal rows added and taken away cancel out."""
    names = MOVEMENT.fieldNames()
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])  # hashes pass over nulls
    hashes = [F.xxhash64(F.lit(seed), nulls, *names).alias(name) for seed, name in enumerate(_DIGESTS[3:])]
    return rows.select(*kept, "move_month", F.lit(0).alias("lost"), F.lit(sign).alias("rows"), *hashes)


# The place of a row in a table: files of different months may have one name.
_PLACE = ("_metadata.file_name as file", "_metadata.row_index as row")


def _lost(rows):
    """Bitmaps of the places of `rows` (move_month, file, row), one for BITMAP_ROWS rows of a file, and the number `lost` of each."""
    words = rows.groupBy("move_month", "file", F.expr(f"row div {BITMAP_ROWS}").alias("block"), F.expr(
        f"cast(row % {BITMAP_ROWS} div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("bits"), F.count("*").alias("lost"))
    every = F.sequence(F.lit(0), F.lit(BITMAP_ROWS // 64 - 1))
    return words.groupBy("move_month", "file", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.sum("lost").alias("lost")).withColumn(
        "bits", F.transform(every, lambda word: F.coalesce(F.try_element_at("bits", word), F.lit(0).cast("long"))))


def _without(placed, lost):
    """Rows whose places are not in the bitmaps `lost`; these are carried to every task as long as they are few."""
    lost = lost.select(F.coalesce("move_month", F.lit("")).alias("in_month"), F.col("file").alias("in_file"), "block", "bits")
    if lost.count() <= MOST_BITMAPS:
        lost = F.broadcast(lost)
    here = (F.coalesce("move_month", F.lit("")) == F.col("in_month")) & (F.col("file") == F.col("in_file"))
    bit = F.expr(f"getbit(bits[cast(row % {BITMAP_ROWS} div 64 as int)], cast(row % 64 as int))")
    return placed.join(lost, here & (F.expr(f"row div {BITMAP_ROWS}") == F.col("block")), "left").where(
        F.coalesce(bit, F.lit(0)) == 0)


def _dealt_by_month(rows, counted):
    """`rows` dealt by month, a month to as many tasks as it has FILE_ROWS; small months share a task.

    Rows travel in columns, in parts of one month, which takes about a quarter of the bytes of a shuffle of rows. The frames
    of `counted` have the months of all rows, or of some more.
    """
    counts = counted[0].select("move_month")
    for other in counted[1:]:
        counts = counts.unionAll(other.select("move_month"))
    slots, used, full = {}, 0, 0
    for month, count in sorted(counts.groupBy("move_month").count().collect(), key=lambda r: r[0] or ""):
        if full and full + count > FILE_ROWS:
            used, full = used + 1, 0
        many = -(-count // FILE_ROWS)
        slots[month] = used, many
        used, full = (used + many, 0) if many > 1 else (used, full + count)

    def pack(batches):
        turn, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACKED_BYTES:
                yield _packed(held, slots, turn)
                turn, held, size = turn + 1, [], 0
        if held:
            yield _packed(held, slots, turn)

    def unpack(batches):
        for batch in batches:
            for part in batch["part"]:
                table = pq.ParquetFile(pa.BufferReader(part.as_buffer())).read(use_threads=False)
                yield from table.to_batches(max_chunksize=10_000)

    packed = rows.mapInArrow(pack, "slot int, part binary").repartitionById(used + 1, "slot")
    return packed.mapInArrow(unpack, rows.schema)


def _packed(batches, slots, turn):
    """Rows sorted and cut by month, each month as the bytes of a Parquet file with the slot that it goes to."""
    table = pa.Table.from_batches(batches)
    table = table.take(pc.sort_indices(table, [("move_month", "ascending"), ("move_date", "ascending")])).combine_chunks()
    numbers, parts = [], []
    runs = pc.run_end_encode(table["move_month"].combine_chunks())
    first = 0
    for month, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
        out = pa.BufferOutputStream()
        pq.write_table(table.slice(first, end - first), out, compression="zstd", write_statistics=False)
        start, many = slots.get(month, (0, 1))
        numbers.append(start + turn % many)
        parts.append(out.getvalue().to_pybytes())
        first = end
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["slot", "part"])


@contextlib.contextmanager
def _folder_beside(spark, path):
    """A path beside the table, whose folder is taken away at the end."""
    beside = _beside(path)
    try:
        yield beside
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _beside(path):
    return f"{path.rstrip('/')}.landing-{uuid.uuid4().hex}"


def _put_months(rows, path, months=(), counted=()):
    """Writes rows by month beside the table and moves the folders into place; of `months`, those without rows are dropped."""
    spark, staged = rows.sparkSession, _beside(path)
    (_dealt_by_month(rows, counted).sortWithinPartitions("move_month", "move_date")
     .write.partitionBy("move_month").parquet(staged))
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    filled = {r[0] for r in spark.read.schema(_LANDED_EXTRACTS).parquet(staged).select("move_month").distinct().collect()}
    if filled:
        files.mkdirs(folder(path))
    for month in filled.union(months):
        name = f"move_month={'__HIVE_DEFAULT_PARTITION__' if month is None else month}"
        files.delete(folder(f"{path}/{name}"), True)
        if month in filled and not files.rename(folder(f"{staged}/{name}"), folder(f"{path}/{name}")):
            raise OSError(f"{staged}/{name} was not moved to {path}")
    files.delete(folder(staged), True)
    spark.catalog.refreshByPath(path)
    return sorted(filled.union(months), key=lambda m: m or "")
