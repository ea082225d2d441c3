"""Repeated runs of lines, found with a suffix array over line numbers by prefix doubling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import SPACE, text_of, write_shared

_LAST = 2 ** 63 - 1
_BUCKET_BITS = 12


def _lines(docs, id, text):
    """Lines with a word: `doc`, `th` (hash of the text), `p` (count of such lines before), `i` (line), hashes, words."""
    body = text_of(text)
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(body).alias("th"),
                       F.split(body, "\n").alias("lines"))
    worded = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
                      lambda s: F.regexp_like(s["line"], F.lit("[^\\x20\\x09-\\x0D]")))
    lines = rows.select("doc", "th", F.posexplode(worded).alias("p", "s"))
    return lines.select(
        "doc", "th", "p", "s.i", F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit(7), "s.line").alias("h2"),
        F.size(F.filter(F.split("s.line", SPACE), lambda w: w != "")).alias("words"))


def _first_ranks(lines):
    """Lines that occur twice or more, with `rank`, the first place of the line's suffixes in hash order.

    Places before a line are summed by buckets of hash values first: 4,096 sums, whatever the size.
    """
    kinds = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "bucket", F.shiftrightunsigned("h1", 64 - _BUCKET_BITS))
    kinds = write_shared(kinds, "line-kinds")
    sums = kinds.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    ranks = kinds.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(before), "bucket").select("h1", "h2", (F.col("inside") + F.col("before")).alias("rank"))
    return lines.join(ranks, ["h1", "h2"]).drop("h1", "h2")


def _doubled(rows, k):
    """Adds the rank by 2^(k+1) lines to the array `ranks`, from ranks by 2^k lines here and 2^k lines on.

    Inside a class of equal suffixes the order is that of the second halves; a
    suffix that ends comes first. Pairs of ranks are counted before classes are
    put in order, so a line that very many documents hold is one row for each continuation.
    """
    run = Window.partitionBy("doc", "th", "run").orderBy("p")
    rows = rows.withColumn("rank", F.element_at("ranks", k + 1)).withColumn(
        "next", F.coalesce(F.lead("rank", 2 ** k).over(run), F.lit(-1)))
    pairs = rows.groupBy("rank", "next").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("rank").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.select("rank", "next", (F.col("rank") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("new"))
    joined = rows.join(pairs, ["rank", "next"]).withColumn("ranks", F.concat("ranks", F.array("new")))
    return write_shared(joined.drop("rank", "next", "new"), "ranks")


def repeated_lines(docs, id="doc_id", text="text", min_words=50):
    """`doc`, `th`, `i`: lines inside a later copy of a run of lines with at least `min_words` words.

    `doc` is the id (null: the largest long), `th` the hash of the text; rows
    with equal id and text are one document.

    Lines without a word are passed over. Lines that occur once end a run. For every start the
    shortest run that reaches `min_words` has at most `min_words` lines, and so has the shortest
    run that reaches it backward from every end, so
    log2(min_words) doublings suffice, however long copies are. The suffixes
    whose prefixes of that length are equal are an interval of the suffix array
    with at least this common prefix; two overlapping ranks by a power of two lines name it.
    All but its first suffix (in order of id, text hash, line) start a copy.

    A maximal repeated run is the union of these: with s its last start that has `min_words`
    words up to the run's end, the runs from its starts up to s cover the lines up to s, and the
    shortest run back from its end is the one from s to the end.
    """
    lines = write_shared(_lines(docs, id, text).dropDuplicates(["doc", "th", "p"]), "lines")
    rows = _first_ranks(lines)
    inner = Window.partitionBy("doc", "th").orderBy("p")
    rows = rows.withColumn("run", F.col("p") - F.row_number().over(inner))
    run = Window.partitionBy("doc", "th", "run").orderBy("p")
    before = F.sum("words").over(run) - F.col("words")
    rows = rows.withColumn("before", before).withColumn(
        "left", F.sum("words").over(Window.partitionBy("doc", "th", "run")) - F.col("before"))
    within = Window.partitionBy("doc", "th", "run").orderBy("before").rangeBetween(0, min_words - 1)
    rows = rows.withColumn("m", F.count("*").over(within)).withColumn(
        "m", F.when(F.col("left") >= min_words, F.col("m"))).withColumn("upto", F.col("before") + F.col("words"))
    back = Window.partitionBy("doc", "th", "run").orderBy("upto").rangeBetween(1 - min_words, 0)
    # A run back from an end that is also the shortest from its start is not named twice.
    rows = rows.withColumn("back", F.count("*").over(back)).withColumn("from", F.min("before").over(back)).withColumn(
        "back", F.when(F.col("before") - F.col("from") >= min_words, F.col("back"))).select(
        "doc", "th", "p", "i", "run", "m", "back", F.array("rank").alias("ranks"))
    rows = write_shared(rows, "ranks")
    longest = rows.agg(F.greatest(F.max("m"), F.max("back"))).first()[0] or 0
    for k in range(max(0, longest.bit_length() - 1)):
        rows = _doubled(rows, k)

    level = F.expr("cast(floor(log2(m)) as int)")
    backward = rows.where("back is not null").select(
        "doc", "th", F.expr("p - cast(back as int) + 1").alias("p"), F.col("back").alias("m"))
    starts = rows.where("m is not null").select("doc", "th", "p", "m", "ranks").unionByName(
        backward.join(rows.select("doc", "th", "p", "ranks"), ["doc", "th", "p"])).withColumn("k", level).select(
        "doc", "th", "p", "m", "k", F.element_at("ranks", F.col("k") + 1).alias("head"),
        F.expr("p + m - shiftleft(1, k)").alias("at"))
    ends = rows.select("doc", "th", F.col("p").alias("at"), F.col("ranks").alias("tail_ranks"))
    starts = write_shared(starts.join(ends, ["doc", "th", "at"]).select(
        "doc", "th", "p", "m", "head", F.element_at("tail_ranks", F.col("k") + 1).alias("tail")), "starts")
    interval = ["m", "head", "tail"]
    # Written, so that the join reads two plain shuffles and a hot interval is split.
    firsts = write_shared(starts.groupBy(*interval).agg(
        F.min(F.struct("doc", "th", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    copies = starts.join(firsts, interval).where(F.struct("doc", "th", "p") != F.col("first"))
    copied = copies.select("doc", "th", F.explode(F.expr("sequence(p, p + cast(m as int) - 1)")).alias("p")).distinct()
    return copied.join(rows, ["doc", "th", "p"]).select("doc", "th", "i")


def dedup_lines(docs, id="doc_id", text="text", min_words=50, count=None):
    """The input's rows and columns without later copies of repeated runs of lines.

    The first copy of every run stays, in the order of ids. Blank lines stay
    where they are, unless no other line is left: then the text is empty. Null texts stay
    null; rows with equal id and text are one document and get the same text; a
    null id counts as the last. An empty table gives an empty table. `count` names an optional
    column with the number of lines deleted.
    """
    gone = repeated_lines(docs, id, text, min_words).groupBy("doc", "th").agg(F.collect_set("i").alias("gone"))
    body = F.col(f"d.`{text}`").cast("string")
    row = docs.select(F.struct("*").alias("d")).select(
        "d", F.coalesce(F.col(f"d.`{id}`").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"))
    rest = F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("gone", i))
    left = F.array_join(rest, "\n")
    clean = F.when(F.col("gone").isNull(), body).when(
        F.regexp_like(left, F.lit("[^\\x20\\x09-\\x0D]")), left).otherwise("")
    columns = [(clean if c == text else F.col(f"d.`{c}`")).alias(c) for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(count))
    return row.join(gone, ["doc", "th"], "left").select(*columns)
