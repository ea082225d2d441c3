"""WARC archives written and read by Spark's text files; record boundaries proven by chains from the file start."""

import hashlib
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, left_lookup, text_of, write_shared

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Base-32 digits as `conv` writes them, and the alphabet of RFC 4648 in the same order.
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(column):
    """SHA-1 of a binary column as 32 upper-case base32 characters: five hex digits are four of base 32."""
    digest = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def write_archives(pages, path, id="page_id", url="url", payload="html", least=0, date="1970-01-01T00:00:00Z"):
    """Writes one record a row, HTTP response or revisit, as WARC 1.1 files below `path`.

    Of rows with equal payloads (by SHA-1) of at least `least` bytes the largest id is the response, the
    others are revisits that refer to it and hold the HTTP header only. Null payloads are empty; null
    ids are below all others; rows that repeat the response's id and payload are responses too. Line
    ends in an address are percent-encoded, a null address has no field. An empty table gives no records; other columns are ignored.
    Each output file is one archive: a row of the text writer is a record, its line end the record's.
    Payloads are read twice and only move if more than 100,000 payloads occur repeatedly.
    """
    body = text_of(payload)
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body")) \
        .withColumn("size", F.octet_length("body").cast("long")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    repeated = write_shared(rows.where(F.col("size") >= least).groupBy("digest").agg(
        F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1"), "repeated")
    rows = left_lookup(rows, repeated, ["digest"])
    first = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("top"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(i).cast("string"), F.lit("")), F.lit(":"), "digest", F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.octet_length("http") + F.when(F.col("first"), F.col("size")).otherwise(0)
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("first"), "response").otherwise("revisit")),
        line("WARC-Record-ID", name("id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", address), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("first"), "").otherwise(F.concat(line("WARC-Refers-To", name("top")), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit("\r\n"))
    rows = rows.withColumn("first", first).withColumn("http", http)
    rows.select(F.concat(head, "http", F.when(F.col("first"), F.col("body")).otherwise("")).alias("value")) \
        .write.option("lineSep", END).text(path)


def _chunks(spark, path):
    """The bytes after each occurrence of the magic, and those before the first, with file, split and file size.

    The text source cuts files into splits; a split's rows come in file order and every byte belongs to one row.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def _by_split(batches):
    """(file, split, file size), iterator position and bytes of each row; counts restart with each split."""
    here, k, at = None, 0, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "split", "file_size", "value")]
        for file, split, size, value in zip(*columns):
            if here != (file, split, size):
                here, k, at = (file, split, size), 0, 0
            yield here, k, at, value
            k, at = k + 1, at + len(value) + len(MAGIC)


def parse_header(value):
    """Fields (lower-case names) and length of the header that follows a magic, or None."""
    end = value.find(END.encode())
    if end < 0:
        return None
    fields = {}
    for raw in value[:end].split(b"\r\n"):
        name, colon, text = raw.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = text.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 16 and fields.get("warc-type")):
        return None
    return fields, end + len(END)


def payload_of(fields, block):
    """The block without its HTTP header, where it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(END.encode())[2]
    return block


CHUNK = ("file string, split long, file_size long, k int, at long, bytes long, next long, exit long, record_type string, "
         "record_id string, refers_to string, target_uri string, claimed string, payload_bytes long, payload_digest string, whole boolean")
_SCHEMA = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind])
                     for name, kind in (c.split() for c in CHUNK.split(", "))])


def _scan(batches):
    """One slim row a chunk: where it lies, and if a header follows the magic, its record's successor.

    Offsets are counted from the split's first row. `exit` is the first successor that is no
    candidate of the split. Digests are taken here if the record ends where its chunk ends.
    """
    def emit(found):
        exits = {}
        for row in reversed(found):
            if row.get("next") is not None:
                row["exit"] = exits[row["at"] - len(MAGIC)] = exits.get(row["next"], row["next"])
        for i in range(0, len(found), 10000):
            yield pa.RecordBatch.from_pylist(found[i:i + 10000], schema=_SCHEMA)

    here, found = None, []
    for where, k, at, value in _by_split(batches):
        if where != here:
            yield from emit(found)
            here, found = where, []
        row = dict(zip(("file", "split", "file_size"), where)) | {"k": k, "at": at, "bytes": len(value)}
        parsed = None if where[1] == 0 and k == 0 else parse_header(value)
        if parsed:
            fields, size = parsed
            end = size + int(fields["content-length"])
            whole = end + len(END) == len(value) and value.endswith(END.encode())
            row |= {"next": at + end + len(END), "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id"),
                    "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
                    "claimed": fields.get("warc-payload-digest"), "whole": whole}
            if whole and fields["warc-type"] != "revisit":
                payload = payload_of(fields, value[size:end])
                row |= {"payload_bytes": len(payload), "payload_digest": b32encode(hashlib.sha1(payload).digest()).decode()}
        found.append(row)
    yield from emit(found)


def reachable(pointers):
    """`file`, `pos` of the nodes reachable from position 0 over `pointers` (file, pos, to), by pointer jumping.

    In every round each pointer is replaced by that of its target, so chains of n pointers take log2(n) rounds.
    """
    jump = write_shared(pointers, "jump")
    nodes = jump.select("file", "pos")
    reach = nodes.where("pos = 0")
    while True:
        target = F.col("to").alias("pos")
        reach = write_shared(reach.unionAll(jump.join(reach, ["file", "pos"]).select("file", target)
                                            .join(nodes, ["file", "pos"], "left_semi")).distinct(), "reach")
        onward = jump.select("file", F.col("pos").alias("to"), F.col("to").alias("far"))
        jump = write_shared(jump.join(onward, ["file", "to"]).select("file", "pos", F.col("far").alias("to")), "jump")
        if jump.isEmpty():
            return reach


def _walk(table):
    """Records of one split on the chain that enters it at `entry`."""
    rows = table.to_pylist()
    by_start = {r["start"]: r for r in rows if r["next"] is not None}
    at, found = rows[0]["entry"], []
    while at in by_start:
        found.append(by_start[at])
        at = by_start[at]["next"]
    return pa.Table.from_pylist(found, schema=table.schema)


def read_archives(spark, path, strict=True):
    """Records of the archives below `path`: `file`, `start`, `next`, header fields, payload size and digest.

    Every occurrence of the magic is a candidate; one whose header parses points to its
    successor by its content length. Only candidates on the chain from the start of a file are
    records: magic, or whole records, inside a payload are passed over. Tasks contract the chains
    of their split, pointer jumping joins the splits, and tasks walk their split from its entry.
    With `strict` an archive whose chain does not end at its end is an error; otherwise the complete records before
    the break are returned. Records whose payload holds the magic lie in several chunks; a second scan
    collects those. Revisits have no payload of their own, see `resolve_revisits`. Archives are plain
    (not compressed) and of version 1.1. `intact` tells whether the digest is the stated one.
    """
    scanned = write_shared(_chunks(spark, path).mapInArrow(_scan, CHUNK), "chunks")
    splits = scanned.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("covers"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = write_shared(splits.select("file", "split", F.coalesce(F.sum("covers").over(before), F.lit(0)).alias("base")), "bases")
    placed = write_shared(scanned.join(base, ["file", "split"]).withColumn(
        "start", F.col("at") + F.col("base") - len(MAGIC)).withColumns(
        {c: F.col(c) + F.col("base") for c in ("next", "exit")}).drop("at", "base"), "placed")
    candidates = placed.where("next is not null")
    exits = candidates.select("file", F.col("exit").alias("start")).distinct()
    entered = candidates.select("file", "split", "start", "exit").join(
        exits.unionAll(candidates.where("start = 0").select("file", "start")).distinct(), ["file", "start"], "left_semi")
    entered = write_shared(entered, "entered")
    reached = reachable(entered.select("file", F.col("start").alias("pos"), F.col("exit").alias("to")))
    entries = entered.join(reached.withColumnRenamed("pos", "start"), ["file", "start"]).select(
        "file", "split", F.col("start").alias("entry"))
    inside = candidates.join(entries, ["file", "split"])
    records = write_shared(inside.groupBy("file", "split").applyInArrow(_walk, inside.schema).where("next <= file_size").drop("entry", "exit"), "records")
    if strict:
        ends = placed.groupBy("file").agg(F.max("file_size").alias("size")).join(
            records.groupBy("file").agg(F.max("next").alias("last")), "file", "left")
        broken = [r["file"] for r in ends.where("last is null or last != size").limit(3).collect()]
        if broken:
            raise ValueError(f"the chain of records breaks in {broken}")
    spread = records.where("not whole")
    fields = ["file", "start", "next", "record_type", "record_id", "refers_to", "target_uri", "claimed", "payload_bytes", "payload_digest"]
    plain = records.where("whole")
    if spread.isEmpty():
        found = plain.select(*fields)
    else:
        joined = _collected(spark, path, placed, records).withColumnsRenamed({"payload_bytes": "b", "payload_digest": "d"})
        found = plain.select(*fields).unionByName(spread.drop("payload_bytes", "payload_digest").join(joined, ["file", "start"]).withColumnsRenamed(
            {"b": "payload_bytes", "d": "payload_digest"}).select(*fields))
    return found.withColumn("intact", F.col("claimed") == F.concat(F.lit("sha1:"), "payload_digest"))


def _collected(spark, path, placed, records):
    """`file`, `start`, payload size and digest of records that lie in several chunks, by a second scan."""
    proven = records.select("file", "split", "k", F.col("start").alias("own"), F.when(~F.col("whole"), F.col("start")).alias("wanted"))
    marked = placed.select("file", "split", "k", "start").join(proven, ["file", "split", "k"], "left")
    latest = F.last("own", True).over(Window.partitionBy("file", "split").orderBy("k"))
    carried = F.last("last", True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    carry = marked.groupBy("file", "split").agg(F.max("own").alias("last")).select("file", "split", carried.alias("carried"))
    covered = marked.withColumn("latest", latest).join(carry, ["file", "split"]).withColumn("record", F.coalesce("latest", "carried"))
    wanted = proven.where("wanted is not null").select("file", F.col("wanted").alias("record"))
    pieces = write_shared(covered.join(wanted, ["file", "record"]).select("file", "split", "k", "start", "record"), "pieces")
    if pieces.count() <= MOST_BROADCAST:
        pieces = F.broadcast(pieces)

    def number(batches):
        for where, k, _, value in _by_split(batches):
            yield pa.record_batch([pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([k], pa.int32()),
                                   pa.array([value], pa.binary())], ["file", "split", "k", "value"])

    chunks = _chunks(spark, path).mapInArrow(number, "file string, split long, k int, value binary")
    parts = chunks.join(pieces, ["file", "split", "k"]).select("file", "record", "start", "value")

    def digest(table):
        rows = sorted(table.select(["start", "value"]).to_pylist(), key=lambda r: r["start"])
        value = MAGIC.encode().join(r["value"] for r in rows)
        fields, size = parse_header(value)
        end = size + int(fields["content-length"])
        if value[end:end + len(END)] != END.encode():
            raise ValueError(f"a record of {end} bytes is not followed by its end")
        payload = payload_of(fields, value[size:end]) if fields["warc-type"] != "revisit" else None
        return pa.table({"file": table["file"][:1], "start": table["record"][:1],
                         "payload_bytes": pa.array([None if payload is None else len(payload)], pa.int64()),
                         "payload_digest": pa.array([None if payload is None else b32encode(
                             hashlib.sha1(payload).digest()).decode()], pa.string())})

    return parts.groupBy("file", "record").applyInArrow(
        digest, "file string, start long, payload_bytes long, payload_digest string")


def resolve_revisits(records):
    """Gives revisits the payload size and digest of the record that they refer to (null where it is missing)."""
    records = write_shared(records, "resolved")
    asked = records.where("record_type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("n"))
    own = records.where("record_type != 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    lookup = write_shared(asked.join(own, "refers_to"), "referred")
    revisits = left_lookup(records.where("record_type = 'revisit'"), lookup, ["refers_to"])
    revisits = revisits.withColumn("payload_bytes", F.col("b")).withColumn("payload_digest", F.col("d"))
    return records.where("record_type != 'revisit'").unionByName(revisits.select(*records.columns))
