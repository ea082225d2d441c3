"""Archives: every byte back, whatever payloads hold, wherever splits fall."""

import base64
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from depotflow.llm import warc
from depotflow.session import fresh_path

NESTED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77:FAKE>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
HUGE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999999\r\n\r\n"
SCHEMA = "page_id long, url string, html string, size string, digest int, n long, top long, first string, http string"


def rows_of(seed):
    texts = [None, "", "plain", "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n", "x" + NESTED, NESTED * 3 + "tail", "a" + HUGE + "b" * 300,
             "é日本😀\r\n\r\n" * 50, "WARC/1.", "WARC/1.1\r", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "y" * 5000 + NESTED + "z" * 3000,
             "ends in the magic WARC/1.1\r\n", "\r\n\r\n", "no colon WARC/1.1\r\nheader\r\n\r\nbody"]
    out = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    out += [(100 + i, None if i % 3 else "http://a/\r\nWARC-Type: revisit", texts[(i * seed) % len(texts)]) for i in range(90)]
    out += [(1000 + i, "u", "copied page " * 30) for i in range(100)]
    return out + [(None, "u", "only here"), (None, "u", "plain"), (5, "http://h/5", "x" + NESTED)]


def brute(rows, least=0):
    top = {}
    for i, _, t in rows:
        t = t or ""
        if i is not None:
            top[t] = max(top.get(t, i), i)
    out = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        last = top.get(t or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = len(raw) >= least and i != last
        out[(i, len(raw), digest, "revisit" if revisit else "response", last if revisit else None)] += 1
    return out


def number(record_id):
    return None if record_id is None else int(record_id.split(":")[2]) if record_id.split(":")[2] else None


@pytest.mark.parametrize("limit,least", [("128m", 0), ("9000", 6)])
def test_round_trip(spark, limit, least):
    rows = rows_of(7)
    frame = spark.createDataFrame([(*r, "s", 1, 2, 3, "f", "h") for r in rows], SCHEMA).repartition(3)
    path = fresh_path(spark, "archives")
    warc.write_archives(frame, path, least=least)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        records = warc.read_archives(spark, path)
        found = warc.resolve_revisits(records).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found) == brute(rows, least)
    assert all(r.intact for r in found if r.record_type == "response")
    uris = {number(r.record_id): r.target_uri for r in found}
    assert uris[3] == "http://h/3" and uris[100] == "http://a/%0D%0AWARC-Type: revisit" and uris[101] is None


def test_plain_reader_agrees(spark):
    """A reader that goes from length to length finds the same records in the files."""
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(rows_of(3), "page_id long, url string, html string").coalesce(2), path)
    walked = Counter()
    for file in Path(path).glob("part-*"):
        raw, at = file.read_bytes(), 0
        while at < len(raw):
            assert raw.startswith(b"WARC/1.1\r\n", at)
            end = raw.index(b"\r\n\r\n", at)
            length = int(raw[at:end].rpartition(b"Content-Length: ")[2])
            walked[(file.name, at, end + 4 + length + 4)] += 1
            at = end + 4 + length + 4
    found = warc.read_archives(spark, path).collect()
    assert Counter((r.file.rsplit("/", 1)[1], r.start, r.next) for r in found) == walked


def test_empty_and_broken(spark):
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0
    path = fresh_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([(i, "u", f"text {i}") for i in range(9)], "page_id long, url string, html string").coalesce(1), path)
    file = next(Path(path).glob("part-*"))
    for crc in Path(path).glob(".*.crc"):
        crc.unlink()
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(ValueError, match="breaks"):
        warc.read_archives(spark, path)
    assert warc.read_archives(spark, path, strict=False).count() == 8


def test_long_chains(spark):
    edges = [("f", i * 10, i * 10 + 10) for i in range(100)] + [("f", 5, 15), ("f", 15, 40), ("g", 7, 9), ("g", 9, 30)]
    found = warc.reachable(spark.createDataFrame(edges, "file string, pos long, to long"))
    assert sorted(map(tuple, found.collect())) == [("f", i * 10) for i in range(100)]
