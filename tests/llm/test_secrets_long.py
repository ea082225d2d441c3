"""Secret scan over texts with very many matches, against brute force."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotflow.llm import secrets


SCHEMA = "doc_id long, text string, source string, lang string"


def lines(rng, n):
    word = lambda size: "".join(rng.choice(list("abcdef0123456789GHXYZ/é"), size))
    made = [lambda: f"token = '{word(12)}'", lambda: f"AKIA{word(4).upper()}ABCDEFGH0123", lambda: f"key {word(24)}x9",
            lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), lambda: f"secret:{'0a' * 20}", lambda: "ünrelated text", lambda: ""]
    return "\n".join(made[i]() for i in rng.integers(0, len(made), n))


def masked(text, spans):
    out, at = [], 0
    for begin, end in sorted(spans):
        if begin >= at:
            out += [text[at:begin], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700])
def test_same_as_brute_force(spark, n):
    texts = [lines(np.random.default_rng([n, i]), n) for i in range(4)] + [None, "", "nothing"]
    frame = spark.createDataFrame([(i, t, f"s{i}", "en") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(frame).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(frame).collect()}
    base = {i: [(m.start(), m.end(), kind, m[group]) for kind, pattern, group, least in secrets.BASE_KINDS
                for m in re.finditer(pattern, t or "") if len(m[group]) >= least] for i, t in enumerate(texts)}
    loose = {i: [(m.start(), m.end(), "owned", m[0]) for m in re.finditer(secrets.LOOSE_KIND[1], t or "")
                 if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
                 and not any(b[0] < m.end() and m.start() < b[1] for b in base[i])] for i, t in enumerate(texts)}
    values = {i: {x[3] for x in base[i] + loose[i]} for i in base}
    order = ["assign", "access", "hex", "owned"]
    for i, text in enumerate(texts):
        own = [x for x in loose[i] if len(set(x[3])) >= 10 and not any(x[3] in values[j] for j in values if j != i)]
        want = sorted(base[i] + own, key=lambda x: (x[0], order.index(x[2])))
        assert found[i] == ",".join(f"{k}:{s}:{e}" for s, e, k, _ in want)
        assert clean[i] == (None if text is None else masked(text, [x[:2] for x in want]))


def test_overlaps(spark):
    """A loose token stays only if no base span reaches it, whatever the lengths."""
    span = lambda k, s, e: (s, k, "x", e, "v")
    base = [span(0, 0, 50), span(2, 10, 12), span(1, 60, 70), span(0, 100, 101)]
    loose = [span(3, s, e) for s, e in [(20, 30), (50, 60), (49, 52), (58, 61), (70, 100), (70, 101), (101, 105)]]
    kind = "array<struct<start:bigint,number:int,kind:string,end:bigint,value:string>>"
    frame = spark.createDataFrame([(base, loose), ([], loose), (base, [])], f"b {kind}, l {kind}")
    found = [[(s.start, s.end) for s in r[0]] for r in frame.select(secrets._apart(F.col("b"), F.col("l"))).collect()]
    assert found == [[(50, 60), (70, 100), (101, 105)], [(s[0], s[3]) for s in loose], []]


def test_many_matches_in_one_text(spark):
    """100,000 key lines: work grows a little faster than their number, not with its square."""
    text = "\n".join(f"api_key = 'k{i:012d}' tok{i:020d}z" for i in range(100_000))
    frame = spark.createDataFrame([(1, text, "s", "en")], SCHEMA)
    begin = time.perf_counter()
    (row,) = secrets.scan_secrets(frame).collect()
    (clean,) = secrets.redact_secrets(frame).collect()
    seconds = time.perf_counter() - begin
    assert row.n_assign == 100_000 and row.spans.count("owned") == 100_000 - sum(len(set(f"tok{i:020d}z")) < 10 for i in range(100_000))
    assert clean.text.count("[SECRET]") == row.spans.count(":") // 2
    print(f"{seconds:.1f} s")
