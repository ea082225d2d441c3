"""The byte model of op2 keeps contexts of up to five bytes."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from depotflow.llm import lm

TEXTS = ["abracadabra abracadabra", "", "çafé bra", "aaaa", None, "the thing that they thought", "they thought the thing",
         "zebra", "é", "abracadabra abracadabra", "thing thong thing", "a", "日本 abracadabra"]


def brute(trained, text, depth=5):
    """Escapes followed one by one from the longest context, seen symbols excluded."""
    seen = {}
    for t in trained:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                seen.setdefault(s[i - k:i], Counter())[s[i]] += 1
    total, s = 0.0, b"\xff" * depth + text + b"\xff"
    for i in range(depth, len(s)):
        p, out = 1.0, set()
        for k in range(depth, -2, -1):
            counts = seen.get(s[i - k:i], {}) if k >= 0 else dict.fromkeys(range(256), 1)
            counts = {b: c for b, c in counts.items() if b not in out}
            if not counts:
                continue
            whole = sum(counts.values()) + (len(counts) if k >= 0 else 0)
            if s[i] in counts:
                p *= counts[s[i]] / whole
                break
            p *= len(counts) / whole
            out |= set(counts)
        total += np.log10(p)
    return total


@pytest.mark.parametrize("part_bytes", [1 << 20, 20])
def test_score_equals_brute_force_of_five_bytes(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(lm, "PART_BYTES", part_bytes)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    raw = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    trained = [t for i, t in raw.items() if crc32(str(i).encode()) % 3]
    found = {r.doc_id: r.score for r in lm.score_documents(docs, modulus=3).collect()}
    assert found == pytest.approx({i: brute(trained, t) for i, t in raw.items()}, rel=1e-5)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "abc"), (1, None)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score_documents(docs, modulus=1).collect()}
    assert found == pytest.approx({0: 4 * np.log10(1 / 256), 1: np.log10(1 / 256)}, rel=1e-5)
