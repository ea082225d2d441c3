"""The word lattice of op6 against the rule stated place by place, and what its plan moves."""

import os
import random

import pytest

from depotflow import session
from depotflow.llm import lattice


def best_ids(word, table, unknown, byte_zero):
    """The best way to each end; of equal sums the longer last piece."""
    longest, best, ids = max(map(len, table)), [0.0], [[]]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            if piece in table:
                ways.append((best[start] + table[piece][1], -start, ids[start] + [table[piece][0]]))
            elif end - start == 1:
                raw = piece.encode()
                ways.append((best[start] + unknown * len(raw), -start, ids[start] + [byte_zero + b for b in raw]))
        top = max(ways, key=lambda way: way[:2])
        best.append(top[0])
        ids.append(top[2])
    return ids[-1]


@pytest.fixture
def pieces(spark):
    rng = random.Random(5)
    made = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"▁", "▁a", "▁▁", "日b", "😀"}
    # few different scores, so that many ways have equal sums; 300 and on are ids of bytes
    rows = [(p, i, -float(rng.randint(1, 6))) for i, p in enumerate(sorted(made))]
    return spark.createDataFrame(rows, "piece string, piece_id int, score double")


@pytest.mark.parametrize("longest, chars", [(512, 1 << 17), (512, 50), (0, 1 << 17), (0, 50), (7, 50)])
def test_words_by_the_rule(pieces, monkeypatch, longest, chars):
    monkeypatch.setattr(lattice, "LONGEST", longest)
    monkeypatch.setattr(lattice, "SLICE_CHARS", chars)
    table = {r.piece: (r.piece_id, r.score) for r in pieces.collect()}
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé▁日😀\x00z") for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["abc" * 40]
    unknown = min(score for _, score in table.values()) - 10
    trie = lattice.piece_trie(pieces)
    assert lattice.word_ids(words, trie, 300).to_pylist() == [best_ids(w, table, unknown, 300) for w in words]
    assert lattice.word_ids([], trie, 300).to_pylist() == []
    assert lattice.word_ids(["", "a"], trie, 300).to_pylist() == [[], best_ids("a", table, unknown, 300)]


def test_documents_move_and_write_nothing(spark, monkeypatch):
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the thing", "", None, "é日\n\n\tthe  thing ", "the thing", "x" * 600 + " y"]
    docs = spark.createDataFrame([(k // 2 if k < 16 else None, texts[k % 6]) for k in range(18)], "doc_id long, text string")
    folder = session.shared_dir(spark)
    before = set(os.listdir(folder))
    whole = lattice.encode_documents(docs, model)
    found = sorted(map(repr, whole.collect()))
    assert set(os.listdir(folder)) == before
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert len(found) == 18
    monkeypatch.setattr(lattice, "BLOCK_CHARS", 1)
    assert sorted(map(repr, lattice.encode_documents(docs, model).collect())) == found
    empty = lattice.encode_documents(docs.where("coalesce(text, '') = ''"), model).collect()
    assert len(empty) == 6 and all(r.ids == [] for r in empty)
