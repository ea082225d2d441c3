"""Scores of texts by a byte model (prediction by partial matching over a trie of contexts) and by token counts."""

from collections import defaultdict
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import id_remainder, text_of, write_shared

#: Edge of a text, on both sides. UTF-8 has no such byte.
EDGE = 0xFF
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Bytes of the longest context. Contexts of up to two bytes are counted in one bounded table, longer ones in the trie.
DEPTH = 5
#: Text bytes for each part of the trie.
PART_BYTES = 8 << 20


def _edged(texts):
    """Bytes of texts with edges: two before each, one after it that serves the next; and their lengths."""
    raw = b"\xff\xff" + b"".join(t + b"\xff\xff" for t in texts)
    return np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts], np.int64)


def _predicted(symbols, lengths):
    """Positions of the bytes to predict: those of the texts and one closing edge each."""
    keep = np.ones(len(symbols) - 2, bool)
    keep[np.cumsum(lengths + 2) - 1] = False
    return np.flatnonzero(keep) + 2


def gram_counts(texts):
    """Distinct three-byte grams (context of two, next byte) and their counts."""
    symbols, lengths = _edged(texts)
    at = _predicted(symbols, lengths)
    used = np.flatnonzero(np.bincount(symbols, minlength=256))
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))
    dense, size = place[symbols], len(used)
    counts = np.bincount((dense[at - 2] * size + dense[at - 1]) * size + dense[at], minlength=size ** 3)
    found = np.flatnonzero(counts)
    first, second, third = found // size ** 2, found // size % size, found % size
    return used[first] << 16 | used[second] << 8 | used[third], counts[found]


def _share(counts, left):
    """Probabilities of one order and of escape, by method C; `left` marks symbols not yet excluded."""
    counts = np.where(left, counts, 0)
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    full = kinds == left.sum(-1, keepdims=True)
    whole = np.maximum(total + np.where(full, 0, kinds), 1)
    escape = np.where(total == 0, 1.0, np.where(full, 0.0, kinds / whole))
    return counts / whole, escape, left & (counts == 0)


def ppm_table(grams, counts):
    """Rows of log10 probabilities for each context seen, and the row of every context.

    A symbol takes its share in the longest context that has seen it; each
    escape passes on what is left, among symbols that longer contexts have not
    seen (symbol exclusion), down to equal shares. A row sums to one. At most
    65,536 + 256 rows of 256 numbers, however large the corpus.
    """
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, (grams >> 8 & 255, grams & 255), counts)
    single = pairs.sum(0)
    row_of = np.empty(65536, np.int32)
    contexts = np.unique(grams >> 8)
    rows = []
    size = 0
    by_context = {int(c): slice(a, b) for c, a, b in zip(
        contexts, np.searchsorted(grams >> 8, contexts), np.searchsorted(grams >> 8, contexts, "right"))}
    for last in range(256):
        own = [c for c in range(last, 65536, 256) if c in by_context]
        level = np.zeros((len(own) + 1, 256), np.int64)     # the extra row: contexts never seen
        for i, c in enumerate(own):
            part = by_context[c]
            level[i, grams[part] & 255] = counts[part]
        left = np.ones(level.shape, bool)
        weight, total = np.ones((len(level), 1)), np.zeros(level.shape)
        for table in (level, pairs[last][None, :], single[None, :], np.ones((1, 256), np.int64)):
            share, escape, left = _share(np.broadcast_to(table, level.shape), left)
            total += weight * share
            weight = weight * escape
        row_of[last::256] = size + len(own)
        row_of[own] = size + np.arange(len(own))
        size += len(level)
        rows.append(total)
    with np.errstate(divide="ignore"):
        return np.log10(np.concatenate(rows)).astype(np.float32), row_of


def ppm_scores(texts, table, row_of):
    """log10 probability of each text, its end included."""
    symbols, lengths = _edged(texts)
    at = _predicted(symbols, lengths)
    context = symbols[at - 2].astype(np.int32) << 8 | symbols[at - 1]
    gained = table[row_of[context], symbols[at]]
    return np.add.reduceat(gained, np.cumsum(lengths + 1) - lengths - 1, dtype=np.float64)


def _chunks(batches, limit):
    """Lists of (id, held out, text bytes) of about `limit` bytes."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((row[0], row[1], row[2].encode()))
            size += len(rows[-1][2])
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def train_ppm(docs):
    """`gram`, `n` over the texts that are not held out. `docs`: id, held, text."""
    def tally(batches):
        found, total = [], []
        for rows in _chunks(batches, CHUNK_BYTES):
            texts = [t for _, held, t in rows if not held]
            if texts:
                grams, counts = gram_counts(texts)
                found.append(grams)
                total.append(counts)
        if found:
            grams, at = np.unique(np.concatenate(found), return_inverse=True)
            sums = np.bincount(at, np.concatenate(total)).astype(np.int64)
            yield pa.record_batch([pa.array(grams), pa.array(sums)], ["gram", "n"])

    return docs.mapInArrow(tally, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def trie_paths(texts):
    """Path of each byte to predict: the five bytes in front of it, nearest first, then the byte, as one number.

    In the order of these numbers a context of any length is one run. A text has a path for each byte and one for its end.
    """
    edge = bytes([EDGE]) * DEPTH
    symbols = np.frombuffer(edge + b"".join(t + edge for t in texts), np.uint8).astype(np.int64)
    behind = np.cumsum(np.array([len(t) for t in texts], np.int64) + DEPTH)
    keep = np.ones(len(symbols) - DEPTH, bool)
    for j in range(1, DEPTH):
        keep[behind - j] = False
    path = symbols[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        path |= symbols[DEPTH - j:len(symbols) - j] << 8 * (DEPTH + 1 - j)
    return path[keep]


def _firsts(ordered):
    """Places where a new number begins."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def distinct_paths(texts):
    """Distinct paths of texts, in order, and how often each occurs."""
    paths = np.concatenate([np.zeros(0, np.int64), *(trie_paths(texts[at:at + 256]) for at in range(0, len(texts), 256))])
    paths.sort()
    first = _firsts(paths)
    return paths[first], np.diff(np.r_[first, len(paths)])


def _parts(paths, parts):
    """Part of the trie that holds a path, by its three nearest bytes: a context of three bytes or more lies whole in one part."""
    near = (paths >> 8 * (DEPTH - 2)).astype(np.uint64)
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) % parts


def short_model(grams, counts):
    """Three-byte grams in order, their counts, sum and number of symbols of each context of two bytes, and `ppm_table`."""
    context = grams >> 8
    return (grams, counts, np.bincount(context, counts, 65536).astype(np.int64),
            np.bincount(context, minlength=65536), *ppm_table(grams, counts))


def trie_logs(paths, counts, short):
    """log10 probability of each path by method C with symbol exclusion, contexts from five bytes down.

    `paths` are distinct, in order, and hold every path of their contexts of three bytes or more; a count of 0 marks a
    path that is only scored. What a context has seen, shorter ones have seen as well. So the symbols excluded
    one byte shorter are this context's own: their number, and the sum of their counts there, are all that is needed.
    No context has seen all 256 symbols, since UTF-8 never uses some, so there is always an escape.
    """
    grams, gram_counts, short_total, short_kinds, table, row_of = short
    logs, unseen = np.zeros(len(paths)), np.ones(len(paths), bool)
    kinds_out = sum_out = np.zeros(len(paths), np.int64)

    def settle(c, total, kinds):
        kinds = kinds - kinds_out
        whole = np.maximum(total - sum_out + kinds, 1)
        hit, missed = unseen & (c > 0), unseen & (c == 0) & (kinds > 0)
        logs[hit] += np.log10(c[hit] / whole[hit])
        logs[missed] += np.log10(kinds[missed] / whole[missed])
        unseen[hit] = False

    def short_counts(gram):
        if not len(grams):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        return np.where(grams[at] == gram, gram_counts[at], 0)

    def as_gram(code):
        return (code >> 8 & 255) << 16 | (code >> 16 & 255) << 8 | code & 255

    code, c, place = paths, counts, np.arange(len(paths))
    for size in range(DEPTH, 2, -1):
        first = _firsts(code >> 8)
        context = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
        total = np.bincount(context, c, len(first)).astype(np.int64)
        kinds = np.bincount(context, c > 0, len(first)).astype(np.int64)
        settle(c[place], total[context][place], kinds[context][place])
        shorter = (code >> 16) << 8 | code & 255
        if size > 3:
            shorter, up = np.unique(shorter, return_inverse=True)
            sums = np.bincount(up, c, len(shorter)).astype(np.int64)
            down = sums[up]
        else:
            down = short_counts(as_gram(shorter))
        kinds_out = kinds[context][place]
        sum_out = np.bincount(context, np.where(c > 0, down, 0), len(first)).astype(np.int64)[context][place]
        if size > 3:
            code, c, place = shorter, sums, up[place]
    gram = as_gram((paths >> 8 * (DEPTH - 1)) << 8 | paths & 255)
    total, kinds = short_total[gram >> 8], short_kinds[gram >> 8]
    settle(short_counts(gram), total, kinds)
    # the table's row less its own escape is what shorter contexts give
    escape = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    rest = table[row_of[gram >> 8], gram & 255].astype(np.float64) - np.log10(escape)
    return np.where(unseen, logs + rest, logs)


BLOCKS = ("block long, id long, held boolean, text binary, "
          "part long, vocabulary binary, seen binary, paths binary, counts binary")
_BLOCK = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                    for n, t in (c.split() for c in BLOCKS.split(", "))])


def _rows(size, **columns):
    """Record batch of the table of blocks; columns that are not given are null."""
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                            for f in _BLOCK], schema=_BLOCK)


def _numbered(texts, parts):
    """Word numbers of each text, the distinct words by number, and their parts: numbers go by part, then by word."""
    numbers, arrays = defaultdict(count().__next__), []
    for text in texts:
        words = text.lower().split()
        arrays.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    words = sorted(numbers)
    part = np.fromiter(map(crc32, words), np.int64, len(words)) % parts
    order = np.argsort(part, kind="stable")
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))[order]] = np.arange(len(words), dtype=np.int32)
    return [place[a] for a in arrays], [words[i] for i in order], part[order]


def write_blocks(docs, parts):
    """Texts, and the words and paths of each block of about 8 MB, in one written table.

    A word or path that a block holds often is there once, whatever its frequency, so what is shuffled later are
    the distinct words and paths of blocks. They lie in one row for each part: words by their
    checksum, paths as differences.
    """
    def split(batches):
        task = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(_chunks(batches, BLOCK_BYTES)):
            block = task + number
            arrays, words, of_word = _numbered([t for _, _, t in rows], parts)
            learned = [a for a, (_, held, _) in zip(arrays, rows) if not held]
            seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *learned]), minlength=len(words)).astype(np.int32)
            yield _rows(len(rows), block=[block] * len(rows), id=[r[0] for r in rows], held=[r[1] for r in rows],
                        text=[r[2] for r in rows])
            trained, times = distinct_paths([t for _, held, t in rows if not held])
            paths = np.union1d(trained, distinct_paths([t for _, held, t in rows if held])[0])
            counts = np.zeros(len(paths), np.int32)
            counts[np.searchsorted(paths, trained)] = times
            of_path = _parts(paths, parts)
            by_part = np.argsort(of_path, kind="stable")
            paths, counts = paths[by_part], counts[by_part]
            held = np.union1d(of_word, of_path)
            cuts = list(zip(held.tolist(), *(np.searchsorted(x, held, side) for x in (of_word, of_path[by_part])
                                             for side in ("left", "right"))))
            for at in range(0, len(cuts), 1000):
                some = cuts[at:at + 1000]
                yield _rows(len(some), block=[block] * len(some), part=[c[0] for c in some],
                            vocabulary=[b" ".join(words[w:x]) for _, w, x, _, _ in some],
                            seen=[seen[w:x].tobytes() for _, w, x, _, _ in some],
                            paths=[np.diff(paths[y:z], prepend=0).tobytes() for *_, y, z in some],
                            counts=[counts[y:z].tobytes() for *_, y, z in some])

    return write_shared(docs.mapInArrow(split, BLOCKS), "lm-blocks")


def count_parts(blocks, short):
    """`block`, `part`, `known`, `logs`, `tokens`, `kinds`, written: what a block gets back for each part it sent.

    `known` has the training count of each word, `logs` the log10 probability of each path (four bytes each), in
    the order sent; `tokens` and `kinds`, once for each part, sum and number of the words seen in training. The
    parts of all blocks meet and are added up. A part has as many words and paths as a block on average; what a busy
    word or context adds to one part are a block's distinct entries of it, never its occurrences.
    """
    model = blocks.sparkSession.sparkContext.broadcast(short)

    def sums(keys, times):
        keys, back = keys
        return keys, back, np.bincount(back, times, len(keys)).astype(np.int64)

    def merge(table: pa.Table) -> pa.Table:
        lists = [v.split() for v in table["vocabulary"].to_pylist()]
        coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
        _, back, total = sums((coded.dictionary, coded.indices.to_numpy()), np.frombuffer(
            b"".join(table["seen"].to_pylist()), np.int32))
        known = np.split(total[back], np.cumsum([len(words) for words in lists])[:-1])
        paths = [np.cumsum(np.frombuffer(p, np.int64)) for p in table["paths"].to_pylist()]
        keys, back, times = sums(np.unique(np.concatenate(paths), return_inverse=True), np.frombuffer(
            b"".join(table["counts"].to_pylist()), np.int32))
        logs = np.split(trie_logs(keys, times, model.value).astype(np.float32)[back], np.cumsum([len(p) for p in paths])[:-1])
        rest = [0] * (table.num_rows - 1)
        return pa.table({
            "block": table["block"], "part": table["part"], "known": pa.array([x.tobytes() for x in known], pa.binary()),
            "logs": pa.array([x.tobytes() for x in logs], pa.binary()), "tokens": pa.array([int(total.sum()), *rest], pa.int64()),
            "kinds": pa.array([int((total > 0).sum()), *rest], pa.int64())})

    sent = blocks.where("part is not null").select("block", "part", "vocabulary", "seen", "paths", "counts")
    return write_shared(sent.groupBy("part").applyInArrow(
        merge, "block long, part long, known binary, logs binary, tokens long, kinds long"), "lm-counts")


def trie_scores(texts, parts, logs):
    """log10 probability of each text of a block, its end included; `logs` are those of the block's paths by part and in order."""
    paths, _ = distinct_paths(texts)
    gained = np.empty(len(paths))
    gained[np.argsort(_parts(paths, parts), kind="stable")] = logs
    index, scores = pd.Index(paths), [np.zeros(0)]
    for at in range(0, len(texts), 256):
        some = texts[at:at + 256]
        lengths = np.array([len(t) + 1 for t in some], np.int64)
        scores.append(np.add.reduceat(gained[index.get_indexer(trie_paths(some))], np.cumsum(lengths) - lengths))
    return np.concatenate(scores)


def score_documents(docs, id="doc_id", text="text", modulus=10):
    """Token and byte model scores of every row; learns from rows whose crc32(id) mod `modulus` is not 0.

    Returns `id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`,
    `base_score` (unigram, log10, 0.1 added to each count) and `score`, the
    log10 probability of the text's bytes and its end under the byte model:
    contexts of five bytes down to none, trained on all learning texts.

    Null text is empty (one token, the end); a null id counts as the empty text
    for the fold; repeated rows are learned from as often as they occur and each
    gets a row; an empty table gives no rows. Other columns are ignored.

    Contexts of up to two bytes have at most 256^3 counts and travel as a broadcast of at most
    340 MB; longer contexts and token counts stay distributed and grow with the input. Texts are
    read three times and shuffled once, to their block's counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), (id_remainder(id, modulus) == 0).alias("held"),
                       text_of(text).alias("text"))
    trained = train_ppm(rows).toPandas().sort_values("gram")
    parts = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    blocks = write_blocks(rows, parts)
    counted = count_parts(blocks, short_model(trained["gram"].to_numpy(np.int64), trained["n"].to_numpy(np.int64)))
    texts = blocks.where("text is not null").select("block", "id", "held", "text")
    sums = counted.agg(F.sum("tokens"), F.sum("kinds")).first()
    ends = texts.where("not held").count()
    tokens, kinds = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    whole = tokens + 0.1 * (kinds + 1)
    end_score = float(np.log10((ends + 0.1) / whole))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        raw = left["text"].to_pylist()
        found = trie_scores(raw, parts, np.frombuffer(b"".join(right["logs"].to_pylist()), np.float32))
        counts = np.frombuffer(b"".join(right["known"].to_pylist()), np.int64)
        gain, known = np.log10((counts + 0.1) / whole), counts > 0
        out = []
        for local in _numbered(raw, parts)[0]:
            out.append((len(local) + 1, int(known[local].sum()) + (ends > 0), float(gain[local].sum()) + end_score))
        lengths, knowns, scores = zip(*out) if out else ((), (), ())
        return pa.table({
            "id": left["id"], "held_out": left["held"], "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(knowns, pa.int64()), "train_tokens": pa.array([tokens] * len(out), pa.int64()),
            "base_score": pa.array(scores, pa.float64()), "score": pa.array(found, pa.float64())})

    schema = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")
    done = texts.groupBy("block").cogroup(counted.select("block", "part", "known", "logs").groupBy("block")) \
        .applyInArrow(score, schema)
    return done.withColumnRenamed("id", id)
