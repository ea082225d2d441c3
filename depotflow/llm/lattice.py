"""SentencePiece encoding and decoding as a lattice of pieces over words."""

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"
UNIT = re.compile(SPACE + r"+[^" + SPACE + r"\n\t]*|[^" + SPACE + r"\n\t]+|[\n\t]")
# Words of more characters are folded edge by edge: taken together, words need a step for each place of the longest.
LONGEST = 512
BLOCK_CHARS = 4 << 20
SLICE_CHARS = 1 << 17
CHAR_BITS = 21


def piece_table(spark, model_file):
    """`piece`, `piece_id`, `score` of the model's ordinary pieces, and the id of byte 0. As many rows as the model has pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    rows = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    crossing = [p for p, _, _ in rows if len(p) > 1 and (re.search("[\n\t]", p) or SPACE in p.lstrip(SPACE))]
    if crossing:
        raise ValueError(f"pieces cross a word's edge: {crossing[:3]}")
    return spark.createDataFrame(rows, "piece string, piece_id int, score double"), model.piece_to_id("<0x00>")


def units(text):
    """Words of a text: blanks become the model's space mark, one is put in front; cut at newlines and tabs.

    No piece crosses these edges.
    """
    return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def piece_trie(pieces):
    """The pieces' prefixes as arrays `keys`, `ids`, `scores`, and the score of a byte of a character without a piece.

    Prefixes are numbered from 1 by length, then in order; that of number i has at i - 1 its key, the number of the
    prefix without its last character and that character, and the id of the piece that it is, else -1. Keys ascend;
    a last one is met by no text.
    """
    table = {r["piece"]: (r["piece_id"], r["score"]) for r in pieces.collect()}
    prefixes = sorted({p[:k] for p in table for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
    number = {p: i for i, p in enumerate(["", *prefixes])}
    keys = [number[p[:-1]] << CHAR_BITS | ord(p[-1]) for p in prefixes] + [1 << 62]
    found = [table.get(p, (-1, 0.0)) for p in prefixes] + [(-1, 0.0)]
    least = min((score for _, score in table.values() if score > -1e8), default=0.0)
    return (np.array(keys, np.int64), np.array([i for i, _ in found], np.int64),
            np.array([score for _, score in found]), least - 10)


def _octets(chars):
    return 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)


def _edges(start, chars, ends, trie):
    """Pieces met from places `start` of words laid end to end: first and last place, id and score, by size, then place.

    The places go down the trie together. `ends` holds for each place that behind its word. A
    character without a piece costs its bytes; its id is -1 less the character.
    """
    keys, ids, scores, unknown = trie
    found, node, size = [], np.zeros(len(start), np.int64), 0
    while len(start):
        last = start + size
        key = node << CHAR_BITS | chars[last]
        edge = np.searchsorted(keys, key)
        met, piece = keys[edge] == key, ids[edge]
        known = met & (piece >= 0)
        if size:
            found.append((start[known], last[known], piece[known], scores[edge[known]]))
        else:
            char = chars[start]
            found.append((start, last, np.where(known, piece, -1 - char), np.where(known, scores[edge], unknown * _octets(char))))
        alive = met & (last + 1 < ends[start])
        start, node, size = start[alive], edge[alive] + 1, size + 1
    return [np.concatenate(x) for x in zip(*found)]


def _fold_together(place, edges, best, back, piece):
    """Folds edges of many words, one step for each place and size; `place` is an edge's first place within its word."""
    order = np.argsort(place.astype(np.int16), kind="stable")
    place = place[order]
    start, last, ids, scores = (x[order] for x in edges)
    size = last - start
    cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(size) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
        to = last[a:b]
        before = start[a:b] - 1 if place[a] else np.full(b - a, -1)
        total = scores[a:b] + (best[before] if place[a] else 0.0)
        better = total > best[to]
        to = to[better]
        best[to], back[to], piece[to] = total[better], before[better], ids[a:b][better]


def _fold_singly(place, edges, best, back, piece):
    """The same fold, edge by edge."""
    order = np.lexsort((edges[1], edges[0]))
    low, high = max(0, edges[0].min() - 1), edges[1].max() + 1
    sums, taken = best[low:high].tolist(), {}
    for k in range(0, len(order), 1 << 16):
        part = order[k:k + (1 << 16)]
        for first, start, last, id_, score in zip(*(x[part].tolist() for x in (place, edges[0] - low, edges[1] - low, *edges[2:]))):
            total = score + (sums[start - 1] if first else 0.0)
            if total > sums[last]:
                sums[last], taken[last] = total, (low + start - 1 if first else -1, id_)
    to = low + np.fromiter(taken, np.int64, len(taken))
    best[low:high] = sums
    back[to], piece[to] = np.array(list(taken.values()), np.int64).T


def _slice_ids(words, trie, byte_zero):
    size = np.fromiter(map(len, words), np.int64, len(words))
    bounds = np.concatenate([[0], np.cumsum(size)])
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    firsts, sizes = np.repeat(bounds[:-1], size), np.repeat(size, size)
    ends = firsts + sizes
    best, back, piece = np.full(len(chars), -np.inf), np.empty(len(chars), np.int64), np.empty(len(chars), np.int64)
    for low in range(0, len(chars), SLICE_CHARS):
        edges = _edges(np.arange(low, min(low + SLICE_CHARS, len(chars))), chars, ends, trie)
        place, short = edges[0] - firsts[edges[0]], sizes[edges[0]] <= LONGEST
        for fold, own in ((_fold_together, short), (_fold_singly, ~short)):
            if own.any():
                fold(place[own], [x[own] for x in edges], best, back, piece)
    chosen, at = np.zeros(len(chars), bool), (bounds[1:] - 1)[size > 0]
    while len(at):
        chosen[at] = True
        at = back[at]
        at = at[at >= 0]
    ids = piece[chosen]
    lost = ids < 0
    octets = np.where(lost, _octets(-1 - ids), 1)
    values = np.repeat(ids, octets)
    values[np.repeat(lost, octets)] = byte_zero + np.frombuffer(
        "".join(map(chr, (-1 - ids[lost]).tolist())).encode(), np.uint8).astype(np.int64)
    behind = np.concatenate([[0], np.cumsum(octets)])[np.concatenate([[0], np.cumsum(chosen)])[bounds]]
    return pa.ListArray.from_arrays(pa.array(behind, pa.int32()), pa.array(values, pa.int32()))


def word_ids(words, trie, byte_zero):
    """Ids of each word of a list by the rule of `encode_words`, in time in proportion to their characters."""
    parts, at, chars = [pa.array([], pa.list_(pa.int32()))], 0, 0
    for i, word in enumerate(words):
        if chars and chars + len(word) > SLICE_CHARS:
            parts.append(_slice_ids(words[at:i], trie, byte_zero))
            at, chars = i, 0
        chars += len(word)
    if at < len(words):
        parts.append(_slice_ids(words[at:], trie, byte_zero))
    return pa.concat_arrays(parts)


def encode_words(words, pieces, byte_zero):
    """`word`, `ids`: the segmentation of each distinct word with the largest sum of scores.

    Every substring that is a piece is an edge; a character without a piece costs its bytes. Edges are folded in order
    of their starts: the best way to each end keeps its last edge, of equal sums the longer last
    piece. Ids are read back from the end. No word is cut.
    """
    shared = words.sparkSession.sparkContext.broadcast(piece_trie(pieces))

    def encode(batches):
        for batch in batches:
            yield pa.record_batch([batch["word"], word_ids(batch["word"].to_pylist(), shared.value, byte_zero)], ["word", "ids"])

    return words.select("word").where("word is not null").distinct().mapInArrow(encode, "word string, ids array<int>")


def encode_documents(docs, model_file, id="doc_id", text="text"):
    """`id`, `ids` (array of piece ids) of every row.

    The lattice is built once for each distinct word of a block of about 4 MB of texts, in the task that
    reads them, so nothing is shuffled or written. Null and empty texts have no ids; null ids and repeated rows each
    get a row; an empty table gives no rows; other columns are ignored. The piece table is broadcast: its size is the
    model's. A block's words and ids are held together; a block has at least one whole text.

    Segments have the largest sum of piece scores. A model whose scores are merge
    ranks is read in the same way, which need not be its own merge order.
    """
    pieces, byte_zero = piece_table(docs.sparkSession, model_file)
    shared = docs.sparkSession.sparkContext.broadcast(piece_trie(pieces))

    def emit(ids, arrays, numbers):
        bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
        coded = word_ids(list(numbers), shared.value, byte_zero).take(pa.array(np.concatenate(arrays)))
        ends = coded.offsets.to_numpy()[bounds]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), coded.values)], ["id", "ids"])

    def encode(batches):
        ids, arrays, size, numbers = [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            for id_, value in zip(batch["id"].to_pylist(), batch["text"]):
                found = units(value.as_py())
                ids.append(id_)
                arrays.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(value.as_py())
                if size >= BLOCK_CHARS:
                    yield emit(ids, arrays, numbers)
                    ids, arrays, size, numbers = [], [], 0, defaultdict(count().__next__)
        if ids:
            yield emit(ids, arrays, numbers)

    done = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text")).mapInArrow(
        encode, "id long, ids array<int>")
    return done.withColumnRenamed("id", id)


def decode_documents(coded, model_file, ids="ids", out="text"):
    """Adds the text `out` of an array of piece ids: pieces and bytes joined, space marks to blanks, the first dropped.

    Null stays null; ids that the model lacks raise an error; bytes that are not UTF-8 become U+FFFD.
    """
    pieces, byte_zero = piece_table(coded.sparkSession, model_file)
    table = {r["piece_id"]: r["piece"].encode() for r in pieces.collect()}
    table |= {byte_zero + b: bytes([b]) for b in range(256)}
    shared = coded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def decode(column):
        known = shared.value
        texts = column.map(lambda x: None if x is None else b"".join(
            [known[i] for i in x.tolist()]).decode("utf-8", "replace").replace(SPACE, " "))
        return texts.map(lambda t: t[1:] if t and t[0] == " " else t)

    return coded.withColumn(out, decode(ids))
