"""Quality scores from random-indexing word vectors and a small network."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .common import id_remainder, smallest_hashes, text_of, write_shared

BUCKETS = 1 << 15
DIMS = 32
NONZERO = 4
WIDTH = 3 * DIMS + 2
REACH = 2
CHUNK = 1_000_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Places(dict):
    """Bucket of each token; digits count as one token."""

    def __missing__(self, token):
        if len(self) > 500_000:
            self.clear()
        word = "0" if token.isdigit() else token
        self[token] = place = zlib.crc32(word.encode()) % BUCKETS
        return place


def index_vectors():
    """Sparse random vectors of the buckets, and a zero row for places between texts."""
    rng = np.random.default_rng(7)
    table = np.zeros((BUCKETS + 1, DIMS), np.int8)
    for row in range(BUCKETS):
        at = rng.choice(DIMS, NONZERO, replace=False)
        table[row, at] = rng.choice((-1, 1), NONZERO)
    return table


def context_sums(places, index):
    """Buckets seen, how often, and the sums of the index vectors up to two tokens around them."""
    last = len(places) - REACH
    total = np.zeros((last - REACH, DIMS), np.int8)
    for step in range(2 * REACH + 1):
        if step != REACH:
            total += index[places[step:last - REACH + step]]
    centre = places[REACH:last]
    order = np.argsort(centre, kind="stable")
    seen, first, counts = np.unique(centre[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(total[order], first, axis=0, dtype=np.int64) if len(seen) else np.zeros((0, DIMS), np.int64)
    real = seen < BUCKETS
    return seen[real], counts[real], sums[real]


def word_vectors(docs, index):
    """Vector and weight of every bucket from all texts; 32,768 rows whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [f"x{i}" for i in range(DIMS)]

    def gather(batches):
        places, table = Places(), shared.value
        counts, sums = np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, DIMS), np.int64)
        edge, held, size = np.full(REACH, BUCKETS, np.int32), [], 0

        def flush():
            seen, n, total = context_sums(np.concatenate([edge, *held]), table)
            counts[seen] += n
            sums[seen] += total

        for batch in batches:
            for text in batch["text"].to_pylist():
                tokens = TOKEN.findall(text)
                held += [np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens)), edge]
                size += len(tokens)
                if size >= CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen]), *[pa.array(c) for c in sums[seen].T]],
                              ["bucket", "n", *names])

    schema = "bucket long, n long, " + ", ".join(f"{x} long" for x in names)
    found = docs.select("text").mapInArrow(gather, schema).groupBy("bucket").agg(
        F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toPandas()
    vectors, weights = np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS, np.float32)
    if len(found):
        at, n = found["bucket"].to_numpy(), found["n"].to_numpy(np.float64)
        sums = found[names].to_numpy(np.float64)
        sums = sums / n[:, None] - sums.sum(0) / n.sum()
        vectors[at] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        weights[at] = 1e-3 / (1e-3 + n / n.sum())
    return vectors, weights


def pooled(places, vectors, weights):
    """Weighted mean and deviation of the word vectors, plain mean, length and share of distinct tokens."""
    if not len(places):
        return np.zeros(WIDTH, np.float32)
    rows, w = vectors[places], weights[places][:, None] + 1e-6
    mean = (rows * w).sum(0) / w.sum()
    spread = np.sqrt(np.maximum((rows * rows * w).sum(0) / w.sum() - mean * mean, 0))
    return np.concatenate([mean, spread, rows.mean(0), [
        np.log1p(len(places)), len(np.unique(places)) / len(places)]]).astype(np.float32)


class Network:
    """Two layers (tanh, logistic) trained by Adam on all rows; temperature set on rows left out."""

    def __init__(self, hidden=24, rounds=400, rate=0.02, decay=1e-3, seed=3):
        self.hidden, self.rounds, self.rate, self.decay, self.seed = hidden, rounds, rate, decay, seed
        self.temperature, self.constant = 1.0, None

    def fit(self, x, y):
        """Every fifth row sets the temperature. One class only, or few rows: a constant."""
        if len(y) < 20 or len(set(y)) < 2:
            self.constant = (float(np.sum(y)) + 1) / (len(y) + 2)
            return self
        left_out = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, t = (x[~left_out] - self.mean) / self.scale, y[~left_out].astype(np.float64)
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], self.hidden)), np.zeros(self.hidden),
             rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, self.rounds + 1):
            inner = np.tanh(z @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(inner @ w[2] + w[3]))) - t) / len(t)
            back = np.outer(error, w[2]) * (1 - inner * inner)
            slopes = [z.T @ back + self.decay * w[0], back.sum(0), inner.T @ error + self.decay * w[2],
                      np.array([error.sum()])]
            for p, g, m, v in zip(w, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= self.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights = w
        logits, truth = self.logits(x[left_out]), y[left_out]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, logits / g) - truth * logits / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logits(self, x):
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def predict(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def score_quality(docs, labels, id="doc_id", text="text", target="quality", modulus=5, most_rows=20_000, cut=0.3):
    """`id`, `held_out`, `score`, `predicted` for every row.

    Word vectors come from all texts: each token's bucket (32,768, by hash)
    sums the fixed random vectors of the tokens up to two places away. A document is the pooled
    vectors of its tokens; labels, languages, sources and ids are not used. The network
    learns from at most `most_rows` labelled rows (those with the
    smallest hash of the id) whose crc32(id) mod `modulus` is not 0.

    Null text is empty and gets the score of a text without tokens; a null id has
    no label; labels other than 0 and 1 are ignored; of several labels of an id the lowest counts; repeated rows
    each get a row; an empty table gives no rows; without labels every score is 0.5.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), (id_remainder(id, modulus) == 0).alias("held_out"),
                       text_of(text).alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(word_vectors(rows, index_vectors()))

    def pool(batches):
        places, (vectors, weights) = Places(), model.value
        for batch in batches:
            found = [pooled(np.fromiter(map(places.__getitem__, t), np.int32, len(t)), vectors, weights)
                     for t in map(TOKEN.findall, batch["text"].to_pylist())]
            yield pa.record_batch([batch["id"], batch["held_out"], pa.array([f.tobytes() for f in found], pa.binary())],
                                  ["id", "held_out", "x"])

    features = write_shared(rows.mapInArrow(pool, "id long, held_out boolean, x binary"), "features")
    known = labels.where(F.col(target).isin(0, 1)).groupBy(F.col(id).cast("long").alias("id")).agg(
        F.min(target).cast("int").alias("y"))
    labelled = features.where("not held_out").join(known, "id").select("id", "x", "y")
    sample = smallest_hashes(labelled, ["id"], most_rows).toPandas()
    x = np.frombuffer(b"".join(map(bytes, sample["x"])), np.float32).reshape(-1, WIDTH)
    network = Network().fit(x.astype(np.float64), sample["y"].to_numpy(np.int64))

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(map(bytes, raw)), np.float32).reshape(-1, WIDTH)
        return pd.Series(network.predict(x.astype(np.float64)))

    scored = features.select("id", "held_out", score("x").alias("score"))
    return scored.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
