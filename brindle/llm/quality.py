"""Quality scores from random-indexing word vectors and a small network.

Each word has a sparse random index vector that its hash fixes. A word's context vector is the sum
of the index vectors of its neighbours over the whole corpus. Words are counted over the whole corpus
first: each that makes up at least a 2^-SHARE part of all words has a vector of its own, so there are
2^SHARE such words at most, and the vocabulary grows with the corpus up to there; rarer words share
the vector of their first bytes. A document's features are the pooled (mean and spread of the)
normalised context vectors of its words; a two-layer network in numpy turns them into log odds, and
a temperature learned on documents set aside calibrates them.

Words are runs of letters and digits or of other signs, case kept. Null and empty texts pool to
zeros and get a score. Repeated rows each get theirs. Without labels of both classes every score
is the share of good labels (0.5 without any, as for empty tables). A score that ties with the
threshold counts as good. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bytewords
from brindle.llm.common import documents, labelled_sample, table, with_row_id, written

#: Numbers of a vector.
DIMENSIONS = 32

#: Words of at least this share of all have their own vector: 32 MB of vectors at most.
SHARE = 20

#: Rarer words share 2^CLASS_BITS vectors by their first bytes.
CLASS_BITS, BEGINNING = 12, 3

#: Words counted together before they leave a task.
TOGETHER = 1 << 23

#: Neighbours on each side, and nonzero entries of an index vector.
REACH, ENTRIES = 2, 2

#: Rows of the matrix that travel together.
CHUNK = 256

#: Labelled documents of each class, at most, that the network is trained on.
SAMPLE = 4000

THRESHOLD = 0.3

HIDDEN, ROUNDS, RATE, DECAY = 24, 400, 0.02, 1e-4

SIGNS = np.where(bytewords.ALNUM, 1, np.where(bytewords.NOT_SPACE, 2, 0)).astype(np.uint8)


class Vocabulary:
    """Rows of words in the table of vectors: frequent words by their keys, then classes of others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.rows = len(keys) + (1 << CLASS_BITS)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytewords.Words, np.ndarray]]:
        for w in bytewords.words(data, offsets, SIGNS, bytewords.SAME, (BEGINNING,)):
            begins = np.where(w.prefix_hash[0] > 0, w.prefix_hash[0], w.hash)
            row = (begins >> np.uint64(64 - CLASS_BITS)).astype(np.int64) + len(self.keys)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
                row = np.where(self.keys[at] == w.hash, at, row)
            yield w, row

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the entries of every row's index vector."""
        names = np.concatenate([self.keys, np.arange(1 << CLASS_BITS, dtype=np.uint64)])
        h = bytewords.mix(names[:, None] * np.uint64(ENTRIES) + np.arange(1, ENTRIES + 1, dtype=np.uint64))
        return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int32)


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """Every word is counted; those of a large enough share reach the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for w in bytewords.words(*bytewords.text_buffers(batch.column(0)), SIGNS, bytewords.SAME):
                held.append(w.hash)
                total += len(w.hash)
                if total >= TOGETHER:
                    yield _tally(held)
                    held, total = [], 0
        if total:
            yield _tally(held)

    counts = docs.select(text_col).mapInArrow(local, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words", compression="zstd")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * F.lit(float(1 << SHARE)) >= F.lit(float(total))).select("word").toArrow()
    return Vocabulary(often.column("word").to_numpy().astype(np.int64).view(np.uint64))


def _tally(held: list[np.ndarray]) -> pa.RecordBatch:
    word, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


class Vectors(NamedTuple):
    words: Vocabulary
    table: np.ndarray


def gather(docs: DataFrame, text_col: str = "text") -> Vectors:
    """Context vectors of all words of the corpus, normalised, in steps of 1/127."""
    words = vocabulary(docs, text_col)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = words.index_vectors()
        total = np.zeros(-(-words.rows // CHUNK) * CHUNK * DIMENSIONS, np.int64)
        for batch in batches:
            for w, row in words.words(*bytewords.text_buffers(batch.column(0))):
                doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.bounds))
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    for a, b in ((row[near], row[near + step]), (row[near + step], row[near])):
                        for k in range(ENTRIES):
                            np.add.at(total, a * DIMENSIONS + place[b, k], sign[b, k])
        yield from _chunks({i: c for i, c in enumerate(total.reshape(-1, CHUNK * DIMENSIONS)) if c.any()})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[i] = sums[i] + c if i in sums else c
        for i, c in sums.items():
            v = c.reshape(-1, DIMENSIONS).astype(float)
            v *= 127 / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.rint(v).astype(np.int8).tobytes()], pa.binary())], ["chunk", "sums"])

    schema = "chunk int, sums binary"
    parts = docs.select(text_col).mapInArrow(local, schema)
    whole = parts.repartition("chunk").mapInArrow(added, schema).toArrow()
    out = np.zeros((-(-words.rows // CHUNK), CHUNK * DIMENSIONS), np.int8)
    for i, raw in zip(whole.column("chunk").to_pylist(), whole.column("sums")):
        out[i] = np.frombuffer(raw.as_buffer(), np.int8)
    return Vectors(words, out.reshape(-1, DIMENSIONS)[: words.rows])


def _chunks(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i, c in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], ["chunk", "sums"])


def pooled(vectors: Vectors, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of documents: mean, and mean square, of their words' vectors, and the mean's length."""
    out = np.zeros((len(offsets) - 1, 2 * DIMENSIONS + 1), np.float32)
    for w, row in vectors.words.words(data, offsets):
        n = np.diff(w.bounds)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        at = w.bounds[:-1][has]
        per = n[has, None].astype(np.float32)
        rows = w.lo + has
        for j in range(0, DIMENSIONS, 8):
            x = vectors.table[row, j : j + 8].astype(np.float32) / np.float32(127)
            out[rows, j : j + 8] = np.add.reduceat(x, at, axis=0) / per
            out[rows, DIMENSIONS + j : DIMENSIONS + j + 8] = np.add.reduceat(x * x, at, axis=0) / per
        out[rows, -1] = np.sqrt((out[rows, :DIMENSIONS] ** 2).sum(1))
    return out


class Network(NamedTuple):
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        z = (hidden @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def constant(share: float, width: int = 2 * DIMENSIONS + 1) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    if len(set(y.tolist())) < 2:
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(7)
    aside = np.arange(len(y)) % 5 == 4
    own = ~aside if len(set(y[aside].tolist())) == 2 else np.ones(len(y), bool)
    shift, scale = x[own].mean(0), x[own].std(0) + 1e-6
    a, t, share = (x[own] - shift) / scale, y[own], weight[own] / weight[own].sum()
    params = [rng.normal(0, np.sqrt(2 / a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, ROUNDS + 1):
        w1, b1, w2, b2 = params
        pre = a @ w1 + b1
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500)))
        dz = (p - t) * share
        dh = np.outer(dz, w2) * (pre > 0)
        grads = [a.T @ dh + DECAY * w1, dh.sum(0), hidden.T @ dz + DECAY * w2, np.array([dz.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = params
    net = Network(shift, scale, w1, b1, w2, float(b2[0]), 1.0)
    judge = aside if not own.all() else own
    hidden = np.maximum((x[judge] - shift) / scale @ w1 + b1, 0)
    z, t, share = hidden @ w2 + b2, y[judge], weight[judge]

    def loss(temperature: float) -> float:
        s = np.where(t > 0, 1, -1) * z / temperature
        return float((np.logaddexp(0, -s) * share).sum())

    return net._replace(temperature=min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))


def score(docs: DataFrame, vectors: Vectors, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: row_id, its id and score; without a network the pooled features."""
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(vectors, *bytewords.text_buffers(batch.column(2)))
            last = pa.array(network.score(x)) if network else pa.array(x.tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), last], ["row_id", "id", "score"])

    rows = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("row_id", "id", "text")
    return rows.mapInArrow(work, f"row_id long, id {kind}, score " + ("double" if network else "array<float>")).withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, vectors: Vectors, sample: int = SAMPLE) -> Network:
    got = labelled_sample(docs, labels, "quality", learn, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(vectors, *bytewords.text_buffers(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x.tolist(), pa.list_(pa.float32()))], ["id", "y", "weight", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = got.mapInArrow(work, f"id {kind}, y int, weight double, x array<float>").toPandas().sort_values("id")
    if not len(rows):
        return constant(0.5)
    return train(np.array(rows["x"].tolist()), rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = gather(docs)
    network = fit(docs, table(spark, sf_dir, "labels"), _fold() != 0, vectors)
    got = score(docs, vectors, network)
    return got.select(
        "doc_id",
        F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
