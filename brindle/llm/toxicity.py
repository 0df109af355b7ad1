"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the weights of its
words and of their beginnings; the document's score is the noisy-or of its sentences' scores, one
minus the chance that none is toxic. Only document labels train the weights; the sentences whose
scores are high are the offending ones. Features are told apart by 64-bit hashes; a word that the
sample did not single out has no weight.

The weights are learned from a bounded sample of labelled documents (SAMPLE of each class). Their
texts stay on the executors: the driver gets the features' counts and, for each document, the
places of the features chosen.

Null and empty texts have no sentence and score 0. Repeated rows each get their score; equal texts
count once in the sample. Without labels of both classes, or without documents, every score is 0.
Ties don't arise. Other columns of the tables don't matter, whatever their names. Texts are whole;
sentences of any length count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bytewords
from brindle.llm.common import SPACES, documents, fresh, labelled_sample, numbered, table, take_up, texts, without_rows, written

#: Labelled documents of each class, at most, that the weights are learned from.
SAMPLE = 2000

#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6)

#: A feature gets a weight if it occurs in so many of the sample's texts, and more often in toxic
#: ones, with so large a likelihood-ratio statistic: chance gives that to one feature in a million.
LEAST_DOCS, LEAST_G2 = 3, 22.0

#: Features with a weight, at most: those of the largest statistic.
FEATURES = 1 << 16

#: A document is toxic from this score on; so is an offending sentence.
THRESHOLD = 0.7

ROUNDS, RATE, DECAY = 300, 0.1, 1e-3

_ENDS = bytewords.byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


class Bags(NamedTuple):
    """keys[k][i] is feature k of word i (0: none); sentence s is words first_word[s]:first_word[s+1],
    document d is sentences first_sentence[d]:first_sentence[d+1]."""

    keys: list[np.ndarray]
    first_word: np.ndarray
    first_sentence: np.ndarray
    words: bytewords.Words


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[Bags]:
    for w in bytewords.words(data, offsets, bytewords.ALNUM, prefixes=BEGINNINGS):
        ends = np.cumsum(_ENDS[w.data])
        sentence = ends[w.start] if len(w.start) else np.empty(0, np.int64)
        new = np.ones(len(sentence), bool)
        new[1:] = sentence[1:] != sentence[:-1]
        new[w.bounds[:-1][w.bounds[:-1] < len(sentence)]] = True
        first_word = np.append(np.flatnonzero(new), len(sentence))
        yield Bags([w.hash, *w.prefix_hash], first_word, np.searchsorted(first_word[:-1], w.bounds), w)


class Features:
    """The chosen features, by their keys in ascending order."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys.astype(np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def places(self, bag: Bags) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) of every feature of the block's words."""
        words, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for key in bag.keys if len(self.keys) else ():
            at = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            hit = self.keys[k] == key[at]
            words.append(at[hit])
            numbers.append(k[hit])
        return np.concatenate(words), np.concatenate(numbers)


class Model(NamedTuple):
    features: Features
    weights: np.ndarray
    bias: float

    def sentences(self, bag: Bags) -> np.ndarray:
        """Log odds of each sentence."""
        word, number = self.features.places(bag)
        sentence = np.searchsorted(bag.first_word, word, "right") - 1
        return np.bincount(sentence, weights=self.weights[number], minlength=len(bag.first_word) - 1) + self.bias


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def noisy_or(z: np.ndarray, first_sentence: np.ndarray) -> np.ndarray:
    """Scores of documents from the log odds of their sentences."""
    sums = np.concatenate([[0.0], np.cumsum(_softplus(z))])
    return -np.expm1(-np.maximum(sums[first_sentence[1:]] - sums[first_sentence[:-1]], 0.0))


def _g2(n_toxic: int, n_clean: int) -> Column:
    """Likelihood-ratio statistic of a feature's counts of documents, `toxic` and `clean`; 0 where it
    leans to clean ones."""
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n_toxic + n_clean))

    def part(k: Column, n: int) -> Column:
        inside = F.when(k > 0, k * F.log(k / (share * n))).otherwise(0.0)
        return inside + F.when(k < n, (F.lit(n) - k) * F.log((F.lit(n) - k) / ((1 - share) * n))).otherwise(0.0)

    return F.when(F.col("toxic") * n_clean > F.col("clean") * n_toxic, 2 * (part(F.col("toxic"), n_toxic) + part(F.col("clean"), n_clean))).otherwise(0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to each feature's number of documents, toxic and clean."""
    take_up("toxicity")
    for batch in batches:
        y = batch.column(0).to_numpy()
        for b in bags(*bytewords.text_buffers(batch.column(1))):
            doc = np.repeat(np.arange(b.words.hi - b.words.lo), np.diff(b.words.bounds))
            pairs = [np.unique(np.stack([doc[k > 0].astype(np.uint64), k[k > 0]], 1), axis=0) for k in b.keys]
            of, key = np.concatenate(pairs).T
            toxic = y[b.words.lo + of.astype(np.int64)] > 0
            known, where = np.unique(key, return_inverse=True)
            columns = [np.bincount(where, weights=side, minlength=len(known)).astype(np.int64) for side in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *map(pa.array, columns)], ["key", "toxic", "clean"])


def _placed(features: Features):
    """(id, y, weight, text) to the number of sentences and the (sentence, feature) pairs, as 32-bit
    numbers; nothing else of the texts reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up("toxicity")
        for batch in batches:
            n, marks = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for b in bags(*bytewords.text_buffers(batch.column(3))):
                n[b.words.lo : b.words.hi] = np.diff(b.first_sentence)
                word, number = features.places(b)
                sentence = np.searchsorted(b.first_word, word, "right") - 1
                order = np.lexsort((number, sentence))
                sentence, number = sentence[order], number[order]
                edges = np.searchsorted(sentence, b.first_sentence)
                for d in np.flatnonzero(np.diff(edges)).tolist():
                    i, j = edges[d], edges[d + 1]
                    marks[b.words.lo + d] = np.stack([sentence[i:j] - b.first_sentence[d], number[i:j]], 1).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(marks, pa.binary())], ["id", "y", "weight", "n", "marks"])

    return work


def train(features: Features, y: np.ndarray, weight: np.ndarray, n: np.ndarray, marks: list[bytes]) -> Model:
    """Full-batch Adam on the weighted likelihood of document labels under the noisy-or. Sentences
    without a feature all have the bias alone, so that only their number counts."""
    pairs = [np.frombuffer(m, np.int32).reshape(-1, 2) for m in marks]
    of_doc = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    both = np.concatenate([np.empty((0, 2), np.int32), *pairs]).astype(np.int64)
    known, sentence = np.unique(of_doc << 32 | both[:, 0], return_inverse=True)
    doc, feature = known >> 32, both[:, 1]
    plain = n - np.bincount(doc, minlength=len(n))
    theta = np.zeros(len(features.keys) + 1)
    theta[-1] = -6.0  # the bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = weight / weight.sum()
    odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, ROUNDS + 1):
        z = np.bincount(sentence, weights=theta[feature], minlength=len(known)) + theta[-1]
        none = np.bincount(doc, weights=_softplus(z), minlength=len(n)) + plain * _softplus(theta[-1])
        p = np.clip(-np.expm1(-none), 1e-9, 1 - 1e-9)
        # d loss / d z: sigmoid(z) for clean documents, -sigmoid(z) * (1 - p) / p for toxic ones
        slope = np.where(y > 0, -(1 - p) / p, 1.0) * share
        each = slope[doc] * odds(z)
        grad = np.append(np.bincount(feature, weights=each[sentence], minlength=len(features.keys)) + DECAY * theta[:-1] / len(y), each.sum() + (slope * plain).sum() * odds(theta[-1]))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(features, theta[:-1], float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents for which `learn`, a condition on `labels`, holds."""
    got = labelled_sample(docs, labels, "toxic", learn, sample)
    once = got.groupBy(F.sha2(F.regexp_replace("text", SPACES, " ").cast("binary"), 256)).agg(F.min(F.struct("id", "y", "weight", "text")).alias("first"))
    sample_of = written(once.select("first.*"), "sample")
    sizes = {bool(r.y): r.n for r in sample_of.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(Features(np.empty(0, np.uint64)), np.empty(0), -50.0)
    counts = sample_of.select("y", "text").mapInArrow(_counted, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).withColumn("g2", _g2(sizes[True], sizes[False])).where(F.col("g2") >= LEAST_G2)
    keys = [r.key for r in strong.orderBy(F.desc("g2"), "key").select("key").limit(FEATURES).collect()]
    features = Features(np.array(keys, np.int64).view(np.uint64))
    kind = dict(docs.dtypes)["doc_id"]
    rows = sample_of.mapInArrow(_placed(features), f"id {kind}, y int, weight double, n long, marks binary").toPandas().sort_values("id")
    return train(features, rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float), rows["n"].to_numpy(np.int64), rows["marks"].tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", located: bool = True, threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, its id, score, and with `located` the offending sentences
    (start, end in characters from first to last word, and their own score)."""
    kind = dict(docs.dtypes)[id_col]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    dense = model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up("toxicity")
        for batch in batches:
            data, offsets = bytewords.text_buffers(batch.column(2))
            scores = np.zeros(batch.num_rows)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for bag in bags(data, offsets):
                z = dense.sentences(bag)
                w = bag.words
                scores[w.lo : w.hi] = noisy_or(z, bag.first_sentence)
                if located:
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    chars = None
                    for s in np.flatnonzero(p >= threshold).tolist():
                        d = int(np.searchsorted(bag.first_sentence, s, "right")) - 1
                        if chars is None:
                            chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                        a, b = w.start[bag.first_word[s]], w.end[bag.first_word[s + 1] - 1]
                        at = chars[w.offsets[d]]
                        found[w.lo + d].append({"start": int(chars[a] - at), "end": int(chars[b] - at), "score": float(p[s])})
            out = [batch.column(0), batch.column(1), pa.array(scores)]
            if located:
                out.append(pa.array(found, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(out, ["row_id", "id", "score", "sentences"][: len(out)])

    rows = texts(docs, id_col, text_col, row)
    made = rows.mapInArrow(work, f"row_id long, id {kind}, score double" + ", sentences array<struct<start:long,end:long,score:double>>" * located)
    return made.withColumnRenamed("id", id_col)


def not_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score `threshold` or more."""
    model = fit(docs, labels, not_held_out())
    row = fresh(docs)
    rows = numbered(docs, row)
    bad = written(score(rows, model, located=False, row=row).where(F.col("score") >= threshold).select(F.col("row_id").alias(row)), "toxic")
    return without_rows(rows, bad, row).drop(row)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"), not_held_out())
    got = score(docs, model)
    return got.select(
        "doc_id",
        F.coalesce(~not_held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "sentences",
    )
