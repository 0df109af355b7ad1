"""Every column of the registered queries that SQL can't check, against independent code."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import bytewords, pii, quality, toxicity
from brindle.llm.queries import QUERIES
from test_llm import brute_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name, sf=SF):
    rows = QUERIES[name](spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def test_personal_data(spark, documents):
    got = result(spark, "op4_pii")
    assert got.keys() == documents.keys()
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for i, r in got.items():
        text = documents[i].text or ""
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(base))
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(set(spans)) == len(spans)
        keys = [(order[k], int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert keys == sorted(keys)
        covered = [(int(a), int(b)) for _, a, b in (s.split(":") for s in base)]
        for k, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in set(spans) - set(base))):
            assert a < b <= len(text) and re.search("[0-9@]", text[a:b]) and all(b <= x or y <= a for x, y in covered)


def test_byte_bpe(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in result(spark, "op5_byte_bpe").items():
        text = documents[i].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_token_counts(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for i, r in result(spark, "op6_token_counts").items():
        text = documents[i].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_sharding(spark, documents):
    got = result(spark, "op10_hilbert_sharding")
    assert got.keys() == documents.keys()
    slots = defaultdict(list)
    for i, r in got.items():
        raw = (documents[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(16)]
    assert set(slots) == set(range(16)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name, modulus, rest, threshold", [("op7_quality", 5, 0, 0.3), ("op9_toxicity", 3, 1, 0.7)])
def test_columns_of_scores(spark, documents, name, modulus, rest, threshold):
    got = result(spark, name)
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def plain_features(text):
    """Sentences as lists of feature names."""
    out = []
    for part in re.split(rb"[\n!.?]", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", part)
        if words:
            out.append([x for w in words for x in [(0, w), *((n, w[:n]) for n in toxicity.BEGINNINGS if len(w) > n)]])
    return out


def test_toxicity_against_plain_retraining(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = sorted(i for i, y in labels.items() if y is not None and texts.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1)
    first = {}
    for i in known:
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    ids = sorted(first.values())
    y = [labels[i] > 0 for i in ids]
    bags = [plain_features(texts[i]) for i in ids]
    toxic, clean = Counter(), Counter()
    for bag, t in zip(bags, y):
        (toxic if t else clean).update({x for s in bag for x in s})
    a, b = sum(y), len(y) - sum(y)

    def g2(x):
        share = (toxic[x] + clean[x]) / (a + b)
        part = lambda k, n: (k * math.log(k / (n * share)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if k < n else 0)
        return 2 * (part(toxic[x], a) + part(clean[x], b)) if toxic[x] * b > clean[x] * a else 0

    kept = {x: k for k, x in enumerate(sorted(x for x in toxic if toxic[x] + clean[x] >= toxicity.LEAST_DOCS and g2(x) >= toxicity.LEAST_G2))}
    assert kept
    theta = np.append(np.zeros(len(kept)), -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sentences = [[np.array([kept[x] for x in s if x in kept], int) for s in bag] for bag in bags]
    for t in range(1, toxicity.ROUNDS + 1):
        grad = np.append(toxicity.DECAY * theta[:-1] / len(y), 0.0)
        for bag, label in zip(sentences, y):
            z = np.array([theta[s].sum() + theta[-1] for s in bag])
            p = np.clip(1 - np.exp(-np.logaddexp(0, z).sum()), 1e-9, 1 - 1e-9)
            for s, odds in zip(bag, (-(1 - p) / p if label else 1.0) / len(y) / (1 + np.exp(-z))):
                np.add.at(grad, s, odds)
                grad[-1] += odds
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    got = result(spark, "op9_toxicity", sf)
    for i, text in texts.items():
        z = np.array([sum(theta[kept[x]] for x in s if x in kept) + theta[-1] for s in plain_features(text or "")])
        assert got[i].score == pytest.approx(1 - math.exp(-np.logaddexp(0, z).sum()), abs=1e-5)


def test_quality_features_against_plain_sums(spark, documents):
    """Counting, context vectors and pooling by dicts; the network is given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vectors = quality.gather(docs)
    words = {i: re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", (r.text or "").encode()) for i, r in documents.items()}
    counts = Counter(w for ws in words.values() for w in ws)
    total = sum(counts.values())
    own = {w: bytewords.word_hash(w) for w, n in counts.items() if n * (1 << quality.SHARE) >= total}
    assert len(own) == len(counts) and vectors.words.keys.tolist() == sorted(own.values())
    place, sign = vectors.words.index_vectors()
    row = {w: int(np.searchsorted(vectors.words.keys, np.uint64(h))) for w, h in own.items()}
    context = defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    for ws in words.values():
        for k, w in enumerate(ws):
            for near in [*ws[max(k - quality.REACH, 0) : k], *ws[k + 1 : k + 1 + quality.REACH]]:
                np.add.at(context[w], place[row[near]], sign[row[near]])
    unit = {w: np.rint(127 * c / max(np.sqrt((c * c).sum()), 1e-9)) / 127 for w, c in context.items()}
    got = {r.doc_id: np.array(r.score) for r in quality.score(docs, vectors, None).collect()}
    for i, ws in words.items():
        x = np.array([unit.get(w, np.zeros(quality.DIMENSIONS)) for w in ws]) if ws else np.zeros((1, quality.DIMENSIONS))
        want = [*x.mean(0), *(x * x).mean(0), np.sqrt((x.mean(0) ** 2).sum())]
        assert got[i] == pytest.approx(np.array(want), abs=2e-4)


def test_null_ids_and_empty_documents_are_scored(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(None, "fine words"), (1, None), (1, "fine words"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for table, n in ((empty, 0), (docs, 4)):
        vectors = quality.gather(table)
        net = quality.fit(table, labels, F.lit(True), vectors)
        assert [round(r.score, 6) for r in quality.score(table, vectors, net).collect()] == [0.5] * n
        model = toxicity.fit(table, labels, F.lit(True))
        assert all(r.score < 1e-9 for r in toxicity.score(table, model).collect()) and toxicity.drop_toxic(table, labels).count() == n
