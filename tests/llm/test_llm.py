"""The training-data operators against brute force, other libraries, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import byte_bpe, bytewords, common, decontamination, exact_dedup, hilbert_sharding, jaccard_join, license_scan, pii, quality, token_counts, toxicity
from brindle.llm.license_texts import TEMPLATES

WORDS = "the of and to in a is that it for on with as this was be by are from at or an".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ",", ".", "é"])) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def scan(spark, tmp_path):
    """Tables as files, which is what operators scan."""

    def make(texts, ids=None, **more):
        path = str(tmp_path / f"t{random.random()}")
        df = table(spark, texts, ids)
        for name, value in more.items():
            df = df.withColumn(name, F.lit(value))
        df.coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


EDGES = [None, "", " \n\t", "x", "same text  here", "same text here", "same\ntext here", "é" * 70_000, "a" * 30_000, "word " * 20_000]


# words


def test_bytewords_against_regex(monkeypatch):
    monkeypatch.setattr(bytewords, "LONG", 24)
    monkeypatch.setattr(bytewords, "BLOCK", 100)
    rng = random.Random(2)
    for _ in range(60):
        docs = ["".join(rng.choice("ab é.  Z") for _ in range(rng.choice([0, 1, 5, 60, 300]))).encode() for _ in range(5)]
        offsets = np.cumsum([0] + [len(d) for d in docs]).astype(np.int64)
        seen, n = defaultdict(set), 0
        for w in bytewords.words(np.frombuffer(b"".join(docs), np.uint8), offsets, bytewords.ALNUM):
            for i in range(len(w.start)):
                seen[bytes(w.data[w.start[i] : w.end[i]]).lower()].add(int(w.hash[i]))
                n += 1
        want = [x.lower() for d in docs for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", d)]
        assert n == len(want) and set(seen) == set(want)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


def thue_morse(n, first):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b ^ first] for b in bits)


def test_words_that_collide_under_polynomials(scan):
    for n in (16, 64, 1024, 2048):
        assert bytewords.word_hash(thue_morse(n, 0).encode()) != bytewords.word_hash(thue_morse(n, 1).encode())
    one, two = (f"x y {thue_morse(1024, k)}" for k in (0, 1))
    got = {r.doc_id: (r.n_similar, r.component_id) for r in jaccard_join.similar(scan([one, two, two])).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1)}


# 1 licences


def test_license_scan(scan):
    mit = next(t for n, t in TEMPLATES if n == "MIT")
    texts = ["prose here\nReleased under the MIT License.\nmore prose", mit, mit.replace("Permission", "Leave"), "no licence at all", *EDGES]
    got = {r.doc_id: r.matches for r in license_scan.scan(scan(texts, extra="x")).collect()}
    assert [(m.line, m.license) for m in got[0]] == [(2, "MIT")] and got[0][0].dice == 1.0
    assert (got[1][0].line, got[1][0].license) == (0, "MIT") and 0.95 < got[2][0].dice < 1
    assert all(got[i] == [] for i in range(3, len(texts)))
    assert license_scan.scan(scan([])).count() == 0


def test_long_licences_within_longer_texts(scan):
    before = "\n".join(" ".join(f"w{9 * i + k}" for k in range(9)) for i in range(600))
    texts = [f"{before}\n{body}\n{before}" if k % 2 else body for k, (_, body) in enumerate(license_scan.FULL)]
    for (name, body), r in zip(license_scan.FULL, sorted(license_scan.scan(scan(texts)).collect(), key=lambda r: r.doc_id)):
        best = max(r.matches, key=lambda m: m.dice)
        assert best.license == name and best.dice > 0.99
        assert best.line == (601 if r.doc_id % 2 else 0) and (not best.line or best.last >= 598 + len(body.split("\n")))


def test_license_wrapped_within_a_longer_text(scan):
    rng = random.Random(11)
    mit, apache = (next(t for n, t in TEMPLATES if n == name) for name in ("MIT", "Apache-2.0"))
    prose_ = "\n".join(prose(rng, 12) for _ in range(60))
    commented = "\n".join(" * " + x for x in apache.split("\n"))
    texts = [f"{prose_}\n{mit}\n{prose_}", f"{prose_}\n/*\n{commented}\n */\n{prose_}\n\n{mit}\n", "code\nReleased under\nthe MIT License.\n" + prose_, prose_, f"{prose_}\n" + "\n".join(mit.split("\n")[:4])]
    got = {r.doc_id: [(m.line, m.last, m.license, round(m.dice, 2)) for m in r.matches] for r in license_scan.scan(scan(texts)).collect()}
    assert got[0] == [(61, 60 + len(mit.split("\n")), "MIT", 1.0)]
    a = 62 + len(apache.split("\n"))
    assert [m for m in got[1] if m[0] != m[1]] == [(62, a - 1, "Apache-2.0", 1.0), (a + 62, a + 61 + len(mit.split("\n")), "MIT", 1.0)]
    assert got[2] == [(2, 3, "MIT", 1.0)] and got[3] == got[4] == []


def test_license_runs_against_brute_force():
    rng = random.Random(3)
    known = license_scan.Templates(TEMPLATES, threshold=0.7)

    def grams(lines):
        w = [(x, i) for i, line in enumerate(lines) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower())]
        return [((x, y), i, j) for (x, i), (y, j) in zip(w, w[1:])]

    templates = sorted(TEMPLATES, key=lambda t: t[0])
    sets = [{g for g, *_ in grams([t])} for _, t in templates]
    for _ in range(25):
        words = prose(rng, 25).split()
        for _, body in rng.sample(templates, 3):
            words += [w for w in body.split() if rng.random() > 0.05] + prose(rng, rng.randrange(15)).split()
        lines = []
        while words:
            k = rng.randrange(1, 25)
            lines.append(" ".join(words[:k]))
            words = words[k:]
        placed, every = grams(lines), []
        for a, b in itertools.combinations(range(len(lines)), 2):
            inside = [(g, i, j) for g, i, j in placed if a <= i and j <= b]
            own = {g for g, *_ in inside}
            for t, s in enumerate(sets):
                if any(g in s and i == a for g, i, _ in inside) and own & s > {g for g, _, j in inside if j < b} & s:
                    every.append((-2 * len(own & s) / (len(own) + len(s)), b - a, a, t))
        want = []
        for d, more, a, t in sorted(e for e in every if -e[0] >= 0.7):
            if all(a + more < x or y < a for x, y, *_ in want):
                want.append((a, a + more, t, round(-d, 9)))
        raw = np.frombuffer("\n".join(lines).encode(), np.uint8)
        w = next(bytewords.words(raw, np.array([0, len(raw)]), bytewords.ALNUM))
        line = np.cumsum(raw == 10)[w.start]
        bigrams = license_scan._bigrams(w.hash)
        near = known.within_reach(np.zeros(len(bigrams), np.int64), bigrams)[1].tolist()
        got = known.runs(bigrams, line[:-1], line[1:], near) if near else []
        assert [(a, b, t, round(d, 9)) for a, b, t, d in got] == sorted(want)


def test_license_pruning_loses_nothing():
    rng = random.Random(5)
    known = license_scan.Templates(TEMPLATES, threshold=0.6)

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        return set(zip(w, w[1:]))

    templates = sorted(TEMPLATES, key=lambda t: t[0])
    for _ in range(200):
        words = rng.choice(templates)[1].split()
        text = " ".join(w for w in words if rng.random() > 0.15) + " " + prose(rng, rng.randrange(6))
        raw = np.frombuffer(text.encode(), np.uint8)
        w = next(bytewords.words(raw, np.array([0, len(raw)]), bytewords.ALNUM))
        got = known.match(np.zeros(max(len(w.hash) - 1, 0), np.int64), license_scan._bigrams(w.hash))
        own = grams(text)
        dice = [2 * len(own & grams(t)) / (len(own) + len(grams(t))) for _, t in templates]
        best = max(range(len(dice)), key=lambda i: (dice[i], -i))
        assert [(j, round(d, 9)) for _, j, d in got] == ([(best, round(dice[best], 9))] if dice[best] >= 0.6 else [])


# row numbers


def test_filters_when_the_cut_into_tasks_changes_between_scans(spark, tmp_path, labels, monkeypatch):
    rng = random.Random(23)
    near = prose(rng, 200)
    leak = "quick brown foxes jump over very lazy dogs while nobody looks at them"
    texts = [prose(rng, rng.randrange(40, 400)) for _ in range(60)]
    for i in range(0, 60, 4):
        texts[i] = (near + f" copy {i}", texts[i - 1], f"{texts[i]} {leak} {texts[i]}", texts[i] + " zzgrawlix")[i // 4 % 4]
    for i in range(60):
        table(spark, [texts[i]], [i]).coalesce(1).write.parquet(str(tmp_path / f"d/part={i}"))
    real, count = common.written, itertools.count()

    def written(*args, **options):
        out = real(*args, **options)
        spark.conf.set("spark.sql.files.minPartitionNum", (1, 60, 7)[next(count) % 3])
        return out

    for module in (common, toxicity, exact_dedup, jaccard_join, decontamination):
        monkeypatch.setattr(module, "written", written)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        docs = spark.read.parquet(str(tmp_path / "d")).drop("part")
        items = spark.createDataFrame([(1, leak)], "item_id long, text string")
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        kind = lambda k: {i for i in range(0, 60, 4) if i // 4 % 4 == k}
        assert ids(decontamination.drop_contaminated(docs, items)) == sorted(set(range(60)) - kind(2))
        assert ids(exact_dedup.drop_duplicates(docs)) == sorted(set(range(60)) - kind(1))
        assert ids(jaccard_join.drop_similar(docs)) == sorted(set(range(60)) - (kind(0) - {0}) - kind(1))
        model = toxicity.Model(toxicity.Features(np.array([bytewords.word_hash(b"zzgrawlix")], np.uint64)), np.array([20.0]), -12.0)
        monkeypatch.setattr(toxicity, "fit", lambda *_: model)
        assert ids(toxicity.drop_toxic(docs, labels([]))) == sorted(set(range(60)) - kind(3))
        got = {r.doc_id: r.n_similar for r in jaccard_join.similar(docs).collect()}
        assert {i for i, n in got.items() if n >= len(kind(0)) - 1} == kind(0)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


# 2 exact dedup


def test_exact_dedup(scan):
    texts = [*EDGES, "same text here", "x"]
    ids = [*range(20, 20 + len(EDGES)), 3, None]
    got = exact_dedup.refine(scan(texts, ids, size=1, prefix="clash", sha="z"), digests=True).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = {}
    for text, members in groups.items():
        keep = min((m for m in members if m is not None), default=None)
        for m in members:
            want[m] = (keep, len(members), m == keep, hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in got} == want


def test_exact_dedup_repeated_rows_and_empty(scan, spark):
    kept = exact_dedup.drop_duplicates(scan(["a b", "a  b", "a b", "c"], [1, 1, 1, 2]))
    assert sorted((r.doc_id, r.text is not None) for r in kept.collect()) == [(1, True), (2, True)]
    assert exact_dedup.refine(scan([])).count() == 0


# 3 decontamination


def brute_hits(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = defaultdict(set)
    for name, text in items:
        w = words(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases[tuple(w[k : k + window])].add(name)
    out = []
    for text in docs:
        w = words(text)
        hit, names = set(), set()
        for p, of in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    names |= of
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_fm_index_finds_all(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(decontamination, "SHARD", 40)
    for trial in range(120):
        voc = ["a", "b", "Ab", "é", "x1", "Q", "zz"][: rng.randrange(2, 8)]
        text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(voc) for _ in range(n))
        items = [(str(i), text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14]) if trial % 2 else rng.choice([8, 10, 12]))) for i in range(rng.randrange(6))]
        docs = [rng.choice([None, text(rng.randrange(60))]) for _ in range(rng.randrange(1, 8))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64())] * 2 + [pa.array(docs, pa.string())], ["row_id", "id", "text"])
        got = next(decontamination._scan(decontamination.Phrases(items), iter([batch]))).to_pylist()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == brute_hits(docs, items)


def test_decontamination_frames(scan, spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, prose(rng, 14)) for i in range(4)] + [(9, None), (None, "solo item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    loud = re.sub("[a-z]", lambda m: m[0].upper(), items[1][1])
    texts = [prose(rng, 30) + " " + loud + ". " + prose(rng, 9), prose(rng, 40), "so solo item it", *EDGES]
    names = [("" if i is None else str(i), t) for i, t in items]
    want = brute_hits(texts, names)
    docs = scan(texts, items="clash", spans=1)
    one = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 60)
    many = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    for got in (one, many):
        assert [(got[i].n_words, got[i].n_hit, list(got[i].items)) for i in range(len(texts))] == want
    assert one[0].spans == many[0].spans and loud.rstrip(".,") in texts[0][one[0].spans[0].start : one[0].spans[0].end]
    clean = decontamination.drop_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w[1]} and clean.columns == docs.columns
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


# 4 personal data


def brute_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and doubled % 10 == 0, 8 <= len(d) <= 15)
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(1)
    for i in range(4000):
        t = "".join(rng.choice("ab.1 2@-+%()é\n٣") for _ in range(rng.randrange(40)))
        t = ("4111" + rng.choice(["", "-", " "]) + "1111 1111 1111" if i % 3 == 0 else "") + t
        assert pii.base_spans(t) == brute_spans(t)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    n, k = 5, pii.LABELS
    unary, edges = rng.normal(size=(n, k)), np.array([(0, 1), (1, 2), (1, 3), (3, 4)])
    pots = rng.normal(size=(len(edges), k, k))
    want = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pots[e][y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(n):
            want[i, y[i]] += w
    assert pii.marginals(unary, edges, pots) == pytest.approx(want / want.sum(1, keepdims=True))


def test_pii_adds_hidden_numbers(scan):
    shown = [f"call +1 (20{i}) 555-327{i} now or card 4524132264652876 here" for i in range(10)] * 3
    hidden = "see +1 (269) 555-3296 4524132264652876 and"
    docs = scan([*shown, hidden, *EDGES, "mail a.b@c-d.example.com twice a.b@c-d.example.com"], base="x", added="y")
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, r in got.items():
        assert [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base] == brute_spans(texts[i])
    assert [hidden[s.start : s.end] for s in got[30].added] == ["4524132264652876", "+1 (269) 555-3296"]
    assert all(not got[i].added for i in range(31, len(got)))
    assert pii.find(scan([]), pii.field({})).count() == 0


def test_skip_edges_link_like_tokens():
    found = pii.tokens("id 555-3296 then (555) x 5553296 and 555-3296 in 555")
    assert [(found[a].text, found[b].text, c) for a, b, c in pii.skips(found)] == [("555-3296", "5553296", True), ("5553296", "555-3296", True)]
    found = pii.tokens("+1 (269) 555-3296 or 269.555.3296 on 12 or 12")
    labels = pii._labels(found, pii.base_spans("+1 (269) 555-3296 or 269.555.3296 on 12 or 12"))
    assert [(found[a].text, found[b].text, c) for a, b, c in pii.skips(found, labels)] == [("12", "12", False), ("555-3296", "269.555.3296", True)]


def test_only_skip_edges_find_repeats_in_another_form():
    shown = [f"call +1 (20{i % 10}) 555-32{i % 90 + 10} now or card 4524132264652876 here in 2024" for i in range(300)]
    model = pii.field(pii._count([*shown, *["order 10 of 2023 with 5551234567 and 4524.1322.6465.2871"] * 300]))
    texts = [
        "call +1 (269) 555-3296 or later 269.555.3296 or (269) 555-3296 and not 555.123.4567",
        "card 4524-1322-6465-2876 again 4524.1322.6465.2876 but not 4524.1322.6465.2871",
        "number 269.555.3296 alone, and 4524.1322.6465.2876",
    ]
    base = [pii.base_spans(t) for t in texts]
    found = lambda skip: [[t[a:b] for _, a, b in s] for t, s in zip(texts, pii.added(texts, base, model, skip))]
    assert found(True) == [["269.555.3296", "(269) 555-3296"], ["4524.1322.6465.2876"], []]
    assert found(False)[1:] == [[], []] and "269.555.3296" not in found(False)[0]


def test_marginals_on_loops_are_near_exact():
    rng = np.random.default_rng(1)
    n, k = 4, pii.LABELS
    unary, edges = rng.normal(size=(n, k)), np.array([(0, 1), (1, 2), (2, 3), (0, 3)])
    pots = 0.5 * rng.normal(size=(len(edges), k, k))
    want = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pots[e][y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(n):
            want[i, y[i]] += w
    assert np.abs(pii.marginals(unary, edges, pots) - want / want.sum(1, keepdims=True)).max() < 0.02


def test_labels_travel_along_a_long_chain():
    n = 1000
    unary = np.zeros((n, pii.LABELS))
    unary[0, 3] = 40.0
    edges = np.stack([np.arange(n - 1), np.arange(1, n)], 1)
    same = np.where(np.eye(pii.LABELS) > 0, 0.0, -30.0)
    assert (pii.marginals(unary, edges, np.repeat(same[None], n - 1, 0)).argmax(1) == 3).all()


def test_long_runs_of_signs_take_linear_time():
    for text in ("9" * 1_000_000, "9." * 500_000, "1 " * 500_000, "a@" * 500_000, "+1((" * 250_000):
        began = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - began < 2


# 5 and 6 tokens


def _fuzz(rng, n):
    return "".join(rng.choice("aab 'srevtdlm\n\t  éßΣİσ\x1c\x85​　１2½字ñ<|startoftext|>.,!aáﬁ") for _ in range(rng.randrange(n)))


@pytest.fixture(scope="module")
def bpe():
    own = byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.bpe.ranks, special_tokens={})


def test_bpe_same_as_library(bpe, monkeypatch):
    own, library = bpe
    rng = random.Random(3)
    texts = [_fuzz(rng, 60) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 2000, "<|endoftext|>"]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    assert own.bpe._long(b"anteaters") == own.bpe.tokens(b"anteaters") or own.bpe.ranks.get(b"anteaters")


def test_bpe_edits(bpe):
    own, _ = bpe
    rng = random.Random(4)
    for _ in range(300):
        text = _fuzz(rng, 40)
        live = byte_bpe.EditableText(own, text)
        for k in range(4):
            a = len(text) if k == 3 else rng.randrange(len(text) + 1)
            b = rng.randrange(a, min(len(text), a + 5) + 1)
            new = _fuzz(rng, 6)
            text = text[:a] + new + text[b:]
            live.replace(a, b, new)
            assert live.ids == own.encode(text)
    live = byte_bpe.EditableText(own, "some words and " * 500)
    before = live.encoded_pieces
    live.append("more")
    live.replace(10, 12, "x")
    assert live.encoded_pieces - before < 20


def test_bpe_frames(scan, bpe):
    docs = scan([*EDGES, "again", "again"], decoded="clash")
    got = {r.doc_id: r for r in byte_bpe.encode(docs, decode=True).collect()}
    for r in docs.collect():
        assert list(got[r.doc_id].ids) == bpe[1].encode_ordinary(r.text or "") and bytes(got[r.doc_id].decoded) == (r.text or "").encode()
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert all(bytes(r.decoded) == bytes(got[r.doc_id].decoded) for r in back.collect())
    assert byte_bpe.encode(scan([])).count() == 0


def test_counts_same_as_library(scan):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    rng = random.Random(6)
    texts = [_fuzz(rng, 60) + rng.choice(["", "<|endoftext|>x", "<|startoftext|"]) for _ in range(1500)] + ["a" * 3000]
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(scan(EDGES, n_tokens=1)).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(EDGES)}
    assert token_counts.count_tokens(scan([])).count() == 0


# 7 and 9 learned scores


def _fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality(scan, labels):
    rng = random.Random(7)
    texts, rows = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" | ".join(prose(rng, 1) + "$$$" for _ in range(60)) if bad else prose(rng, 120))
        rows.append((i, int(not bad), 0))
    texts += EDGES
    docs = scan(texts, score=1.0)
    vectors = quality.gather(docs)
    net = quality.fit(docs, labels(rows), quality._fold() != 0, vectors)
    got = {r.doc_id: r.score for r in quality.score(docs, vectors, net).collect()}
    held = [i for i in range(400) if _fold(i, 5) == 0]
    assert sum((got[i] >= 0.3) == bool(rows[i][1]) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(texts)
    alone = quality.fit(docs, labels([]), quality._fold() != 0, vectors)
    assert quality.score(docs, vectors, alone).select(F.round("score", 6)).distinct().collect() == [(0.5,)]
    assert quality.score(scan([]), vectors, net).count() == 0


def test_index_vectors_add_up(scan):
    docs = scan(["a b c", "c b"])
    got = quality.gather(docs)
    assert len(got.words.keys) == 3
    place, sign = got.words.index_vectors()
    row = {w: int(np.searchsorted(got.words.keys, bytewords.word_hash(w))) for w in (b"a", b"b", b"c")}
    want = np.zeros(quality.DIMENSIONS)
    for near in (b"b", b"c"):  # the words around "a"
        for p, s in zip(place[row[near]], sign[row[near]]):
            want[p] += s
    assert got.table[row[b"a"]] / 127 == pytest.approx(want / np.linalg.norm(want), abs=0.005)


def test_rare_words_share_vectors_by_their_beginnings(scan, monkeypatch):
    monkeypatch.setattr(quality, "SHARE", 4)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["often", "common"]) + f" rarely{rng.randrange(50)}" for _ in range(30)) for _ in range(10)]
    words = quality.vocabulary(scan(texts))
    assert words.keys.tolist() == sorted(map(bytewords.word_hash, (b"often", b"common")))
    raw = b"often rarely1 rarely2 seldom"
    row = next(words.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[1]
    assert row[0] < 2 <= row[1] == row[2] != row[3] >= 2


def test_toxicity(scan, labels):
    rng = random.Random(8)
    texts, rows = [], []
    for i in range(500):
        parts = [prose(rng, 12).replace(".", "") for _ in range(8)]
        if i % 5 == 0:
            parts[3] += " moron" if i % 2 else " lowei" + rng.choice("abcdefgh") * 2
        texts.append(". ".join(parts) + ".")
        rows.append((i, 1, int(i % 5 == 0)))
    docs = scan([*texts, *EDGES], score=0.5)
    model = toxicity.fit(docs, labels(rows), toxicity.not_held_out())
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(500) if _fold(i, 3) == 1]
    assert sum((got[i].score >= 0.7) == bool(rows[i][2]) for i in held) >= 0.97 * len(held)
    for i in held:
        if rows[i][2] and got[i].score >= 0.7:
            assert any(re.search("moron|lowei", texts[i][s.start : s.end]) for s in got[i].sentences)
    assert all(got[i].score < 0.7 for i in range(500, 510))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels(rows)).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}
    none = toxicity.fit(docs, labels([(1, 1, 0)]), toxicity.not_held_out())
    assert toxicity.score(docs, none).where("score > 0.01").count() == 0
    assert toxicity.score(scan([]), model).count() == 0


def test_noisy_or():
    z = np.array([-1.0, 0.5, 2.0])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z, np.array([0, 2, 2, 3])) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])


# 8 Jaccard join


def brute_links(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()))
    n = len(texts)
    near = defaultdict(set)
    for i, j in itertools.combinations(range(n), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
            near[i].add(j)
            near[j].add(i)
    out = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - reach:
                reach.add(k)
                todo.append(k)
        out.append((len(sets[i]), len(near[i]), min((ids[k] for k in reach if ids[k] is not None), default=None)))
    return out


def _near_copies(rng, n):
    texts = []
    while len(texts) < n:
        base = prose(rng, rng.choice([1, 2, 3, 4, 6, 9, 30, 80])).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "swap"])
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("boundary", [None, 0, 12, 10_000])
def test_jaccard_join(scan, monkeypatch, boundary):
    rng = random.Random(11)
    texts = _near_copies(rng, 90) + ["shared passage of many words " * 3 + prose(rng, 5) for _ in range(12)] + EDGES
    ids = [rng.randrange(10_000) for _ in texts]
    ids[5], ids[6] = None, ids[4]
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 300)
    monkeypatch.setattr(jaccard_join, "BITMAP", 640)
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "_boundary", lambda sets: boundary)
    got = jaccard_join.similar(scan(texts, ids, size=1, sig="clash", rep=2)).collect()
    want = brute_links(texts, ids)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)


def test_one_of_each_component_stays(scan):
    rng = random.Random(12)
    texts = _near_copies(rng, 40) + ["", None]
    docs = scan(texts)
    kept = {r.doc_id for r in jaccard_join.drop_similar(docs).collect()}
    assert kept == {i for i, (_, _, c) in enumerate(brute_links(texts, list(range(len(texts))))) if c == i}
    assert jaccard_join.similar(scan([])).count() == 0


def test_packing():
    rng = np.random.default_rng(3)
    for values in (np.array([5], np.uint64), np.sort(rng.integers(0, 1 << 40, 1000, np.uint64)), np.array([1, 1 << 39, 1 << 47], np.uint64), np.array([1, 1 << 39, 1 << 60], np.uint64), np.array([7, 7, 7], np.uint64)):
        assert (jaccard_join._unpack(jaccard_join._pack(values)) == values).all()


def test_bitmaps_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(jaccard_join, "BITMAP", 640)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = {i: np.unique(np.concatenate([rng.permutation(base)[: 380 if i % 2 else 310], rng.integers(0, 1 << 63, 20, np.uint64)])) for i in range(8)}
    pairs = list(itertools.combinations(range(8), 2))
    want = [(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    got = [p for b in jaccard_join._links({i: (len(s), s.tobytes()) for i, s in sets.items()}, pairs) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert got == want and 0 < len(want) < len(pairs)


def test_hot_shingles_go_as_counts(monkeypatch):
    rng = random.Random(9)
    texts = ["every document begins like this " + prose(rng, rng.randrange(2, 30)) + rng.choice(["", " and ends like that one"]) for _ in range(60)] + [None, "", "every document begins like this"]
    texts[20:40] = [t + " more" for t in texts[:20]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 21)), pa.array(texts[k : k + 21])], ["row_id", "text"]) for k in (0, 21, 42)]
    found = {}
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2000)
    for hot in (2, 5, 10**6):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        sent = list(jaccard_join._send(4)(iter(batches)))
        assert hot > 100 or any(r["numbers"][:1] == b"h" for b in sent for r in b.to_pylist() if r["range"] >= 0)
        answers = list(jaccard_join._answer(iter(sent), 4))
        found[hot] = sorted((r["row_id"], r["size"], r["prefix"], r["df"], r["tokens"]) for b in jaccard_join._reduce(iter(answers), 4) for r in b.to_pylist())
    assert found[2] == found[5] == found[10**6] and len(found[2]) > 3
    df = Counter(x for t in texts for x in set(jaccard_join.shingles(next(bytewords.words(np.frombuffer((t or " ").encode(), np.uint8), np.array([0, len((t or " ").encode())]), bytewords.NOT_SPACE)).hash).tolist()))
    for row, size, prefix, step, raw in found[2]:
        t = np.frombuffer(raw, np.uint64).tolist()
        assert all(df[x] > 1 for x in t) and [math.floor(8 * math.log2(df[x]) + 1e-9) for x in t] == sorted(math.floor(8 * math.log2(df[x]) + 1e-9) for x in t)
        assert step == math.floor(8 * math.log2(df[t[prefix - 1]]) + 1e-9)


def test_blocks_grow(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(["x" * 10, None, "y" * 15])], ["row_id", "text"]) for k in range(0, 30, 3)]
    got = list(jaccard_join._blocks(iter(batches), 60))
    assert [r for b in got for r in b.column(0).to_pylist()] == list(range(30))
    assert all(b.num_rows >= 6 for b in got[:-1])


# 10 sharding


def test_hilbert_curve_is_one_path():
    places = sorted((hilbert_sharding.hilbert_index(p, 3), p) for p in itertools.product(range(8), repeat=3))
    assert [i for i, _ in places] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(places, places[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 16, 33, 200])
def test_sharding(scan, n):
    rng = random.Random(n)
    texts = [rng.choice([*EDGES[:7], prose(rng, 20)]) for _ in range(n)]
    got = hilbert_sharding.shard(scan(texts, shard=1, slot=2, place=3)).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    shards = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        shards[r.shard].append((r.slot, r.place))
    counts = [len(shards[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(16))
    order = [p for s in sorted(shards) for _, p in sorted(shards[s])]
    assert order == sorted(order) and all([x for x, _ in sorted(v)] == list(range(len(v))) for v in shards.values())


def test_cuts_compare_whole_values(spark):
    rng = random.Random(4)
    # ten sources that share their first 19 bytes, one with a third of the rows
    names = ["https://example.com/" + c for c in "jihgfedcba"]
    values = [rng.choice(names) for _ in range(400)] + [names[3]] * 200 + [None] * 50
    facts = spark.createDataFrame([(v,) for v in values], "d string")
    edges = hilbert_sharding.cuts(facts, "d")
    order = sorted(values, key=lambda v: (v is not None, v or ""))
    want = sorted({order[-(-k * len(order) // 16) - 1] for k in range(1, 16)} - {order[-1]}, key=lambda v: (v is not None, v))
    assert edges == want and None in edges and len(edges) >= 6
    bins = {r.d: r.b for r in facts.select("d", hilbert_sharding._bin("d", edges).alias("b")).distinct().collect()}
    assert bins == {v: sum(e is None or e < v for e in edges) if v else 0 for v in set(values)}
    assert hilbert_sharding.cuts(facts.limit(0), "d") == []


def test_shard_files(scan, spark, tmp_path):
    docs = scan([prose(random.Random(i), 9) for i in range(40)])
    hilbert_sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 40 and {r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {10}
