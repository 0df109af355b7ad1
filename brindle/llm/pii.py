"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans: each kind's leftmost non-overlapping matches, of which those that fail
the kind's test (parts of an address, Luhn's sum, number of digits) drop out without another try.
So a number can hide its neighbour: "+1 (269) 555-3296 4524132264652876" is one failed match. And a
number written again in a way that no pattern knows ("269.555.3296") has no base span.

The field labels tokens that have a digit or an @ (any other token is outside for certain, which
leaves its neighbours' potentials constant, so it needs no variable). Tokens of base spans are
observed. The others' unary potentials come from their shape, or where that shape never was in a
base span, from their numbers of digits and signs; and from their neighbours' shapes. Chain edges
link tokens side by side. Skip edges link tokens, however far apart, to the next equal or similar
one (long numbers are alike however they are grouped), and to the last base span of those digits.
Factors are trained piecewise from counts over all documents, with the base spans as labels; as these
are incomplete, a token without a label that repeats a labelled number is no evidence. Loopy
sum-product messages, passed until they settle, give marginals. A labelled run of tokens is added if
no base span touches it and it passes its kind's own test, or has the digits of a base span of its
kind (for phones, of its last seven or more). Base spans always stay.

Null counts as empty: no spans. Repeated rows each give theirs, an empty table none; equally likely
labels take the first of outside, email, ip, card, phone. Columns other than id and text don't
matter. Texts are whole; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import documents, with_row_id, written

KINDS = ("email", "ip", "card", "phone")

#: Labels of the field: outside, then the kinds.
LABELS = 1 + len(KINDS)

#: Shapes that make up at least one MOST_SHAPES-th of a factor's labelled tokens have potentials of
#: their own, which are so many at most, whatever the corpus; the others share one row.
MOST_SHAPES = 20_000
_OTHER = 0

#: Marginal probability from which a label counts; pseudo-counts of each label, and of each pair.
SURE, SMOOTH, PAIR = 0.8, 0.05, 0.5

#: Weight of a coarse shape's evidence: most of its tokens have no label for want of a pattern.
TRUST = 0.5

#: Messages are passed until none changes by more than SETTLED. After a round per token, which lets
#: labels travel through a whole document, they move half the way, for so many rounds at most.
SETTLED, ROUNDS = 1e-6, 1000

#: Different counts that a task keeps before it hands them on, and rows that share a graph.
COUNTED, TOGETHER = 50_000, 256

#: Digits from which a number is alike in any grouping.
DIGITS = 6

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
# a match can begin only where a run of digits does, which is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@]")
_EDGES = ".,;:!?\"'$%&*#|<>[]{}=/\\-_~`^"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses: an address has one @, so each @ is tried once,
    with all the local part before it, which keeps texts without spaces linear."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for kind, pattern, test in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if test(m[0])]
    return out


class Token(NamedTuple):
    place: int
    start: int
    end: int
    text: str
    digits: str
    shape: int
    coarse: int
    joined: bool


@lru_cache(1 << 16)
def _number(shape: str) -> int:
    """A shape as a number, never that of _OTHER."""
    return int.from_bytes(hashlib.blake2b(shape.encode(), digest_size=8).digest(), "little", signed=True) | 1


def _shapes(text: str, digits: str) -> tuple[int, int]:
    """The whole shape, and the coarse one: digits, letters, signs that tell kinds."""
    fine = re.sub(r"[0-9]+", lambda m: f"\x00{min(len(m[0]), 20)}", text)
    fine = re.sub(r"[^\W\d_]+", "a", fine)
    dots = text.count(".") == 3 and _IP.fullmatch(text) is not None
    whole = "@" not in text and _CARD.fullmatch(text) is not None and is_card(text)
    mail = "@" in text and bool(emails(text))
    if dots:
        fine = "ip" + str(is_ip(text))
    elif mail or "@" in text:
        fine = "mail" + str(mail)
    elif whole:
        fine += "luhn"
    coarse = min(len(digits), 20) << 6 | (text[:1] == "+") << 5 | ("@" in text) << 4 | mail << 3 | dots << 2 | whole << 1 | (re.search(r"[^\W\d_]", text) is not None)
    return _number(fine), coarse


def tokens(text: str) -> list[Token]:
    """Candidate tokens without the signs around them; joined: it follows the candidate before it
    with only a space between."""
    out: list[Token] = []
    for place, m in enumerate(_TOKEN.finditer(text)):
        word = m[0]
        if not _CANDIDATE.search(word):
            continue
        core = word.strip(_EDGES)
        if not core:
            continue
        start = m.start() + word.index(core)
        joined = bool(out) and out[-1].place == place - 1 and start == out[-1].end + 1
        digits = _NOT_DIGIT.sub("", core)
        out.append(Token(place, start, start + len(core), core, digits, *_shapes(core, digits), joined))
    return out


def _key(token: Token) -> str:
    """Equal for equal or similar tokens."""
    return token.digits if _long(token) else token.text.lower()


def _long(token: Token) -> bool:
    return len(token.digits) >= DIGITS and "@" not in token.text


def _tails(digits: str) -> tuple[str, ...]:
    """A number as it is and without what may be a country's code."""
    return (digits, digits[-10:]) if len(digits) > 10 else (digits,)


def skips(found: list[Token], labels: list[int] | None = None) -> list[tuple[int, int, bool]]:
    """(token, token, alike for certain): each token with the next one alike, unless they are side by
    side; and with the last token of a base span (run of `labels`) that has its digits."""
    last: dict[str, int] = {}
    out = []
    for i, t in enumerate(found):
        key = _key(t)
        if key in last and not (t.joined and last[key] == i - 1):
            out.append((last[key], i, _long(t) or "@" in t.text))
        last[key] = i
    ends: dict[str, int] = {}
    for i, j, _ in _runs(found, labels or []):
        if j - i > 1:
            for tail in _tails("".join(t.digits for t in found[i:j])):
                ends[tail] = j - 1
    if ends:
        out += [(ends[tail], i, True) for i, t in enumerate(found) if not labels[i] and _long(t) for tail in _tails(t.digits)[-1:] if tail in ends]
    return out


def _runs(found: list[Token], labels: list[int]) -> list[tuple[int, int, int]]:
    """(first, end, label) of the base spans' tokens: neighbours of one label."""
    out, i = [], 0
    while i < len(labels):
        j = i + 1
        if labels[i]:
            while j < len(labels) and labels[j] == labels[i] and found[j].joined and found[j].text[:1] != "+":
                j += 1
            out.append((i, j, labels[i]))
        i = j
    return out


def _labels(found: list[Token], spans: list[tuple[int, int, int]]) -> list[int]:
    by_start = sorted((a, b, k) for k, a, b in spans)
    out, i = [], 0
    for t in found:
        while i < len(by_start) and by_start[i][1] <= t.start:
            i += 1
        j, label = i, 0
        while j < len(by_start) and by_start[j][0] < t.end:
            if by_start[j][1] > t.start:
                label = by_start[j][2] + 1
                break
            j += 1
        out.append(label)
    return out


def _count(texts: list[str | None]) -> Counter:
    """Counts of (factor, value, label or labels): own shape 0, shape before 1, after 2, chain 3, skip
    between alike tokens 4 and others 5, own coarse shape 6."""
    n: Counter = Counter()
    for text in texts:
        if not text:
            continue
        found = tokens(text)
        if not found:
            continue
        y = _labels(found, base_spans(text))
        linked = skips(found, y)
        unknown = {c for a, b, alike in linked if alike and (y[a] > 0) != (y[b] > 0) for c in (a, b) if not y[c]}
        for i, t in enumerate(found):
            if i not in unknown:
                n[0, t.shape, y[i]] += 1
                n[6, t.coarse, y[i]] += 1
            if t.joined:
                n[1, found[i - 1].shape, y[i]] += 1
                n[2, t.shape, y[i - 1]] += 1
                n[3, y[i - 1], y[i]] += 1
        for a, b, alike in linked:
            if not alike or (a not in unknown and b not in unknown):
                n[4 if alike else 5, y[a], y[b]] += 1
    return n


class Field(NamedTuple):
    """Log potentials. `places` has the row of each shape in the tables of factors 0, 1, 2 and 6."""

    places: dict[int, dict[int, int]]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    coarse: np.ndarray
    pairs: np.ndarray

    def row(self, factor: int, value: int) -> int:
        return self.places[factor].get(value, 0)


def field(counts: dict[tuple[int, int, int], int]) -> Field:
    places: dict[int, dict[int, int]] = {f: {_OTHER: 0} for f in (0, 1, 2, 6)}
    for factor, value, label in sorted(counts):
        if factor == 6 or (factor < 3 and label):
            places[factor].setdefault(value, len(places[factor]))
    tables = {f: np.zeros((len(places[f]), LABELS)) for f in places} | {f: np.zeros((LABELS, LABELS)) for f in (3, 4, 5)}
    for (factor, value, label), n in counts.items():
        tables[factor][places[factor].get(value, 0) if factor in places else value, label] += n
    prior = (tables[6].sum(0) + 1) / (tables[6].sum() + LABELS)
    log_prior = np.log(prior)
    own, coarse = (np.log((t + SMOOTH * LABELS * prior) / (t.sum(1, keepdims=True) + SMOOTH * LABELS)) for t in (tables[0], tables[6]))
    sides = []
    for t in (tables[1], tables[2]):
        share = (t + LABELS * prior) / (t.sum(1, keepdims=True) + LABELS)
        sides.append(0.5 * (np.log(share) - log_prior))
    pairs = []
    for t, any_pair, same in ((tables[3], PAIR, 0.0), (tables[4], PAIR / 1000, 1.0), (tables[5], PAIR, 0.0)):
        # which token comes first says nothing; alike tokens agree as long as nothing is known of any
        joint = (t + t.T) / 2 + any_pair + same * np.eye(LABELS)
        joint /= joint.sum()
        side = joint.sum(1)
        pairs.append(np.log(joint) - np.log(side)[:, None] - np.log(side)[None, :])
    return Field(places, own, sides[0], sides[1], coarse, np.stack(pairs))


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Sum-product messages on all edges at once, until they settle: exact on trees. `longest`: tokens
    of the largest document, between whose tokens the edges are."""
    n, e = len(unary), len(edges)
    longest = n if longest is None else longest
    if not n:
        return unary
    src = np.concatenate([edges[:, 0], edges[:, 1]]) if e else np.empty(0, np.int64)
    dst = np.concatenate([edges[:, 1], edges[:, 0]]) if e else np.empty(0, np.int64)
    pot = np.concatenate([potentials, potentials.transpose(0, 2, 1)]) if e else np.empty((0, LABELS, LABELS))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    message = np.zeros((2 * e, LABELS))
    belief = unary
    for step in range(longest + ROUNDS if e else 0):
        z = (belief[src] - message[back])[:, :, None] + pot
        top = z.max(1, keepdims=True)
        new = (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]
        new -= new.max(1, keepdims=True)
        if step > longest:
            new = (new + message) / 2
        moved = np.abs(new - message).max()
        message = new
        belief = unary + np.stack([np.bincount(dst, weights=message[:, k], minlength=n) for k in range(LABELS)], 1)
        if moved < SETTLED:
            break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(texts: list[str | None], bases: list[list[tuple[int, int, int]]], model: Field, skip: bool = True) -> list[list[tuple[int, int, int]]]:
    """Spans beyond the base ones, for many documents in one graph; without `skip`, by chains only."""
    found = [tokens(t) if t else [] for t in texts]
    observed = [_labels(mine, known) for mine, known in zip(found, bases)]
    unary, edges, kinds, base = [], [], [], 0
    fixed = np.where(np.eye(LABELS) > 0, 0.0, -40.0)
    for mine, y in zip(found, observed):
        for i, t in enumerate(mine):
            own = model.row(0, t.shape)
            u = model.own[own] if own else TRUST * model.coarse[model.row(6, t.coarse)]
            if t.joined:
                u = u + model.before[model.row(1, mine[i - 1].shape)]
                edges.append((base + i - 1, base + i))
                kinds.append(0)
            if i + 1 < len(mine) and mine[i + 1].joined:
                u = u + model.after[model.row(2, mine[i + 1].shape)]
            unary.append(fixed[y[i]] if y[i] else u)
        for a, b, alike in skips(mine, y) if skip else ():
            edges.append((base + a, base + b))
            kinds.append(1 if alike else 2)
        base += len(mine)
    if not base:
        return [[] for _ in texts]
    p = marginals(np.array(unary), np.array(edges, np.int64).reshape(-1, 2), model.pairs[np.array(kinds, np.int64)], max(map(len, found)))
    label, sure = p.argmax(1).tolist(), (p.max(1) >= SURE).tolist()
    out, base = [], 0
    for text, mine, y, known in zip(texts, found, observed, bases):
        spans, i = [], 0
        digits = [{_NOT_DIGIT.sub("", text[a:b]) for k, a, b in known if k == kind} for kind in range(len(KINDS))]
        while i < len(mine):
            k, j = label[base + i], i + 1
            if k and sure[base + i] and not y[i]:
                # numbers may be several tokens; a phone number begins at a plus sign
                while k >= 3 and j < len(mine) and mine[j].joined and not y[j] and label[base + j] == k and sure[base + j] and (k == 3 or mine[j].text[0] != "+"):
                    j += 1
                # the longest run from here that is one entity; else the next token gets its turn
                ends = [e for e in range(j, i, -1) if _fits(k - 1, text[mine[i].start : mine[e - 1].end]) or _repeats(k - 1, "".join(t.digits for t in mine[i:e]), digits[k - 1])]
                if ends:
                    j = ends[0]
                    spans.append((k - 1, mine[i].start, mine[j - 1].end))
                else:
                    j = i + 1
            i = j
        out.append(spans)
        base += len(mine)
    return out


def _fits(kind: int, text: str) -> bool:
    if kind == 0:
        return emails(text) == [(0, len(text))]
    pattern, test = ((_IP, is_ip), (_CARD, is_card), (_PHONE, is_phone))[kind - 1]
    return bool(pattern.fullmatch(text)) and test(text)


def _repeats(kind: int, digits: str, known: set[str]) -> bool:
    """Whether a base span of the kind has these digits; a phone number may lack the first ones."""
    if kind == 0 or len(digits) < DIGITS:
        return False
    return digits in known or (kind == 3 and len(digits) > DIGITS and any(d.endswith(digits) for d in known))


def _only_candidates(text_col: str) -> Column:
    """Texts without a digit or @ have no spans: they don't travel to Python."""
    return F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col))


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """The field, from counts over all documents. Of the shapes that ever were in base spans at most
    MOST_SHAPES a factor reach the driver, and coarse shapes are at most 1344."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                n.update(_count(batch.column(0).slice(k, TOGETHER).to_pylist()))
                if len(n) > COUNTED:
                    yield counted(n)
                    n = Counter()
        if n:
            yield counted(n)

    def counted(n: Counter) -> pa.RecordBatch:
        a, b, c = zip(*n)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(n.values(), pa.int64())], ["factor", "value", "label", "n"])

    texts = docs.select(_only_candidates(text_col).alias("text")).where("text is not null")
    counts = written(texts.mapInArrow(work, "factor int, value long, label int, n long").groupBy("factor", "value", "label").agg(F.sum("n").alias("n")), "counts")
    shaped = F.col("factor").isin(0, 1, 2)
    known = counts.where(shaped & (F.col("label") > 0))
    total = known.groupBy("factor").agg(F.sum("n").alias("total"))
    often = known.groupBy("factor", "value").agg(F.sum("n").alias("k")).join(F.broadcast(total), "factor").where(F.col("k") * MOST_SHAPES >= F.col("total")).select("factor", "value", F.lit(True).alias("own"))
    kept = counts.join(F.broadcast(often), ["factor", "value"], "left")
    value = F.when(~shaped | F.col("own"), F.col("value")).otherwise(F.lit(_OTHER).cast("long"))
    rows = kept.groupBy("factor", value.alias("value"), "label").agg(F.sum("n").alias("n")).collect()
    return field({(r.factor, r.value, r.label): r.n for r in rows})


def find(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: row_id, its id, base and added (arrays of kind, start, end; by kind
    in the order of KINDS, then start)."""
    kind = dict(docs.dtypes)[id_col]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    structs = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.column(2).slice(k, TOGETHER).to_pylist()
                known = [base_spans(t) if t else [] for t in part]
                base += [structs(s) for s in known]
                more += [structs(sorted(s)) for s in added(part, known, model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(more, span)], ["row_id", "id", "base", "added"])

    rows = with_row_id(docs.select(F.col(id_col).alias("id"), _only_candidates(text_col).alias("text"))).select("row_id", "id", "text")
    spans = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(work, f"row_id long, id {kind}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = find(docs, fit(docs))
    of = lambda k: F.filter("base", lambda s: s.kind == k)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(order(a) != order(b), order(a) - order(b)).when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0).cast("int"))
    return got.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
