"""Byte-level BPE by prefix dynamic programming.

Each prefix of a piece has one encoding, and the encoding of a prefix without its last token is the
encoding of the shorter prefix. So one token per position is enough: `last[i]`, the only token that
ends at i and may follow the encoding of what lies before it. Encoding runs from left to right in
time linear in the text; appending continues where it stopped, and an edit re-encodes only until
the piece boundaries meet again.

Null counts as empty and gives no tokens; special strings are ordinary text; every text is whole.
Repeated rows each give theirs, an empty table none. Each text has one encoding, so nothing ties.
Columns other than id and text don't matter, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from brindle.llm.common import documents, remembers, take_up

RANKS = "byte_bpe_50k.tiktoken"

#: Pieces of one generation whose tokens a worker remembers; this bounds memory only.
REMEMBERED = 150_000

#: Prefixes whose last tokens a worker remembers before it starts afresh; pieces beyond LONG bytes
#: are worked out by position instead.
PREFIXES, LONG = 250_000, 64

#: Rows of one output batch and bytes of text in it; a longer text is a batch of its own.
OUT_ROWS, OUT_BYTES = 512, 1 << 22

_NEVER = 1 << 60


class _Tails(dict):
    def __init__(self, ranks: dict[bytes, int]) -> None:
        found: dict[bytes, set[int]] = {}
        for text in ranks:
            found.setdefault(text[-2:], set()).add(len(text))
        super().__init__({tail: tuple(sorted(sizes | {1}, reverse=True)) for tail, sizes in found.items()})

    def __missing__(self, tail: bytes) -> tuple[int, ...]:
        return (1,)


class PrefixBpe:
    """Encoder of one rank file: `ranks` maps byte strings to ids in merge order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.texts = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.texts[rank] = text
        self.remembered = PREFIXES
        self.last: dict[bytes, int] = {b"": -1}
        #: By the last two bytes: the lengths of the tokens that end so, longest first.
        self._tails: dict[bytes, tuple[int, ...]] = _Tails(ranks)
        self._pairs: dict[int, bool] = {}
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        parts = [bytes([b]) for b in self.texts[token]]
        while len(parts) > 2:
            best, at = _NEVER, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], _NEVER)
                if r < best:
                    best, at = r, i
            if best >= token:
                raise ValueError(f"token {token} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """From the outermost byte up to the token: each node's bytes, and the rank at which the
        next node swallows it."""
        known = self._spines.get((token, right))
        if known is None:
            text = self.texts[token]
            if len(text) == 1:
                known = [(text, _NEVER)]
            else:
                below = self._spine(self._halves(token)[right], right)
                known = [*below[:-1], (below[-1][0], token), (text, _NEVER)]
            self._spines[token, right] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, stay as they are: no merge crosses the boundary
        while the nodes beside it exist."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self._stay_apart(left, right)
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        a, b = self._spine(left, True), self._spine(right, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            merged = self.ranks.get(x + y, _NEVER)
            if merged < x_ends and merged <= y_ends and merged != _NEVER:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def tokens(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece. Each prefix's last token goes into `self.last`, which pieces share:
        only prefixes not met before are worked out."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.last) > self.remembered:
            self.last = {b"": -1}
        last, ranks, pairs, tails = self.last, self.ranks, self._pairs, self._tails
        n = known = len(piece)
        if n > LONG:
            return self._long(piece)
        while piece[:known] not in last:
            known -= 1
        for end in range(known + 1, n + 1):
            for size in tails[piece[max(0, end - 2) : end]]:
                if size > end:
                    continue
                token = ranks.get(piece[end - size : end])
                if token is not None:
                    if size == end:
                        break
                    before = last[piece[: end - size]]
                    follows = pairs.get(before << 32 | token)
                    if follows is None:
                        follows = self.may_follow(before, token)
                    if follows:
                        break
            else:
                raise ValueError("the ranks lack single bytes")
            last[piece[:end]] = token
        out, at = [], n
        while at:
            token = last[piece[:at]]
            out.append(token)
            at -= len(self.texts[token])
        out.reverse()
        return tuple(out)

    def _long(self, piece: bytes) -> tuple[int, ...]:
        """The same for a piece whose prefixes would take too much room as keys: by position."""
        ranks, last = self.ranks, [-1]
        for end in range(1, len(piece) + 1):
            for size in self._tails[piece[max(0, end - 2) : end]]:
                token = ranks.get(piece[end - size : end]) if size <= end else None
                if token is not None and (size == end or self.may_follow(last[end - size], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack single bytes")
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.texts[last[at]])
        out.reverse()
        return tuple(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


class _Known(dict):
    """Tokens by piece (32-bit ids), computed at first sight. When it is full it becomes the older
    generation, from which pieces that are met again come back."""

    def __init__(self, bpe: PrefixBpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = array("i", self.bpe.tokens(piece.encode())).tobytes()
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.bpe = PrefixBpe(ranks)
        self.pattern = regex.compile(pattern)
        self.known = _Known(self.bpe)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


class EditableText:
    """A text kept with its tokens. `append` and `replace` give the tokens of the whole new text,
    but split and encode only near the change."""

    def __init__(self, tokenizer: Tokenizer, text: str = "") -> None:
        self.tokenizer, self.text = tokenizer, ""
        self.ends: list[int] = []
        self.pieces: list[bytes] = []
        self.encoded_pieces = 0
        self.append(text)

    @property
    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(self.pieces), np.int32).tolist()

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """text[start:end] becomes `new`. A piece is settled by what precedes its end and the two
        characters after it (a contraction is three long); from a boundary on, what follows does not
        depend on what came before."""
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        keep = 0
        while keep < len(self.ends) and self.ends[keep] + 2 <= start:
            keep += 1
        at = self.ends[keep - 1] if keep else 0
        later = {e + shift: i for i, e in enumerate(self.ends) if e >= end}
        ends, pieces, meet = [], [], None
        while at < len(text):
            if at >= start + len(new) and at in later:
                meet = later[at] + 1
                break
            m = self.tokenizer.pattern.match(text, at)
            if m is None or m.end() == at:
                at += 1
                continue
            at = m.end()
            ends.append(at)
            pieces.append(self.tokenizer.known[m[0]])
            self.encoded_pieces += 1
        rest = range(meet, len(self.ends)) if meet is not None else ()
        self.ends = self.ends[:keep] + ends + [self.ends[i] + shift for i in rest]
        self.pieces = self.pieces[:keep] + pieces + [self.pieces[i] for i in rest]
        self.text = text


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return Tokenizer(ranks, pattern)


remembers("byte_bpe", tokenizer.cache_clear)


def small_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most OUT_ROWS rows and OUT_BYTES bytes of the text column."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        lo = total = 0
        for i, size in enumerate(sizes):
            if i > lo and (i - lo >= OUT_ROWS or total + size > OUT_BYTES):
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += size
        if lo < len(sizes):
            yield batch.slice(lo, len(sizes) - lo)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, decode: bool = False) -> DataFrame:
    """One row per row of `docs`: its id, `ids` (array of int; empty for null and empty texts) and,
    with `decode`, `decoded` (the bytes that the ids stand for). Repeated rows each give theirs."""
    path = path or public_tokenizers.path(RANKS)
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up("byte_bpe")
        tok = tokenizer(path, pattern)
        for batch in small_batches(batches, 1):
            ids = [np.frombuffer(tok.packed(t) if t else b"", np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
            if decode:
                out.append(pa.array([tok.decode(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, ids array<int>" + ", decoded binary" * decode)
    return made.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`tokens` with the bytes that its ids stand for; null ids give null. Needs unique column names
    other than `out_col`."""
    path = path or public_tokenizers.path(RANKS)
    where = tokens.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, public_tokenizers.PATTERN).bpe
        for batch in batches:
            got = [None if x is None else bpe.decode(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, out_col])

    schema = StructType([*tokens.schema.fields, StructField(out_col, BinaryType())])
    return tokens.mapInArrow(work, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(documents(spark, sf_dir), decode=True)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
