"""Token counts by a heap and a linked list, without identifiers.

Each word starts as a linked list of symbols; a heap holds the rank and place of every adjacent pair
that may merge. The lowest rank, leftmost at ties, is popped and merged until none is left. A word's
count is its initial symbols minus its merges; the sum over a text is its count.

Null counts as empty: no bytes, no tokens. Texts are whole, words of any length included. Repeated
rows each give theirs, an empty table none. Columns other than id and text don't matter, whatever
their names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.byte_bpe import small_batches
from brindle.llm.common import documents, remembers, take_up

VOCABULARY = "word_bpe_49k.json"

#: Words of one generation whose counts a worker remembers; this bounds memory only.
REMEMBERED = 300_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the other bytes from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordCounter(dict):
    """Tokens of a word, computed at first sight."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str) -> None:
        super().__init__()
        self.older: dict[str, int] = {}
        self.suffix, self.symbols = suffix, byte_symbols()
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.first = [number(s) for s in self.symbols]
        self.final = [number(s + suffix) for s in self.symbols]
        #: (left, right) -> (rank, merged)
        self.merges = {(number(a), number(b)): (rank, number(a + b)) for rank, (a, b) in enumerate(merges)}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.count(word.encode())
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def count(self, word: bytes) -> int:
        n = len(word)
        symbol = [self.first[b] for b in word]
        symbol[-1] = self.final[word[-1]]
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        merges = self.merges.get
        heap = []
        for i in range(n - 1):
            m = merges((symbol[i], symbol[i + 1]))
            if m is not None:
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else -1
            if j < 0 or merges((symbol[i], symbol[j])) != (rank, made):
                continue
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            merged += 1
            if k >= 0:
                before[k] = i
                m = merges((made, symbol[k]))
                if m is not None:
                    heapq.heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0:
                m = merges((symbol[h], made))
                if m is not None:
                    heapq.heappush(heap, (m[0], h, m[1]))
        return n - merged


class Counter:
    """Counts of the tokenizer that a tokenizers JSON file describes: NFC, white space, lower case,
    a splitting pattern, byte-level symbols with an end-of-word suffix, whole special strings."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError("a vocabulary of another kind")
        self.words = WordCounter([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.marks = {s[:2] for s in special}

    def count(self, text: str) -> int:
        if not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.words.__getitem__, self.pattern.findall(text.lower())))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        return Counter(json.load(f))


remembers("token_counts", counter.cache_clear)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes` and `n_tokens` (0 for null and empty texts)."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up("token_counts")
        count = counter(path).count
        for batch in small_batches(batches, 1):
            texts = batch.column(1)
            n = np.fromiter((count(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))
            size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n)], ["id", "n_bytes", "n_tokens"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long")
    return made.withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 2048)
