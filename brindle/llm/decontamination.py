"""Benchmark decontamination with an FM-index per training shard.

A shard is the words of some whole documents of one task. Every word that some test phrase contains
is a symbol; all other words, document ends, and runs of symbols shorter than the shortest phrase
become separators, which no occurrence can cross. The suffix array of the symbols gives the
Burrows-Wheeler transform, a wavelet tree over it answers ranks, test phrases are searched backward
all at once, and the rows found are walked to sampled suffix positions. Occurrences are merged into
removal spans.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. Phrases are the runs of
WINDOW consecutive words of an item; an item of fewer words, but some, is one phrase. Null and
empty texts have no words; a null item id counts as the empty string; repeated items count once;
repeated documents each get their row. Empty tables give no rows, or no hits. Other columns don't
matter. Words are told apart by 64-bit hashes: those of one length up to eight bytes for certain, any
others but for a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bytewords
from brindle.llm.common import documents, fresh, numbered, table, take_up, texts, without_rows, written

#: Words of a phrase.
WINDOW = 10

#: Symbols after which a shard's index is built.
SHARD = 1_000_000

#: Every how many symbols a suffix position is kept.
SAMPLE = 8

#: Bytes of item texts searched for in one scan; a larger benchmark is searched for in blocks, of
#: which the driver has one at a time, as arrays.
ITEM_BYTES = 16 << 20


class WaveletTree:
    """Symbols in [0, 2^levels) by bits from the highest, level by level; ranks of many at once."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.n, self.levels = len(symbols), levels
        self.bits, self.sums, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            small = np.packbits(bit, bitorder="little")
            packed[: len(small)] = small
            words = packed.view(np.uint64)
            sums = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=sums[1:])
            self.bits.append(words)
            self.sums.append(sums)
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, first), self._ones(level, at)
            first = np.where(one, self.zeros[level] + a, first - a)
            at = np.where(one, self.zeros[level] + b, at - b)
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros are separators: each sorts before all symbols and by place, so no
    comparison goes past one."""
    n = len(text)
    zero = text == 0
    zeros = int(zero.sum())
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + (zeros - 1 if zeros else 0)
    rank[zero] = np.arange(zeros)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        if n == 0 or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


class FmIndex:
    """Of symbols from 1 on, with zeros as separators."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        order = suffix_array(text)
        bwt = text[order - 1]  # the symbol before the whole text is the last one, a separator
        top = int(text.max(initial=0))
        self.tree = WaveletTree(bwt, max(top.bit_length(), 1))
        self.smaller = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.smaller[1:])
        kept = (order % sample == 0) | (bwt == 0)
        self.kept = kept
        self.kept_rank = np.cumsum(kept) - 1
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given backward: phrases[:, 0] is the last symbol."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.tree.n)
        alive = np.arange(len(phrases))
        top = len(self.smaller) - 2
        for step in range(phrases.shape[1]):
            alive = alive[step < lengths[alive]] if step else alive
            symbol = phrases[alive, step].astype(np.int64)
            there = symbol <= top
            lo[alive[~there]] = hi[alive[~there]] = 0
            alive, symbol = alive[there], symbol[there]
            base = self.smaller[symbol]
            lo[alive] = base + self.tree.rank(symbol, lo[alive])
            hi[alive] = base + self.tree.rank(symbol, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next kept row, which is at most a sample away."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        go = np.flatnonzero(~self.kept[rows])
        while len(go):
            at = rows[go]
            symbol = self.tree.access(at)
            rows[go] = self.smaller[symbol] + self.tree.rank(symbol, at)
            steps[go] += 1
            go = go[~self.kept[rows[go]]]
        return self.places[self.kept_rank[rows]] + steps


class Phrases:
    """Distinct phrases of items, as symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        raw = [text.encode() for _, text in items]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        per_item = []
        for block in bytewords.words(data, offsets, bytewords.ALNUM):
            per_item += [block.hash[a:b] for a, b in zip(block.bounds, block.bounds[1:])]
        every = np.concatenate([np.empty(0, np.uint64), *per_item])
        self.vocabulary, ids = np.unique(every, return_inverse=True)
        ids = np.append(ids + 1, np.zeros(window, np.int64)).astype(np.int32)
        size = np.array([len(h) for h in per_item], np.int64)
        count = np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(size)), count)
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - (np.cumsum(size) - size), count)
        length = np.minimum(size[item], window)
        # backward, the last symbol first; zeros after the first one of an item that is shorter
        step = np.arange(window)
        rows = np.where(step < length[:, None], ids[start[:, None] + np.maximum(length[:, None] - 1 - step, 0)], 0).astype(np.int32)
        self.backward, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.backward > 0).sum(1)
        known, number = np.unique(np.array([name for name, _ in items], dtype=object), return_inverse=True)
        self.names = known.tolist()
        # the items of phrase i are members[first[i]:first[i + 1]]
        pairs = np.unique(which.reshape(-1).astype(np.int64) * max(len(known), 1) + number[item])
        self.members = pairs % max(len(known), 1)
        self.first = np.searchsorted(pairs, np.arange(len(self.lengths) + 1) * max(len(known), 1))
        self.shortest = int(self.lengths.min(initial=window))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def items(self, phrases: np.ndarray) -> list[str]:
        """Names of the items that have any of these phrases, sorted."""
        found = np.concatenate([self.members[self.first[p] : self.first[p + 1]] for p in phrases.tolist()])
        return [self.names[i] for i in np.unique(found).tolist()]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(at):
            h = hashes[at]
            place = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[place] == h, place + 1, 0)
        return out


class _Shard:
    """Symbols of documents until they are indexed, with the word of each."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, symbols: np.ndarray, bounds: np.ndarray, base: int) -> None:
        """Runs of symbols long enough for a phrase, each followed by a separator."""
        n = len(symbols)
        inside = symbols > 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edges = bounds[(bounds > 0) & (bounds < n)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        keep = ends - starts >= self.phrases.shortest
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return
        sizes = ends - starts + 1
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        where = np.arange(total) - np.repeat(first - starts, sizes)
        text = symbols[np.minimum(where, n - 1)]
        text[first + sizes - 1] = 0
        self.parts.append(text)
        self.words.append(where + base)
        self.size += total

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, phrase) of every occurrence."""
        if not self.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        text, words = np.concatenate(self.parts), np.concatenate(self.words)
        self.clear()
        index = FmIndex(text)
        lo, hi = index.search(self.phrases.backward, self.phrases.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)
        return words[index.locate(rows)], which


def _scan(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_up("decontamination")
    for batch in batches:
        data, offsets = bytewords.text_buffers(batch.column(2))
        n_docs = batch.num_rows
        n_words = np.zeros(n_docs, np.int64)
        shard, found, base = _Shard(phrases), [], 0
        for block in bytewords.words(data, offsets, bytewords.ALNUM):
            n_words[block.lo : block.hi] = np.diff(block.bounds)
            if len(phrases.lengths):
                shard.add(phrases.symbols(block.hash), block.bounds, base)
            base += len(block.start)
            if shard.size >= SHARD:
                found.append(shard.occurrences())
        found.append(shard.occurrences())
        word = np.concatenate([f[0] for f in found])
        phrase = np.concatenate([f[1] for f in found])
        first = np.concatenate([[0], np.cumsum(n_words)])
        hits: list[int] = [0] * n_docs
        items: list[list[str]] = [[] for _ in range(n_docs)]
        spans: list[list[dict]] = [[] for _ in range(n_docs)]
        if len(word):
            doc = np.searchsorted(first, word, "right") - 1
            by_doc = np.argsort(doc, kind="stable")
            word, phrase, doc = word[by_doc], phrase[by_doc], doc[by_doc]
            docs, at = np.unique(doc, return_index=True)
            for d, a, b in zip(docs.tolist(), at.tolist(), [*at[1:].tolist(), len(doc)]):
                mine = np.unique(phrase[a:b])
                items[d] = phrases.items(mine)
                start = word[a:b] - first[d]
                marks = np.zeros(n_words[d] + 1, np.int64)
                np.add.at(marks, start, 1)
                np.add.at(marks, start + phrases.lengths[phrase[a:b]], -1)
                hit = np.cumsum(marks)[:-1] > 0
                hits[d] = int(hit.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                raw = data[offsets[d] : offsets[d + 1]]
                w = next(bytewords.words(raw, np.array([0, len(raw)]), bytewords.ALNUM))
                chars = np.cumsum((raw & 0xC0) != 0x80)
                spans[d] = [{"start": int(chars[w.start[i]]) - 1, "end": int(chars[w.end[j - 1] - 1])} for i, j in zip(edge[::2], edge[1::2])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["row_id", "id", "n_words", "n_hit", "items", "spans"],
        )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, its id, n_words, n_hit (words inside occurrences), items
    (ids found, sorted as strings) and spans (merged, in characters, end exclusive). No text moves."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    kind = dict(docs.dtypes)[id_col]
    rows = texts(docs, id_col, text_col, row)
    if blocks > 1 and not row:
        rows = written(rows, "numbered", compression="zstd")
    found = None
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        phrases = Phrases([(r.name, r.text) for r in mine.collect()], window)
        scan = lambda batches, phrases=phrases: _scan(phrases, batches)
        part = rows.mapInArrow(scan, f"row_id long, id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
        if blocks == 1:
            return part.withColumnRenamed("id", id_col)
        part = written(part.where("n_hit > 0"), "hits")
        found = part if found is None else found.unionByName(part)
        del phrases, scan
    return _merged(rows, found).withColumnRenamed("id", id_col)


def _merged(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The results of several item blocks as one: hits are counted again over the union of spans."""
    kind = dict(rows.dtypes)["id"]
    found = hits.groupBy("row_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans: list[dict] = []
                for s in r["spans"] or []:
                    if spans and s["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], s["end"])
                    else:
                        spans.append(dict(s))
                raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
                starts = np.concatenate([w.start for w in bytewords.words(raw, np.array([0, len(raw)]), bytewords.ALNUM)])
                at = np.cumsum((raw & 0xC0) != 0x80)[starts] - 1
                hit = sum(int(np.searchsorted(at, s["end"]) - np.searchsorted(at, s["start"])) for s in spans)
                out.append({"row_id": r["row_id"], "id": r["id"], "n_words": len(starts), "n_hit": hit, "items": r["items"] or [], "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row_id", pa.int64()), batch.schema.field("id"), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    schema = f"row_id long, id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    return rows.join(found, "row_id", "left").select("row_id", "id", "text", "items", "spans").mapInArrow(recount, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which a phrase occurs."""
    row = fresh(docs)
    rows = numbered(docs, row)
    bad = written(contamination(rows, items, id_col, text_col, row=row).where("n_hit > 0").select(F.col("row_id").alias(row)), "contaminated")
    return without_rows(rows, bad, row).drop(row)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
