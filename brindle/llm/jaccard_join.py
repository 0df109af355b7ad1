"""Exact Jaccard self-join of documents' word n-grams: a size-aware heavy-light join.

1. Documents with equal sets become one class (a 128-bit signature of the set, its size); from here
   on a class is one set, so copies cost nothing.
2. Every shingle's document frequency is counted exactly. Blocks of documents send their shingles,
   sorted and packed, to ranges of the hash space; a range answers each block with the shingles that
   other sets have too. Shingles of one set only can't be shared and never travel again. Of a shingle
   that many of a block's documents have, only their number goes to its range, so that a hot one
   gives its range a few entries a block.
3. Under the order (frequency in steps of an eighth of its log2, hash) two sets of Jaccard >= t share a shingle among the first
   s - ceil(t s) + 1 of each, and two shingles among one more. Sets in which those are all of their
   own drop out here. Small ("light") sets are keyed by all fixed-size subsets (pairs) of that
   prefix; large ("heavy") sets scan inverted lists of single shingles. The boundary is the set size
   at which the estimated cost of both is least.
4. Candidate pairs are checked exactly, in cells to which each set is sent once; cells beyond a number
   of sets or of shingles are split in two dimensions and checked one after the other, so that no
   task holds an unbounded group.
5. Links are counted by class sizes and joined into components by label propagation.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z became a-z; with fewer than SHINGLE words the whole sequence
is one shingle. Null, empty and blank texts have empty sets and are linked with nothing. Repeated
rows count as documents. Null ids are never a component's id unless all of its ids are null; of equal
ids any row stands for the other. An empty table gives no rows. Other columns don't matter.

Shingles are told apart by 64 bits of hash, which makes the join exact but for collisions: n shingles
have n^2 / 2^65 pairs of them on average, 0.0003 for the 10^8 of a gigabyte of text, and one
changes a count of common shingles only if both of its shingles are in the sets compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import bytewords
from brindle.llm.common import attach_groups, documents, fresh, numbered, smaller_batches, take_up, texts, without_rows, written

SHINGLE = 3

#: Jaccard threshold in percent.
PERCENT = 70

#: Elements of the subsets that key light sets.
SUBSET = 2

#: Bytes of text in a block, per range of the hash space, and per task that answers for ranges.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
TASK_BYTES = 16 << 20

#: Shingles that a block sends to a range, at least, where there are many ranges: blocks grow with
#: the ranges up to MOST_BYTES, lest rows become as many as shingles.
LEAST_SENT, MOST_BYTES = 64, 64 << 20

#: One in so many subset keys, and lists, is looked at to estimate what they cost.
PROBES, LISTS = 64, 8

#: A shingle that so many documents of a block have goes to its range as a count.
HOT = 8

#: Sets in a part of a cell of the check, and shingles.
CELL, CELL_SHINGLES = 500, 2_000_000

#: Bits of a cell's bitmaps at a time: 32 MB.
BITMAP = 1 << 28

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles of one document's words, in ascending order."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < SHINGLE:
        h = np.uint64(n) * np.ones(1, np.uint64)
        for x in hashes:
            h = bytewords.mix(h * _A + x)
        return h
    h = hashes[: n - SHINGLE + 1]
    for k in range(1, SHINGLE):
        h = bytewords.mix(h * _A + hashes[k : n - SHINGLE + 1 + k])
    return np.unique(h)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = bytewords.text_buffers(texts)
    for w in bytewords.words(data, offsets, bytewords.NOT_SPACE):
        for a, b in zip(w.bounds.tolist(), w.bounds[1:].tolist()):
            yield shingles(w.hash[a:b])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_up("signatures")
    for batch in batches:
        sizes, sigs = [], []
        for s in _sets(batch.column(2)):
            sizes.append(len(s))
            sigs.append(np.array([bytewords.mix(s ^ _A).sum(), bytewords.mix(s ^ _B).sum(), len(s)], np.uint64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["row_id", "id", "size", "sig"])


def _pack(values: np.ndarray) -> bytes:
    """Ascending values as 32-bit or 48-bit steps, or whole where a step is too long."""
    steps = np.diff(values, prepend=values[:1])
    most = int(steps.max()) if len(steps) else 0
    if most < 1 << 32:
        return b"d" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"e" + values[:1].tobytes() + _low(steps, 6) if most < 1 << 48 else b"w" + values.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"w":
        return np.frombuffer(raw, np.uint64, offset=1)
    steps = np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64) if raw[:1] == b"d" else _high(raw[9:], 6)
    return np.cumsum(steps, dtype=np.uint64) + np.frombuffer(raw, np.uint64, 1, 1)


def _low(values: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of each value."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _high(raw: bytes, n: int) -> np.ndarray:
    whole = np.zeros((len(raw) // n, 8), np.uint8)
    whole[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return whole.view(np.uint64).ravel()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `size` bytes of text, and 65,536 rows at most."""
    held, held_bytes, held_rows = [], 0, 0
    for batch in batches:
        _, offsets = bytewords.text_buffers(batch.column(1))
        for lo, hi in bytewords.spans(offsets, size):
            for a in range(lo, hi, 1 << 16):
                n = min(hi - a, 1 << 16)
                weight = int(offsets[a + n] - offsets[a])
                if held and (held_bytes + weight > size or held_rows + n > 1 << 16):
                    yield held[0] if len(held) == 1 else pa.concat_batches(held)
                    held, held_bytes, held_rows = [], 0, 0
                held.append(batch.slice(a, n))
                held_bytes += weight
                held_rows += n
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _send(log_ranges: int):
    """Blocks of (row_id, text) to one or two rows per range: the block (its first row_id), and the
    fingerprints in the range, ascending, with the number of the block's document for each (n), or
    for hot ones with the count of the block's documents (h). Two rows stay with the block: -1 has
    the row_ids and set sizes of its documents, -2 the hot fingerprints and who has them."""
    shift = np.uint64(64 - log_ranges)
    mask = (np.uint64(1) << shift) - np.uint64(1)
    size = min(max(BLOCK_BYTES, 6 * LEAST_SENT << log_ranges), max(MOST_BYTES, BLOCK_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_up("sets")
        for block in _blocks(batches, size):
            sets = list(_sets(block.column(1)))
            first = block.column(0)[0].as_py()
            sizes = np.array([len(s) for s in sets], np.int64)
            yield _rows([(-1, first, block.column(0).to_numpy().tobytes(), sizes.tobytes())])
            number = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            token = np.concatenate(sets)
            del sets
            order = np.argsort(token, kind="stable")
            token, number = token[order], number[order]
            first_of = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
            times = np.diff(first_of, append=len(token))
            hot = times >= HOT
            out = []
            if hot.any():
                every, counts = np.repeat(hot, times), times[hot].astype(np.uint32)
                tokens = token[first_of[hot]]
                yield _rows([(-2, first, tokens.tobytes(), counts.tobytes() + number[every].tobytes())])
                token, number = token[~every], number[~every]
                out += [(r, first, _pack(tokens[a:b] & mask), b"h" + counts[a:b].tobytes()) for r, a, b in _cut(tokens, shift)]
            for r, a, b in _cut(token, shift):
                out.append((r, first, _pack(token[a:b] & mask), b"n" + number[a:b].tobytes()))
                if len(out) >= 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return work


def _cut(token: np.ndarray, shift: np.uint64) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of ascending tokens."""
    of = (token >> shift).astype(np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(token)])


def _rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], ["range", "block", "tokens", "numbers"])


def _shared(rows: list[tuple[int, int, bytes, bytes]], log_ranges: int) -> Iterator[pa.RecordBatch]:
    """For each block of some ranges: the entries whose fingerprint occurs in more than one set."""
    shift, width = np.uint64(64 - log_ranges), _width(log_ranges)
    whole = lambda r, t: _unpack(t) | np.uint64(r) << shift
    light = [whole(r, t) for r, _, t, n in rows if n[:1] == b"n"]
    hot = [(whole(r, t), np.frombuffer(n, np.uint32, offset=1)) for r, _, t, n in rows if n[:1] == b"h"]
    every = np.concatenate([np.empty(0, np.uint64), *light])
    every.sort()
    del light
    # shared: twice among the light entries, or hot anywhere
    known = np.concatenate([np.empty(0, np.uint64), *(t for t, _ in hot)])
    counts = np.concatenate([np.empty(0, np.uint32), *(c for _, c in hot)])
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], known]))
    if not len(shared):
        return
    count = np.searchsorted(every, shared, "right") - np.searchsorted(every, shared)
    count = count + np.bincount(np.searchsorted(shared, known), weights=counts, minlength=len(shared))
    del every, known, counts, hot
    step = np.minimum(np.log2(count) * 8, 255).astype(np.uint8)
    out = []
    for r, block, packed, numbers in rows:
        t = whole(r, packed)
        k = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
        keep = shared[k] == t
        if keep.any():
            head, low, df = np.uint32(r).tobytes(), _low(t[keep], width), step[k[keep]].tobytes()
            docs = np.frombuffer(numbers, np.uint16, offset=1)[keep].tobytes() if numbers[:1] == b"n" else b""
            out.append((block, _LIGHT if docs else _HOT, head + low + df + docs))
        if len(out) == 64:
            yield _answers(out)
            out = []
    if out:
        yield _answers(out)


def _width(log_ranges: int) -> int:
    """Bytes of a fingerprint within its range."""
    return (64 - log_ranges + 7) // 8


#: What a row for a block holds: shared fingerprints with a document for each; the block's documents;
#: who has its hot fingerprints; hot fingerprints' frequencies.
_LIGHT, _MEMBERS, _OWN, _HOT = range(4)


def _answers(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, kind, raw = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(raw, pa.binary())], ["block", "kind", "entries"])


def _answer(batches: Iterator[pa.RecordBatch], log_ranges: int) -> Iterator[pa.RecordBatch]:
    """All rows of a task's ranges; the rows that stay with blocks pass through."""
    take_up("answers")
    rows = []
    for batch in batches:
        for r, block, tokens, numbers in zip(*(c.to_pylist() for c in batch.columns)):
            if r == -1:
                yield _answers([(block, _MEMBERS, tokens + numbers)])
            elif r == -2:
                yield _answers([(block, _OWN, np.int64(len(tokens)).tobytes() + tokens + numbers)])
            else:
                rows.append((r, block, tokens, numbers))
    if rows:
        yield from _shared(rows, log_ranges)


def _need(size: np.ndarray) -> np.ndarray:
    """Shingles that a set shares with any set similar to it, at least."""
    return (PERCENT * size + 99) // 100


def _reduce(batches: Iterator[pa.RecordBatch], log_ranges: int) -> Iterator[pa.RecordBatch]:
    """Per block of a task: the sets that can have partners, with their shared shingles in global
    order, how many of these are in the prefix, and the largest frequency (eight times its log2) among those."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for block, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(block, [[], [], [], []])[kind].append(raw)
    for block in list(held):
        yield from _sets_of(*held.pop(block), log_ranges)


def _sets_of(light: list[bytes], members: list[bytes], own: list[bytes], hot: list[bytes], log_ranges: int) -> Iterator[pa.RecordBatch]:
    row, size = np.frombuffer(members[0], np.int64).reshape(2, -1)
    shift, width = np.uint64(64 - log_ranges), _width(log_ranges)
    low = (np.uint64(1) << shift) - np.uint64(1)

    def entries(raw: bytes, each: int) -> tuple[int, np.ndarray, np.ndarray]:
        high = int(np.frombuffer(raw, np.uint32, 1)[0])
        n = (len(raw) - 4) // each
        return n, _high(raw[4 : 4 + n * width], width) & low | np.uint64(high) << shift, np.frombuffer(raw, np.uint8, n, 4 + n * width)

    token, df, doc = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)], [np.empty(0, np.uint16)]
    for raw in light:
        n, t, f = entries(raw, width + 3)
        token.append(t)
        df.append(f)
        doc.append(np.frombuffer(raw, np.uint16, n, 4 + n * width + n))
    for raw in own:
        n = int(np.frombuffer(raw, np.int64, 1)[0]) // 8
        t, times = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
        _, tokens, steps = zip(*(entries(h, width + 1) for h in hot))
        tokens, steps = np.concatenate(tokens), np.concatenate(steps)
        order = np.argsort(tokens)
        f = steps[order][np.searchsorted(tokens[order], t)]
        token.append(np.repeat(t, times))
        df.append(np.repeat(f, times))
        doc.append(np.frombuffer(raw, np.uint16, offset=8 + 12 * n))
    token, df, doc = np.concatenate(token), np.concatenate(df), np.concatenate(doc)
    count = np.bincount(doc, minlength=len(row))
    alive = (size > 1) & (count >= _need(size))
    keep = alive[doc]
    token, df, doc = token[keep], df[keep], doc[keep]
    order = np.lexsort((token, df, doc))
    token, df, doc = token[order], df[order], doc[order]
    own = np.flatnonzero(alive)
    first = np.searchsorted(doc, own)
    last = np.searchsorted(doc, own, "right")
    # the set's own shingles come first in its order
    prefix = size[own] - _need(size[own]) + 1 - (size[own] - (last - first))
    out = []
    for d, a, b, m in zip(own.tolist(), first.tolist(), last.tolist(), prefix.tolist()):
        if m > 0:
            out.append((int(row[d]), int(size[d]), int(m), int(df[a + m - 1]), token[a:b].tobytes()))
    for k in range(0, len(out), 1024):
        part = list(zip(*out[k : k + 1024]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.int64()), pa.array(part[4], pa.binary())], ["row_id", "size", "prefix", "df", "tokens"])


def _subsets(prefix: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(prefix), 1)
    lo, hi = np.minimum(prefix[i], prefix[j]), np.maximum(prefix[i], prefix[j])
    return bytewords.mix(lo * _A + hi * _B) | np.uint64(1)


def _singles(prefix: np.ndarray) -> np.ndarray:
    return bytewords.mix(prefix) & ~np.uint64(1)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, steps = [], []
        for m, raw, step in zip(*(batch.column(k).to_pylist() for k in (2, 4, 5))):
            key = _singles(np.frombuffer(raw, np.uint64, m))
            key = key[(key >> np.uint64(1)) % np.uint64(LISTS) == np.uint64(0)]
            keys.append(key)
            steps.append(np.full(len(key), step, np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(steps))], ["key", "step"])


def _keys(boundary: int):
    """(key, row_id, size, left, heavy): pairs of the prefix for light sets, single shingles for heavy
    ones and for light ones that a heavy one may be similar to. left: shared shingles after the key's
    first one in the global order. last: a heavy set's key before this one, else 0."""
    near = (PERCENT * boundary) // 100

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            total = 0
            for row, size, m, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                t = np.frombuffer(raw, np.uint64)
                keys, after = [], []
                left = np.arange(len(t) - 1, -1, -1, dtype=np.int32)
                if size <= boundary:
                    p = t[: m + SUBSET - 1]
                    keys.append(_subsets(p))
                    after.append(left[np.triu_indices(len(p), 1)[0]])
                if size > boundary or size >= near:
                    keys.append(_singles(t[:m]))
                    after.append(left[:m])
                key = np.concatenate(keys)
                last = np.zeros(len(key), np.int64)
                if size > boundary:
                    # heavy sets have single keys only, in the global order
                    last[1:] = _signed(key)[:-1]
                for column, values in zip(columns, (key, np.full(len(key), row), np.full(len(key), size, np.int32), np.concatenate(after), np.full(len(key), size > boundary), last)):
                    column.append(values)
                total += len(key)
                if total > 200_000:
                    yield _entries(columns)
                    columns, total = [[] for _ in range(6)], 0
            if total:
                yield _entries(columns)

    return work


def _entries(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    key, *rest = map(np.concatenate, columns)
    return pa.RecordBatch.from_arrays([pa.array(_signed(key)), *map(pa.array, rest)], ["key", "row_id", "size", "left", "heavy", "last"])


def _sizes(size: Column) -> Column:
    """Steps of set sizes at which a boundary is looked for: at most some 100."""
    return F.floor(F.log2(size.cast("double")) * 4).cast("int")


def _met(keys: DataFrame) -> list:
    """By step: keys, and the pairs of entries that meet under one key when all sets up to the step
    take part and did not before."""
    # hashed by key alone, which serves both the counts and the window
    per = keys.repartition("key").groupBy("key", "step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("step"))
    more = (F.col("upto") * F.col("upto") - (F.col("upto") - F.col("n")) * (F.col("upto") - F.col("n"))).cast("double") / 2
    return per.withColumn("upto", upto).groupBy("step").agg(F.sum("n").alias("keys"), F.sum(more).alias("pairs")).collect()


def _sampled(steps: int):
    """(key, step) of the subsets of sets up to a step, of one in PROBES keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, m, raw, step in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5))):
                if step <= steps:
                    key = _subsets(np.frombuffer(raw, np.uint64, m + SUBSET - 1 if 8 * (m + SUBSET - 1) <= len(raw) else m))
                    key = key[key % np.uint64(PROBES) == np.uint64(1)]
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array([step] * len(key), pa.int32())], ["key", "step"])

    return work


def _boundary(sets: DataFrame) -> int:
    """The set size up to which keying by subsets costs less than scanning lists. A cost is a row per
    key and per pair of entries that meet under one, on either side: estimated from one in LISTS
    lists, and from one in PROBES subset keys over the sizes whose subsets are not already too many.
    Light sets just under the boundary need list keys too. The boundary moves work only; any gives
    the same links."""
    stepped = sets.withColumn("step", _sizes(F.col("size")))
    m = F.col("prefix").cast("double")
    rows = stepped.groupBy("step").agg(F.max("size").alias("top"), F.sum(m * (m + 1) / 2).alias("subsets")).orderBy("step").collect()
    lists = {r.step: r for r in _met(stepped.mapInArrow(_single, "key long, step int"))}
    total = LISTS * sum(r.keys + r.pairs for r in lists.values())
    count, last = 0.0, None
    for r in rows:
        count += r.subsets
        if count > total:
            break
        last = r.step
    if last is None:
        return 0
    subsets = {r.step: r for r in _met(stepped.mapInArrow(_sampled(last), "key long, step int"))}
    best, at, cost = total, 0, total
    for r in rows:
        if r.step > last:
            break
        cost += r.subsets
        cost += PROBES * subsets[r.step].pairs if r.step in subsets else 0
        cost -= LISTS * (lists[r.step].keys + lists[r.step].pairs) if r.step in lists else 0
        # sizes of at least PERCENT of the boundary lie in this step and the two before it
        near = LISTS * sum(lists[k].keys for k in range(r.step - 2, r.step + 1) if k in lists)
        if cost + near < best:
            best, at = cost + near, r.top
    return at


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the pairs of a task's cells, which come one after the other."""
    take_up("links")
    now, sets, pairs = None, {}, []
    for batch in batches:
        for cell, a, b, size, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != now:
                if pairs:
                    yield from _links(sets, pairs)
                now, sets, pairs = cell, {}, []
            if tokens is not None:
                sets[a] = size, tokens
            else:
                pairs.append((a, b))
    if pairs:
        yield from _links(sets, pairs)


def _links(sets: dict[int, tuple[int, bytes]], pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """By bitmaps over the cell's shingles: a pair's common ones are the bits that both have. Shingles
    are taken some at a time, so that the bitmaps stay small."""
    rows = list(sets)
    place = {r: i for i, r in enumerate(rows)}
    size = np.array([sets[r][0] for r in rows], np.int64)
    lists = [np.frombuffer(sets[r][1], np.uint64) for r in rows]
    known, code = np.unique(np.concatenate(lists), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), [len(t) for t in lists])
    del lists
    a = np.array([place[p[0]] for p in pairs])
    b = np.array([place[p[1]] for p in pairs])
    both = np.zeros(len(a), np.int64)
    width = max(64, (BITMAP // len(rows)) >> 6 << 6)
    order = np.argsort(code, kind="stable") if len(known) > width else np.arange(len(code))
    code, doc = code[order], doc[order]
    for first in range(0, len(known), width):
        i, j = np.searchsorted(code, (first, first + width)) if len(known) > width else (0, len(code))
        c = code[i:j] - first
        bits = np.zeros((len(rows), min(width, len(known) - first) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (doc[i:j], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
        chunk = max(1, (1 << 20) // bits.shape[1])
        for k in range(0, len(a), chunk):
            both[k : k + chunk] += np.bitwise_count(bits[a[k : k + chunk]] & bits[b[k : k + chunk]]).sum(1, dtype=np.int64)
    ok = np.flatnonzero(100 * both >= PERCENT * (size[a] + size[b] - both))
    if len(ok):
        names = np.array(rows, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[a[ok]]), pa.array(names[b[ok]])], ["a", "b"])


def candidates(sets: DataFrame) -> DataFrame:
    """(a, size_a, b, size_b), a < b: each pair of sets that share a key after which enough shingles are
    left. The first key that a similar pair shares is followed by all else that it has in common, so
    it passes; later keys need not. Where the keys before are the same too, the pair has met there
    already."""
    keys = sets.mapInArrow(_keys(_boundary(sets)), "key long, row_id long, size int, left int, heavy boolean, last long")
    keys = written(keys, "keys")
    x, y = keys.alias("x"), keys.alias("y")
    low, high = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.row_id") < F.col("y.row_id"))
    reach = F.least("x.left", "y.left") + 1
    fit = (low * 100 >= high * PERCENT) & (reach * (100 + PERCENT) >= (low + high) * PERCENT) & (((F.col("x.key") % 2) != 0) | F.col("x.heavy") | F.col("y.heavy"))
    new = (F.col("x.last") == 0) | (F.col("x.last") != F.col("y.last"))
    met = x.join(y, same & fit & new).select(F.col("x.row_id").alias("a"), F.col("x.size").alias("size_a"), F.col("y.row_id").alias("b"), F.col("y.size").alias("size_b"))
    return met.distinct()


def links(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: each similar pair of sets, once."""
    found = written(candidates(sets), "candidates")
    # pairs meet where the first partner of their second set is; counted before any b has a task
    placed = written(found.join(found.groupBy("b").agg(F.min("a").alias("lead")), "b"), "placed")
    sent = placed.select("lead", F.col("a").alias("row"), F.col("size_a").alias("size")).union(placed.select("lead", "b", "size_b")).distinct()
    sent = written(sent, "sent")
    sides = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / CELL_SHINGLES)).cast("long")
    side = sent.groupBy("lead").agg(sides.alias("side")).where("side > 1")
    part = lambda c: F.pmod(F.xxhash64(c), F.col("side"))
    one = F.coalesce("side", F.lit(1).cast("long"))
    # cells that share a number would only be checked together
    cell = lambda i, j: F.xxhash64("lead", i, j)
    wide = placed.join(side, "lead", "left").withColumn("side", one)
    asked = wide.select(cell(F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("cell"), "a", "b", F.lit(None).cast("int").alias("size"), F.lit(None).cast("binary").alias("tokens"))
    spread = sent.join(side, "lead", "left").withColumn("side", one).withColumn("own", part("row")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
    where = spread.select(cell(F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.col("row").alias("row_id")).distinct()
    given = where.join(sets.select("row_id", "size", "tokens"), "row_id").select("cell", F.col("row_id").alias("a"), F.lit(None).cast("long").alias("b"), "size", "tokens")
    return given.unionByName(asked).repartition("cell").sortWithinPartitions("cell").mapInArrow(_check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component. Each round points every node to
    its least neighbour or itself, follows the pointers to their ends by doubling, and contracts the
    edges; what is left of a near-clique after one round is a point."""
    rounds = []
    left = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    while left.limit(1).count():
        ends = left.union(left.select("y", "x")).groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least"))
        point = written(ends.select("node", F.least("node", "least").alias("label")), "pointers")
        while True:
            further = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
            point = written(point.join(further, "label").select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "pointers")
            moved = point.where("moved").limit(1).count()
            point = point.drop("moved")
            if not moved:
                break
        rounds.append(point)
        x, y = point.select(F.col("node").alias("x"), F.col("label").alias("px")), point.select(F.col("node").alias("y"), F.col("label").alias("py"))
        over = left.join(x, "x").join(y, "y").where("px != py")
        left = written(over.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "contracted")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = rounds[0]
    for point in rounds[1:]:
        further = point.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels


def _ranges(rows: DataFrame) -> int:
    """log2 of the number of ranges, which follows the amount of text, so that a range stays small."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(size // RANGE_BYTES).bit_length(), 4)


def classes(docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, id, size of its set, and its class: rep (row_id of its first
    row), members, least_id. Empty sets have no class."""
    kind = dict(docs.dtypes)[id_col]
    rows = texts(docs, id_col, text_col, row)
    with smaller_batches(docs.sparkSession):
        signed = written(rows.mapInArrow(signatures, f"row_id long, id {kind}, size int, sig binary"), "signatures")
    groups = written(signed.where("size > 0").groupBy("sig").agg(F.min("row_id").alias("rep"), F.count("*").alias("members"), F.min("id").alias("least_id")), "classes")
    return attach_groups(signed.withColumn("sig", F.when(F.col("size") > 0, F.col("sig"))), groups, "sig", "members").drop("sig")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of `docs`: row_id, its id, n_shingles, n_similar (other rows linked directly),
    component_id (smallest id reachable), component (its first class's row_id), rep and members (its
    class). `row` names the column of numbers that `docs` has, if it is `numbered`; else its ids and
    texts are written with numbers, since they are read several times."""
    docs = texts(docs, id_col, text_col, row) if row else numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = docs.select("row_id", "text")
    classed = written(classes(docs, "id", "text", "row_id"), "classed")
    skipped = written(classed.where("size = 0 or row_id != rep").select("row_id"), "skipped")
    own = without_rows(rows, skipped, "row_id").select("row_id", "text")
    log_ranges = _ranges(rows)
    sent = own.mapInArrow(_send(log_ranges), "range int, block long, tokens binary, numbers binary")
    # a range's rows meet in one task; the rows about blocks spread over all
    place = F.when(F.col("range") < 0, F.xxhash64("block")).otherwise(F.col("range").cast("long"))
    tasks = max((RANGE_BYTES << log_ranges) // TASK_BYTES, 4)
    answered = sent.repartition(tasks, place).mapInArrow(lambda batches: _answer(batches, log_ranges), "block long, kind int, entries binary")
    with smaller_batches(docs.sparkSession):
        sets = written(answered.repartition(tasks, "block").mapInArrow(lambda batches: _reduce(batches, log_ranges), "row_id long, size int, prefix int, df long, tokens binary"), "sets")
    found = written(links(sets), "links")
    reps = classed.where("row_id = rep").select("rep", "members", "least_id")
    both = found.union(found.select("b", "a"))
    near = both.join(reps.select(F.col("rep").alias("b"), "members"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("linked"))
    part = components(found)
    named = part.join(reps.select(F.col("rep").alias("node"), "least_id"), "node")
    names = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    facts = reps.join(near, "rep", "left").join(part.join(names, "label").withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.col("members").alias("n"), (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"),
        F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("label", "rep").alias("component"),
    )
    facts = written(facts, "facts")
    return attach_groups(classed, facts, "rep", "n").select(
        "row_id", F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"),
        F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component", "row_id").alias("component"), "rep", F.coalesce("members", F.lit(1).cast("long")).alias("members"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (null ids last), of equal ids
    the first row. Rows with empty sets all stay."""
    row = fresh(docs)
    rows = numbered(docs, row)
    found = written(similar(rows, id_col, text_col, row).where("n_similar > 0").select("row_id", F.col(id_col).alias("id"), "component"), "similar")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_id").alias("row"))
    first = found.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row_id"))
    gone = written(found.select("row_id").join(first, "row_id", "left_anti").withColumnRenamed("row_id", row), "dropped")
    return without_rows(rows, gone, row).drop(row)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "n_similar", "component_id")
