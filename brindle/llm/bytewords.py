"""Words of Arrow text columns, cut and hashed by numpy on the UTF-8 bytes, a few MB at a time.

Word classes are sets of bytes: bytes of 0x80 and above belong to characters outside ASCII, so an
ASCII class cuts the bytes just where it cuts the characters. Nothing runs per word in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 21

#: Bytes beyond which a word is hashed by BLAKE2b instead of eight bytes a step.
LONG = 1024

_STEP = np.uint64(0x9E3779B97F4A7C55)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: `[^\\x20\\x09-\\x0D]+`
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


class Words(NamedTuple):
    """Words of documents lo..hi-1 of a batch. Word i is bytes start[i]:end[i] of `data`; those of
    document lo+d are bounds[d]:bounds[d+1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray
    prefix_hash: list


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (of length rows + 1, from 0) of a string array; null counts as empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to `limit` bytes together, or one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def _hashes(data: np.ndarray, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each eight bytes of a word are mixed into what came before. Words of one size of up to eight
    bytes never share a hash; any other two do with a chance of 2^-64, for no step is linear."""
    h = mix(mix(size.astype(np.uint64)) ^ (lanes[start] & _MASKS[np.minimum(size, 8)]))
    at = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(at):
        h[at] = mix(h[at] * _STEP + (lanes[start[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        word = data[start[i] : start[i] + size[i]]
        h[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = LOWER, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """Blocks of words with their 64-bit hashes. `is_word` may hold several classes (0 is none): a
    word is a run of one class. For each n of `prefixes`, up to 8, prefix_hash has the hashes
    of the words' first n bytes (0 where the word is not longer than n)."""
    for lo, hi in spans(offsets):
        d = data[offsets[lo] : offsets[hi]]
        off = offsets[lo : hi + 1] - offsets[lo]
        kind = is_word[d].view(np.uint8)
        before = np.zeros(len(d), np.uint8)
        after = np.zeros(len(d), np.uint8)
        before[1:] = kind[:-1]
        after[:-1] = kind[1:]
        inner = off[(off > 0) & (off < len(d))]
        before[inner] = 0
        after[inner - 1] = 0
        start = np.flatnonzero((kind > 0) & (before != kind))
        end = np.flatnonzero((kind > 0) & (after != kind)) + 1
        folded, size = fold[d], end - start
        lanes = _lanes(folded)
        h = _hashes(folded, lanes, start, size)
        pre = [np.where(size > n, mix(mix(np.full(1, n + 1_000_003, np.uint64)) ^ (lanes[start] & _MASKS[n])), np.uint64(0)) for n in prefixes]
        yield Words(lo, hi, d, off, start, end, np.searchsorted(start, off), h, pre)


def word_hash(word: bytes) -> int:
    """The hash that `words` gives to one word (already folded)."""
    arr = np.frombuffer(word, np.uint8)
    got = next(words(arr, np.array([0, len(word)], np.int64), np.ones(256, bool), SAME))
    return int(got.hash[0])
