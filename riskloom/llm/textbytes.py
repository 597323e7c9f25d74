"""Words and shingles of whole Arrow text columns, hashed without Python loops over words.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 keeps these
bytes for themselves, so working on bytes is exact. Hashes have 64 bits: a
polynomial with random byte values modulo 2**64, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes hashed at a time; bounds the working memory whatever the batch holds.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is no letter or digit: a coarser cut for bag-of-words features.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_powers = np.ones(1, _U)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, _U)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; nulls count as empty text.

    A chunk holds about CHUNK_BYTES, or one longer text.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + CHUNK_BYTES, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (rows + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, head: int | None = None) -> np.ndarray:
    """A 64-bit hash per word, or of its first ``head`` bytes; ``fold`` lower-cases A-Z only."""
    if not len(starts):
        return np.zeros(0, _U)
    values = _VALUES[_FOLD[data] if fold else data]
    lengths = ends - starts if head is None else np.minimum(ends - starts, head)
    power = _pow(int(lengths.max()))
    # the position of each byte after the last word's start; only bytes of (the head of) a word count
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    limit = np.zeros(len(data), np.int64)
    limit[starts[0] :] = np.repeat(lengths, np.diff(np.append(starts, len(data))))
    inside = place < limit
    values = values * power[np.where(inside, place, 0)]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has its whole sequence as one shingle; a row without
    words has none.
    """
    odd = np.random.default_rng(width).integers(1, 2**62, width, dtype=np.uint64) * _U(2) + _U(1)
    n = len(words)
    rolled = np.zeros(n, _U)
    for k in range(width):
        rolled[: n - k] += words[k:] * odd[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            part = words[a:b]
            s = mix(np.array([np.sum(part * odd[: b - a], dtype=_U) + _U(b - a)], _U))
        else:
            s = np.zeros(0, _U)
        out.append(s)
    return out


def shingle_sets(text: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of every row, in order."""
    for _, data, off in text_chunks(text):
        starts, ends, first = word_bounds(data, off)
        yield from shingle_hashes(word_hashes(data, starts, ends), first, width)
