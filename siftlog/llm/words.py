"""Words and word n-grams of whole Arrow batches as 64-bit hashes.

The functions work on the UTF-8 bytes of a column of texts, so no Python string
is made.  Words are runs of word bytes, A-Z are lower-cased, a word never
crosses a document.  Memory is a small multiple of ``CHUNK_BYTES`` or of the
longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18         # texts are worked on in runs of about this many bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, dtype=bool)                       # everything but the six ASCII white-space bytes
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)                       # ASCII letters and digits, all other alphabets
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    _, at = text_bytes(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield start, end
        start = end


class Words:
    """Words of some texts: ``hash``, first byte ``begin``, byte after the last ``end``, text number ``doc``."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray = SPACED):
        self.raw, self.at = text_bytes(texts)
        n = len(self.raw)
        self.docs = len(self.at) - 1
        inside = word_bytes[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        power, inverse = _powers_to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.begin]) * inverse[self.begin])
        self.doc = (np.searchsorted(self.at, self.begin, side="right") - 1).astype(np.int64)
        self.per_doc = np.bincount(self.doc, minlength=self.docs)
        self.first_word = np.concatenate([[0], np.cumsum(self.per_doc)])      # word range of each text


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (by doubling)."""
    mask = (1 << 64) - 1
    out, size, todo, done, have = None, 0, n, h, 1
    step = _STEP
    while todo:
        if todo & 1:
            if out is None:
                out, size = done, have
            else:           # runs of size followed by runs of have
                m = len(h) - size - have + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] * np.uint64(pow(_STEP, have, 1 << 64)) + done[size:size + m]
                size += have
        todo >>= 1
        if todo:
            m = len(h) - 2 * have + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            done = done[:m] * np.uint64(step) + done[have:have + m]
            have, step = have * 2, step * step & mask
    return mix(out)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs at every word, and which of them lie within one text."""
    g = rolling(w.hash, n)
    if not len(g):
        return g, np.zeros(0, bool)
    return g, w.doc[n - 1:] == w.doc[:len(g)]


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum (``best`` is the numpy ufunc) of every run of ``width`` values."""
    out, have = values, 1
    while have < width:
        move = min(have, width - have)
        if len(out) <= move:
            return out[:0]
        out = best(out[:-move], out[move:])
        have += move
    return out


def find(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` that occur in the sorted ``table``, and where."""
    if not len(table) or not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    bits = np.zeros(1 << 20, bool)
    low = np.uint64((1 << 20) - 1)
    bits[table & low] = True
    near = np.flatnonzero(bits[values & low])
    at = np.searchsorted(table, values[near])
    at[at == len(table)] = 0
    hit = table[at] == values[near]
    return near[hit], at[hit]
