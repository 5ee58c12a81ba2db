"""Vectorised word scanning over the byte buffers of Arrow string columns.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; these bytes never occur inside a UTF-8 sequence, so
bytes can be cut without decoding. Hashes are 64-bit polynomial hashes of the bytes, finished by a mixer,
so equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def _pow(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES // 2), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[s:e]`` for each range, in constant time a range."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _pow(_BASE, len(values)), out=total[1:])
    inverse = _pow(_BASE_INV, len(values) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: byte ranges, hashes and each text's span of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
        """``space``: for each byte, whether it separates words (ASCII bytes only)."""
        self.data, self.offsets = data, offsets
        word = ~space[data]
        inner = np.zeros(len(data) + 1, bool)
        inner[1:-1] = word[1:] & word[:-1] if len(data) else inner[1:-1]
        inner[offsets] = False
        body = np.append(word, False)
        self.starts = np.flatnonzero(body & ~inner)
        last = ~inner[1:] & word
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = range_hash(_BYTE[data], self.starts, self.ends)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, hash) of every run of ``size`` words that lies in one text."""
        n = np.maximum(self.counts - size + 1, 0)
        docs = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(docs)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[:-1], n)
        return docs, at, range_hash(self.hashes, at, at + size)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset or len(texts) == 0:
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())]) if len(texts) else texts
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into blocks of about BLOCK_BYTES of text (a longer text stands alone): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = _buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows take ``counts`` of ``values`` in turn."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
