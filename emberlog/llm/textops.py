"""Numpy over batches of texts: words, lines and rolling hashes of many documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i below n."""
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(n, p, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any stretch of data: sum of byte values times powers of P, shifted to the stretch's start."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = powers(len(data) + 1)
        values = _BYTE[np.arange(256) | (((np.arange(256) >= 65) & (np.arange(256) <= 90)) * 32)] if lower else _BYTE
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words, by first word (fewer than n words: none)."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, _U)
    for k in range(n):
        out = out * _P + words[k : len(words) - n + 1 + k]
    return mix(out)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, before = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    before[order] = same[:-1]
    return twice, before


class Texts:
    """A few documents in one byte array, each followed by \\n."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=self.bounds[1:])

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches of bytes for which inside[byte] holds; \\n must not be inside."""
        m = np.zeros(len(self.data) + 2, np.int8)
        m[1:-1] = inside[self.data]
        step = np.diff(m)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(starts, self.bounds)))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.data == 10)
        return np.concatenate([[0], ends[:-1] + 1]), ends


def sliced(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of a batch with about most bytes of text (binary, null: empty)."""
    at, size, texts = 0, 0, []
    column = batch.column(batch.schema.get_field_index(text))
    for k in range(batch.num_rows):
        x = column[k].as_py() or b""
        if texts and size + len(x) > most:
            yield batch.slice(at, k - at), texts
            at, size, texts = k, 0, []
        texts.append(x)
        size += len(x) + 1
    if texts:
        yield batch.slice(at), texts


def by_slice(f: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES):
    """A function for mapInArrow that applies f to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, text, most):
                yield f(part, texts)

    return run
