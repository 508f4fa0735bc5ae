"""Vectorised hashing of bytes, words and shingles inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; a longer text is taken whole.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche, one to one on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random word for each byte, so that the rolling sums below have no structure of their own.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Rolling:
    """Hashes of any substrings of a byte array from one pass of prefix sums; equal substrings have equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[data] * up[: len(data)], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each [start, stop), lengths told apart."""
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, np.bool_)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): hashes of all words of the texts in order, A-Z lower-cased, and for each text where its words end.

    Words are the runs between white space (space, tab to carriage return) of `data`; a word never crosses texts.
    """
    return sized_words(data, offsets)[:2]


def sized_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the bytes of each word."""
    low = _LOWER[data]
    solid = ~_GAP[low]
    first = np.zeros(len(data) + 1, np.bool_)
    first[offsets[offsets <= len(data)]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | first[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Rolling(low).of(start, stop), np.searchsorted(start, offsets[1:]), stop - start


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Distinct hashes, ascending, of each text's n-word shingles; a shorter text's whole sequence counts as one."""
    for data, offsets in pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        hashes, ends = words(data, offsets)
        at = 0
        for end in ends:
            w = hashes[at:end]
            at = end
            if len(w) == 0:
                yield w
                continue
            m = min(n, len(w))
            h = np.full(len(w) - m + 1, m, np.uint64)
            for k in range(m):
                h = mix(h + w[k : len(w) - m + 1 + k])
            yield np.unique(h)


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in order as (bytes, offsets), about PIECE bytes at once."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
            size += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64)
        at = to


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list array of numpy arrays."""
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
